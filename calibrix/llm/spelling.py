"""Spelling variants: words one inserted, deleted or replaced letter apart, found by a trie of letter counts.

A word's frequency vector counts its letters by group (``GROUPS``). A replaced letter takes one from a group and adds one to
another (or stays in its group), an inserted one adds one to a group. So the words near a word have vectors that exceed its
own by one in at most one group (the surplus) and fall short by one in at most one (the deficit). Words are arranged in a
trie by their length and the successive counts; a depth-first search from a word goes down the branches of its own count, and
spends the surplus and the deficit on branches of one more and one less, each once. Words at the leaves it reaches are verified.

Each pair of near words is looked for from one side: from the shorter word, or, of two words of a length, from the one with the
smaller vector, so that the surplus is spent before the deficit; words of one leaf meet by their order.

The trie is dealt out by its upper levels: a node of the trie (length and the first counts) is a key, a word is listed at
its own node, and sent as a search to the nodes that its budget reaches (``reached``). A node with more than ``limit`` bytes
of words and searches is divided further by the next levels, until all are small or the vector is used up; a leaf that is still larger is
dealt on to tiles of some of its words and some of its searches. So no task holds a large node, whatever the number
of words, and no pair is lost. Inside a node the search is vectorised: all searches go down the trie together.

``word_counts`` counts the words of whole texts (in tasks first, then by a shuffle), ``near_words`` finds the near words, and
``spelling_forms`` a word's form (the most frequent near word, if it is ``ratio`` times as frequent; ties: the smallest) and the
root at which following forms ends.

Words may have the letters of ``GROUPS`` only (as ``word_counts`` gives them); in ``near_words`` and ``spelling_forms`` a word with other
characters of Latin-1 is compared all the same (they count as one more group), beyond Latin-1 it is an error. Nulls: a null text has no words, a
null id is taken as the empty string in the drop hash, null words are left out. Empty and blank texts have no words, long texts are read whole. Words given
more than once count by the sum of their numbers. Empty tables give empty results. Only id and text (or word and n) are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import fresh_path
from calibrix.llm.common import slices, utf8

# Letter groups in the order of the trie's levels: frequent letters alone, first, as their counts divide the words best.
GROUPS = ["e", "n", "t", "a", "i", "o", "r", "h", "s", "u", "l", "c", "d", "m", "g", "p", "f", "b", "zk", "wy", "vx", "qj",
          "".join(map(chr, range(0xC0, 0xE0))), "".join(map(chr, range(0xE0, 0xF0))), "".join(map(chr, range(0xF0, 0x100)))]
LEVELS = len(GROUPS) + 1  # and one for whatever else is in Latin-1
_GROUP = np.full(256, LEVELS - 1, np.uint8)
for _g, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode("latin-1"))] = _g
_WORD = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
# Levels of the first keys, and by how many a node of more than LIMIT bytes (ROW_BYTES a row, and its word) is divided at a time.
FIRST_LEVELS, MORE_LEVELS, LIMIT, ROW_BYTES = 2, 2, 1_500_000, 16
# Distinct words that a task counts before it passes them on; leaves that are compared without going on down; letters compared at a time.
COUNTED, FEW_LEAVES, COMPARED = 200_000, 8, 2_000_000

# Where a search stands: it is the word itself, as listed; a search among words of its length with all its budget, with the surplus
# spent, with all spent; a search among words one longer, with only a surplus to spend.
LISTED, WHOLE, SURPLUS_SPENT, SPENT, LONGER = range(5)


# --- words ---

def words_of(doc_id: object, text: str, drop: int = 0) -> dict[str, int]:
    """Numbers of the words (runs of letters, A to Z lower-cased) of a text. If ``drop`` divides the crc32 of ``<id>:<word>``, the word loses
    the letter at that crc32 modulo its length (an edit with known answers; 0: none)."""
    found: dict[str, int] = {}
    for w in _WORD.findall(text):
        if len(w) >= MIN_LETTERS:
            found[w] = found.get(w, 0) + 1
    if not drop:
        return found
    out: dict[str, int] = {}
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in found.items():
        h = zlib.crc32(w.encode(), seed)
        if h % drop == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        if len(w) >= MIN_LETTERS:
            out[w] = out.get(w, 0) + n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, drop: int = 0) -> DataFrame:
    """``word, n``: words of ``MIN_LETTERS`` letters or more that occur ``min_count`` times or more in all texts."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))

    def run(batches):
        total: dict[str, int] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, n in words_of(doc_id, x.as_buffer().to_pybytes().lower().decode("utf-8", "replace"), drop).items():
                    total[w] = total.get(w, 0) + n
                if len(total) >= COUNTED:
                    yield flush()
                    total.clear()
        yield flush()

    found = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


# --- the trie ---

def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """The words' letter counts by group, a level a column."""
    groups = _GROUP[codes]
    return np.stack([(groups == g).sum(1, dtype=np.int32) for g in range(LEVELS)], 1)


def reached(counts: np.ndarray, state: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trie's nodes after the levels ``first`` to ``last`` that searches (or listed words) come to from a node before them: row numbers,
    the counts at these levels, and where the search stands then."""
    rows, at, levels = np.arange(len(counts)), counts[:, first:last], range(last - first)
    yield rows, at, state

    def stepped(goes: np.ndarray, *changes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        to = at[goes].copy()
        for level, by in changes:
            to[:, level] += by
        fine = (to >= 0).all(1)
        return goes[fine], to[fine]

    whole, longer, owing = (rows[state == s] for s in (WHOLE, LONGER, SURPLUS_SPENT))
    for i in levels:
        for goes, after in ((whole, SURPLUS_SPENT), (longer, SPENT)):
            some, to = stepped(goes, (i, 1))
            yield some, to, np.full(len(some), after)
        some, to = stepped(owing, (i, -1))
        yield some, to, np.full(len(some), SPENT)
        for j in levels[i + 1 :]:
            some, to = stepped(whole, (i, 1), (j, -1))
            yield some, to, np.full(len(some), SPENT)


_ROW = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("state", T.IntegerType()), T.StructField("word", T.BinaryType()),
                     T.StructField("n", T.LongType())])


def _big_endian(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as rows of bytes, four to a count, so that keys are in the vectors' order."""
    return np.ascontiguousarray(counts, ">u4").view(np.uint8).reshape(len(counts), -1)


def _rows(keys: np.ndarray, state: np.ndarray, batch: pa.RecordBatch, took: np.ndarray) -> pa.RecordBatch:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(keys.tobytes())])
    at = pa.array(took)
    return pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(state, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)],
                                      _ROW.names)


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and letter counts of the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield length, rows, vectors(letters([words[i] for i in rows], length))


def first_keys(words: DataFrame, levels: int) -> DataFrame:
    """``key, state, word, n``: words as listed and as searches, at the nodes after the length and the first ``levels`` levels."""

    def run(batches):
        for batch in slices(batches, 10_000):
            for length, rows, counts in _by_length(batch.column("word").to_pylist()):
                for start in (LISTED, WHOLE, LONGER):
                    head = np.full((len(rows), 1), length + (start == LONGER))
                    for some, at, state in reached(counts, np.full(len(rows), start), 0, levels):
                        if len(some):
                            yield _rows(_big_endian(np.hstack([head[some], at])), state, batch, rows[some])

    return words.select("word", "n").mapInArrow(run, _ROW)


def next_keys(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The same rows at the nodes ``last - first`` levels further down."""

    def run(batches):
        for batch in slices(batches, 10_000):
            if not batch.num_rows:
                continue
            states = batch.column("state").to_numpy()
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for _, mine, counts in _by_length(batch.column("word").to_pylist()):
                for some, at, state in reached(counts, states[mine], first, last):
                    if len(some):
                        yield _rows(np.hstack([keys[mine[some]], _big_endian(at)]), state, batch, mine[some])

    return rows.mapInArrow(run, _ROW)


def search(listed: np.ndarray, counts: np.ndarray, state: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of the trie of ``listed`` vectors (distinct, in lexicographic order, alike before ``level``) by the words
    with ``counts`` that stand at ``state``: search and leaf numbers that fit."""
    levels = listed.shape[1]

    def compared(lo: int, hi: int, q: np.ndarray, s: np.ndarray, at: int):
        gap = listed[lo:hi, None, at:] - counts[None, q, at:]
        up, down = gap == 1, gap == -1
        ups, downs = up.sum(2), down.sum(2)
        # What is left of the budget is all spent, or, of a whole one, nothing (words of one leaf).
        ok = ((gap == 0) | up | down).all(2) & (downs == np.where(s == WHOLE, ups, s == SURPLUS_SPENT))
        ok &= np.where(s == WHOLE, ups <= 1, ups == (s == LONGER)) & ((s != WHOLE) | (up.argmax(2) <= down.argmax(2)) if at < levels else True)
        leaf, found = np.nonzero(ok)
        return q[found], lo + leaf

    def below(lo: int, hi: int, q: np.ndarray, s: np.ndarray, at: int):
        if not len(q):
            return
        if hi - lo <= FEW_LEAVES or at == levels:
            for i in range(0, len(q), 20_000):
                yield compared(lo, hi, q[i : i + 20_000], s[i : i + 20_000], at)
            return
        branches = listed[lo:hi, at]
        ends = [0, *(np.flatnonzero(np.diff(branches)) + 1).tolist(), hi - lo]
        own = counts[q, at]
        for a, b in zip(ends, ends[1:], strict=False):
            c = branches[a]
            more = (own == c - 1) & ((s == WHOLE) | (s == LONGER))
            less = (own == c + 1) & (s == SURPLUS_SPENT)
            goes = np.flatnonzero((own == c) | more | less)
            before = s[goes]
            after = np.where(more[goes], np.where(before == WHOLE, SURPLUS_SPENT, SPENT), np.where(less[goes], SPENT, before))
            yield from below(lo + a, lo + b, q[goes], after, at + 1)

    yield from below(0, len(listed), np.arange(len(counts)), state, level)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words ``a`` and ``b`` (rows of codes, ``b`` as long or one longer) differ by one letter replaced or inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], 1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= a.shape[1]


class _Best:
    """Per word its number of near words, and the one of largest n (ties: the smallest word, as words are numbered in order)."""

    def __init__(self, size: int):
        self.count, self.n, self.other = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def add(self, word: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
        self.count += np.bincount(word, minlength=len(self.count))
        order = np.lexsort((other, -n, word))
        first = order[np.flatnonzero(np.diff(word[order], prepend=-1))]
        w, o, m = word[first], other[first], n[first]
        better = (m > self.n[w]) | ((m == self.n[w]) & (o < self.other[w]))
        self.n[w[better]], self.other[w[better]] = m[better], o[better]


def _expanded(found: Iterator[tuple[np.ndarray, np.ndarray]], ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Search numbers, places in the leaves' order and leaf numbers of ``found``, at most ``most`` (or a search's one) at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        q, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
        upto = np.cumsum(ends[leaf + 1] - ends[leaf])
        for lo in range(0, int(upto[-1]) if len(upto) else 0, most):
            at = np.arange(lo, min(lo + most, int(upto[-1])))
            k = np.searchsorted(upto, at, "right")
            yield q[k], ends[leaf[k] + 1] - (upto[k] - at), leaf[k]

    for q, leaf in found:
        held.append((q, leaf))
        size += int((ends[leaf + 1] - ends[leaf]).sum())
        if size >= most:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


_NEAR = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n_near", T.LongType()), T.StructField("near_n", T.LongType()),
                      T.StructField("near_word", T.BinaryType())])


def near_in_node(key: bytes, state: np.ndarray, words: list[bytes], n: np.ndarray) -> pa.Table:
    """Near words among the rows of a node: per word with any their number and the one of largest n."""
    length, level = int.from_bytes(key[:4], "big"), min((len(key) - 4) // 4, LEVELS)
    distinct = sorted(set(words))
    number = {w: i for i, w in enumerate(distinct)}
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    best, listed = _Best(len(distinct)), np.flatnonzero(state == LISTED)
    if len(listed):
        codes = letters([words[i] for i in listed], length)
        leaves, leaf = np.unique(vectors(codes), axis=0, return_inverse=True)
        in_order = np.argsort(leaf.ravel(), kind="stable")
        ends = np.searchsorted(leaf.ravel()[in_order], np.arange(len(leaves) + 1))
        codes, listed = codes[in_order], listed[in_order]
        for size, kind in ((length, (WHOLE, SURPLUS_SPENT, SPENT)), (length - 1, (LONGER, SPENT))):
            q = np.array([i for i in np.flatnonzero(np.isin(state, kind)) if len(words[i]) == size], np.int64)
            if not len(q):
                continue
            mine = letters([words[i] for i in q], size)
            counts = vectors(mine)
            for s, place, at in _expanded(search(leaves, counts, state[q], level), ends, max(1, COMPARED // max(1, length))):
                ok = near(mine[s], codes[place])
                s, place, at = s[ok], place[ok], at[ok]
                a, b = q[s], listed[place]
                # Words of one leaf meet from both sides: the search of the smaller one counts.
                once = (word[a] < word[b]) | (counts[s] != leaves[at]).any(1)
                a, b = a[once], b[once]
                if len(a):
                    best.add(word[a], word[b], n[b])
                    best.add(word[b], word[a], n[a])
    has = np.flatnonzero(best.count)
    return pa.Table.from_arrays([pa.array([distinct[i] for i in has], pa.binary()), pa.array(best.count[has]), pa.array(best.n[has]),
                                 pa.array([distinct[i] for i in best.other[has]], pa.binary())], _NEAR.names)


def _near_in_table(rows: pa.Table) -> pa.Table:
    return near_in_node(rows.column("key")[0].as_py(), rows.column("state").to_numpy(), rows.column("word").to_pylist(), rows.column("n").to_numpy())


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tiles(rows: DataFrame, large: DataFrame, limit: int) -> DataFrame:
    """Rows of large leaves, dealt out so that each chunk of words meets each chunk of searches in a node of its own."""
    parts = F.ceil(F.lit(2.0) * F.col("size") / limit).cast("int")
    chunk = F.pmod(F.xxhash64("word", "state"), F.col("parts")).cast("int")
    both = rows.join(large, "key").withColumn("parts", parts).withColumn("chunk", chunk)
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    listed = F.col("state") == LISTED
    tile = F.format_string("%012d%012d", F.when(listed, F.col("chunk")).otherwise(F.col("other")), F.when(listed, F.col("other")).otherwise(F.col("chunk")))
    return both.select(F.concat("key", tile.cast("binary")).alias("key"), "state", "word", "n")


def _nodes(words: DataFrame, limit: int) -> list[DataFrame]:
    """Rows whose nodes have at most ``limit`` bytes, or are tiles of a leaf."""
    rows, level, out = first_keys(words, FIRST_LEVELS), FIRST_LEVELS, []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.octet_length("word") + ROW_BYTES).alias("size"))
        large = _kept(sizes.where(F.col("size") > limit), "spelling_large")  # at most the rows' bytes / limit
        if large.isEmpty():
            return [*out, rows]
        out.append(rows.join(large, "key", "left_anti"))
        if level >= LEVELS:
            return [*out, _tiles(rows, large, limit)]
        last = min(LEVELS, level + MORE_LEVELS)
        rows = _kept(next_keys(rows.join(large, "key", "left_semi"), level, last), "spelling_nodes")
        level = last


def near_words(words: DataFrame, word_col: str = "word", n_col: str = "n", limit: int = LIMIT) -> DataFrame:
    """``word, n_near, near_word, near_n``: for words with any near word, how many, and the most frequent of them (ties: the smallest)."""
    rows = words.select(F.encode(F.col(f"`{word_col}`"), "ISO-8859-1").alias("word"), F.col(f"`{n_col}`").alias("n")).where("word is not null")
    rows = _kept(rows.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling_words")
    parts = [nodes.groupBy("key").applyInArrow(_near_in_table, _NEAR) for nodes in _nodes(rows, limit)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("w"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select(F.decode("word", "ISO-8859-1").alias("word"), "n_near", F.decode("best.w", "ISO-8859-1").alias("near_word"),
                        (-F.col("best.less")).alias("near_n"))


def spelling_forms(words: DataFrame, word_col: str = "word", n_col: str = "n", ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a row per word, with its most frequent near word if that is ``ratio`` times as frequent, and
    where following forms ends. Numbers grow by ``ratio`` with each step, so there are as many rounds as digits, at most."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    rows = words.select(F.col(f"`{word_col}`").alias("word"), F.col(f"`{n_col}`").alias("n")).where("word is not null")
    rows = _kept(rows.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling_counts")
    is_form = F.col("near_n") >= ratio * F.col("n")
    forms = rows.join(near_words(rows, limit=limit), "word", "left").select(
        "word", F.when(is_form, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n"))
    forms = _kept(forms, "spelling_forms")
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    steps, moving = links.select(F.col("word").alias("root"), F.col("root").alias("next")), links
    ended = []
    while not moving.isEmpty():
        both = _kept(moving.join(steps, "root", "left"), "spelling_roots")
        ended.append(both.where("next is null").select("word", "root"))
        moving = both.where("next is not null").select("word", F.col("next").alias("root"))
    roots = links.where("1 = 0")
    for e in ended:
        roots = roots.unionAll(e)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = 0) -> DataFrame:
    """``spelling_forms`` of the words of whole texts."""
    return spelling_forms(word_counts(docs, id_col, text_col, drop=drop))
