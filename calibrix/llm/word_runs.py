"""Periodic runs of words: maximal stretches that repeat with a period, and the text with each kept once.

Words are the stretches of bytes other than space and \\t to \\r, compared as bytes. A run is a stretch of words with smallest
period q (words q apart are equal) of at least ``max(6, 4 * q)`` words that can't be extended on either side. Every run has
Lyndon roots: factors of length q that are the longest Lyndon words at their place in one of the two orders of the words
(numbers ascending or descending). So it is enough to know those longest Lyndon words:

1. ``lyndon_array``: phase one of Baier's suffix sorter. Suffixes are grouped by their first word; groups are taken from the
   highest down, each of its suffixes points at the last suffix before it in a lower group, and suffixes so pointed at move
   to a new group right above their own, whose context grows by the pointing group's. When a group is taken its context is
   the longest Lyndon word at its suffixes. It is run under both orders.
2. ``runs_between``: each root is extended by longest common extensions to both sides, from tables of the ranks of all
   factors of 1, 2, 4, ... words (exact, no hashes), for all roots at once. Extensions of 4 periods are runs.

Before, ``stretches`` cuts the text where no run can be: in a run of at least ``max(6, 4 * q)`` words each three neighbouring
words occur three times or more, so words that no such triple joins can't be in one run. What is cut off has no run, and no run
changes by it (a word that would extend a run would be in it).

Nulls: a null text has no words; its row has no runs and an empty collapsed text, rows with a null id as well. Empty and
blank texts likewise. A long text is handled whole, in memory in proportion to its words times the logarithm of the longest
repetitive stretch. Each row is handled by itself: repeated rows give equal rows, equal words tie by being one word, an
empty table gives an empty result. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import map_batches, utf8

# Fixed values of what counts as a run: words, and periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)

Run = tuple[int, int, int]
Edit = Callable[[object, list[bytes]], list[bytes]]


def lyndon_array(word: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there (phase one of Baier's suffix sorter)."""
    n = len(word)
    symbols = sorted(set(word))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in word]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))  # the group under each, -1 under the lowest
    above = [*range(1, len(symbols)), -1]
    taken, previous, longest = [False] * n, [-1] * n, [1] * n
    g = len(symbols) - 1
    while g >= 0:
        size, pointed = context[g], {}
        for i in sorted(m for m in members[g] if group[m] == g):
            # Places in groups above, and this group's own to the left, hide those they point over.
            p = i - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            taken[i], previous[i], longest[i] = True, p, size
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moved.setdefault((-times, group[p]), []).append(p)
        # Most pointed at first: what follows is put between the old group and those.
        for times, old in sorted(moved):
            new, up = len(members), above[old]
            places = moved[times, old]
            members.append(places)
            context.append(context[old] - times * size)
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in places:
                group[p] = new
        members[g] = []
        g = below[g]
    return longest


class Extensions:
    """Longest common extensions, from the ranks of all factors whose length is a power of two."""

    def __init__(self, ids: np.ndarray):
        self.n, self.ranks = len(ids), [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            r = self.ranks[-1]
            pairs = r[: self.n - 2 * width + 1] * self.n + r[width : self.n - width + 1]
            distinct, inverse = np.unique(pairs, return_inverse=True)
            if len(distinct) == len(pairs):  # no longer factor occurs twice
                break
            self.ranks.append(inverse)
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, x, y = self.ranks[k], a + out, b + out
            fits = np.flatnonzero(y < len(r))
            out[fits[r[x[fits]] == r[y[fits]]]] += 1 << k
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b`` (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, x, y = self.ranks[k], a - out - (1 << k), b - out - (1 << k)
            fits = np.flatnonzero(x >= 0)
            out[fits[r[x[fits]] == r[y[fits]]]] += 1 << k
        return out


def runs_between(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """``start, length, period`` of every run of a sequence of numbers, a row each, by start and period; of 3 periods or more."""
    n, found, extend = len(ids), [], None
    order = np.unique(ids, return_inverse=True)[1]
    for sequence in (order, order.max(initial=0) - order):
        period = np.array(lyndon_array(sequence.tolist()), np.int64)
        at = np.flatnonzero(min_periods * period <= n)
        at = at[at + period[at] < n]
        # A run's first root but one at its very start is followed by a period more, at least.
        at = at[order[at] == order[at + period[at]]]
        if not len(at):
            continue
        extend = extend or Extensions(order)
        q = period[at]
        start = at - extend.left(at, at + q)
        length = at + q + extend.right(at, at + q) - start
        found.append(np.stack([start, length, q], 1)[length >= np.maximum(min_length, min_periods * q)])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and one past the last place of the stretches outside which there's no run of 6 words and 4 periods."""
    todo = [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n < MIN_LENGTH:
            continue
        part = np.unique(ids[lo:hi], return_inverse=True)[1] if lo or hi < len(ids) else ids
        pairs = np.unique(part[:-1] * n + part[1:], return_inverse=True)[1]
        triple, times = np.unique(pairs[:-1] * n + part[2:], return_inverse=True, return_counts=True)[1:]
        often = times[triple] >= 3
        joined = np.zeros(n + 1, bool)  # joined[i]: place i - 1 with place i
        joined[1 : n - 1] |= often
        joined[2:n] |= often
        change = np.flatnonzero(np.diff(joined.view(np.int8)))
        for a, b in zip(change[::2].tolist(), (change[1::2] + 1).tolist(), strict=True):
            if (a, b) == (0, n):
                yield lo, hi
            else:
                todo.append((lo + a, lo + b))


def runs_of(words: list[bytes]) -> list[Run]:
    """Start, length and period of every run of ``words``, by start and period."""
    n, number = len(words), {}
    ids = np.fromiter(map(number.setdefault, words, range(n)), np.int64, n)
    if len(number) == n:
        return []
    out = []
    for lo, hi in stretches(ids):
        out += [(lo + s, length, q) for s, length, q in runs_between(ids[lo:hi]).tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run has behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: each row's runs (array of start, length, period by start, then period) and its words
    without the repetitions, a space between them. ``edit(id, words)`` may change a row's words before (and gets the id)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("collapsed", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        sizes, ends, found, texts = [], [0], [], []
        for doc_id, x in zip(ids, batch.column(1), strict=True):
            words = x.as_buffer().to_pybytes().split()
            if edit:
                words = edit(doc_id, words)
            runs = runs_of(words)
            sizes.append(len(words))
            found += runs
            ends.append(len(found))
            texts.append(b" ".join(collapsed(words, runs)))
        parts = np.array(found, np.int64).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                                           pa.array(texts, pa.binary())], schema.names)

    return map_batches(src, run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent (ties: first start, then period) and SHA-256 digests, of ``periodic_runs``."""
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
                  "if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The edit of the query's contract: for a tenth of the ids the words from some place on repeat what starts there."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
