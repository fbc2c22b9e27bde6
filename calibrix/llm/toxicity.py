"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words (ASCII letters lower-cased, punctuation around them dropped) and the
words' first 4, 5 and 6 code points, hashed into ``BUCKETS`` buckets. The machine scores

    logit = b + sum_i w_i + sum_{i<j} <v_i, v_j>

over the document's buckets: pairs of terms that matter only together, such as an insult and the mention of a
group, get weight by their factors, which linear weights can't give.

It is fitted on a bounded sample of labelled rows: per class the first ``max_positive`` / ``max_negative`` rows
in the order of a hash of their id, among rows that aren't held out. A bucket takes part if its document count
is at least 3 and its chi-square statistic in the sample reaches ``MIN_CHI2``, or, for a term that matters only in a
pair, if the statistic among the documents of such a bucket reaches ``MIN_JOINT``, or that of a pair exceeds its terms' own by
``MIN_PAIR`` (tested for all pairs of the ``PAIR_TERMS`` terms in the most documents). The sample ends before its documents have more than
``max_terms`` different terms in all, counted per document, so that very long texts don't fill the driver. Scoring covers every row, each
text as a whole.

Nulls: rows with a null id or label aren't learnt from; a null text scores as the empty text. An id with several
labels counts as toxic if any is 1. Repeated rows score alike. Without labels of both classes to learn from
every score is 0. Empty tables give empty results. ``toxicity`` reads id and text only, ``drop_toxic`` keeps
every column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import Remembered, map_batches, slices, unused, utf8, word_blocks
from calibrix.sources.files import written

BUCKETS, FACTORS, EPOCHS, MIN_CHI2 = 1 << 20, 8, 30, 20.0
# Higher, as each term is tested with every bucket of the first kind; or with every other of PAIR_TERMS.
MIN_JOINT, MIN_PAIR, PAIR_TERMS = 30.0, 45.0, 1000
# Rows of the sample by label, and different terms of all its documents together.
MAX_POSITIVE, MAX_NEGATIVE, MAX_TERMS = 3000, 6000, 20_000_000
THRESHOLD = 0.7
# Words whose features a task remembers, twice at most.
WORDS = 100_000
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_/\\+=~`^@"


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word and of its prefixes; none for mere punctuation."""
    word = word.strip(_EDGE)
    if not word:
        return []
    text = word.decode("utf-8", "replace")
    terms = [b"w" + word] + [b"p%d" % n + text[:n].encode() for n in (4, 5, 6) if len(text) >= n]
    return [xxhash.xxh32_intdigest(t) % BUCKETS for t in terms]


def document_words(text: bytes) -> set[bytes]:
    return set().union(*(set(words) for words in word_blocks(text.lower())))


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' features one after the other, and which document each is of."""
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), of


@dataclass
class FactorizationMachine:
    """Weights of the buckets that take part."""

    index: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    fitted: bool = True

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """For documents given as arrays of feature numbers."""
        flat, of = joined(docs)
        each, total, squares = self.factors[flat], np.zeros((len(docs), self.factors.shape[1])), np.zeros(len(docs))
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(of, each[:, k], len(docs))
        squares = np.bincount(of, (each**2).sum(1), len(docs))
        return self.bias + np.bincount(of, self.linear[flat], len(docs)) + 0.5 * ((total**2).sum(1) - squares)

    def gradient(self, docs: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the documents' mean log loss, in the bias, the linear weights and the factors."""
        err = (self.scores(docs) - labels) / max(1, len(docs))
        flat, of = joined(docs)
        each, size = self.factors[flat], len(self.linear)
        dv = np.empty_like(self.factors)
        for k in range(dv.shape[1]):
            total = np.bincount(of, each[:, k], len(docs))
            dv[:, k] = np.bincount(flat, err[of] * (total[of] - each[:, k]), size)
        return float(err.sum()), np.bincount(flat, err[of], size), dv

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(docs))
        return 1 / (1 + np.exp(-np.clip(self.logits(docs), -30, 30)))


def _chi2(a: np.ndarray, df: np.ndarray, pos: int, n: int) -> np.ndarray:
    """Chi-square with the label of terms in ``df`` of ``n`` documents, ``a`` of them among the ``pos`` toxic ones."""
    b, c = df - a, pos - a
    d = (n - pos) - b
    return n * (a * d - b * c) ** 2 / np.maximum(1e-9, df * (n - df) * pos * (n - pos))


def _joint(strong: np.ndarray, inverse: np.ndarray, at: np.ndarray, labels: np.ndarray, size: int, least: float) -> np.ndarray:
    """Terms whose chi-square among the documents that have one of the ``strong`` terms reaches ``least``."""
    out, is_strong = np.zeros(size, bool), np.zeros(size, bool)
    is_strong[strong] = True
    where = np.flatnonzero(is_strong[inverse])  # of the strong terms only, which are few
    where = where[np.argsort(inverse[where], kind="stable")]
    doc = np.searchsorted(at, where, "right") - 1
    first = np.searchsorted(inverse[where], [strong, strong + 1])
    terms = lambda docs: np.concatenate([inverse[at[i] : at[i + 1]] for i in docs])
    for s, lo, hi in zip(strong, *first, strict=True):
        having = doc[lo:hi]
        toxic = having[labels[having] == 1]
        n, pos = len(having), len(toxic)
        if n < least or not 0 < pos < n:  # the statistic is n at most
            continue
        df = np.bincount(terms(having), minlength=size).astype(float)
        out |= (_chi2(np.bincount(terms(toxic), minlength=size), df, pos, n) >= least) & (df >= 3) & (n - df >= 3)
    return out


def _pure_pairs(inverse: np.ndarray, at: np.ndarray, labels: np.ndarray, chi2: np.ndarray, df: np.ndarray, least: float, most: int) -> np.ndarray:
    """Terms of a pair whose statistic as one term exceeds those of both its terms by ``least``, among the ``most`` terms in the most documents: a
    pair of which neither term is associated with the label by itself. One product of documents by terms for all pairs."""
    n, pos, out = len(labels), int(labels.sum()), np.zeros(len(df), bool)
    usual = np.argsort(-df, kind="stable")[:most]
    usual = usual[(df[usual] >= 3) & (df[usual] <= n - 3)]
    place = np.full(len(df), -1, np.int32)
    place[usual] = np.arange(len(usual))
    has = np.zeros((n, len(usual)), np.float32)
    for i in range(n):
        mine = place[inverse[at[i] : at[i + 1]]]
        has[i, mine[mine >= 0]] = 1
    both = has.T @ has
    has[labels != 1] = 0
    toxic = has.T @ has
    gain = _chi2(toxic.astype(float), both.astype(float), pos, n) - np.maximum(chi2[usual][:, None], chi2[usual][None, :])
    gain[(both < 3) | (n - both < 3)] = 0
    np.fill_diagonal(gain, 0)
    out[usual[(gain >= least).any(1)]] = True
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, rate: float = 0.1,
        decay: float = 3e-4, min_chi2: float = MIN_CHI2, seed: int = 7,
        min_joint: float = MIN_JOINT, min_pair: float = MIN_PAIR, pair_terms: int = PAIR_TERMS) -> FactorizationMachine:
    """A machine from arrays of distinct buckets and 0/1 labels, by AdaGrad on mini-batches."""
    n, pos = len(docs), int(labels.sum())
    if not n or not pos or pos == n:
        return FactorizationMachine({}, 0.0, np.zeros(0), np.zeros((0, factors)), False)
    at = np.cumsum([0, *map(len, docs)])
    flat = np.concatenate(docs).astype(np.int32)
    times = np.bincount(flat)
    buckets = np.flatnonzero(times)
    number = np.zeros(len(times), np.int32)
    number[buckets] = np.arange(len(buckets))
    inverse, df = number[flat], times[buckets].astype(float)
    del flat
    a = np.zeros(len(buckets))  # with the bucket and toxic
    for i in np.flatnonzero(labels):
        a[inverse[at[i] : at[i + 1]]] += 1
    chi2 = _chi2(a, df, pos, n)
    strong = (chi2 >= min_chi2) & (df >= 3)
    used = strong | _joint(np.flatnonzero(strong), inverse, at, labels, len(buckets), min_joint)
    used = np.flatnonzero(used | _pure_pairs(inverse, at, labels, chi2, df, min_pair, pair_terms))
    index = {int(buckets[i]): k for k, i in enumerate(used)}
    place = np.full(len(buckets), -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [z[z >= 0] for z in (place[inverse[at[i] : at[i + 1]]] for i in range(n))]
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(index, float(np.log(pos / (n - pos))), np.zeros(len(used)),
                             rng.normal(0, 0.01, (len(used), factors)))
    g_w, g_v, g_b = np.full(len(used), 1e-6), np.full((len(used), factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            db, dw, dv = m.gradient([rows[i] for i in batch], labels[batch])
            dw, dv = dw + decay * m.linear / len(batch), dv + decay * m.factors / len(batch)
            g_w += dw**2
            g_v += dv**2
            g_b += db**2
            m.linear -= rate * dw / np.sqrt(g_w)
            m.factors -= rate * dv / np.sqrt(g_v)
            m.bias -= rate * db / np.sqrt(g_b)
    return m


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of its id as text leaves 1 on division by 3."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE,
                    max_terms: int = MAX_TERMS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of the sample: at most ``max_positive + max_negative`` rows and ``max_terms`` buckets reach the driver."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(~held_out("id") & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    # Ids that the documents have, so that the bound counts rows with a text.
    known = known.join(docs.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi")
    order = F.xxhash64(F.col("id").cast("string"))
    some = [known.where(F.col("y") == y).orderBy(order, "id").limit(n) for y, n in ((1, max_positive), (0, max_negative))]
    spark = docs.sparkSession
    ids = [(r["id"], r["y"]) for s in some for r in s.collect()]
    if not ids:
        return [], np.zeros(0, np.int64)
    wanted = spark.createDataFrame(ids, T.StructType([known.schema["id"], T.StructField("y", T.IntegerType())]))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    texts = texts.join(F.broadcast(wanted), "id")  # at most max_positive + max_negative rows
    schema = T.StructType([texts.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("b", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in batch.column("text"):
            found = {b for w in document_words(x.as_buffer().to_pybytes()) for b in word_buckets(w)}
            out.append(np.array(sorted(found), "<i4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(out, pa.binary())], schema.names)

    rows = map_batches(texts, run, schema).groupBy("id").agg(F.max("y").alias("y"), F.min("b").alias("b"))
    rows = written(rows.withColumn("size", F.octet_length("b") / 4), "toxicity_sample")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id"))  # a bounded number of rows
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= max_terms).select("id", "y", "b").toArrow().sort_by("id")
    buckets = [np.frombuffer(x, "<i4") for x in rows.column("b").to_pylist()]
    return buckets, rows.column("y").to_numpy().astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, **options) -> FactorizationMachine:
    return fit(*training_sample(docs, labels, **options))


def _scorer(model: FactorizationMachine):
    """Scores of a column of texts; the features of a word are looked up once per task."""
    features = Remembered(lambda word: tuple(model.index[b] for b in word_buckets(word) if b in model.index), WORDS)

    def score(column: pa.Array) -> np.ndarray:
        docs = []
        for x in column:
            words = document_words(x.as_buffer().to_pybytes())
            docs.append(np.array(sorted({f for w in words for f in features[w]}), np.int64))
        return model.scores(docs)

    return score


def toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS rows of weights

    schema = T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        score = _scorer(shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], schema.names)

    out = src.mapInArrow(run, schema)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is at least ``threshold``."""
    at, text = len(docs.columns), unused("__text", docs.columns)
    src = docs.withColumn(text, utf8(F.col(f"`{text_col}`")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(shared.value)
        for batch in slices(batches):
            keep = pa.array(score(batch.column(at)) < threshold)
            yield batch.filter(keep).select(range(at))

    return src.mapInArrow(run, docs.schema)
