"""Quality rules: an ordered decision list learnt from labelled statistics, as Spark conditional expressions.

Statistics of a text (counts, and ratios of them) are computed once over the whole text. The learner covers the
documents of low quality by rules, one after the other. A rule is a conjunction of thresholds: it grows by the
condition with the highest information gain until it matches no document of good quality (on two thirds of the
sample), and is pruned from its end for precision (on the other third). It joins the list if it is precise enough
there, the documents it matches are set aside, and the next rule is learnt from the rest. The list becomes a chain
of ``when`` expressions over the statistics' columns, readable as it stands; what no rule matches is kept.

The sample is bounded: the first ``max_rows`` labelled rows in the order of a hash of their id. So is the list: at most ``max_rules`` rules of
``MAX_CONDITIONS`` conditions, whose thresholds are the values of a statistic in the sample, or ``THRESHOLDS`` quantiles of them where there are more.
Applying the list covers all rows, and texts of any length as a whole.

Nulls: a null text has no words (and fails the base rule); labels with a null id or value aren't learnt from, of an id's
several labels the lowest holds. Ties between conditions go to the first in order of name and threshold. Without both classes
no rule is learnt. Repeated rows give equal rows, empty tables empty results. Only id and text are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import map_batches, utf8

# Fixed values of the base rule and its statistics.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words",
          "n_same_words"]
# Rows of the sample; bounds of the list learnt from it.
MAX_ROWS, MIN_PRECISION, MAX_CONDITIONS, THRESHOLDS, MAX_RULES = 8000, 0.9, 4, 64, 32


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more; words given by number.

    Windows are compared exactly: windows of twice the length are pairs of windows, and each pair gets a number.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids, width = words.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)[1:]
        width += step
        again = counts[ids] > 1
        # A repeated window has repeated windows only: without such a run there is none.
        need = window - width + 1
        ends = np.concatenate([[0], np.cumsum(again)])
        if not (ends[need:] - ends[:-need] == need).any():
            return 0
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change) > 0).sum())


def counts(text: bytes) -> list[int]:
    """``COUNTS`` of a text's UTF-8 bytes."""
    words = text.split()
    n = len(words)
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    points = len(text) - points  # bytes that begin a code point
    white = len(text) - len(text.translate(None, _WHITE))
    kept = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, range(n)), np.int64, n)
    return [n, points - white, kept(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines), kept(bytes(range(65, 91))),
            kept(b"0123456789"), kept(b"!?"), len(number), int((ids[1:] == ids[:-1]).sum())]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``doc_id``, ``COUNTS`` and the columns ``keep``, one row per row of ``docs``."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], utf8(F.col(f"`{text_col}`")).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([counts(x.as_buffer().to_pybytes()) for x in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(rows[:, i]) for i in range(len(COUNTS))]], schema.names)

    return map_batches(src, run, schema)


def features() -> dict[str, Column]:
    """What the rules' conditions are about: ratios of the counts, 0 where the denominator is 0."""
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": ratio("word_chars", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
        "symbols_per_char": ratio("n_symbols", "word_chars"), "dup_lines_per_line": ratio("n_dup_lines", "n_lines"),
        "repeat_words_per_word": ratio("n_repeat_words", "n_words"), "upper_per_char": ratio("n_upper", "word_chars"),
        "digits_per_char": ratio("n_digits", "word_chars"), "marks_per_word": ratio("n_marks", "n_words"),
        "distinct_per_word": ratio("n_distinct_words", "n_words"), "same_per_word": ratio("n_same_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` or, if ``above``, ``feature > threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        c, t = F.col(self.feature), F.lit(self.threshold)
        return c > t if self.above else c <= t


Rule = tuple[Condition, ...]


def matches(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _candidates(x: dict[str, np.ndarray], thresholds: int) -> list[Condition]:
    out = []
    for name in sorted(x):
        values = np.unique(x[name])
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, thresholds + 2)[1:-1], method="lower")) if len(values) > thresholds else values[:-1]
        out += [Condition(name, above, float(t)) for t in cuts for above in (False, True)]
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, conditions: list[Condition], most: int = MAX_CONDITIONS) -> Rule:
    """The conjunction that FOIL's gain builds, until it covers no good document."""
    rule: Rule = ()
    held = {c: c.holds(x[c.feature]) for c in conditions}
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for c, h in held.items():
            both = inside & h
            p = int((both & bad).sum())
            if not p:
                continue
            q = int(both.sum())
            g = p * (np.log2(p / q) - np.log2(p0 / (p0 + n0)))
            if g > gain:
                best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & held[best]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, min_precision: float = MIN_PRECISION, thresholds: int = THRESHOLDS,
          max_rules: int = MAX_RULES) -> list[Rule]:
    """The decision list for ``bad`` documents; rows in ``prune`` judge the rules that the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    conditions = _candidates({k: v[~prune] for k, v in x.items()}, thresholds) if len(bad) else []
    while len(rules) < max_rules:
        g, p = left & ~prune, left & prune
        if not (bad & g).any() or (bad & g).all():
            break
        rule = grow({k: v[g] for k, v in x.items()}, bad[g], conditions)
        xp, yp, n = {k: v[p] for k, v in x.items()}, bad[p], int(p.sum())

        def worth(r: Rule) -> float:
            m = matches(r, xp, n)  # noqa: B023
            return (int((m & yp).sum()) - int((m & ~yp).sum())) / max(1, int(m.sum()))  # noqa: B023

        # From the longest on, the first that is best: dropping conditions must pay.
        tails = [rule[:k] for k in range(len(rule), 0, -1)]
        if not tails:
            break
        rule = max(tails, key=worth)
        m = matches(rule, xp, n)
        precise = int((m & yp).sum()) >= min_precision * max(1, int(m.sum()))
        hit = matches(rule, {k: v[left] for k, v in x.items()}, int(left.sum()))
        if not precise or not (bad[left] & hit).any():
            break
        if not m.any():  # the third for pruning has nothing to say: what the rule grew from decides
            if (hit & ~bad[left]).any():
                break
        rules.append(rule)
        left[np.flatnonzero(left)[hit]] = False
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list matches, as ordered conditional expressions."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              max_rows: int = MAX_ROWS, **options) -> list[Rule]:
    """The decision list from the first ``max_rows`` labelled documents by hash of their id; at most as many rows of numbers
    reach the driver."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y")).join(docs.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi")
    some = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows).collect()
    if not some:
        return []
    wanted = docs.sparkSession.createDataFrame(some, known.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(wanted), "id")  # at most max_rows rows
    rows = statistics(texts, "id", "text", "y").select("doc_id", "y", *[c.alias(n) for n, c in features().items()])
    # Of an id's several texts the one whose statistics sort first is learnt from.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", *features())).alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    ids = rows["doc_id"]
    hashed = (ids.astype("int64").to_numpy() * 2654435761) % (1 << 32) if pd.api.types.is_integer_dtype(ids) else np.array(
        [zlib.crc32(str(i).encode()) for i in ids], np.int64)
    return learn({n: rows[n].to_numpy() for n in features()}, rows["y"].to_numpy() == 0, hashed % 3 == 0, **options)


def quality(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``: one row per row of ``docs``."""
    rows = statistics(docs, id_col, text_col)
    rows = rows.select("*", *[c.alias(n) for n, c in features().items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
