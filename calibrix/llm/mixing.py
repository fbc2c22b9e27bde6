"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over what it has. Each document draws its
number of copies from the Poisson distribution with that mean, by inverting the distribution function at a
uniform number hashed from the seed, the document's id and (for repeated ids) nothing else: a rerun or another
partitioning draws the same. Copies are exploded and shuffled globally by a hash of (seed, id, copy).

Rates above ``STEP`` are split: the sum of independent draws of mean ``rate / k`` is a draw of mean ``rate``,
so the table of a distribution has a few dozen entries at any rate and no count is capped.

Nulls: a null source is a source of its own; a null text has no characters; a null id hashes as the empty
string. Repeated rows (equal ids) draw equal counts. A source without any characters has no rate and takes no
part in the weights: its documents are left out. Empty tables give empty results. All columns are kept.

Only DataFrame functions are used. The rates (one row a source) are a written table, so that Spark knows its
size: a small one is broadcast, a large one joined by a shuffle whose hot sources adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrix.llm.common import unused
from calibrix.sources.files import written

STEP = 16.0
# Entries of a distribution table for a mean of up to STEP: beyond it the rest is under 1e-16.
_ENTRIES = 96


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1): 52 bits of the MD5 of the seed and the parts."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, epochs: float = 1.0,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, docs, chars, share, rate``: ``share`` of the mixture's characters, ``rate`` the mean number of
    copies of each document. Target shares are ``weights`` (others 0), or without them in proportion to
    ``chars ** power``; the mixture has ``epochs`` times the characters that ``docs`` has."""
    src = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.char_length(F.col(f"`{text_col}`")).cast("long")), F.lit(0)).alias("chars"))
    src = src.where("chars > 0")
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    src = written(src.withColumn("weight", weight), "source_rates")
    total = src.agg(F.sum("weight"), F.sum("chars")).first()  # two numbers
    share = F.col("weight") / F.lit(total[0]) if total[0] else F.lit(0.0)
    return src.select("source", "docs", "chars", share.alias("share"),
                      (share * F.lit(float(epochs)) * F.lit(float(total[1] or 0)) / F.col("chars")).alias("rate"))


def distribution(mean: Column) -> Column:
    """Array: the Poisson distribution function at 0, 1, 2, ... for a mean of at most STEP."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = F.sequence(F.lit(1), F.lit(_ENTRIES))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(step, start, add, lambda acc: acc["cdf"])


def with_counts(docs: DataFrame, rates: DataFrame, seed: int, id_col: str, source_col: str, count: str) -> DataFrame:
    """``docs`` and its number of copies (null where its source has no rate)."""
    parts = F.ceil(F.col("rate") / STEP).cast("int")
    src, table, k = (unused(f"__{x}", docs.columns) for x in ("source", "cdf", "parts"))
    rates = rates.where("rate > 0").select(F.col("source").alias(src), parts.alias(k),
                                           distribution(F.col("rate") / parts).alias(table))
    rates = written(rates, "source_rates")
    out = docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(src)), "inner")
    # Each draw's number is bound first: inside the filter it would be hashed again for every entry of the table.
    draws = F.transform(F.sequence(F.lit(1), F.col(k)), lambda i: uniform(seed, F.col(f"`{id_col}`"), i))
    n = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(table), lambda c: c <= u)))
    return out.withColumn(count, n).drop(src, table, k)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 42,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy: str | None = None,
        position: str | None = None) -> DataFrame:
    """The mixture: each document as often as drawn, globally shuffled. ``copy`` and ``position`` name optional
    columns for a copy's number (from 1) and its shuffle key, a uniform number: rows are dealt out by the key and
    sorted by it in their partition."""
    taken = [*docs.columns, copy or "", position or ""]
    count, nth, key = (unused(f"__{x}", taken) for x in ("count", "copy", "key"))
    rates = source_rates(docs, weights, power, epochs, source_col, text_col)
    out = with_counts(docs, rates, seed, id_col, source_col, count).where(F.col(count) > 0)
    out = out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count)
    out = out.withColumn(key, uniform(seed + 1, F.col(f"`{id_col}`"), F.col(nth)))
    out = out.repartition(F.col(key)).sortWithinPartitions(key)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(nth).alias(copy)] if copy else []),
                      *([F.col(key).alias(position)] if position else []))
