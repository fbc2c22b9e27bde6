"""SimHash near-duplicates: fingerprints of word shingles, linked by Hamming distance over pivot tables.

Words are runs of bytes other than space and \\t to \\r, with A-Z lower-cased; a text's shingles are its
``shingle`` consecutive words joined by one space, repeats included (a shorter text: all its words; none:
fingerprint zero). A bit is set if more than half of the shingles' XXH64 values have it.

Search for pairs within ``max_bits``:

1. Equal fingerprints become one class (a partial aggregate), so copies never meet each other in pairs.
2. The table is dealt out by block agreement. With ``max_bits + 2`` blocks of bits, fingerprints within
   ``max_bits`` agree in two whole blocks at least, so a class goes to one cell for each pair of blocks.
   A cell with more than ``cell_rows`` classes is dealt on to tiles (pairs of its chunks): all of its pairs
   are still met, each tile is bounded, and none is dropped.
3. In a task, the distance table to ``pivots`` reference fingerprints is computed once for its rows. Rows are
   sorted by the first coordinate; as ``|d(x,p) - d(y,p)| <= d(x,y)``, a row is compared with those after it
   only until that coordinate has grown by more than ``max_bits``, pairs are discarded as soon as any other
   coordinate differs by more, and survivors are verified by their exact distance.
4. A task returns a spanning forest of its links, not all pairs of a dense group.

Components come from alternating star contractions over the forests' edges, each round a written table.

Nulls: a null text is empty; a null ``doc_id`` takes part, ids are taken over the others (null if there are
none). Ties and repeated rows get the same fingerprint and component. An empty table gives an empty result.
Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import map_batches, slices, unused, utf8, word_blocks
from calibrix.sources.files import written

SHINGLE, MAX_BITS, SEED = 3, 3, 42
PIVOTS, CELL_ROWS = 24, 2048
_FLUSH = 1 << 20


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text's UTF-8 bytes."""
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for words in word_blocks((text or b"").lower(), shingle - 1):
        n = len(words) - shingle + 1
        if n <= 0:
            continue
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        h = np.fromiter((digest(p, seed) for p in parts), np.uint64, n)
        total += n
        bits = h.view(np.uint8).reshape(-1, 8)
        for at in range(0, n, 1 << 14):
            ones += np.unpackbits(bits[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total:  # fewer words than a shingle has
        words = (text or b"").lower().split()
        return digest(b" ".join(words), seed) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _with_fingerprints(batch: pa.RecordBatch, text: int, shingle: int, seed: int) -> pa.Array:
    fps = (simhash(x.as_buffer().to_pybytes(), shingle, seed) for x in batch.column(text))
    return pa.array(np.fromiter(fps, np.uint64, batch.num_rows).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """``doc_id, digest, fp``: each row's fingerprint as a signed long (the same 64 bits), and a digest of its whole text."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("b"))
    src = src.select("doc_id", F.xxhash64("b").alias("digest"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(2, "fp", _with_fingerprints(batch, 2, shingle, seed))

    return map_batches(src, run, src.select("doc_id", "digest", F.lit(0).cast("long").alias("fp")).schema)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, one row each."""
    refs = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(pivots)], np.uint64)
    return np.stack([np.bitwise_count(fps ^ r) for r in refs], axis=1).astype(np.int8)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links u-v: the smallest node of each one's component."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


def near_links(group: np.ndarray, side: np.ndarray, across: np.ndarray, fps: np.ndarray, max_bits: int,
               pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links within each group.

    Rows are sorted by group, then by distance to the first pivot. Where ``across`` is set, only rows of
    different ``side`` are compared (the others meet in their own tile).
    """
    table, n = pivot_table(fps, pivots), len(fps)
    us, vs, held = [], [], 0
    low, step = np.arange(max(0, n - 1)), 1
    while len(low):
        low = low[low + step < n]
        high = low + step
        near = (group[low] == group[high]) & (table[high, 0] - table[low, 0] <= max_bits)
        low, high = low[near], high[near]
        meet = ~across[low] | (side[low] != side[high])
        x, y = low[meet], high[meet]
        for c in range(1, pivots):
            ok = np.abs(table[x, c] - table[y, c]) <= max_bits
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
        us.append(x[ok])
        vs.append(y[ok])
        held += int(ok.sum())
        if held > _FLUSH:
            label = forest(n, np.concatenate(us), np.concatenate(vs))
            keep = np.flatnonzero(label != np.arange(n))
            us, vs, held = [keep], [label[keep]], 0
        step += 1
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    label = forest(n, u, v)
    keep = np.flatnonzero(label != np.arange(n))
    return keep, label[keep]


def _cells(classes: DataFrame, max_bits: int) -> DataFrame:
    """``fp, cell``: a row for each pair of blocks; equal cells agree in both."""
    n = max_bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(lo, hi - lo) for lo, hi in pairwise(edges)]
    fp = F.col("fp")
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND((1 << w) - 1) for lo, w in blocks]
    cells = [F.struct(F.lit(k).alias("k"), F.shiftleft(part[i], blocks[j][1]).bitwiseOR(part[j]).alias("v"))
             for k, (i, j) in enumerate(combinations(range(n), 2))]
    return classes.select("fp", F.inline(F.array(*cells)))


def links(classes: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``u, v`` with u > v: a forest over ``fp`` whose components are those of all links within ``max_bits``."""
    cells = _cells(classes, max_bits)
    big = written(cells.groupBy("k", "v").count().where(F.col("count") > cell_rows)
                  .select("k", "v", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks")), "simhash_cells")
    dealt = cells.join(big, ["k", "v"], "left")
    n = F.coalesce("chunks", F.lit(1))
    dealt = dealt.select("k", "v", "fp", n.alias("n"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("side"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    p0 = xxhash.xxh64_intdigest(b"pivot 0", SEED)
    p0 = p0 - (1 << 64) if p0 >> 63 else p0
    dealt = dealt.select("k", "v", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side",
                         "fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(p0))).alias("d0"))
    keys = ["k", "v", "a", "b"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "d0")

    def rows(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        new = reduce(np.logical_or, [np.diff(cols[c], prepend=cols[c][:1]) != 0 for c in keys])
        fps = cols["fp"].view(np.uint64)
        i, j = near_links(np.cumsum(new), cols["side"], cols["a"] != cols["b"], fps, max_bits, pivots)
        x, y = fps[i].view(np.int64), fps[j].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a cell's or tile's rows so far, and those of others before it
        for batch in slices(batches, 1 << 13):
            cols = [batch.column(c).to_numpy() for c in keys]
            change = np.flatnonzero(reduce(np.logical_or, [np.diff(c) != 0 for c in cols]))
            first = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys)
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or first:
                yield rows(pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield rows(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``edges`` (u, v), u > v, the smallest node it is connected with.

    Alternates the large-star and small-star contractions, each by a partial minimum and a join on the
    node, until the edges don't change; every round is a written table, so lineage stays short.
    """
    def state(e: DataFrame):
        return e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(edges, "components")
    now = state(edges)
    while now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = written(small.where("u != v").distinct(), "components")
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id, component``: one row per row of ``docs``. ``fingerprint`` is 16
    lowercase hex digits, ``component_id`` the smallest id reachable by links of at most ``max_bits`` bits,
    ``component`` a fingerprint that stands for the component."""
    return _grouped(docs, id_col, text_col, shingle, max_bits, pivots, cell_rows).drop("digest")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int = MAX_BITS, pivots: int = PIVOTS,
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """``near_duplicates`` with the ``digest`` of each row's text."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash")
    comp = components(links(classes, max_bits, pivots, cell_rows))
    comp = comp.union(comp.select(F.col("root"), F.col("root")).distinct())
    # Only classes that hold copies or links can have another id than their own.
    linked = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or root is not null")
    linked = linked.select("fp", F.coalesce("root", "fp").alias("root"), "low")
    ids = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = written(linked.select("fp", "root").join(ids, "root"), "simhash")
    out = fps.join(ids, "fp", "left")
    return out.select("doc_id", "digest", _hex("fp").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      _hex(F.coalesce("root", "fp")).alias("component"))


def _hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         **options) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Of rows that repeat this id, the one
    that sorts first by text and then by the other columns stays; a component without any id keeps a row too.
    All columns are kept. A row is told by its id and the digest of its text, which were taken beside its fingerprint, so
    the texts are neither fingerprinted nor written a second time."""
    dup = _grouped(docs, id_col, text_col, shingle, **options)
    kept = dup.where("doc_id = component_id or (component_id is null and fingerprint = component)")
    none = F.lit(-(1 << 63))
    key, of, fp = (unused(f"__{x}", docs.columns) for x in ("id", "digest", "fp"))
    kept = kept.select(F.coalesce("doc_id", none).alias(key), F.col("digest").alias(of), F.col("fingerprint").alias(fp))
    rows = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), none)).withColumn(of, F.xxhash64(utf8(F.col(f"`{text_col}`"))))
    rows = rows.join(kept.distinct(), [key, of])
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields
              if isinstance(f.dataType, T.AtomicType) and f.name != text_col]
    order = Window.partitionBy(key, fp).orderBy(F.col(f"`{text_col}`"), *others)
    nth = unused("__nth", docs.columns)
    rows = rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
