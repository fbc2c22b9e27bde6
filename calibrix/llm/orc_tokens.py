"""Token ids in ORC: one row a document, in ascending order of id over the files.

The texts are range-partitioned and sorted by id, then encoded in place by the tokenizers library, so ids come out
in order without being shuffled themselves. ORC keeps the integer columns run-length encoded, with row indexes in
each stripe and Bloom filters on the document id: readers of one id or a range of ids skip files, stripes and row
groups by metadata alone, and stripes of a file can be read in parallel.

A document's ``start`` in the whole sequence isn't stored, as no task knows it while writing: it is the sum of a
file's row counts before it (a window within its file) and of the files before (a window over one row per file).

Nulls: a null text has the end id only; null document ids come first. Repeated ids follow each other in the order of
their texts' hashes. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.bpe import PATTERN, byte_letters
from calibrix.llm.common import map_batches, utf8
from calibrix.llm.pretokens import spaced

# Row index entries every so many rows; the Bloom filters' rate of false positives; bytes of a stripe.
INDEX_ROWS, BLOOM_RATE, STRIPE_BYTES = 1000, 0.01, 16 << 20
# Bytes of texts encoded together (or one longer text); pieces that the library's model gets in one string; strings in a call.
PORTION_BYTES, TOGETHER, STRINGS = 8 << 20, 64, 256
# Bytes that no UTF-8 text has.
_NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))
# A space before white space (as str.isspace has it) or the end, in RE2: such a text isn't cut at every space.
_WIDE = r" (?:[\t-\r\x1c-\x1f\x{85}\p{Z}]|\z)"


def barrier_letter(model: dict, letters: list[str]) -> str | None:
    """The letter of a byte that no text has and no merge of a BPE model joins to another: pieces with it between them are
    encoded together as each would be alone. None if the model has none, or if a piece's place in what it gets matters."""
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    merged = {c for m in model["merges"] for c in "".join(m)}
    return next((letters[b] for b in _NEVER if letters[b] in model["vocab"] and letters[b] not in merged), None)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with ``PORTION_BYTES`` of text at most, or one row."""
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def strings(column: pa.Array) -> pa.Array:
    """UTF-8 bytes as strings, with U+FFFD for what isn't UTF-8."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Callable[[pa.Array], pa.ListArray]:
    """A function from texts to the ids of each by the tokenizers library.

    Where the file's pre-tokenizer is byte-level, texts are cut at spaces, the different chunks of all of them are cut by its pattern,
    and the different pieces of these are encoded by the library's model, many in one string; else, and for texts with an added token,
    the library gets the whole text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, cut = [t["content"] for t in spec.get("added_tokens", [])], spec["pre_tokenizer"] or {}
    byte_level = spec["normalizer"] is None and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)

    def whole(texts: pa.Array) -> pa.ListArray:
        ids = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").view("<i4") for t in texts.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "<i4"), *ids])))

    if not byte_level:
        return whole
    letters, findall, model = byte_letters(), regex.compile(PATTERN).findall, Tokenizer(lib.model)
    shown, barrier = dict(enumerate(letters)), barrier_letter(spec["model"], letters)
    between, end, together = (bytes([letters.index(barrier)]), spec["model"]["vocab"][barrier], TOGETHER) if barrier else (b"", -1, 1)

    def encoded(pieces: pa.Array) -> pa.ListArray:
        """Ids of different pieces."""
        n = len(pieces)
        groups = pa.ListArray.from_arrays(pa.array([*range(0, n, together), n], pa.int32()), pieces.cast(pa.binary()))
        joined, found = pc.binary_join(groups, between), [np.empty(0, np.int64)]
        for k in range(0, len(joined), STRINGS):
            strings = [g.decode("latin-1").translate(shown) for g in joined[k : k + STRINGS].to_pylist()]
            found.append(np.array([i for g in model.encode_batch_fast(strings, add_special_tokens=False) for i in [*g.ids, end]], np.int64))
        flat = np.concatenate(found)
        at = np.concatenate([[0], np.flatnonzero(flat == end) - np.arange(n)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[flat != end].astype("<u4").view("<i4")))

    def by_chunks(texts: pa.ListArray) -> pa.ListArray:
        """Ids of texts that were cut before spaces: each but a text's first chunk has a space before it."""
        values, at = texts.flatten(), texts.offsets.to_numpy() - texts.offsets[0].as_py()
        later = np.ones(len(values), bool)
        later[at[:-1]] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        # No piece goes beyond a chunk, so the different chunks are cut in one pass: only a chunk begins with a space and no white space.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py()
        pieces = findall(f" {joined}") if joined else []
        starts = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        for head in values.filter(pa.array(~later)).to_pylist():
            starts.append(len(pieces))
            pieces += findall(head)
        of = np.empty(len(values), np.int64)
        of[later], of[~later] = coded.indices.to_numpy(), len(coded.dictionary) + np.arange(len(texts))
        different = pa.array(pieces, pa.string()).dictionary_encode()
        ids = encoded(different.dictionary).take(different.indices)
        of_chunks = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[[*starts, len(pieces)]]), ids.values).take(pa.array(of))
        return pa.ListArray.from_arrays(pa.array(of_chunks.offsets.to_numpy()[at]), of_chunks.values)

    def encode(texts: pa.Array) -> pa.ListArray:
        kind = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False).astype(int)
        for a in added:
            kind[pc.match_substring(texts, a).to_numpy(zero_copy_only=False)] = 2
        rows = [np.flatnonzero(kind == k) for k in range(3)]
        plain, wide, odd = (texts.take(pa.array(r)) for r in rows)
        chunks = pa.concat_arrays([pc.split_pattern(plain, " "), pa.array([spaced(t) for t in wide.to_pylist()], pa.list_(pa.string()))])
        return pa.concat_arrays([by_chunks(chunks), whole(odd)]).take(pa.array(np.argsort(np.concatenate(rows))))

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``doc_id, nth, n_tokens, ids`` as ORC files below ``path``; ``nth`` is a row's number in its file's task."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    tie = F.xxhash64("text")
    src = src.repartitionByRange(F.col("doc_id").asc(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc(), tie.asc())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("nth", T.LongType()),
                           T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    end = np.array(end_id, "<u4").astype("<i4")

    def run(batches):
        encode, at = library_encoder(tokenizer), 0
        for batch in portions(batches):
            ids = encode(strings(batch.column("text")))
            ends = ids.offsets.to_numpy()
            n, offsets = np.diff(ends) + 1, ends + np.arange(len(ends))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.insert(ids.values.to_numpy(), ends[1:], end)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.arange(at, at + len(n))), pa.array(n, pa.int32()), lists], schema.names)
            at += len(n)

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(BLOOM_RATE), "orc.create.index": "true",
               "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    src.mapInArrow(run, schema).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, nth, n_tokens, ids`` and the ``file`` of each row."""
    df = spark.read.schema("doc_id long, nth long, n_tokens int, ids array<int>").orc(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"))


def starts(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all rows before. The files' totals come from ``lengths``, of which only the id, number of
    ids and file are read (the ids themselves not)."""
    first, last = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.max("doc_id").alias("last")
    files = lengths.groupBy("file").agg(F.sum("n_tokens").alias("total"), first, last)
    before = Window.orderBy(F.col("first"), F.col("last").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = rows.join(files, rows["file"] == files["of"]).drop("of")
    return out.withColumn("start", F.col("start") + F.col("file_start")).drop("file_start")


def checksums(rows: DataFrame) -> DataFrame:
    """The rows with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) instead of ``ids``."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "ids"] + [T.StructField("ids_crc32", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].astype("<i4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        kept = [batch.column(f.name) for f in schema.fields[:-1]]
        return pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], schema.names)

    return map_batches(rows, run, schema)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files below ``path``."""
    stored = read_tokens(spark, path)
    return starts(checksums(stored), stored).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
