import json
import os
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
import tokenizers
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calibrix.config import scratch_path
from calibrix.llm import orc_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = 2


def index(spark, docs):
    path = scratch_path(spark, "token_orc", uuid.uuid4().hex)
    orc_tokens.write_tokens(docs, path, PATH, END)
    return path, orc_tokens.token_index(spark, path)


def test_against_the_library(spark, odd_docs):
    more = spark.range(200).selectExpr("(id * 7919) % 1000 + 50 as doc_id", "concat('text  with   spaces \n\n of ', id, '<|endoftext|> after ') as text")
    docs = odd_docs.select("doc_id", "text").union(more).repartition(5)
    path, got = index(spark, docs)
    got = {(r.doc_id, r.start): r for r in got.collect()}
    lib = Tokenizer.from_file(PATH)
    rows = sorted((r for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()),
                  key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert len(got) == len(rows)
    at = 0
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, END]
        row = got[r.doc_id, at]
        assert row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_files_are_sorted_and_indexed(spark):
    docs = spark.range(5000).selectExpr("(id * 7919) % 5000 as doc_id", "concat('word ', id) as text").repartition(3)
    path, _ = index(spark, docs)
    folder = path.removeprefix("file:")
    files = sorted(f for f in os.listdir(folder) if f.endswith(".orc"))
    ids = []
    for f in files:
        t = orc.ORCFile(pyarrow.fs.LocalFileSystem().open_input_file(os.path.join(folder, f)))
        ids += t.read(columns=["doc_id"]).column("doc_id").to_pylist()
    assert ids == list(range(5000))
    one = spark.read.orc(path).where("doc_id = 1234").select("n_tokens")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)]" in one._jdf.queryExecution().toString() and one.count() == 1


def test_no_rows(spark, no_docs):
    assert index(spark, no_docs)[1].count() == 0


def test_columns_with_clashing_names(spark, odd_docs):
    docs = odd_docs.withColumn("ids", F.lit("x")).withColumn("nth", F.lit(7)).withColumn("file", F.lit(1)).withColumn("start", F.lit(2.0))
    path, got = index(spark, docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, index(spark, odd_docs.select("doc_id", "text"))[1].collect()), key=str)


ODD = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\x00", "a", "foo", "\u00c9t\u00e9", "\u00ff", "'s", "'re", "1", "\u0663", "\u6f22", "!", "...",
       "\U0001f600", "<|endoftext|>", "<|"]


def odd_texts(n):
    pick = random.Random(7)
    made = ["".join(pick.choices(ODD, [6, 2] + [1] * (len(ODD) - 2), k=pick.randint(0, 12))) for _ in range(n)]
    return ["", " ", "  ", "a ", " a", "<|endoftext|>", "word " * 3000 + "\u00e9" * 500, *made]


@pytest.fixture
def spied(monkeypatch):
    """Numbers of strings that the library's model gets in each call."""
    calls = []

    class Spy:
        from_file = staticmethod(Tokenizer.from_file)

        def __init__(self, model):
            self.inner = Tokenizer(model)

        def encode_batch_fast(self, strings, **kw):
            calls.append(len(strings))
            return self.inner.encode_batch_fast(strings, **kw)

    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    orc_tokens.library_encoder.cache_clear()
    yield calls
    orc_tokens.library_encoder.cache_clear()


def test_model_gets_many_pieces_at_a_time(spied):
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("ar", "elo", "im", "ust") for c in ("ane", "ig", "ogra", "ul")]
    texts = [" ".join(words), " ".join(reversed(words)), ", ".join(words)]
    got = orc_tokens.library_encoder(PATH)(pa.array(texts)).to_pylist()
    assert got == [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < sum(spied) <= (len(words) + 3) // orc_tokens.TOGETHER + 1


@pytest.mark.parametrize("change", [{}, {"model": {"ignore_merges": True}}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}])
def test_encoder_equals_the_library(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= change.get("model", {})
    spec["pre_tokenizer"] = change.get("pre_tokenizer", spec["pre_tokenizer"])
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts, lib = odd_texts(2000), Tokenizer.from_file(path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    encode = orc_tokens.library_encoder(path)
    assert encode(pa.array(texts)).to_pylist() == want
    assert [encode(pa.array([t])).to_pylist()[0] for t in texts[:20]] == want[:20]
    assert encode(pa.array([], pa.string())).to_pylist() == []


def test_portions_are_bounded(monkeypatch):
    monkeypatch.setattr(orc_tokens, "PORTION_BYTES", 10)
    texts = [b"12345", b"12345", b"", b"1", b"x" * 50, b"", b"12"]
    parts = [b.column("text").to_pylist() for b in orc_tokens.portions(iter([pa.record_batch([pa.array(texts)], ["text"])]))]
    assert parts == [texts[:3], texts[3:4], texts[4:5], texts[5:]]


def test_bytes_that_are_not_utf8():
    assert orc_tokens.strings(pa.array([b"a\xffb", b"c"])).to_pylist() == ["a\ufffdb", "c"]
