import hashlib
import json
import os
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calibrix.llm import bpe
from calibrix.llm.pretokens import ChunkCache, chunks

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.encoder(PATH)


def same(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, text[:60]
    assert OWN.decode(got) == LIB.decode(ids, skip_special_tokens=False)


PIECES = ["a", " ", "  ", "\n", "\t", "'s", "'LL", "é", "漢", "🙂", "1", "½", ".", "<|endoftext|>", "<|endof", "the", " the", "ing", "\r\n", "́", "\xa0",
          "\x1c", "\x85", "\x00", "_", "٣"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=30).map("".join))
def test_against_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    same(text)


def test_long_pretokens():
    rnd = random.Random(4)
    for n, letters in ((3000, "abcdefghijklmnopqrstuvwxyz"), (5000, "aA"), (4000, "e"), (4000, "=-")):
        same("".join(rnd.choice(letters) for _ in range(n)))
    same(" " * 5000 + "x")


def test_every_token_of_the_vocabulary():
    rnd = random.Random(2)
    for ids in (rnd.choices(range(50256), k=20) for _ in range(300)):
        same(OWN.decode(np.array(ids, "<u4").tobytes()))


def test_ids_that_are_no_text():
    vocab = json.load(open(PATH))["model"]["vocab"]
    ids = [i for t, i in vocab.items() if len(t) == 1][120:150]
    assert OWN.decode(np.array(ids, "<u4").tobytes()) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t.'s", max_size=40))
def test_chunks_join_and_encode_alone(text):
    parts = chunks(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in LIB.encode(p, add_special_tokens=False).ids] == LIB.encode(text, add_special_tokens=False).ids


def test_cache_forgets_but_stays_right():
    asked = []

    def encode(parts):
        asked.extend(parts)
        return [p.encode() for p in parts]

    cache, rnd = ChunkCache(encode, limit=5), random.Random(1)
    for _ in range(200):
        parts = [str(rnd.randrange(12)) for _ in range(rnd.randrange(9))] + ["x" * 100]
        assert cache(parts) == [p.encode() for p in parts]
        assert len(cache.young) <= 20 and len(cache.old) <= 20
    assert len(asked) > 12


@pytest.mark.parametrize("with_ids", [False, True])
def test_whole_tables(odd_docs, no_docs, with_ids):
    out = bpe.encode_documents(odd_docs, PATH, with_ids=with_ids)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    expect = []
    for r in odd_docs.collect():
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expect.append((str(r.doc_id), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIB.decode(ids, skip_special_tokens=False).encode())))
    rows = out.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(expect)
    assert not with_ids or all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in rows)
    assert bpe.encode_documents(no_docs, PATH, with_ids=with_ids).count() == 0
