"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token the last token of its BPE encoding is unique. It is found from left to right:
the automaton gives the vocabulary's tokens that end at the prefix's end, and the one sought is that token
which may follow the last token of the prefix before it. Two tokens may stand side by side if undoing their
merges, latest first, never meets a pair that BPE would have joined earlier. Back-pointers from the whole
pre-token then give the exact ids, in time linear in its length however long it is.

The vocabulary comes from a ``tokenizer.json`` with a ByteLevel pre-tokenizer and decoder; its path is a
parameter. Text of an added token becomes that token's id, as the tokenizers library does by default. A token
whose own bytes encode otherwise never occurs in an encoding and isn't used.

Nulls: a null text is encoded as the empty text (no ids; decoded: empty). Repeated rows give equal rows, an
empty table an empty result; other columns of the input aren't read. A text's length isn't limited.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import Remembered, map_batches, utf8
from calibrix.llm.pretokens import CACHE_CHARS, ChunkCache, chunks, pieces

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens and pairs of tokens that a Python worker remembers, twice at most.
WORDS, PAIRS = 100_000, 150_000
_NONE = -1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: the printable Latin-1 characters for
    themselves, the others in order from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class PrefixBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        # Ranks of pairs; of each token that a merge makes, the rank and the pair it is made from.
        self.merged, self.rank, self.halves = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((a, b), r)
            if ab not in self.halves:
                self.halves[ab], self.rank[ab] = (a, b), r
        self.size = size
        self.pairs = Remembered(lambda pair: self._apart(*divmod(pair, size), float("inf")), PAIRS)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.words = Remembered(self._word, WORDS)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i in vocab.values():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        whole = {i for i in vocab.values() if len(self.bytes[i]) == 1}
        for i, (a, b) in sorted(self.halves.items(), key=lambda x: self.rank[x[0]]):
            if a in whole and b in whole and self._apart(a, b, self.rank[i]):
                whole.add(i)
        if dead := set(vocab.values()) - whole:
            for i in dead:
                self.automaton.remove_word(self.bytes[i].decode("latin-1"))
            self.automaton.make_automaton()
        self.cache = ChunkCache(lambda parts: [self._chunk(p) for p in parts])

    def _apart(self, a: int, b: int, below: float) -> bool:
        """Whether a, b get built side by side without a merge across their border of a rank under ``below``.

        Steps back in time: the one built last is halved, and the pair then at the border must not be one that
        merges before it. Merges of one rank go from left to right: a pair at the border comes before an equal
        one in the right token, and of two tokens of one rank the right one is built last.
        """
        while True:
            got = self.merged.get((a, b))
            if got is not None and got < below:
                return False
            of_a, of_b = self.rank.get(a, _NONE), self.rank.get(b, _NONE)
            if of_a > of_b:
                below, a = of_a, self.halves[a][1]
            elif of_b != _NONE:
                below, b = of_b + 0.5, self.halves[b][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(word)
        last, start = [_NONE] * (n + 1), [0] * (n + 1)
        pairs, size = self.pairs, self.size
        for end, (token, width) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            at = end - width
            before = last[at]
            if at == 0:
                last[end], start[end] = token, 0
            elif before >= 0 and pairs[before * size + token]:
                last[end], start[end] = token, at
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        ids = self.encode_word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        words, cached = pieces(chunk, self.pattern.findall), self.words
        return b"".join([cached[w] if len(w) <= CACHE_CHARS else self._word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not self.split or not self.split.search(text):
            return b"".join(self.cache(chunks(text)))
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.cache(chunks(text[at : m.start()]))
            out.append(struct.pack("<I", self.added[m[0]]))
            at = m.end()
        return b"".join(out + self.cache(chunks(text[at:])))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        of, n = self.bytes, len(self.bytes)
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBPE:
    """One encoder per Python worker and vocabulary."""
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | tuple = ("doc_id",),
                     with_ids: bool = False) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids`` array<int>)."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], utf8(F.col(f"`{text_col}`")).alias("__text"))
    out = [*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
           T.StructField("decoded_sha256", T.StringType())]
    out += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        ids, hashes, back = [], [], []
        for x in batch.column(batch.num_columns - 1):
            got = bpe.encode(x.as_buffer().to_pybytes().decode("utf-8", "replace"))
            hashes.append(hashlib.sha256(got).hexdigest())
            back.append(hashlib.sha256(bpe.decode(got).encode()).hexdigest())
            ids.append(got)
        n = np.array([len(x) // 4 for x in ids], np.int64)
        cols = [*batch.columns[:-1], pa.array(n), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
        if with_ids:
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            cols.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return map_batches(src, run, T.StructType(out))
