"""Secret scan: fixed patterns, and novelty of strings in sensitive contexts by dictionary-primed zstandard.

Three kinds of spans come from patterns (``assign``, ``access``, ``hex``). The fourth, ``novel``, has strings
that no pattern has: a run of key characters up to ``reach`` after a sensitive word is a candidate, on its line or on
those below as long as each line before ends open (``:``, ``=``, ``|``, a bracket, comma, quote and the like), and so is
each line of a PEM private key, up to its END line. A candidate's novelty is the number of bytes it adds to a zstandard frame whose dictionary holds the text around it and common
identifiers of code. A word, a path, a name used nearby or an identifier costs a few bytes there; a random key
costs as much as itself. A candidate is reported if its marginal bytes are at least ``min_share`` of its length. Words
that the dictionary lacks are new as well: of a candidate with fewer than 3 digits, less than ``MAX_WORDLIKE`` of the
pairs of neighbours may be letter pairs that words are made of, which holds for random letters of any case; and one with
fewer than 3 letters has to be unbroken, as numbers set with separators are dates and the like.

Offsets are code points, ends exclusive. Nulls: a null text has no spans. Empty tables give empty results,
repeated rows equal rows. Other columns aren't read by ``secret_spans``; ``redact`` keeps all of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.common import map_batches, unused, utf8

# Kinds in the order of ties, patterns, least lengths.
KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
# Words that a secret may follow, and identifiers that prime the dictionary.
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|"
                       r"bearer|authorization|client[ _-]?id|signature", re.I | re.A)
IDENTIFIERS = ("password passwd passphrase secret token api_key apikey access_key private_key credential bearer "
               "authorization client_id client_secret signature username user host port localhost http https www com org "
               "net example test default config settings environment variable value string number true false null none "
               "import from return function class self this public private static final void int float double boolean "
               "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxx "
               "2020 2021 2022 2023 2024 2025 2026")
# First letters with the second letters that follow them in words and identifiers: 93% of the pairs there, 38% of all pairs.
PAIRS = frozenset(x[0] + y for x in (
    "abcdgiklmnprstuvwy baeilorsuy cacehiklorstu dadeilorsu eabcdefgilmnopqrstvwxy faefilorstu gaehilnorsu haeiort iabcdefglmnoprstvxz "
    "keis ladeilostuy mabeimopsu nacdefgiklnopstuv oabcdfgiklmnoprstuvw paeiloprstuy qu racdefgiklmnoprstuvy sacehilmopstuy "
    "tacdefhilmoprstuy uabcefilmnprst vaei waeiors xcept ynpst ze").split() for y in x[1:])
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MAX_WORDLIKE = 0.65
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LEAST = 16
# The line break of a line that goes on below; the header of a PEM key, the lines of one without an END line, and the rest
# of a body behind its last whole line.
_BREAK = re.compile(r"([:=|>(\[{,\\\"'`+-]?)[ \t\r]*\n")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_LINES = re.compile(r"(?:\s*[A-Za-z-]+: [^\n]*\n)*(?:(?:\s|\\[nr]|[\"',+>])*[A-Za-z0-9+/=]{16,})*")
_PEM_REST = re.compile(r"(?:\s|\\[nr]|[\"',+>])+([A-Za-z0-9+/=]{1,15})(?![A-Za-z0-9+/=])")
REACH, AROUND, MIN_SHARE = 256, 256, 0.8
# zstandard's entropy coder makes any long key of a small alphabet cheap. So literals are left as they are (a target length
# does that with the fast strategy), and only repetition saves bytes, at every length alike.
_PLAIN = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_FAST, min_match=4, target_length=1,
                                                        write_content_size=False, write_dict_id=False)
_ID_BYTES = IDENTIFIERS.encode()


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that ``candidate`` adds to a frame primed with identifiers and the text around it."""
    primer = zstandard.ZstdCompressionDict(_ID_BYTES + b" " + around.encode("utf-8", "replace"),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(compression_params=_PLAIN, dict_data=primer)
    return len(c.compress(candidate.encode())) - len(c.compress(b""))


def wordlike(candidate: str) -> float:
    """Share of the pairs of neighbouring letters and digits that are letter pairs of words; a change of case is none."""
    usual = sum(p[i : i + 2] in PAIRS for p in map(str.lower, _PART.findall(candidate)) for i in range(len(p) - 1))
    return usual / max(1, len(candidate) - 1 - 2 * sum(not x.isalnum() for x in candidate))


def may_be_key(candidate: str) -> bool:
    """Whether new bytes are to be taken for a key's: neither a word nor a number set with separators."""
    digits, letters = sum(x.isdigit() for x in candidate), sum(x.isalpha() for x in candidate)
    if letters < 3:
        return candidate.rstrip("=").isalnum()
    return digits >= 3 or wordlike(candidate) < MAX_WORDLIKE


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, sorted; kinds count as in ``KINDS``."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _contexts(text: str, reach: int) -> list[tuple[int, int, bool]]:
    """(start, end, whether a PEM key) of the stretches where candidates may begin, sorted."""
    heads, keys = [(m.start(), m.end()) for m in _PEM.finditer(text)], []
    for i, (begin, start) in enumerate(heads):
        end = text.find("-----END ", start, heads[i + 1][0] if i + 1 < len(heads) else len(text))
        end = end if end >= 0 else _PEM_LINES.match(text, start).end()
        if end > start:
            keys.append((begin, start, end))
    i, found = 0, []
    for m in SENSITIVE.finditer(text):
        while i < len(keys) and keys[i][2] <= m.start():
            i += 1
        if i < len(keys) and keys[i][0] < m.end():
            continue  # in a PEM key
        end = min(len(text), m.end() + reach)
        found.append((m.end(), next((x.start() for x in _BREAK.finditer(text, m.end(), end) if not x[1]), end), False))
    return sorted(found + [(start, end, True) for _, start, end in keys])


def novel_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH, around: int = AROUND,
                min_share: float = MIN_SHARE) -> list[tuple[int, int, int]]:
    """(start, 3, end) of candidates in sensitive contexts whose bytes are new, none overlapping ``base``."""
    out, after = [], 0
    begins, upto = [b for b, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def covered(s: int, e: int) -> bool:
        """Whether a pattern span overlaps: of those that begin before ``e``, the one that ends last does if any does."""
        k = bisect_left(begins, e)
        return k > 0 and upto[k - 1] > s

    for start, end, pem in _contexts(text, reach):
        at = max(start, after)
        while c := _CANDIDATE.search(text, at, end if pem else end + _LEAST - 1):
            s, e = c.start(), c.end() if pem else _CANDIDATE.match(text, c.start()).end()
            at = after = e
            s += s > 0 and text[s - 1 : s + 1] in ("\\n", "\\r")  # an escaped line break
            if e - s < _LEAST or covered(s, e) or not may_be_key(text[s:e]):
                continue
            if marginal_bytes(text[s:e], f"{text[max(0, s - around) : s]}\n{text[e : e + around]}") >= min_share * (e - s):
                out.append((s, 3, e))
        if pem and out and out[-1][0] >= start and (rest := _PEM_REST.match(text, out[-1][2], end)):
            out.append((rest.start(1), 3, rest.end(1)))
    return out


def all_spans(text: str, **options) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, **options))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _texts(column: pa.Array) -> list[str]:
    return [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in column]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans``: ``spans`` lists ``kind:start:end`` by
    start, then kind, joined by commas; ``base_sha256`` is the hash of the same list of the pattern spans."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    names = ["n_assign", "n_access", "n_hex", "n_novel"]
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t, **options) for t in _texts(batch.column(1))]
        counts = np.array([[sum(k == i for _, k, _ in f) for i in range(4)] for f in found], np.int64).reshape(-1, 4)
        base = [hashlib.sha256(_listed([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
        cols = [batch.column(0), *[pa.array(counts[:, i]) for i in range(4)], pa.array(base, pa.string()),
                pa.array([_listed(f) for f in found], pa.string())]
        return pa.RecordBatch.from_arrays(cols, schema.names)

    return map_batches(src, run, schema)


def redacted(text: str, mark: str, **options) -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in all_spans(text, **options):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", n_chars_col: str | None = "n_chars",
           **options) -> DataFrame:
    """``docs`` with its secrets replaced by ``mark``; every row and column stays, null texts stay null, and the
    count of code points in ``n_chars_col`` follows a changed text. Texts without spans aren't touched."""
    at, text, found = len(docs.columns), unused("__text", docs.columns), unused("__found", docs.columns)
    src = docs.withColumn(text, utf8(F.col(f"`{text_col}`")))
    schema = T.StructType([*docs.schema.fields, T.StructField(found, T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [redacted(t, mark, **options) if base_spans(t) or SENSITIVE.search(t) else t for t in _texts(batch.column(at))]
        old = _texts(batch.column(at))
        return batch.set_column(at, found, pa.array([b if a != b else None for a, b in zip(old, new, strict=True)], pa.string()))

    out = map_batches(src, run, schema)
    if n_chars_col in docs.columns:
        n = F.when(F.col(found).isNotNull(), F.char_length(F.col(found)).cast(docs.schema[n_chars_col].dataType))
        out = out.withColumn(n_chars_col, F.coalesce(n, F.col(f"`{n_chars_col}`")))
    return out.withColumn(text_col, F.coalesce(F.col(found), F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
