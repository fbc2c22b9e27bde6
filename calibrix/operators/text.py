"""Tokenising, a vocabulary built from the data, token-id lookup, truncate and pad.

Words are lower-cased and split on whitespace and ASCII punctuation (an RE2/Java-compatible
class). The vocabulary ranks tokens by corpus frequency (ties: a hash of the token, then the
token) with the global rank, so no single task orders the whole vocabulary. Token ids are
attached with an equi-join on the token, salted for common ones. The vocabulary's partitions are hashed
(each is a small share of the corpus), so the tokens, many times as many, are shuffled but never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import MAX_SEQ_LEN
from calibrix.operators.ranking import global_rank, shuffle_partitions
from calibrix.sources.files import written

# Token pattern and special token ids.
TOKEN_PATTERN = r"[^\s!-/:-@\[-`{-~]+"
SEPARATOR_PATTERN = r"[\s!-/:-@\[-`{-~]+"
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
# Tokens seen fewer times are unknown: a parameter of the user, 1 keeps all.
MIN_COUNT = 1
# Occurrences of one token that a join task is given.
HOT_ROWS = 1_000_000


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """``(doc_id, pos, token)`` for every token of every whole text.

    Tokens are the maximal runs matching ``TOKEN_PATTERN``; they are taken by splitting on runs of
    the complementary class and dropping the empty ends (the same tokens, faster than extracting
    every match). ``keep_empty``: a text without tokens has one row with null position and token.
    """
    arr = F.filter(F.split(F.lower(F.col(text_col)), SEPARATOR_PATTERN), lambda t: t != F.lit(""))
    each = F.posexplode_outer(arr) if keep_empty else F.posexplode(arr)
    return docs.select(id_col, each.alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def dealt(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents dealt evenly over the tasks, which tokenising and exploding whole texts of very different length
    needs; a shuffle of the texts, small beside that of their tokens."""
    return docs.repartition(shuffle_partitions(docs.sparkSession), id_col)


def token_key(col: str = "token"):
    """60-bit integer from the token's md5: the tie-break key among tokens of equal count."""
    return F.conv(F.substring(F.md5(F.col(col)), 1, 15), 16, 10).cast("bigint")


def build_vocab(toks: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(token, token_id, count)`` for tokens seen at least ``min_count`` times; ids from 4 in
    (count desc, key, token) order, by the global rank (its sorted rows are a written table)."""
    counts = toks.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    keyed = counts.where(F.col("count") >= min_count).select("token", "count", (-F.col("count")).alias("_c"), token_key().alias("_k"))
    r = global_rank(keyed, "_c", "_k", out="_r", extra_order=["token"])
    return r.select("token", (F.col("_r") + FIRST_WORD_ID - 1).alias("token_id"), "count")


def lookup(toks: DataFrame, vocab: DataFrame, hot_rows: int = HOT_ROWS, value: str = "token_id") -> DataFrame:
    """Attach ids (the vocabulary's column ``value``) and counts; unknown tokens map to UNK.

    A token with more than ``hot_rows`` occurrences is salted: its vocabulary row is repeated for each of
    ``count / hot_rows`` salts and its occurrences are dealt over them, so no join task gets all of a common word.
    The list of hot tokens is written first, for Spark to know its size. The join hashes the vocabulary's rows: a sort of the
    occurrences would spill them.
    """
    vocab = written(vocab, "vocabulary")
    hot = written(vocab.where(F.col("count") > hot_rows).select("token", F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts")), "hot_tokens")
    salts = F.coalesce("_salts", F.lit(1))
    left = toks.join(hot, "token", "left").withColumn("_salt", F.pmod(F.xxhash64(*toks.columns), salts).cast("int")).drop("_salts")
    right = vocab.select("token", value, "count").join(hot, "token", "left").select(
        "token", value, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    j = left.join(right.hint("shuffle_hash"), ["token", "_salt"], "left").drop("_salt")
    unknown = F.lit(UNK_ID).cast("bigint")
    return j.withColumn(value, F.coalesce(F.col(value), unknown if value == "token_id" else F.array(unknown)))


def encode(ids: DataFrame, max_len: int = MAX_SEQ_LEN, id_col: str = "doc_id") -> DataFrame:
    """``input_ids`` / ``attention_mask`` of length ``max_len``: [CLS] first max_len-2 ids [SEP] pads.

    ``ids`` come from ``tokens`` with ``keep_empty``, so a text without tokens has its row here too. Only the
    first ``max_len - 2`` positions of a document are gathered (bounded per document).
    """
    keep = max_len - 2
    docs = ids.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") < keep, F.struct("pos", "token_id")))).alias("_p"))
    body = F.transform("_p", lambda s: s["token_id"])
    n = F.size(body)
    pad = F.lit(keep) - n
    input_ids = F.concat(F.array(F.lit(CLS_ID).cast("bigint")), body, F.array(F.lit(SEP_ID).cast("bigint")),
                         F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), n + 2), F.array_repeat(F.lit(0).cast("bigint"), pad))
    return docs.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"))


def tokenize_pad(docs: DataFrame, max_len: int = MAX_SEQ_LEN, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """Documents as padded ids, in the vocabulary of all their tokens; a token beyond the length only counts for it."""
    toks = tokens(dealt(docs, id_col), id_col, text_col, keep_empty=True)
    vocab = build_vocab(toks, min_count)
    first = toks.where(F.col("pos").isNull() | (F.col("pos") < max_len - 2))
    return encode(lookup(first, vocab), max_len, id_col)


# ------------------------------------------------------------------ subwords (J5, F11 with pieces)
def longest_pieces(word: str, pieces: dict[str, int]) -> list[int]:
    """Ids of the pieces that cover ``word`` from its beginning, each the longest that fits; a character that is no piece is UNK."""
    out, at, longest = [], 0, pieces.get("", 0)
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if (found := pieces.get(word[at:end])) is not None:
                break
        else:
            found, end = UNK_ID, at + 1
        out.append(found)
        at = end
    return out


def word_pieces(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``words`` (distinct ``token`` and other columns) with ``piece_ids``: greedy longest match in ``pieces`` (``piece, piece_id``). Each distinct
    word is cut once, however often it occurs. The pieces must be bounded (``subword_pieces``): every task gets them."""
    table = {r["piece"]: r["piece_id"] for r in pieces.select("piece", "piece_id").collect()}
    table[""] = max(map(len, table), default=0)  # the empty text can't be a piece: the longest one's length is kept there
    shared = words.sparkSession.sparkContext.broadcast(table)  # a vocabulary's size and the characters
    schema = T.StructType([*words.schema.fields, T.StructField("piece_ids", T.ArrayType(T.LongType()))])

    def run(frames):
        for pdf in frames:
            yield pdf.assign(piece_ids=[longest_pieces(w, shared.value) for w in pdf["token"]])

    return words.mapInPandas(run, schema)


def subword_pieces(vocab: DataFrame, size: int) -> DataFrame:
    """``piece, piece_id``: the ``size`` first words of the vocabulary, under their ids, and every single character of the others (id: behind
    the words', by code point), so that no word of the corpus has an unknown part."""
    words = vocab.where(F.col("token_id") < FIRST_WORD_ID + size).select(F.col("token").alias("piece"), F.col("token_id").alias("piece_id"))
    chars = vocab.select(F.explode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("piece")).distinct()
    chars = chars.join(words.where(F.length("piece") == 1), "piece", "left_anti")
    code = F.conv(F.hex(F.encode("piece", "UTF-32")), 16, 10).cast("bigint")
    return words.unionByName(chars.select("piece", (code + FIRST_WORD_ID + size).alias("piece_id")))


def subword_lookup(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT,
                   first: int | None = None) -> DataFrame:
    """``doc_id, pos, token, piece_ids`` for every token of every whole text (null position and token for a text without any). ``first``: for each
    text's tokens at so many positions; the others only count for the vocabulary."""
    toks = tokens(dealt(docs, id_col), id_col, text_col, keep_empty=True)
    vocab = written(build_vocab(toks, min_count), "vocabulary")
    if first is not None:
        toks = toks.where(F.col("pos").isNull() | (F.col("pos") < first))
    return lookup(toks, word_pieces(vocab.select("token", "count"), subword_pieces(vocab, size)), value="piece_ids")


def encode_pieces(rows: DataFrame, max_len: int = MAX_SEQ_LEN, id_col: str = "doc_id") -> DataFrame:
    """``input_ids`` / ``attention_mask`` from ``subword_lookup``, as ``encode``. Of a document the words of the first ``max_len - 2`` positions are
    gathered, as each has a piece at least."""
    keep = max_len - 2
    docs = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("pos") < keep, F.struct("pos", "piece_ids")))).alias("_p"))
    body = F.slice(F.flatten(F.transform("_p", lambda s: s["piece_ids"])), 1, keep)
    docs = docs.select(id_col, body.alias("_b"))
    n, pad = F.size("_b"), F.lit(keep) - F.size("_b")
    one = lambda v: F.array(F.lit(v).cast("bigint"))
    input_ids = F.concat(one(CLS_ID), F.col("_b"), one(SEP_ID), F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), n + 2), F.array_repeat(F.lit(0).cast("bigint"), pad))
    return docs.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"))
