"""Document fingerprints: Merkle trees over paragraphs and sections, by DataFrame functions alone.

A text's paragraphs are its lines. A section ends after a paragraph that is blank or whose hash starts with
0 or 1, so the cut between sections depends on the text around it only and an edit leaves other sections as they
are. A paragraph's node is a SHA-256, a section's that of its paragraphs' nodes, and the root, which
is the fingerprint, that of its sections' nodes: equal texts have equal roots, and comparing nodes from the root
down finds the sections and paragraphs that differ.

The leaves below a paragraph are its phrases, cut where the content says so: behind punctuation marks, behind words that end with one of
some letters, in long stretches without white space behind some characters, and at 64 code points where nothing else cuts. So an
insertion changes the phrases around it only. A paragraph's node is made of its leaves' nodes and its text.

The likeness of two trees compares them from the root down: 1 for equal roots, else the Dice coefficient of the multisets of their
leaves, each weighted by its length: 0 where no phrase is shared, and a repeated phrase counts as often as both have it.

Nulls: a null text is the empty text (one empty paragraph; two empty texts are alike to the degree 1). A null id
counts as the smallest id. Repeated ids: rows follow each other by text. An empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrix.llm.common import unused

# Behind what a phrase ends, in a line, and the longest phrase. Each alternative is told by its first character, and most characters are passed
# over by the one class in front, which Java tests at once.
_ENDS = (r"(?![\x01-\x20\x22-\x2B\x2D\x2F4-9<->@A-CE-FH-LN-PR-SU-XZ\[-ca-ce-fh-ln-pr-su-xz{}~\x7F])(?:[.!?;:,|\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F\u2026]+[ \t]*"
         r"|[dgmtyDGMTY0-3\u00E0-\u00EA\u03B1-\u03B8\u0430-\u0438\u05D0-\u05D8\u0621-\u062B\u0904-\u0920][ \t]+"
         r"|[0qQ\u0435\u3044\u306E\u4E00-\u52FF](?<=\S{33}))")
LONGEST = 64
_LOWEST = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often (or within which lambda) it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tree(text: Column) -> Column:
    """``struct(root, sections array<struct(node, first)>, paragraphs array<string>, leaves array<long>)``;
    ``first`` is a section's first paragraph, counted from 1."""
    def of_paragraphs(lines: Column, leaves: Column, nodes: Column) -> Column:
        n = F.size(nodes)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(nodes, i).rlike("^[01]") | (F.trim(F.element_at(lines, i)) == ""))
        starts = F.concat(F.array(F.lit(1)), F.transform(F.filter(ends, lambda i: i < n), lambda i: i + 1))

        def sections(starts: Column) -> Column:
            size = lambda s, k: F.coalesce(F.get(starts, k + 1), n + 1) - s
            return F.transform(starts, lambda s, k: F.struct(
                F.sha2(F.concat(F.lit("section:"), F.array_join(F.slice(nodes, s, size(s, k)), "")), 256).alias("node"), s.alias("first")))

        return let(let(starts, sections), lambda s: F.struct(
            F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform(s, lambda x: x["node"]), "")), 256).alias("root"),
            s.alias("sections"), nodes.alias("paragraphs"), F.flatten(leaves).alias("leaves")))

    def of_leaves(lines: Column, leaves: Column) -> Column:
        listed = lambda x: F.array_join(x.cast("array<string>"), ",")
        nodes = F.zip_with(lines, leaves, lambda x, p: F.sha2(F.concat(F.lit("paragraph:"), listed(p), F.lit(":"), x), 256))
        return let(nodes, lambda n: of_paragraphs(lines, leaves, n))

    text = F.coalesce(text, F.lit(""))
    return let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, phrases), lambda leaves: of_leaves(lines, leaves)))


def phrases(line: Column) -> Column:
    """The leaves of a line: ``array<long>``, of each phrase 56 bits of its hash, 7 of its length, and a 0. A NUL marks the cuts; one in
    the text is a cut as well."""
    found = F.split(F.regexp_replace(line, _ENDS, "$0\x00"), "\x00", -1)
    parts = F.transform(found, lambda x: F.when(F.char_length(x) <= LONGEST, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0))))
    leaf = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-256)) + 2 * F.char_length(x)
    return F.transform(F.filter(F.flatten(parts), lambda x: x != ""), leaf)


def _chars(leaf: Column) -> Column:
    return F.shiftright(leaf, 1).bitwiseAND(F.lit(127))


def shared_chars(a: Column, b: Column) -> Column:
    """Length of the common part of two multisets of leaves: both sorted together, those of ``b`` with a 1 at their end, so that a node's
    leaves of either side are a run each, next to each other."""
    def of_sorted(both: Column) -> Column:
        n = F.size(both)

        def of_runs(runs: Column) -> Column:
            def add(total: Column, j: Column) -> Column:
                here, other = F.get(runs, j), F.get(runs, j + 1)
                leaf, times = F.get(both, here), F.least(other - here, F.coalesce(F.get(runs, j + 2), n) - other)
                same = (leaf.bitwiseAND(F.lit(1)) == 0) & (F.get(both, other) == leaf + 1)
                return total + F.when(same, _chars(leaf) * times).otherwise(0)

            return F.when(F.size(runs) > 1, F.aggregate(F.sequence(F.lit(0), F.size(runs) - 2), F.lit(0).cast("long"), add)).otherwise(0)

        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(both, i) != F.get(both, i - 1)))
        return F.when(n > 0, let(starts, of_runs)).otherwise(0)

    return let(F.sort_array(F.concat(a, F.transform(b, lambda x: x + 1))), of_sorted)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the Dice coefficient of two trees' leaves, weighted by length; 1 for equal roots."""
    size = lambda x: F.aggregate(x["leaves"], F.lit(0).cast("long"), lambda total, p: total + _chars(p))
    dice = let(size(a) + size(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(2.0 * shared_chars(a["leaves"], b["leaves"]) / n))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(dice)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 1) of the sections of ``a`` whose node ``b`` lacks: the branches that an edit touched."""
    return let(F.transform(b["sections"], lambda s: s["node"]), lambda other: F.filter(
        F.transform(a["sections"], lambda s, k: F.when(~F.array_contains(other, s["node"]), k + 1)), lambda k: k.isNotNull()))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 1) of the paragraphs that differ at their place, where the roots differ; else none."""
    longer = F.sequence(F.lit(1), F.greatest(F.size(a["paragraphs"]), F.size(b["paragraphs"])))
    differ = F.filter(longer, lambda i: ~F.get(a["paragraphs"], i - 1).eqNullSafe(F.get(b["paragraphs"], i - 1)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(differ)


def with_next(docs: DataFrame, id_col: str, text_col: str, out: str, buckets: int | None = None) -> DataFrame:
    """Adds as ``out`` the text of the next row by descending id (after the last row: the first row's).

    Rows are dealt into ranges of ids by quantiles, each sorted in a task of its own. A range ends at an id that
    exists; the rows of that id go to the range below it too, behind its last row, and so do the rows of the largest
    id to the lowest range: so each range has the successor of its last row, without a window over all rows.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, b, guest = (unused(x, [*docs.columns, out]) for x in ("__key", "__range", "__guest"))
    keyed = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)))
    probs = [i / buckets for i in range(1, buckets)]
    found = keyed.agg(F.percentile_approx(key, probs, max(10_000, 20 * buckets)).alias("cuts") if probs else F.array().alias("cuts"),
                      F.max(key).alias("top")).first()
    cuts = sorted({*(found["cuts"] or []), found["top"]}) if found["top"] is not None else [0]
    # Range i has the ids above cut i-1 up to cut i; found by blocks of cuts, then in the block.
    width = max(1, int(len(cuts) ** 0.5))
    whole, coarse = F.array(*[F.lit(c).cast("long") for c in cuts]), F.array(*[F.lit(c).cast("long") for c in cuts[width - 1 :: width]])
    block = F.size(F.filter(coarse, lambda c: c < F.col(key)))
    place = let(block, lambda k: k * width + F.size(F.filter(F.slice(whole, k * width + 1, F.lit(width)), lambda c: c < F.col(key))))
    # An id that is a cut is the last one of its range, the rows above it follow in the next range.
    above = F.when(F.col(key) == cuts[-1], F.lit(0)).when(F.get(whole, F.col(b)) == F.col(key), F.col(b) + 1)
    rows = keyed.withColumn(b, place)
    rows = rows.withColumn(guest, F.explode(F.filter(F.array(F.struct(F.col(b).alias("r"), F.lit(0).alias("g")), F.struct(
        above.alias("r"), F.lit(1).alias("g"))), lambda x: x["r"].isNotNull())))
    rows = rows.withColumn(b, F.col(guest)["r"]).withColumn(guest, F.col(guest)["g"])
    order = Window.partitionBy(b).orderBy(F.col(guest), F.col(key).desc(), F.col(f"`{text_col}`"))
    follows = F.coalesce(F.lead(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).over(order), F.lit(""))
    return rows.withColumn(out, follows).where(F.col(guest) == 0).drop(b, guest, key)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many code points from the start of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """For each row the fingerprint of its text and of an edited version of it, and how alike they are:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections``."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = with_next(src, "doc_id", "text", "following", buckets)

    def compare(x: Column) -> Column:
        a, e, f = x["a"], x["e"], x["f"]
        return F.struct(a["root"].alias("fingerprint"), e["root"].alias("edited_fingerprint"), likeness(a, e).alias("near_edited"),
                        likeness(a, f).alias("near_next"), F.size(differing_sections(a, e)).cast("long").alias("edited_sections"))

    def row(new: Column) -> Column:
        trees = F.struct(tree(F.col("text")).alias("a"), tree(new).alias("e"), tree(F.col("following")).alias("f"))
        return F.struct(F.sha2(new, 256).alias("edited_sha256"), let(trees, compare).alias("c"))

    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), let(edited(F.col("text"), F.col("following")), row).alias("x"))
    return rows.select("doc_id", "n_chars", "x.edited_sha256", "x.c.*")
