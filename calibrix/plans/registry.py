"""Named queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.

Each query reads the driver tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibrix.config import DEFAULT_COEFFICIENT
from calibrix.operators import groups as G
from calibrix.plans import oracle as O
from calibrix.plans.common import finish
from calibrix.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _plus_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: IEEE -0.0 + 0.0 = +0.0, and Spark's
    decimal rounding never yields -0.0."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            depth += sql[k] == "("
            depth -= sql[k] == ")"
            if depth == 0:
                break
            k += 1
        inner = _plus_zero_rounds(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0::DOUBLE)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        QUERIES[name].__name__ = name
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = _plus_zero_rounds(sql)
        return fn

    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ============================================================ A11: flagship
@register(
    "group_metrics",
    _with(O.predictions_cte(), O.terms_cte(), O.group_metrics_ctes(DEFAULT_COEFFICIENT)) + O.gm_final(),
)
def q_group_metrics(spark, sf_dir):
    """All metrics per kept group on its class-balanced subset, plus the unbalanced ALL row."""
    gm = G.group_metrics(FX.predictions(spark, sf_dir), DEFAULT_COEFFICIENT)
    return gm.select("group", "group_size", "n_rows", *O.GM_DOUBLES, "tn", "fp", "fn", "tp")


# ============================================================ preparation (S1-S4, P*, W5, W6, U*, A1-A4, L*)
from pyspark.sql import functions as F  # noqa: E402

from calibrix.config import GROUPS, HIST_BINS, HIST_ZOOM_MIN, TARGET_RANGES  # noqa: E402
from calibrix.operators import prepare as P  # noqa: E402
from calibrix.operators.ranking import global_rank  # noqa: E402
from calibrix.sources import files as FS  # noqa: E402
from calibrix.functions.random import uniform  # noqa: E402

_GL = ", ".join(GROUPS)


def _prepared(spark, sf_dir):
    return P.prepare(FX.comments(spark, sf_dir), texts=False)


@register("project_columns", O.with_prepare() + f"SELECT {_GL}, id, round(target, 6) AS target, comment_text FROM comments")
def q_project_columns(spark, sf_dir):
    """Keep the nine group columns and the base columns."""
    return P.project_columns(FX.comments(spark, sf_dir))


@register("rename_label", O.with_prepare() + "SELECT id, round(target, 6) AS target, round(target, 6) AS labels FROM comments")
def q_rename_label(spark, sf_dir):
    return P.rename_label(FX.comments(spark, sf_dir)).select("id", "target", "labels")


@register("any_null_partition", O.with_prepare(part_null=True) + f"SELECT id, {O.any_null_sql()} AS any_null FROM comments")
def q_any_null_partition(spark, sf_dir):
    """Flag rows with any null group (part-null fixture: some labelled rows miss one group)."""
    return FX.comments(spark, sf_dir, part_null=True).select("id", P.any_null().alias("any_null"))


@register("null_sentinel", O.with_prepare(part_null=True) + f"SELECT id, stratum, {_GL} FROM cleaned")
def q_null_sentinel(spark, sf_dir):
    """Any null group -> all nine groups -1.0 (part-null fixture)."""
    return P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir, part_null=True))).select("id", "stratum", *GROUPS)


@register("range_filter", O.with_prepare() + f"SELECT id, round(target, 6) AS target FROM comments WHERE target >= 0.25{O.D} AND target < 0.5{O.D}")
def q_range_filter(spark, sf_dir):
    return FX.comments(spark, sf_dir).where(P.in_range("target", 0.25, 0.5)).select("id", "target")


@register(
    "stratified_drop",
    O.with_prepare() + "SELECT id, stratum, round(target, 6) AS target FROM kept",
)
def q_stratified_drop(spark, sf_dir):
    """Exact per-(stratum, range) down-sampling by hash order."""
    cleaned = P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir)))
    return P.kept_keys(cleaned)


@register("drop_by_id", O.with_prepare() + "SELECT id, stratum FROM cleaned WHERE id NOT IN (SELECT id FROM drop_plan WHERE _pos <= _n_drop)")
def q_drop_by_id(spark, sf_dir):
    """Remove sampled ids with a left-anti join on id."""
    cleaned = P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir)))
    return cleaned.select("id", "stratum").join(P.dropped_ids(cleaned), "id", "left_anti")


@register("exact_split", O.with_prepare() + "SELECT id, stratum, split FROM prepared")
def q_exact_split(spark, sf_dir):
    """Chained exact train/calib/eval/test split per null stratum."""
    return P.prepare_keys(FX.comments(spark, sf_dir)).select("id", "stratum", "split")


@register(
    "union_strata",
    O.with_prepare()
    + "SELECT stratum, count(*) AS n_rows, count(*) FILTER (WHERE target > 0.5) AS n_toxic FROM kept GROUP BY stratum",
)
def q_union_strata(spark, sf_dir):
    """Bag union of the separately down-sampled null and no-null parts."""
    cleaned = P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir)))
    a = P.kept_keys(cleaned.where(F.col("stratum") == P.WITH_NULLS))
    b = P.kept_keys(cleaned.where(F.col("stratum") == P.WITHOUT_NULLS))
    u = a.unionByName(b)
    return u.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("target") > 0.5, 1)).alias("n_toxic"))


@register("eval_without_nulls", O.with_prepare() + "SELECT id, split, stratum FROM splits WHERE split IN ('eval', 'test')")
def q_eval_without_nulls(spark, sf_dir):
    keys = P.eval_without_nulls(P.prepare_keys(FX.comments(spark, sf_dir)))
    return keys.where(F.col("split").isin("eval", "test")).select("id", "split", "stratum")


@register(
    "seeded_shuffle",
    O.with_prepare()
    + f"SELECT id, row_number() OVER (ORDER BY {O.u('shuffle', 'id')}, id) AS shuffle_pos FROM splits WHERE split = 'train'",
)
def q_seeded_shuffle(spark, sf_dir):
    """Train rows in a seeded hash order (exact positions by the global rank)."""
    train = P.prepare_keys(FX.comments(spark, sf_dir)).where(F.col("split") == "train").select("id")
    r = global_rank(train.withColumn("_h", uniform("shuffle", "id")), "_h", "id", out="shuffle_pos")
    return r.select("id", "shuffle_pos")


# First rows kept of each split: the user's limits, one per split.
HEAD_ROWS = {"train": 40, "calib": 25, "eval": 15, "test": 10}


@register(
    "head_n",
    O.with_prepare()
    + "SELECT split, id FROM (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY id) AS rn FROM splits) "
    "WHERE rn <= CASE split " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in HEAD_ROWS.items()) + " END",
)
def q_head_n(spark, sf_dir):
    """The first N rows of each split in id order, N by split (a bounded top-k of each split: no sort of the rest)."""
    s = P.eval_without_nulls(P.prepare_keys(FX.comments(spark, sf_dir))).select("split", "id")
    out = None
    for split, n in HEAD_ROWS.items():
        top = s.where(F.col("split") == split).orderBy("id").limit(n)
        out = top if out is None else out.unionByName(top)
    return out


_TR_ROWS = []
for _k in (2, 4):
    for _lo, _hi in TARGET_RANGES[_k]:
        _TR_ROWS.append((_k, P.range_label(_lo, _hi), _lo, _hi))


def _sql_range_counts(src: str, table: str) -> str:
    parts = [
        f"SELECT '{table}' AS \"table\", CAST({k} AS BIGINT) AS num_ranges, '{lab}' AS target_range, "
        f"count(*) FILTER (WHERE target >= {O.lit(lo)} AND target < {O.lit(hi)}) AS n FROM {src}"
        for k, lab, lo, hi in _TR_ROWS
    ]
    return " UNION ALL ".join(parts)


_PROFILE_TABLES = [
    ("full", "cleaned", None),
    ("with_nulls", "cleaned", "stratum = 'with_nulls'"),
    ("without_nulls", "cleaned", "stratum = 'without_nulls'"),
    ("with_nulls_dropped", "kept", "stratum = 'with_nulls'"),
    ("without_nulls_dropped", "kept", "stratum = 'without_nulls'"),
    ("clean", "kept", None),
    ("train", "splits", "split = 'train'"),
    ("calib", "splits", "split = 'calib'"),
    ("eval", "splits", "split = 'eval'"),
    ("test", "splits", "split = 'test'"),
]


def _profile_sql() -> str:
    parts = []
    for name, src, cond in _PROFILE_TABLES:
        s = f"(SELECT * FROM {src}" + (f" WHERE {cond})" if cond else ")")
        parts.append(_sql_range_counts(s, name))
    return O.with_prepare() + " UNION ALL ".join(parts)


def _profile_frames(spark, sf_dir):
    cleaned = P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir)))
    prepared = P.split_keys(P.kept_keys(cleaned))
    pre = cleaned.select(
        "target",
        F.explode(F.array(F.lit("full"), F.concat("stratum")) ).alias("table"),
    )
    post = prepared.select(
        "target",
        F.explode(
            F.array(
                F.concat("stratum", F.lit("_dropped")),
                F.lit("clean"),
                F.when(F.col("split").isin("train", "calib") | (F.col("stratum") == P.WITHOUT_NULLS), F.col("split")),
            )
        ).alias("table"),
    ).where(F.col("table").isNotNull())
    return pre.unionByName(post)


@register("target_range_counts", _profile_sql())
def q_target_range_counts(spark, sf_dir):
    """Rows per 2 and 4 target ranges for every intermediate table of the preparation."""
    return P.target_range_counts(_profile_frames(spark, sf_dir), by=["table"])


@register(
    "shape_counts",
    O.with_prepare()
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM {src}" + (f" WHERE {cond}" if cond else "") + f") AS n_rows, "
        f"(SELECT len(struct_keys(x)) FROM (SELECT * FROM {src} LIMIT 1) x) AS n_cols"
        for name, src, cond in _PROFILE_TABLES
    ),
)
def q_shape_counts(spark, sf_dir):
    """Row and column counts of each intermediate table (one pass per stage; columns from the tables' schemas)."""
    cleaned = P.null_sentinel(P.project_columns(FX.comments(spark, sf_dir)))
    width = {"cleaned": len(cleaned.columns), "kept": len(cleaned.columns), "splits": len([*cleaned.columns, "split"])}
    n_cols = F.create_map(*[x for name, src, _ in _PROFILE_TABLES for x in (F.lit(name), F.lit(width[src]).cast("bigint"))])
    counts = _profile_frames(spark, sf_dir).groupBy("table").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("n_cols", F.element_at(n_cols, F.col("table")))


@register(
    "group_positive_counts",
    O.with_prepare()
    + " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", count(*) FILTER (WHERE {g} > 0) AS n_positive, count(*) FILTER (WHERE {g} > 0.5{O.D}) AS n_above_half, "
        f"count(*) FILTER (WHERE {g} > 0.5{O.D} AND split = 'eval' AND stratum = 'without_nulls') AS n_eval_above_half FROM prepared"
        for g in GROUPS
    ),
)
def q_group_positive_counts(spark, sf_dir):
    """Per group: count > 0 and > 0.5 on the cleaned table, > 0.5 on the eval split (one pass)."""
    prep = _prepared(spark, sf_dir)
    is_eval = (F.col("split") == "eval") & (F.col("stratum") == P.WITHOUT_NULLS)
    aggs = []
    for g in GROUPS:
        aggs += [
            F.count(F.when(F.col(g) > 0, 1)).alias(f"{g}__pos"),
            F.count(F.when(F.col(g) > 0.5, 1)).alias(f"{g}__half"),
            F.count(F.when((F.col(g) > 0.5) & is_eval, 1)).alias(f"{g}__eval"),
        ]
    one = prep.agg(*aggs)
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"{g}__pos").alias("n_positive"),
                                       F.col(f"{g}__half").alias("n_above_half"), F.col(f"{g}__eval").alias("n_eval_above_half"))
                              for g in GROUPS]))
    return one.select(rows)


def _hist_sql() -> str:
    vals = " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", CASE WHEN target > 0.5{O.D} THEN 'toxic' ELSE 'not_toxic' END AS series, {g} AS value FROM splits WHERE split = 'eval'"
        for g in GROUPS
    )
    return O.with_prepare(
        f"hv AS ({vals})",
        "hv_all AS (SELECT 'full' AS hist, * FROM hv UNION ALL SELECT 'zoom' AS hist, * FROM hv WHERE value >= 0.1::DOUBLE "
        "UNION ALL SELECT 'target' AS hist, 'ALL' AS \"group\", 'target' AS series, target AS value FROM kept)",
        "hr AS (SELECT hist, \"group\", min(value) AS lo0, max(value) AS hi0 FROM hv_all GROUP BY 1, 2)",
        "hr2 AS (SELECT hist, \"group\", CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM hr)",
    ) + (
        f"SELECT v.hist, v.\"group\", v.series, CAST(least(floor((v.value - r.lo) * ({HIST_BINS}.0::DOUBLE / (r.hi - r.lo))), {HIST_BINS - 1}) AS BIGINT) AS bin, "
        "count(*) AS n FROM hv_all v JOIN hr2 r ON v.hist = r.hist AND v.\"group\" = r.\"group\" GROUP BY 1, 2, 3, 4"
    )


@register("histogram_30", _hist_sql())
def q_histogram_30(spark, sf_dir):
    """30-bin histograms: per group toxic vs non-toxic on eval (full and zoom >= 0.1), and target.

    All three value series come from one pass over the prepared table (the kept rows after the
    down-sampling are exactly the target histogram's input), exploded into (hist, group, series).
    """
    prep = _prepared(spark, sf_dir)
    is_eval = (F.col("split") == "eval") & (F.col("stratum") == P.WITHOUT_NULLS)
    series = F.when(F.col("target") > 0.5, "toxic").otherwise("not_toxic")
    items = [F.struct(F.lit("target").alias("hist"), F.lit("ALL").alias("group"), F.lit("target").alias("series"),
                      F.col("target").alias("value"))]
    for g in GROUPS:
        v = F.col(g).cast("double")
        items.append(F.when(is_eval, F.struct(F.lit("full").alias("hist"), F.lit(g).alias("group"),
                                               series.alias("series"), v.alias("value"))))
        items.append(F.when(is_eval & (v >= HIST_ZOOM_MIN), F.struct(
            F.lit("zoom").alias("hist"), F.lit(g).alias("group"), series.alias("series"), v.alias("value"))))
    vals = prep.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
    return P.histogram(vals, ["hist", "group"], ["series"])


def _sample_sql() -> str:
    parts = []
    for i, (lo, hi) in enumerate(TARGET_RANGES[2]):
        lab = P.range_label(lo, hi)
        for d, salt in enumerate(("sample1", "sample2")):
            parts.append(
                f"(SELECT '{lab}' AS target_range, {d + 1} AS draw, id, comment_text FROM comments "
                f"WHERE target >= {O.lit(lo)} AND target < {O.lit(hi)} ORDER BY {O.u(salt, 'id')}, id LIMIT 1)"
            )
    return O.with_prepare() + "SELECT target_range, CAST(draw AS BIGINT) AS draw, id, comment_text FROM (" + " UNION ALL ".join(parts) + ")"


@register("sample_per_range", _sample_sql())
def q_sample_per_range(spark, sf_dir):
    """Two independent seeded one-row draws per target range."""
    return P.sample_per_range(FX.comments(spark, sf_dir))


@register(
    "toxic_split",
    O.with_prepare()
    + " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", CASE WHEN target > 0.5{O.D} THEN 'toxic' ELSE 'not_toxic' END AS series, count(*) AS n, "
        f"count(*) FILTER (WHERE {g} >= 0.1{O.D}) AS n_zoom FROM splits WHERE split = 'eval' GROUP BY 1, 2"
        for g in GROUPS
    ),
)
def q_toxic_split(spark, sf_dir):
    """Eval rows split at target <= 0.5 / > 0.5, with the zoom (>= 0.1) count per group."""
    ev = P.prepared_splits(FX.comments(spark, sf_dir), texts=False).where(F.col("split") == "eval")
    long = P.group_value_long(ev.withColumn("series", F.when(F.col("target") > 0.5, "toxic").otherwise("not_toxic")), ["series"])
    return long.groupBy("group", "series").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") >= HIST_ZOOM_MIN, 1)).alias("n_zoom")
    )


@register(
    "drop_missing_groups",
    O.with_prepare()
    + " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", count(*) FILTER (WHERE {g} <> -1.0{O.D} AND {g} >= 0.5{O.D}) AS n_members, "
        f"count(*) FILTER (WHERE {g} <> -1.0{O.D} AND {g} >= 0.5{O.D}) > 0 AS present FROM splits WHERE split = 'test'"
        for g in GROUPS
    ),
)
def q_drop_missing_groups(spark, sf_dir):
    """Per group: members in the test split and whether the group is scored at all."""
    from calibrix.operators.groups import member_condition

    t = P.prepared_splits(FX.comments(spark, sf_dir), texts=False).where(F.col("split") == "test")
    one = t.agg(*[F.count(F.when(member_condition(g), 1)).alias(g) for g in GROUPS])
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).alias("n_members"), (F.col(g) > 0).alias("present"))
                              for g in GROUPS]))
    return one.select(rows)


from calibrix.config import code_fingerprint, fresh_path, scratch_path  # noqa: E402
from calibrix.operators import text as TX  # noqa: E402
from calibrix.sources.tables import read_table  # noqa: E402


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


@register("scan_comments", O.with_prepare() + f"SELECT {_GL}, id, round(target, 6) AS target, comment_text FROM comments")
def q_scan_comments(spark, sf_dir):
    """Comments written as multi-line CSV and read back with the fixed schema."""
    path = fresh_path(spark, "comments_csv")
    FS.write_csv(P.project_columns(FX.comments(spark, sf_dir)), path)
    return FS.read_comments_csv(spark, path)


def _write_splits(spark, sf_dir, fmt) -> tuple[str, DataFrame]:
    path, df = fresh_path(spark, "splits"), P.prepared_splits(FX.comments(spark, sf_dir))
    FS.write_splits(df, path, fmt)
    return path, df


@register("write_splits", O.with_prepare() + "SELECT split, count(*) AS n_rows, CAST(sum(length(comment_text)) AS BIGINT) AS n_chars FROM splits GROUP BY split")
def q_write_splits(spark, sf_dir):
    """Write the four splits as CSV files partitioned by split, read them back, count rows and characters per split."""
    path, df = _write_splits(spark, sf_dir, "csv")
    back = FS.read_split(spark, path, fmt="csv", schema=df.drop("split").schema)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("comment_text")).alias("n_chars"))


@register("scan_splits", O.with_prepare() + "SELECT id, round(target, 6) AS target, stratum FROM splits WHERE split = 'eval'")
def q_scan_splits(spark, sf_dir):
    """Read one split from the partitioned table (partition pruning on ``split``)."""
    path, _ = _write_splits(spark, sf_dir, "parquet")
    return FS.read_split(spark, path, "eval").select("id", "target", "stratum")


_PAT = TX.TOKEN_PATTERN.replace("'", "''")
_TOK_SQL = (
    f"tk0 AS (SELECT doc_id, regexp_extract_all(lower(text), '{_PAT}') AS toks FROM documents), "
    "tk AS (SELECT doc_id, CAST(unnest(generate_series(0, len(toks) - 1)) AS BIGINT) AS pos, unnest(toks) AS token FROM tk0 WHERE len(toks) > 0), "
    f"vc AS (SELECT token, count(*) AS cnt FROM tk GROUP BY token HAVING count(*) >= {TX.MIN_COUNT}), "
    f"vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, ('0x' || substr(md5(token), 1, 15))::BIGINT, token) + {TX.FIRST_WORD_ID - 1} AS BIGINT) AS token_id, cnt FROM vc), "
    f"ids AS (SELECT tk.doc_id, tk.pos, tk.token, coalesce(vocab.token_id, {TX.UNK_ID}) AS token_id FROM tk LEFT JOIN vocab ON tk.token = vocab.token)"
)


@register(
    "cached_dataset",
    O.with_prepare(_TOK_SQL, f"cd AS (SELECT doc_id, count(*) AS n, sum(token_id) AS total FROM ids WHERE pos < {TX.MAX_SEQ_LEN - 2} GROUP BY doc_id)")
    + f"SELECT s.id, s.split, coalesce(n, 0) + 2 AS n_tokens, CAST(coalesce(total, 0) + {TX.CLS_ID + TX.SEP_ID} AS BIGINT) AS id_sum "
    "FROM splits s LEFT JOIN cd ON cd.doc_id = s.id",
)
def q_cached_dataset(spark, sf_dir):
    """The splits' padded token arrays, read from the cache if it was built from these files by this code, else built
    and saved. The key has the input files' names, sizes and times."""
    inputs = FS.input_listing(spark, *[f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "labels")])
    path = scratch_path(spark, "tokenised_splits", inputs, code_fingerprint())

    def build():
        enc = TX.tokenize_pad(_docs(spark, sf_dir)).withColumnRenamed("doc_id", "id")
        return P.prepared_splits(FX.comments(spark, sf_dir), texts=False).join(enc, "id")

    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return FS.materialize(spark, path, build).select("id", "split", total("attention_mask").alias("n_tokens"), total("input_ids").alias("id_sum"))


# ============================================================ forecasts: losses, groups, AUC, batches
from calibrix.config import (  # noqa: E402
    EVAL_BATCH_SIZE,
    EVAL_STEPS,
    METRIC_NAMES,
    OVERALL,
    PATIENCE,
    SWEEP_COEFFICIENTS,
)
from calibrix.functions import math as FM  # noqa: E402
from calibrix.operators import auc as AU  # noqa: E402
from calibrix.operators import calibration as CA  # noqa: E402
from calibrix.operators import losses as L  # noqa: E402
from calibrix.operators import callbacks as CB  # noqa: E402
from calibrix.operators import partials as PA  # noqa: E402
from calibrix.operators import runs as R  # noqa: E402
from calibrix.operators.ranking import shuffle_partitions  # noqa: E402
from calibrix.sources import commits as C  # noqa: E402

_D = O.D
_PRED = O.predictions_cte()
_TERMS = O.terms_cte()
_COEF = DEFAULT_COEFFICIENT
_HASHED = O.predictions_cte(hashed_ids=True)


def _terms(spark, sf_dir):
    return L.forecast_terms(FX.predictions(spark, sf_dir))


def _wp(*extra):
    return _with(_PRED, _TERMS, *extra)


@register(
    "join_forecasts",
    _wp("lab AS (SELECT row_id, label, input_r, " + _GL + " FROM predictions)", "fc AS (SELECT row_id, mean, stddev FROM predictions)")
    + "SELECT lab.row_id, round(lab.label, 6) AS label, round(lab.input_r, 6) AS input_r, " + _GL + ", round(fc.mean, 6) AS mean, round(fc.stddev, 6) AS stddev FROM lab JOIN fc ON lab.row_id = fc.row_id",
)
def q_join_forecasts(spark, sf_dir):
    """Align labels/inputs/groups with forecasts by row id: two stored tables, bucketed and sorted alike, joined without a
    shuffle."""
    p = FX.predictions(spark, sf_dir)
    n = shuffle_partitions(spark)
    lab = FS.write_bucketed(p.select("row_id", "label", "input_r", *GROUPS), "labels", "row_id", n)
    fc = FS.write_bucketed(p.select("row_id", "mean", "stddev"), "forecasts", "row_id", n)
    return lab.hint("merge").join(fc, "row_id", "inner")


@register("binarize", _wp() + "SELECT row_id, CAST(pred_label AS BIGINT) AS pred_label, CAST(target_label AS BIGINT) AS target_label FROM terms")
def q_binarize(spark, sf_dir):
    return _terms(spark, sf_dir).select("row_id", "pred_label", "target_label")


@register("group_member", _wp(O.members_cte()) + "SELECT row_id, \"group\", gval FROM members")
def q_group_member(spark, sf_dir):
    """Long membership table: (row, group) where value != -1 and value >= 0.5."""
    return G.group_members(_terms(spark, sf_dir).select("row_id", *GROUPS), keep=["row_id"])


@register("cast_groups", _wp() + "SELECT row_id, " + ", ".join(f"CAST({g} AS DOUBLE) AS {g}" for g in GROUPS) + " FROM predictions")
def q_cast_groups(spark, sf_dir):
    return FX.predictions(spark, sf_dir).select("row_id", *[F.col(g).cast("double").alias(g) for g in GROUPS])


_LOSS_SQL = {
    "loss_nll": "avg(nll)",
    "loss_cdf": "avg(cdf_gap)",
    "loss_stddev": "avg(stddev)",
    "loss_total": f"(1.0{_D}-{O.lit(_COEF)})*avg(cdf_gap) + {O.lit(_COEF)}*avg(nll)",
}


def _loss_query(name):
    col = {"loss_total": "loss"}.get(name, name)

    def fn(spark, sf_dir):
        return L.overall_losses(FX.predictions(spark, sf_dir), _COEF).select("n_rows", F.col(col).alias(name))

    fn.__doc__ = f"Whole-table {name} over the forecast rows."
    register(name, _wp() + f"SELECT count(*) AS n_rows, {O.r6(_LOSS_SQL[name], name)} FROM terms")(fn)


for _n in _LOSS_SQL:
    _loss_query(_n)


_GM = O.group_metrics_ctes(_COEF)


@register("confusion_counts", _wp(_GM) + "SELECT \"group\", tn, fp, fn, tp FROM gm")
def q_confusion_counts(spark, sf_dir):
    """tn, fp, fn, tp per kept group (balanced) and overall; never fails on one-class input."""
    return G.group_metrics(FX.predictions(spark, sf_dir), _COEF).select("group", "tn", "fp", "fn", "tp")


@register("classification_metrics", _wp(_GM) + "SELECT \"group\", " + ", ".join(O.r6(f'"{c}"', c) for c in ["FPR", "Recall", "Accuracy", "Precision", "F1"]) + " FROM gm")
def q_classification_metrics(spark, sf_dir):
    return G.group_metrics(FX.predictions(spark, sf_dir), _COEF).select("group", "FPR", "Recall", "Accuracy", "Precision", "F1")


@register("min_group_size", _wp(O.members_cte(), O.sizes_cte()) + "SELECT \"group\", n0, n1, group_size, kept FROM sizes")
def q_min_group_size(spark, sf_dir):
    """Per group: class sizes and whether min(n0, n1) reaches 50."""
    return G.group_sizes(G.group_members(_terms(spark, sf_dir)))


@register("class_counts", _wp(O.members_cte(), O.sizes_cte()) + "SELECT \"group\", n0 AS zeros, n1 AS ones FROM sizes")
def q_class_counts(spark, sf_dir):
    return G.class_counts(G.group_members(_terms(spark, sf_dir)))


@register("balanced_subset", _with(_HASHED, _TERMS, O.members_cte(), O.sizes_cte(), O.balanced_cte())
          + "SELECT \"group\", row_id, CAST(target_label AS BIGINT) AS target_label FROM balanced")
def q_balanced_subset(spark, sf_dir):
    """First min(n0, n1) members of each class per kept group, in row order (rows with hashed, sparse ids)."""
    terms = L.forecast_terms(FX.predictions(spark, sf_dir, hashed_ids=True)).select("row_id", "target_label", *GROUPS)
    return G.balanced_members(G.group_members(terms)).select("group", "row_id", "target_label")


def _sample_metrics_sql() -> str:
    return _with(_PRED, O.terms_cte(pred=_bm_sql()), O.group_metrics_ctes(DEFAULT_COEFFICIENT)) + O.gm_final()


def _bm_sql(seed=42):
    import math as _m

    z = f"(sqrt(-2.0{_D} * ln(1.0{_D} - {O.u(f'bm1_{seed}', 'row_id')})) * cos({_m.pi * 2.0!r}{_D} * {O.u(f'bm2_{seed}', 'row_id')}))"
    return f"(mean + stddev * {z})"


@register("group_metrics_sampled", _sample_metrics_sql())
def q_group_metrics_sampled(spark, sf_dir):
    """Group metrics with predictions drawn from N(mean, stddev) instead of the mean."""
    gm = G.group_metrics(FX.predictions(spark, sf_dir), _COEF, use_sample=True)
    return gm.select("group", "group_size", "n_rows", *O.GM_DOUBLES, "tn", "fp", "fn", "tp")


def _gm_long_sql(src="gm", metrics=METRIC_NAMES) -> str:
    return " UNION ALL ".join(f"SELECT \"group\", '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM {src}" for m in metrics)


def _gm_long(spark, sf_dir):
    """Long metric table; the wide table (one row per group) is written once, since the summaries
    built on it read it from several branches."""
    gm = FS.written(G.group_metrics(FX.predictions(spark, sf_dir), _COEF), "group_metrics")
    return G.metrics_long(gm, METRIC_NAMES)


def _extremes_sql(src: str, by: str = "") -> str:
    from calibrix.config import HIGHER_IS_BETTER, LOWER_IS_BETTER, MEAN_METRICS

    lo = ", ".join(f"'{m}'" for m in LOWER_IS_BETTER)
    hi = ", ".join(f"'{m}'" for m in HIGHER_IS_BETTER)
    me = ", ".join(f"'{m}'" for m in MEAN_METRICS)
    b = f"{by}, " if by else ""
    return (
        f"SELECT {b}metric, CASE WHEN metric IN ({lo}) THEN max(value) WHEN metric IN ({hi}) THEN min(value) END AS worst_group, "
        f"CASE WHEN metric IN ({lo}) THEN min(value) WHEN metric IN ({hi}) THEN max(value) END AS best_group, "
        f"avg(value) AS mean, count(*) AS n_groups FROM {src} WHERE \"group\" <> '{OVERALL}' AND metric IN ({me}) GROUP BY {b}metric"
    )


@register(
    "group_extremes",
    _wp(_GM, f"gl AS ({_gm_long_sql()})", f"ex AS ({_extremes_sql('gl')})")
    + "SELECT metric, round(worst_group, 6) AS worst_group, round(best_group, 6) AS best_group, round(mean, 6) AS mean, n_groups FROM ex",
)
def q_group_extremes(spark, sf_dir):
    """Worst / best / mean over groups per metric, by each metric's direction."""
    return R.group_extremes(_gm_long(spark, sf_dir))


@register(
    "group_spread",
    _wp(_GM, f"gl AS ({_gm_long_sql()})")
    + f"SELECT metric, round(max(value) - min(value), 6) AS spread FROM gl WHERE \"group\" <> '{OVERALL}' GROUP BY metric",
)
def q_group_spread(spark, sf_dir):
    """biggest_diffs: max - min over groups per metric."""
    return R.group_spread(_gm_long(spark, sf_dir))


_KEY_SQL = f"CASE WHEN \"group\" = '{OVERALL}' THEN metric ELSE 'eval_' || \"group\" || '_' || metric END"


@register("metric_key", _wp(_GM, f"gl AS ({_gm_long_sql()})") + f"SELECT \"group\", metric, {_KEY_SQL} AS key FROM gl")
def q_metric_key(spark, sf_dir):
    """``eval_{group}_{metric}`` keys (bare metric names for the overall row)."""
    from calibrix.functions.strings import metric_key

    return _gm_long(spark, sf_dir).select("group", "metric", metric_key("eval", "group", "metric").alias("key"))


@register("merge_metrics", _wp(_GM, f"gl AS ({_gm_long_sql()})") + f"SELECT {_KEY_SQL} AS key, round(value, 6) AS value FROM gl")
def q_merge_metrics(spark, sf_dir):
    """Group metric keys and overall keys in one (key, value) table (bag union)."""
    from calibrix.functions.strings import metric_key

    lg = _gm_long(spark, sf_dir)
    grp = lg.where(F.col("group") != OVERALL).select(metric_key("eval", "group", "metric").alias("key"), "value")
    ov = lg.where(F.col("group") == OVERALL).select(F.col("metric").alias("key"), "value")
    return grp.unionByName(ov)


@register("metrics_map", _wp(_GM, f"gl AS ({_gm_long_sql()})") + "SELECT \"group\", metric AS key, round(value, 6) AS value FROM gl")
def q_metrics_map(spark, sf_dir):
    """Per group a ``map<metric, value>`` (bounded: one entry per metric), exploded for checking."""
    lg = _gm_long(spark, sf_dir)
    maps = lg.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    return maps.select("group", F.explode("m").alias("key", "value"))


def _suffix_sql():
    from calibrix.config import MEAN_METRICS

    parts = [
        f"SELECT '{m}' AS metric, key, round(value, 6) AS value FROM mk WHERE key LIKE '%{m}' AND key <> '{m}' AND key <> 'biggest_diffs_{m}'"
        for m in MEAN_METRICS
    ]
    return _wp(_GM, f"gl AS ({_gm_long_sql()})", f"mk AS (SELECT {_KEY_SQL} AS key, value FROM gl)") + " UNION ALL ".join(parts)


@register("metric_suffix_filter", _suffix_sql())
def q_metric_suffix_filter(spark, sf_dir):
    """Keys ending with a metric name, excluding the overall key and ``biggest_diffs_*``."""
    from calibrix.config import MEAN_METRICS
    from calibrix.functions.strings import metric_key

    lg = _gm_long(spark, sf_dir).select(metric_key("eval", "group", "metric").alias("key"), "value")
    out = None
    for m in MEAN_METRICS:
        part = lg.where(F.col("key").endswith(m) & (F.col("key") != m) & (F.col("key") != f"biggest_diffs_{m}")).select(
            F.lit(m).alias("metric"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


from calibrix.config import SWEEP_LEARNING_RATES  # noqa: E402
from calibrix.functions.strings import py_run_name  # noqa: E402

# The grid as SQL VALUES; run names by the Python form (the Spark side builds them with the column
# function, so the oracle checks one against the other).
_GRID_VALUES = ", ".join(f"({lr!r}{_D}, {c!r}{_D}, '{py_run_name(42, c, lr)}')"
                         for lr in SWEEP_LEARNING_RATES for c in SWEEP_COEFFICIENTS)


@register(
    "alpha_sweep",
    _wp(f"st AS (SELECT avg(cdf_gap) AS lc, avg(nll) AS ln FROM terms)",
        f"sw AS (SELECT g.coefficient, (1.0{_D} - g.coefficient) * lc + g.coefficient * ln AS eval_loss FROM st, (VALUES {_GRID_VALUES}) g(learning_rate, coefficient, run_name))")
    + "SELECT arg_min(coefficient, eval_loss) AS best_coefficient, round(min(eval_loss), 6) AS best_eval_loss, count(*) AS n_runs FROM sw",
)
def q_alpha_sweep(spark, sf_dir):
    """Coefficient of the grid with the lowest eval loss (one data pass, algebra on alpha)."""
    return L.best_alpha(L.alpha_sweep(FX.predictions(spark, sf_dir), SWEEP_COEFFICIENTS))


@register(
    "grid_cross",
    _wp(f"st AS (SELECT avg(cdf_gap) AS lc, avg(nll) AS ln FROM terms)")
    + f"SELECT g.learning_rate, g.coefficient, g.run_name, round((1.0{_D} - g.coefficient) * lc + g.coefficient * ln, 6) AS eval_loss "
    f"FROM st, (VALUES {_GRID_VALUES}) g(learning_rate, coefficient, run_name)",
)
def q_grid_cross(spark, sf_dir):
    """Every grid point applied to the data: run name and eval loss per (learning rate, coefficient)."""
    grid = R.param_grid(spark).select("learning_rate", "coefficient", "run_name")
    sweep = L.alpha_sweep(FX.predictions(spark, sf_dir), SWEEP_COEFFICIENTS)
    # The grid holds one row per parameter combination (fixed, small): broadcast.
    return sweep.join(F.broadcast(grid), "coefficient").select("learning_rate", "coefficient", "run_name", "eval_loss")


def _auc_from(src: str) -> str:
    return (
        f"ar AS (SELECT scope, target_label, rank() OVER (PARTITION BY scope ORDER BY pred_value) + "
        f"(count(*) OVER (PARTITION BY scope, pred_value) - 1) / 2.0{_D} AS r FROM {src}), "
        "ag AS (SELECT scope, count(*) FILTER (WHERE target_label = 1) AS n_pos, count(*) FILTER (WHERE target_label = 0) AS n_neg, "
        "sum(CASE WHEN target_label = 1 THEN r ELSE 0 END) AS rs FROM ar GROUP BY scope)"
    )


_AUC_FINAL = (
    "SELECT scope AS \"group\", n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN "
    f"round((rs - n_pos * (n_pos + 1) / 2.0{_D}) / (n_pos * n_neg), 6) END AS auc FROM ag"
)


@register(
    "auc_full",
    _wp(O.members_cte(), f"sc AS (SELECT '{OVERALL}' AS scope, pred_value, target_label FROM terms UNION ALL "
        "SELECT \"group\" AS scope, pred_value, target_label FROM members)", _auc_from("sc")) + _AUC_FINAL,
)
def q_auc_full(spark, sf_dir):
    """Exact ROC AUC of the clipped mean against the binarised label: overall and per group."""
    sc = G.with_scopes(_terms(spark, sf_dir), ["pred_value", "target_label"])
    return AU.auc(sc, by=["group"])


def _bg_sql(kind: str) -> str:
    parts = []
    for g in GROUPS:
        inside = f"({g} <> -1.0{_D} AND {g} >= 0.5{_D})"
        if kind == "bpsn":
            cond = f"(target_label = 1 AND NOT {inside}) OR (target_label = 0 AND {inside})"
        else:
            cond = f"(target_label = 0 AND NOT {inside}) OR (target_label = 1 AND {inside})"
        parts.append(f"SELECT '{g}' AS scope, row_id, pred_value, target_label FROM terms WHERE {cond}")
    return " UNION ALL ".join(parts)


for _kind in ("bpsn", "bnsp"):
    def _mk(kind):
        def fn(spark, sf_dir):
            bg = AU.background_subgroup(_terms(spark, sf_dir), kind)
            return AU.auc(bg, by=["group"])

        fn.__doc__ = f"{kind.upper()} AUC per group (background/subgroup mix of opposite classes)."
        register(f"auc_{kind}", _wp(f"sc AS ({_bg_sql(kind)})", _auc_from("sc")) + _AUC_FINAL)(fn)

    _mk(_kind)


@register(
    "group_background",
    _wp(f"bp AS ({_bg_sql('bpsn')})", f"bn AS ({_bg_sql('bnsp')})")
    + "SELECT a.scope AS \"group\", a.n AS n_bpsn, b.n AS n_bnsp FROM (SELECT scope, count(*) AS n FROM bp GROUP BY scope) a "
    "JOIN (SELECT scope, count(*) AS n FROM bn GROUP BY scope) b ON a.scope = b.scope",
)
def q_group_background(spark, sf_dir):
    """Per group: sizes of the BPSN and BNSP row sets (predicate across class and membership), in one aggregate."""
    tox, one = F.col("target_label") == 1, _terms(spark, sf_dir)
    aggs = []
    for g in GROUPS:
        inside = G.member_condition(g)
        aggs += [F.count(F.when(tox != inside, 1)).alias(f"{g}__p"), F.count(F.when(tox == inside, 1)).alias(f"{g}__n")]
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"{g}__p").alias("n_bpsn"), F.col(f"{g}__n").alias("n_bnsp"))
                              for g in GROUPS]))
    return one.agg(*aggs).select(rows)


@register(
    "pairwise_gap",
    _wp(O.members_cte(), f"sc AS (SELECT '{OVERALL}' AS scope, cdf, input_r FROM terms UNION ALL SELECT \"group\", cdf, input_r FROM members)")
    + "SELECT x.scope AS \"group\", count(*) // (SELECT count(*) FROM sc s WHERE s.scope = x.scope) AS n_x, "
    "(SELECT count(*) FROM sc s WHERE s.scope = x.scope) AS n_y, round(avg(abs(x.cdf - y.input_r)), 6) AS pairwise_gap "
    "FROM sc x JOIN sc y ON x.scope = y.scope GROUP BY x.scope",
)
def q_pairwise_gap(spark, sf_dir):
    """Mean |PIT_i - r_j| over all pairs (the broadcast-shaped cdf loss), overall and per group,
    by the sorted-gap identity (the oracle enumerates the pairs)."""
    sc = G.with_scopes(_terms(spark, sf_dir), ["cdf", "input_r"])
    return L.pairwise_gap_cols(sc, "cdf", "input_r", by=["group"])


_B = EVAL_BATCH_SIZE
_BATCH_SQL = f"bt AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {_B} AS batch_id FROM terms)"


@register("batch_index", _with(_HASHED, _TERMS, _BATCH_SQL) + "SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id FROM bt")
def q_batch_index(spark, sf_dir):
    """Consecutive batches of 64 labelled rows in row order (hashed, sparse row ids)."""
    rows = FX.predictions(spark, sf_dir, hashed_ids=True).where(F.col("label").isNotNull())
    return L.batch_ids(rows.select("row_id"), _B)


_BATCH_AGG = (
    f"bl AS (SELECT batch_id, count(*) AS n, (1.0{_D}-{O.lit(_COEF)})*avg(cdf_gap) + {O.lit(_COEF)}*avg(nll) AS loss, "
    "avg(cdf_gap) AS loss_cdf, avg(stddev) AS loss_stddev, avg(nll) AS loss_nll FROM bt GROUP BY batch_id), "
    "bp AS (SELECT x.batch_id, avg(abs(x.cdf - y.input_r)) AS loss_cdf_pairs FROM bt x JOIN bt y ON x.batch_id = y.batch_id GROUP BY x.batch_id)"
)


@register(
    "concat_batches",
    _wp(_BATCH_SQL, _BATCH_AGG)
    + "SELECT bl.batch_id, n, " + ", ".join(O.r6(c, c) for c in ["loss", "loss_cdf", "loss_stddev", "loss_nll", "loss_cdf_pairs"])
    + " FROM bl JOIN bp ON bl.batch_id = bp.batch_id",
)
def q_concat_batches(spark, sf_dir):
    """Per-batch results concatenated in batch order (one table; no driver-side concat)."""
    return L.batch_losses(FX.predictions(spark, sf_dir), _B, _COEF).select(
        "batch_id", "n", "loss", "loss_cdf", "loss_stddev", "loss_nll", "loss_cdf_pairs")


@register(
    "batched_eval_loss",
    _wp(_BATCH_SQL, _BATCH_AGG)
    + "SELECT count(*) AS n_batches, round(avg(loss), 6) AS eval_loss, round(avg(loss_cdf), 6) AS eval_cdf_loss, "
    "round(avg(loss_nll), 6) AS eval_nll_loss, round(sum(loss * n) / sum(n), 6) AS eval_loss_rows, "
    "round(sum(loss_cdf_pairs * n) / sum(n), 6) AS eval_cdf_loss_pairs FROM bl JOIN bp ON bl.batch_id = bp.batch_id",
)
def q_batched_eval_loss(spark, sf_dir):
    """Mean of batch means, the row-weighted mean and the in-batch all-pairs cdf form (B = 64)."""
    return L.batched_eval_loss(FX.predictions(spark, sf_dir), _B, _COEF)


@register(
    "partial_final_eval",
    _wp(O.members_cte(), f"sc AS (SELECT '{OVERALL}' AS scope, cdf_gap, nll, stddev FROM terms UNION ALL SELECT \"group\", cdf_gap, nll, stddev FROM members)")
    + "SELECT scope AS \"group\", count(*) AS n, round(avg(cdf_gap), 6) AS loss_cdf, round(avg(nll), 6) AS loss_nll, "
    "round(avg(stddev), 6) AS loss_stddev FROM sc GROUP BY scope",
)
def q_partial_final_eval(spark, sf_dir):
    """Losses over all members, overall and per group, from partial statistics that are stored every few input files: the
    forecasts arrive as files in two lots, each evaluated by a run of its own, the second over the new files only."""
    source, store = fresh_path(spark, "forecast_files"), fresh_path(spark, "loss_partials")
    p = FX.predictions(spark, sf_dir)
    early = F.pmod(F.xxhash64("row_id"), F.lit(3)) > 0
    for lot in (p.where(early), p.where(~early)):
        lot.write.mode("append").parquet(source)
        PA.flush_partials(spark, source, store, schema=p.schema)
    return PA.final_losses(spark, store)


_SCOPES_SQL = f"sc AS (SELECT '{OVERALL}' AS \"group\", * FROM terms UNION ALL BY NAME SELECT * FROM members)"
_BALANCED_SQL = ("SELECT \"group\", 'balanced_accuracy' AS metric, round((coalesce(avg(CASE WHEN target_label = 0 THEN 1.0{d} - pred_label END), 0.0{d}) "
                 "+ coalesce(avg(CASE WHEN target_label = 1 THEN pred_label::DOUBLE END), 0.0{d})) / 2, 6) AS value FROM {src} GROUP BY \"group\" "
                 "UNION ALL SELECT \"group\", 'nll_mean', round(avg(nll), 6) FROM {src} GROUP BY \"group\" "
                 "UNION ALL SELECT \"group\", 'nll_spread', round(stddev_pop(nll), 6) FROM {src} GROUP BY \"group\"").replace("{d}", _D)


@register("callback_metrics", _wp(O.members_cte(), _SCOPES_SQL) + _BALANCED_SQL.format(src="sc"))
def q_callback_metrics(spark, sf_dir):
    """Metrics of the user's (balanced accuracy; mean and spread of a loss by merged moments), overall and per group, as partial
    states per task that are merged."""
    return CB.evaluate(FX.predictions(spark, sf_dir), [CB.BalancedAccuracy(), CB.Spread("nll")])


def _halfway(fc: DataFrame) -> DataFrame:
    return fc.withColumn("mean", F.lit(0.25) + F.lit(0.5) * F.col("mean")).withColumn("stddev", F.lit(2.0) * F.col("stddev"))


@register("preprocess_forecasts", _with(_PRED, f"pp AS (SELECT * REPLACE (0.25{_D} + 0.5{_D} * mean AS mean, 2.0{_D} * stddev AS stddev) FROM predictions)",
                                        O.terms_cte(src="pp"), O.members_cte(), _SCOPES_SQL) + _BALANCED_SQL.format(src="sc"))
def q_preprocess_forecasts(spark, sf_dir):
    """The same after a transform of the user's on the forecasts."""
    return CB.evaluate(FX.predictions(spark, sf_dir), [CB.BalancedAccuracy(), CB.Spread("nll")], preprocess=_halfway)


_PIT_SQL = (
    f"pr AS (SELECT row_id, mean, stddev, {O.cdf()} AS pit FROM predictions WHERE label IS NOT NULL), "
    "pr2 AS (SELECT *, row_number() OVER (ORDER BY pit, row_id) AS pos, count(*) OVER () AS n FROM pr), "
    f"pr3 AS (SELECT *, CASE WHEN n > 1 THEN (pos - 1) / (n - 1)::DOUBLE ELSE 0.0{_D} END AS q, "
    f"least(greatest(pit, 1e-6{_D}), 1.0{_D} - 1e-6{_D}) AS cdf FROM pr2)"
)


@register("pit_rank", _wp(_PIT_SQL) + "SELECT row_id, pos, round(q, 6) AS q, round(cdf, 6) AS cdf FROM pr3")
def q_pit_rank(spark, sf_dir):
    """PIT sorted and paired with linspace(0, 1, n); PIT clipped to [1e-6, 1 - 1e-6]."""
    p = FX.predictions(spark, sf_dir).select("row_id", "label", "mean", "stddev")
    return CA.pit_rank(p).select("row_id", "pos", "q", "cdf")


@register("sort_by_pit", _wp(_PIT_SQL) + "SELECT pos, row_id, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(pit, 6) AS pit FROM pr3")
def q_sort_by_pit(spark, sf_dir):
    """(mean, stddev, PIT) in the order of the PIT, with each row's position."""
    r = CA.pit_rank(FX.predictions(spark, sf_dir).select("row_id", "label", "mean", "stddev"))
    return r.select("pos", "row_id", "mean", "stddev", F.col("_pit").alias("pit")).orderBy("pos")


@register(
    "calibration_mse",
    _wp(_PIT_SQL)
    + f"SELECT count(*) AS n_rows, round(avg(pow({O.cdf('q', 'mean', 'stddev')} - q, 2)), 6) AS mse, "
    "round(avg(pow(cdf - q, 2)), 6) AS pit_grid_mse FROM pr3",
)
def q_calibration_mse(spark, sf_dir):
    """Calibration MSE of the uncalibrated forecasts on the PIT-sorted grid, and PIT-vs-grid error."""
    return CA.calibration_mse(CA.pit_rank(FX.predictions(spark, sf_dir).select("row_id", "label", "mean", "stddev")))


@register("linspace", _wp("nn AS (SELECT count(*) AS n FROM predictions)")
          + f"SELECT i, round(CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0.0{_D} END, 6) AS q FROM nn, range(n) t(i)")
def q_linspace(spark, sf_dir):
    """n evenly spaced points on [0, 1], n = forecast rows (generated by range, split over tasks)."""
    n = FX.predictions(spark, sf_dir).count()
    q = F.col("id") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return spark.range(0, n).select(F.col("id").alias("i"), q.alias("q"))


@register("normal_cdf", _wp() + f"SELECT row_id, round((label - mean) / stddev, 6) AS z, round({O.cdf()}, 6) AS cdf FROM predictions")
def q_normal_cdf(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    return p.select("row_id", ((F.col("label") - F.col("mean")) / F.col("stddev")).alias("z"), FM.normal_cdf("label", "mean", "stddev").alias("cdf"))


@register("normal_nll", _wp() + f"SELECT row_id, round({O.nll()}, 6) AS nll FROM predictions")
def q_normal_nll(spark, sf_dir):
    return FX.predictions(spark, sf_dir).select("row_id", FM.gaussian_nll("label", "mean", "stddev").alias("nll"))


@register("sample_forecast", _wp() + f"SELECT row_id, round({_bm_sql()}, 6) AS sample, round({O.clamp(_bm_sql())}, 6) AS pred_value, "
          f"CAST({O.clamp(_bm_sql())} > 0.5{_D} AS BIGINT) AS pred_label FROM predictions")
def q_sample_forecast(spark, sf_dir):
    """A seeded draw from N(mean, stddev) per row (Box-Muller), clipped and binarised."""
    p = FX.predictions(spark, sf_dir)
    s = FM.sample_normal("mean", "stddev", "row_id")
    return p.select("row_id", s.alias("sample"), FM.clamp(s).alias("pred_value"), (FM.clamp(s) > 0.5).cast("int").alias("pred_label"))


@register("clamp", _wp(_PIT_SQL) + f"SELECT p.row_id, round({O.clamp('p.mean')}, 6) AS mean_clipped, round(pr3.cdf, 6) AS pit_clipped "
          "FROM predictions p LEFT JOIN pr3 ON p.row_id = pr3.row_id")
def q_clamp(spark, sf_dir):
    """Clip predictions to [0, 1] and the PIT to [1e-6, 1 - 1e-6]."""
    from calibrix.config import PIT_CLIP

    p = FX.predictions(spark, sf_dir)
    return p.select("row_id", FM.clamp("mean").alias("mean_clipped"),
                    FM.clamp(FM.normal_cdf("label", "mean", "stddev"), PIT_CLIP, 1 - PIT_CLIP).alias("pit_clipped"))


@register("attach_r", _wp() + f"SELECT row_id, round({O.u('r42', 'row_id')} * 1.0{_D}, 6) AS input_r FROM predictions")
def q_attach_r(spark, sf_dir):
    """Seeded uniform r in [0, bound) per row, stable under repartitioning."""
    from calibrix.functions.random import attach_r

    return FX.predictions(spark, sf_dir).select("row_id", attach_r("row_id", 42, 1.0).alias("input_r"))


# ============================================================ runs: eval log, schedule, sweep summaries
_EL = O.eval_log_cte()


def _patience_sql() -> str:
    return (
        "el1 AS (SELECT *, min(eval_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM eval_log), "
        "el2 AS (SELECT *, (prev_best IS NULL OR eval_loss < prev_best) AS improved FROM el1), "
        "el3 AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl, "
        "min(eval_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss FROM el2), "
        "el4 AS (SELECT *, row_number() OVER (PARTITION BY run_id, isl ORDER BY step) - 1 AS bad, "
        "max(CASE WHEN improved THEN step END) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_step FROM el3)"
    )


@register(
    "early_stop",
    _with(_EL, _patience_sql())
    + f"SELECT r.run_id, r.n_evals, s.stop_step, round(coalesce(s.best_loss, r.bl), 6) AS best_loss, coalesce(s.best_step, r.bs) AS best_step FROM "
    "(SELECT run_id, count(*) AS n_evals, min(eval_loss) AS bl, arg_min(step, eval_loss) AS bs FROM eval_log GROUP BY run_id) r LEFT JOIN "
    f"(SELECT run_id, arg_min(step, step) AS stop_step, arg_min(best_loss, step) AS best_loss, arg_min(best_step, step) AS best_step FROM el4 WHERE bad >= {PATIENCE} GROUP BY run_id) s "
    "ON r.run_id = s.run_id",
)
def q_early_stop(spark, sf_dir):
    """Patience 3: first step after three non-improving evaluations, per run."""
    return R.early_stop(FX.eval_log(spark, sf_dir), PATIENCE)


@register("best_step", _with(_EL, _patience_sql()) + "SELECT run_id, step, round(best_loss, 6) AS best_loss, best_step, improved, bad FROM el4")
def q_best_step(spark, sf_dir):
    """Running best loss and the step of its checkpoint, per run and evaluation."""
    t = R.patience_trace(FX.eval_log(spark, sf_dir))
    return t.select("run_id", "step", "best_loss", "best_step", "improved", "bad")


@register("every_k_steps", _with(_EL) + "SELECT run_id, step, eval_loss FROM eval_log WHERE step % 5 = 0")
def q_every_k_steps(spark, sf_dir):
    """Keep evaluations whose step is a multiple of 5."""
    return FX.eval_log(spark, sf_dir).where(F.col("step") % 5 == 0)


@register(
    "stamp",
    "SELECT event_id, strftime(ts, '%Y_%m_%d') AS day, strftime(ts, '%H_%M') AS hm FROM events",
)
def q_stamp(spark, sf_dir):
    """``yyyy_MM_dd`` and ``HH_mm`` stamps of each event time."""
    from calibrix.functions.strings import stamp_day, stamp_minute
    from calibrix.sources.tables import read_table

    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    return ev.select("event_id", stamp_day("ts").alias("day"), stamp_minute("ts").alias("hm"))


def _lr_sql() -> str:
    from calibrix.config import NUM_EPOCHS, TRAIN_BATCH_SIZE, WARMUP_RATIO

    return O.with_prepare(
        f"tt AS (SELECT CAST(floor(count(*) / {float(TRAIN_BATCH_SIZE)!r}{_D} * {float(NUM_EPOCHS)!r}{_D}) AS BIGINT) AS total FROM splits WHERE split = 'train')",
        f"tw AS (SELECT total, CAST(floor({WARMUP_RATIO!r}{_D} * total) AS BIGINT) AS warmup FROM tt)",
    ) + (
        "SELECT s AS step, 1e-5::DOUBLE AS base_lr, round(CASE WHEN s < warmup THEN s / greatest(1, warmup)::DOUBLE "
        "ELSE greatest(0.0::DOUBLE, (total - s) / greatest(1, total - warmup)::DOUBLE) END, 6) AS lr_factor FROM tw, range(total) t(s)"
    )


@register("lr_schedule", _lr_sql())
def q_lr_schedule(spark, sf_dir):
    """Linear warm-up / decay for int(n_train / 8 * 3) steps: lr = base_lr * lr_factor."""
    from calibrix.config import NUM_EPOCHS, TRAIN_BATCH_SIZE

    n = P.prepare_keys(FX.comments(spark, sf_dir)).where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"))
    s = R.lr_schedule(spark, n, 1e-5, TRAIN_BATCH_SIZE, NUM_EPOCHS)
    return s.select("step", F.lit(1e-5).alias("base_lr"), (F.col("lr") / F.lit(1e-5)).alias("lr_factor"))


def _sweep_long(spark, sf_dir, coefficients=SWEEP_COEFFICIENTS):
    """Long metric table per run of the coefficient grid, each run with its own forecasts and weighting of the losses.

    The wide group table (a row per run and group) is written once: the trade-off summaries read it from several
    branches."""
    gm = G.group_metrics(FX.run_predictions(spark, sf_dir, coefficients), _COEF, by=["coefficient"])
    gm = FS.written(gm, "group_metrics").withColumn(
        "loss", (F.lit(1.0) - F.col("coefficient")) * F.col("loss_cdf") + F.col("coefficient") * F.col("loss_nll"))
    return G.metrics_long(gm, METRIC_NAMES, by=["coefficient"])


_SWEEP = (O.run_predictions_cte(SWEEP_COEFFICIENTS), O.terms_cte(src="run_predictions"), O.group_metrics_ctes(_COEF, by="coefficient"))


def _sweep_long_sql() -> str:
    runs = f"runs AS (SELECT * REPLACE ((1.0{_D} - coefficient) * loss_cdf + coefficient * loss_nll AS loss) FROM gm)"
    longq = " UNION ALL ".join(
        f"SELECT coefficient, \"group\", '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM runs" for m in METRIC_NAMES)
    return f"{runs}, sl AS ({longq})"


def _tradeoff_sql(compat: bool = False) -> str:
    pairs = R.tradeoff_pairs(compat)
    ks = (
        "sk AS (SELECT coefficient, metric AS key, value FROM sl WHERE \"group\" = 'ALL' "
        "UNION ALL SELECT coefficient, metric || '_worst_group', worst_group FROM ex WHERE worst_group IS NOT NULL "
        "UNION ALL SELECT coefficient, metric || '_best_group', best_group FROM ex WHERE best_group IS NOT NULL "
        "UNION ALL SELECT coefficient, metric || '_mean', mean FROM ex)"
    )
    parts = [
        f"SELECT a.coefficient, CAST({i} AS BIGINT) AS pair, '{x}' AS key_x, '{y}' AS key_y, round(a.value, 6) AS x, round(b.value, 6) AS y "
        f"FROM sk a JOIN sk b ON a.coefficient = b.coefficient AND a.key = '{x}' AND b.key = '{y}'"
        for i, (x, y) in enumerate(pairs)
    ]
    return _with(_PRED, *_SWEEP, _sweep_long_sql(), f"ex AS ({_extremes_sql('sl', 'coefficient')})", ks) + " UNION ALL ".join(parts)


@register("tradeoff_points", _tradeoff_sql())
def q_tradeoff_points(spark, sf_dir):
    """Per run of the coefficient grid, the (x, y) points of the 14 trade-off scatters whose keys exist."""
    return R.tradeoff_points(_sweep_long(spark, sf_dir), ["coefficient"]).withColumn("pair", F.col("pair").cast("bigint"))


@register("metric_point_append", _tradeoff_sql())
def q_metric_point_append(spark, sf_dir):
    """Append the runs' points (with a wall-clock stamp) to the scatter table and read it back without the stamp: the
    first runs create the table, later runs are appended to it by a second write, which is repeated and counts once."""
    pts = FS.written(R.tradeoff_points(_sweep_long(spark, sf_dir), ["coefficient"]).withColumn("pair", F.col("pair").cast("bigint")), "points")
    path, last = fresh_path(spark, "plot_points"), SWEEP_COEFFICIENTS[-1]
    for key, runs in (("first", F.col("coefficient") < last), ("last", F.col("coefficient") == last), ("last", F.col("coefficient") == last)):
        C.append_once(pts.where(runs).withColumn("timestamp", F.current_timestamp()), path, key, partition_by=["pair"])
    return C.read_committed(spark, path, pts.schema)


@register(
    "metric_log",
    _with(_PRED, *_SWEEP, _sweep_long_sql())
    + f"SELECT coefficient AS run_coefficient, CAST(st.step AS BIGINT) AS step, CASE WHEN \"group\" = '{OVERALL}' THEN metric ELSE 'eval_' || \"group\" || '_' || metric END AS key, "
    f"round(value, 6) AS value FROM sl, (VALUES (0), ({EVAL_STEPS})) st(step) WHERE st.step = 0 OR coefficient > 0",
)
def q_metric_log(spark, sf_dir):
    """Long-form metric log per run, partitioned by run: every run's first record, then a second append with the records
    of the runs that went on to the next evaluation step; each under a commit record, so that a retry doesn't double rows."""
    from calibrix.functions.strings import metric_key

    lg = FS.written(_sweep_long(spark, sf_dir).select(
        F.col("coefficient").alias("run_coefficient"), metric_key("eval", "group", "metric").alias("key"), "value"), "metric_log_rows")
    path = fresh_path(spark, "metric_log")
    for step, rows in ((0, lg), (EVAL_STEPS, lg.where(F.col("run_coefficient") > 0))):
        C.append_once(rows.withColumn("step", F.lit(step).cast("bigint")), path, f"step {step}", partition_by=["run_coefficient"])
    return C.read_committed(spark, path, lg.withColumn("step", F.lit(0).cast("bigint")).schema).select("run_coefficient", "step", "key", "value")


# ============================================================ embeddings: activations, heads, features
def _emb(spark, sf_dir):
    from calibrix.sources.tables import read_table

    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


_EMB_LONG = "el AS (SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@register("sigmoid_stddev", _with(_EMB_LONG) + f"SELECT vec_id, pos, round(1.0{_D} / (1.0{_D} + exp(-x)) * 5.0{_D} + 0.01{_D}, 6) AS stddev FROM el")
def q_sigmoid_stddev(spark, sf_dir):
    """Scale head sigmoid(x) * 5 + 0.01 of every embedding coordinate."""
    e = _emb(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), FM.sigmoid_stddev(F.col("x").cast("double")).alias("stddev"))


@register("leaky_relu", _with(_EMB_LONG) + f"SELECT vec_id, pos, round(CASE WHEN x > 0 THEN x ELSE 0.01{_D} * x END, 6) AS leaky, round(greatest(x, 0.0{_D}), 6) AS relu FROM el")
def q_leaky_relu(spark, sf_dir):
    """Leaky ReLU (slope 0.01) and ReLU of every embedding coordinate."""
    e = _emb(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), FM.leaky_relu("x").alias("leaky"), FM.relu("x").alias("relu"))


# How often r is appended to the features.
INPUT_R_DIM = 2


@register(
    "concat_feature",
    _with(_EMB_LONG) + f"SELECT vec_id, pos, round(x, 6) AS x FROM el UNION ALL SELECT vec_id, CAST(len(embedding) + k AS BIGINT) AS pos, "
    f"round({O.u('r42', 'vec_id')}, 6) AS x FROM embeddings, range({INPUT_R_DIM}) t(k)",
)
def q_concat_feature(spark, sf_dir):
    """Feature vector with r appended ``INPUT_R_DIM`` times, exploded to (vec_id, pos, x)."""
    from calibrix.functions.random import attach_r

    e = _emb(spark, sf_dir)
    feat = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array_repeat(attach_r("vec_id"), INPUT_R_DIM))
    return e.select("vec_id", F.posexplode(feat).alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))


# ============================================================ text: vocabulary lookup, tokenise + pad
@register("vocab_lookup", _with(_TOK_SQL) + "SELECT doc_id, pos, token_id FROM ids")
def q_vocab_lookup(spark, sf_dir):
    """Every token of every document mapped to its id in a vocabulary built from the corpus."""
    toks = TX.tokens(TX.dealt(_docs(spark, sf_dir)))
    return TX.lookup(toks, TX.build_vocab(toks)).select("doc_id", "pos", "token_id")


def _encode_sql() -> str:
    keep = 510
    return _with(
        _TOK_SQL,
        f"nd AS (SELECT d.doc_id, least(coalesce(len(t.toks), 0), {keep}) AS n FROM documents d JOIN tk0 t ON d.doc_id = t.doc_id)",
        "grid AS (SELECT nd.doc_id, nd.n, CAST(p AS BIGINT) AS pos FROM nd, range(512) r(p))",
    ) + (
        f"SELECT g.doc_id, g.pos, CAST(CASE WHEN g.pos = 0 THEN {TX.CLS_ID} WHEN g.pos <= g.n THEN i.token_id "
        f"WHEN g.pos = g.n + 1 THEN {TX.SEP_ID} ELSE {TX.PAD_ID} END AS BIGINT) AS input_id, "
        "CAST(CASE WHEN g.pos <= g.n + 1 THEN 1 ELSE 0 END AS BIGINT) AS attention_mask "
        "FROM grid g LEFT JOIN ids i ON g.doc_id = i.doc_id AND i.pos = g.pos - 1"
    )


@register("tokenize_pad", _encode_sql())
def q_tokenize_pad(spark, sf_dir):
    """512-long input ids and attention mask per document, exploded to (doc_id, pos, ...)."""
    enc = TX.tokenize_pad(_docs(spark, sf_dir))
    z = F.arrays_zip("input_ids", "attention_mask")
    return enc.select("doc_id", F.posexplode(z).alias("pos", "e")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("e.input_ids").alias("input_id"),
        F.col("e.attention_mask").alias("attention_mask"))


# Words that are pieces of their own; the others are cut.
SUBWORD_SIZE = 1000
_PIECES_SQL = (
    _TOK_SQL, "words AS (SELECT DISTINCT token FROM tk)",
    f"pieces AS (SELECT token AS piece, token_id AS piece_id FROM vocab WHERE token_id < {TX.FIRST_WORD_ID + SUBWORD_SIZE} "
    f"UNION ALL SELECT c, CAST(ord(c) + {TX.FIRST_WORD_ID + SUBWORD_SIZE} AS BIGINT) FROM (SELECT DISTINCT unnest(string_split(token, '')) AS c FROM words) "
    f"WHERE c NOT IN (SELECT token FROM vocab WHERE token_id < {TX.FIRST_WORD_ID + SUBWORD_SIZE}))",
    "longest AS (SELECT max(length(piece)) AS n FROM pieces)",
    "ends AS (SELECT token, CAST(unnest(range(1, length(token) + 1)) AS BIGINT) AS p FROM words)",
    "found AS (SELECT token, p, max(l) AS l, arg_max(piece_id, l) AS piece_id FROM (SELECT token, p, CAST(unnest(range(1, least(length(token) - p + 1, n) + 1)) AS BIGINT) AS l "
    "FROM ends, longest) JOIN pieces ON piece = substr(token, p, l) GROUP BY token, p)",
    "hop AS (SELECT token, CAST(1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS k FROM words UNION ALL "
    "SELECT hop.token, hop.p + found.l, hop.k + 1 FROM hop JOIN found ON hop.token = found.token AND hop.p = found.p)",
    "cut AS (SELECT hop.token, k, piece_id FROM hop JOIN found ON hop.token = found.token AND hop.p = found.p)",
)


@register("subword_lookup", "WITH RECURSIVE " + ", ".join(_PIECES_SQL) + " SELECT doc_id, pos, token, k, piece_id FROM tk JOIN cut USING (token)")
def q_subword_lookup(spark, sf_dir):
    """J5 with pieces: every token of every document cut into the longest pieces of a vocabulary of frequent words and characters."""
    rows = TX.subword_lookup(_docs(spark, sf_dir), SUBWORD_SIZE)
    return rows.select("doc_id", "pos", "token", F.posexplode("piece_ids").alias("k", "piece_id")).where("token is not null").withColumn("k", F.col("k").cast("bigint"))


@register("subword_pad", "WITH RECURSIVE " + ", ".join(_PIECES_SQL) + f""",
flat AS (SELECT doc_id, piece_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS place FROM tk JOIN cut USING (token)),
kept AS (SELECT doc_id, count(*) AS n, sum(piece_id) AS total, sum(piece_id * place) AS weighted FROM flat WHERE place <= {TX.MAX_SEQ_LEN - 2} GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) + 2 AS n_tokens, CAST(coalesce(total, 0) + {TX.CLS_ID + TX.SEP_ID} AS BIGINT) AS id_sum,
CAST(coalesce(weighted, 0) + {TX.SEP_ID} * (coalesce(n, 0) + 1) AS BIGINT) AS id_order FROM documents LEFT JOIN kept USING (doc_id)""")
def q_subword_pad(spark, sf_dir):
    """F11 with pieces: padded ids of each document, as their number, sum and sum weighted by place."""
    enc = TX.encode_pieces(TX.subword_lookup(_docs(spark, sf_dir), SUBWORD_SIZE, first=TX.MAX_SEQ_LEN - 2))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return enc.select("doc_id", total(F.col("attention_mask")).alias("n_tokens"), total(F.col("input_ids")).alias("id_sum"),
                      total(F.transform("input_ids", lambda x, i: x * i)).alias("id_order"))


# ============================================================ streams
from calibrix.sources.fixtures import EVAL_LOG_DAY0  # noqa: E402
from calibrix.streaming import group_loss as SG  # noqa: E402
from calibrix.streaming import patience as SP  # noqa: E402
from calibrix.streaming.sources import stage_in_order  # noqa: E402


def _stream_t1_sql() -> str:
    items = ["SELECT ts, cdf_gap, nll, stddev, 'ALL' AS \"group\" FROM terms", O.members_cte(cols="ts, cdf_gap, nll, stddev", name="mem")]
    one_minus = O.lit(1.0 - DEFAULT_COEFFICIENT)
    coef = O.lit(DEFAULT_COEFFICIENT)
    return _with(
        O.predictions_cte(keep_ts=True), O.terms_cte(), items[1],
        f"lg AS ({items[0]} UNION ALL SELECT ts, cdf_gap, nll, stddev, \"group\" FROM mem)",
    ) + (
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, \"group\", count(*) AS n_rows, "
        f"round({one_minus} * avg(cdf_gap) + {coef} * avg(nll), 6) AS loss, round(avg(cdf_gap), 6) AS loss_cdf, "
        "round(avg(stddev), 6) AS loss_stddev, round(avg(nll), 6) AS loss_nll FROM lg GROUP BY 1, 2"
    )


@register("stream_group_loss", _stream_t1_sql())
def q_stream_group_loss(spark, sf_dir):
    """Events staged as an in-order file stream, a part of them delivered twice -> forecast rows -> redelivered events
    dropped -> daily (window, group) sums in the state store (update mode: windows that the watermark has passed leave the
    state) -> losses of each window's last update."""
    d = fresh_path(spark, "stream_group_loss")
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    again = ev.where(F.pmod(F.xxhash64("event_id"), F.lit(8)) == 0)
    stage_in_order(ev.unionByName(again), f"{d}/source", "ts", files=16)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/source")
    q = SG.stream_group_loss(FX.forecasts_from_events(stream, keep_ts=True), f"{d}/out", f"{d}/checkpoint", event_id="row_id")
    q.awaitTermination()
    return SG.finish_losses(SG.latest_sums(spark, f"{d}/out"), DEFAULT_COEFFICIENT)


def _eval_log_stream_source(spark, sf_dir, d):
    """The evaluation log as files in an order that has nothing to do with the steps'."""
    log = SP.numbered(FX.eval_log(spark, sf_dir)).withColumn(
        "ts", F.to_timestamp(F.date_add(F.to_date(F.lit(EVAL_LOG_DAY0)), F.col("step").cast("int"))))
    log = log.withColumn("delivery", F.xxhash64("run_id", "step"))
    stage_in_order(log, f"{d}/source", "delivery", files=8)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/source")


@register("stream_early_stop", ORACLE["early_stop"])
def q_stream_early_stop(spark, sf_dir):
    """The evaluation log as a file stream out of order, patience state per run (transformWithStateInPandas),
    latest status per run read back from the per-batch sink. Nothing is late within the log's span."""
    d = fresh_path(spark, "stream_early_stop")
    q = SP.stream_early_stop(_eval_log_stream_source(spark, sf_dir, d), f"{d}/out", f"{d}/checkpoint", PATIENCE, wait="400 days")
    q.awaitTermination()
    return SP.latest_status(spark, f"{d}/out")


# ============================================================ models (M1-M8)
from calibrix.config import CALIB_BATCH_SIZE, NUM_EPOCHS  # noqa: E402
from calibrix.functions.math import gaussian_nll, normal_cdf  # noqa: E402
from calibrix.operators import fitting as FT  # noqa: E402
from calibrix.operators import models as MD  # noqa: E402
from calibrix.operators.calibration import calibration_mse, pit_rank  # noqa: E402

_CALIB_PARAMS = MD.init_calibration(42)
# Share of embedding rows treated as unlabelled by the prediction step (M8).
UNLABELLED_SHARE = 0.3
# Train / eval cut of the embedding rows for fitting.
FIT_TRAIN_SHARE = 0.8
# Learning rate of the single fits, and the sweep's second one.
FIT_LR = 1e-3


def _feats(spark, sf_dir):
    return MD.features(_emb(spark, sf_dir))


def _head_params():
    return MD.init_head(64)


_FEATURES_CTE = (f"features AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, {O.u('r42', 'vec_id')} AS input_r, "
                 f"label / {MD.LABEL_SCALE!r}{_D} AS label FROM embeddings)")
_HEAD_CTES = MD.head_sql(_head_params(), "features")


@register("score_head", _with(_FEATURES_CTE, *_HEAD_CTES)
          + "SELECT vec_id, round(label, 6) AS label, round(input_r, 6) AS input_r, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM scored")
def q_score_head(spark, sf_dir):
    """M1: the Gaussian head over every embedding row (seeded weights), per Arrow batch."""
    return MD.score_head(_feats(spark, sf_dir), _head_params(), keep=["vec_id", "label", "input_r"])


@register("score_unlabelled", _with(_FEATURES_CTE, *_HEAD_CTES,
          f"sl AS (SELECT * REPLACE (CASE WHEN {O.u('unl', 'vec_id')} >= {O.lit(UNLABELLED_SHARE)} THEN label END AS label) FROM scored)")
          + f"SELECT vec_id, round(label, 6) AS label, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round({O.nll()}, 6) AS loss_nll, "
          f"round(abs({O.cdf()} - input_r), 6) AS loss_cdf FROM sl")
def q_score_unlabelled(spark, sf_dir):
    """M8: prediction step with a nullable label; loss columns are null where the label is."""
    f = _feats(spark, sf_dir).withColumn("label", F.when(uniform("unl", "vec_id") >= UNLABELLED_SHARE, F.col("label")))
    s = MD.score_head(f, _head_params(), keep=["vec_id", "label", "input_r"])
    return s.select("vec_id", "label", "mean", "stddev",
                    gaussian_nll("label", "mean", "stddev").alias("loss_nll"),
                    F.abs(normal_cdf("label", "mean", "stddev") - F.col("input_r")).alias("loss_cdf"))


_M2_MEAN, _M2_STD = MD.calibrated_sql(_CALIB_PARAMS)
_CALIBRATED_CTE = ("calibrated AS (SELECT row_id, label, input_r, " + _GL
                   + f", {_M2_MEAN} AS mean, {_M2_STD} AS stddev FROM predictions)")


@register("score_calibrated", _with(O.predictions_cte(), _CALIBRATED_CTE)
          + "SELECT row_id, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM calibrated")
def q_score_calibrated(spark, sf_dir):
    """M2: the calibration layer (fixed seeded weights) as column expressions over stored forecasts."""
    return MD.score_calibrated(FX.predictions(spark, sf_dir), _CALIB_PARAMS).select("row_id", "mean", "stddev")


@register("evaluate_calibrated", _with(O.predictions_cte(), _CALIBRATED_CTE, O.terms_cte(src="calibrated"),
                                       O.group_metrics_ctes(DEFAULT_COEFFICIENT)) + O.gm_final())
def q_evaluate_calibrated(spark, sf_dir):
    """M6: group metrics (A11) after swapping in the calibrated forecasts."""
    fc = MD.score_calibrated(FX.predictions(spark, sf_dir), _CALIB_PARAMS)
    gm = G.group_metrics(fc, DEFAULT_COEFFICIENT)
    return gm.select("group", "group_size", "n_rows", *O.GM_DOUBLES, "tn", "fp", "fn", "tp")


@register("evaluate_forecasts", _wp(_GM, f"gl AS ({_gm_long_sql()})", _BATCH_SQL, _BATCH_AGG)
          + f"SELECT CAST({EVAL_STEPS} AS BIGINT) AS step, 'eval_' || CASE WHEN \"group\" = '{OVERALL}' THEN metric "
          f"ELSE \"group\" || '_' || metric END AS key, round(value, 6) AS value FROM gl WHERE \"group\" <> '{OVERALL}' OR metric <> 'loss' "
          + "".join(f"UNION ALL SELECT CAST({EVAL_STEPS} AS BIGINT), '{k}', round(avg({c}), 6) FROM bl "
                    for k, c in (("eval_loss", "loss"), ("eval_cdf_loss", "loss_cdf"), ("eval_nll_loss", "loss_nll"))))
def q_evaluate_forecasts(spark, sf_dir):
    """M5: the evaluation record of a split's forecasts (step, key, value): the group metrics, and the losses as means
    over batches, which replace the row mean under ``eval_loss``."""
    from calibrix.functions.strings import metric_key, with_prefix

    lg = _gm_long(spark, sf_dir).where((F.col("group") != OVERALL) | (F.col("metric") != "loss"))
    metrics = lg.select(with_prefix("eval", metric_key("eval", "group", "metric")).alias("key"), "value")
    names = ["eval_loss", "eval_cdf_loss", "eval_nll_loss"]
    batches = L.batched_eval_loss(FX.predictions(spark, sf_dir), _B, _COEF).select(*names).unpivot([], names, "key", "value")
    return metrics.unionByName(batches).select(F.lit(EVAL_STEPS).cast("bigint").alias("step"), "key", "value")


# Share of the forecasts that the calibration layer is fitted on; the rest measures it.
CALIBRATION_SHARE = 0.5


@register("fit_calibration")
def q_fit_calibration(spark, sf_dir):
    """M4 -> M2 -> A21: the calibration layer is fitted on the PIT-ranked calibration rows (SGD in batches of 1000, one
    epoch); the calibration error of the other rows is reported before and after."""
    p = FX.predictions(spark, sf_dir).select("row_id", "label", "mean", "stddev")
    p = p.withColumn("_fit", uniform("calibration", "row_id") < CALIBRATION_SHARE)
    fitted, _ = FT.fit_calibration(pit_rank(p.where("_fit")), CALIB_BATCH_SIZE)
    held = FS.written(pit_rank(p.where(~F.col("_fit"))).select("row_id", "mean", "stddev", "q", "cdf"), "calibration_rows")
    before = calibration_mse(MD.score_calibrated(held, _CALIB_PARAMS)).withColumn("stage", F.lit("before"))
    after = calibration_mse(MD.score_calibrated(held, fitted)).withColumn("stage", F.lit("after"))
    return before.unionByName(after).select("stage", "n_rows", "mse", "pit_grid_mse")


def _fit_frames(spark, sf_dir):
    f = _feats(spark, sf_dir).withColumn("_tr", uniform("fit_split", "vec_id") < FIT_TRAIN_SHARE)
    return f.where("_tr").drop("_tr"), f.where(~F.col("_tr")).drop("_tr")


_FIT_LOG = "learning_rate double, coefficient double, epoch long, train_loss double, eval_loss double"


@register("fit_head")
def q_fit_head(spark, sf_dir):
    """M3: the head fitted on the training rows in mini-batch epochs, evaluated after each; the training log."""
    tr, ev = _fit_frames(spark, sf_dir)
    _, log = FT.fit_head(tr, ev, [(FIT_LR, DEFAULT_COEFFICIENT)], epochs=NUM_EPOCHS)
    return spark.createDataFrame(log, _FIT_LOG)


@register("fit_score_evaluate")
def q_fit_score_evaluate(spark, sf_dir):
    """M3 -> M1 -> losses: fit on the training rows, score the evaluation rows with the fitted and with the initial
    weights, and evaluate both."""
    tr, ev = _fit_frames(spark, sf_dir)
    params, _ = FT.fit_head(tr, ev, [(FIT_LR, DEFAULT_COEFFICIENT)], epochs=NUM_EPOCHS)
    out = None
    for stage, p in (("initial", _head_params()), ("fitted", params[FIT_LR, DEFAULT_COEFFICIENT])):
        scored = MD.score_head(ev, p, keep=["vec_id", "label", "input_r"])
        row = L.overall_losses(scored, DEFAULT_COEFFICIENT, id_col="vec_id").withColumn("stage", F.lit(stage))
        out = row if out is None else out.unionByName(row)
    return out.select("stage", "n_rows", "loss", "loss_cdf", "loss_stddev", "loss_nll")


@register("sweep_fit")
def q_sweep_fit(spark, sf_dir):
    """M7: every point of the (learning rate, coefficient) grid trained in the same passes over the data; the best
    evaluation loss and its epoch per point."""
    tr, ev = _fit_frames(spark, sf_dir)
    grid = [(lr, c) for lr in (*SWEEP_LEARNING_RATES, FIT_LR) for c in SWEEP_COEFFICIENTS]
    params, log = FT.fit_head(tr, ev, grid, epochs=NUM_EPOCHS)
    rows = [(lr, c, int(p["best_epoch"]), float(p["best_eval_loss"]), float(log[(log["learning_rate"] == lr) & (log["coefficient"] == c)]["train_loss"].iloc[-1]))
            for (lr, c), p in params.items()]
    return spark.createDataFrame(rows, "learning_rate double, coefficient double, best_epoch long, best_eval_loss double, final_train_loss double")
