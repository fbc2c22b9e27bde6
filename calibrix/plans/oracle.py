"""Independent SQL (DuckDB dialect) for the oracle check.

The same fixture formulas as ``calibrix.sources.fixtures`` are written out in SQL here; every
query result is rounded to 6 places, integers are BIGINT, as in ``calibrix.plans.common.finish``.
"""

from __future__ import annotations

from calibrix.config import (
    DROP_RANGES,
    DROP_SHARES_WITH_NULLS,
    DROP_SHARES_WITHOUT_NULLS,
    GROUPS,
    MIN_GROUP_SIZE,
    OVERALL,
)
from calibrix.functions.math import ERF_COEFFICIENTS, HALF_LOG_2PI, SQRT2
from calibrix.sources.fixtures import PART_NULL_SHARE, PREDICTION_GROUP_RATES, PREDICTION_UNKNOWN_SHARE, UNLABELLED_SHARE

D = "::DOUBLE"


def lit(x: float) -> str:
    return f"({float(x)!r}{D})"


def u(salt: str, idexpr: str, part: int = 0) -> str:
    return f"((('0x'||substr(md5('{salt}'||':'||CAST({idexpr} AS VARCHAR)),{1 + 8 * part},8))::BIGINT)/(4294967296.0{D}))"


def column_u(table: str, k: int, idexpr: str) -> str:
    return u(f"{table}{k // 4}", idexpr, k % 4)


def erf(x: str) -> str:
    ax = f"abs({x})"
    u = f"(4.0{D}/(2.0{D}+{ax})-1.0{D})"
    poly = lit(ERF_COEFFICIENTS[-1])
    for c in reversed(ERF_COEFFICIENTS[:-1]):
        poly = f"({poly}*{u}+{lit(c)})"
    y = f"(1.0{D}-({u}+1.0{D})/2.0{D}*exp({poly}-({x})*({x})))"
    return f"(CASE WHEN ({x}) < 0 THEN -{y} ELSE {y} END)"


def cdf(label: str = "label", mean: str = "mean", std: str = "stddev") -> str:
    return f"(0.5{D}*(1.0{D}+{erf(f'(({label})-({mean}))/({std})/{lit(SQRT2)}')}))"


def nll(label: str = "label", mean: str = "mean", std: str = "stddev") -> str:
    z = f"((({label})-({mean}))/({std}))"
    return f"(ln({std})+{lit(HALF_LOG_2PI)}+{z}*{z}/2.0{D})"


def clamp(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x},{lit(lo)}),{lit(hi)}) END)"


def r6(expr: str, name: str) -> str:
    return f"round(({expr}){D}, 6) AS \"{name}\""


# ---------------------------------------------------------------- fixtures
def predictions_cte(keep_ts: bool = False, hashed_ids: bool = False, name: str = "predictions") -> str:
    y = f"least(value/100.0{D}, 1.0{D})"
    rid = "('0x'||substr(md5('id:'||event_id),1,15))::BIGINT" if hashed_ids else "event_id"
    cols = [
        f"{rid} AS row_id",
        f"(CASE WHEN {column_u('forecast', 0, 'event_id')} >= {lit(UNLABELLED_SHARE)} THEN {y} END) AS label",
        f"{column_u('forecast', 1, 'event_id')} AS input_r",
        f"(0.6{D}*{y}+0.4{D}*{column_u('forecast', 2, 'event_id')}) AS mean",
        f"(0.05{D}+0.45{D}*{column_u('forecast', 3, 'event_id')}) AS stddev",
    ]
    for k, (g, p) in enumerate(zip(GROUPS, PREDICTION_GROUP_RATES), 5):
        cols.append(
            f"(CASE WHEN {column_u('forecast', 4, 'event_id')} < {lit(PREDICTION_UNKNOWN_SHARE)} THEN -1.0{D} "
            f"WHEN {column_u('forecast', k, 'event_id')} < {lit(p)} THEN 0.75{D} ELSE 0.0{D} END) AS {g}"
        )
    if keep_ts:
        cols.append("CAST(ts AS TIMESTAMP) AS ts")
    return f"{name} AS (SELECT " + ", ".join(cols) + " FROM events)"


def run_predictions_cte(coefficients: list[float]) -> str:
    grid = ", ".join(f"({lit(c)})" for c in coefficients)
    return (f"run_predictions AS (SELECT p.* REPLACE ((1.0{D} - 0.5{D}*coefficient)*mean + 0.25{D}*coefficient AS mean, "
            f"stddev*(0.5{D} + coefficient) AS stddev), coefficient FROM predictions p, (VALUES {grid}) g(coefficient))")


def terms_cte(src: str = "predictions", name: str = "terms", pred: str = "mean") -> str:
    """cdf, nll, pred_value, then cdf_gap / labels (mirrors ``forecast_terms``)."""
    return (
        f"{name}_a AS (SELECT *, {cdf()} AS cdf, {nll()} AS nll, {clamp(pred)} AS pred_value FROM {src} WHERE label IS NOT NULL), "
        f"{name} AS (SELECT *, abs(cdf - input_r) AS cdf_gap, CAST(pred_value > 0.5{D} AS INTEGER) AS pred_label, "
        f"CAST(label > 0.5{D} AS INTEGER) AS target_label FROM {name}_a)"
    )


def comments_cte(part_null: bool = False, name: str = "comments") -> str:
    idc = "d.doc_id"
    nt, ut = column_u("comment", 0, idc), column_u("comment", 1, idc)
    target = (f"(CASE WHEN l.toxic = 1 THEN 0.5{D} + 0.5{D}*{ut} WHEN l.quality = 0 THEN 0.25{D} + 0.25{D}*{ut} "
              f"WHEN l.doc_id IS NOT NULL THEN CASE WHEN {nt} < 0.3{D} THEN 0.0{D} ELSE 0.5{D}*{ut} END "
              f"WHEN {nt} < 0.2{D} THEN 0.0{D} WHEN {nt} > 0.98{D} THEN 1.0{D} ELSE {ut} END)")
    cols = [f"{idc} AS id", f"{target} AS target", "d.text AS comment_text"]
    for k, g in enumerate(GROUPS, 3):
        v = f"greatest(0.0{D}, floor({column_u('comment', k, idc)}*9)/4.0{D} - 1.0{D})"
        v = f"(CASE WHEN l.doc_id IS NULL THEN NULL ELSE {v} END)"
        if part_null and g == GROUPS[0]:
            v = f"(CASE WHEN {column_u('comment', 2, idc)} < {lit(PART_NULL_SHARE)} THEN NULL ELSE {v} END)"
        cols.append(f"CAST({v} AS DOUBLE) AS {g}")
    return (
        f"{name} AS (SELECT " + ", ".join(cols)
        + " FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"
    )


def eval_log_cte() -> str:
    return (
        "eval_log AS (SELECT event_type AS run_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) "
        "AS step, round(avg(value), 6) AS eval_loss FROM events GROUP BY 1, 2)"
    )


# ---------------------------------------------------------------- group metrics pieces
def members_cte(src: str = "terms", name: str = "members", cols: str = "*", groups=GROUPS) -> str:
    parts = [
        f"SELECT {cols}, '{g}' AS \"group\", CAST({g} AS DOUBLE) AS gval FROM {src} "
        f"WHERE {g} <> -1.0{D} AND {g} >= 0.5{D}"
        for g in groups
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def sizes_cte(src: str = "members", name: str = "sizes", min_size: int = MIN_GROUP_SIZE, by: str = "") -> str:
    """``by``: an outer key, e.g. a run's coefficient."""
    b = f"{by}, " if by else ""
    return (
        f"{name}_a AS (SELECT {b}\"group\", count(*) FILTER (WHERE target_label = 0) AS n0, "
        f"count(*) FILTER (WHERE target_label = 1) AS n1 FROM {src} GROUP BY {b}\"group\"), "
        f"{name} AS (SELECT {b}\"group\", n0, n1, least(n0, n1) AS group_size, least(n0, n1) >= {min_size} AS kept "
        f"FROM {name}_a)"
    )


def balanced_cte(src: str = "members", sizes: str = "sizes", name: str = "balanced", by: str = "") -> str:
    part, on = (f"m.{by}, ", f"m.{by} = s.{by} AND ") if by else ("", "")
    return (
        f"{name} AS (SELECT * FROM (SELECT m.*, s.group_size, row_number() OVER (PARTITION BY {part}m.\"group\", "
        f"m.target_label ORDER BY m.row_id) AS _pos FROM {src} m JOIN {sizes} s ON {on}m.\"group\" = s.\"group\" "
        f"WHERE s.kept) WHERE _pos <= group_size)"
    )


def metric_select(coef: float) -> str:
    """Aggregate list producing n_rows, losses and confusion counts."""
    return (
        f"count(*) AS n_rows, (1.0{D}-{lit(coef)})*avg(cdf_gap) + {lit(coef)}*avg(nll) AS loss, "
        "avg(cdf_gap) AS loss_cdf, avg(stddev) AS loss_stddev, avg(nll) AS loss_nll, "
        "count(*) FILTER (WHERE target_label = 0 AND pred_label = 0) AS tn, "
        "count(*) FILTER (WHERE target_label = 0 AND pred_label = 1) AS fp, "
        "count(*) FILTER (WHERE target_label = 1 AND pred_label = 0) AS fn, "
        "count(*) FILTER (WHERE target_label = 1 AND pred_label = 1) AS tp"
    )


def classification_exprs() -> dict[str, str]:
    tn, fp, fn, tp = (f"CAST({c} AS DOUBLE)" for c in ("tn", "fp", "fn", "tp"))
    prec = f"(CASE WHEN {tp}+{fp} > 0 THEN {tp}/({tp}+{fp}) ELSE 0.0{D} END)"
    rec = f"(CASE WHEN {tp}+{fn} > 0 THEN {tp}/({tp}+{fn}) ELSE 0.0{D} END)"
    return {
        "Recall": rec,
        "FPR": f"(CASE WHEN {fp}+{tn} > 0 THEN {fp}/({fp}+{tn}) ELSE 0.0{D} END)",
        "Precision": prec,
        "F1": f"(CASE WHEN {prec}+{rec} > 0 THEN 2.0{D}*({prec}*{rec})/({prec}+{rec}) ELSE 0.0{D} END)",
        "Accuracy": f"(({tp}+{tn})/({tp}+{tn}+{fp}+{fn}))",
    }


def group_metrics_ctes(coef: float, src_terms: str = "terms", by: str = "") -> str:
    """CTEs ending in ``gm`` = wide group metric table (kept groups + ALL row), unrounded."""
    cls = classification_exprs()
    cls_sel = ", ".join(f"{v} AS \"{k}\"" for k, v in cls.items())
    b, group_by = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"{members_cte(src_terms)}, {sizes_cte(by=by)}, {balanced_cte(by=by)}, "
        f"gm_g AS (SELECT {b}\"group\", CAST(count(*) / 2 AS BIGINT) AS group_size, {metric_select(coef)} FROM balanced GROUP BY {b}\"group\"), "
        f"gm_all AS (SELECT {b}'{OVERALL}' AS \"group\", CAST(NULL AS BIGINT) AS group_size, {metric_select(coef)} FROM {src_terms}{group_by}), "
        f"gm_u AS (SELECT * FROM gm_g UNION ALL SELECT * FROM gm_all), "
        f"gm AS (SELECT *, {cls_sel} FROM gm_u)"
    )


GM_DOUBLES = ["loss", "loss_cdf", "loss_stddev", "loss_nll", "Recall", "FPR", "Precision", "F1", "Accuracy"]


def gm_final(src: str = "gm") -> str:
    d = ", ".join(r6(f'"{c}"', c) for c in GM_DOUBLES)
    return f"SELECT \"group\", group_size, n_rows, {d}, tn, fp, fn, tp FROM {src}"


# ---------------------------------------------------------------- preparation pipeline
def any_null_sql(groups=GROUPS) -> str:
    return "(" + " OR ".join(f"{g} IS NULL" for g in groups) + ")"


def range_index_sql(col: str, ranges) -> str:
    whens = " ".join(f"WHEN {col} >= {lit(lo)} AND {col} < {lit(hi)} THEN {i}" for i, (lo, hi) in enumerate(ranges))
    return f"(CASE {whens} ELSE NULL END)"


def prepare_ctes(src: str = "comments") -> str:
    """CTEs: cleaned -> kept (after drop) -> prepared (with split) -> splits (eval/test w/o nulls)."""
    an = any_null_sql()
    gsel = ", ".join(f"CASE WHEN {an} THEN -1.0{D} ELSE {g} END AS {g}" for g in GROUPS)
    share_whens = []
    for s, shares in (("with_nulls", DROP_SHARES_WITH_NULLS), ("without_nulls", DROP_SHARES_WITHOUT_NULLS)):
        for i, p in enumerate(shares):
            share_whens.append(f"WHEN stratum = '{s}' AND _rng = {i} THEN {lit(p)}")
    share = "(CASE " + " ".join(share_whens) + f" ELSE 0.0{D} END)"
    gl = ", ".join(GROUPS)
    return (
        f"cleaned AS (SELECT id, target, comment_text, {gsel}, CASE WHEN {an} THEN 'with_nulls' ELSE 'without_nulls' END "
        f"AS stratum FROM {src}), "
        f"dr AS (SELECT *, {range_index_sql('target', DROP_RANGES)} AS _rng, {u('drop', 'id')} AS _h FROM cleaned), "
        f"dr2 AS (SELECT *, row_number() OVER (PARTITION BY stratum, _rng ORDER BY _h, id) AS _pos, "
        f"count(*) OVER (PARTITION BY stratum, _rng) AS _n FROM dr), "
        f"drop_plan AS (SELECT *, CASE WHEN _rng IS NULL THEN 0 ELSE floor(_n * {share}) END AS _n_drop FROM dr2), "
        f"kept AS (SELECT id, target, comment_text, {gl}, stratum FROM drop_plan WHERE _rng IS NULL OR _pos > _n_drop), "
        f"sp AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {u('split', 'id')}, id) AS _pos, "
        f"count(*) OVER (PARTITION BY stratum) AS _n FROM kept), "
        f"sp1 AS (SELECT *, ceil(_n * (CASE WHEN stratum = 'with_nulls' THEN 0.25{D} ELSE 0.5{D} END)) AS _t1 FROM sp), "
        f"sp2 AS (SELECT *, ceil(_t1 * 0.67{D}) AS _t2 FROM sp1), "
        f"sp3 AS (SELECT *, ceil(_t2 * 0.5{D}) AS _t3 FROM sp2), "
        f"prepared AS (SELECT id, target, comment_text, {gl}, stratum, CASE WHEN _pos <= _n - _t1 THEN 'train' "
        f"WHEN _pos <= _n - _t2 THEN 'calib' WHEN _pos <= _n - _t3 THEN 'eval' ELSE 'test' END AS split FROM sp3), "
        f"splits AS (SELECT * FROM prepared WHERE split IN ('train', 'calib') OR stratum = 'without_nulls')"
    )


def with_prepare(*extra: str, part_null: bool = False) -> str:
    return "WITH " + ", ".join([comments_cte(part_null), prepare_ctes(), *extra]) + " "
