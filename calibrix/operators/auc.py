"""Exact ROC AUC by rank sums, per scope, without sorting all rows in one task.

Rows are first aggregated to ``(scope, score) -> (pos, neg)`` (a partial aggregate: duplicates
collapse map-side). ``prefix_sum`` gives the negatives strictly below each score, and

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)       (ties count one half)

Scopes with no positives or no negatives give null (the metric is undefined there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.config import GROUPS
from calibrix.operators.groups import member_condition
from calibrix.operators.ranking import prefix_sum


def auc(df: DataFrame, score: str = "pred_value", label: str = "target_label", by: list[str] | tuple = ()) -> DataFrame:
    """``n_pos, n_neg, auc`` per ``by`` key. Distinct scores are ordered by sampled ranges per key, so scores that
    cluster spread over the tasks all the same."""
    by = list(by)
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("_neg"),
    )
    ps = prefix_sum(per, "_s", ["_neg"], partition_by=by, strict=True)
    return ps.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)).alias("_num"),
    ).select(
        *by,
        "n_pos",
        "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_num") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
    )


def background_subgroup(terms: DataFrame, kind: str, groups: list[str] = GROUPS) -> DataFrame:
    """Rows of each group's BPSN (toxic outside + non-toxic inside) or BNSP (non-toxic outside +
    toxic inside) set, as ``(group, score, label)``. Each row is emitted once per group whose set
    it is in (bounded by the number of group columns)."""
    tox = F.col("target_label") == 1
    items = []
    for g in groups:
        inside = member_condition(g)
        cond = (tox & ~inside) | (~tox & inside) if kind == "bpsn" else (~tox & ~inside) | (tox & inside)
        items.append(F.when(cond, F.lit(g)))
    return terms.select(
        "row_id", "pred_value", "target_label", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("group")
    )
