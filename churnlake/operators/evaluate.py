"""Evaluation over scored rows (id, y, p).

Counts are conditional sums in one aggregate. Curves and AUC group rows by
distinct score first (a hot score collapses map-side), write that table once
in score order, and take running totals and class totals from its ranges; the gains table
ranks rows by (p desc, id) in the same way. No step moves all rows into one task.

One rule for incomplete rows: a row without a label or without a score (NULL or
NaN) has no part in any count, curve or area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators.rank import Key, range_count, range_stats, ranged, totals_of
from churnlake.session import materialize

THRESHOLD_GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]  # .10 .. .90


def complete(scored: DataFrame) -> DataFrame:
    """Rows with a label and a score."""
    return scored.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))


def apply_threshold(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    return scored.withColumn("y_pred", (F.col("p") >= threshold).cast("int"))


def _cells(t: float, y: str = "y", p: str = "p"):
    pred = F.col(p) >= F.lit(t)
    pos = F.col(y) == 1
    return {
        "tn": F.count_if(~pos & ~pred), "fp": F.count_if(~pos & pred),
        "fn": F.count_if(pos & ~pred), "tp": F.count_if(pos & pred),
    }


def confusion_matrix(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                     by: list[str] | None = None) -> DataFrame:
    """All four cells always present (one class only still gives a 2x2)."""
    cells = _cells(threshold)
    rows = complete(scored)
    out = (rows.groupBy(*by) if by else rows).agg(*[v.alias(k) for k, v in cells.items()])
    n = F.greatest(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.lit(1))
    return out.select(*(by or []), "tn", "fp", "fn", "tp",
                      *[F.round(100.0 * F.col(k) / n, 6).alias(f"{k}_pct") for k in cells])


def _metrics_from_cells() -> list:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
    return [F.round(F.coalesce(F.try_divide(tp + tn, n), F.lit(0.0)), 6).alias("accuracy"),
            F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
            F.round(f1, 6).alias("f1")]


def classification_metrics(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                           by: list[str] | None = None) -> DataFrame:
    cm = confusion_matrix(scored, threshold, by)
    return cm.select(*(by or []), F.lit(threshold).alias("threshold"), *_metrics_from_cells())


def classification_report(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    cm = confusion_matrix(scored, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def prf(t, f_p, f_n):
        p = F.coalesce(F.try_divide(t, t + f_p), F.lit(0.0))
        r = F.coalesce(F.try_divide(t, t + f_n), F.lit(0.0))
        f = F.coalesce(F.try_divide(2.0 * t, 2.0 * t + f_p + f_n), F.lit(0.0))
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = F.coalesce(F.try_divide(tp + tn, n), F.lit(0.0))
    w = lambda a, b: F.coalesce(F.try_divide(a * s0 + b * s1, n), F.lit(0.0))
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("label"), F.round(p, 6).alias("precision"),
                             F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"),
                             s.cast("long").alias("support")) for k, p, r, f, s in rows])
    return cm.select(F.explode(arr).alias("r")).select("r.*")


def threshold_metrics(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Metrics at every threshold of the grid from ONE aggregate (no row x threshold join)."""
    ts = thresholds or THRESHOLD_GRID
    aggs = []
    for i, t in enumerate(ts):
        for k, v in _cells(t).items():
            aggs.append(v.alias(f"{k}_{i}"))
    wide = complete(scored).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                             *[F.col(f"{k}_{i}").alias(k) for k in ("tn", "fp", "fn", "tp")])
                    for i, t in enumerate(ts)])
    long = wide.select(F.explode(arr).alias("r")).select("r.*")
    return long.select("threshold", "tn", "fp", "fn", "tp", *_metrics_from_cells())


# ------------------------------------------------------------- curves / AUC

def score_table(scored: DataFrame, by: str | None = None) -> DataFrame:
    """(model?, p, pos, neg, cum_pos, cum_neg, n_pos, n_neg, place) over distinct scores, descending p.

    cum_* are inclusive counts of rows with score >= p (within the model); place numbers all rows in (model, descending p) order.
    """
    keys = ([by] if by else []) + ["p"]
    g = materialize(complete(scored).groupBy(*keys).agg(
        F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg")), "scores")
    order = ([Key(by)] if by else []) + [Key("p", False)]
    stored = ranged(g, order, range_count(g.count()))
    if not by:
        stats = range_stats(stored, ["pos", "neg"])
        n_pos, n_neg = (sum(r[f"_s_{v}"] or 0 for r in stats) for v in ("pos", "neg"))
        return totals_of(stored, g.columns, order, ["pos", "neg"], stats=stats, position="place").withColumns(
            {"n_pos": F.lit(n_pos).cast("long"), "n_neg": F.lit(n_neg).cast("long")})
    rt = totals_of(stored, g.columns, order, ["pos", "neg"], position="place")
    # the first score of a model tells what all models before it hold
    base = rt.groupBy(by).agg(F.min(F.col("cum_pos") - F.col("pos")).alias("base_pos"),
                              F.min(F.col("cum_neg") - F.col("neg")).alias("base_neg"),
                              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return rt.join(base, by).select(by, "p", "pos", "neg",
                                    (F.col("cum_pos") - F.col("base_pos")).alias("cum_pos"),
                                    (F.col("cum_neg") - F.col("base_neg")).alias("cum_neg"), "n_pos", "n_neg", "place")


def roc_auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Tie-aware AUC = sum_p pos_p * (neg below p + neg_p / 2) / (P * N); NULL for one class."""
    t = score_table(scored, by)
    below = F.col("n_neg") - F.col("cum_neg")  # negatives with a strictly lower score
    num = F.col("pos") * (2 * below + F.col("neg"))
    g = t.groupBy(*([by] if by else []), "n_pos", "n_neg")
    out = g.agg(F.sum(num).alias("num"))
    return out.select(*([by] if by else []),
                      F.round(F.try_divide(F.col("num").cast("double"),
                                           2.0 * F.col("n_pos") * F.col("n_neg")), 6).alias("roc_auc"))


def _corners(t: DataFrame, by: str | None) -> DataFrame:
    """The points of a score table at which the curve turns, and the first and last of each model.

    A step of the curve is (neg, pos) of one score; it goes straight on where the next score has the same counts. The next
    score is found by its place, so a neighbour in another range, or on another executor, is a join partner like any other.
    """
    following = t.select((F.col("place") - 1).alias("place"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"),
                         (F.col(by) if by else F.lit(0)).alias("_by"))
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("_pos").isNull() | ~F.col("_by").eqNullSafe(F.col(by) if by else F.lit(0))
    turns = (F.col("_pos") != F.col("pos")) | (F.col("_neg") != F.col("neg"))
    return t.join(following, "place", "left").filter(first | last | turns)


def roc_curve(scored: DataFrame, by: str | None = None, drop_collinear: bool = True) -> DataFrame:
    """(fpr, tpr) per distinct score plus the origin (threshold = +inf); points on a straight stretch are left out."""
    t = score_table(scored, by)
    t = _corners(t, by) if drop_collinear else t
    keys = [by] if by else []
    pts = t.select(*keys, F.col("p").alias("threshold"),
                   F.round(F.try_divide(F.col("cum_neg").cast("double"), F.col("n_neg")), 6).alias("fpr"),
                   F.round(F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos")), 6).alias("tpr"))
    origin = (scored.select(*keys).distinct() if by else scored.limit(1).select())
    origin = origin.select(*keys, F.lit(float("inf")).alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def _precision(cp, cn):
    return F.coalesce(F.try_divide(cp.cast("double"), cp + cn), F.lit(0.0))


def pr_curve(scored: DataFrame, by: str | None = None) -> DataFrame:
    """(precision, recall) per distinct score plus the end point (recall 0, precision 1)."""
    t = score_table(scored, by)
    keys = [by] if by else []
    rec = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("n_pos"))
    pts = t.select(*keys, F.col("p").alias("threshold"),
                   F.round(_precision(F.col("cum_pos"), F.col("cum_neg")), 6).alias("precision"),
                   F.round(rec, 6).alias("recall"))
    end = (scored.select(*keys).distinct() if by else scored.limit(1).select())
    end = end.select(*keys, F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Trapezoid area under (recall, precision), plus the prevalence baseline.

    The previous point of each score is derived from its own counts
    (cum - own), so no lag over a global order is needed.
    """
    t = score_table(scored, by)
    keys = [by] if by else []
    P = F.col("n_pos")
    rec = F.when(P == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / P)
    prev_cp, prev_cn = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    prev_rec = F.when(P == 0, F.lit(1.0)).otherwise(prev_cp / P)
    prev_prec = F.when(prev_cp + prev_cn == 0, F.lit(1.0)).otherwise(_precision(prev_cp, prev_cn))
    # for the first score the previous point is the end point (0, 1)
    prev_rec = F.when(prev_cp + prev_cn == 0, F.lit(0.0)).otherwise(prev_rec)
    prec = _precision(F.col("cum_pos"), F.col("cum_neg"))
    area = (rec - prev_rec) * (prec + prev_prec) / 2.0
    out = t.groupBy(*keys, "n_pos", "n_neg").agg(F.sum(area).alias("a"))
    return out.select(*keys, F.round("a", 6).alias("pr_auc"),
                      F.round(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")), 6).alias("baseline"))


def calibration_curve(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins (a, b] (0 in the first), empty bins dropped; mean p and mean y."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    b = F.lit(n_bins - 1)
    for i in reversed(range(len(edges))):
        b = F.when(F.col("p") <= F.lit(edges[i]), F.lit(i)).otherwise(b)
    return (complete(scored).withColumn("bin", b).groupBy("bin")
            .agg(F.round(F.avg("p"), 6).alias("mean_predicted"),
                 F.round(F.avg(F.col("y").cast("double")), 6).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("count")))


def gains_table(scored: DataFrame, n_bins: int = 10, id_col: str = "id") -> DataFrame:
    """Cumulative gains, one row per decile, empty deciles too: rows sorted by p desc (id breaks
    ties), decile of the 0-based position i is max(ceil(n*i/(N-1)) - 1, 0) (quantile bins over the
    index), then churners captured through each decile."""
    rows = complete(scored).select(id_col, "y", "p")
    stored = ranged(rows, [Key("p", False), Key(id_col)], range_count(rows.count()))
    stats = range_stats(stored, ["y"])
    n, churners = sum(r["_n"] for r in stats), sum(r["_s_y"] or 0 for r in stats)
    ranked = totals_of(stored, ["y"], [Key("p", False), Key(id_col)], ["y"], position="pos", stats=stats)
    i = F.col("pos") - 1
    decile = F.lit(0) if n <= 1 else F.greatest(F.floor((i * n_bins + n - 2) / (n - 1)) - 1, F.lit(0))
    per = ranked.groupBy(decile.cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("customers"), F.sum("y").alias("y"))
    found = {r["decile"]: (r["customers"], r["y"]) for r in per.collect()}  # at most n_bins rows
    out, cum = [], 0
    for d in range(n_bins):
        customers, y = found.get(d, (0, 0))
        cum += y
        out.append((d, customers, cum))
    table = scored.sparkSession.createDataFrame(out, "decile int, customers long, churners_cum long")
    cap = F.try_divide(F.col("churners_cum").cast("double"), F.lit(churners))
    x = (F.col("decile") + 1) / F.lit(float(n_bins))
    return table.select("decile", "customers", "churners_cum", F.round(x, 6).alias("pct_customers"),
                        F.round(cap, 6).alias("pct_churners_captured"), F.round(cap / x, 6).alias("lift"))


def lift_by_decile(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    return gains_table(scored, n_bins).select("decile", "lift")


def cost_evaluation(scored: DataFrame, cost_fn: float = S.COST_FALSE_NEGATIVE,
                    cost_fp: float = S.COST_FALSE_POSITIVE,
                    threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    cm = confusion_matrix(scored, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = fn * cost_fn + fp * cost_fp
    base = (tp + fn) * cost_fn
    n = F.greatest(tp + fp + fn + tn, F.lit(1))
    return cm.select(
        tn.alias("true_negatives"), fp.alias("false_positives"), fn.alias("false_negatives"),
        tp.alias("true_positives"),
        (fn * cost_fn).alias("cost_false_negatives"), (fp * cost_fp).alias("cost_false_positives"),
        total.alias("total_model_cost"), base.alias("baseline_cost_no_model"),
        (base - total).alias("cost_saved_vs_baseline"),
        F.round(total / n, 6).alias("cost_per_customer"))


def model_comparison(scored_models: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                     by: str = "model") -> DataFrame:
    """One metrics row per model from the stacked scores (one pass per metric family)."""
    m = classification_metrics(scored_models, threshold, [by]).drop("threshold")
    auc = roc_auc(scored_models, by)
    return m.join(auc, by)


def best_model(comparison: DataFrame, by: str = "model") -> DataFrame:
    """Model with the top AUC; ties go to the first model in name order.

    ``comparison`` has one row per model, so the top-1 sort is tiny.
    """
    top = comparison.orderBy(F.desc("roc_auc"), F.asc(by)).limit(1)
    return top.select(F.col(by).alias("best_model"), "roc_auc")
