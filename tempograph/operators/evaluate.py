"""Ranking metrics, thresholds and regime rollups over (tau, txid, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.operators.running import quantiles, running
from tempograph.sources.graph import regime

LOW_SUPPORT = 10


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(p: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold``, 0 where undefined."""
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    c = p.filter("label <> -1").groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count("*").alias("n"))
    pr, rc = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*by, "n", "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def curve(p: DataFrame, by: list[str]) -> DataFrame:
    """Distinct scores with positives and rows at or above each; ties are one point. No task holds a group."""
    g = p.filter("label <> -1").groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count("*").alias("n"))
    return running(g, by, [F.desc("score")], ["tp", "n"]).withColumnsRenamed({"all_tp": "pos", "all_n": "rows"})


def average_precision(p: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise average precision with ties grouped; null if a group has one class."""
    c = curve(p, by)
    ap = F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")) / F.nullif(F.max("pos"), F.lit(0))
    return c.groupBy(*by).agg(F.when(F.max("pos") < F.max("rows"), ap).alias("ap"))


def _best() -> Column:
    """(f1, -score) of the lowest of the scores with the greatest F1, over rows of ``curve``."""
    pr, rc = F.col("cum_tp") / F.col("cum_n"), F.col("cum_tp") / F.nullif(F.col("pos"), F.lit(0))
    f1 = F.coalesce(F.round(2 * pr * rc / (pr + rc + 1e-8), 9), F.lit(0.0))
    return F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low")))


def _threshold(best: Column) -> Column:
    return F.when(best["f1"] > 0, -best["low"]).otherwise(0.5)


def best_f1_threshold(p: DataFrame, by: list[str]) -> DataFrame:
    """Lowest of the scores with the greatest F1; 0.5 if that is 0."""
    b = curve(p, by).groupBy(*by).agg(_best().alias("best"), F.max("pos").alias("pos"))
    return b.select(*by, _threshold(F.col("best")).alias("threshold"), F.col("best")["f1"].alias("f1"), "pos")


def quantile_at(p: DataFrame, by: list[str], q: Column) -> DataFrame:
    """Linear quantile of the score at a p that differs by group (``q`` over the group's columns)."""
    counts = p.filter(F.col("score").isNotNull()).groupBy(*by, "score").agg(F.count("*").alias("n"))
    return quantiles(counts, by, "score", {"quantile": q})


def calibrated_threshold(p: DataFrame, by: list[str], epsilon: int = LOW_SUPPORT) -> DataFrame:
    """Best-F1 threshold, or below ``epsilon`` positives the quantile 1 - rate of the scores; with a flag.

    Both come from one curve; it descends, so places are counted from its end.
    """
    at = (F.col("rows") - 1) * (1 - F.col("pos") / F.col("rows"))
    holds = lambda i: (F.col("rows") - F.col("cum_n") <= i) & (i < F.col("rows") - F.col("cum_n") + F.col("n"))
    ends = [F.max(F.when(holds(f(at)), F.col("score"))).alias(k) for k, f in (("lo", F.floor), ("hi", F.ceil))]
    c = curve(p, by).groupBy(*by).agg(_best().alias("best"), F.max("pos").alias("pos"), F.max(at).alias("at"), *ends)
    few = F.col("pos") < epsilon
    quantile = F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))
    return c.select(*by, F.when(few, quantile).otherwise(_threshold(F.col("best"))).alias("threshold"), few.alias("fallback"))


def precision_at_k(p: DataFrame, by: list[str]) -> DataFrame:
    """Precision among the k best scores, k the number of positives; ties by id."""
    y = p.filter("label <> -1").select(*by, "score", "txid", F.lit(1).alias("n"), (F.col("label") == 1).cast("int").alias("y"))
    r = running(y, by, [F.desc("score"), F.col("txid")], ["n", "y"])
    hits = F.count_if((F.col("cum_n") <= F.col("all_y")) & (F.col("y") == 1))
    return r.groupBy(*by).agg(F.max("all_y").alias("k"), _safe(hits, F.max("all_y")).alias("precision_at_k"))


def regime_rollup(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pooled F1 for each regime and over all (regime null), in one rollup."""
    q = p.filter("label <> -1").withColumn("regime", regime())
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    g = q.rollup("regime").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count("*").alias("n"))
    return g.select(F.coalesce("regime", F.lit("all")).alias("regime"), "n", _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def macro_pooled(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean over steps of rounded step F1 and of step average precision, and pooled F1."""
    step = confusion(p, ["tau"], threshold).select("tau", F.round("f1", 4).alias("f1")).join(average_precision(p, ["tau"]), "tau")
    macro = step.agg(F.avg("f1").alias("macro_f1"), F.avg(F.round("ap", 4)).alias("macro_ap"))
    pooled = confusion(p.withColumn("g", F.lit(1)), ["g"], threshold).select(F.col("f1").alias("pooled_f1"))
    return macro.join(F.broadcast(pooled))


def regime_metrics(p: DataFrame, threshold: float = 0.5, low: int = LOW_SUPPORT) -> DataFrame:
    """Precision, recall, F1 and average precision for each regime and over all, with positives and a low-support flag; macro_f1 is the mean of rounded step F1."""
    q = p.filter("label <> -1").withColumn("regime", regime())
    both = q.unionByName(q.withColumn("regime", F.lit("all")))
    pooled = confusion(both, ["regime"], threshold).withColumn("n_pos", F.col("tp") + F.col("fn"))
    step = confusion(q, ["tau"], threshold).select(regime().alias("regime"), F.round("f1", 4).alias("f1"))
    macro = step.unionByName(step.withColumn("regime", F.lit("all"))).groupBy("regime").agg(F.avg("f1").alias("macro_f1"))
    out = pooled.join(average_precision(both, ["regime"]), "regime").join(macro, "regime")
    return out.select("regime", "n", "n_pos", "precision", "recall", "f1", "ap", "macro_f1", (F.col("n_pos") < low).alias("low_support"))


def static_macro(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean step F1 over the steps that have both classes, and how many those are."""
    two = p.filter("label <> -1").groupBy("tau").agg(F.countDistinct("label").alias("kinds")).filter("kinds = 2")
    return confusion(p, ["tau"], threshold).join(two, "tau").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("steps"))
