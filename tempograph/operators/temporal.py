"""Walk-forward blocks, lag features, decay, smoothing over the step axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(available: list[int], tau: int, window: int | None = None, gap: int = 1) -> tuple[list[int], int | None]:
    """(train steps, calibration step) for a test step; missing steps are skipped.

    ``gap`` 1 leaves the step before tau to calibration, 0 trains on it too.
    """
    low = min(available) if window is None else max(min(available), tau - window)
    train = [t for t in sorted(available) if low <= t <= tau - 1 - gap]
    if any(t >= tau for t in train):
        raise ValueError("training block reaches the test step")
    return train, (tau - 1 if gap and tau - 1 in available else None)


def check_splits(train: set[int], val: set[int], test: set[int]) -> None:
    if train & val or train & test or val & test:
        raise ValueError("splits overlap")


def window_sums(steps: DataFrame, cols: list[str], start: int | None, end: int) -> DataFrame:
    """Sums over the steps tau+start .. tau+end by a RANGE frame, so that missing steps count as gaps."""
    w = Window.orderBy("tau").rangeBetween(Window.unboundedPreceding if start is None else start, end)
    return steps.select("tau", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in cols])


def lag_features(steps: DataFrame, cols: list[str], window: int, train_end: int) -> DataFrame:
    """(tau, features): for lags window..1 the step's figures and a presence flag, then differences of neighbours.

    Missing steps take the mean over the training steps; a difference is 0 if
    either of its steps is missing. The range join runs as an equi-join on the
    exploded lags. Only past steps enter.
    """
    m = steps.filter(F.col("tau") <= train_end).agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    want = steps.select("tau").distinct().select("tau", F.explode(F.sequence(F.lit(window), F.lit(1))).alias("lag")).withColumn("at", F.col("tau") - F.col("lag"))
    have = steps.select(F.col("tau").alias("at"), *[F.col(c).cast("double").alias(c) for c in cols], F.lit(1.0).alias("present"))
    j = want.join(have, "at", "left").join(F.broadcast(m))  # one row
    j = j.withColumn("present", F.coalesce("present", F.lit(0.0)))
    v = F.array(*[F.coalesce(F.col(c), F.col(f"m_{c}")) for c in cols])
    g = j.select("tau", "lag", v.alias("v"), "present").groupBy("tau").agg(F.array_sort(F.collect_list(F.struct((-F.col("lag")).alias("o"), "v", "present"))).alias("l"))
    levels = F.flatten(F.transform("l", lambda s: F.concat(s["v"], F.array(s["present"]))))
    diffs = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.lit(window)) if window > 1 else F.array().cast("array<int>"),
            lambda i: F.zip_with(F.element_at("l", i)["v"], F.element_at("l", i - 1)["v"], lambda a, b: F.when((F.element_at("l", i)["present"] > 0) & (F.element_at("l", i - 1)["present"] > 0), a - b).otherwise(0.0)),
        )
    )
    return g.select("tau", F.concat(levels, diffs).alias("features"))


def snapshot_figures(n: DataFrame, e: DataFrame, x: DataFrame, width: int, pagerank: DataFrame | None = None) -> DataFrame:
    """Per step: illicit rate, nodes, edges, mean degree, variance of PageRank (0 without it), then mean and deviation of each feature."""
    f = F.col("features")
    y = F.when(F.col("label") >= 0, (F.col("label") == 1).cast("double"))
    c = x.groupBy("tau").agg(F.avg(y).alias("rate"), F.count("*").alias("nodes"), *[F.avg(f[i]).alias(f"mean{i}") for i in range(width)], *[F.stddev_pop(f[i]).alias(f"std{i}") for i in range(width)])
    out = c.join(e.groupBy("tau").agg(F.count("*").alias("edges")), "tau", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    out = out.withColumn("mean_degree", F.col("edges") * 2.0 / F.col("nodes"))
    if pagerank is None:
        return out.withColumn("pr_var", F.lit(0.0))
    return out.join(pagerank.groupBy("tau").agg(F.var_pop("pagerank").alias("pr_var")), "tau", "left")


def figure_names(width: int) -> list[str]:
    """The figures of a lag other than its rate and its flag, in order."""
    return ["nodes", "edges", "mean_degree", "pr_var", *[f"mean{i}" for i in range(width)], *[f"std{i}" for i in range(width)]]


def lag_matrix(steps: DataFrame, width: int, window: int, train_end: int, label_lag: int = 0) -> DataFrame:
    """(tau, features): ``snapshot_figures`` of the steps tau - window .. tau - 1 and the differences of neighbours.

    A lag holds rate, nodes, edges, mean degree, PageRank variance, a flag whether
    the step exists, then means and deviations: m = 6 + 2 width figures, so
    m window + (m - 1)(window - 1) in all, as the flag has no difference. The
    rate is read ``label_lag`` steps earlier still. What is missing is the mean
    over the training steps; differences at a missing step are 0. One row a step.
    """
    if label_lag < 0:
        raise ValueError("a negative label lag reads labels of later steps")
    cols = figure_names(width)
    m = steps.filter(F.col("tau") <= train_end).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m_{c}") for c in ("rate", *cols)])
    want = steps.select("tau", F.explode(F.sequence(F.lit(window), F.lit(1), F.lit(-1))).alias("lag")) if window else steps.select("tau", F.lit(0).alias("lag")).limit(0)
    want = want.withColumns({"at": F.col("tau") - F.col("lag"), "rate_at": F.col("tau") - F.col("lag") - label_lag})
    have = steps.select(F.col("tau").alias("at"), *[F.col(c).cast("double").alias(c) for c in cols], F.lit(1.0).alias("present"))
    j = want.join(have, "at", "left").join(steps.select(F.col("tau").alias("rate_at"), "rate"), "rate_at", "left").join(F.broadcast(m))  # one row
    head = ["rate", *cols[:4]]
    fill = lambda c: F.coalesce(F.col(c), F.col(f"m_{c}"))
    row = F.struct((-F.col("lag")).alias("o"), F.array(*map(fill, head)).alias("a"), F.coalesce("present", F.lit(0.0)).alias("p"), F.array(*map(fill, cols[4:])).alias("b"))
    g = j.groupBy("tau").agg(F.array_sort(F.collect_list(row)).alias("l"))  # ``window`` entries
    levels = F.flatten(F.transform("l", lambda s: F.concat(s["a"], F.array(s["p"]), s["b"])))
    minus = lambda s, t: F.zip_with(F.concat(s["a"], s["b"]), F.concat(t["a"], t["b"]), lambda u, v: F.when((s["p"] > 0) & (t["p"] > 0), u - v).otherwise(0.0))
    later, earlier = F.slice("l", 2, max(window - 1, 0)), F.slice("l", 1, max(window - 1, 0))
    return g.select("tau", F.concat(levels, F.flatten(F.zip_with(later, earlier, minus))).alias("features"))


def label_lag_rate(steps: DataFrame, rate: str, lag: int, train_end: int) -> DataFrame:
    """The rate read ``lag`` steps back, the training mean where that step is missing."""
    m = steps.filter(F.col("tau") <= train_end).agg(F.avg(rate).alias("m"))
    past = steps.select((F.col("tau") + lag).alias("tau"), F.col(rate).alias("past"))
    return steps.select("tau").join(past, "tau", "left").join(F.broadcast(m)).select("tau", F.coalesce("past", "m").alias("lagged_rate"))


def ema(steps: DataFrame, col: str, alpha: float = 0.3) -> DataFrame:
    """h0 = x0, h = alpha x + (1 - alpha) h; one row a step, so the ordered fold is small."""
    g = steps.agg(F.array_sort(F.collect_list(F.struct("tau", F.col(col).cast("double").alias("x")))).alias("l"))
    zero = F.array().cast("array<struct<tau:int,h:double>>")
    last = lambda acc: F.element_at(acc, -1)["h"]
    fold = F.aggregate("l", zero, lambda acc, s: F.concat(acc, F.array(F.struct(s["tau"].cast("int").alias("tau"), F.when(F.size(acc) == 0, s["x"]).otherwise(alpha * s["x"] + (1 - alpha) * F.try_element_at(acc, F.greatest(F.size(acc), F.lit(1)))["h"]).alias("h")))))
    return g.select(F.inline(fold))


def causal_shift(steps: DataFrame, col: str) -> DataFrame:
    return steps.select("tau", F.lag(col, 1, 0).over(Window.orderBy("tau")).alias("shifted"))


def class_weight(total: Column, count: Column, classes: int = 2) -> Column:
    return total / (classes * F.greatest(count, F.lit(1)).cast("double"))


def decay_weights(rows: DataFrame, lam: float = 0.25, keep: tuple[str, ...] = ()) -> DataFrame:
    """exp(-lam (last - tau)) times the class weight, scaled to mean 1; labelled rows only, with the columns ``keep``."""
    y = rows.filter("label <> -1")
    c = y.agg(F.max("tau").alias("last"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    j = y.join(F.broadcast(c))
    total = F.greatest("n0", F.lit(1)) + F.greatest("n1", F.lit(1))
    raw = F.exp(-lam * (F.col("last") - F.col("tau"))) * class_weight(total, F.when(F.col("label") == 1, F.col("n1")).otherwise(F.col("n0")))
    j = j.withColumn("raw", raw)
    m = j.agg(F.avg("raw").alias("mean"))
    return j.join(F.broadcast(m)).select("tau", "txid", "label", *keep, (F.col("raw") / F.col("mean")).alias("weight"))


def consecutive_sides(rows: DataFrame) -> DataFrame:
    """Each row as side 1 of its own step and side 0 of the next, for steps that have both sides."""
    x = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    x = x.withColumn("tau", F.when(F.col("side") == 1, F.col("tau")).otherwise(F.col("tau") + 1))
    both = rows.select("tau").distinct()
    both = both.join(both.select((F.col("tau") + 1).alias("tau")), "tau")
    return x.join(F.broadcast(both), "tau")  # one row a step


def onestep_sets(steps: DataFrame, first: int) -> DataFrame:
    """(tau, step, role): for each step from ``first`` the steps its state is calibrated on (up to tau - 2) and inferred on (also tau - 1)."""
    t = steps.select("tau").distinct()
    pairs = t.filter(F.col("tau") >= first).select("tau", F.explode(F.sequence(F.lit(1), F.col("tau") - 1)).alias("step"))
    pairs = pairs.join(t.select(F.col("tau").alias("step")), "step", "left_semi")
    roles = F.when(F.col("step") <= F.col("tau") - 2, F.array(F.lit("calibrate"), F.lit("infer"))).otherwise(F.array(F.lit("infer")))
    return pairs.select("tau", "step", F.explode(roles).alias("role"))
