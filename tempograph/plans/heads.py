"""Registered queries of model heads, walk-forward runs, label separability and the summed operator."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tempograph.operators import anomaly, draws, graph, stats, temporal
from tempograph.plans import models, walk
from tempograph.plans.registry import NODES, TEST, W, _flat, _hops, _steps, query
from tempograph.sources import files
from tempograph.sources import graph as g

ALL = list(range(1, g.STEPS + 1))
#: Rows of each label that a step needs before its separability is read.
LEAST = 3


@query()
def l1_static(spark, d):
    return models.static_scores(g.features(spark, d), "l1", 4)


@query()
def mlp_static(spark, d):
    return walk.static(g.features(spark, d), 4, g.TRAIN_END, TEST, "mlp")


@query()
def gbt_walk_forward_decay(spark, d):
    return walk.decide(walk.run(g.features(spark, d), 4, TEST, "gbt"))


@query()
def lr_walk_forward_window(spark, d):
    return walk.decide(walk.run(g.features(spark, d), 4, TEST, lam=0.0, window=10))


@query()
def ipca_walk_forward(spark, d):
    return models.ipca_walk_forward(g.features(spark, d), "lr", 4, 3, TEST, ALL)


@query()
def ema_walk_forward(spark, d):
    # The smoothed state of a step holds the steps before it only.
    c = temporal.causal_shift(temporal.ema(_steps(spark, d), "mean_value"), "h")
    return walk.decide(walk.run(models.with_context(g.features(spark, d), c, ["shifted"]), 5, TEST, lam=0.0))


@query()
def walk_forward_metrics(spark, d):
    return walk.step_metrics(walk.decide(walk.run(g.features(spark, d), 4, TEST)))


@query()
def walk_forward_metrics_propagated(spark, d):
    n = g.nodes(spark, d)
    s = graph.symmetric_operator(n, g.dirty_edges(g.edges_of(n)))
    x = g.features(spark, d)
    hops = graph.propagate(s, x, 1, 4, multiscale=True).join(x.select("tau", "txid", "label"), ["tau", "txid"])
    return walk.step_metrics(walk.decide(walk.run(hops, 8, TEST)))


@query()
def walk_forward_metrics_lags(spark, d):
    lags = temporal.lag_features(_steps(spark, d), ["n", "rate", "mean_value"], 3, g.TRAIN_END)  # 18 figures a step, of earlier steps only
    x = g.features(spark, d).join(F.broadcast(lags.withColumnRenamed("features", "lags")), "tau").withColumn("features", F.concat("features", "lags"))
    return walk.step_metrics(walk.decide(walk.run(x, 22, TEST)))


@query()
def mlp_walk_forward(spark, d):
    return walk.step_metrics(walk.decide(walk.run(g.features(spark, d), 4, TEST, "mlp", lam=0.0)))


@query()
def ensemble_walk_forward(spark, d):
    x = g.features(spark, d)
    return walk.step_metrics(walk.decide(walk.blend(walk.run(x, 4, TEST, "mlp"), walk.run(x, 4, TEST, "gbt"))))


@query()
def forest_walk_forward(spark, d):
    k = temporal.window_sums(_steps(spark, d), ["n1", "n0"], None, -2)
    rates = k.select("tau", F.try_divide(F.col("n1").cast("double"), (F.col("n0") + F.col("n1")).cast("double")).alias("rate"))
    return anomaly.flag_by_prevalence(anomaly.forest_walk_forward(g.features(spark, d), TEST), rates)


_SUMMED = """m0 AS (SELECT tau, src AS r, dst AS c, count(*) AS m FROM dirty GROUP BY ALL),
m1 AS (SELECT tau, r, c, max(m) AS m FROM (SELECT * FROM m0 UNION ALL SELECT tau, c, r, m FROM m0) GROUP BY ALL),
m2 AS (SELECT tau, r, c, sum(m) AS m FROM (SELECT * FROM m1 UNION ALL SELECT tau, txid, txid, 1 FROM nodes) GROUP BY ALL),
md AS (SELECT tau, r, sum(m) AS d FROM m2 GROUP BY ALL),
s AS (SELECT m2.tau, m2.r, m2.c, m2.m / sqrt(a.d * b.d) AS w FROM m2 JOIN md a ON a.tau = m2.tau AND a.r = m2.r JOIN md b ON b.tau = m2.tau AND b.r = m2.c)"""


def _summed(spark, d):
    n = g.nodes(spark, d)
    return graph.summed_operator(n, g.dirty_edges(g.edges_of(n)))


@query(f"{W}, {_SUMMED} SELECT tau, r, c, round(w, 9) AS w FROM s")
def summed_operator(spark, d):
    return _summed(spark, d).withColumn("w", F.round("w", 9))


@query(f"{W}, {_SUMMED}, {_hops(1)} SELECT tau, txid, " + ", ".join(f"round(f{i}, 5) AS f{i}" for i in range(4)) + " FROM x1")
def sgc_summed(spark, d):
    return _flat(graph.propagate(_summed(spark, d), g.features(spark, d), 1, 4), 4, 5)


def _separability(points):
    c = points.groupBy("tau").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    keep = c.filter((F.col("n0") >= LEAST) & (F.col("n1") >= LEAST))
    m = stats.mmd2_line(points.join(F.broadcast(keep.select("tau")), "tau", "left_semi"), "tau", 0.5)  # one row a step
    return m.join(F.broadcast(keep), "tau").select("tau", F.col("n1").alias("n_illicit"), F.round("mmd2", 6).alias("mmd2"))


def _sep_sql(rep, value):
    return f"""p_{rep} AS ({value}), k_{rep} AS (SELECT tau, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM p_{rep} GROUP BY tau),
m_{rep} AS (SELECT a.tau, avg(CASE WHEN a.label = 0 AND b.label = 0 AND a.txid <> b.txid THEN exp(-0.5 * (a.v - b.v) * (a.v - b.v)) END) AS k0,
 avg(CASE WHEN a.label = 1 AND b.label = 1 AND a.txid <> b.txid THEN exp(-0.5 * (a.v - b.v) * (a.v - b.v)) END) AS k1,
 avg(CASE WHEN a.label = 0 AND b.label = 1 THEN exp(-0.5 * (a.v - b.v) * (a.v - b.v)) END) AS k2 FROM p_{rep} a JOIN p_{rep} b ON a.tau = b.tau GROUP BY a.tau),
o_{rep} AS (SELECT '{rep}' AS representation, tau, n1 AS n_illicit, round(k0 + k1 - 2 * k2, 6) AS mmd2 FROM m_{rep} JOIN k_{rep} USING (tau) WHERE n0 >= {LEAST} AND n1 >= {LEAST})"""


@query(f"{W}, {_SUMMED}, {_hops(1)}, {_sep_sql('raw', 'SELECT tau, txid, label, value / 10 AS v FROM nodes WHERE label >= 0')}, "
       f"{_sep_sql('propagated', 'SELECT n.tau, n.txid, n.label, x.f0 / 10 AS v FROM nodes n JOIN x1 x USING (tau, txid) WHERE n.label >= 0')} SELECT * FROM o_raw UNION ALL SELECT * FROM o_propagated")
def label_separability_series(spark, d):
    x = g.features(spark, d).filter("label >= 0")
    hop = graph.propagate(_summed(spark, d), g.features(spark, d), 1, 4).join(x.select("tau", "txid", "label"), ["tau", "txid"])
    point = lambda y: y.select("tau", F.col("txid").alias("vec_id"), F.col("label").alias("side"), F.array(F.col("features")[0] / 10).alias("v"))
    raw, moved = (_separability(point(y)).withColumn("representation", F.lit(r)) for r, y in (("raw", x), ("propagated", hop)))
    return raw.unionByName(moved)


@query("""WITH l AS (SELECT column_name AS name FROM (DESCRIBE documents)), r AS (SELECT column_name AS name FROM (DESCRIBE labels))
SELECT 'left' AS side, name FROM (SELECT name FROM l EXCEPT ALL SELECT name FROM r) UNION ALL SELECT 'right', name FROM (SELECT name FROM r EXCEPT ALL SELECT name FROM l)""")
def schema_difference(spark, d):
    return files.schema_diff(spark, g.table(spark, d, "documents"), g.table(spark, d, "labels")).select("side", "name")


def _scaled(spark, d):
    return stats.zscore(g.features(spark, d), 4, F.lit(True))


_DRAWN = """z AS (SELECT tau, txid, label, """ + ", ".join(f"(f[{i}] - avg(f[{i}]) OVER ()) / CASE WHEN stddev_pop(f[{i}]) OVER () > 0 THEN stddev_pop(f[{i}]) OVER () ELSE 1 END AS z{i}" for i in range(1, 5)) + """ FROM feats),
cnt AS (SELECT tau, count(*) AS n, count(*) FILTER (label = 1) AS i FROM z GROUP BY tau),
mm AS (SELECT least(800, min(n)) AS m FROM cnt),
c0 AS (SELECT * FROM (SELECT *, md5('0:' || txid) AS h, row_number() OVER (PARTITION BY tau ORDER BY md5('0:' || txid), txid) AS r FROM z) WHERE r <= (SELECT m FROM mm)),
pool AS (SELECT * FROM c0 ORDER BY h, txid LIMIT 2000),
sig AS (SELECT median(sqrt(power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2) + power(a.z3 - b.z3, 2) + power(a.z4 - b.z4, 2))) AS s FROM pool a JOIN pool b ON a.txid < b.txid),
drawn AS (SELECT * FROM (
  SELECT 'Base' AS variation, (SELECT m FROM mm) AS m, seed, z.*, row_number() OVER (PARTITION BY seed, tau ORDER BY md5(seed || ':' || txid), txid) AS r FROM z, (SELECT unnest(range(10)) AS seed)
  UNION ALL SELECT 'Illicit', 24, seed, z.*, row_number() OVER (PARTITION BY seed, tau ORDER BY md5(seed || ':' || txid), txid) FROM z, (SELECT unnest(range(10)) AS seed) WHERE label = 1 AND tau IN (SELECT tau FROM cnt WHERE i >= 24))
  WHERE r <= m),
kern AS (SELECT a.variation, a.seed, a.m, a.tau, b.tau AS tau2, sum(exp(-(power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2) + power(a.z3 - b.z3, 2) + power(a.z4 - b.z4, 2)) / (2 * s * s))) AS k
  FROM drawn a JOIN drawn b ON a.variation = b.variation AND a.seed = b.seed AND (b.tau = a.tau OR b.tau = a.tau + 1) AND a.txid <> b.txid, sig GROUP BY ALL),
raw AS (SELECT x.variation, x.seed, CAST(x.m AS INT) AS m, x.tau, (x.k + y.k) / (x.m * (x.m - 1)) - 2 * c.k / (x.m * x.m) AS mmd2 FROM kern x JOIN kern y USING (variation, seed) JOIN kern c USING (variation, seed)
  WHERE x.tau2 = x.tau AND y.tau2 = y.tau AND y.tau = x.tau + 1 AND c.tau = x.tau AND c.tau2 = x.tau + 1),
med AS (SELECT variation, seed, median(mmd2) AS med, mad(mmd2) AS mad FROM raw WHERE tau NOT IN (40, 41, 42, 43, 44) GROUP BY ALL)"""


@query(f"{W}, {_DRAWN} SELECT variation, tau, CAST(seed AS INT) AS seed, m, round(mmd2, 8) AS mmd2, round((mmd2 - med) / (1.4826 * mad), 4) AS z, CAST(rank() OVER (PARTITION BY variation, seed ORDER BY mmd2 DESC) AS INT) AS rank FROM raw LEFT JOIN med USING (variation, seed)")
def mmd_canary(spark, d):
    return draws.canary(_scaled(spark, d)).select("variation", "tau", "seed", "m", F.round("mmd2", 8).alias("mmd2"), F.round("z", 4).alias("z"), "rank")


@query(f"{W}, {_DRAWN}, k AS (SELECT variation, tau, rank() OVER (PARTITION BY variation, seed ORDER BY mmd2 DESC) AS rank FROM raw) SELECT variation, tau, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS first_share, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS top_share, median(rank) AS median_rank FROM k GROUP BY ALL")
def canary_rank_share(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    rows = draws.canary(_scaled(spark, d))
    return rows.groupBy("variation", "tau").agg(share(F.col("rank") == 1).alias("first_share"), share(F.col("rank") <= 10).alias("top_share"), F.median("rank").alias("median_rank"))


@query()
def mmd_canary_verdict(spark, d):
    x = _scaled(spark, d)
    return draws.canary_verdict(draws.canary(x), draws.shock_permutation(x, 1 / (2 * draws.kernel_width(x) ** 2)))


def _draw_rows(spark, d, steps=None):
    """Separability of both representations in each draw, of ``steps`` only if given; scales and kernel widths are of all steps."""
    n = g.nodes(spark, d)
    x = stats.zscore(g.features(spark, d), 4, F.col("label") != -1)
    s = graph.symmetric_operator(n, g.edges_of(n))
    x = x.select("tau", "txid", "label", F.col("features").alias("raw"))
    moved = graph.propagate(s, x.withColumnRenamed("raw", "features"), 1, 4, multiscale=True).select("tau", "txid", F.col("features").alias("propagated"))
    # Read for both kernel widths and the draws; stays until the session's cache is cleared.
    both = x.join(moved, ["tau", "txid"]).filter("label <> -1").persist(StorageLevel.MEMORY_AND_DISK)
    widths = {"raw": 4, "propagated": 8}  # each representation has its own kernel width; draws and permutations are the same
    gammas = [(w, 1 / (2 * draws.kernel_width(both.withColumn("features", F.col(name))) ** 2)) for name, w in widths.items()]
    asked = both.filter(F.col("tau").isin(steps)) if steps else both
    out = draws.separability(asked.select("tau", "txid", "label", F.concat(*widths).alias("features")), gammas)
    return out.withColumn("representation", F.element_at(F.array(*[F.lit(name) for name in widths]), F.col("rep") + 1)).drop("rep")


@query()
def label_separability_draws(spark, d):
    return _draw_rows(spark, d)


@query()
def propagation_verdict(spark, d):
    # A step's draws and permutations are its own, so steps that the verdict does not read are not tested.
    return draws.broadcast_verdict(_draw_rows(spark, d, [draws.SHOCK, draws.SHOCK + 1]), "raw", "propagated")
