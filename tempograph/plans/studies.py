"""Registered queries of studies and reports: lag matrices, snapshot bases, drift table, dimensions over hops, tables over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import names
from tempograph.operators import draws, graph, stats, sums, temporal
from tempograph.plans import walk
from tempograph.plans.registry import _ID, NODES, RUNS, TEST, W, _pr_sql, _runs, query
from tempograph.sources import graph as g

#: Snapshots that are shown on their own plane, and the steps of the shock report.
SHOWN, AROUND = (1, 42, 43, 44, 49), (41, 42, 43, 44, 45)
_FIGURES = ["nodes", "edges", "mean_degree", "pr_var", *[f"mean{i}" for i in range(4)], *[f"std{i}" for i in range(4)]]


def _lag_sql(window: int, label_lag: int) -> str:
    head, rest = _FIGURES[:4], _FIGURES[4:]
    fill = lambda t, c: f"coalesce({t}.{c}, tr.{c})"
    joins, levels, diffs = "", [], []
    for lag in range(window, 0, -1):
        joins += f" LEFT JOIN fig a{lag} ON a{lag}.tau = t.tau - {lag} LEFT JOIN fig r{lag} ON r{lag}.tau = t.tau - {lag + label_lag}"
        levels += [fill(f"r{lag}", "rate"), *[fill(f"a{lag}", c) for c in head], f"CASE WHEN a{lag}.tau IS NULL THEN 0.0 ELSE 1.0 END", *[fill(f"a{lag}", c) for c in rest]]
        if lag < window:
            both = f"a{lag}.tau IS NOT NULL AND a{lag + 1}.tau IS NOT NULL"
            diffs += [f"CASE WHEN {both} THEN {fill(f'r{lag}', 'rate')} - {fill(f'r{lag + 1}', 'rate')} ELSE 0.0 END"]
            diffs += [f"CASE WHEN {both} THEN a{lag}.{c} - a{lag + 1}.{c} ELSE 0.0 END" for c in (*head, *rest)]
    stats_ = ", ".join([f"avg(f[{i + 1}]) AS mean{i}" for i in range(4)] + [f"stddev_pop(f[{i + 1}]) AS std{i}" for i in range(4)])
    return f"""{W}, pr AS ({_pr_sql(20).replace("round(p, 9)", "p")}),
fig AS (SELECT c.tau, rate, CAST(nodes AS DOUBLE) AS nodes, CAST(coalesce(e.edges, 0) AS DOUBLE) AS edges, 2.0 * coalesce(e.edges, 0) / nodes AS mean_degree, v.pr_var, {", ".join(rest)}
  FROM (SELECT tau, avg(CASE WHEN label >= 0 THEN label END) AS rate, count(*) AS nodes, {stats_} FROM feats GROUP BY tau) c LEFT JOIN (SELECT tau, count(*) AS edges FROM edges GROUP BY tau) e USING (tau)
  LEFT JOIN (SELECT tau, var_pop(pagerank) AS pr_var FROM pr JOIN nodes USING (tau, txid) GROUP BY tau) v USING (tau)),
tr AS (SELECT avg(rate) AS rate, {", ".join(f"avg({c}) AS {c}" for c in _FIGURES)} FROM fig WHERE tau <= 26),
flat AS (SELECT t.tau, unnest([{", ".join(levels + diffs)}]) AS v, unnest(range({len(levels + diffs)})) AS pos FROM fig t CROSS JOIN tr{joins})
SELECT tau, CAST(pos AS INT) AS pos, round(v, 6) + 0.0 AS v FROM flat"""


@query(_lag_sql(3, 2))
def lag_matrix(spark, d):
    n = g.nodes(spark, d)
    e = g.edges_of(n)
    ranks = graph.pagerank(n, g.dirty_edges(e), iterations=20, tol=None)
    m = temporal.lag_matrix(temporal.snapshot_figures(n, e, g.features(spark, d), 4, ranks), 4, 3, g.TRAIN_END, label_lag=2)
    return m.select("tau", F.posexplode("features").alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)  # no negative zero


_BASE = r"regexp_replace(name, ' \(Seed [0-9]+, Var .*\)', '')"


@query(f"WITH {RUNS} SELECT {_BASE} AS config, tau, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, round(avg(prauc), 6) AS prauc_mean, round(stddev_samp(prauc), 6) AS prauc_std FROM runs GROUP BY ALL")
def timestep_seed_agg(spark, d):
    r = _runs(spark, d).withColumn("config", names.without_seed(F.col("name")))
    cells = [F.round(f(c), 6).alias(f"{c}_{k}") for c in ("f1", "prauc") for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return r.groupBy("config", "tau").agg(*cells)


@query(f"""WITH {RUNS}, c AS (SELECT {_BASE} AS config, regexp_extract(name, 'Var ([A-Za-z]+)', 1) AS variation, regexp_extract(name, 'K=([0-9]+)', 1) AS k, regexp_extract(name, 'Topo=([A-Za-z]+)', 1) AS topo, f1, seq FROM runs),
a AS (SELECT config, variation, round(avg(f1), 6) AS f1_mean FROM c GROUP BY ALL), h AS (SELECT config, variation, min_by(k, seq) AS k, min_by(topo, seq) AS topo FROM c WHERE seq % 2 = 0 GROUP BY ALL)
SELECT a.*, CAST(h.k AS INT) AS k, h.topo FROM a LEFT JOIN h USING (config, variation)""")
def hyper_reattach(spark, d):
    p = names.parse_name(F.col("name"))
    c = _runs(spark, d).select(names.without_seed(F.col("name")).alias("config"), p["variation"].alias("variation"), p["k"].cast("int").alias("k"), names.split_name(names.without_seed(F.col("name")))["topo"].alias("topo"), "f1", "seq")
    key = ["config", "variation"]
    logged = c.filter("seq % 2 = 0").groupBy(*key).agg(F.min_by("k", "seq").alias("k"), F.min_by("topo", "seq").alias("topo"))
    return c.groupBy(*key).agg(F.round(F.avg("f1"), 6).alias("f1_mean")).join(logged, key, "left")


@query(f"""WITH {RUNS}, t AS (SELECT *, ['run0', 'run1', 'run2', 'run3', 'phaseA', 'phaseB', 'phaseC', 'phaseD'][seq % 8 + 1] AS tag, regexp_extract(name, 'Topo=([A-Za-z]+)', 1) AS topo FROM runs),
m AS (SELECT tag, topo, name, unnest(['f1', 'prauc']) AS metric, unnest([f1, prauc]) AS v FROM t),
o AS (SELECT metric, max(v) AS old FROM m WHERE name LIKE 'Grid:%Var Base)' GROUP BY metric),
b AS (SELECT metric, tag, max(v) AS best FROM m WHERE CASE tag WHEN 'run3' THEN topo = 'late' WHEN 'run2' THEN topo = 'early' WHEN 'run0' THEN topo <> 'None' WHEN 'run1' THEN topo <> 'None' ELSE true END GROUP BY ALL)
SELECT metric, tag, round(old, 6) AS old, round(best, 6) AS best, round(best - old, 6) AS delta FROM b JOIN o USING (metric)""")
def best_of_runs(spark, d):
    r = _runs(spark, d).withColumn("topo", names.split_name(names.without_seed(F.col("name")))["topo"])
    tags = ["run0", "run1", "run2", "run3", "phaseA", "phaseB", "phaseC", "phaseD"]
    t = r.withColumn("tag", F.element_at(F.array(*map(F.lit, tags)), (F.col("seq") % 8 + 1).cast("int")))
    long = t.select("tag", "topo", "name", F.explode(F.create_map(F.lit("f1"), F.col("f1"), F.lit("prauc"), F.col("prauc"))).alias("metric", "v"))
    head = F.when(F.col("tag") == "run3", F.col("topo") == "late").when(F.col("tag") == "run2", F.col("topo") == "early").when(F.col("tag").startswith("run"), F.col("topo") != "None").otherwise(True)
    base = F.col("name").startswith("Grid:") & F.col("name").endswith("Var Base)")
    old = long.filter(base).groupBy("metric").agg(F.max("v").alias("old"))
    best = long.filter(head).groupBy("metric", "tag").agg(F.max("v").alias("best"))
    return best.join(F.broadcast(old), "metric").select("metric", "tag", *[F.round(F.col(c), 6).alias(c) for c in ("old", "best")], F.round(F.col("best") - F.col("old"), 6).alias("delta"))  # two rows


@query(f"WITH {RUNS}, s AS (SELECT seq, regexp_extract(name, 'Var ([A-Za-z]+)', 1) AS variation, CASE seq % 11 WHEN 0 THEN 'none' WHEN 1 THEN NULL WHEN 2 THEN '42.5x' ELSE regexp_extract(name, 'Seed ([0-9]+)', 1) END AS seed FROM runs) SELECT seq, seed, variation = 'Base' AND coalesce(TRY_CAST(seed AS INT) IN (42, 44), false) AS current FROM s")
def safe_cast_membership(spark, d):
    p = names.parse_name(F.col("name"))
    odd = F.when(F.col("seq") % 11 == 0, "none").when(F.col("seq") % 11 == 1, None).when(F.col("seq") % 11 == 2, "42.5x").otherwise(p["seed"].cast("string"))
    r = _runs(spark, d).select("seq", odd.alias("seed"), p["variation"].alias("variation"))
    return r.select("seq", "seed", ((F.col("variation") == "Base") & names.safe_member(F.col("seed"), [42, 44])).alias("current"))


_MLP = f"""n AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'MLP-Deep [' || replace({_BASE}, 'Grid: ', '') || ']' WHEN 1 THEN 'MLP-Small [K=' || (seq % 3 + 1) || ']' WHEN 2 THEN 'something else' ELSE {_BASE} END AS name FROM runs)"""


@query(f"""WITH {RUNS}, {_MLP}, p AS (SELECT seq, name, regexp_extract(name, '^MLP-([A-Za-z]+) \\[', 1) AS a, CASE WHEN name LIKE 'Grid:%' OR name LIKE 'MLP-%' THEN name ELSE '' END AS s FROM n)
SELECT seq, CASE WHEN a = '' THEN 'Linear' ELSE a END AS arch, coalesce(TRY_CAST(regexp_extract(s, 'K=([0-9]+)', 1) AS INT), 1) AS k, CASE WHEN contains(s, 'Dir=') THEN regexp_extract(s, 'Dir=([A-Z])', 1) ELSE 'F' END AS dir,
CASE WHEN contains(s, 'Topo=') THEN regexp_extract(s, 'Topo=([A-Za-z]+)', 1) ELSE 'None' END AS topo FROM p""")
def split_names(spark, d):
    base = names.without_seed(F.col("name"))
    made = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("MLP-Deep ["), F.regexp_replace(base, "Grid: ", ""), F.lit("]")))
    made = made.when(F.col("seq") % 4 == 1, F.concat(F.lit("MLP-Small [K="), (F.col("seq") % 3 + 1).cast("string"), F.lit("]"))).when(F.col("seq") % 4 == 2, "something else").otherwise(base)
    p = names.split_name(F.col("name"))
    return _runs(spark, d).select("seq", made.alias("name")).select("seq", *[p[c].alias(c) for c in ("arch", "k", "dir", "topo")])


@query(f"""{W}, pool AS (SELECT * FROM feats ORDER BY md5('0:' || txid), txid LIMIT {draws.POOL}),
z AS (SELECT txid, {", ".join(f"(f[{i}] - avg(f[{i}]) OVER ()) / stddev_pop(f[{i}]) OVER () AS z{i}" for i in range(1, 5))} FROM feats)
SELECT round(quantile_cont(sqrt(power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2) + power(a.z3 - b.z3, 2) + power(a.z4 - b.z4, 2)), 0.9), 6) AS edge_length, count(*) AS pairs
FROM z a JOIN z b ON a.txid < b.txid WHERE a.txid IN (SELECT txid FROM pool) AND b.txid IN (SELECT txid FROM pool)""")
def pooled_edge_length(spark, d):
    x = stats.zscore(g.features(spark, d), 4, F.lit(True))
    pool = x.orderBy(draws.seeded(F.lit(0), "txid"), "txid").limit(draws.POOL)  # the sample of the measure itself
    pairs = stats.pairs_within(pool.select(F.lit(0).alias("g"), F.col("txid").alias("vec_id"), F.col("features").alias("v")), "g")
    return pairs.agg(F.round(F.percentile(F.sqrt("d2"), F.lit(0.9)), 6).alias("edge_length"), F.count("*").alias("pairs"))


@query()
def snapshot_planes(spark, d):
    x = g.features(spark, d).filter(F.col("tau").isin(*SHOWN) & (F.col("label") != -1))
    packed = sums.pack(x)
    planes = {t: sums.basis(c, 2) for t, c in sums.step_covariances(packed).items()}
    return sums.projected(packed, planes).select("tau", "txid", "label", F.col("features")[0].alias("pca1"), F.col("features")[1].alias("pca2"))


@query()
def manifold_drift(spark, d):
    z = stats.zscore(g.features(spark, d), 4, F.col("tau") <= draws.REFERENCE_END)
    packed = sums.pack(z)
    steps = sums.step_covariances(packed)
    if not steps:
        return draws.drift_table(z, z)
    fixed = sums.basis(sums.merged([c for t, c in steps.items() if t <= draws.REFERENCE_END] or list(steps.values())), draws.DRIFT_PARTS)
    return draws.drift_table(z, sums.projected(packed, {t: fixed for t in steps}))


@query()
def dimension_over_hops(spark, d):
    n = g.nodes(spark, d)
    x = stats.zscore(g.features(spark, d), 4, F.col("tau") <= g.TRAIN_END)
    s = graph.symmetric_operator(n, g.edges_of(n))
    out = None
    for k in (0, 1, 2):
        p = graph.propagate(s, x, k, 4).select(F.lit(k).alias("hops"), F.col("txid").alias("vec_id"), F.transform("features", lambda v: F.round(v, 9)).alias("v"))  # equal sums that were added in another order are 0 apart
        out = p if out is None else out.unionByName(p)
    return stats.two_nn(out, "hops", cells=True).withColumn("dimension", F.round("dimension", 6))


@query()
def champion_report(spark, d):
    n = g.nodes(spark, d)
    e = g.edges_of(n)
    x = g.features(spark, d)
    hops = graph.propagate(graph.symmetric_operator(n, e), x, 2, 4, multiscale=True).join(x.select("tau", "txid", "label"), ["tau", "txid"])
    steps = [t for t in TEST if t in AROUND]
    graph_f1 = walk.step_metrics(walk.decide(walk.run(hops, 12, steps))).select("tau", F.col("f1").alias("graph_f1"))
    trees_f1 = walk.step_metrics(walk.decide(walk.run(x, 4, steps, "gbt"))).select("tau", F.col("f1").alias("trees_f1"))
    topology = graph.snapshot_topology(n, e).filter(F.col("tau").isin(*AROUND))
    return topology.select("tau", "n_nodes", "n_edges", "n_illicit", "mean_degree", "density_directed").join(graph_f1, "tau", "left").join(trees_f1, "tau", "left")
