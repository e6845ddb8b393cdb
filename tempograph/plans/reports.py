"""Further registered queries: drift, injection, regimes, lookups and report tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import names
from tempograph.operators import evaluate, graph, stats, temporal
from tempograph.plans.registry import _ID, NODES, RUNS, STEP, SYM, W, _chan, _flat, _hops, _loop_sql, _pred, _runs, _steps, query
from tempograph.sources import graph as g

_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_CONF = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) AS n"


@query(W + """, c AS (SELECT tau, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM nodes GROUP BY tau),
k AS (SELECT a.tau, coalesce(sum(b.n1), 0) AS n1, coalesce(sum(b.n0), 0) AS n0 FROM c a LEFT JOIN c b ON b.tau <= a.tau - 2 WHERE a.tau >= 35 GROUP BY a.tau)
SELECT tau, round((greatest(n0, 1) + greatest(n1, 1)) / (2.0 * greatest(n0, 1)), 6) AS w0, round((greatest(n0, 1) + greatest(n1, 1)) / (2.0 * greatest(n1, 1)), 6) AS w1,
round(n0 / greatest(n1, 1), 6) AS scale_pos_weight, round(coalesce(n1 / nullif(n0 + n1, 0), 0.5), 6) AS base_rate FROM k""")
def class_weights_walk_forward(spark, d):
    k = temporal.window_sums(_steps(spark, d), ["n1", "n0"], None, -2).filter("tau >= 35")
    n0, n1 = F.greatest("n0", F.lit(1)), F.greatest("n1", F.lit(1))
    rate = F.coalesce(F.try_divide(F.col("n1").cast("double"), (F.col("n0") + F.col("n1")).cast("double")), F.lit(0.5))
    return k.select("tau", F.round(temporal.class_weight(n0 + n1, n0), 6).alias("w0"), F.round(temporal.class_weight(n0 + n1, n1), 6).alias("w1"), F.round(F.col("n0") / n1, 6).alias("scale_pos_weight"), F.round(rate, 6).alias("base_rate"))


@query(f"WITH {NODES}, {STEP} SELECT tau, CAST(coalesce(sum(n1) OVER w, 0) AS BIGINT) AS n1, CAST(coalesce(sum(n0) OVER w, 0) AS BIGINT) AS n0 FROM step WINDOW w AS (ORDER BY tau RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def baseline_window_stats(spark, d):
    return temporal.window_sums(_steps(spark, d), ["n1", "n0"], -5, -1)


@query(W + ", t AS (SELECT DISTINCT tau FROM nodes), p AS (SELECT a.tau, b.tau AS step FROM t a JOIN t b ON b.tau < a.tau WHERE a.tau >= 35) SELECT tau, step, 'infer' AS role FROM p UNION ALL SELECT tau, step, 'calibrate' FROM p WHERE step <= tau - 2")
def onestep_state_sets(spark, d):
    return temporal.onestep_sets(g.nodes(spark, d), g.VAL_END + 1)


_DRIFT = """pts AS (SELECT tau, txid, value / 10 AS v FROM nodes),
kx AS (SELECT a.tau, avg(exp(-0.5 * (a.v - b.v) * (a.v - b.v))) AS k FROM pts a JOIN pts b ON a.tau = b.tau AND a.txid <> b.txid GROUP BY a.tau),
kxy AS (SELECT b.tau, avg(exp(-0.5 * (a.v - b.v) * (a.v - b.v))) AS k FROM pts a JOIN pts b ON a.tau = b.tau - 1 GROUP BY b.tau),
mmd AS (SELECT y.tau, x.k + y.k - 2 * c.k AS mmd2 FROM kx x JOIN kx y ON y.tau = x.tau + 1 JOIN kxy c ON c.tau = y.tau)"""


def _drift(spark, d):
    x = g.nodes(spark, d).select("tau", F.col("txid").alias("vec_id"), F.array(F.col("value") / 10).alias("v"))
    return stats.mmd2_line(temporal.consecutive_sides(x), "tau", 0.5)


@query(f"WITH {NODES}, {_DRIFT} SELECT tau, round(mmd2, 6) AS mmd2 FROM mmd")
def drift_consecutive(spark, d):
    return _drift(spark, d).select("tau", F.round("mmd2", 6).alias("mmd2"))


@query(f"WITH {NODES}, {_DRIFT} SELECT tau, CAST(rank() OVER (ORDER BY round(mmd2, 9) DESC) AS INT) AS place, CAST(count(*) OVER () AS BIGINT) AS of FROM mmd")
def drift_rank(spark, d):
    m = _drift(spark, d).select("tau", F.round("mmd2", 9).alias("mmd2"))  # one row a step
    return m.select("tau", F.rank().over(Window.orderBy(F.desc("mmd2"))).alias("place"), F.count("*").over(Window.partitionBy()).alias("of"))


@query(f"WITH {NODES}, {_DRIFT}, r AS (SELECT tau, round(mmd2, 9) AS m FROM mmd), z AS (SELECT median(m) AS md, mad(m) AS s FROM r WHERE tau NOT BETWEEN 41 AND 45) SELECT tau, round(CASE WHEN s > 0 THEN (m - md) / (1.4826 * s) END, 4) AS z, m > md + 3 * 1.4826 * s AS alarm FROM r, z")
def drift_alarm(spark, d):
    # Transitions that touch steps 41 to 44 stay out of the null distribution.
    m = _drift(spark, d).select("tau", F.round("mmd2", 9).alias("m"))
    null = m.filter("tau not between 41 and 45")
    md = null.agg(F.median("m").alias("md"))
    s = null.join(F.broadcast(md)).agg(F.median(F.abs(F.col("m") - F.col("md"))).alias("s"))
    z = m.join(F.broadcast(md)).join(F.broadcast(s))  # one row each
    return z.select("tau", F.round(F.when(F.col("s") > 0, (F.col("m") - F.col("md")) / (1.4826 * F.col("s"))), 4).alias("z"), (F.col("m") > F.col("md") + 3 * 1.4826 * F.col("s")).alias("alarm"))


_DEG = "deg AS (SELECT n.tau, n.txid, n.label, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM nodes n LEFT JOIN (SELECT tau, src AS txid, count(*) c FROM dirty GROUP BY ALL) o USING (tau, txid) LEFT JOIN (SELECT tau, dst AS txid, count(*) c FROM dirty GROUP BY ALL) i USING (tau, txid))"


def _topo(spark, d, mode):
    n = g.nodes(spark, d)
    e = g.dirty_edges(g.edges_of(n))
    t = graph.degrees(n, e).select("tau", "txid", F.array(F.col("in_degree").cast("double"), F.col("out_degree").cast("double")).alias("topo"))
    return _flat(graph.inject_topology(graph.symmetric_operator(n, e), g.features(spark, d), t, mode, 1, 4, 2), 6, 5)


_OUT = ", ".join(f"round(x.f{i}, 5) AS f{i}" for i in range(4))


@query(f"WITH {NODES}, {SYM}, {_DEG}, {_hops(1)}, t AS (SELECT s.tau, s.r AS txid, sum(w * in_degree) AS a, sum(w * out_degree) AS b FROM s JOIN deg ON deg.tau = s.tau AND deg.txid = s.c GROUP BY ALL) SELECT x.tau, x.txid, {_OUT}, round(t.a, 5) AS f4, round(t.b, 5) AS f5 FROM x1 x JOIN t USING (tau, txid)")
def topo_early(spark, d):
    return _topo(spark, d, "early")


@query(f"WITH {NODES}, {SYM}, {_DEG}, {_hops(1)} SELECT x.tau, x.txid, {_OUT}, CAST(in_degree AS DOUBLE) AS f4, CAST(out_degree AS DOUBLE) AS f5 FROM x1 x JOIN deg USING (tau, txid)")
def topo_late(spark, d):
    return _topo(spark, d, "late")


#: Moves means with few digits off the ties of rounding, where engines differ in the last bit.
_OFF = 1.000000001
_TWO = [("y1", "s", "x0"), ("y2", "so", "x0"), ("y3", "si", "x0"), ("z1", "s", "y1"), ("z2", "so", "y2"), ("z3", "si", "y3")]


@query(f"WITH {NODES}, {SYM}, {_loop_sql('so', 'src', 'dst')}, {_loop_sql('si', 'dst', 'src')}, {_hops(0)}, {', '.join(_chan(*t) for t in _TWO)} SELECT x0.tau, x0.txid, "
       + ", ".join(f"round({t}.f{i} * {_OFF}, 4) AS f{4 * h + i}" for h, t in enumerate(["x0", *(t[0] for t in _TWO)]) for i in range(4)) + " FROM x0 " + " ".join(f"JOIN {t[0]} USING (tau, txid)" for t in _TWO))
def sgc_directional_k2(spark, d):
    n = g.nodes(spark, d)
    x = graph.propagate_directional(n, g.dirty_edges(g.edges_of(n)), g.features(spark, d), 2, 4)
    return _flat(x.withColumn("features", F.transform("features", lambda v: v * _OFF)), 28, 4)


@query(W + f", {_DEG} SELECT label, CAST(least(out_degree, 12) AS INT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS density FROM deg GROUP BY label, least(out_degree, 12)")
def degree_histogram(spark, d):
    n = g.nodes(spark, d)
    return graph.degree_histogram(graph.degrees(n, g.dirty_edges(g.edges_of(n)))).withColumn("density", F.round("density", 6))


@query(W + f", {_DEG} SELECT label, round(corr(in_degree, out_degree), 6) AS r, round(avg(in_degree), 6) AS mean_in, round(stddev_pop(in_degree), 6) AS std_in, round(var_pop(out_degree), 6) AS var_out FROM deg GROUP BY label")
def degree_correlation_by_label(spark, d):
    n = g.nodes(spark, d)
    x = graph.degrees(n, g.dirty_edges(g.edges_of(n)))
    a = x.groupBy("label").agg(F.corr("in_degree", "out_degree").alias("r"), F.avg("in_degree").alias("mean_in"), F.stddev_pop("in_degree").alias("std_in"), F.var_pop("out_degree").alias("var_out"))
    return a.select("label", *[F.round(c, 6).alias(c) for c in ("r", "mean_in", "std_in", "var_out")])


@query(W + f""", q AS (SELECT *, CASE WHEN tau < 43 THEN 'pre_shock' WHEN tau = 43 THEN 'shock' ELSE 'recovery' END AS regime FROM pred WHERE label <> -1), both_ AS (SELECT regime, tau, label, score FROM q UNION ALL SELECT 'all', tau, label, score FROM q),
c AS (SELECT regime, {_CONF} FROM both_ GROUP BY regime), st AS (SELECT regime, tau, {_CONF} FROM both_ GROUP BY regime, tau), m AS (SELECT regime, avg(round({_F1}, 4)) AS macro_f1 FROM st GROUP BY regime),
g AS (SELECT regime, score, count(*) FILTER (label = 1) AS tp, count(*) AS n FROM both_ GROUP BY ALL), cu AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY regime) AS pos, sum(n) OVER (PARTITION BY regime) AS rows FROM g WINDOW w AS (PARTITION BY regime ORDER BY score DESC)),
ap AS (SELECT regime, CASE WHEN max(pos) < max(rows) THEN sum(tp * ct / cn) / nullif(max(pos), 0) END AS ap FROM cu GROUP BY regime)
SELECT regime, n, tp + fn AS n_pos, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1, round(ap, 6) AS ap, round(macro_f1, 5) AS macro_f1, tp + fn < 10 AS low_support FROM c JOIN ap USING (regime) JOIN m USING (regime)""")
def regime_metrics_full(spark, d):
    m = evaluate.regime_metrics(_pred(spark, d))
    return m.withColumns({**{c: F.round(c, 6) for c in ("precision", "recall", "f1", "ap")}, "macro_f1": F.round("macro_f1", 5)})


@query(W + f", t AS (SELECT tau FROM pred WHERE label <> -1 GROUP BY tau HAVING count(DISTINCT label) = 2), c AS (SELECT tau, {_CONF} FROM pred WHERE label <> -1 AND tau IN (SELECT tau FROM t) GROUP BY tau) SELECT round(avg({_F1}), 6) AS macro_f1, count(*) AS steps FROM c")
def static_macro(spark, d):
    return evaluate.static_macro(_pred(spark, d)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(W + " SELECT label, txid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || txid), txid) AS k FROM nodes) WHERE k <= 2200")
def stratified_cap_sample(spark, d):
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("7:"), F.col("txid").cast("string"))), "txid")
    return g.nodes(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 2200").select("label", "txid")


@query(W + " SELECT tau, CAST(least(800, min(c)) AS BIGINT) AS m FROM (SELECT tau, label, count(*) AS c FROM nodes WHERE label >= 0 GROUP BY ALL) GROUP BY tau ORDER BY tau")
def identical_sample_size(spark, d):
    c = g.nodes(spark, d).filter("label >= 0").groupBy("tau", "label").count()
    return c.groupBy("tau").agg(F.least(F.lit(800).cast("long"), F.min("count")).alias("m")).orderBy("tau")


@query(f"WITH {RUNS} SELECT seq, round(least(f1, 12.0), 6) AS f1 FROM runs WHERE regexp_matches(name, 'Topo=(early|late)') AND NOT contains(name, 'Dir=T') AND seq BETWEEN 100 AND 5000")
def name_filters(spark, d):
    r = _runs(spark, d).filter(F.col("name").rlike("Topo=(early|late)") & ~F.col("name").contains("Dir=T") & F.col("seq").between(100, 5000))
    return r.select("seq", F.round(F.least("f1", F.lit(12.0)), 6).alias("f1"))


@query(f"WITH {RUNS}, c AS (SELECT DISTINCT {_ID} AS config FROM runs), v AS (SELECT unnest(['Base', 'PCA']) AS variation) SELECT config, variation, config || ' (Var ' || variation || ')' AS target FROM c CROSS JOIN v")
def config_targets(spark, d):
    c = _runs(spark, d).select(names.config_id(F.col("name")).alias("config")).distinct()
    c = c.withColumn("variation", F.explode(F.array(F.lit("Base"), F.lit("PCA"))))
    return c.withColumn("target", F.concat("config", F.lit(" (Var "), "variation", F.lit(")")))


@query(f"""WITH {RUNS}, want AS (SELECT unnest(['Grid: K=1, Dir=F, Topo=None (Seed 42, Var PCA)', 'Grid: K=2, Dir=T, Topo=early', 'K=3, Dir=F']) AS target),
h AS (SELECT target, name, min(seq) AS seq, min(CASE WHEN name = target THEN 0 WHEN {_ID} = target THEN 1 ELSE 2 END) AS p, max(CASE WHEN contains(name, 'Var PCA') THEN 1 ELSE 0 END) AS pca FROM runs JOIN want ON contains(name, target) GROUP BY ALL)
SELECT target, name, CAST(p AS INT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, pca DESC, name) AS k FROM h) WHERE k = 1""")
def fallback_lookup(spark, d):
    want = spark.createDataFrame([("Grid: K=1, Dir=F, Topo=None (Seed 42, Var PCA)",), ("Grid: K=2, Dir=T, Topo=early",), ("K=3, Dir=F",)], "target string")
    r = _runs(spark, d).select("name").distinct()
    p = F.when(F.col("name") == F.col("target"), 0).when(names.config_id(F.col("name")) == F.col("target"), 1).otherwise(2)
    h = r.join(F.broadcast(want), F.col("name").contains(F.col("target"))).withColumn("priority", p)
    w = Window.partitionBy("target").orderBy("priority", F.desc(F.col("name").contains("Var PCA")), "name")
    return h.withColumn("k", F.row_number().over(w)).filter("k = 1").select("target", "name", "priority")


@query(f"WITH {RUNS}, dict AS (SELECT * FROM (VALUES ('early', 'before'), ('late', 'after')) t(topo, moment)) SELECT seq, coalesce(moment, 'N/A') AS moment FROM runs LEFT JOIN dict ON topo = regexp_extract(name, 'Topo=([A-Za-z]+)', 1)")
def default_lookup(spark, d):
    words = spark.createDataFrame([("early", "before"), ("late", "after")], "topo string, moment string")
    r = _runs(spark, d).select("seq", names.parse_name(F.col("name"))["topo"].alias("topo"))
    return r.join(F.broadcast(words), "topo", "left").select("seq", F.coalesce("moment", F.lit("N/A")).alias("moment"))


@query(f"WITH {RUNS}, known AS (SELECT name FROM runs WHERE seq % 200 = 0 UNION SELECT name FROM runs WHERE seq % 330 = 1) SELECT DISTINCT name, name IN (SELECT name FROM known) AS known FROM runs")
def name_existence(spark, d):
    r = _runs(spark, d).select("seq", "name")
    known = r.filter("seq % 200 = 0").select("name").union(r.filter("seq % 330 = 1").select("name")).distinct().withColumn("known", F.lit(True))
    return r.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {RUNS}, c AS (SELECT DISTINCT {_ID} AS config FROM runs), p AS (SELECT unnest(['grid topo=late', 'grid k=2, dir=t', 'sweep early']) AS phrase) SELECT phrase, config FROM p JOIN c ON len(list_filter(string_split(phrase, ' '), lambda t: len(t) > 2 AND NOT contains(lower(config), t))) = 0")
def fuzzy_match(spark, d):
    phrases = spark.createDataFrame([("grid topo=late",), ("grid k=2, dir=t",), ("sweep early",)], "phrase string")
    c = _runs(spark, d).select(names.config_id(F.col("name")).alias("config")).distinct()
    hit = F.forall(F.split("phrase", " "), lambda t: (F.length(t) <= 2) | F.lower("config").contains(t))
    return c.join(F.broadcast(phrases), hit).select("phrase", "config")


@query(f"WITH {RUNS}, k AS (SELECT CAST(regexp_extract(name, 'Seed ([0-9]+)', 1) AS INT) AS seed, tau, round(avg(f1), 9) AS m FROM runs GROUP BY ALL), r AS (SELECT seed, tau, rank() OVER (PARTITION BY seed ORDER BY m DESC) AS place FROM k) SELECT tau, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 6) AS first_share, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS top_share, round(median(place), 6) AS median_place FROM r GROUP BY tau")
def rank_share_over_seeds(spark, d):
    k = _runs(spark, d).withColumn("seed", names.parse_name(F.col("name"))["seed"]).groupBy("seed", "tau").agg(F.round(F.avg("f1"), 9).alias("m"))
    r = k.withColumn("place", F.rank().over(Window.partitionBy("seed").orderBy(F.desc("m"))))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return r.groupBy("tau").agg(share(F.col("place") == 1).alias("first_share"), share(F.col("place") <= 10).alias("top_share"), F.round(F.median("place"), 6).alias("median_place"))


@query(f"WITH {RUNS}, s AS (SELECT tau, regexp_extract(name, 'Var ([A-Za-z]+)', 1) AS representation, f1 FROM runs), a AS (SELECT tau, representation, avg(CASE WHEN f1 > 50 THEN 1.0 ELSE 0.0 END) AS separable FROM s GROUP BY ALL), m AS (SELECT max(separable) FILTER (representation = 'Base') AS raw, max(separable) FILTER (representation = 'PCA') AS prop, tau FROM a GROUP BY tau) SELECT tau, round(raw, 6) AS raw, round(prop, 6) AS prop, CASE WHEN raw IS NULL OR prop IS NULL THEN 'PENDING' WHEN raw >= 0.5 AND prop >= 0.5 THEN 'BOTH' WHEN raw >= 0.5 THEN 'LOST' WHEN prop >= 0.5 THEN 'GAINED' ELSE 'NEITHER' END AS verdict FROM m")
def separability_verdict(spark, d):
    s = _runs(spark, d).withColumn("representation", names.parse_name(F.col("name"))["variation"])
    p = s.groupBy("tau").pivot("representation", ["Base", "PCA"]).agg(F.avg(F.when(F.col("f1") > 50, 1.0).otherwise(0.0)))
    raw, prop = F.col("Base"), F.col("PCA")
    verdict = F.when(raw.isNull() | prop.isNull(), "PENDING").when((raw >= 0.5) & (prop >= 0.5), "BOTH").when(raw >= 0.5, "LOST").when(prop >= 0.5, "GAINED").otherwise("NEITHER")
    return p.select("tau", F.round(raw, 6).alias("raw"), F.round(prop, 6).alias("prop"), verdict.alias("verdict"))


@query(f"WITH {RUNS}, s AS (SELECT tau, regexp_extract(name, 'Var ([A-Za-z]+)', 1) AS representation, name, f1, seq FROM runs WHERE tau IN (1, 42, 43, 44, 49)) SELECT tau, representation, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, count(DISTINCT name) AS names, min_by(name, seq) AS first_name FROM s GROUP BY ALL")
def representation_summary(spark, d):
    s = _runs(spark, d).filter(F.col("tau").isin(1, 42, 43, 44, 49)).withColumn("representation", names.parse_name(F.col("name"))["variation"])
    return s.groupBy("tau", "representation").agg(F.round(F.avg("f1"), 6).alias("mean"), F.round(F.median("f1"), 6).alias("median"), F.countDistinct("name").alias("names"), F.min_by("name", "seq").alias("first_name"))


@query(f"WITH {RUNS}, c AS (SELECT {_ID} AS config, f1, seq FROM runs) SELECT config, 0.0::DOUBLE AS lam, round(avg(f1), 6) AS f1 FROM c WHERE seq % 4 = 0 GROUP BY config UNION ALL SELECT config, [0.0, 0.05, 0.25, 0.5][seq % 4 + 1]::DOUBLE, round(avg(f1), 6) FROM c WHERE seq % 4 > 0 GROUP BY ALL")
def ablation_series(spark, d):
    c = _runs(spark, d).select(names.config_id(F.col("name")).alias("config"), "f1", "seq")
    base = c.filter("seq % 4 = 0").withColumn("lam", F.lit(0.0))
    rows = c.filter("seq % 4 > 0").withColumn("lam", F.element_at(F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5)]), (F.col("seq") % 4).cast("int")))
    return base.unionByName(rows).groupBy("config", "lam").agg(F.round(F.avg("f1"), 6).alias("f1"))


@query(f"WITH {NODES}, {STEP} SELECT n.tau, n.txid, s.n AS n_nodes, round(s.mean_value, 6) AS mean_value FROM nodes n JOIN step s USING (tau)")
def snapshot_broadcast(spark, d):
    s = _steps(spark, d).select("tau", F.col("n").alias("n_nodes"), F.round("mean_value", 6).alias("mean_value"))
    return g.nodes(spark, d).select("tau", "txid").join(F.broadcast(s), "tau")  # one row a step


@query("SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL) AS text, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (source IS NULL) AS source, count(*) FILTER (n_chars IS NULL) AS n_chars, count(*) AS n_rows FROM documents")
def completeness(spark, d):
    x = g.table(spark, d, "documents")
    return x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in x.columns], F.count("*").alias("n_rows"))


@query("SELECT event_id, round(greatest(value - 50, 0), 6) AS relu, round((value / 50 - 1) / (1 + exp(1 - value / 50)), 6) AS silu, round(tanh(value / 50 - 1), 6) AS tanh FROM events")
def activations(spark, d):
    x = F.col("value") / 50 - 1
    return g.table(spark, d, "events").select("event_id", F.round(F.greatest(F.col("value") - 50, F.lit(0.0)), 6).alias("relu"), F.round(x / (1 + F.exp(-x)), 6).alias("silu"), F.round(F.tanh(x), 6).alias("tanh"))


@query("WITH l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) SELECT count(*) FILTER (d.doc_id IS NULL) AS missing, count(*) AS checked FROM l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)")
def alignment_check(spark, d):
    lab = g.table(spark, d, "labels").select("doc_id").distinct()
    have = g.table(spark, d, "documents").select("doc_id").distinct().withColumn("have", F.lit(True))
    return lab.join(have, "doc_id", "left").agg(F.count_if(F.col("have").isNull()).alias("missing"), F.count("*").alias("checked"))


@query("SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id FROM events")
def leak_guard(spark, d):
    e = g.table(spark, d, "events").select(F.col("event_id").alias("txid"), F.col("ts"), "value", F.col("user_id").cast("double").alias("user_id"), F.lit(0).alias("label"))
    chosen = graph.feature_columns(e.columns)
    graph.check_features(chosen)
    return e.select(F.col("txid").alias("event_id"), *chosen)
