"""Registered queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempograph.functions import names
from tempograph.operators import evaluate, graph, stats, store, temporal
from tempograph.plans import models, walk
from tempograph.sources import graph as g
from tempograph.streaming import windows

TEST = list(range(g.VAL_END + 1, g.STEPS + 1))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODES = """nodes AS (
  SELECT event_id AS txid, CAST(date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) * 49 // 2592000000000 + 1 AS INT) AS tau,
         user_id, value, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 ELSE -1 END AS label, ts FROM events),
l AS (SELECT txid AS src, tau, lead(txid, 1) OVER w AS d1, lead(txid, 2) OVER w AS d2 FROM nodes WINDOW w AS (PARTITION BY user_id, tau ORDER BY ts, txid)),
edges AS (SELECT tau, src, d1 AS dst FROM l WHERE d1 IS NOT NULL UNION ALL SELECT tau, src, d2 FROM l WHERE d2 IS NOT NULL),
dirty AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE src % 10 = 0 UNION ALL SELECT tau, dst, src FROM edges WHERE src % 7 = 0
          UNION ALL SELECT tau, src, src FROM edges WHERE src % 13 = 0),
feats AS (SELECT tau, txid, label, [value, CAST(user_id % 10 AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE),
          (date_diff('microsecond', timestamp '2024-01-01 00:00:00', e.ts) * 49 % 2592000000000) / 49.0 / 1e6] AS f
          FROM nodes n JOIN (SELECT event_id, props, ts FROM events) e ON e.event_id = n.txid),
pred AS (SELECT tau, txid, label, floor(value / 10) / 10.0 AS score FROM nodes)"""
W = f"WITH {NODES}"
STEP = "step AS (SELECT tau, count(*) AS n, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, avg(CASE WHEN label >= 0 THEN label END) AS rate, avg(value) AS mean_value FROM nodes GROUP BY tau)"
SYM = """s0 AS (SELECT tau, src AS r, dst AS c FROM dirty UNION SELECT tau, dst, src FROM dirty UNION SELECT tau, txid, txid FROM nodes),
sd AS (SELECT tau, r, count(*) AS d FROM s0 GROUP BY tau, r),
s AS (SELECT s0.tau, s0.r, s0.c, 1 / sqrt(a.d * b.d) AS w FROM s0 JOIN sd a ON a.tau = s0.tau AND a.r = s0.r JOIN sd b ON b.tau = s0.tau AND b.r = s0.c)"""
RUNS = """runs AS (SELECT event_id AS seq, 'Grid: K=' || (event_id % 3 + 1) || ', Dir=' || CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'T' END || ', Topo=' ||
  CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'early' ELSE 'late' END || ' (Seed ' || (42 + event_id % 4) || ', Var ' || CASE WHEN event_id % 7 < 4 THEN 'Base' ELSE 'PCA' END || ')' AS name,
  value AS f1, CAST(user_id AS DOUBLE) AS prauc, CAST(event_id % 49 + 1 AS INT) AS tau FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events")
    i = F.col("event_id")
    topo = F.when(i % 5 == 0, "None").when(i % 5 == 1, "early").otherwise("late")
    name = F.format_string("Grid: K=%d, Dir=%s, Topo=%s (Seed %d, Var %s)", i % 3 + 1, F.when(i % 2 == 0, "F").otherwise("T"), topo, 42 + i % 4, F.when(i % 7 < 4, "Base").otherwise("PCA"))
    return e.select(i.alias("seq"), name.alias("name"), F.col("value").alias("f1"), F.col("user_id").cast("double").alias("prauc"), (i % 49 + 1).cast("int").alias("tau"))


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return g.nodes(spark, d).select("tau", "txid", "label", (F.floor(F.col("value") / 10) / 10.0).alias("score"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    n = g.nodes(spark, d)
    y = F.when(F.col("label") >= 0, F.col("label"))
    return n.groupBy("tau").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), F.avg(y).alias("rate"), F.avg("value").alias("mean_value"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings, as doubles: label is the group, odd ids are side 1."""
    e = g.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.withColumn("side", (F.col("vec_id") % 2).cast("int"))


POINTS = "pts AS (SELECT vec_id, CAST(label AS INT) AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v, CAST(vec_id % 2 AS INT) AS side FROM embeddings)"


@query(W + """, c AS (SELECT tau, count(*) n, count(*) FILTER (label = 1) i, count(*) FILTER (label = 0) c, count(*) FILTER (label = -1) u FROM nodes GROUP BY tau),
e AS (SELECT tau, count(*) m FROM edges GROUP BY tau), t AS (SELECT c.*, coalesce(m, 0) AS m FROM c LEFT JOIN e USING (tau))
SELECT tau, n AS n_nodes, m AS n_edges, i AS n_illicit, c AS n_licit, u AS n_unknown, i + c AS n_labeled, round(coalesce(i / nullif(i + c, 0), 0), 6) AS illicit_rate,
round(2.0 * m / n, 6) AS mean_degree, round(coalesce(2.0 * m / nullif(n * (n - 1), 0), 0), 6) AS density_undirected, round(coalesce(m / nullif(n * (n - 1), 0), 0), 6) AS density_directed,
CASE WHEN tau < 43 THEN 'pre_shock' WHEN tau = 43 THEN 'shock' ELSE 'recovery' END AS regime FROM t""")
def snapshot_topology(spark, d):
    n = g.nodes(spark, d)
    return graph.snapshot_topology(n, g.edges_of(n))


@query(W + ", bad AS (SELECT * FROM edges UNION ALL SELECT 1, -1, min(txid) FROM nodes) SELECT tau, src, dst, 'src' AS side FROM bad WHERE src NOT IN (SELECT txid FROM nodes) UNION ALL SELECT tau, src, dst, 'dst' FROM bad WHERE dst NOT IN (SELECT txid FROM nodes)")
def edge_guard_orphans(spark, d):
    n = g.nodes(spark, d)
    bad = g.edges_of(n).unionByName(n.agg(F.min("txid").alias("dst")).select(F.lit(1).alias("tau"), F.lit(-1).cast("long").alias("src"), "dst"))
    return graph.orphan_edges(bad, n)


@query(W + ", bad AS (SELECT src, dst FROM edges UNION ALL SELECT min(txid) FILTER (tau = 1), min(txid) FILTER (tau = 2) FROM nodes) SELECT src, dst, a.tau AS src_tau, b.tau AS dst_tau FROM bad JOIN nodes a ON a.txid = src JOIN nodes b ON b.txid = dst WHERE a.tau <> b.tau")
def edge_guard_cross_temporal(spark, d):
    n = g.nodes(spark, d)
    x = n.agg(F.min(F.when(F.col("tau") == 1, F.col("txid"))).alias("src"), F.min(F.when(F.col("tau") == 2, F.col("txid"))).alias("dst"))
    return graph.cross_step_edges(g.edges_of(n).unionByName(x.select(F.lit(0).alias("tau"), "src", "dst")), n)


@query(W + """, o AS (SELECT tau, src AS txid, count(*) c FROM dirty GROUP BY ALL), i AS (SELECT tau, dst AS txid, count(*) c FROM dirty GROUP BY ALL)
SELECT n.tau, n.txid, n.label, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree FROM nodes n LEFT JOIN o USING (tau, txid) LEFT JOIN i USING (tau, txid)""")
def degree_in_out(spark, d):
    n = g.nodes(spark, d)
    return graph.degrees(n, g.dirty_edges(g.edges_of(n)))


@query(W + """, j AS (SELECT e.tau, least(a.label, b.label) lo, greatest(a.label, b.label) hi FROM edges e JOIN nodes a ON a.txid = src JOIN nodes b ON b.txid = dst)
SELECT t.tau, count(*) FILTER (lo = 0 AND hi = 0) AS licit_licit, count(*) FILTER (lo = 1 AND hi = 1) AS illicit_illicit, count(*) FILTER (lo = 0 AND hi = 1) AS illicit_licit, count(*) FILTER (lo = -1 AND hi = 1) AS illicit_unknown
FROM (SELECT DISTINCT tau FROM nodes) t LEFT JOIN j USING (tau) GROUP BY t.tau""")
def homophily_by_step(spark, d):
    n = g.nodes(spark, d)
    return graph.homophily(n, g.edges_of(n))


@query(W + """ SELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS q50, round(mad(value), 6) AS mad,
round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.99), 6) AS q99,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM nodes GROUP BY label""")
def value_profile_by_label(spark, d):
    return stats.profile(g.nodes(spark, d), "label", "value")


_COLS = ("value", "user", "k", "into")


@query(W + f""", flat AS (SELECT label, unnest([{", ".join(f"'{c}'" for c in _COLS)}]) AS col, unnest(f) AS v FROM feats)
SELECT label, col, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(mad(v), 6) AS mad,
{", ".join(f"round(quantile_cont(v, {q}), 6) AS {k}" for k, q in stats.QUANTILES.items())}, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis
FROM flat WHERE v IS NOT NULL GROUP BY ALL""")
def feature_profile_by_label(spark, d):
    return stats.profiles(g.features(spark, d), "label", {c: F.col("features")[i] for i, c in enumerate(_COLS)})


@query("SELECT d.doc_id, d.lang, CASE WHEN l.quality IS NULL THEN -1 ELSE CAST(l.quality AS INT) END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_join(spark, d):
    docs, lab = g.table(spark, d, "documents").select("doc_id", "lang"), g.table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("label"))


@query(W + " SELECT e.tau, e.src, e.dst FROM edges e WHERE src IN (SELECT txid FROM nodes WHERE label <> -1) AND dst IN (SELECT txid FROM nodes WHERE label <> -1)")
def subgraph_semi_join(spark, d):
    n = g.nodes(spark, d)
    return graph.subgraph(g.edges_of(n), n.filter("label <> -1"))


@query(W + " SELECT tau, txid, CAST(row_number() OVER (PARTITION BY tau ORDER BY txid) - 1 AS INT) AS local_id FROM nodes")
def local_reindex(spark, d):
    return graph.local_ids(g.nodes(spark, d)).select("tau", "txid", "local_id")


@query(W + " SELECT CASE WHEN tau <= 26 THEN 'train' WHEN tau <= 34 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (label = 1) AS n1 FROM nodes GROUP BY 1")
def split_counts(spark, d):
    return g.nodes(spark, d).groupBy(g.split().alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"))


@query(f"WITH {NODES}, {SYM} SELECT tau, r, c, round(w, 9) AS w FROM s")
def sym_norm_operator(spark, d):
    n = g.nodes(spark, d)
    return graph.symmetric_operator(n, g.dirty_edges(g.edges_of(n))).withColumn("w", F.round("w", 9))


def _row_sql(r: str, c: str) -> str:
    return W + f", m AS (SELECT tau, {r} AS r, {c} AS c, count(*) AS m FROM dirty GROUP BY ALL) SELECT tau, r, c, round(m / sum(m) OVER (PARTITION BY tau, r), 9) AS w FROM m"


@query(_row_sql("src", "dst"))
def row_norm_out(spark, d):
    return graph.row_operator(g.dirty_edges(g.edges(spark, d))).withColumn("w", F.round("w", 9))


@query(_row_sql("dst", "src"))
def row_norm_in(spark, d):
    return graph.row_operator(g.dirty_edges(g.edges(spark, d)), reverse=True).withColumn("w", F.round("w", 9))


def _flat(x: DataFrame, width: int, digits: int = 6) -> DataFrame:
    return x.select("tau", "txid", *[F.round(F.col("features")[i], digits).alias(f"f{i}") for i in range(width)])


def _hops(k: int) -> str:
    out, cols = [], ", ".join(f"sum(w * f{i}) AS f{i}" for i in range(4))
    out.append("x0 AS (SELECT tau, txid, " + ", ".join(f"f[{i + 1}] AS f{i}" for i in range(4)) + " FROM feats)")
    out += [f"x{h} AS (SELECT s.tau, s.r AS txid, {cols} FROM s JOIN x{h - 1} x ON x.tau = s.tau AND x.txid = s.c GROUP BY ALL)" for h in range(1, k + 1)]
    return ", ".join(out)


_F4 = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(4))


def _sgc(k: int):
    def q(spark, d):
        n = g.nodes(spark, d)
        s = graph.symmetric_operator(n, g.dirty_edges(g.edges_of(n)))
        return _flat(graph.propagate(s, g.features(spark, d), k, 4), 4)

    q.__name__ = f"sgc_hop{k}"
    return query(f"WITH {NODES}, {SYM}, {_hops(k)} SELECT tau, txid, {_F4} FROM x{k}")(q)


for _k in (1, 2, 3):
    _sgc(_k)


@query(f"WITH {NODES}, {SYM}, {_hops(2)} SELECT x0.tau, x0.txid, " + ", ".join(f"round(x{h}.f{i}, 6) AS f{4 * h + i}" for h in range(3) for i in range(4)) + " FROM x0 JOIN x1 USING (tau, txid) JOIN x2 USING (tau, txid)")
def sgc_multiscale_k2(spark, d):
    n = g.nodes(spark, d)
    s = graph.symmetric_operator(n, g.dirty_edges(g.edges_of(n)))
    return _flat(graph.propagate(s, g.features(spark, d), 2, 4, multiscale=True), 12)


def _loop_sql(name: str, r: str, c: str) -> str:
    return f"""{name} AS (SELECT tau, r, c, m / sum(m) OVER (PARTITION BY tau, r) AS w FROM (SELECT tau, r, c, count(*) AS m FROM (
  SELECT tau, {r} AS r, {c} AS c FROM dirty UNION ALL SELECT tau, txid, txid FROM nodes) GROUP BY ALL))"""


def _chan(name: str, op: str, x: str) -> str:
    return f"{name} AS (SELECT s.tau, s.r AS txid, " + ", ".join(f"sum(w * f{i}) AS f{i}" for i in range(4)) + f" FROM {op} s JOIN {x} x ON x.tau = s.tau AND x.txid = s.c GROUP BY ALL)"


@query(f"WITH {NODES}, {SYM}, {_loop_sql('so', 'src', 'dst')}, {_loop_sql('si', 'dst', 'src')}, {_hops(0)}, {_chan('y1', 's', 'x0')}, {_chan('y2', 'so', 'x0')}, {_chan('y3', 'si', 'x0')} SELECT x0.tau, x0.txid, "
       + ", ".join(f"round({t}.f{i}, 4) AS f{4 * h + i}" for h, t in enumerate(("x0", "y1", "y2", "y3")) for i in range(4)) + " FROM x0 JOIN y1 USING (tau, txid) JOIN y2 USING (tau, txid) JOIN y3 USING (tau, txid)")
def sgc_directional_k1(spark, d):
    n = g.nodes(spark, d)
    return _flat(graph.propagate_directional(n, g.dirty_edges(g.edges_of(n)), g.features(spark, d), 1, 4), 16, 4)


@query(f"WITH {NODES}, {SYM}, {_hops(1)} SELECT x1.tau, x1.txid, round(x1.f0, 6) AS f0, round(x1.f1, 6) AS f1, round(x0.f2, 6) AS f2, round(x0.f3, 6) AS f3 FROM x1 JOIN x0 USING (tau, txid)")
def sgc_local_only(spark, d):
    n = g.nodes(spark, d)
    x = g.features(spark, d)
    s = graph.symmetric_operator(n, g.dirty_edges(g.edges_of(n)))
    local = graph.propagate(s, x.withColumn("features", F.slice("features", 1, 2)), 1, 2)
    rest = x.select("tau", "txid", F.slice("features", 3, 2).alias("rest"))
    return _flat(local.join(rest, ["tau", "txid"]).select("tau", "txid", F.concat("features", "rest").alias("features")), 4)


def _pr_sql(rounds: int) -> str:
    s = W + ", u AS (SELECT DISTINCT tau, src, dst FROM dirty), o AS (SELECT tau, src, count(*) AS k FROM u GROUP BY ALL), m AS (SELECT tau, count(*) AS n FROM nodes GROUP BY tau), p0 AS (SELECT tau, txid, 1.0::DOUBLE / n AS p FROM nodes JOIN m USING (tau))"
    for i in range(1, rounds + 1):
        s += f""", q{i} AS (SELECT p.tau, p.txid, p.p, o.k FROM p{i - 1} p LEFT JOIN o ON o.tau = p.tau AND o.src = p.txid),
d{i} AS (SELECT tau, coalesce(sum(p) FILTER (k IS NULL), 0) AS d FROM q{i} GROUP BY tau), i{i} AS (SELECT u.tau, u.dst AS txid, sum(q.p / q.k) AS x FROM u JOIN q{i} q ON q.tau = u.tau AND q.txid = u.src GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT q.tau, q.txid, 0.85 * (coalesce(x, 0) + d / n) + 0.15 / n AS p FROM q{i} q JOIN m ON m.tau = q.tau JOIN d{i} d ON d.tau = q.tau LEFT JOIN i{i} i ON i.tau = q.tau AND i.txid = q.txid)"""
    return s + f" SELECT tau, txid, round(p, 9) AS pagerank FROM p{rounds}"


@query(_pr_sql(20))
def pagerank_fixed20(spark, d):
    n = g.nodes(spark, d)
    return graph.pagerank(n, g.dirty_edges(g.edges_of(n)), iterations=20, tol=None).withColumn("pagerank", F.round("pagerank", 9))


@query()
def pagerank_converged(spark, d):
    n = g.nodes(spark, d)
    return graph.pagerank(n, g.edges_of(n))


@query(W + """, u AS (SELECT DISTINCT tau, least(src, dst) AS a, greatest(src, dst) AS b FROM dirty WHERE src <> dst), t AS (SELECT x.tau, x.a, x.b, y.b AS c FROM u x JOIN u y ON y.tau = x.tau AND y.a = x.b JOIN u z ON z.tau = x.tau AND z.a = x.a AND z.b = y.b),
k AS (SELECT tau, unnest([a, b, c]) AS txid FROM t), kc AS (SELECT tau, txid, count(*) AS t FROM k GROUP BY ALL), g AS (SELECT tau, unnest([a, b]) AS txid FROM u), gc AS (SELECT tau, txid, count(*) AS d FROM g GROUP BY ALL)
SELECT n.tau, n.txid, round(coalesce(2.0 * coalesce(t, 0) / nullif(d * (d - 1), 0), 0), 9) AS clustering FROM nodes n LEFT JOIN gc USING (tau, txid) LEFT JOIN kc USING (tau, txid)""")
def clustering_coeff(spark, d):
    n = g.nodes(spark, d)
    return graph.clustering(n, g.dirty_edges(g.edges_of(n))).withColumn("clustering", F.round("clustering", 9))


@query(W + ", m AS (SELECT " + ", ".join(f"avg(f[{i}]) AS m{i}, stddev_pop(f[{i}]) AS s{i}" for i in range(1, 5)) + " FROM feats WHERE tau <= 26) SELECT tau, txid, " + ", ".join(f"round((f[{i}] - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END, 6) AS f{i - 1}" for i in range(1, 5)) + " FROM feats, m")
def zscore_train_fit(spark, d):
    return _flat(stats.zscore(g.features(spark, d), 4, F.col("tau") <= g.TRAIN_END), 4)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0.0::DOUBLE ELSE value END AS v FROM events")
def nan_inf_clean(spark, d):
    e = g.table(spark, d, "events")
    dirty = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return e.select("event_id", stats.clean(dirty).alias("v"))


@query(W + ", x AS (SELECT label, i - 1 AS pos, f[i] AS x FROM feats, (SELECT unnest([1, 2, 3, 4]) AS i)), r AS (SELECT CAST(pos AS INT) AS pos, round(coalesce(corr(x, label), 0), 6) AS r FROM x GROUP BY pos) SELECT pos, r FROM r ORDER BY abs(r) DESC, pos LIMIT 3")
def pearson_topk(spark, d):
    return stats.correlations(g.features(spark, d), 4, "label", 3)


@query(f"WITH {NODES}, {STEP} SELECT tau, CAST(coalesce(sum(n1) OVER w, 0) AS BIGINT) AS n1, CAST(coalesce(sum(n0) OVER w, 0) AS BIGINT) AS n0 FROM step WHERE tau NOT IN (3, 4) WINDOW w AS (ORDER BY tau RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)")
def expanding_window_stats(spark, d):
    return temporal.window_sums(_steps(spark, d).filter("tau not in (3, 4)"), ["n1", "n0"], None, -2)


@query(f"WITH {NODES}, {STEP} SELECT tau, CAST(coalesce(sum(n1) OVER w, 0) AS BIGINT) AS n1, CAST(coalesce(sum(n0) OVER w, 0) AS BIGINT) AS n0 FROM step WINDOW w AS (ORDER BY tau RANGE BETWEEN 5 PRECEDING AND 2 PRECEDING)")
def sliding_window_stats(spark, d):
    return temporal.window_sums(_steps(spark, d), ["n1", "n0"], -5, -2)


_LAG = f"""WITH {NODES}, {STEP}, st AS (SELECT * FROM step WHERE tau NOT IN (3, 4)), m AS (SELECT avg(n) AS mn, avg(rate) AS mr FROM st WHERE tau <= 26),
j AS (SELECT t.tau, lag, coalesce(CAST(s.n AS DOUBLE), mn) AS n, coalesce(s.rate, mr) AS r, CASE WHEN s.tau IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p FROM (SELECT tau FROM st) t CROSS JOIN (SELECT unnest([3, 2, 1]) AS lag) CROSS JOIN m LEFT JOIN st s ON s.tau = t.tau - lag),
k AS (SELECT tau, {', '.join(f'max(n) FILTER (lag = {i}) AS n{i}, max(r) FILTER (lag = {i}) AS r{i}, max(p) FILTER (lag = {i}) AS p{i}' for i in (3, 2, 1))} FROM j GROUP BY tau)
SELECT tau, round(n3, 6) AS f0, round(r3, 6) AS f1, p3 AS f2, round(n2, 6) AS f3, round(r2, 6) AS f4, p2 AS f5, round(n1, 6) AS f6, round(r1, 6) AS f7, p1 AS f8,
round(CASE WHEN p2 * p3 > 0 THEN n2 - n3 ELSE 0 END, 6) AS f9, round(CASE WHEN p2 * p3 > 0 THEN r2 - r3 ELSE 0 END, 6) AS f10, round(CASE WHEN p1 * p2 > 0 THEN n1 - n2 ELSE 0 END, 6) AS f11, round(CASE WHEN p1 * p2 > 0 THEN r1 - r2 ELSE 0 END, 6) AS f12 FROM k"""


@query(_LAG)
def lag_features_w3(spark, d):
    x = temporal.lag_features(_steps(spark, d).filter("tau not in (3, 4)"), ["n", "rate"], 3, g.TRAIN_END)
    return x.select("tau", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(13)])


@query(f"WITH {NODES}, {STEP}, m AS (SELECT avg(rate) AS m FROM step WHERE tau <= 26) SELECT a.tau, round(coalesce(b.rate, m), 6) AS lagged_rate FROM step a CROSS JOIN m LEFT JOIN step b ON b.tau = a.tau - 2")
def label_lag_rate(spark, d):
    return temporal.label_lag_rate(_steps(spark, d), "rate", 2, g.TRAIN_END).withColumn("lagged_rate", F.round("lagged_rate", 6))


@query(f"WITH RECURSIVE {NODES}, {STEP}, r AS (SELECT tau, mean_value AS h FROM step WHERE tau = 1 UNION ALL SELECT s.tau, 0.3 * s.mean_value + 0.7 * r.h FROM r JOIN step s ON s.tau = r.tau + 1) SELECT tau, round(h, 6) AS h FROM r")
def ema_snapshot(spark, d):
    return temporal.ema(_steps(spark, d), "mean_value").withColumn("h", F.round("h", 6))


@query(f"WITH {NODES}, {STEP} SELECT tau, lag(n1, 1, 0) OVER (ORDER BY tau) AS shifted FROM step")
def causal_shift(spark, d):
    return temporal.causal_shift(_steps(spark, d), "n1")


@query(W + ", c AS (SELECT max(tau) AS t, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM nodes WHERE label <> -1), r AS (SELECT tau, txid, label, exp(-0.25 * (t - tau)) * (n0 + n1) / (2.0 * CASE WHEN label = 1 THEN n1 ELSE n0 END) AS w FROM nodes, c WHERE label <> -1) SELECT tau, txid, label, round(w / avg(w) OVER (), 6) AS weight FROM r")
def decay_weights(spark, d):
    return temporal.decay_weights(g.nodes(spark, d)).withColumn("weight", F.round("weight", 6))


_CONF = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) AS n"


@query(W + f", c AS (SELECT tau, {_CONF} FROM pred WHERE label <> -1 GROUP BY tau) SELECT tau, n, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def confusion_by_step(spark, d):
    c = evaluate.confusion(_pred(spark, d), ["tau"])
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


_CURVE = "g AS (SELECT tau, score, count(*) FILTER (label = 1) AS tp, count(*) AS n FROM pred WHERE label <> -1 GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY tau) AS pos, sum(n) OVER (PARTITION BY tau) AS rows FROM g WINDOW w AS (PARTITION BY tau ORDER BY score DESC))"
_AP = "ap AS (SELECT tau, CASE WHEN max(pos) < max(rows) THEN sum(tp * ct / cn) / nullif(max(pos), 0) END AS ap FROM c GROUP BY tau)"


@query(W + f", {_CURVE}, {_AP} SELECT tau, round(ap, 6) AS ap FROM ap")
def average_precision_by_step(spark, d):
    return evaluate.average_precision(_pred(spark, d), ["tau"]).withColumn("ap", F.round("ap", 6))


_BEST = "b AS (SELECT tau, score, pos, round(coalesce(2 * (ct / cn) * (ct / nullif(pos, 0)) / (ct / cn + ct / nullif(pos, 0) + 1e-8), 0), 9) AS f1 FROM c), bt AS (SELECT tau, CASE WHEN f1 > 0 THEN score ELSE 0.5 END AS threshold, f1, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY f1 DESC, score) AS k FROM b) WHERE k = 1)"


@query(W + f", {_CURVE}, {_BEST} SELECT tau, threshold, round(f1, 6) AS f1, pos FROM bt")
def best_f1_threshold(spark, d):
    return evaluate.best_f1_threshold(_pred(spark, d), ["tau"]).withColumn("f1", F.round("f1", 6))


@query(W + f", {_CURVE}, {_BEST}, y AS (SELECT tau, score, row_number() OVER (PARTITION BY tau ORDER BY score) - 1 AS i, (count(*) OVER t - 1) * (1 - avg(label) OVER t) AS pt FROM pred WHERE label <> -1 WINDOW t AS (PARTITION BY tau)), q AS (SELECT tau, max(score) FILTER (i = floor(pt)) AS a, max(score) FILTER (i = ceil(pt)) AS b, max(pt) AS pt FROM y GROUP BY tau) SELECT tau, round(CASE WHEN pos < 40 THEN a + (pt - floor(pt)) * (b - a) ELSE threshold END, 6) AS threshold, pos < 40 AS fallback FROM bt JOIN q USING (tau)")
def calibrated_threshold(spark, d):
    return evaluate.calibrated_threshold(_pred(spark, d), ["tau"], epsilon=40).withColumn("threshold", F.round("threshold", 6))


@query(W + ", p AS (SELECT *, CASE WHEN tau < 43 THEN 'pre_shock' WHEN tau = 43 THEN 'shock' ELSE 'recovery' END AS regime FROM pred WHERE label <> -1), c AS (SELECT coalesce(regime, 'all') AS regime, " + _CONF + " FROM p GROUP BY ROLLUP (regime)) SELECT regime, n, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def regime_metrics_rollup(spark, d):
    return evaluate.regime_rollup(_pred(spark, d)).withColumn("f1", F.round("f1", 6))


@query(W + f", {_CURVE}, {_AP}, k AS (SELECT tau, {_CONF} FROM pred WHERE label <> -1 GROUP BY tau), s AS (SELECT tau, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM k), z AS (SELECT {_CONF} FROM pred WHERE label <> -1) SELECT round(avg(s.f1), 5) AS macro_f1, round(avg(round(ap, 4)), 5) AS macro_ap, round((SELECT 2.0 * tp / (2 * tp + fp + fn) FROM z), 6) AS pooled_f1 FROM s JOIN ap USING (tau)")
def macro_vs_pooled(spark, d):
    return evaluate.macro_pooled(_pred(spark, d)).select(F.round("macro_f1", 5).alias("macro_f1"), F.round("macro_ap", 5).alias("macro_ap"), F.round("pooled_f1", 6).alias("pooled_f1"))


@query(W + ", y AS (SELECT tau, label, row_number() OVER (PARTITION BY tau ORDER BY score DESC, txid) AS r, sum(label) OVER (PARTITION BY tau) AS k FROM pred WHERE label <> -1) SELECT tau, CAST(max(k) AS BIGINT) AS k, round(coalesce(count(*) FILTER (r <= k AND label = 1) / nullif(max(k), 0), 0), 6) AS precision_at_k FROM y GROUP BY tau")
def precision_at_k(spark, d):
    return evaluate.precision_at_k(_pred(spark, d), ["tau"]).withColumn("precision_at_k", F.round("precision_at_k", 6))


@query(W + " SELECT a.tau, a.txid, round(0.7 * a.score + 0.3 * n.value / 100.0, 6) AS score FROM pred a JOIN nodes n USING (tau, txid)")
def ensemble_blend(spark, d):
    b = g.nodes(spark, d).select("tau", "txid", (F.col("value") / 100.0).alias("b"))
    return _pred(spark, d).join(b, ["tau", "txid"]).select("tau", "txid", F.round(0.7 * F.col("score") + 0.3 * F.col("b"), 6).alias("score"))


_ID = r"trim(regexp_replace(name, '\s*\((?:Seed\s+\d+,\s*)?Var\s+[^)]+\)', '', 'g'))"


@query(f"WITH {RUNS} SELECT {_ID} AS config, count(*) AS n, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std FROM runs GROUP BY 1")
def results_seed_agg(spark, d):
    return store.seed_summary(_runs(spark, d).withColumn("config", names.config_id(F.col("name"))), ["config"], "f1")


@query(f"WITH {RUNS} SELECT {_ID} AS config, round(avg(f1) FILTER (tau < 43), 6) AS pre_shock, round(avg(f1) FILTER (tau = 43), 6) AS shock, round(avg(f1) FILTER (tau > 43), 6) AS recovery, round(avg(f1), 6) AS overall FROM runs GROUP BY 1")
def phase_pivot(spark, d):
    r = _runs(spark, d).select(names.config_id(F.col("name")).alias("config"), g.regime().alias("regime"), "f1")
    p = r.groupBy("config").pivot("regime", ["pre_shock", "shock", "recovery"]).agg(F.round(F.avg("f1"), 6))
    return p.join(r.groupBy("config").agg(F.round(F.avg("f1"), 6).alias("overall")), "config")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1")
def dedup_keep_last(spark, d):
    x = store.keep_last(g.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("WITH o AS (SELECT o_orderkey AS test_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PENDING' ELSE 'PASS' END AS verdict FROM orders) SELECT test_id, CASE WHEN test_id % 3 = 0 THEN 'PASS' ELSE verdict END AS verdict FROM o")
def audit_upsert(spark, d):
    o = g.table(spark, d, "orders")
    log = o.select(F.col("o_orderkey").alias("test_id"), F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PASS").alias("verdict"))
    return store.upsert_verdicts(log, log.filter("test_id % 3 = 0").withColumn("verdict", F.lit("PASS")))


@query(f"WITH {RUNS} SELECT seq, name FROM runs WHERE name NOT IN (SELECT name FROM runs WHERE seq % 110 = 0)")
def resume_anti_join(spark, d):
    r = _runs(spark, d)
    return store.remaining(r.select("seq", "name"), r.filter("seq % 110 = 0").select("name"), ["name"])


@query(f"WITH {RUNS}, m AS (SELECT {_ID} AS config, round(avg(f1), 9) AS a, round(avg(prauc), 9) AS b FROM runs GROUP BY 1), r AS (SELECT config, row_number() OVER (ORDER BY a DESC, config) AS k, row_number() OVER (ORDER BY b DESC, config) AS j FROM m), u AS (SELECT config, k FROM r WHERE k <= 3 UNION ALL SELECT config, j + 3 FROM r WHERE j <= 3) SELECT config, CAST(min(k) AS INT) AS place FROM u GROUP BY config")
def champion_topn_union(spark, d):
    return store.champions(_runs(spark, d).withColumn("config", names.config_id(F.col("name"))), ["config"], ["f1", "prauc"], 3)


@query("SELECT k, dir, topo, injection, seed, variation FROM (SELECT unnest([1, 2, 3])::BIGINT AS k), (SELECT unnest(['F', 'T']) AS dir), (SELECT unnest([false, true]) AS topo), (SELECT unnest(['early', 'late']) AS injection), (SELECT unnest([42, 43, 44])::BIGINT AS seed), (SELECT unnest(['Base', 'PCA']) AS variation) WHERE NOT (injection = 'early' AND NOT topo)")
def config_grid(spark, d):
    return store.config_grid(spark)


@query(f"WITH {RUNS} SELECT seq, 'Grid' AS family_tag, CAST(regexp_extract(name, 'K=([0-9]+)', 1) AS INT) AS k, regexp_extract(name, 'Dir=([TF])', 1) = 'T' AS dir, regexp_extract(name, 'Topo=(None|early|late)', 1) AS topo, CAST(regexp_extract(name, 'Seed ([0-9]+)', 1) AS INT) AS seed, regexp_extract(name, 'Var ([A-Za-z]+)', 1) AS variation FROM runs")
def parse_names(spark, d):
    p = _runs(spark, d).select("seq", names.parse_name(F.col("name")).alias("p"))
    return p.select("seq", *[f"p.{f}" for f in ("family_tag", "k", "dir", "topo", "seed", "variation")])


@query(f"WITH {RUNS} SELECT seq, name FROM runs WHERE seq % 3 = 1 AND seq % 2 = 1 AND seq % 5 = 1")
def dynamic_select(spark, d):
    r = names.with_parsed(_runs(spark, d), "name")
    return r.filter(names.matches(family_tag="Grid", k=2, dir=True, topo="early", decay=False)).select("seq", "name")


@query(f"WITH {RUNS} SELECT seq, CASE WHEN seq % 4 = 0 THEN 9 ELSE CAST(seq % 3 + 1 AS INT) END AS k FROM runs")
def column_override(spark, d):
    r = _runs(spark, d).withColumn("hops", F.when(F.col("seq") % 4 == 0, "9").otherwise("N/A"))
    return names.with_parsed(r, "name", {"k": "hops"}).select("seq", F.col("_k").alias("k"))


@query(f"WITH {RUNS}, m AS (SELECT {_ID} AS config, max(f1) AS best FROM runs GROUP BY 1) SELECT config, round(best, 6) AS best, round(best - (SELECT best FROM m WHERE config = 'Grid: K=1, Dir=F, Topo=None'), 6) AS delta FROM m")
def max_by_delta(spark, d):
    m = _runs(spark, d).groupBy(names.config_id(F.col("name")).alias("config")).agg(F.max("f1").alias("best"))
    base = m.filter(F.col("config") == "Grid: K=1, Dir=F, Topo=None").select(F.col("best").alias("b"))
    return m.join(F.broadcast(base)).select("config", F.round("best", 6).alias("best"), F.round(F.col("best") - F.col("b"), 6).alias("delta"))


_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"WITH {POINTS} SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(exp(-0.01 * {_D2}), 6) AS k FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id < b.vec_id")
def pairwise_rbf(spark, d):
    e = g.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))  # half as wide as doubles
    return stats.pairs_within(e, "label").select("label", "a", "b", F.round(F.exp(-0.01 * F.col("d2")), 6).alias("k"))


@query(f"WITH {POINTS} SELECT a.label, round(median(sqrt({_D2})), 6) AS sigma FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def median_heuristic(spark, d):
    return stats.median_distance(_points(spark, d), "label").withColumn("sigma", F.round("sigma", 6))


@query(f"WITH {POINTS}, k AS (SELECT a.label, a.side AS s, b.side AS t, exp(-0.01 * {_D2}) AS k FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT label, round(avg(k) FILTER (s = 0 AND t = 0) + avg(k) FILTER (s = 1 AND t = 1) - 2 * avg(k) FILTER (s = 0 AND t = 1), 6) AS mmd2 FROM k GROUP BY label")
def mmd_unbiased_pairs(spark, d):
    return stats.mmd2(_points(spark, d), "label", 0.01).withColumn("mmd2", F.round("mmd2", 6))


@query()
def permutation_p(spark, d):
    return stats.permutation_test(_points(spark, d), "label", 0.01)


@query(f"WITH {NODES}, {STEP}, m AS (SELECT median(mean_value) AS m, mad(mean_value) AS d FROM step) SELECT tau, round((mean_value - m) / (1.4826 * d), 6) AS z, CAST(rank() OVER (ORDER BY mean_value DESC) AS INT) AS place FROM step, m")
def robust_z_rank(spark, d):
    z = stats.robust_z(_steps(spark, d).select("tau", "mean_value"), "mean_value")
    return z.select("tau", F.round("z", 6).alias("z"), F.rank().over(Window.orderBy(F.desc("mean_value"))).alias("place"))


@query(f"""WITH {POINTS}, p AS (SELECT a.label, a.vec_id AS id, sqrt({_D2}) AS r FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id), t AS (SELECT label, id, r, row_number() OVER (PARTITION BY label, id ORDER BY r) AS k FROM p),
m AS (SELECT label, id, ln(max(r) / min(r)) AS x FROM t WHERE k <= 2 GROUP BY ALL HAVING min(r) > 0), i AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY x, id) AS i, count(*) OVER (PARTITION BY label) AS n FROM m), y AS (SELECT label, x, -ln(1 - i / n + 1e-10) AS y FROM i WHERE i <= floor(n * 0.9)) SELECT label, round(sum(x * y) / sum(x * x), 5) AS dimension FROM y GROUP BY label""")
def twonn_dim(spark, d):
    return stats.two_nn(_points(spark, d), "label").withColumn("dimension", F.round("dimension", 5))


@query(f"""WITH {POINTS}, n AS (SELECT label, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM pts GROUP BY label),
e AS (SELECT label, v[1] AS x, sum(CASE WHEN side = 0 THEN 1.0::DOUBLE / a ELSE -1.0::DOUBLE / b END) AS w FROM pts JOIN n USING (label) GROUP BY label, v[1]),
c AS (SELECT label, x, sum(w) OVER k AS f, lead(x) OVER k AS next FROM e WINDOW k AS (PARTITION BY label ORDER BY x)) SELECT label, round(coalesce(sum(abs(f) * (next - x)), 0), 6) AS wasserstein FROM c GROUP BY label""")
def wasserstein_1d(spark, d):
    return stats.wasserstein_1d(_points(spark, d).withColumn("x", F.col("v")[0]), "label", "x").withColumn("wasserstein", F.round("wasserstein", 6))


@query()
def wasserstein_matching(spark, d):
    return stats.wasserstein_nd(_points(spark, d), "label")


@query()
def pca_k_variance(spark, d):
    x = stats.zscore(g.features(spark, d), 4, F.col("tau") <= g.VAL_END)
    mean, comp, _ = stats.pca_fit(x.filter(F.col("tau") <= g.VAL_END), 4, 0.98)
    return _flat(stats.pca_project(x, mean, comp), len(comp))


@query(W + " SELECT tau, count(*) FILTER (label = 1) AS n1 FROM nodes GROUP BY tau HAVING count(*) FILTER (label = 1) >= 24 AND count(*) FILTER (label = 0) >= 3")
def min_support_filter(spark, d):
    return _steps(spark, d).filter("n1 >= 24 and n0 >= 3").select("tau", "n1")


@query(W + " SELECT tau, txid, label FROM (SELECT *, row_number() OVER (PARTITION BY tau, label ORDER BY txid) AS k FROM nodes WHERE label >= 0) JOIN (SELECT tau, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m FROM nodes GROUP BY tau) USING (tau) WHERE k <= m")
def size_matched_sample(spark, d):
    n = g.nodes(spark, d).filter("label >= 0")
    w = Window.partitionBy("tau", "label").orderBy("txid")
    m = n.groupBy("tau").agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("m"))
    return n.withColumn("k", F.row_number().over(w)).join(m, "tau").filter("k <= m").select("tau", "txid", "label")


@query(W + ", a AS (SELECT tau, f, exp(f[1] / 100 - max(f[1] / 100) OVER (PARTITION BY tau)) AS a FROM feats) SELECT tau, " + ", ".join(f"round(sum(a * f[{i}]) / sum(a), 5) AS f{i - 1}" for i in range(1, 5)) + " FROM a GROUP BY tau")
def softmax_pool(spark, d):
    x = g.features(spark, d).withColumn("s", F.col("features")[0] / 100)
    return graph.attention_pool(x, "s", 4).select("tau", *[F.round(F.col("pooled")[i], 5).alias(f"f{i}") for i in range(4)])


@query(W + ", s AS (SELECT tau, count(*) AS n, " + ", ".join(f"sum(f[{i}]) AS s{i - 1}, sum(f[{i}] * f[{i}]) AS q{i - 1}" for i in (1, 2)) + " FROM feats GROUP BY tau) SELECT tau, CAST(sum(n) OVER w AS BIGINT) AS n, " + ", ".join(f"round(sum({c}) OVER w, 4) AS {c}" for c in ("s0", "q0", "s1", "q1")) + " FROM s WINDOW w AS (ORDER BY tau)")
def incremental_pca_moments(spark, d):
    return stats.incremental_moments(g.features(spark, d), 2)


@query()
def lr_static(spark, d):
    return walk.static(g.features(spark, d), 4, g.TRAIN_END, TEST)


@query()
def rf_static(spark, d):
    return models.static_scores(g.features(spark, d), "rf", 4)


@query()
def gbt_static(spark, d):
    return walk.static(g.features(spark, d), 4, g.TRAIN_END, TEST, "gbt", trees=60, depth=6)


@query()
def lr_walk_forward_decay(spark, d):
    return walk.decide(walk.run(g.features(spark, d), 4, TEST))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return windows.tumbling(g.table(spark, d, "events"))


@query("SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding_windows(spark, d):
    return windows.sliding(g.table(spark, d, "events"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), c AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM c GROUP BY user_id, s")
def session_windows(spark, d):
    return windows.sessions(g.table(spark, d, "events"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return g.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
