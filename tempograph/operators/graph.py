"""Guards, topology, normalisation, propagation, PageRank and clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.operators.running import release, settle
from tempograph.sources.graph import regime


class IntegrityError(ValueError):
    """The edge table breaks an invariant."""


def orphan_edges(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node, once for each such endpoint."""
    ids = n.select("txid")
    src = e.join(ids, e["src"] == ids["txid"], "left_anti").withColumn("side", F.lit("src"))
    dst = e.join(ids, e["dst"] == ids["txid"], "left_anti").withColumn("side", F.lit("dst"))
    return src.unionByName(dst)


def cross_step_edges(e: DataFrame, n: DataFrame) -> DataFrame:
    a = n.select(F.col("txid").alias("src"), F.col("tau").alias("src_tau"))
    b = n.select(F.col("txid").alias("dst"), F.col("tau").alias("dst_tau"))
    return e.select("src", "dst").join(a, "src").join(b, "dst").filter("src_tau <> dst_tau")


def check_edges(e: DataFrame, n: DataFrame) -> None:
    if orphan_edges(e, n).limit(1).count():
        raise IntegrityError("orphan edge")
    if cross_step_edges(e, n).limit(1).count():
        raise IntegrityError("edge across temporal steps")


def subgraph(e: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both endpoints in ``keep`` (tau, txid)."""
    k = keep.select("tau", "txid")
    out = e.join(k.withColumnRenamed("txid", "src"), ["tau", "src"], "left_semi")
    return out.join(k.withColumnRenamed("txid", "dst"), ["tau", "dst"], "left_semi").select("tau", "src", "dst")


def local_ids(n: DataFrame) -> DataFrame:
    """0-based ids in each step, by id."""
    return n.withColumn("local_id", F.row_number().over(Window.partitionBy("tau").orderBy("txid")) - 1)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def snapshot_topology(n: DataFrame, e: DataFrame) -> DataFrame:
    """One row a step: counts, illicit rate, mean degree, density and regime."""
    c = n.groupBy("tau").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("label") == 1).alias("n_illicit"),
        F.count_if(F.col("label") == 0).alias("n_licit"), F.count_if(F.col("label") == -1).alias("n_unknown"),
    )
    d = e.groupBy("tau").agg(F.count("*").alias("n_edges"))
    t = c.join(d, "tau", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    nn, ne = F.col("n_nodes"), F.col("n_edges")
    return t.select(
        "tau", "n_nodes", "n_edges", "n_illicit", "n_licit", "n_unknown", (F.col("n_illicit") + F.col("n_licit")).alias("n_labeled"),
        F.round(ratio(F.col("n_illicit"), F.col("n_illicit") + F.col("n_licit")), 6).alias("illicit_rate"),
        F.round(ratio(2 * ne, nn), 6).alias("mean_degree"), F.round(ratio(2 * ne, nn * (nn - 1)), 6).alias("density_undirected"),
        F.round(ratio(ne, nn * (nn - 1)), 6).alias("density_directed"), regime().alias("regime"),
    )


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """In- and out-degree with multiplicity, 0 for isolated nodes; one exchange of both edge ends."""
    ends = e.select("tau", F.col("src").alias("txid"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("tau", F.col("dst").alias("txid"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy("tau", "txid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = n.select("tau", "txid", "label").join(d, ["tau", "txid"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})


def homophily(n: DataFrame, e: DataFrame) -> DataFrame:
    """Edge counts by the labels of the ends; steps without edges count 0."""
    lab = n.select("tau", "txid", "label")
    j = e.join(lab.select("tau", F.col("txid").alias("src"), F.col("label").alias("a")), ["tau", "src"]).join(lab.select("tau", F.col("txid").alias("dst"), F.col("label").alias("b")), ["tau", "dst"])
    low, high = F.least("a", "b"), F.greatest("a", "b")
    c = j.groupBy("tau").agg(
        F.count_if((low == 0) & (high == 0)).alias("licit_licit"), F.count_if((low == 1) & (high == 1)).alias("illicit_illicit"),
        F.count_if((low == 0) & (high == 1)).alias("illicit_licit"), F.count_if((low == -1) & (high == 1)).alias("illicit_unknown"),
    )
    cols = ("licit_licit", "illicit_illicit", "illicit_licit", "illicit_unknown")
    return n.select("tau").distinct().join(c, "tau", "left").select("tau", *[F.coalesce(x, F.lit(0)).alias(x) for x in cols])


def symmetric_operator(n: DataFrame, e: DataFrame) -> DataFrame:
    """(tau, r, c, w): D^-1/2 (max(A, A') + I) D^-1/2; duplicates, reciprocal edges and loops have weight 1."""
    a = e.select("tau", F.col("src").alias("r"), F.col("dst").alias("c"))
    a = a.union(e.select("tau", F.col("dst"), F.col("src"))).union(n.select("tau", "txid", "txid")).distinct()
    d = a.groupBy("tau", "r").agg(F.count("*").alias("d"))
    a = a.join(d, ["tau", "r"]).join(d.select("tau", F.col("r").alias("c"), F.col("d").alias("dc")), ["tau", "c"])
    return a.select("tau", "r", "c", (1 / F.sqrt(F.col("d") * F.col("dc").cast("double"))).alias("w"))


def summed_operator(n: DataFrame, e: DataFrame) -> DataFrame:
    """(tau, r, c, w): D^-1/2 (max(A, A') + I) D^-1/2 where repeated edges add up and a node's own loop comes on top of I."""
    m = e.groupBy("tau", F.col("src").alias("r"), F.col("dst").alias("c")).agg(F.count("*").alias("m"))
    m = m.unionAll(m.select("tau", F.col("c").alias("r"), F.col("r").alias("c"), "m")).groupBy("tau", "r", "c").agg(F.max("m").alias("m"))
    a = m.unionAll(n.select("tau", "txid", "txid", F.lit(1).cast("long"))).groupBy("tau", "r", "c").agg(F.sum("m").alias("m"))
    d = a.groupBy("tau", "r").agg(F.sum("m").alias("d"))
    a = a.join(d, ["tau", "r"]).join(d.select("tau", F.col("r").alias("c"), F.col("d").alias("dc")), ["tau", "c"])
    return a.select("tau", "r", "c", (F.col("m") / F.sqrt(F.col("d") * F.col("dc").cast("double"))).alias("w"))


def row_operator(e: DataFrame, reverse: bool = False, loops: DataFrame | None = None) -> DataFrame:
    """(tau, r, c, w): D^-1 A with duplicates summed; ``reverse`` follows edges backwards."""
    r, c = ("dst", "src") if reverse else ("src", "dst")
    a = e.select("tau", F.col(r).alias("r"), F.col(c).alias("c"))
    if loops is not None:
        a = a.union(loops.select("tau", "txid", "txid"))
    m = a.groupBy("tau", "r", "c").agg(F.count("*").alias("m"))
    return m.select("tau", "r", "c", (F.col("m") / F.sum("m").over(Window.partitionBy("tau", "r"))).alias("w"))


def hop(s: DataFrame, x: DataFrame, width: int, col: str = "features") -> DataFrame:
    """S X as join and aggregate; rows of X are arrays of ``width``."""
    y = x.select("tau", F.col("txid").alias("c"), col)
    j = s.join(y, ["tau", "c"])
    sums = j.groupBy("tau", F.col("r").alias("txid")).agg(F.array(*[F.sum(F.col("w") * F.col(col)[i]) for i in range(width)]).alias(col))
    return sums


def propagate(s: DataFrame, x: DataFrame, k: int, width: int, multiscale: bool = False) -> DataFrame:
    """S^k X, or [X | SX | ... | S^k X]; k = 0 is X."""
    now = x.select("tau", "txid", "features")
    parts = [now]
    for _ in range(k):
        now = hop(s, now, width)
        parts.append(now)
    if not multiscale:
        return parts[-1]
    out = parts[0].withColumnRenamed("features", "f0")
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("features", f"f{i}"), ["tau", "txid"])
    return out.select("tau", "txid", F.concat(*[f"f{i}" for i in range(k + 1)]).alias("features"))


def directional_operators(n: DataFrame, e: DataFrame) -> DataFrame:
    """(tau, r, c, s, o, i): weights of ``symmetric_operator`` and of ``row_operator`` with loops along edges and against them, in one table; null where one has no entry.

    The symmetric one has every entry that either of the others has.
    """
    one, none = F.lit(1), F.lit(0)
    a = e.select("tau", F.col("src").alias("r"), F.col("dst").alias("c"), one.alias("o"), none.alias("i"))
    a = a.union(e.select("tau", "dst", "src", none, one)).union(n.select("tau", "txid", "txid", one, one))
    a = a.groupBy("tau", "r", "c").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    d = a.groupBy("tau", "r").agg(F.count("*").alias("d"), F.sum("o").alias("do"), F.sum("i").alias("di"))
    a = a.join(d, ["tau", "r"]).join(d.select("tau", F.col("r").alias("c"), F.col("d").alias("dc")), ["tau", "c"])
    row = [F.when(F.col(k) > 0, F.col(k) / F.col(f"d{k}")).alias(k) for k in ("o", "i")]
    return a.select("tau", "r", "c", (1 / F.sqrt(F.col("d") * F.col("dc").cast("double"))).alias("s"), *row)


def propagate_directional(n: DataFrame, e: DataFrame, x: DataFrame, k: int, width: int) -> DataFrame:
    """[X, then for each hop: symmetric, out, in], each channel propagated by its own operator; one join and one aggregate a hop for all channels."""
    ops, names = directional_operators(n, e), [f"f{i}" for i in range(3 * width)]
    out = x.select("tau", "txid", F.col("features").alias("f"))
    now = x.select("tau", F.col("txid").alias("c"), *[F.col("features")[i % width].alias(f) for i, f in enumerate(names)])
    for _ in range(k):
        sums = [F.sum(F.col(w) * F.col(names[i])).alias(names[i]) for i, w in enumerate(w for w in "soi" for _ in range(width))]
        now = ops.join(now, ["tau", "c"]).groupBy("tau", F.col("r").alias("c")).agg(*sums)
        out = out.join(now.withColumnRenamed("c", "txid"), ["tau", "txid"]).select("tau", "txid", F.concat("f", F.array(*names)).alias("f"))
    return out.withColumnRenamed("f", "features")


#: Edges out of a node that meet its rank in one place at most; what a node has beyond goes to further places.
FAN = 65_536

def _links(n: DataFrame, e: DataFrame, alpha: float, fan: int) -> DataFrame:
    """(tau, src, piece, dst, share, own, pieces): distinct edges and what part of its rank a node sends along each, and a link of each node to itself (``own``) that sends none.

    ``pieces`` says over how many pieces ``dst`` spreads its own links.
    """
    u = e.select("tau", "src", "dst").distinct()
    out = u.groupBy("tau", "src").agg(F.count("*").alias("k")).select("tau", "src", "k", F.ceil(F.col("k") / fan).cast("int").alias("pieces"))
    sent = u.join(out, ["tau", "src"]).select("tau", "src", F.pmod(F.hash("dst"), F.col("pieces")).alias("piece"), "dst", (alpha / F.col("k")).alias("share"), F.lit(False).alias("own"))
    kept = n.select("tau", F.col("txid").alias("src"), F.lit(0).alias("piece"), F.col("txid").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    return sent.unionAll(kept).join(out.select("tau", F.col("src").alias("dst"), "pieces"), ["tau", "dst"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))


def _send(v: DataFrame, links: DataFrame) -> DataFrame:
    """Ranks sent along the edges (``got``); each node keeps its own (``x``) and the one before (``was``)."""
    copies = v.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces").withColumnRenamed("txid", "src")
    j = copies.join(links, ["tau", "src", "piece"])
    kept = [F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("x", "was")]
    return j.groupBy("tau", F.col("dst").alias("txid")).agg(F.max("pieces").alias("pieces"), *kept, F.sum(F.col("x") * F.col("share")).alias("got"))


def pagerank(n: DataFrame, e: DataFrame, alpha: float = 0.85, iterations: int = 200, tol: float | None = 1e-6, fan: int = FAN) -> DataFrame:
    """PageRank in each step on distinct directed edges, whose ends are nodes of the step; dangling mass is spread evenly.

    A round joins ranks to edges, sums by target and is checkpointed. What it
    adds to every node alike (jumps and dangling mass) follows from the sum of
    what was sent, as ranks add up to 1, so one row a step comes to the driver
    and goes back. A step leaves the loop with the ranks of the first round that
    changes less than ``tol`` for a node on average, seen in the round after;
    ``tol=None`` runs all rounds.
    """
    spark = n.sparkSession
    place = ["tau", "src", "piece"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = settle(_links(n, e, alpha, fan).repartition(parts, *place).sortWithinPartitions(*place))  # in place for all rounds: only ranks move
    size = n.groupBy("tau").agg(F.count("*").alias("m"))
    first = (1.0 / F.col("m")).alias("x")
    x = links.filter("own").select("tau", F.col("src").alias("txid"), "pieces").join(size, "tau").select("tau", "txid", "pieces", first, first.alias("was"))
    sizes = {r["tau"]: r["m"] for r in size.collect()}  # one row a step
    done, old = [], []
    for k in range(iterations):
        s = settle(_send(x, links))
        release(*old)
        rows = s.groupBy("tau").agg(F.sum("got").alias("got"), F.sum(F.abs(F.col("x") - F.col("was"))).alias("moved")).collect()  # one row a step
        over = [r["tau"] for r in rows if k and tol is not None and r["moved"] < sizes[r["tau"]] * tol]
        go_on = [(r["tau"], (1 - r["got"]) / sizes[r["tau"]]) for r in rows if r["tau"] not in over]
        if over:
            ended = spark.createDataFrame([(t,) for t in over], "tau int")
            done.append(s.join(F.broadcast(ended), "tau").select("tau", "txid", F.col("x").alias("pagerank")))
        old = [] if over else [s]
        x = s.join(F.broadcast(spark.createDataFrame(go_on, "tau int, add double")), "tau").select("tau", "txid", "pieces", (F.col("got") + F.col("add")).alias("x"), F.col("x").alias("was"))
        if not go_on:
            break
    else:
        done.append(x.select("tau", "txid", F.col("x").alias("pagerank")))
    return reduce(DataFrame.unionByName, done) if done else x.select("tau", "txid", F.col("x").alias("pagerank"))


def oriented(u: DataFrame, deg: DataFrame) -> DataFrame:
    """Each undirected edge (tau, u, v) from its end of lower degree to the other, ties by id: no node has more than sqrt(2 edges) edges out."""
    j = u.join(deg.select("tau", F.col("txid").alias("u"), F.col("d").alias("du")), ["tau", "u"]).join(deg.select("tau", F.col("txid").alias("v"), F.col("d").alias("dv")), ["tau", "v"])
    first = F.struct("du", "u") < F.struct("dv", "v")
    return j.select("tau", F.when(first, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("high"))


def wedges(o: DataFrame) -> DataFrame:
    """(tau, low, u, w): pairs u < w of ends of oriented edges out of a node; a hub's edges come in, so it adds few."""
    left, right = o.select("tau", "low", F.col("high").alias("u")), o.select("tau", "low", F.col("high").alias("w"))
    return left.join(right, ["tau", "low"]).filter("u < w")


def clustering(n: DataFrame, e: DataFrame) -> DataFrame:
    """Local clustering coefficient of the undirected simple graph; 0 below degree 2."""
    u = e.filter("src <> dst").select("tau", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = u.select("tau", F.explode(F.array("u", "v")).alias("txid")).groupBy("tau", "txid").agg(F.count("*").alias("d"))
    tri = wedges(oriented(u, deg)).join(u.select("tau", "u", F.col("v").alias("w")), ["tau", "u", "w"])
    corner = tri.select("tau", F.explode(F.array("low", "u", "w")).alias("txid")).groupBy("tau", "txid").agg(F.count("*").alias("t"))
    j = n.select("tau", "txid").join(deg, ["tau", "txid"], "left").join(corner, ["tau", "txid"], "left")
    return j.select("tau", "txid", F.coalesce(F.try_divide(2.0 * F.coalesce("t", F.lit(0)), F.col("d") * (F.col("d") - 1).cast("double")), F.lit(0.0)).alias("clustering"))


def attention_pool(x: DataFrame, score: str, width: int) -> DataFrame:
    """Softmax of a score over each step's nodes, then the weighted sum of their features."""
    top = F.max(score).over(Window.partitionBy("tau"))
    y = x.withColumn("a", F.exp(F.col(score) - top))
    return y.groupBy("tau").agg(F.array(*[F.sum(F.col("a") * F.col("features")[i]) / F.sum("a") for i in range(width)]).alias("pooled"))


def inject_topology(s: DataFrame, x: DataFrame, topo: DataFrame, mode: str, k: int, width: int, topo_width: int) -> DataFrame:
    """Propagated features with topology columns put in before propagation (early), after it (late) or not at all (none).

    ``topo`` holds (tau, txid, topo), an array of ``topo_width``; nodes without it have zeros.
    """
    if mode not in ("early", "late", "none"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "none":
        return propagate(s, x, k, width)
    zeros = F.array(*[F.lit(0.0)] * topo_width)

    def put(y: DataFrame) -> DataFrame:
        return y.join(topo, ["tau", "txid"], "left").select("tau", "txid", F.concat("features", F.coalesce("topo", zeros)).alias("features"))

    return propagate(s, put(x), k, width + topo_width) if mode == "early" else put(propagate(s, x, k, width))


def degree_histogram(d: DataFrame, col: str = "out_degree", most: int = 12) -> DataFrame:
    """Share of each label's nodes by degree, degrees above ``most`` in one bin."""
    c = d.groupBy("label", F.least(F.col(col), F.lit(most)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


class LeakError(ValueError):
    """A feature list holds the id or the step."""


def feature_columns(columns: list[str], keys: tuple[str, ...] = ("txid", "tau", "ts", "label")) -> list[str]:
    """Columns that a model may see: all but keys, steps, times and labels, in order."""
    return [c for c in columns if c.lower() not in keys]


def check_features(chosen: list[str], keys: tuple[str, ...] = ("txid", "tau", "ts", "label")) -> None:
    bad = [c for c in chosen if c.lower() in keys]
    if bad:
        raise LeakError(f"{bad[0]} must not be a feature")
