"""Running sums, exact quantiles, metrics and PageRank against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.operators import evaluate, graph, running, stats


@pytest.fixture(scope="module")
def scored(spark):
    """Three groups, one with most rows, one of null; many ties."""
    rng = np.random.default_rng(4)
    rows = [(g, i, int(rng.integers(-1, 2)), float(rng.integers(0, 40)) / 40) for i in range(900) for g in [1 if i % 9 else 2 if i % 2 else None]]
    return rows, spark.createDataFrame(rows, "g int, txid long, label int, score double").repartition(5).cache()


def test_running(spark, scored):
    rows, df = scored
    got = running.running(df.withColumn("n", F.lit(1)), ["g"], [F.desc("score"), F.col("txid")], ["n", "label"]).collect()
    assert len(got) == len(rows)
    for g in (1, 2, None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
        sums = dict(zip((r[1] for r in own), np.cumsum([r[2] for r in own])))
        place = {r[1]: i + 1 for i, r in enumerate(own)}
        mine = [r for r in got if r["g"] == g]
        assert all(r["cum_n"] == place[r["txid"]] and r["cum_label"] == sums[r["txid"]] for r in mine)
        assert {(r["all_n"], r["all_label"]) for r in mine} == {(len(own), sum(r[2] for r in own))}
    assert running.running(df.limit(0).withColumn("n", F.lit(1)), ["g"], [F.col("score")], ["n"]).collect() == []


def test_no_window_over_a_group(scored):
    df = scored[1].filter("g is not null")
    for frame in (evaluate.average_precision(df, ["g"]), evaluate.calibrated_threshold(df, ["g"]), evaluate.precision_at_k(df, ["g"])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "score" in line]
        assert windows and all("__range" in line for line in windows)


def test_metrics(scored):
    rows, df = scored
    ap = {r["g"]: r["ap"] for r in evaluate.average_precision(df, ["g"]).collect()}
    best = {r["g"]: r for r in evaluate.best_f1_threshold(df, ["g"]).collect()}
    few = {r["g"]: r for r in evaluate.calibrated_threshold(df, ["g"], epsilon=10_000).collect()}
    top = {r["g"]: r for r in evaluate.precision_at_k(df, ["g"]).collect()}
    for g in (1, 2, None):
        own = [r for r in rows if r[0] == g and r[2] >= 0]
        y, s = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        cuts = np.unique(s)[::-1]
        tp, n = np.array([y[s >= c].sum() for c in cuts]), np.array([(s >= c).sum() for c in cuts])
        assert np.isclose(ap[g], (np.diff(tp, prepend=0) * tp / n).sum() / y.sum())
        pr, rc = tp / n, tp / y.sum()
        f1 = np.round(2 * pr * rc / (pr + rc + 1e-8), 9)
        assert np.isclose(best[g]["f1"], f1.max()) and best[g]["threshold"] == cuts[f1 == f1.max()].min()
        assert few[g]["fallback"] and np.isclose(few[g]["threshold"], np.quantile(s, 1 - y.mean()))
        order = sorted(own, key=lambda r: (-r[3], r[1]))[: y.sum()]
        assert top[g]["k"] == y.sum() and np.isclose(top[g]["precision_at_k"], np.mean([r[2] for r in order]))


def test_quantiles(spark, scored):
    rows, df = scored
    counts = df.groupBy("g", "score").agg(F.count("*").alias("n"))
    got = {r["g"]: r for r in running.quantiles(counts, ["g"], "score", {"a": 0.0, "b": 0.37, "c": 1.0, "own": F.col("g") / 10.0}).collect()}
    for g in (1, 2, None):
        s = [r[3] for r in rows if r[0] == g]
        assert np.allclose([got[g][k] for k in "abc"], np.quantile(s, [0, 0.37, 1]))
        assert g is None or np.isclose(got[g]["own"], np.quantile(s, g / 10))


def test_profiles(spark, scored):
    rows, df = scored
    x = df.withColumn("other", F.when(F.col("txid") % 4 > 0, F.col("txid") * 0.5))
    got = {(r["g"], r["col"]): r for r in stats.profiles(x, "g", {"score": F.col("score"), "other": F.col("other")}).collect()}
    assert len(got) == 6
    for g in (1, 2, None):
        for col, of in (("score", lambda r: r[3]), ("other", lambda r: r[1] * 0.5 if r[1] % 4 else None)):
            v = np.array([of(r) for r in rows if r[0] == g and of(r) is not None])
            r = got[g, col]
            want = [len(v), v.mean(), v.std(ddof=1), v.min(), v.max(), np.median(np.abs(v - np.median(v))), *np.quantile(v, list(stats.QUANTILES.values()))]
            assert np.allclose([r[k] for k in ("n", "mean", "std", "min", "max", "mad", *stats.QUANTILES)], want, atol=2e-6)


def _dense(ids, links, rounds, tol, alpha=0.85):
    m, at = len(ids), {k: i for i, k in enumerate(ids)}
    a = np.zeros((m, m))
    for s, d in set(links):
        a[at[s], at[d]] = 1
    out = a.sum(1)
    p = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 1 / m)
    x = np.full(m, 1 / m)
    for k in range(rounds):
        new = alpha * x @ p + (1 - alpha) / m
        moved, x = np.abs(new - x).sum(), new
        if tol is not None and moved < m * tol:
            break
    return dict(zip(ids, x)), k + 1


@pytest.fixture(scope="module")
def steps():
    """Steps that converge after different numbers of rounds: a hub, a cycle, no edges, one node, a random graph with loops and repeats."""
    rng = np.random.default_rng(3)
    hub = [(100 + i, 100) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 40, 2)]
    cycle = [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(200, 203)]
    rand = [(500 + int(a), 500 + int(b)) for a, b in rng.integers(0, 60, (150, 2))]
    return {1: (range(100, 140), hub), 2: (range(200, 207), cycle), 3: (range(300, 305), []), 4: ([400], []), 5: (range(500, 560), rand + rand[:20])}


@pytest.mark.parametrize("tol,iterations", [(None, 13), (1e-3, 200), (1e-12, 8)])
def test_pagerank(spark, steps, tol, iterations):
    n = spark.createDataFrame([(t, int(i)) for t, (ids, _) in steps.items() for i in ids], "tau int, txid long")
    e = spark.createDataFrame([(t, *p) for t, (_, links) in steps.items() for p in links], "tau int, src long, dst long")
    got = {(r["tau"], r["txid"]): r["pagerank"] for r in graph.pagerank(n, e, iterations=iterations, tol=tol, fan=5).collect()}
    used = set()
    for t, (ids, links) in steps.items():
        want, k = _dense(list(ids), links, iterations, tol)
        used.add(k)
        assert all(abs(got.pop((t, i)) - x) < 1e-12 for i, x in want.items())
    assert not got and (tol != 1e-3 or len(used) > 2)


def test_pagerank_of_nothing(spark):
    n, e = spark.createDataFrame([], "tau int, txid long"), spark.createDataFrame([], "tau int, src long, dst long")
    assert graph.pagerank(n, e).collect() == []
