"""All channels of directional propagation share a join and an aggregate a hop."""

import numpy as np
from tempograph.operators import graph


def test_directional_channels_equal_their_operators(spark):
    # repeated, reciprocal and self edges, a node without edges, an end that is no node
    edges = [(1, 1, 2), (1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 3), (1, 9, 1), (2, 7, 8)]
    nodes = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 7), (2, 8)]
    e, n = spark.createDataFrame(edges, "tau int, src long, dst long"), spark.createDataFrame(nodes, "tau int, txid long")
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(t, v, rng.normal(size=2).tolist()) for t, v in nodes], "tau int, txid long, features array<double>")
    out = graph.propagate_directional(n, e, x, 2, 2)
    got = {(r["tau"], r["txid"]): r["features"] for r in out.collect()}
    parts = [x, *(graph.propagate(s, x, k, 2) for k in (1, 2) for s in (graph.symmetric_operator(n, e), graph.row_operator(e, False, n), graph.row_operator(e, True, n)))]
    want = {key: [] for key in got}
    for p in parts:
        for r in p.collect():
            if (r["tau"], r["txid"]) in want:
                want[r["tau"], r["txid"]] += r["features"]
    assert set(got) == set(nodes) and all(len(v) == 14 and np.allclose(v, want[k]) for k, v in got.items())
    # a hop: its join, those of its operator's degrees, and that to the output; the second holds the first's again
    assert str(out._jdf.queryExecution().analyzed()).count("Join") <= 12
