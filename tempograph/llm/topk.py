"""Exact top-k inner products over norm-sorted vectors.

Vectors are integers (``floor(scale * x)``). Candidates are processed by
descending length. An orthogonal rotation from the SVD of all vectors moves
most of the energy into the first coordinates, so that

    q.c = q1.c1 + q2.c2 <= q1.c1 + |q2| |c2|        (Cauchy-Schwarz on the rest)

prunes most candidates after a partial sum, and |q| |c| ends a query's scan
once candidates are too short. Bounds are floating point with a margin; scores
that decide are integer and exact.

Distribution: candidates are split into bands of descending length. A first
pass over the longest vectors (at most ``head_rows``, a fixed bound) gives each
query a lower bound on its k-th score. A query then only goes to the bands that
can still beat that bound, and each band holds a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.common import cut

K = 20
SCALE = 64.0
HEAD_ROWS = 2048
BAND_ROWS = 8192
QUERY_BLOCK = 2048
#: Most numbers of live query blocks that are broadcast; beyond, candidates are joined with them by a shuffle.
BROADCAST_BLOCKS = 200_000


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 0))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; float products only where they are exact."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def block_topk(q: np.ndarray, c: np.ndarray, floor: np.ndarray, rot: np.ndarray, head: int, k: int, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triples (query row, candidate row, score) that may be among the k best of q over c.

    ``c`` is sorted by descending length; ``floor`` holds lower bounds on each
    query's k-th score and is raised in place. Equal scores are never pruned.
    """
    cr, qr = c @ rot, q @ rot
    cn, qn = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    c2, q2 = np.linalg.norm(cr[:, head:], axis=1), np.linalg.norm(qr[:, head:], axis=1)
    margin = 1e-9 * (qn.max(initial=0) * cn.max(initial=0)) + 1e-6
    live = np.arange(len(q))
    for at in range(0, len(c), tile):
        end = min(at + tile, len(c))
        live = live[qn[live] * cn[at] + margin >= floor[live]]
        if not len(live):
            return
        bound = qr[live, :head] @ cr[at:end, :head].T + q2[live, None] * c2[None, at:end]
        qi, ci = np.nonzero(bound + margin >= floor[live, None])
        if not len(qi):
            continue
        if len(qi) > 0.2 * bound.size:
            scores = _exact(q[live], c[at:end])[qi, ci]
        else:
            a, b = q[live[qi]], c[at + ci]
            scores = (np.einsum("ij,ij->i", a, b) if margin < 1e5 else np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))).astype(np.int64)
        keep = scores >= floor[live[qi]]
        qi, ci, scores = live[qi[keep]], at + ci[keep], scores[keep]
        # The k-th best score of this tile is a lower bound too.
        order = np.lexsort((-scores, qi))
        qs, ss = qi[order], scores[order]
        first = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0)) if len(qs) else np.zeros(0, int)
        rank = np.arange(len(qs)) - start
        kth = rank == k  # one more than k: the query itself may be among them
        np.maximum.at(floor, qs[kth], ss[kth])
        top = ss >= floor[qs]
        yield qs[top], ci[order][top], ss[top]


def exact_topk(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: float = SCALE,
    query_filter=None, head_rows: int = HEAD_ROWS, band_rows: int = BAND_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row with every other row.

    Vectors that are null, or hold null or non-finite components, take no part;
    of vectors of several lengths, missing components count as 0. Queries are
    the rows of ``query_filter`` (default: id divisible by 20) with an id.
    Repeated rows are queries and candidates each; a row is never its own
    candidate, though its copies are. Ties go to the smaller id, null last.
    Fewer than k candidates: all. An empty table gives no rows. Components
    should stay below 2**25 after scaling, so that scores fit a long.
    """
    spark = vectors.sparkSession
    query_filter = F.col("id") % 20 == 0 if query_filter is None else query_filter
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    v = v.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    v = v.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    # Rows are told apart by id and, for repeated ids, a number.
    v = v.withColumn("no", F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.xxhash64("v"))).orderBy("v")))
    v = cut(v)  # read several times below

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(r) for r in b.column(0).to_pylist()]
            d = max(map(len, x), default=0)
            m = np.array([np.pad(r, (0, d - len(r))) for r in x])
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([(m.T @ m).ravel().tolist()], pa.list_(pa.float64()))], ["d", "rows", "g"])

    # Rows of d * d numbers, one per batch.
    grams = v.select("v").mapInArrow(gram, "d int, rows long, g array<double>")
    sums = grams.groupBy("d").agg(F.sum("rows").alias("rows"), F.max(F.size("g")).alias("dd"))
    flat = grams.select("d", F.posexplode("g").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x")).collect()  # d * d numbers for each vector length
    rows = sum(r["rows"] for r in sums.collect())
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max((r["d"] for r in flat), default=0)
    g = np.zeros((d, d))
    for r in flat:
        g[r["i"] // r["d"], r["i"] % r["d"]] += r["x"]
    _, vecs = np.linalg.eigh(g) if d else (None, np.zeros((0, 0)))
    rot = np.ascontiguousarray(vecs[:, ::-1])  # right singular vectors, largest first
    head = max(1, min(d, d // 4))
    v = v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))))

    # Bands of descending length: cut points from quantiles; ties only make a band longer by salting below.
    n_bands = max(1, -(-rows // band_rows))
    cuts = v.select(F.percentile_approx("n", [i / n_bands for i in range(1, n_bands)], 10000)).first()[0] if n_bands > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    band = F.size(F.filter(F.lit(cuts).cast("array<double>") if cuts else F.array().cast("array<double>"), lambda x: x >= F.col("n"))) if cuts else F.lit(0)
    v = v.withColumn("band", band)
    tops = [r["n"] for r in v.groupBy("band").agg(F.max("n").alias("n"), F.count("*").alias("c")).orderBy("band").collect()]
    sizes = {r["band"]: r["c"] for r in v.groupBy("band").agg(F.count("*").alias("c")).collect()}
    bands = sorted(sizes)
    splits = {b: max(1, -(-sizes[b] // (2 * band_rows))) for b in bands}  # many equal lengths in one band

    lead = v.orderBy(F.desc("n"), "id", "no").limit(head_rows).select("id", "no", "v").collect()  # head_rows at most
    lead_v = np.array([r["v"] for r in lead]).reshape(len(lead), d)
    shared = spark.sparkContext.broadcast((lead_v, rot))
    band_list = [(int(b), float(t), int(splits[b])) for b, t in zip(bands, tops)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query: its lower bound, and a copy for each part of a band that can beat it."""
        lead_v, rot = shared.value
        for p in batches:
            if not len(p):
                continue
            q = _matrix(p["v"]).reshape(len(p), d)
            s = _exact(q, lead_v)
            # one more than k, since the query may be among the leaders itself
            low = np.partition(s, len(lead_v) - k - 1, axis=1)[:, len(lead_v) - k - 1].astype(float) if len(lead_v) > k else np.full(len(p), -np.inf)
            for b, top, parts in band_list:
                go = p["n"].to_numpy() * top * (1 + 1e-9) + 1e-6 >= low
                if go.any():
                    x = p[go].assign(low=low[go], band=b)
                    for s_ in range(parts):
                        yield x.assign(part=s_)[["id", "no", "v", "low", "band", "part"]]

    queries = v.filter(query_filter).select("id", "no", "v", "n").mapInPandas(route, "id long, no int, v array<double>, low double, band int, part int")
    n_blocks = max(1, -(-rows // (20 * query_block)))
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("id", "no"), F.lit(n_blocks)).cast("int")))
    # A candidate goes to the query blocks in which a query can still be beaten by its band, and to no other.
    live = queries.groupBy("band", "part").agg(F.collect_set("block").alias("blocks"))
    live = F.broadcast(live) if sum(splits.values()) * n_blocks <= BROADCAST_BLOCKS else live
    part_of = F.pmod(F.xxhash64("id", "no"), F.element_at(F.create_map(*[F.lit(x) for b in bands for x in (b, splits[b])]), F.col("band"))).cast("int")
    cands = v.withColumn("part", part_of).join(live, ["band", "part"]).withColumn("block", F.explode("blocks"))

    def join(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_no": [], "id": [], "no": [], "score": []}
        if len(left) and len(right):
            _, rot = shared.value
            right = right.sort_values(["n", "id", "no"], ascending=[False, True, True])
            q, c = _matrix(left["v"]), _matrix(right["v"])
            qid, qno, cid, cno = left["id"].to_numpy(), left["no"].to_numpy(), right["id"].astype("Int64"), right["no"].to_numpy()
            found = list(block_topk(q, c, left["low"].to_numpy().copy(), rot, head, k))
            if found:
                qi, ci, s = (np.concatenate(x) for x in zip(*found))
                p = pd.DataFrame({"query_id": qid[qi], "query_no": qno[qi], "id": cid.iloc[ci].array, "no": cno[ci], "score": s})
                p = p[~((p["query_id"] == p["id"]).fillna(False) & (p["query_no"] == p["no"]))]
                p = p.sort_values(["query_id", "query_no", "score", "id"], ascending=[True, True, False, True], na_position="last")
                return p[p.groupby(["query_id", "query_no"]).cumcount() < k]
        return pd.DataFrame(out)

    near = (
        queries.groupBy("band", "part", "block")
        .cogroup(cands.select("id", "no", "v", "n", "band", "part", "block").groupBy("band", "part", "block"))
        .applyInPandas(join, "query_id long, query_no int, id long, no int, score long")
    )
    w = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "no")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
