"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target size. It is met with whole copies of all its
documents plus a part: documents are counted by exact length, each length
gives its proportional share, and what then remains of the budget (less than
one longest document) is fitted by a bounded-knapsack dynamic program over the
remaining counts. The documents behind the chosen length counts are picked by a
seeded hash, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.common import cut, free, free_name, spread_join, stable, word_count

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 17


def fit_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, int]:
    """How many documents of each length, so that the total comes closest to ``budget`` from below.

    Bounded knapsack by binary splitting; ``reach[s]`` tells whether total s
    can be made and ``by[s]`` which item made it first. Stops once the budget
    itself is reachable. Lengths above the budget and of 0 take no part.
    """
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        if length <= 0 or length > budget:
            continue
        left, step = min(count, budget // length), 1
        while left > 0 and not reach[budget]:
            n = min(step, left)
            w = n * length
            if w <= budget:
                new = np.zeros_like(reach)
                new[w:] = reach[: budget + 1 - w]
                new &= ~reach
                by[new] = len(items)
                reach |= new
                items.append((length, n))
            left -= n
            step *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    out: dict[int, int] = {}
    while at:
        length, n = items[by[at]]
        out[length] = out.get(length, 0) + n
        at -= length * n
    return out


def plan_source(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length (ascending lengths) for a budget below the source's size."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.copy()
    # Proportional share of each length, in whole numbers; lengths keep their mix.
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    # Longest first, one more document of each length, until less than one longest document is left.
    for i in range(len(lengths) - 1, -1, -1):
        if left < lengths[-1]:
            break
        if take[i] < counts[i] and 0 < lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    extra = fit_subset(lengths, counts - take, min(left, int(lengths[-1])))
    if extra:
        at = {int(n): i for i, n in enumerate(lengths)}
        for n, c in extra.items():
            take[at[n]] += c
    return take


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight): shares of the total by weight.

    No target passes ``max_repeats`` times the source's size; the excess goes to
    the others by weight, again and again until none is above. Runs on the
    source table by aggregates only; each round fixes at least one source.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    rate = 0.0
    while True:
        # Sources above their cap at the present rate stay there; rates only rise.
        r = sources.agg(F.sum(F.when(capped, cap)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()
        if not r["w"]:
            break
        new = (total - (r["fixed"] or 0.0)) / r["w"]
        above = sources.agg(F.count(F.when(cap < F.col("weight") * F.lit(new), 1)).alias("n")).first()["n"]
        rate, capped = new, cap < F.col("weight") * F.lit(new)
        if above == r["n"]:
            break
    return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(float(rate))))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without one task for all: range parts, then offsets."""
    flagged = sizes.withColumn("__null", F.col("source").isNull())
    parts = cut(flagged.repartitionByRange("__null", "source").withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # one row a partition
    offset, at = {}, 0
    for p in sorted(counts):
        offset[p], at = at, at + counts[p]
    local = F.row_number().over(Window.partitionBy("__part").orderBy("__null", "source"))
    off = F.element_at(F.create_map(*[F.lit(x) for p, o in offset.items() for x in (p, o)]), F.col("__part")) if offset else F.lit(0)
    return parts.withColumn("no", (local - 1 + off).cast("long")).drop("__null", "__part")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, size: Column | None = None, key_col: str | None = None,
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken), then ``key`` if ``key_col`` names a row key.

    ``size`` defaults to the number of words. ``taken`` is the size times the
    number of copies the mix takes (0 to ``max_repeats``). Documents of size 0
    take nothing. Null sources form one source, numbered last; null ids and
    repeated rows are documents of their own. Documents with equal hash are
    ordered by id and size only, so which of several equal rows is taken does
    not show. Long texts are counted whole, other columns are not looked at. An
    empty table gives no rows.
    """
    size = word_count(text_col) if size is None else size
    key = [] if key_col is None else ["key"]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *[F.col(key_col).alias(k) for k in key])
    slim = cut(slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    hist = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    ranked = ranked_sources(sizes)
    n_w = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % n_w + 1).cast("int"))
    targets = cut(source_targets(ranked.withColumn("weight", weight), weights, max_repeats))

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        total, target = int(p["source_size"].iloc[0]), float(p["target"].iloc[0])
        full = min(max_repeats, int(target // total)) if total else 0
        budget = int(round(target - full * total)) if full < max_repeats else 0
        take = plan_source(p["size"].to_numpy(np.int64), p["n"].to_numpy(np.int64), budget)
        return p[["source", "size", "n", "source_size", "target"]].assign(full=full, take=take)

    # A group holds one row for each length that occurs in a source, not its documents.
    lengths = hist.join(targets, hist["source"].eqNullSafe(targets["source"])).select(hist["source"], "size", "n", "source_size", "target")
    plans = cut(lengths.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, full int, take long"))

    # Seeded choice inside a (source, length) group without gathering it: about sqrt(n) hash
    # buckets; whole buckets are taken up to the one in which the count is met, which is ranked.
    partly = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    rows = spread_join(slim, plans, ["source", "size"], ["h"], null_safe=True)
    rows = rows.withColumn("bucket", F.when(partly, F.pmod(F.col("h"), F.ceil(F.sqrt("n")).cast("long"))))
    rows = cut(rows)
    free(slim, hist, targets, plans)
    whole = rows.filter(~partly).withColumn("extra", (F.col("take") > 0).cast("int"))
    some = rows.filter(partly)
    buckets = some.groupBy("source", "size", "bucket").agg(F.count("*").alias("b"), F.first("take").alias("take"))
    upto = F.sum("b").over(Window.partitionBy("source", "size").orderBy("bucket"))
    buckets = buckets.withColumn("before", upto - F.col("b")).withColumn("state", F.when(F.col("before") + F.col("b") <= F.col("take"), 1).when(F.col("before") >= F.col("take"), 0).otherwise(2))
    buckets = cut(buckets.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), (F.col("take") - F.col("before")).alias("need"), "state"))
    some = some.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    sure = some.filter("state < 2").withColumn("extra", F.col("state"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", *key))
    edge = some.filter("state = 2").withColumn("extra", (rank <= F.col("need")).cast("int"))
    out = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("full") + F.col("extra"))).cast("long").alias("taken"), *key]
    return whole.select(*out).unionByName(sure.select(*out)).unionByName(edge.select(*out))


def apply_mix(docs: DataFrame, **kw) -> DataFrame:
    """The documents the mix takes, repeated as often as it takes them; columns are kept, whatever their names.

    A repeated document has its rows next to it. Documents that the mix takes 0
    times, and those of size 0 (null and empty texts), are dropped. Null sources
    form one source; null ids and repeated rows are documents of their own. Long
    texts are counted whole. An empty table gives no rows.
    """
    docs = stable(docs)
    uid, copies = free_name(docs, "__uid"), free_name(docs, "__copies")
    d = docs.withColumn(uid, F.monotonically_increasing_id())
    taken = mix_sources(d, key_col=uid, **kw).filter("size > 0 and taken > 0")
    taken = taken.select(F.col("key").alias(uid), (F.col("taken") / F.col("size")).cast("int").alias(copies))
    return d.join(taken, uid).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies)
