"""Line-run deduplication: a suffix array over line-ID sequences by distributed prefix doubling.

Documents are sequences of line ids; lines that occur once end a stretch, so the
array holds the suffixes that begin with a repeated line. The rank of a suffix
after round k is the number of suffixes whose first ``2**k`` lines are smaller;
round k + 1 sorts the distinct pairs of ranks ``2**k`` lines apart and moves each
within its class. Ranks are given to distinct pairs (counted with map-side
combining, sorted by range, numbered by partition offsets), never to the
positions of one group, so a line that a third of all documents share is one row
of the sort. A suffix whose rank is its own is done; the rounds end when all are.

In the order of the ranks, neighbours' longest common prefixes follow from the
lines ahead. Intervals of prefixes of m lines or more hold the occurrences of
runs of m lines. Prefixes are measured up to ``min_words`` lines, for no shortest
run with so many words is longer. Such shortest runs, taken forward from each
line and backward from each line, together cover every line of every maximal
repeated run; of the occurrences of a run all but the first (by document id,
then position) are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import HOT_KEYS, HOT_ROWS, WORD, cut, free, free_name, no_clash, number_in_order, spread_join, stable

MIN_WORDS = 10


def by_document(step) -> callable:
    """mapInArrow function that hands ``step`` one document's rows (sorted by uid) at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            held.append(b)
            t = pa.Table.from_batches(held)
            uid = t.column("uid").to_numpy()
            cuts = np.flatnonzero(uid[1:] != uid[:-1]) + 1
            if len(cuts):
                yield from step(t.slice(0, cuts[-1]))
                held = t.slice(cuts[-1]).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from step(pa.Table.from_batches(held))

    return run


def shortest_runs(words: np.ndarray, run: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line: length of the shortest run with ``least`` words that starts there (0 if none), and
    the least and greatest length of those runs starting there that are shortest for the line they end at.

    ``run`` numbers stretches of neighbouring repeated lines; runs stay inside one.
    """
    n = len(words)
    total = np.r_[0, np.cumsum(words)]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    last = np.r_[first[1:], n]
    which = np.cumsum(np.r_[False, run[1:] != run[:-1]])
    end = np.searchsorted(total, total[:-1] + least, "left")  # lines [i, end) have enough words
    ahead = np.where((end <= n) & (end <= last[which]), end - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    ends = np.flatnonzero((total[1:] >= least) & (start >= first[which]))
    low, high = np.full(n, np.iinfo(np.int32).max), np.zeros(n, int)
    np.minimum.at(low, start[ends], ends + 1 - start[ends])
    np.maximum.at(high, start[ends], ends + 1 - start[ends])
    return ahead, low, high


def ranks_in_class(entries: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Entries (r, next, uid, q, c) with ``rank``: r, and the sum of c over the class's entries before in order.

    Sorted by range; a class may lie in many partitions, whose sums meet on the
    driver (one row a partition). Also the checkpoint behind; None without entries.
    """
    order = ["r", "next", "uid", "q"]
    parts = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        total = tail = 0  # of all, and of the last class
        for b in it:
            if b.num_rows:
                r, c = b.column("r").to_numpy(), b.column("c").to_numpy()
                part, first = (b.column("part")[0].as_py(), int(r[0])) if part is None else (part, first)
                mine = int(c[r == r[-1]].sum())
                tail = mine + (tail if last == r[-1] else 0)
                total, last = total + int(c.sum()), int(r[-1])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, first, last, total, tail)], ["part", "first", "last", "total", "tail"])

    found = sorted(parts.mapInArrow(sums, "part long, first long, last long, total long, tail long").collect())  # one row a partition
    if not found:
        free(parts)
        return None
    carry, class_, held = {}, None, 0  # what of a partition's first class lies before it
    for part, first, last, total, tail in found:
        carry[part] = held if first == class_ else 0
        held = tail + (carry[part] if first == last else 0)
        class_ = last

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in it:
            if not b.num_rows:
                continue
            r, c = b.column("r").to_numpy(), b.column("c").to_numpy()
            if last is None:
                last, held = int(r[0]), carry[b.column("part")[0].as_py()]
            before = np.cumsum(c) - c
            at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            inside = before - np.repeat(before[at], np.diff(np.r_[at, len(r)]))
            inside[r == last] += held
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r + inside)], ["r", "next", "uid", "q", "c", "rank"])
            held = int(inside[-1] + c[-1])
            last = int(r[-1])

    return parts.mapInArrow(run, "r long, next long, uid long, q int, c long, rank long"), parts


def suffix_ranks(start: DataFrame) -> DataFrame:
    """(uid, q, r): each suffix's place in the suffix array, by prefix doubling.

    ``start`` holds (uid, q, r): line q of document uid, whose line alone has
    rank r, the number of positions with smaller lines. Every line occurs twice
    or more; a missing q ends the suffix, and no two ends are equal.
    """
    state = start.select("uid", "q", "r", F.lit(True).alias("alive"))
    done, old, k = [], (), 0
    while True:
        span = 1 << k

        def step(t: pa.Table, span=span) -> Iterator[pa.RecordBatch]:
            uid, q, r = (t.column(c).to_numpy() for c in ("uid", "q", "r"))
            alive = t.column("alive").to_numpy()
            # Positions sort by (uid, q); number documents to look positions up by one key.
            doc = np.cumsum(np.r_[False, uid[1:] != uid[:-1]]).astype(np.int64)
            key = (doc << 32) + q
            i = np.minimum(np.searchsorted(key, key + span), len(key) - 1)
            after = np.where(key[i] == key + span, r[i], -1)
            busy = np.bincount(doc, weights=alive)[doc] > 0
            cols = [pa.array(x) for x in (uid, q, r, alive, after, busy)]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "q", "r", "alive", "next", "busy"])

        ranked = cut(state.repartition("uid").sortWithinPartitions("uid", "q").mapInArrow(by_document(step), "uid long, q int, r long, alive boolean, next long, busy boolean"))
        free(*old)
        done.append(ranked.filter("not busy").select("uid", "q", "r"))
        live = ranked.filter("alive and next >= 0")
        # Distinct pairs with their counts; a suffix that ends here is alone and comes first in its class.
        pairs = live.groupBy("r", "next").agg(F.count("*").alias("c")).select("r", "next", F.lit(0).cast("long").alias("uid"), F.lit(0).alias("q"), "c")
        ends = ranked.filter("alive and next < 0").select("r", "next", "uid", "q", F.lit(1).cast("long").alias("c"))
        found = ranks_in_class(pairs.unionByName(ends))
        if found is None:
            break
        entries, kept = found
        often = kept.filter(F.col("c") > HOT_ROWS).orderBy(F.desc("c")).limit(HOT_KEYS).select(F.xxhash64("r", "next").alias("h"))
        hot = [x["h"] for x in often.collect()]  # HOT_KEYS at most
        moved = spread_join(live, entries.filter("next >= 0").select("r", "next", "rank", "c"), ["r", "next"], ["uid", "q"], hot=hot)
        state = moved.select("uid", "q", F.col("rank").alias("r"), (F.col("c") > 1).alias("alive"))
        state = state.unionByName(entries.filter("next < 0").select("uid", "q", F.col("rank").alias("r"), F.lit(False).alias("alive")))
        state = state.unionByName(ranked.filter("busy and not alive").select("uid", "q", "r", "alive"))
        old, k = (kept,), k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading equal entries of the rows of two matrices; -1 equals nothing."""
    return np.logical_and.accumulate((a == b) & (a >= 0), axis=1).sum(1)


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, start, n): runs of n lines from ``start`` that have an earlier copy.

    ``lines`` holds (uid, k, q, words, h1, h2): the document and its order key,
    the line's number, its words (one at least) and its 128-bit id.
    """
    depth = min_words
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1")
    ids = number_in_order(ids, ["h1", "h2"], "r", "c").select("h1", "h2", "r")
    here = spread_join(lines, ids, ["h1", "h2"], ["uid", "q"]).select("uid", "k", "q", "words", "r")

    def runs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        uid, q, r, words = (t.column(c).to_numpy() for c in ("uid", "q", "r", "words"))
        new = np.r_[True, (uid[1:] != uid[:-1]) | (q[1:] != q[:-1] + 1)]
        stretch = np.cumsum(new)
        lengths = shortest_runs(words, stretch, min_words)
        last = np.searchsorted(stretch, stretch, "right")
        n = np.minimum(last - np.arange(len(q)), depth)
        at = np.r_[0, np.cumsum(n)]
        flat = r[np.arange(at[-1]) - np.repeat(at[:-1] - np.arange(len(q)), n)]
        ahead = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("uid", "k", "q", "r")), *(pa.array(x, pa.int32()) for x in lengths), ahead], ["uid", "k", "q", "r", "ahead", "low", "high", "lines"])

    names = "uid long, k long, q int, r long, ahead int, low int, high int, lines array<long>"
    state = cut(here.repartition("uid").sortWithinPartitions("uid", "q").mapInArrow(by_document(runs), names))
    order = suffix_ranks(state.select("uid", "q", "r"))
    array = state.drop("r").join(order, ["uid", "q"]).repartitionByRange("r").sortWithinPartitions("r").withColumn("part", F.spark_partition_id())
    array = cut(array.select("uid", "k", "q", "r", "ahead", "low", "high", "lines", "part"))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        col = b.column("lines")
        n, x = col.value_lengths().to_numpy(), np.full((b.num_rows, depth), -1, np.int64)
        x[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = col.flatten().to_numpy()
        return x

    def ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's first and last suffix, and how many neighbours in it share fewer than 1, 2, ... lines."""
        first = last = part = None
        breaks = np.zeros(depth, np.int64)
        for b in it:
            if b.num_rows:
                x = matrix(b)
                first, part = (x[0], b.column("part")[0].as_py()) if first is None else (first, part)
                x = x if last is None else np.vstack([last, x])
                breaks += (common_prefixes(x[:-1], x[1:])[:, None] < np.arange(1, depth + 1)).sum(0)
                last = x[-1:]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (first, last[0], breaks))], ["part", "first", "last", "breaks"])

    found = sorted(array.mapInArrow(ends, "part int, first array<long>, last array<long>, breaks array<long>").collect())  # one row a partition
    base, at, before = {}, np.zeros(depth, np.int64), None
    for part, first, last, breaks in found:
        if before is not None:
            at = at + (common_prefixes(np.array([before]), np.array([first]))[0] < np.arange(1, depth + 1))
        base[part] = at
        at, before = at + np.array(breaks), last

    def intervals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shortest runs at each suffix, with the number of their interval at their depth."""
        last = at = None
        for b in it:
            if not b.num_rows:
                continue
            x = matrix(b)
            broken = np.zeros((len(x), depth), np.int64)
            y = x if last is None else np.vstack([last, x])
            broken[len(x) - len(y) + 1 :] = common_prefixes(y[:-1], y[1:])[:, None] < np.arange(1, depth + 1)
            at = base[b.column("part")[0].as_py()] if at is None else at
            number = at + np.cumsum(broken, axis=0)
            last, at = x[-1:], number[-1]
            ahead, low, high = (b.column(c).to_numpy() for c in ("ahead", "low", "high"))
            many = np.maximum(high - low + 1, 0)
            row = np.repeat(np.arange(len(x)), many)
            n = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            own = np.flatnonzero((ahead > 0) & ((ahead < low) | (ahead > high)))
            row, n = np.r_[row, own], np.r_[n, ahead[own]]
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("uid", "k", "q")), pa.array(n, pa.int32()), pa.array(number[row, n - 1])], ["uid", "k", "start", "n", "interval"])

    found = cut(array.mapInArrow(intervals, "uid long, k long, start int, n int, interval long"))
    free(state, array)
    at = F.struct("k", "uid", "start")
    firsts = found.groupBy("n", "interval").agg(F.min(at).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return spread_join(found, firsts, ["n", "interval"], ["uid", "start"]).filter(at > F.col("first")).select("uid", "start", "n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """The documents with later copies of repeated line runs deleted from their texts.

    Lines end at LF; they are equal if they are after trimming blanks, and lines
    without words neither count nor break a run. Runs need ``min_words`` words.
    The first occurrence by id (null last), then row, then place stays. Texts
    without deleted lines are kept byte for byte, null ones stay null; a text
    all of whose lines go becomes empty. Repeated rows are copies of one
    another. With ``counts``: n_lines and n_deleted (lines with words) follow
    the columns, which must not have these names. Rows are never dropped. Long
    texts are read whole, other columns are kept whatever their names, and an
    empty table gives no rows.
    """
    no_clash(docs, ["n_lines", "n_deleted"] if counts else [])
    docs = stable(docs)
    uid, gone = free_name(docs, "__uid"), free_name(docs, "__gone")
    base = docs.withColumn(uid, F.monotonically_increasing_id())
    parts = F.split(F.col(text_col), "\n")
    worded = F.filter(F.transform(parts, lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("line"), i.alias("pos"))), lambda s: F.length(s["line"]) > 0)
    lines = base.select(F.col(uid).alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k"), F.posexplode(worded).alias("q", "s"))
    line = F.col("s.line")
    lines = cut(lines.select("uid", "k", "q", F.col("s.pos").alias("pos"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))
    runs = repeated_runs(lines.drop("pos"), min_words)
    hit = runs.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("q")).groupBy("uid").agg(F.collect_set("q").alias(gone))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, g):
            if t is None or g is None:
                return t
            drop, q, out = set(g.tolist()), 0, []
            for x in t.split("\n"):
                if x.strip(" \t\r\x0b\x0c"):
                    if q not in drop:
                        out.append(x)
                    q += 1
                else:
                    out.append(x)
            return "\n".join(out)

        return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)

    j = base.join(hit.withColumnRenamed("uid", uid), uid, "left")
    hurt = F.col(gone).isNotNull()
    j = j.withColumn(text_col, F.when(hurt, without(F.when(hurt, F.col(text_col)), F.col(gone))).otherwise(F.col(text_col)) if not counts else F.col(text_col))
    if not counts:
        return j.select(*docs.columns)
    j = j.withColumn("n_lines", F.coalesce(F.size(worded), F.lit(0)).cast("long")).withColumn("n_deleted", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    j = j.withColumn(text_col, F.when(hurt, without(F.when(hurt, F.col(text_col)), F.col(gone))).otherwise(F.col(text_col)))
    return j.select(*docs.columns, "n_lines", "n_deleted")
