"""Quality rules: statistics of each text, judged by an isolation forest.

Base rules reject short and self-repeating texts outright. Of the others the
forest rejects those whose rule statistics are anomalous: random splits
isolate them after few steps. It sees all statistics, as excesses over the
quartiles in units of their spread, and splits by range, so an outlier in any
one rule can be isolated; a value outside what a tree has seen leaves its box
early. Trees are grown on bounded random subsamples, as the method prescribes,
of rows labelled good, so that a common kind of bad text is not taken for
normal; the path-length threshold is calibrated on labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import cut, free_name, no_clash

N_TREES = 100
SUBSAMPLE = 256
#: Share of good labelled rows that the threshold may reject.
MAX_FALSE_REJECT = 0.005
SEED = 8
#: Decimal digits of a score.
DIGITS = 5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["mean_word", "symbols_per_word", "dup_lines_per_line", "repeat_share", "distinct_share", "upper_share", "digit_share", "bang_share", "repeat_pairs", "punct_share", "log_words"]

#: Statistics of which low values are unusual too.
TWO_SIDED = ["mean_word", "distinct_share", "punct_share"]
#: Least spread that counts as a unit of each statistic.
UNITS = [0.1, 0.02, 0.02, 0.02, 0.02, 0.01, 0.01, 0.01, 0.01, 0.02, 0.3]


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words inside windows of n words that occur twice or more, the first included."""
    if len(ids) < n:
        return 0
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """Base counts and rule statistics of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((code[w] for w in words), np.uint64, n) if n else np.zeros(0, np.uint64)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids)
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[b], minlength=5) if len(b) else np.zeros(5, int)
    w1, l1 = max(1, n), max(1, len(lines))
    stats = [
        min(chars / w1, 50.0), symbols / w1, dup / l1, repeat / w1, len(code) / w1 * (1 + np.log(w1)) / 8,
        kinds[1] / max(1, chars), kinds[2] / max(1, chars), kinds[3] / w1,
        float((ids[1:] == ids[:-1]).sum()) / w1 if n > 1 else 0.0, kinds[4] / w1, np.log1p(n),
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in stats]


_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[33] = 3
for _c in b",.;:?()\"'-":
    _KIND[_c] = 4


class Forest:
    """Isolation forest over rows of all statistics; trees are arrays of nodes with their boxes."""

    def __init__(self, x: np.ndarray, n_trees: int = N_TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.low, self.high = np.quantile(x, [0.25, 0.75], axis=0)
        self.unit = np.maximum(self.high - self.low, UNITS)
        x = self.excess(x)
        self.size = min(subsample, len(x))
        depth = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(n_trees)]

    def excess(self, x: np.ndarray) -> np.ndarray:
        under = [STATS.index(c) for c in TWO_SIDED]
        return np.hstack([np.maximum(x - self.high, 0) / self.unit, (np.maximum(self.low - x, 0) / self.unit)[:, under]])

    @staticmethod
    def _mean_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cutoff, left, right, path, lows, highs = [], [], [], [], [], [], []

        def node(rows: np.ndarray, at: int) -> int:
            me = len(feature)
            low, high = rows.min(0), rows.max(0)
            for a, v in ((feature, -1), (cutoff, 0.0), (left, me), (right, me), (path, at + self._mean_path(len(rows))), (lows, low), (highs, high)):
                a.append(v)
            span = high - low
            if at < depth and len(rows) > 1 and span.max() > 0:
                f = int(rng.choice(len(span), p=span / span.sum()))
                c = float(rng.uniform(low[f], high[f]))
                c = c if c > low[f] else float(high[f])
                go = rows[:, f] < c
                feature[me], cutoff[me] = f, c
                left[me] = node(rows[go], at + 1)
                right[me] = node(rows[~go], at + 1)
            return me

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cutoff, left, right, path, lows, highs))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in 0 to 1; short paths score high.

        A row outside a node's box is split off there with the probability of a
        cut between the two, so its path is an expectation.
        """
        x = self.excess(x)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cutoff, left, right, path, lows, highs in self.trees:
            at, step = np.zeros(len(x), int), 0
            stay, live = np.ones(len(x)), np.ones(len(x), bool)
            while live.any():
                low, high = lows[at], highs[at]
                out = (np.maximum(low - x, 0) + np.maximum(x - high, 0)).sum(1)
                leave = live * out / np.maximum((high - low).sum(1) + out, 1e-12)
                total += stay * leave * (step + 1)
                stay *= 1 - leave
                f = feature[at]
                done = live & (f < 0)
                total[done] += stay[done] * path[at[done]]
                live &= f >= 0
                at = np.where(live, np.where(x[rows, np.maximum(f, 0)] < cutoff[at], left[at], right[at]), at)
                step += 1
        return 2.0 ** (-total / len(self.trees) / max(self._mean_path(self.size), 1e-9))


def calibrate(at: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false: float = MAX_FALSE_REJECT) -> float:
    """Threshold above which a row is rejected: most bad rows, among those that reject few good ones.

    ``at`` are the distinct scores in order, ``good`` and ``bad`` the numbers of rows with each.
    """
    if not good.sum() or not bad.sum():
        return float("inf")
    false, true = (1 - np.cumsum(n) / n.sum() for n in (good, bad))
    ok = false <= max_false
    best = np.flatnonzero(ok)[np.argmax((true - false)[ok])]  # the highest score rejects none
    # half way to the next score, so that ties fall on one side
    return float((at[best] + at[best + 1]) / 2) if best + 1 < len(at) else float(at[best])


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the base counts (long) and the array ``rule_stats``; null texts have no words."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, rule_stats array<double>")
    def stats(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            both = [statistics(x) for x in s]
            p = pd.DataFrame([b for b, _ in both], columns=BASE, dtype="int64")
            p["rule_stats"] = [x for _, x in both]
            yield p

    no_clash(docs, [*BASE, "rule_stats"])
    s = free_name(docs, "__s")
    return docs.withColumn(s, stats(F.coalesce(F.col(text_col), F.lit("")))).select(*docs.columns, f"{s}.*")


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_verdicts(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Append base counts, base_failed, anomaly (double, null where the base rules fail) and kept.

    Null texts have no words and fail the base rules. Without labelled rows, or
    with labels of one kind only, the forest rejects nothing. Of several labels
    of an id the lowest counts; null ids have no label. Repeated rows are judged
    each; long texts are read whole. Rows with the threshold's own score are
    kept. Other columns are kept, the appended names must not be among them. An
    empty table gives no rows.

    All labelled rows set the threshold, by counts of each score (scores have
    ``DIGITS`` digits, which bounds what reaches the driver). The trees are fitted
    on the good rows of the smallest seeded hashes, as many as all trees can hold.
    """
    no_clash(docs, ["base_failed", "anomaly", "kept"])
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and l_id is not null")
    lab = lab.groupBy("l_id").agg(F.min("y").alias("y"))
    # Statistics first, so that no text is shuffled should the labels be too many to broadcast.
    rows = text_statistics(docs.select("doc_id", text_col), text_col).filter(~base_failed()).select("doc_id", "rule_stats")
    rows = cut(rows.join(lab, F.col("doc_id") == F.col("l_id")).select("l_id", "y", "rule_stats"))
    sample = rows.filter("y = 1").orderBy(F.xxhash64(F.lit(SEED), "l_id"), "l_id", "rule_stats").limit(N_TREES * SUBSAMPLE).toPandas()  # a few numbers each
    forest = Forest(np.array(sample["rule_stats"].tolist())) if len(sample) else None
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value
        for s in it:
            yield pd.Series(np.round(f.score(np.array(s.tolist())), DIGITS) if f is not None and len(s) else np.zeros(len(s)), dtype="float64")

    counts = rows.groupBy(anomaly("rule_stats").alias("at")).agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).toPandas().sort_values("at")
    threshold = calibrate(counts["at"].to_numpy(), counts["good"].to_numpy(), counts["bad"].to_numpy())

    out = text_statistics(docs, text_col)
    out = out.withColumn("base_failed", base_failed()).withColumn("anomaly", anomaly("rule_stats"))
    out = out.withColumn("anomaly", F.when(~F.col("base_failed"), F.col("anomaly")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("anomaly", F.lit(0.0)) <= F.lit(threshold)))
