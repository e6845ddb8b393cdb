"""Exact Jaccard similarity join of word-shingle sets by PartEnum signatures.

Sizes are split into bands so that a set's partner lies in its own band or a
neighbouring one; a set gets the signatures of two instances, its own band's and
the next. In an instance, sets that are similar enough differ in at most k
features. Up to ``SUBSET_K`` the feature domain is cut into ``k + 2`` parts and
each pair of parts makes a signature, of which one at least holds no differing
feature. Beyond, subsets of more than one part cost more signatures than their
selectivity saves, so of ``k + 1 + e`` parts each makes a signature, and similar
sets agree on at least ``e + 1``. Sets with at most e empty parts need no
signature for empty ones; the rare others enumerate those as well.

The surplus e also removes the crowded groups without losing a pair: in one
order of all signatures, by size of group, each set leaves its e largest (less
its empty parts), and the smallest of the e + 1 shared ones stays on both sides.

Signature groups are never expanded into pairs. All members are held against the
group's smallest member first, through parity sketches (a lower bound on the
symmetric difference) and then exactly. Groups whose members are by then in one
component are done; in the others, only members of different components are
still compared, by their whole sets in blocks of bounded size. What is exact:
every pair that shares a signature is linked, refuted, or already connected.

Skew: of the most frequent equal sets one copy is signed and the others take its
label; signatures frequent in a sample are dealt to several tasks; joins on hot
keys are salted. These lists are of bounded length and affect balance only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.common import MEMO_BYTES, SALTS, cut, cut_some, free, free_name, hot_keys, small_batches, spread_join, stable

WORDS = 5
PERCENT = 80
BLOCK = 1024
#: Most features on a block's side, as far as single sets allow.
BLOCK_FEATURES = 1 << 20
FILTER_WORDS = 1 << 17
#: Up to so many differing features, pairs of parts are enumerated.
SUBSET_K = 3
#: Part of k by which the number of parts exceeds k + 1.
SURPLUS = 8
#: Most equal sets that are signed once for all their copies, and most signatures that are dealt to several tasks.
HEAVY_SETS, HEAVY_SIGNATURES = 20_000, 10_000
#: Rows read of each sampled partition, and partitions sampled at least (one in 50 of many).
SAMPLE_ROWS, SAMPLE_PARTITIONS = 250, 8
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashes of the n-word shingles of whole texts, ascending."""

    def __init__(self, n: int, most: int = MEMO_BYTES // 3):
        self.n, self.most, self.size, self.known = n, most, 0, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if self.size > self.most:
            known.clear()
            self.size = 0
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
                    self.size += len(w) + 150
            ids = [known[w] for w in words]
        w = np.array(ids, np.uint64)
        n = min(self.n, len(w))
        h = w[: len(w) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _A + w[k : len(w) - n + 1 + k]
        h = np.sort(_mix(h))
        return h[np.r_[True, h[1:] != h[:-1]]]


class Bands:
    """Size bands for a threshold of ``percent`` / 100, and each band's most differing features."""

    def __init__(self, percent: int):
        self.percent = percent
        self.last = [0]  # last size of each band; band 0 is empty

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            self.last.append(low * 100 // self.percent)
        return int(np.searchsorted(self.last, size))

    def parts(self, band: int) -> tuple[int, int, int]:
        """(most differing features k, number of parts, surplus e) of a band's instance."""
        while len(self.last) <= band:
            self.of(self.last[-1] + 1)
        k = 2 * self.last[band] * (100 - self.percent) // (100 + self.percent)
        if k <= SUBSET_K:
            return k, k + 2 if k else 1, 0
        e = max(2, k // SURPLUS)
        return k, k + 1 + e, e

    def of_parts(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts (of n) that ascending hashes fall into, and where each begins."""
        part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return part[at], at

    def spare(self, h: np.ndarray) -> tuple[int, int]:
        """How many of its largest groups a set may leave, in its instance of even and of odd number."""
        out, band = [0, 0], self.of(len(h))
        for j in (band, band + 1):
            _, n, e = self.parts(j)
            if e:
                out[j & 1] = max(0, e - (n - len(self.of_parts(h, n)[0])))
        return out[0], out[1]


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of one set, for the instance of its own band and the next; the last bit is the instance's."""
    band, out = bands.of(len(h)), []
    mixed = _mix(h + _A)
    for j in (band, band + 1):
        k, n, e = bands.parts(j)
        p, at = bands.of_parts(h, n)
        total = np.add.reduceat(mixed, at)
        if 0 < k <= SUBSET_K:
            sums = np.zeros(n, np.uint64)
            sums[p.astype(np.int64)] = total
            a, b = np.array(list(itertools.combinations(range(n), 2))).T
            p, total = (a * n + b).astype(np.uint64), _mix(sums[a] + _A) + sums[b]
        elif n - len(at) > e:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), p)
            p, total = np.r_[p, empty], np.r_[total, np.zeros(len(empty), np.uint64)]
        sig = _mix(total + _mix(p * _A + np.uint64(j)))
        out.append((sig & ~np.uint64(1)) | np.uint64(j & 1))
    return np.concatenate(out)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the features falling on each of one to two times as many bits, a power of two."""
    bits = max(64, 1 << int(len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sums(h: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are known."""
    return (int(_mix(h).sum()) & (2**63 - 1), int(_mix(h ^ _C).sum()) & (2**63 - 1)) if len(h) else (0, 0)


def _list(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _sized(a: Column, b: Column, percent: int) -> Column:
    """Can sets of sizes a and b be similar at all?"""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _apart(a: Column, b: Column) -> Column:
    """Lower bound on the symmetric difference from two sketches; the longer one is folded."""

    def fold(x: Column, y: Column) -> Column:
        n = F.size(y)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches of one width for the sets h[at[k]:at[k + 1]], about eight bits a feature."""
    rows = len(at) - 1
    bits = max(64, 8 << int(len(h) // rows).bit_length())
    x, step = np.empty((rows, bits // 64), np.uint64), max(1, (1 << 22) // bits)
    for s in range(0, rows, step):
        e = min(rows, s + step)
        row = np.repeat(np.arange(e - s), np.diff(at[s : e + 1]))
        odd = np.bincount(row * bits + (h[at[s] : at[e]] & np.uint64(bits - 1)).astype(np.int64), minlength=(e - s) * bits) & 1
        x[s:e] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(e - s, -1)
    return x


def near_rows(t: pa.Table, percent: int) -> np.ndarray:
    """Which rows of a block have one of the other side, in another component, that sizes and sketches allow."""
    root, n, side = (t.column(c).to_numpy() for c in ("root", "n", "side"))
    lists = t.column("sketch").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy()
    at, flat, width = np.r_[0, np.cumsum(size)], lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), int(size.min())
    x = np.stack([np.bitwise_xor.reduce(flat[at[r] : at[r + 1]].reshape(-1, width), axis=0) for r in range(len(size))])
    right, on = np.flatnonzero(side == 1), np.zeros(len(size), bool)
    for r in np.flatnonzero(side == 0):
        c = right[(root[right] != root[r]) & (100 * np.minimum(n[right], n[r]) >= percent * np.maximum(n[right], n[r]))]
        d = np.bitwise_count(x[c] ^ x[r]).sum(1, dtype=np.int64)
        c = c[(100 + percent) * d <= (100 - percent) * (n[c] + n[r])]
        on[c] = True
        on[r] = len(c) > 0
    return on


def joining_links(t: pa.Table, percent: int, step: int = 64) -> pa.RecordBatch:
    """Links (a, b) of a block that join components: rows of side 0 against those of side 1, nearest sketches first."""
    uid, root, side = (t.column(c).to_numpy() for c in ("uid", "root", "side"))
    lists = t.column("h").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy().astype(np.int64)
    at = np.r_[0, np.cumsum(n)]
    h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    root, x, right = root.copy(), _parities(h, at), np.flatnonzero(side == 1)
    found: list[tuple[int, int]] = []
    for r in np.flatnonzero(side == 0):
        c = right[(root[right] != root[r]) & (100 * np.minimum(n[right], n[r]) >= percent * np.maximum(n[right], n[r]))]
        if not len(c):
            continue
        d = np.bitwise_count(x[c] ^ x[r]).sum(1, dtype=np.int64)
        near = (100 + percent) * d <= (100 - percent) * (n[c] + n[r])
        c = c[near][np.argsort(d[near], kind="stable")]
        own = h[at[r] : at[r + 1]]
        while len(c):
            now, c = c[:step], c[step:]
            flat = np.concatenate([h[at[k] : at[k + 1]] for k in now])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(n[now])[:-1]])
            for k in now[100 * both >= percent * (n[now] + n[r] - both)]:
                if root[k] != root[r]:
                    found.append((min(uid[k], uid[r]), max(uid[k], uid[r])))
                    root[root == root[k]] = root[r]
            c = c[root[c] != root[r]]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, label): each linked node's smallest reachable ``rank`` struct.

    ``links`` (a, b); ``nodes`` (uid, rank), rank a struct that ends in uid.
    Every round takes the smallest label among the neighbours and then the
    label's own label, so that chains shorten by half; labels only fall.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("uid")).union(links.select("b", "a")).distinct())
    ends = both.select(F.col("node").alias("uid")).distinct()
    hubs = hot_keys(both, ["uid"])
    state = cut(nodes.join(ends, "uid", "left_semi").select("uid", F.col("rank").alias("label")))
    hot: list[int] = []  # at first every label is its row's own
    while True:
        told = spread_join(both, state, ["uid"], ["node"], hot=hubs).select(F.col("node").alias("uid"), "label")
        # A row's own label comes along as ``old``, so that nothing is joined again to see what moved.
        low = state.withColumn("old", F.col("label")).unionByName(told, allowMissingColumns=True)
        low = low.groupBy("uid").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        to = state.select(F.col("uid").alias("root"), F.col("label").alias("jump"))
        new = spread_join(low.withColumn("root", F.col("label.uid")), to, ["root"], ["uid"], "left", hot)
        new = new.select("uid", F.least("label", F.coalesce("jump", "label")).alias("label"), "old")
        new, moved = cut_some(new, F.col("label") != F.col("old"))
        free(state)
        state = new.select("uid", "label")
        if not moved:
            free(both)
            return state
        hot = hot_keys(state.select(F.col("label.uid").alias("root")), ["root"])


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int):
        self.words, self.percent, self.block = words, percent, block
        self.docs = stable(docs)
        self.base = self.docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def _info(self) -> DataFrame:
        """Size, 128-bit sum, sketch and spare signatures of every set."""
        words, percent = self.words, self.percent

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to, bands = Shingler(words), Bands(percent)
            for b in it:
                uid, ids, texts = b.columns
                for at in range(0, len(texts), 2048):
                    sets = [to(t.as_py()) for t in texts.slice(at, 2048)]
                    sums, spare = [_sums(h) for h in sets], [bands.spare(h) if len(h) else (0, 0) for h in sets]
                    longs = [[len(h) for h in sets], *zip(*sums), *zip(*spare)] if sets else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [uid.slice(at, 2048), ids.slice(at, 2048), *(pa.array(x, pa.int64()) for x in longs), _list([sketch(h) for h in sets])],
                        ["uid", "doc_id", "n", "h1", "h2", "spare0", "spare1", "sketch"],
                    )

        return self.base.mapInArrow(run, "uid long, doc_id long, n long, h1 long, h2 long, spare0 long, spare1 long, sketch array<long>")

    def _signed(self, copies: dict[tuple[int, int, int], int], heavy: np.ndarray | None) -> DataFrame:
        """(sig, uid, salt): a row for each signature; heavy ones are dealt out by ``salt`` from 1, others have 0.

        Of equal sets in ``copies`` the named row alone is signed. Without
        ``heavy``, the signatures of a sample of partitions, uncounted.
        """
        words, percent, sampled = self.words, self.percent, heavy is None
        shared = self.docs.sparkSession.sparkContext.broadcast((copies, np.sort(heavy) if heavy is not None else np.zeros(0, np.int64)))
        step = max(1, min(50, self.base.rdd.getNumPartitions() // SAMPLE_PARTITIONS)) if sampled else 1

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if TaskContext.get().partitionId() % step:
                return
            to, bands, (copies, heavy) = Shingler(words), Bands(percent), shared.value
            seen = 0
            for b in it:
                if sampled:
                    b = b.slice(0, SAMPLE_ROWS - seen)
                    seen += b.num_rows
                for at in range(0, b.num_rows, 1024):
                    own, sigs = [], []
                    for u, t in zip(b.column(0).slice(at, 1024).to_pylist(), b.column(2).slice(at, 1024)):
                        h = to(t.as_py())
                        if len(h) and (not copies or copies.get((len(h), *_sums(h)), u) == u):
                            own.append(u)
                            sigs.append(signatures(h, bands).view(np.int64))
                    if own:
                        sig, uid = np.concatenate(sigs), np.repeat(np.array(own, np.int64), [len(x) for x in sigs])
                        salt = np.zeros(len(sig), np.int32)
                        if len(heavy):
                            on = heavy[np.minimum(np.searchsorted(heavy, sig), len(heavy) - 1)] == sig
                            salt[on] = 1 + ((uid[on].view(np.uint64) * _B) >> np.uint64(33)).astype(np.int64) % SALTS
                        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(uid), pa.array(salt)], ["sig", "uid", "salt"])
                if sampled and seen >= SAMPLE_ROWS:
                    return

        return self.base.mapInArrow(run, "sig long, uid long, salt int")

    def _members(self, info: DataFrame, copies: dict[tuple[int, int, int], int]) -> DataFrame:
        """(sig, uid, salt, g, pivot): the groups that remain once each set has left its largest ones."""
        often = self._signed(copies, None).groupBy("sig").agg(F.count("*").alias("c")).filter("c > 20").orderBy(F.desc("c")).limit(HEAVY_SIGNATURES)
        heavy = often.select("sig").toArrow().column("sig").to_numpy()  # HEAVY_SIGNATURES at most
        group = Window.partitionBy("sig", "salt")
        m = self._signed(copies, heavy).withColumn("g", F.count("*").over(group)).filter("g > 1 or salt > 0")
        # One order of all groups, heavy ones first: each set leaves the first ones, as many as it can spare.
        m = m.join(info.select("uid", "spare0", "spare1"), "uid").withColumn("odd", F.col("sig").bitwiseAND(F.lit(1)))
        first = Window.partitionBy("uid", "odd").orderBy((F.col("salt") == 0), F.when(F.col("salt") == 0, -F.col("g")), "sig")
        m = m.withColumn("k", F.row_number().over(first)).filter(F.col("k") > F.when(F.col("odd") == 0, F.col("spare0")).otherwise(F.col("spare1")))
        m = m.select("sig", "uid", "salt", F.count("*").over(group).alias("g"), F.min("uid").over(group).alias("pivot")).filter("g > 1 or salt > 0")
        m = cut(m)
        if len(heavy):
            whole = m.filter("salt > 0").groupBy("sig").agg(F.sum(F.lit(1)).alias("all"), F.min("pivot").alias("least"))  # HEAVY_SIGNATURES rows at most
            m = m.join(F.broadcast(whole.withColumnRenamed("sig", "h_sig")), (F.col("salt") > 0) & (F.col("sig") == F.col("h_sig")), "left")
            m = m.select("sig", "uid", "salt", F.coalesce("all", "g").alias("g"), F.coalesce("least", "pivot").alias("pivot")).filter("g > 1")
        return m

    def _sets(self, needed: DataFrame) -> DataFrame:
        """(uid, h): the sets of the needed documents (named once or more) and few others, by a filter of fixed size."""
        bit = F.pmod(F.xxhash64("uid"), F.lit(FILTER_WORDS * 64))
        words_ = needed.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("x"))
        table, got = np.zeros(FILTER_WORDS, np.int64), words_.toArrow()  # FILTER_WORDS rows at most
        table[got.column("w").to_numpy()] = got.column("x").to_numpy()
        shared = needed.sparkSession.sparkContext.broadcast(table)
        words = self.words

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to = Shingler(words)
            for b in it:
                bits = b.column(1).to_numpy()
                on = (shared.value[bits // 64] >> (bits % 64)) & 1
                keep = np.flatnonzero(on)
                if len(keep):
                    for at in range(0, len(keep), 1024):
                        part = b.take(pa.array(keep[at : at + 1024]))
                        yield pa.RecordBatch.from_arrays([part.column(0), _list([to(t.as_py()) for t in part.column(2)])], ["uid", "h"])

        return self.base.select("uid", bit.alias("bit"), "text").mapInArrow(run, "uid long, h array<long>")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, same) that are similar; ``same`` marks equal sets, which need no look."""
        sure = pairs.filter("same").select("a", "b")
        rest, some = cut_some(pairs.filter("not same").select("a", "b"))
        if not some:
            return sure
        sets = self._sets(rest.select(F.col("a").alias("uid")).union(rest.select(F.col("b").alias("uid"))))
        x = spread_join(rest, sets.select(F.col("uid").alias("a"), F.col("h").alias("ha")), ["a"], ["b"])
        x = x.join(sets.select(F.col("uid").alias("b"), F.col("h").alias("hb")), "b")
        x = x.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("i"))
        x = x.filter(100 * F.col("i").cast("long") >= self.percent * (F.col("na") + F.col("nb") - F.col("i")).cast("long"))
        return sure.unionByName(x.select("a", "b"))

    def _candidates(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches allow, with ``same``."""
        hot = hot_keys(pairs, ["a"])
        of_a, of_b = (info.select(F.col("uid").alias(side), *[F.col(c).alias(c + side) for c in ("n", "h1", "h2", "sketch")]) for side in ("a", "b"))
        pairs = spread_join(pairs, of_a, ["a"], ["b"], hot=hot).join(of_b, "b")
        same = (F.col("na") == F.col("nb")) & (F.col("h1a") == F.col("h1b")) & (F.col("h2a") == F.col("h2b"))
        near = (100 + self.percent) * _apart(F.col("sketcha"), F.col("sketchb")) <= (100 - self.percent) * (F.col("na") + F.col("nb"))
        return pairs.filter(_sized(F.col("na"), F.col("nb"), self.percent)).filter(same | near).select("a", "b", same.alias("same"))

    def _open(self, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
        """(sig, uid, root, major): the members of the groups that still span several components, and whether there are any."""
        m = members.join(labels.select("uid", F.col("label.uid").alias("root")), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        m = cut(m.select("sig", "uid", "root"))
        sizes = m.groupBy("sig", "root").agg(F.count("*").alias("c"))
        groups = sizes.groupBy("sig").agg(F.sum("c").alias("g"), F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"))
        # Two members were held against each other already.
        groups = groups.filter("g > 2 and most < g").select("sig", "major")
        open_ = cut_some(spread_join(m, groups, ["sig"], ["uid"]))
        free(m)
        return open_

    def _rest(self, m: DataFrame, info: DataFrame) -> DataFrame:
        """Links (a, b) between different components of open groups, exact, compared in blocks of bounded size.

        Groups with the same largest component are compared together, so a pair is
        looked at once and not for every signature it shares; of equal sets in one
        component one is taken. Only sets that a sketch finds near another are read. A block gives no more links than join its components.
        """
        percent, block = self.percent, self.block
        m = m.select(F.col("major").alias("key"), "uid", "root").distinct().join(info.select("uid", "n", "h1", "h2"), "uid")
        m = m.groupBy("key", "root", "n", "h1", "h2").agg(F.min("uid").alias("uid"))
        # Sizes that can be similar lie in one band or in neighbouring ones.
        band = F.floor(F.log("n") / max(1.0001 * math.log(100 / percent), 1e-9))
        m = cut(m.select("key", "uid", "root", "n", band.alias("band")))
        near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))
        left = m.filter(F.col("root") != F.col("key")).select("key", "uid", "root", "n", near.alias("band"), F.lit(0).alias("side"))
        m = left.unionByName(m.withColumn("side", F.lit(1)))

        def number(side: int) -> Column:
            rows, features = F.count_if(F.col("side") == side), F.sum(F.when(F.col("side") == side, F.col("n")))
            return F.greatest(F.ceil(rows / block), F.ceil(features / BLOCK_FEATURES)).cast("int")

        m = spread_join(m, m.groupBy("key", "band").agg(number(0).alias("is"), number(1).alias("js")).filter("is > 0 and js > 0"), ["key", "band"], ["uid"])
        for c, side in (("i", 0), ("j", 1)):
            own = F.array(F.pmod(F.xxhash64("uid"), F.col(c + "s")).cast("int"))
            m = m.withColumn(c, F.explode(F.when(F.col("side") == side, own).otherwise(F.sequence(F.lit(0), F.col(c + "s") - 1))))
        key = ["key", "band", "i", "j"]
        cols = [*key, "uid", "root", "side"]

        def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for b in it:
                held.append(b)
                t = pa.Table.from_batches(held)
                k = np.stack([t.column(c).to_numpy() for c in key])
                cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
                if len(cuts):
                    yield from (t.slice(s, e - s) for s, e in zip([0, *cuts[:-1]], cuts))
                    held = t.slice(cuts[-1]).combine_chunks().to_batches()
            if held:
                yield pa.Table.from_batches(held)

        def flag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in blocks(it):
                yield from t.filter(pa.array(near_rows(t, percent))).select(cols).to_batches()

        def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in blocks(it):
                yield joining_links(t, percent)

        rows = m.select(*cols, "n").join(info.select("uid", "sketch"), "uid").repartition(*key).sortWithinPartitions(*key).select(*cols, "n", "sketch")
        rows = cut(rows.mapInArrow(flag, "key long, band long, i int, j int, uid long, root long, side int"))
        rows = rows.join(self._sets(rows.select("uid")), "uid").repartition(*key).sortWithinPartitions(*key)
        return rows.mapInArrow(compare, "a long, b long").distinct()

    def _merged(self, labels: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
        """The labels after further links, which are followed between whole components."""
        for side in ("a", "b"):
            links = links.join(labels.select(F.col("uid").alias(side), F.col("label.uid").alias("r" + side)), side, "left")
        up = connected_components(links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), nodes)
        to = up.select(F.col("uid").alias("root"), F.col("label").alias("lower"))
        known = spread_join(labels.withColumn("root", F.col("label.uid")), to, ["root"], ["uid"], "left").select("uid", F.coalesce("lower", "label").alias("label"))
        merged = cut(known.unionByName(up.join(labels.select("uid"), "uid", "left_anti")))
        free(labels, up)
        return merged

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(info, labels): all documents, and the labels of the linked ones."""
        with small_batches(self.docs.sparkSession):
            return self._run()

    def _run(self) -> tuple[DataFrame, DataFrame]:
        info = cut(self._info())
        rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "uid")
        nodes = info.select("uid", rank.alias("rank"))
        equal = info.filter("n > 0").groupBy("n", "h1", "h2").agg(F.count("*").alias("c"), F.min(rank).alias("rank"))
        equal = cut(equal.filter("c > 1").orderBy(F.desc("c")).limit(HEAVY_SETS).select("n", "h1", "h2", "rank"))
        kept = equal.select("n", "h1", "h2", "rank.uid").toArrow()  # four numbers for each of HEAVY_SETS at most
        members = self._members(info, dict(zip(zip(*(kept.column(c).to_pylist() for c in ("n", "h1", "h2"))), kept.column("uid").to_pylist())))
        pairs = cut(members.filter("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct())
        near = cut(self._candidates(pairs, info))
        free(pairs)
        links = cut(self._linked(near))
        free(near)
        labels = connected_components(links, nodes)
        free(links)
        open_, some = self._open(members.filter("g > 2").select("sig", "uid"), labels)
        if some:
            rest, some = cut_some(self._rest(open_, info))
            if some:
                labels = self._merged(labels, rest, nodes)
            free(rest)
        free(open_)
        if kept.num_rows:
            one = equal.join(labels.select(F.col("uid").alias("l_uid"), "label"), F.col("rank.uid") == F.col("l_uid"), "left").select("n", "h1", "h2", F.col("rank.uid").alias("own"), F.coalesce("label", "rank").alias("label"))
            copies = info.join(F.broadcast(one), ["n", "h1", "h2"]).filter("uid <> own").select("uid", "label")
            labels = labels.unionByName(copies)
        return info, labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Sets hold the distinct ``words``-word shingles of the text with A-Z lowered;
    fewer words make one shingle of all of them, none the empty set. Two rows
    are linked if 100 * intersection >= percent * union; empty sets with none.
    component_id is the smallest id reachable over links, the row's own
    included; null ids are never smallest, and a null id without links stays
    null. Repeated rows are rows of their own. An empty table gives no rows.
    """
    info, labels = _Join(docs, id_col, text_col, words, percent, block).run()
    j = info.join(labels.select(F.col("uid").alias("l_uid"), "label"), F.col("uid") == F.col("l_uid"), "left")
    own = F.coalesce(F.nullif(F.col("label.k"), F.lit(2**63 - 1)), F.col("doc_id"))
    return j.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, without those linked to one of smaller id; of equal ids the first row stays.

    Null and empty texts are linked with nothing and stay; null ids come last, so
    a group of null ids alone keeps its first row. Repeated rows are copies of
    one another. All columns are kept, an empty table gives no rows.
    """
    join = _Join(docs, "doc_id", "text", words, percent, BLOCK)
    _, labels = join.run()
    uid = free_name(docs, "__uid")
    drop = labels.filter("label.uid <> uid").select(F.col("uid").alias(uid))
    return join.docs.withColumn(uid, F.monotonically_increasing_id()).join(drop, uid, "left_anti").drop(uid)
