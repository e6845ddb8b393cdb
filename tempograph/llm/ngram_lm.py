"""Interpolated modified Kneser-Ney trigram model: counted in Spark, memory-mapped by workers.

Counting. Each task numbers its words, sorts its trigrams as numbers and emits
the distinct ones with counts, packed into one block for each shard. A shard
holds all trigrams of its middle words: so one exchange completes the trigrams'
counts, the totals of their contexts (first two words) and the continuation
counts of their last two words. A second exchange brings together what each word
needs. All of it grows with the corpus; nothing but a few totals reaches the
driver.

Balance. Middle words that would fill much of a shard (at most ``1 / FREQUENT``
of them, estimated from a sample, which affects balance only) are spread over
all shards by their left neighbour; their continuation counts are summed in the
second exchange, by the last word, and their totals go to the driver.

Texts start with one begin token, so a text's first token has a context of one
word; no word stands before the begin token, whose bigrams count as often as
they occur.

Model. Files of sorted hashes in the shared folder, one of a kind a shard,
written under a temporary name and renamed, so a task that runs again does no
harm. Within a shard n-grams are known by 40 bits of their hash: in a shard of
four million n-grams some 4 in a million unseen ones meet another's count.
Words are known by 48 bits.
Workers map the files and search them with sorted batches of queries.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import MEMO_BYTES, fold, free_name, no_clash, scratch

#: No word contains a line feed, so these are never words.
BEGIN, END = b"\n<s>", b"\n</s>"
FREQUENT = 0.0005
SHARD_BYTES = 8 << 20
FLUSH_TOKENS = 3_000_000
#: Word numbers that fit a packed trigram; a worker starts new numbers at half of them.
NUMBERS = 1 << 21
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_ROW = np.dtype([("raw", "<u8"), ("cont", "<u4"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def word_hash(w: bytes) -> int:
    """Hash of a word: 48 bits, as the upper ones of 64."""
    return xxhash.xxh64_intdigest(w) & ~0xFFFF


def mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    h = (u ^ (u >> np.uint64(31))) * _A + w
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Words:
    """Numbers of the words of texts (0 begins, 1 ends a text) and the words' hashes by number."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {BEGIN: 0, END: 1}
        self.hashes = [word_hash(BEGIN), word_hash(END)]
        self.size = 0

    def full(self) -> bool:
        return self.size > self.most or len(self.hashes) > NUMBERS // 2

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, each text closed by the end token, and the texts' lengths in tokens."""
        known, hashes, flat, sizes = self.known, self.hashes, [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            try:
                flat += [known[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = len(hashes)
                        hashes.append(word_hash(w))
                        self.size += len(w) + 200
                flat += [known[w] for w in words]
            flat.append(1)
            sizes.append(len(words) + 1)
        return np.array(flat, np.int32), np.array(sizes, np.int64)


def left_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's second and first left neighbour; the begin token where there is none."""
    u, v = np.zeros_like(tokens), np.zeros_like(tokens)
    first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    v[1:], u[2:] = tokens[:-1], tokens[:-2]
    v[first] = u[first] = 0
    u[first[sizes > 1] + 1] = 0
    return u, v


class Sharding:
    """Shards of words, and the words whose trigrams are spread (the begin token among them)."""

    def __init__(self, shards: int, frequent: np.ndarray):
        self.shards = shards
        self.frequent = np.unique(np.r_[frequent.astype(np.uint64), np.uint64(word_hash(BEGIN))])

    def word(self, w: np.ndarray) -> np.ndarray:
        return ((w * _B) >> np.uint64(33)).astype(np.int64) % self.shards

    def place(self, v: np.ndarray) -> np.ndarray:
        """A word's place among the frequent ones, -1 for others."""
        at = np.minimum(np.searchsorted(self.frequent, v), len(self.frequent) - 1)
        return np.where(self.frequent[at] == v, at, -1)

    def trigram(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shard of trigrams: by middle word, frequent ones by first and middle, first tokens by themselves."""
        begin = v == np.uint64(word_hash(BEGIN))
        key = np.where(begin, w, np.where(self.place(v) >= 0, mix(u, v), v))
        return self.word(key)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of the values over each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return (k[at], *(np.add.reduceat(v[order], at) for v in values))


def _cuts(s: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(s)]))


def _bytes(c: np.ndarray) -> bytes:
    """Counts as bytes, with those above 254 behind them."""
    big = np.flatnonzero(c > 254)
    return b"".join(x.tobytes() for x in (np.array([len(c), len(big)], "<u4"), big.astype("<u4"), c[big].astype("<u8"), np.minimum(c, 255).astype("u1")))


def _hash_bytes(h: np.ndarray) -> bytes:
    """Word hashes in ascending order, about five bytes each: steps of the upper 16 bits, and 32 bits."""
    upper = (h >> np.uint64(48)).astype(np.int64)
    return _bytes(np.diff(upper, prepend=0)) + (h >> np.uint64(16)).astype("<u4").tobytes()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str, k: int) -> np.ndarray:
        x = np.frombuffer(self.data, kind, k, self.at)
        self.at += x.nbytes
        return x

    def counts(self) -> np.ndarray:
        n, n_big = self.take("<u4", 2)
        big, values = self.take("<u4", n_big), self.take("<u8", n_big)
        c = self.take("u1", n).astype(np.int64)
        c[big] = values
        return c

    def hashes(self) -> np.ndarray:
        upper = np.cumsum(self.counts()).astype(np.uint64)
        return (upper << np.uint64(48)) | (self.take("<u4", len(upper)).astype(np.uint64) << np.uint64(16))


def _pack(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, hashes: np.ndarray) -> bytes:
    """Block of trigrams in order of their middle words: the block's word hashes once, then places among them."""
    words, place = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    kind, n = ("<u2" if len(words) <= 1 << 16 else "<u4"), len(u)
    order = np.argsort(hashes[words])
    rank = np.empty(len(words), kind)
    rank[order] = np.arange(len(words))
    place = rank[place]
    runs = _cuts(v)
    at = np.array([a for a, _ in runs], np.int64)
    head = np.array([len(words), n, len(runs)], "<u4")
    return b"".join([head.tobytes(), _hash_bytes(hashes[words[order]]), place[n : 2 * n][at].tobytes(), _bytes(np.diff(np.r_[at, n])), place[:n].tobytes(), place[2 * n :].tobytes(), _bytes(c)])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = _Reader(data)
    n_words, n, n_runs = r.take("<u4", 3)
    kind = "<u2" if n_words <= 1 << 16 else "<u4"
    words, v = r.hashes(), r.take(kind, n_runs)
    v = np.repeat(v, r.counts())
    u, w = r.take(kind, n), r.take(kind, n)
    return words[u], words[v], words[w], r.counts()


def _fs(uri: str):
    from pyarrow import fs

    p = urlparse(uri)
    return (fs.LocalFileSystem(), p.path) if p.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def _write(uri: str, *arrays: np.ndarray) -> None:
    f, path = _fs(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    with f.open_output_stream(temp) as out:
        for a in arrays:
            out.write(a.tobytes())
    f.move(temp, path)


#: Kinds of tables: the row that most have, which needs no counts, and the bits of a hash kept beyond 32.
TABLES = {"trigrams": ((1,), 8), "contexts": ((1, 1, 0, 0), 8), "conts": ((1,), 8), "hot": ((1,), 8), "words": ((1, 1, 1, 1, 0, 0), 16)}


def _lower(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(32 - bits)).astype(f"<u{bits // 8}")


def _write_table(path: str, kind: str, shard: int, h: np.ndarray, cols: list[np.ndarray]) -> None:
    """Sorted hashes with counts; rows that equal the kind's most frequent one are hashes only."""
    plain, bits = TABLES[kind]
    order = np.argsort(h)
    h, cols = h[order], [c[order] for c in cols]
    is_plain = np.logical_and.reduce([c == x for c, x in zip(cols, plain)])
    out = [np.array([is_plain.sum(), (~is_plain).sum()], "<u8")]
    keys = [h[is_plain], h[~is_plain]]
    out += [(k >> np.uint64(32)).astype("<u4") for k in keys]
    out += [_lower(k, bits) for k in keys]
    _write(f"{path}/{kind}-{shard}", *out, *(np.frombuffer(_bytes(c[~is_plain]), "u1") for c in cols))


class _Table:
    def __init__(self, raw: np.ndarray, kind: str):
        r, (plain, self.bits) = _Reader(raw), TABLES[kind]
        sizes = [int(x) for x in r.take("<u8", 2)]
        hi = [r.take("<u4", n) for n in sizes]
        lo = [r.take(f"<u{self.bits // 8}", n) for n in sizes]
        self.keys, self.plain, self.cols = list(zip(hi, lo)), plain, []
        for _ in plain:
            n, n_big = (int(x) for x in r.take("<u4", 2))
            big, values = r.take("<u4", n_big), r.take("<u8", n_big)
            self.cols.append((r.take("u1", n), big, values))

    @staticmethod
    def _match(keys: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        have, low = keys
        out = np.full(len(hi), -1, np.int64)
        if not len(have):
            return out
        at, left = np.searchsorted(have, hi), np.arange(len(hi))
        while len(left):
            left = left[at[left] < len(have)]
            left = left[have[at[left]] == hi[left]]
            hit = low[at[left]] == lo[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts of the hashes, in order, one row a column of the table; zeros where there is none."""
        hi, lo = (h >> np.uint64(32)).astype("<u4"), _lower(h, self.bits)
        out = np.zeros((len(self.plain), len(h)))
        out[:, self._match(self.keys[0], hi, lo) >= 0] = np.array(self.plain, float)[:, None]
        row = self._match(self.keys[1], hi, lo)
        hit = np.flatnonzero(row >= 0)
        for x, (small, big, values) in zip(out, self.cols):
            c = small[row[hit]].astype(float)
            e = c == 255
            c[e] = values[np.searchsorted(big, row[hit[e]])]
            x[hit] = c
        return out


#: Most files a worker keeps mapped, and bytes of remote files it keeps in memory.
MAPPED_FILES, FETCHED_BYTES = 4096, 256 << 20
_mapped: dict[str, object] = {}
_fetched = 0


def _map(uri: str, read):
    """``read`` of a model file's bytes, None if the shard has none.

    Files of a mounted folder are memory-mapped; those of other stores are read
    into memory, as many as FETCHED_BYTES allow, never onto a local disk.
    """
    global _fetched
    if uri in _mapped:
        return _mapped[uri]
    if len(_mapped) >= MAPPED_FILES or _fetched > FETCHED_BYTES:
        _mapped.clear()
        _fetched = 0
    p = urlparse(uri)
    raw = np.zeros(0, "u1")
    if p.scheme in ("", "file"):
        if os.path.exists(p.path) and os.path.getsize(p.path):
            raw = np.memmap(p.path, "u1", "r")
    else:
        from pyarrow import fs

        f, remote = _fs(uri)
        if f.get_file_info(remote).type != fs.FileType.NotFound:
            with f.open_input_stream(remote) as src:
                raw = np.frombuffer(src.read(), "u1")
            _fetched += len(raw)
    _mapped[uri] = read(raw) if len(raw) else None
    return _mapped[uri]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; fixed ones where the corpus has none."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(x, 0.05), i + 0.95)) for i, x in enumerate(d))


class Model:
    """A counted model: totals, the frequent words' totals, and where its shards lie."""

    def __init__(self, path: str, sharding: Sharding, totals: dict[str, int], hot: np.ndarray, d3: tuple, d2: tuple, d1: tuple):
        self.path, self.sharding, self.hot, self.d3, self.d2, self.d1 = path, sharding, hot, d3, d2, d1
        self.tokens, self.vocab, self.pairs = totals["tokens"], totals["vocab"], totals["pairs"]
        g = d1[0] * totals["c1"] + d1[1] * totals["c2"] + d1[2] * totals["c3"]
        self.rest = g / self.pairs if self.pairs else 1.0

    def _by_shard(self, shard: np.ndarray, h: np.ndarray):
        order = np.argsort((shard.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        for a, b in _cuts(shard[order]):
            yield int(shard[order[a]]), order[a:b]

    def words(self, h: np.ndarray) -> np.ndarray:
        """Rows of words, with the totals of frequent ones; zeros for unknown words."""
        out = np.zeros(len(h), _WORD_ROW)
        for name, x in zip(_WORD_ROW.names, self._counts("words", self.sharding.word(h), h)):
            out[name] = x
        place = self.sharding.place(h)
        for j, name in enumerate(("total", "n1", "n2", "n3")):
            out[name][place >= 0] = self.hot[place[place >= 0], j]
        return out

    def _counts(self, kind: str, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(TABLES[kind][0]), len(h)))
        for s, at in self._by_shard(shard, h):
            if (t := _map(f"{self.path}/{kind}-{s}", lambda raw: _Table(raw, kind))) is not None:
                out[:, at] = t.find(h[at])
        return out

    def token_scores(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each token w after u and v: numbers of words with these hashes and rows."""

        def level(c, total, n, d, below):
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            d = np.array([0.0, *d])
            p = (np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) + (d[1] * n[0] + d[2] * n[1] + d[3] * n[2]) * below) / safe
            return np.where(seen, p, below)

        d1 = np.array([0.0, *self.d1])
        cont = rows["cont"].astype(np.float64)
        p = (np.maximum(cont - d1[np.minimum(cont, 3).astype(int)], 0) / max(self.pairs, 1) + self.rest / (self.vocab + 1))[w]
        frequent = self.sharding.place(hashes) >= 0
        of = self.sharding.word(hashes)
        two = mix(hashes[v], hashes[w])
        a = np.zeros(len(w))
        hot = frequent[v]
        for name, on, shard in (("hot", hot, of[w]), ("conts", ~hot, of[v])):
            i = np.flatnonzero(on)
            a[i] = self._counts(name, shard[i], two[i])[0]
        p = level(a, rows["total"][v].astype(np.float64), [rows[x][v].astype(np.float64) for x in ("n1", "n2", "n3")], self.d2, p)
        i = np.flatnonzero(v != 0)  # a first token has no third word
        context = mix(hashes[u[i]], hashes[v[i]])
        shard = np.where(hot[i], self.sharding.word(context), of[v[i]])
        total, *n = self._counts("contexts", shard, context)
        c = np.zeros(len(i))
        known = np.flatnonzero(total > 0)
        c[known] = self._counts("trigrams", shard[known], mix(context[known], hashes[w[i[known]]]))[0]
        p[i] = level(c, total, n, self.d3, p[i])
        return np.log10(p)


def _frequent_words(train: DataFrame, share: float) -> np.ndarray:
    """Hashes of words that make up at least ``share`` of a sample's tokens, with the begin token."""

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Words()
        for b in it:
            t, _ = to(b.column(0).to_pylist())
            n = np.bincount(t, minlength=len(to.hashes))
            top = np.flatnonzero(n >= max(2, share * len(t) / 2))
            h = np.array(to.hashes, np.uint64)[top].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[top]), pa.array([len(t)] * len(top), pa.int64())], ["w", "n", "of"])
            if to.full():
                to.clear()

    got = train.sample(0.02, 7).select("text").mapInArrow(words, "w long, n long, of long").groupBy("w").agg(F.sum("n").alias("x"))
    rows = got.orderBy(F.desc("x")).limit(int(1 / FREQUENT)).collect()
    return np.array([r["w"] for r in rows], np.int64).view(np.uint64)


def _shard_count(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown, as for rows made in memory
        return max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(4, -(-size // SHARD_BYTES))


def train_model(train: DataFrame, path: str, frequent_share: float | None = None) -> Model:
    """Count the texts of ``train`` (column text) into a model below ``path``.

    Words of at least ``frequent_share`` of a sample's tokens are spread over all
    shards; by default, those that would fill a tenth of one.
    """
    n = _shard_count(train)
    sharding = Sharding(n, _frequent_words(train, max(FREQUENT, 0.1 / n) if frequent_share is None else frequent_share))
    start = np.uint64(word_hash(BEGIN))

    def blocks(parts: list[tuple[np.ndarray, ...]], hashes: list[int]) -> Iterator[pa.RecordBatch]:
        u, v, w = (np.concatenate(x).astype(np.uint64) for x in zip(*parts))
        h = np.array(hashes, np.uint64)
        if len(h) <= NUMBERS:
            bits, low = np.uint64(21), np.uint64(NUMBERS - 1)
            key = np.sort((v << (bits + bits)) | (u << bits) | w)
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            c, key = np.diff(np.r_[at, len(key)]), key[at]
            u, v, w = ((x & low).astype(np.int32) for x in (key >> bits, key >> (bits + bits), key))
            del key
        else:
            order = np.lexsort((w, u, v))
            u, v, w = (x[order].astype(np.int32) for x in (u, v, w))
            at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            c = np.diff(np.r_[at, len(u)])
            u, v, w = u[at], v[at], w[at]
        s = sharding.trigram(h[u], h[v], h[w])
        order = np.argsort(s.astype(np.uint16) if sharding.shards <= 1 << 16 else s, kind="stable")
        s = s[order]
        for a, b in _cuts(s):
            i = order[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(s[a])], pa.int32()), pa.array([_pack(u[i], v[i], w[i], c[i], h)])], ["shard", "data"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, parts, size = Words(), [], 0
        for b in it:
            for a in range(0, b.num_rows, 256):
                t, sizes = to(b.column(0).slice(a, 256).to_pylist())
                parts.append((*left_of(t, sizes), t))
                size += len(t)
                if size >= FLUSH_TOKENS or to.full():
                    yield from blocks(parts, to.hashes)
                    parts, size = [], 0
                    if to.full():
                        to.clear()
        if size:
            yield from blocks(parts, to.hashes)

    names = ["kind", "shard", "rows", "n", "data"]

    def row(kind: str, s: int, rows: int, counts: list[int] | None, data: bytes | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([s], pa.int32()), pa.array([rows], pa.int64()), pa.array([counts], pa.list_(pa.int64())), pa.array([data], pa.binary())], names)

    def tally(c: np.ndarray) -> list[int]:
        return [int((c == k).sum()) for k in (1, 2, 3, 4)]

    def by_count(c: np.ndarray) -> list[np.ndarray]:
        return [(c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64)]

    def reduce_trigrams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for b in it:
            for s, d in zip(b.column(0).to_pylist(), b.column(1)):
                got.setdefault(s, []).append(d.as_buffer().to_pybytes())
        for s in sorted(got):
            u, v, w, c = (np.concatenate(x) for x in zip(*[_unpack(d) for d in got.pop(s)]))
            h = mix(mix(u, v), w)
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            c, h, order = np.add.reduceat(c[order], at), h[at], order[at]
            u, v, w = u[order], v[order], w[order]
            del order, at
            real = v != start
            if real.any():
                _write_table(path, "trigrams", s, h[real], [c[real]])
                key, *stats = _sum_by(mix(u[real], v[real]), c[real], *by_count(c[real]))
                _write_table(path, "contexts", s, key, stats)
            yield row("trigrams", s, int(real.sum()), tally(c[real]))
            del h, u
            # Bigrams of the last two words: how many words stand before them; of first tokens, how often they occur.
            two = mix(v, w)
            order = np.argsort(two)
            two = two[order]
            at = np.flatnonzero(np.r_[True, two[1:] != two[:-1]])
            a = np.add.reduceat(np.where(real, 1, c)[order], at)
            raw = np.add.reduceat(c[order], at)
            two, v, w = two[at], v[order[at]], w[order[at]]
            place = sharding.place(v)
            own = place < 0
            if own.any():
                _write_table(path, "conts", s, two[own], [a[own]])
            yield row("conts", s, int(own.sum()), tally(a[own]))
            left, *totals = _sum_by(v[own], a[own], *by_count(a[own]))
            right, raw, conts = _sum_by(w, raw, own.astype(np.int64))
            z = np.zeros
            cols = [np.r_[x, z(len(left), np.int64)] for x in (raw, conts)] + [np.r_[z(len(right), np.int64), x] for x in totals]
            key, *cols = _sum_by(np.r_[right, left], *cols)
            to = sharding.word(key)
            order = np.argsort(to, kind="stable")
            for x, y in _cuts(to[order]):
                i = order[x:y]
                yield row("word", int(to[i[0]]), len(i), None, _hash_bytes(key[i]) + b"".join(_bytes(k[i]) for k in cols))
            spread = np.flatnonzero(~own)
            to = sharding.word(w[spread])
            order = np.lexsort((w[spread], to))
            for x, y in _cuts(to[order]):
                i = spread[order[x:y]]
                yield row("spread", int(to[order[x]]), len(i), None, _hash_bytes(w[i]) + place[i].astype("<u2").tobytes() + _bytes(a[i]))

    def reduce_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, dict[str, list]] = {}
        for b in it:
            for kind, s, k, t, d in zip(*(b.column(x).to_pylist() for x in names)):
                if kind in ("word", "spread"):
                    got.setdefault(s, {"word": [], "spread": []})[kind].append((k, d))
                else:
                    yield row(kind, s, k, t)
        for s in sorted(got):
            parts = got.pop(s)
            keys, cols = [], [[] for _ in _WORD_ROW.names]
            for k, d in parts["word"]:
                r = _Reader(d)
                keys.append(r.hashes())
                for x in cols:
                    x.append(r.counts())
            pairs = []
            for k, d in parts["spread"]:
                r = _Reader(d)
                pairs.append((r.hashes(), r.take("<u2", k), r.counts()))
            if pairs:
                w, place, a = (np.concatenate(x) for x in zip(*pairs))
                two = mix(sharding.frequent[place], w)
                order = np.argsort(two)
                two = two[order]
                at = np.flatnonzero(np.r_[True, two[1:] != two[:-1]])
                a, two, w, place = np.add.reduceat(a[order], at), two[at], w[order[at]], place[order[at]]
                _write_table(path, "hot", s, two, [a])
                yield row("conts", s, len(a), tally(a))
                hot, *stats = _sum_by(place, a, *by_count(a))
                for i, x in zip(hot.tolist(), zip(*(x.tolist() for x in stats))):
                    yield row("hot", i, 0, list(x))
                w, more = _sum_by(w, np.ones(len(w), np.int64))
                keys.append(w)
                for name, x in zip(_WORD_ROW.names, cols):
                    x.append(more if name == "cont" else np.zeros(len(w), np.int64))
            key, *sums = _sum_by(np.concatenate(keys), *(np.concatenate(x) for x in cols))
            _write_table(path, "words", s, key, sums)
            raw, cont = sums[0], sums[1]
            yield row("words", s, len(key), [int(raw.sum()), int((raw > 0).sum()), int(cont.sum()), int((cont >= 3).sum()), *tally(cont)])

    out = "kind string, shard int, rows long, n array<long>, data binary"
    # One shard a task: the shard's number is the partition's.
    trigrams = train.select("text").mapInArrow(count, "shard int, data binary").repartitionById(n, F.col("shard")).mapInArrow(reduce_trigrams, out)
    words = trigrams.repartitionById(n, F.col("shard")).mapInArrow(reduce_words, out)
    place = F.when(F.col("kind") == "hot", F.col("shard")).otherwise(-1)
    sums = words.groupBy("kind", place.alias("place")).agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(8)]).collect()  # one row a kind and frequent word
    hot, got = np.zeros((len(sharding.frequent), 4), np.int64), {}
    for r in sums:
        x = [int(r[f"n{i}"] or 0) for i in range(8)]
        if r["kind"] == "hot":
            hot[r["place"]] = x[:4]
        else:
            got[r["kind"]] = x
    w = got.get("words", [0] * 8)
    totals = {"tokens": w[0], "vocab": w[1], "pairs": w[2], "c1": w[4], "c2": w[5], "c3": w[3]}
    return Model(path, sharding, totals, hot, *(discounts(got.get(k, [0] * 4)[:4]) for k in ("trigrams", "conts")), discounts(w[4:8]))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append n_tokens, n_known, train_tokens (long), base_score and score (double)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # totals and at most 1 / FREQUENT words

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, to = shared.value, Words()
        hashes, rows = np.zeros(0, np.uint64), np.zeros(0, _WORD_ROW)
        for s in it:
            out = []
            for a in range(0, len(s), 1024):
                w, sizes = to(s.iloc[a : a + 1024].tolist())
                new = np.array(to.hashes[len(hashes) :], np.uint64)
                hashes, rows = np.r_[hashes, new], np.r_[rows, m.words(new)]
                raw = rows["raw"].astype(np.float64)
                logp, at = m.token_scores(*left_of(w, sizes), w, hashes, rows), np.r_[0, np.cumsum(sizes)[:-1]]
                base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.vocab + 1)))[w]
                out.append(pd.DataFrame({"n_tokens": sizes, "n_known": np.add.reduceat((raw > 0).astype(np.int64)[w], at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logp, at)}))
                if to.full():
                    to.clear()
                    hashes, rows = np.zeros(0, np.uint64), np.zeros(0, _WORD_ROW)
            yield pd.concat(out) if out else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})

    no_clash(docs, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    c = free_name(docs, "__s")
    found = docs.withColumn(c, scored(F.coalesce(F.col(text_col), F.lit(""))))
    return found.select(*docs.columns, f"{c}.n_tokens", f"{c}.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), f"{c}.base_score", f"{c}.score")


def lm_scores(docs: DataFrame, spark: SparkSession, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Score all texts with a model of those whose crc32 fold is not ``held_fold``; adds held_out.

    Null and empty texts are the end token alone. Repeated rows are counted and
    scored each. With no training text every token has probability 1. Perplexity
    is ``10 ** (-score / n_tokens)``. Long texts are read whole. Other columns are
    kept, the appended names must not be among them. An empty table gives no rows.
    """
    no_clash(docs, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    train = docs.filter(fold("doc_id", folds) != held_fold).select("text")
    model = train_model(train, scratch(spark, "kn"))
    return score_texts(docs.withColumn("held_out", fold("doc_id", folds) == held_fold), model)
