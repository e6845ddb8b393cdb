"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention inside a
piece). Documents longer than a sequence are cut into full sequences; what
remains is packed in blocks (closed by documents or by tokens): the block's tokens fix the number of sequences,
documents are taken by descending length, and each goes to the sequence of the
lowest cost with room. A document that fits nowhere is cut over the cheapest
open sequences, so all sequences of a block are full. Only the last sequence of
a task can be short; it is cut into powers of two, which need no padding.

All work is local to a task: no shuffle, and memory bounded by a block.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
BLOCK_DOCS = 2048
#: A block also closes at so many tokens; texts are encoded in slices of so many code points, or one text.
BLOCK_TOKENS, SLICE_CHARS = 1 << 20, 1 << 20
END_ID = 0


def pack_block(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full sequences, and what is left over, each as pieces (document, start, length).

    ``lengths`` are those of the documents, each at most ``capacity``. The
    left-over pieces hold fewer than ``capacity`` tokens together.
    """
    n = sum(lengths) // capacity
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room, cost = [capacity] * n, [0.0] * n
    # by[r]: (cost, sequence) of those with r tokens of room; entries that no longer hold are dropped when met
    by: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, s) for s in range(n)]}
    size_of = 1 << capacity.bit_length()
    none = (math.inf, -1)
    tree = [none] * (2 * size_of)  # least (cost, sequence) over ranges of room

    def refresh(r: int) -> None:
        heap = by.get(r, [])
        while heap and (room[heap[0][1]] != r or cost[heap[0][1]] != heap[0][0]):
            heapq.heappop(heap)
        i = size_of + r
        tree[i] = heap[0] if heap else none
        while i > 1:
            i //= 2
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(least: int) -> int:
        """The sequence of the lowest cost with at least so much room, -1 if there is none."""
        best, low, high = none, size_of + least, 2 * size_of
        while low < high:
            if low & 1:
                best, low = min(best, tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low // 2, high // 2
        return best[1]

    def put(s: int, i: int, start: int, part: int) -> None:
        seqs[s].append((i, start, part))
        old = room[s]
        room[s] -= part
        cost[s] += linear * part + quadratic * part * part
        refresh(old)
        if room[s]:
            heapq.heappush(by.setdefault(room[s], []), (cost[s], s))
            refresh(room[s])

    refresh(capacity)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    rest: list[tuple[int, int, int]] = []
    for i in order:
        start, size = 0, lengths[i]
        if size and (s := cheapest(size)) >= 0:
            put(s, i, 0, size)
            continue
        while size and (s := cheapest(1)) >= 0:  # no sequence has room: cut over the cheapest
            part = min(size, room[s])
            put(s, i, start, part)
            start, size = start + part, size - part
        if size:
            rest.append((i, start, size))
    return seqs, rest


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs (document, ids) pairs given block by block; yields rows of pieces."""

    def __init__(self, capacity: int, base: int, keep_ids: bool):
        self.capacity, self.next, self.keep = capacity, base, keep_ids
        self.rest: list[tuple[object, np.ndarray, int, int]] = []  # key, ids of the piece, start, document's length

    def _emit(self, rows: list, key, ids: np.ndarray, start: int, total: int, seq: int, offset: int) -> None:
        rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset, ids if self.keep else None))

    def add(self, docs: list[tuple[object, np.ndarray]]) -> list[tuple]:
        rows: list[tuple] = []
        small = self.rest
        self.rest = []
        for key, ids in docs:
            n = len(ids)
            at = 0
            while n - at >= self.capacity:
                self._emit(rows, key, ids[at : at + self.capacity], at, n, self.next, 0)
                self.next += 1
                at += self.capacity
            if at < n:
                small.append((key, ids[at:], at, n))
        seqs, rest = pack_block([len(x[1]) for x in small], self.capacity)
        for seq in seqs:
            offset = 0
            for i, start, size in seq:
                key, ids, at, n = small[i]
                self._emit(rows, key, ids[start : start + size], at + start, n, self.next, offset)
                offset += size
            self.next += 1
        self.rest = [(small[i][0], small[i][1][start : start + size], small[i][2] + start, small[i][3]) for i, start, size in rest]
        return rows

    def close(self) -> list[tuple]:
        """The last, short sequence as sequences of power-of-two lengths."""
        rows: list[tuple] = []
        sizes = powers(sum(len(x[1]) for x in self.rest))
        k, offset = 0, 0
        for key, ids, at, n in self.rest:
            used = 0
            while used < len(ids):
                part = min(len(ids) - used, sizes[k] - offset)
                self._emit(rows, key, ids[used : used + part], at + used, n, self.next, offset)
                used, offset = used + part, offset + part
                if offset == sizes[k]:
                    k, offset, self.next = k + 1, 0, self.next + 1
        self.rest = []
        return rows


def byte_bpe_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids as the tokenizers library gives them for the vocabulary at ``path``.

    Texts without special strings are encoded by the same merges through
    tiktoken, which is several times faster; the vocabulary is read from the
    file, the splitting pattern of such files is the one that
    ``public_tokenizers`` names. Everything else goes through the library.
    """
    import json

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.loads(own.to_str())
    special = [t["content"] for t in spec["added_tokens"]]
    try:
        import public_tokenizers
        import tiktoken

        pattern = public_tokenizers.PATTERN
        chars = byte_chars()
        ranks = {bytes(chars[c] for c in p): i for p, i in spec["model"]["vocab"].items() if p not in special}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, KeyError, ValueError):
        fast = None

    def encode(texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if fast is None or any(s in t for s in special):
                slow.append(i)
            else:
                out[i] = fast.encode_ordinary(t)
        if slow:
            for i, e in zip(slow, own.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = e.ids
        return out

    return encode


def byte_chars() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: bytes without a visible form follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    block_docs: int = BLOCK_DOCS, end_id: int = END_ID, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every document's tokens are its text's ids followed by ``end_id``; null and
    empty texts are that id alone. Each id lies in exactly one piece. Null ids
    and repeated rows are documents of their own. ``ids`` is null unless
    ``keep_ids``. Sequence ids count on from the task's number shifted by 33
    bits, so they are unique and the same in a rerun of a task. Equal lengths
    are packed in the order they come in, equal costs into the earlier sequence.
    Long texts are encoded whole. Other columns are not looked at. An empty
    table gives no rows.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        ids = pa.nulls(len(rows), types[-1])
        if keep_ids:
            flat = np.concatenate(cols[-1]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[2])].astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:-1], types)), ids], names)

    def slices(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
        """Ids and texts of a batch, 64 rows or ``SLICE_CHARS`` at a time; only these become Python strings."""
        ids, texts = b.column(0).to_pylist(), b.column(1)
        own: tuple[list, list[str]] = [], []
        size = 0
        for i, k in enumerate(ids):
            own[0].append(k)
            own[1].append(texts[i].as_py())
            size += len(own[1][-1])
            if len(own[0]) >= 64 or size >= SLICE_CHARS:
                yield own
                own, size = ([], []), 0
        if own[0]:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33, keep_ids)
        waiting: list[tuple[object, np.ndarray]] = []
        held = 0
        for b in batches:
            for keys, texts in slices(b):
                for k, t in zip(keys, encode(texts)):
                    waiting.append((k, np.array([*t, end_id], "<u4")))
                    held += len(t) + 1
                    if len(waiting) >= block_docs or held >= BLOCK_TOKENS:
                        rows = packer.add(waiting)
                        waiting, held = [], 0
                        if rows:
                            yield table(rows)
        rows = packer.add(waiting) + packer.close()
        if rows:
            yield table(rows)

    return slim.mapInArrow(run, schema)
