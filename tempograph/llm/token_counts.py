"""Token counts by a compiled finite-state transducer.

A piece vocabulary with byte fallback (BPE, identity normalisation) is turned
into a deterministic transducer. Reading one character moves from state to
state and emits the change of the token count of the prefix read so far, so a
text's count is the sum of what its transitions emit.

* **States.** The tokenization of a prefix ends in exactly one piece. A state
  keeps, for the last few prefixes that a longer piece can still reach back to,
  that last piece and the count relative to the newest prefix. A piece ``t``
  ends a prefix if the tokenization before it ends in a piece ``s`` that is
  compatible: the merge rules keep ``s`` and ``t`` apart. States and
  transitions are made when first met and then kept.
* **Reset.** No piece holds the space mark after another character, so every
  state goes to the start state where a space follows a non-space. Between two
  resets lies a *segment*; segments act as macro transitions from the start
  state to itself, annotated with the count they emit.
* **Chunk maps.** A chunk of a long text maps entry states to exit states and
  counts. The entry states that can occur are those to which the characters
  before the chunk lead from the start state, whichever of them the reading
  begins at; states forget the past quickly, so these are few. Maps compose
  associatively: a text's chunks are mapped apart, by separate tasks above
  ``split_chars``, and combined by a prefix scan in tree form. Where a chunk's
  true entry state is not among the mapped ones, the text is read in one go,
  so counts are exact in any case.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import MEMO_BYTES, free_name, no_clash, stable

SPACE = "▁"
#: Characters of a chunk, and of a text that separate tasks share.
CHUNK_CHARS = 1 << 16
SPLIT_CHARS = 1 << 20
#: Characters before a chunk from which its entry states are found.
LOOK_BACK = 64
#: States and bytes of segments remembered by one worker; beyond it the tables start anew.
MEMO_STATES = 400_000

Map = dict  # entry state -> (exit state, count)


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a piece model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        sp.id_to_piece(i): sp.get_score(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    }


def merge(text: str, pieces: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Pieces of a short string by the merge rules (best score, then leftmost), and the last pair merged."""
    parts, pair = list(text), None
    while True:
        best = None
        for i in range(len(parts) - 1):
            score = pieces.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best[0]):
                best = (score, i)
        if best is None:
            return parts, pair
        i = best[1]
        pair = (parts[i], parts[i + 1])
        parts[i : i + 2] = [pair[0] + pair[1]]


def compile_splits(pieces: dict[str, float]) -> dict[str, tuple[str, str]]:
    """For every piece of two or more characters that the rules make whole: the pair it is made of."""
    made = ((p, merge(p, pieces)) for p in pieces if len(p) > 1)
    return {p: pair for p, (parts, pair) in made if len(parts) == 1}


class Transducer:
    """Deterministic transducer that emits token-count changes."""

    def __init__(self, pieces: dict[str, float], split: dict[str, tuple[str, str]] | None = None):
        bad = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        if bad:
            raise ValueError(f"the reset needs pieces with leading space marks only, not {bad[0]!r}")
        self.pieces = pieces
        self.split = compile_splits(pieces) if split is None else split
        self.rank = {p: -pieces[p] for p in self.split}
        self.longest = max(map(len, pieces), default=1)
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        # A state: (last piece, count relative to the newest) of the prefixes it still needs, oldest first.
        self.states: list[tuple[str, tuple[tuple[str, int], ...]]] = [("", (("", 0),))]
        self.ids = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.memo: dict[str, int] = {}
        self.memo_size = 0

    def _compatible(self, left: str, right: str) -> bool:
        """Do the merge rules leave these two adjacent pieces apart?

        Undo the younger of the two pieces at the seam step by step; a merge
        across the seam that is older than what was undone would have come first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if not left:
            ok = True
        elif SPACE * 2 in left + right:  # runs of spaces share one score
            ok = merge(left + right, self.pieces)[0] == [left, right]
        else:
            rank, split, ok = self.rank, self.split, True
            lr, rr = rank.get(left, -1.0), rank.get(right, -1.0)
            limit, tie = float("inf"), False  # tie: a merge as old as the limit lies further left and comes first
            while True:
                across = rank.get(left + right)
                if across is not None and (across < limit or tie and across == limit):
                    ok = False
                    break
                if lr > rr:
                    limit, tie, left = lr, False, split[left][1]
                    lr = rank.get(left, -1.0)
                elif rr >= 0:
                    limit, tie, right = rr, True, split[right][0]
                    rr = rank.get(right, -1.0)
                else:
                    break
        self.pairs[key] = ok
        return ok

    def _move(self, state: int, ch: str) -> tuple[int, int]:
        """Make the transition for ``ch``: next state and emitted count change."""
        tail, trace = self.states[state]
        text = tail + ch
        found = None
        # The piece that ends the new prefix starts at one of the kept prefixes.
        for back in range(min(len(text), self.longest), 0, -1):
            piece = text[-back:]
            if back > 1 and piece not in self.split:
                continue
            last, rel = trace[len(trace) - back]
            if last is not None and self._compatible(last, piece):
                grown = 1 if piece in self.pieces else len(piece.encode("utf-8", "surrogatepass"))
                found = (piece, rel + grown)
                break
        piece, change = found
        # Keep the suffix that can still begin a piece, and the prefixes inside it.
        keep = next((n for n in range(min(len(text), self.longest - 1), 0, -1) if text[-n:] in self.prefixes), 0)
        tail, trace = text[len(text) - keep :], trace[len(trace) - keep :] if keep else ()
        # A prefix after which no longer piece can begin is forgotten: states that differ there alone are one.
        kept = [(p, r - change) if p is not None and tail[i:] in self.prefixes else (None, 0) for i, (p, r) in enumerate(trace)]
        new = (tail, (*kept, (piece, 0)))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][ch] = (to, change)
        return to, change

    def run(self, segment: str, state: int = 0) -> tuple[int, int]:
        """Exit state and emitted count for ``segment`` read from ``state``."""
        total, moves = 0, self.moves
        for ch in segment:
            step = moves[state].get(ch)
            if step is None:
                step = self._move(state, ch)
            state, change = step
            total += change
        return state, total

    def segment(self, text: str) -> int:
        """Count emitted by a whole segment between two resets."""
        n = self.memo.get(text)
        if n is None:
            if self.memo_size >= MEMO_BYTES:
                self.memo.clear()
                self.memo_size = 0
            n = self.memo[text] = self.run(text)[1]
            self.memo_size += 4 * len(text) + 150
        return n

    _cuts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def advance(self, text: str, state: int) -> tuple[int, int]:
        """As ``run``, with whole segments as single transitions."""
        parts = self._cuts.findall(text.replace(" ", SPACE))
        if not parts:
            return state, 0
        state, total = self.run(parts[0], state)
        if len(parts) > 1:
            memo = self.memo
            for p in parts[1:-1]:
                n = memo.get(p)
                total += self.segment(p) if n is None else n
            state, n = self.run(parts[-1])
            total += n
        return state, total

    def begin(self) -> int:
        """State after the space mark that the model puts in front, with the tables made small again."""
        if len(self.states) >= MEMO_STATES:
            self.states, self.moves = self.states[:1], [{}]
            self.ids = {self.states[0]: 0}
        return self.run(SPACE)[0]

    def chunk_map(self, chunk: str, before: str = "") -> Map:
        """Map of a chunk, for the entry states that the characters ``before`` it allow; none before: the text's begin."""
        if not before:
            entries = [self.begin()]
        else:
            before = before[-LOOK_BACK:].replace(" ", SPACE)
            entries = dict.fromkeys(self.run(before[i:])[0] for i in range(len(before) + 1))
        out = {}
        for e in entries:
            to, n = self.advance(chunk, e)
            out[self.states[e]] = (self.states[to], n)
        return out

    @staticmethod
    def compose(a: Map, b: Map) -> Map:
        """Map of chunk a followed by chunk b; associative. Entries that lead to a state b does not map are left out."""
        return {e: (b[x][0], n + b[x][1]) for e, (x, n) in a.items() if x in b}

    def scan(self, maps: list[Map]) -> Map:
        """Prefix scan in tree form; returns the map of all chunks."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def maps(self, text: str, chunk: int, before: str = "") -> list[Map]:
        return [self.chunk_map(text[i : i + chunk], (text[max(0, i - LOOK_BACK) : i] or before)) for i in range(0, len(text), chunk)]

    def close(self, m: Map) -> int | None:
        """Count of a text whose chunks have map ``m``; None if a chunk was entered in a state it does not map."""
        begin = self.states[self.begin()]
        return m[begin][1] + self.run(SPACE)[1] if begin in m else None

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if len(text) > chunk:
            n = self.close(self.scan(self.maps(text, chunk)))
            if n is not None:
                return n
        return self.advance(text, self.begin())[1] + self.run(SPACE)[1]


def pack_map(m: Map) -> str:
    """A chunk map as text, the same from any worker."""
    return json.dumps(list(m.items()))


def unpack_map(text: str) -> Map:
    state = lambda s: (s[0], tuple((p, n) for p, n in s[1]))
    return {state(e): (state(x), n) for e, (x, n) in json.loads(text)}


_workers: dict[str, Transducer] = {}


def _transducer(shared) -> Transducer:
    """This worker's transducer; its states outlive a task."""
    key, pieces, splits = shared.value
    t = _workers.get(key)
    if t is None:
        gc.set_threshold(500_000, 20, 50)  # many small long-lived tuples, no cycles
        t = _workers[key] = Transducer(pieces, splits)
    return t


def count_tokens(
    docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens",
    chunk_chars: int = CHUNK_CHARS, split_chars: int = SPLIT_CHARS,
) -> DataFrame:
    """Append ``out_col`` (long): the number of pieces of every whole text.

    Null and empty texts count 0. Repeated rows are counted each. All columns
    are kept, whatever their names; ``out_col`` must not be one of them. An
    empty table gives no rows. The vocabulary (as large as the model, whatever
    the data) is broadcast; texts above ``split_chars`` have their chunk maps
    made by separate tasks and composed per text.
    """
    no_clash(docs, [out_col])
    spark, docs = docs.sparkSession, stable(docs)
    pieces = load_pieces(model_path)
    digest = hashlib.sha256(repr(sorted(pieces.items())).encode("utf-8", "surrogatepass")).hexdigest()
    shared = spark.sparkContext.broadcast((digest, pieces, compile_splits(pieces)))

    @F.pandas_udf("long")
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(shared)
        for s in it:
            yield pd.Series([t.count(x, chunk_chars) if x else 0 for x in s], dtype="int64")

    @F.pandas_udf("string")
    def mapped(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        t = _transducer(shared)
        for texts, befores in it:
            yield pd.Series([pack_map(t.scan(t.maps(x, chunk_chars, y))) for x, y in zip(texts, befores)], dtype=object)

    @F.pandas_udf("long")
    def closed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(shared)
        for s in it:
            yield pd.Series([t.close(t.scan([unpack_map(m) for m in ms])) for ms in s], dtype="Int64")

    uid, n = free_name(docs, "__uid"), free_name(docs, "__n")
    text = F.col(text_col)
    long_text = F.length(text) > split_chars
    short = docs.filter(F.coalesce(~long_text, F.lit(True))).withColumn(out_col, counted(F.coalesce(text, F.lit(""))))
    # Few texts are this long; each is cut into parts that go to separate tasks.
    longs = docs.filter(long_text).withColumn(uid, F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / split_chars).cast("int"))
    cuts = F.transform(starts, lambda i: F.struct(i.alias("k"), F.substring(text, i * split_chars + 1, F.lit(split_chars)).alias("part"), F.when(i > 0, F.substring(text, i * split_chars + 1 - LOOK_BACK, F.lit(LOOK_BACK))).otherwise("").alias("before")))
    parts = (
        longs.select(F.col(uid).alias("uid"), F.explode(cuts).alias("c"))
        .repartition("uid", "c.k")
        .select("uid", "c.k", mapped("c.part", "c.before").alias("m"))
        .groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("maps"))
        .select(F.col("uid").alias(uid), closed("maps").alias(n))
    )
    whole = F.when(F.col(n).isNull(), counted(F.when(F.col(n).isNull(), text).otherwise("")))
    longs = longs.join(parts, uid).withColumn(out_col, F.coalesce(F.col(n), whole)).select(*docs.columns, out_col)
    return short.unionByName(longs)
