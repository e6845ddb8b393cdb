"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Strict patterns (``base_spans``) always count. Beyond them, generators of high
recall propose spans that may overlap: runs of digit groups, loose separators,
spelled-out signs, IPv6. For each kind, boosted trees score a proposal from its
format and its context, and a threshold calibrated on held-out documents selects.

Labels come from the corpus: spans that the strict patterns find, as they are
and written in other ways, are positive; proposals that cut or exceed them,
the same spans spoilt (a wrong check digit, a part above 255, a piece of a
token), and what the generators propose elsewhere are negative. The last kind
may hide true ones, so a second fit leaves out what the first calls positive.

Two passes over the texts, no shuffle of texts: the first collects examples, the
second applies the models. Equal examples are counted, and all of them are fitted:
a scan a level sums the histograms of all kinds, so no task holds a kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tempograph.llm.common import cut, delete, free, no_clash, scratch
from tempograph.operators import boosting
from tempograph.operators.running import running
from tempograph.operators.sums import tree_sum_of

KINDS = ("email", "ip", "card", "phone")
#: The examples of a kind and label (planted, spoilt, found elsewhere) weigh as so many at most, all together.
WEIGHS = 4000
#: Part of that for what is found elsewhere, in the first fit.
DOUBT = 0.3
#: Different examples in a task of a fit, and steps of a gradient's unit: whole numbers add up alike in any order.
TASK_ROWS, UNIT = 20_000, 2.0**20
#: Features are told apart up to here.
LAST = 255
#: Share of the spans above the threshold that must be right on held-out documents.
PRECISION = 0.98
#: No threshold is lower.
LEAST_SCORE = 0.5
TREES, DEPTH, ETA = 40, 4, 0.2
#: Trees after which the margins are checkpointed.
KEEP = 20
#: Code points on either side that count as context.
WINDOW = 32
#: Digit groups in a proposal at most.
GROUPS = 8
ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
#: Bytes of text after which rows leave a task's buffer.
OUT_BYTES = 8 << 20

Span = tuple[int, int, int]  # kind, start, end

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _byte(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern; each ``@`` is looked at once, so long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """What the strict patterns find, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_RUN = re.compile("[0-9]+")
_GAP = re.compile(r"[\x20().\-/\[\]]{1,3}")
_AT = re.compile(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\x20at\x20|\s?@\s?", re.I)
_LOOSE_LOCAL = re.compile(r"[\w.%+-]+\Z")
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\x20dot\x20|\x20\.\x20)"
_LOOSE_DOMAIN = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,5}}", re.I)
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap."""
    out: list[Span] = []
    low = text.lower() if "at" in text or "AT" in text or "At" in text else ""
    if "@" in text or "(at" in low or "[at" in low or "{at" in low or (" at " in low and "dot" in low):
        for m in _AT.finditer(text):
            a = _LOOSE_LOCAL.search(text, max(0, m.start() - 64), m.start())
            b = _LOOSE_DOMAIN.match(text, m.end())
            if a and b:
                out.append((0, a.start(), b.end()))
    if ":" in text:
        out += [(1, m.start(), m.end()) for m in _SIX.finditer(text) if m.end() - m.start() >= 6]
    runs = [m.span() for m in _RUN.finditer(text)]
    for i, (s, e) in enumerate(runs):
        n, parts = e - s, 1
        signs = s
        while signs > 0 and s - signs < 2 and text[signs - 1] in "+(":
            signs -= 1
        for j in range(i, min(i + GROUPS, len(runs))):
            if j > i:
                if runs[j][0] - runs[j - 1][1] > 3 or not _GAP.fullmatch(text, runs[j - 1][1], runs[j][0]):
                    break
                n, parts = n + runs[j][1] - runs[j][0], parts + 1
            if n > 19:
                break
            end = runs[j][1]
            if parts == 4 and n <= 12 and (j == i or "." in text[s:end]):
                out.append((1, s, end))
            if n >= 12:
                out.append((2, s, end))
            if 7 <= n <= 15:
                out.append((3, signs, end))
    return out


_CONTACT = re.compile(r"tel|phone|call|fax|mobile|mail|contact|reach", re.I)
_NET = re.compile(r"\bip|host|addr|server|client|login", re.I)
_PAY = re.compile(r"card|visa|pay|credit|amex|account", re.I)
_NUMBER = re.compile(r"\bid|order|ref|version|\bv$|token|key|password|isbn|invoice|serial|#|=", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./ -][0-9]{1,2}[./ -](?:19|20)[0-9]{2}")
_HEX = set("0123456789abcdefABCDEF")
N_FEATURES = 36


def _side(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isalpha():
        return 2
    if c.isdigit():
        return 3
    return 4 + min("=:#\"'([{<)]}>.,;!?%$&*|+-/_@\\".find(c) // 4 + 1, 8)


def features(text: str, span: Span) -> list[int]:
    """Format of the span and its context, as small whole numbers."""
    kind, s, e = span
    x, before, after = text[s:e], text[max(0, s - WINDOW) : s], text[e : e + WINDOW]
    runs = [m.group() for m in _RUN.finditer(x)]
    digits, gaps = "".join(runs), re.sub("[0-9A-Za-z]", "", x)
    sizes = [len(r) for r in runs] or [0]
    at = _AT.search(x)
    labels = re.split(_DOT, x[at.end() :], flags=re.I) if kind == 0 and at else []
    near = before[-16:] + after[:16]
    return [
        min(len(x), 250), len(digits), sum(c.isalpha() for c in x), len(set(digits)), len(gaps), len(set(gaps)),
        max(sizes), len(runs), min(sizes), sizes[0], sizes[-1], sizes[-2] if len(sizes) > 1 else 0,
        int(12 <= len(digits) <= 19 and luhn(digits)), int(len(runs) == 4 and all(map(_byte, runs))), int("@" in x), sum(x.count(c) for c in "([{"),
        int(x[:1] == "+"), int(digits[:2] == "00"), int(digits[:1] or 10), x.count(" "), x.count("."), x.count("-"), x.count(":"), x.count("/"),
        len(labels), len(labels[-1]) if labels else 0, at.start() if kind == 0 and at else 0,
        _side(before[-1:]), _side(after[:1]), _side(after[1:2]) if after[:1] in tuple(" .-/") else 0,
        (1 if _CONTACT.search(before) else 0) + (2 if _NET.search(before) else 0), (1 if _PAY.search(before) else 0) + (2 if _NUMBER.search(before) else 0),
        sum(c.isdigit() for c in near), sum(c in _HEX for c in near) if len(near) else 0, int(bool(_DATE.fullmatch(x))), int(before[-1:] in tuple("+(") if before else 0),
    ]


def _draw(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def rewritten(kind: int, x: str, r: int) -> str:
    """A true span in one of the other ways to write it, ``r`` picks."""
    d = _digits(x)
    if kind == 0:
        local, _, domain = x.partition("@")
        at = (" (at) ", "[at]", " at ", " @ ", "(at)", "@", " [at] ", "{at}")[r % 8]
        dot = (" dot ", ".", "[.]", "(dot)", " . ", " [dot] ")[r // 8 % 6 if at not in (" at ", "@") else 0 if at == " at " else 2]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        p = [int(v) for v in x.split(".")]
        six = "2001:db8:" + ":".join(f"{a * 251 + r % 199:x}" for a in p)
        return ("[.]".join(map(str, p)), "(.)".join(map(str, p)), " . ".join(map(str, p)), six + ":0:1", six + "::1", ". ".join(map(str, p)))[r % 6]
    if kind == 2:
        sep = ("", " ", "-", ".", "/", "  ")[r % 6]
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    head, a, b, c = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
    forms = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{head} {a} {b} {c}", f"{head} ({a}) {b}-{c}", f"+{head} {a}/{b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}")
    return forms[r % 8] if head and a else f"00{d[:2]} {d[2:5]} {d[5:]}"


def spoilt(kind: int, x: str, r: int) -> str:
    """Something like a true span that is none."""
    d = _digits(x)
    if kind == 0:
        local, _, domain = x.partition("@")
        return (f"{local}@{domain.partition('.')[0]}", f"look at {domain.partition('.')[0]} dot matrix", f"{local} at {domain.partition('.')[0]}.", f"at the dot {local}")[r % 4]
    if kind == 1:
        p = x.split(".")
        return (
            ".".join([*p[:3], str(256 + r % 700)]), f"version {x}", f"v{x}", f"{x}.{r % 90}", f"{r % 12 + 1}:{r % 60:02}:{r // 60 % 60:02}", f"{r % 28 + 1:02}.{r // 28 % 12 + 1:02}.20{r % 30:02}.{r % 24}",
            ":".join(f"{r >> 8 * k & 255:02x}" for k in range(6)), f"{p[0]}.{p[1]} {p[2]}.{p[3]}",
        )[r % 8]
    if kind == 2:
        k = r // 8 % len(d)
        wrong = d[:k] + str((int(d[k]) + 1 + r // 200 % 8) % 10) + d[k + 1 :]
        wrong = wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
        return (wrong, wrong, wrong, f"{wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}", f"a{d}f{r % 97}", f"token={d[:13]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d}e7b0")[r % 8]
    n = d[-10:]
    return (
        f"20{r % 30:02}-{r // 30 % 12 + 1:02}-{r % 28 + 1:02} {r % 24:02}", f"{n[:3]}.{n[3:]}", f"a{n}c{r % 7}", f"id={n}", f"978-{n[0]}-{n[1:3]}-{n[3:9]}-{n[9]}",
        f"{r % 28 + 1}/{r // 28 % 12 + 1}/20{r % 30:02}", f"{n[:2]}/{n[2:4]}/{n[4:6]}/{n[6:8]}", f"{n[:5]}{n}", n,
    )[r % 9]


def examples(text: str, seed: str) -> Iterator[tuple[int, int, list[int]]]:
    """(kind, group, features); group 1: planted and right, 0: wrong, -1: found elsewhere."""
    base = base_spans(text)
    found = proposals(text)
    if not base and not found:
        return
    for c in found:
        if not any(c[1] < e and s < c[2] for _, s, e in base):
            yield c[0], -1, features(text, c)
    for kind, s, e in base:
        x, before, after = text[s:e], text[max(0, s - 2 * WINDOW) : s], text[e : e + 2 * WINDOW]
        r = _draw(seed, kind, s)
        beside = f" {'4' if r & 1 else '+1 '}{r % 10**11:011}" if r % 5 == 0 and kind > 1 else ""  # another number follows at once
        for right, form in ((1, x), (1, rewritten(kind, x, r >> 8)), (1, rewritten(kind, x, r >> 24)), (0, spoilt(kind, x, r >> 16))):
            made = before + form + beside + after
            a, b = len(before), len(before) + len(form)
            for c in proposals(made):
                if c[1] < b and a < c[2]:
                    hit = right and c[0] == kind and c[1:] in ((a, b), (a - 1, b))
                    yield c[0], int(hit), features(made, c)


def kind_edges(values: list[tuple[int, int, int, float]]) -> list[list[np.ndarray]]:
    """Inner quantiles of each kind and feature from (kind, feature, value, weight), as ``boosting.edges_of`` has them of rows."""
    out = [[np.zeros(0)] * N_FEATURES for _ in KINDS]
    for (kind, j), own in pd.DataFrame(values, columns=["kind", "j", "v", "w"]).groupby(["kind", "j"]):
        own = own.groupby("v")["w"].sum()
        v, below = own.index.to_numpy(float), np.cumsum(own.to_numpy(float))
        at = np.searchsorted(below, below[-1] * np.arange(1, boosting.BINS) / boosting.BINS * (1 - 1e-12))
        cuts = np.unique(v[np.minimum(at, len(v) - 1)])
        out[kind][j] = cuts[cuts < v[-1]]
    return out


_PACKED = "kind binary, label binary, many binary, held binary, bins binary, margin binary"
_TYPES = (np.int8, np.int8, np.int64, np.bool_, np.uint8, np.float64)


def _packed(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(c, t).tobytes()], pa.binary()) for c, t in zip(cols, _TYPES)], [c.split()[0] for c in _PACKED.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            out = [np.frombuffer(b.column(k)[i].as_py(), t) for k, t in enumerate(_TYPES)]
            out[4] = out[4].reshape(len(out[0]), N_FEATURES)
            yield out


def fit_trees(rows: DataFrame, weight: np.ndarray, edges: list[list[np.ndarray]]) -> tuple[list[boosting.Booster], DataFrame]:
    """Trees of every kind, grown side by side over all packed rows that are not held out, one scan a level; and the rows with their margins.

    ``weight`` is that of an example by (kind, label), with label -1 in the last place.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        out = np.zeros((len(KINDS), 3))
        for kind, label, many, held, _, _ in _unpacked(batches):
            np.add.at(out, (kind[~held], label[~held]), many[~held])
        return [out]

    total = (tree_sum_of(rows, counted) or [np.zeros((len(KINDS), 3))])[0] * weight
    rate = total[:, 1] / np.maximum(total.sum(axis=1), 1e-12)
    base = np.log(np.clip(rate, 1e-6, 1 - 1e-6) / np.clip(1 - rate, 1e-6, 1))
    models = [boosting.Booster(e, float(b)) for e, b in zip(edges, base)]
    alive = [0 < r < 1 for r in rate]

    def sums(states: list[boosting.Tree], level: int, alive: list[bool]):
        def one(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
            out = np.zeros((len(KINDS), 1 << level, N_FEATURES, boosting.BINS, 2))
            for kind, label, many, held, bins, margin in _unpacked(batches):
                for k in np.flatnonzero(alive):
                    own = np.flatnonzero((kind == k) & ~held & (many > 0))
                    w, p, b = many[own] * weight[k, label[own]], boosting.sigmoid(margin[own] + base[k]), bins[own]
                    g, h = (np.rint(x * UNIT) for x in (w * (p - (label[own] == 1)), w * p * (1 - p)))
                    out[k] += boosting.histogram(b, boosting.level_nodes(states[k], b, level), 1 << level, g, h)
            return [out]

        return one

    def raised(rows: DataFrame, grown: dict[int, boosting.Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for kind, label, many, held, bins, margin in _unpacked(batches):
                margin = margin.copy()
                for k, t in grown.items():
                    margin[kind == k] += t.value[t.nodes(bins[kind == k])]
                yield _packed(kind, label, many, held, bins, margin)

        return rows.mapInArrow(run, _PACKED)

    stale: list[DataFrame] = []  # let go once the rows made from them are kept
    for t in range(TREES):
        states = [boosting.growing(DEPTH) for _ in KINDS]
        go = list(alive)
        for level in range(DEPTH):
            if not any(go):
                break
            hist = tree_sum_of(rows, sums(states, level, go))[0] / UNIT
            while stale:
                stale.pop().unpersist()
            go = [go[k] and boosting.grow_level(states[k], level, hist[k], ETA) for k in range(len(KINDS))]
        alive = [a and s.feature[0] >= 0 for a, s in zip(alive, states)]
        if not any(alive):
            break
        grown = {k: states[k] for k in range(len(KINDS)) if alive[k]}
        for k, tree in grown.items():
            models[k].trees.append(tree)
        if t:
            stale.append(rows)
        rows = raised(rows, grown)
        if t % KEEP == KEEP - 1:
            rows = cut(rows)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    if stale:
        rows.count()
        stale.pop().unpersist()
    return models, rows


def thresholds(rows: DataFrame, models: list[boosting.Booster]) -> list[float]:
    """Each kind's lowest score from which on ``PRECISION`` of the held-out examples, as often as they are there, are right."""
    base = np.array([m.base for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, label, many, held, _, margin in _unpacked(batches):
            at = np.flatnonzero(held & (many > 0))
            score = boosting.sigmoid(margin[at] + base[kind[at]])
            yield pa.RecordBatch.from_arrays([pa.array(kind[at].astype(np.int32)), pa.array(score), pa.array(many[at] * (label[at] == 1)), pa.array(many[at])], ["kind", "score", "hits", "n"])

    by = rows.mapInArrow(run, "kind int, score double, hits long, n long").groupBy("kind", "score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    good = running(by, ["kind"], [F.desc("score")], ["hits", "n"]).filter(F.col("cum_hits") >= PRECISION * F.col("cum_n"))
    least = {r["kind"]: r["s"] for r in good.groupBy("kind").agg(F.min("score").alias("s")).collect()}  # one row a kind
    return [max(LEAST_SCORE, least[k]) if k in least else 2.0 for k in range(len(KINDS))]


def choose(text: str, base: list[Span], models: list[tuple[boosting.Booster, float]]) -> list[Span]:
    """The base spans and the proposals above their kind's threshold, best first, that overlap nothing chosen."""
    edges = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in edges], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in edges], np.int64)) if edges else starts

    def free(c: Span) -> bool:
        i = np.searchsorted(starts, c[2], side="left")  # those that begin before its end
        return i == 0 or ends[i - 1] <= c[1]

    open_ = [c for c in proposals(text) if models[c[0]][1] <= 1 and free(c)]
    if not open_:
        return base
    scored = []
    for kind in {c[0] for c in open_}:
        own = [c for c in open_ if c[0] == kind]
        p = models[kind][0].score(np.array([features(text, c) for c in own], float))
        scored += [(-float(v), c[1] - c[2], c) for v, c in zip(p, own) if v >= models[kind][1]]
    out, taken = list(base), set()
    for _, _, c in sorted(scored):
        places = range(c[1], c[2])
        if not taken.intersection(places):
            taken.update(places)
            out.append(c)
    return sorted(out)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[boosting.Booster, float]]:
    """Trees and threshold of each kind, from the texts of ``docs``."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["kind", "right", "held", "x"]

        def out() -> pa.RecordBatch:
            k, g, h, x = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(h, pa.bool_()), pa.array(x, pa.list_(pa.int32()))], names)

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                if text := texts[i].as_py():
                    seed = str(ids[i].as_py())
                    held = _draw(seed) % 3 == 0
                    rows += [(k, g, held, x) for k, g, x in examples(text, seed)]
                if len(rows) >= 4096:
                    yield out()
                    rows = []
        if rows:
            yield out()

    path = scratch(spark, "personal-data")
    docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter("t is not null").mapInArrow(run, "kind int, right int, held boolean, x array<int>").write.parquet(path)
    made = cut(spark.read.parquet(path).groupBy("kind", "right", "held", "x").agg(F.count("*").alias("many")))
    delete(spark, path)
    size = {(r["kind"], r["right"], r["held"]): (r["n"], r["rows"]) for r in made.groupBy("kind", "right", "held").agg(F.sum("many").alias("n"), F.count("*").alias("rows")).collect()}  # 24 rows at most
    has = lambda k, right, held: any((k, g, held) in size for g in right)
    ready = [has(k, (1,), False) and has(k, (1,), True) and has(k, (-1, 0), False) for k in range(len(KINDS))]
    if not any(ready):
        free(made)
        return [(boosting.Booster([np.zeros(0)] * N_FEATURES), 2.0)] * len(KINDS)
    count = lambda k, g: sum(size.get((k, g, held), (0,))[0] for held in (False, True))
    weight = np.array([[min(1.0, WEIGHS / max(1, count(k, g))) for g in (0, 1, -1)] for k in range(len(KINDS))])
    value = made.filter("not held").select("kind", "right", "many", F.posexplode("x").alias("j", "v"))
    value = value.groupBy("kind", "right", "j", F.least("v", F.lit(LAST)).alias("v")).agg(F.sum("many").alias("n"))
    edges = kind_edges([(r["kind"], r["j"], r["v"], r["n"] * weight[r["kind"], r["right"]]) for r in value.collect()])  # LAST numbers a kind, label and feature at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, label, held, many = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "right", "held", "many"))
            x = b.column("x").flatten().to_numpy().reshape(len(kind), N_FEATURES).astype(float)
            bins = np.zeros(x.shape, np.uint8)
            for k in np.unique(kind):
                bins[kind == k] = boosting.Booster(edges[k]).bins(x[kind == k])
            yield _packed(kind, label, many, held, bins, np.zeros(len(kind)))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.array([m.base for m in first])
        for kind, label, many, held, bins, margin in _unpacked(batches):
            out = (label == -1) & (boosting.sigmoid(margin + base[kind]) >= 0.5)
            yield _packed(kind, label, np.where(out, 0, many), held, bins, np.zeros(len(kind)))

    tasks = max(1, -(-sum(r for _, r in size.values()) // TASK_ROWS))
    rows = made.filter(F.col("kind").isin([k for k in range(len(KINDS)) if ready[k]])).coalesce(tasks).mapInArrow(pack, _PACKED).persist(StorageLevel.MEMORY_AND_DISK)
    first, scored = fit_trees(rows, weight * [1, 1, DOUBT], edges)
    kept = scored.mapInArrow(sure, _PACKED).persist(StorageLevel.MEMORY_AND_DISK)
    models, last = fit_trees(kept, weight, edges)
    least = thresholds(last, models)
    for x in {id(x): x for x in (rows, scored, kept, last)}.values():
        x.unpersist()
    free(made)
    return [(m, t if ok else 2.0) for m, t, ok in zip(models, least, ready)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: list[tuple[boosting.Booster, float]] | None = None) -> DataFrame:
    """``docs`` with counts of the strict patterns, their spans (``base``) and all ``spans`` (kind, start, end in code points).

    Spans are sorted by kind as in ``KINDS`` and by start. All of ``base`` are
    in ``spans``; what is added overlaps none of them and no other added one.
    Null and empty texts have none. Null ids count as one id (an id only seeds
    which spans are learnt from); repeated rows are judged alike. Long texts are
    read whole, in time that grows with their length. A corpus without strict
    spans of a kind gives it no added ones. Other columns are kept; ones with a
    name that is added raise ``ValueError``. An empty table gives no rows.
    """
    no_clash(docs, ADDED)
    spark = docs.sparkSession
    models = fit(docs, id_col, text_col) if models is None else models
    shared = spark.sparkContext.broadcast(models)  # TREES small trees a kind
    names = [f"__pii{i}" for i in range(len(docs.columns) + 1)]
    slim = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names)], F.coalesce(F.col(text_col), F.lit("")).alias(names[-1]))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            base, spans = [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                own = base_spans(text)
                base.append(own)
                spans.append(choose(text, own, shared.value))
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts, *(pa.array([as_rows(x) for x in col], pa.list_(span)) for col in (base, spans))], [*names[:-1], *ADDED])

    schema = slim.drop(names[-1]).schema
    for c in ADDED[:4]:
        schema = schema.add(c, "long")
    for c in ADDED[4:]:
        schema = schema.add(c, ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long")))
    return slim.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, docs.columns)))


def span_text(col: str):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text_col: str = "text", spans: str = "spans"):
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one, named after the first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(acc, s):
        new = F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(new.alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.when(F.col(text_col).isNotNull(), F.aggregate(order, start, put, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text)))))
