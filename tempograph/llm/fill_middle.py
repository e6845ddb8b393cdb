"""Fill-in-the-middle transformation.

A text is decoded to an array of code points. Runs of letters are one unit and
every other code point is one; comparing the classes of neighbours gives the
boundaries. Two seeded ranks among the boundaries cut the text into prefix,
middle and suffix, which are put together with sentinels in one of two orders.

All work is local to a row; the seeded numbers come from the id alone, so reruns
agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import no_clash

SEED = 1
PLAIN_PERCENT, SPM_PERCENT = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
#: Bytes of output after which rows leave a task's buffer.
OUT_BYTES = 8 << 20


def boundaries(points: np.ndarray) -> np.ndarray:
    """Places where units end, from 0: 0 and then one for each unit."""
    if not len(points):
        return np.zeros(1, np.int64)
    letter = ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122))
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate(([0], inner, [len(points)]))


def seeded(id_col: str, seed: int, k: int) -> Column:
    """The k-th number (from 0, 32 bits) that belongs to a row's id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
    middle) or ``plain`` (the text as it is): for texts that are empty or hold a
    sentinel, and for ``plain_percent`` of the rest. A null text counts as
    empty; a null id counts as an id without digits, so rows with a null id draw
    the same numbers, as rows with equal ids do. Long texts are cut whole. Other
    columns are kept; ones with a name that is added raise ``ValueError``. An
    empty table gives no rows.
    """
    no_clash(docs, ADDED)
    names = [f"__fim{i}" for i in range(len(docs.columns) + 5)]
    slim = docs.select(
        *[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names)], F.coalesce(F.col(text_col), F.lit("")).alias(names[-5]), *[seeded(id_col, seed, k).alias(names[k - 4]) for k in range(4)]
    )
    width = len(docs.columns)

    def one(text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = boundaries(points)
        n = len(ends) - 1
        if not text or h[2] % 100 >= 100 - plain_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        a, b = (int(ends[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        pre, mid, suf = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
        if h[3] % 100 < spm_percent:
            return n, "spm", a, b - a, f"{SUFFIX}{suf}{PREFIX}{pre}{MIDDLE}{mid}"
        return n, "psm", a, b - a, f"{PREFIX}{pre}{SUFFIX}{suf}{MIDDLE}{mid}"

    def table(b: pa.RecordBatch, at: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        kept = b.slice(at, len(rows)).columns[:width]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types))], [*names[:width], *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, held = [], 0, 0
            numbers = list(zip(*(b.column(width + 1 + k).to_pylist() for k in range(4))))
            texts = b.column(width)
            for i, h in enumerate(numbers):
                rows.append(one(texts[i].as_py(), h))
                held += len(rows[-1][-1])
                if held >= OUT_BYTES:
                    yield table(b, at, rows)
                    rows, at, held = [], i + 1, 0
            if rows:
                yield table(b, at, rows)

    added = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = slim.select(*names[:width]).schema
    for field in added.split(", "):
        schema = schema.add(*field.split())
    return slim.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, docs.columns)))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made of, as its sentinels tell; plain output is the text."""

    def joined(first: str, second: str) -> tuple[Column, Column, Column]:
        # Only what was put in holds sentinels, and none can begin inside another.
        head = F.substring_index(F.col(output), second, 1)
        tail = F.expr(f"substring(`{output}`, length(substring_index(`{output}`, '{second}', 1)) + {len(second) + 1})")
        return head.substr(F.lit(len(first) + 1), F.length(head)), F.substring_index(tail, MIDDLE, 1), F.substring_index(tail, MIDDLE, -1)

    pre, suf, mid = joined(PREFIX, SUFFIX)
    suf2, pre2, mid2 = joined(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(pre, mid, suf)).when(F.col(form) == "spm", F.concat(pre2, mid2, suf2)).otherwise(F.col(output))
