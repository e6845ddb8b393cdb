"""Every stage of the corpus pipeline against brute force, on whole tables."""

import zlib
from collections import Counter, defaultdict

import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import re  # noqa: E402

from test_operators import brute_components, brute_lines  # noqa: E402

from tempograph.llm import quality_classifier  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into each stage, and out of the last."""
    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        rows.append([r.asDict() for r in docs.collect()])
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*rows, [r.asDict() for r in docs.collect()]]


def key(r):
    return tuple(str(r[c]) for c in ("doc_id", "text", "lang", "source", "n_chars"))


def test_classifier_stage(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    train = [r for r in stages[0] if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    train.sort(key=lambda r: r["doc_id"])
    model = quality_classifier.fit([r["text"] or "" for r in train], [labels[r["doc_id"]] for r in train])
    want = [key(r) for r in stages[0] if model.score(r["text"] or "") >= 0.5]
    assert sorted(want) == sorted(key(r) for r in stages[1]) and 0 < len(want) < len(stages[0])


def test_line_stage(stages):
    before = sorted(stages[1], key=lambda r: r["doc_id"])
    gone = brute_lines([r["text"] for r in before], 10)
    after = {r["doc_id"]: r for r in stages[2]}
    assert len(after) == len(before) == len(stages[2])
    for i, r in enumerate(before):
        left = len([x for x in (r["text"] or "").split("\n") if WORD.search(x)]) - gone[i]
        assert len([x for x in (after[r["doc_id"]]["text"] or "").split("\n") if WORD.search(x)]) == left
        assert gone[i] or after[r["doc_id"]]["text"] == r["text"]


def test_jaccard_stage(stages):
    before = sorted(stages[2], key=lambda r: r["doc_id"])
    first = brute_components([r["text"] for r in before], 5, 80)
    want = [key(r) for i, r in enumerate(before) if first[i][1] == i]
    assert sorted(want) == sorted(key(r) for r in stages[3])


def test_mix_stage(stages):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    of = defaultdict(int)
    for r in stages[3]:
        of[r["source"]] += size(r)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(of.values())
    while True:
        free = [s for s in names if s not in capped]
        rate = (total - sum(3 * of[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if rate * weight[s] > 3 * of[s]}
        if not above:
            break
        capped |= above
    target = {s: 3 * of[s] if s in capped else rate * weight[s] for s in names}
    times, taken = Counter(key(r) for r in stages[4]), defaultdict(int)
    assert set(times) <= {key(r) for r in stages[3]} and max(times.values()) <= 3
    for r in stages[4]:
        taken[r["source"]] += size(r)
        assert size(r) > 0
    assert all(abs(taken[s] - target[s]) <= max(size(r) for r in stages[3] if r["source"] == s) for s in names)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in stages[4])
    seqs, used = defaultdict(list), Counter()
    for r in stages[5]:
        assert len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append(r)
        used[r["doc_id"]] += r["length"]
    assert used == Counter({d: n for d, n in ((d, sum(len(i) * c for (x, i), c in want.items() if x == d)) for d in {d for d, _ in want})})
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))] and n <= 1024 and n & (n - 1) == 0
    # The pieces of a document's copies put together again are its ids.
    parts = defaultdict(list)
    for r in stages[5]:
        parts[r["doc_id"]].append((r["start"], tuple(r["ids"])))
    for (d, ids), c in want.items():
        if sum(1 for x, _ in want if x == d) == 1:
            got = Counter()
            for start, x in parts[d]:
                for i, t in enumerate(x):
                    got[start + i, t] += 1
            assert got == Counter({(i, t): c for i, t in enumerate(ids)})
