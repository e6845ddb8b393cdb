"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import compaction, fill_middle, jaccard_join, line_dedup, mixing, ngram_lm, packing, personal_data, quality_classifier, quality_rules, token_counts, topk, whitening


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact_documents(_read(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_read(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify_quality(docs, _read(spark, sf_dir, "labels")).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=False).drop("ids")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.rule_verdicts(docs, _read(spark, sf_dir, "labels")).drop("text", "rule_stats")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs, words=4, percent=85)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.lm_scores(docs, spark).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(personal_data.span_text("base"), 256).alias("base_sha256")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base, personal_data.span_text("spans").alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(_read(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_compaction, op3_exact_topk, op4_source_mixing, op5_quality_classifier, op6_packing,
        op7_line_dedup, op8_quality_rules, op9_jaccard_join, op10_kneser_ney, op11_fill_middle, op12_personal_data, op13_whitening, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_topk": """
WITH raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: floor(64 * x)) AS e FROM raw),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_line_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS uid, doc_id, text FROM documents),
raw AS (
  SELECT uid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
l AS (
  SELECT uid, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
w AS (
  SELECT uid, pos, t, row_number() OVER (PARTITION BY uid ORDER BY pos) AS q,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE t <> ''),
starts AS (
  SELECT uid, q AS a, q AS b, n, t AS body FROM w
  UNION ALL
  SELECT s.uid, s.a, w.q, s.n + w.n, s.body || chr(10) || w.t
  FROM starts s JOIN w ON w.uid = s.uid AND w.q = s.b + 1 WHERE s.n < 10),
ends AS (
  SELECT uid, q AS a, q AS b, n, t AS body FROM w
  UNION ALL
  SELECT s.uid, w.q, s.b, s.n + w.n, w.t || chr(10) || s.body
  FROM ends s JOIN w ON w.uid = s.uid AND w.q = s.a - 1 WHERE s.n < 10),
runs AS (SELECT uid, a, b, body FROM starts WHERE n >= 10 UNION SELECT uid, a, b, body FROM ends WHERE n >= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY md5(body) ORDER BY uid, a) AS k FROM runs),
gone AS (SELECT DISTINCT w.uid, w.pos FROM ranked r JOIN w ON w.uid = r.uid AND w.q BETWEEN r.a AND r.b WHERE r.k > 1),
left_ AS (
  SELECT l.uid, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN gone g ON g.uid = l.uid AND g.pos = l.pos WHERE g.uid IS NULL GROUP BY l.uid),
c AS (
  SELECT w.uid, count(*) AS n_lines, count(g.uid) AS n_deleted FROM w LEFT JOIN gone g ON g.uid = w.uid AND g.pos = w.pos GROUP BY w.uid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM d LEFT JOIN left_ ON left_.uid = d.uid LEFT JOIN c ON c.uid = d.uid
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, h FROM (
    SELECT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM both_ UNION SELECT r.x, e.b FROM reach r JOIN both_ e ON e.a = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = d.doc_id
""",
    "op11_fill_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
}
