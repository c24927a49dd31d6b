"""Registered queries of the training-data operators: each applies its operator, with production
parameters, to its whole table and derives the contract's columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    compression_quality,
    cross_tokenizer,
    decontamination,
    embedding_dups,
    html_text,
    jaccard_join,
    language_id,
    licenses,
    packing,
    pii,
    prefix_trie,
    token_counts,
    url_rules,
)
from .shared import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

# The policy list that the url query's contract states.
POLICY = [(url_rules.BLOCK, "net/"), (url_rules.ALLOW, "example.net/en/"), (url_rules.BLOCK, "example.com/de/"), (url_rules.ALLOW, "org/fr/")]


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out())
    scored = compression_quality.score(docs, compression_quality.learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_candidate_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document; the counts are of base spans."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.find_spans(docs, pii.learn(docs))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
                        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def op3_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the texts and languages outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.learn(docs.where(~held_out()))
    found = language_id.identify(docs, model, spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_alignment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document holds an exact or edited copy."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.find_items(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by the policy list or else by mined rules."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality in (0, 1)")
    known = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, url_rules.BLOCK).otherwise(url_rules.ALLOW).alias("verdict"))
    return url_rules.judge(pages, known, POLICY).select("page_id", "host", "path", "rule", "verdict")


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_text.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose distinct 3-word shingles have Jaccard similarity of 0.9 or more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.jaccard_components(docs, n=3, num=90, den=100)


def op8_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_subspace_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings of cosine 0.95 or more, and their classes."""
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), t=0.95)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes and byte-level BPE tokens of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer on every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return cross_tokenizer.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_monoid_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix tree of all conversations, each rebuilt on the head of its hundred's first one."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    base = F.col("conv_id") - F.col("conv_id") % 100
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(turns, base, head, most=5)


def op13_license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and expressions of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_compression_quality, op2_candidate_boosted_pii, op3_viterbi_language_id, op4_alignment_decontamination,
    op5_association_url_filter, op6_wrapper_induction, op7_ngram_jaccard_join, op8_minimum_bin_slack_packing,
    op9_subspace_pigeonhole_join, op10_token_counts,
    op11_identity_map_alignment, op12_monoid_prefix_trie, op13_license_expressions)}

_COMPONENTS = """
edge AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach AS (SELECT x, x AS y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
component AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)"""

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE
word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
         FROM documents),
gram AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])
                                             WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM word),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM gram p JOIN gram q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * k >= 90 * (s.n + t.n - k)),"""
    + _COMPONENTS + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN component ON id = d.doc_id""",
    "op9_subspace_pigeonhole_join": """
WITH RECURSIVE
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM vec p JOIN vec q ON p.vec_id < q.vec_id AND len(p.v) = len(q.v)
         WHERE list_cosine_similarity(p.v, q.v) >= 0.95),"""
    + _COMPONENTS + """,
degree AS (SELECT x, count(*) AS n FROM edge GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree ON x = e.vec_id LEFT JOIN component ON id = e.vec_id""",
}
