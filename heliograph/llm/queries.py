"""Queries of the text operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import materialise, read_table
from heliograph.llm.decontaminate import find_contamination, words_hit
from heliograph.llm.edit_counts import RESULTS, apply_edits, build_trees, derived_edits
from heliograph.llm.fingerprints import fingerprint_documents
from heliograph.llm.language import fit_dictionaries, held_out, identify_language
from heliograph.llm.lexicon import bpe_round_trip
from heliograph.llm.ngram_join import near_duplicates
from heliograph.llm.quality_votes import fit_voters, score_quality
from heliograph.llm.quality_votes import held_out as quality_held_out
from heliograph.llm.repeat_runs import run_digests
from heliograph.llm.secret_scan import fit_on_texts, scan
from heliograph.llm.site_tree import extract_text
from heliograph.llm.spelling_groups import count_words, group_variants, without_one
from heliograph.llm.token_ids import token_file_digests
from heliograph.llm.tool_calls import derived_messages, link_calls, tools_table

TOKENIZER = "byte_bpe_50k.json"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    predicted = identify_language(docs.select("doc_id", "text"), fit_dictionaries(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", words_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text", "source"), fit_on_texts(docs))
    secret = F.filter("findings", lambda x: x["is_secret"])
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"),
        F.sha2(F.array_join(F.array_sort(F.transform(secret, lambda x: x["candidate"])), ","), 256).alias("secrets_sha256"), F.round(F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)), 6).alias("max_score"),
    )


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    trees = materialise(build_trees(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path), "count-trees")
    return apply_edits(derived_edits(trees), path).select("doc_id", *RESULTS)


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(derived_messages(read_table(spark, sf_dir, "conversations")), tools_table(spark))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), fit_voters(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_held_out().alias("held_out"), "score", "predicted")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read_table(spark, sf_dir, "documents"), without_one))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_bpe, op3_fingerprints, op4_language, op5_decontaminate, op6_secrets, op7_edit_counts, op8_tool_calls, op9_html_text, op10_ngram_join, op11_periodic_runs, op12_quality, op13_spelling)}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The rest is beyond SQL: tokenizers, automata, compression, hashing in chunks, forests, trees of counts, HTML, votes, checksums of words.
ORACLES: dict[str, str] = {
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(k) WHERE len(w) > 0),
 dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - n + 2)) r(k) WHERE len(w) >= n),
 h AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) r(p) GROUP BY 1), m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, text, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' ')))) ELSE [] END AS g FROM d),
 n AS (SELECT doc_id, len(g) AS size, CASE WHEN text IS NULL THEN 'doc' || doc_id WHEN len(g) = 0 THEN 'text' || text ELSE 'runs' || array_to_string(g, '/') END AS node FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s),
 rep AS (SELECT node, min(doc_id) AS r, any_value(size) AS size, count(*) AS copies FROM n GROUP BY 1), re AS (SELECT r, size, g FROM rep JOIN e ON e.doc_id = r),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.size) AS sa, any_value(b.size) AS sb FROM re a JOIN re b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-6),
 t AS (SELECT r AS node, r AS root FROM rep UNION SELECT p.b, t.root FROM t JOIN p ON p.a = t.node), c AS (SELECT node, min(root) AS class_id FROM t GROUP BY 1),
 l AS (SELECT a, count(*) AS texts, sum(copies) AS docs FROM p JOIN rep ON p.b = r GROUP BY 1)
SELECT n.doc_id, class_id, CAST(coalesce(docs, 0) + copies - 1 AS BIGINT) AS n_links, coalesce(texts, 0) AS n_text_links, copies AS n_copies FROM n JOIN rep USING (node) JOIN c ON c.node = r LEFT JOIN l ON l.a = r""",
}
