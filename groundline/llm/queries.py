"""The registered queries of the numbered problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import dialogues, leakage, lookalike, neighbors, pairs, sentences, splitting, tokens
from groundline.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, sf_dir, "document_chunks"), k=5, least=0.9).toDF("chunk_a", "chunk_b")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chunk above 1,000 characters."""
    pieces = splitting.split_oversized(table(spark, sf_dir, "document_chunks"))
    return pieces.withColumnsRenamed({"id": "chunk_id", "text": "piece_text"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece = 0").select("chunk_id")


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations, one row for each turn."""
    return dialogues.conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogues.verdicts(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return found.filter("reason is not null").select("conversation_id")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by time alone, split at the calibrated gap."""
    return dialogues.sessions(table(spark, sf_dir, "messages"))


def _course_names(spark: SparkSession, sf_dir: str, field: str, code: str) -> DataFrame:
    rows = table(spark, sf_dir, "course_documents").select("id", F.col(field).alias("value"))
    names = table(spark, sf_dir, "course_catalog").select(F.col(code).alias("name_key"), F.col(field).alias("name")).distinct()
    found = lookalike.match_names(rows, names)
    return found.select(F.lit(field).alias("field"), F.least("id", "name_key").alias("key_a"), F.greatest("id", "name_key").alias("key_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(table(spark, sf_dir, "document_chunks").select("id", F.col("text").alias("value")))
    alike = lookalike.pairs(lookalike.classes(lookalike.suspects(texts))).select(F.lit("text").alias("field"), "key_a", "key_b")
    return _course_names(spark, sf_dir, "subject", "subject_code").unionByName(_course_names(spark, sf_dir, "course_id", "course_code")).unionByName(alike)


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk text in its one form, as a hash, with whether the form differs from the text as stored. Texts delivered twice count once."""
    done = lookalike.canonical(table(spark, sf_dir, "document_chunks").select("id", F.col("text").alias("value")))
    return done.select(F.col("id").alias("chunk_id"), F.sha2("canonical", 256).alias("canonical_sha256"), (F.col("canonical") != F.col("value")).alias("changed")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(spread(table(spark, sf_dir, "messages").select("id", "conversation_id", "position", "role", "content", "payload")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_questions"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_ends(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p3_sessions": p3_sessions,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

TRUSTED = """
    m AS (SELECT DISTINCT id, conversation_id AS c, position AS p, lower(trim(role)) AS r, content, created_at FROM messages WHERE conversation_id IS NOT NULL),
    k AS (SELECT c, min(p) AS lo FROM m GROUP BY c
          HAVING count(*) = count(p) AND count(DISTINCT p) = count(*) AND max(p) - min(p) + 1 = count(*) AND count(*) % 2 = 0
             AND bool_and(regexp_matches(coalesce(content, ''), '[\\p{L}\\p{N}]'))),
    t AS (SELECT k.c, k.lo FROM k JOIN m USING (c) GROUP BY 1, 2
          HAVING bool_and(coalesce(m.r = CASE WHEN (m.p - k.lo) % 2 = 0 THEN 'user' ELSE 'assistant' END, false))),
    kept AS (SELECT c, lo FROM t WHERE c IN (SELECT id FROM conversations))
"""

ORACLE: dict[str, str] = {
    "p2_found": "SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE length(text) > 1000",
    "p3_found": f"""WITH {TRUSTED} SELECT id AS conversation_id FROM
        (SELECT id FROM conversations WHERE id IS NOT NULL UNION SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL)
        WHERE id NOT IN (SELECT c FROM kept)""",
    "p3_conversations": f"""WITH {TRUSTED} SELECT m.c AS conversation_id, m.p - kept.lo AS turn, m.r AS role, m.content, m.created_at FROM m JOIN kept USING (c)""",
}
