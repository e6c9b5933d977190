"""Queries of the problems of language-model training data, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import bpe, conversations, packing, pii, subjects
from tidewrack.sources.tables import table

#: Capacity, in tokens, of the containers of p8.
CAPACITY = 2048


def _texts(spark: SparkSession, d: str) -> DataFrame:
    email = table(spark, d, "email", "artifact_id", "text").select(F.lit("email").alias("src"), F.col("artifact_id").alias("rec_id"), "text")
    return email.unionByName(table(spark, d, "messages", "id", "text").select(F.lit("messages").alias("src"), F.col("id").alias("rec_id"), "text"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "employees").where("coalesce(role, '') <> 'bot'").select("name").unionByName(table(spark, d, "externals", "name"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(_texts(spark, d), _people(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_texts(spark, d), _people(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "email"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", bpe.encode(F.col("text")).alias("ids"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents", "doc_id", "text").select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", bpe.decode(F.col("ids")).alias("text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "documents", "doc_id", "text").select("doc_id", bpe.token_count(F.col("text")).alias("size"))
    return packing.pack(sized, "doc_id", "size", CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels")).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p5_found, p7_ids, p7_roundtrip, p8_containers, p9_found)}

_KEY = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')"

ORACLE = {
    "p5_found": f"""
        WITH RECURSIVE mails AS (
            SELECT {_KEY.format('artifact_id')} AS a, {_KEY.format('container_id')} AS c, trim(container_id) AS container_id, {_KEY.format('parent_id')} AS p, upper(nullif(trim(sender_id), '')) AS sender,
                   try_cast(ts AS TIMESTAMPTZ) AS instant, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) > 0 AS said, trim(artifact_id) AS artifact_id
            FROM email QUALIFY row_number() OVER (PARTITION BY {_KEY.format('artifact_id')} ORDER BY loaded_at DESC) = 1),
        checked AS (
            SELECT m.c, count(*) FILTER (m.p IS NULL) AS roots, count(*) FILTER (m.p IS NOT NULL AND k.a IS NULL) AS gaps, count(*) FILTER (m.instant IS NULL) AS timeless, max(m.sender) FILTER (m.p IS NULL) AS opener, count(*) AS n
            FROM mails m LEFT JOIN mails k ON k.c = m.c AND k.a = m.p WHERE m.c IS NOT NULL GROUP BY m.c),
        sound AS (SELECT * FROM checked WHERE roots = 1 AND gaps = 0 AND timeless = 0),
        tree AS (SELECT m.c, m.a FROM mails m JOIN sound s ON s.c = m.c WHERE m.p IS NULL UNION SELECT m.c, m.a FROM mails m JOIN tree t ON m.c = t.c AND m.p = t.a),
        whole AS (SELECT s.c, s.opener FROM sound s JOIN (SELECT c, count(*) AS n FROM tree GROUP BY c) t ON t.c = s.c AND t.n = s.n),
        turns AS (
            SELECT m.*, CASE WHEN m.sender IS NULL THEN 'unknown' WHEN starts_with(m.sender, 'BOT_') THEN 'system' WHEN m.sender = w.opener THEN 'opener' ELSE 'replier' END AS speaker
            FROM mails m JOIN whole w ON w.c = m.c WHERE m.said)
        SELECT container_id, CAST(row_number() OVER (PARTITION BY c ORDER BY instant, a) AS INTEGER) AS turn_no, artifact_id, speaker FROM turns
        WHERE c IN (SELECT c FROM turns GROUP BY c HAVING count(*) FILTER (speaker = 'opener') > 0 AND count(*) FILTER (speaker = 'replier') > 0)
    """,
    "p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
