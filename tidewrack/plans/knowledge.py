"""More queries of the knowledge pipeline: the kept store, reports, checks of the corpus, ordered joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import render
from tidewrack.functions import text as X
from tidewrack.functions.keys import blank, norm_key
from tidewrack.operators import asof, checks, conflicts, folds, graph, quarantine, store
from tidewrack.operators.ranking import rank_within
from tidewrack.operators.topic_store import TopicStore
from tidewrack.plans.reference import QUESTION, artifacts, entities, readings, topic_state
from tidewrack.session import materialize, shared_dir
from tidewrack.sources import corpus
from tidewrack.sources.connectors import json_line, write_jsonl
from tidewrack.sources.tables import table

#: Readings up to the first third of all numbers make the first batch of the kept store, the rest the second.
FIRST_BATCH = 1 / 3
#: Phrases that no text may hold if a question about them is to have no answer.
FORBIDDEN = ("root cause of the outage", "signed the lease", "schema migration", "retry logic")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewrack-{name}-{uuid.uuid4().hex}"


def _two_batches(spark: SparkSession, d: str) -> tuple[TopicStore, DataFrame, DataFrame]:
    r = readings(spark, d)
    last = (r.agg(F.max("seq")).head()[0] or 0) * FIRST_BATCH
    return TopicStore(spark, _folder(spark, "store")), r.where(F.col("seq") <= last), r.where(F.col("seq") > last)


def stored_topics(spark: SparkSession, d: str) -> DataFrame:
    kept, first, second = _two_batches(spark, d)
    kept.upsert(first)
    return kept.upsert(second).select("topic", "status", "confidence", "blocker", "owner", "mentions", "first_seen", "last_seen", "updates")


def store_batches(spark: SparkSession, d: str) -> DataFrame:
    kept, first, second = _two_batches(spark, d)
    parts = [kept.upsert(b, i).where(F.col("changed_in") == i).agg(F.lit(i).alias("batch"), F.count_if(F.col("made_in") == i).alias("created"), F.count_if(F.col("made_in") < i).alias("updated")) for i, b in enumerate((first, second))]
    return parts[0].unionByName(parts[1])


def stale_after_batch(spark: SparkSession, d: str) -> DataFrame:
    kept, first, second = _two_batches(spark, d)
    text = render.embedding_text(F.col("topic"), F.col("status"), F.col("owner"), F.col("blocker"))
    kept.set_embedded(kept.upsert(first).withColumn("text", text))
    return store.stale_embeddings(kept.upsert(second).withColumn("text", text)).select("topic", "text")


def status_items(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.array(F.struct(F.lit("store").alias("artifact_id"), F.col("topic").alias("span")))
    item = F.to_json(F.struct(F.lit("store").alias("source"), "topic", "status", "owner", "blocker", "confidence", pieces.alias("evidence")))
    return topic_state(spark, d).select("topic", F.coalesce(checks.item_reason(item), F.lit("sound")).alias("verdict"))


def item_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 8
    pieces = F.when(k != 6, F.array(F.struct(F.lit("e1").alias("artifact_id"), F.when(k == 7, F.lit(" ")).otherwise(F.col("topic")).alias("span")))).otherwise(F.array().cast("array<struct<artifact_id:string,span:string>>"))
    item = F.to_json(F.struct(F.when(k != 1, F.col("source")).alias("source"), F.when(k == 5, F.lit("  ")).otherwise(F.col("topic")).alias("topic"), F.when(k == 2, F.lit("fine")).otherwise(F.col("status")).alias("status"), F.when(k == 3, F.lit("sure")).otherwise(F.col("confidence")).alias("confidence"), F.when(k == 4, F.lit(1)).alias("extra"), pieces.alias("evidence")))
    return readings(spark, d).groupBy(F.coalesce(checks.item_reason(item), F.lit("sound")).alias("verdict")).agg(F.count("*").alias("n"))


def claim_positions(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.conflict_positions(readings(spark, d))


def briefing_text(spark: SparkSession, d: str) -> DataFrame:
    state = materialize(topic_state(spark, d))
    shown = store.briefing(state)
    return spark.createDataFrame([(render.briefing(shown.collect(), store.briefing_tail(state, shown).collect()),)], "text string")


def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    e = store.first_deliveries(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "loaded_at"), "evidence_id", ["loaded_at"])
    e = e.select("evidence_id", "topic_key", norm_key(F.col("artifact_id")).alias("artifact_id"))
    top = store.evidence_for(e, artifacts(spark, d, texts=False).select("artifact_id", F.unix_timestamp("ts").alias("ts")))
    listed = top.groupBy("topic_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]), " ").alias("evidence"))
    topics = table(spark, d, "topic_evidence", "topic_key").distinct()
    return topics.join(listed, "topic_key", "left")


def topic_aliases(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "topic_evidence", "topic_key").distinct().select("topic_key", F.explode(X.tokens(F.col("topic_key"))).alias("token"))
    return asked.join(graph.alias_table(entities(spark, d)), "token").select("topic_key", "entity").distinct()


def alias_phrases(spark: SparkSession, d: str) -> DataFrame:
    return graph.phrase_matches(artifacts(spark, d), entities(spark, d)).groupBy("entity").agg(F.count("*").alias("n"))


def artifact_aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_keys(artifacts(spark, d)).groupBy("alias").agg(F.count("*").alias("n"))


def posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    block = F.floor(F.col("doc_id") / 1000)
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    return x.groupBy("token", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_set("doc_id")), " ").alias("docs"))


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "ts", "value").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return e.cube("event_type", "month").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def topic_quarters(spark: SparkSession, d: str) -> DataFrame:
    x = topic_state(spark, d).select(F.lit(1).alias("all"), (-F.col("mentions")).alias("m"), "topic")
    ranked = materialize(rank_within(x, ["all"], ["m", "topic"]))
    return asof.ntiles(ranked, "rank", 4, ranked.count(), "quarter").select("topic", "quarter", "rank")


def status_turns(spark: SparkSession, d: str) -> DataFrame:
    x = asof.with_previous(readings(spark, d).select("topic", "seq", "status"), ["topic"], "seq", ["status"])
    return x.where("status <> previous_status").groupBy("topic", "previous_status", "status").agg(F.count("*").alias("n"))


def last_view_before(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = e.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("ts").alias("viewed_at"), F.col("value").alias("viewed"))
    return asof.asof_join(bought, seen, ["user_id"], "ts", "ts", ["viewed_at", "viewed"], "event_id").select("event_id", "viewed_at", "viewed")


def daily_balance(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d, texts=False).where("ts IS NOT NULL").select("source", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    per = lambda s: a.where(F.col("source") == s).groupBy("day").agg(F.count("*").alias(s))
    return per("email").join(per("ticket"), "day", "full").select("day", F.coalesce("email", F.lit(0)).alias("mails"), F.coalesce("ticket", F.lit(0)).alias("tickets"))


def chunk_usage(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d).select(F.lit(1).alias("all"), "artifact_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    chunk = F.floor((F.col("rank") - 1) / 40).cast("bigint")
    return rank_within(x, ["all"], ["artifact_id"]).groupBy(chunk.alias("chunk")).agg(F.count("*").alias("artifacts"), F.sum("chars").alias("chars"))


def corpus_order(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d, texts=False).select(F.lit(1).alias("all"), F.coalesce(F.unix_timestamp("ts"), F.lit(1 << 40)).alias("at"), "artifact_id")
    return rank_within(x, ["all"], ["at", "artifact_id"], "place").select("artifact_id", "place")


def message_positions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "messages", "source", "id", "ingested_at").where("id IS NOT NULL AND source IS NOT NULL").distinct()
    r = rank_within(x, ["source"], ["ingested_at", "id"], "n")
    return r.select("id", "ingested_at", F.concat(F.lit("msg_"), F.col("n").cast("string")).alias("position"), "source")


def artifact_lines(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d).select("artifact_id", "source", "container_id", "parent_id", "sender_id", "text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    return x.select("artifact_id", F.md5(json_line(x.columns)).alias("line"))


def warning_report(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "email").unionByName(table(spark, d, "ticket"))
    found = F.array_compact(F.array(*[F.when(blank(F.col(c)), F.concat(F.col("source"), F.lit(f": no {c}"))) for c in ("container_id", "sender_id", "ts", "text")]))
    return x.select(F.explode(found).alias("warning")).groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning").limit(12)


def failure_report(spark: SparkSession, d: str) -> DataFrame:
    x = quarantine.failed_lines(table(spark, d, "slack_02_broken")).orderBy("file_name", "line_no", "line").limit(25)
    return x.select("file_name", "line_no", "reason", quarantine.shortened(F.col("line")).alias("raw"))


def hidden_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "email", F.lit("email").alias("of"), "artifact_id", "meta", "raw").unionByName(table(spark, d, "ticket", F.lit("ticket").alias("of"), "artifact_id", "meta", "raw"))
    return checks.field_prefixes(x.unionByName(table(spark, d, "slack_01_clean", F.lit("slack_01_clean").alias("of"), "artifact_id", "meta", "raw")), "of", ["meta", "raw"])


def unresolved_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subject_labels", "doc_id").distinct().join(table(spark, d, "documents", "doc_id"), "doc_id", "left_anti")


def disjoint_replies(spark: SparkSession, d: str) -> DataFrame:
    return checks.disjoint_steps(artifacts(spark, d))


def forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    return checks.phrase_counts(artifacts(spark, d).select("text"), FORBIDDEN)


def corpus_digests(spark: SparkSession, d: str) -> DataFrame:
    return checks.digests(artifacts(spark, d).select("source", "artifact_id", "text"), "source", ["artifact_id", "text"])


def fact_caps(spark: SparkSession, d: str) -> DataFrame:
    return checks.fact_caps(artifacts(spark, d).select("artifact_id", F.explode(X.aliases(F.col("text"))).alias("fact")))


def silent_recipients(spark: SparkSession, d: str) -> DataFrame:
    return checks.silent(artifacts(spark, d, texts=False).where("source = 'email'"), 48)


def corpus_loaded(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "corpus")
    columns = ["artifact_id", "source", "container_id", "parent_id", "sender_id", "recipients", "ts", "text"]
    write_jsonl(table(spark, d, "email").unionByName(table(spark, d, "ticket")).select(*columns), path)
    good, failed = corpus.load_corpus(spark, f"{path}/*", "*")
    ok = corpus.corpus_messages(good).groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("message").alias("outcome"), "n")
    return ok.unionByName(failed.groupBy(F.regexp_extract("reason", "^[a-z_]+", 0).alias("outcome")).agg(F.count("*").alias("n")).select(F.lit("").alias("source"), "outcome", "n"))


def asked_artifacts(spark: SparkSession, d: str) -> DataFrame:
    parts = artifacts(spark, d)
    words, named = graph.asked_words(spark, QUESTION)
    known = graph.alias_table(entities(spark, d)).where(F.col("token").isin(*words, *named)).select("entity").distinct()
    by_entity = parts.select("artifact_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).join(graph.alias_table(entities(spark, d)), "token").join(known, "entity").select("artifact_id")
    return by_entity.unionByName(graph.alias_keys(parts).where(F.col("alias").isin(*named)).select("artifact_id")).distinct()


def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = store.first_deliveries(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "loaded_at"), "evidence_id", ["loaded_at"]).withColumn("artifact_id", norm_key(F.col("artifact_id")))
    known = artifacts(spark, d, texts=False).select("artifact_id", F.array("artifact_id").alias("known"))
    none = F.array().cast("array<string>")
    x = e.join(known, "artifact_id", "left").select(F.col("artifact_id").isNull().alias("abstained"), F.when(F.col("artifact_id").isNull(), none).otherwise(F.array("artifact_id")).alias("cited"), F.coalesce("known", none).alias("known"), none.alias("who"))
    return x.groupBy(F.coalesce(checks.answer_reason(F.col("abstained"), F.col("cited"), F.col("known"), F.col("who")), F.lit("sound")).alias("verdict")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        stored_topics, store_batches, stale_after_batch, status_items, item_verdicts, claim_positions, briefing_text, evidence_lists, topic_aliases, alias_phrases, artifact_aliases, posting_blocks, event_cube,
        topic_quarters, status_turns, last_view_before, daily_balance, chunk_usage, corpus_order, message_positions, artifact_lines, warning_report, failure_report, hidden_keys, unresolved_labels, disjoint_replies,
        forbidden_phrases, corpus_digests, fact_caps, silent_recipients, corpus_loaded, asked_artifacts, answer_verdicts,
    )
}
