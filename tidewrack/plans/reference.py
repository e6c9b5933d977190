"""Queries of the knowledge pipeline's own operators on the test tables, and the SQL that states their results.

Roles of the tables: readings of a status are ``events`` (topic: user, status: event type, confidence: value, seen by the
day); artifacts are ``email`` and ``ticket``; evidence is ``topic_evidence``; documents and embeddings are themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.functions import render
from tidewrack.functions import text as X
from tidewrack.functions.keys import norm_key
from tidewrack.operators import checks, conflicts, evidence, folds, graph, provider, retrieval, store
from tidewrack.operators.ranking import rank_within
from tidewrack.session import materialize
from tidewrack.sources.mail import leaf_parts, mail_records
from tidewrack.sources.tables import table
from tidewrack.streaming import incremental

#: The question of the retrieval queries, the terms of the keyword search.
QUESTION = "Who is blocked by the retry logic and the schema migration of svc-payout?"
TERMS = ["retry logic", "schema migration", "blocked", "audit"]
#: Instant that divides stored from arriving messages.
CUT = "2026-03-01 00:00:00"

_STATUS = {"error": "blocked", "signup": "at_risk", "click": "unclear", "view": "unclear", "purchase": "on_track"}


def readings(spark: SparkSession, d: str) -> DataFrame:
    """topic, status, confidence, owner, blocker, seen_at, seq, and the ranks packed into one number."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _STATUS.items()], F.lit("unclear"))
    confidence = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 20, "medium").otherwise("low")
    fifth = (F.col("event_id") % 5).cast("string")
    x = e.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("topic"), status.alias("status"), confidence.alias("confidence"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("owner "), (F.col("event_id") % 7).cast("string"))).alias("owner"),
        F.when((status == "blocked") | (F.col("event_id") % 11 == 0), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("part "), fifth, F.lit(" is missing"))).otherwise(F.concat(F.lit("budget "), fifth, F.lit(" was cut")))).alias("blocker"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("seen_at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "slack").otherwise("email").alias("source"),
    )
    importance = folds.rank_of(F.col("status"), folds.STATUS_RANK) * 10 + folds.rank_of(F.col("confidence"), folds.CONFIDENCE_RANK)
    return x.withColumn("importance", importance.cast("bigint")).withColumn("state_rank", (F.datediff("seen_at", F.lit("1970-01-01")) * 100 + importance).cast("bigint"))


def artifacts(spark: SparkSession, d: str, texts: bool = True) -> DataFrame:
    return graph.normalized_artifacts(table(spark, d, "email"), table(spark, d, "ticket"), texts=texts)


def entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "employees").where("employee_id IS NOT NULL").select(F.upper(norm_key(F.col("employee_id"))).alias("entity"), F.filter(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "email", "slack_handle")), lambda t: t.isNotNull()).alias("terms"))
    return e.unionByName(table(spark, d, "externals").where("entity_id IS NOT NULL").select(F.upper(norm_key(F.col("entity_id"))).alias("entity"), F.filter(F.array("name"), lambda t: t.isNotNull()).alias("terms")))


def topic_state(spark: SparkSession, d: str) -> DataFrame:
    return folds.topic_state(readings(spark, d), "topic", "state_rank", "seq")


def ranked_blocked_topics(spark: SparkSession, d: str) -> DataFrame:
    x = store.ranked_topics(topic_state(spark, d), "blocked")
    return x.orderBy(F.desc("urgency"), F.desc("last_seen"), F.desc("mentions"), "topic").limit(12).select("topic", "urgency", "last_seen", "mentions")


def briefing_top12(spark: SparkSession, d: str) -> DataFrame:
    return store.briefing(topic_state(spark, d)).select("topic", "status", "confidence", "owner", "blocker")


def briefing_tail(spark: SparkSession, d: str) -> DataFrame:
    state = topic_state(spark, d)
    return store.briefing_tail(state, store.briefing(state))


def topic_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return topic_state(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return topic_state(spark, d).agg(F.count("*").alias("topics"), F.sum("mentions").alias("readings"), F.sum("updates").alias("updates"), F.count_if(F.col("owner").isNotNull()).alias("owned"))


def topic_history_last6(spark: SparkSession, d: str) -> DataFrame:
    return store.history(readings(spark, d), "topic", 6).select("topic", "seq", "status", "confidence", "place")


def merged_items(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_items(readings(spark, d), "topic", "importance", "seq")


def deduped_items(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d).withColumn("topic", X.claim_key(F.concat(F.lit("  "), F.upper("topic"))))
    x = x.withColumn("coarse", (folds.rank_of(F.col("status"), folds.STATUS_RANK) * 10 + F.when(F.col("confidence") == "high", 1).otherwise(0)).cast("bigint"))
    return folds.merge_items(x, "topic", "coarse", "seq")


def message_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", "source", "sender", "timestamp", "text")
    return m.select(X.message_id(F.lit(None).cast("string"), F.col("source"), F.col("sender"), F.col("timestamp"), F.col("text")).alias("message_id")).groupBy("message_id").agg(F.count("*").alias("n"))


def new_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", "id", "source", "ingested_at")
    early = F.col("ingested_at") < F.lit(CUT).cast("timestamp_ntz")
    return store.new_rows(m.where(~early), m.where(early), "id", ["ingested_at"]).select("id", "source", "ingested_at")


def evidence_verified(spark: SparkSession, d: str) -> DataFrame:
    checked = evidence.checked_evidence(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "span"), artifacts(spark, d))
    return checked.groupBy("evidence_id", "verdict").agg(F.count("*").alias("n"))


def topics_without_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.dropped_topics(evidence.checked_evidence(table(spark, d, "topic_evidence", "topic_key", "artifact_id", "span"), artifacts(spark, d)))


def evidence_top6(spark: SparkSession, d: str) -> DataFrame:
    e = store.first_deliveries(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "loaded_at"), "evidence_id", ["loaded_at"])
    e = e.select("evidence_id", "topic_key", norm_key(F.col("artifact_id")).alias("artifact_id"))
    return store.evidence_for(e, artifacts(spark, d, texts=False).select("artifact_id", F.unix_timestamp("ts").alias("ts"))).select("topic_key", "evidence_id", "artifact_id", "ts", "place")


def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    e = store.first_deliveries(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "span", "loaded_at"), "evidence_id", ["loaded_at"])
    e = e.select("topic_key", norm_key(F.col("artifact_id")).alias("artifact_id"), "span", "evidence_id")
    return folds.union_evidence(e, ["topic_key", "artifact_id"], "span", "evidence_id")


def topic_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("topic_key")
    x = table(spark, d, "topic_evidence", "topic_key").select(X.topic_key(k).alias("store_key"), X.topic_key(k, X.MERGE_KEY_WORDS).alias("merge_key"), X.claim_key(k).alias("subject_key"))
    return x.groupBy("store_key", "merge_key", "subject_key").agg(F.count("*").alias("n"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequency(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    x = retrieval.bm25(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", QUESTION).withColumn("score", F.round("score", 6))
    return x.orderBy(F.desc("score"), "doc_id").limit(15)


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    x = retrieval.keyword_score(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", TERMS)
    return x.orderBy(F.desc("score"), "doc_id").limit(20)


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.cosine_top(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 8).select("query_id", "id", "score")


def context_union(spark: SparkSession, d: str) -> DataFrame:
    topics = store.ranked_topics(topic_state(spark, d))
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    near = retrieval.cosine_top(v.where("vec_id = 0"), v, "vec_id", "embedding", 8).select(F.concat(F.lit("user "), F.col("id").cast("string")).alias("topic"))
    return retrieval.with_urgent(near.join(topics.select("topic"), "topic", "left_semi"), topics)


def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    now = folds.topic_state(r, "topic", "state_rank", "seq").select("topic", F.concat_ws(". ", "topic", "status", "owner", "blocker").alias("text"))
    before = folds.topic_state(r.where("seen_at < timestamp_ntz'2024-01-20 00:00:00'"), "topic", "state_rank", "seq").select("topic", F.concat_ws(". ", "topic", "status", "owner", "blocker").alias("embedded_for"))
    return store.stale_embeddings(now.join(before, "topic", "left")).select("topic", "text")


def alias_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "email", "text").unionByName(table(spark, d, "ticket", "text")).select(F.explode(X.aliases(F.col("text"))).alias("alias"))
    return x.groupBy("alias").agg(F.count("*").alias("n"))


def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    words = artifacts(spark, d).select("artifact_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    hits = words.join(graph.alias_table(entities(spark, d)), "token").select("artifact_id", "entity").distinct()
    return hits.groupBy("entity").agg(F.count("*").alias("n"))


def _seeds(spark: SparkSession, d: str, parts: DataFrame, source: str | None = None) -> DataFrame:
    x = retrieval.bm25(parts, "artifact_id", "text", QUESTION).withColumn("score", F.round("score", 6))
    x = x.orderBy(F.desc("score"), "artifact_id").limit(20)
    if source:
        x = x.join(parts.where(F.col("source") == source).select("artifact_id"), "artifact_id", "left_semi")
    return x.select("artifact_id")


def _found(parts: DataFrame, table: DataFrame) -> Callable[[str | None], tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """(seeds, artifacts, links, alias keys) of the question over all artifacts, or over those of one source only; ranks are always those among all."""
    links = materialize(graph.artifact_entities(parts, table))
    ranked = retrieval.bm25(parts, "artifact_id", "text", QUESTION).withColumn("score", F.round("score", 6))
    keys = materialize(graph.alias_keys(parts))

    def of(source: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        here = parts.where(F.col("source") == source) if source else parts
        own = lambda x: x.join(here.select("artifact_id"), "artifact_id", "left_semi") if source else x
        return graph.seeds(QUESTION, ranked, here, own(links), table, keys), here, own(links), own(keys)

    return of


def retrieval_hops(spark: SparkSession, d: str) -> DataFrame:
    seeds, parts, links, keys = _found(materialize(artifacts(spark, d)), graph.alias_table(entities(spark, d)))(None)
    return graph.retrieve(seeds, parts, links, question=QUESTION, keys=keys).select("artifact_id", "hop", F.size("path").alias("path_length"))


def source_retrieval(spark: SparkSession, d: str) -> DataFrame:
    of = _found(materialize(artifacts(spark, d)), graph.alias_table(entities(spark, d)))

    def only(source: str) -> DataFrame:
        seeds, parts, links, keys = of(source)
        return graph.retrieve(seeds, parts, links, question=QUESTION, keys=keys).select("artifact_id", "hop", F.size("path").alias("path_length"), F.lit(source).alias("only"))

    return only("email").unionByName(only("ticket"))


def retrieval_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _found(materialize(artifacts(spark, d)), graph.alias_table(entities(spark, d)))(None)[0]


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.artifact_entities(artifacts(spark, d), graph.alias_table(entities(spark, d))).groupBy("entity").agg(F.count("*").alias("n"))


def source_ablation(spark: SparkSession, d: str) -> DataFrame:
    parts = artifacts(spark, d)
    return _seeds(spark, d, parts, "email").withColumn("only", F.lit("email")).unionByName(_seeds(spark, d, parts, "ticket").withColumn("only", F.lit("ticket")))


def thread_neighbours(spark: SparkSession, d: str) -> DataFrame:
    parts = artifacts(spark, d, texts=False).where("container_id IS NOT NULL")
    sizes = parts.groupBy("container_id").agg((F.count("*") - 1).alias("n")).where("n > 0")
    return parts.where("parent_id IS NULL").select("container_id", F.col("artifact_id").alias("from_id")).join(sizes, "container_id").select("from_id", "n")


def time_neighbours(spark: SparkSession, d: str) -> DataFrame:
    parts = artifacts(spark, d)
    sent = parts.where("sender_id IS NOT NULL").select("artifact_id", F.col("sender_id").alias("entity"))
    return graph.time_neighbours(_seeds(spark, d, parts), parts, sent)


def conflicting_claims(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.conflicts(readings(spark, d)).select("subject", "seq_a", "seq_b", "claim_a", "claim_b", "winner")


def owner_referral(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "employees", "employee_id", "name", "manager_id", "loaded_at").withColumn("employee_id", F.upper(norm_key(F.col("employee_id"))))
    e = store.first_deliveries(e, "employee_id", ["loaded_at"]).select("employee_id", "name", F.upper(norm_key(F.col("manager_id"))).alias("manager_id"))
    boss = e.select(F.col("employee_id").alias("manager_id"), F.col("name").alias("refer_to"))
    sent = artifacts(spark, d, texts=False).where("source = 'ticket' AND parent_id IS NULL AND sender_id IS NOT NULL").groupBy(F.col("sender_id").alias("employee_id")).agg(F.count("*").alias("tickets"))
    return sent.join(e, "employee_id").join(boss, "manager_id", "left").select("employee_id", "tickets", F.coalesce("refer_to", "name").alias("refer_to"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "subject_labels", "doc_id", "subject").where("subject = 'software'").select("doc_id").distinct()
    ranked = retrieval.bm25(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", QUESTION).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(50)
    both = gold.join(ranked.withColumn("hit", F.lit(True)), "doc_id", "left").agg(F.count("hit").alias("found"), F.count("*").alias("gold"))
    return both.select("found", "gold", F.round(F.col("found") / F.col("gold"), 6).alias("recall"))


def fabricated_citations(spark: SparkSession, d: str) -> DataFrame:
    e = store.first_deliveries(table(spark, d, "topic_evidence", "evidence_id", "topic_key", "artifact_id", "loaded_at"), "evidence_id", ["loaded_at"]).withColumn("artifact_id", norm_key(F.col("artifact_id"))).where("artifact_id IS NOT NULL")
    answer = F.concat(F.lit("It stands in ["), "artifact_id", F.lit(", eml_none] and [chk-1; bad id]."))
    known = artifacts(spark, d, texts=False).select("artifact_id", F.array("artifact_id").alias("available"))
    x = e.join(known, "artifact_id", "left").withColumn("cited", X.citations(answer))
    x = evidence.fabricated(x, "cited", "available")
    return x.select("evidence_id", F.size("cited").alias("cited"), F.array_join("fabricated", ",").alias("fabricated"))


def mail_bodies(spark: SparkSession, d: str) -> DataFrame:
    return mail_records(table(spark, d, "gmail_raw", "id", "snippet", "internalDate", "payload")).select("id", "sender", "epoch_ms", "text").distinct()


def html_bodies(spark: SparkSession, d: str) -> DataFrame:
    sample = F.concat(F.lit("<p>"), "snippet", F.lit("</p> &amp;\t<b>x</b>&nbsp;&mdash;"))
    return table(spark, d, "gmail_raw", "id", "snippet").select("id", X.html_text(sample).alias("text")).distinct()


def html_parts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gmail_raw", "id", "payload")
    parts = g.select("id", F.explode(leaf_parts(F.col("payload"), g.schema["payload"].dataType)).alias("p")).where("p.mime = 'text/html' AND p.data <> ''")
    return parts.select("id", X.html_text(X.base64url_text(F.col("p.data"))).alias("text")).distinct()


def artifact_validation(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "email").unionByName(table(spark, d, "ticket")).select(checks.artifact_reason().alias("reason"))
    return x.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events", "props").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return x.groupBy("k").agg(F.count("*").alias("n"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d, texts=False).where("source = 'ticket' AND container_id IS NOT NULL").select(F.lit(1).alias("batch"), "artifact_id")
    r = rank_within(x, ["batch"], ["artifact_id"], "rank")
    return r.select("artifact_id", F.floor((F.col("rank") - 1) / 40).cast("bigint").alias("chunk"))


def _chunked(parts: DataFrame) -> DataFrame:
    """artifact_id, text if there is one, chunk: all artifacts in chunks of 40 by id."""
    kept = [c for c in ("artifact_id", "text") if c in parts.columns]
    r = rank_within(parts.select(F.lit(1).alias("batch"), *kept), ["batch"], ["artifact_id"], "rank")
    return r.select(*kept, F.floor((F.col("rank") - 1) / 40).cast("bigint").alias("chunk"))


def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(artifacts(spark, d, texts=False)).select("artifact_id", "chunk")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d, texts=False).where("container_id IS NOT NULL").select("container_id", "artifact_id", F.unix_timestamp("ts").alias("at"))
    return folds.top_per_key(x, ["container_id"], [F.desc_nulls_last("at"), F.desc("artifact_id")], 8).select("container_id", "artifact_id", "place")


def request_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return folds.most_within(e, "user_id", "s", 60).withColumnRenamed("most", "peak")


def dangling_parents(spark: SparkSession, d: str) -> DataFrame:
    return checks.dangling_parents(artifacts(spark, d, texts=False))


def unknown_senders(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "employees", F.col("employee_id").alias("person_id")).unionByName(table(spark, d, "externals", F.col("entity_id").alias("person_id")))
    return checks.unknown_senders(artifacts(spark, d, texts=False), people)


def fact_partition(spark: SparkSession, d: str) -> DataFrame:
    facts = artifacts(spark, d).select(F.coalesce("container_id", F.lit("-")).alias("container_id"), F.explode(X.aliases(F.col("text"))).alias("fact"))
    return checks.fact_partition(facts)


def silence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return checks.unanswered(artifacts(spark, d, texts=False).where("source = 'email'"))


def channel_outsiders(spark: SparkSession, d: str) -> DataFrame:
    parts = artifacts(spark, d, texts=False).where("source = 'email' AND container_id IS NOT NULL")
    members = parts.where("parent_id IS NULL").select("container_id", F.explode(F.array_union("recipients", F.array("sender_id"))).alias("sender_id")).where("sender_id IS NOT NULL").distinct()
    out = parts.where("parent_id IS NOT NULL AND sender_id IS NOT NULL").join(members, ["container_id", "sender_id"], "left_anti")
    return out.groupBy("container_id", "sender_id").agg(F.count("*").alias("n"))


def answer_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = ["user", "part", "owner"]
    state = topic_state(spark, d)
    hay = F.lower(F.concat_ws(" ", "topic", F.coalesce("blocker", F.lit("none")), F.coalesce("owner", F.lit("none"))))
    hits = sum((F.when(F.contains(hay, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    kept = state.where(F.col("confidence").isin("high", "medium")).withColumn("hits", hits).where("hits > 0")
    kept = kept.withColumn("_c", folds.rank_of(F.col("confidence"), folds.CONFIDENCE_RANK)).withColumn("_s", folds.rank_of(F.col("status"), folds.ANSWER_STATUS_RANK))
    return kept.orderBy(F.desc("_c"), F.desc("_s"), "topic").limit(24).select("topic", "status", "confidence", "hits")


def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "messages", "source", "sender", "timestamp", "text")
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    warnings = F.filter(F.array(F.when(none("sender"), "no sender"), F.when(none("timestamp"), "no timestamp"), F.when(none("text"), "no text")), lambda w: w.isNotNull())
    x = x.select("source", F.explode(F.when(F.size(warnings) > 0, warnings).otherwise(F.array(F.lit("ok")))).alias("warning"))
    return x.groupBy("source", "warning").agg(F.count("*").alias("n"))


def working_days(spark: SparkSession, d: str) -> DataFrame:
    x = topic_state(spark, d).select("topic", F.col("first_seen").cast("date").alias("a"), F.col("last_seen").cast("date").alias("b"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return x.select("topic", F.size(F.filter(F.sequence(lo, hi), lambda t: F.weekday(t) < 5)).alias("days"))


def provider_items(spark: SparkSession, d: str) -> DataFrame:
    x = _chunked(artifacts(spark, d)).select("chunk", F.col("artifact_id").alias("id"), "text")
    return provider.extract_by_chunk(x).select("chunk", "artifact_id", "status", "span", "error").distinct()


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", provider.hashed_embedding(F.col("text")).alias("embedding"))


def item_sentences(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = topic_state(spark, d)
    return x.select("topic", render.item_sentence(c("topic"), c("status"), c("owner"), c("blocker"), F.lit("ev")).alias("sentence"), render.briefing_line(c("topic"), c("owner"), c("blocker"), c("confidence")).alias("line"), render.embedding_text(c("topic"), c("status"), c("owner"), c("blocker")).alias("embedded"))


def conflict_sentences(spark: SparkSession, d: str) -> DataFrame:
    x = conflicts.conflicts(readings(spark, d))
    text = render.conflict_sentence(F.col("subject"), F.col("claim_a"), F.col("seq_a").cast("string"), F.col("claim_b"), F.col("seq_b").cast("string"), F.col("resolution"), F.lit("The later claim counts."))
    return x.select("seq_a", "seq_b", text.alias("sentence"))


def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = table(spark, d, "messages", "id", "source", "sender", "timestamp", "text").where("id IS NOT NULL")
    return x.select("id", F.md5(render.message_block(c("id"), c("source"), c("sender"), c("timestamp"), c("text"))).alias("block")).distinct()


def topic_lookup(spark: SparkSession, d: str) -> DataFrame:
    state = topic_state(spark, d)
    return store.looked_up(state, "topic", "user 7", 3).select("topic", "status")


def container_winner(spark: SparkSession, d: str) -> DataFrame:
    x = artifacts(spark, d, texts=False).where("container_id IS NOT NULL AND ts IS NOT NULL")
    last = F.max_by("artifact_id", F.struct("ts", F.when(F.col("source") == "ticket", 1).otherwise(0), "artifact_id"))
    return x.groupBy("container_id").agg(last.alias("winner"), F.unix_timestamp(F.max("ts")).alias("at"))


def question_overlap(spark: SparkSession, d: str) -> DataFrame:
    asked = X.tokens(F.lit(QUESTION))
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(F.array_intersect(X.tokens(F.col("text")), asked)).alias("shared"))
    return x.where("shared > 0")


def stream_new_messages(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "messages").schema
    stream = incremental.table_stream(spark, f"{d}/messages.parquet", schema).select("id", F.col("ingested_at").cast("timestamp").alias("at"))
    return incremental.run_once(incremental.deduplicated(stream, "id", "at", "30 days").select("id"))


def stream_topic_fold(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    e = incremental.table_stream(spark, f"{d}/events.parquet", schema)
    e = e.select(F.col("user_id").alias("topic"), "event_type", F.col("event_id").alias("seq"), F.date_trunc("day", "ts").alias("day"))
    return incremental.fold_batches(e, "topic", "day", "seq", ["event_type"])


QUERIES = {
    f.__name__: f
    for f in (
        topic_state, ranked_blocked_topics, briefing_top12, briefing_tail, topic_status_counts, store_stats, topic_history_last6, merged_items, deduped_items,
        message_ids, new_messages, evidence_verified, topics_without_evidence, evidence_top6, evidence_union, topic_keys, doc_stats, doc_freq, bm25_topk, keyword_search,
        cosine_topk, context_union, stale_embeddings, alias_keys, alias_matches, retrieval_hops, source_ablation, source_retrieval, retrieval_seeds, entity_links, thread_neighbours, time_neighbours,
        conflicting_claims, owner_referral, recall_at_k, fabricated_citations, mail_bodies, html_bodies, html_parts, artifact_validation, json_props, chunks, all_chunks, last_turns, request_rate,
        item_sentences, conflict_sentences, prompt_blocks, topic_lookup, container_winner, question_overlap,
        dangling_parents, unknown_senders, fact_partition, silence_pairs, channel_outsiders, answer_terms, ingest_stats, working_days, provider_items, hashed_vectors,
        stream_new_messages, stream_topic_fold,
    )
}
