"""Folders of JSON lines, fixtures of messages, worlds of entities: read leniently, with what was wrong kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.functions.keys import blank, trimmed
from tidewrack.functions.text import first_present
from tidewrack.operators.timestamps import epoch_ms
from tidewrack.sources.connectors import channel_messages
from tidewrack.sources.mail import mail_records

# Names under which fixtures bear a field, and the known sources.
SENDER_NAMES = ("sender", "from", "user", "username", "user_name", "author", "real_name")
TEXT_NAMES = ("text", "body", "message", "content")
TIME_NAMES = ("timestamp", "ts", "date", "created_at", "time")
SOURCES = ("slack", "email", "ticket", "export", "doc")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """file_name, line_no, line of the files of a folder; files of any size are read in splits. Files of one name in several folders stay apart by ``path``.

    A line's number is its place in its split plus the lines of the file's earlier splits. A byte-order mark is dropped.
    """
    x = spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    before = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    splits = x.groupBy("path", "at").agg(F.count("*").alias("n")).select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    x = x.withColumn("i", F.row_number().over(W.partitionBy("path", "at").orderBy("m"))).join(splits, ["path", "at"])
    line_no = (F.col("before") + F.col("i")).cast("int")
    return x.select("path", "file_name", line_no.alias("line_no"), F.when(line_no == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line"))


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{name}", "string")


def _object(name: str) -> Column:
    """The JSON text of an object; another value stands in one under ``value``; null where it is missing."""
    v = F.try_variant_get(F.col("v"), f"$.{name}", "variant")
    text = F.to_json(v)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), text).when(v.isNotNull() & (text != "null"), F.concat(F.lit('{"value":'), text, F.lit("}")))


def artifacts_of(lines: DataFrame) -> DataFrame:
    """Artifacts from lines (file_name, line_no, line) with ``warnings`` on what was coerced, and ``reason`` where a line gives none.

    A missing source comes from the file's name. Recipients may be a list, a text (one recipient) or null (none). A text
    that is missing is empty. Lines that are blank are no rows.
    """
    x = lines.where(~blank(F.col("line"))).withColumn("v", F.try_parse_json("line"))
    kind = F.schema_of_variant("v")
    hint = F.regexp_extract("file_name", "^([a-z]+)", 1)
    source = F.coalesce(F.when(trimmed(_field("source")) != "", trimmed(_field("source"))), hint)
    to_list = F.try_variant_get(F.col("v"), "$.recipients", "array<string>")
    recipients = F.coalesce(F.filter(F.transform(to_list, lambda r: trimmed(r)), lambda r: F.length(r) > 0), F.when(trimmed(_field("recipients")) != "", F.array(trimmed(_field("recipients")))), F.array().cast("array<string>"))
    ms = epoch_ms(_field("ts"))
    warn = F.filter(
        F.array(
            F.when(_field("source").isNull(), "source from file name"), F.when(~source.isin(*SOURCES), "unknown source"), F.when(_field("text").isNull(), "no text"),
            F.when(_field("ts").isNull(), "ts is null"), F.when(_field("ts").isNotNull() & ms.isNull(), "ts unreadable"), F.when(to_list.isNull() & _field("recipients").isNotNull(), "recipients no list"),
        ),
        lambda w: w.isNotNull(),
    )
    reason = F.when(F.col("v").isNull(), "bad_json").when(~kind.startswith("OBJECT"), "not_object").when(blank(_field("artifact_id")), "no_id")
    return x.select(
        "file_name", "line_no", reason.alias("reason"), trimmed(_field("artifact_id")).alias("artifact_id"), source.alias("source"), _field("container_id").alias("container_id"), _field("parent_id").alias("parent_id"),
        _field("sender_id").alias("sender_id"), recipients.alias("recipients"), ms.alias("epoch_ms"), F.coalesce(_field("text"), F.lit("")).alias("text"),
        _object("meta").alias("meta"), F.coalesce(_object("raw"), F.col("line")).alias("raw"), F.when(reason.isNull(), warn).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def load_corpus(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(artifacts, failures) of a folder of .jsonl files, or others of a ``pattern``; of an id the first line (file, line) counts, later ones are failures."""
    x = artifacts_of(read_lines(spark, path, pattern))
    good = x.where("reason IS NULL")
    first = good.groupBy("artifact_id").agg(F.min(F.struct("file_name", "line_no")).alias("f"))
    marked = good.join(first, "artifact_id").withColumn("again", F.struct("file_name", "line_no") != F.col("f"))
    failures = x.where("reason IS NOT NULL").select("file_name", "line_no", "reason")
    again = marked.where("again").select("file_name", "line_no", F.concat(F.lit("duplicate of "), F.col("f.file_name"), F.lit(":"), F.col("f.line_no").cast("string")).alias("reason"))
    return marked.where("NOT again").drop("again", "f", "reason"), failures.unionByName(again)


def load_strictly(spark: SparkSession, path: str) -> DataFrame:
    """The artifacts of a folder; raises ValueError if any line fails or lacks a required field."""
    good, failures = load_corpus(spark, path)
    poor = good.where(blank(F.col("source")) | blank(F.col("container_id")) | blank(F.col("sender_id")) | F.col("epoch_ms").isNull())
    bad = failures.select("file_name", "line_no", "reason").unionByName(poor.select("file_name", "line_no", F.lit("required field").alias("reason"))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file_name']}:{bad[0]['line_no']}: {bad[0]['reason']}")
    return good


def corpus_messages(artifacts: DataFrame) -> DataFrame:
    """artifact_id, source, sender, epoch_ms, text of the artifacts with a text."""
    return artifacts.where(~blank(F.col("text"))).select("artifact_id", "source", F.coalesce("sender_id", F.lit("unknown")).alias("sender"), "epoch_ms", "text")


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, gold_artifacts (array) of an answer key's questions."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.questions", "array<variant>")).alias("v"))
    return x.select(_field("question_id").alias("question_id"), _field("question").alias("question"), F.try_variant_get("v", "$.gold_artifacts", "array<string>").alias("gold_artifacts"))


def is_mail(record: Column) -> Column:
    """Whether a JSON record is one of a mail API, by its payload."""
    return F.try_variant_get(F.try_parse_json(record), "$.payload", "variant").isNotNull()


def read_messages(spark: SparkSession, path: str, default_source: str = "slack") -> DataFrame:
    """source, sender, timestamp, text of a fixture file: a JSON list, or an object with ``messages``; blank texts are dropped."""
    x = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    x = x.select(F.explode(listed).alias("v"))
    any_of = lambda names: first_present(*[_field(n) for n in names])
    out = x.select(F.coalesce(first_present(_field("source")), F.lit(default_source)).alias("source"), F.coalesce(any_of(SENDER_NAMES), F.lit("unknown")).alias("sender"), F.coalesce(any_of(TIME_NAMES), F.lit("")).alias("timestamp"), trimmed(any_of(TEXT_NAMES)).alias("text"))
    return out.where(F.length("text") > 0)


def read_world(spark: SparkSession, path: str) -> DataFrame:
    """(kind, entity, name, owner, terms) of a world file: its projects, services, clients, employees and outside people."""
    x = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    out = None
    for group, id_name, owner in (("employees", "employee_id", "manager_id"), ("projects", "project_id", "owner_id"), ("services", "service_id", "owner_id"), ("clients", "client_id", "csm_id"), ("external", "client_id", "client_id")):
        g = x.select(F.explode(F.try_variant_get("v", f"$.{group}", "array<variant>")).alias("v"))
        own = F.coalesce(F.try_variant_get("v", "$.aliases", "array<string>"), F.array().cast("array<string>"))
        extra = [_field(n) for n in ("name", "email", "slack_handle", "team")] if group == "employees" else [_field("name")]
        g = g.select(F.lit(group).alias("kind"), _field(id_name).alias("entity"), _field("name").alias("name"), _field(owner).alias("owner"), F.filter(F.concat(own, F.array(*extra)), lambda t: t.isNotNull()).alias("terms"))
        out = g if out is None else out.unionByName(g)
    return out.where("entity IS NOT NULL")


def asked_in(key: DataFrame, question_id: str) -> DataFrame:
    """The question of an answer key with this id, in any case; no row if there is none."""
    return key.where(F.lower("question_id") == question_id.strip().lower())


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """source, sender, timestamp (ISO, UTC), text of a dump of a mail API: a JSON list, or an object with ``messages``; records without payload are dropped."""
    part = "mimeType:string,body:struct<data:string>"
    payload = f"struct<{part},headers:array<struct<name:string,value:string>>,parts:array<struct<{part},parts:array<struct<{part},parts:array<struct<{part}>>>>>>>"
    x = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    x = x.select(F.explode(F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("v"))
    x = x.select(*[_field(n).alias(n) for n in ("id", "snippet", "internalDate")], F.from_json(F.to_json(F.try_variant_get("v", "$.payload", "variant")), payload).alias("payload")).where("payload IS NOT NULL")
    iso = F.date_format(F.timestamp_millis("epoch_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return mail_records(x).select("source", "sender", F.coalesce(iso, F.lit("")).alias("timestamp"), "text")


def two_files(spark: SparkSession, chat_path: str, mail_path: str) -> DataFrame:
    """The messages of a fixture that are of chat, and those of a mail dump."""
    return read_messages(spark, chat_path).where("source = 'slack'").unionByName(read_mail(spark, mail_path))


READERS: dict[str, Callable[..., DataFrame]] = {"corpus": lambda spark, path: load_corpus(spark, path)[0], "fixtures": read_messages, "gmail": read_mail, "slack": lambda spark, path: channel_messages(spark.read.json(f"{path}/history", "user string, ts string, text string, subtype string"), spark.read.json(f"{path}/users", "user string, name string"))}


def ingest(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The reader of a kind of source."""
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(READERS))}")
    return READERS[source](spark, path)
