"""Validation of records, and checks of a corpus against itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.keys import blank, norm_key
from tidewrack.functions.text import aliases, tokens
from tidewrack.operators.folds import top_per_key

# What statuses, confidences and sources there are.
STATUSES = ("on_track", "at_risk", "blocked", "unclear")
CONFIDENCES = ("high", "medium", "low")


def artifact_reason() -> Column:
    """The first rule that an artifact breaks; null where it is sound."""
    return (
        F.when(blank(F.col("artifact_id")), "artifact_id").when(blank(F.col("source")), "source").when(blank(F.col("container_id")), "container_id")
        .when(blank(F.col("sender_id")), "sender_id").when(F.col("ts").isNull(), "ts").when(blank(F.col("text")), "text")
    )


def item_reason(item: Column) -> Column:
    """The first rule that a status item, as JSON text, breaks; null where it is sound. Unknown fields are a fault."""
    v = F.try_parse_json(item)
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    known = F.array(*[F.lit(n) for n in ("blocker", "confidence", "evidence", "owner", "source", "status", "topic")])
    need = F.array(*[F.lit(n) for n in ("confidence", "evidence", "source", "status", "topic")])
    get = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    pieces = F.try_variant_get(v, "$.evidence", "array<struct<artifact_id:string,span:string>>")
    return (
        F.when(v.isNull() | names.isNull(), "not an object").when(F.size(F.array_except(need, names)) > 0, "missing field").when(F.size(F.array_except(names, known)) > 0, "unknown field")
        .when(~F.coalesce(get("status").isin(*STATUSES), F.lit(False)), "status").when(~F.coalesce(get("confidence").isin(*CONFIDENCES), F.lit(False)), "confidence").when(blank(get("topic")), "topic")
        .when(pieces.isNull() | (F.size(pieces) == 0) | F.exists(pieces, lambda p: blank(p["artifact_id"]) | blank(p["span"])), "evidence")
    )


def conflict_reason(positions: Column, resolution: Column, note: Column) -> Column:
    """The first rule that a conflict breaks."""
    return F.when(F.size(positions) < 2, "positions").when((resolution == "newer_wins") & blank(note), "note")


def answer_reason(abstained: Column, cited: Column, known: Column, who: Column) -> Column:
    """The first rule that an answer breaks: who abstains names a person, who doesn't cites, and only known ids."""
    return (
        F.when(abstained & (F.size(who) == 0), "names nobody").when(~abstained & (F.size(cited) == 0), "cites nothing")
        .when(F.size(F.array_except(cited, known)) > 0, "cites unknown ids")
    )


def dangling_parents(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, parent_id) of normalised artifacts whose parent is no artifact."""
    known = artifacts.select(F.col("artifact_id").alias("parent_id"))
    return artifacts.where("parent_id IS NOT NULL").join(known, "parent_id", "left_anti").select("artifact_id", "parent_id")


def unknown_senders(artifacts: DataFrame, people: DataFrame) -> DataFrame:
    """(sender_id, n): senders of normalised artifacts that are no people (person_id)."""
    known = people.select(F.upper(norm_key(F.col("person_id"))).alias("sender_id")).where("sender_id IS NOT NULL").distinct()
    return artifacts.where("sender_id IS NOT NULL").groupBy("sender_id").agg(F.count("*").alias("n")).join(known, "sender_id", "left_anti")


def fact_partition(facts: DataFrame) -> DataFrame:
    """(container_id, facts, enough): distinct facts (container_id, fact) that a container holds, and whether these are all there are."""
    total = facts.agg(F.count_distinct("fact")).head()[0]
    return facts.groupBy("container_id").agg(F.count_distinct("fact").alias("facts")).select("container_id", "facts", (F.col("facts") >= total).alias("enough"))


def unanswered(artifacts: DataFrame, hours: int = 48) -> DataFrame:
    """(artifact_id, container_id): first artifacts of a container that no one but their sender follows up within ``hours``.

    Time is cut into spans of that length. A span of a container is reduced to its two senders with the last, and its two
    with the first artifacts; these tell of any first artifact whether another sender follows, so no pairs are made.
    """
    span = hours * 3600
    x = artifacts.where("ts IS NOT NULL AND container_id IS NOT NULL AND sender_id IS NOT NULL").select("artifact_id", "container_id", "parent_id", "sender_id", F.unix_timestamp("ts").alias("at"))
    x = x.withColumn("span", F.floor(F.col("at") / span))
    said = x.groupBy("container_id", "span", "sender_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))

    def two(order: Column, value: str) -> DataFrame:
        top = top_per_key(said, ["container_id", "span"], [order, F.asc("sender_id")], 2)
        return top.groupBy("container_id", "span").agg(F.collect_list(F.struct(F.col("sender_id").alias("s"), F.col(value).alias("t"))).alias(value))

    roots = x.where("parent_id IS NULL")
    same = roots.join(two(F.desc("last"), "last"), ["container_id", "span"], "left")
    after = two(F.asc("first"), "first").withColumn("span", F.col("span") - 1)
    both = same.join(after, ["container_id", "span"], "left")
    in_span = F.exists("last", lambda o: (o["s"] != F.col("sender_id")) & (o["t"] >= F.col("at")))
    next_span = F.exists("first", lambda o: (o["s"] != F.col("sender_id")) & (o["t"] <= F.col("at") + span))
    answered = F.coalesce(in_span, F.lit(False)) | F.coalesce(next_span, F.lit(False))
    return both.where(~answered).select("artifact_id", "container_id")


def field_prefixes(rows: DataFrame, of: str, columns: list[str], prefix: str = "_") -> DataFrame:
    """(of, rows, hidden): rows of each table, and those with a field in a JSON column whose name begins with ``prefix``, as provenance that leaked would."""
    names = lambda c: F.coalesce(F.map_keys(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")), F.array().cast("array<string>"))
    hidden = F.exists(F.concat(*[names(c) for c in columns]), lambda k: k.startswith(prefix))
    return rows.groupBy(of).agg(F.count("*").alias("rows"), F.count_if(hidden).alias("hidden"))


def content_words(text: Column) -> Column:
    """Distinct tokens of more than two characters that are no aliases."""
    return F.array_except(F.filter(tokens(text), lambda t: F.length(t) > 2), aliases(text))


def disjoint_steps(artifacts: DataFrame) -> DataFrame:
    """(container_id, steps, disjoint): replies of each container to a known parent, and those that share no content word with it."""
    child = artifacts.where("parent_id IS NOT NULL").select("container_id", "parent_id", content_words(F.col("text")).alias("w"))
    parent = artifacts.select(F.col("artifact_id").alias("parent_id"), content_words(F.col("text")).alias("pw"))
    return child.join(parent, "parent_id").groupBy("container_id").agg(F.count("*").alias("steps"), F.count_if(~F.arrays_overlap("w", "pw")).alias("disjoint"))


def phrase_counts(texts: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """(phrase, n): in how many texts each phrase stands, in any case; phrases in none too."""
    hits = texts.agg(*[F.count_if(F.contains(F.lower("text"), F.lit(p.lower()))).alias(f"n{i}") for i, p in enumerate(phrases)])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"n{i}").alias("n")) for i, p in enumerate(phrases)])).alias("x")).select("x.*")


def digests(rows: DataFrame, of: str, columns: list[str]) -> DataFrame:
    """(of, n, digest): rows of each group and a digest of their values in any order; the same for two runs that gave the same rows."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("~")) for c in columns])
    return rows.groupBy(of).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def fact_caps(facts: DataFrame) -> DataFrame:
    """(total, cap, worst, over): distinct facts (artifact_id, fact), a third of them rounded up, the most that one artifact holds, and how many hold more than that third."""
    total = facts.agg(F.count_distinct("fact")).head()[0]
    cap = -(-total // 3)
    each = facts.groupBy("artifact_id").agg(F.count_distinct("fact").alias("n"))
    return each.agg(F.lit(total).cast("bigint").alias("total"), F.lit(cap).cast("bigint").alias("cap"), F.max("n").alias("worst"), F.count_if(F.col("n") > cap).alias("over"))


def silent(artifacts: DataFrame, hours: int) -> DataFrame:
    """(artifact_id, person): people that a first artifact of a container went to and who sent nothing in it until ``hours`` later."""
    first = artifacts.where("parent_id IS NULL AND container_id IS NOT NULL AND ts IS NOT NULL").select("artifact_id", "container_id", F.unix_timestamp("ts").alias("at"), F.explode(F.array_distinct("recipients")).alias("person")).where("person IS NOT NULL")
    span = hours * 3600
    # an answer counts for the roots of its span and of the one before it, so roots and answers meet by span only
    said = artifacts.where("sender_id IS NOT NULL AND ts IS NOT NULL").select("container_id", F.col("sender_id").alias("person"), F.unix_timestamp("ts").alias("t"))
    said = said.withColumn("span", F.floor(F.col("t") / span)).groupBy("container_id", "person", "span").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    x = first.withColumn("span", F.floor(F.col("at") / span))
    same = x.join(said.select("container_id", "person", "span", "last_t"), ["container_id", "person", "span"], "left")
    both = same.join(said.select("container_id", "person", (F.col("span") - 1).alias("span"), "first_t"), ["container_id", "person", "span"], "left")
    answered = F.coalesce(F.col("last_t") >= F.col("at"), F.lit(False)) | F.coalesce(F.col("first_t") <= F.col("at") + span, F.lit(False))
    return both.where(~answered).select("artifact_id", "person")
