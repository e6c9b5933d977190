"""Artifacts and the entities they share: index, seeds, neighbours, hops.

Neighbours are always those of a frontier, never all pairs of artifacts that share an entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.functions.keys import norm_key
from tidewrack.functions.text import aliases, tokens, word_spans
from tidewrack.session import materialize

#: Scores of neighbours that share an entity, and a container. Those that share an entity within a time are among the first.
BY_ENTITY, BY_CONTAINER = 3.0, 2.0


def alias_table(entities: DataFrame) -> DataFrame:
    """(token, entity): every token of an entity's terms (entity, terms array), and its id."""
    terms = entities.select("entity", F.explode(F.flatten(F.transform("terms", lambda t: tokens(t)))).alias("token"))
    return terms.select("token", "entity").unionByName(entities.select(F.lower("entity").alias("token"), "entity")).where(F.col("token").isNotNull()).distinct()


def phrase_matches(artifacts: DataFrame, entities: DataFrame) -> DataFrame:
    """(artifact_id, entity): entities one of whose terms (entity, terms array) stands in the text word for word, terms of several words too.

    Words are runs of letters, digits and underscores in lower case. A text gives all runs of as many words as the longest
    term has, which meet the terms in an equi-join.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    terms = entities.select("entity", F.explode(F.transform("terms", lambda t: words(t))).alias("w")).where(F.size("w") > 0).select("entity", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).distinct()
    lengths = sorted(r["n"] for r in terms.select("n").distinct().collect())
    x = artifacts.select("artifact_id", words(F.col("text")).alias("w"))

    def runs(n: int) -> Column:
        of_n = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, of_n).otherwise(F.array().cast("array<string>"))

    each = [runs(n) for n in lengths]
    found = F.array_distinct(F.concat(*each)) if each else F.array().cast("array<string>")
    return x.select("artifact_id", F.explode(found).alias("phrase")).join(terms.select("phrase", "entity"), "phrase").select("artifact_id", "entity").distinct()


def artifact_entities(artifacts: DataFrame, table: DataFrame) -> DataFrame:
    """(artifact_id, entity): entities whose alias token stands in text or container, senders, recipients, and unknown aliases themselves.

    A token stands in a text as a whole word, also inside a word with hyphens or apostrophes. So parts of such words are
    looked up as well, up to as many words as the longest token has; longer parts can't be tokens.
    """
    most = table.agg(F.max(F.regexp_count("token", F.lit("['-]+")))).head()[0] or 0
    words = F.array_distinct(F.concat(word_spans(F.col("text"), most + 1), aliases(F.col("text")), tokens(F.col("container_id")), F.array(F.lower(F.coalesce("container_id", F.lit(""))))))
    x = artifacts.select("artifact_id", F.explode(words).alias("token"))
    named = x.join(table, "token").select("artifact_id", "entity")
    mined = artifacts.select("artifact_id", F.explode(aliases(F.col("text"))).alias("token")).join(table, "token", "left_anti").select("artifact_id", F.col("token").alias("entity"))
    sent = artifacts.where("sender_id IS NOT NULL").select("artifact_id", F.col("sender_id").alias("entity"))
    got = artifacts.select("artifact_id", F.explode("recipients").alias("entity")).where("entity IS NOT NULL")
    out = reduce(DataFrame.unionByName, (named, mined, sent, got))
    return out.select("artifact_id", F.upper(F.btrim("entity")).alias("entity")).distinct()


def alias_keys(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, alias): aliases in text, ids and people of an artifact, and the tokens of its container and parent."""
    people = F.flatten(F.transform(F.coalesce("recipients", F.array().cast("array<string>")), lambda r: aliases(r)))
    fields = [aliases(F.col(c)) for c in ("text", "container_id", "parent_id", "sender_id")]
    found = F.array_distinct(F.concat(*fields, people, tokens(F.col("container_id")), tokens(F.col("parent_id"))))
    return artifacts.select("artifact_id", F.explode(found).alias("alias"))


def asked_words(spark: SparkSession, question: str) -> tuple[list[str], list[str]]:
    """(tokens, aliases) of a question."""
    return tuple(spark.range(1).select(tokens(F.lit(question)), aliases(F.lit(question))).head())


def seeds(question: str, ranked: DataFrame, artifacts: DataFrame, entities: DataFrame, table: DataFrame, keys: DataFrame, top_k: int = 20) -> DataFrame:
    """(artifact_id, place): the best max(3 top_k, 30) of ``ranked`` (artifact_id, score) and the artifacts of the question's aliases and entities; 2 top_k at most.

    Only ``artifacts`` are kept, after that best part of ``ranked`` was taken. The two lists take turns, the ranked one
    first, so that the cap leaves room for both; alias hits come by id. Of either list no more than 2 top_k can be kept.
    """
    words, named = asked_words(artifacts.sparkSession, question)
    known = table.where(F.col("token").isin(*words, *named)).select(F.upper(F.btrim("entity")).alias("entity")).distinct()
    hits = entities.join(known, "entity").select("artifact_id").unionByName(keys.where(F.col("alias").isin(*named)).select("artifact_id")).distinct()
    here = artifacts.select("artifact_id")
    best = ranked.orderBy(F.desc("score"), "artifact_id").limit(max(3 * top_k, 30)).join(here, "artifact_id", "left_semi")
    best = best.select("artifact_id", F.lit(0).alias("list"), F.row_number().over(W.orderBy(F.desc("score"), "artifact_id")).alias("turn"))
    hits = hits.join(here, "artifact_id", "left_semi").orderBy("artifact_id").limit(2 * top_k)
    hits = hits.select("artifact_id", F.lit(1).alias("list"), F.row_number().over(W.orderBy("artifact_id")).alias("turn"))
    x = best.unionByName(hits).groupBy("artifact_id").agg(F.min(F.struct("turn", "list")).alias("at")).orderBy("at", "artifact_id").limit(2 * top_k)
    return x.select("artifact_id", F.row_number().over(W.orderBy("at", "artifact_id")).alias("place"))


def neighbours(frontier: DataFrame, artifacts: DataFrame, entities: DataFrame) -> DataFrame:
    """(artifact_id, path, score) of the neighbours of the frontier (artifact_id, path): for each the best score, then the greatest artifact that leads to it.

    The frontier is reduced to one row an entity and one a container before it meets the artifacts, so a common entity reads
    its artifacts once, whatever number of the frontier shares it. Members of the frontier may come out too.
    """
    by = F.max(F.struct(F.col("artifact_id").alias("from_id"), "path")).alias("by")
    of = frontier.join(entities, "artifact_id").groupBy("entity").agg(by)
    shared = entities.join(of, "entity").select("artifact_id", F.struct(F.lit(BY_ENTITY).alias("score"), "by.from_id", "by.path").alias("p"))
    places = artifacts.select("artifact_id", "container_id").where("container_id IS NOT NULL")
    near = frontier.join(places, "artifact_id").groupBy("container_id").agg(by)
    near = places.join(near, "container_id").select("artifact_id", F.struct(F.lit(BY_CONTAINER).alias("score"), "by.from_id", "by.path").alias("p"))
    best = shared.unionByName(near).groupBy("artifact_id").agg(F.max("p").alias("p"))
    return best.select("artifact_id", F.concat(F.col("p.path"), F.array("artifact_id")).alias("path"), F.col("p.score").alias("score"))


def time_neighbours(frontier: DataFrame, artifacts: DataFrame, entities: DataFrame, hours: int = 6) -> DataFrame:
    """(from_id, artifact_id): artifacts of the frontier's source within ``hours`` that share an entity with it."""
    artifacts = artifacts.select("artifact_id", "source", "ts")
    a = frontier.select("artifact_id").join(artifacts, "artifact_id").join(entities, "artifact_id").select(F.col("artifact_id").alias("from_id"), F.col("source").alias("s"), F.col("ts").alias("t"), "entity")
    b = artifacts.join(entities, "artifact_id").select("artifact_id", "source", "ts", "entity")
    gap = F.abs(F.unix_timestamp("ts") - F.unix_timestamp("t"))
    x = a.join(b, "entity").where((F.col("s") == F.col("source")) & (F.col("artifact_id") != F.col("from_id")) & (gap <= hours * 3600))
    return x.select("from_id", "artifact_id").distinct()


def retrieve(seeds: DataFrame, artifacts: DataFrame, entities: DataFrame, hops: int = 3, cap: int = 600, top_k: int = 50, question: str = "", keys: DataFrame | None = None) -> DataFrame:
    """(artifact_id, hop, path): seeds (hop 0), what they reach, each hop's best ``cap``, until ``top_k`` are seen, and the alias closure; a report of ``top_k``.

    The closure adds the artifacts under an alias of the question (hop 0) and those under an alias in the text of one that
    was found (one hop more). Alias hits come first, then others, both as they were found: seeds by ``place`` if they have
    one, a hop by score, the closure by what led there, each then by id. Paths are whole, from the seed on. ``keys`` are the
    ``alias_keys`` of the artifacts, if they are there already.
    """
    place = F.col("place") if "place" in seeds.columns else F.lit(0)
    seen = materialize(seeds.select("artifact_id", F.lit(0).alias("hop"), F.array("artifact_id").alias("path"), F.lit(0).alias("step"), place.cast("double").alias("key")))
    frontier, n = seen, seen.count()
    for hop in range(1, hops + 1):
        if n >= top_k:
            break
        new = neighbours(frontier.select("artifact_id", "path"), artifacts, entities).join(seen.select("artifact_id"), "artifact_id", "left_anti")
        frontier = materialize(new.orderBy(F.desc("score"), "artifact_id").limit(cap).select("artifact_id", F.lit(hop).alias("hop"), "path", F.lit(hop).alias("step"), (-F.col("score")).alias("key")))
        found = frontier.count()
        if not found:
            break
        n += found
        seen = seen.unionByName(frontier)
    keys = materialize(alias_keys(artifacts)) if keys is None else keys
    named = asked_words(artifacts.sparkSession, question)[1]
    asked = keys.where(F.col("alias").isin(*named)).select("artifact_id").distinct()
    asked = materialize(asked.select("artifact_id", F.lit(0).alias("hop"), F.array("artifact_id").alias("path"), F.lit(hops + 1).alias("step"), F.lit(0.0).alias("key")))
    seen = materialize(seen.unionByName(asked.join(seen.select("artifact_id"), "artifact_id", "left_anti")))
    # the first that was found with an alias leads to all artifacts of the alias, so a hot alias is one row here
    said = seen.join(artifacts.select("artifact_id", "text"), "artifact_id").select(F.struct("step", "key", "artifact_id", "hop", "path").alias("by"), F.explode(aliases(F.col("text"))).alias("alias"))
    hits = said.groupBy("alias").agg(F.min("by").alias("by")).join(keys, "alias").groupBy("artifact_id").agg(F.min("by").alias("by"))
    hits = materialize(hits.unionByName(asked.join(hits, "artifact_id", "left_anti").select("artifact_id", F.lit(None).cast(hits.schema["by"].dataType).alias("by"))))
    order = ["step", "key", F.col("by.step"), F.col("by.key"), F.col("by.artifact_id"), "artifact_id"]
    closed = hits.join(seen.select("artifact_id"), "artifact_id", "left_anti").select("artifact_id", (F.col("by.hop") + 1).alias("hop"), F.concat("by.path", F.array("artifact_id")).alias("path"), F.lit(hops + 2).alias("step"), F.lit(0.0).alias("key"), "by", F.lit(True).alias("is_hit"))
    old = seen.join(hits.select("artifact_id", F.lit(True).alias("is_hit")), "artifact_id", "left").withColumn("by", F.lit(None).cast(hits.schema["by"].dataType)).withColumn("is_hit", F.col("is_hit").isNotNull())
    return old.unionByName(closed).orderBy(F.desc("is_hit"), *order).limit(top_k).select("artifact_id", "hop", "path")


def normalized_artifacts(*tables: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each artifact of the tables, its first delivery: ids in lower case, senders and recipients in upper, ts as UTC time.

    Of deliveries of one time and source the least by the other columns counts, the text last. Without ``texts`` there is no
    text column, and texts are neither read nor shuffled.
    """
    parts = []
    for t in tables:
        ts = F.when(F.col("ts").rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.expr("try_cast(ts AS timestamp)"))
        parts.append(
            t.select(
                norm_key(F.col("artifact_id")).alias("artifact_id"), "loaded_at", "source", norm_key(F.col("container_id")).alias("container_id"), norm_key(F.col("parent_id")).alias("parent_id"),
                F.upper(norm_key(F.col("sender_id"))).alias("sender_id"), F.transform("recipients", lambda r: F.upper(norm_key(r))).alias("recipients"), ts.alias("ts"), *(["text"] if texts else []),
            )
        )
    x = reduce(DataFrame.unionByName, parts).where("artifact_id IS NOT NULL")
    rest = [c for c in x.columns if c != "artifact_id"]
    return x.groupBy("artifact_id").agg(F.min(F.struct(*rest)).alias("a")).select("artifact_id", "a.*")
