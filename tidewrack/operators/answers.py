"""Answers with checked citations, or an abstention that names who would know."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import render
from tidewrack.functions.text import citations, tokens
from tidewrack.operators.folds import ANSWER_STATUS_RANK, CONFIDENCE_RANK, rank_of
from tidewrack.operators.store import briefing, briefing_tail

#: Longest question, most excerpts that a provider sees, most items that an answer names.
LONGEST_QUESTION, EXCERPTS, NAMED = 500, 24, 12


@dataclass
class Answer:
    question: str
    text: str
    abstained: bool = False
    cited: list[str] = field(default_factory=list)
    who_would_know: list[str] = field(default_factory=list)


def check_question(question: str, source: str | None = None, sources: tuple[str, ...] = ("slack", "email", "ticket")) -> str:
    """The question without blanks around it; raises ValueError where it is empty, too long or asks of an unknown source."""
    q = question.strip()
    if not q or len(q) > LONGEST_QUESTION:
        raise ValueError(f"a question has 1 to {LONGEST_QUESTION} characters")
    if source and source not in sources:
        raise ValueError(f"unknown source {source!r}")
    return q


def relevant_items(items: DataFrame, question: str) -> DataFrame:
    """Items (topic, status, confidence, owner, blocker, artifact_id) of at least medium confidence that contain a term of the question."""
    hay = F.lower(F.concat_ws(" ", "topic", F.coalesce("blocker", F.lit("none")), F.coalesce("owner", F.lit("none"))))
    terms = F.filter(tokens(F.lit(question)), lambda t: F.length(t) > 2)
    return items.where(F.col("confidence").isin("high", "medium")).where(F.exists(terms, lambda t: F.contains(hay, t)))


# What kind of entity is asked first for an owner.
KIND_WEIGHT = {"services": 4, "projects": 3, "clients": 2, "employees": 1}


def world_owners(world: DataFrame) -> DataFrame:
    """entity, name, owner, owner_name, weight of a world's entities (kind, entity, name, owner): who is responsible, employees for themselves."""
    people = world.where("kind = 'employees'").select(F.col("entity").alias("owner"), F.col("name").alias("owner_name"))
    weight = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in KIND_WEIGHT.items()])
    x = world.where(weight.isNotNull()).select("entity", "name", F.when(F.col("kind") == "employees", F.col("entity")).otherwise(F.col("owner")).alias("owner"), weight.alias("weight"))
    return x.join(people, "owner", "left").select("entity", "name", "owner", "owner_name", "weight")


def synthesized(state: DataFrame, provider: Callable[[list[dict]], str] | None = None, n: int = 12, title: str = "*Briefing*") -> str:
    """A briefing of topics: the provider's text on the n that are shown, or the deterministic one without a provider or where it fails; then a line on the rest."""
    shown = briefing(state, n)
    top, rest = shown.collect(), briefing_tail(state, shown).collect()
    try:
        text = provider([r.asDict() for r in top]) if provider and top else ""
    except Exception:  # noqa: BLE001
        text = ""
    return text.strip() + render.tail_line({r["status"]: r["n"] for r in rest}) if text and text.strip() else render.briefing(top, rest, title)


def write_answer(spark: SparkSession, answer: Answer, path: str) -> None:
    """An answer as one text file in the folder ``path``."""
    spark.createDataFrame([(answer.text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def referral(owners: DataFrame, question: str) -> tuple[str, str] | None:
    """(entity, name) of the owner of the entity that shares most words with the question (entity, name, owner, owner_name, weight)."""
    asked = tokens(F.lit(question))
    x = owners.withColumn("hits", F.size(F.array_intersect(tokens(F.col("name")), asked))).where("hits > 0")
    best = x.orderBy(F.desc("weight"), F.desc("hits"), "entity").limit(1).collect()
    return (best[0]["owner"], best[0]["owner_name"]) if best else None


def answer(question: str, items: DataFrame, candidates: DataFrame, owners: DataFrame, provider: Callable[[str, list[dict]], str | None] | None = None) -> Answer:
    """The provider's text if it cites candidates (artifact_id, path, source, container_id, text) and nothing else; else the items' sentences; else an abstention.

    The provider sees at most EXCERPTS candidates, those of the shortest paths; it gives None where they don't suffice.
    A provider that fails leaves the answer to the items.
    """
    q = check_question(question)

    def abstain() -> Answer:
        who = referral(owners, q)
        said = f"{who[1]} would know." if who and who[1] else f"Ask {who[0]}." if who else "No owner is known."
        return Answer(q, f"There is not enough confirmed information. {said}", True, [], [who[0]] if who else [])

    shown = candidates.orderBy(F.size("path"), "artifact_id").limit(EXCERPTS)
    if provider:
        excerpts = [r.asDict() for r in shown.collect()]
        try:
            text = provider(q, excerpts)
        except Exception:  # noqa: BLE001
            text = ""
        if text is None:
            return abstain()
        cited = items.sparkSession.range(1).select(citations(F.lit(text)).alias("c")).head()["c"]
        if cited and not set(cited) - {e["artifact_id"] for e in excerpts}:
            trace = shown.where(F.col("artifact_id").isin(cited)).orderBy("artifact_id").select(render.hop_trace(F.col("path"), F.col("source"), F.col("container_id")).alias("t"))
            return Answer(q, "\n".join([text, "", "Found by:", *(f"  {r['t']}" for r in trace.collect())]), False, cited)
    named = relevant_items(items, q).withColumn("s", render.item_sentence(F.col("topic"), F.col("status"), F.col("owner"), F.col("blocker"), F.col("artifact_id")))
    named = named.orderBy(rank_of(F.col("confidence"), CONFIDENCE_RANK).desc(), rank_of(F.col("status"), ANSWER_STATUS_RANK).desc(), "topic").limit(NAMED).collect()
    if not named:
        return abstain()
    return Answer(q, " ".join(f"{r['s']}." for r in named), False, [r["artifact_id"] for r in named if r["artifact_id"]])


def last_turns(turns: DataFrame, n: int = 8) -> list[dict]:
    """The last n turns (seq, role, text) of one chat, in order."""
    return [r.asDict() for r in reversed(turns.orderBy(F.desc("seq")).limit(n).collect())]
