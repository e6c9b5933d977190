"""Personal information inside free text: found, and replaced with typed placeholders.

A semi-Markov conditional random field scores candidate segments by features of their whole span and chooses
boundaries and types together. Its weights are fitted when first needed, from annotated sentences made by patterns; its
name lexicon comes from the people tables and, for names they lack, from the corpus itself: a part of a mail address
of two parts that stands beside several different others is a name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.pii_candidates import Candidate, Lexicon, candidates, fold, folded_words
from tidewrack.llm.pii_training import examples
from tidewrack.llm.semicrf import best, fit, links
from tidewrack.session import materialize

#: A lexicon of at most so many names goes out to the tasks whole; of a larger one each text gets the names it holds, by a join.
LEXICON = 500_000
#: Beside so many different others must a part of a mail address stand to be a name.
PARTNERS = 3


@functools.lru_cache(maxsize=1)
def trained_weights() -> dict[str, float]:
    """The model's weights."""
    return fit(examples(known=2))


def _split_names(people: DataFrame) -> DataFrame:
    """given, family: folded names of the people with at least two words."""

    @F.pandas_udf("struct<given:string,family:string>")
    def parts(names: pd.Series) -> pd.DataFrame:
        rows = [(n or "").split() for n in names]
        return pd.DataFrame({"given": [fold(r[0]) if len(r) > 1 else None for r in rows], "family": [fold("-".join(r[1:])) if len(r) > 1 else None for r in rows]})

    return people.select(parts("name").alias("p")).select("p.*").where("given IS NOT NULL")


def names_table(people: DataFrame, texts: DataFrame) -> DataFrame:
    """word, given, family: folded names of ``people`` (name), and names that the mail addresses in all ``texts`` (text) put beside them.

    A name that only mail addresses hold may be either. Without people the table is empty, or holds such names only.
    """
    known = _split_names(people)
    known = known.select(F.col("given").alias("word"), F.lit(True).alias("given"), F.lit(False).alias("family")).unionByName(known.select(F.col("family").alias("word"), F.lit(False).alias("given"), F.lit(True).alias("family")))
    known = known.groupBy("word").agg(F.bool_or("given").alias("given"), F.bool_or("family").alias("family"))
    local = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z][a-z'-]+[._][a-z][a-z'-]+)(?:\+\w+)?(?:@| ?\[at\]| ?\(at\)| at )"), 1))
    found = texts.where(F.lower("text").rlike(r"@|\[at\]|\(at\)| at ")).select(local.alias("local")).distinct()
    half = lambda i: F.regexp_replace(F.split("local", "[._]").getItem(i), "'", "")
    either = F.array(F.struct(half(0).alias("a"), half(1).alias("b")), F.struct(half(1).alias("a"), half(0).alias("b")))
    both = found.select(F.explode(either).alias("p")).select("p.*")
    new = both.groupBy("a").agg(F.countDistinct("b").alias("partners")).where((F.col("partners") >= PARTNERS) & (F.length("a") > 2))
    new = new.select(F.col("a").alias("word"), F.lit(True).alias("mined"))
    out = known.join(new, "word", "full").select("word", *[F.coalesce(c, "mined").alias(c) for c in ("given", "family")])
    return materialize(out)


def _lexicon(rows: list) -> Lexicon:
    return Lexicon(frozenset(r["word"] for r in rows if r["given"]), frozenset(r["word"] for r in rows if r["family"]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_words(text: pd.Series) -> pd.Series:
    """The distinct folded words of texts, also joined in twos and threes as families of several words are, and without a possessive ending."""
    return pd.Series([sorted(folded_words(t)) for t in text])


def names_in_texts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """h (SHA-256 of a text), names (array of word, given, family): the names that each distinct text holds; texts without any have no row."""
    words = texts.select("text").distinct().select(F.sha2("text", 256).alias("h"), F.explode(_folded_words("text")).alias("word"))
    return words.join(names, "word").groupBy("h").agg(F.collect_list(F.struct("word", "given", "family")).alias("names"))


def find_in(text: str | None, weights: dict[str, float], lex: Lexicon) -> list[Candidate]:
    """The personal information in a text, in order."""
    segments = candidates(text, lex) if text else []
    return best(segments, weights, links(text, segments)) if segments else []


def _with_found(rows: DataFrame, people: DataFrame, schema: str, emit: Callable[..., list[tuple]]) -> DataFrame:
    """``emit(src, rec_id, text, found)`` of each row (src, rec_id, text) as rows of ``schema``."""
    names = names_table(people, rows.where(F.col("text").isNotNull()))
    columns = [c.split()[0] for c in schema.split(", ")]
    weights = trained_weights()
    if names.count() <= LEXICON:
        shared = rows.sparkSession.sparkContext.broadcast(_lexicon(names.collect()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lex = shared.value
            for b in batches:
                yield pd.DataFrame([row for s, i, t in zip(b["src"], b["rec_id"], b["text"], strict=True) for row in emit(s, i, t, find_in(t, weights, lex))], columns=columns)

        return rows.mapInPandas(run, schema)

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                [row for s, i, t, own in zip(b["src"], b["rec_id"], b["text"], b["names"], strict=True) for row in emit(s, i, t, find_in(t, weights, _lexicon([] if own is None else own)))], columns=columns
            )

    own = names_in_texts(rows.where(F.col("text").isNotNull()), names)
    return rows.withColumn("h", F.sha2("text", 256)).join(own, "h", "left").select("src", "rec_id", "text", "names").mapInPandas(run_own, schema)


def personal_information(rows: DataFrame, people: DataFrame) -> DataFrame:
    """src, rec_id, kind, start_at: one distinct row for each piece in ``rows`` (src, rec_id, text).

    Whole texts are read, of any length; null, empty and blank ones have no row. start_at counts code points from 0.
    Repeated rows come out once.
    """
    texts = rows.where(F.col("text").isNotNull()).select("src", "rec_id", "text")
    found = _with_found(texts, people, "src string, rec_id string, kind string, start_at int", lambda s, i, t, cs: [(s, i, c.kind, c.start) for c in cs])
    return found.distinct()


def redacted(rows: DataFrame, people: DataFrame) -> DataFrame:
    """src, rec_id, text with ``[EMAIL]``, ``[PHONE]``, ``[NAME]``, ``[ADDRESS]``, ``[ID_NUMBER]`` in place of each piece, else unchanged; null texts stay null."""
    texts = rows.select("src", "rec_id", "text")

    def emit(src: str, rec_id: str, text: str | None, found: list[Candidate]) -> list[tuple]:
        for c in reversed(found):
            text = text[: c.start] + f"[{c.kind.upper()}]" + text[c.end :]
        return [(src, rec_id, text)]

    return _with_found(texts, people, "src string, rec_id string, text string", emit)
