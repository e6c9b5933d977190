"""Text functions as Spark expressions: tokens, aliases, keys, citations, HTML, quoted history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no tokens; what is a token and an alias; words that topic keys leave out.
STOP_WORDS = (
    "a", "about", "again", "all", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "here", "how", "i", "if", "in", "is", "it", "just", "me", "my", "no", "not", "now", "of", "on", "or",
    "our", "out", "re", "s", "she", "so", "some", "still", "t", "that", "the", "them", "then", "there", "these", "they", "this", "those", "to", "up",
    "us", "was", "we", "were", "what", "when", "which", "who", "why", "will", "with", "would", "you",
)
TOKEN = r"\b[a-z0-9][a-z0-9'-]*\b"
ALIAS = r"[A-Za-z]{2,4}-\d+|PR\s*#?\d+|\b[a-z]{1,4}\d+\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MERGE_KEY_WORDS = ("the", "a", "an", "project", "team")
STORE_KEY_WORDS = (*MERGE_KEY_WORDS, "workstream", "initiative")


def squeezed(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens (letters and digits, with inner apostrophes and hyphens) that are no stop words; an empty array for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def word_spans(c: Column, most: int) -> Column:
    """Distinct runs of at most ``most`` words in a text in lower case that only hyphens and apostrophes divide, parts of longer runs too."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+(?:['-]+\w+)*"), F.lit(0)))

    def spans(run: Column) -> Column:
        words = F.regexp_extract_all(run, F.lit(r"(?U)['-]*\w+"), F.lit(0))  # each with the signs before it

        def of(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(words))
            lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1))
            return F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.regexp_replace(F.array_join(F.slice(words, i, n), ""), "^['-]+", ""))))

        return F.flatten(F.transform(F.array(words), of))

    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("['-]"), spans(r)).otherwise(F.array(r)))))


def aliases(c: Column) -> Column:
    """Distinct aliases in a text, in lower case and sorted: ticket keys, pull requests, short codes, mail addresses."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ALIAS), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: F.lower(a))))


def topic_key(c: Column, leave_out: tuple[str, ...] = STORE_KEY_WORDS) -> Column:
    """Sorted words of a topic without those left out; the topic itself, trimmed and in lower case, where none is left."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +")
    kept = F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*leave_out))), " ")
    return F.when(kept != "", kept).otherwise(F.btrim(F.lower(c)))


def claim_key(c: Column) -> Column:
    """A subject or claim in lower case with single blanks."""
    return squeezed(F.lower(c))


def citations(c: Column) -> Column:
    """Distinct ids cited in square brackets, several divided by commas or semicolons, in order; empty for null."""
    groups = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p.rlike(r"^[A-Za-z0-9_-]+$")))


def html_text(c: Column) -> Column:
    """HTML without tags, with ``&mdash; &nbsp; &amp;`` resolved and runs of blanks and tabs single."""
    t = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, sign in (("&mdash;", "—"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(t, "[ \t]+", " ")


def without_history(c: Column) -> Column:
    """A mail body up to the reply marker, without quoted lines, up to the signature; trimmed."""
    marker = r"(?m)^[ \t]*On .{0,120}?\bwrote:[ \t]*$|^[ \t]*-{2,}[ \t]*Original Message[ \t]*-{2,}[ \t]*$"
    t = F.split(F.regexp_replace(c, "\r\n?", "\n"), marker, 2)[0]
    t = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~F.ltrim(line).startswith(">")), "\n")
    return F.regexp_replace(F.split(t, r"(?m)^--[ \t]*$", 2)[0], r"(?U)^\s+|\s+$", "")


def base64url_text(c: Column) -> Column:
    """Text of a base64url value without padding; null where it is none."""
    return F.decode(F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64")), "UTF-8")


def message_id(artifact_id: Column, source: Column, sender: Column, timestamp: Column, text: Column) -> Column:
    """The artifact's id, or 16 hex digits of the SHA-256 of the other fields; a null field counts as ``None``."""
    parts = [F.coalesce(x, F.lit("None")) for x in (source, sender, timestamp, text)]
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.coalesce(F.when(F.length(F.btrim(artifact_id)) > 0, F.btrim(artifact_id)), digest)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
