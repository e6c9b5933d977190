"""Sentences, lines and prompts from columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

# How statuses are worded, their headings in a briefing, and the wording of all sentences below.
STATUS_WORDS = {"blocked": "is blocked", "at_risk": "is at risk", "on_track": "is on track"}
STATUS_HEADINGS = {"blocked": "Blocked", "at_risk": "At risk", "unclear": "Unclear", "on_track": "On track"}


def _given(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def item_sentence(topic: Column, status: Column, owner: Column, blocker: Column, artifact_id: Column) -> Column:
    """``topic is blocked because x; y is responsible [id]``; parts that are null or empty are left out."""
    words = F.lit("is unclear")
    for s, w in STATUS_WORDS.items():
        words = F.when(status == s, w).otherwise(words)
    why = F.concat_ws("; ", _given(blocker), F.concat(_given(owner), F.lit(" is responsible")))
    return F.concat_ws(" ", F.coalesce(topic, F.lit("This item")), words, F.concat(F.lit("because "), _given(why)), F.concat(F.lit("["), _given(artifact_id), F.lit("]")))


def conflict_sentence(subject: Column, left: Column, left_id: Column, right: Column, right_id: Column, resolution: Column, note: Column) -> Column:
    """What two reports say of a subject and how it was resolved."""
    text = F.concat(F.lit("There is a disagreement about "), subject, F.lit(": one report says "), left, F.lit(" ["), left_id, F.lit("], another says "), right, F.lit(" ["), right_id, F.lit("]."))
    return F.concat_ws(" ", text, F.concat(F.lit("The resolution is "), F.replace(_given(resolution), F.lit("_"), F.lit(" ")), F.lit(": "), _given(note)))


def briefing_line(topic: Column, owner: Column, blocker: Column, confidence: Column) -> Column:
    """A bullet of a briefing."""
    return F.concat(
        F.lit("• *"), topic, F.lit("*"), F.coalesce(F.concat(F.lit(" — "), _given(blocker)), F.lit("")), F.coalesce(F.concat(F.lit(" ("), _given(owner), F.lit(")")), F.lit(" (no owner named)")),
        F.when(confidence == "low", F.lit(" _[low confidence, needs confirmation]_")).otherwise(""),
    )


def hop_trace(path: Column, source: Column, container: Column) -> Column:
    """``a → b   (source · container · 1 hop)``."""
    hops = F.size(path) - 1
    return F.concat(F.array_join(path, " → "), F.lit("   ("), F.coalesce(source, F.lit("?")), F.lit(" · "), F.coalesce(container, F.lit("?")), F.lit(" · "), hops.cast("string"), F.when(hops == 1, " hop)").otherwise(" hops)"))


def embedding_text(topic: Column, status: Column, owner: Column, blocker: Column) -> Column:
    """The text of a topic that is embedded."""
    return F.concat_ws(". ", topic, F.concat(F.lit("status: "), status), F.concat(F.lit("owner: "), _given(owner)), F.concat(F.lit("blocker: "), _given(blocker)))


def message_block(id_: Column, source: Column, sender: Column, timestamp: Column, text: Column) -> Column:
    """A message of a prompt under its id."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("["), id_, F.lit("] source="), part(source), F.lit(" | sender="), part(sender), F.lit(" | timestamp="), part(timestamp), F.lit("\n"), part(text))


def candidate_block(id_: Column, container: Column, path: Column, text: Column) -> Column:
    """A retrieved artifact of a prompt, with the way it was found."""
    return F.concat(F.lit("["), id_, F.lit("] in "), F.coalesce(container, F.lit("?")), F.lit(" via "), F.array_join(path, " → "), F.lit("\n"), F.coalesce(text, F.lit("")))


def topic_block(topic: Column, status: Column, owner: Column, blocker: Column, seen: Column, evidence: Column) -> Column:
    """A stored topic of a chat's prompt: its state, when it was last seen, and its pieces of evidence (array), one a line."""
    head = F.concat_ws(" | ", topic, F.concat(F.lit("status: "), status), F.concat(F.lit("owner: "), F.coalesce(_given(owner), F.lit("unknown"))), F.concat(F.lit("blocker: "), F.coalesce(_given(blocker), F.lit("none"))), F.concat(F.lit("last seen "), seen))
    return F.concat_ws("\n", head, F.transform(evidence, lambda e: F.concat(F.lit("  - "), e)))


def briefing(shown: Sequence[Row], rest: Sequence[Row], title: str = "*Briefing*") -> str:
    """The text of a briefing from its topics (topic, status, owner, blocker, confidence; a top-n report) and how many of each status are not shown (status, n)."""
    if not shown:
        return f"{title}\n\nNothing was reported."
    lines = [title, ""]
    for status, heading in STATUS_HEADINGS.items():
        of = [r for r in shown if r["status"] == status]
        if of:
            lines.append(f"*{heading}*")
            for r in of:
                why, who = f" — {r['blocker']}" if r["blocker"] else "", f" ({r['owner']})" if r["owner"] else " (no owner named)"
                lines.append(f"• *{r['topic']}*{why}{who}{' _[low confidence, needs confirmation]_' if r['confidence'] == 'low' else ''}")
            lines.append("")
    return "\n".join(lines).strip() + tail_line({r["status"]: r["n"] for r in rest})


def tail_line(counts: dict[str, int]) -> str:
    """What a briefing says of the topics it doesn't show; empty if it shows all."""
    left = Counter(counts)
    named = ", ".join(f"{left[s]} {h.lower()}" for s, h in STATUS_HEADINGS.items() if left[s])
    return f"\n\n_Plus {left.total()} more not detailed above: {named}._" if left.total() else ""


def split_answer(text: str, mark: str = "Found by:") -> tuple[str, list[str]]:
    """An answer's text, and the lines of its trace."""
    said, _, trace = text.partition(f"\n{mark}")
    return said.strip(), [line.strip() for line in trace.splitlines() if line.strip()]
