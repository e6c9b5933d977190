"""Threads of mail rows into ordered conversations with speaker roles.

Rows are an event log: deliveries and retries of one artifact fold into its last version. A container of the
final mails is kept if it is one tree without gaps in which an opener and a replier say something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.keys import blank, norm_key, trimmed
from tidewrack.operators.ranking import rank_within
from tidewrack.session import materialize


def fold_versions(rows: DataFrame) -> DataFrame:
    """One row for each artifact: its last version (greatest loaded_at; ties: the greatest values).

    Only what conversations need is kept; of the text, whether there is any. Rows without artifact or container id
    belong to no conversation.
    """
    ts = F.when(F.col("ts").rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d"), F.expr("try_cast(ts AS timestamp)"))
    version = F.max(F.struct(F.col("loaded_at"), norm_key(F.col("container_id")).alias("c"), trimmed(F.col("container_id")).alias("container_id"), norm_key(F.col("parent_id")).alias("p"), F.upper(trimmed(F.col("sender_id"))).alias("sender"), ts.alias("ts"), (~blank(F.col("text"))).alias("said"), trimmed(F.col("artifact_id")).alias("artifact_id")))
    x = rows.groupBy(norm_key(F.col("artifact_id")).alias("a")).agg(version.alias("v")).where(F.col("a").isNotNull()).select("a", "v.*")
    return x.where(F.col("c").isNotNull()).withColumn("sender", F.when(F.length("sender") > 0, F.col("sender"))).drop("loaded_at")


def rooted(mails: DataFrame) -> DataFrame:
    """The (c, a) of ``mails`` (c, a, p; every p is an a of the same c, or null) that don't lead up to a root: they are on or below a cycle.

    Pointer doubling: after n rounds every mail within 2**n steps of its root is done, so a round that ends none
    leaves only cycles. Each round joins only the mails that are still open.
    """
    state = materialize(mails.select("c", "a", F.col("p").alias("up")))
    left = state.where(F.col("up").isNotNull()).count()
    while left:
        jump = state.select("c", F.col("a").alias("up"), F.col("up").alias("up2"))
        open_ = state.where(F.col("up").isNotNull()).join(jump, ["c", "up"], "left").select("c", "a", F.col("up2").alias("up"))
        state = materialize(state.where(F.col("up").isNull()).unionByName(open_))
        now = state.where(F.col("up").isNotNull()).count()
        if now == left:
            break
        left = now
    return state.where(F.col("up").isNotNull()).select("c", "a")


def conversations(rows: DataFrame) -> DataFrame:
    """container_id, turn_no, artifact_id, speaker of each mail with text of each kept conversation.

    A container is kept if exactly one of its mails has no parent, every other parent is a mail of the container,
    every mail leads up to the first, no time is null or unreadable, and an opener and a replier have text. Speakers:
    ``unknown`` (no sender), ``system`` (``BOT_``), ``opener`` (who sent the first mail), ``replier``. Turns count from
    1 by instant, then artifact_id; ranks come from ranges, so a container of any size is never one task.
    """
    m = materialize(fold_versions(rows))
    known = m.select("c", F.col("a").alias("p"), F.lit(True).alias("linked"))
    x = m.select("c", "a", "p", "ts", "sender").join(known, ["c", "p"], "left")
    root = F.col("p").isNull()
    checked = x.groupBy("c").agg(
        F.count_if(root).alias("roots"), F.count_if(~root & F.col("linked").isNull()).alias("gaps"), F.count_if(F.col("ts").isNull()).alias("timeless"),
        F.max(F.when(root, F.col("sender"))).alias("opener"),
    )
    sound = materialize(checked.where("roots = 1 AND gaps = 0 AND timeless = 0").select("c", "opener"))
    kept = m.join(sound, "c")
    cyclic = rooted(kept.select("c", "a", "p")).select("c").distinct()
    speaker = F.when(F.col("sender").isNull(), "unknown").when(F.col("sender").startswith("BOT_"), "system").when(F.col("sender") == F.col("opener"), "opener").otherwise("replier")
    turns = kept.join(cyclic, "c", "left_anti").where("said").withColumn("speaker", speaker)
    both = turns.groupBy("c").agg(F.count_if(F.col("speaker") == "opener").alias("o"), F.count_if(F.col("speaker") == "replier").alias("r")).where("o > 0 AND r > 0").select("c")
    turns = turns.join(both, "c", "left_semi").select("c", "container_id", "ts", "a", "artifact_id", "speaker")
    return rank_within(turns, ["c"], ["ts", "a"], "turn_no").select("container_id", F.col("turn_no").cast("int").alias("turn_no"), "artifact_id", "speaker")
