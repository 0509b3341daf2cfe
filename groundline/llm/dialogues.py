"""Problem 3: rebuild conversations from message rows, and drop those that cannot be trusted.

A channel's rows are put in order by a clock and split into sessions wherever the clock jumps by more than a gap; roles are brought to
one writing; a session without reciprocal replies is dropped. Where rows carry a position, position is the clock and 1 the gap, so that a
skipped position is a break, and a conversation of more than one session is dropped (``verdicts`` and ``conversations``); where only times
are known, ``turns`` and ``sessions`` split at a gap calibrated from all pauses, infer missing roles from the turns beside them, and drop
sessions in which not both sides speak. No channel is ever collected: checks are partial aggregates, and windows run inside blocks of the clock.

Defined results: copies of a row (one id) count once; rows without a channel belong to no conversation; null, repeated or skipped
positions, other roles, and contents without a letter or digit make a conversation untrusted; an empty table drops every id of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
#: Positions in one block of the clock.
BLOCK = 1024
#: Bins per doubling of the pause, in the histogram from which the gap is calibrated.
BINS = 2


def role_of(role: Column) -> Column:
    """The role in one writing: without case and surrounding white space."""
    return F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))


def says_something(content: Column) -> Column:
    return F.coalesce(content.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def distinct_messages(messages: DataFrame, *columns: Column) -> DataFrame:
    """One row per message id with the given columns; rows without an id count each for itself."""
    rows = messages.select("id", *columns)
    names = [c for c in rows.columns if c != "id"]
    once = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct(*names)).alias("_")).select("id", *[F.col(f"_.{c}").alias(c) for c in names])
    return once.unionByName(rows.filter("id is null"))


def verdicts(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, first_position, reason) for every id of both tables; reason is null for a conversation to keep."""
    rows = distinct_messages(messages, F.col("conversation_id"), F.col("position"), role_of(F.col("role")).alias("role"), says_something(F.col("content")).alias("says"))
    odd = F.pmod("position", F.lit(2))
    places = rows.filter("conversation_id is not null").groupBy("conversation_id", "position").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("role") == USER).alias("u"),
        F.count_if(F.col("role") == ASSISTANT).alias("a"),
        F.count_if(~F.col("says")).alias("silent"),
    )
    placed = paused(places.filter("position is not null").withColumn("block", F.floor(F.col("position") / BLOCK)), "conversation_id", "position")
    total = placed.unionByName(places.filter("position is null").withColumns({"block": F.lit(None).cast("long"), "pause": F.lit(None).cast("double")})).groupBy("conversation_id").agg(
        F.sum("n").alias("n"),
        F.count("position").alias("places"),
        F.count_if(F.col("position").isNull()).alias("nulls"),
        F.min("position").alias("first_position"),
        F.count_if(F.col("pause") > 1).alias("breaks"),
        F.sum(F.when(odd == 0, F.col("u")).otherwise(F.col("a"))).alias("even_first"),
        F.sum(F.when(odd == 1, F.col("u")).otherwise(F.col("a"))).alias("odd_first"),
        F.sum("silent").alias("silent"),
    )
    known = conversations.filter("id is not null").select(F.col("id").alias("conversation_id")).distinct().withColumn("listed", F.lit(True))
    fits = F.when(F.pmod("first_position", F.lit(2)) == 0, F.col("even_first")).otherwise(F.col("odd_first"))
    reason = (
        F.when(F.col("n").isNull(), "no messages")
        .when(F.col("listed").isNull(), "not listed")
        .when(F.col("nulls") > 0, "position missing")
        .when(F.col("n") > F.col("places"), "position repeated")
        .when(F.col("breaks") > 0, "position skipped")
        .when((fits != F.col("n")) | (F.col("n") % 2 != 0), "no reciprocal replies")
        .when(F.col("silent") > 0, "empty content")
    )
    return total.join(known, "conversation_id", "full_outer").select("conversation_id", "first_position", reason.alias("reason"))


def conversations(messages: DataFrame, listed: DataFrame) -> DataFrame:
    """(conversation_id, turn, role, content, created_at) of the kept conversations; turn counts from 0 in order."""
    kept = verdicts(messages, listed).filter("reason is null").select("conversation_id", "first_position")
    rows = distinct_messages(messages.filter("conversation_id is not null"), F.col("conversation_id"), F.col("position"), role_of(F.col("role")).alias("role"), F.col("content"), F.col("created_at"))
    return rows.join(kept, "conversation_id").select("conversation_id", (F.col("position") - F.col("first_position")).alias("turn"), "role", "content", "created_at")


def paused(rows: DataFrame, channel: str, clock: str, tie: str | None = None) -> DataFrame:
    """rows (channel, clock, block) with pause: the clock since the row before in the channel, null for the first.

    Windows run inside (channel, block of the clock); the last clock of the block before comes from the table of blocks.
    """
    ends = rows.groupBy(channel, "block").agg(F.max(clock).alias("end"))
    earlier = ends.select(channel, "block", F.lag("end").over(Window.partitionBy(channel).orderBy("block")).alias("earlier"))
    inside = Window.partitionBy(channel, "block").orderBy(clock, *([F.col(tie).asc_nulls_first()] if tie else []))
    before = F.coalesce(F.lag(clock).over(inside), F.col("earlier"))
    return rows.join(earlier, [channel, "block"]).withColumn("pause", F.col(clock).cast("double") - before.cast("double")).drop("earlier")


def paced(messages: DataFrame, channel: str = "conversation_id", clock: str = "created_at", block: str = "day") -> DataFrame:
    """Each distinct message with the seconds since the one before it in its channel."""
    rows = distinct_messages(messages, F.col(channel).alias("channel"), F.col(clock).alias("at"), role_of(F.col("role")).alias("role")).filter("channel is not null and at is not null")
    return paused(rows.withColumn("block", F.date_trunc(block, "at")), "channel", "at", "id")


def calibrated_gap(paced_rows: DataFrame) -> float:
    """The pause, in seconds, that best parts the pauses within sessions from those between them.

    A histogram of the logarithms of all pauses (at most a hundred bins, whatever the table) is split where the variance between both
    sides is largest. Without two different pauses the gap is infinite.
    """
    bins = paced_rows.filter("pause > 0").groupBy(F.floor(F.log2("pause") * BINS).alias("bin")).count().orderBy("bin").collect()
    best, gap = 0.0, float("inf")
    total = sum(r["count"] for r in bins)
    mean = sum(r["bin"] * r["count"] for r in bins) / max(1, total)
    seen = moment = 0.0
    for r in bins[:-1]:
        seen, moment = seen + r["count"], moment + r["bin"] * r["count"]
        between = (mean * seen - moment) ** 2 / (seen * (total - seen))
        if between > best:
            best, gap = between, 2.0 ** ((r["bin"] + 1) / BINS)
    return gap


def turns(messages: DataFrame, gap: float | None = None) -> DataFrame:
    """(conversation_id, session, at, id, role, inferred) of every message by time alone, in order of (at, id); sessions count from 0.

    A role that is missing or unknown is inferred by alternation from the nearest known turn before it in its session and block of time,
    else from the nearest after it; where there is none it stays null.
    """
    rows = paced(messages)
    gap = calibrated_gap(rows) if gap is None else gap
    rows = rows.withColumn("opens", F.coalesce(F.col("pause") > gap, F.lit(True)).cast("int"))
    blocks = rows.groupBy("channel", "block").agg(F.sum("opens").alias("opened"))
    running = F.sum("opened").over(Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offset = blocks.select("channel", "block", F.coalesce(running, F.lit(0)).alias("offset"))
    by_time = ("at", F.col("id").asc_nulls_first())
    inside = Window.partitionBy("channel", "block").orderBy(*by_time)
    numbered = rows.withColumn("in_block", F.sum("opens").over(inside)).withColumn("n", F.row_number().over(inside)).join(offset, ["channel", "block"])
    numbered = numbered.withColumn("session", F.col("offset") + F.col("in_block") - 1)
    w = Window.partitionBy("channel", "block", "session").orderBy(*by_time)
    said = F.when(F.col("role").isin(USER, ASSISTANT), F.struct("n", "role"))
    before = F.last(said, ignorenulls=True).over(w)
    after = F.first(said, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.coalesce("before", "after")
    other = F.when(near["role"] == USER, ASSISTANT).otherwise(USER)
    role = F.when(near.isNotNull(), F.when((F.col("n") - near["n"]) % 2 == 0, near["role"]).otherwise(other))
    known = numbered.withColumn("before", before).withColumn("after", after)
    return known.select(F.col("channel").alias("conversation_id"), "session", "at", "id", role.alias("role"), (~F.coalesce(F.col("role").isin(USER, ASSISTANT), F.lit(False))).alias("inferred"))


def sessions(messages: DataFrame, gap: float | None = None) -> DataFrame:
    """(conversation_id, session, messages, inferred, started, ended) of the sessions, by time alone, in which both roles speak."""
    both = turns(messages, gap).groupBy("conversation_id", "session").agg(
        F.count("*").alias("messages"), F.count_if(F.col("inferred") & F.col("role").isNotNull()).alias("inferred"), F.min("at").alias("started"), F.max("at").alias("ended"), F.count_if(F.col("role") == USER).alias("u"), F.count_if(F.col("role") == ASSISTANT).alias("a")
    )
    return both.filter("u > 0 and a > 0").drop("u", "a")
