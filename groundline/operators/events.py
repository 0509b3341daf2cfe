"""Answer streams as rows: the events an answer is told in, their faults, what a reader makes of them, and what is stored of an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types of events with the fields each may have besides version and type, and the types that end a stream.
FIELDS = {
    "conversation": ("conversation_id",),
    "status": ("stage", "retrieval_query"),
    "claim": ("index", "text", "citations"),
    "citations": ("citations",),
    "completed": ("message_id",),
    "abstention": ("message",),
    "error": ("message",),
}
TERMINAL = ("completed", "abstention", "error")


def _claims() -> Column:
    return F.coalesce(F.transform("payload.claims", lambda c: c["text"]), F.array().cast("array<string>"))


def told(messages: DataFrame) -> DataFrame:
    """(id, seq, type, text): the events that each stored answer stands for; one without a status has no end."""
    event = lambda kind, text=None: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text") if text is None else text.alias("text"))
    status = F.col("payload.status")
    end = F.when(status == "answered", F.array(event("citations"), event("completed"))).when(status == "abstained", F.array(event("abstention"))).when(status == "error", F.array(event("error")))
    none = F.array().cast("array<struct<type:string,text:string>>")
    everything = F.concat(F.array(event("conversation"), event("status")), F.transform(_claims(), lambda t: event("claim", t)), F.coalesce(end, none))
    return messages.select("id", F.posexplode(everything).alias("seq", "e")).select("id", "seq", "e.type", "e.text")


def settled(messages: DataFrame) -> DataFrame:
    """(id, stored, status, claims, citations): an answer without citations is an error, and only an answer keeps its claims and citations."""
    stored, cited = F.col("payload.status"), F.coalesce(F.array_size("payload.citations"), F.lit(0))
    status = F.when((stored == "answered") & (cited > 0), "answered").when(stored == "abstained", "abstained").otherwise("error")
    rows = messages.select("id", stored.alias("stored"), status.alias("status"), F.size(_claims()).alias("n"), cited.alias("c"))
    kept = lambda c: F.when(F.col("status") == "answered", F.col(c)).otherwise(0)
    return rows.select("id", "stored", "status", kept("n").alias("claims"), kept("c").alias("citations"))


def shown(events: DataFrame, key: str) -> DataFrame:
    """(key, status, claims): what a reader holds after the events (key, seq, type, text): an abstention clears the claims, an error keeps them."""
    state = events.groupBy(key).agg(F.max(F.struct("seq", "type"))["type"].alias("last"), F.sort_array(F.collect_list(F.when(F.col("type") == "claim", F.struct("seq", "text")))).alias("held"))
    status = F.when(F.col("last") == "completed", "answered").when(F.col("last") == "abstention", "abstained").when(F.col("last") == "error", "error").otherwise("open")
    return state.select(key, status.alias("status"), F.when(F.col("last") == "abstention", F.array().cast("array<string>")).otherwise(F.col("held.text")).alias("claims"))


def as_lines(events: DataFrame) -> DataFrame:
    """Each event as one line of JSON: (…, line) of (…, type, text)."""
    return events.withColumn("line", F.to_json(F.struct(F.lit(2).alias("version"), "type", "text")))


def faults(lines: DataFrame, key: str) -> DataFrame:
    """(key, fault) of the streams of lines (key, seq, line): what a reader must not accept; null for a sound one.

    A line is an event if it is an object of version 2 whose type is known and whose fields belong to that type. Only partial aggregates
    are shuffled, however long a stream is.
    """
    event = F.from_json("line", "map<string,string>")
    kind = F.element_at(event, "type")
    allowed = F.element_at(F.create_map(*[x for k, names in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, ("version", "type", *names))))]), kind)
    fine = (F.element_at(event, "version") == "2") & (F.size(F.array_except(F.map_keys(event), allowed)) == 0)
    rows = lines.select(key, "seq", (~F.coalesce(fine, F.lit(False))).alias("odd"), F.coalesce(kind.isin(*TERMINAL), F.lit(False)).alias("ends"))
    state = rows.groupBy(key).agg(F.count_if("odd").alias("odd"), F.min(F.when(F.col("ends"), F.col("seq"))).alias("end"), F.max("seq").alias("last"))
    return state.select(key, F.when(F.col("odd") > 0, "not an event").when(F.col("end").isNull(), "no end").when(F.col("last") > F.col("end"), "event after the end").alias("fault"))


def balanced_emphasis(text: Column) -> Column:
    """The text without its ** marks if their number is odd."""
    return F.when(F.regexp_count(text, F.lit(r"\*\*")) % 2 == 1, F.replace(text, F.lit("**"), F.lit(""))).otherwise(text)


def same_scope(a: Column, b: Column) -> Column:
    """Whether two scopes {subject, course_id, document_id} are one; nulls are equal."""
    return a["subject"].eqNullSafe(b["subject"]) & a["course_id"].eqNullSafe(b["course_id"]) & a["document_id"].eqNullSafe(b["document_id"])
