"""Daily archives of messages, and what of them is worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARCHIVE = "messages array<struct<sender:string,text:string>>, _corrupt string"
DOCUMENT = r"(?i)[.](?:doc|docx|epub|md|pdf|txt)\b"


def read_archives(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(messages, bad files) of the files ``<date>.json`` in a folder: (date, pos, sender, text) and (date).

    A file that is no archive is reported, not read, and does not end the job.
    """
    raw = spark.read.schema(ARCHIVE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    dated = raw.withColumn("date", F.regexp_extract(F.input_file_name(), r"([^/]+)[.]json$", 1))
    good = dated.filter("_corrupt IS NULL AND messages IS NOT NULL").select("date", F.posexplode("messages").alias("pos", "m"))
    return good.select("date", F.col("pos").cast("long").alias("pos"), "m.sender", "m.text"), dated.filter("_corrupt IS NOT NULL OR messages IS NULL").select("date")


def unprocessed(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The dates (date) still to be read, in order."""
    return available.select("date").distinct().join(processed.select("date"), "date", "left_anti").orderBy("date")


def pair_exchanges(messages: DataFrame, key: str = "date", order: str = "pos") -> DataFrame:
    """(key, exchange_no, user_text, agent_text): an agent's message ends an exchange, and so does another user message.

    Senders other than user and agent are left out first. Either side may be missing.
    """
    said = messages.filter(F.col("sender").isin("user", "agent"))
    line = Window.partitionBy(key).orderBy(order)
    before = F.lag("sender").over(line)
    starts = before.isNull() | (before == "agent") | (F.col("sender") == "user")
    numbered = said.withColumn("starts", starts.cast("long")).withColumn("exchange_no", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    side = lambda who: F.max(F.when(F.col("sender") == who, F.col("text")))  # noqa: E731 - at most one of each
    return numbered.groupBy(key, "exchange_no").agg(side("user").alias("user_text"), side("agent").alias("agent_text"))


def moment_of(date: Column, number: Column) -> Column:
    """When an exchange of a day is taken to be: its number in seconds after midnight, so that exchanges of a day keep their order and spread over its minutes."""
    return F.to_timestamp(date) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), number.cast("decimal(18,6)"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def eligible(exchanges: DataFrame, least: int = 20, key: str = "date") -> DataFrame:
    """Exchanges long enough, with their id."""
    long_enough = F.length(_text("user_text")) + F.length(_text("agent_text")) >= least
    return exchanges.filter(long_enough).withColumn("exchange_id", F.concat(F.lit("exchange_"), F.col(key).cast("string"), F.lit("_"), F.col("exchange_no").cast("string")))


def for_rebuild(exchanges: DataFrame, most: int = 50, least: int = 30, runtime_notes: tuple[str, ...] = ("runtime context",), key: str = "date") -> DataFrame:
    """Exchanges that a rebuild shows to a model: of the first ``most`` of a day, those long enough that are no
    heartbeat, no context of a sub-agent and no note of the runtime (a text that begins with one of ``runtime_notes``)."""
    kept = eligible(exchanges.filter(F.col("exchange_no") < most), least, key)
    user = F.lower(_text("user_text"))
    skip = user.contains("heartbeat") | user.startswith("[subagent context]")
    for note in runtime_notes:
        skip = skip | user.startswith(note.lower())
    return kept.filter(~skip)


def from_people(events: DataFrame) -> DataFrame:
    """Turn events (session_key, source_session, is_heartbeat, prompt, user_text, n_messages) that people wrote in a chat.

    Left out are heartbeats, sessions of other sessions, of schedules and of sub-agents, other channels, events without messages, and
    work on documents: a long text that names a file of text.
    """
    key = _text("session_key")
    machine = F.coalesce("is_heartbeat", F.lit(False)) | F.col("source_session").isNotNull() | F.lower(_text("prompt")).contains("heartbeat") | key.contains("cron:") | key.contains("subagent:")
    channel = key.contains("telegram") | key.contains("webchat")
    document = _text("user_text").rlike(DOCUMENT) & (F.length(_text("user_text")) > 2000)
    return events.filter(~machine & channel & (F.col("n_messages") > 0) & ~document)
