"""Upkeep: decay, expiry, pending entities, merges, and questions about gaps. Each gives a new snapshot or a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down; 999 where there is no earlier time."""
    return F.coalesce(F.floor((later.cast("double") - earlier.cast("double")) / 86400.0), F.lit(999))


def on_or_before_day(stamp: Column, cutoff: Column) -> Column:
    """Stored stamps compare with a cutoff by text, in which the whole day of the cutoff counts as before it."""
    return F.to_date(stamp) <= F.to_date(cutoff)


def decay(triples: DataFrame, agent: str, as_of: str, half_life_days: float = 90, floor: float = 0.1) -> DataFrame:
    """Halve, once a call, the confidence of triples above ``floor`` that were not written for longer than the half-life."""
    age = (moment(as_of).cast("double") - F.col("updated_at").cast("double")) / 86400.0
    due = (F.col("agent_id") == agent) & (F.col("confidence") > floor) & (age > half_life_days)
    return triples.withColumn("confidence", F.when(due, F.col("confidence") * 0.5).otherwise(F.col("confidence"))).withColumn("decayed", due)


def _limits(ttl: Mapping[str, int], as_of: str) -> Column:
    """The day on or before which a triple of its predicate has expired; null for predicates without a limit."""
    if not ttl:
        return F.lit(None).cast("timestamp")
    days = F.element_at(F.create_map(*[F.lit(x) for p in sorted(ttl.items()) for x in p]), F.col("predicate"))
    return moment(as_of) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), days)


def expired(triples: DataFrame, agent: str, ttl: Mapping[str, int], as_of: str) -> DataFrame:
    return triples.filter((F.col("agent_id") == agent) & on_or_before_day(F.col("created_at"), _limits(ttl, as_of)))


def expire(triples: DataFrame, agent: str, ttl: Mapping[str, int], as_of: str) -> DataFrame:
    """The triples that stay."""
    gone = (F.col("agent_id") == agent) & on_or_before_day(F.col("created_at"), _limits(ttl, as_of))
    return triples.filter(~F.coalesce(gone, F.lit(False)))


def expired_counts(triples: DataFrame, agent: str, ttl: Mapping[str, int], as_of: str) -> DataFrame:
    return expired(triples, agent, ttl, as_of).groupBy("predicate").agg(F.count(F.lit(1)).alias("expired"))


def pending_outcomes(triples: DataFrame, entities: DataFrame, agent: str, as_of: str, recency_days: int = 7, max_age_days: int = 30) -> DataFrame:
    """(id, outcome) of the registered ends of pending triples: resolved, expired or waiting."""
    own = triples.filter((F.col("agent_id") == agent) & F.col("pending"))
    ids = own.select(F.col("subject").alias("id")).union(own.select(F.col("object").alias("id"))).distinct()
    days = days_between(moment(as_of), F.col("last_seen"))
    outcome = F.when((F.col("mention_count") > 1) | (days < recency_days), "resolved").when(days > max_age_days, "expired").otherwise("waiting")
    return ids.join(entities.filter(F.col("agent_id") == agent), "id").select("id", outcome.alias("outcome"))


def clear_pending(triples: DataFrame, outcomes: DataFrame, agent: str) -> DataFrame:
    """``triples`` with the flag cleared where an end is resolved or expired."""
    done = outcomes.filter("outcome <> 'waiting'").select("id")
    s, o = done.withColumnsRenamed({"id": "subject"}).withColumn("s", F.lit(True)), done.withColumnsRenamed({"id": "object"}).withColumn("o", F.lit(True))
    hit = (F.col("agent_id") == agent) & F.coalesce("s", "o", F.lit(False))
    return triples.join(s, "subject", "left").join(o, "object", "left").withColumn("pending", F.col("pending") & ~hit).drop("s", "o")


def merge_entities(triples: DataFrame, entities: DataFrame, keep: str, merge: str, agent: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(triples, entities) after ``merge`` became ``keep``; unchanged when either is unknown.

    Names and aliases of the merged entity become aliases, mentions add up, both ends of triples are rewritten and
    those of the kept entity are pending no more. Equal triples that arise stay apart, and pairs are not rewritten.
    """
    both = entities.filter((F.col("agent_id") == agent) & F.col("id").isin(keep, merge))
    gone = both.filter(F.col("id") == merge).select("agent_id", F.col("canonical_name").alias("m_name"), F.col("aliases").alias("m_aliases"), F.col("mention_count").alias("m_count"))
    kept = both.filter(F.col("id") == keep).join(gone, "agent_id")
    names = F.array_except(F.array_distinct(F.concat("aliases", "m_aliases", F.array("m_name"))), F.array("canonical_name"))
    changed = kept.withColumns({"aliases": names, "mention_count": F.col("mention_count") + F.col("m_count")}).select(*entities.columns)
    ready = F.broadcast(kept.select("agent_id").distinct().withColumn("ready", F.lit(True)))  # one row or none
    rest = entities.join(ready, "agent_id", "left").filter(~(F.coalesce("ready", F.lit(False)) & F.col("id").isin(keep, merge))).select(*entities.columns)
    t = triples.join(ready, "agent_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    touched = F.col("ready") & ((F.col("subject") == merge) | (F.col("object") == merge))
    end = lambda c: F.when(F.col("ready") & (F.col(c) == merge), F.lit(keep)).otherwise(F.col(c))
    t = t.withColumn("updated_at", F.when(touched, moment(as_of)).otherwise(F.col("updated_at"))).withColumns({"subject": end("subject"), "object": end("object")})
    t = t.withColumn("pending", F.col("pending") & ~(F.col("ready") & ((F.col("subject") == keep) | (F.col("object") == keep))))
    return t.select(*triples.columns), rest.unionByName(changed)


def _degree(triples: DataFrame, agent: str) -> DataFrame:
    """(id, degree, specific): triples that touch an id, a self-loop once, and those of them that say more than related_to."""
    own = triples.filter(F.col("agent_id") == agent)
    ends = own.select(F.col("subject").alias("id"), "predicate").unionByName(own.filter("subject <> object").select(F.col("object").alias("id"), "predicate"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("predicate") != "related_to", 1)).alias("specific"))


def under_connected(triples: DataFrame, entities: DataFrame, agent: str, mentions: int = 5, edges: int = 3, limit: int = 5) -> DataFrame:
    own = entities.filter((F.col("agent_id") == agent) & (F.col("mention_count") > mentions))
    n = F.coalesce("degree", F.lit(0))
    return own.join(_degree(triples, agent), "id", "left").filter(n < edges).select("id", "canonical_name", "mention_count", n.alias("triple_count")).orderBy(F.desc("mention_count"), "id").limit(limit)


def generic_only(triples: DataFrame, entities: DataFrame, agent: str, mentions: int = 3, limit: int = 5) -> DataFrame:
    own = entities.filter((F.col("agent_id") == agent) & (F.col("mention_count") > mentions))
    return own.join(_degree(triples, agent).filter("specific = 0"), "id").select("id", "canonical_name", "mention_count").orderBy("id").limit(limit)


def dead_zone(entities: DataFrame, agent: str, as_of: str, days: int = 30, mentions: int = 5, limit: int = 3) -> DataFrame:
    quiet = on_or_before_day(F.col("last_seen"), moment(as_of) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days)))
    own = entities.filter((F.col("agent_id") == agent) & (F.col("mention_count") > mentions) & quiet)
    return own.select("id", "canonical_name", "mention_count").orderBy(F.desc("mention_count"), "id").limit(limit)


def knowledge_gaps(triples: DataFrame, entities: DataFrame, agent: str, as_of: str, days: int = 30, known: Sequence[str] = ()) -> DataFrame:
    """(question, type, source_id). Names in ``known`` need no question; they are left out after the limits."""
    unknown = ~F.lower("canonical_name").isin(*known) if known else F.lit(True)
    name = F.col("canonical_name")
    ask = lambda df, kind, *parts: df.select(F.concat(*parts).alias("question"), F.lit(kind).alias("type"), F.concat(F.lit("graph:"), "id").alias("source_id"))
    few = ask(
        under_connected(triples, entities, agent).filter(unknown), "under_connected", F.lit("What is on record about "), name, F.lit("? Mentioned "), F.col("mention_count").cast("string"),
        F.lit(" times, with hardly any relationship."),
    )
    vague = ask(generic_only(triples, entities, agent).filter(unknown), "generic_only", F.lit("In what way is "), name, F.lit(" related to the rest? So far it is only associated."))
    quiet = ask(dead_zone(entities, agent, as_of, days), "temporal_dead_zone", F.lit("Nothing new on "), name, F.lit(f" for over {days} days. Is it as before?"))
    return few.unionByName(vague).unionByName(quiet)
