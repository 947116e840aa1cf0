"""Point lookups, filters and statistics over the snapshots. Every limit follows a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_id

NEWEST = (F.desc, "updated_at"), (F.asc, "subject"), (F.asc, "predicate"), (F.asc, "object")


def newest_first() -> list[Column]:
    return [direction(c) for direction, c in NEWEST]


def id_of(name: str) -> Column:
    """The id of a name given by a caller, folded to a constant by the optimizer."""
    return entity_id(F.lit(name))


def entity(entities: DataFrame, id_: str) -> DataFrame:
    return entities.filter(F.col("id") == id_)


def entity_by_name(entities: DataFrame, name: str, agent: str) -> DataFrame:
    return entities.filter((F.col("canonical_name") == name) & (F.col("agent_id") == agent))


def entities_by_prefix(entities: DataFrame, prefix: str, agent: str, limit: int = 10) -> DataFrame:
    """Names that begin with ``prefix`` whatever their case, in order of name."""
    return entities.filter((F.col("agent_id") == agent) & F.lower("canonical_name").startswith(F.lower(F.lit(prefix)))).orderBy("canonical_name", "id").limit(limit)


def resolve_or_create(entities: DataFrame, names: DataFrame, agent: str) -> DataFrame:
    """(name, id, is_new) of ``names`` (name)."""
    known = entities.filter(F.col("agent_id") == agent).select("id", F.lit(True).alias("known"))
    return names.withColumn("id", entity_id(F.col("name"))).join(known, "id", "left").select("name", "id", F.col("known").isNull().alias("is_new"))


def triples_for(triples: DataFrame, name: str, agent: str, limit: int = 50) -> DataFrame:
    """The ``limit`` newest triples with the entity as subject and the ``limit`` newest as object; a self-loop once."""
    own = triples.filter(F.col("agent_id") == agent)
    sides = [own.filter(F.col(c) == id_of(name)).orderBy(*newest_first()).limit(limit) for c in ("subject", "object")]
    return sides[0].unionByName(sides[1]).dropDuplicates(["agent_id", "subject", "predicate", "object"])


def query_triples(triples: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None, agent: str | None = None, limit: int = 50) -> DataFrame:
    out = triples
    for column, value in (("subject", subject and id_of(subject)), ("predicate", predicate), ("object", object_ and id_of(object_)), ("agent_id", agent)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.orderBy(*newest_first()).limit(limit)


def triples_by_id(triples: DataFrame, id_: str, agent: str, limit: int = 20) -> DataFrame:
    """The ``limit`` newest triples that touch the id on either side."""
    return triples.filter((F.col("agent_id") == agent) & ((F.col("subject") == id_) | (F.col("object") == id_))).orderBy(*newest_first()).limit(limit)


def by_exchange(triples: DataFrame, exchange: str) -> DataFrame:
    return triples.filter(F.col("source_exchange_id") == exchange)


def without_exchange(triples: DataFrame, exchange: str) -> DataFrame:
    return triples.filter(~F.col("source_exchange_id").eqNullSafe(exchange))


def cooccurring(pairs: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The pairs of an entity, most frequent first, with the ``other`` end."""
    own = id_of(name)
    found = pairs.filter((F.col("entity_a") == own) | (F.col("entity_b") == own))
    return found.withColumn("other", F.when(F.col("entity_a") == own, F.col("entity_b")).otherwise(F.col("entity_a"))).orderBy(F.desc("count"), "entity_a", "entity_b").limit(limit)


def top_pairs(pairs: DataFrame, limit: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "entity_a", "entity_b").limit(limit)


def recent_entities(entities: DataFrame, agent: str, limit: int = 200) -> DataFrame:
    return entities.filter(F.col("agent_id") == agent).orderBy(F.desc("last_seen"), "id").limit(limit)


def recent_by_agent(entities: DataFrame, limit: int = 200) -> DataFrame:
    """The ``limit`` newest entities of each agent."""
    order = Window.partitionBy("agent_id").orderBy(F.desc("last_seen"), "id")
    return entities.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= limit).drop("__rank")


def predicate_stats(triples: DataFrame, agent: str) -> DataFrame:
    own = triples.filter(F.col("agent_id") == agent)
    return own.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.avg("confidence").alias("avg_confidence")
    )


def graph_stats(triples: DataFrame, entities: DataFrame, pairs: DataFrame, agent: str) -> DataFrame:
    """(section, name, value): the counts, the ten newest entities and the ten most frequent pairs."""
    count = lambda df, name: df.filter(F.col("agent_id") == agent).agg(F.count(F.lit(1)).alias("value")).select(F.lit("count").alias("section"), F.lit(name).alias("name"), "value")
    recent = recent_entities(entities, agent, 10).select(F.lit("recent").alias("section"), F.col("id").alias("name"), F.col("mention_count").alias("value"))
    top = top_pairs(pairs, 10).select(F.lit("pair").alias("section"), F.concat_ws("|", "entity_a", "entity_b").alias("name"), F.col("count").alias("value"))
    return count(entities, "entities").unionByName(count(triples, "triples")).unionByName(recent).unionByName(top)


def active_patterns(patterns: DataFrame, agent: str) -> DataFrame:
    return patterns.filter((F.col("agent_id") == agent) & F.col("active")).orderBy(F.desc("weight"), F.array_join("predicates", ">"))
