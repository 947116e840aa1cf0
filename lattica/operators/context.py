"""What is known about entities, as relations and as sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lookup

#: What stands between subject and object in a sentence; other predicates are not said.
VERBS = {
    "causes": "leads to", "created": "created", "has_property": "has", "interested_in": "is interested in", "knows": "knows", "located_in": "is in",
    "occurred_at": "occurred at", "part_of": "is part of", "prefers": "prefers", "related_to": "is related to", "uses": "uses", "works_on": "works on",
}


def entity_context(triples: DataFrame, entities: DataFrame, pairs: DataFrame, name: str, agent: str) -> DataFrame:
    """One row: the entity, its relationships as a map from predicate to triples, co-occurring ids, number of triples.
    No row for an unknown entity."""
    found = lookup.triples_for(triples, name, agent)
    one = F.struct("subject", "object", "confidence", F.col("source_date").alias("date"))
    grouped = found.groupBy("predicate").agg(F.array_sort(F.collect_list(one)).alias("list"), F.count(F.lit(1)).alias("n"))
    summed = grouped.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "list")))).alias("relationships"), F.coalesce(F.sum("n"), F.lit(0)).alias("triple_count"))
    beside = lookup.cooccurring(pairs, name, 10).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "other", "count"))).alias("l"))
    beside = beside.select(F.transform("l", lambda x: F.struct(x["other"].alias("entity"), x["count"].alias("count"))).alias("cooccurrences"))
    row = entities.filter((F.col("id") == lookup.id_of(name)) & (F.col("agent_id") == agent))
    # One row each: joins on nothing are of single rows.
    return row.withColumn("__k", F.lit(1)).join(summed.withColumn("__k", F.lit(1)), "__k").join(beside.withColumn("__k", F.lit(1)), "__k").drop("__k")


def context_edges(triples: DataFrame, entities: DataFrame, seeds: Sequence[str], agent: str, min_confidence: float = 0.6, min_mentions: int = 2, exclude: Sequence[str] = ("related_to",), limit: int = 50) -> DataFrame:
    """(rank, subject, predicate, object, subject_name, object_name): what may be said about the seeds, best first.

    The limit comes before the filters: predicates to leave out, triples with neither end registered, and registered objects with few
    mentions.
    """
    wanted = list(dict.fromkeys(seeds))
    own = triples.filter((F.col("agent_id") == agent) & (F.col("confidence") >= min_confidence) & (F.col("subject").isin(*wanted) | F.col("object").isin(*wanted)))
    order = [F.desc("confidence"), *lookup.newest_first()]
    top = own.orderBy(*order).limit(limit)
    names = entities.filter(F.col("agent_id") == agent)
    top = F.broadcast(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))  # at most ``limit`` rows
    ends = names.select("id", "canonical_name", "mention_count")
    joined = top.join(ends.toDF("subject", "subject_known", "subject_mentions"), "subject", "left").join(ends.toDF("object", "object_known", "object_mentions"), "object", "left")
    kept = joined.filter(~F.col("predicate").isin(*exclude)) if exclude else joined
    kept = kept.filter(F.coalesce("subject_known", "object_known").isNotNull() & (F.col("object_mentions").isNull() | (F.col("object_mentions") >= min_mentions)))
    return kept.select("rank", "subject", "predicate", "object", F.coalesce("subject_known", "subject").alias("subject_name"), F.coalesce("object_known", "object").alias("object_name"))


def sentences(edges: DataFrame, max_lines: int = 5) -> DataFrame:
    """(line, sentence): the edges of one subject as one sentence, subjects in order of their best edge."""
    verb = F.element_at(F.create_map(*[F.lit(x) for p in sorted(VERBS.items()) for x in p]), F.col("predicate"))
    clauses = edges.withColumn("clause", F.concat_ws(" ", verb, "object_name")).withColumn("said", verb.isNotNull())
    grouped = clauses.groupBy("subject_name").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.when(F.col("said"), F.struct("rank", "clause")))).alias("c"))
    c = F.transform("c", lambda x: x["clause"])
    grouped = grouped.filter(F.size("c") > 0).withColumn("c", c)
    n = F.size("c")
    told = (
        F.when(n == 1, F.col("c")[0]).when(n == 2, F.array_join("c", " and "))
        .otherwise(F.concat(F.array_join(F.slice(F.col("c"), F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at("c", -1)))
    )
    line = F.row_number().over(Window.orderBy("first"))
    return grouped.select("first", F.concat_ws(" ", "subject_name", told).alias("sentence")).orderBy("first").limit(max_lines).select(line.alias("line"), "sentence")
