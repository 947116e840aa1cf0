"""Snapshots from append-only logs: what upserts, one after the other, would leave.

All folds are insert-only over logs: a batch of writes is a batch of rows, and a snapshot is a query. ``fold_triples`` also
accepts the last snapshot as part of its log (``as_log``), so a fold can go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MULTI_VALUED
from ..functions.ids import entity_id


def fold_triples(log: DataFrame) -> DataFrame:
    """The triples after all writes of ``log`` in order of ``seq``.

    A write with an empty part is none; a missing or zero confidence is 1. Writing a triple that is there raises its
    confidence to the larger one. A single-valued predicate holds one object a subject: another object replaces it, and when an
    earlier one returns it is a new triple. So per slot (agent, subject, predicate and, for multi-valued predicates,
    object) the last run of equal objects is what stands: its first write gives the source, its last the time of update.
    The last object of a slot and the last write of any other come from pre-aggregating ``max_by`` and ``max``; no slot is
    sorted in one task, so a subject with a third of all writes is no harder than others.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = log.filter(given("subject") & given("predicate") & given("object"))
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("confidence"))
    first = F.col("first_seq") if "first_seq" in log.columns else F.col("seq")
    created = F.col("created_at") if "created_at" in log.columns else F.col("ts")
    rows = rows.withColumns({"confidence": confidence, "subject": entity_id(F.col("subject")), "object": entity_id(F.col("object")), "__first": first, "__created": created})
    # Runs of one object, pre-aggregated: most writes of a slot collapse before the shuffle.
    slot = ["agent_id", "subject", "predicate"]
    multi = F.col("predicate").isin(*sorted(MULTI_VALUED))
    last = rows.filter(~multi).groupBy(*slot, "object").agg(F.max("seq").alias("last"))
    top = last.groupBy(*slot).agg(F.max_by("object", "last").alias("__object"))
    other = last.join(top, slot).filter(F.col("object") != F.col("__object")).groupBy(*slot).agg(F.max("last").alias("__since"))
    bounds = top.join(other, slot, "left")
    standing = rows.filter(~multi).join(bounds, slot).filter((F.col("object") == F.col("__object")) & (F.col("seq") > F.coalesce("__since", F.lit(-(1 << 62)))))
    kept = rows.filter(multi).unionByName(standing.drop("__object", "__since"))
    return kept.groupBy(*slot, "object").agg(
        F.max("confidence").alias("confidence"), F.min_by("source_exchange_id", "seq").alias("source_exchange_id"), F.min_by("source_date", "seq").alias("source_date"),
        F.min_by("__created", "seq").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.min("__first").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min_by("pending", "seq").alias("pending"),
    )


def as_log(triples: DataFrame) -> DataFrame:
    """A snapshot as the head of a log that later writes follow."""
    return triples.withColumns({"seq": F.col("last_seq"), "ts": F.col("updated_at")}).drop("last_seq", "updated_at")


def onto_triples(triples: DataFrame, log: DataFrame) -> DataFrame:
    """The snapshot ``triples`` after the later writes of ``log``. Slots that it does not write to stay as they are, whatever upkeep has
    made of them; the others are folded on from what stands in them."""
    slot = ["agent_id", "subject", "predicate"]
    new = log.withColumns({"first_seq": F.col("seq"), "created_at": F.col("ts")})
    touched = log.select("agent_id", entity_id(F.col("subject")).alias("subject"), "predicate").distinct()
    there = as_log(triples.join(touched, slot, "left_semi")).select(*new.columns)
    folded = fold_triples(there.unionByName(new))
    return triples.join(touched, slot, "left_anti").unionByName(folded.select(*triples.columns))


def onto_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """The registry ``entities`` after later mentions, folded in ``new``: names, types and aliases stay, mentions add up."""
    both = entities.withColumn("__late", F.lit(0)).unionByName(new.select(*entities.columns).withColumn("__late", F.lit(1)))
    first = lambda c: F.min_by(c, "__late").alias(c)
    return both.groupBy("agent_id", "id").agg(
        first("canonical_name"), first("entity_type"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mention_count").alias("mention_count"), first("aliases")
    ).select(*entities.columns)


def onto_cooccurrences(pairs: DataFrame, new: DataFrame) -> DataFrame:
    both = pairs.unionByName(new.select(*pairs.columns))
    return both.groupBy("agent_id", "entity_a", "entity_b").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen")).select(*pairs.columns)


def fold_entities(mentions: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """The registry: name and type of the first mention, times of first and last, number of mentions."""
    rows = mentions.withColumn("id", entity_id(F.col("name")))
    return rows.groupBy("agent_id", *extra_keys, "id").agg(
        F.min_by("name", "seq").alias("canonical_name"), F.min_by(F.coalesce("entity_type", F.lit("CONCEPT")), "seq").alias("entity_type"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("mention_count"),
        F.array().cast("array<string>").alias("aliases"),
    )


def pairs_of(mentions: DataFrame) -> DataFrame:
    """(agent_id, exchange_id, entity_a, entity_b, ts): each pair of different entities of an exchange, once.

    The pairs of an exchange are its result (at most 15 names are kept of one, and of the known names those of the 200 newest), so the join is on the exchange.
    """
    own = mentions.select("agent_id", "exchange_id", entity_id(F.col("name")).alias("id"), "ts").groupBy("agent_id", "exchange_id", "id").agg(F.max("ts").alias("ts"))
    a, b = own.withColumnRenamed("id", "entity_a"), own.withColumnsRenamed({"id": "entity_b", "ts": "ts_b"})
    return a.join(b, ["agent_id", "exchange_id"]).filter("entity_a < entity_b").select("agent_id", "exchange_id", "entity_a", "entity_b", F.greatest("ts", "ts_b").alias("ts"))


def fold_cooccurrences(pairs: DataFrame) -> DataFrame:
    """Counts of unordered pairs, one an exchange."""
    return pairs.groupBy("agent_id", F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b")).agg(
        F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_seen")
    )


def latest_seq(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0] or 0


def sequence(batch: DataFrame, after: int, ts: str, key: str) -> DataFrame:
    """``batch`` with the arrival numbers that follow ``after``, in order of time and key.

    A number is the rank within its minute and the count of all earlier minutes, so no task sorts the whole batch, and
    running it again gives the same numbers.
    """
    rows = batch.withColumn("__minute", F.date_trunc("minute", ts))
    counts = rows.groupBy("__minute").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col("__minute").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__minute").alias("__m"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__minute").orderBy(ts, key))
    ranked = rows.withColumn("__rank", rank).join(starts, F.col("__minute").eqNullSafe(F.col("__m")))
    return ranked.withColumn("seq", F.lit(after) + F.col("__start") + F.col("__rank")).drop("__minute", "__m", "__start", "__rank")
