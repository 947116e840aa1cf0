"""Exchanges as a stream: each micro-batch is extracted, appended to the logs and folded onto the last snapshots.

What is last by arrival wins, so there is no event time and no watermark. A batch goes on from the last state, so upkeep (decay, expiry,
merges, cleared flags) stays in force and no older log is read. A batch that is run again (after a failure) writes the
same log batch again and is folded onto the state before it, or, where other changes followed, is left as it is; so it does not count twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions import extract, model, names
from ..operators import fold, lookup, resolve
from ..sources.store import GraphStore, State

EXCHANGE = schema.EXCHANGES


def statements(exchanges: DataFrame, known: DataFrame | None, config: Mapping | None, after: int) -> tuple[DataFrame, DataFrame]:
    """(mention log, triple log) of a batch of exchanges, numbered after ``after`` in order of time and id."""
    numbered = fold.sequence(exchanges, 0, "ts", "exchange_id").withColumn("first", F.lit(after) + F.col("seq") * 1_000_000)
    facts = numbered.select("exchange_id", "agent_id", "ts", "first")
    said = numbered.select("exchange_id", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("content")) for i, c in enumerate(("user_text", "agent_text"))])).alias("m"))
    texts = extract.exchange_texts(said.select("exchange_id", "m.pos", "m.content"))
    if known is not None and "agent_id" in known.columns:
        texts = texts.join(numbered.select("exchange_id", "agent_id"), "exchange_id")
    recognise = names.named_things if (config or {}).get("recogniser") == "rules" else None
    found, triples, _ = extract.extract(texts, known, recognise, config)
    mentions = found.join(facts, "exchange_id").select("agent_id", (F.col("first") + F.col("pos")).alias("seq"), "ts", "name", "entity_type", "exchange_id")
    # Triples of an exchange follow its mentions, in a fixed order.
    order = F.row_number().over(Window.partitionBy("exchange_id").orderBy("subject", "predicate", "object"))
    told = triples.withColumn("n", order).join(facts, "exchange_id").select(
        "agent_id", (F.col("first") + 500_000 + F.col("n")).alias("seq"), "ts", "subject", "predicate", "object", "confidence",
        F.col("exchange_id").alias("source_exchange_id"), F.to_date("ts").alias("source_date"), F.lit(False).alias("pending"),
    )
    return mentions, told


def canonical(mentions: DataFrame, triples: DataFrame, entities: DataFrame, pairs: DataFrame, as_of: str, config: Mapping) -> tuple[DataFrame, DataFrame]:
    """``mentions`` and ``triples`` of a batch with names that the registry knows as another in its place: exact and assumed ones.

    A name is resolved by its agent's registry, and by the names of its exchange as context. Each distinct name of an agent and exchange is one mention.
    """
    if config["method"] == "exact":
        return mentions, triples
    named = mentions.select("agent_id", "exchange_id", "name").unionByName(triples.select("agent_id", F.col("source_exchange_id").alias("exchange_id"), F.col("subject").alias("name")))
    named = named.unionByName(triples.select("agent_id", F.col("source_exchange_id").alias("exchange_id"), F.col("object").alias("name"))).distinct()
    context = mentions.select("agent_id", "exchange_id", F.col("name").alias("context")).distinct()
    chosen = resolve.resolved_names(named, context, entities, pairs, as_of, config)
    keys = ["agent_id", "exchange_id", "name"]
    now = chosen.select(*keys, "canonical_name")
    mentions = mentions.join(now, keys, "left").withColumn("name", F.coalesce("canonical_name", "name")).drop("canonical_name")
    for c in ("subject", "object"):
        own = now.select("agent_id", F.col("exchange_id").alias("source_exchange_id"), F.col("name").alias(c), "canonical_name")
        triples = triples.join(own, ["agent_id", "source_exchange_id", c], "left").withColumn(c, F.coalesce("canonical_name", c)).drop("canonical_name")
    return mentions, triples


def ingest_batch(store: GraphStore, batch: DataFrame, number: int, config: Mapping | None = None, resolution: Mapping | None = None) -> None:
    """Append one batch of exchanges and fold it onto the last state. With ``resolution`` names become those of the registry that they stand for."""
    base = store.base_for(number)
    if base is None:
        return
    entities = store.read("entities", state=base)
    known = lookup.recent_by_agent(entities, 200).select("agent_id", "canonical_name", "entity_type")
    mentions, triples = statements(batch, known, config, base.seq)
    if resolution and base.tables:
        latest = batch.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if latest:
            mentions, triples = store.staged("mention_log", number, mentions), store.staged("triple_log", number, triples)
            mentions, triples = canonical(mentions, triples, entities, store.read("cooccurrences", state=base), latest, resolution)
    write_statements(store, number, base, mentions, triples)
    store.unstage()


def write_statements(store: GraphStore, number: int, base: State, mentions: DataFrame, triples: DataFrame, aliases: DataFrame | None = None) -> None:
    """Append the statements of a batch to the logs and fold them onto ``base``. ``aliases``: (agent_id, id, aliases) to add to the registry."""
    store.append("mention_log", number, mentions)
    store.append("triple_log", number, triples)
    mentions, triples = store.read_log("mention_log", [number]), store.read_log("triple_log", [number])
    last = max(fold.latest_seq(mentions), fold.latest_seq(triples))
    entities = fold.onto_entities(store.read("entities", state=base), fold.fold_entities(mentions))
    if aliases is not None:
        entities = model.with_aliases(entities, aliases)
    tables = {
        "triples": fold.onto_triples(store.read("triples", state=base), triples), "entities": entities,
        "cooccurrences": fold.onto_cooccurrences(store.read("cooccurrences", state=base), fold.fold_cooccurrences(fold.pairs_of(mentions))),
    }
    store.commit(tables, base, number, last)


def start(spark: SparkSession, source: str, store: GraphStore, checkpoint: str, config: Mapping | None = None, trigger: Mapping | None = None, resolution: Mapping | None = None) -> StreamingQuery:
    """Follow a folder of JSON lines of exchanges (``EXCHANGE``)."""
    stream = spark.readStream.schema(EXCHANGE).json(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_batch(store, df, n, config, resolution))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
