"""Which known entity a mention means.

Mentions come as a table (mention_id, mention) and their context as (mention_id, context). The resolution of a
batch reads one snapshot of the registry.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_id, stripped
from ..session import short_list
from . import lookup
from .maintenance import days_between, moment


def candidates(mentions: DataFrame, entities: DataFrame, agent: str | None, prefix_limit: int = 10, recent: int = 200) -> DataFrame:
    """(mention_id, mention, id, canonical_name, entity_type, mention_count, last_seen) of what a mention may be. Without an ``agent``
    mentions have an ``agent_id`` each, as the result then has, and meet the registry of that agent.

    Names with the mention's first 60 % (three letters at least) as prefix, and of the ``recent`` newest entities those whose name or alias holds
    the mention or is held by it. The prefix search joins on the prefix itself, so it meets no more than ``prefix_limit`` names a mention.
    """
    keys = [] if agent is not None else ["agent_id"]
    own = entities if agent is None else entities.filter(F.col("agent_id") == agent)
    m = mentions.withColumn("low", stripped(F.lower("mention")))
    m = m.withColumn("prefix", F.substring("low", F.lit(1), F.greatest(F.lit(3), F.ceil(F.length("low") * 0.6).cast("int"))))
    info = ["id", "canonical_name", "entity_type", "mention_count", "last_seen"]
    # Names by those of their prefixes that are asked for, the first in order of each: a prefix of half the registry costs no more than another.
    asked = m.select(*keys, "prefix").filter(F.length("prefix") > 0).distinct()
    lower = own.withColumn("lname", F.lower("canonical_name")).filter(F.length("lname") > 0)
    starts = F.transform(F.sequence(F.lit(1), F.length("lname")), lambda n: F.substring("lname", F.lit(1), n))
    keyed = lower.select(*keys, *info, F.explode(starts).alias("prefix")).join(asked, [*keys, "prefix"], "left_semi")
    order = Window.partitionBy(*keys, "prefix").orderBy("canonical_name", "id")
    first = keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= prefix_limit).drop("rank")
    hits = m.join(first, [*keys, "prefix"]).select(*keys, "mention_id", "mention", *info)
    newest = F.broadcast(lookup.recent_entities(entities, agent, recent)) if agent is not None else short_list(lookup.recent_by_agent(entities, recent))  # at most ``recent`` rows an agent
    meets = lambda x: F.contains(x, F.col("low")) | F.contains(F.col("low"), x)
    met = meets(F.lower("canonical_name")) | F.exists("aliases", lambda a: meets(F.lower(a)))
    held = (m.join(newest, met) if agent is not None else m.join(newest, "agent_id").filter(met)).select(*keys, "mention_id", "mention", *info)
    return hits.unionByName(held).dropDuplicates(["mention_id", "id"])


def top_partner(pairs: DataFrame) -> DataFrame:
    """(id, entity_a, entity_b, count): the most frequent pair of every id."""
    ends = pairs.select(F.col("entity_a").alias("id"), "entity_a", "entity_b", "count").unionByName(pairs.filter("entity_a <> entity_b").select(F.col("entity_b").alias("id"), "entity_a", "entity_b", "count"))
    best = F.min(F.struct((-F.col("count")).alias("k"), "entity_a", "entity_b", "count")).alias("b")
    return ends.groupBy("id").agg(best).select("id", "b.entity_a", "b.entity_b", "b.count")


def context_counts(found: DataFrame, contexts: DataFrame, pairs: DataFrame, only_top: bool = True) -> DataFrame:
    """(mention_id, id, together): how often a candidate met the names around the mention.

    ``only_top``: only the most frequent pair of the smaller id is looked at; otherwise the pair itself.
    """
    ctx = contexts.select("mention_id", entity_id(F.col("context")).alias("ctx"))
    both = found.select("mention_id", "id").join(ctx, "mention_id").select("mention_id", "id", F.least("id", "ctx").alias("a"), F.greatest("id", "ctx").alias("b"))
    if only_top:
        top = top_partner(pairs).toDF("a", "pa", "pb", "count")
        met = both.join(top, "a").filter((F.col("pa") == F.col("a")) & (F.col("pb") == F.col("b")))
    else:
        met = both.join(pairs.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), "count"), ["a", "b"])
    return met.groupBy("mention_id", "id").agg(F.sum("count").alias("together"))


def scores(found: DataFrame, contexts: DataFrame, pairs: DataFrame, as_of: str, recency_days: int = 7, min_together: int = 2, only_top: bool = True) -> DataFrame:
    """``found`` with ``score`` and ``days`` since the entity was last seen."""
    days = days_between(moment(as_of), F.col("last_seen"))
    n = F.coalesce("together", F.lit(0))
    score = (
        F.lit(0.5) + F.when(days < recency_days, 0.3).when(days < 30, 0.1).otherwise(0.0) + F.when(n >= min_together, 0.2).when(n > 0, 0.1).otherwise(0.0)
        + F.when(F.col("mention_count") > 10, 0.1).when(F.col("mention_count") > 3, 0.05).otherwise(0.0)
    )
    return found.join(context_counts(found, contexts, pairs, only_top), ["mention_id", "id"], "left").withColumns({"score": F.least(F.lit(1.0), score), "days": days})


def recency(days) -> F.Column:
    return F.when(days < 7, "recent").when(days < 30, F.concat(days.cast("string"), F.lit("d ago"))).otherwise("not seen recently")


def tiers(mentions: DataFrame, scored: DataFrame, entities: DataFrame, assume: float = 0.8, ask: float = 0.4, recency_days: int = 7, by_agent: bool = False) -> DataFrame:
    """(mention_id, mention, tier, confidence, id, options): exact, new, assume, ask or defer. ``by_agent``: mentions have an ``agent_id``.

    ``options``: up to three candidates of an ``ask``, best first; candidates of one score are in order of id.
    """
    m = mentions.withColumn("own", entity_id(F.col("mention")))
    keys = ["agent_id"] * by_agent
    known = entities.select(*keys, F.col("id").alias("own")).distinct()
    exact = m.join(known, [*keys, "own"], "left_semi")
    open_ = m.join(known, [*keys, "own"], "left_anti").drop("own")
    one = F.struct((-F.round("score", 9)).alias("k"), "id", "canonical_name", "entity_type", "mention_count", "days", "score")
    best = scored.groupBy("mention_id").agg(F.array_sort(F.collect_list(one)).alias("c"))  # bounded by the candidates of a mention
    j = open_.join(best, "mention_id", "left")
    n = F.size("c")
    first, second = F.col("c")[0], F.try_element_at("c", F.lit(2))
    dominant = (first["mention_count"] / F.greatest(F.lit(1), second["mention_count"]) > 5) & (first["days"] < recency_days)
    single = F.when(first["score"] >= assume, "assume").when(first["score"] < ask, "ask").otherwise("defer")
    tier = F.when(F.col("c").isNull(), "new").when(n == 1, single).when(dominant, "assume").otherwise("ask")
    sure = F.when(F.col("c").isNull(), 1.0).when(n == 1, first["score"]).when(dominant, 0.85).otherwise(0.3)
    told = j.withColumns({"tier": tier, "confidence": sure})
    asked = F.col("tier") == "ask"
    out = told.select(
        "mention_id", "mention", "tier", "confidence", F.when(F.col("tier").isin("assume", "defer"), first["id"]).alias("id"),
        F.when(asked, F.slice("c", 1, 3)).alias("options"),
    )
    sure = exact.select("mention_id", "mention", F.lit("exact").alias("tier"), F.lit(1.0).alias("confidence"), F.col("own").alias("id"))
    return out.unionByName(sure, allowMissingColumns=True)


def resolved_tiers(mentions: DataFrame, contexts: DataFrame, entities: DataFrame, pairs: DataFrame, as_of: str, config: Mapping) -> DataFrame:
    """``tiers`` of mentions (agent_id, mention_id, mention), each by the registry of its agent."""
    found = candidates(mentions, entities, None)
    scored = scores(found, contexts, pairs, as_of, config["recency_days"], config["cooccurrence_min"])
    return tiers(mentions, scored, entities, config["assume"], config["ask"], config["recency_days"], by_agent=True)


def resolved_names(named: DataFrame, contexts: DataFrame, entities: DataFrame, pairs: DataFrame, as_of: str, config: Mapping) -> DataFrame:
    """(agent_id, exchange_id, name, canonical_name) of the names (agent_id, exchange_id, name) that are exact or assumed. ``contexts``: the names
    (agent_id, exchange_id, context) of the same exchanges."""
    key = F.concat_ws("\u0001", "agent_id", "exchange_id", "name")
    mentions = named.select("agent_id", "exchange_id", key.alias("mention_id"), F.col("name").alias("mention"))
    around = mentions.join(contexts, ["agent_id", "exchange_id"]).select("mention_id", "context")
    found = resolved_tiers(mentions.drop("exchange_id"), around, entities, pairs, as_of, config).filter(F.col("tier").isin("exact", "assume"))
    chosen = mentions.join(found.select("mention_id", "id"), "mention_id").join(entities.select("agent_id", "id", "canonical_name"), ["agent_id", "id"])
    return chosen.select("agent_id", "exchange_id", F.col("mention").alias("name"), "canonical_name")


def notes(resolved: DataFrame) -> DataFrame:
    """(mention_id, note) for what has to be asked."""
    line = lambda x: F.concat(
        F.lit("- "), x["canonical_name"], F.lit(" ("), F.lower(x["entity_type"]), F.lit(", "), x["mention_count"].cast("string"), F.lit(" mentions, "), recency(x["days"]), F.lit(")")
    )
    text = F.concat_ws("\n", F.concat(F.lit('It is not clear which known entity "'), "mention", F.lit('" is.')), F.lit("Known:"), F.array_join(F.transform("options", line), "\n"), F.lit("Asking which one is meant may help."))
    return resolved.filter("tier = 'ask'").select("mention_id", text.alias("note"))


def canonicalize(batch: DataFrame, resolved: DataFrame, entities: DataFrame, method: str = "conversational") -> DataFrame:
    """``batch`` with subjects and objects replaced by the canonical names of exact and assumed mentions."""
    if method == "exact":
        return batch
    names = resolved.filter(F.col("tier").isin("exact", "assume")).join(entities.select("id", "canonical_name"), "id").groupBy("mention").agg(F.min("canonical_name").alias("name"))
    out = batch
    for c in ("subject", "object"):
        out = out.join(names.toDF(c, "__name"), c, "left").withColumn(c, F.coalesce("__name", c)).drop("__name")
    return out.select(*batch.columns)
