"""Graph retrieval: link expansion, multi-hop traversal and the fusion of scores.

An edge that may be walked either way is two rows, so every step is an equi-join; a condition with OR would be
planned as a Cartesian product. The number of hops is small and known, so the loop is unrolled into one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_id
from .lookup import newest_first


def walkable(triples: DataFrame) -> DataFrame:
    """(here, there, subject, predicate, object, source_exchange_id, confidence): each triple from both its ends."""
    rest = ["subject", "predicate", "object", "source_exchange_id", "confidence"]
    forth = triples.select(F.col("subject").alias("here"), F.col("object").alias("there"), *rest)
    back = triples.filter("subject <> object").select(F.col("object").alias("here"), F.col("subject").alias("there"), *rest)
    return forth.unionByName(back)


def hop_paths(triples: DataFrame, entities: DataFrame, seeds: Sequence[str], agent: str, max_hops: int = 2, decay: float = 0.7, min_confidence: float = 0.6) -> DataFrame:
    """(node, depth, path, source_exchange_id, score) of every path of up to ``max_hops`` edges from the seeds.

    The first edge scores its confidence times ``decay``, each further one ``decay``. A path goes on only from a
    registered entity and never to a node (or label) that it holds. An edge between two seeds leads to its object.
    """
    own = triples.filter((F.col("agent_id") == agent) & (F.col("confidence") >= min_confidence))
    wanted = list(dict.fromkeys(seeds))
    s, o = F.col("subject").isin(*wanted), F.col("object").isin(*wanted)
    start = own.filter(s | o).select(
        F.when(s, F.col("object")).otherwise(F.col("subject")).alias("node"), F.lit(1).alias("depth"), F.array("subject", "predicate", "object").alias("path"),
        "source_exchange_id", (F.col("confidence") * decay).alias("score"),
    )
    known = entities.filter(F.col("agent_id") == agent).select(F.col("id").alias("node"))
    edges = walkable(own).select("here", "there", "predicate", F.col("source_exchange_id").alias("exchange"))
    out = front = start
    for depth in range(2, max_hops + 1):
        step = front.join(known, "node", "left_semi").join(edges, F.col("node") == F.col("here")).filter(~F.array_contains("path", F.col("there")))
        front = step.select(
            F.col("there").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("predicate", "there")).alias("path"),
            F.col("exchange").alias("source_exchange_id"), (F.col("score") * decay).alias("score"),
        )
        out = out.unionByName(front)
    return out


def multi_hop(triples: DataFrame, entities: DataFrame, seeds: Sequence[str], agent: str, max_hops: int = 2, decay: float = 0.7, min_confidence: float = 0.6, limit: int | None = 40) -> DataFrame:
    """(source_exchange_id, score, depth): exchanges by the sum of the scores of the paths that end in them."""
    paths = hop_paths(triples, entities, seeds, agent, max_hops, decay, min_confidence).filter("source_exchange_id IS NOT NULL")
    found = paths.groupBy("source_exchange_id").agg(F.sum("score").alias("score"), F.min("depth").alias("depth"))
    return found if limit is None else found.orderBy(F.desc(F.round("score", 9)), "source_exchange_id").limit(limit)


def single_hop(triples: DataFrame, pairs: DataFrame, names: Sequence[str], agent: str, limit: int = 20, boost: float = 0.1, min_shared: int = 1, per_side: int = 100, per_pair: int = 20, partners: int = 5) -> DataFrame:
    """(source_exchange_id, score, shared_count, shared, max_confidence, newest): link expansion over one edge.

    A seed's ``per_side`` newest triples on either side add their confidence. Its ``partners`` most frequent
    co-occurring entities add ``boost`` times the count of the pair for each of their ``per_pair`` newest triples, but share nothing,
    so exchanges met by co-occurrence alone are left out.
    """
    spark = triples.sparkSession
    seeds = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seed int")).withColumn("id", entity_id(F.col("name")))
    own = triples.filter(F.col("agent_id") == agent)
    value = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))

    def newest(side: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("seed").orderBy(*newest_first()))
        return own.join(seeds, F.col(side) == F.col("id")).withColumn("rank", rank).filter(F.col("rank") <= per_side)

    direct = newest("subject").unionByName(newest("object")).dropDuplicates(["seed", "subject", "predicate", "object"])
    direct = direct.filter("source_exchange_id IS NOT NULL").select("source_exchange_id", value.alias("part"), F.lower("name").alias("shared"), value.alias("confidence"), "source_date")
    ends = pairs.select(F.col("entity_a").alias("id"), F.col("entity_b").alias("other"), "count", "entity_a", "entity_b").unionByName(
        pairs.filter("entity_a <> entity_b").select(F.col("entity_b").alias("id"), F.col("entity_a").alias("other"), "count", "entity_a", "entity_b")
    )
    order = Window.partitionBy("seed").orderBy(F.desc("count"), "entity_a", "entity_b")
    beside = ends.join(seeds, "id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= partners).select("seed", "other", "count")
    touching = own.select("*", F.col("subject").alias("here")).unionByName(own.filter("subject <> object").select("*", F.col("object").alias("here")))
    near = Window.partitionBy("seed", "other").orderBy(*newest_first())
    boosted = touching.join(F.broadcast(beside), F.col("here") == F.col("other")).withColumn("rank", F.row_number().over(near)).filter((F.col("rank") <= per_pair) & F.col("source_exchange_id").isNotNull())
    boosted = boosted.select("source_exchange_id", (F.col("count") * boost).alias("part"), F.lit(None).cast("string").alias("shared"), F.lit(None).cast("double").alias("confidence"), "source_date")
    found = direct.unionByName(boosted).groupBy("source_exchange_id").agg(
        F.sum("part").alias("score"), F.array_sort(F.collect_set("shared")).alias("shared"), F.max("confidence").alias("max_confidence"), F.max("source_date").alias("newest")
    )
    found = found.withColumn("shared_count", F.size("shared")).filter(F.col("shared_count") >= min_shared)
    return found.orderBy(F.desc(F.round("score", 9)), "source_exchange_id").limit(limit)


def meta_path(triples: DataFrame, patterns: DataFrame, seeds: Sequence[str], agent: str, per_pattern: int = 20) -> DataFrame:
    """(source_exchange_id, score): exchanges of the last edge of paths that follow a pattern forward from a seed.

    All patterns of two and three predicates are walked at once; other lengths are skipped. A pattern keeps its
    ``per_pattern`` best paths, and an exchange its best score.
    """
    own = triples.filter(F.col("agent_id") == agent).select("subject", "predicate", "object", "confidence", "source_exchange_id")
    wanted = patterns.filter(F.size("predicates").isin(2, 3)).select("predicates", "weight").distinct()
    front = own.filter(F.col("subject").isin(*dict.fromkeys(seeds))).join(wanted, F.col("predicate") == F.col("predicates")[0])
    front = front.select("predicates", "weight", F.col("object").alias("at"), F.col("confidence").alias("c"), F.array("subject", "object").alias("nodes"), "source_exchange_id")
    done = None
    for step in (1, 2):
        edge = own.toDF("here", "label", "there", "more", "exchange")
        front = front.filter(F.size("predicates") > step).join(edge, (F.col("at") == F.col("here")) & (F.col("predicates")[step] == F.col("label")))
        front = front.select(
            "predicates", "weight", F.col("there").alias("at"), (F.col("c") * F.col("more")).alias("c"), F.concat("nodes", F.array("there")).alias("nodes"), F.col("exchange").alias("source_exchange_id")
        )
        ended = front.filter(F.size("predicates") == step + 1)
        done = ended if done is None else done.unionByName(ended)
    score = F.col("c") * F.col("weight")
    best = Window.partitionBy("predicates").orderBy(F.desc(F.round(score, 9)), F.array_join("nodes", "/"))
    kept = done.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_pattern).filter("source_exchange_id IS NOT NULL")
    return kept.groupBy("source_exchange_id").agg(F.max(score).alias("score"))


def fuse(hops: DataFrame, metas: DataFrame, seeds: Sequence[str], limit: int = 20) -> DataFrame:
    """(source_exchange_id, score, shared_count, shared): the better of both scores."""
    both = hops.select("source_exchange_id", F.col("score").alias("a")).join(metas.select("source_exchange_id", F.col("score").alias("b")), "source_exchange_id", "full_outer")
    best = F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))
    shared = F.array(*[F.lit(x) for x in seeds])
    out = both.select("source_exchange_id", best.alias("score"), F.lit(len(seeds)).alias("shared_count"), shared.alias("shared"))
    return out.orderBy(F.desc(F.round("score", 9)), "source_exchange_id").limit(limit)
