"""Discovery and validation of predicate patterns, all patterns in one join instead of one query each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import predicate_stats

KEY = ">"
PATHS = 200


def fanout(triples: DataFrame, agent: str, least: int = 5) -> DataFrame:
    """(predicate, cnt, fanout) of predicates with enough triples; nothing when fewer than two qualify."""
    stats = predicate_stats(triples, agent).filter(F.col("cnt") >= least)
    counted = stats.withColumn("there", F.count(F.lit(1)).over(Window.partitionBy()))  # one row a predicate
    return counted.filter("there >= 2").select("predicate", "cnt", (F.col("cnt") / F.greatest("subjects", F.lit(1))).alias("fanout"))


def candidates(fans: DataFrame, max_length: int = 3, triples_up_to: int = 6) -> DataFrame:
    """(predicates, fanouts): all ordered pairs, and all ordered triples when few predicates qualify.

    The table has one row a predicate of the vocabulary, so its combinations are built from one collected row.
    """
    row = fans.agg(F.array_sort(F.collect_list(F.struct("predicate", "fanout"))).alias("all"))
    first = row.select("all", F.explode("all").alias("x"))
    pairs = first.select("all", "x", F.explode("all").alias("y"))
    out = pairs.select(F.array("x.predicate", "y.predicate").alias("predicates"), F.array("x.fanout", "y.fanout").alias("fanouts"))
    if max_length >= 3:
        three = pairs.filter(F.size("all") <= triples_up_to).select("x", "y", F.explode("all").alias("z"))
        out = out.unionByName(three.select(F.array("x.predicate", "y.predicate", "z.predicate").alias("predicates"), F.array("x.fanout", "y.fanout", "z.fanout").alias("fanouts")))
    return out


def capped(found: DataFrame, max_fanout: float = 50, selective: float = 10) -> DataFrame:
    """Candidates with a selective step and a bounded product of fanouts."""
    product = F.aggregate("fanouts", F.lit(1.0), lambda a, x: a * x)
    return found.filter(F.exists("fanouts", lambda x: x < selective) & (product < F.pow(F.lit(float(max_fanout)), F.size("fanouts"))))


def weight(as_of: Column, half: float = 90.0) -> Column:
    """What the age of a triple leaves of it."""
    days = (as_of.cast("double") - F.col("updated_at").cast("double")) / 86400.0
    return 1.0 / (1.0 + days / half)


def first_sources(edges: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """(predicates, src): the first ``most`` nodes in order from which a whole path of each of ``patterns`` (two or three predicates) begins."""
    # The nodes from which the last 1, 2 and 3 steps of a pattern can be taken.
    able, out = None, None
    for left in (1, 2, 3):
        step = patterns.filter(F.size("predicates") >= left).select("predicates", F.element_at("predicates", -left).alias("label"))
        there = edges.join(F.broadcast(step), F.col("predicate") == F.col("label")).select("predicates", F.col("subject").alias("src"), F.col("object").alias("at"))
        if able is not None:
            there = there.join(able.withColumnRenamed("src", "at"), ["predicates", "at"], "left_semi")
        able = there.select("predicates", "src").distinct()
        if left > 1:
            ended = able.filter(F.size("predicates") == left)
            out = ended if out is None else out.unionByName(ended)
    rank = F.row_number().over(Window.partitionBy("predicates").orderBy("src"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def evaluate(triples: DataFrame, patterns: DataFrame, agent: str, as_of: str, min_yield: int = 3, paths: int = PATHS) -> DataFrame:
    """(pattern, yield, overlap, avg_confidence) of ``patterns`` (predicates) that yield enough.

    A path is a distinct (source, target, confidence); a pattern's first ``paths`` in that order count. Overlap is the share
    with a direct edge, whatever its predicate. ``pattern`` is the predicates joined by ``>``.

    Every source that begins a path has one at least, so the first ``paths`` sources of a pattern have all that can count. They are found backwards,
    as sets of nodes, and only their paths are listed; hubs in between do not multiply.
    """
    now = F.lit(as_of).cast("timestamp")
    own = triples.filter(F.col("agent_id") == agent).select("subject", "predicate", "object", "confidence", weight(now).alias("w"))
    wanted = F.broadcast(patterns.filter(F.size("predicates").isin(2, 3)).select("predicates").distinct())  # one row a combination of the vocabulary
    sources = first_sources(own, wanted, paths)
    front = own.join(wanted, F.col("predicate") == F.col("predicates")[0]).select(
        "predicates", F.col("subject").alias("src"), F.col("object").alias("at"), F.col("confidence").alias("c"), F.array("w").alias("ws")
    )
    front = front.join(sources, ["predicates", "src"], "left_semi")
    done = None
    for step in (1, 2):
        edge = own.toDF("here", "label", "there", "more", "w2")
        front = front.filter(F.size("predicates") > step).join(edge, (F.col("at") == F.col("here")) & (F.col("predicates")[step] == F.col("label")))
        front = front.select("predicates", "src", F.col("there").alias("at"), (F.col("c") * F.col("more")).alias("c"), F.concat("ws", F.array("w2")).alias("ws"))
        ended = front.filter(F.size("predicates") == step + 1)
        done = ended if done is None else done.unionByName(ended)
    path = done.select(F.array_join("predicates", KEY).alias("pattern"), "src", F.col("at").alias("dst"), F.aggregate("ws", F.col("c"), lambda a, x: a * x).alias("conf")).distinct()
    order = Window.partitionBy("pattern").orderBy("src", "dst", "conf")
    path = path.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= paths)
    direct = own.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct().withColumn("direct", F.lit(1))
    scored = path.join(direct, ["src", "dst"], "left").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("yield"), (F.count("direct") / F.count(F.lit(1))).alias("overlap"), F.avg("conf").alias("avg_confidence")
    )
    return scored.filter(F.col("yield") >= min_yield)


def pattern_table(spark, rows: Sequence[Sequence], agent: str, kind: str = "static") -> DataFrame:
    """A catalogue from (predicate, ..., weight) rows, all active."""
    return spark.createDataFrame(
        [(agent, [str(x) for x in r[:-1]], kind, float(r[-1]), 0.0, 1.0, None, True) for r in rows],
        "agent_id string, predicates array<string>, pattern_type string, weight double, yield_score double, overlap_ratio double, last_validated timestamp, active boolean",
    )


def seed_patterns(catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """``catalogue`` with those ``seeds`` whose predicates it lacks, active or not."""
    return catalogue.unionByName(seeds.join(catalogue.select("agent_id", "predicates"), ["agent_id", "predicates"], "left_anti"))


def save_patterns(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert of ``found`` (the catalogue's columns): a known pattern gets the new scores, is active again and keeps its type."""
    new = found.select("agent_id", "predicates", *[F.col(c).alias(f"new_{c}") for c in ("weight", "yield_score", "overlap_ratio", "last_validated")], F.lit(True).alias("hit"))
    joined = catalogue.withColumn("known", F.lit(True)).join(new, ["agent_id", "predicates"], "full_outer")
    pick = lambda c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        "agent_id", "predicates", F.coalesce("pattern_type", F.lit("discovered")).alias("pattern_type"), pick("weight"), pick("yield_score"), pick("overlap_ratio"),
        pick("last_validated"), (F.coalesce("hit", F.lit(False)) | F.coalesce("active", F.lit(False))).alias("active"),
    )


def discover(triples: DataFrame, catalogue: DataFrame, agent: str, as_of: str, max_active: int = 12, min_yield: int = 3, max_overlap: float = 0.9, max_fanout: float = 50, max_length: int = 3) -> DataFrame:
    """The patterns worth saving: (predicates, weight, yield, overlap, score), best first, as many as there are slots."""
    own = catalogue.filter((F.col("agent_id") == agent) & F.col("active"))
    found = capped(candidates(fanout(triples, agent), max_length), max_fanout).join(own.select("predicates"), "predicates", "left_anti")
    scored = evaluate(triples, found, agent, as_of, min_yield).filter(F.col("overlap") <= max_overlap)
    scored = scored.withColumn("score", F.col("yield") * (1 - F.col("overlap")) * F.col("avg_confidence"))
    slots = own.agg(F.greatest(F.lit(max_active) - F.count(F.lit(1)), F.lit(0)).alias("slots"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "pattern"))).withColumn("__k", F.lit(1))  # one row a pattern
    kept = ranked.join(slots.withColumn("__k", F.lit(1)), "__k").filter("rank <= slots")
    return kept.select(F.split("pattern", KEY).alias("predicates"), F.least("score", F.lit(1.0)).alias("weight"), "yield", "overlap", "score", "rank")


def validate(triples: DataFrame, catalogue: DataFrame, agent: str, as_of: str, min_yield: int = 3, max_overlap: float = 0.9) -> DataFrame:
    """``catalogue`` with its active discovered patterns scored anew, and retired where they yield too little or only
    what is there directly."""
    scores = evaluate(triples, catalogue.filter(F.col("active") & (F.col("pattern_type") != "static")), agent, as_of, min_yield)
    joined = catalogue.withColumn("pattern", F.array_join("predicates", KEY)).join(scores.withColumnRenamed("yield", "y"), "pattern", "left")
    due = F.col("active") & (F.col("pattern_type") != "static") & (F.col("agent_id") == agent)
    good = F.col("y").isNotNull() & (F.col("overlap") <= max_overlap)
    score = F.col("y") * (1 - F.col("overlap")) * F.col("avg_confidence")
    keep = due & good
    return joined.select(
        "agent_id", "predicates", "pattern_type", F.when(keep, F.least(score, F.lit(1.0))).otherwise(F.col("weight")).alias("weight"),
        F.when(keep, F.col("y").cast("double")).otherwise(F.col("yield_score")).alias("yield_score"), F.when(keep, F.col("overlap")).otherwise(F.col("overlap_ratio")).alias("overlap_ratio"),
        F.when(due, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_validated")).alias("last_validated"), (F.col("active") & (~due | good)).alias("active"),
    )
