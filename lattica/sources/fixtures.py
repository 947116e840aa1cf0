"""A knowledge graph derived from the ``events`` table, for queries, benchmarks and tests.

Every event is one statement about its user; a static part says which items and projects belong where. Arrival order
is the event id. As in a store, logs are folded once a session and queries read the written snapshots. All names are written with a space (``User 8``), so ids come from normalisation (``user_8``).
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold
from ..session import shared_dir

AGENT = "main"
KINDS = {"User": "PERSON", "Item": "THING", "Project": "CONCEPT", "Category": "CONCEPT", "Topic": "CONCEPT"}


def triple_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    u = F.col("user_id")
    kind = F.col("event_type")
    even = k % 2 == 0
    name = lambda what, n: F.concat(F.lit(what + " "), n.cast("string"))
    predicate = (
        F.when(kind == "click", "uses").when(kind == "view", "interested_in").when(kind == "purchase", "knows").when(kind == "signup", "works_on")
        .when(even, "created").otherwise("related_to")
    )
    obj = (
        F.when(kind.isin("click", "view"), name("Item", k)).when(kind == "purchase", name("User", u - u % 10 + k % 20)).when(kind == "signup", name("Project", k % 25))
        .when(even, name("Item", k)).otherwise(name("Topic", k % 30))
    )
    day = F.to_date("ts")
    said = e.select(
        F.lit(AGENT).alias("agent_id"), F.col("event_id").alias("seq"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("ts"), name("User", u).alias("subject"), predicate.alias("predicate"),
        obj.alias("object"), ((40 + F.floor(F.least("value", F.lit(60.0)))) / 100.0).alias("confidence"),
        F.concat(F.lit("exchange_"), day.cast("string"), F.lit("_"), u.cast("string")).alias("source_exchange_id"), day.alias("source_date"), F.lit(False).alias("pending"),
    )

    def fixed(n, first, subject, predicate, obj, confidence):
        i = F.col("id")
        return spark.range(n).select(
            F.lit(AGENT).alias("agent_id"), (i + first).alias("seq"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), name(subject, i).alias("subject"),
            F.lit(predicate).alias("predicate"), obj(i).alias("object"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("source_exchange_id"),
            F.lit(None).cast("date").alias("source_date"), F.lit(False).alias("pending"),
        )

    items = fixed(100, -1000, "Item", "part_of", lambda i: name("Category", i % 10), 0.9)
    projects = fixed(25, -500, "Project", "part_of", lambda i: name("Category", i % 10), 0.8)
    tools = fixed(25, -400, "Project", "uses", lambda i: name("Item", 3 * i), 0.7)
    return said.unionByName(items).unionByName(projects).unionByName(tools)


def mention_log(log: DataFrame) -> DataFrame:
    """The subject of every statement, and its object unless that is a user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.substring_index("name", " ", 1))
    one = lambda c: log.select("agent_id", "seq", "ts", F.col(c).alias("name"), F.col("source_exchange_id").alias("exchange_id"))
    both = one("subject").unionByName(one("object").filter(~F.col("name").startswith("User ")))
    return both.select("agent_id", "seq", "ts", "name", kind.alias("entity_type"), "exchange_id")


#: Paths of the snapshots written in this process, by application, source and name.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _clear(spark: SparkSession) -> None:
    """Delete the snapshots at the end; a session that ended before has no file system to ask, and own folders go by themselves."""
    if spark.sparkContext._jsc is None:
        return
    for path in _WRITTEN.values():
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Graph:
    """Logs, their folds as plans, and the snapshots that queries read."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def log(self) -> DataFrame:
        return triple_log(self.spark, self.sf_dir)

    @cached_property
    def mentions(self) -> DataFrame:
        return mention_log(self.log)

    def folded(self, name: str) -> DataFrame:
        if name == "triples":
            return fold.fold_triples(self.log)
        if name == "entities":
            return fold.fold_entities(self.mentions)
        return fold.fold_cooccurrences(fold.pairs_of(self.mentions.filter("exchange_id IS NOT NULL")))

    def _snapshot(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = f"{shared_dir(self.spark)}/graph-{uuid.uuid4().hex}/{name}"
            self.folded(name).write.parquet(path)
            if not _WRITTEN:
                atexit.register(_clear, self.spark)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    @cached_property
    def triples(self) -> DataFrame:
        return self._snapshot("triples")

    @cached_property
    def entities(self) -> DataFrame:
        return self._snapshot("entities")

    @cached_property
    def cooccurrences(self) -> DataFrame:
        return self._snapshot("cooccurrences")
