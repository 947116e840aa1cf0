"""One object for everything an application asks of a graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import config as settings
from .functions import extract, model
from .functions.ids import entity_id
from .operators import context, fold, lookup, maintenance, mining, resolve, traverse
from .session import let_workers_import
from .sources import archive
from .sources.store import GraphStore, State
from .streaming import ingest


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


class GraphEngine:
    """Queries and upkeep over the snapshots of ``store``. Methods that change something write a new version.

    ``as_of`` stands for the present wherever age matters; without it, it is the time of the call.
    """

    def __init__(self, spark: SparkSession, root: str, *layers: Mapping[str, Any]) -> None:
        self.spark, self.store, self.config = let_workers_import(spark), GraphStore(spark, root), settings.load(*layers)

    def agent(self, name: str | None) -> str:
        name = name or "main"
        return self.config["agent_aliases"].get(name, name)

    # -- reading --
    def get_state(self, agent: str | None = None) -> DataFrame:
        s = self.store
        return lookup.graph_stats(s.read("triples"), s.read("entities"), s.read("cooccurrences"), self.agent(agent))

    def query_ids(self, text: str, agent: str | None = None) -> list[str]:
        """The entities a text names: a short list, at the driver."""
        one = self.spark.createDataFrame([("q", text)], "exchange_id string, text string")
        known = lookup.recent_entities(self.store.read("entities"), self.agent(agent), 200).select("canonical_name", "entity_type")
        found = extract.entities(one, known, most=self.config["extraction"]["max_entities"])
        rows = found.select("pos", entity_id(F.col("name")).alias("id")).orderBy("pos").collect()
        return list(dict.fromkeys(r["id"] for r in rows))

    def search(self, text: str, agent: str | None = None, limit: int | None = None) -> DataFrame:
        """(source_exchange_id, score, ...), best first; no rows where the text names nothing."""
        r, own = self.config["retrieval"], self.agent(agent)
        ids = self.query_ids(text, agent)
        limit = limit or r["max_results"]
        triples = self.store.read("triples")
        if not ids:
            return traverse.fuse(*[triples.limit(0).select("source_exchange_id", F.lit(0.0).alias("score"))] * 2, [], limit)
        if r["max_hops"] <= 1:
            return traverse.single_hop(triples, self.store.read("cooccurrences"), ids, own, limit, r["cooccurrence_boost"], r["min_shared"])
        hops = traverse.multi_hop(triples, self.store.read("entities"), ids, own, r["max_hops"], r["hop_decay"], r["min_confidence"], 2 * r["max_results"])
        return traverse.fuse(hops, traverse.meta_path(triples, self.active_patterns(agent), ids, own), ids, limit)

    def context(self, text: str, agent: str | None = None) -> DataFrame:
        c = self.config["context"]
        edges = context.context_edges(self.store.read("triples"), self.store.read("entities"), self.query_ids(text, agent), self.agent(agent), c["min_confidence"], c["min_mentions"], c["exclude"])
        return context.sentences(edges, c["max_lines"])

    def get_entity(self, name: str, agent: str | None = None) -> DataFrame:
        s = self.store
        return context.entity_context(s.read("triples"), s.read("entities"), s.read("cooccurrences"), name, self.agent(agent))

    def get_triples(self, subject: str | None = None, predicate: str | None = None, object_: str | None = None, agent: str | None = None, limit: int = 50) -> DataFrame:
        return lookup.query_triples(self.store.read("triples"), subject, predicate, object_, self.agent(agent), limit)

    def list_agents(self) -> DataFrame:
        t, e = self.store.read("triples").groupBy("agent_id").agg(F.count(F.lit(1)).alias("triples")), self.store.read("entities").groupBy("agent_id").agg(F.count(F.lit(1)).alias("entities"))
        return t.join(e, "agent_id", "full_outer").na.fill(0)

    def detect_gaps(self, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        return maintenance.knowledge_gaps(self.store.read("triples"), self.store.read("entities"), self.agent(agent), as_of or _now(), known=self.config["gaps"]["known_names"])

    def resolve_entities(self, mentions: Sequence[str], around: Sequence[str] = (), agent: str | None = None, as_of: str | None = None) -> DataFrame:
        r, own = self.config["resolution"], self.agent(agent)
        m = self.spark.createDataFrame(list(enumerate(mentions)), "mention_id int, mention string")
        c = self.spark.createDataFrame([(i, x) for i in range(len(mentions)) for x in around], "mention_id int, context string")
        entities = self.store.read("entities")
        scored = resolve.scores(resolve.candidates(m, entities, own), c, self.store.read("cooccurrences"), as_of or _now(), r["recency_days"], r["cooccurrence_min"])
        return resolve.tiers(m, scored, entities.filter(F.col("agent_id") == own), r["assume"], r["ask"], r["recency_days"])

    def resolve_entity(self, mention: str, around: Sequence[str] = (), agent: str | None = None, as_of: str | None = None) -> DataFrame:
        return self.resolve_entities([mention], around, agent, as_of)

    # -- patterns --
    def active_patterns(self, agent: str | None = None) -> DataFrame:
        return lookup.active_patterns(self.get_patterns(agent), self.agent(agent))

    def get_patterns(self, agent: str | None = None) -> DataFrame:
        seeds = mining.pattern_table(self.spark, self.config["patterns"]["static"], self.agent(agent))
        return mining.seed_patterns(self.store.read("patterns"), seeds)

    def discover_patterns(self, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        p, own, now = self.config["patterns"], self.agent(agent), as_of or _now()
        known = self.get_patterns(agent)
        found = mining.discover(self.store.read("triples"), known, own, now, p["max_active"], p["min_yield"], p["max_overlap"], p["max_fanout"], p["max_length"])
        rows = found.select(F.lit(own).alias("agent_id"), "predicates", "weight", F.col("yield").cast("double").alias("yield_score"), F.col("overlap").alias("overlap_ratio"), F.lit(now).cast("timestamp").alias("last_validated"))
        self.store.write("patterns", mining.save_patterns(known, rows))
        return self.get_patterns(agent).filter((F.col("pattern_type") == "discovered") & F.col("active"))

    def validate_patterns(self, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        p = self.config["patterns"]
        self.store.write("patterns", mining.validate(self.store.read("triples"), self.get_patterns(agent), self.agent(agent), as_of or _now(), p["min_yield"], p["max_overlap"]))
        return self.store.read("patterns")

    # -- upkeep --
    def merge_entities(self, keep: str, merge: str, agent: str | None = None, as_of: str | None = None) -> None:
        triples, entities = maintenance.merge_entities(self.store.read("triples"), self.store.read("entities"), keep, merge, self.agent(agent), as_of or _now())
        self.store.commit({"triples": triples, "entities": entities})

    def decay(self, agent: str | None = None, as_of: str | None = None) -> int:
        out = maintenance.decay(self.store.read("triples"), self.agent(agent), as_of or _now(), self.config["storage"]["half_life_days"])
        changed = out.filter("decayed").count()
        self.store.write("triples", out.drop("decayed"))
        return changed

    def cleanup_expired_triples(self, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        ttl, own, now = self.config["extraction"]["predicate_ttl_days"], self.agent(agent), as_of or _now()
        before = self.store.read("triples")
        self.store.write("triples", maintenance.expire(before, own, ttl, now))
        return maintenance.expired_counts(before, own, ttl, now)

    def process_pending(self, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        r, own = self.config["resolution"], self.agent(agent)
        triples = self.store.read("triples")
        outcomes = maintenance.pending_outcomes(triples, self.store.read("entities"), own, as_of or _now(), r["recency_days"], r["pending_max_age_days"])
        self.store.write("triples", maintenance.clear_pending(triples, outcomes, own))
        return outcomes

    # -- exchanges --
    def ingest(self, exchanges: DataFrame, batch: int) -> None:
        """Take in exchanges (exchange_id, agent_id, ts, user_text, agent_text) as they come; names become those of the registry that they stand for."""
        ingest.ingest_batch(self.store, exchanges, batch, self.config["extraction"], self.config["resolution"])

    def follow(self, source: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
        """``ingest`` for every file of a folder of JSON lines."""
        return ingest.start(self.spark, source, self.store, checkpoint, self.config["extraction"], trigger, self.config["resolution"])

    # -- archives --
    def backfill_status(self, folder: str, processed: DataFrame) -> DataFrame:
        messages, _ = archive.read_archives(self.spark, folder)
        return archive.unprocessed(messages, processed)

    def backfill(self, folder: str, processed: DataFrame, batch: int = 1, days: int = 10, agent: str | None = None) -> DataFrame:
        """Read the next ``days`` archives of an agent into the logs; the dates read. Names known at the start stand for the whole batch."""
        messages, _ = archive.read_archives(self.spark, folder)
        dates = archive.unprocessed(messages, processed).limit(days)
        chosen = messages.join(dates, "date", "left_semi")
        rows = archive.eligible(archive.pair_exchanges(chosen), self.config["extraction"]["min_exchange_length"])
        exchanges = rows.select("exchange_id", F.lit(self.agent(agent)).alias("agent_id"), archive.moment_of(F.col("date"), F.col("exchange_no")).alias("ts"), "user_text", "agent_text")
        ingest.ingest_batch(self.store, exchanges, batch, self.config["extraction"])
        return dates

    def enrichment_queue(self, folder: str, processed: DataFrame, limit: int = 10) -> DataFrame:
        """(exchange_id, date, user_text, agent_text, queued_at): the first exchanges of the dates read that are long enough to be shown to a model."""
        messages, _ = archive.read_archives(self.spark, folder)
        rows = archive.eligible(archive.pair_exchanges(messages.join(processed.select("date"), "date", "left_semi")), self.config["extraction"]["min_exchange_length"])
        first = rows.orderBy("date", "exchange_no").limit(limit)
        text = lambda c: F.coalesce(c, F.lit("")).alias(c)
        return first.select("exchange_id", "date", text("user_text"), text("agent_text"), F.col("exchange_no").alias("queued_at"))

    def reset(self, agent: str | None = None) -> dict[str, int]:
        """Forget what one agent has, but for the patterns: how many triples and entities that were. Other agents keep theirs."""
        own = F.col("agent_id") == self.agent(agent)
        tables = {name: self.store.read(name) for name in ("triples", "entities", "cooccurrences")}
        gone = {name: tables[name].filter(own).count() for name in ("triples", "entities")}
        self.store.commit({name: df.filter(~own) for name, df in tables.items()})
        return gone

    def rebuild(self, folder: str, call: Callable[[str], str] | None = None, per_day: int = 50, agent: str | None = None) -> DataFrame:
        """Forget what an agent has and replay all its archives, with a model where ``call`` is given; the dates read."""
        self.reset(agent)
        messages, _ = archive.read_archives(self.spark, folder)
        dates = messages.select("date").distinct()
        batch = self.store.state().spare()
        if call is None:
            return self.backfill(folder, dates.limit(0), batch, 1 << 20, agent)
        rows = archive.for_rebuild(archive.pair_exchanges(messages), per_day)
        rows = rows.withColumn("ts", archive.moment_of(F.col("date"), F.col("exchange_no")))
        self._write_answers(rows, model.answers(rows, call), batch, agent)
        return dates

    def _write_answers(self, exchanges: DataFrame, answered: DataFrame, batch: int, agent: str | None = None, enrich: bool = False) -> None:
        """Write what a model answered. ``enrich``: with raised confidence, from the threshold on, pending where an end is to be resolved later."""
        base = self.store.base_for(batch)
        if base is None:
            return
        own = F.lit(self.agent(agent)).alias("agent_id")
        numbered = fold.sequence(exchanges.select("exchange_id", "ts"), 0, "ts", "exchange_id").withColumn("first", F.lit(base.seq) + F.col("seq") * 1_000_000)
        parsed = answered.filter("error IS NULL").withColumn("p", model.parsed(F.col("raw"))).join(numbered, "exchange_id")
        e = parsed.select("exchange_id", "ts", "first", F.posexplode("p.entities").alias("pos", "x"))
        mentions = e.select(own, (F.col("first") + F.col("pos")).alias("seq"), "ts", F.col("x.name").alias("name"), F.col("x.type").alias("entity_type"), "exchange_id")
        aliases = e.filter(F.size("x.aliases") > 0).select(own, entity_id(F.col("x.name")).alias("id"), F.col("x.aliases").alias("aliases"))
        r = parsed.select("exchange_id", "ts", "first", F.posexplode("p.relationships").alias("pos", "x")).select("exchange_id", "ts", "first", "pos", "x.subject", "x.predicate", "x.object", "x.confidence")
        if enrich:
            c, x = self.config["enrichment"], self.config["extraction"]
            r = model.enrichment(r, self._tiers(r, mentions, base), x.get("confidence_threshold", c["threshold"]), x["predicate_thresholds"], c["boost"])
        else:
            r = r.withColumn("pending", F.lit(False))
        triples = r.select(own, (F.col("first") + 500_000 + F.col("pos")).alias("seq"), "ts", "subject", "predicate", "object", "confidence", F.col("exchange_id").alias("source_exchange_id"), F.to_date("ts").alias("source_date"), "pending")
        ingest.write_statements(self.store, batch, base, mentions, triples, aliases)

    def _tiers(self, relationships: DataFrame, mentions: DataFrame, base: State) -> DataFrame:
        """(exchange_id, mention, tier) of both ends of relationships; the entities of the exchange are the context."""
        own = mentions.select("agent_id").limit(1)
        ends = relationships.select("exchange_id", F.col("subject").alias("mention")).union(relationships.select("exchange_id", F.col("object"))).distinct()
        key = F.concat_ws("\u0001", "exchange_id", "mention")
        named = ends.crossJoin(F.broadcast(own)).select("agent_id", "exchange_id", key.alias("mention_id"), "mention")  # one row on the right
        around = named.join(mentions.select("exchange_id", F.col("name").alias("context")).distinct(), "exchange_id").select("mention_id", "context")
        entities, pairs = self.store.read("entities", state=base), self.store.read("cooccurrences", state=base)
        latest = mentions.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).first()[0] or _now()
        told = resolve.resolved_tiers(named.drop("exchange_id"), around, entities, pairs, latest, self.config["resolution"])
        return named.select("mention_id", "exchange_id", "mention").join(told.select("mention_id", "tier"), "mention_id").select("exchange_id", "mention", "tier")

    def enrich(self, queue: DataFrame, call: Callable[[str], str], batch: int, as_of: str | None = None, agent: str | None = None) -> DataFrame:
        """Show the next queued exchanges (exchange_id, date, user_text, agent_text, queued_at) to a model; the dead letters."""
        chosen = model.queued(queue, self.config["enrichment"]["per_run"], self.config["enrichment"]["queue"]).withColumn("ts", F.to_timestamp("date"))
        answered = model.answers(chosen, model.with_retries(call)).cache()
        self._write_answers(chosen, answered, batch, agent, enrich=True)
        return model.dead_letters(chosen, answered, as_of or _now())

    def retry_failed(self, letters: DataFrame, call: Callable[[str], str], batch: int, limit: int = 10, agent: str | None = None) -> DataFrame:
        """Try dead letters again from their previews; those that are left."""
        again = letters.orderBy("failed_at", "exchange_id").limit(limit).select("exchange_id", F.to_timestamp("date").alias("ts"), F.col("preview").alias("user_text"), F.lit("").alias("agent_text"))
        answered = model.answers(again, model.with_retries(call)).cache()
        self._write_answers(again, answered, batch, agent)
        return model.without(letters, answered.filter("error IS NULL"))

    def nightly(
        self, folder: str, processed: DataFrame, batch: int, agent: str | None = None, as_of: str | None = None, days: int = 5, queue: DataFrame | None = None, call: Callable[[str], str] | None = None,
        discovered_at: str | None = None,
    ) -> dict[str, DataFrame | bool]:
        """Backfill, enrichment (batch + 1, where there is a queue and a model), pending entities and gaps; then, where the last time ``discovered_at`` is longer ago than the setting
        (or unknown), decay, discovery and validation. ``more``: exchanges or dates are left, so it should run again."""
        now = as_of or _now()
        out: dict = {"dates": self.backfill(folder, processed, batch, days, agent)}
        more = not self.backfill_status(folder, processed.select("date").union(out["dates"].select("date"))).isEmpty()
        if queue is not None and call is not None:
            out["letters"] = self.enrich(queue, call, batch + 1, as_of, agent)
            more = more or queue.limit(self.config["enrichment"]["per_run"] + 1).count() > self.config["enrichment"]["per_run"]
        out |= {"pending": self.process_pending(agent, as_of), "gaps": self.detect_gaps(agent, as_of), "more": more}
        hours = None if discovered_at is None else (datetime.fromisoformat(now) - datetime.fromisoformat(discovered_at)).total_seconds() / 3600
        if hours is None or hours > self.config["patterns"]["every_hours"]:
            self.decay(agent, as_of)
            out["patterns"] = self.discover_patterns(agent, as_of)
            self.validate_patterns(agent, as_of)
            out["discovered_at"] = now
        return out
