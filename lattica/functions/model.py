"""Extraction by an external model: calls, parsing of answers, dead letters, and enrichment of the graph."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MODEL_PREDICATES
from ..session import let_workers_import

TYPES = frozenset("CONCEPT DATE EVENT ORGANIZATION PERSON PLACE THING".split())
SYNONYMS = {"activity": "EVENT", "ai assistant": "PERSON", "body part": "THING", "condition": "CONCEPT", "location": "PLACE", "object": "THING", "person": "PERSON", "supplement": "THING"}
_ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
_RELATION = T.StructType([*[T.StructField(n, T.StringType()) for n in ("subject", "predicate", "object")], T.StructField("confidence", T.DoubleType())])
ANSWER = T.StructType([T.StructField("entities", T.ArrayType(_ENTITY)), T.StructField("relationships", T.ArrayType(_RELATION))])
#: Letters of each side that a model is shown.
SHOWN = 3000
PREVIEW = 100


def _first(item: dict, *names: str):
    return next((item[n] for n in names if item.get(n)), None)


def _load(raw: str):
    fence = re.search(r"`{3}(?:json)?(.*?)`{3}", raw, re.DOTALL)
    body = fence[1] if fence else raw
    start, end = body.find("{"), body.rfind("}")
    if start < 0 or end < start:
        return None
    body = body[start : end + 1]
    for attempt in (body, re.sub(r",(\s*[\]}])", r"\1", body).replace("'", '"')):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def parse_answer(raw: str | None) -> dict:
    """The entities and relationships of an answer; what is malformed is left out."""
    out: dict = {"entities": [], "relationships": []}
    data = _load(raw) if raw and len(raw) >= 10 else None
    if data is None:
        return out
    for e in data.get("entities") or []:
        name = _first(e, "name", "id", "canonical_name") if isinstance(e, dict) else None
        if not isinstance(name, str) or len(name.strip()) < 2:
            continue
        kind = str(e.get("type") or "CONCEPT")
        kind = kind.upper() if kind.upper() in TYPES else SYNONYMS.get(kind.lower(), "CONCEPT")
        aliases = e.get("aliases") if isinstance(e.get("aliases"), list) else []
        out["entities"].append({"name": name.strip(), "type": kind, "aliases": [a for a in aliases if isinstance(a, str) and a.strip()]})
    for r in data.get("relationships") or []:
        if not isinstance(r, dict):
            continue
        ends = _first(r, "subject", "source", "from"), _first(r, "object", "target", "to")
        if not all(ends) or not r.get("predicate"):
            continue
        s, o = (str(x).strip() for x in ends)
        if min(len(s), len(o)) < 2 or s.lower() == o.lower():
            continue
        sure = r.get("confidence")
        sure = min(1.0, max(0.0, float(sure))) if isinstance(sure, (int, float)) and not isinstance(sure, bool) else 0.8
        out["relationships"].append({"subject": s, "predicate": r["predicate"] if r["predicate"] in MODEL_PREDICATES else "has_property", "object": o, "confidence": sure})
    return out


@F.arrow_udf(ANSWER)
def parsed(raw: pa.Array) -> pa.Array:
    entity = pa.struct([("name", pa.string()), ("type", pa.string()), ("aliases", pa.list_(pa.string()))])
    relation = pa.struct([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("confidence", pa.float64())])
    return pa.array([parse_answer(x) for x in raw.to_pylist()], type=pa.struct([("entities", pa.list_(entity)), ("relationships", pa.list_(relation))]))


def prompt(user: str | None, agent: str | None) -> str:
    return (
        "List what this exchange says about people, places, organisations, things, ideas and events, as JSON with the keys entities (name, type, aliases) and"
        f" relationships (subject, predicate, object, confidence). Known predicates: {', '.join(MODEL_PREDICATES)}.\n\nUser: {(user or '')[:SHOWN]}\nAgent: {(agent or '')[:SHOWN]}\n"
    )


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` tried again after time-outs and lost connections only, waiting twice as long each time."""

    def run(text: str) -> str:
        for n in range(attempts):
            try:
                return call(text)
            except (TimeoutError, ConnectionError) as e:
                e.retries = n
                if n == attempts - 1:
                    raise
                sleep(wait * 2**n)
        raise ValueError("attempts must be positive")

    return run


def answers(exchanges: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(exchange_id, raw, error, retries) of exchanges (exchange_id, user_text, agent_text): one call each, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, user, agent in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((key, call(prompt(user, agent)), None, 0))
                except Exception as e:  # noqa: BLE001 - what failed goes to the dead letters with its reason
                    rows.append((key, None, f"{type(e).__name__}: {e}", getattr(e, "retries", 0)))
            types = (*[pa.string()] * 3, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["exchange_id", "raw", "error", "retries"])

    let_workers_import(exchanges.sparkSession)
    return exchanges.select(F.col("exchange_id").cast("string"), "user_text", "agent_text").mapInArrow(run, "exchange_id string, raw string, error string, retries int")


def dead_letters(exchanges: DataFrame, answered: DataFrame, as_of: str) -> DataFrame:
    """(exchange_id, date, failed_at, error, retries, preview) of the calls that failed."""
    failed = answered.filter("error IS NOT NULL").select("exchange_id", "error", "retries")
    return exchanges.join(failed, "exchange_id").select("exchange_id", "date", F.lit(as_of).cast("timestamp").alias("failed_at"), "error", "retries", F.substring("user_text", 1, PREVIEW).alias("preview"))


def without(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("exchange_id"), "exchange_id", "left_anti")


def queued(queue: DataFrame, per_run: int = 3, most: int = 50) -> DataFrame:
    """The exchanges of the next run: the oldest of the first ``most`` that were queued."""
    return queue.orderBy("queued_at", "exchange_id").limit(most).orderBy("queued_at", "exchange_id").limit(per_run)


def enrichment(relationships: DataFrame, tiers: DataFrame, threshold: float = 0.7, thresholds: Mapping[str, float] | None = None, boost: float = 0.1) -> DataFrame:
    """``relationships`` worth writing: confidence raised by ``boost``, at least the threshold, pending where an end is to be
    resolved later. ``tiers`` is (mention, tier), or (exchange_id, mention, tier) where relationships have an ``exchange_id``."""
    sure = F.least(F.col("confidence") + boost, F.lit(1.0))
    floor = F.lit(float(threshold))
    for p, v in sorted((thresholds or {}).items()):
        floor = F.when(F.col("predicate") == p, float(v)).otherwise(floor)
    keys = [c for c in ("exchange_id",) if c in tiers.columns]
    later = tiers.filter("tier = 'defer'").select(*keys, "mention").distinct().withColumn("later", F.lit(True))
    s, o = later.toDF(*keys, "subject", "s_later"), later.toDF(*keys, "object", "o_later")
    kept = relationships.withColumn("confidence", sure).filter(F.round("confidence", 9) >= floor)
    out = kept.join(s, [*keys, "subject"], "left").join(o, [*keys, "object"], "left").withColumn("pending", F.coalesce("s_later", "o_later", F.lit(False)))
    return out.drop("s_later", "o_later").select(*relationships.columns, "pending")


def with_aliases(entities: DataFrame, found: DataFrame) -> DataFrame:
    """``entities`` with the aliases of ``found`` (id, aliases; and agent_id, where it has that) added."""
    keys = [c for c in ("agent_id",) if c in found.columns]
    new = found.select(*keys, "id", F.explode("aliases").alias("a")).groupBy(*keys, "id").agg(F.array_sort(F.collect_set("a")).alias("more"))
    return entities.join(new, [*keys, "id"], "left").withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).drop("more").select(*entities.columns)
