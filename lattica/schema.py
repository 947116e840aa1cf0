"""Relations of the knowledge graph. ``seq`` is the order of arrival, which decides what overwrites what."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def relation(fields: str) -> T.StructType:
    """A schema from ``name type`` pairs; it needs no session, as parsing by Spark would."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


TRIPLE_LOG = relation(
    "agent_id string, seq long, ts timestamp, subject string, predicate string, object string, confidence double, source_exchange_id string, source_date date, pending boolean"
)
MENTION_LOG = relation("agent_id string, seq long, ts timestamp, name string, entity_type string, exchange_id string")
TRIPLES = relation(
    "agent_id string, subject string, predicate string, object string, confidence double, source_exchange_id string,"
    " source_date date, created_at timestamp, updated_at timestamp, first_seq long, last_seq long, pending boolean"
)
ENTITIES = relation("agent_id string, id string, canonical_name string, entity_type string, first_seen timestamp, last_seen timestamp, mention_count long, aliases strings")
COOCCURRENCES = relation("agent_id string, entity_a string, entity_b string, count long, last_seen timestamp")
PATTERNS = relation("agent_id string, predicates strings, pattern_type string, weight double, yield_score double, overlap_ratio double, last_validated timestamp, active boolean")
EXCHANGES = relation("exchange_id string, agent_id string, ts timestamp, user_text string, agent_text string")
