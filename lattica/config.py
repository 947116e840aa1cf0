"""Settings in layers: later layers win, objects merge key by key, lists and scalars are replaced."""

from __future__ import annotations

import copy
from typing import Any

#: Predicates of which a subject keeps many objects; any other predicate keeps the last one.
MULTI_VALUED = frozenset(["knows", "member_of", "part_of", "works_on"])

_CANONICAL = "causes created has_property interested_in knows located_in occurred_at part_of prefers related_to uses works_on"
_MODEL_ONLY = (
    "avoids buys controls delegates_to dislikes does drinks eats enjoys exercises fears feels hates invested_in likes"
    " lives_with loves meets member_of organizes owns plans sleeps suffers_from takes travels_to trusts visits wants wears weighs"
)
CANONICAL_PREDICATES = tuple(_CANONICAL.split())
MODEL_PREDICATES = tuple(sorted({*_CANONICAL.split(), *_MODEL_ONLY.split()} - {"related_to"}))

STATIC_PATTERNS = (
    (("created", "part_of"), 0.9), (("knows", "works_on"), 0.85), (("interested_in",) * 2, 0.8), (("works_on", "part_of"), 0.75), (("uses", "created"), 0.7),
)


def defaults() -> dict[str, Any]:
    extraction = {"min_exchange_length": 20, "max_entities": 15, "confidence_threshold": 0.5, "predicate_thresholds": {}}
    extraction |= {"canonical_predicates": list(CANONICAL_PREDICATES), "predicate_ttl_days": {"feels": 30, "eats": 14, "weighs": 7}, "recogniser": None}
    return {
        "agent_aliases": {},
        "extraction": extraction,
        "retrieval": {"max_hops": 2, "max_results": 20, "min_shared": 1, "cooccurrence_boost": 0.1, "hop_decay": 0.7, "min_confidence": 0.6},
        "patterns": {"max_active": 12, "min_yield": 3, "max_overlap": 0.9, "max_fanout": 50, "max_length": 3, "every_hours": 24, "static": [list(p) + [w] for p, w in STATIC_PATTERNS]},
        "context": {"max_lines": 5, "min_confidence": 0.6, "min_mentions": 2, "exclude": ["related_to"]},
        "storage": {"half_life_days": 90},
        "resolution": {"method": "conversational", "assume": 0.8, "ask": 0.4, "pending_max_age_days": 30, "recency_days": 7, "cooccurrence_min": 2, "seeds": []},
        "gaps": {"known_names": ["api", "false", "llm", "null", "response", "true", "undefined"]},
        "enrichment": {"queue": 50, "per_run": 3, "threshold": 0.7, "boost": 0.1},
    }


def merge(*layers: dict[str, Any] | None) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merge(out[key], value)
            else:
                out[key] = copy.deepcopy(value)
    return out


def load(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """The defaults under ``layers``, first to last."""
    return merge(defaults(), *layers)
