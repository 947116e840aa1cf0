"""Identity of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for names that people write; Java's ``\s`` is ASCII only.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def entity_id(name: Column) -> Column:
    """Lower case, trimmed, runs of white space as one underscore; nothing left (or null): ``unknown``."""
    bare = F.regexp_replace(stripped(F.lower(name)), rf"{SPACE}+", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(bare)
