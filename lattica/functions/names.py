"""Names of people, places and organisations by rules: what stands beside a name tells what it is.

A name is a run of up to four capitalised words. After a title it is a person; before a word such as Inc or University it is, with that word, an organisation;
after "in", "near", "at" or "from" a place; and two or three capitalised words that none of these rules takes are a person. So single
capitalised words without such a hint are no names, as most of them only begin a sentence. All is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD, _FROM, _TO = "[A-Z][a-z]+", r"(?:\A|[^\pL\pN])", r"(?:\z|[^\pL\pN])"
TITLED = rf"{_FROM}(?:Dr|Mr|Mrs|Ms|Prof)[.]? ({_WORD}(?: {_WORD}){{0,2}}){_TO}"
ORGANISED = rf"{_FROM}((?:{_WORD} ){{1,3}}(?:Bank|College|Corp|Foundation|GmbH|Group|Inc|Institute|Labs|Ltd|University)){_TO}"
PLACED = rf"{_FROM}(?:in|near|at|from) ({_WORD}(?: {_WORD}){{0,1}}){_TO}"
PAIRED = rf"{_FROM}({_WORD}(?: {_WORD}){{1,2}}){_TO}"
#: In order: what an earlier rule takes is not what a later one makes of it.
RULES = (("PERSON", TITLED), ("PLACE", PLACED), ("ORGANIZATION", ORGANISED), ("PERSON", PAIRED))


def _typed(kind: str):
    return lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type"))


def raw_names(text: Column) -> Column:
    """array<struct<name, type>>: what each rule finds, rule by rule, in order of the text."""
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _typed(kind)) for kind, pattern in RULES])


def named_things(texts: DataFrame) -> DataFrame:
    """A recogniser: (exchange_id, pos, name, entity_type) of exchanges (exchange_id, text); a name counts by its first rule."""
    found = texts.select("exchange_id", F.posexplode(raw_names(F.coalesce("text", F.lit("")))).alias("pos", "e"))
    return found.select("exchange_id", (F.col("pos") - (1 << 30)).alias("pos"), F.col("e.name").alias("name"), F.col("e.type").alias("entity_type"))
