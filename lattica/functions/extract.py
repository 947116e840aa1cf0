"""From exchanges to mentions, triples and pairs.

Exchanges are (exchange_id, text). Recognition of names is pluggable: ``recognise`` maps exchanges to
(exchange_id, pos, name, entity_type), found before what patterns find. ``names.named_things`` goes by rules and ``lexicon`` by a list;
a statistical one would depend on a model that is not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import let_workers_import
from . import text as tx

MOST = 15


def exchange_texts(messages: DataFrame, least: int = 20, least_message: int = 10) -> DataFrame:
    """(exchange_id, text) from (exchange_id, pos, content): cleaned messages of more than ``least_message`` letters,
    a blank line between them; exchanges shorter than ``least`` are left out."""
    clean = tx.strip_context(tx.message_text(F.col("content"))).alias("clean")
    # Inside a generator a message is cleaned once; a filter would clean it again.
    cleaned = messages.select("exchange_id", F.inline(F.filter(F.array(F.struct("pos", clean)), lambda m: F.length(m["clean"]) > least_message)))
    joined = cleaned.groupBy("exchange_id").agg(F.array_sort(F.collect_list(F.struct("pos", "clean"))).alias("m"))
    return joined.select("exchange_id", F.array_join(F.transform("m", lambda x: x["clean"]), "\n\n").alias("text")).filter(F.length("text") >= least)


def matcher(names: list[str]) -> Callable[[str], list[int]]:
    """Which of the (lower-case) names a lower-case text holds as parts, in one pass over the text where the automaton is there."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [i for i, n in enumerate(names) if n in text]
    machine, by_name = ahocorasick.Automaton(), {}
    for i, n in enumerate(names):
        by_name.setdefault(n, []).append(i)
    for n, own in by_name.items():
        machine.add_word(n, own)
    machine.make_automaton()

    def run(text: str) -> list[int]:
        found = {own[0]: own for _, own in machine.iter(text)}
        return sorted(i for own in found.values() for i in own)

    return run


def holding(texts: DataFrame, text: str, known: DataFrame, most: int = 10_000) -> DataFrame:
    """``texts`` joined with each row of ``known`` (name, ...) whose name is part of the text, whatever the case. ``known`` has up to ``most`` rows
    and no empty name; where both have an ``agent_id``, only names of the text's agent count."""
    rows = known.withColumn("__low", F.lower("name")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"this list is to have at most {most} rows")
    short = F.broadcast(known.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("__n", T.IntegerType()), *known.schema.fields, T.StructField("__low", T.StringType())])).drop("__low"))
    keyed = "agent_id" in known.columns and "agent_id" in texts.columns
    lists: dict[str | None, list[tuple[int, str]]] = {}
    for i, r in enumerate(rows):
        lists.setdefault(r["agent_id"] if keyed else None, []).append((i, r["__low"]))
    let_workers_import(texts.sparkSession)

    def run(low: pa.Array, agent: pa.Array) -> pa.Array:
        machines = {}
        out = []
        for x, a in zip(low.to_pylist(), agent.to_pylist()):
            own = lists.get(a)
            if x is None or own is None:
                out.append([])
                continue
            if a not in machines:
                machines[a] = matcher([n for _, n in own])
            out.append([own[j][0] for j in machines[a](x)])
        return pa.array(out, type=pa.list_(pa.int32()))

    agent = F.col("agent_id") if keyed else F.lit(None).cast("string")
    hits = F.arrow_udf(run, "array<int>")(F.lower(text), agent)
    return texts.withColumn("__n", F.explode(hits)).join(short.drop("agent_id") if keyed else short, "__n").drop("__n")


def lexicon(names: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A recogniser of listed names (name, entity_type) as whole words; the list is broadcast, and more than 10,000 names raise."""

    def recognise(texts: DataFrame) -> DataFrame:
        words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), F.lit(" "))
        spaced = names.select(words("name").alias("name"), F.col("name").alias("shown"), "entity_type").filter(F.length("name") > 2)
        hit = holding(texts.withColumn("__words", words("text")), "__words", spaced)
        return hit.select("exchange_id", (F.locate(F.lower("shown"), F.lower("text")) - (1 << 30)).alias("pos"), F.col("shown").alias("name"), "entity_type")

    return recognise


def entities(texts: DataFrame, known: DataFrame | None = None, recognise: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST) -> DataFrame:
    """(exchange_id, pos, name, entity_type): the first ``most`` valid names of a text, then known names in it.

    A name counts once, whatever its case. ``known`` (canonical_name, entity_type) are those of the 200 newest entities
    or any other list of up to 10,000; names of three letters or more are looked for as parts of the text, and not counted in ``most``.
    """
    raw = texts.select("exchange_id", F.posexplode(tx.raw_entities(F.col("text"))).alias("pos", "e")).select("exchange_id", "pos", F.col("e.name").alias("name"), F.col("e.type").alias("entity_type"))
    if recognise:
        raw = recognise(texts).select("exchange_id", "pos", "name", "entity_type").unionByName(raw)
    named = raw.withColumn("name", tx.clean_name(F.col("name"))).filter((F.length("name") >= 2) & ~F.lower("name").isin(*sorted(tx.NOISE)) & tx.valid_entity_name(F.col("name")))
    once = named.groupBy("exchange_id", F.lower("name").alias("key")).agg(F.min(F.struct("pos", "name", "entity_type")).alias("e")).select("exchange_id", "key", "e.*")
    order = Window.partitionBy("exchange_id").orderBy("pos")
    kept = once.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    if known is not None:
        own = [c for c in known.columns if c == "agent_id"]
        short = known.select(F.col("canonical_name").alias("name"), "entity_type", *own).filter(F.length("name") >= 3)
        hits = holding(texts, "text", short).select("exchange_id", F.lower("name").alias("key"), F.lit(1 << 20).alias("pos"), "name", "entity_type")
        new = hits.join(kept.select("exchange_id", "key"), ["exchange_id", "key"], "left_anti")
        new = new.groupBy("exchange_id", "key").agg(F.min(F.struct("pos", "name", "entity_type")).alias("e")).select("exchange_id", "key", "e.*")
        kept = kept.unionByName(new).withColumn("pos", F.row_number().over(Window.partitionBy("exchange_id").orderBy("pos", "name")))
    return kept.select("exchange_id", F.col("pos").cast("int").alias("pos"), "name", "entity_type")


def first_names(raw: Column, most: int = MOST) -> Column:
    """array<struct<name, entity_type>>: the first ``most`` valid names of ``raw`` (array<struct<name, type>>), each once, whatever its case.
    What comes after them is not looked at, so a long text costs no more than its names up to there."""

    def taken(own: Column, x: Column) -> Column:
        def with_name(name: Column) -> Column:
            new = tx.bound(F.lower(name), lambda low: ~F.array_contains(own["key"], low) & ~low.isin(*sorted(tx.NOISE)))
            one = F.struct(F.lower(name).alias("key"), name.alias("name"), x["type"].alias("entity_type"))
            return F.when((F.length(name) >= 2) & new & tx.valid_entity_name(name), F.concat(own, F.array(one))).otherwise(own)

        return F.when(F.size(own) >= most, own).otherwise(tx.bound(tx.clean_name(x["name"]), with_name))

    start = F.array().cast("array<struct<key:string,name:string,entity_type:string>>")
    return F.transform(F.aggregate(raw, start, taken), lambda x: F.struct(x["name"].alias("name"), x["entity_type"].alias("entity_type")))


def mined(texts: DataFrame, raw_names: Callable[[Column], Column] | None = None, most: int = MOST, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """(exchange_id, names, relations) of exchanges with one text an id: what ``entities`` and ``triples`` find without known names and associations,
    as array<struct<name, entity_type>> and array<struct<subject, predicate, object>>.

    A text is read once and by itself, so nothing is shuffled or joined. ``raw_names`` is a recogniser as a column function, such as ``names.raw_names``.
    """
    let_workers_import(texts.sparkSession)
    text = F.col("text")
    raw = F.concat(raw_names(text), tx.raw_entities(text)) if raw_names else tx.raw_entities(text)
    sound = lambda r: tx.valid_entity_name(r["subject"]) & tx.valid_entity_name(r["object"])
    wanted = lambda r: r["predicate"].isin(*predicates) & sound(r) if predicates else sound(r)
    return texts.select("exchange_id", "text", tx.relations(text).alias("r")).select("exchange_id", first_names(raw, most).alias("names"), F.filter("r", wanted).alias("relations"))


def pairs_within(names: Column) -> Column:
    """array<struct<name_a, name_b>> of all ``names`` of an exchange, first before second."""
    after = lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.struct(x["name"].alias("name_a"), y["name"].alias("name_b")))
    return F.flatten(F.transform(names, after))


def pairs(found: DataFrame) -> DataFrame:
    """(exchange_id, name_a, name_b) of all entities of an exchange, first before second."""
    a, b = found.select("exchange_id", F.col("pos").alias("pa"), F.col("name").alias("name_a")), found.select("exchange_id", F.col("pos").alias("pb"), F.col("name").alias("name_b"))
    return a.join(b, "exchange_id").filter("pa < pb").select("exchange_id", "name_a", "name_b")


def triples(texts: DataFrame, pair_rows: DataFrame, threshold: float = 0.5, thresholds: Mapping[str, float] | None = None, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """(exchange_id, subject, predicate, object, confidence): relations stated, and related_to for pairs without one.

    The association of a pair has confidence 0.4, so the default threshold keeps none.
    """
    stated = tx.relationships(texts, predicates=predicates)
    ends = stated.select("exchange_id", F.lower("subject").alias("x"), F.lower("object").alias("y"))
    either = ends.unionByName(ends.select("exchange_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    loose = pair_rows.withColumns({"x": F.lower("name_a"), "y": F.lower("name_b")}).join(either, ["exchange_id", "x", "y"], "left_anti")
    loose = loose.select("exchange_id", F.col("name_a").alias("subject"), F.lit("related_to").alias("predicate"), F.col("name_b").alias("object"), F.lit(0.4).alias("confidence"))
    floor = F.lit(float(threshold))
    for p, v in sorted((thresholds or {}).items()):
        floor = F.when(F.col("predicate") == p, float(v)).otherwise(floor)
    both = stated.unionByName(loose).filter(F.col("confidence") >= floor)
    return both.filter(tx.valid_entity_name(F.col("subject")) & tx.valid_entity_name(F.col("object")))


def extract(texts: DataFrame, known: DataFrame | None = None, recognise: Callable[[DataFrame], DataFrame] | None = None, config: Mapping | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, triples, pairs) of exchanges (exchange_id, text)."""
    c = config or {}
    found = entities(texts, known, recognise, c.get("max_entities", MOST))
    beside = pairs(found)
    return found, triples(texts, beside, c.get("confidence_threshold", 0.5), c.get("predicate_thresholds"), tuple(c.get("canonical_predicates", ())) or None), beside
