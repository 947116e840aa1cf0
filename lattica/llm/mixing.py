"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Within a source, documents stand in a permuted order (by a seeded hash) and their words are one line, cut into blocks
of ``block_words``; a document belongs to the block that it begins in. The target of a source is a number of words: whole passes over
the line, and a last pass that takes part of it. So of its blocks some are passed over whole times, a quota is to be drawn once more, and
the others are a reserve.

A tree over the output shards splits these numbers of all sources: at each node the left half draws as many blocks as its share
of the shards, by a multivariate hypergeometric law from the blocks of the node, without replacement, until each leaf has its own.
A shard takes its run of each source's permuted blocks, disjoint from all others, and of that run it draws as many as it has of the quota;
what it takes is shuffled locally. Blocks hold different numbers of words, so what all shards drew of a source is laid end to end in the order
of shards, the reserve behind it, and the words up to the target are taken; one document a source may be cut.

No group is sorted or summed in one task: places in a line come from sums over hash ranges and then over shards. What is at the driver are sources x shards numbers,
at most ``MOST_NUMBERS``.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 7
WEIGHTS = (1, 2, 3)
MOST = 3
#: Words of a block and of an output shard, at least. Both grow with the corpus, so that the numbers at the driver stay bounded.
BLOCK_WORDS, SHARD_WORDS = 1024, 1 << 16
MOST_SHARDS, MOST_NUMBERS, MOST_BLOCKS = 4096, 400_000, 200_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@F.arrow_udf(T.LongType())
def n_words(text: pa.Array) -> pa.Array:
    return pa.array([0 if x is None else len(x.split()) for x in text.cast(pa.binary()).to_pylist()], type=pa.int64())


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size).

    Targets share the whole by weight, no more than ``most`` times a source's size; what is above is reshared by weight
    until none is above. That is one level for all: with sources in order of size / weight, those below it are full,
    and the level follows from sums over the order, so no loop is needed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = sizes.withColumn("weight", cycle)
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everyone = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size = F.col("source_size").cast("double")
    level = weighted.withColumn(
        "level",
        (F.sum(size).over(everyone) - most * F.coalesce(F.sum(size).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # The first source in order that is not full sets the level.
    open_ = F.col("level") * F.col("weight") <= most * size
    found = level.withColumn("at", F.min(F.when(open_, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everyone))
    return found.select("source", "source_size", F.least(F.coalesce(F.col("at.level") * F.col("weight"), most * size), most * size).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block quotas whose sum over shards is ``quotas``, exactly."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(first: int, last: int, have: np.ndarray, path: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        total = int(have.sum())
        take = total * (middle - first) // (last - first)
        law = np.random.Generator(np.random.PCG64([seed, path]))
        left = law.multivariate_hypergeometric(have, take, method="marginals") if total else have * 0
        node(first, middle, left, 2 * path)
        node(middle, last, have - left, 2 * path + 1)

    node(0, shards, quotas.astype(np.int64), 1)
    return out


def placed(docs: DataFrame, range_rows: int = 100_000, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, tie, source, size, copies) with ``at``: the words before it in its source's permuted order."""
    sized = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    rows = docs.count()
    bits = max(1, int(np.ceil(np.log2(max(2, rows / range_rows)))))
    sized = sized.withColumn("range", F.shiftright("h", 64 - bits))
    sums = sized.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_at")).toDF("s", "r", "range_at")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("local", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    return local.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select(
        *docs.columns, (F.col("range_at") + F.col("local")).alias("at")
    )


def _collected(facts: DataFrame) -> list:
    """The sources at the driver, in order, after a check that they are no more than the tree can hold."""
    rows = facts.orderBy(F.col("source").asc_nulls_last()).limit(MOST_NUMBERS // 3 + 1).collect()
    if len(rows) * 3 > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS // 3} sources")
    return rows


def tree(spark, facts: DataFrame, block_words: int, shard_words: int, seed: int) -> tuple[DataFrame, int]:
    """(runs, block size) of ``facts`` (source, source_size, want). ``runs`` is (s, again, per, chunk, first, last, drawn, shard): a shard's run of blocks first..last - 1
    of source ``s``, of whole passes (``again``) or of the last one, of which it draws the first ``drawn``. It is listed under every chunk of
    ``per`` blocks that it reaches, so that blocks find their run by an equi-join."""
    rows = _collected(facts)
    sizes, wants = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("source_size", "want"))
    total = int(wants.sum())
    block = max(block_words, -(-total // MOST_BLOCKS))
    blocks = -(-sizes // block)
    whole = wants // np.maximum(sizes, 1)
    rest = wants - whole * sizes
    # In integers without bound, as words times blocks may exceed 64 bits.
    quota = np.array([min(int(b), -(-int(r) * int(b) // max(1, int(n)))) for b, r, n in zip(blocks, rest, sizes)], dtype=np.int64)
    # Of every source the blocks of whole passes, those to be drawn, and the reserve.
    numbers = np.concatenate((whole * blocks, quota, blocks - quota))
    shards = int(max(1, min(MOST_SHARDS, MOST_NUMBERS // max(1, len(numbers)), total // shard_words)))
    split = split_quotas(numbers, shards, seed).reshape(shards, 3, len(rows))
    out = []
    for again, run, drawn in ((True, split[:, 0], split[:, 0]), (False, split[:, 1] + split[:, 2], split[:, 1])):
        ends = np.cumsum(run, axis=0)
        for i, r in enumerate(rows):
            per = max(1, -(-int(ends[-1, i]) // shards))
            for shard in np.flatnonzero(run[:, i]).tolist():
                first, last = int(ends[shard, i] - run[shard, i]), int(ends[shard, i])
                out += [(r["source"], again, per, c, first, last, int(drawn[shard, i]), shard) for c in range(first // per, (last - 1) // per + 1)]
    return spark.createDataFrame(out, "s string, again boolean, per long, chunk long, first long, last long, drawn long, shard int"), block


def _in_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (source, block, ...) with the ``shard`` in whose run the block is, and ``reserve``: it is not drawn there."""
    per = runs.select(F.col("s").alias("ps"), F.col("per").alias("own_per")).distinct()
    keyed = rows.join(per, F.col("source").eqNullSafe(F.col("ps"))).withColumn("c", F.expr("block div own_per"))
    met = keyed.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("c") == F.col("chunk"))).filter("first <= block AND block < last")
    return met.select(*rows.columns, "shard", (F.col("block") >= F.col("first") + F.col("drawn")).alias("reserve"))


LINE = ["doc_id", "tie", "size", "source", "copies", "copy", "source_size", "target", "want", "at", "whole"]


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, range_rows: int, block_words: int, shard_words: int, tree_seed: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(written rows of ``mix_plan`` with ``shard``, that draws the last pass; runs; block size)."""
    spark = docs.sparkSession
    common.prepare(spark)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")
    )
    # Rows repeated whole collapse to one with a number of copies, so that no range of hashes holds them all.
    sized = common.written(sized.groupBy("doc_id", "tie", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    facts = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")))
    want = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    facts = common.written(facts.withColumn("want", want), "sources")
    runs, block = tree(spark, facts, block_words, shard_words, seed if tree_seed is None else tree_seed)
    line = placed(sized, range_rows, seed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    line = line.withColumn("at", F.col("at") + F.col("copy") * F.col("size")).join(facts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    whole = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0))
    line = line.withColumn("whole", whole).select(*LINE)
    last = common.written(_in_run(line.filter("size > 0").withColumn("block", F.expr(f"at div {block}")), runs.filter("NOT again")), "line")
    # Words before a row in the order of the draw: those of earlier shards, then those before it in its own shard.
    group = ["source", "reserve", "shard"]
    before = Window.partitionBy("source").orderBy("reserve", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.groupBy(*group).agg(F.sum("size").alias("there"))
    starts = starts.select(F.col("source").alias("a"), F.col("reserve").alias("b"), F.col("shard").alias("c"), F.coalesce(F.sum("there").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group).orderBy("at", "doc_id", "tie", "copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = last.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("a")) & (F.col("reserve") == F.col("b")) & (F.col("shard") == F.col("c")))
    rest = F.col("want") - F.col("whole") * F.col("source_size")
    laid = laid.withColumn("part", F.least(F.greatest(rest - F.col("start") - F.col("local"), F.lit(0)), F.col("size"))).select(*LINE, "part", "shard")
    none = line.filter("size = 0").select(*LINE, F.lit(0).cast("long").alias("part"), F.lit(None).cast("int").alias("shard"))
    plan = common.written(laid.unionByName(none).withColumn("taken", F.col("size") * F.col("whole") + F.col("part")), "plan")
    common.discard(sized, facts, last)
    return plan, runs, block


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, range_rows: int = 100_000,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, tree_seed: int | None = None,
) -> DataFrame:
    """(doc_id, tie, size, source, copies, copy, source_size, target, want, at, whole, part, taken) of every row of ``docs``.

    ``taken`` = size * whole passes + the words of the part taken in the last pass. ``tie`` tells apart rows of one id, and ``copy``, 0
    to ``copies`` - 1, rows repeated in id, text and source. ``tree_seed`` (else ``seed``) is the seed of the tree's draws alone.
    Null text: size 0. Null source: one source, last in order. Null or repeated ids are rows of their own; rows
    repeated whole follow each other, so each has its own words. Sources
    without words have target 0. An empty table gives an empty one. Reruns agree.
    """
    return _plan(docs, id_col, text_col, source_col, seed, range_rows, block_words, shard_words, tree_seed)[0].drop("shard")


def draws(plan: DataFrame, runs: DataFrame, block: int) -> DataFrame:
    """The rows of a plan once for every pass that takes words of them, with ``pass``, ``words`` and the ``shard`` that draws them."""
    facts = [*LINE, "taken"]
    last = plan.filter("part > 0").select(*facts, F.col("whole").alias("pass"), F.col("part").alias("words"), "shard")
    again = plan.filter("whole > 0 AND size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    # Blocks of whole passes are numbered one pass after the other.
    again = again.drop("shard").withColumn("block", F.expr(f"pass * ((source_size + {block - 1}) div {block}) + at div {block}"))
    again = _in_run(again, runs.filter("again")).select(*facts, "pass", F.col("size").alias("words"), "shard")
    return last.unionByName(again)


def _numbered(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, source_col: str, own: str) -> DataFrame:
    """The rows of ``docs`` with an id, text and source in ``repeated`` (doc_id, tie, source), with ``own``: 0, 1 and so on among those that
    share them. Rows are numbered within their input partition, from counts of the partitions before, so no task holds all copies of a row."""
    k_id, k_tie, k_source, at, part, s_id, s_tie, s_source, s_part, start, place = common.fresh(docs, *"k_id k_tie k_source at part s_id s_tie s_source s_part start place".split())
    on = F.col(id_col).cast("long").eqNullSafe(F.col(k_id)) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col(k_tie))
    on = on & F.col(source_col).cast("string").eqNullSafe(F.col(k_source))
    found = docs.withColumn(at, F.monotonically_increasing_id()).join(repeated.toDF(k_id, k_tie, k_source), on)
    # Written, as a number holds for one evaluation only. Its upper bits are the partition.
    found = common.written(found.withColumn(part, F.shiftright(at, 33)), "repeated")
    key = [k_id, k_tie, k_source]
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy(*key, part).agg(F.count(F.lit(1)).alias(start))
    starts = starts.select(*key, part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start)).toDF(s_id, s_tie, s_source, s_part, start)
    same = F.col(k_id).eqNullSafe(F.col(s_id)) & F.col(k_tie).eqNullSafe(F.col(s_tie)) & F.col(k_source).eqNullSafe(F.col(s_source))
    local = found.withColumn(place, F.row_number().over(Window.partitionBy(*key, part).orderBy(at)) - 1)
    joined = local.join(starts, same & (F.col(part) == F.col(s_part)))
    return joined.select(*docs.columns, (F.col(start) + F.col(place)).alias(own))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
    tree_seed: int | None = None,
) -> DataFrame:
    """The mixed rows: ``docs`` with each row once for every pass that takes words of it, and the columns
    ``mix_shard`` and ``mix_order`` (the local shuffle of a shard), which replace columns of these names. A last, partial pass that ends inside a document
    takes its first words, as they stand. Other columns pass unchanged. A document goes to the shard that draws the
    block it begins in. Rows repeated in id, text and source each have their own words, as in the plan; which of them is which
    copy is arbitrary. See ``mix_plan`` for nulls, ties and empty
    input; documents without words have no row."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_shard", "mix_order")])
    plan, runs, block = _plan(docs, id_col, text_col, source_col, seed, 100_000, block_words, shard_words, tree_seed)
    d_id, d_tie, d_source, d_copies, d_copy, d_pass, d_row, number = common.fresh(docs, *"id tie source copies copy pass row number".split())
    drawn = draws(plan, runs, block)
    own = drawn.select(
        F.col("doc_id").alias(d_id), F.col("tie").alias(d_tie), F.col("source").alias(d_source), F.col("copies").alias(d_copies), F.col("copy").alias(d_copy),
        F.col("pass").alias(d_pass), F.struct("shard", "words", "size").alias(d_row),
    )
    on = F.col(id_col).cast("long").eqNullSafe(F.col(d_id)) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col(d_tie))
    on = on & F.col(source_col).cast("string").eqNullSafe(F.col(d_source))
    rows = docs.join(own.filter(F.col(d_copies) == 1), on)
    repeated = plan.filter("copies > 1 AND copy = 0 AND size > 0").select("doc_id", "tie", "source")
    if repeated.limit(1).count():
        numbered = _numbered(docs, repeated, id_col, text_col, source_col, number)
        many = numbered.join(own.filter(F.col(d_copies) > 1), on & (F.col(number) == F.col(d_copy))).drop(number)
        rows = rows.unionByName(many)
    law = F.xxhash64(F.lit(seed), d_pass, d_id, d_tie)
    row = F.col(d_row)
    rows = rows.withColumn(text_col, _piece(F.col(text_col), F.when(row["words"] < row["size"], row["words"])))
    return rows.select(*docs.columns, row["shard"].alias("mix_shard"), law.alias("mix_order"))


@F.arrow_udf(T.StringType())
def _piece(text: pa.Array, words: pa.Array) -> pa.Array:
    """The first ``words`` words of a text with the white space between them; where that is null, the whole text."""
    out = []
    for x, n in zip(text.cast(pa.binary()).to_pylist(), words.to_pylist()):
        if n is not None:
            last = next(islice(_WORD.finditer(x), n - 1, None))
            x = x[: last.end()]
        out.append(x)
    return pa.array(out, type=pa.binary()).cast(pa.string())


def query(spark, sf_dir: str) -> DataFrame:
    """What the shards draw of every document, summed; documents that none draws take nothing."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan, runs, block = _plan(docs, "doc_id", "text", "source", SEED, 100_000, BLOCK_WORDS, SHARD_WORDS, None)
    facts = ["size", "source_size", "target"]
    drawn = draws(plan, runs, block).groupBy("doc_id", "tie", "source", "at").agg(*[F.first(c).alias(c) for c in facts], F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    none = plan.filter("taken = 0").select("doc_id", *facts, "taken", F.lit(0).cast("long").alias("n_shards"))
    return drawn.select("doc_id", *facts, "taken", "n_shards").unionByName(none)
