"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is the assistant once: in its rendering the turns of that participant are the
assistant's and carry the loss mask, and all others are users named after their participant. System turns are
instructions in the rendering of every participant and no participant. They stand where their turn number has them. With ``carry`` each
part also begins with the instruction in force, the last system turn of the parts before it: one turn a part, however many there are.

A rendering is cut into parts of ``part_turns`` turns, as a training example has to end somewhere and a conversation
may hold any share of all rows: a turn's number gives its part. The turns of a crowded part (many rows with one number) are
rendered in pieces: runs of neighbours in the order of the dialogue, of ``crowd`` turns, so that no task gathers more. Their
places come from counts over ranges of the order. ``query`` joins the pieces of a part to one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PART_TURNS = 64
#: Turns of one part that are rendered together; a part with more is cut into runs of so many.
CROWD = 4096
#: Turns of crowded parts that one task orders.
RANGE_ROWS = 100_000
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _named(role, speaker):
    name = F.regexp_replace(role, r"[^A-Za-z0-9_-]", "_")
    return F.when(role == SYSTEM, F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))


def _pieces(t: DataFrame, crowd: int) -> list[DataFrame]:
    """``t`` (conv_id, turn, role, text, part) with ``piece``: the turns of other parts and, where there are any, of crowded ones.

    Only turns of crowded parts are counted and ordered. They are sorted into ranges, a task each; ``place`` is what the
    ranges before hold of the part, and what stands before in the own range, in running sums over at most a range.
    """
    spark = t.sparkSession
    sizes = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    sizes = common.written(sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "n"), "crowded")
    rows = sizes.agg(F.sum("n")).first()[0]
    if not rows:
        return [t.withColumn("piece", F.lit(0))]
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    calm = t.join(sizes, same, "left_anti").withColumn("piece", F.lit(0))
    # Rows repeated whole are counted first, so that no range of the order holds them all.
    whole = t.join(sizes.drop("n"), same, "left_semi").groupBy(*t.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("conv_id"), F.col("part"), F.col("turn"), F.col("role"), F.col("text")]
    ranges = common.blocks_for(rows, RANGE_ROWS)
    sorted_ = whole.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()) if ranges > 1 else whole.withColumn("range", F.lit(0))
    sorted_ = common.written(sorted_, "turns")
    before = Window.partitionBy("conv_id", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_.groupBy("conv_id", "part", "range").agg(F.sum("copies").alias("n"))
    starts = starts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "part", "range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_.withColumn("own", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, same & (F.col("range") == F.col("r")))
    placed = placed.withColumn("place", F.col("start") + F.col("own"))
    # A row repeated whole is listed once a piece that it reaches, with as many copies as stand there.
    placed = placed.withColumn("piece", F.explode(F.sequence(F.expr(f"place div {crowd}"), F.expr(f"(place + copies - 1) div {crowd}"))))
    times = F.least(F.col("place") + F.col("copies"), (F.col("piece") + 1) * crowd) - F.greatest(F.col("place"), F.col("piece") * crowd)
    placed = placed.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return [calm, placed.select(*t.columns, F.col("piece").cast("int").alias("piece"))]


def carried(t: DataFrame) -> DataFrame:
    """The rows that ``carry`` adds to turns (conv_id, turn, role, text, part, key, none). They have no turn number, so they come first."""
    where = ["key", "none", "conv_id", "part"]
    said = t.filter(F.col("role") == SYSTEM).groupBy(*where).agg(F.max(F.struct("turn", "text")).alias("last"))
    # One row a part, so the order within a conversation is over parts and not over turns.
    parts = t.groupBy(*where).agg(F.count(F.lit(1)).alias("there")).join(said.drop("conv_id"), ["key", "none", "part"], "left")
    before = Window.partitionBy("key", "none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("force", F.last("last", ignorenulls=True).over(before)).filter("force IS NOT NULL")
    return found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(SYSTEM).alias("role"), F.col("force.text").alias("text"), "part", "key", "none")


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS, crowd: int = CROWD, carry: bool = False
) -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, n_assistant, text, mask) for every participant and part.

    A part of more than ``crowd`` turns is several rows: ``piece`` 0, 1 and so on are its runs of ``crowd`` turns in order, the last
    one shorter; their texts in order are the part's, and each mask counts from the start of its piece. Other parts are piece 0.
    ``carry``: a part begins with the last system turn of the parts before it.
    ``text`` joins the turns as ``<|im_start|>role name=who`` newline text ``<|im_end|>`` newline; ``mask`` is an array of
    (start, end) character ranges of ``text`` that the assistant speaks, end marker included. Turns are in order of
    turn number (null first), then role and text (null first), so ties have one order; repeated rows stay. Null text: an
    empty turn. Null role: the participant "unknown". Null conversation: one conversation. A conversation of system
    turns alone has no participant and no row. Markers inside a text are broken with a zero-width space, so no text can
    end a turn. An empty table gives an empty one. Extra columns are not carried.
    """
    return reduce(DataFrame.unionByName, _rotated(turns, conv_col, turn_col, role_col, text_col, part_turns, crowd, carry))


def _rotated(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS, crowd: int = CROWD, carry: bool = False
) -> list[DataFrame]:
    """``rotate`` in two tables: other parts and, where there are any, crowded ones."""
    t = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.col(text_col).alias("text")
    )
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)))
    # A null conversation is a key like any other.
    t = t.withColumns({"key": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    key = ["key", "none"]
    if carry:
        t = t.unionByName(carried(t))
    people = t.filter(F.col("role") != SYSTEM).select(*key, F.col("role").alias("perspective")).distinct()
    turns_of = common.written(t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "conversations")
    # One row a turn and participant: no more than turns x participants.
    return [_rendered(common.spread_join(some, people, key, "n", turns_of).drop(*key)) for some in _pieces(t, crowd)]


def _rendered(wide: DataFrame) -> DataFrame:
    """The rows of ``rotate`` from turns (conv_id, turn, role, text, part, piece) times perspectives."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_(start|end)\|>", "<\u200b|im_$1|>")
    head = F.concat(F.lit(START), _named(F.col("role"), F.col("perspective")), F.lit("\n"))
    one = F.struct(
        F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("raw"), F.concat(head, body, F.lit(END + "\n")).alias("shown"),
        F.length(head).alias("from"), F.length(F.concat(head, body, F.lit(END))).alias("to"), (F.col("role") == F.col("perspective")).alias("own"),
    )
    grouped = wide.select("conv_id", "perspective", "part", "piece", one.alias("one")).groupBy("conv_id", "perspective", "part", "piece").agg(F.array_sort(F.collect_list("one")).alias("all"))
    shown = F.transform("all", lambda x: x["shown"])
    spans = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["shown"])).alias("at"),
            F.when(x["own"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["from"]).alias("start"), (s["at"] + x["to"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return grouped.select(
        "conv_id", "perspective", "part", "piece", F.size("all").cast("long").alias("n_turns"), F.size(F.filter("all", lambda x: x["own"])).cast("long").alias("n_assistant"),
        F.array_join(shown, "").alias("text"), spans.alias("mask"),
    )


def whole_parts(pieces: DataFrame) -> DataFrame:
    """The rows of ``rotate`` with the pieces of a part joined in order to one row, and the mask counted from its start.

    Such a row holds all turns of its part, as the SQL has it, so Spark's 2 GB a value bound a part here; ``pieces`` has no such bound.
    """
    one = F.struct("piece", "n_turns", "n_assistant", "text", "mask")
    grouped = pieces.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(one)).alias("all"))
    # Where each piece starts: the lengths are summed over pieces, not over turns.
    spans = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.concat(s["spans"], F.array(F.transform(x["mask"], lambda m: F.struct((s["at"] + m["start"]).alias("start"), (s["at"] + m["end"]).alias("end"))))).alias("spans"),
        ),
        lambda s: F.flatten(s["spans"]),
    )
    total = lambda name: F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x[name])
    return grouped.select(
        "conv_id", "perspective", "part", total("n_turns").alias("n_turns"), total("n_assistant").alias("n_assistant"), F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"), spans.alias("mask")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """The renderings, one row a part of any size, their masks as text: start-end ranges joined by commas."""
    calm, *crowded = _rotated(common.table(spark, sf_dir, "conversations"), carry=True)
    out = reduce(DataFrame.unionByName, map(whole_parts, crowded), calm.drop("piece"))
    told = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("mask", told)


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, text AS raw, coalesce(text, '') AS text, CAST(coalesce(floor(turn / 64.0), -1) AS BIGINT) AS part FROM conversations
), told AS (
  SELECT conv_id, part, raw FROM own WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, part ORDER BY turn DESC NULLS LAST, raw DESC NULLS LAST) = 1
), force AS (
  SELECT o.conv_id, o.part, told.raw FROM (SELECT DISTINCT conv_id, part FROM own) o JOIN told ON o.conv_id IS NOT DISTINCT FROM told.conv_id AND told.part < o.part
  QUALIFY row_number() OVER (PARTITION BY o.conv_id, o.part ORDER BY told.part DESC) = 1
), t AS (
  SELECT * FROM own UNION ALL SELECT conv_id, NULL, 'system', raw, coalesce(raw, ''), part FROM force
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), w AS (
  SELECT t.conv_id, perspective, part, turn, role, raw,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
      ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head,
    regexp_replace(text, '<\\|im_(start|end)\\|>', '<' || chr(8203) || '|im_\\1|>', 'g') || '<|im_end|>' AS rest
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER g AS n,
    coalesce(sum(length(head) + length(rest) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, raw NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM w WINDOW g AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, raw NULLS FIRST)
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE role = perspective) AS n_assistant,
  string_agg(head || rest || chr(10), '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(head) + length(rest) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE role = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
