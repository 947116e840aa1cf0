"""SimHash near-duplicates by pivot distance tables.

Fingerprints that are equal form one class, so thousands of copies become one row before anything is compared. For
each class the Hamming distances to ``PIVOTS`` reference fingerprints are tabled. By the triangle inequality a pair
within distance ``t`` differs by at most ``t`` in every coordinate of that table, so pairs are discarded by their maximum
coordinate difference, and the survivors verified bit by bit. Comparing all tables with each other would be a cross
join; pairs meet by an equi-join on bands of bits, of which at least one is equal within ``t``. A pair counts once, in the
first band where both are equal. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
NEAR = 2
PIVOTS = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text; 0 for a text without words."""
    units = (text or b"").translate(_LOWER).split()
    if not units:
        return 0
    joined = b" ".join(units)
    h = xxhash.xxh64_intdigest
    if len(units) <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(units) - SHINGLE + 1
    hashes = np.fromiter(
        (h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist())), dtype="<u8", count=n
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""
    common.prepare(docs.sparkSession)
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> list[int]:
    """The reference fingerprints: fixed pseudo-random 64-bit values."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)]


def band_masks(near: int, classes: int) -> list[int]:
    """Bit masks of which every pair within ``near`` bits has at least one equal.

    The 64 bits are cut into blocks; each mask leaves out ``near`` of them, so at least one mask has no differing bit.
    More blocks make longer and more masks. The count follows the number of classes: about one chance meeting a
    mask and class at most, whatever the size of the corpus.
    """
    for blocks in range(near + 1, 13):
        bits = 64 * (blocks - near) // blocks
        if classes <= 1 << bits:
            break
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, blocks - near)]


def near_pairs(classes: DataFrame, near: int = NEAR, count: int | None = None) -> DataFrame:
    """(a, b): every pair of different fingerprints of ``classes`` (fp) at most ``near`` bits apart, a < b."""
    refs = pivots()
    masks = band_masks(near, classes.count() if count is None else count)
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))) for p in refs]
    # The table of distances, eight bytes to a long.
    packed = [
        sum((F.shiftleft(distance[i + j].cast("long"), 7 * j) for j in range(1, 8)), distance[i].cast("long")).alias(f"to{i // 8}")
        for i in range(0, PIVOTS, 8)
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    keyed = classes.select("fp", *packed).select("fp", "to0", "to1", F.explode(rows).alias("k")).select("k.band", "k.bits", "fp", "to0", "to1")
    other = keyed.toDF("band", "bits", "b", "b_to0", "b_to1")
    met = keyed.toDF("band", "bits", "a", "a_to0", "a_to1").join(other, ["band", "bits"]).filter("a < b")
    coordinate = lambda c, j: F.shiftright(c, 7 * j).bitwiseAND(127)
    far = [F.abs(coordinate(F.col(f"a_to{i}"), j) - coordinate(F.col(f"b_to{i}"), j)) for i in (0, 1) for j in range(8)]
    met = met.filter(F.greatest(*far) <= near)
    differing = F.col("a").bitwiseXOR(F.col("b"))
    met = met.filter(F.bit_count(differing) <= near)
    first = F.lit(len(masks) - 1)
    for i in reversed(range(len(masks) - 1)):
        first = F.when(differing.bitwiseAND(F.lit(_signed(masks[i]))) == 0, i).otherwise(first)
    return met.filter(F.col("band") == first).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable over ``edges`` (a, b), for every end of an edge.

    Each round hooks a node to the smallest root around it and then follows that root one step further (pointer
    jumping), so chains halve and the rounds grow with the logarithm of the longest chain. Each round is a written
    table, which the next one deletes; groups pre-aggregate by ``min``.
    """
    both = common.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = last = common.written(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        around = both.join(state.toDF("b", "m"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("m").alias("m"))
        hooked = state.join(around, "fp").select("fp", F.least("root", "m").alias("now"), F.col("root").alias("old"))
        jump = hooked.groupBy(F.col("old").alias("o")).agg(F.min("now").alias("far"))
        new = F.least("now", F.coalesce("far", "now"))
        moved = hooked.join(jump.toDF("now", "far"), "now", "left").select("fp", new.alias("root"), (new < F.col("old")).alias("moved"))
        step = common.written(moved, "roots")
        common.discard(last)
        last, state = step, step.select("fp", "root")
        if step.filter("moved").limit(1).count() == 0:
            common.discard(both)
            return state


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id) of every row of ``docs``.

    Null or empty texts have fingerprint zero and are linked like any other. A null id is a document too: it counts
    in ``n_near`` but names no component unless all its members have null ids (then null). Repeated rows are separate
    documents with the same id. An empty table gives an empty one. Ties: the smallest id names a component.
    """
    prints = common.written(fingerprints(docs.select(F.col(id_col).cast("long"), F.col(text_col))), "prints")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "classes")
    edges = common.written(near_pairs(classes.select("fp"), near, classes.count()), "pairs")
    if edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = ends.join(classes.select(F.col("fp").alias("b"), "size"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("size").alias("beside"))
        roots = components(edges)
        named = roots.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
        linked = around.join(roots, "fp").join(named, "root").select("fp", "beside", "component_id")
        facts = classes.join(linked, "fp", "left")
    else:
        facts = classes.withColumns({"beside": F.lit(0), "component_id": F.col("least")})
    facts = facts.select("fp", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_near"), F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(facts, "fp").select("doc_id", common.hex16(F.col("fp")).alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. All columns pass unchanged.

    Of rows repeated whole one stays; of rows that share the smallest id but differ, the one with the smallest
    text (null first). Rows with a null id stay only where their component has no other id.
    """
    groups = simhash_groups(docs, id_col, text_col, near)
    key, row = common.fresh(docs, "id", "row")
    kept = common.written(groups.filter("doc_id <=> component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(row)), "kept")
    # Always by a shuffle: a table of kept ids that is broadcast while it is small would make small runs differ from large ones.
    out = docs.join(kept.select(key).hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left_semi")
    if kept.filter(F.col(row) > 1).limit(1).count():
        out = out.groupBy(F.col(id_col).alias(key)).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNotNull(), text_col)).alias(row)).select(f"{row}.*")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
