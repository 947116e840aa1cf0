"""What the two vector searches share: reading vectors, blocks of queries, and merging their finds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries gathered at the driver and broadcast at once: 32,768 of 64 components are 16 MB.
QUERY_BLOCK = 32_768


def sound(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, v) of the rows that take part: an id, and no null or non-finite component; ``zero``: zero vectors too."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def width(rows: DataFrame) -> int:
    """The largest number of components; shorter vectors count as filled with zeros."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def query_table(rows: DataFrame, every: int, each: int = QUERY_BLOCK) -> tuple[DataFrame, int]:
    """(a written table (id, v, part) of the queries, number of parts): ids divisible by ``every``, one vector an id, in
    parts of about ``each``."""
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = common.written(queries, "queries")
    parts = common.blocks_for(queries.count(), each)
    return queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), parts


def gathered(part: DataFrame) -> pa.Table:
    """One part of the queries, at the driver, in order of id."""
    return part.orderBy("id").toArrow().combine_chunks()


class Best:
    """The best ``k`` finds of each of a block of queries: highest score, then smallest id."""

    def __init__(self, queries: int, k: int, kind) -> None:
        self.k = k
        self.q = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=kind)
        self.least = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        able = score >= self.least[q]
        q, ids, score = q[able], ids[able], score[able]
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        full = np.flatnonzero(rank == self.k - 1)
        self.least[q[full]] = score[full]
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def search(index: DataFrame, queries: DataFrame, parts: int, k: int, kernel: Callable, score_type: str, prepare: Callable, beside: Callable | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): every part of the queries against the whole index, one part after the other.

    ``prepare(table of a part)`` gives (what the kernel is to know of these queries, the score below which nothing counts of each or None);
    ``kernel(record batch, query ids, prepared, best)`` adds what it finds in one batch of the index; ``beside(part)`` gives further finds
    (query_id, vec_id, score). A task keeps ``k`` finds a query, so what is shuffled is bounded by tasks x queries x ``k``. The finds of a part are
    written and its broadcast is destroyed before the next part is gathered, so one part at most is at the driver and on an executor.
    """
    spark = index.sparkSession
    kind = np.int64 if score_type == "long" else np.float64
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    paths, out = [], None
    for i in range(parts):
        part = queries.filter(F.col("part") == i)
        rows = gathered(part)
        prepared, floor = prepare(rows)
        held = spark.sparkContext.broadcast((rows["id"].to_numpy(), prepared, floor))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, prepared, floor = held.value
            best = Best(len(ids), k, kind)
            if floor is not None:
                best.least = floor.copy()
            for batch in batches:
                kernel(batch, ids, prepared, best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
        if beside:
            found = found.unionByName(beside(part))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = common.written(ranked, "found")
        paths.append(common.path_of(out))
        held.destroy()
    return spark.read.schema(out.schema).parquet(*paths)
