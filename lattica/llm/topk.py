"""Exact top-k search over an impact-ordered index, score at a time.

A component of an integer vector is a posting: the vector, with that impact, in the list of its dimension. The index cuts
the postings of a block of vectors into segments by quantised impact, highest first. A query takes the segments in that
order and adds their contributions to its accumulators. What the segments still to come can add to a vector is bounded
by the length of what is left of it, so after each segment some vectors provably cannot reach the best ``k``; vectors that no
query at hand can use any more are left out of later segments. Only when
few possible members are left does the query stop, and these are rescored exactly from all their postings.

Components are whole numbers held as doubles, exact at any size. Sums of products are exact in single or double precision where they are small
enough; where they are not, the bounds allow for rounding and the rescoring is done in integers without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

K = 20
EVERY = 20
SCALE = 64
BLOCK = 4096
#: Queries handled at once within a task.
STEP = 512
#: A query block stops with proof once this share of the vectors is still possible.
FEW = 0.02
INDEX = "ids binary, segments array<struct<places:binary,impacts:binary>>"


#: Components count as no larger than this, so that their multiples are doubles; scores as no larger than a long.
LARGEST = 2.0**1000
LONG = (1 << 63) - 1


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * np.clip(x, -LARGEST, LARGEST))


def segments(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, impacts) of a block's postings in falling quantised impact: |impact| in [2**j, 2**(j+1)), two levels of
    which share a segment; a place is vector * dimensions + dimension."""
    flat = values.ravel()
    level = np.where(flat == 0, -1, np.floor(np.log2(np.maximum(np.abs(flat), 1))).astype(np.int64))
    out = []
    top = int(level.max(initial=-1))
    while top >= 0:
        places = np.flatnonzero((level == top) | (level == top - 1) & (level >= 0))
        out.append((places.astype(np.int32), flat[places]))
        top = int(level[level < top - 1].max(initial=-1))
    return out


def _indexer(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def row(a, v):
            parts = [{"places": p.tobytes(), "impacts": x.tobytes()} for p, x in segments(v)]
            return pa.RecordBatch.from_pylist([{"ids": a.tobytes(), "segments": parts}], schema=schema)

        part = pa.struct([("places", pa.binary()), ("impacts", pa.binary())])
        schema = pa.schema([("ids", pa.binary()), ("segments", pa.list_(part))])
        have = 0
        for batch in batches:
            ids.append(batch["id"].to_numpy())
            rows.append(quantised(vectors.matrix(batch["v"], dims), scale))
            have += batch.num_rows
            while have >= BLOCK:
                a, v = np.concatenate(ids), np.concatenate(rows)
                yield row(a[:BLOCK], v[:BLOCK])
                ids, rows, have = [a[BLOCK:]], [v[BLOCK:]], have - BLOCK
        if have:
            yield row(np.concatenate(ids), np.concatenate(rows))

    return run


def _kernel(dims: int, k: int):
    def run(batch: pa.RecordBatch, query_ids: np.ndarray, queries: np.ndarray, best: vectors.Best) -> None:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            planes, whole = [], np.zeros(len(ids) * dims)
            for s in row["segments"]:
                places, impacts = np.frombuffer(s["places"], np.int32), np.frombuffer(s["impacts"], np.float64)
                whole[places] = impacts
                planes.append((places, impacts))
            whole = whole.reshape(-1, dims)
            # Single precision is exact below 2**24, double below 2**53.
            with np.errstate(over="ignore"):
                top = float(np.abs(whole).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
            kind = np.float32 if top < 1 << 24 else np.float64
            rest = whole.copy()
            dense, left = [], []
            for places, impacts in planes:
                plane = np.zeros(len(ids) * dims, dtype=kind)
                plane[places] = impacts
                rest.ravel()[places] = 0
                dense.append(plane.reshape(-1, dims))
                left.append(_length(rest))
            for at in range(0, len(queries), STEP):
                _some(queries[at : at + STEP], query_ids[at : at + STEP], at, ids, whole, dense, left, kind, top, k, best)

    return run


def _length(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def _some(q, own, at, ids, whole, dense, left, kind, top, k, best) -> None:
    length, size = _length(q), _length(whole)
    least = best.least[at : at + len(q)]
    able = np.arange(len(ids))
    sums = np.zeros((len(q), len(ids)), dtype=kind)
    mine = own[:, None] == ids[None, :]
    possible = ~mine
    with np.errstate(over="ignore", invalid="ignore"):
        for plane, norms in zip(dense, left):
            sums += q.astype(kind) @ plane[able].T
            # One unit of slack covers rounding of the bound; sums of integers are exact, but for those beyond 2**53.
            slack = length[:, None] * norms[able][None, :] + (1.0 if norms.any() else 0.0)
            if not top < 1 << 53:
                slack = slack + length[:, None] * size[able][None, :] * (len(whole[0]) * 2.0**-50)
            slack = slack.astype(kind)
            low = np.where(mine, -np.inf, np.nan_to_num(sums - slack, nan=-np.inf, posinf=-np.inf, neginf=-np.inf))
            if low.shape[1] > k:
                least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            possible = ~(sums + slack < least[:, None]) & ~mine
            if possible.mean() <= FEW:
                break
            alive = possible.any(axis=0)
            if alive.mean() < 0.7:
                able, sums, mine, possible = able[alive], sums[:, alive], mine[:, alive], possible[:, alive]
    i, j = np.nonzero(possible)
    j = able[j]
    for a in range(0, len(i), 1 << 18):
        b = slice(a, a + (1 << 18))
        best.add(i[b] + at, ids[j[b]], _exact(q, whole, i[b], j[b], top))


def _exact(q, whole, i, j, top) -> np.ndarray:
    """The integer products of rows ``i`` of ``q`` and ``j`` of ``whole``, as longs; the largest or smallest long for those beyond."""
    if top < 1 << 53:
        return (q[i] * whole[j]).sum(axis=1).astype(np.int64)
    a, b = {x: [int(c) for c in q[x]] for x in set(i.tolist())}, {x: [int(c) for c in whole[x]] for x in set(j.tolist())}
    products = (sum(map(int.__mul__, a[x], b[y])) for x, y in zip(i.tolist(), j.tolist()))
    return np.array([min(max(p, -LONG - 1), LONG) for p in products], dtype=np.int64)


def exact_top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, query_block: int = vectors.QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query, exactly.

    Ties go to the smaller id. Vectors (or ids) that are null or hold null or non-finite components take no part; an empty vector is zero,
    shorter ones are filled with zeros. Rows that share an id are candidates each, are all the query's own, and the
    smallest of their vectors is the query. Fewer candidates than ``k``: all. An empty table gives an empty one.
    Scores beyond the range of a long are given as its largest or smallest value, and tie there.
    """
    common.prepare(table.sparkSession)
    rows = vectors.sound(table, id_col, vector_col, zero=True)
    dims = max(1, vectors.width(rows))
    index = common.written(rows.mapInArrow(_indexer(dims, scale), INDEX), "impacts")
    queries, parts = vectors.query_table(rows, every, query_block)
    found = vectors.search(index, queries, parts, k, _kernel(dims, k), "long", lambda t: (quantised(vectors.matrix(t["v"].combine_chunks(), dims), scale), None))
    common.discard(index)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
