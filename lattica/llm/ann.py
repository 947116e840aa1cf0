"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample. Every row is indexed: its cell, the
codes of its residual with the length of what they leave out, and the vector itself for the exact reranking. Cells grow with the
rows; a cell is stored in blocks of bounded size, so a cell that holds a third of all rows is many blocks.

A query first meets the sample: its ``k``-th best product there is a floor, as whatever scores less is not among the ``k`` best. Cells are probed in order of their
potential, the product with the centroid and ``LEAN`` standard deviations of what residuals add to it, which favours cells of long or scattered vectors as inner products do. How
many are probed is measured when the index is built: as many as hold the share ``AIM`` of the true neighbours among sample rows that the centroids were not fitted on. The
longest rows, the share ``LONGEST``, are near to many queries by inner product, whatever their direction; they are a cell of their own that every query probes. Cells whose
bound is below the floor are left out.

In each block a table of the query's products with all codewords gives asymmetric scores by look-up. For a query without a floor the ``rerank`` best are scored exactly in double
precision, which gives one; then so is every row whose score could reach it, given the error of its codes. So what the probed
cells hold is searched exactly, without a cap, and the best ``k`` of all blocks stay, copies and ties by id.
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
SAMPLE = 20_000
#: Rows of a cell; the number of cells follows the number of rows, up to what the sample can fit.
CELL_ROWS, FEWEST, MOST_CELLS = 128, 8, 1024
AIM, LEAN, LONGEST = 0.92, 2.0, 0.03
#: The share of the sample that is not fitted on, and the rows that ask in order to measure how many cells to probe.
HELD, TRIALS = 0.25, 1024
PARTS = 16
CODES = 256
RERANK = 40
BLOCK = 4096
#: Pairs of a query and a row that are looked up at once, and that are scored exactly at once.
LOOKED, PAIRS = 1 << 19, 16_384
INDEX = "cell int, ids binary, codes binary, errors binary, vectors binary"


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each row of ``x``."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty centre stays where it was."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mixed = x[rng.permutation(len(x))]
    first = np.sort(np.unique(mixed, axis=0, return_index=True)[1])
    centres = mixed[first[:k]]
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, cells: int = 64, parts: int = PARTS, codes: int = CODES) -> dict:
    """Coarse centroids with the standard deviation of their residuals along a direction, and, for each run of dimensions, the codewords of the residuals."""
    centres = k_means(sample, cells)
    # An empty cell would use up a probe.
    centres = centres[np.unique(nearest(sample, centres))]
    residual = sample - centres[nearest(sample, centres)]
    runs = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
    books = [k_means(residual[:, r], codes, rounds=5) for r in runs]
    return {"centres": centres, "spread": spread(sample, centres), "runs": runs, "books": books, "long": np.inf}


def with_long(model: dict, sample: np.ndarray, share: float = LONGEST) -> dict:
    """``model`` with a last cell for rows longer than all but the ``share`` of ``sample``; none where no row is."""
    length = np.linalg.norm(sample, axis=1)
    limit = float(np.quantile(length, 1 - share)) if len(length) else np.inf
    longer = sample[length > limit]
    if not len(longer):
        return model
    return {**model, "long": limit, "centres": np.concatenate((model["centres"], longer.mean(axis=0, keepdims=True))), "spread": np.append(model["spread"], 0.0)}


def cells_of(model: dict, x: np.ndarray) -> np.ndarray:
    """The cell of each row: the last one of long rows, the nearest of others."""
    usual = len(model["centres"]) - (model["long"] < np.inf)
    own = nearest(x, model["centres"][:usual])
    return np.where(np.linalg.norm(x, axis=1) > model["long"], len(model["centres"]) - 1, own)


def spread(sample: np.ndarray, centres: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """The standard deviation of the residuals of each cell along a direction; ``prior`` rows of the whole stand in for what few rows cannot tell."""
    own = nearest(sample, centres)
    square = ((sample - centres[own]) ** 2).sum(axis=1) / max(1, sample.shape[1])
    count = np.bincount(own, minlength=len(centres))
    return np.sqrt((np.bincount(own, weights=square, minlength=len(centres)) + prior * square.mean()) / (count + prior))


def potential(model: dict, q: np.ndarray) -> np.ndarray:
    """(queries, cells): by what cells are ordered for probing; that of long rows comes first."""
    found = q @ model["centres"].T + LEAN * np.linalg.norm(q, axis=1)[:, None] * model["spread"][None, :]
    if model["long"] < np.inf:
        found[:, -1] = np.inf
    return found


def probes_for(model: dict, asking: np.ndarray, held: np.ndarray, near: int, aim: float = AIM) -> int:
    """How many cells hold the share ``aim`` of the ``near`` nearest of ``held`` of each row of ``asking``, none of which is in ``held``."""
    cells = len(model["centres"])
    if len(held) < 50 or not len(asking) or cells == 1:
        return cells
    own = cells_of(model, held)
    places = []
    for at in range(0, len(asking), 128):
        some = asking[at : at + 128]
        top = np.argpartition(-(some @ held.T), near - 1, axis=1)[:, :near]
        rank = np.empty((len(some), cells), dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-potential(model, some), axis=1), np.broadcast_to(np.arange(cells), rank.shape), axis=1)
        places.append(np.take_along_axis(rank, own[top], axis=1).ravel())
    return int(np.ceil(np.quantile(np.concatenate(places), aim))) + 1


def encode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, codes, length of the residual that the codes leave out) of the rows of ``x``."""
    cell = cells_of(model, x)
    residual = x - model["centres"][cell]
    codes = np.stack([nearest(residual[:, r], b).astype(np.uint8) for r, b in zip(model["runs"], model["books"])], axis=1)
    left = np.sqrt(sum(((residual[:, r] - b[codes[:, i]]) ** 2).sum(axis=1) for i, (r, b) in enumerate(zip(model["runs"], model["books"]))))
    return cell, codes, left


def _encoder(held, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch["v"], dims)
            cell, codes, left = encode(held.value, x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"], pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(np.linalg.norm(x - held.value["centres"][cell], axis=1)),
                ],
                names=["id", "cell", "codes", "error", "vector", "far"],
            )

    return run


def _blocker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of cell become blocks of one cell."""
    cell, ids, codes, errors, own = None, [], [], [], []

    def block():
        arrays = [pa.array([cell], pa.int32()), *[pa.array([x], pa.binary()) for x in (np.array(ids, dtype=np.int64).tobytes(), b"".join(codes), np.array(errors).tobytes(), b"".join(own))]]
        return pa.RecordBatch.from_arrays(arrays, names=["cell", "ids", "codes", "errors", "vectors"])

    for batch in batches:
        for i, c, k, e, v in zip(*(batch.column(n).to_pylist() for n in ("id", "cell", "codes", "error", "vector"))):
            if ids and (c != cell or len(ids) >= BLOCK):
                yield block()
                ids, codes, errors, own = [], [], [], []
            cell = c
            ids.append(i)
            codes.append(k)
            errors.append(e)
            own.append(v)
    if ids:
        yield block()


def contenders(ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The rows that can be among the ``k`` best of some query, in order. Equal vectors score alike and go by id, and a query
    leaves out one id: of rows equal in both the first ``k`` are enough, and of equal vectors the first 2 ``k`` of those."""
    _, same = np.unique(np.ascontiguousarray(own).view(f"V{own.itemsize * own.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))

    def places(*keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys[0]))
        new = np.zeros(len(at), dtype=bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
        return at - np.maximum.accumulate(np.where(new, at, 0))

    order = order[places(same[order], ids[order]) < k]
    return np.sort(order[places(same[order]) < 2 * k])


def _products(q: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows ``i`` of ``q`` and ``j`` of ``own``: equal rows give equal products."""
    runs = range(0, len(i), PAIRS)
    return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + PAIRS]], own[j[a : a + PAIRS]]) for a in runs]) if len(i) else np.empty(0)


class Askers:
    """The queries that probe a cell, from the cells (or -1) that each query probes."""

    def __init__(self, probes: np.ndarray) -> None:
        cells = probes.ravel()
        order = np.argsort(cells, kind="stable")
        self.cells, self.queries, self.probes = cells[order], (order // max(1, probes.shape[1])).astype(np.int32), probes

    def of(self, cell: int) -> np.ndarray:
        return self.queries[np.searchsorted(self.cells, cell) : np.searchsorted(self.cells, cell, side="right")]


def _kernel(held, dims: int, rerank: int):
    last: list[Askers] = []

    def run(batch: pa.RecordBatch, query_ids: np.ndarray, prepared, best: vectors.Best) -> None:
        model = held.value
        queries, probes = prepared
        if not last or last[0].probes is not probes:
            last[:] = [Askers(probes)]
        for row in batch.to_pylist():
            asking = last[0].of(row["cell"])
            if not len(asking):
                continue
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            own = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, dims)
            able = contenders(ids, own, best.k)
            codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(len(ids), -1)[able]
            errors = np.frombuffer(row["errors"], dtype=np.float64)[able]
            ids, own = ids[able], own[able]
            centre = model["centres"][row["cell"]]
            size = np.sqrt((own**2).sum(axis=1).max())
            # What sums of single precision may be off, and products of double precision.
            slack, tiny = 1e-5 * (size + np.linalg.norm(centre) + errors.max()), 1e-15 * dims * size
            step = max(64, LOOKED // max(1, len(ids)))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                q = queries[some]
                length = np.linalg.norm(q, axis=1)
                scores = np.zeros((len(some), len(ids)), dtype=np.float32)
                for part, (r, book) in enumerate(zip(model["runs"], model["books"])):
                    table = (q[:, r] @ book.T).astype(np.float32)
                    scores += table[:, codes[:, part]]
                mine = query_ids[some][:, None] == ids[None, :]
                scores[mine] = -np.inf
                floor = best.least[some]
                # A query without a floor scores its best rows by codes first.
                bare = np.flatnonzero(np.isneginf(floor))
                n = min(max(rerank, best.k), len(ids))
                near = np.argpartition(-scores[bare], n - 1, axis=1)[:, :n]
                i, j = np.repeat(bare, n), near.ravel()
                score = np.where(mine[i, j], -np.inf, _products(q, own, i, j))
                if n >= best.k:
                    floor[bare] = np.partition(score.reshape(-1, n), n - best.k, axis=1)[:, n - best.k]
                # Every other row that may reach the k-th score: first by the error of its codes, then by its product.
                reach = floor - q @ centre
                may = ~(scores < (reach[:, None] - length[:, None] * (errors + slack)[None, :])) & ~mine
                may[i, j] = False
                rows = np.flatnonzero(may.any(axis=0))
                may = may[:, rows]
                product = np.where(may, q @ own[rows].T, -np.inf)
                if len(rows) >= best.k:
                    floor = np.maximum(floor, np.partition(product, len(rows) - best.k, axis=1)[:, len(rows) - best.k])
                more, column = np.nonzero(may & ~(product < (floor - 2 * tiny * length)[:, None]))
                other = ~mine[i, j]
                i, j, score = i[other], j[other], score[other]
                score = np.concatenate((score, _products(q, own, more, rows[column])))
                i, j = np.concatenate((i, more)), np.concatenate((j, rows[column]))
                best.add(some[i], ids[j], score)

    return run


def build(rows: DataFrame, dims: int, k: int = K, sample: int = SAMPLE, cells: int | None = None, probes: int | None = None) -> tuple[DataFrame, object]:
    """(index table, broadcast model) of all of ``rows`` (id, v)."""
    spark = rows.sparkSession
    # At most ``sample`` vectors, those with the smallest hash of their id, reach the driver.
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow().combine_chunks()
    x = vectors.matrix(taken["v"].combine_chunks(), dims)
    total = rows.count()
    # The sample is in the order of a hash. Rows that were not fitted on stand for all others; of so few, the share of the ``k`` nearest that is among them.
    held_rows = x[: int(len(x) * HELD)]
    model = fit(x[len(held_rows) :], cells or min(MOST_CELLS, max(FEWEST, total // CELL_ROWS)))
    model = with_long({**model, "spread": spread(x, model["centres"])}, x)
    count = len(model["centres"])
    near = int(min(k, max(1, round(k * len(held_rows) / max(1, total)))))
    wanted = min(probes or probes_for(model, x[len(held_rows) :][:TRIALS], held_rows, near), count)
    held = spark.sparkContext.broadcast(model)
    coded = common.written(rows.mapInArrow(_encoder(held, dims), "id long, cell int, codes binary, error double, vector binary, far double"), "coded")
    facts = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    # Rows of a large cell spread over as many tasks as it has blocks.
    tasks = F.element_at(F.create_map(*[F.lit(y) for r in facts for y in (r["cell"], common.blocks_for(r["n"], BLOCK))]), F.col("cell"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id"), tasks.cast("long")))
    index = salted.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "id").select("id", "cell", "codes", "error", "vector").mapInArrow(_blocker, INDEX)
    index = common.written(index, "cells")
    common.discard(coded)
    held.destroy()
    far = np.zeros(count)
    for r in facts:
        far[r["cell"]] = r["far"]
    return index, spark.sparkContext.broadcast({**model, "far": far, "probes": wanted, "ids": taken["id"].to_numpy(), "sample": x, "own": cells_of(model, x)})


ASKED = "id long, v array<double>, part int, cells binary, floor double, ids array<long>, scores array<double>"


def _asker(held, dims: int, k: int):
    """What a query learns from the sample: the cells to probe, the floor, and sample rows of other cells among its ``k`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sample, sample_ids, own = model["sample"], model["ids"], model["own"]
        size = np.linalg.norm(sample, axis=1).max(initial=0)
        for batch in batches:
            q, ids = vectors.matrix(batch["v"], dims), batch["id"].to_numpy()
            length = np.linalg.norm(q, axis=1)
            slack = 1e-14 * dims * length * size
            floor, told_ids, told_scores = np.full(len(q), -np.inf), [], []
            cells = np.argsort(-potential(model, q), axis=1)[:, : model["probes"]].astype(np.int16)
            for at in range(0, len(q), 128):
                scores = q[at : at + 128] @ sample.T
                scores[ids[at : at + 128, None] == sample_ids[None, :]] = -np.inf
                for i, row in enumerate(scores, start=at):
                    if len(row) > k:
                        kth = np.partition(row, len(row) - k)[len(row) - k]
                        near = np.flatnonzero((row >= kth - slack[i]) & (row > -np.inf))
                    else:
                        near = np.flatnonzero(row > -np.inf)
                    exact = _products(q, sample, np.full(len(near), i), near)
                    first = np.lexsort((sample_ids[near], -exact))[:k]
                    near, exact = near[first], exact[first]
                    if len(near) == k:
                        floor[i] = exact[-1] - slack[i]
                    outside = ~np.isin(own[near], cells[i])
                    told_ids.append(sample_ids[near[outside]])
                    told_scores.append(exact[outside])
            # No row of such a cell can reach the floor.
            centre = np.take_along_axis(q @ model["centres"].T, cells.astype(np.int64), axis=1)
            cells[centre + length[:, None] * model["far"][cells] + 1e-9 * (np.abs(centre) + length[:, None]) < floor[:, None]] = -1
            arrays = [batch["id"], batch["v"], batch["part"], pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(floor), pa.array(told_ids, pa.list_(pa.int64())), pa.array(told_scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "part", "cells", "floor", "ids", "scores"])

    return run


def nearest_neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, cells: int | None = None, probes: int | None = None, rerank: int = RERANK, query_block: int = vectors.QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that the probed cells and the sample hold of every query, by inner product, ties to
    the smaller id. ``rerank`` rows a block are scored exactly first; it is no cut, and results do not depend on it. ``cells`` follows the rows
    and ``probes`` what the sample needs, unless given.

    Vectors (or ids) that are null, zero, or hold null or non-finite components take no part; shorter vectors are filled with
    zeros. Rows that share an id are candidates each, are all the query's own, and the smallest of their vectors is
    the query. Fewer candidates than ``k``: all that the probed cells hold. An empty table gives an empty one.
    """
    spark = table.sparkSession
    common.prepare(spark)
    rows = vectors.sound(table, id_col, vector_col, zero=False)
    dims = vectors.width(rows)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, held = build(rows, dims, k, sample, cells, probes)
    queries, parts = vectors.query_table(rows, every, query_block)
    asked = common.written(queries.mapInArrow(_asker(held, dims, k), ASKED), "asked")

    def prepare(rows: pa.Table):
        cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), dtype=np.int16).reshape(len(rows), -1) if len(rows) else np.empty((0, 1), np.int16)
        return (vectors.matrix(rows["v"].combine_chunks(), dims), cells), rows["floor"].to_numpy()

    def beside(part: DataFrame) -> DataFrame:
        return part.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))

    # The kernel needs no sample rows.
    small = spark.sparkContext.broadcast({name: held.value[name] for name in ("centres", "runs", "books")})
    found = vectors.search(index, asked, parts, k, _kernel(small, dims, rerank), "double", prepare, beside)
    common.discard(index, asked)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
