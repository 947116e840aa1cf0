"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Texts become hashed features: words, word shapes (``Aa!`` for ``That!``), and how much a text repeats itself, damped and
weighted by rarity. A truncated decomposition of the labelled texts gives the latent space. The labelled vectors are
broadcast; each document's cosine with all of them is computed exactly, a block of documents at a time, and the
labels of the nearest vote with their similarity as weight.

The labelled rows are a sample of at most ``max_labelled`` (those with the smallest hash of their id), which bounds what is
broadcast and what the driver fits; all documents are scored, on their whole texts. Labels of held-out
rows (crc32 of the id as text divisible by 5) are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
BUCKETS = 8192
#: The last buckets are for what is counted about the text as a whole.
EXTRA = 8
SHARPNESS = 4.0
_SHAPES = ((re.compile(rb"[A-Z]+"), b"\x01"), (re.compile(rb"[a-z\x80-\xff]+"), b"\x02"), (re.compile(rb"[0-9]+"), b"\x03"))
_SEEN: dict[bytes, tuple[int, int]] = {}


def _buckets(word: bytes) -> tuple[int, int]:
    found = _SEEN.get(word)
    if found is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        shape = re.sub(rb"(.)\1+", rb"\1", shape, flags=re.DOTALL)
        room = BUCKETS - EXTRA
        # A quarter of the space is kept for shapes.
        found = xxhash.xxh64_intdigest(word.lower()) % (room * 3 // 4), room * 3 // 4 + xxhash.xxh64_intdigest(shape, 1) % (room // 4)
        _SEEN[word] = found
    return found


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text; empty for a text without words."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = Counter(words)
    n = len(words)
    pairs = np.array([_buckets(w) for w in counts], dtype=np.int64)
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    by_word = np.bincount(pairs[:, 0], weights=times, minlength=BUCKETS)
    by_shape = np.bincount(pairs[:, 1], weights=times, minlength=BUCKETS)
    out = np.log1p(by_word)
    out /= np.linalg.norm(out)
    shapes = np.sqrt(by_shape / n)
    out += 2.0 * shapes / np.linalg.norm(shapes)
    lines = text.split(b"\n")
    size = len(text)
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = size - len(text.translate(None, b"!#$%&*+/<=>?@[]^_{|}~"))
    out[BUCKETS - EXTRA :] = [
        min(1.0, 2.0 * sum(map(eq, words, words[1:])) / n), max(counts.values()) / n if n > 3 else 0.0, 1.0 - len(set(lines)) / len(lines),
        min(1.0, 4.0 * upper / size), min(1.0, 8.0 * marks / size), 1.0 - len(counts) / n, 1.0 / (1.0 + n / 20.0), 0.1,
    ]
    at = np.flatnonzero(out)
    return at.astype(np.int32), out[at].astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
            names=["doc_id", "quality", "at", "value"],
        )


def _dense(rows, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (at, value) in enumerate(rows):
        out[i, at] = value * weight[at]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_space(rows, labels: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """The latent space of labelled feature rows, by subspace iteration over blocks of rows, and their vectors in it."""
    seen = np.zeros(BUCKETS)
    for at, _ in rows:
        seen[at] += 1
    weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32)
    weight[BUCKETS - EXTRA :] = 1.0
    weight[BUCKETS * 3 // 4 - EXTRA : BUCKETS - EXTRA] = np.minimum(weight[BUCKETS * 3 // 4 - EXTRA : BUCKETS - EXTRA], 3.0) + 0.3
    wide = min(dimensions + 16, max(1, len(rows)))
    base = np.random.Generator(np.random.PCG64(1)).standard_normal((BUCKETS, wide)).astype(np.float32)
    for _ in range(4):
        new = np.zeros_like(base)
        for i in range(0, len(rows), 256):
            block = _dense(rows[i : i + 256], weight)
            new += block.T @ (block @ base)
        base, _ = np.linalg.qr(new)
    # Rotate to the principal directions.
    small = np.concatenate([_dense(rows[i : i + 256], weight) @ base for i in range(0, len(rows), 256)])
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    project = base @ turn[:dimensions].T
    return {"project": weight[:, None] * project, "vectors": _unit(small @ turn[:dimensions].T), "labels": labels.astype(np.float32)}


def vote(model: dict, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The weighted share of label 1 among the nearest labelled vectors of each of ``vectors`` (unit length or zero)."""
    labels, prior = model["labels"], float(model["labels"].mean())
    cosine = vectors @ model["vectors"].T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    share = (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
    return np.clip(np.where(total > 1e-9, share, prior), 0.0, 1.0)


def score_texts(model: dict | None, texts: list[bytes | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    vectors = np.zeros((len(texts), model["project"].shape[1]), dtype=np.float32)
    for i, x in enumerate(texts):
        at, value = features(x)
        if len(at):
            vectors[i] = value @ model["project"][at]
    return vote(model, _unit(vectors))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """(id, text, quality) of the sample the model is fitted on."""
    own = labels.filter(F.col("quality").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    own = own.groupBy(F.col("doc_id").alias("own_id")).agg(F.avg(F.col("quality").cast("double")).alias("own_label"))
    sample = own.orderBy(F.xxhash64("own_id"), "own_id").limit(max_labelled)
    # At most max_labelled rows of 16 bytes are broadcast.
    found = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), F.col("i") == F.col("own_id"))
    return found.select("i", "t", F.col("own_label").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict | None:
    """The model, or None where no labelled row has a text with words. What the driver gathers is bounded by ``max_labelled``."""
    common.prepare(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col, max_labelled).mapInArrow(_featured, "doc_id long, quality double, at binary, value binary")
    # Repeated documents could exceed the bound, so it holds here too.
    found = rows.filter(F.length("at") > 0).orderBy(F.xxhash64("doc_id"), "doc_id", "at", "value").limit(max_labelled).collect()
    if not found:
        return None
    pairs = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]
    return fit_space(pairs, np.array([r["quality"] for r in found]))


def with_score(docs: DataFrame, model: dict | None, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every row's text: 0 to 1. A null text or one without words gets the share of label 1
    among the labelled; without any label every score is 0.5. Other columns pass unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(held.value, text.cast(pa.binary()).to_pylist()), type=pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``; all columns unchanged."""
    [score] = common.fresh(docs, "score")
    return with_score(docs, fit(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) >= threshold).drop(score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = with_score(docs, model, "text", "score")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
