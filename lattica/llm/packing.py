"""Harmonic packing into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class ``m`` holds what fits exactly ``m`` times into a sequence, and each of
its sequences takes ``m`` pieces, whatever else happens. As documents may be cut, a document is first cut into pieces
that fill their class: whole capacities, then for the rest the largest ``capacity // m`` that it holds, and so on; only a
tail of at most ``TAIL`` ids keeps a length that does not divide the capacity. The cut depends on nothing but the
length, so workers share nothing. Documents are spread over workers by a hash; a worker numbers the pieces of
a class and every ``m`` of them are a sequence. What is left over in a worker, fewer than ``m`` pieces of each class, is
bounded by the classes alone and goes into sequences by first fit in falling length.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
TAIL = 64
END_ID = 1
#: Documents of one worker, and pieces: the number of workers follows whichever asks for more.
WORKER_DOCS, WORKER_PIECES = 500_000, 3
#: Numbers of pieces by worker and class are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 50_000
CLASS_BITS, BIN_BITS = 12, 31


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(ranks_file: str, special: str = "<|endoftext|>", special_id: int = 50256):
    """The byte-level vocabulary as ranks: the ids of the same vocabulary's ``tokenizers`` file, several times faster.
    As there, the special token's string in a text is that token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})
    return encoding, special


def encode(text: str | None, ranks_file: str) -> np.ndarray:
    """The ids of a text with the end id, as little-endian unsigned 32 bits."""
    encoding, special = encoder(ranks_file)
    if not text:
        return np.array([END_ID], dtype="<u4")
    if special in text:
        ids = encoding.encode_to_numpy(text, allowed_special={special})
    else:
        ids = encoding.encode_to_numpy(text, disallowed_special=())
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


@cache
def cut(length: int, capacity: int = CAPACITY, tail: int = TAIL) -> tuple[tuple[int, int, int], ...]:
    """(start, length, class) of the pieces of the last, not full part of a document."""
    out, at = [], 0
    while length - at > tail:
        m = -(-capacity // (length - at))
        while capacity // m > length - at:
            m += 1
        out.append((at, capacity // m, m))
        at += capacity // m
    if length > at:
        out.append((at, length - at, capacity // (length - at)))
    return tuple(out)


def pieces(ids: np.ndarray, capacity: int = CAPACITY, tail: int = TAIL) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, class, crc32) of every piece of a document."""
    full = len(ids) // capacity
    view = memoryview(ids).cast("B")
    for i in range(full):
        yield i * capacity, capacity, 1, zlib.crc32(view[4 * i * capacity : 4 * (i + 1) * capacity])
    for at, n, m in cut(len(ids) - full * capacity, capacity, tail):
        at += full * capacity
        yield at, n, m, zlib.crc32(view[4 * at : 4 * (at + n)])


def _cutter(ranks_file: str, capacity: int, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text, ranks_file)
                total = len(ids)
                rows += [(doc, at, n, m, crc, total) for at, n, m, crc in pieces(ids, capacity, tail)]
            if rows:
                names = ["doc_id", "start", "length", "class", "ids_crc32", "doc_tokens"]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _leftovers(capacity: int):
    """First fit in falling length over what one worker has left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        room: list[int] = []
        place, offset = [], []
        for n in pdf["length"].tolist():
            for b, free in enumerate(room):
                if free >= n:
                    break
            else:
                b = len(room)
                room.append(capacity)
            place.append(b)
            offset.append(capacity - room[b])
            room[b] -= n
        # Class 0 marks these sequences.
        base = pdf["worker"].to_numpy(dtype=np.int64) << (CLASS_BITS + BIN_BITS)
        out = pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = base + np.array(place, dtype=np.int64)
        out["offset"] = np.array(offset, dtype=np.int64)
        return out

    return run


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def harmonic_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tail: int = TAIL, ranks_file: str | None = None, worker_docs: int = WORKER_DOCS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece. Null and empty texts have the end id alone. Rows with a null or
    repeated id are packed as rows of their own and keep that id. Ties are broken by (doc_id, start, checksum), so reruns
    agree. Sequences are to be padded to ``capacity``, except those whose ids are a power of two. An empty table gives an empty one.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cutter = _cutter(ranks_file or tokenizer_file(), capacity, tail)
    rows = source.mapInArrow(cutter, "doc_id long, start long, length long, class int, ids_crc32 long, doc_tokens long")
    # Rows repeated whole collapse and are numbered, so that they too spread over the workers.
    rows = rows.groupBy("doc_id", "start", "length", "class", "ids_crc32", "doc_tokens").count()
    rows = common.written(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count"), "pieces")
    # One piece of each document starts it. Few long documents have many pieces.
    facts = rows.agg(F.count(F.when(F.col("start") == 0, 1)).alias("docs"), F.count(F.lit(1)).alias("pieces")).first()
    workers = max(common.blocks_for(facts["docs"], worker_docs), common.blocks_for(facts["pieces"], WORKER_PIECES * worker_docs))
    rows = rows.withColumn("worker", F.pmod(F.xxhash64("doc_id", "ids_crc32", "copy"), F.lit(workers)))
    order = Window.partitionBy("worker", "class").orderBy("doc_id", "start", "ids_crc32", "copy")
    counted = rows.groupBy("worker", "class").agg(F.count(F.lit(1)).alias("there"))
    placed = rows.withColumn("rn", F.row_number().over(order) - 1).join(F.broadcast(counted) if workers * tail < BROADCAST_ROWS else counted, ["worker", "class"])
    placed = placed.withColumn("bin", F.expr("rn div class"))
    full = placed.filter((F.col("bin") + 1) * F.col("class") <= F.col("there"))
    base = F.shiftleft(F.shiftleft(F.col("worker").cast("long"), CLASS_BITS).bitwiseOR(F.col("class").cast("long")), BIN_BITS).bitwiseOR(F.col("bin"))
    # All pieces of a sequence but those of tails have one length; tails of one class may differ, so offsets are sums.
    inside = Window.partitionBy("worker", "class", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("sequence_id", base).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = placed.filter((F.col("bin") + 1) * F.col("class") > F.col("there"))
    rest = rest.groupBy("worker").applyInPandas(
        _leftovers(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return full.select(*RESULT).unionByName(rest.select(*RESULT))


def query(spark, sf_dir: str) -> DataFrame:
    return harmonic_pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


assert CAPACITY < 1 << CLASS_BITS and sys.byteorder == "little"
