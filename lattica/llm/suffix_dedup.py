"""Exact repeats over bytes by the interval tree of an enhanced suffix array.

A block holds all suffixes whose first ``k`` bytes have an anchor of the block, so every common-prefix interval of
``k`` or more is whole within one block. The suffixes are sorted, their common prefixes with the neighbour above are
scanned with a stack, and each interval closed by the scan is a right-maximal repeat with all its occurrences. An
interval is left-maximal when the bytes to the left of its occurrences differ (or an occurrence stands first in its
phrase, where the block cannot see to the left); those intervals are the maximal repeat groups. In each of them the earliest
occurrence stays, and every other is a span of the group's length. Other intervals give no span: a longer group, further left, covers
the same occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common, repeats

K = 100
RESULT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary,kept_sha256:string>"


def no_split(text: bytes) -> bytes:
    return text


def byte_symbols(text: bytes) -> np.ndarray:
    return anchors.BYTE_SYMBOLS[np.frombuffer(text, dtype=np.uint8)]


def cut_bytes(text: bytes, start: int, end: int) -> bytes:
    return text[start:end]


def suffix_array(block: pd.DataFrame, k: int):
    """The suffixes of a block's classes as ``repeats.sorted_suffixes`` has them: arrays (class, offset, copy, byte to the left or -1) in order, their
    common prefixes, and the rank of their places in the corpus."""
    owner, offset, copy, _, prefix = repeats.sorted_suffixes(block, k, no_split, byte_symbols, 1)
    lengths = np.array([len(x) for x in block["piece"]], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    buffer = np.frombuffer(b"".join(map(bytes, block["piece"])) + b"\0", dtype=np.uint8)
    before = np.where(offset > 0, buffer[np.maximum(base[owner] + offset - 1, 0)].astype(np.int64), -1)
    docs, starts = block["doc"].to_numpy()[owner], (block["span"].to_numpy() >> repeats.LOW)[owner] + offset
    rank = np.empty(len(owner), dtype=np.int64)
    rank[np.lexsort((copy, starts, docs))] = np.arange(len(owner))
    return owner, offset, copy, before, prefix, rank


def intervals(prefix: np.ndarray, rank: np.ndarray, before: np.ndarray, k: int):
    """Yield each common-prefix interval of at least ``k``, children before parents: (first row, last row, length,
    earliest row, rows that were earliest in a child and are not here, left-maximal)."""
    stack: list[list] = []
    n = len(prefix)
    prefixes, ranks, left = prefix.tolist(), rank.tolist(), before.tolist()
    for i in range(n + 1):
        value = prefixes[i] if 0 < i < n else 0
        # The row before i, as a child to be: (first row, earliest row, byte to the left or None when they differ)
        if i:
            child = [i - 1, i - 1, left[i - 1] if left[i - 1] >= 0 else None]
            while stack and stack[-1][0] > value:
                length, members = stack.pop()
                members.append(child)
                child, losers = _close(members, ranks)
                yield child[0], i - 1, length, child[1], losers, child[2] is None
            if value >= k:
                if stack and stack[-1][0] == value:
                    stack[-1][1].append(child)
                else:
                    stack.append([value, [child]])


def _close(members: list[list], ranks: list[int]) -> tuple[list, list[int]]:
    best = min((m[1] for m in members), key=ranks.__getitem__)
    bytes_left = {m[2] for m in members}
    one = bytes_left.pop() if len(bytes_left) == 1 else None
    return [members[0][0], best, one], [m[1] for m in members if m[1] != best]


def _kernel(block: pd.DataFrame, k: int) -> dict[int, tuple[list, list]]:
    """The spans of maximal repeat groups. A group that is not left-maximal gives none: the byte to the left is the same at
    all its occurrences, so a longer group covers each of them."""
    owner, offset, copy, before, prefix, rank = suffix_array(block, k)
    length = np.zeros(len(owner), dtype=np.int64)
    for _, _, common_prefix, _, losers, maximal in intervals(prefix, rank, before, k):
        if maximal:
            for row in losers:
                length[row] = common_prefix
    lost = np.flatnonzero(length)
    return repeats.joined_spans(owner[lost], copy[lost], offset[lost], length[lost])


def repeat_groups(block: pd.DataFrame, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeat groups of a block (doc, span, piece): (length, all occurrences (doc, start), earliest first)."""
    block = block.sort_values(["doc", "span"], kind="stable").reset_index(drop=True)
    owner, offset, _, before, prefix, rank = suffix_array(block, k)
    docs, starts = block["doc"].to_numpy()[owner], (block["span"].to_numpy() >> repeats.LOW)[owner] + offset
    found = []
    for a, b, length, _, _, maximal in intervals(prefix, rank, before, k):
        if maximal:
            found.append((length, sorted((int(docs[i]), int(starts[i])) for i in range(a, b + 1))))
    return found


def _tree(k: int):
    """The interval tree of a block, one row an occurrence, in the deepest interval that holds it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        # Copies are joined afterwards, so a class stands for itself alone here.
        pdf = pdf.sort_values(["doc", "span"], kind="stable").drop_duplicates(["anchor", "phrase"]).reset_index(drop=True).assign(again=False)
        owner, offset, _, before, prefix, rank = suffix_array(pdf, k)
        own = np.full(len(owner), -1, dtype=np.int64)
        length, maximal, parent, open_ = [], [], [], []
        for a, b, n, _, _, left in intervals(prefix, rank, before, k):
            part = own[a : b + 1]
            part[part < 0] = len(length)
            while open_ and open_[-1][0] >= a:
                parent[open_.pop()[1]] = len(length)
            open_.append((a, len(length)))
            length.append(n)
            maximal.append(left)
            parent.append(-1)
        held = np.flatnonzero(own >= 0)
        # A group whose occurrences are all in longer groups has one row without a place.
        bare = np.setdiff1d(np.arange(len(length)), own[held])
        g = np.concatenate((own[held], bare))
        name = lambda x: np.where(x >= 0, (np.int64(block) << 32) | x, -1)
        place = lambda x: pd.array([*x[held].tolist(), *[None] * len(bare)], dtype="Int64")
        return pd.DataFrame(
            {
                "group": name(g), "parent": name(np.array(parent, dtype=np.int64)[g]), "length": np.array(length, dtype=np.int64)[g], "maximal": np.array(maximal, dtype=bool)[g],
                "anchor": place(pdf["anchor"].to_numpy()[owner]), "phrase": place(pdf["phrase"].to_numpy()[owner]), "offset": place(offset),
            }
        )

    return run


def repeat_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, **sizes) -> DataFrame:
    """(group, parent, length, maximal, doc_id, start): the repeat groups with all their occurrences.

    A group is a common-prefix interval: a text of ``length`` bytes (within its phrases) and everywhere it stands. An occurrence is listed once,
    under the longest group that it belongs to; it belongs to the parents of that group too, so the table grows with the occurrences and
    not with the depth of the tree; a group all of whose occurrences are in longer groups has one row with a null place. ``maximal``: the bytes to the left differ, so no longer group covers this one. Phrases that stand at
    several places as wholes are one group each (no parent). Of anchors with too many phrases for a block, the groups are those of ``k`` bytes.
    See ``suffix_dedup`` for nulls, repeated rows and empty input.
    """
    common.prepare(docs.sparkSession)
    own = spec(k, **sizes)
    rows = repeats.one_row_each(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
    found = repeats.candidates(rows, own)
    kept, n = repeats.class_table(found, own)
    places = common.spread_join(found, kept.select("anchor", "phrase", "n", "again"), ["anchor", "phrase"], "n")
    start = F.shiftright("span", repeats.LOW)
    group = F.concat_ws(":", F.hex("anchor"), F.hex("phrase"))
    out = places.filter("again").select(
        group.alias("group"), F.lit(None).cast("string").alias("parent"), (F.col("span").bitwiseAND((1 << repeats.LOW) - 1) + (k - 1)).alias("length"), F.lit(True).alias("maximal"),
        F.col("doc").alias("doc_id"), start.alias("start"),
    )
    pieces = repeats.fetched(rows, kept, own)
    if n.get(False):
        tree = repeats.blocked(pieces.filter("NOT hot"), own, n[False]).groupBy("block").applyInPandas(_tree(k), "group long, parent long, length long, maximal boolean, anchor long, phrase long, offset long")
        # Each class stands for its copies, which hold the same occurrence at the same offset.
        tree = tree.join(places.select("anchor", "phrase", "doc", "span"), ["anchor", "phrase"], "left")
        out = out.unionByName(
            tree.select(
                F.col("group").cast("string").alias("group"), F.when(F.col("parent") >= 0, F.col("parent").cast("string")).alias("parent"), "length", "maximal", F.col("doc").alias("doc_id"), (start + F.col("offset")).alias("start"),
            )
        )
    if n.get(True):
        windows = common.written(repeats.hot_windows(pieces.filter("hot"), own), "windows")
        again = common.written(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "again")
        hot = common.spread_join(windows, again, ["h1", "h2"], "many")
        out = out.unionByName(
            hot.select(F.concat_ws(":", F.hex("h1"), F.hex("h2"), F.lit("w")).alias("group"), F.lit(None).cast("string").alias("parent"), F.lit(k).cast("long").alias("length"), F.lit(True).alias("maximal"), F.col("doc").alias("doc_id"), "start")
        )
    return out


def spec(k: int = K, block_rows: int = 8_000, hot_variants: int = 20_000) -> repeats.Spec:
    q = max(1, min(24, k // 4))
    return repeats.Spec(k, q, no_split, byte_symbols, cut_bytes, _kernel, False, False, block_rows, hot_variants)


def _keep(with_text: bool):
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for x, own in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            x = x or b""
            kept, at, removed, found = [], 0, 0, repeats.merged(own)
            for a, b in found:
                b = min(b, len(x))
                if a < b:
                    kept.append(x[at:a])
                    removed += b - a
                    at = b
            kept.append(x[at:])
            joined = b"".join(kept)
            rows.append((len(x), removed, len(found), joined if with_text else None, hashlib.sha256(joined).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return F.arrow_udf(run, RESULT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, with_text: bool = True, **sizes) -> DataFrame:
    """``docs`` with a struct column ``dedup`` (n_bytes, n_removed, n_spans, kept, kept_sha256).

    Removed is every byte covered by ``k`` bytes that also start earlier: in a document of smaller id, or earlier in
    the same. ``kept`` is binary, as a cut may split a character (null unless ``with_text``). All other columns pass
    unchanged; a column named ``dedup`` is replaced. Null text: empty. Null id: takes no part, nothing is removed. Rows
    repeated whole are one document, so they do not remove each other; rows that share an id with different texts are
    one document too: both lose the spans of either. An empty table gives an empty one.
    """
    key, spans = common.fresh(docs, "id", "spans")
    own = repeats.spans(docs.select(F.col(id_col).cast("long"), F.col(text_col)), spec(k, **sizes)).toDF(key, spans)
    joined = docs.join(own.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(key), "left")
    return joined.withColumn("dedup", _keep(with_text)(F.col(text_col), F.col(spans))).drop(key, spans)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup(docs, with_text=False)
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", "dedup.kept_sha256")


# Bytes as hexadecimal digits, which SQL can cut; strings of 100 bytes by their MD5 digest, each with its earliest place.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), h AS (
  SELECT doc_id, octet_length(b) AS n, hex(b) AS h FROM d
), parts AS (
  SELECT doc_id, c, n, substr(h, 2 * c + 1, 698) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 250)) AS c FROM h WHERE n >= 100)
), s AS (
  SELECT doc_id, c + unnest(range(1, least(251, n - c - 98))) AS p, unnest(list_transform(range(1, least(251, n - c - 98)), lambda i: md5(substr(h, 2 * i - 1, 200)))) AS win FROM parts
), f AS (
  SELECT win, min(struct_pack(d := doc_id, p := p)) AS first FROM s GROUP BY win HAVING count(*) > 1
), dup AS (
  SELECT doc_id, p FROM s JOIN f USING (win) WHERE first.d < doc_id OR first.p < p
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM dup)) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM runs
), told AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS rest, list(struct_pack(x := since, y := a) ORDER BY a) AS kept FROM gaps GROUP BY doc_id
)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(kept, lambda k: substr(h, 2 * k.x - 1, 2 * (k.y - k.x))), ''), '') || substr(h, 2 * coalesce(rest, 1) - 1))) AS kept_sha256
FROM h LEFT JOIN told USING (doc_id)
"""
