"""Substring dedup over words by relative Lempel-Ziv parsing.

Every document is parsed greedily into factors, each the longest copy of text in a document with a smaller id, against reference
blocks that index the whole corpus. Blocks are routed by content: a phrase of a document is parsed against exactly the block
that holds all phrases with its anchor; any other block shares none of its windows of 50 words. A block indexes its text by a
sorted array of suffixes, in which the longest factor at any place is found by a stack. A factor of at least ``k`` words is
a duplicate span. Where a factor ends, the windows that straddle its end are looked up one by one, as text that crosses the end
may be copied from another source; a new factor starts at the first that is found. So the covered
words are exactly those inside a window of ``k`` words that also starts in a document with a smaller id. Equal phrases
are parsed once, for all their places. Factors end with their phrase; a longer repeat is a chain of them, whose spans join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

K = 50
RESULT = "struct<n_words:long,n_removed:long,n_spans:long,kept:string,kept_sha256:string>"


def words(text: bytes) -> list[bytes]:
    """The runs of bytes other than space and 0x09-0x0D."""
    return text.split()


def word_symbols(units: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, units), dtype=np.uint64, count=len(units))


def cut_words(units: list[bytes], start: int, end: int) -> bytes:
    return b" ".join(units[start:end])


def longest_earlier(key: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order the longest prefix that it shares with one of smaller key, and which that is (or -1).

    The best on either side is the nearest of smaller key, as common prefixes only shrink with the distance; a stack finds it.
    """
    n = len(key)
    keys, length, source = key.tolist(), [0] * n, [-1] * n
    for rows, shared in ((range(n), prefix.tolist()), (range(n - 1, -1, -1), [*prefix[1:].tolist(), 0])):
        stack: list[tuple[int, int]] = []
        for r in rows:
            own, same = keys[r], shared[r]
            while stack and keys[stack[-1][0]] >= own:
                same = min(same, stack.pop()[1])
            if stack and same > length[r]:
                length[r], source[r] = same, stack[-1][0]
            stack.append((r, same))
    return np.array(length, dtype=np.int64), np.array(source, dtype=np.int64)


def parsed(block: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The factors of at least ``k`` words of a block's classes, in order of doc: (class, copy, start, length, source class,
    source start). A class is parsed against all text of smaller documents, and its copies (``copy`` 1) once for all of them
    against that and its first place. At each position that a factor may start the longest is taken."""
    owner, offset, copy, _, prefix = repeats.sorted_suffixes(block, k, words, word_symbols, 4)
    if not len(owner):
        return
    doc = np.unique(block["doc"].to_numpy(), return_inverse=True)[1][owner]
    length, source = longest_earlier(2 * doc + copy, prefix)
    hit = np.flatnonzero(length >= k)
    hit = hit[np.lexsort((offset[hit], copy[hit], owner[hit]))]
    group = 2 * owner[hit] + copy[hit]
    edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(hit)])) if len(hit) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at = offset[hit[a:b]]
        reached = 0
        while reached < b - a:
            row = int(hit[a + reached])
            n, s = int(length[row]), int(source[row])
            yield int(owner[row]), int(copy[row]), int(at[reached]), n, int(owner[s]), int(offset[s])
            # Windows wholly inside the factor are covered; the next to try is the first found across its end.
            reached = int(np.searchsorted(at, at[reached] + max(n - k + 1, 1)))


def factors(block: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The long factors (doc, start, length, source doc, source start) of a block's classes (doc, span, piece)."""
    block = block.sort_values(["doc", "span"], kind="stable").reset_index(drop=True)
    docs, starts = block["doc"].to_numpy(), block["span"].to_numpy() >> repeats.LOW
    for i, copy, at, length, s, from_ in parsed(block, k):
        if not copy:
            yield int(docs[i]), int(starts[i]) + at, length, int(docs[s]), int(starts[s]) + from_


def _kernel(block: pd.DataFrame, k: int) -> dict[int, tuple[list, list]]:
    found = list(parsed(block, k))
    if not found:
        return {}
    owner, copy, at, length = (np.array(x, dtype=np.int64) for x in list(zip(*found))[:4])
    return repeats.joined_spans(owner, copy, at, length)


def spec(k: int = K, block_rows: int = 6_000, hot_variants: int = 20_000) -> repeats.Spec:
    q = max(1, min(6, k // 4))
    return repeats.Spec(k, q, words, word_symbols, cut_words, _kernel, True, True, block_rows, hot_variants)


def _keep(with_text: bool):
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for x, own in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            units = words(x) if x is not None else []
            found = repeats.merged(own)
            kept, at, removed = [], 0, 0
            for a, b in found:
                b = min(b, len(units))
                if a < b:
                    kept += units[at:a]
                    removed += b - a
                    at = b
            kept += units[at:]
            joined = b" ".join(kept)
            rows.append((len(units), removed, len(found), joined if with_text else None, hashlib.sha256(joined).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        arrays = [pa.array(c, type=t) for c, t in zip(cols, types)]
        arrays[3] = arrays[3].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, names=["n_words", "n_removed", "n_spans", "kept", "kept_sha256"])

    return F.arrow_udf(run, RESULT)


def rlz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, with_text: bool = True, **sizes) -> DataFrame:
    """``docs`` with a struct column ``dedup`` (n_words, n_removed, n_spans, kept, kept_sha256).

    ``kept`` is the words left, joined by one space (null unless ``with_text``). All other columns pass unchanged;
    a column named ``dedup`` is replaced. Null text: no words. Null id: takes no part, nothing is removed. Texts of
    fewer than ``k`` words: nothing is removed. Rows repeated whole are one document and keep or lose the same words;
    rows that share an id with different texts are treated as one document too: both lose the spans of either.
    An empty table gives an empty one.
    """
    key, spans = common.fresh(docs, "id", "spans")
    own = repeats.spans(docs.select(F.col(id_col).cast("long"), F.col(text_col)), spec(k, **sizes)).toDF(key, spans)
    joined = docs.join(own.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(key), "left")
    return joined.withColumn("dedup", _keep(with_text)(F.col(text_col), F.col(spans))).drop(key, spans)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rlz_dedup(docs, with_text=False)
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.n_spans", "dedup.kept_sha256")


# Windows as text, each with the smallest document it stands in.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS win FROM d WHERE len(w) >= 50
), f AS (
  SELECT win, min(doc_id) AS first FROM s GROUP BY win
), dup AS (
  SELECT doc_id, p FROM s JOIN f USING (win) WHERE first < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d
), cov AS (
  SELECT doc_id, word.p AS p, x, coalesce(max(CASE WHEN dup.p IS NOT NULL THEN 1 END) OVER (PARTITION BY doc_id ORDER BY word.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM word LEFT JOIN dup USING (doc_id, p)
), told AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept FROM cov GROUP BY doc_id
), runs AS (
  SELECT doc_id, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans FROM (SELECT doc_id, gone, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM cov) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
