"""The dataflow that both substring operators share: phrases -> classes -> blocks -> spans.

1. Every document is cut into phrases (``anchors.py``). Anchors met at two places (``across_docs``: in two documents)
   stay; the rest of the corpus can hold no repeat and is out of the game before anything wide is shuffled.
2. Equal phrases are one class: (anchor, phrase hash), 128 bits, with its first place and whether there are later ones.
   Thousands of copies of a passage collapse into a class by a pre-aggregating ``min`` before any text moves.
3. The text of each class is fetched once and goes to the reference block of its anchor. A kernel (factor parsing for
   words, the interval tree of an enhanced suffix array for bytes) finds there what of the class repeats earlier text, for its first
   place and for its copies, and nothing else makes a span. Hashes route; a block holds a bounded number of classes.
4. What was found for a class holds for all its places, by an equi-join on the class.

An anchor with more classes than ``hot_variants`` does not fit in a block. The texts of its classes are cut again,
into single windows, which are classes of their own: 128-bit hashes with the first place of each by a pre-aggregating
``min``. That is exact too and has no group in any one task. Their texts come with the same fetch, spread over all blocks, which
pass them on: a second fetch would move all documents again. Joins on keys that may be hot are spread (``common.spread_join``).

Positions are counted in symbols (words or bytes) from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

#: A phrase's span is packed as start * 2**18 + windows; a phrase has at most k - q + 1 windows.
LOW = 18
#: A repeat is packed as start * 2**31 + length.
LONG = 31
FOUND = "anchor long, phrase long, doc long, span long, n long, own array<long>, later array<long>, piece binary"
_PIECES = "anchor long, phrase long, doc long, span long, n long, again boolean, hot boolean, piece binary"


@dataclass(frozen=True)
class Spec:
    """What differs between words and bytes. ``split`` gives the units of a text and ``symbols`` their 64-bit symbols;
    ``kernel`` takes a block of classes (doc, span, again, piece) and gives for each the repeats (start, length) in its first
    place and in its copies; ``across_docs``: only another document counts; ``keep_phrases``: all phrases are written
    once, where they are few against the text, and not computed for each of their two uses."""

    k: int
    q: int
    split: Callable
    symbols: Callable
    cut: Callable
    kernel: Callable
    across_docs: bool
    keep_phrases: bool
    block_rows: int
    hot_variants: int


def _phrase_batches(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            rows = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if doc is None or text is None:
                    continue
                anchor, whole, start, n = anchors.phrases(spec.symbols(spec.split(text)), spec.k, spec.q)
                if not len(anchor):
                    continue
                for to, x in zip(out, (anchor, whole, np.full(len(anchor), doc, dtype=np.int64), (start << LOW) | n)):
                    to.append(x)
                rows += len(anchor)
                if rows > 100_000:
                    yield _batch(out)
                    out, rows = [[], [], [], []], 0
            if rows:
                yield _batch(out)

    return run


def _batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["anchor", "phrase", "doc", "span"])


def phrase_table(docs: DataFrame, spec: Spec) -> DataFrame:
    """(anchor, phrase, doc, span) of every phrase of ``docs`` (doc, text)."""
    return docs.mapInArrow(_phrase_batches(spec), "anchor long, phrase long, doc long, span long")


def candidates(docs: DataFrame, spec: Spec) -> DataFrame:
    """The phrases whose anchor stands at two places, as a written table."""
    rows = phrase_table(docs, spec)
    tables = []
    if spec.keep_phrases:
        rows = common.written(rows, "all-phrases")
        tables.append(rows)
    met = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    met = common.written(met.filter("a < b" if spec.across_docs else "n > 1").select("anchor", "n"), "met")
    out = common.written(common.spread_join(rows, met, ["anchor"], "n").select("anchor", "phrase", "doc", "span"), "phrases")
    common.discard(met, *tables)
    return out


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, text) without null ids, and rows repeated whole once: they are one document."""
    docs = docs.filter(F.col("doc").isNotNull())
    if docs.groupBy("doc").count().filter("count > 1").limit(1).count():
        docs = docs.groupBy("doc", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text")).select("doc", "text")
    return docs


def _pieces_of(spec: Spec):
    """The texts of the classes wanted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if text is None:  # another row of this id
                    continue
                units = spec.split(text)
                for x in wanted:
                    start, n = x["span"] >> LOW, x["span"] & ((1 << LOW) - 1)
                    if start + n + spec.k - 1 > len(units):  # another row of this id
                        continue
                    piece = spec.cut(units, start, start + n + spec.k - 1)
                    rows.append((x["anchor"], x["phrase"], doc, x["span"], x["n"], x["again"], x["hot"], piece))
                    size += len(piece)
                if size > 4 << 20:
                    yield _pieces(rows)
                    rows, size = [], 0
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows) -> pa.RecordBatch:
    types = (*[pa.int64()] * 5, *[pa.bool_()] * 2, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _PIECES.split(", ")])


def packed(spans: list[tuple[int, int]]) -> list[int]:
    return [(int(a) << LONG) | int(n) for a, n in spans]


def _block(spec: Spec):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        crowded, pdf = pdf[pdf["hot"]], pdf[~pdf["hot"]]
        # A class is here once, but for rows of one id with different texts.
        pdf = pdf.sort_values(["doc", "span", "anchor", "phrase"], kind="stable").drop_duplicates(["anchor", "phrase"]).reset_index(drop=True)
        found = spec.kernel(pdf, spec.k) if len(pdf) else {}
        out = pdf.loc[list(found), ["anchor", "phrase", "doc", "span", "n"]].copy()
        for i, name in enumerate(("own", "later")):
            out[name] = pd.Series([packed(x[i]) for x in found.values()], index=out.index, dtype=object)
        out["piece"] = None
        if len(crowded):
            out = pd.concat([out, crowded[["anchor", "phrase", "doc", "span", "n", "piece"]].assign(own=None, later=None)[list(out.columns)]])
        return out

    return run


def sorted_suffixes(block: pd.DataFrame, k: int, split: Callable, symbols: Callable, unit: int) -> tuple[np.ndarray, ...]:
    """The enhanced suffix array of a block of classes: (class, offset, copy, symbols left, prefix) in order of the suffixes.

    Listed are suffixes whose first ``k`` symbols stand at two places of the block, and of a class with copies (``again``) the
    whole phrase twice: its first place and, with ``copy`` 1, all others. Further suffixes of the copies would have the
    same symbol before them as those of the first place, so they begin no group or factor of their own. ``prefix`` is the common
    prefix with the suffix before, found by comparing the symbols themselves. ``unit``: bytes of a symbol in that comparison.
    """
    texts = [symbols(split(bytes(x))) for x in block["piece"]]
    again = block["again"].to_numpy(dtype=bool) if "again" in block else np.zeros(len(texts), dtype=bool)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    whole = np.concatenate(texts) if len(texts) else np.empty(0, np.uint64)
    n = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    if not len(owner):
        return owner, offset, offset, offset, offset
    _, inverse, count = np.unique(anchors.window_hashes(whole, k, 0)[base[owner] + offset], return_inverse=True, return_counts=True)
    first = again[owner] & (offset == 0)
    listed = np.flatnonzero((count[inverse] > 1) | first)
    copies = np.flatnonzero(first)
    copy = np.concatenate((np.zeros(len(listed), dtype=np.int64), np.ones(len(copies), dtype=np.int64)))
    listed = np.concatenate((listed, copies))
    owner, offset = owner[listed], offset[listed]
    left = lengths[owner] - offset
    if not len(owner):
        return owner, offset, copy, left, left
    # Suffixes sort by their first ``k`` symbols (a number each) and then by what follows; symbols as ranks within the block are a few bytes.
    ranks = (np.unique(whole, return_inverse=True)[1] + 1).astype(f">u{unit}") if unit > 1 else np.frombuffer(b"".join(map(bytes, block["piece"])), dtype=np.uint8)
    wide = int((left - k).max()) * unit
    buffer = np.concatenate((ranks.view(np.uint8), np.zeros(wide + 1, dtype=np.uint8)))
    rows = np.empty((len(owner), 4 + wide), dtype=np.uint8)
    rows[:, :4] = (inverse[listed] + 1).astype(">u4").view(np.uint8).reshape(-1, 4)
    tails = np.lib.stride_tricks.sliding_window_view(buffer, max(wide, 1))
    at = (base[owner] + offset) * unit
    for a in range(0, len(rows), 1 << 15):
        part = slice(a, a + (1 << 15))
        if wide:
            rows[part, 4:] = tails[at[part] + k * unit]
            rows[part, 4:][np.arange(wide) >= ((left[part] - k) * unit)[:, None]] = 0
    # Stable: equal suffixes stay in the order of their places.
    order = np.argsort(rows.view(f"S{4 + wide}").ravel(), kind="stable")
    owner, offset, copy, left, at = owner[order], offset[order], copy[order], left[order], at[order]
    prefix = np.zeros(len(rows), dtype=np.int64)
    heads = np.lib.stride_tricks.sliding_window_view(buffer, k * unit)
    for a in range(1, len(rows), 1 << 14):
        b = min(a + (1 << 14), len(rows))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + wide) - 4
        # The first symbols are compared themselves, not by their numbers.
        equal = (same >= 0) & (heads[at[a:b]] == heads[at[a - 1 : b - 1]]).all(axis=1)
        prefix[a:b] = np.where(equal, np.minimum(k + same // unit, np.minimum(left[a:b], left[a - 1 : b - 1])), 0)
    return owner, offset, copy, left, prefix


def joined_spans(owner: np.ndarray, copy: np.ndarray, offset: np.ndarray, length: np.ndarray) -> dict[int, tuple[list, list]]:
    """class -> (repeats of its first place, of its copies), each the maximal runs (start, length) of what is given."""
    out: dict[int, tuple[list, list]] = {}
    order = np.lexsort((offset, copy, owner))
    for c, again, a, n in zip(*(x[order].tolist() for x in (owner, copy, offset, length))):
        runs = out.setdefault(c, ([], []))[again]
        if runs and a <= runs[-1][0] + runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], a + n - runs[-1][0]))
        else:
            runs.append((a, n))
    return out


def _windows_of(spec: Spec):
    """(h1, h2, start, doc, span) of the windows of class texts; ``start`` counts in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, span, text in zip(*(batch[c].to_pylist() for c in ("doc", "span", "piece"))):
                symbols = spec.symbols(spec.split(text))
                a, b = (anchors.window_hashes(symbols, spec.k, base) for base in (0, 1))
                if len(a):
                    same = [pa.array(np.full(len(a), x)) for x in (doc, span)]
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array((span >> LOW) + np.arange(len(a))), *same], names=["h1", "h2", "start", "doc", "span"])

    return run


def hot_windows(pieces: DataFrame, spec: Spec) -> DataFrame:
    """The windows of the texts ``pieces`` of crowded anchors' classes."""
    return pieces.select("doc", "span", "piece").mapInArrow(_windows_of(spec), "h1 long, h2 long, start long, doc long, span long")


def blocked(pieces: DataFrame, spec: Spec, rows: int) -> DataFrame:
    """The classes by reference block: ``block`` follows from the anchor; those that are hot go to all blocks alike."""
    route = F.when(F.col("hot"), F.xxhash64("anchor", "phrase")).otherwise(F.xxhash64("anchor"))
    return pieces.withColumn("block", F.pmod(route, F.lit(common.blocks_for(rows, spec.block_rows))))


def class_table(found: DataFrame, spec: Spec) -> tuple[DataFrame, dict[bool, int]]:
    """(written (anchor, phrase, doc, span, n, again, hot) of the classes that can hold a repeat, their numbers by ``hot``)."""
    place = F.struct("doc", "span")
    classes = found.groupBy("anchor", "phrase").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    again = F.col("last.doc") > F.col("first.doc") if spec.across_docs else F.col("last") > F.col("first")
    classes = common.written(classes.select("anchor", "phrase", "first.doc", "first.span", "n", again.alias("again")), "classes")
    several = common.written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")), "variants")
    kept = common.spread_join(classes, several, ["anchor"], "variants").filter("again OR variants > 1")
    kept = kept.select("anchor", "phrase", "doc", "span", "n", "again", (F.col("variants") > spec.hot_variants).alias("hot"))
    kept = common.written(kept, "kept")
    common.discard(classes, several)
    return kept, {r["hot"]: r["count"] for r in kept.groupBy("hot").count().collect()}


def fetched(docs: DataFrame, kept: DataFrame, spec: Spec) -> DataFrame:
    """``kept`` with the text ``piece`` of each class, taken from its first place."""
    wanted = kept.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("anchor", "phrase", "span", "n", "again", "hot")).alias("wanted"))
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc") == F.col("d")).select("doc", "text", "wanted")
    return texts.mapInArrow(_pieces_of(spec), _PIECES)


def _hot_found(kept: DataFrame, pieces: DataFrame, spec: Spec) -> DataFrame:
    """A written table of what repeats in the classes of crowded anchors: windows that stand earlier, and all of every copy."""
    windows = common.written(hot_windows(pieces, spec), "windows")
    lead = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("many"))
    lead = common.written(lead.filter("many > 1"), "leads")
    later = F.col("doc") > F.col("f.doc")
    if not spec.across_docs:
        later = later | ((F.col("doc") == F.col("f.doc")) & (F.col("start") > F.col("f.start")))
    key = ["doc", "span"]
    repeat = F.shiftleft(F.col("start") - F.shiftright("span", LOW), LONG).bitwiseOR(F.lit(spec.k).cast("long"))
    own = common.spread_join(windows, lead, ["h1", "h2"], "many").filter(later).groupBy(*key).agg(F.collect_list(repeat).alias("own"))
    whole = F.array(F.col("span").bitwiseAND((1 << LOW) - 1) + (spec.k - 1))
    empty = F.array().cast("array<long>")
    out = kept.filter("hot").join(own, key, "left").select("anchor", "phrase", *key, "n", F.coalesce("own", empty).alias("own"), F.when(F.col("again"), whole).otherwise(empty).alias("later"))
    out = common.written(out, "hot-repeats")
    common.discard(windows, lead)
    return out


def spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """A written table (d, spans): what in each document repeats earlier text, packed as start * 2**31 + length.
    ``docs`` is (doc, text)."""
    common.prepare(docs.sparkSession)
    docs = one_row_each(docs.toDF("doc", "text"))
    found = candidates(docs, spec)
    kept, sizes = class_table(found, spec)
    read = [common.written(blocked(fetched(docs, kept, spec), spec, sum(sizes.values())).groupBy("block").applyInPandas(_block(spec), FOUND), "repeats")]
    told = read[0].filter("piece IS NULL").drop("piece")
    if sizes.get(True):
        read.append(_hot_found(kept, read[0].filter("piece IS NOT NULL"), spec))
        told = told.unionByName(read[1])
    told = told.withColumnsRenamed({"doc": "f_doc", "span": "f_span"})
    common.discard(kept)
    first = F.col("doc") == F.col("f_doc")
    if not spec.across_docs:
        first = first & (F.col("span") == F.col("f_span"))
    at = F.shiftleft(F.shiftright("span", LOW), LONG)
    some = common.spread_join(found, told, ["anchor", "phrase"], "n").select("doc", at.alias("at"), F.when(first, F.col("own")).otherwise(F.col("later")).alias("s"))
    some = some.filter(F.size("s") > 0).select("doc", F.transform("s", lambda x: x + F.col("at")).alias("s"))
    out = common.written(some.groupBy(F.col("doc").alias("d")).agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
    common.discard(found, *read)
    return out


def merged(spans) -> list[tuple[int, int]]:
    """The maximal covered runs (start, end) of packed spans."""
    if spans is None or not len(spans):
        return []
    x = np.sort(np.asarray(spans, dtype=np.int64))
    start, end = x >> LONG, (x >> LONG) + (x & ((1 << LONG) - 1))
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.concatenate(([0], cut))].tolist(), reach[np.append(cut - 1, len(x) - 1)].tolist()))
