import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import anchors, repeats, simhash, substring_dedup, suffix_dedup

from . import brute

DOCS = "doc_id long, text string, spans string, __lt_extra int"
#: Names that helper columns have or had.
CLASHES = ["__id_0", "__spans_0", "__row_0", "__score_0", "__lt_id", "__lt_spans", "__lt_row", "__lt_score", "dedup", "doc", "d", "h", "n", "anchor", "fp", "size"]


def corpus(seed=3, n=60):
    """Documents that share passages of many lengths, with copies, repeated rows, nulls and a long one."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(6, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 5)):
            p = list(r.choice(passages)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
            if r.random() < 0.4 and p:
                p[r.randrange(len(p))] = "changed"
            text += p[r.randint(0, 3) :]
        rows.append((i * 3, (" " if i % 2 else "\n").join(text)))
    rows += [(1000, None), (1001, ""), (1002, "  \t "), (None, rows[5][1]), (1003, "a " * 300), (1004, "a " * 300), (1005, rows[4][1] + " " + rows[4][1]), rows[7], rows[7], (2, rows[9][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3, "hot_variants": 10**6}, {"hot_variants": 1}])
def test_substring_matches_brute_force(spark, sizes):
    rows = corpus()
    out = substring_dedup.rlz_dedup(frame(spark, rows), k=8, **sizes)
    assert out.columns == ["doc_id", "text", "spans", "__lt_extra", "dedup"]
    got = [(r.doc_id, (r.dedup.n_words, r.dedup.n_removed, r.dedup.kept_sha256)) for r in out.collect()]
    want = brute.substring(rows, 8)
    assert len(got) == len(rows)
    assert all(want[i] == x for i, x in got)
    assert sum(x[1] for _, x in got) > 100


def test_substring_exact_50(spark):
    p = [f"x{i}" for i in range(50)]
    rows = [(1, " ".join(p)), (2, " ".join(["a", *p, "b"])), (3, " ".join(p[:49])), (4, " ".join(p[1:]) + " z"), (0, None)]
    got = {r.doc_id: r.dedup for r in substring_dedup.rlz_dedup(frame(spark, rows)).collect()}
    assert (got[2].n_removed, got[2].kept) == (50, "a b")
    assert [got[i].n_removed for i in (0, 1, 3, 4)] == [0, 0, 0, 0]


def test_factors_look_across_their_ends():
    """A greedy factor from one source ends where another source goes on."""
    a, b, c = "a b c d e f", "d e f g h i", "a b c d e f g h i"
    block = pd.DataFrame({"doc": [1, 2, 3], "span": [0 << repeats.LOW | 1] * 3, "piece": [x.encode() for x in (a, b, c)]})
    found = list(substring_dedup.factors(block, 4))
    assert found == [(3, 0, 6, 1, 0), (3, 3, 6, 2, 0)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3, "hot_variants": 10**6}, {"hot_variants": 1}])
def test_suffix_matches_brute_force(spark, sizes):
    rows = corpus(5)
    got = [(r.doc_id, r.dedup) for r in suffix_dedup.suffix_dedup(frame(spark, rows), k=20, **sizes).collect()]
    want = brute.suffix(rows, 20)
    assert len(got) == len(rows)
    for i, d in got:
        if i is not None:
            assert (d.n_bytes, d.n_removed, d.n_spans, d.kept_sha256) == want[i]
        else:
            assert d.n_removed == 0


def test_interval_tree_gives_all_occurrences():
    texts = [b"xabcdefgh1", b"yabcdefgh2", b"zabcdefgx3", b"qabcdefgh1"]
    block = pd.DataFrame({"doc": range(4), "span": [0 << repeats.LOW | (10 - 5)] * 4, "piece": texts})
    found = sorted(suffix_dedup.repeat_groups(block, 6))
    assert (7, [(0, 1), (1, 1), (2, 1), (3, 1)]) in found
    assert (8, [(0, 1), (1, 1), (3, 1)]) in found
    assert all(len({texts[d][s : s + n] for d, s in places}) == 1 for n, places in found)


def test_hot_keys_are_spread(spark, monkeypatch):
    """Every join with hot keys, down to keys of two rows, gives what it gives without."""
    from lattica.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "MOST_HOT", 1 << 40)
    rows = corpus(7, 40)
    got = {(r.doc_id, r.dedup.n_removed, r.dedup.kept_sha256) for r in substring_dedup.rlz_dedup(frame(spark, rows), k=8, hot_variants=3).collect()}
    want = brute.substring(rows, 8)
    assert got == {(i, n, sha) for i, (_, n, sha) in want.items()}
    got = {r.doc_id: r.dedup.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, rows), k=20, hot_variants=3).collect()}
    assert all(got[i] == x[1] for i, x in brute.suffix(rows, 20).items())


def test_spread_join_with_any_sizes(spark, monkeypatch):
    from lattica.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i % 3, i) for i in range(100)] + [(7, 1)], "k long, v long")
    facts = common.written(spark.createDataFrame([(0, 34, "a"), (1, 33, "b"), (5, 2, "c")], "k long, n long, f string"), "facts")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.spread_join(rows, facts, ["k"], "n", how=how).select("k", "v", "f").collect()), key=repr)
        assert got == sorted(map(tuple, rows.join(facts, "k", how).select("k", "v", "f").collect()), key=repr)
    many = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "k long, p string")
    assert common.spread_join(rows, many, ["k"], "n", facts).count() == 2 * 34 + 33


def test_all_copies_of_a_hot_passage_go(spark):
    """A passage in a third of all documents, each with neighbours of its own."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" for _ in range(60)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(f"y{r.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    for sizes in ({}, {"hot_variants": 20}):
        out = {x.doc_id: x.dedup.n_removed for x in substring_dedup.rlz_dedup(frame(spark, rows), **sizes).collect()}
        assert out[0] == 0 and {n for i, n in out.items() if i % 3 == 0 and i} == {70} and {n for i, n in out.items() if i % 3} == {0}
    out = {x.doc_id: x.dedup for x in suffix_dedup.suffix_dedup(frame(spark, rows), hot_variants=20).collect()}
    want = brute.suffix(rows, 100)
    assert all((d.n_removed, d.n_spans) == want[i][1:3] for i, d in out.items())


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_texts_are_fetched_once(spark, monkeypatch, tmp_path, module):
    """Crowded anchors do not make the documents move again: each class is cut from its document once."""
    from dataclasses import replace

    r = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"x{r.randrange(10**6)} {passage} y{r.randrange(10**6)}" if i % 3 == 0 else " ".join(f"z{j}" for j in range(i, i + 60))) for i in range(120)]
    docs = frame(spark, rows).select("doc_id", "text")
    log = str(tmp_path / "cuts")
    own = module.spec()

    def cut(units, start, end):
        with open(log, "ab") as f:
            f.write(b".")
        return own.cut(units, start, end)

    sizes = []
    table = repeats.class_table
    monkeypatch.setattr(repeats, "class_table", lambda *x: sizes.append((out := table(*x))[1]) or out)
    told = [sorted((x.d, repeats.merged(x.spans)) for x in repeats.spans(docs, replace(own, cut=cut, hot_variants=n)).collect()) for n in (20, 10**6)]
    assert told[0] == told[1] and len(told[0]) > 70
    assert sizes[0].get(True) and sizes[0].get(False) and not sizes[1].get(True)
    assert (tmp_path / "cuts").stat().st_size == sum(sum(x.values()) for x in sizes)


def test_clashing_names_pass(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(60))), (3, "some other text"), (3, "a third")]
    table = frame(spark, rows).withColumns({c: F.lit(c) for c in CLASHES if c != "dedup"}).withColumn("dedup", F.lit("old"))
    for out in (substring_dedup.rlz_dedup(table), suffix_dedup.suffix_dedup(table)):
        assert sorted(out.columns) == sorted(table.columns) and out.count() == 4
        assert all(r[c] == c for r in out.collect() for c in CLASHES if c != "dedup")
    for out in (simhash.near_dedup(table), simhash.near_dedup(table.unionByName(table))):
        assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
        assert all(r[c] == c for r in out.collect() for c in CLASHES if c != "dedup")


def test_very_long_texts(spark):
    """Texts of several parts (over 131,072 words), one a copy but for a word."""
    w = [f"w{i % 4099}x{i % 977}" for i in range(140_000)]
    other = [*w[:70_000], "changed", *w[70_000:]]
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, "short")]
    got = {r.doc_id: (r.dedup.n_removed, r.dedup.kept) for r in substring_dedup.rlz_dedup(frame(spark, rows)).collect()}
    assert got == {1: (0, " ".join(w)), 2: (140_000, "changed"), 3: (0, "short")}
    prints = {r.doc_id: r.fingerprint for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert prints == {i: f"{brute.fingerprint(t):016x}" for i, t in rows}


def test_factors_are_the_longest():
    """The first document with a window is not the one with the longest copy."""
    texts = ("a b c d e x", "a b c d e f g", "z a b c d e f g h")
    block = pd.DataFrame({"doc": [1, 2, 3], "span": [0 << repeats.LOW | 1] * 3, "piece": [x.encode() for x in texts]})
    assert list(substring_dedup.factors(block, 4)) == [(2, 0, 5, 1, 0), (3, 1, 7, 2, 0)]


def test_spans_come_from_left_maximal_groups():
    """A group further left covers what is not left-maximal, so leaving that out loses nothing."""
    r = random.Random(2)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(8, 30))).encode() for _ in range(4)]
        block = pd.DataFrame({"doc": range(4), "span": [0 << repeats.LOW | 1] * 4, "piece": texts, "again": [r.random() < 0.3 for _ in texts]})
        found = suffix_dedup._kernel(block, 5)
        want = brute.suffix([(i, t.decode()) for i, t in enumerate(texts)], 5)
        assert [sum(n for _, n in found.get(i, ([], []))[0]) for i in range(4)] == [want[i][1] for i in range(4)]
        assert all(found[i][1] == [(0, len(texts[i]))] for i in range(4) if block["again"][i])


def test_no_share_comes_from_hashes_alone(spark, sf_dir, monkeypatch):
    """Without its kernel neither operator removes anything."""
    from dataclasses import replace

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for module in (substring_dedup, suffix_dedup):
        own = module.spec()
        assert repeats.spans(docs, replace(own, kernel=lambda block, k: {})).count() == 0 < repeats.spans(docs, own).count()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.rlz_dedup(none).count() == suffix_dedup.suffix_dedup(none).count() == simhash.simhash_groups(none).count() == simhash.near_dedup(none).count() == 0


def test_anchor_of_equal_windows_is_equal():
    import numpy as np

    r = np.random.Generator(np.random.PCG64(1))
    same = r.integers(0, 1 << 60, 300).astype(np.uint64)
    for lead in (0, 1, 77):
        x = np.concatenate((r.integers(0, 1 << 60, lead).astype(np.uint64), same))
        anchor, _, start, n = anchors.phrases(x, 50, 6)
        by_window = dict(zip(np.concatenate([np.arange(s, s + m) for s, m in zip(start, n)]).tolist(), np.repeat(anchor, n).tolist()))
        assert sorted(by_window) == list(range(len(x) - 49))
        own = [by_window[lead + p] for p in range(251)]
        if lead == 0:
            first = own
        assert own == first


def test_parts_of_very_long_texts(monkeypatch):
    text = ("abcdefghij" * 50 + "klmno") * 20
    whole = anchors.phrases(suffix_dedup.byte_symbols(text.encode()), 100, 24)
    monkeypatch.setattr(anchors, "PART", 512)
    parts = anchors.phrases(suffix_dedup.byte_symbols(text.encode()), 100, 24)
    expand = lambda x: [a for a, n in zip(x[0].tolist(), x[3].tolist()) for _ in range(n)]
    assert expand(whole) == expand(parts)


def near_copies(seed=1):
    r = random.Random(seed)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(400)] = f"n{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(r.choice("abcdefghijkl") * 3 for _ in range(30))) for i in range(30)]
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "oNE"), (205, "One Two"), (None, "one two"), rows[0]]


def test_simhash_matches_brute_force(spark):
    rows = near_copies()
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", n, c) for (i, p), (n, c) in zip(prints, brute.groups(prints))), key=repr)
    got = sorted(map(tuple, simhash.simhash_groups(frame(spark, rows)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("classes", [10, 1 << 30, 1 << 36])
def test_near_pairs_for_any_number_of_bands(spark, classes):
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(50)}
    prints |= {p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in list(prints) for _ in range(3)} | {p ^ 7 for p in list(prints)[:20]}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = sorted(tuple(x) for x in simhash.near_pairs(table, 2, classes).collect())
    want = sorted({tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2})
    assert got == want
    assert len(simhash.band_masks(2, classes)) >= 3


def test_long_chains_are_one_component(spark):
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << i))
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_dedup_keeps_one_a_group(spark):
    rows = near_copies()
    kept = [r.doc_id for r in simhash.near_dedup(frame(spark, rows)).collect()]
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    want = {c for _, c in brute.groups(prints)}
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_query_columns(spark, sf_dir):
    out = substring_dedup.query(spark, sf_dir)
    assert dict(out.dtypes)["n_removed"] == "bigint" and out.filter(F.length("kept_sha256") != 64).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3}])
def test_repeat_tree_lists_all_occurrences(spark, sizes):
    rows = [x for x in dict(reversed(corpus(5))).items() if x[0] is not None]
    k = 20
    got = suffix_dedup.repeat_tree(frame(spark, rows), k=k, **sizes).collect()
    texts = {i: (t or "").encode() for i, t in rows}
    parent = {r.group: r.parent for r in got}
    members = {}
    for r in got:
        g = r.group
        while g is not None and r.doc_id is not None:
            members.setdefault(g, set()).add((r.doc_id, r.start))
            g = parent[g]
    length = {r.group: r.length for r in got}
    for g, places in members.items():
        assert len(places) > 1
        assert len({texts[d][s : s + length[g]] for d, s in places}) == 1
    where = {}
    for i, b in texts.items():
        for p in range(len(b) - k + 1):
            where.setdefault(b[p : p + k], set()).add((i, p))
    listed = {(r.doc_id, r.start) for r in got if r.doc_id is not None}
    covered = {(d, s + j) for g, places in members.items() for d, s in places for j in range(length[g] - k + 1)}
    for places in where.values():
        if len(places) > 1:
            assert places <= covered
    assert listed <= set().union(*(p for p in where.values() if len(p) > 1))
