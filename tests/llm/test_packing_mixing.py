import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import mixing, packing

from . import brute


def texts():
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "Straße", "x1", "émoi", "\n", "!!"]) for _ in range(int(r.paretovariate(0.7) * 20) % 9000))) for i in range(80)]
    return rows + [(500, None), (501, ""), (None, "no id"), (502, "a<|endoftext|>b"), rows[3], (503, "a" * 20_000)]


def ids_of(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("worker_docs, limit", [(10**6, 50_000), (20, 50_000), (20, 0)])
def test_packing_round_trip(spark, tokenizer, worker_docs, limit, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    out = packing.harmonic_pack(docs, worker_docs=worker_docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for i, t in rows:
        ids = ids_of(t, tokenizer)
        at = 0
        for n in [packing.CAPACITY] * (len(ids) // packing.CAPACITY) + [n for _, n, _ in packing.cut(len(ids) % packing.CAPACITY)]:
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    again = packing.harmonic_pack(docs, worker_docs=worker_docs).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_full_bins_hold_their_class():
    for n in range(1, packing.CAPACITY):
        cut = packing.cut(n)
        assert sum(x for _, x, _ in cut) == n
        assert all(x * m <= packing.CAPACITY and x * (m + 1) > packing.CAPACITY for _, x, m in cut)
        assert all(packing.CAPACITY - x * m < m for _, x, m in cut if x > packing.TAIL)


def test_workers_follow_pieces_too(spark):
    docs = spark.createDataFrame([(i, "word " * 60_000) for i in range(3)], "doc_id long, text string")
    out = packing.harmonic_pack(docs, worker_docs=3).collect()
    assert len({r.sequence_id >> (packing.CLASS_BITS + packing.BIN_BITS) for r in out}) > 3


def test_packing_nothing(spark):
    assert packing.harmonic_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def mixed_rows():
    r = random.Random(5)
    rows = []
    for i in range(300):
        source = r.choices(["big", "small", "tiny", "ä", None, ""], [60, 20, 1, 9, 5, 5])[0]
        rows.append((i, " ".join(f"w{j}" for j in range(r.randint(0, 60))), source))
    return rows + [(400, None, "big"), (401, "", "empty"), (None, "a b c", "small"), rows[0], (402, "one two three", "only")]


def test_mix_plan_meets_targets(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, target int")
    out = mixing.mix_plan(docs, range_rows=20).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix_plan(docs, range_rows=50).collect()), key=repr)


def test_mix_rows_follow_the_plan(spark):
    rows = [x for x in mixed_rows() if x[0] is not None][:-2]
    rows = list({x[0]: x for x in rows}.values())
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, first int")
    out = mixing.mix(docs, block_words=16, shard_words=512)
    assert out.columns == ["doc_id", "text", "source", "first", "mix_shard", "mix_order"]
    got, shards = Counter(), Counter()
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] += len(brute.words(r.text))
        shards[r.mix_shard] += 1
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs, block_words=16, shard_words=512).collect()}
    assert all(got[i] == n for i, n in plan.items())
    assert len(shards) > 3


def test_mix_writes_what_the_query_reports_on_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 512)
    rows = mixed_rows() + [(900, "again and again", "many")] * 700 + [(901, "in two sources", "big"), (901, "in two sources", "small"), (None, "a b c", "small"), (None, "a b c", None)]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, source string, row int").repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    said, wrote = Counter(), Counter()
    for r in mixing.query(spark, str(tmp_path)).collect():
        said[r.doc_id] += r.taken
    passes = Counter()
    for r in mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet")), block_words=16, shard_words=512).collect():
        wrote[r.doc_id] += len(brute.words(r.text))
        passes[r.row] += 1
        assert (r.doc_id, r.source) == (rows[r.row][0], rows[r.row][2])
    assert +said == +wrote
    # Some copies are taken once more than others, none more than the passes allow.
    own = [passes[i] for i, x in enumerate(rows) if x[0] == 900]
    assert max(own) - min(own) == 1


def drawn_plainly(docs, block, shards, seed, tree_seed):
    """doc_id -> words taken, by a plain version of the whole operator over rows without repeats."""
    lines = {}
    for i, text, source in docs:
        lines.setdefault(source, []).append((mixing_hash(seed, i, text), i, len(brute.words(text))))
    order = sorted(lines, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, _, n in lines[s]) for s in order}
    goal = brute.targets(sizes)
    want = {s: min(round(goal[s]), 3 * sizes[s]) for s in order}
    whole = {s: want[s] // sizes[s] if sizes[s] else 0 for s in order}
    rest = {s: want[s] - whole[s] * sizes[s] for s in order}
    blocks = {s: -(-sizes[s] // block) for s in order}
    quota = {s: min(blocks[s], -(-rest[s] * blocks[s] // max(1, sizes[s]))) for s in order}
    numbers = [whole[s] * blocks[s] for s in order] + [quota[s] for s in order] + [blocks[s] - quota[s] for s in order]
    split = mixing.split_quotas(np.array(numbers), shards, tree_seed).reshape(shards, 3, len(order))
    taken = {}
    for n, s in enumerate(order):
        at, drawn, reserve, first = 0, [], [], 0
        own = {}
        for shard in range(shards):
            q, r = split[shard, 1, n], split[shard, 2, n]
            drawn += range(first, first + q)
            reserve += range(first + q, first + q + r)
            first += q + r
        for _, i, size in sorted(lines[s]):
            own.setdefault(at // block, []).append((i, size))
            at += size
        left = rest[s]
        for i, size in [x for b in drawn + reserve for x in own.get(b, [])]:
            taken[i] = whole[s] * size + min(size, left)
            left -= min(size, left)
    return taken


def mixing_hash(seed, i, text):
    return HASHES[seed, i, text]


HASHES = {}


def test_query_equals_a_plain_splitting_tree(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = list({x[0]: x for x in mixed_rows() if x[0] is not None}.values())
    rows = [x for x in rows if x[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in docs.select("*", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect():
        HASHES[mixing.SEED, r.doc_id, r.text] = r.h
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 512)
    got = mixing.query(spark, str(tmp_path)).collect()
    shards = sum(len(brute.words(t)) for _, t, _ in rows) // 512
    want = drawn_plainly(rows, 16, shards, mixing.SEED, mixing.SEED)
    assert shards > 5 and {r.doc_id: r.taken for r in got} == want
    assert max(r.n_shards for r in got) > 1


def test_another_tree_draws_other_blocks_within_the_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    taken = []
    for tree_seed in (1, 2):
        out = mixing.mix_plan(docs, block_words=16, shard_words=512, tree_seed=tree_seed).collect()
        sums = Counter()
        for r in out:
            sums[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        assert all(abs(sums[r.source] - r.target) <= 0.5 + 1e-6 for r in out)
        taken.append({(r.doc_id, r.tie, r.source, r.copy): r.taken for r in out})
    assert taken[0].keys() == taken[1].keys() and sum(taken[0][k] != taken[1][k] for k in taken[0]) > 20


def test_the_tree_has_many_shards_on_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    assert len({r.mix_shard for r in mixing.mix(docs).select("mix_shard").distinct().collect()}) > 3


def test_mixing_of_clashing_names_and_very_long_texts(spark):
    long = "word " * 200_000
    rows = [(1, long, "a", 5), (2, "b " * 1000, "b", 6), (3, None, "b", 7), (3, "c d", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id_0 int").selectExpr("*", "1 AS __row_0", "2 AS mix_shard", "3 AS mix_order", "4 AS tie", "5 AS copy", "6 AS pass", "7 AS __lt_id", "8 AS __lt_row")
    out = mixing.mix(docs.unionByName(docs.filter("doc_id = 2")))
    assert sorted(out.columns) == sorted(docs.columns) and {r["__id_0"] for r in out.collect()} <= {5, 6, 8}
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert (r["__row_0"], r.tie, r.copy, r["pass"], r["__lt_id"], r["__lt_row"]) == (1, 4, 5, 6, 7, 8)
    goal = brute.targets({"a": 200_000, "b": 2000, None: 2})
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal)


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 0, 7, 123456])
    out = mixing.split_quotas(quotas, 13, 1)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    assert abs(out.sum(axis=1) - quotas.sum() / 13).max() <= 4
    assert (out == mixing.split_quotas(quotas, 13, 1)).all()


def test_mixing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix_plan(wordless).collect()] == [(0, 0.0)] * 2 and mixing.mix(wordless).count() == 0
