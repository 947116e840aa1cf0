import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import ann, quality, topk, vectors


def rows_of(n=400, dims=16, seed=1):
    r = np.random.Generator(np.random.PCG64(seed))
    x = r.standard_normal((n, dims)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows[40] = (40, rows[7][1])
    rows[60] = (60, rows[60][1][:9])
    return rows + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 16), (1060, [float("inf")] + [0.0] * 15), (1080, []), (1100, [0.0] * 16), (None, rows[3][1]), rows[20], rows[21]]


def padded(rows, dims=16):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return np.array([i for i, _ in good]), np.array([list(v) + [0.0] * (dims - len(v)) for _, v in good], dtype=np.float64)


SCHEMA = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("block", [65536, 7])
def test_exact_top_k_matches_brute_force(spark, block):
    rows = rows_of()
    table = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    got = sorted(map(tuple, topk.exact_top_k(table, k=5, query_block=block).collect()))
    ids, x = padded(rows)
    v = topk.quantised(x)
    want = []
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        own = min((tuple(y) for y in x[ids == q]))
        score = v @ topk.quantised(np.array(own))
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_exact_top_k_small_and_empty(spark):
    table = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], ""), (20, [-1.0], "")], SCHEMA)
    got = sorted(map(tuple, topk.exact_top_k(table).collect()))
    assert got == [(0, 1, 1, 64 * 128), (0, 2, 20, -64 * 64), (20, 1, 0, -64 * 64), (20, 2, 1, -64 * 128)]
    assert topk.exact_top_k(table.limit(0)).count() == 0 and ann.nearest_neighbours(table.limit(0)).count() == 0


def test_segments_fall_in_impact():
    values = np.array([[5, -9, 0], [1, 30, -2]])
    found = topk.segments(values)
    tops = [np.abs(v).max() for _, v in found]
    assert tops == sorted(tops, reverse=True)
    assert {int(p): int(v) for ps, vs in found for p, v in zip(ps, vs)} == {0: 5, 1: -9, 3: 1, 4: 30, 5: -2}


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = rows_of(1500)
    table = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    got = ann.nearest_neighbours(table, k=10).collect()
    ids, x = padded(rows)
    alive = (x != 0).any(axis=1)
    ids, x = ids[alive], x[alive]
    hit = n = 0
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        own = np.array(min(tuple(y) for y in x[ids == q]))
        score = x @ own
        best = sorted((-s, int(i)) for s, i in zip(score, ids) if i != q)[:10]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(r.vec_id != q for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            assert any(abs(r.score - s) < 1e-9 for s in score[ids == r.vec_id])
        hit += len({r.vec_id for r in found} & {i for _, i in best})
        n += len({i for _, i in best})
    assert hit / n >= 0.9


def test_ann_on_the_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {}
    for r in ann.query(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = table.toPandas()
    x = np.stack(rows["embedding"]).astype(np.float64)
    ids = rows["vec_id"].to_numpy()
    hit = 0
    for q, found in got.items():
        score = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hit += len(found & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9


def shaped(kind, n=6000, dims=32, seed=2):
    r = np.random.Generator(np.random.PCG64(seed))
    if kind == "clusters":
        return r.standard_normal((100, dims))[r.integers(0, 100, n)] + 0.5 * r.standard_normal((n, dims))
    x = r.standard_normal((n, dims))
    return x * np.exp(r.standard_normal(n) * 0.5)[:, None] if kind == "skewed" else x


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "skewed"])
def test_ann_recall_on_vectors_of_any_shape(spark, tmp_path, kind):
    """The sample is a quarter of the rows, so most neighbours are outside of it."""
    import pyarrow.parquet as pq

    x = shaped(kind)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "v.parquet")
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = {}
    for r in ann.nearest_neighbours(table, sample=1500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-score)[:20].tolist()))
        assert len(found[q]) == 20
    assert hit / (20 * len(found)) >= 0.9


@pytest.mark.parametrize("search", [topk.exact_top_k, ann.nearest_neighbours])
def test_one_part_of_the_queries_is_gathered_at_a_time(spark, monkeypatch, search):
    from lattica.llm import common

    told = []
    gathered, written = vectors.gathered, common.written
    monkeypatch.setattr(vectors, "gathered", lambda part: told.append("gathered") or gathered(part))
    monkeypatch.setattr(common, "written", lambda df, tag: [written(df, tag), told.append(tag)][0])
    table = spark.createDataFrame([(*x, "") for x in rows_of(1500)], SCHEMA)
    whole = sorted(map(tuple, search(table, k=5).collect()))
    told.clear()
    assert sorted(map(tuple, search(table, k=5, query_block=20).collect())) == whole
    steps = [x for x in told if x in ("gathered", "found")]
    assert len(steps) > 6 and steps == ["gathered", "found"] * (len(steps) // 2)


def test_exact_top_k_of_components_beyond_a_long(spark):
    big = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e7, 1e8]), (20, [1e9, 1e9]), (21, [1e300, -1e300]), (22, [1.0, 1.0])]
    table = spark.createDataFrame([(*x, "") for x in big], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, topk.exact_top_k(table).collect()))
    whole = {i: [math.floor(64 * c) for c in v] if max(map(abs, v)) < 1e200 else [64 * int(c) for c in v] for i, v in big}
    want = []
    for q in (0, 20):
        score = {i: min(max(sum(a * b for a, b in zip(whole[q], v)), -(1 << 63)), (1 << 63) - 1) for i, v in whole.items() if i != q}
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0])))]
    assert got == want


def test_clashing_names_of_vectors(spark):
    rows = [(i, [float(i), 1.0], "x", 0, "y") for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int, cell string")
    assert ann.nearest_neighbours(table, k=3).count() == topk.exact_top_k(table, k=3).count() == 6


class Held:
    def __init__(self, value):
        self.value = value


def found_by_kernel(ids, x, queries, k=20, rerank=40, cells=64, probes=48, block=4096):
    """(ids, scores) of the finds of each query, best first, from blocks of the cells as ``build`` makes them."""
    model = ann.fit(x[:20_000], cells)
    cell, codes, errors = ann.encode(model, x)
    n = min(probes, len(model["centres"]))
    near = np.argsort(-(x[queries] @ model["centres"].T), axis=1)[:, :n].astype(np.int16)
    run, best = ann._kernel(Held(model), x.shape[1], rerank), vectors.Best(len(queries), k, np.float64)
    for c in range(len(model["centres"])):
        own = np.flatnonzero(cell == c)
        for at in range(0, len(own), block):
            some = own[at : at + block]
            arrays = [pa.array([c], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in (ids[some], codes[some], errors[some], x[some]))]
            run(pa.RecordBatch.from_arrays(arrays, names=["cell", "ids", "codes", "errors", "vectors"]), ids[queries], (x[queries], near), best)
    return [(best.id[best.q == q], best.score[best.q == q]) for q in range(len(queries))]


@pytest.mark.parametrize("noise", [0.0, 0.01, 0.05])
def test_ann_finds_all_of_a_crowd_of_copies(noise):
    r = np.random.Generator(np.random.PCG64(4))
    x = r.standard_normal((12_000, 32))
    x[::3] = x[0] + noise * r.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x), dtype=np.int64)
    queries = np.arange(0, len(x), 100)
    # With all cells probed the finds are exact, in and outside of the crowd.
    for q, (found, score) in zip(queries, found_by_kernel(ids, x, queries, probes=64)):
        want = np.einsum("ij,ij->i", x, np.broadcast_to(x[q], x.shape))
        want[q] = -np.inf
        order = np.lexsort((ids, -want))[:20]
        assert found.tolist() == order.tolist() and np.allclose(score, want[order], atol=1e-12)


def test_cells_start_from_distinct_vectors_and_none_is_empty():
    r = np.random.Generator(np.random.PCG64(4))
    x = r.standard_normal((3000, 16))
    x[::3] = x[0]
    assert len(np.unique(ann.k_means(x, 64, rounds=0), axis=0)) == 64
    centres = ann.fit(x, 64)["centres"]
    assert len(np.unique(ann.nearest(x, centres))) == len(centres) >= 60
    assert len(ann.fit(np.ones((50, 4)), 64)["centres"]) == 1


def test_contenders_leave_enough_of_equal_rows():
    ids = np.array([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])
    own = np.ones((10, 2))
    own[9] = 2
    assert ids[ann.contenders(ids, own, 2)].tolist() == [1, 1, 2, 3, 7]


def test_best_keeps_ties_by_id():
    best = vectors.Best(1, 2, np.int64)
    best.add(np.zeros(3, np.int64), np.array([9, 4, 5]), np.array([7, 7, 7]))
    best.add(np.zeros(2, np.int64), np.array([1, 2]), np.array([7, 3]))
    assert best.id.tolist() == [1, 4]


def test_shape_reads_the_whole_word():
    plain, marked = (quality._buckets(b"a" * 64 + x)[1] for x in (b"b" * 100_000, b"!" * 100_000))
    assert plain == quality._buckets(b"ab")[1] and marked == quality._buckets(b"ab!")[1] and plain != marked


def quality_rows(seed=1, n=400):
    r = random.Random(seed)
    good = ["the", "thing", "and", "other", "was", "there", "entation", "morning", "river"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(good) + r.choice(["", "s", "er"]) for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            w = [x + r.choice(["***", "%%%", "###"]) for x in w] if i % 8 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    docs += [(900, None), (901, ""), (902, "word " * 50_000), docs[3], (None, "the thing")]
    labels += [(900, 1), (1, None), (2, 1), (2, 1), (None, 0), (7777, 1)]
    return docs, labels


def test_quality_votes_well_and_reads_no_held_out_label(spark):
    docs, labels = quality_rows()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    model = quality.fit(d.select("doc_id", "text"), lab)
    scored = quality.with_score(d, model, name="s")
    assert scored.columns == ["doc_id", "text", "score", "s"]
    got = {(r.doc_id, (r.text or "")[:9]): r.s for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    truth = dict(labels)
    held = [(truth[i], s) for (i, _), s in got.items() if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == bool(q) for q, s in held]) > 0.95
    turned = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    again = {(r.doc_id, (r.text or "")[:9]): r.s for r in quality.with_score(d, quality.fit(d.select("doc_id", "text"), turned), name="s").collect()}
    assert again == got
    kept = {r.doc_id for r in quality.keep_good(d, lab).collect()}
    assert np.mean([i in kept for i in range(400) if i % 4]) > 0.98 and np.mean([i in kept for i in range(0, 400, 4)]) < 0.2


def test_votes_equal_a_plain_neighbour_vote(spark):
    """Every score against all cosines, sorted, one document at a time."""
    docs, labels = quality_rows(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = [t for _, t in docs]
    got = quality.score_texts(model, [None if t is None else t.encode() for t in texts])
    for text, score in zip(texts, got):
        at, value = quality.features(None if text is None else text.encode())
        v = value @ model["project"][at] if len(at) else np.zeros(model["project"].shape[1])
        v = v / max(float(np.linalg.norm(v)), 1e-12)
        cosine = sorted(((float(v @ u), float(y)) for u, y in zip(model["vectors"], model["labels"])), reverse=True)
        kth = cosine[quality.NEIGHBOURS - 1][0]
        near = [(max(c, 0.0) ** quality.SHARPNESS, y) for c, y in cosine if c > kth + 1e-6]
        edge = [(max(c, 0.0) ** quality.SHARPNESS, y) for c, y in cosine if abs(c - kth) <= 1e-6]
        if sum(w for w, _ in near + edge) < 1e-9:
            assert abs(score - float(np.mean(model["labels"]))) < 1e-6
            continue
        # Which of equally near neighbours vote is open.
        room = quality.NEIGHBOURS - len(near)
        votes = [sum(w * y for w, y in near + part) / sum(w for w, _ in near + part) for part in (sorted(edge, key=lambda x: x[1])[:room], sorted(edge, key=lambda x: -x[1])[:room])]
        assert min(votes) - 1e-4 <= score <= max(votes) + 1e-4


def test_keep_good_leaves_columns_alone(spark):
    docs, labels = quality_rows(2, 60)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS __score_0", "2 AS quality", "3 AS own_id", "4 AS i", "5 AS quality_score")
    out = quality.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert out.columns == d.columns and all((r["__score_0"], r.quality, r.own_id, r.i, r.quality_score) == (1, 2, 3, 4, 5) for r in out.collect())


def test_quality_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(d, none) is None
    assert {r.s for r in quality.with_score(d, None, name="s").collect()} == {0.5}
    assert quality.keep_good(d.limit(0), none).count() == 0


def test_quality_held_out_on_the_test_table(spark, sf_dir):
    out = quality.query(spark, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in out.collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.85
