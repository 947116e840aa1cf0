import importlib.util
from collections import Counter

import numpy as np
import pytest

from lattica.llm import packing

from . import brute

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is absent")


def stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_each_stage_on_its_input(spark, sf_dir):
    """Every stage against a plain version of it, over its predecessor's rows."""
    import corpus_pipeline as p

    docs, good, near, cut, mixed, packed = stages(spark, sf_dir)
    assert len(p.STAGES) == 5 and all(x.columns == p.COLUMNS for x in (good, near, cut, mixed))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    judged = [(labels[r.doc_id], r.doc_id in kept) for r in docs.collect() if r.doc_id in labels]
    assert np.mean([k for q, k in judged if q == 1]) > 0.97 and np.mean([k for q, k in judged if q == 0]) < 0.35

    rows = [(r.doc_id, r.text) for r in good.collect()]
    roots = [c for _, c in brute.groups([(i, brute.fingerprint(t)) for i, t in rows])]
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(roots))

    rows = {r.doc_id: r.text for r in near.collect()}
    want = brute.substring(list(rows.items()), 50)
    left = {r.doc_id: r for r in cut.collect()}
    assert set(left) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    import hashlib

    for i, r in left.items():
        assert hashlib.sha256(b" ".join(brute.words(r.text))).hexdigest() == want[i][2]
        assert want[i][1] or r.text == rows[i]

    sizes, taken = Counter(), Counter()
    for r in left.values():
        sizes[r.source] += len(brute.words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(brute.words(r.text))
        assert left[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    goal = brute.targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)

    total = sum(len(packing.encode(r.text, packing.tokenizer_file())) for r in mixed.collect())
    used = Counter()
    for r in packed.collect():
        used[r.sequence_id] += r.length
    assert sum(used.values()) == total and max(used.values()) <= packing.CAPACITY


def test_run_equals_its_stages(spark, sf_dir):
    import corpus_pipeline as p

    a = sorted(map(tuple, p.run(spark, sf_dir).collect()))
    assert a == sorted(map(tuple, p.run(spark, sf_dir).collect())) and a
    assert p.ORACLE_SQL is None


def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()
    rows = [tuple(r) for r in good]
    rows += [(900, None, "en", "web", None), (901, "", None, None, 0), (902, "  ", "en", None, 2), (None, rows[0][1], "en", "web", 5), (None, None, None, None, None), rows[1], rows[1], (903, rows[1][1], "en", "web", 9)]
    rows += [(904, " ".join(f"w{i % 1009}" for i in range(140_000)), "en", "long", 1), (905, rows[2][1] + " and more", "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 AS dedup", "2 AS quality_score", "3 AS mix_shard", "4 AS __id_0", "5 AS length", "6 AS fp", "7 AS worker"), rows


def test_stages_handle_edges(spark, sf_dir):
    import corpus_pipeline as p

    docs, rows = edges(spark)
    good = p.quality_stage(spark, docs, sf_dir)
    kept = Counter(map(tuple, good.collect()))
    assert good.columns == p.COLUMNS and all(n == rows.count(r) for r, n in kept.items())
    assert len({rows[i] in kept for i in (20, 21, 22, 24)}) == 1 and (rows[1] in kept) == ((903, rows[1][1], "en", "web", 9) in kept)

    near = p.near_dedup_stage(spark, docs, sf_dir)
    roots = [c for _, c in brute.groups([(r[0], brute.fingerprint(r[1])) for r in rows])]
    ids = [r.doc_id for r in near.collect()]
    assert near.columns == p.COLUMNS and sorted(ids, key=repr) == sorted(set(roots), key=repr)

    cut = p.substring_stage(spark, docs, sf_dir)
    want = brute.substring([(r[0], r[1]) for r in rows if r[0] is not None], 50)
    left = Counter((r.doc_id, len(brute.words(r.text))) for r in cut.collect())
    assert cut.columns == p.COLUMNS and left == Counter(
        (r[0], want[r[0]][0] - want[r[0]][1] if r[0] is not None else len(brute.words(r[1]))) for r in rows if r[0] is None or not want[r[0]][1] or want[r[0]][1] < want[r[0]][0]
    )

    mixed = p.mixing_stage(spark, docs, sf_dir)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    for r in mixed.collect():
        taken[r.source] += len(brute.words(r.text))
        assert r.text and r.n_chars == len(r.text)
    assert mixed.columns == p.COLUMNS and all(abs(taken[s] - t) <= 1 for s, t in brute.targets(sizes).items())

    packed = p.packing_stage(spark, docs, sf_dir).collect()
    total = sum(len(packing.encode(r[1], packing.tokenizer_file())) for r in rows)
    assert sum(r.length for r in packed) == total and packed[0].__fields__ == packing.RESULT


def test_stages_of_nothing(spark, sf_dir):
    import corpus_pipeline as p

    none = edges(spark)[0].limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
