import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import config, schema
from lattica.operators import context, fold, lookup, maintenance, mining, resolve, traverse

T0 = datetime(2024, 1, 1)
WRITES = [
    ("Cora", "knows", "Dan", 0.90), ("Dan", "created", "Dashboard", 0.80), ("Dashboard", "part_of", "Suite", 0.70), ("Cora", "uses", "React", 0.50), ("Cora", "uses", "Vue", 0.80),
    ("Cora", "knows", "Dan", 0.95), ("Dan", "knows", "Eve", 0.65), ("Cora", "uses", "React", 0.60), ("Eve", "works_on", "Fenrir", 0.90),
]


def log_of(spark, writes, first=1, agent="main"):
    rows = [(agent, first + i, T0 + timedelta(minutes=first + i), s, p, o, c, f"ex{first + i}", date(2024, 1, 1), False) for i, (s, p, o, c) in enumerate(writes)]
    return spark.createDataFrame(rows, schema.TRIPLE_LOG)


@pytest.fixture(scope="module")
def triples(spark):
    return fold.fold_triples(log_of(spark, WRITES)).cache()


@pytest.fixture(scope="module")
def entities(spark):
    names = ["Cora", "Dan", "Dashboard", "Suite", "React", "Vue"] * 2
    rows = [("main", i, T0, n, "PERSON" if n in ("Cora", "Dan") else "THING", f"ex{i}") for i, n in enumerate(names)]
    return fold.fold_entities(spark.createDataFrame(rows, schema.MENTION_LOG)).cache()


def test_fold_of_the_small_graph(triples):
    got = {(r.subject, r.predicate, r.object, round(r.confidence, 2), r.source_exchange_id) for r in triples.collect()}
    assert got == {
        ("cora", "knows", "dan", 0.95, "ex1"), ("dan", "created", "dashboard", 0.8, "ex2"), ("dashboard", "part_of", "suite", 0.7, "ex3"), ("dan", "knows", "eve", 0.65, "ex7"),
        ("cora", "uses", "react", 0.6, "ex8"), ("eve", "works_on", "fenrir", 0.9, "ex9"),
    }


def replay(writes):
    """One write after the other."""
    state = {}
    for i, (s, p, o, c) in enumerate(writes):
        if not (s and p and o):
            continue
        s, o, c = s.lower(), o.lower(), c or 1.0
        if (s, p, o) in state:
            state[s, p, o] = (max(state[s, p, o][0], c), state[s, p, o][1])
            continue
        if p not in config.MULTI_VALUED:
            for k in [k for k in state if k[:2] == (s, p)]:
                del state[k]
        state[s, p, o] = (c, f"ex{i + 1}")
    return state


WRITE = st.tuples(st.sampled_from(["a", "B", "c", ""]), st.sampled_from(["uses", "knows", "part_of", "created"]), st.sampled_from(["x", "y", "Z", "a"]), st.sampled_from([0.0, 0.3, 0.5, 0.9]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WRITE, max_size=30), st.integers(0, 30))
def test_fold_equals_replay(spark, writes, at):
    want = replay(writes)
    read = lambda df: {(r.subject, r.predicate, r.object): (r.confidence, r.source_exchange_id) for r in df.collect()}
    assert read(fold.fold_triples(log_of(spark, writes))) == want
    head = fold.as_log(fold.fold_triples(log_of(spark, writes[:at])))
    rest = log_of(spark, writes[at:], first=at + 1).withColumns({"first_seq": F.col("seq"), "created_at": F.col("ts")})
    assert read(fold.fold_triples(head.unionByName(rest))) == want


def hops(df):
    return {r.source_exchange_id: (round(r.score, 5), r.depth) for r in df.collect()}


def test_multi_hop(triples, entities):
    two = hops(traverse.multi_hop(triples, entities, ["cora"], "main", 2))
    assert two == {"ex1": (0.665, 1), "ex2": (0.4655, 2), "ex7": (0.4655, 2), "ex8": (0.42, 1)}
    three = hops(traverse.multi_hop(triples, entities, ["cora"], "main", 3))
    assert three == {**two, "ex3": (0.32585, 3)}


def test_meta_paths_and_fusion(spark, triples, entities):
    patterns = mining.pattern_table(spark, config.defaults()["patterns"]["static"], "main")
    meta = traverse.meta_path(triples, patterns, ["dan"], "main")
    assert {r.source_exchange_id: round(r.score, 5) for r in meta.collect()} == {"ex3": 0.504, "ex9": 0.49725}
    fused = traverse.fuse(traverse.multi_hop(triples, entities, ["dan"], "main"), meta, ["dan"]).collect()
    assert [(r.source_exchange_id, round(r.score, 5)) for r in fused] == [("ex1", 0.665), ("ex2", 0.56), ("ex3", 0.504), ("ex9", 0.49725), ("ex8", 0.4655), ("ex7", 0.455)]


def test_three_step_patterns(spark, triples):
    patterns = mining.pattern_table(spark, [["knows", "created", "part_of", 0.5], ["uses", 0.9], ["knows"] * 4 + [0.9]], "main")
    assert [(r.source_exchange_id, round(r.score, 4)) for r in traverse.meta_path(triples, patterns, ["cora"], "main").collect()] == [("ex3", round(0.95 * 0.8 * 0.7 * 0.5, 4))]


def test_walks_equal_the_or_join(spark):
    r = random.Random(4)
    names = list("abcdefg")
    writes = [(r.choice(names), r.choice(["knows", "part_of"]), r.choice(names), r.choice([0.5, 0.7, 0.9])) for _ in range(25)]
    t = fold.fold_triples(log_of(spark, writes)).cache()
    known = spark.createDataFrame([("main", n) for n in "abcde"], "agent_id string, id string")
    rows = [x for x in t.collect() if x.confidence >= 0.6]
    seeds, paths = ["a", "b"], []
    for x in rows:
        if x.subject in seeds or x.object in seeds:
            paths.append((x.object if x.subject in seeds else x.subject, 1, (x.subject, x.predicate, x.object), x.source_exchange_id))
    at = 0
    while at < len(paths):
        node, depth, path, _ = paths[at]
        at += 1
        if depth < 3 and node in "abcde":
            for x in rows:
                if node in (x.subject, x.object):
                    to = x.object if x.subject == node else x.subject
                    if to not in path:
                        paths.append((to, depth + 1, (*path, x.predicate, to), x.source_exchange_id))
    got = traverse.hop_paths(t, known, seeds, "main", 3).collect()
    assert sorted((p.node, p.depth, tuple(p.path), p.source_exchange_id) for p in got) == sorted(paths)


def test_sentences(spark, triples, entities):
    said = context.sentences(context.context_edges(triples, entities, ["cora"], "main")).collect()
    assert [(r.line, r.sentence) for r in said] == [(1, "Cora knows Dan and uses React")]
    edges = spark.createDataFrame([(1, "A", "created", "X"), (2, "B", "said", "Y"), (3, "A", "uses", "Y"), (4, "A", "knows", "Z")], "rank int, subject_name string, predicate string, object_name string")
    assert [r.sentence for r in context.sentences(edges).collect()] == ["A created X, uses Y, and knows Z"]


def test_entity_context_of_unknown(triples, entities, spark):
    pairs = spark.createDataFrame([], schema.COOCCURRENCES)
    assert context.entity_context(triples, entities, pairs, "Nobody", "main").count() == 0
    row = context.entity_context(triples, entities, pairs, "Dan", "main").first()
    assert row.triple_count == 3 and set(row.relationships) == {"knows", "created"} and row.cooccurrences == []


def test_lookups(spark, triples, entities):
    assert lookup.entity_by_name(entities, "Dan", "main").count() == 1 and lookup.entity_by_name(entities, "Dan", "x").count() == 0
    new = lookup.resolve_or_create(entities, spark.createDataFrame([("DAN",), ("Zed",)], "name string"), "main")
    assert {r.name: (r.id, r.is_new) for r in new.collect()} == {"DAN": ("dan", False), "Zed": ("zed", True)}
    assert lookup.without_exchange(triples, "ex1").count() == 5


def test_decay_expiry_pending_and_merge(triples, entities):
    later = "2024-04-20 00:00:00"
    assert {r.confidence for r in maintenance.decay(triples, "main", later).filter("predicate = 'created'").collect()} == {0.4}
    assert maintenance.decay(triples, "main", "2024-03-01 00:00:00").filter("decayed").count() == 0
    assert maintenance.expire(triples, "main", {"uses": 0}, "2024-01-01 00:00:00").count() == 5  # the whole day counts
    assert maintenance.expire(triples, "main", {}, later).count() == 6
    waiting = triples.withColumn("pending", F.col("predicate") == "knows")
    out = maintenance.pending_outcomes(waiting, entities, "main", later)
    assert {(r.id, r.outcome) for r in out.collect()} == {("cora", "resolved"), ("dan", "resolved")}
    assert maintenance.clear_pending(waiting, out, "main").filter("pending").count() == 0
    t, e = maintenance.merge_entities(triples, entities, "cora", "dan", "main", later)
    assert {(r.subject, r.object) for r in t.filter("predicate = 'knows'").collect()} == {("cora", "cora"), ("cora", "eve")}
    kept = e.filter("id = 'cora'").first()
    assert (kept.aliases, kept.mention_count) == (["Dan"], 4) and e.count() == 5
    t, e = maintenance.merge_entities(triples, entities, "cora", "nobody", "main", later)
    assert t.exceptAll(triples).count() == 0 and e.count() == 6


def test_patterns_are_seeded_saved_and_kept(spark):
    known = mining.pattern_table(spark, [["a", "b", 0.9]], "main").withColumn("active", F.lit(False))
    assert mining.seed_patterns(known, mining.pattern_table(spark, [["a", "b", 0.5], ["c", "d", 0.4]], "main")).count() == 2
    found = mining.pattern_table(spark, [["a", "b", 0.7], ["e", "f", 0.6]], "main")
    saved = {tuple(r.predicates): (r.pattern_type, r.weight, r.active) for r in mining.save_patterns(known, found).collect()}
    assert saved == {("a", "b"): ("static", 0.7, True), ("e", "f"): ("discovered", 0.6, True)}


def test_resolution_tiers(spark):
    now = "2024-02-01 00:00:00"
    rows = [("main", "bob_martinez", "Bob Martinez", "PERSON", T0, datetime(2024, 1, 30), 20, []), ("main", "alina", "Alina", "PERSON", T0, datetime(2024, 1, 1), 2, ["Al B"]), ("main", "alinda", "Alinda", "PERSON", T0, datetime(2023, 12, 1), 2, [])]
    e = spark.createDataFrame(rows, schema.ENTITIES)
    m = spark.createDataFrame(list(enumerate(["Bob", "alina", "Ali", "Zz", "al b"])), "mention_id int, mention string")
    none = spark.createDataFrame([], "mention_id int, context string")
    scored = resolve.scores(resolve.candidates(m, e, "main"), none, spark.createDataFrame([], schema.COOCCURRENCES), now)
    got = {r.mention: (r.tier, r.id) for r in resolve.tiers(m, scored, e).collect()}
    assert got == {"Bob": ("assume", "bob_martinez"), "alina": ("exact", "alina"), "Ali": ("ask", None), "Zz": ("new", None), "al b": ("defer", "alina")}
    note = resolve.notes(resolve.tiers(m, scored, e)).first().note
    assert "- Alina (person, 2 mentions, not seen recently)" in note and note.count("\n") == 4


def test_layers():
    c = config.load({"retrieval": {"max_hops": 3}}, {"context": {"exclude": []}, "retrieval": {"max_results": 5}})
    assert (c["retrieval"]["max_hops"], c["retrieval"]["max_results"], c["retrieval"]["hop_decay"], c["context"]["exclude"]) == (3, 5, 0.7, [])
    assert len(config.MODEL_PREDICATES) == 42
