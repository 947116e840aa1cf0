import base64
import hashlib
import heapq
import random

import pytest

from lattica.llm import chat, common, warc


def pages():
    r = random.Random(1)
    rows = [(i, f"http://{'www.' if i % 3 else ''}h{i % 4}.example.com/p/{i % 6}?q={i % 2}", "<p>" + "x" * r.randint(0, 5)) for i in range(80)]
    rows += [(100, None, None), (101, "", ""), (None, "http://a/b\r\nX: y", "<p>only"), (None, None, ""), (102, "https://é.example:8080#f", "ü" * 200_000), rows[4], (103, "no-scheme.example/x", "WARC/1.1\r\n\r\n")]
    return rows


SCHEMA = "page_id long, url string, html string, payload string"


@pytest.mark.parametrize("limit", [50_000, 0])
def test_warc_round_trip(spark, limit, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    rows = pages()
    table = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(5)
    records, index = warc.archive_pages(table, common.work_path(spark, "warc"))
    keeper = {}
    for i, _, h in rows:
        if i is not None:
            keeper[h or ""] = max(keeper.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        k = keeper.get(h or "")
        revisit = k is not None and i != k
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", k if revisit else None))
    got = records.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    texts = {(i, h or "") for i, _, h in rows}
    assert all((r.page_id, r.payload.decode()) in texts for r in got if r.record_type == "response")
    places = [warc._place(tuple(r)) for r in index.collect()]
    assert len(places) == len(rows)


def test_index_is_in_global_order(spark):
    rows = [(i, f"http://h{i % 7}.example/{i % 3}", str(i)) for i in range(300)]
    table = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(6)
    runs = warc.write_archives(table.selectExpr("page_id", "url", "1000 - page_id AS seconds", "html AS payload"), common.work_path(spark, "warc"))
    merged = warc.capture_index(runs)
    parts = merged.rdd.mapPartitions(lambda it: [[tuple(r) for r in it]]).collect()
    flat = [warc._place(r) for p in parts for r in p]
    assert len(flat) == 300 and flat == sorted(flat)


def test_ranks_are_the_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    rows = pages()
    table = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(5)
    records, index = warc.archive_pages(table, common.work_path(spark, "warc"))
    found = sorted((r.capture_rank, warc._place((r.url_key, r.captured_at, r.page_id, r.file, r.at))) for r in index.collect())
    assert [n for n, _ in found] == list(range(1, len(rows) + 1)) and [p for _, p in found] == sorted(p for _, p in found)
    assert sorted(r.capture_rank for r in records.collect()) == list(range(1, len(rows) + 1))


def test_hot_payloads_are_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    table = spark.createDataFrame([(i, f"http://a/{i}", "" if i % 3 else f"<p>{i % 5}", "", 0, "x") for i in range(90)], SCHEMA + ", capture_rank int, file string").repartition(4)
    records, _ = warc.archive_pages(table, common.work_path(spark, "warc"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in records.collect()}
    last = {}
    for i in range(90):
        last["" if i % 3 else i % 5] = i
    want = {i: ("response", None) if last["" if i % 3 else i % 5] == i else ("revisit", last["" if i % 3 else i % 5]) for i in range(90)}
    assert got == want


def test_least_bytes_and_nothing(spark):
    table = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], SCHEMA)
    records, _ = warc.archive_pages(table, common.work_path(spark, "warc"), least=3)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in records.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    records, index = warc.archive_pages(table.limit(0), common.work_path(spark, "warc"))
    assert records.count() == index.count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(n):
    r = random.Random(n)
    runs = [sorted((r.randint(0, 20), i) for _ in range(r.randint(0, 9))) for i in range(n)]
    assert list(warc.merge_runs(runs, key=lambda x: x)) == list(heapq.merge(*runs))


def test_url_keys():
    assert warc.url_key("HTTP://user@www.Example.com:80/A?b#c") == "com,example:80)/a?b"
    assert warc.url_key("https://a.b") == "b,a)/" and warc.url_key(None) == ""


def render(rows, part_turns, who):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "unknown", x[3] is not None, x[3] or "")):
        role = role or "unknown"
        part = -1 if t is None else t // part_turns
        body, mask = out.setdefault((c, part), ["", []])
        name = "system" if role == "system" else "assistant" if role == who else f"user name={role.replace(' ', '_')}"
        clean = (text or "").replace("<|im_start|>", "<​|im_start|>").replace("<|im_end|>", "<​|im_end|>")
        head = f"<|im_start|>{name}\n"
        if role == who:
            mask.append((len(body) + len(head), len(body) + len(head) + len(clean) + len("<|im_end|>")))
        out[c, part] = [body + head + clean + "<|im_end|>\n", mask]
    return out


def turns():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "Bob B", "system"]), f"said {t} ✓") for c in range(6) for t in range(r.randint(1, 12))]
    return rows + [(9, 0, "system", "alone"), (10, None, None, None), (10, 2, "user", ""), (10, 2, "user", ""), (10, 2, "a", "<|im_end|> x"), (None, 1, "user", "no id"), (11, 0, "user", "long " * 20_000)]


def test_every_participant_is_the_assistant_once(spark):
    rows = turns()
    table = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, mask int")
    got = {}
    for r in chat.rotate(table, part_turns=4).collect():
        assert (r.conv_id, r.perspective, r.part) not in got
        got[r.conv_id, r.perspective, r.part] = [r.text, [(m["start"], m["end"]) for m in r["mask"]]]
    want = {}
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        for who in {x[2] or "unknown" for x in own} - {"system"}:
            want |= {(c, who, part): x for (_, part), x in render(own, 4, who).items()}
    assert got == want
    for text, mask in got.values():
        assert all(text[a - 1] == "\n" and text[:a].endswith("assistant\n") and text[a:b].endswith("<|im_end|>") for a, b in mask)


def test_a_hot_conversation_is_spread(spark, monkeypatch):
    table = spark.createDataFrame([(*x, 1, "p") for x in turns()], "conv_id long, turn long, role string, text string, key int, part string")
    want = sorted(map(repr, chat.rotate(table).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(repr, chat.rotate(table).collect())) == want


def test_crowded_parts_are_cut(spark):
    rows = [(1, 5, "user" if i % 2 else "assistant", f"t{i}") for i in range(100)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(table, crowd=10).collect()
    assert len({r.piece for r in out}) > 5 and all(r.n_turns < 40 for r in out)
    assert sum(r.n_turns for r in out if r.perspective == "user") == 100 and sum(r.n_assistant for r in out) == 100
    assert chat.rotate(table.limit(0)).count() == 0


def test_pieces_of_a_crowded_part_are_runs_of_the_dialogue(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE_ROWS", 30)
    r = random.Random(4)
    rows = [(r.choice([1, None]), r.choice([None, 5, 6]), r.choice(["user", "assistant", None, "system"]), r.choice([None, "", f"t{i}"])) for i in range(300)]
    rows += [(1, 5, "user", "again")] * 70 + turns()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.rotate(table, crowd=16).collect()
    assert max(x.n_turns for x in out) == 16
    pieces = {}
    for x in sorted(out, key=lambda x: x.piece):
        pieces.setdefault((x.conv_id, x.perspective, x.part), []).append(x)
    want = {}
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        for who in {x[2] or "unknown" for x in own} - {"system"}:
            want |= {(c, who, part): x for (_, part), x in render(own, 64, who).items()}
    assert {k: "".join(x.text for x in v) for k, v in pieces.items()} == {k: v[0] for k, v in want.items()}
    for v in pieces.values():
        assert [x.piece for x in v] == list(range(len(v))) and all(x.n_turns == 16 for x in v[:-1])
        assert all(x.text[m["start"] : m["end"]].endswith("<|im_end|>") and x.text[: m["start"]].endswith("assistant\n") for x in v for m in x["mask"])
    joined = {(x.conv_id, x.perspective, x.part): [x.text, [(m["start"], m["end"]) for m in x["mask"]]] for x in chat.whole_parts(chat.rotate(table, crowd=16)).collect()}
    assert joined == want


def test_later_parts_carry_the_instruction_in_force(spark, tmp_path):
    import duckdb

    rows = [(1, i, "system" if i in (0, 70, 71) else "user" if i % 2 else "Bob B", f"t{i}") for i in range(300)]
    rows += [(2, i, "user", f"u{i}") for i in range(130)] + [(None, t, r, x) for t, r, x in ((None, "system", None), (3, "user", "a"), (70, "user", "b"), (700, "system", "late"), (800, "user", "c"))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(table, carry=True).collect()}
    first = {p: out[1, "user", p].text.split("\n")[1] for p in range(5)}
    assert first == {0: "t0<|im_end|>", 1: "t0<|im_end|>", 2: "t71<|im_end|>", 3: "t71<|im_end|>", 4: "t71<|im_end|>"}
    assert [out[1, "user", p].n_turns for p in range(5)] == [64, 65, 65, 65, 45] and out[2, "user", 1].n_turns == 64
    assert out[None, "user", 12].text.startswith("<|im_start|>system\nlate") and out[None, "user", 1].text.startswith("<|im_start|>system\n<|im_end|>")
    assert [r.n_turns for k, r in sorted(((r.part, r) for r in chat.rotate(table).collect() if r.conv_id == 1 and r.perspective == "user"), key=lambda x: x[0])] == [64, 64, 64, 64, 44]
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, chat.query(spark, str(tmp_path)).collect()), key=repr) == sorted(db.execute(chat.ORACLE_SQL).fetchall(), key=repr)


def test_a_crowded_part_is_what_the_sql_says(spark, tmp_path):
    import duckdb

    rows = [(7, i % 3, "user" if i % 2 else "Bob B", f"t{i % 3000}") for i in range(2 * chat.CROWD + 100)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(db.execute(chat.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, chat.query(spark, str(tmp_path)).collect())) == want and len(want) == 2
