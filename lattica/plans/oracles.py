"""DuckDB SQL for the graph queries, written from what each operator means, not from its Spark plan."""

from __future__ import annotations

from . import text_oracles

AS_OF = "2024-01-31 00:00:00"
SEEDS = ("user_3", "user_8")

_LOG = """
ev AS (
  SELECT event_id, date_trunc('second', ts) AS ts, user_id AS u, event_type AS kind, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    (40 + CAST(floor(least(value, 60.0)) AS BIGINT)) / 100.0::DOUBLE AS conf
  FROM events
), log AS (
  SELECT event_id AS seq, ts, 'User ' || u AS s,
    CASE kind WHEN 'click' THEN 'uses' WHEN 'view' THEN 'interested_in' WHEN 'purchase' THEN 'knows' WHEN 'signup' THEN 'works_on'
      ELSE CASE WHEN k % 2 = 0 THEN 'created' ELSE 'related_to' END END AS p,
    CASE kind WHEN 'click' THEN 'Item ' || k WHEN 'view' THEN 'Item ' || k WHEN 'purchase' THEN 'User ' || (u - u % 10 + k % 20) WHEN 'signup' THEN 'Project ' || (k % 25)
      ELSE CASE WHEN k % 2 = 0 THEN 'Item ' || k ELSE 'Topic ' || (k % 30) END END AS o,
    conf, 'exchange_' || strftime(ts, '%Y-%m-%d') || '_' || u AS exch, CAST(ts AS DATE) AS sdate
  FROM ev
  UNION ALL SELECT i - 1000, TIMESTAMP '2024-01-01 00:00:00', 'Item ' || i, 'part_of', 'Category ' || (i % 10), 0.9::DOUBLE, NULL, NULL FROM range(100) t(i)
  UNION ALL SELECT i - 500, TIMESTAMP '2024-01-01 00:00:00', 'Project ' || i, 'part_of', 'Category ' || (i % 10), 0.8::DOUBLE, NULL, NULL FROM range(25) t(i)
  UNION ALL SELECT i - 400, TIMESTAMP '2024-01-01 00:00:00', 'Project ' || i, 'uses', 'Item ' || (3 * i), 0.7::DOUBLE, NULL, NULL FROM range(25) t(i)
), mentions AS (
  SELECT seq, ts, s AS name, exch FROM log UNION ALL SELECT seq, ts, o, exch FROM log WHERE NOT starts_with(o, 'User ')
), named AS (
  SELECT *, replace(lower(name), ' ', '_') AS id,
    CASE WHEN starts_with(name, 'User ') THEN 'PERSON' WHEN starts_with(name, 'Item ') THEN 'THING' ELSE 'CONCEPT' END AS kind FROM mentions
)"""
# Of a slot, the writes after the last one of another object than the last.
_TRIPLES = """
, w AS (
  SELECT *, replace(lower(s), ' ', '_') AS subject, replace(lower(o), ' ', '_') AS object FROM log
), slots AS (
  SELECT *, CASE WHEN p IN ('knows', 'part_of', 'member_of', 'works_on') THEN object ELSE '' END AS slot FROM w
), finals AS (
  SELECT subject, p, slot, arg_max(object, seq) AS final FROM slots GROUP BY ALL
), lasts AS (
  SELECT x.subject, x.p, x.slot, f.final, max(CASE WHEN x.object <> f.final THEN x.seq END) AS since
  FROM slots x JOIN finals f USING (subject, p, slot) GROUP BY ALL
), triples AS (
  SELECT 'main' AS agent_id, x.subject, x.p AS predicate, x.object, max(x.conf) AS confidence, arg_min(struct_pack(e := x.exch), x.seq).e AS source_exchange_id,
    arg_min(struct_pack(d := x.sdate), x.seq).d AS source_date, min(x.ts) AS created_at, max(x.ts) AS updated_at, min(x.seq) AS first_seq, max(x.seq) AS last_seq
  FROM slots x JOIN lasts l ON x.subject = l.subject AND x.p = l.p AND x.slot = l.slot AND x.object = l.final AND (l.since IS NULL OR x.seq > l.since)
  GROUP BY x.subject, x.p, x.object
)"""
_ENTITIES = """
, entities AS (
  SELECT 'main' AS agent_id, id, arg_min(name, seq) AS canonical_name, arg_min(kind, seq) AS entity_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mention_count
  FROM named GROUP BY id
)"""
_PAIRS = """
, inex AS (
  SELECT DISTINCT exch, id, max(ts) OVER (PARTITION BY exch, id) AS ts FROM named WHERE exch IS NOT NULL
), cooc AS (
  SELECT a.id AS entity_a, b.id AS entity_b, count(*) AS count, max(greatest(a.ts, b.ts)) AS last_seen
  FROM inex a JOIN inex b ON a.exch = b.exch AND a.id < b.id GROUP BY ALL
)"""


def _with(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_LOG.strip()}{_TRIPLES}{_ENTITIES}{_PAIRS}{''.join(more)}\n{body}"


_T = "subject, predicate, object, round(confidence, 6) AS confidence, source_exchange_id, CAST(source_date AS VARCHAR) AS source_date, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"
_NEW = "updated_at DESC, subject, predicate, object"
_Q = "('" + "', '".join(SEEDS) + "')"
_SEED_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEEDS))

SQL: dict[str, str] = {}

SQL["triple_fold"] = _with(f"SELECT agent_id, {_T}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, first_seq, last_seq FROM triples")
SQL["entity_registry"] = _with(
    "SELECT agent_id, id, canonical_name, entity_type, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, mention_count FROM entities"
)
SQL["cooccurrence_counts"] = _with("SELECT entity_a, entity_b, count, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM cooc")
SQL["normalize_entity_id"] = r"""
WITH n AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part UNION SELECT n_name FROM nation
  UNION SELECT * FROM (VALUES ('  Bob   Smith '), (''), ('ÄRGER  und' || chr(9) || 'Mut')))
SELECT name, CASE WHEN coalesce(name, '') = '' THEN 'unknown' ELSE regexp_replace(trim(lower(name), ' ' || chr(9) || chr(10)), '\s+', '_', 'g') END AS id FROM n
"""
SQL["entity_lookup"] = _with("SELECT id, canonical_name, entity_type, mention_count FROM entities WHERE id = 'user_8'")
SQL["entity_prefix"] = _with("SELECT id, canonical_name FROM entities WHERE canonical_name ILIKE 'uSer 1%' ORDER BY canonical_name, id LIMIT 10")
SQL["triples_for_entity"] = _with(
    f"""SELECT DISTINCT {_T} FROM (
      (SELECT * FROM triples WHERE subject = 'user_8' ORDER BY {_NEW} LIMIT 50) UNION ALL (SELECT * FROM triples WHERE object = 'user_8' ORDER BY {_NEW} LIMIT 50))"""
)
SQL["triple_query"] = _with(f"SELECT {_T} FROM triples WHERE predicate = 'knows' AND agent_id = 'main' ORDER BY triples.updated_at DESC, subject, predicate, object LIMIT 50")
SQL["triples_by_id"] = _with(f"SELECT {_T} FROM triples WHERE subject = 'item_3' OR object = 'item_3' ORDER BY triples.updated_at DESC, subject, predicate, object LIMIT 20")
SQL["triples_by_exchange"] = _with(f"SELECT {_T} FROM triples WHERE source_exchange_id = (SELECT max(source_exchange_id) FROM triples)")
SQL["cooccur_top_for_entity"] = _with(
    """SELECT entity_a, entity_b, count, CASE WHEN entity_a = 'item_3' THEN entity_b ELSE entity_a END AS other
    FROM cooc WHERE entity_a = 'item_3' OR entity_b = 'item_3' ORDER BY count DESC, entity_a, entity_b LIMIT 20"""
)
SQL["cooccur_top"] = _with("SELECT entity_a, entity_b, count FROM cooc ORDER BY count DESC, entity_a, entity_b LIMIT 10")
SQL["recent_entities"] = _with("SELECT id, canonical_name, mention_count FROM entities ORDER BY last_seen DESC, id LIMIT 200")
SQL["predicate_stats"] = _with(
    "SELECT predicate, count(DISTINCT object) AS objects, count(DISTINCT subject) AS subjects, count(*) AS cnt, round(avg(confidence), 6) AS avg_confidence FROM triples GROUP BY predicate"
)
SQL["graph_stats"] = _with(
    """SELECT 'count' AS section, 'entities' AS name, count(*) AS value FROM entities UNION ALL SELECT 'count', 'triples', count(*) FROM triples
    UNION ALL SELECT * FROM (SELECT 'recent', id, mention_count FROM entities ORDER BY last_seen DESC, id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'pair', entity_a || '|' || entity_b, count FROM cooc ORDER BY count DESC, entity_a, entity_b LIMIT 10)"""
)


def _hops(hops: int) -> str:
    end = "CASE WHEN t.subject = h.node THEN t.object ELSE t.subject END"
    return f"""
, hop AS (
  SELECT CASE WHEN subject IN {_Q} THEN object ELSE subject END AS node, 1 AS depth, [subject, predicate, object] AS path, source_exchange_id AS exch, confidence * 0.7::DOUBLE AS score
  FROM triples WHERE (subject IN {_Q} OR object IN {_Q}) AND confidence >= 0.6
  UNION ALL
  SELECT {end}, h.depth + 1, list_concat(h.path, [t.predicate, {end}]), t.source_exchange_id, h.score * 0.7::DOUBLE
  FROM triples t JOIN hop h ON (t.subject = h.node OR t.object = h.node)
  WHERE h.depth < {hops} AND t.confidence >= 0.6 AND EXISTS (SELECT 1 FROM entities e WHERE e.id = h.node) AND NOT list_contains(h.path, {end})
)"""


_BY_EXCHANGE = "SELECT exch AS source_exchange_id, sum(score) AS score, min(depth) AS depth FROM hop WHERE exch IS NOT NULL GROUP BY exch"
for _n in (1, 2, 3):
    SQL[f"multi_hop_{_n}"] = _with(f"SELECT source_exchange_id, round(score, 6) AS score, depth FROM ({_BY_EXCHANGE})", _hops(_n), recursive=True)
SQL["multi_hop_paths"] = _with("SELECT node, depth, array_to_string(path, '/') AS path, exch AS source_exchange_id, round(score, 6) AS score FROM hop", _hops(2), recursive=True)
SQL["single_hop_search"] = _with(
    """SELECT source_exchange_id, round(sum(part), 6) AS score, count(DISTINCT shared) AS shared_count, string_agg(DISTINCT shared, ',' ORDER BY shared) AS shared,
      max(confidence) AS max_confidence, CAST(max(source_date) AS VARCHAR) AS newest
    FROM parts WHERE source_exchange_id IS NOT NULL GROUP BY source_exchange_id HAVING count(DISTINCT shared) >= 1
    ORDER BY round(sum(part), 9) DESC, source_exchange_id LIMIT 20""",
    f"""
, q(seed, id) AS (VALUES {_SEED_VALUES}), sides AS (
  SELECT seed, id, t.*, row_number() OVER (PARTITION BY seed ORDER BY {_NEW}) AS r FROM q JOIN triples t ON t.subject = q.id
  UNION ALL SELECT seed, id, t.*, row_number() OVER (PARTITION BY seed ORDER BY {_NEW}) FROM q JOIN triples t ON t.object = q.id
), direct AS (
  SELECT DISTINCT seed, id, subject, predicate, object, confidence, source_exchange_id, source_date FROM sides WHERE r <= 100
), partners AS (
  SELECT seed, CASE WHEN entity_a = id THEN entity_b ELSE entity_a END AS other, count, row_number() OVER (PARTITION BY seed ORDER BY count DESC, entity_a, entity_b) AS r
  FROM q JOIN cooc ON entity_a = id OR entity_b = id
), near AS (
  SELECT seed, count, t.source_exchange_id, t.source_date, row_number() OVER (PARTITION BY seed, other ORDER BY {_NEW}) AS r
  FROM partners JOIN triples t ON (t.subject = other OR t.object = other) WHERE partners.r <= 5
), parts AS (
  SELECT source_exchange_id, confidence AS part, replace(id, '_', ' ') AS shared, confidence, source_date FROM direct
  UNION ALL SELECT source_exchange_id, 0.1::DOUBLE * count, NULL, NULL, source_date FROM near WHERE r <= 20
)""",
)
_PATTERNS = """
, patterns(id, p1, p2, p3, weight) AS (VALUES (1, 'created', 'part_of', NULL, 0.9::DOUBLE), (2, 'knows', 'works_on', NULL, 0.85::DOUBLE),
  (3, 'interested_in', 'interested_in', NULL, 0.8::DOUBLE), (4, 'works_on', 'part_of', NULL, 0.75::DOUBLE), (5, 'uses', 'created', NULL, 0.7::DOUBLE)%s
), mpaths AS (
  SELECT m.id, a.source_exchange_id AS x1, b.source_exchange_id AS exch, a.confidence * b.confidence * weight AS score, a.subject || '/' || a.object || '/' || b.object AS nodes
  FROM patterns m JOIN triples a ON a.predicate = p1 JOIN triples b ON b.predicate = p2 AND b.subject = a.object WHERE p3 IS NULL AND a.subject IN """ + _Q + """
  UNION ALL
  SELECT m.id, NULL, c.source_exchange_id, a.confidence * b.confidence * c.confidence * weight, a.subject || '/' || a.object || '/' || b.object || '/' || c.object
  FROM patterns m JOIN triples a ON a.predicate = p1 JOIN triples b ON b.predicate = p2 AND b.subject = a.object JOIN triples c ON c.predicate = p3 AND c.subject = b.object
  WHERE a.subject IN """ + _Q + """
), mranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, nodes) AS r FROM mpaths
), meta AS (
  SELECT exch AS source_exchange_id, max(score) AS score FROM mranked WHERE r <= 20 AND exch IS NOT NULL GROUP BY exch
)"""
_THREE = ", (6, 'knows', 'knows', 'works_on', 0.6::DOUBLE), (7, 'knows', 'works_on', 'part_of', 0.5::DOUBLE), (8, 'knows', 'knows', 'uses', 0.4::DOUBLE)"
SQL["meta_path_2step"] = _with("SELECT source_exchange_id, round(score, 6) AS score FROM meta", _PATTERNS % "")
SQL["meta_path_3step"] = _with("SELECT source_exchange_id, round(score, 6) AS score FROM meta", (_PATTERNS % _THREE).replace("), mpaths", "), mpaths", 1).replace("WHERE p3 IS NULL AND", "WHERE p3 IS NULL AND false AND"))
SQL["active_patterns"] = """
SELECT * FROM (VALUES ('created>part_of', 0.9::DOUBLE, 'static'), ('knows>works_on', 0.85::DOUBLE, 'static'), ('interested_in>interested_in', 0.8::DOUBLE, 'static'),
  ('works_on>part_of', 0.75::DOUBLE, 'static'), ('uses>created', 0.7::DOUBLE, 'static')) t(predicates, weight, pattern_type)
"""
_FUSED = f"""
, top AS (SELECT * FROM ({_BY_EXCHANGE}) ORDER BY round(score, 9) DESC, source_exchange_id LIMIT 40
), fused AS (
  SELECT coalesce(top.source_exchange_id, meta.source_exchange_id) AS source_exchange_id, greatest(coalesce(top.score, 0), coalesce(meta.score, 0)) AS score
  FROM top FULL JOIN meta ON top.source_exchange_id = meta.source_exchange_id
)"""
SQL["hop_meta_fusion"] = _with(
    f"SELECT source_exchange_id, round(score, 6) AS score, {len(SEEDS)} AS shared_count, '{','.join(SEEDS)}' AS shared FROM fused ORDER BY round(fused.score, 9) DESC, source_exchange_id LIMIT 20",
    _hops(2), _PATTERNS % "", _FUSED, recursive=True,
)
# The query text names "User 3" and "User 8"; both stand in it as parts.
SQL["graph_search"] = SQL["hop_meta_fusion"]
SQL["entity_context"] = _with(
    f"""SELECT * FROM (
      SELECT 'triple' AS part, predicate AS k, subject || '|' || object AS v, round(confidence, 6) AS n FROM (
        SELECT DISTINCT * FROM ((SELECT * FROM triples WHERE subject = 'user_8' ORDER BY {_NEW} LIMIT 50) UNION ALL (SELECT * FROM triples WHERE object = 'user_8' ORDER BY {_NEW} LIMIT 50)))
      UNION ALL SELECT 'pair', other, '', n FROM (SELECT CASE WHEN entity_a = 'user_8' THEN entity_b ELSE entity_a END AS other, count::DOUBLE AS n
        FROM cooc WHERE entity_a = 'user_8' OR entity_b = 'user_8' ORDER BY count DESC, entity_a, entity_b LIMIT 10))"""
)
_CTX = f"""
, tops AS (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, {_NEW}) AS rank FROM triples WHERE (subject IN {_Q} OR object IN {_Q}) AND confidence >= 0.6
), edges AS (
  SELECT rank, t.subject, t.predicate, t.object, coalesce(a.canonical_name, t.subject) AS subject_name, coalesce(b.canonical_name, t.object) AS object_name
  FROM tops t LEFT JOIN entities a ON a.id = t.subject LEFT JOIN entities b ON b.id = t.object
  WHERE rank <= 50 AND t.predicate <> 'related_to' AND (a.id IS NOT NULL OR b.id IS NOT NULL) AND (b.id IS NULL OR b.mention_count >= 2)
)"""
SQL["graph_context_edges"] = _with("SELECT CAST(rank AS INTEGER) AS rank, subject, predicate, object, subject_name, object_name FROM edges", _CTX)
SQL["graph_context"] = _with(
    """SELECT CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS line, sentence FROM (
      SELECT min(rank) AS first, subject_name || ' ' || CASE WHEN count(*) = 1 THEN max(clause) WHEN count(*) = 2 THEN string_agg(clause, ' and ' ORDER BY rank)
        ELSE string_agg(CASE WHEN back > 1 THEN clause END, ', ' ORDER BY rank) || ', and ' || max(CASE WHEN back = 1 THEN clause END) END AS sentence
      FROM (SELECT *, row_number() OVER (PARTITION BY subject_name ORDER BY rank DESC) AS back,
          CASE predicate WHEN 'created' THEN 'created ' WHEN 'uses' THEN 'uses ' WHEN 'knows' THEN 'knows ' WHEN 'works_on' THEN 'works on '
            WHEN 'interested_in' THEN 'is interested in ' WHEN 'part_of' THEN 'is part of ' END || object_name AS clause FROM edges)
      GROUP BY subject_name ORDER BY first LIMIT 5)""",
    _CTX,
)

# ---- mining ----
LATER = "2024-04-20 00:00:00"
_FAN = """
, st AS (SELECT predicate, count(DISTINCT subject) AS subjects, count(*) AS cnt FROM triples GROUP BY predicate HAVING count(*) >= 5
), fans AS (SELECT predicate, cnt, cnt / subjects::DOUBLE AS fanout FROM st WHERE (SELECT count(*) FROM st) >= 2
), cand AS (
  SELECT a.predicate || '>' || b.predicate AS pattern, 2 AS len, a.fanout * b.fanout AS product, least(a.fanout, b.fanout) AS smallest FROM fans a, fans b
  UNION ALL SELECT a.predicate || '>' || b.predicate || '>' || c.predicate, 3, a.fanout * b.fanout * c.fanout, least(a.fanout, b.fanout, c.fanout)
  FROM fans a, fans b, fans c WHERE (SELECT count(*) FROM fans) <= 6
), capped AS (SELECT * FROM cand WHERE smallest < 10 AND product < pow(50, len)
)"""
SQL["predicate_fanout"] = _with("SELECT predicate, cnt, round(fanout, 6) AS fanout FROM fans", _FAN)
SQL["pattern_candidates"] = _with("SELECT pattern FROM cand", _FAN)
SQL["pattern_candidates_capped"] = _with("SELECT pattern FROM capped", _FAN)
_W = f"1.0::DOUBLE / (1.0::DOUBLE + (epoch(TIMESTAMP '{LATER}') - epoch(%s.updated_at)) / 86400.0::DOUBLE / 90.0::DOUBLE)"


def _evaluated(source: str, three: bool = False) -> str:
    if three:
        paths = f"""SELECT DISTINCT pattern, a.subject AS src, c.object AS dst, a.confidence * b.confidence * c.confidence * ({_W % 'a'}) * ({_W % 'b'}) * ({_W % 'c'}) AS conf
          FROM {source} m JOIN triples a ON a.predicate = split_part(pattern, '>', 1) JOIN triples b ON b.predicate = split_part(pattern, '>', 2) AND b.subject = a.object
          JOIN triples c ON c.predicate = split_part(pattern, '>', 3) AND c.subject = b.object"""
    else:
        paths = f"""SELECT DISTINCT pattern, a.subject AS src, b.object AS dst, a.confidence * b.confidence * ({_W % 'a'}) * ({_W % 'b'}) AS conf
          FROM {source} m JOIN triples a ON a.predicate = split_part(pattern, '>', 1) JOIN triples b ON b.predicate = split_part(pattern, '>', 2) AND b.subject = a.object"""
    return f"""
, epaths AS ({paths}
), eranked AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY src, dst, conf) AS r FROM epaths
), evals AS (
  SELECT pattern, count(*) AS yield, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM triples t WHERE t.subject = src AND t.object = dst)) / count(*)::DOUBLE AS overlap, avg(conf) AS avg_confidence
  FROM eranked WHERE r <= 200 GROUP BY pattern HAVING count(*) >= 3
)"""


_EV = "SELECT pattern, yield, round(overlap, 6) AS overlap, round(avg_confidence, 6) AS avg_confidence FROM evals"
SQL["pattern_eval_2step"] = _with(_EV, _FAN, _evaluated("(SELECT pattern FROM cand WHERE len = 2)"))
SQL["pattern_eval_3step"] = _with(_EV, _evaluated("(VALUES ('knows>works_on>part_of'), ('knows>knows>uses'), ('uses>part_of>uses')) v(pattern)", True).replace("v(pattern) m", "m(pattern)"))
_STATIC = "('created>part_of', 'knows>works_on', 'interested_in>interested_in', 'works_on>part_of', 'uses>created')"
SQL["discover_patterns"] = _with(
    """SELECT pattern, yield, round(overlap, 6) AS overlap, round(score, 6) AS score, round(least(score, 1), 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, yield * (1 - overlap) * avg_confidence AS score, row_number() OVER (ORDER BY round(yield * (1 - overlap) * avg_confidence, 9) DESC, pattern) AS rank FROM evals WHERE overlap <= 0.9) WHERE rank <= 7""",
    _FAN, _evaluated(f"(SELECT pattern FROM capped WHERE pattern NOT IN {_STATIC})"),
)
SQL["validate_patterns"] = _with(
    """SELECT v.pattern, v.kind AS pattern_type, round(CASE WHEN good THEN least(score, 1) ELSE v.weight END, 6) AS weight,
      CASE WHEN v.kind = 'discovered' THEN coalesce(good, false) ELSE true END AS active
    FROM vals v LEFT JOIN (SELECT *, yield * (1 - overlap) * avg_confidence AS score, overlap <= 0.9 AS good FROM evals) e ON e.pattern = v.pattern AND v.kind = 'discovered'""",
    f"""
, vals(pattern, kind, weight) AS (VALUES ('knows>uses', 'discovered', 0.3::DOUBLE), ('uses>created', 'discovered', 0.4::DOUBLE), ('knows>knows', 'discovered', 0.5::DOUBLE), ('knows>works_on', 'static', 0.85::DOUBLE)
){_evaluated("(SELECT pattern FROM vals WHERE kind = 'discovered')")}""",
)

# ---- upkeep ----
SQL["decay_stale"] = _with(
    f"""SELECT subject, predicate, object, round(CASE WHEN old THEN confidence * 0.5 ELSE confidence END, 6) AS confidence, old AS decayed FROM (
      SELECT *, confidence > 0.1 AND (epoch(TIMESTAMP '{LATER}') - epoch(updated_at)) / 86400.0 > 90 AS old FROM triples)"""
)
_TTL = f"""
, ttl(p, cutoff) AS (VALUES ('uses', DATE '2024-01-24'), ('created', DATE '2024-01-17')), gone AS (SELECT t.* FROM triples t JOIN ttl ON t.predicate = p WHERE CAST(created_at AS DATE) <= cutoff)"""
SQL["ttl_expire"] = _with("SELECT subject, predicate, object FROM triples EXCEPT SELECT subject, predicate, object FROM gone", _TTL)
SQL["ttl_expired_counts"] = _with("SELECT predicate, count(*) AS expired FROM gone GROUP BY predicate", _TTL)
_PENDING = "first_seq % 7 = 0"
SQL["pending_resolution"] = _with(
    f"""SELECT e.id, CASE WHEN mention_count > 1 OR floor((epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(last_seen)) / 86400) < 7 THEN 'resolved'
        WHEN floor((epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(last_seen)) / 86400) > 30 THEN 'expired' ELSE 'waiting' END AS outcome
      FROM (SELECT subject AS id FROM triples WHERE {_PENDING} UNION SELECT object FROM triples WHERE {_PENDING}) p JOIN entities e ON e.id = p.id"""
)
_GAPS = """
, deg AS (SELECT e.id, e.canonical_name, e.mention_count, count(t.subject) AS n, count(CASE WHEN t.predicate <> 'related_to' THEN 1 END) AS good
  FROM entities e LEFT JOIN triples t ON t.subject = e.id OR t.object = e.id GROUP BY ALL
), few AS (SELECT id, canonical_name, mention_count, n AS triple_count FROM deg WHERE mention_count > 5 AND n < 3 ORDER BY mention_count DESC, id LIMIT 5
), vague AS (SELECT id, canonical_name, mention_count FROM deg WHERE mention_count > 3 AND n > 0 AND good = 0 ORDER BY id LIMIT 5
), quiet AS (SELECT id, canonical_name, mention_count FROM entities WHERE mention_count > 5 AND CAST(last_seen AS DATE) <= DATE '2024-01-24' ORDER BY mention_count DESC, id LIMIT 3
)"""
SQL["gap_under_connected"] = _with("SELECT * FROM few", _GAPS)
SQL["gap_generic_only"] = _with("SELECT * FROM vague", _GAPS)
SQL["gap_dead_zone"] = _with("SELECT * FROM quiet", _GAPS)
SQL["knowledge_gaps"] = _with(
    """SELECT 'What is on record about ' || canonical_name || '? Mentioned ' || mention_count || ' times, with hardly any relationship.' AS question, 'under_connected' AS type, 'graph:' || id AS source_id FROM few WHERE lower(canonical_name) <> 'topic 1'
    UNION ALL SELECT 'In what way is ' || canonical_name || ' related to the rest? So far it is only associated.', 'generic_only', 'graph:' || id FROM vague WHERE lower(canonical_name) <> 'topic 1'
    UNION ALL SELECT 'Nothing new on ' || canonical_name || ' for over 7 days. Is it as before?', 'temporal_dead_zone', 'graph:' || id FROM quiet""",
    _GAPS,
)

# ---- resolution ----
MENTIONS = ((1, "User 8"), (2, "User"), (3, "Ite"), (4, "project 12 extra"), (5, "Zeta"), (6, "Category 3 x"), (7, "Topic 1 of"), (8, "us"))
CONTEXTS = ((2, "Item 3"), (2, "User 8"), (3, "User 3"), (4, "User 8"), (4, "Category 2"), (6, "Item 3"), (7, "User 4"), (7, "Item 8"))
_RESOLVE = f"""
, m(mention_id, mention) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in MENTIONS)}
), c(mention_id, context) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in CONTEXTS)}
), pre AS (
  SELECT mention_id, mention, e.*, row_number() OVER (PARTITION BY mention_id ORDER BY canonical_name, id) AS r
  FROM m JOIN entities e ON starts_with(lower(canonical_name), substr(lower(mention), 1, CAST(greatest(3, ceil(0.6 * length(mention))) AS BIGINT)))
), newest AS (SELECT * FROM entities ORDER BY last_seen DESC, id LIMIT 200
), options AS (
  SELECT mention_id, mention, id, canonical_name, entity_type, mention_count, last_seen FROM pre WHERE r <= 10
  UNION SELECT mention_id, mention, id, canonical_name, entity_type, mention_count, last_seen FROM m JOIN newest ON contains(lower(canonical_name), lower(mention)) OR contains(lower(mention), lower(canonical_name))
), ctx AS (
  SELECT o.mention_id, o.id, least(o.id, replace(lower(context), ' ', '_')) AS a, greatest(o.id, replace(lower(context), ' ', '_')) AS b FROM options o JOIN c ON c.mention_id = o.mention_id
), together AS (
  SELECT mention_id, id, sum(n)::BIGINT AS together FROM (
    SELECT mention_id, id, (SELECT CASE WHEN entity_a = a AND entity_b = b THEN count END FROM cooc WHERE entity_a = a OR entity_b = a ORDER BY count DESC, entity_a, entity_b LIMIT 1) AS n FROM ctx)
  GROUP BY ALL
), scored AS (
  SELECT o.*, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen)) / 86400) AS days, coalesce(together, 0) AS together FROM options o LEFT JOIN together t ON t.mention_id = o.mention_id AND t.id = o.id
), graded AS (
  SELECT *, least(1.0, 0.5 + CASE WHEN days < 7 THEN 0.3 WHEN days < 30 THEN 0.1 ELSE 0 END + CASE WHEN together >= 2 THEN 0.2 WHEN together > 0 THEN 0.1 ELSE 0 END
    + CASE WHEN mention_count > 10 THEN 0.1 WHEN mention_count > 3 THEN 0.05 ELSE 0 END)::DOUBLE AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY mention_id) AS n,
    lead(mention_count) OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS second FROM graded
), decided AS (
  SELECT m.mention_id, m.mention, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN p.id IS NULL THEN 'new' WHEN n = 1 THEN CASE WHEN score >= 0.8 THEN 'assume' WHEN score < 0.4 THEN 'ask' ELSE 'defer' END
      WHEN p.mention_count / greatest(1, second) > 5 AND days < 7 THEN 'assume' ELSE 'ask' END AS tier, n, score, p.id AS best, x.id AS own
  FROM m LEFT JOIN entities x ON x.id = replace(lower(mention), ' ', '_') LEFT JOIN placed p ON p.mention_id = m.mention_id AND p.r = 1
)"""
SQL["resolve_candidates"] = _with("SELECT mention_id, mention, id, canonical_name FROM options", _RESOLVE)
SQL["resolve_scores"] = _with("SELECT mention_id, id, round(score, 6) AS score, CAST(days AS BIGINT) AS days FROM graded", _RESOLVE)
SQL["resolve_tiers"] = _with(
    """SELECT mention_id, mention, tier, round(CASE WHEN tier IN ('exact', 'new') THEN 1.0 WHEN n = 1 THEN score WHEN tier = 'assume' THEN 0.85 ELSE 0.3 END, 6)::DOUBLE AS confidence,
      CASE WHEN tier = 'exact' THEN own WHEN tier IN ('assume', 'defer') THEN best END AS id FROM decided""",
    _RESOLVE,
)
SQL["resolve_notes"] = _with(
    """SELECT d.mention_id, 'It is not clear which known entity "' || d.mention || '" is.' || chr(10) || 'Known:' || chr(10) || string_agg('- ' || canonical_name || ' (' || lower(entity_type) || ', ' || mention_count || ' mentions, '
        || CASE WHEN days < 7 THEN 'recent' WHEN days < 30 THEN CAST(days AS BIGINT) || 'd ago' ELSE 'not seen recently' END || ')', chr(10) ORDER BY p.r) || chr(10) || 'Asking which one is meant may help.' AS note
      FROM decided d JOIN placed p ON p.mention_id = d.mention_id AND p.r <= 3 WHERE d.tier = 'ask' GROUP BY d.mention_id, d.mention""",
    _RESOLVE,
)
SQL["merge_entities"] = _with(
    f"""SELECT CASE WHEN subject = 'user_8' THEN 'user_3' ELSE subject END AS subject, predicate, CASE WHEN object = 'user_8' THEN 'user_3' ELSE object END AS object, round(confidence, 6) AS confidence,
        CASE WHEN subject = 'user_8' OR object = 'user_8' THEN '{AS_OF}' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at, 'triple' AS part FROM triples
      UNION ALL SELECT k.id, CAST(k.mention_count + g.mention_count AS VARCHAR), g.canonical_name, 0, '', 'entity' FROM entities k, entities g WHERE k.id = 'user_3' AND g.id = 'user_8'"""
)
SQL["canonicalize_triples"] = _with(
    """SELECT b.n, coalesce(s.canonical_name, b.subject) AS subject, b.predicate, coalesce(o.canonical_name, b.object) AS object FROM batch b
      LEFT JOIN (SELECT mention, canonical_name FROM decided JOIN entities ON entities.id = CASE tier WHEN 'exact' THEN own WHEN 'assume' THEN best END) s ON s.mention = b.subject
      LEFT JOIN (SELECT mention, canonical_name FROM decided JOIN entities ON entities.id = CASE tier WHEN 'exact' THEN own WHEN 'assume' THEN best END) o ON o.mention = b.object""",
    _RESOLVE + ", batch(n, subject, predicate, object) AS (VALUES (1, 'User 8', 'knows', 'User'), (2, 'project 12 extra', 'uses', 'Zeta'), (3, 'Category 3 x', 'part_of', 'User 8'))",
)

# ---- archives ----
_CONV = """
WITH said AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS sender, text FROM conversations WHERE role IN ('user', 'assistant')
), marked AS (SELECT *, lag(sender) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM said
), ex AS (
  SELECT conv_id, no - 1 AS exchange_no, max(CASE WHEN sender = 'user' THEN text END) AS user_text, max(CASE WHEN sender = 'agent' THEN text END) AS agent_text
  FROM (SELECT *, CAST(sum(CASE WHEN prev = 'user' AND sender = 'agent' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS no FROM marked) GROUP BY conv_id, no
)"""
_LEN = "length(coalesce(user_text, '')) + length(coalesce(agent_text, ''))"
SQL["pair_exchanges"] = _CONV + "SELECT * FROM ex"
SQL["unprocessed_dates"] = "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events WHERE strftime(ts, '%Y-%m-%d') NOT IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'signup' AND event_id % 97 = 0)"
SQL["backfill_exchanges"] = _CONV + f"SELECT 'exchange_' || conv_id || '_' || exchange_no AS exchange_id, CAST({_LEN} AS INTEGER) AS letters FROM ex WHERE {_LEN} >= 20"
SQL["rebuild_filter"] = _CONV + f"SELECT 'exchange_' || conv_id || '_' || exchange_no AS exchange_id FROM ex WHERE exchange_no < 50 AND {_LEN} >= 30 AND NOT contains(lower(coalesce(user_text, '')), 'heartbeat') AND NOT starts_with(lower(coalesce(user_text, '')), '[subagent context]')"
SQL["ingest_filter"] = """
SELECT conv_id, turn FROM conversations
WHERE role = 'user' AND conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND conv_id % 5 IN (0, 1) AND NOT contains(lower(text), 'heartbeat')
  AND NOT (regexp_matches(text, '(?i)[.](pdf|docx?|txt|epub|md)\\b') AND length(text) > 2000)
"""

# ---- text ----
_TEXTS = """
WITH texts AS (
  SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT * FROM (VALUES ('l1', 'On 2026-01-31, 1/2/26 or March 3, 2026 see http://a.example/b?c=1 (and https://d.example).'), ('l2', 'Mail a.b@mailbox.com or ask @dana_k; may 7'))
)"""


def _extract(pattern: str, group: int = 0) -> str:
    return _TEXTS + f"SELECT k, unnest(regexp_extract_all(text, {pattern}, {group})) AS found FROM texts"


SQL["extract_emails"] = _extract(r"'[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.-]+'")
SQL["extract_mentions"] = _extract(r"'@([A-Za-z0-9_]{2,30})'", 1)
SQL["extract_urls"] = _extract("'https?://[^ \\t\\n\\r\\f\\v<>)\"'']+'")
SQL["extract_dates"] = _extract(
    r"'(?i)\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|(?:april|august|december|february|january|july|june|march|may|november|october|september)\s+[0-9]{1,2}(?:,?\s*[0-9]{4})?)\b'", 1
)
SQL["gazetteer_match"] = _with(
    "SELECT k, canonical_name, entity_type FROM tx JOIN (SELECT * FROM entities ORDER BY last_seen DESC, id LIMIT 200) ON length(canonical_name) >= 3 AND contains(lower(text), lower(canonical_name))",
    """, tx AS (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations
      UNION ALL SELECT 'e' || event_id, 'user ' || user_id || ' saw ITEM ' || CAST(regexp_extract(props, '[0-9]+') AS BIGINT) FROM events)""",
)
SQL["strip_context"] = r"""
SELECT k, out FROM (VALUES ('a', 'Hello'), ('b', ''), ('c', 'Before'), ('d', 'x [OTHER] y')) t(k, out)
UNION ALL SELECT 'd' || doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) FROM documents
"""
SQL["cooccurrence_pairs"] = _with("SELECT exch AS exchange_id, a.id AS name_a, b.id AS name_b FROM inex a JOIN inex b USING (exch) WHERE a.id < b.id")
SQL["enrichment_filter"] = _with(
    """SELECT subject, predicate, object, round(confidence, 6) AS confidence, pending FROM (
      SELECT t.subject, t.predicate, t.object, least(t.confidence + 0.1, 1.0) AS confidence, s.mention_count % 3 = 0 OR coalesce(o.mention_count % 3 = 0, false) AS pending
      FROM triples t JOIN entities s ON s.id = t.subject LEFT JOIN entities o ON o.id = t.object)
    WHERE round(confidence, 9) >= CASE predicate WHEN 'uses' THEN 0.9 WHEN 'knows' THEN 0.75 ELSE 0.7 END"""
)
# What a model says of suppliers: named, typed and related in ways that answers are, some malformed.
SQL["parse_model_response"] = """
WITH s AS (
  SELECT s_suppkey AS n, s_name, n_name, s_suppkey % 4 AS form, s_suppkey % 7 AS kind, (s_suppkey % 13) / 10.0 AS sure FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
SELECT n, 'entity' AS part, s_name AS a, CASE kind WHEN 0 THEN 'ORGANIZATION' WHEN 1 THEN 'PLACE' WHEN 2 THEN 'EVENT' WHEN 3 THEN 'THING' ELSE 'CONCEPT' END AS b, NULL AS c, NULL::DOUBLE AS d FROM s WHERE form < 3
UNION ALL SELECT n, 'entity', n_name, 'PLACE', NULL, NULL FROM s WHERE form < 3
UNION ALL SELECT n, 'relation', s_name, CASE WHEN kind % 2 = 0 THEN 'knows' ELSE 'has_property' END, n_name, CASE WHEN form = 1 THEN 0.8 ELSE least(sure, 1.0) END FROM s WHERE form < 3
"""
SQL.update(text_oracles.SQL)
