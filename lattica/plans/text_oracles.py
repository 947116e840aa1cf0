"""DuckDB SQL for the text functions: each rule as an SQL expression, over the same table rows as the queries."""

from __future__ import annotations

from ..functions import names
from ..functions import text as tx
from ..functions.ids import SPACE

_SPACES = SPACE.replace(r"\s", r"\s\v")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def stripped(x: str) -> str:
    return _replace(x, rf"\A{_SPACES}+|{_SPACES}+\z")


def strip_markdown(x: str) -> str:
    for pattern, by in (
        (r"\*\*([^*]+)\*\*", r"\1"), (r"[*_]([^_*]+)[*_]", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?i)\A-\s*\[[x ]\]\s*", ""), (r"\A[-•]\s+", ""), (r"\A\|\s*", ""), (r"\s*\|\z", ""),
        (r"[`_*]+\z", ""), (r"\A[\s`_*|•-]+", ""),
    ):
        x = _replace(x, pattern, by)
    return stripped(x)


def clean_name(x: str) -> str:
    return stripped(_replace(strip_markdown(x), r"[.,;:!?]+\z"))


_NOISE = ", ".join(quoted(w) for w in sorted(tx.NOISE))
_GERMAN = "|".join(w for w in tx._GERMAN.split() if w.isascii())


def valid(table: str, name: str = "name") -> str:
    """A query for the rows of ``table`` with ``valid``."""
    is_ = lambda pattern: f"regexp_matches(c, {quoted(pattern)})"
    bad = [
        "length(c) < 2", f"low IN ({_NOISE})", f"length(c) < 3 AND NOT {is_(r'^[A-Z][A-Z]$')}", is_(r"^\d+$"), f"length(c) <= 3 AND {is_(r'^[a-z]+$')}", is_(r"^[-•|*_`\[\]]"), is_(r"[-•|*_`\[\]]$"),
        is_(r"\s[+&]\s"), f"{is_('^[a-z]')} AND NOT {is_('[A-Z]')} AND length(c) < 6", is_(rf"(?i)^(?:{tx._OPENERS.replace(' ', '|')})\s"), "starts_with(c, '(')",
        "contains(low, 'successfully') OR contains(low, '_bytes')", "length(c) - length(replace(c, '_', '')) >= 3", "words >= 5",
        rf"{is_(r'[.]\w{2,4}$')} AND NOT {is_(r'(?i)[.](?:com|de|eu|io|net|org)$')}", is_(r"[=<>;(){}\[\]]"), f"words <= 2 AND {is_(rf'^(?:(?i:{_GERMAN})|[zü]wischen|über)(?:[^\pL\pN_]|$)')}", is_(r"(?i)^(?:skip|heartbeat)"),
    ]
    return f"""SELECT * EXCLUDE (c, low, words), coalesce(length({name}) >= 2 AND NOT ({' OR '.join(f'({b})' for b in bad)}), false) AS valid
      FROM (SELECT *, lower(c) AS low, len(string_split_regex(c, '\\s+')) AS words FROM (SELECT *, {strip_markdown(name)} AS c FROM {table}))"""


def _alt(words: str) -> str:
    return "|".join(words.split())


def relations(texts: str, predicates=tuple(tx.RELATIONS)) -> str:
    """CTEs (for a recursive WITH) that end in ``relations`` (exchange_id, subject, predicate, object, confidence) of the CTE
    ``texts`` (exchange_id, text). The engine of DuckDB looks at nothing ahead, so matches are taken one by one, and each goes on after the object."""
    out, all_ = [], []
    for predicate in predicates:
        verbs, ends = tx.RELATIONS[predicate]
        verb = "|".join(v.replace("~", " ") for v in verbs.split())
        word, token = r"[A-Za-z]\w*", r"\w[\w-]*"
        pattern = rf"(?is)\A(.*?)\b({word}(?:\s+{word})*)(\s+(?:{verb})\s+)({token}(?:\s+{token}){{0,3}})(?:\s+(?:{_alt(ends)})\b|[.,;]|\z)"
        m = f"regexp_extract(rest, {quoted(pattern)}, ['a', 's', 'v', 'o'])"
        out.append(f"""r_{predicate} AS (
          SELECT exchange_id, text AS rest, 0 AS n, '' AS s, '' AS o FROM {texts} WHERE regexp_matches(text, {quoted(rf'(?i)\b(?:{verb})\b')})
          UNION ALL
          SELECT exchange_id, substr(rest, length(m.a) + length(m.s) + length(m.v) + length(m.o) + 1), n + 1, m.s, m.o FROM (SELECT *, {m} AS m FROM r_{predicate}) WHERE m.s <> ''
        )""")
        all_.append(f"SELECT exchange_id, n, s, {quoted(predicate)} AS predicate, o FROM r_{predicate} WHERE n > 0")
    subject = _replace("trim(s)", rf"(?i)\A(?:(?:{_alt(tx.FILLERS)})\s+)+")
    head = f"regexp_replace(trim(o), {quoted(rf'(?is)\A(.*?)\s+(?:{_alt(tx.CUTS)})\s.*\z')}, '\\1')"
    obj = _replace(_replace(head, rf"(?i)(?:\s+(?:{_alt(tx.STOPS)}))+\z"), r"[.,;:!?]+\z")
    noise = f"lower(subject) NOT IN ({_NOISE}) AND lower(object) NOT IN ({_NOISE})"
    return ", ".join(out) + f""", r_all AS (SELECT exchange_id, n, predicate, {subject} AS subject, {obj} AS object FROM ({' UNION ALL '.join(all_)}))
    , relations AS (
      SELECT exchange_id, arg_min(subject, n) AS subject, predicate, arg_min(object, n) AS object, 0.7::DOUBLE AS confidence
      FROM r_all WHERE length(subject) >= 2 AND length(object) >= 2 AND {noise} GROUP BY exchange_id, lower(subject), predicate, lower(object)
    )"""


_DECORATED = """decorated AS (
  SELECT CASE p_partkey % 9 WHEN 0 THEN '**' || p_name || '**' WHEN 1 THEN '*' || p_name || '*' WHEN 2 THEN '[' || p_name || '](https://part.example/' || p_partkey || ')' WHEN 3 THEN '- [ ] ' || p_name
    WHEN 4 THEN '- [X] ' || p_name WHEN 5 THEN '• ' || p_name WHEN 6 THEN '| ' || p_name || ' |' WHEN 7 THEN '`' || p_name || '`' ELSE replace(p_name, ' ', '_') END AS name FROM part
  UNION SELECT c_name FROM customer UNION SELECT unnest(string_split(text, ' ')) FROM documents WHERE text IS NOT NULL
)"""
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_LAST = "upper(string_split(p_name, ' ')[-1][1]) || string_split(p_name, ' ')[-1][2:]"
_MESSAGES = f"""said AS (
  SELECT 'c' || conv_id AS exchange_id, turn, trim(text) AS text FROM conversations WHERE role <> 'system' AND length(trim(coalesce(text, ''))) > 10
  UNION ALL SELECT 'p' || p_partkey, 0, 'Ask @part_' || p_partkey || ' and Prof. ' || {_TITLE} || ' in Port ' || {_LAST} || ' about it on 2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || '.' FROM part
  UNION ALL SELECT 'p' || p_partkey, 1, {_TITLE} || ' Labs uses Engine' || p_partkey || ', see https://part.example/' || p_partkey || ' or mail p' || p_partkey || '@part.example; If Anna works on ' || {_TITLE} || ' for both.' FROM part
), texts AS (
  SELECT exchange_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM said GROUP BY exchange_id HAVING length(string_agg(text, chr(10) || chr(10))) >= 20
)"""


def _found(pattern: str, group: int, kind: str, order: int) -> str:
    return f"SELECT exchange_id, {order} AS rule, unnest(regexp_extract_all(text, {quoted(pattern)}, {group})) AS raw, generate_subscripts(regexp_extract_all(text, {quoted(pattern)}, {group}), 1) AS place, {quoted(kind)} AS entity_type FROM texts"


_RULES = [(p, 1, k) for k, p in names.RULES] + [(tx.DATE, 1, "DATE"), (tx.MENTION, 1, "PERSON"), (tx.EMAIL, 0, "THING"), (tx.URL, 0, "THING")]
SQL = {
    "strip_markdown": f"WITH {_DECORATED} SELECT name, {strip_markdown('name')} AS out FROM decorated",
    "valid_entity_name": f"WITH {_DECORATED} SELECT name, valid FROM ({valid('decorated')})",
    "extract_relationships": f"""WITH RECURSIVE texts AS (
        SELECT 'd' || doc_id AS exchange_id, text FROM documents UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations
        UNION ALL SELECT 's' || s_suppkey, s_name || ' lives in ' || n_name || ' and it knows ' || r_name || '; so it works on Order ' || s_suppkey || ' for both.' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      ), {relations('texts')} SELECT * FROM relations""",
    "exchange_extraction": f"""WITH RECURSIVE {_MESSAGES}, raw AS ({' UNION ALL '.join(_found(p, g, k, i) for i, (p, g, k) in enumerate(_RULES))}
      ), cleaned AS (SELECT exchange_id, rule, place, {clean_name('raw')} AS name, entity_type FROM raw
      ), sound AS (SELECT * FROM ({valid('cleaned')}) WHERE valid AND length(name) >= 2 AND lower(name) NOT IN ({_NOISE})
      ), once AS (SELECT exchange_id, min(struct_pack(rule := rule, place := place, name := name, entity_type := entity_type)) AS e FROM sound GROUP BY exchange_id, lower(name)
      ), found AS (SELECT exchange_id, e.name AS name, e.entity_type AS entity_type, row_number() OVER (PARTITION BY exchange_id ORDER BY e) AS pos FROM once QUALIFY pos <= 15
      ), {relations('texts')}, ends AS (SELECT *, 1 AS row FROM relations
      ), named AS (SELECT * FROM ({valid('ends', 'subject')}) WHERE valid
      ), kept AS (SELECT * EXCLUDE (valid), valid AS object_valid FROM ({valid('(SELECT * EXCLUDE (valid) FROM named)', 'object')}) WHERE valid
      )
      SELECT exchange_id, 'entity' AS part, name AS a, entity_type AS b, NULL AS c FROM found
      UNION ALL SELECT exchange_id, 'triple', subject, predicate, object FROM kept
      UNION ALL SELECT a.exchange_id, 'pair', a.name, b.name, NULL FROM found a JOIN found b ON a.exchange_id = b.exchange_id AND a.pos < b.pos""",
}
