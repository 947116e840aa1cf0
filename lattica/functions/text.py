"""Text functions of the extraction path, as column expressions wherever the JVM's regular expressions can do them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import let_workers_import
from .ids import SPACE, stripped

#: First words of the headers of injected blocks, and what follows each.
BLOCKS = {"CONTEMPLATION": ("STATE",), "CONTINUITY": ("CONTEXT",), "GRAPH": ("CONTEXT", "NOTE"), "GROWTH": ("VECTORS",), "MEMORY": ("INTEGRATION",), "STABILITY": ("CONTEXT",)}
_HEADS = "|".join(f"{a} {b}" for a in sorted(BLOCKS) for b in BLOCKS[a])
_DAYS = "|".join(sorted("Fri Mon Sat Sun Thu Tue Wed".split()))
_BLOCK = rf"(?is)\x5B(?:{_HEADS})\x5D.*?(?=\x5B(?:{'|'.join(sorted(BLOCKS))})|\z)"
_STAMP = rf"\A\x5B(?:{_DAYS}) [0-9]{{4}}(?:-[0-9]{{2}}){{2}} [0-9]{{2}}:[0-9]{{2}} [A-Z]+\x5D\s*"

NOISE = frozenset(
    # English, German, and code, in order of the alphabet.
    """a aber ah all also an any async auch await bitte catch const da danke das dass dein dem den der des dich die dort du each
    ein eine einer er es euer every function gemacht gerne getan haben he hello here hey hi hier hmm huh i ich ihr it ja just
    klar können let machen me mehr mein mich mir my müssen nein no noch note notes now nur oder oh okay please really return
    returns schon sehr sein she sich sie skip sollen some sorry still successfully sure thank thanks that the then there they
    this today tomorrow too try uh um und unser us var very viel wann was we weil well wenn wer werden wie wieder wir wo
    wollen yes you your änder ändern über""".split()
)
_OPENERS = "and are but can did do had has if is it not or so that the then this was were will"
_GERMAN = "bei beim bis gegen nach nur ohne seit unter vor zwischen über"
_DOMAINS = "com de eu io net org"
FILLERS = (
    "actually also although and apparently basically because but even hey if just like maybe no now obviously oh ok only or perhaps plus since so still then well when while yeah yes"
)
STOPS = "a about also an and are as at be been being both but by for from had has have if in is of on or so that the to too was were when where which while who with"
CUTS = "about and at both but by for from in on or to with"
_alt = lambda words: "|".join(words.split())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with one evaluation of ``value``: a lambda binds it."""
    return F.transform(F.array(value), use)[0]


def message_text(content: Column, parts: Column | None = None) -> Column:
    """The text of a message: its content, else the ``text`` or ``content`` of its parts joined by a space; never null."""
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), p["content"], F.lit(""))), " ") if parts is not None else F.lit(None)
    return F.coalesce(content, joined, F.lit(""))


def strip_context(text: Column) -> Column:
    """Injected blocks go up to the next one or the end of the text; then a time stamp at the start goes."""
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    # Few texts have white space at an end, and to look for it takes longer than the rest.
    return bound(F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), _STAMP, ""), lambda t: F.when(ends(t).rlike(SPACE), stripped(t)).otherwise(t))


#: A name that begins and ends with an ASCII letter or digit and has no mark-up inside (a single underscore is none). Cleaning leaves it as it is.
_PLAIN = r"\A(?=[0-9A-Za-z])[^*_`|\x5B]*+(?:_[^*_`|\x5B]*+)?(?<=[0-9A-Za-z])\z"


def strip_markdown(name: Column) -> Column:
    return F.when(name.rlike(_PLAIN), name).otherwise(_unmarked(name))


def _unmarked(name: Column) -> Column:
    for pattern, by in (
        (r"[*]{2}([^*]+)[*]{2}", "$1"), (r"(?:\x2A|_)([^_*]+)(?:\x2A|_)", "$1"), (r"\x5B([^\x5D]+)\x5D\x28[^\x29]+\x29", "$1"), (r"(?i)\A-\s*\x5B[x ]\x5D\s*", ""),
        (r"\A(?:-|•)\s+", ""), (r"\A\x7C\s*", ""), (r"\s*\x7C\z", ""), (r"[`_*]+\z", ""), (r"\A[\s`_*|•-]+", ""),
    ):
        name = F.regexp_replace(name, pattern, by)
    return stripped(name)


def valid_entity_name(name: Column) -> Column:
    """Whether a name can stand for something: not noise, a fragment of a sentence, code or the output of a tool."""
    return F.coalesce((F.length(name) >= 2) & bound(strip_markdown(name), _sound), F.lit(False))


#: What a cleaned name must not match, in one pattern: each further one would read the name again.
_UNSOUND = "|".join([
    r"\A(?![A-Z]{2}\z)[\s\S]{0,2}\z", r"\A[0-9]+\z", r"\A(?:-|[•|*_`]|\x5B|\x5D)", r"(?:-|[•|*_`]|\x5B|\x5D)\z", r"\s[&+]\s",
    r"\A[a-z][^A-Z]{0,4}\z", rf"\A(?i:{_alt(_OPENERS)})\s", r"(?i:successfully|_bytes)", r"_[^_]*+_[^_]*+_",
    r"\s\S++\s++\S++\s++\S++\s",  # five words
    rf"[.](?!(?i:{_alt(_DOMAINS)})\z)\w{{2,4}}\z", r"[<=>;]|[\x28\x29\x5B\x5D\x7B\x7D]",
    rf"\A(?i:{_alt(_GERMAN)})\b\S*+(?:\s++\S++)?\z",  # two words at most
    r"\A(?i:heartbeat|skip)",
])


def _sound(c: Column) -> Column:
    return ~c.rlike(_UNSOUND) & ~F.lower(c).isin(*sorted(NOISE))


#: For Java and Python alike.
_FILLED = rf"(?i)\A(?:(?:{_alt(FILLERS)})\s+)+(?=\S)"
_CUT = rf"(?is)\A(.*?)\s+(?:{_alt(CUTS)})\s.*"
_STOPPED = rf"(?i)(?:\s+(?:{_alt(STOPS)}))+(?![\s\S])"


def clean_subject(phrase: Column) -> Column:
    """Without filler words at the start, but never without any word."""
    return F.regexp_replace(phrase, _FILLED, "")


def trim_object(phrase: Column) -> Column:
    """Up to the first preposition or conjunction inside, without stop words and punctuation at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(phrase, _CUT, "$1"), _STOPPED, ""), r"[!,.:;?]+\z", "")


EMAIL = r"[\w.+-]+@[\w-]+[.][\w.-]+"
MENTION = r"@(\w{2,30})"
URL = r"""https?://[^\s<>)"']+"""
_MONTHS = "april|august|december|february|january|july|june|march|may|november|october|september"
DATE = rf"(?i)\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|(?:{_MONTHS})\s+[0-9]{{1,2}}(?:,?\s*[0-9]{{4}})?)\b"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def raw_entities(text: Column) -> Column:
    """What patterns find, in order: dates, mentions, e-mail addresses, addresses of pages, as (name, type)."""
    typed = lambda names, kind: F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
    return F.concat(typed(found(text, DATE, 1), "DATE"), typed(found(text, MENTION, 1), "PERSON"), typed(found(text, EMAIL), "THING"), typed(found(text, URL), "THING"))


def clean_name(name: Column) -> Column:
    return F.when(name.rlike(_PLAIN), name).otherwise(stripped(F.regexp_replace(_unmarked(name), r"[!,.:;?]+\z", "")))


#: Verbs of each predicate, and the words at which its object ends.
_COMMON = "and at but for from in on or to with"
RELATIONS = {
    "created": ("built created designed developed made wrote", _COMMON),
    "interested_in": ("enjoys? is~interested~in is~into likes? loves?", _COMMON),
    "knows": ("knows? met spoke~with talked~to", _COMMON),
    "located_in": ("based~in is~from is~in lives?~in located~in moved~to", "after and because before but or since"),
    "part_of": ("belongs?~to is~a~component~of is~inside is~part~of", _COMMON),
    "prefers": ("favou?rs? prefers? would~rather", _COMMON),
    "uses": ("is~using runs?~on runs?~with uses?", _COMMON),
    "works_on": ("is~working~on working~on works?~on", _COMMON),
}
_LEAD = r"[A-Za-z]\w{0,}"
_TOKEN = r"\w[\w-]{0,}"


def relation_pattern(predicate: str) -> re.Pattern:
    verbs, ends = RELATIONS[predicate]
    # Longer alternatives first: what follows decides, so the order only saves time.
    verb = "|".join(sorted((v.replace("~", " ") for v in verbs.split()), key=len, reverse=True))
    subject, obj = rf"\b({_LEAD}(?:\s+{_LEAD}){{0,}})", rf"({_TOKEN}(?:\s+{_TOKEN}){{0,3}})"
    return re.compile(rf"{subject}\s+(?:{verb})\s+{obj}(?=\s+(?:{_alt(ends)})\b|[.,;]|\Z)", re.IGNORECASE | re.ASCII)


_PATTERNS = {p: relation_pattern(p) for p in RELATIONS}
_VERBS = {p: re.compile(r"\b(?:" + "|".join(v.replace("~", " ") for v in RELATIONS[p][0].split()) + r")\b", re.IGNORECASE | re.ASCII) for p in RELATIONS}
_STRETCH = re.compile(r"[\w\s-]+", re.ASCII)
ANY_VERB = r"(?i)\b(?:" + "|".join(v.replace("~", " ") for p in sorted(RELATIONS) for v in RELATIONS[p][0].split()) + r")\b"


def _first_words(verbs: str) -> set[str]:
    """The first words of ``verbs``, with and without the letters marked by ``?``."""
    out = {v.split("~")[0] for v in verbs.split()}
    while some := {w for w in out if "?" in w}:
        out = out - some | {w.replace("?", "", 1) for w in some} | {re.sub(r"\w[?]", "", w, count=1) for w in some}
    return out


_FIRST = {p: _first_words(RELATIONS[p][0]) for p in RELATIONS}
_ANY_FIRST = set().union(*_FIRST.values())
_FILLED_RE, _CUT_RE, _STOPPED_RE = (re.compile(x, re.ASCII) for x in (_FILLED, _CUT, _STOPPED))


def relations_in(text: str | None) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) as matched. A match lies within one stretch of words, and white space stands around its verb, so stretches without
    the first word of one are passed over, and long texts without punctuation cost no recursion, as they would in Java."""
    out = []
    for m in _STRETCH.finditer(text or ""):
        piece = text[m.start() : m.end() + 1]
        words = _ANY_FIRST.intersection(piece.lower().split())
        if words:
            for predicate, pattern in _PATTERNS.items():
                if not words.isdisjoint(_FIRST[predicate]) and _VERBS[predicate].search(piece):
                    out += [(x[1].strip(), predicate, x[2].strip()) for x in pattern.finditer(piece)]
    return out


def clean_relations(text: str | None) -> list[tuple[str, str, str]]:
    """``relations_in`` with subjects and objects as ``clean_subject`` and ``trim_object`` leave them, without noise; each once, whatever its case. Their
    letters are of ASCII, where Python and Java agree."""
    out = {}
    for s, predicate, o in relations_in(text):
        s, o = _FILLED_RE.sub("", s), _STOPPED_RE.sub("", _CUT_RE.sub(r"\1", o))
        x, y = s.lower(), o.lower()
        if len(s) >= 2 and len(o) >= 2 and x not in NOISE and y not in NOISE:
            out.setdefault((x, predicate, y), (s, predicate, o))
    return list(out.values())


_FOUND = pa.list_(pa.struct([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string())]))


_TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "predicate", "object")])


@F.arrow_udf(T.ArrayType(_TRIPLE))
def _relations(text: pa.Array) -> pa.Array:
    return pa.array([[{"subject": s, "predicate": p, "object": o} for s, p, o in clean_relations(x)] for x in text.to_pylist()], type=_FOUND)


def relations(text: Column) -> Column:
    """array<struct<subject, predicate, object>>: the ``clean_relations`` of a text. Python workers must know this package."""
    return _relations(F.when(text.rlike(ANY_VERB), text))


def relationships(texts: DataFrame, key: str = "exchange_id", text: str = "text", predicates: tuple[str, ...] | None = None) -> DataFrame:
    """(key, subject, predicate, object, confidence): each relation of a text once, whatever its case."""
    let_workers_import(texts.sparkSession)
    rows = texts.filter(F.col(text).rlike(ANY_VERB)).select(key, F.posexplode(relations(F.col(text))).alias("pos", "r")).select(key, "pos", "r.*")
    if predicates:
        rows = rows.filter(F.col("predicate").isin(*predicates))
    first = rows.groupBy(key, F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o")).agg(F.min_by(F.struct("subject", "object"), "pos").alias("r"))
    return first.select(key, "r.subject", "predicate", "r.object", F.lit(0.7).alias("confidence"))
