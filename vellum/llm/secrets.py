"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression.  Its Boolean trigram query is derived from the
parsed expression (``query_of``): literals, small classes, alternatives and bounded
repeats are spelt out as far as SPELT strings go, whatever they can't do without
becomes an AND of trigrams, alternatives become an OR, and anything else asks for
nothing.  Case is folded on both sides, so a query holds for either.

The index has a posting (trigram, text) for every trigram of any query that occurs
in a lower-cased text; texts go by a hash, so copies share their postings, and two
texts of one hash could only add candidates.  A rule's candidates are the texts that
have a posting for every trigram of one of the query's alternatives: posting lists
are intersected by counting, per text, after partial counts where the text was read.
Candidates come back to the documents by that hash and are verified with the
expression.  A rule without a mandatory trigram, or with an expression that the
parser doesn't know, has no query, and every document is its candidate.

Defined cases: a null text is empty; repeated rows each get their own result; an
empty table gives no rows; positions are in code points, the end exclusive; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, text_of


@dataclasses.dataclass(frozen=True)
class Rule:
    """kind: name.  pattern: expression, in what Java's and Python's syntax share, whose leftmost matches, without overlap,
    count if ``least`` characters of ``group`` match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base rules.  A match of fewer characters than asked for is dropped and not tried again, which a
# bounded repeat gives at once where a run can't be parted; `assign` needs its check on group 2 afterwards.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24),
)
# Public formats of further credentials.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("url_password", r"[a-z][a-z0-9+.-]{0,19}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + ADDED


#: Strings that a part of an expression is spelt out to at most, and alternatives of a query; beyond that it asks for less.
SPELT = 64

# A query is a set of alternatives, each a set of trigrams that must all occur; one empty alternative asks for nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _either(queries: list[Query]) -> Query:
    """The alternatives of all, those left out that ask for all that another one asks for."""
    every = set().union(*queries)
    least = frozenset(a for a in every if not any(b < a for b in every))
    return least if len(least) <= SPELT else ANYTHING


def _both(a: Query, b: Query) -> Query:
    """Both queries, or the one of fewer alternatives where spelling out both is too much."""
    if len(a) * len(b) > SPELT:
        return min((a, b), key=lambda q: (q == ANYTHING, len(q)))
    return _either([frozenset(x | y for x in a for y in b)])


def _strings(op, value) -> set[str] | None:
    """All strings that a part can match, in lower case; None if they are too many or aren't known."""
    if op is C.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is C.IN:
        out: set[str] = set()
        for kind, v in value:
            codes = [v] if kind is C.LITERAL else range(v[0], v[1] + 1) if kind is C.RANGE and v[1] - v[0] < SPELT else None
            if codes is None or any(c > 127 for c in codes):  # classes, negation
                return None
            out |= {chr(c).lower() for c in codes}
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is C.ATOMIC_GROUP:
        return _sequence_strings(value)
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if None in parts else _few(set().union(*parts))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        one = _sequence_strings(inner) if high <= SPELT else None
        out, now = set(), {""}
        for times in range(high + 1 if one else 0):
            if times >= low:
                out |= now
            now = _few({x + y for x in now for y in one})
            if now is None:
                return None if times < high else _few(out)
        return _few(out) if one else None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}
    return None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= SPELT else None


def _sequence_strings(parts) -> set[str] | None:
    out: set[str] | None = {""}
    for op, value in parts:
        own = _strings(op, value)
        out = None if own is None else _few({x + y for x in out for y in own})
        if out is None:
            return None
    return out


def _asked(op, value) -> Query:
    """The query of a part that can't be spelt out."""
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.ATOMIC_GROUP:
        return _sequence(value)
    if op is C.BRANCH:
        return _either([_sequence(p) for p in value[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
        return _sequence(value[2])
    return ANYTHING


def _sequence(parts) -> Query:
    """What parts one after another ask for: trigrams of the strings that stand together, and of the parts between them."""
    run, asked = {""}, ANYTHING
    spelt = lambda strings: _either([frozenset([trigrams(x)]) for x in strings])
    for op, value in parts:
        own = _strings(op, value)
        if own is not None and len(run) * len(own) <= SPELT:
            run = {x + y for x in run for y in own}
        else:
            asked = _both(asked, spelt(run))
            run = {""} if own is None else own
            if own is None:
                asked = _both(asked, _asked(op, value))
    return _both(asked, spelt(run))


def query_of(rule: Rule) -> list[list[str]]:
    """The rule's trigram query, derived from its expression: an OR of ANDs; empty if it has no mandatory trigram."""
    try:
        asked = _sequence(_parser.parse(rule.pattern))
    except re.error:  # Java's own syntax
        return []
    return [] if asked == ANYTHING else sorted(sorted(a) for a in asked)


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set(itertools.chain.from_iterable(a for r in rules for a in query_of(r))))


def text_key(body: Column) -> Column:
    return F.xxhash64(body)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """The inverted index (trigram, text_key): trigrams that some query asks for, and the texts that have them, each pair once."""
    prepare(docs.sparkSession)
    body = text_of(docs, text)
    low = docs.select(text_key(body).alias("text_key"), F.lower(body).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in _vocabulary(rules)]).cast("array<string>"))
    return low.select("text_key", F.explode(found).alias("trigram")).distinct().select("trigram", "text_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, rules): numbers of the rules whose query a text's postings satisfy.

    Each alternative's posting lists are intersected by counting the texts' entries in
    them; the queries, a few rows for each rule, are broadcast.
    """
    asked = [(rank, number, t, len(a)) for rank, rule in enumerate(rules) for number, a in enumerate(query_of(rule)) for t in a]
    queries = index.sparkSession.createDataFrame(asked, "rank int, alternative int, trigram string, needed int")
    met = index.join(F.broadcast(queries), "trigram").groupBy("text_key", "rank", "alternative", "needed").agg(F.count("*").alias("n")).where("n = needed")
    return met.groupBy("text_key").agg(F.collect_set("rank").alias("rules"))


def _matches(rule: Rule, text: Column) -> Column:
    """Array of (start, end) of the matches that count.

    The lengths of what stands before each match and of each match give the
    positions; -1 keeps the empty ends.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    wholes = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else wholes
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(wholes)).alias("gap"), F.transform(wholes, lambda x: F.length(x)).alias("whole"), F.transform(groups, lambda x: F.length(x)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        end = at + x["whole"]
        span = F.array(F.struct(at.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(rows, start, step)["spans"]


def _labelled(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with an array of (start, rank, end, kind), sorted by start and then the rules' order (rank), and its name."""
    prepare(docs.sparkSession)
    key, own, name = (free_name(docs, n) for n in ("text_key", "candidate_rules", "secrets"))
    found = candidates(postings(docs, rules, text=text), rules).withColumnsRenamed({"text_key": key, "rules": own})
    joined = docs.withColumn(key, text_key(text_of(docs, text))).join(found, key, "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    body = text_of(docs, text)
    each = []
    for rank, rule in enumerate(rules):
        may = F.coalesce(F.array_contains(own, rank), F.lit(False)) if query_of(rule) else F.lit(True)
        # the verifier runs on candidates that meet the expression at all
        each.append(_labelled(F.when(may & body.rlike(rule.pattern), _matches(rule, body)).otherwise(none), rank, rule.kind))
    return joined.select(*docs.columns, F.array_sort(F.concat(*each)).alias(name)), name


def listed(name: str, keep=None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    spans = F.col(name) if keep is None else F.filter(F.col(name), keep)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
