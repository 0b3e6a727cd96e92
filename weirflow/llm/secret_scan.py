"""Secret scans over a trigram inverted index. DataFrame functions only.

Each rule's pattern yields a Boolean trigram query on the driver: a disjunction of trigram sets of which
one must be present as a whole. Documents post the trigrams that queries read; intersecting the postings
gives candidates, and only those are verified by the pattern. A rule with no mandatory trigram scans
every text in full.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import fold

Query = list[frozenset[str]]
ALWAYS: Query = [frozenset()]


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters, else the match is dropped but still consumed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)authorization:\x20?bearer\x20[A-Za-z0-9._~+/=-]{16,}"),
)


def _least(query: Query) -> Query:
    return [q for q in dict.fromkeys(query) if not any(o < q for o in query)]


def _both(a: Query, b: Query) -> Query:
    pairs = [x | y for x in a for y in b]
    return _least(pairs) if len(pairs) <= 64 else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """Exact strings of a part of a pattern (None: not few) and the trigram query that any match meets."""
    exact, query, whole = {""}, ALWAYS, True
    for op, arg in nodes:
        own, needs = None, ALWAYS
        if op is C.LITERAL:
            own = {chr(arg).lower()} if chr(arg).isascii() else None
        elif op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            own = {chr(c).lower() for _, c in arg}
        elif op is C.SUBPATTERN:
            own, needs = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            own = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            needs = _least([q for _, x in parts for q in x])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, inner_needs = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                own = inner | {""}
            elif low >= 1:
                needs = inner_needs
                if inner is not None and low == high and len(inner) ** low <= 64:
                    own = {""}
                    for _ in range(low):
                        own = {x + y for x in own for y in inner}
        elif op is C.AT:
            own = {""}
        if own is not None and len(own) * len(exact) <= 64:
            exact = {x + y for x in exact for y in own}
        else:
            query, exact, whole = _both(_both(query, _of_strings(exact)), needs if own is None else _of_strings(own)), {""}, False
    query = _both(query, _of_strings(exact))
    return (exact if whole else None), query


def trigram_query(pattern: str) -> Query:
    """Disjunction of lower-case trigram sets; one of them lies in the folded text of any match.

    `[frozenset()]` when the pattern has no mandatory trigram."""
    return _walk(_parser.parse(pattern))[1]


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Inverted index (trigram, doc_id) of the given trigrams over folded whole texts."""
    text = F.coalesce(fold(F.col("text")), F.lit(""))
    listed = F.array(*map(F.lit, trigrams))
    return docs.select("doc_id", text.alias("folded")).select("doc_id", F.explode(F.filter(listed, lambda t: F.contains(F.col("folded"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules with mandatory trigrams whose query a document meets."""
    clauses = [(i, r.kind, sorted(q)) for i, (r, q) in enumerate((r, q) for r in rules for q in trigram_query(r.pattern)) if q]
    rows = [(i, kind, t, 1 << n, (1 << len(q)) - 1) for i, kind, q in clauses for n, t in enumerate(q)]
    terms = docs.sparkSession.createDataFrame(rows, "clause int, kind string, trigram string, bit long, full long")
    met = (
        postings(docs, sorted({t for _, _, q in clauses for t in q}))
        .join(F.broadcast(terms), "trigram")
        .groupBy("doc_id", "clause", "kind", "full")
        .agg(F.bit_or("bit").alias("have"))
        .where("have = full")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (s, rank, e) in code points, end exclusive.

    The pieces between matches and the matches themselves, taken in turn, give the places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("found"), kept.alias("kept"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,rank:int,e:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["found"])
        one = F.array(F.struct(s.alias("s"), F.lit(rank).alias("rank"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.length(x["kept"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<s:bigint,rank:int,e:bigint>>")
    return F.when(F.regexp_like(text, pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """Secrets in every whole text of (doc_id, text); other columns are ignored.

    Returns doc_id and `found`, an array of structs (s, rank, e), sorted; `rank` is the rule's place in
    `rules`. A null text is empty and has none. Rows with the same or a null doc_id are each scanned on
    their own text: the index only says which rules may match, and verification decides."""
    # texts meet their candidates by a hash join at every size; one without an id may match any rule
    side = candidates(docs.where("doc_id is not null"), rules).withColumnRenamed("doc_id", "_doc")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = texts.where("doc_id is not null").join(side.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "kinds")
    every = F.array(*(F.lit(r.kind) for r in rules))
    rows = known.unionByName(texts.where("doc_id is null").select("doc_id", "text", every.alias("kinds")))
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, rank)
        if trigram_query(rule.pattern) != ALWAYS:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast("array<struct<s:bigint,rank:int,e:bigint>>"))
        parts.append(spans)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def listed(found: Column, rules: Sequence[Rule]) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
