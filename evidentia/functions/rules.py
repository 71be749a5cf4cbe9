"""Ordered rule tables, and first-match selection as one generated expression.

A rule table is small and fixed for a query, so its patterns become literals of a WHEN chain: each is compiled once, the first that
hits wins and ends the chain, and no join or regular expression from a column is needed.

Regular expressions are slow on text that they don't match, which is nearly all of it. So each pattern's needed literals are read from its
parsed form: plain strings of which every match has at least one. marked() looks for the distinct literals of all rule sets in the lower-cased text and keeps
what occurs as bits; a pattern is tried only where one of its literals does. Few literals are looked for one by one, many by one automaton. The literals only rule rows out, so the hits are those of the patterns alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, reduce
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rule_table import ALIASES, RULES


@dataclass(frozen=True)
class Rule:
    pattern: str
    category: str
    cwe: str = ""
    severity: str = ""
    operation: str = ""
    control: str = ""


def rules(ruleset: str, lang: str, kind: str) -> list[Rule]:
    """Default rules in order of priority; none for a language without rules."""
    lang = ALIASES.get((ruleset, lang), lang)
    return [Rule(*r[3:]) for r in RULES if r[:3] == (ruleset, lang, kind)]


def read_rules(path: str, kind: str, lang: str) -> list[Rule]:
    """Rules of a user's YAML file: {language: {<kind>s: [{pattern, category, cwe?, severity?, operation?, control?}]}}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = ((yaml.safe_load(f) or {}).get(lang) or {}).get(f"{kind}s") or []
    return [Rule(r["pattern"], r.get("category", ""), r.get("cwe", ""), r.get("severity", ""), r.get("operation", ""), r.get("control", "")) for r in found]


#: Which rule kinds each mode needs.
MODES = {
    "injection": (("injection", "sink"), ("injection", "source")),
    "absence": (("absence", "trigger"), ("absence", "guard")),
    "hygiene": (("hygiene", "check"),),
}
MODES["both"] = MODES["injection"] + MODES["absence"]
MODES["all"] = MODES["both"] + MODES["hygiene"]


def rule_sets(mode: str, lang: str) -> dict[str, list[Rule]]:
    """The rules that a mode needs, by kind."""
    return {kind: rules(ruleset, lang, kind) for ruleset, kind in MODES[mode]}


def rule_frame(spark: SparkSession, given: Iterable[Rule]) -> DataFrame:
    """The rules as a table, with their ordinals."""
    rows = [(k, r.pattern, r.category, r.cwe, r.severity, r.operation, r.control) for k, r in enumerate(given)]
    return spark.createDataFrame(rows, "ordinal int, pattern string, category string, cwe string, severity string, operation string, control string")


@cache
def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern has at its top level; '' if there is none, or if case doesn't count for it."""
    try:
        parsed = _parser.parse(pattern)
    except re.error:  # a pattern that only the other dialect has
        return ""
    ignores_case, best, run = bool(parsed.state.flags & re.I), "", ""
    for kind, value in [*parsed, (None, None)]:
        plain = kind is _constants.LITERAL and not (ignores_case and chr(value).isalpha())
        run = run + chr(value) if plain else ""
        best = max(best, run, key=len)
    return best


#: Literals of a mask word.
WORD_BITS = 62


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of which each is needed, the one whose shortest literal is longer; then the smaller."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


#: Literals that a pattern may need; sets beyond it are not joined further.
MOST_LITERALS = 24


def _spelled(parsed) -> frozenset[str] | None:
    """All strings that a parsed sequence stands for, in lower case, if it has nothing but characters and choices of them; None otherwise, or if they are many."""
    out = frozenset([""])
    for kind, value in parsed:
        if kind is _constants.LITERAL and value < 128:
            own = frozenset([chr(value).lower()])
        elif kind is _constants.IN and all(k is _constants.LITERAL and c < 128 for k, c in value):
            own = frozenset(chr(c).lower() for _, c in value)
        elif kind is _constants.SUBPATTERN:
            own = _spelled(value[-1])
        elif kind is _constants.BRANCH:
            parts = [_spelled(p) for p in value[1]]
            own = None if None in parts else frozenset().union(*parts)
        else:
            return None
        if own is None or len(out) * len(own) > MOST_LITERALS:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _needed(parsed) -> frozenset[str] | None:
    """Lower-case literals of which every match of a parsed sequence has one; None if nothing is known."""
    best, run = None, frozenset([""])
    for kind, value in [*parsed, (None, None)]:
        own = _spelled([(kind, value)]) if kind is not None else None
        if own is not None and len(run) * len(own) <= MOST_LITERALS:
            run = frozenset(a + b for a in run for b in own)
            continue
        best = _better(best, run if "" not in run else None)
        run, inner = own if own is not None else frozenset([""]), None
        if kind is _constants.SUBPATTERN:
            inner = _needed(value[-1])
        elif kind is _constants.ATOMIC_GROUP:
            inner = _needed(value)
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0]:
            inner = _needed(value[2])
        elif kind is _constants.BRANCH:
            parts = [_needed(p) for p in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        best = _better(best, inner)
    return best


@cache
def needed_literals(pattern: str) -> frozenset[str]:
    """Lower-case literals one of which is in the lower-cased text of every match of the pattern; empty if none are known."""
    try:
        return _needed(_parser.parse(pattern)) or frozenset()
    except re.error:  # a pattern that only the other dialect has
        return frozenset()


def _quoted(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: So many literals are looked for one by one; more of them by an automaton, which reads a text once whatever their number.
SINGLY = 40


@cache
def _automaton(patterns: tuple[str, ...]):
    """Finds the literals of the patterns; a literal's value is one number with the bits of all patterns that it serves."""
    import ahocorasick

    bits: dict[str, int] = {}
    for k, p in enumerate(patterns):
        for x in needed_literals(p):
            bits[x] = bits.get(x, 0) | 1 << k
    found = ahocorasick.Automaton()
    for x, own in bits.items():
        found.add_word(x, own)
    found.make_automaton()
    return found


def _masks(patterns: tuple[str, ...], words: list[str]):
    """A function from texts to a struct of mask words: bit k of word w is set if a literal of pattern w * WORD_BITS + k occurs."""

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(patterns)
        out, low = np.zeros((len(words), len(texts)), np.int64), (1 << WORD_BITS) - 1
        for i, text in enumerate(texts.to_pylist()):
            mask = 0
            for _, bits in automaton.iter((text or "").lower()):
                mask |= bits
            w = 0
            while mask:
                out[w, i], mask, w = mask & low, mask >> WORD_BITS, w + 1
        return pa.StructArray.from_arrays([pa.array(o) for o in out], names=words)

    return F.arrow_udf(run, ", ".join(f"{w} bigint" for w in words))


def marked(rows: DataFrame, sets: dict[str, list[Rule]], *columns: str) -> DataFrame:
    """rows with a column for each named set: the ordinal of its first rule that hits any of the columns, null if none does.

    One scan for all sets: the texts are searched for the distinct literals of all rules, and a pattern is tried on what has one of its literals. The
    expressions go to Spark as text, as building some thousand of them one by one takes longer than matching. The marks come out of a generator of one row, because a filter on
    them would else be pushed below the search, where each of its mentions of a mark lower-cases and searches the text again.
    """
    patterns = tuple(p for p in dict.fromkeys(r.pattern for given in sets.values() for r in given) if needed_literals(p))
    place = {p: divmod(k, WORD_BITS) for k, p in enumerate(patterns)}
    low, *words = [f"mark{k}_" for k in range((len(patterns) - 1) // WORD_BITS + 2)]
    literals = {x for p in patterns for x in needed_literals(p)}

    def tried(pattern: str) -> str:
        hit = " OR ".join(f"`{c}` RLIKE {_quoted(pattern)}" for c in columns)
        return f"({words[place[pattern][0]]} & {1 << place[pattern][1]}L) <> 0L AND ({hit})" if pattern in place else hit

    def first(given: list[Rule]) -> str:
        if not given:
            return "CAST(NULL AS INT)"
        chain = "CASE " + " ".join(f"WHEN {tried(r.pattern)} THEN {k}" for k, r in enumerate(given)) + " END"
        if any(r.pattern not in place for r in given):
            return chain
        masks: dict[int, int] = {}
        for r in given:
            w, bit = place[r.pattern]
            masks[w] = masks.get(w, 0) | 1 << bit
        return f"CASE WHEN {' OR '.join(f'({words[w]} & {m}L) <> 0L' for w, m in masks.items())} THEN {chain} END"

    text = F.concat_ws("\n", *columns)
    if len(literals) > SINGLY:
        out = rows.withColumn(low, _masks(patterns, words)(text)).selectExpr("*", *[f"{low}.{w}" for w in words])
    else:
        any_of = lambda p: " OR ".join(f"contains({low}, {_quoted(x)})" for x in sorted(needed_literals(p)))
        mask = [" | ".join(f"IF({any_of(p)}, {1 << bit}L, 0L)" for p, (w, bit) in place.items() if w == k) for k in range(len(words))]
        out = rows.withColumn(low, F.lower(text)).selectExpr("*", *[f"{m} AS {w}" for m, w in zip(mask, words) if m])
    marks = ", ".join(f"{first(given)} AS `{name}`" for name, given in sets.items())
    return out.selectExpr(*[f"`{c}`" for c in rows.columns if c not in sets], f"inline(array(struct({marks})))")


def hits(columns: Iterable[Column], pattern: str) -> Column:
    """Whether the pattern is found in a column. A literal that it needs is looked for first, which is far cheaper."""
    literal = required_literal(pattern)

    def hit(c: Column) -> Column:
        return F.contains(c, F.lit(literal)) & c.rlike(pattern) if literal else c.rlike(pattern)

    return reduce(lambda a, b: a | b, map(hit, columns))


def first_match(given: list[Rule], *columns: Column) -> Column:
    """Ordinal of the first rule that hits any of the columns, null if none does."""
    if not given:
        return F.lit(None).cast("int")
    chain = F.when(hits(columns, given[0].pattern), 0)
    for k, rule in enumerate(given[1:], 1):
        chain = chain.when(hits(columns, rule.pattern), k)
    return chain


def attribute(given: list[Rule], ordinal: Column, name: str) -> Column:
    """An attribute of the rule with this ordinal."""
    if not given:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(getattr(r, name)) for r in given]), ordinal)


def any_match(given: list[Rule], *columns: Column) -> Column:
    return first_match(given, *columns).isNotNull()
