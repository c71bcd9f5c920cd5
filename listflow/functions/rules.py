"""Ordered first-match rules over a text column.

A rule is ``(label, [pattern, ...])``. Plain patterns are substrings, patterns
that start with ``re:`` are regular expressions.

A long term list is one array literal that a higher-order function walks. Spelled
out as conditions, a hundred terms make a generated method that the JVM refuses
to compile, which is ten times slower than the walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, functions as F

from listflow.functions.text import WORD_CHARS

MAX_INLINE_TERMS = 8
Rule = tuple[str, Sequence[str]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def any_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def sql_string(value: str) -> str:
    """A SQL string literal; used for literals only, never for patterns with columns."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_array(terms: Iterable[str]) -> Column:
    """The terms as one array literal."""
    return F.expr(f"cast(array({', '.join(sql_string(t) for t in terms)}) as array<string>)")


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """True when the text contains one of the terms; null for a null text."""
    terms = list(terms)
    if len(terms) <= MAX_INLINE_TERMS:
        return any_of(text.contains(t) for t in terms)
    return let(text, lambda x: F.exists(term_array(terms), lambda t: F.contains(x, t)))


def starts_with_any(text: Column, terms: Iterable[str]) -> Column:
    return any_of(text.startswith(t) for t in terms)


def word_pattern(patterns: Iterable[str]) -> str:
    """Match one of the patterns as a whole word in any script."""
    return f"(?<![{WORD_CHARS}])(?:{'|'.join(patterns)})(?![{WORD_CHARS}])"


def has_word(text: Column, patterns: Iterable[str]) -> Column:
    return F.rlike(text, F.lit(word_pattern(patterns)))


def first_match(cases: Sequence[tuple[object, Column]], default: object = None) -> Column:
    """The value of the first true condition."""
    (value, condition), *rest = cases
    out = F.when(condition, F.lit(value))
    for value, condition in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def _first_label(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Label of the first term that the text contains; null without one."""
    rows = ", ".join(f"struct({sql_string(term)} AS term, {sql_string(label)} AS label)" for label, term in pairs)
    hits = F.filter(F.expr(f"array({rows})"), lambda r: F.contains(text, r["term"]))
    return F.get(hits, 0)["label"]


def classify(text: Column, rules: Sequence[Rule], default: str | None = None) -> Column:
    """Label of the first rule that matches the text."""
    flat = [(label, p) for label, patterns in rules for p in patterns]

    def run(x: Column) -> Column:
        found = []
        for is_regex, group in groupby(flat, key=lambda r: r[1].startswith("re:")):
            if is_regex:
                found += [F.when(F.rlike(x, F.lit(p[3:])), label) for label, p in group]
            else:
                found.append(_first_label(x, list(group)))
        return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)

    return let(text, run)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value for a key of a small literal map; null when absent."""
    entries = ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms contained in the text, in table order."""
    return let(text, lambda x: F.filter(term_array(terms), lambda t: F.contains(x, t)))
