"""From a string column to an array of terms, in expressions of the engine alone.

An analyzer is a function of columns, so that analysis stays in the JVM and in one scan; they nest, as in
`stopped(standard)`. White space means ASCII white space. An analyzer may have a `matches(column, term)`, which says whether
a term is among those of the column without making them all; None where it can't tell.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

# English function words; the empty string counts as one. By length, to keep the list readable.
STOP_WORDS = frozenset(
    """i a
    us we to so or on of no my me it is in if he do by be at as an am
    yet you who why was too tis the she say own our off nor not may let its how him his her has had got get for did can but are any and all
    your with will whom when what were twas they this then them that than some says said rather only often must most might like just into hers have from ever else does dear been also able
    would where which while wants their there these since should other least every could cannot about after among across almost because either however likely neither""".split()
) | {""}


_SPACE = " \t\n\r\f\x0b"


def keyword(c: Column) -> Column:
    """The value itself as the only term."""
    return F.array(c)


def standard(c: Column) -> Column:
    """Trimmed, in lower case, split at white space and - , ; : . (empty terms stay where a separator ends the text)."""
    return F.split(F.btrim(F.lower(c), F.lit(_SPACE)), r"[\s\x0B\-,;:.]+")


_BETWEEN = f"{_SPACE}-,;:."


def _standard_matches(c: Column, term: str) -> Column | None:
    if not term:
        return None
    if any(x in term for x in _BETWEEN):
        return F.lit(False)
    text = F.lower(c)
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.contains(text, F.lit(term)) & text.rlike(rf"(?:^|[\s\x0B\-,;:.]){quoted}(?:[\s\x0B\-,;:.]|\z)")


standard.matches = _standard_matches


def lowered(inner: Analyzer) -> Analyzer:
    return lambda c: F.transform(inner(c), F.lower)


def stopped(inner: Analyzer, words: frozenset[str] = STOP_WORDS) -> Analyzer:
    """Without stop words; the order and the repetitions of other terms stay."""
    listed = sorted(words)

    def run(c: Column) -> Column:
        return F.filter(inner(c), lambda t: ~t.isin(listed))

    if hasattr(inner, "matches"):
        run.matches = lambda c, term: F.lit(False) if term in words else inner.matches(c, term)
    return run


def lexer(rules: list[tuple[str, str]], keep: str = "TOKEN") -> Analyzer:
    """A tokenizer of ordered rules (name, pattern): at each place the first rule that matches wins, and the text of
    rules named `keep` is given. Characters that no rule matches are skipped. Patterns must have no groups that capture."""
    for name, pattern in rules:
        if re.compile(pattern).groups:
            raise ValueError(f"rule {name} has a capturing group; use (?:...)")
    either = "|".join(f"({p})" for _, p in rules)
    kept = [k for k, (name, _) in enumerate(rules, 1) if name == keep]
    if not kept:
        return lambda c: F.filter(F.array(c), lambda t: F.lit(False))
    if len(rules) == 1:
        return lambda c: F.regexp_extract_all(c, F.lit(either), F.lit(1))

    def run(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(either), F.lit(0))
        groups = [F.regexp_extract_all(c, F.lit(either), F.lit(k)) for k in kept]
        # a token is kept if one of the kept rules' groups took it, which is then not empty
        return F.filter(F.transform(found, lambda t, i: F.when(F.greatest(*[F.length(F.get(g, i)) for g in groups], F.lit(0)) > 0, t)), lambda t: t.isNotNull())

    return run


def over(values: Column, analyzer: Analyzer | None) -> Column:
    """Terms of every string of an array, in order."""
    return values if analyzer is None else F.flatten(F.transform(values, analyzer))
