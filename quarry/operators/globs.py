"""Name patterns: full globs, minimal globs, ignore rules and the package filter chain."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed


def glob_regex(pattern: str) -> str:
    """A regular expression of a case-sensitive glob: ``*``, ``?`` and ``[set]`` (F8)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            negated = inside.startswith("^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", inside.removeprefix("^"))
            out, i = f"{out}[{'^' * negated}{body}]", end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.sub(r"(\W)", r"\\\1", c, flags=re.ASCII)
        i += 1
    return f"^{out}$"


def glob(c: Column, pattern: str) -> Column:
    """Whether a name matches a glob; an empty pattern and a bare ``*`` are errors, as they would match all (F8)."""
    if pattern in ("", "*"):
        raise ValueError("a pattern must not be empty or match every name")
    return c.rlike(glob_regex(pattern))


def mini_glob(c: Column, pattern: str) -> Column:
    """The minimal glob of filters.

    ``*`` matches all, stars alone none, ``@s/*`` a scope, ``x/*`` a beginning; one star
    splits beginning and end, which may overlap; with more stars every piece must occur.
    """
    pattern = pattern.strip()
    if pattern == "*":
        return F.lit(True)
    if not pattern.strip("*"):
        return F.lit(False)
    if pattern.endswith("/*"):
        return c.startswith(pattern[:-1] if pattern.startswith("@") else pattern[:-2])
    pieces = pattern.split("*")
    if len(pieces) == 1:
        return c == pattern
    if len(pieces) == 2:
        return c.startswith(pieces[0]) & c.endswith(pieces[1])
    return reduce(lambda a, b: a & b, [c.contains(p) for p in pieces if p])


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of the lines of an ignore file."""
    lines = [x.strip() for x in text.splitlines()]
    rules = [(x.removeprefix("!").strip(), x.startswith("!")) for x in lines if x and not x.startswith("#")]
    return [r for r in rules if r[0]]


def ignored(c: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a name drops it."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        verdict = F.when(mini_glob(c, pattern), F.lit(not negated)).otherwise(verdict)
    return verdict


def allowed(df: DataFrame, name: str, manifests: DataFrame | None) -> DataFrame:
    """Rows named by any manifest; without a manifest all rows."""
    if manifests is None or manifests.isEmpty():
        return df
    return df.join(manifests.select(F.col("name").alias(name)).distinct(), name, "left_semi")


def package_filter(
    df: DataFrame, name: str = "name", include: Sequence[str] = (), include_globs: Sequence[str] = (),
    manifests: DataFrame | None = None, rules: Sequence[tuple[str, bool]] = (), exclude_globs: Sequence[str] = (),
) -> DataFrame:
    """The chain of package filters, all of which must pass."""
    c = F.col(name)
    df = df.where(~c.isin(*fixed.TOOLCHAIN))
    if include:
        df = df.where(c.isin(*include))
    if include_globs:
        df = df.where(reduce(lambda a, b: a | b, [mini_glob(c, p) for p in include_globs]))
    df = allowed(df, name, manifests)
    if rules:
        df = df.where(~ignored(c, rules))
    if exclude_globs:
        df = df.where(~reduce(lambda a, b: a | b, [mini_glob(c, p) for p in exclude_globs]))
    return df
