"""Predicates on arrays of tags, and aliases."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exists(arr: Column, test, value) -> Column:
    return F.exists(arr, lambda t: test(t, value))


def tag_filter(tags: Column, *, min_num=None, max_num=None, has_any=None, has_all=None, has_none=None, any_startswith=None, any_endswith=None, in_any=None, any_match=None, none_match=None, logic: str = "and", ignore_case: bool = True) -> Column:
    """Whether an array, taken as a set, passes the tests given, joined by ``logic``; null counts as empty.

    Values are one or more strings; patterns must match from the start of a tag. Without any
    test the answer is true for "and", false for "or".
    """
    low = lambda s: s.lower() if ignore_case else s
    arr = F.coalesce(F.array_distinct(F.transform(tags, F.lower) if ignore_case else tags), F.array().cast("array<string>"))
    every = lambda v: [low(x) for x in ([v] if isinstance(v, str) else v)]
    flag = "(?i)" if ignore_case else ""
    some = lambda f, v: reduce(lambda a, b: a | b, [_exists(arr, f, x) for x in v])
    given = lambda v: F.array(*map(F.lit, every(v)))
    patterns = lambda v: [f"^{flag}(?:{x})" for x in ([v] if isinstance(v, str) else v)]
    tests = []
    if min_num is not None:
        tests.append(F.size(arr) >= min_num)
    if max_num is not None:
        tests.append(F.size(arr) <= max_num)
    if has_any is not None:
        tests.append(F.arrays_overlap(arr, given(has_any)))
    if has_all is not None:
        tests.append(F.size(F.array_except(given(has_all), arr)) == 0)
    if has_none is not None:
        tests.append(~F.arrays_overlap(arr, given(has_none)))
    if any_startswith is not None:
        tests.append(some(lambda t, x: t.startswith(x), every(any_startswith)))
    if any_endswith is not None:
        tests.append(some(lambda t, x: t.endswith(x), every(any_endswith)))
    if in_any is not None:
        tests.append(some(lambda t, x: t.contains(x), every(in_any)))
    if any_match is not None:
        tests.append(some(lambda t, x: t.rlike(x), patterns(any_match)))
    if none_match is not None:
        tests.append(~some(lambda t, x: t.rlike(x), patterns(none_match)))
    join = (lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b)
    return reduce(join, tests) if tests else F.lit(logic == "and")


def tag_counts(rows: DataFrame, column: str = "tags") -> DataFrame:
    """(tag, n) over all rows."""
    return rows.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def alias_map(rules: list[tuple[str, str | None]], vocabulary: list[str]) -> dict[str, str | None]:
    """tag -> alias by the first rule whose pattern finds something in it; others keep their name."""
    return {t: next((new for pattern, new in rules if re.search(pattern, t)), t) for t in vocabulary}


def aliased(tags: Column, rules: list[tuple[str, str | None]]) -> Column:
    """Tags renamed by the first rule that fits (None drops them), each once, in order."""

    def rename(t: Column) -> Column:
        out = None
        for pattern, new in rules:
            case = (t.rlike(pattern), F.lit(new).cast("string"))
            out = F.when(*case) if out is None else out.when(*case)
        return t if out is None else out.otherwise(t)

    return F.array_distinct(F.filter(F.transform(tags, rename), lambda t: t.isNotNull()))
