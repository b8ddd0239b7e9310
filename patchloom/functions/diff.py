"""Line differences: a Myers core for changed lines, difflib for unified text and insertion points."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def split_lines(text: str | None) -> list[str]:
    return text.splitlines() if text else []


def myers(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines on a shortest edit path, after the common ends are taken off."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    # a line that the other side lacks is on no path of equal lines; without those, unlike texts cost little
    has_a, has_b = set(a[start : len(a) - end]), set(b[start : len(b) - end])
    at_x = [i for i in range(start, len(a) - end) if a[i] in has_b]
    at_y = [j for j in range(start, len(b) - end) if b[j] in has_a]
    x, y = [a[i] for i in at_x], [b[j] for j in at_y]
    n, m = len(x), len(y)
    far, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(far.copy())
        for k in range(-d, d + 1, 2):
            i = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            far[k] = i
            if i >= n and j >= m:
                break
        else:
            continue
        break
    middle, i, j = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        v, k = trace[d], i - j
        back = k + 1 if k == -d or (k != d and v.get(k - 1, -1) < v.get(k + 1, -1)) else k - 1
        pi = v.get(back, 0) if d else 0
        pj = pi - back if d else 0
        while i > pi and j > pj and i > 0 and j > 0 and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            middle.append((at_x[i], at_y[j]))
        i, j = pi, pj
    same = [(i, i) for i in range(start)] + middle[::-1]
    return same + [(len(a) - end + i, len(b) - end + i) for i in range(end)]


def changed_lines(old: str | None, new: str | None) -> tuple[list[int], list[int], list[int]]:
    """1-based (modified old, deleted old, added new) lines."""
    a, b = split_lines(old), split_lines(new)
    if not a or not b:
        return [], list(range(1, len(a) + 1)), list(range(1, len(b) + 1))
    modified, deleted, added = [], [], []
    i = j = 0
    for x, y in [*myers(a, b), (len(a), len(b))]:
        if x > i and y > j:
            modified += range(i + 1, x + 1)
        else:
            deleted += range(i + 1, x + 1)
        added += range(j + 1, y + 1)
        i, j = x + 1, y + 1
    return modified, deleted, added


def line_map(old: str | None, new: str | None) -> dict[int, int]:
    """Unchanged lines: old number to new number."""
    return {i + 1: j + 1 for i, j in myers(split_lines(old), split_lines(new))}


def unified(old: str | None, new: str | None, context: int = 3, doubled: bool = False) -> str:
    """Unified diff; doubled keeps line ends and joins by another one."""
    a, b = (old or "").splitlines(keepends=doubled), (new or "").splitlines(keepends=doubled)
    return "\n".join(difflib.unified_diff(a, b, "before", "after", n=context, lineterm="\n" if doubled else ""))


def insertion_point(old: str | None, new: str | None) -> list[int]:
    """Lines around the first pure insertion; none if there is no such."""
    a, b = split_lines(old), split_lines(new)
    for op, i1, _, _, _ in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op == "insert":
            return [1] if i1 == 0 else [len(a)] if i1 >= len(a) else [i1, i1 + 1]
    return []


def diff_context(diff: str) -> list[str]:
    """Changed lines of a diff with the line before and after each run."""
    lines = [x for x in diff.split("\n") if not x.startswith(("---", "+++", "@@"))]
    keep = {j for i, x in enumerate(lines) if x[:1] in "+-" and x for j in (i - 1, i, i + 1)}
    return [x for i, x in enumerate(lines) if i in keep]


_LINES = ArrayType(IntegerType())
CHANGED = StructType([StructField(n, _LINES) for n in ("modified", "deleted", "added")])


@F.pandas_udf(CHANGED)
def changed_lines_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for old, new in pairs:
        yield pd.DataFrame([changed_lines(a, b) for a, b in zip(old, new, strict=True)], columns=["modified", "deleted", "added"])


@F.pandas_udf(StringType())
def unified_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in pairs:
        yield pd.Series([unified(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def unified_doubled_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in pairs:
        yield pd.Series([unified(a, b, doubled=True) for a, b in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def diff_context_udf(diffs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in diffs:
        yield pd.Series(["\n".join(diff_context(x)) for x in batch], dtype=object)


@F.pandas_udf(_LINES)
def insertion_point_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in pairs:
        yield pd.Series([insertion_point(a, b) for a, b in zip(old, new, strict=True)], dtype=object)
