"""Patterns that are asked only of texts that hold a piece they need.

Most lines match none of the many patterns that judge them.  Every match of
``other\\s+deduct`` holds "other", so texts without it need no search; looking
for a piece is many times cheaper than running the pattern.  Results are the
same, null for null included.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: More pieces than this cost more than the search.
MOST = 12
_PARSER = re._parser  # type: ignore[attr-defined]


def _exact(items) -> frozenset[str] | None:
    """All strings that a part of a pattern stands for, in lower case, where they are few and of ASCII letters and marks."""
    found = frozenset([""])
    for op, arg in items:
        match str(op):
            case "LITERAL" if arg < 128:
                more: frozenset[str] | None = frozenset([chr(arg).lower()])
            case "SUBPATTERN":
                more = _exact(arg[-1])
            case "BRANCH":
                each = [_exact(x) for x in arg[1]]
                more = frozenset().union(*each) if None not in each else None
            case _:
                more = None
        if more is None or len(found) * len(more) > MOST:
            return None
        found = frozenset(a + b for a, b in product(found, more))
    return found


def _needed(items) -> frozenset[str] | None:
    """Pieces of which every match of a part of a pattern holds one; None if there are none."""
    options: list[frozenset[str]] = []
    run = frozenset([""])

    def flush(next_run: frozenset[str] = frozenset([""])) -> None:
        nonlocal run
        options.append(run)
        run = next_run

    for op, arg in items:
        name = str(op)
        if name == "AT":
            continue
        if name in ("ASSERT", "ASSERT_NOT"):
            if name == "ASSERT" and (inner := _needed(arg[1])) is not None:
                options.append(inner)
            continue
        whole = _exact([(op, arg)])
        if whole is not None and len(run) * len(whole) <= MOST:
            run = frozenset(a + b for a, b in product(run, whole))
            continue
        flush(whole or frozenset([""]))
        if whole is not None:
            continue
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(arg[-1])
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            inner = frozenset().union(*each) if None not in each else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        if inner is not None:
            options.append(inner)
    flush()
    # single letters, digits and blanks keep too few texts out
    good = [o for o in options if len(o) <= MOST and all(len(p) > 1 or (p and not p.isalnum() and not p.isspace()) for p in o)]
    return max(good, key=lambda o: (min(map(len, o)), -len(o)), default=None)


@cache
def pieces(pattern: str) -> tuple[str, ...] | None:
    """Lower-case pieces of which every text that matches holds one; None if the pattern tells of none."""
    try:
        found = _needed(_PARSER.parse(pattern))
    except re.error:
        return None
    # a piece that holds another one is not asked for
    return None if found is None else tuple(sorted(p for p in found if not any(o != p and o in p for o in found)))


class Text:
    """A text column beside its lower case (or a text that holds it): ``rlike`` looks for pieces first."""

    def __init__(self, text: Column, low: Column) -> None:
        self.text, self.low = text, low

    def rlike(self, pattern: str) -> Column:
        need = pieces(pattern)
        if need is None:
            return self.text.rlike(pattern)
        return reduce(Column.__or__, [F.contains(self.low, F.lit(p)) for p in need]) & self.text.rlike(pattern)


def gated(text: Column | Text) -> Text:
    return text if isinstance(text, Text) else Text(text, F.lower(text))
