"""Patterns that Java gives up sooner: it tries every alternative, and the edge of a word, at every character."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

#: Characters of classes as Java has them without (?U).
CLASSES = {op.CATEGORY_DIGIT: "0123456789", op.CATEGORY_SPACE: " \t\n\x0b\f\r"}


class _Unknown(Exception):
    """The characters that may come first aren't known."""


def _of_class(items) -> set[str]:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 100:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif kind is op.CATEGORY and value in CLASSES:
            out |= set(CLASSES[value])
        else:
            raise _Unknown
    return out


def _firsts(tokens) -> tuple[set[str], bool]:
    """The characters with which a match may begin, and whether it may be empty."""
    out: set[str] = set()
    for kind, value in tokens:
        if kind is op.LITERAL:
            own, empty = {chr(value)}, False
        elif kind is op.IN:
            own, empty = _of_class(value), False
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            own, empty = _firsts(value[2])
            empty = empty or value[0] == 0
        elif kind is op.SUBPATTERN:
            own, empty = _firsts(value[3])
        elif kind is op.BRANCH:
            each = [_firsts(branch) for branch in value[1]]
            own, empty = set().union(*(chars for chars, _ in each)), any(e for _, e in each)
        elif kind in (op.AT, op.ASSERT_NOT):
            own, empty = set(), True
        else:
            raise _Unknown
        out |= own
        if not empty:
            return out, False
    return out, True


def _alternatives(pattern: str) -> bool:
    """Whether a pattern has alternatives outside of its groups."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    depth = 0
    for c in plain:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return True
    return False


def quick(pattern: str) -> str:
    """The same matches, looked for only where one of the characters stands with which they begin.

    Patterns that begin with a letter are searched for it anyway; those with flags, bound to a
    zone's start, or with classes that Python doesn't know stay as they are.
    """
    if "(?i" in pattern or "(?s" in pattern or "(?U" in pattern:
        return pattern
    try:
        tokens = _parser.parse(pattern)
        if not _alternatives(pattern) and (not len(tokens) or tokens[0][0] is op.LITERAL or tokens[0] == (op.AT, op.AT_BEGINNING)):
            return pattern
        chars, empty = _firsts(tokens)
    except (_Unknown, re.error):
        return pattern
    if empty or not chars:
        return pattern
    shown = "".join(sorted(c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02x}" for c in chars))
    return f"(?=[{shown}])(?:{pattern})"
