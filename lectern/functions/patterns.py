"""Patterns of Python's ``re`` for Spark's regular expressions.

Users write patterns for Python; Spark's engine reads many of the same signs in another way (word characters, digits,
white space, the dot, ends of lines). The pattern is parsed by Python itself and each construct is written anew in signs
that mean the same to Spark; one that has no counterpart is refused with a reason, before a job starts.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from lectern.functions import fixed


class PatternError(ValueError):
    """The pattern is wrong, or holds a construct that Spark can't match as Python does."""


_CATEGORIES = {
    C.CATEGORY_DIGIT: (r"\p{Nd}", "0-9"),
    C.CATEGORY_SPACE: (fixed.WHITE, r"\x09-\x0d\x20"),
    C.CATEGORY_WORD: (r"\p{L}\p{N}_", "0-9A-Za-z_"),
}
_NEGATED = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD}


def _sign(code: int) -> str:
    return f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, flags: int):
        self.flags = flags

    def _members(self, category, ascii_: bool) -> str:
        return _CATEGORIES[category][ascii_]

    def _class(self, items: list, flags: int) -> str:
        ascii_, inside, negated = bool(flags & re.ASCII), [], False
        for op, value in items:
            if op is C.NEGATE:
                negated = True
            elif op is C.LITERAL:
                inside.append(_sign(value))
            elif op is C.RANGE:
                inside.append(f"{_sign(value[0])}-{_sign(value[1])}")
            elif op is C.CATEGORY and value in _NEGATED:
                inside.append(f"[^{self._members(_NEGATED[value], ascii_)}]")
            elif op is C.CATEGORY:
                inside.append(self._members(value, ascii_))
            else:
                raise PatternError(f"a character class holds {op}")
        held = f"[{''.join(inside)}]"
        # as a look ahead, as engines differ on what a negation covers when classes are nested
        return f"(?:(?!{held})(?s:.))" if negated else held

    def _place(self, where, flags: int) -> str:
        if where is C.AT_BEGINNING_STRING or (where is C.AT_BEGINNING and not flags & re.MULTILINE):
            return r"\A"
        if where is C.AT_BEGINNING:
            return r"(?:\A|(?<=\n))"
        if where is C.AT_END_STRING:
            return r"\z"
        if where is C.AT_END:
            return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
        word = f"[{self._members(C.CATEGORY_WORD, bool(flags & re.ASCII))}]"
        edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        return edge if where is C.AT_BOUNDARY else f"(?!{edge})"

    def _cased(self, text: str, flags: int) -> str:
        return f"(?i{'' if flags & re.ASCII else 'u'}:{text})" if flags & re.IGNORECASE else text

    def write(self, parsed, flags: int) -> str:
        return "".join(self._one(op, value, flags) for op, value in parsed)

    def _one(self, op, value, flags: int) -> str:
        if op is C.LITERAL:
            return self._cased(_sign(value), flags)
        if op is C.NOT_LITERAL:
            return self._cased(f"(?:(?!{_sign(value)})(?s:.))", flags)
        if op is C.ANY:
            return "(?s:.)" if flags & re.DOTALL else r"[^\n]"
        if op is C.IN:
            return self._cased(self._class(value, flags), flags)
        if op is C.AT:
            return self._place(value, flags)
        if op is C.BRANCH:
            return f"(?:{'|'.join(self.write(p, flags) for p in value[1])})"
        if op is C.SUBPATTERN:
            group, add, remove, inner = value
            return f"({'?:' if group is None else ''}{self.write(inner, (flags | add) & ~remove)})"
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            times = f"{{{low},}}" if high is C.MAXREPEAT else f"{{{low},{high}}}"
            return f"(?:{self.write(inner, flags)}){times}{'?' if op is C.MIN_REPEAT else '+' if op is C.POSSESSIVE_REPEAT else ''}"
        if op in (C.ASSERT, C.ASSERT_NOT):
            way, inner = value
            return f"(?{'<' if way < 0 else ''}{'=' if op is C.ASSERT else '!'}{self.write(inner, flags)})"
        if op is C.ATOMIC_GROUP:
            return f"(?>{self.write(value, flags)})"
        if op is C.GROUPREF:
            return self._cased(f"(?:\\{value})", flags)
        if op is C.GROUPREF_EXISTS:
            raise PatternError("a choice by whether a group took part has no counterpart")
        raise PatternError(f"{op} has no counterpart")


def for_spark(pattern: str) -> str:
    """A pattern that matches in Spark where ``re.search(pattern, ...)`` matches in Python.

    Raises PatternError for what isn't a pattern, and for choices by a group. Groups keep their numbers; names go.
    """
    try:
        re.compile(pattern)
        parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError) as e:
        raise PatternError(f"not a pattern: {e}") from e
    if parsed.state.flags & re.LOCALE:
        raise PatternError("matching by the machine's locale has no counterpart")
    writer = _Writer(parsed.state.flags)
    return writer.write(parsed, parsed.state.flags)
