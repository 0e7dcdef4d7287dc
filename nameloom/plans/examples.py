"""Texts that match a pattern, and what a table of patterns says of a text, both by
Python's own regular expressions: answers that don't come from Spark's."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser


def python_pattern(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


def spellings_of(pattern: str) -> list[str]:
    """The shortest text of each alternative at the top of a pattern or of its
    outermost groups."""

    def one(parsed) -> str:
        out = []
        for kind, of in parsed:
            if kind is K.LITERAL:
                out.append(chr(of))
            elif kind is K.NOT_LITERAL or kind is K.ANY:
                out.append("x")
            elif kind is K.IN:
                first, value = of[0]
                out.append("~" if first is K.NEGATE else chr(value) if first is K.LITERAL else chr(value[0]) if first is K.RANGE else "2" if value is K.CATEGORY_DIGIT else " " if value is K.CATEGORY_SPACE else "w")
            elif kind is K.BRANCH:
                out.append(min(map(one, of[1]), key=len))
            elif kind is K.SUBPATTERN:
                out.append(one(of[3]))
            elif kind in (K.MAX_REPEAT, K.MIN_REPEAT):
                out.append(one(of[2]) * of[0])
        return "".join(out)

    def every(parsed) -> list[str]:
        for at, (kind, of) in enumerate(parsed):
            inner = of[1] if kind is K.BRANCH else [of[3]] if kind is K.SUBPATTERN else []
            texts = [t for branch in inner for t in every(branch)]
            if len(texts) > 1:
                before, after = one(parsed[:at]), one(parsed[at + 1 :])
                return [before + t + after for t in texts]
        return [one(parsed)]

    found = re.compile(python_pattern(pattern), re.I)
    return [t for t in every(_parser.parse(python_pattern(pattern), re.I)) if found.search(t)]


def all_matching(rows: list[tuple[str, str]], text: str, wrap: str = "{}") -> list[str]:
    """Labels of the rows whose pattern is found in text, in order."""
    return list(dict.fromkeys(label for pattern, label in rows if re.search(wrap.format(python_pattern(pattern)), text, re.I)))
