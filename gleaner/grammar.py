"""What a token looks like. The prefix, the number of digits and the published example are parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

#: White space as ECMAScript's \s has it, as the inside of a class; Java's and Python's own differ.
BLANKS = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Characters of context kept on each side of a token.
PAD = 60


@dataclass(frozen=True)
class Grammar:
    """`prefix{` + hex digits + `}`; the prefix in this case only, digits in either."""

    prefix: str = "TOKEN"
    digits: int = 16
    example: str | None = None
    #: A pattern of its own instead, e.g. for e-mail addresses; the confusable repair then has nothing to repair.
    custom: str | None = None

    @property
    def pattern(self) -> str:
        return self.custom or f"{re.escape(self.prefix)}\\{{[0-9a-fA-F]{{{self.digits}}}\\}}"

    @property
    def published(self) -> str:
        return self.example or f"{self.prefix}{{0000deadbeef0000}}"

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)

    def find(self, text: str, pad: int = PAD) -> list[tuple[str, int, str]]:
        """(token, index, context) of every token in order; the example is never one."""
        hide = self.published.lower()
        return [(m[0], m.start(), excerpt(text, m.start(), len(m[0]), pad)) for m in self.regex.finditer(text) if m[0].lower() != hide]


SPACES = re.compile(f"[{BLANKS}]+")


def excerpt(text: str, index: int, length: int, pad: int = PAD) -> str:
    """One line around a match: white space collapsed, an ellipsis where it was cut."""
    start, end = max(0, index - pad), min(len(text), index + length + pad)
    return ("…" if start else "") + SPACES.sub(" ", text[start:end]).strip() + ("…" if end < len(text) else "")


DEFAULT = Grammar()
