"""Escape decoders: pure functions, and the same as Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities known by name; a non-breaking space is a plain one here.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "lbrace": "{", "rbrace": "}"}
ENTITY = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);")
JS = re.compile(r"\\u\{([0-9a-fA-F]+)\}")
JS4 = re.compile(r"\\u([0-9a-fA-F]{4})")
JS2 = re.compile(r"\\x([0-9a-fA-F]{2})")
CSS = re.compile(r"\\([0-9a-fA-F]{1,6})[ \t\n]?")


def point(value: int) -> str:
    """The character; ValueError above U+10FFFF, which makes a whole channel fail, as it should."""
    return chr(value)


def join_surrogates(text: str) -> str:
    """Pairs of escaped surrogates are one character; single ones can't be written."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def entities(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] != "#":
            return NAMED.get(e.lower(), m[0])
        if e[1] in "xX":
            return point(int(e[2:], 16))
        digits = re.match(r"\d+", e[1:])  # as much of it as is a decimal number
        return point(int(digits[0])) if digits else point(-1)

    return join_surrogates(ENTITY.sub(one, text))


def js_escapes(text: str) -> str:
    for pattern in (JS, JS4, JS2):
        text = pattern.sub(lambda m: point(int(m[1], 16)), text)
    return join_surrogates(text)


def css_escapes(text: str) -> str:
    return join_surrogates(CSS.sub(lambda m: point(int(m[1], 16)), text))


def percent(text: str) -> str | None:
    """None where the bytes aren't UTF-8."""
    try:
        return unquote_to_bytes(re.sub(r"%(?![0-9a-fA-F]{2})", "%25", text)).decode("utf-8")
    except UnicodeDecodeError:
        return None


LOW = "abcdefghijklmnopqrstuvwxyz"
TURN = str.maketrans(LOW + LOW.upper(), LOW[13:] + LOW[:13] + LOW[13:].upper() + LOW[:13].upper())


def rot13(text: str) -> str:
    return text.translate(TURN)


def _udf(f: Callable[[str], str | None]):
    """Null for null, and where the decoder fails."""

    def safe(x: str | None) -> str | None:
        try:
            return None if x is None else f(x)
        except (ValueError, OverflowError):
            return None

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([safe(x) for x in texts.to_pylist()], pa.string())

    return run


decode_entities, decode_js, decode_css = _udf(entities), _udf(js_escapes), _udf(css_escapes)
