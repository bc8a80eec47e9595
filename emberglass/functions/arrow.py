"""The few functions that Spark has no counterpart of, on Arrow batches."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EMOJI = re.compile("[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
#: Digits and signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"})
#: Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans({"а": "a", "β": "b", "В": "b", "¢": "c", "©": "c", "ϲ": "c", "ԁ": "d", "е": "e", "€": "e", "ё": "e", "ϝ": "f", "ԍ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "κ": "k", "ⅼ": "l", "м": "m", "η": "n", "о": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "я": "r", "ѕ": "s", "$": "s", "т": "t", "τ": "t", "υ": "u", "µ": "u", "ν": "v", "ω": "w", "х": "x", "×": "x", "у": "y", "¥": "y", "ʐ": "z"})


def _styled(text: str) -> str:
    """Letters in a mathematical or enclosed style as plain lower-case letters."""
    if text.isascii():
        return text
    out = []
    for c in text:
        d = unicodedata.normalize("NFKD", c) if ord(c) > 0x2000 else c
        out.append(d.lower() if len(d) == 1 and d != c and d.isascii() and d.isalpha() else c)
    return "".join(out)


def clean(text: str, o: dict) -> str:
    """The steps of text cleaning, in their fixed order."""
    if o["remove_emoji"]:
        text = _EMOJI.sub("", text)
    if o["space"]:
        text = _SPACE.sub(" ", text)
    if o["l33t"]:
        text = re.sub(r"\|(?=\d)", "1", text).translate(_LEET)
    if o["homoglyph"]:
        text = _styled(text).translate(_ALIKE)
    if o["unicode_normalize"]:
        text = unicodedata.normalize(o["form"], text)
    if o["unidecode"]:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii())
    text = text.upper() if o["upper"] else text.lower() if o["lower"] else text
    if o["remove_space"]:
        text = _SPACE.sub("", text)
    return _PUNCTUATION.sub("", text) if o["remove_punctuation"] else text


def cleaner(options: dict):
    """A column function that cleans text with literal options; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else clean(t, options))

    return F.pandas_udf(run, "string")


def murmur3_32(data: bytes, seed: int = 42) -> int:
    """Murmur3 x86 32-bit, unsigned."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h, n = seed, len(data)
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    scramble = lambda k: (rot((k * c1) & mask, 15) * c2) & mask
    whole = n - n % 4
    for i in range(0, whole, 4):
        h = (rot(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < n:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= n
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    return h ^ (h >> 16)


def murmur3(c: Column) -> Column:
    """Murmur3 of text with seed 42, as an unsigned number."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else murmur3_32(t.encode()))

    return F.pandas_udf(run, "bigint")(c)


def long_ipv6(c: Column) -> Column:
    """All eight groups of an IPv6 address without leading zeros; null where invalid."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else ":".join(g.lstrip("0") or "0" for g in ipaddress.IPv6Address(t).exploded.split(":"))
        except ValueError:
            return None

    return F.pandas_udf(_series(one), "string")(c)


def _series(one):
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


#: What answers mail-exchanger lookups; replace it to reach a resolver. The default knows no domain.
resolver = lambda domain: None


def mx_lookup(c: Column) -> Column:
    """Least address that takes a domain's mail, by the module's ``resolver``; never computed ahead or twice."""
    ask = resolver
    return F.pandas_udf(_series(lambda d: None if d is None else ask(d)), "string").asNondeterministic()(c)
