"""Passages of texts and their features.

Texts are cut at sentence ends and line breaks by built-in functions; passages longer than
``WINDOW`` characters are read in overlapping windows, so every character of a text is in some passage.
Numbers and sample or gene codes are masked, which lets equal sentences about other samples
be scored once. A passage's features are hashed words, word pairs and character trigrams of the
text after disguises (letter case, marks, look-alike letters, digits for letters, stretched,
split or starred words, broken encoding) are undone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 400
STEP = 300
#: Number of hashed features; bounds every table of feature statistics.
DIM = 1 << 20


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Every pattern fails at once on a character that cannot begin a match.
_INVISIBLE = r"[\u00ad\u200b-\u200f\u2060\ufeff]+"
_MARKUP = r"<[^<>]{1,200}>|&nbsp;"
_MASKED = (
    r"[A-Z](?<![\p{L}\p{Nd}_].)(?:CGA[-A-Z0-9]{4,20}|\d{2,6}-[A-Z]|[A-Z]{1,4}\d{1,3})\b"
    r"|\d(?<![\p{L}\d].)\d*+(?:[.,:]\d++)*+(?![\p{L}\d])"
)
_ENDS = r"(?=[.!?…:;])(!\d|[.!?…]['\")\]»]{0,2}|[:;]-?[()])\s+"
_LAUGHS = r"(\s(?:[lL][oO][lL]|[hH][aA] ?[hH][aA]|[xX][dD]))\s+(?=\p{Lu})"
_RUN_ON = r"(?= )(?<=[\p{Ll}\d]) (?=\p{Lu}['’]?\p{Ll}+\s\p{Ll})"


def _readings(parts: Column) -> Column:
    """Sentences, and by themselves also what follows a colon, is quoted, or runs on without a full stop."""
    after_colon = F.flatten(F.transform(F.filter(parts, lambda p: p.contains(": ")), lambda p: F.slice(F.split(p, r":\s+", 2), 2, 1)))
    quoted = F.flatten(F.transform(F.filter(parts, lambda p: p.rlike("[\"»“”]")), lambda p: F.regexp_extract_all(p, F.lit("[\"«“„]([^\"»“”]{4,})[\"»“”]"), F.lit(1))))
    run_on = F.flatten(F.transform(F.filter(parts, lambda p: p.rlike(r"^\P{L}*+\p{Ll}")), lambda p: F.split(p, _RUN_ON, 2)))
    return F.concat(parts, after_colon, quoted, run_on)


def passages(text: Column) -> Column:
    """The distinct masked passages of a text as an array; empty for NULL and blank text."""
    t = F.regexp_replace(F.regexp_replace(text, _INVISIBLE, ""), _MARKUP, " ")
    # a line break is put behind every end of a sentence, which is cheaper than splitting by a look behind
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _MASKED, "0"), _ENDS, "$1\n"), _LAUGHS, "$1\n")
    clean = F.transform(F.array_distinct(_bound(F.split(t, r"[\r\n]+"), _readings)), lambda p: F.trim(F.regexp_replace(p, r"[\s\p{Z}]+", " ")))
    windows = F.flatten(F.transform(clean, lambda p: F.when(F.length(p) <= WINDOW, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / F.lit(STEP)).cast("int")), lambda i: F.substring(p, i * STEP + 1, F.lit(WINDOW))))))
    return F.coalesce(F.array_distinct(F.filter(windows, lambda p: p.rlike(r"\p{L}"))), F.array().cast("array<string>"))


# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = str.maketrans("авеёкмнорстухіјѕαεικνορτυχ", "abeekmhopctyxijsaeiknoptux")
STANDS_FOR = str.maketrans("013457@$€|!", "oieastaseii")
_BROKEN = re.compile("[\u00c2\u00c3][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]|\u00e2\u20ac")
_WORDISH = re.compile(r"[^\s]+")
_SPLIT = re.compile(r"(?<=[^\W\d_])[-_.·*'’+#%~^](?=[^\W\d_])")
_SPACED = re.compile(r"\b(?:[^\W\d_] ){3,}[^\W\d_]\b")
_RUN = re.compile(r"(.)\1+")
_WORD = re.compile(r"[a-z]+")


def plain(text: str) -> str:
    """``text`` in lower-case Latin letters with disguises undone."""
    if _BROKEN.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            try:
                text = text.encode("latin-1").decode("utf-8")
            except UnicodeError:
                text = _BROKEN.sub("", text)
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOK_ALIKES)
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)

    def undo(m: re.Match) -> str:
        word = m[0]
        core = word.rstrip(".,;:!?\"')]")
        if any(c.isalpha() for c in core) and not core.isalpha():
            return core.translate(STANDS_FOR) + word[len(core):]
        return word

    text = _WORDISH.sub(undo, text)
    text = _SPLIT.sub("", text)
    return _RUN.sub(r"\1", text)


def features(text: str) -> list[int]:
    """Hashed features of a passage, with repetitions."""
    words = _WORD.findall(plain(text))
    out = [zlib.crc32(b"w" + w.encode()) & (DIM - 1) for w in words]
    out += [zlib.crc32(f"p{a} {b}".encode()) & (DIM - 1) for a, b in zip(words, words[1:])]
    for w in words:
        padded = f" {w} ".encode()
        out += [zlib.crc32(padded[i : i + 3]) & (DIM - 1) for i in range(len(padded) - 2)]
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
