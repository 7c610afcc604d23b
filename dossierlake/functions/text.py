"""Column functions over text. All but the counting of words stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Unicode white space as a regex class body, written out because `\s` differs
# between regex engines.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
NON_WS = f"[^{SPACE}]"

# The same set by Java's Unicode classes, about eight times faster over long texts.
_FAST_WS = r"(?U)[\s\x1c-\x1f]+"

# The same characters as text, for trimming.
SPACE_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                       *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _fold_tables() -> tuple[str, str]:
    """Letters with a one-character base form, and those base forms, by Unicode rule."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_tables()


def strip(col: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def words(col: Column) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(col, _FAST_WS), "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


# Texts that are counted at a time, so a batch of long ones is never held as Python objects.
_AT_A_TIME = 256


def counted_words(col: Column) -> Column:
    """array<struct<term, tf>>: the different words of `words` and how often each is there, in order of their first place; none for null."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def count(texts: pa.Array) -> pa.Array:
        done = []
        for start in range(0, len(texts), _AT_A_TIME):
            terms, times, ends = [], [], [0]
            for text in texts.slice(start, _AT_A_TIME).to_pylist():
                # str.split() cuts at the characters of SPACE.
                found = Counter((text or "").split())
                terms.extend(found)
                times.extend(found.values())
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int32())], fields=list(kind.value_type))
            done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=kind))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return count(col)


def first_words(col: Column, limit: int = 1000) -> Column:
    """The first `limit` words, joined again by single spaces."""
    return F.array_join(F.slice(words(col), 1, limit), " ")


def fold_accents(col: Column) -> Column:
    """Lower-cased text without diacritics."""
    return F.regexp_replace(F.translate(F.lower(col), _FOLD_FROM, _FOLD_TO), r"[\x{300}-\x{36f}]", "")


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+", " ")


def title_key(col: Column) -> Column:
    """Heading text for comparison: lower case, no leading digits numbering, single spaces."""
    lowered = strip(F.lower(col))
    return collapse_spaces(F.regexp_replace(lowered, rf"^\p{{Nd}}[.\p{{Nd}}]*[).{SPACE}-]*", ""))


def field_key(col: Column) -> Column:
    """A safe field name; the input itself if nothing of it is left."""
    folded = F.regexp_replace(strip(fold_accents(col)), "[ -]", "_")
    kept = F.regexp_replace(folded, r"[^\p{L}\p{N}_]", "")
    trimmed = F.regexp_replace(kept, "^_+|_+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), col)


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def sentences(col: Column, min_chars: int = 10) -> Column:
    """Sentences longer than `min_chars`: cut at white space between an end mark and a capital."""
    cut = rf"(?<=[.!?]){WS}+(?=[A-Z\x{{c0}}-\x{{178}}\[])"
    trimmed = F.transform(F.split(col, cut), lambda s: strip(s))
    return F.filter(trimmed, lambda s: F.length(s) > min_chars)


# Decimal digits of other scripts that number headings and chapters, each set from 0 to 9.
_DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xFF10)


def ascii_digits(col: Column) -> Column:
    """Arabic, Persian, Devanagari, Bengali and full-width digits as 0-9."""
    return F.translate(col, "".join(chr(z + d) for z in _DIGIT_ZEROS for d in range(10)), "0123456789" * len(_DIGIT_ZEROS))


def greater_number(a: Column, b: Column) -> Column:
    """Whether the digits `a` are a greater number than the digits `b`, however many there are."""
    x, y = F.ltrim(ascii_digits(a), F.lit("0")), F.ltrim(ascii_digits(b), F.lit("0"))
    return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x > y))
