"""Text helpers as columns, with Unicode whitespace and line ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as whitespace and as line ends, as text and as patterns.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those of SPACES that are space marks (category Zs), and no control characters or line ends.
SPACE_MARKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _holds(c: Column, characters: str) -> Column:
    """Whether c has any of the characters: searches for bytes, which cost far less than a pattern."""
    found = F.contains(c, F.lit(characters[0]))
    for x in characters[1:]:
        found = found | F.contains(c, F.lit(x))
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Words joined by single spaces."""
    c = strip(c)
    usual = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), " {2,}", " ")
    return F.when(_holds(c, SPACES.replace("\n", "").replace(" ", "")), F.regexp_replace(c, f"{WHITESPACE}+", " ")).otherwise(usual)


def split_lines(c: Column) -> Column:
    """Lines without their ends; a last line end opens no line."""
    parts = F.when(_holds(c, ENDS[1:]), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))
    return let(parts, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))


def utf8(c: Column) -> Column:
    """The text of bytes, null where they are not UTF-8."""
    return F.try_validate_utf8(c.cast("string"))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*\z", 1)


def suffix(c: Column) -> Column:
    """Lower-case file suffix with its dot; a dot at either end of the name starts none."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)\A.+(\.[^.]+)\z", 1))


def stem(c: Column) -> Column:
    name = basename(c)
    return F.when(suffix(c) != "", F.regexp_extract(name, r"(?s)\A(.+)\.[^.]+\z", 1)).otherwise(name)


def mime(c: Column) -> Column:
    return F.lower(strip(F.substring_index(c, ";", 1)))


def hard_split(text: Column, limit: Column | int) -> Column:
    """Pieces of at most `limit` characters, cut at the last space that fits; limit must be positive.

    One pass of a pattern: as many characters as may be before the end, or
    before a space, or else as many as may be; the space around is dropped.
    """
    size = (F.lit(limit) if isinstance(limit, int) else limit).cast("string")
    some = F.concat(F.lit(".{1,"), size, F.lit("}"))
    pattern = F.concat(F.lit("(?s)("), some, F.lit(r"\z|"), some, F.lit("(?= )|"), some, F.lit(f"){WHITESPACE}*"))
    return F.transform(F.regexp_extract_all(strip(text), pattern, F.lit(1)), strip)
