"""Text cleaning, tokens and previews as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrika.schemas import MAX_INPUT_CHARS, PREVIEW_CHARS

# Fixed values. Whitespace is the Unicode set plus four separators that count as space too; a
# tag ends at the first '>' of its line, and only '\n' ends a line.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
TAG = r"<[^\n>]*>"
ENTITY = r"&[a-z]+;"
URL = r"(?U)(?:http|www\.)[^\s\x1c-\x1f]+"
# Every tag, entity and URL contains one of these.
MARKERS = ("<", "&", "http", "www.")
SEPARATOR = " [SEP] "

# A token is a run of letters, marks and digits, or one punctuation mark or symbol.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]"


def _accent_table() -> tuple[str, str]:
    """Small accented Latin letters and their base letters, then marks to delete."""
    accented, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(point)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower():
            accented.append(letter)
            plain.append(base)
    accented.extend(chr(point) for point in range(0x300, 0x370))
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def clean_text(text: Column) -> Column:
    """Markup, entities and URLs become spaces; spaces collapse; anything but text is ''.

    Removing one kind never brings up another kind's marker, so one look at the raw text tells
    whether the three patterns need to run at all.
    """
    raw = stripped = text.cast("string")
    for pattern in (TAG, ENTITY, URL):
        stripped = F.regexp_replace(stripped, pattern, " ")
    marked = reduce(or_, [F.contains(raw, F.lit(marker)) for marker in MARKERS])
    spaced = F.regexp_replace(F.when(marked, stripped).otherwise(raw), f"{SPACE}+", " ")
    return F.when(F.typeof(text) == "string", F.coalesce(F.trim(spaced), F.lit(""))).otherwise("")


def combine_title_body(title: Column, body: Column) -> Column:
    """Both parts cleaned, around a separator that stays even beside an empty part."""
    return F.concat(clean_text(title), F.lit(SEPARATOR), clean_text(body))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(NOT_SPACE)


def tokens(text: Column) -> Column:
    """All tokens of a text in order, lower-cased and without accents.

    ``text`` should be a plain column, as it is read more than once: texts of ASCII alone, told
    by their length in bytes, skip the accent table.
    """
    lower = F.lower(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, lower).otherwise(F.translate(lower, ACCENTED, PLAIN))
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(TOKEN), F.lit(0))


def truncate(text: Column, length: int = MAX_INPUT_CHARS) -> Column:
    return F.substring(text, 1, length)


def preview(text: Column, length: int = PREVIEW_CHARS) -> Column:
    shortened = F.concat(F.substring(text, 1, length), F.lit("..."))
    return F.when(F.char_length(text) > length, shortened).otherwise(text)


def percent_text(share: Column) -> Column:
    """``share`` as a percentage with one decimal, rounded half-even on the exact binary value.

    With k the tenths below and n = 2k + 1, the share rounds up when 20x > n. Written as
    16x - n > -4x, both sides are exact doubles near the boundary, so no tie is misjudged.
    """
    x = share * F.lit(100.0)
    k = F.floor(x * 10.0)
    left, right = x * 16.0 - (k * 2 + 1), x * -4.0
    up = (left > right) | ((left == right) & (k % 2 == 1))
    tenths = k + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def utc_date(moment: Column) -> Column:
    """The UTC calendar date, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86400).cast("int"))
