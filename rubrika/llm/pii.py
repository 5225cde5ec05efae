"""Pseudonyms for personal numbers, dates and addresses that keep their format.

A value is found by its shape, checked (Luhn digit of cards, mod 97 of IBANs, ranges of dates and of
social security numbers, octets up to 255, length of phone numbers), and mapped by a keyed Feistel
permutation of all values of its kind. The map is one to one and depends on key, kind and value
alone, so equal values stay equal across documents and formats; punctuation, lengths and check
digits stay as they are or are made right again. Numbers that fail their check are left alone.

Phone numbers and network addresses that nobody can have (an American area code from 0 or 1, an
address of 0, 127 or 224 up) are mapped too, among their like; those in use stay in use.

Cases: null text stays null, empty text empty; values at text borders count; rows, ids and other
columns pass unchanged; the counts replace columns of the same names; an empty table stays empty.
"""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
KEY = "change-me"  # production passes its own secret
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
SLICE = 512

# Shapes. Digits may stand in groups; a match must not touch other word characters.
_SHAPES = re.compile(
    r"(?<![\w.@/+-])(?:"
    r"(?P<iso>\d{4}-\d{2}-\d{2})(?!\d|-\d)"
    r"|(?P<dmy>\d{1,2}([./])\d{1,2}\3\d{4})(?![\w/]|\.\d)"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-]|\.\d)"
    r"|(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w-]|\.\d)"
    r")"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def permute(value: int, size: int, key: str, kind: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over the next even number of bits,
    walked until it lands inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    secret, width = key.encode()[:64], (half + 7) // 8 + 8
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            seen = f"{kind}:{size}:{k}:{right}".encode()
            turn = int.from_bytes(blake2b(seen, key=secret, digest_size=min(64, width)).digest(), "big")
            left, right = right, left ^ (turn & mask)
        value = left << half | right
        if value < size:
            return value


def _digits(text: str, key: str, kind: str) -> str:
    return str(permute(int(text), 10 ** len(text), key, f"{kind}{len(text)}")).zfill(len(text))


def _fill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    each = iter(digits)
    return "".join(next(each) if c.isdigit() else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(found: str, key: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    payload = digits[0] + _digits(digits[1:-1], key, "card" + digits[0])
    return _fill(found, payload + luhn_digit(payload))


def _day(found: str, key: str) -> str | None:
    iso = found[4:5] == "-"
    parts = [int(x) for x in re.split(r"\D", found)]
    year, month, day = parts if iso else parts[::-1]
    swapped = not iso and month > 12  # month first
    if swapped:
        month, day = day, month
    try:
        number = date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    moved = permute(number - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "day")
    new = date.fromordinal(FIRST_DAY + moved)
    if iso:
        return new.isoformat()
    mark = re.search(r"[./]", found)[0]
    first, second = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{first:02d}{mark}{second:02d}{mark}{new.year:04d}"


def _usable(address: int) -> bool:
    return 0 < address >> 24 < 224 and address >> 24 != 127


def _address(found: str, key: str) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    value = parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]
    usable = _usable(value)
    while True:  # walks within the usable ones, or within the others
        value = permute(value, 1 << 32, key, "ip")
        if _usable(value) == usable:
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _social(found: str, key: str) -> str | None:
    digits = found.replace("-", "")

    def right(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    if not right(digits):
        return None
    while True:
        digits = _digits(digits, key, "ssn")
        if right(digits):
            return _fill(found, digits)


def _phone(found: str, key: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    code = re.match(r"\+(\d{1,3})[ .(-]", found)
    head = code[1] if code else "1" if found[0] == "+" and len(digits) == 11 and digits[0] == "1" else ""
    body = digits[len(head) :]
    if not (10 if not head else 7) <= len(body) <= 14 or len(digits) > 15:
        return None
    american = len(body) == 10 and head in ("", "1")

    def right(d: str) -> bool:
        return not american or (d[0] in "23456789" and d[3] in "23456789")

    usable = right(body)
    while True:
        body = _digits(body, key, "phone" + (head or "1"))
        if right(body) == usable:
            return _fill(found, head + body)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _iban(found: str, key: str) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
        return None
    numbers = re.sub(r"\D", "", plain[4:])
    if not numbers:
        return None
    body = _fill(plain[4:], _digits(numbers, key, "iban"))
    check = 98 - _iban_number(plain[:2] + "00" + body) % 97
    each = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(each) for c in found)


def _name(local: str, key: str) -> str:
    """The part before @: letters stay letters, digits digits, marks where they are."""
    value, size = 0, 1
    for c in local:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        if base > 1:
            value = value * base + (int(c) if base == 10 else ord(c.lower()) - 97)
            size *= base
    shape = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in local)
    value = permute(value, size, key, "mail" + shape)
    out = []
    for c in reversed(local):
        if c.isdigit():
            value, d = divmod(value, 10)
            out.append(str(d))
        elif c.isalpha():
            value, d = divmod(value, 26)
            out.append(chr((65 if c.isupper() else 97) + d))
        else:
            out.append(c)
    return "".join(reversed(out))


_MAKERS = {"iso": _day, "dmy": _day, "ip": _address, "ssn": _social, "phone": _phone, "card": _card}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, found: str, key: str) -> str | None:
    """The replacement of a value, or None where its check fails."""
    if kind == "iban":
        return _iban(found, key)
    if kind == "mail":
        return _name(found, key)
    return _MAKERS[kind](found, key)


def replace(text: str, key: str) -> tuple[str, int, int]:
    """The text with pseudonyms, the numbers and addresses replaced, and the dates replaced."""
    edits: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text[max(0, at - 64) : at])
        if local and _DOMAIN.match(text, at + 1):
            edits.append((at - len(local[0]), at, pseudonym("mail", local[0], key), "mail"))
        at = text.find("@", at + 1)
    for m in _SHAPES.finditer(text):
        new = pseudonym(m.lastgroup, m[0], key)
        if new is None and m.lastgroup == "phone":
            # Digits in the shape of a phone number may be a card.
            new = pseudonym("card", m[0], key)
        if new is not None:
            edits.append((m.start(), m.end(), new, m.lastgroup))
    for m in _IBAN.finditer(text):
        new = pseudonym("iban", m[0], key)
        if new is not None:
            edits.append((m.start(), m.end(), new, "iban"))
    if not edits:
        return text, 0, 0
    out, end, days, kept = [], 0, 0, 0
    for a, b, new, kind in sorted(edits):
        if a >= end:
            out += text[end:a], new
            end = b
            kept += 1
            days += kind in ("iso", "dmy")
    return "".join(out) + text[end:], kept - days, days


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text, and ``n_numbers`` and ``n_dates`` replaced."""
    docs = docs.drop("n_numbers", "n_dates")
    docs = docs.withColumn(text, docs[text].cast("string"))
    place = docs.columns.index(text)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_numbers", T.LongType()), T.StructField("n_dates", T.LongType())]
    )

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                done = [(None, 0, 0) if t is None else replace(t, key) for t in part.column(place).to_pylist()]
                texts, numbers, days = zip(*done)
                columns = part.columns
                columns[place] = pa.array(texts, pa.string())
                columns += [pa.array(numbers, pa.int64()), pa.array(days, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)
