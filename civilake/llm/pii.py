"""Personal data: validated numbers and dates replaced by keyed format-preserving pseudonyms.

Equal values get equal pseudonyms in every document and every notation of a
kind, so records stay linked; the key's holder can undo them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
# The notations that are looked at. Each is tried where a digit run begins (or at the sign before it).
IPV4 = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?!\w|\.[0-9])")
DATE_YMD = re.compile(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?!\w|[-/.][0-9])")
DATE_DMY = re.compile(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})(?!\w|[-/.][0-9])")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?!\w|-[0-9])")
PHONE_US = re.compile(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|-[0-9])")
PHONE_WORLD = re.compile(r"\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?!\w|-[0-9])")
CARD = re.compile(r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?!\w|-[0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def date_class(day: date) -> tuple[bool, bool, bool]:
    """What a notation may show of a date: whether month and day need two digits, and whether the day cannot be a month."""
    return day.month > 9, day.day > 9, day.day > 12


#: The dates of each class, in order. A date's pseudonym is of its class, so it fits the same notation and is read back as what it is.
DATES: dict[tuple[bool, bool, bool], list[date]] = {}
for _at in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
    DATES.setdefault(date_class(date.fromordinal(_at)), []).append(date.fromordinal(_at))
PLACES = {day: at for days in DATES.values() for at, day in enumerate(days)}


class Feistel:
    """A keyed permutation of 0..size-1 for any size: a Feistel network over two near-equal parts, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, number: int, value: int, modulus: int) -> int:
        width = min(64, modulus.bit_length() // 8 + 9)
        text = f"{tweak}|{number}|{value}".encode()
        return int.from_bytes(blake2b(text, key=self.key, digest_size=width).digest(), "big") % modulus

    def permute(self, value: int, size: int, tweak: str, undo: bool = False) -> int:
        """The value's image (or, undoing, its origin) among ``size`` values; the tweak separates kinds of values."""
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for number in reversed(range(ROUNDS)) if undo else range(ROUNDS):
                sign = -1 if undo else 1
                if number % 2:
                    right = (right + sign * self._round(tweak, number, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, number, right, a)) % a
            value = left * b + right
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    """The check digit of a card number without it."""
    total = 0
    for at, digit in enumerate(reversed(body)):
        doubled = int(digit) * (2 if at % 2 == 0 else 1)
        total += doubled - 9 * (doubled > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


def refilled(shape: str, digits: str) -> str:
    """A notation with its digits replaced in turn."""
    feed = iter(digits)
    return "".join(next(feed) if "0" <= c <= "9" else c for c in shape)


class Pseudonyms:
    """Finds validated values and gives each its pseudonym under one key."""

    def __init__(self, key: bytes, undo: bool = False):
        self.feistel, self.undo = Feistel(key), undo

    def _digits(self, digits: str, tweak: str) -> str:
        n = len(digits)
        return f"{self.feistel.permute(int(digits), 10**n, f'{tweak}/{n}', self.undo):0{n}d}"

    def _mixed(self, text: str, tweak: str) -> str:
        """Letters stay letters of their case, digits digits, all else as it is."""
        value, size, radixes = 0, 1, []
        for c in text:
            radix = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
            own = ord(c) - 48 if radix == 10 else ord(c.lower()) - 97 if radix == 26 else 0
            value, size = value * radix + own, size * radix
            radixes.append(radix)
        shape = "".join("9" if r == 10 else "a" if r == 26 else c for r, c in zip(radixes, text, strict=True))
        value = self.feistel.permute(value, size, f"{tweak}/{shape}", self.undo)
        out = []
        for c, radix in zip(reversed(text), reversed(radixes), strict=True):
            value, own = divmod(value, radix)
            new = c if radix == 1 else str(own) if radix == 10 else chr(97 + own)
            out.append(new.upper() if c.isupper() else new)
        return "".join(reversed(out))

    def ipv4(self, m: re.Match) -> str | None:
        parts = [int(p) for p in m.groups()]
        if any(p > 255 or str(p) != raw for p, raw in zip(parts, m.groups(), strict=True)):
            return None
        value = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4", self.undo)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, year: int, month: int, day: int) -> date | None:
        try:
            old = date(year, month, day)
        except ValueError:
            return None
        if old not in PLACES:
            return None
        kind = date_class(old)
        days = DATES[kind]
        return days[self.feistel.permute(PLACES[old], len(days), f"date/{kind}", self.undo)]

    def date_ymd(self, m: re.Match) -> str | None:
        year, mark, month, day = m.groups()
        new = self._date(int(year), int(month), int(day))
        return new and f"{new.year:04d}{mark}{new.month:0{len(month)}d}{mark}{new.day:0{len(day)}d}"

    def date_dmy(self, m: re.Match) -> str | None:
        """Day first if that makes a date, else month first."""
        first, mark, second, year = m.groups()
        new = self._date(int(year), int(second), int(first))
        parts = (new.day, new.month) if new else None
        if not new:
            new = self._date(int(year), int(first), int(second))
            parts = (new.month, new.day) if new else None
        return parts and f"{parts[0]:0{len(first)}d}{mark}{parts[1]:0{len(second)}d}{mark}{new.year:04d}"

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = (int(x) for x in m.groups())
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value = self.feistel.permute(value, 898 * 99 * 9999, "ssn", self.undo)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone_us(self, m: re.Match) -> str | None:
        """Area codes and exchanges begin with 2 to 9; both keep to that."""
        digits = "".join(DIGITS.findall(m[0]))
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        if area < 200 or exchange < 200:
            return None
        value = self.feistel.permute(((area - 200) * 800 + exchange - 200) * 10000 + line, 800 * 800 * 10000, "phone", self.undo)
        value, line = divmod(value, 10000)
        area, exchange = divmod(value, 800)
        return refilled(m[0], f"{digits[:-10]}{area + 200:03d}{exchange + 200:03d}{line:04d}")

    def phone_world(self, m: re.Match) -> str | None:
        digits = "".join(DIGITS.findall(m[0]))
        if not 8 <= len(digits) <= 15:
            return None
        return refilled(m[0], digits[:2] + self._digits(digits[2:], f"phone+{digits[:2]}"))

    def card(self, m: re.Match) -> str | None:
        digits = "".join(DIGITS.findall(m[0]))
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body = self._digits(digits[:-1], "card")
        return refilled(m[0], body + luhn_digit(body))

    def iban(self, m: re.Match) -> str | None:
        flat = m[0].replace(" ", "")
        if iban_check(flat[:2], flat[4:]) != flat[2:4]:
            return None
        rest = self._mixed(flat[4:], f"iban/{flat[:2]}")
        feed = iter(flat[:2] + iban_check(flat[:2], rest) + rest)
        return "".join(c if c == " " else next(feed) for c in m[0])

    def numbers(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every validated number and date, from left to right."""
        tries = (
            ("ip", IPV4, self.ipv4), ("date", DATE_YMD, self.date_ymd), ("date", DATE_DMY, self.date_dmy), ("ssn", SSN, self.ssn),
            ("phone", PHONE_US, self.phone_us), ("phone", PHONE_WORLD, self.phone_world), ("card", CARD, self.card),
        )
        at = 0
        while found := DIGIT.search(text, at):
            run = found.start()
            at = DIGITS.match(text, run).end()
            start = run
            while start and text[start - 1] in "+(" and run - start < 2:
                start -= 1
            before = text[start - 1] if start else " "
            if run > 1 and text[run - 2 : run].isalpha() and text[run - 2 : run].isupper() and not (run > 2 and text[run - 3].isalnum()):
                m = IBAN.match(text, run - 2)
                new = self.iban(m) if m else None
                if new:
                    yield m.start(), m.end(), "iban", new
                    at = m.end()
                continue
            if before.isalnum() or before in "_.-/@" and start > 1 and text[start - 2].isalnum():
                continue
            for kind, pattern, make in tries:
                m = next((m for s in {start, run} if (m := pattern.match(text, s))), None)
                new = make(m) if m else None
                if new:
                    yield m.start(), m.end(), kind, new
                    at = m.end()
                    break

    def emails(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """The local part of every address."""
        at = text.find("@")
        while at >= 0:
            start = at
            while start and text[start - 1] in LOCAL:
                start -= 1
            local = text[start:at].lstrip(".")
            if local and DOMAIN.match(text, at + 1):
                yield at - len(local), at, "email", self._mixed(local, "email")
            at = text.find("@", at + 1)

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
        """The text with pseudonyms, and what was found (offsets in the old text); null stays null."""
        if not text or not (DIGIT.search(text) or "@" in text):
            return text, []
        found = list(self.emails(text)) if "@" in text else []
        spans = sorted([*found, *(x for x in self.numbers(text) if not any(x[0] < b and a < x[1] for a, b, _, _ in found))])
        out, done = [], 0
        for start, end, _, new in spans:
            out += [text[done:start], new]
            done = end
        return "".join([*out, text[done:]]), spans


FOUND = "found array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with its text pseudonymised and a column ``found`` (kind, start, length, pseudonym of each value).

    Replaced are Luhn-valid card numbers, US social security numbers of issued
    ranges, telephone numbers, IPv4 addresses, IBANs with right check digits,
    calendar dates of 1900-2099, and the local parts of e-mail addresses; digits
    are 0-9. Each keeps its notation, its length (addresses may gain or lose
    digits) and its checks. A date's pseudonym is a date of 1900-2099 whose month
    and day need as many digits and whose day exceeds 12 if the date's does: so
    one date has one pseudonym in every notation, and with ``undo`` the same key
    gives every text back. ``03/04/2001`` is read day first. Whatever fails its
    check is left alone. Whole texts are read; null and empty texts stay as they
    are; repeated rows are replaced alike, an empty table gives no rows. A column
    named ``found`` is replaced; the text stands last but one.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())])
    names = [n for n in docs.columns if n not in ("found", text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = Pseudonyms(key, undo)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, spans = zip(*(names_of.replace(t.as_py()) for t in part.column(part.num_columns - 1)), strict=True)
                listed = [[{"kind": k, "start": a, "length": b - a, "pseudonym": new} for a, b, k, new in found] for found in spans]
                yield pa.record_batch(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(listed, pa.list_(kind))], names=[*part.schema.names, "found"]
                )

    wanted = docs.select(*(F.col(f"`{n}`") for n in names), F.col(text_col))
    schema = wanted.withColumn("found", F.lit(None).cast(FOUND.removeprefix("found "))).schema
    return wanted.mapInArrow(run, schema)


def op7(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of query ``op7_pii``: every document's text with pseudonyms, and what was replaced."""
    return pseudonymised(docs.select("doc_id", "text"), key).select("doc_id", "text", F.size("found").alias("n_found"), "found")
