"""Operator 8: replace personal numbers, dates and addresses by pseudonyms of the same format.

A value is validated, mapped to an integer below the number of valid values of its format, sent
through a keyed Feistel permutation of that range, and written back with its separators.  Equal
values get equal pseudonyms in every document, different values different ones, and only the key
undoes it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import spare

ROUNDS = 8
#: Only for the catalogue query and tests: a user passes a secret of their own.
DEMO_KEY = b"catalogue demonstration key"

_FIRST_DAY = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2100, 1, 1).toordinal() - _FIRST_DAY

_EMAIL = re.compile(r"(?<![\w.+%-])([A-Za-z0-9][\w.+%-]*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", re.ASCII)
_FORMS = {
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "iso": r"\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}",
    "day": r"\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d{13,19} | \d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7} | \d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{2,4} | \d{2,4}[ .-]\d{2,4})(?:[ .-]\d{2,4}){1,3} | \+\d{8,15}",
}
_AFTER = re.compile(r"(?!(?!T\d\d:\d\d)[\w/-]|[.,]\d)", re.ASCII)
_NUMBER = re.compile(rf"(?<![\w.,+/-])(?:{'|'.join(f'(?P<{k}>{f})' for k, f in _FORMS.items())}){_AFTER.pattern}", re.ASCII | re.VERBOSE)
#: Each form alone, for a start where the first reading fails its check.
_ALONE = {k: re.compile(f, re.ASCII | re.VERBOSE) for k, f in _FORMS.items()} | {"iban": re.compile(_IBAN.pattern[len(r"(?<!\w)"):], re.ASCII)}
_RUN = re.compile(r"[A-Z0-9]+", re.ASCII)
#: No value is longer than this many characters.
_LONGEST = 48
_HAS_DIGIT = re.compile(r"\d", re.ASCII)


def feistel(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a balanced Feistel network over the next
    even number of bits, walked until it lands in the range."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1

    def noise(r: int, x: int) -> int:
        word = f"{kind}|{size}|{r}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(word, digest_size=8 + half // 8, key=key).digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            if back:
                left, right = right ^ noise(ROUNDS - 1 - r, left), left
            else:
                left, right = right, left ^ noise(r, right)
        value = left << half | right
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size) that leaves no value in place: the next one on the one
    cycle on which the Feistel permutation orders them."""
    return feistel((feistel(value, size, key, kind) + 1) % size, size, key, kind, back=True)


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _refill(pattern: str, chars: str, kept: str) -> str:
    """``pattern`` with its characters out of ``kept`` replaced in order by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c in kept else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    new = f"{moved(int(d[:-1]), 10 ** n, key, 'card'):0{n}d}"
    return _refill(text, new + luhn_digit(new), "0123456789")


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    new = moved(int.from_bytes(bytes(parts), "big"), 2 ** 32, key, "ip")
    return ".".join(str(x) for x in new.to_bytes(4, "big"))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    new = moved((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    rest, serial = divmod(new, 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _unassigned(national: str) -> bool:
    """Area or office begin with 0 or 1, which no American number has."""
    return national[0] in "01" or national[3] in "01"


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    national = d[-10:]
    american = (len(d) == 10 and not text.startswith("+")) or (len(d) == 11 and d[0] == "1")
    if american:
        if _unassigned(national):
            if len(d) == 10 and "(" not in text:
                return None
            new = national
            while _unassigned(new := f"{moved(int(new), 10 ** 10, key, 'phone-1-other'):010d}") is False:
                pass
            return _refill(text, d[:-10] + new, "0123456789")
        area, office, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
        new = moved((area * 800 + office) * 10000 + line, 800 * 800 * 10000, key, "phone-1")
        rest, line = divmod(new, 10000)
        area, office = divmod(rest, 800)
        return _refill(text, f"{d[:-10]}{area + 200:03d}{office + 200:03d}{line:04d}", "0123456789")
    if not text.startswith("+") or not 8 <= len(d) <= 15:
        return None
    n = len(d) - 2
    return _refill(text, d[:2] + f"{moved(int(d[2:]), 10 ** n, key, 'phone'):0{n}d}", "0123456789")


def _date(year: int, month: int, day: int, key: bytes) -> dt.date | None:
    try:
        n = dt.date(year, month, day).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return dt.date.fromordinal(moved(n, _DAYS, key, "date") + _FIRST_DAY) if 0 <= n < _DAYS else None


def _iso(text: str, key: bytes) -> str | None:
    sep = text[4]
    new = _date(*(int(x) for x in text.split(sep)), key)
    return new and f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}"


def _day(text: str, key: bytes) -> str | None:
    """Day first; if that is no date, month first."""
    sep = next(c for c in text if not c.isdigit())
    a, b, year = (int(x) for x in text.split(sep))
    if new := _date(year, b, a, key):
        return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"
    new = _date(year, a, b, key)
    return new and f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year}"


def _mixed(text: str, key: bytes, kind: str) -> str:
    """Permutes letters among letters (case kept) and digits among digits; the rest stays."""
    value, size = 0, 1
    for c in text:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value = value * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0)
        size *= base
    value = moved(value, size, key, f"{kind}|{''.join('9' if c.isdigit() else 'a' if c.isalpha() else c for c in text)}")
    out = []
    for c in reversed(text):
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, x = divmod(value, base)
        new = str(x) if base == 10 else chr(97 + x) if base == 26 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _email(name: str, domain: str, key: bytes) -> str:
    return f"{_mixed(name, key, 'email|' + domain.lower())}@{domain}"


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _mixed(plain[4:], key, "iban|" + plain[:2])
    check = 98 - number(account + plain[:2] + "00") % 97
    return _refill(text, f"{plain[:2]}{check:02d}{account}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


_BY_KIND = {"ip": _ip, "iso": _iso, "day": _day, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}


@lru_cache(maxsize=100_000)
def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    return _BY_KIND[kind](value, key)


def _reading(text: str, m: re.Match, kinds: tuple[str, ...], limit: int, key: bytes) -> tuple[int, str] | None:
    """End and pseudonym of the first valid value at the match's start and before ``limit``: as
    matched, else by every form, from the longest end to the shortest."""
    first = next((k for k in kinds if len(kinds) > 1 and m[k]), kinds[0])
    if m.end() <= limit and (new := _pseudonym(first, m[0], key)) is not None:
        return m.end(), new
    start = m.start()
    for end in sorted((r.end() for r in _RUN.finditer(text, start, min(limit, start + _LONGEST))), reverse=True):
        if not _AFTER.match(text, end):
            continue
        for kind in kinds:
            if (kind, end) != (first, m.end()) and _ALONE[kind].fullmatch(text, start, end):
                new = _pseudonym(kind, text[start:end], key)
                if new is not None:
                    return end, new
    return None


def _replace(text: str, pattern: re.Pattern, kinds: tuple[str, ...], taken: list[tuple[int, int]], key: bytes) -> tuple[str, list[tuple[int, int]]]:
    """As pattern.sub, but a rejected match hides nothing that begins within it, and the spans
    ``taken`` stay as they are.  Also returns the spans of the new values."""
    out, done, size, spans, k = [], 0, 0, [], 0
    m = pattern.search(text)
    while m:
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        start, stop = taken[k] if k < len(taken) else (len(text), len(text))
        if m.start() >= start:
            m = pattern.search(text, stop)
            continue
        found = _reading(text, m, kinds, start, key)
        if found:
            out += text[done:m.start()], found[1]
            size += m.start() - done + len(found[1])
            spans.append((size - len(found[1]), size))
            done = found[0]
        m = pattern.search(text, done if found else m.start() + 1)
    return "".join(out) + text[done:], spans


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, int]:
    """The text with its valid values replaced, and how many were."""
    if not text:
        return text, 0
    count = 0

    def mail(m: re.Match) -> str:
        nonlocal count
        count += 1
        return _email(m[1], m[2], key)

    if _HAS_DIGIT.search(text):
        text, accounts = _replace(text, _IBAN, ("iban",), [], key)
        text, numbers = _replace(text, _NUMBER, tuple(_FORMS), accounts, key)
        count = len(accounts) + len(numbers)
    if "@" in text:
        text = _EMAIL.sub(mail, text)
    return text, count


def pseudonymise_text(docs: DataFrame, text: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, plus n_replaced (int).

    Read as personal and valid: card numbers (Luhn), US social security numbers and phones, other
    phones with a country code (also code 1, or an area in parentheses, before an area or office
    that America does not assign; these map among themselves), IPv4 addresses, IBANs (mod 97), dates from 1900 to 2099 (year
    first, or day first, or else month first; also before the time of an ISO timestamp, which stays;
    written back with two-digit day and month) and the
    local part of email addresses.  A pseudonym is valid in the same sense, keeps separators and
    length (but for the octets of an address), never equals its value, and is the same wherever the value stands with
    the same separators or others.  Anything else, such as a number that fails its check, stays; so where
    values could overlap, the valid one that begins first counts.

    A map over rows: no shuffle, nothing is gathered.  Whole texts are read, in pieces of a few
    million characters at a time.  Null text stays null, empty text empty, both with 0.  Repeated
    rows get equal results.  Other columns pass through; a column named n_replaced is replaced.
    """
    docs = docs.drop("n_replaced")

    @F.pandas_udf("text string, n int")
    def replace(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pseudonymise(t, key) for t in texts], columns=["text", "n"])

    new = spare(docs, "_q_new")
    return (docs.withColumn(new, replace(F.col(text)))
            .withColumns({text: F.col(f"{new}.text"), "n_replaced": F.col(f"{new}.n")}).drop(new))
