"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, calendar, ranges). A keyed Feistel network permutes
them within their own format: a card number becomes another valid card number, a date another date in the
same notation. The permutation depends on key and kind alone, so equal values stay equal in all documents,
and whoever holds the key can turn them back.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table

#: Key of the query; a job passes its own.
KEY = b"kelpline example key"
ROUNDS = 10
KINDS = ("email", "phone", "ip", "card", "number", "ssn", "iban", "date")


class Permutation:
    """A keyed permutation of the numbers below size: Feistel rounds over two halves, walked until in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.a = max(1, int(size**0.5))
        while self.a * self.a < size:
            self.a += 1
        self.b = -(-size // self.a)

    def _round(self, i: int, half: int, most: int) -> int:
        made = hmac.digest(self.key, b"%s:%d:%d:%d" % (self.tweak, self.size, i, half), "sha256")
        return int.from_bytes(made[:16], "big") % most

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, left, self.b)) % self.b
            else:
                left = (left + sign * self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def apply(self, x: int, back: bool = False) -> int:
        while True:
            x = self._once(x, back)
            if x < self.size:
                return x


@lru_cache(4096)
def _permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def _digits(key: bytes, kind: str, digits: str, back: bool, valid: Callable[[str], bool] = lambda d: True) -> str:
    """Permutes a string of digits, walking on until the result is valid (the start is)."""
    p = _permutation(key, kind, 10 ** len(digits))
    while True:
        digits = str(p.apply(int(digits), back)).zfill(len(digits))
        if valid(digits):
            return digits


def _refilled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _card(key: bytes, value: str, back: bool) -> str | None:
    digits = _only_digits(value)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = _digits(key, "card", digits[:-1], back)
    return _refilled(value, f"{body}{luhn(body)}")


def _number(key: bytes, value: str, back: bool) -> str | None:
    digits = _only_digits(value)
    if luhn(digits[:-1]) == int(digits[-1]):
        return None
    # numbers that would pass as a card are those of the other kind, both ways
    return _refilled(value, _digits(key, "number", digits, back, lambda d: luhn(d[:-1]) != int(d[-1])))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(key: bytes, value: str, back: bool) -> str | None:
    digits = _only_digits(value)
    return _refilled(value, _digits(key, "ssn", digits, back, _ssn_valid)) if _ssn_valid(digits) else None


def _ip(key: bytes, value: str, back: bool) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
        return None
    x = _permutation(key, "ip", 1 << 32).apply(int.from_bytes(bytes(parts), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Country codes of two digits; those that begin with 1 or 7 have one, all others three.
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _country(digits: str) -> int:
    """How many digits the country code of an international number has."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3


def _phone(key: bytes, value: str, back: bool) -> str | None:
    digits = _only_digits(value)
    if not 8 <= len(digits) <= 15:
        return None
    kept = _country(digits) if value[0] == "+" else 0  # the country stays, however the number is parted
    return _refilled(value, digits[:kept] + _digits(key, "phone", digits[kept:], back))


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(key: bytes, value: str, back: bool) -> str | None:
    country, check, body = value[:2], value[2:4], value[4:]
    if int(check) != 98 - _iban_rest(country, body):
        return None
    made = _refilled(body, _digits(key, "iban", _only_digits(body), back))
    return f"{country}{98 - _iban_rest(country, made):02d}{made}"


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Order of year, month and day by what divides them: ISO, dots (day first), slashes (month first, else day first).
_ORDERS = {"-": ((0, 1, 2),), ".": ((2, 1, 0),), "/": ((2, 0, 1), (2, 1, 0))}


def _day(parts: list[str], order: tuple[int, ...]) -> int | None:
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    return day if _FIRST <= day <= _LAST else None


def _written(day: int, order: tuple[int, ...]) -> list[str]:
    made, out = datetime.date.fromordinal(day), [""] * 3
    for place, x in zip(order, (f"{made.year:04d}", f"{made.month:02d}", f"{made.day:02d}"), strict=True):
        out[place] = x
    return out


def _date(key: bytes, value: str, back: bool) -> str | None:
    sign = next(c for c in value if c in _ORDERS)
    parts, orders = value.split(sign), _ORDERS[sign]
    for k, order in enumerate(orders):
        day = _day(parts, order)
        if day is not None:
            p = _permutation(key, f"date{sign}{k}", _LAST - _FIRST + 1)
            while True:  # on to a date that no earlier order reads
                day = _FIRST + p.apply(day - _FIRST, back)
                made = _written(day, order)
                if all(_day(made, o) is None for o in orders[:k]):
                    return sign.join(made)
    return None


def _letters(key: bytes, kind: str, s: str, base: str, back: bool) -> str:
    own = [base.index(c) for c in s]
    x = 0
    for d in own:
        x = x * len(base) + d
    x, out = _permutation(key, kind, len(base) ** len(own)).apply(x, back), []
    for _ in own:
        x, d = divmod(x, len(base))
        out.append(base[d])
    return "".join(reversed(out))


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _email(key: bytes, value: str, back: bool) -> str:
    """The part before the at sign: letters and digits change within their class, all else stays."""
    local, _, domain = value.partition("@")
    for base in _CLASSES:
        own = "".join(c for c in local if c in base)
        if own:
            new = iter(_letters(key, "email" + base[0], own, base, back))
            local = "".join(next(new) if c in base else c for c in local)
    return f"{local}@{domain}"


_PSEUDONYM = {"email": _email, "phone": _phone, "ip": _ip, "card": _card, "number": _number, "ssn": _ssn, "iban": _iban, "date": _date}
#: Patterns of candidates; what an earlier kind accepts is not offered to a later one.
_PATTERNS = (
    ("email", re.compile(r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")),
    ("number", re.compile(r"(?<![0-9A-Za-z+])[0-9]{13,19}(?![0-9A-Za-z])")),
    # a part of a longer row of groups of digits is no phone: with new digits the row might pass as a card
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?<![0-9][ .-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[ .-][0-9])|(?<![0-9A-Za-z])\+[0-9]{1,4}(?:[ .-]?[0-9]{2,11}){1,4}(?![0-9A-Za-z]|[ .-][0-9])")),
)
_ANY = re.compile("[0-9@]")


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every validated value, in order, not overlapping."""
    if not text or not _ANY.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect.bisect(found, (s, e))
            free = (not at or found[at - 1][1] <= s) and (at == len(found) or found[at][0] >= e)
            if free and _PSEUDONYM[kind](KEY, m[0], False) is not None:
                found.insert(at, (s, e, kind))
    return found


def pseudonymised(text: str | None, key: bytes = KEY, back: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with its values permuted (back: turned back), and what was found where."""
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], _PSEUDONYM[kind](key, text[s:e], back)]
        at = e
    return "".join([*out, text[at:]]), found


OUT = "doc_id long, n_values long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string, text_sha256 string, text string"


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Every whole text with its personal data pseudonymised: counts by kind, spans in the old text, digest, new text.

    Null texts stay null (digest of an empty text), null ids and repeated rows stay, other columns are
    ignored, an empty table gives no rows. No shuffle.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                new, found = pseudonymised(text, key)
                kinds = [k for _, _, k in found]
                out.append((len(found), *map(kinds.count, KINDS), ",".join(f"{k}:{s}:{e}" for s, e, k in found), hashlib.sha256((new or "").encode("utf-8", "surrogatepass")).hexdigest(), new))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")][1:])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    return by_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"))
