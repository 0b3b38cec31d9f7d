"""Format-preserving pseudonyms (for problem 10).

A value is brought to its canonical form first, so that all spellings of one number or date are one value: the country
and the subscriber's part of a telephone number, the digits of an identity number, the day of a date. A keyed Feistel
network permutes the canonical part; the permutation is repeated until the result is valid again (cycle walking), which
keeps it a permutation of the valid values. The result is printed in the format that was found: the same separators,
the same prefix. The holder of the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable

ROUNDS = 8
#: Days that dates are permuted among: 1900 to 2099.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# Country codes of one and two digits; all others have three.
SHORT_COUNTRIES = ("1", "7")
TWO_COUNTRIES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def feistel_digits(digits: str, key: bytes, undo: bool = False) -> str:
    """Keyed permutation of the digit strings of one length (two or more digits)."""
    n = len(digits)
    if n < 2:
        return digits
    u, v = n // 2, n - n // 2
    a, b = int(digits[:u]), int(digits[u:])
    ma, mb = 10**u, 10**v

    def f(i: int, x: int) -> int:
        return int.from_bytes(hmac.new(key, f"{n}|{i}|{x}".encode(), hashlib.sha256).digest()[:16], "big")

    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        sign = -1 if undo else 1
        if i % 2 == 0:
            a = (a + sign * f(i, b)) % ma
        else:
            b = (b + sign * f(i, a)) % mb
    return f"{a:0{u}d}{b:0{v}d}"


def walk(digits: str, key: bytes, valid: Callable[[str], bool], undo: bool = False) -> str:
    """Permutation of the valid digit strings of one length; an invalid one is permuted among all."""
    if len(digits) < 2:
        return digits
    new = feistel_digits(digits, key, undo)
    if valid(digits):
        while not valid(new):
            new = feistel_digits(new, key, undo)
    return new


# ---------------------------------------------------------------- validity


def valid_social(d: str) -> bool:
    """Social security numbers: no part is all zeros, no area 666. Numbers from 900 on are not issued as such; they serve
    as taxpayer and sample numbers, and only their serial must not be zeros."""
    return len(d) == 9 and d[:3] not in ("000", "666") and (d[3:5] != "00" or d[0] == "9") and d[5:] != "0000"


def valid_citizen(d: str) -> bool:
    """Twelve digits that begin with a province code."""
    return len(d) == 12 and 1 <= int(d[:3]) <= 96


def valid_national(country: str, d: str) -> bool:
    """Subscriber numbers: plans of North America and Vietnam, else a first digit that is no zero."""
    if country == "1":
        return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"
    if country == "84":
        return len(d) in (9, 10) and d[0] in "235789"
    return 4 <= len(d) <= 14 and d[0] != "0"


def split_number(value: str, home: str = "84") -> tuple[str, str, int] | None:
    """(country, subscriber's digits, digits before them in ``value``), or None if no plan fits."""
    digits = "".join(c for c in value if c in "0123456789")
    bare = value.lstrip("( ")
    if bare.startswith("+") or digits.startswith("00"):
        skip = 0 if bare.startswith("+") else 2
        rest = digits[skip:]
        n = 1 if rest[:1] in SHORT_COUNTRIES else 2 if rest[:2] in TWO_COUNTRIES else 3
        country, own = rest[:n], rest[n:]
        trunk = 1 if own.startswith("0") and country != "39" else 0
        return (country, own[trunk:], skip + n + trunk) if len(own) - trunk >= 4 else None
    if digits.startswith("0"):
        return (home, digits[1:], 1) if 8 <= len(digits) - 1 <= 10 else None
    if len(digits) == 11 and digits[0] == "1":
        return "1", digits[1:], 1
    if len(digits) == 10:
        return "1", digits, 0
    return None


def valid_phone(value: str) -> bool:
    parts = split_number(value)
    return parts is not None and valid_national(parts[0], parts[1])


def _print(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in value)


def phone(value: str, key: bytes, undo: bool = False) -> str:
    digits = "".join(c for c in value if c in "0123456789")
    parts = split_number(value)
    if parts is None:
        return _print(value, feistel_digits(digits, key + b"phone", undo))
    country, own, before = parts
    new = walk(own, key + b"phone" + country.encode(), lambda d: valid_national(country, d), undo)
    return _print(value, digits[:before] + new)


def national_id(value: str, key: bytes, undo: bool = False) -> str:
    digits = "".join(c for c in value if c in "0123456789")
    letters = any(c.isalpha() for c in value)
    valid = (lambda d: True) if letters else valid_social if len(digits) == 9 else valid_citizen if len(digits) == 12 else (lambda d: True)
    return _print(value, walk(digits, key + b"id", valid, undo))


# ---------------------------------------------------------------- dates

_ISO = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")
_DAY_FIRST = re.compile(r"(\d{1,2})([-/. ])(\d{1,2})\2(\d{4})")
_NAMED = re.compile(rf"(\d{{1,2}})(?:st|nd|rd|th)?([ ])({'|'.join(MONTHS)}),?[ ](\d{{4}})", re.I)
_NAMED_US = re.compile(rf"({'|'.join(MONTHS)})[ ](\d{{1,2}})(?:st|nd|rd|th)?,?[ ](\d{{4}})", re.I)
DATE = re.compile(rf"(?<![\w/.-])(?:\d{{4}}([-/.])\d{{1,2}}\1\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\2\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?[ ](?:{'|'.join(MONTHS)}),?[ ]\d{{4}}|(?:{'|'.join(MONTHS)})[ ]\d{{1,2}}(?:st|nd|rd|th)?,?[ ]\d{{4}})(?![\w/-])", re.I)


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n if FIRST_DAY <= n <= LAST_DAY else None


def read_date(value: str) -> tuple[int, Callable[[datetime.date], str]] | None:
    """(ordinal day, printer in the same format), or None if it is no day of the calendar. The day goes before the month,
    unless only the other order is a day."""
    pad = lambda n, like: str(n).zfill(len(like)) if like.startswith("0") or len(like) == 2 else str(n)
    m = _ISO.fullmatch(value)
    if m:
        y, s, mo, d = m.groups()
        n = _day(int(y), int(mo), int(d))
        return None if n is None else (n, lambda x: f"{x.year}{s}{pad(x.month, mo)}{s}{pad(x.day, d)}")
    m = _DAY_FIRST.fullmatch(value)
    if m:
        a, s, b, y = m.groups()
        n = _day(int(y), int(b), int(a))
        if n is not None:
            return n, lambda x: f"{pad(x.day, a)}{s}{pad(x.month, b)}{s}{x.year}"
        n = _day(int(y), int(a), int(b))
        return None if n is None else (n, lambda x: f"{pad(x.month, a)}{s}{pad(x.day, b)}{s}{x.year}")
    m = _NAMED.fullmatch(value)
    if m:
        n = _day(int(m[4]), MONTHS.index(m[3].lower()) + 1, int(m[1]))
        return None if n is None else (n, lambda x: f"{x.day} {MONTHS[x.month - 1].capitalize()} {x.year}")
    m = _NAMED_US.fullmatch(value)
    if m:
        n = _day(int(m[3]), MONTHS.index(m[1].lower()) + 1, int(m[2]))
        return None if n is None else (n, lambda x: f"{MONTHS[x.month - 1].capitalize()} {x.day}, {x.year}")
    return None


def date(value: str, key: bytes, undo: bool = False) -> str:
    found = read_date(value)
    if found is None:
        return value
    day, show = found
    inside = lambda d: int(d) <= LAST_DAY - FIRST_DAY
    new = walk(f"{day - FIRST_DAY:05d}", key + b"date", inside, undo)
    return show(datetime.date.fromordinal(FIRST_DAY + int(new)))


def tag(kind: str, value: str, key: bytes) -> str:
    """Keyed tag of a name, mailbox or address; case, blanks and punctuation do not count."""
    flat = " ".join(re.findall(r"[\w@.]+", value.casefold()))
    return hmac.new(key, f"{kind}|{flat}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:12]


def placeholder(kind: str, value: str, key: bytes) -> str:
    """Typed placeholder with the pseudonym of the value."""
    change = {"phone": phone, "national_id": national_id, "date": date}.get(kind)
    return f"[{kind.upper()} {change(value, key) if change else tag(kind, value, key)}]"
