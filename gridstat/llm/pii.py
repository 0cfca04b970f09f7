"""Format-preserving pseudonyms of personal numbers and dates, by a keyed Feistel network.

A value is read as a number in the range that its format allows, permuted within
that range by a Feistel network with a keyed hash, and written back in the same
format: equal values stay linked across documents, different ones stay different,
none stays itself, and without the key there is no way back.  Results outside the
range, or that the format's own test refuses, are permuted again until one fits
(cycle walking), so the whole is a permutation of the valid values.  A date stays
within those that are written with as many digits and read in the same order: where
day and month could change places, month first is read if that is a date.

Found and tested: card numbers (Luhn), IBANs in capitals or small letters (mod 97),
US social security numbers, telephone numbers, IPv4 and IPv6 addresses, calendar
dates of 1900-2099 in digits or with an English month (``3 May 1987``, ``May 3,
1987``; the month stays within those of as many letters, and May is
written as a short one), dates with slashes and a
year of two digits (1950-2049), the local part of e-mail addresses, and keys and
passwords (each character within its own kind).  Three groups of digits with blanks
are a telephone number if area and exchange begin with 2 to 9 and no other number
stands beside them; ten digits in a row, ordinals (``3rd of May``) and IPv6
addresses in mixed case or of fewer than three colons are left alone.  Separators, country codes, a card's first digit, an e-mail's domain and
the digits of each part of an address are kept; check digits are computed anew.
Numbers that fail their test are left alone, and so is all other text.

Defined cases: a null text stays null, an empty one empty; all other columns are
carried as they are, but one of the name that the findings get is replaced by them;
repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10
_ROWS = 1000
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of range(size) for each tweak, for any size."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds
        self._round = lru_cache(1 << 16)(self._hashed)  # small ranges need few different ones

    def _hashed(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        data = b"%d|%d|" % (i, bits) + tweak + b"|" + x.to_bytes((bits + 7) // 8 or 1, "big")
        out = b""
        while len(out) * 8 < bits:
            out += blake2b(data + b"|%d" % len(out), key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, tweak: bytes, x: int, half: int) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for i in range(self.rounds):
            a, b = b, a ^ self._round(tweak, i, b, half)
        return a << half | b

    def _back(self, tweak: bytes, x: int, half: int) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for i in reversed(range(self.rounds)):
            a, b = b ^ self._round(tweak, i, a, half), a
        return a << half | b

    def _walk(self, step: Callable[[bytes, int, int], int], t: bytes, x: int, size: int, half: int) -> int:
        while (x := step(t, x, half)) >= size:
            pass
        return x

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The next valid number after x in the keyed order of the range (the one before, with ``back``).

        The order is the network's: x goes to its place, one further and back out, so that no number stays itself where there is another.
        """
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        t = tweak.encode() + b"|%d" % size
        while True:
            place = self._walk(self._once, t, x, size, half)
            x = self._walk(self._back, t, (place + (-1 if back else 1)) % size, size, half)
            if valid is None or valid(x):
                return x


def _spell(f: Feistel, text: str, tweak: str, kinds: tuple[str, ...] = (_DIGITS, _UPPER, _LOWER), valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
    """Permute the characters that belong to one of the alphabets, each within its own; the rest stay."""
    own = [(i, next((k for k in kinds if c in k), "")) for i, c in enumerate(text)]
    own = [(i, k) for i, k in own if k]
    size, x = 1, 0
    for i, k in own:
        x, size = x * len(k) + k.index(text[i]), size * len(k)

    def written(y: int) -> str:
        out = list(text)
        for i, k in reversed(own):
            y, r = divmod(y, len(k))
            out[i] = k[r]
        return "".join(out)

    shape = "".join(str(kinds.index(k)) for _, k in own)
    return written(f.permute(x, size, f"{tweak}/{shape}", (lambda y: valid(written(y))) if valid else None, back)) if size > 1 else text


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only(text: str, keep: str = _DIGITS) -> str:
    return "".join(c for c in text if c in keep)


def _refill(text: str, new: str, keep: str = _DIGITS) -> str:
    it = iter(new)
    return "".join(next(it) if c in keep else c for c in text)


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    d = _only(m[0])
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + _spell(f, d[1:-1], f"card/{d[0]}", back=back)
    check = next(c for c in _DIGITS if luhn(body + c))
    return _refill(m[0], body + check)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


#: Characters of an IBAN by country.
_IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    """The match, or its part of the country's length where a word or number follows that looks like more of it."""
    own, size = m[0].upper(), _IBAN_SIZES.get(m[0][:2].upper())
    places = [i for i, c in enumerate(own) if c != " "]
    if size and len(places) > size and places[size] != places[size - 1] + 1:
        own = own[: places[size - 1] + 1]
    s = own.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_rest(s) != 1:
        return None
    body = _spell(f, s[4:], f"iban/{s[:2]}", back=back)
    new = _refill(own, f"{s[:2]}{98 - _iban_rest(s[:2] + '00' + body):02d}{body}", _DIGITS + _UPPER)
    return new.lower() if m[0][:2].islower() else new


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, m: re.Match, back: bool) -> str | None:
    d = _only(m[0])
    return _refill(m[0], _spell(f, d, "ssn", valid=_ssn_ok, back=back)) if _ssn_ok(d) else None


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    d = _only(m[0])
    if not 7 <= len(d) <= 15:
        return None
    code = d[: len(_only(m["cc"] or ""))]
    own = d[len(code) :]
    north = len(own) == 10 and code in ("", "1")
    ok = (lambda x: x[0] in "23456789" and x[3] in "23456789") if north and own[0] in "23456789" and own[3] in "23456789" else None
    return _refill(m[0], code + _spell(f, own, "phone/north" if ok else f"phone/{code}", valid=ok, back=back))


def _spaced_phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    return _refill(m[0], _spell(f, _only(m[0]), "phone/north", valid=lambda x: x[0] in "23456789" and x[3] in "23456789", back=back))


def _ipv6(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Hexadecimal digits within the groups as they are; those in capitals keep one, by which they are known."""
    own = m[0]
    letters = {c for c in own if c.isalpha()}
    upper = any(c.isupper() for c in letters)
    if upper and any(c.islower() for c in letters) or own.count(":") < 3 or not any(c.isdigit() for c in own):
        return None
    try:
        IPv6Address(own)
    except ValueError:
        return None
    ok = lambda x: any(c.isdigit() for c in x) and (not upper or any(c.isalpha() for c in x))
    return _spell(f, own, f"ipv6/{own.find('::')}/{upper}", (_DIGITS + ("ABCDEF" if upper else "abcdef"),), ok, back)


def _ipv4(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    spans = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]
    size, x = 1, 0
    for p, (low, n) in zip(parts, spans, strict=True):
        x, size = x * n + int(p) - low, size * n
    y = f.permute(x, size, "ipv4/" + "".join(str(len(p)) for p in parts), back=back)
    out = []
    for low, n in reversed(spans):
        y, r = divmod(y, n)
        out.append(str(low + r))
    return ".".join(reversed(out))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _read(order: str, parts: tuple[str, ...]) -> date | None:
    v = dict(zip(order, map(int, parts), strict=True))
    try:
        return date(v["y"], v["m"], v["d"])
    except ValueError:
        return None


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = (m["y1"], m["m1"], m["d1"]) if m["y1"] else (m["a2"], m["b2"], m["y2"])
    sep = m["s1"] or m["s2"]
    orders = ("ymd",) if m["y1"] else ("dmy",) if sep == "." else ("mdy", "dmy")
    order = next((o for o in orders if _read(o, parts)), None)
    day = order and _read(order, parts)
    if not day or not 1900 <= day.year < 2100:
        return None

    def written(x: int) -> tuple[str, ...]:
        new = _FIRST + timedelta(x)
        v = {"y": new.year, "m": new.month, "d": new.day}
        return tuple(f"{v[k]:0{len(old)}d}" for k, old in zip(order, parts, strict=True))

    def alike(x: int) -> bool:
        """As many digits, and read in the same order."""
        new = written(x)
        return all(len(a) == len(b) for a, b in zip(new, parts, strict=True)) and next(o for o in orders if _read(o, new)) == order

    return sep.join(written(f.permute((day - _FIRST).days, _DAYS, "date", alike, back)))


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_SHORT = tuple(x[:3] for x in _MONTHS)
_NAMES = "|".join(dict.fromkeys([*_MONTHS, *_SHORT]))


def _named_date(f: Feistel, m: re.Match, back: bool) -> str | None:
    name, day, year = m["n1"] or m["n2"], m["d1"] or m["d2"], m["y1"] or m["y2"]
    style = next((s for s in (str.title, str.upper, str.lower) if s(name) == name), None)
    names = _SHORT if len(name) == 3 else _MONTHS
    at = next((i for i, x in enumerate(names, 1) if x.lower() == name.lower()), 0)
    own = style and _read("ymd", (year, str(at), day))
    if not own or not 1900 <= own.year < 2100:
        return None

    def alike(x: int) -> bool:
        new = _FIRST + timedelta(x)
        return len(names[new.month - 1]) == len(name) and len(f"{new.day:0{len(day)}d}") == len(day)

    new = _FIRST + timedelta(f.permute((own - _FIRST).days, _DAYS, f"date/{len(name)}", alike, back))
    parts = {"n": style(names[new.month - 1]), "d": f"{new.day:0{len(day)}d}", "y": f"{new.year:04d}"}
    out, place = [], m.start()
    for start, end, k in sorted((m.start(g), m.end(g), g[0]) for g in ("n1", "d1", "y1", "n2", "d2", "y2") if m[g] is not None):
        out += [m.string[place:start], parts[k]]
        place = end
    return "".join(out) + m.string[place : m.end()]


_HALF = date(1950, 1, 1)
_CENTURY = (date(2050, 1, 1) - _HALF).days


def _short_date(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Month first if that is a date; a year of two digits is one of 1950-2049."""
    parts = (m["a"], m["b"], m["y"])
    read = lambda o, p: _read(o, (*p[:2], str(1900 + int(p[2]) + 100 * (int(p[2]) < 50))))
    order = next((o for o in ("mdy", "dmy") if read(o, parts)), None)
    if order is None:
        return None

    def written(x: int) -> tuple[str, ...]:
        new = _HALF + timedelta(x)
        v = {"y": new.year % 100, "m": new.month, "d": new.day}
        return tuple(f"{v[k]:0{len(old)}d}" for k, old in zip(order, parts, strict=True))

    def alike(x: int) -> bool:
        new = written(x)
        return all(len(a) == len(b) for a, b in zip(new, parts, strict=True)) and next(o for o in ("mdy", "dmy") if read(o, new)) == order

    return "/".join(written(f.permute((read(order, parts) - _HALF).days, _CENTURY, "date/short", alike, back)))


def _email(f: Feistel, m: re.Match, back: bool) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return _spell(f, local, f"email/{domain.lower()}", back=back) + "@" + domain


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    whole, word = m[0], m["word"]
    kinds = ("0123456789abcdef",) if re.fullmatch("[0-9a-f]+", word) else (_DIGITS, _UPPER, _LOWER)
    at = m.start("word") - m.start()
    return whole[:at] + _spell(f, word, "secret", kinds, back=back) + whole[at + len(word) :]


def _access_key(f: Feistel, m: re.Match, back: bool) -> str | None:
    return m[0][:4] + _spell(f, m[0][4:], "access", (_UPPER + "234567" + "0189",), back=back)


#: Kinds in order of precedence: name, what a text with one of them always has, pattern, and the pseudonym of a match or of its beginning.
KINDS: list[tuple[str, str, str, Callable[[Feistel, re.Match, bool], str | None]]] = [
    ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("secret", "(?i:passw|pwd|secret|token|api[_-]?key)", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key))\s*[=:]\s*[\"']?(?P<word>[A-Za-z0-9_+/-]{8,})", _secret),
    ("access", "AKIA", r"\bAKIA[A-Z0-9]{16}\b", _access_key),
    ("iban", "[0-9]", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("iban", "[0-9]", r"\b[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?\b", _iban),
    ("card", "[0-9]", r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])", _card),
    ("date", "[0-9]", r"(?<![0-9./-])(?:(?P<y1>[0-9]{4})(?P<s1>[-/.])(?P<m1>[0-9]{1,2})(?P=s1)(?P<d1>[0-9]{1,2})|(?P<a2>[0-9]{1,2})(?P<s2>[-/.])(?P<b2>[0-9]{1,2})(?P=s2)(?P<y2>[0-9]{4}))(?![0-9])", _date),
    ("date", "[0-9]", r"(?<![0-9./-])(?P<a>[0-9]{1,2})/(?P<b>[0-9]{1,2})/(?P<y>[0-9]{2})(?![0-9]|[./-][0-9])", _short_date),
    ("date", "[0-9]", rf"(?<![0-9A-Za-z./,-])(?:(?P<d1>[0-9]{{1,2}}) (?P<n1>(?i:{_NAMES}))\.?,? (?P<y1>[0-9]{{4}})|(?P<n2>(?i:{_NAMES}))\.? (?P<d2>[0-9]{{1,2}}),? (?P<y2>[0-9]{{4}}))(?![0-9])", _named_date),
    ("ipv6", "[0-9]", r"(?<![0-9A-Za-z_:.])[0-9A-Fa-f:]{6,39}(?:(?<=[0-9A-Fa-f])|(?<=::))(?![0-9A-Za-z_]|:[0-9A-Fa-f:]|\.[0-9])", _ipv6),
    ("ipv4", "[0-9]", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ipv4),
    ("ssn", "[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("phone", "[0-9]", r"(?<![0-9.+])(?:(?P<cc>\+[0-9]{1,3})[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?(cc)(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})|(?(cc)[0-9]{7,12}|(?!)))(?![0-9])", _phone),
    ("phone", "[0-9]", r"(?<![0-9.+-])(?<![0-9][ ,])[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9]|[ ,.-][0-9])", _spaced_phone),
]
_PATTERNS = [(kind, re.compile(p), fn) for kind, _, p, fn in KINDS]
_NEEDED = "|".join(dict.fromkeys(need for _, need, _, _ in KINDS))


def pseudonyms(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every found value replaced, and (kind, start, end) of each, in code points."""
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))
    for kind, pattern, fn in _PATTERNS:
        for m in pattern.finditer(text):
            if covered.find(1, m.start(), m.end()) >= 0:
                continue
            new = fn(f, m, back)
            if new is not None:  # as long as what it replaces
                end = m.start() + len(new)
                covered[m.start() : end] = b"\1" * len(new)
                taken.append((m.start(), end, kind, new))
    if not taken:
        return text, []
    out, at = [], 0
    for a, b, _, new in sorted(taken):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in sorted(taken)]


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", found: str | None = "found", back: bool = False) -> DataFrame:
    """docs with ``text`` rewritten; ``found``, if named, is a new column with the kind and place of each value.

    ``back`` undoes it: the key holder gets the original values again.
    """
    schema = T.StructType([f for f in docs.schema if f.name != found])
    names = [f.name for f in schema]
    at = names.index(text)
    if found:
        schema = schema.add(found, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
            column = b.column(at)
            # only texts that have what some kind always has leave Arrow
            some = pc.fill_null(pc.match_substring_regex(column, _NEEDED), False)
            new: list[str] = []
            kinds: list[list] = []
            for x in column.filter(some).to_pylist():
                y, k = pseudonyms(x, f, back)
                new.append(y)
                kinds.append([{"kind": a, "start": s, "end": e} for a, s, e in k])
            cols = list(b.columns)
            cols[at] = pc.replace_with_mask(column, some, pa.array(new, column.type)) if new else column
            if found:
                it = iter(kinds)
                cols.append(pa.array([next(it) if s else [] for s in some.to_pylist()], spans))
            yield pa.RecordBatch.from_arrays(cols, names=names + [found] * bool(found))

    return docs.select(*names).mapInArrow(run, schema)
