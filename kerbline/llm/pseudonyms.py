"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their check (Luhn, IBAN modulus, calendar, octets, area codes)
are permuted among the values of their own format, so a card stays a valid card of as many
digits and a date a date written alike. Mail addresses and secrets are permuted letter by
letter class. The permutation depends on the key and the kind of value only: equal values
get equal pseudonyms in every document, different values different ones, and whoever has the
key can undo it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbline.llm.common import pieces

ROUNDS = 8
#: Dates are permuted within these years.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST - FIRST).days + 1


class Feistel:
    """Keyed permutations of digit strings and of ranges."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key[:64] if len(key) <= 64 else hashlib.blake2b(key).digest()

    def _draw(self, kind: str, k: int, value: int, below: int) -> int:
        said = f"{kind}:{k}:{value}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big") % below

    def _rounds(self, kind: str, value: int, a: int, b: int, back: bool) -> int:
        """A permutation of range(a * b): halves below a and b are moved by each other in turn."""
        left, right = divmod(value, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            move = self._draw(kind, k, right if k % 2 == 0 else left, a if k % 2 == 0 else b)
            move = -move if back else move
            if k % 2 == 0:
                left = (left + move) % a
            else:
                right = (right + move) % b
        return left * b + right

    def number(self, kind: str, value: int, size: int, valid: Callable[[int], bool] = lambda x: True, back: bool = False) -> int:
        """Permutes the valid values of range(size): it is applied until it meets one."""
        a = max(1, int(size ** 0.5))
        b = -(-size // a)
        kind = f"{kind}/{size}"
        while True:
            value = self._rounds(kind, value, a, b, back)
            if value < size and valid(value):
                return value

    def digits(self, kind: str, text: str, alphabet: str, valid: Callable[[str], bool] = lambda x: True, back: bool = False) -> str:
        n, base = len(text), len(alphabet)
        if not n:
            return text
        index = {c: k for k, c in enumerate(alphabet)}
        value = 0
        for c in text:
            value = value * base + index[c]

        def spelled(x: int) -> str:
            out = []
            for _ in range(n):
                x, d = divmod(x, base)
                out.append(alphabet[d])
            return "".join(reversed(out))

        half = n // 2
        a, b, kind = base ** half, base ** (n - half), f"{kind}/{base}/{n}"
        while True:
            value = self._rounds(kind, value, a, b, back)
            if valid(got := spelled(value)):
                return got


TEN = "0123456789"
_CLASSES = (TEN, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c in TEN else c for c in shape)


def _by_class(f: Feistel, kind: str, text: str, back: bool) -> str:
    """Digits, small and capital letters each permuted among themselves; other characters stay."""
    out = list(text)
    for name, alphabet in zip("dlu", _CLASSES):
        places = [k for k, c in enumerate(text) if c in alphabet]
        for k, c in zip(places, f.digits(f"{kind}-{name}", "".join(text[k] for k in places), alphabet, back=back)):
            out[k] = c
    return "".join(out)


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub("[ -]", "", m[0])
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    # All but the check digit is permuted; one that would give equal digits only is passed over.
    full = lambda body: body + next(c for c in TEN if luhn(body + c))
    body = f.digits("card", digits[:-1], TEN, lambda b: len(set(full(b))) > 1, back)
    return _refill(m[0], full(body))


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class(f, "iban", plain[4:], back)
    got = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(got) for c in m[0])


def _area(digits: str) -> bool:
    return digits[0] in "23456789" and digits[3] in "23456789"


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not m[0].startswith("+"):
        return _refill(m[0], f.digits("phone", digits, TEN, _area, back)) if _area(digits) else None
    if not 8 <= len(digits) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})[ .(-]", m[0])
    kept = len(code[1]) if code else 1
    rest = digits[kept:]
    at_home = len(rest) == 10 and _area(rest)
    got = f.digits("phone", rest, TEN, _area if at_home else lambda x: True, back)
    return _refill(m[0], digits[:kept] + got)


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, f.number("ip", value, 1 << 32, back=back).to_bytes(4, "big")))


def _ssn(f: Feistel, m: re.Match, back: bool) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = m[0].replace("-", "")
    return _refill(m[0], f.digits("ssn", digits, TEN, ok, back)) if ok(digits) else None


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    a, mark, b, c = m["a"], m["mark"], m["b"], m["c"]
    year_first = len(a) == 4
    y, x, z = (a, b, c) if year_first else (c, a, b)
    # Day and month in the order written; with a slash and only one reading, that one.
    orders = [(x, z)] if year_first else [(z, x)] if mark != "/" else [(z, x), (x, z)]
    for month, day in orders:
        try:
            when = date(int(y), int(month), int(day))
        except ValueError:
            continue
        if not FIRST <= when <= LAST:
            return None
        # A field written with one digit keeps one; dates of the same widths are permuted among themselves.
        short = [k for k, d in (("d", day), ("m", month)) if len(d) == 1]
        month_first = year_first or (month, day) == (x, z) and mark == "/" and orders.index((month, day)) == 1
        # Either reading of a/b/c is kept in its own kind, where it stays the only one or the first.
        kind = "date" if not month_first or year_first else "date-us"

        def stays(d: int, us: bool = kind == "date-us", short: list[str] = short) -> bool:
            x = FIRST + timedelta(d)
            return (not us or x.day > 12) and ("d" not in short or x.day < 10) and ("m" not in short or x.month < 10)

        got = FIRST + timedelta(f.number("-".join([kind, *short]), (when - FIRST).days, DAYS, stays, back))
        yy, mm, dd = f"{got.year:04d}", f"{got.month:0{len(month)}d}", f"{got.day:0{len(day)}d}"
        return mark.join((yy, mm, dd) if year_first else (mm, dd, yy) if month_first else (dd, mm, yy))
    return None


def _mail(f: Feistel, m: re.Match, back: bool) -> str | None:
    local, _, host = m[0].partition("@")
    return f"{_by_class(f, 'mail', local, back)}@{host}"


#: Longer secrets are permuted in stretches of so many characters.
_STRETCH = 128


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    value = m["value"]
    if not any(c in TEN for c in value):
        return None
    if len(value) > _STRETCH:
        got = "".join(_by_class(f, f"secret-{k}", value[k:k + _STRETCH], back) for k in range(0, len(value), _STRETCH))
    elif re.fullmatch(r"\d+|[0-9a-f]+", value):
        mixed = not value.isdigit()
        got = f.digits("secret", value, TEN + "abcdef" * mixed,
                       lambda x: not mixed or not (x.isdigit() or x.isalpha()), back)
    else:
        got = _by_class(f, "secret", value, back)
    return m[0][:m.start("value") - m.start()] + got


def _access_key(f: Feistel, m: re.Match, back: bool) -> str | None:
    return m[0][:4] + _by_class(f, "access", m[0][4:], back)


#: Kind, pattern, replacement; the first whose check passes is taken at a place. Every
#: repetition is bounded and begins where its run begins, so long runs cost linear time. Only a
#: secret's is not: it is taken whole, and where it has no digit its run is not tried again.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("mail", r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _mail),
    ("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", _access_key),
    ("secret", r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.=-]{8,}(?<!\.))", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\w/.-])(?P<a>\d{4}(?=[-/.]\d\d?[-/.]\d\d?(?!\d))|\d\d?(?=[-/.]\d\d?[-/.]\d{4}(?!\d)))(?P<mark>[-/.])(?P<b>\d\d?)(?P=mark)(?P<c>\d{1,4})(?![\w/-]|\.\d)", _date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _address),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", _card),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){1,6}(?!\w)|(?<![\w(.-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])", _phone),
)

_SOME = re.compile(r"[0-9@:=]|AKIA")
_NAMED = [(kind, f"(?P<k{k}>{p.replace('?P<', f'?P<k{k}_').replace('(?P=', f'(?P=k{k}_')})") for k, (kind, p, _) in enumerate(KINDS)]
_ANY = re.compile("|".join(p for _, p in _NAMED))
_NO_SECRET = re.compile("|".join(p for kind, p in _NAMED if kind != "secret"))
_EACH = [re.compile(p) for _, p, _ in KINDS]


#: No pattern begins further than this before the first character that ``_SOME`` finds in it.
_BEFORE = 160


def replace(text: str, f: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms for its private values (or, ``back``, the values) and their kinds in order."""
    out, found, at, look, barren = [], [], 0, 0, 0
    while sign := _SOME.search(text, look):
        place, after = max(look, sign.start() - _BEFORE), sign.start() + 1
        while place < after:
            m = (_ANY if place >= barren else _NO_SECRET).match(text, place)
            place += 1
            for k in range(int(m.lastgroup[1:].partition("_")[0]), len(KINDS)) if m else ():
                one = _EACH[k].match(text, m.start())
                if one and (got := KINDS[k][2](f, one, back)) is not None:
                    out += [text[at:m.start()], got]
                    at = place = after = one.end()
                    found.append(KINDS[k][0])
                    break
                if one and KINDS[k][0] == "secret":
                    barren = one.end()  # no digit up to there
        look = after
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``count`` names a column for how many there are.

    One pass without a shuffle. NULL stays NULL and counts 0. Rows are independent, so
    repeated rows stay equal.
    """
    if count in docs.columns:
        docs = docs.drop(count)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in pieces(batches, text):
            got = [(None, []) if t is None else replace(t, f, back) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in got], pa.string())
            more = [pa.array([len(x) for _, x in got], pa.int64())] if count else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*batch.schema.names, *([count] if count else [])])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *([T.StructField(count, T.LongType())] if count else [])]))
