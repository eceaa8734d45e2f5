"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by pattern and validated (check digits, octets, calendar), so
other numbers stay as they are. A valid value is an element of a finite set,
all valid values of its kind and format, and a keyed Feistel network permutes
that set: the pseudonym is again valid and has the same punctuation, different
values get different pseudonyms, and a value gets the same one in every
document, so what was linked stays linked. With the key, ``reveal`` inverts it.

Kinds and what is permuted:

    card     13 to 19 digits with a right Luhn digit: all digits but that one
    phone    "+", a country code and a number in any groups, or a number as it is written
             in country 1 (ddd-ddd-dddd and the like): the digits after the country code
    iban     country, right check digits and account, in capitals or without
             spaces in small letters: letters and digits of the account
    ssn      ddd-dd-dddd with valid area, group and serial: the nine digits
    ip       four octets: the 32-bit address
    date     y-m-d, y/m/d, m/d/y, d/m/y or d.m.y from 1900 to 2099: the day
    email    letters and digits of the local part, each within its class
    secret   value of a key, token, secret or password, of 8 characters with a digit at
             least, or a key of known prefix: hexadecimal digits as such, else letters
             and digits each within their class

Digits are ASCII digits; numbers in others, IPv6 addresses and national phone numbers
of other countries are left. A phone number's pseudonym depends on its digits alone,
so any punctuation of it stays linked; an IBAN's on its characters without spaces and
case. A date's pseudonym depends on the day alone for y-m-d, y/m/d and d.m.y, so these
stay linked; months and days come out with two digits. m/d/y is read where both readings are possible, d/m/y only where
the first number is above 12; either keeps to dates that read the same way.

Defined results: a null text stays null, an empty one empty; rows are handled
one by one, so repeated rows get equal texts and null ids do no harm, and a text of any
length is read whole; where patterns overlap the one that begins first counts; an empty
table gives an empty result; other columns pass through, and those that clash
with a count made here are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chronoloom.llm.common import read_table, small_batches

KINDS = ("card", "phone", "iban", "ssn", "ip", "date", "email", "secret")
ROUNDS = 10
_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

#: Country codes of two digits; those that begin with 1 or 7 have one, all others three (fixed values).
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_PATTERN = re.compile(
    r"""(?P<email>[\w.%+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
      |(?P<secret>(?:key|token|secret|password|passwd)["']?\s{0,3}[=:]\s{0,3}["']?(?:[0-9a-fA-F]{16,}\b|(?=[^\s"']*[0-9])[^\s"']{8,})
                 |\b(?:[spr]k_(?:live|test)_[0-9A-Za-z]{10,}|gh[pousr]_[0-9A-Za-z]{20,}|AKIA[0-9A-Z]{16})\b)
      |(?P<phone>(?<![\w+])\+[0-9](?:[ ./-]?\(?[0-9]\)?){6,14}(?!\w)|(?<![\w.+-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\w-]|\.[0-9]))
      |(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?:(?=T[0-9])|(?![\w/-]|\.[0-9])))
      |(?P<iban>\b(?:[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})\b)
      |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
      |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
      |(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))""",
    re.VERBOSE,
)


class Feistel:
    """A keyed permutation of 0 .. size - 1, of its own for each ``tweak``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.size = size
        # the two halves' sizes; their product covers the set, and values beyond it are walked out of
        self.a = max(1, round(size**0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        self.b = -(-size // self.a)

    def _word(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%d:%d" % (i, half, self.size), key=self.key, digest_size=32).digest())

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._word(i, right)) % self.a
            else:
                right = (right + sign * self._word(i, left)) % self.b
        return left * self.b + right

    def permute(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Walks on until the value lies in the set and is valid, which stays a permutation of the valid values."""
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


#: For each ASCII letter and digit the size of its class and the first of it.
_CLASSES = {c: (len(of), of[0]) for of in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in of}


def _refilled(shape: str, digits: str, skip: int = 0) -> str:
    """``shape`` with its digits after the first ``skip`` replaced in order."""
    out, at = [], 0
    for c in shape:
        if c.isdigit() and c.isascii():
            if skip:
                skip -= 1
            else:
                c = digits[at]
                at += 1
        out.append(c)
    return "".join(out)


class Pseudonymiser:
    """Replaces the personal values of texts under a key; remembers the latest values."""

    REMEMBERED = 200_000

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        self.key, self.kinds = key, kinds
        self.known: dict[tuple[str, str, bool], str | None] = {}

    def _permuted(self, tweak: str, size: int, x: int, back: bool, valid: Callable[[int], bool] = lambda x: True) -> int:
        return Feistel(self.key, tweak, size).permute(x, back, valid)

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or with ``back`` the value of a pseudonym); None if it isn't valid."""
        at = kind, text, back
        if at not in self.known:
            if len(self.known) > self.REMEMBERED:
                self.known = {}
            self.known[at] = getattr(self, f"_{kind}")(text, back)
        return self.known[at]

    def _card(self, text: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if int(digits[-1]) != luhn_digit(digits[:-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        # a number of one repeated digit is no card, so none becomes one
        body = lambda x: f"{x:0{n}d}"
        x = self._permuted(f"card{n}", 10**n, int(digits[:-1]), back, lambda x: len(set(body(x) + str(luhn_digit(body(x))))) > 1)
        return _refilled(text, body(x) + str(luhn_digit(body(x))))

    def _phone(self, text: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if text[0] == "+":
            country = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
            code, digits = digits[:country], digits[country:]
        else:
            country, code = 0, "1"
        if not 5 <= len(digits) <= 14:
            return None
        x = self._permuted(f"phone{code}:{len(digits)}", 10 ** len(digits), int(digits), back)
        return _refilled(text, f"{x:0{len(digits)}d}", country)

    def _ssn(self, text: str, back: bool) -> str | None:
        x = int(text.replace("-", ""))
        return _refilled(text, f"{self._permuted('ssn', 10**9, x, back, _ssn_valid):09d}") if _ssn_valid(x) else None

    def _ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self._permuted("ip", 1 << 32, int.from_bytes(bytes(map(int, parts))), back)
        return ".".join(map(str, x.to_bytes(4)))

    def _date(self, text: str, back: bool) -> str | None:
        mark = re.search(r"\D", text)[0]
        a, b, c = map(int, text.split(mark))
        first = text[4] == mark  # the year comes first
        swap = mark == "/" and not first and a <= 12
        late = mark == "/" and not first and not swap
        year, month, day = (a, b, c) if first else (c, a, b) if swap else (c, b, a)
        try:
            x = (date(year, month, day) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        x = self._permuted("date" + "<"[:swap] + ">"[:late], _DAYS, x, back, lambda x: not late or (_FIRST + timedelta(x)).day > 12)
        d = _FIRST + timedelta(x)
        if first:
            return d.strftime(f"%Y{mark}%m{mark}%d")
        two = (d.month, d.day) if swap else (d.day, d.month)
        return mark.join([*(f"{v:02d}" for v in two), str(d.year)])

    def _iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "").upper()
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        account = self._in_classes("iban" + plain[:2], plain[4:], back)
        if account is None:
            return None
        chars = iter(plain[:2] + f"{98 - number(account + plain[:2] + '00') % 97:02d}" + account)
        return "".join(c if c == " " else next(chars).lower() if c.islower() else next(chars) for c in text)

    def _in_classes(self, tweak: str, text: str, back: bool) -> str | None:
        """``text`` with its ASCII letters and digits permuted, each within its class; None if there are none."""
        x, size, shape = 0, 1, ""
        for c in text:
            if c in _CLASSES:
                radix, zero = _CLASSES[c]
                x, size = x * radix + ord(c) - ord(zero), size * radix
                shape += zero
            else:
                shape += c
        if size == 1:
            return None
        x = self._permuted(tweak + shape, size, x, back)
        out = []
        for i, c in enumerate(reversed(shape)):
            if text[-1 - i] in _CLASSES:
                x, d = divmod(x, _CLASSES[c][0])
                c = chr(ord(c) + d)
            out.append(c)
        return "".join(reversed(out))

    def _email(self, text: str, back: bool) -> str | None:
        local, domain = text.rsplit("@", 1)
        new = self._in_classes(f"email@{domain.lower()}:", local, back)
        return None if new is None else f"{new}@{domain}"

    def _secret(self, text: str, back: bool) -> str | None:
        name = re.match(r"(?:key|token|secret|password|passwd)[\"']?\s*[=:]\s*[\"']?|[a-z]{2}_(?:live_|test_)?|gh[a-z]_|AKIA", text)[0]
        value = text[len(name) :]
        n = len(value)
        if re.fullmatch(r"[0-9]{16,}", value):
            return f"{name}{self._permuted(f'secret digits{n}', 10**n, int(value), back):0{n}d}"
        # letters of one case: mixed case would not come back as digits; one letter at least, so it is read so again
        if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
            x = f"{self._permuted(f'secret{n}', 16**n, int(value, 16), back, lambda x: not f'{x:x}'.isdigit()):0{n}x}"
            return name + (x.upper() if value == value.upper() else x)
        return self._apart(name, value, back)

    def _apart(self, name: str, value: str, back: bool) -> str | None:
        """A value by classes; what would be read as hexadecimal digits afterwards is walked on from."""
        while True:
            new = self._in_classes("secret", value, back)
            if new is None or not re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", new):
                return None if new is None else name + new
            value = new

    def replace(self, text: str, counts: dict[str, int], back: bool = False) -> str:
        """``text`` with its valid values replaced; what only looks like a value is passed over whole, so that
        the text is read the same way back."""

        def one(m: re.Match) -> str:
            kind = m.lastgroup
            new = self.value(kind, m[0], back) if kind in self.kinds else None
            if new is None:
                return m[0]
            counts[kind] += 1
            return new

        return _PATTERN.sub(one, text)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = KINDS, back: bool = False) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and the number of each kind as ``n_<kind>``.

    With ``back`` pseudonyms made under the same key become the values again.
    """
    small_batches(docs.sparkSession)
    made = [f"n_{k}" for k in kinds]
    names = [c for c in docs.columns if c not in made]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in made])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonymiser(key, kinds)
        for batch in batches:
            texts, counts = batch.column(text).to_pylist(), []
            for i, x in enumerate(texts):
                counts.append(dict.fromkeys(kinds, 0))
                if x:
                    texts[i] = own.replace(x, counts[-1], back)
            new = pa.array(texts, batch.column(text).type)
            yield pa.RecordBatch.from_arrays([*(new if c == text else batch.column(c) for c in names), *(pa.array([n[k] for n in counts], pa.int64()) for k in kinds)], names=[*names, *made])

    return docs.select(*names).mapInArrow(replace, schema)


#: The registered query's key. A key for real data is the caller's, from a secret store.
QUERY_KEY = b"a fixed key for a reproducible query"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
