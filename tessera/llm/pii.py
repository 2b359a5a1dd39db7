"""Format-preserving pseudonyms: validated values are permuted within their format by a keyed Feistel network.

Equal values get equal pseudonyms, so they stay linked across documents; different values of one format stay different, and
no value is its own pseudonym. The key is the caller's secret: there is none by default.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from bisect import bisect_left, bisect_right
from functools import lru_cache
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts

ROUNDS = 8
#: Where the queries and the pipeline find their key.
KEY_SETTING = "spark.tessera.secret.pseudonyms"
#: Domains up to this size are permuted as numbers; texts of larger ones symbol by symbol, in linear time.
NUMBERS_TO = 1 << 256
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1

# How values are written.
EMAIL = re.compile(
    r"(?<![\w.'+%-])[.'%+-]*+(?P<local>\w(?:[\w.'%+-]*+(?<!\.))?)"
    r"@(?P<domain>(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])"
)
NUMBER = re.compile(
    r"""(?<![\w.@/-])(?:
    (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w-]|\.[0-9])
    |(?P<date>[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?!(?!T[0-9]{2}:)[\w/-]|\.[0-9])
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    |(?P<card>[0-9]{13,19}
        |[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}
        |[0-9]{4}[ -][0-9]{4}-[0-9]{4}[ -][0-9]{4}
        |[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w|-[0-9])
    |(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}
        |\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}
        |[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w|-[0-9])
    )""",
    re.X,
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])
    |(?P<label>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))["']?\s{0,3}(?P<sign>[:=])(?P<gap>\s{0,3}))
        (?:"(?P<double>[^"\r\n]{6,}+)"|'(?P<single>[^'\r\n]{6,}+)'|["'`]?(?P<bare>[^\s<>"'`][^\s<>]{5,}+))
    |(?<![A-Za-z0-9])(?P<prefixed>(?:ghp|gho|sk|pk|xox[abp])[_-])(?P<rest>[A-Za-z0-9_-]{16,}+)""",
    re.X,
)
#: What may stand after a value without quotes, and a word of prose.
AFTER_VALUE, WORD = "\"'`.,;:!?)]}", re.compile(r"(?:[^\W\d_]|(?<=[^\W\d_])['’-])(?:[a-zß-öø-ÿ]|(?<=\w)['’-])*")
SECRET_HINTS = ("akia", "asia", "pass", "pwd", "secret", "token", "key", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox")


@lru_cache(maxsize=16)
def _secret(key: bytes) -> bytes:
    """All of the key, whatever its length."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return hashlib.sha512(key).digest()


def _stream(key: bytes, tweak: bytes, i: int, half: bytes, size: int) -> bytes:
    """`size` bytes that depend on the key, the format, the round and one half of a value."""
    return hashlib.shake_256(_secret(key) + b"%d|%d|" % (len(tweak), i) + tweak + half).digest(size)


def permute(x: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """A keyed bijection of 0 .. size - 1: unbalanced Feistel rounds on x = a + b * m, walked until back in the domain."""
    if size < 2:
        return x
    m = isqrt(size - 1) + 1
    n = -(-size // m)
    width = m.bit_length() // 8 + 1

    def mask(i: int, half: int) -> int:
        return int.from_bytes(_stream(key, tweak, i, half.to_bytes(width, "big"), width + 16), "big")

    sign = -1 if back else 1
    while True:
        a, b = x % m, x // m
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if i % 2:
                b = (b + sign * mask(i, a)) % n
            else:
                a = (a + sign * mask(i, b)) % m
        x = a + b * m
        if x < size:
            return x


def _other(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed bijection without fixed points: a step to the next value, seen through the permutation."""
    if size < 2:
        return x
    return permute((permute(x, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def _permute_symbols(digits: np.ndarray, radix: np.ndarray, key: bytes, tweak: bytes, back: bool) -> None:
    """The Feistel rounds on the two halves of a long value, symbol by symbol, in place."""
    half = len(digits) // 2
    halves = (slice(0, half), slice(half, None))
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        to, by = halves[i % 2], halves[1 - i % 2]
        mask = np.frombuffer(_stream(key, tweak, i, digits[by].astype(np.uint8).tobytes(), 8 * len(radix[to])), "<u8")
        step = (mask % radix[to].astype(np.uint64)).astype(np.int64)
        digits[to] = (digits[to] + (-step if back else step)) % radix[to]


def _other_symbols(digits: list[int], radix: list[int], key: bytes, tweak: bytes) -> list[int]:
    """As _other, for values of any length: the step is one of the first symbol."""
    d, r = np.array(digits, np.int64), np.array(radix, np.int64)
    _permute_symbols(d, r, key, tweak, back=False)
    d[0] = (d[0] + 1) % r[0]
    _permute_symbols(d, r, key, tweak, back=True)
    return d.tolist()


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = {c: kind for kind in (DIGITS, LOWER, UPPER) for c in kind}
HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


def permute_text(value: str, key: bytes, tweak: bytes) -> str:
    """Digits to digits, lower to lower and capital to capital letters, hexadecimal digits to such; the rest stays.

    The format (which kind of character stands where) enters the permutation, so values of one format stay different.
    Texts that read as hexadecimal are a format apart, and their pseudonyms read so too: they are permuted among all
    texts of such digits until one has a letter and a digit again.
    """
    hexadecimal = _reads_hexadecimal(value)
    spans = HEX if hexadecimal else PLAIN
    kinds = [spans.get(c) for c in value]
    names = {DIGITS: "0", LOWER: "a", UPPER: "A"}
    shape = "".join([names.get(k, "f") if k else c for c, k in zip(value, kinds, strict=True)])
    tweak += (b"hex" if hexadecimal else b"") + shape.encode("utf-8", "surrogatepass")
    digits = [k.index(c) for c, k in zip(value, kinds, strict=True) if k]
    radix = [len(k) for k in kinds if k]
    if not digits:
        return value
    while True:
        digits = _other_digits(digits, radix, key, tweak)
        it = iter(digits)
        out = "".join([k[next(it)] if k else c for c, k in zip(value, kinds, strict=True)])
        if hexadecimal == _reads_hexadecimal(out):
            return out


def _reads_hexadecimal(value: str) -> bool:
    letters = {c for c in value if c.isalpha()}
    return bool(letters) and letters <= set("abcdef") and len(value) >= 8 and any(c in DIGITS for c in value)


def _other_digits(digits: list[int], radix: list[int], key: bytes, tweak: bytes) -> list[int]:
    x, size = 0, 1
    for d, r in zip(digits, radix, strict=True):
        x, size = x * r + d, size * r
        if size > NUMBERS_TO:
            return _other_symbols(digits, radix, key, tweak)
    y, out = _other(x, size, key, tweak), []
    for r in reversed(radix):
        y, d = divmod(y, r)
        out.append(d)
    return out[::-1]


def _refill(shape: str, digits: str) -> str:
    """The digits at the places of the digits of `shape`."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Check sum modulo ten; 0 for a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def card(value: str, key: bytes) -> str | None:
    """A card number that passes its check digit: all digits but the last are permuted, the last follows."""
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = str(_other(int(digits[:-1]), 10**n, key, b"card%d" % n)).zfill(n)
    return _refill(value, body + str(-luhn(body + "0") % 10))


def ip(value: str, key: bytes) -> str | None:
    """A dotted address, each part up to 255."""
    parts = value.split(".")
    if any(int(p) > 255 for p in parts):
        return None
    y = _other(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def ssn(value: str, key: bytes) -> str | None:
    """A social security number of a range in use; so is its pseudonym."""
    a, g, s = (int(x) for x in value.split("-"))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    y = _other((areas.index(a) * 99 + g - 1) * 9999 + s - 1, len(areas) * 99 * 9999, key, b"ssn")
    return f"{areas[y // 9999 // 99]:03}-{y // 9999 % 99 + 1:02}-{y % 9999 + 1:04}"


def phone(value: str, key: bytes) -> str | None:
    """The last ten digits, or all of a shorter number but its country code; the layout stays."""
    digits = re.sub(r"\D", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    n = min(10, len(digits) - 1 if value[0] == "+" else len(digits))
    return _refill(value, digits[:-n] + str(_other(int(digits[-n:]), 10**n, key, b"phone%d" % n)).zfill(n))


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """The days of the range after the twelfth of their month: the only ones that can be told to be written month first."""
    return [x for x in range(DAYS) if datetime.date.fromordinal(DAY0 + x).day > 12]


def _padded(parts: list[str]) -> list[bool]:
    """Whether days and months below ten bear a zero; a number of two digits follows the other part, or bears one."""
    own = [len(p) == 2 if int(p) < 10 else None for p in parts]
    return [own[i] if own[i] is not None else own[1 - i] is not False for i in (0, 1)]


def date(value: str, key: bytes) -> str | None:
    """A calendar date of 1900 to 2099, day first unless only month first fits.

    The day is permuted; order, separators and the use of leading zeros stay. One day gets one pseudonym in all layouts
    but the month-first one: what reads as month first has a permutation of its own among days after the twelfth, so
    that its pseudonym reads so too.
    """
    a, s1, b, s2, c = re.split(r"([-/.])", value)
    year_first = len(a) == 4
    for order in ["ymd"] if year_first else ["dmy", "mdy"]:
        parts = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"]))
        except ValueError:
            continue
        x = day.toordinal() - DAY0
        if s1 != s2 or not 0 <= x < DAYS:
            return None
        if order == "mdy":
            late = _late_days()
            y = late[_other(bisect_left(late, x), len(late), key, b"date mdy")]
        else:
            y = _other(x, DAYS, key, b"date")
        new = datetime.date.fromordinal(DAY0 + y)
        zero = dict(zip("md", _padded([parts["m"], parts["d"]]), strict=True))
        shown = {"y": f"{new.year:04}"} | {k: f"{v:02}" if zero[k] else str(v) for k, v in (("m", new.month), ("d", new.day))}
        return s1.join(shown[k] for k in order)
    return None


def iban(value: str, key: bytes) -> str | None:
    """An account number with valid check digits: the account part is permuted, the check digits follow."""
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_text(plain[4:], key, b"iban")
    new = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in value)


def email(local: str, domain: str, key: bytes) -> str:
    """The part before @; the domain names no person and stays. A part of few characters takes the tweak of its domain."""
    return permute_text(local, key, b"email" + domain.lower().encode())


NUMBERS = {"ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}
Value = tuple[int, int, str, str]


class Masker:
    def __init__(self, key: bytes):
        _secret(key)
        self.key = key

    @staticmethod
    def _collect(pattern: re.Pattern, text: str, replace, found: list[Value]) -> list[Value]:
        """`found`, in order, and what validates and overlaps nothing of it; `replace` gives a value or nothing."""
        starts, ends = [v[0] for v in found], [v[1] for v in found]
        own, at = [], 0
        while m := pattern.search(text, at):
            got = replace(m)
            if got and bisect_right(ends, got[0]) == bisect_left(starts, got[1]):  # none between what ends before and begins after
                own.append(got)
            at = m.end() if got else m.start() + 1  # what fails to validate may hide something shorter
        return sorted([*found, *own]) if own else found

    def find(self, text: str) -> list[Value]:
        """(start, end, kind, pseudonym) of all values, in order, without overlaps."""
        found: list[Value] = []
        low = text.lower()
        if any(h in low for h in SECRET_HINTS):
            found = self._collect(SECRET, text, self._secret, found)
        if "@" in text:
            found = self._collect(EMAIL, text, self._email, found)
        if any(d in text for d in DIGITS):
            found = self._collect(IBAN, text, self._iban, found)
            found = self._collect(NUMBER, text, self._number, found)
        return found

    def _secret(self, m: re.Match) -> Value | None:
        """A quoted value runs to its quote, another one to white space; one plain word after a colon and a blank is prose."""
        if m["aws"]:
            return m.start("aws"), m.end("aws"), "secret", m["aws"][:4] + permute_text(m["aws"][4:], self.key, b"aws")
        group = next(g for g in ("double", "single", "bare", "rest") if m[g])
        value = m[group]
        if group == "bare":
            value = value.rstrip(AFTER_VALUE)
            prose = m["sign"] == ":" and m["gap"] and WORD.fullmatch(value)
            if len(value) < 6 or prose:
                return None
        new = permute_text(value, self.key, b"secret")
        return None if new == value else (m.start(group), m.start(group) + len(value), "secret", new)

    def _email(self, m: re.Match) -> Value:
        new = email(m["local"], m["domain"], self.key)
        return m.start("local"), m.end(), "email", f"{new}@{m['domain']}"

    def _iban(self, m: re.Match) -> Value | None:
        value = m.group()
        while value:  # what follows may only look like a last group, as a currency does
            if new := iban(value, self.key):
                return m.start(), m.start() + len(value), "iban", new
            value = value.rpartition(" ")[0]
        return None

    def _number(self, m: re.Match) -> Value | None:
        kind = next(k for k in NUMBERS if m[k])
        new = NUMBERS[kind](m.group(), self.key)
        return new and (m.start(), m.end(), kind, new)

    def mask(self, text: str) -> tuple[str, list[Value]]:
        """The text with its pseudonyms, and the values found."""
        found, out, at = self.find(text), [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]) if found else text, found


def session_key(spark: SparkSession) -> bytes:
    """The key in the setting KEY_SETTING; where it is unset, a random one that lasts as long as the session.

    Give the setting a secret from outside to link values across sessions. Spark redacts settings of such a name.
    """
    if not (key := spark.conf.get(KEY_SETTING, None)):
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(32))
    return key.encode()


def pseudonymize(docs: DataFrame, key: bytes, keep=("doc_id",), text: str = "text", spans: bool = False) -> DataFrame:
    """Per row the text with pseudonyms in place of values (column `text`), n_pii and pii_kinds; with `spans` also where.

    key: the caller's secret, of any length but not empty; the same key gives the same pseudonyms in every run. Emails,
    addresses, card, phone, account and social security numbers, dates and secrets, of any length, as far as they validate
    (check digits, ranges, calendar); what does not stays as it is. A null text stays null, an empty one empty; both have
    no values. Repeated rows stay and get equal results. Of the other columns only `keep` is read; a kept one that is
    named like a result gives way to it. Narrow; Python, since keyed permutations are not expressible in SQL.
    """
    schema = "text string, n_pii long, pii_kinds string"
    schema += ", values array<struct<kind:string,start:int,end:int,pseudonym:string>>" if spans else ""

    def make():
        masker = Masker(key)

        def work(texts):
            got = [masker.mask(t) if t else (t, []) for t in texts]
            out = {"text": [t for t, _ in got], "n_pii": [len(found) for _, found in got]}
            out["pii_kinds"] = [",".join(sorted({v[2] for v in found})) for _, found in got]
            if spans:
                out["values"] = [[{"kind": k, "start": a, "end": b, "pseudonym": p} for a, b, k, p in found] for _, found in got]
            return out

        return work

    return map_texts(docs, make, schema, keep, text)
