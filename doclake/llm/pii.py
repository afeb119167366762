"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Every value that is found and valid is replaced by another valid value of the same format: card numbers keep their length
and a right check digit, addresses stay addresses, dates stay dates. Equal values get equal pseudonyms under one key, in
any document, so they stay linked; the permutation can be undone with the key. No value is its own pseudonym: the value is
permuted, moved on by a keyed step in the cycle, and permuted back.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from doclake.llm.common import text_slices, trimmed

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. n - 1 without fixed points (n > 1), from an unbalanced Feistel network.

    Numbers are split into a high and a low part; in turn, each part is moved by a keyed hash of the other. Where the parts'
    product is above n, results outside are permuted again until one lies inside.
    """

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n = n
        self.a = max(1, int(n**0.5)) if n < 1 << 100 else 1 << (n.bit_length() // 2)
        self.b = -(-n // self.a)
        self.seed = hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=32).digest()
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.seed, digest_size=16).digest(), "big") % max(1, n - 1)

    def _f(self, k: int, x: int, size: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%d" % (k, x), key=self.seed, digest_size=24).digest(), "big") % size

    def forward(self, x: int) -> int:
        while True:
            high, low = divmod(x, self.b)
            for k in range(ROUNDS):
                if k % 2:
                    high = (high + self._f(k, low, self.a)) % self.a
                else:
                    low = (low + self._f(k, high, self.b)) % self.b
            x = high * self.b + low
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            high, low = divmod(x, self.b)
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    high = (high - self._f(k, low, self.a)) % self.a
                else:
                    low = (low - self._f(k, high, self.b)) % self.b
            x = high * self.b + low
            if x < self.n:
                return x

    def apply(self, x: int) -> int:
        return self.backward((self.forward(x) + self.step) % self.n)

    def undo(self, x: int) -> int:
        return self.backward((self.forward(x) - self.step) % self.n)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its decimal digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


#: Dates of these years stay in them, and dates of all other years from 1 to 9999 in the others.
NEAR = range(1900, 2100)


class _Calendar:
    """Numbers the days whose day or month has one digit where it is written so, and comes after the twelfth if ``late``.

    A date that can be read in one order only stays such a date.
    """

    def __init__(self, near: bool, short_day: bool, short_month: bool, late: bool):
        fits = lambda x: not (short_day and x.day > 9 or short_month and x.month > 9 or late and x.day <= 12)
        year = lambda y: [x for d in range(366) if (x := datetime.date(y, 1, 1) + datetime.timedelta(d)).year == y and fits(x)]
        self.of = {leap: [(x.month, x.day) for x in year(2004 if leap else 2001)] for leap in (False, True)}
        self.years = [y for y in range(1, 10_000) if (y in NEAR) == near]
        self.starts = [0]
        for y in self.years:
            self.starts.append(self.starts[-1] + len(self.of[calendar.isleap(y)]))
        self.n = self.starts[-1]

    def index(self, day: datetime.date) -> int:
        at = bisect.bisect_left(self.years, day.year)
        return self.starts[at] + bisect.bisect_left(self.of[calendar.isleap(day.year)], (day.month, day.day))

    def day(self, k: int) -> datetime.date:
        at = bisect.bisect_right(self.starts, k) - 1
        y = self.years[at]
        return datetime.date(y, *self.of[calendar.isleap(y)][k - self.starts[at]])


class Pseudonyms:
    """Finds and replaces values under one key; ``undo`` gives the original values back."""

    #: Kinds in order of precedence: where two finds overlap, the earlier one that starts first wins.
    PATTERNS = {
        "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "key_id": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
        "secret": r"(?i:(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{12,}|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?)(?![A-Za-z0-9])",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?![\d/-])",
        "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
        "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
        "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
        "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)",
    }
    KINDS = tuple(PATTERNS)

    def __init__(self, key: bytes):
        self.key = key
        self.pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in self.PATTERNS.items()))
        self.permutations: dict[tuple[int, str], Permutation] = {}

    def _permute(self, x: int, n: int, tweak: str, undo: bool) -> int:
        if n < 2:
            return x
        if (n, tweak) not in self.permutations:
            if len(self.permutations) > 4096:
                self.permutations.clear()
            self.permutations[n, tweak] = Permutation(n, self.key, tweak)
        p = self.permutations[n, tweak]
        return p.undo(x) if undo else p.apply(x)

    def _number(self, digits: str, tweak: str, undo: bool) -> str:
        return str(self._permute(int(digits), 10 ** len(digits), f"{tweak}:{len(digits)}", undo)).zfill(len(digits)) if digits else ""

    def _classes(self, text: str, tweak: str, undo: bool, alphabets: tuple[str, ...] = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> str:
        """Permutes all strings with this pattern of character classes; other characters stay."""
        of = {c: a for a in alphabets for c in a}
        radices = [len(of[c]) if c in of else 1 for c in text]
        x, n = 0, 1
        for c, r in zip(text, radices):
            x, n = x * r + (of[c].index(c) if r > 1 else 0), n * r
        shape = "".join("dlu"[alphabets.index(of[c])] if c in of else c for c in text)
        x, out = self._permute(x, n, f"{tweak}:{shape}", undo), []
        for c, r in zip(reversed(text), reversed(radices)):
            if r == 1:
                out.append(c)
            else:
                x, k = divmod(x, r)
                out.append(of[c][k])
        return "".join(reversed(out))

    def value(self, kind: str, text: str, undo: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't a valid one of its kind."""
        if kind != "email" and not text.isascii():  # decimal digits of any script count as digits
            text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
        return getattr(self, f"_{kind}")(text, undo)

    def _email(self, text: str, undo: bool) -> str | None:
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self._classes(local, 'local', undo)}@{self._classes(host, 'host', undo)}.{top}"

    def _key_id(self, text: str, undo: bool) -> str | None:
        return text[:4] + self._classes(text[4:], "key", undo, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))

    def _secret(self, text: str, undo: bool) -> str | None:
        at = re.search(r"[A-Za-z0-9_+/-]*\Z", text).start() if re.search(r"[:=\"'\s]", text) else (4 if re.match(r"gh[pousr]_|xox[abp]-", text) else 3 if text.startswith("sk-") else 0)
        head, body = text[:at], text[at:]
        if re.fullmatch("[0-9a-f]+", body):
            return head + self._classes(body, "hex", undo, ("0123456789abcdef",))
        return head + self._classes(body, "secret", undo, ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",))

    def _iban(self, text: str, undo: bool) -> str | None:
        bare = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
            return None
        body = self._classes(bare[4:], "iban" + bare[:2], undo)
        bare = f"{bare[:2]}{98 - number(body + bare[:2] + '00') % 97:02d}{body}"
        it = iter(bare)
        return "".join(c if c == " " else next(it) for c in text)

    @functools.cache  # noqa: B019  at most sixteen small tables, and one tool per key
    def _calendar(self, near: bool, short_day: bool, short_month: bool, late: bool) -> "_Calendar":
        return _Calendar(near, short_day, short_month, late)

    def _date(self, text: str, undo: bool) -> str | None:
        a, b, c = re.split(r"[./-]", text)
        mark = text[len(a)]
        if len(a) == 4:
            order, late = "ymd", False
        elif mark == "/":
            order, late = ("mdy", False) if int(a) <= 12 else ("dmy", True)
        else:
            order, late = ("dmy", False) if int(b) <= 12 else ("mdy", True)
        written = dict(zip(order, (a, b, c)))
        parts = {k: int(x) for k, x in written.items()}
        try:
            day = datetime.date(parts["y"], parts["m"], parts["d"])
        except ValueError:
            return None
        kind = day.year in NEAR, len(written["d"]) == 1, len(written["m"]) == 1, late
        days = self._calendar(*kind)
        new = days.day(self._permute(days.index(day), days.n, f"date{kind}", undo))
        got = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{got[k]:0{len(written[k])}d}" for k in order)

    def _ip(self, text: str, undo: bool) -> str | None:
        octets = list(map(int, text.split(".")))
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        return str(ipaddress.IPv4Address(self._permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", undo)))

    def _ip6(self, text: str, undo: bool) -> str | None:
        """In the shortest form, whatever the address's own: all forms of one address share a pseudonym."""
        try:
            value = int(ipaddress.IPv6Address(text)) if text != "::" else None
        except ValueError:
            return None
        if value is None:
            return None
        new = str(ipaddress.IPv6Address(self._permute(value, 1 << 128, "ip6", undo)))
        return new.upper() if text.isupper() else new

    def _ssn(self, text: str, undo: bool) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)
        x = self._permute((areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", undo)
        x, serial = divmod(x, 9999)
        areas, group = divmod(x, 99)
        return f"{areas + 1 + (areas >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str, undo: bool) -> str | None:
        code = re.match(r"\+\d{1,3}(?=\D)", text)
        at = code.end() if code else (1 if text[0] == "+" else 0)
        body = _only_digits(text[at:])
        if not 7 <= len(body) <= 15:
            return None
        return text[:at] + _refill(text[at:], self._number(body, "phone", undo))

    def _card(self, text: str, undo: bool) -> str | None:
        digits = _only_digits(text)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._number(digits[1:-1], "card" + digits[0], undo)
        return _refill(text, digits[0] + body + luhn_digit(digits[0] + body))

    def replace(self, text: str, undo: bool = False) -> tuple[str, dict[str, int]]:
        """The text with every valid value replaced, and how many of each kind."""
        counts: dict[str, int] = {}
        out, at = [], 0
        while m := self.pattern.search(text, at):
            new = self.value(m.lastgroup, m.group(), undo)
            kind, end = m.lastgroup, m.end()
            if new is None:  # another kind may hold from the same place
                for other in self.KINDS[self.KINDS.index(kind) + 1 :]:
                    again = self._one(other).match(text, m.start())
                    if again and (new := self.value(other, again.group(), undo)) is not None:
                        kind, end = other, again.end()
                        break
            if new is None:
                end = m.start() + 1
                while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
                    end += 1
                new = text[m.start() : end]
            else:
                counts[kind] = counts.get(kind, 0) + 1
            out += [text[at : m.start()], new]
            at = end
        return ("".join(out) + text[at:], counts) if out else (text, counts)

    def _one(self, kind: str) -> re.Pattern[str]:
        return re.compile(self.PATTERNS[kind])


#: No kind can be found in a text without one of these.
_HINT = re.compile(r"[\d@]|:[0-9A-Fa-f]{0,4}:|sk-|xox|gh[pousr]_|A[KS]IA|[a-f]{32}|(?i:token|secret|passw|api[_-]?key|access[_-]?key|auth)")
_PSEUDONYMS: dict[bytes, Pseudonyms] = {}


def pseudonyms(key: bytes) -> Pseudonyms:
    if key not in _PSEUDONYMS:
        _PSEUDONYMS[key] = Pseudonyms(key)
    return _PSEUDONYMS[key]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False, replaced_col: str | None = "n_replaced", kinds_col: str | None = "pii_kinds") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, and how many there were in all and by kind.

    ``key`` is a secret: whoever has it can undo the pseudonyms, and other keys give other ones.

    Whole texts of any length are searched. Null texts stay null, with no values; all other columns, repeated rows and the
    number of rows stay as they are. Columns named like the two new ones are replaced; None leaves a count out.
    """
    names = [c for c in docs.columns if c not in (replaced_col, kinds_col)]
    extra = [StructField(c, kind) for c, kind in ((replaced_col, IntegerType()), (kinds_col, MapType(StringType(), IntegerType()))) if c is not None]
    fields = [StructField(text_col, StringType()) if c == text_col else docs.schema[c] for c in names]
    out = StructType([*fields, *extra])
    place = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pseudonyms(key)
        for batch in batches:
            for part in text_slices(batch, place):
                texts, counts = [], []
                for value in part.column(place):
                    text, found = value.as_py(), {}
                    if text and _HINT.search(text):
                        text, found = tool.replace(text, undo)
                    texts.append(text)
                    counts.append(found)
                columns = list(part.columns)
                columns[place] = pa.array(texts, pa.string())
                if replaced_col is not None:
                    columns.append(pa.array([sum(c.values()) for c in counts], pa.int32()))
                if kinds_col is not None:
                    columns.append(pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    numbered = [F.col(f"`{c}`").cast("string" if c == text_col else docs.schema[c].dataType).alias(f"c{k}") for k, c in enumerate(names)]
    return docs.select(*numbered).mapInArrow(trimmed(work), out)
