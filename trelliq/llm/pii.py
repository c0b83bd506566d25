"""Format-preserving pseudonyms for personal data.

Emails, card, phone, social-security and account numbers, IP addresses, dates, labelled secrets and access keys with an issuer's prefix are found by pattern and
validated (check digits, ranges, the calendar). Each valid value is written as a number below the count of values of its format
and sent through a keyed Feistel network with cycle walking, a permutation of that range. So pseudonyms have the same format and
pass the same validation, equal values in the same format get equal pseudonyms in every document, different values different ones.
Where a format could be read in two ways (3/4/2020), the walk goes on until the pseudonym is read as its value was, so whoever has
the key can go back. What fails validation is left alone.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")

#: Months as they are written out.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = f"(?i:{'|'.join(MONTHS)})"

_PATTERN = re.compile(
    r"(?P<secret>(?i:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer)[\"']?\s*[=:]\s*[\"']?(?P<body>(?=[A-Za-z0-9_+/.-]*?[A-Za-z0-9_+/-]{16})[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+={0,2}+(?!@)))"
    r"|(?P<token>(?<![A-Za-z0-9_])(?:A(?:KIA|SIA|IDA|ROA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,80}|[sr]k_live_[A-Za-z0-9]{16,64})(?![A-Za-z0-9_]))"
    r"|(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}(?:\d{2}|:\d{2}))|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])))"
    rf"|(?P<written>(?<![\w.,/-])(?:\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})(?![\w/-]))"
    r"|(?P<ip>(?<![\w.])(?<!(?i:version) )(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?=[a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5}::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![\w:]|\.\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|0\d{2,4}[/-]\d{5,8}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|(?<!\d[ .-])(?:\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})(?![ .]\d))(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
_MAY_HOLD = re.compile(r"[0-9@]|[=:]\s*[\"']?[A-Za-z0-9_+/.-]{16}|A(?:KIA|SIA|IDA|ROA)|AIza|gh[pousr]_|xox[abprs]-|k_live_")

_PIECE = 192
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31


class Feistel:
    """Keyed permutations of the ranges 0..size-1, another for each kind and size."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def _round(self, kind: str, size: int, i: int, half: int, width: int) -> int:
        data = b"%d %d %d" % (size, i, half)
        return int.from_bytes(blake2b(data, digest_size=min(64, width // 8 + 8), key=self.key, person=kind.encode()[:16]).digest(), "big") & ((1 << width) - 1)

    def _once(self, kind: str, size: int, value: int, width: int, order) -> int:
        left, right = value >> width, value & ((1 << width) - 1)
        if order.step > 0:
            for i in order:
                left, right = right, left ^ self._round(kind, size, i, right, width)
        else:
            for i in order:
                left, right = right ^ self._round(kind, size, i, left, width), left
        return left << width | right

    def _walk(self, kind: str, size: int, value: int, order) -> int:
        if not 0 <= value < size:
            raise ValueError("value outside its range")
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            value = self._once(kind, size, value, width, order)
            if value < size:
                return value

    def forward(self, kind: str, size: int, value: int) -> int:
        return self._walk(kind, size, value, range(self.rounds))

    def backward(self, kind: str, size: int, value: int) -> int:
        return self._walk(kind, size, value, range(self.rounds - 1, -1, -1))


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _within(value, once: Callable, same: Callable):
    """``once`` again and again until ``same``: a permutation of the values that are ``same``, if ``once`` permutes all of them."""
    value = once(value)
    while not same(value):
        value = once(value)
    return value


def _shuffle(text: str, kind: str, step, letters: str = _LETTERS) -> str:
    """Digits to digits and letters to letters, all positions at once; case and other characters stay where they are."""
    value, size = 0, 1
    low = text.lower()
    for c in low:
        alphabet = _DIGITS if c in _DIGITS else letters if c in letters else ""
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    if size == 1:
        return text
    value, out = step(kind, size, value), []
    for c, was in zip(reversed(low), reversed(text), strict=True):
        alphabet = _DIGITS if c in _DIGITS else letters if c in letters else ""
        if alphabet:
            value, i = divmod(value, len(alphabet))
            c = alphabet[i].upper() if was.isupper() else alphabet[i]
        out.append(c)
    return "".join(reversed(out))


def _is_hex(text: str) -> bool:
    """A hexadecimal number with letters, all of one case."""
    return bool(re.fullmatch(r"(?=[0-9]*[a-f])[0-9a-f]+|(?=[0-9]*[A-F])[0-9A-F]+", text))


def _secret(text: str, kind: str, step) -> str:
    """Hexadecimal numbers become such numbers; others keep digits and letters where they are and become no such number."""
    if _is_hex(text):
        form = f"0{len(text)}{'X' if text.upper() == text else 'x'}"
        return _within(text, lambda t: format(step(f"hex{kind[6:]}", 16 ** len(t), int(t, 16)), form), _is_hex)
    return _within(text, lambda t: _shuffle(t, kind, step), lambda t: not _is_hex(t))


def _pieces(text: str, step) -> str:
    """A long secret in even pieces, each by the permutation of its place: a round of the network has 64 bytes for half a value."""
    n = -(-len(text) // _PIECE)
    stops = [len(text) * i // n for i in range(n + 1)]
    return "".join(_secret(text[a:b], f"secret {i}", step) for i, (a, b) in enumerate(zip(stops, stops[1:])))


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


#: Orders of the fields of a date, in the order in which a text is tried.
_DATES = (("ymd", re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})")), ("dmy", re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4})")), ("mdy", re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})")), ("dmy", re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})")))


def _date(text: str, step) -> str | None:
    """3/4/2020 is month/day if the calendar has it. A pseudonym keeps the width of each field and whether the day is beyond 12."""
    for form, pattern in _DATES:
        if m := pattern.fullmatch(text):
            part, width = dict(zip(form, map(int, m.groups()), strict=True)), dict(zip(form, map(len, m.groups()), strict=True))
            try:
                day = datetime.date(part["y"], part["m"], part["d"])
            except ValueError:
                continue
            if 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
                break
    else:
        return None

    def same(value: int) -> bool:
        new = datetime.date.fromordinal(_FIRST_DAY + value)
        return (new.day > 12) == (day.day > 12) and (width["d"] == 2 or new.day < 10) and (width["m"] == 2 or new.month < 10)

    new = datetime.date.fromordinal(_FIRST_DAY + _within(day.toordinal() - _FIRST_DAY, lambda v: step("date", _DAYS, v), same))
    field = {"y": new.year, "m": new.month, "d": new.day}
    return ("-" if "-" in text else "." if "." in text else "/").join(f"{field[c]:0{width[c]}d}" for c in form)


def _written_date(text: str, step) -> str | None:
    """A day with its month as a word: 4 March 1999 or March 4, 1999. The pseudonym's month is a word in the same case, and the day keeps its width."""
    first = text[0].isdigit()
    parts = text.replace(",", "").split(" ")
    day, month = (parts[0], parts[1]) if first else (parts[1], parts[0])
    try:
        date = datetime.date(int(parts[2]), 1 + [m.lower() for m in MONTHS].index(month.lower()), int(day))
    except ValueError:
        return None
    if not 0 <= date.toordinal() - _FIRST_DAY < _DAYS:
        return None

    def same(value: int) -> bool:
        new = datetime.date.fromordinal(_FIRST_DAY + value)
        return (new.day > 12) == (date.day > 12) and (len(day) == 2 or new.day < 10)

    new = datetime.date.fromordinal(_FIRST_DAY + _within(date.toordinal() - _FIRST_DAY, lambda v: step("date", _DAYS, v), same))
    word = MONTHS[new.month - 1]
    word = word.upper() if month.isupper() else word.lower() if month.islower() else word
    number = f"{new.day:0{len(day)}d}"
    return f"{number} {word} {new.year}" if first else f"{word} {number}, {new.year}"


def _ip(text: str, step) -> str | None:
    """Octets with leading zeros keep their widths, and one at least keeps a leading zero."""
    parts = text.split(".")
    if max(map(int, parts)) > 255:
        return None
    if not any(len(p) > 1 and p[0] == "0" for p in parts):
        return ".".join(str(b) for b in step("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big")).to_bytes(4, "big"))
    radix = [{1: 10, 2: 100, 3: 256}[len(p)] for p in parts]
    size = radix[0] * radix[1] * radix[2] * radix[3]

    def written(value: int) -> list[str]:
        out = []
        for r, p in zip(reversed(radix), reversed(parts), strict=True):
            value, octet = divmod(value, r)
            out.append(f"{octet:0{len(p)}d}")
        return out[::-1]

    value = 0
    for r, p in zip(radix, parts, strict=True):
        value = value * r + int(p)
    zero = lambda v: any(len(p) > 1 and p[0] == "0" for p in written(v))
    return ".".join(written(_within(value, lambda v: step(f"ip {''.join(str(len(p)) for p in parts)}", size, v), zero)))


def replace(kind: str, text: str, step) -> str | None:
    """Pseudonym of a found value, None if it fails validation. ``step`` is Feistel.forward, or backward to undo.

    An IPv6 address keeps its spelling: digits become digits and letters letters a-f, so another spelling is another value.
    """
    digits = _digits(text)
    if kind == "email":
        at = text.rindex(".")
        return _shuffle(text[:at], kind, step) + text[at:]
    if kind == "secret":
        if len(text) > _PIECE:
            return _pieces(text, step)
        return _secret(text, kind, step)
    if kind == "token":
        lead = 8 if text[1:8] == "k_live_" else 5 if text.startswith("xox") else 4  # what names the issuer stays
        return text[:lead] + _shuffle(text[lead:], "secret", step)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        n = len(digits) - 2  # the first digit (the issuer's kind) stays, the last follows
        whole = lambda v: (body := digits[0] + str(v).zfill(n)) + luhn_digit(body)
        value = _within(int(digits[1:-1]), lambda v: step(kind, 10**n, v), lambda v: len(set(whole(v))) > 1)
        return _refill(text, whole(value))
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        n = min(10, len(digits))  # the same number with and without its country code stays linked
        return _refill(text, digits[:-n] + str(step(kind, 10**n, int(digits[-n:]))).zfill(n))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        rank = area - 1 - (area > 666)
        value = step(kind, 898 * 99 * 9999, (rank * 99 + group - 1) * 9999 + serial - 1)
        rank, group, serial = value // 9999 // 99, value // 9999 % 99 + 1, value % 9999 + 1
        return f"{rank + 1 + (rank >= 665):03d}-{group:02d}-{serial:04d}"
    if kind == "ip":
        return _ip(text, step)
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return _shuffle(text, kind, step, "abcdef")
    if kind == "iban":
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _iban_number(flat) % 97 != 1:
            return None
        body = _shuffle(flat[4:], kind, step)
        check = 98 - _iban_number(flat[:2] + "00" + body) % 97
        it = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "date":
        return _date(text, step)
    if kind == "written":
        return _written_date(text, step)
    raise ValueError(kind)


def pseudonymise(text: str | None, step) -> tuple[str | None, Counter]:
    """The text with valid values replaced, and how many of each kind."""
    found: Counter = Counter()
    if not text or not _MAY_HOLD.search(text):
        return text, found

    def swap(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "secret":
            found[kind] += 1
            return m[0][: m.start("body") - m.start()] + replace(kind, m["body"], step)
        new = replace(kind, m[0], step)
        if new is None:
            return m[0]
        found[{"token": "secret", "ipv6": "ip", "written": "date"}.get(kind, kind)] += 1
        return new

    return _PATTERN.sub(swap, text), found


def pseudonyms(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count for each kind, for every row of ``docs`` (doc_id, text, ...).

    Null text stays null and empty text empty, with counts of 0. Whole texts are read. Repeated rows and null doc_ids are passed
    on; equal values get equal pseudonyms wherever they occur. An empty table gives an empty result. Other columns are neither
    read nor returned. Each row is handled by itself, so no key, source or value can gather in one task.
    ``key`` has 16 to 64 bytes; with ``undo`` pseudonyms made with it are turned back.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Feistel(key)
        step = network.backward if undo else network.forward
        for batch in batches:
            for part in slices(batch, "text", rows=1024):
                texts, counts = [], []
                for t in part.column("text").to_pylist():
                    new, found = pseudonymise(t, step)
                    texts.append(new)
                    counts.append(found)
                kinds = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
                total = pa.array([c.total() for c in counts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), total, *kinds], names=["doc_id", "text", "n_found", *[f"n_{k}" for k in KINDS]])

    rows = docs.select("doc_id", "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_found long, {counts}")
