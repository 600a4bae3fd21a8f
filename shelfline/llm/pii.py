"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn, mod 97, octets, calendar).
The characters that carry a value are read as one number in the mixed radix of
their format, that number goes through a keyed Feistel permutation of exactly
the values the format can hold, and it is written back in the same format. The
same value gives the same pseudonym in every document, two values never share
one, the holder of the key can undo it, and no text changes its length.

A value that spans the format's few possibilities (say, one letter) may map to
itself; that is what a permutation does. Numbers that fail validation stay.

A candidate that fails is tried shorter (an IBAN at its country's length, a phone
at an earlier space), then by the later patterns at the same place, then the
search goes on inside it.

A phone number is its country code and its national digits: spellings with other blanks, with or
without a trunk `(0)`, or (in North America) without the country code stay linked.

Null texts stay null, empty texts stay empty, and a text of any length is read whole. Rows are changed each
for itself: repeated rows give equal rows, an empty table an empty one, and no ties can arise. All columns but
`text` pass through unread.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import per_batch

ROUNDS = 10
KINDS = ("email", "card", "ip", "phone", "date", "ssn", "iban", "secret")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Alternatives start at a token's first character and are bounded, so a very long token costs one look.
PATTERNS = r"""
 (?P<email>(?u:(?<![\w\u0300-\u036f.%+-])[^\W_][\w\u0300-\u036f.%+-]{0,63}@(?:[^\W_]|-){1,63}(?:\.(?:[^\W_]|-){1,63}){1,5}))
|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
|(?P<key>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))
|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){2,4}(?![\w-])
  |(?<![\w+])\+\d{1,3}[ .-]\d(?:[ .-]?\d{2,4}){2,4}(?![\w-])
  |(?<![\w+.-])1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])
  |(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?![\w-])
  |(?<![\w+])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]*\d))
|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
|(?P<iso>(?<![\w-])\d{4}-\d{2}-\d{2}(?!(?!T\d\d)[\w-]))
|(?P<day>(?<![\w./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\w/]|\.\d))
|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))
|(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![A-Za-z0-9]))
"""
PATTERN = re.compile(PATTERNS, re.X | re.A)
#: Each kind by itself, in the order of PATTERN.
SINGLE = {re.search(r"<(\w+)>", p)[1]: re.compile(p, re.X | re.A) for p in re.split(r"\n\|", PATTERNS)}
#: IBAN lengths by country, as registered.
IBAN_LENGTHS = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE IL IQ TL GI OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
#: Country calling codes of one and two digits, as assigned; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                        "81 82 84 86 90 91 92 93 94 95 98".split())
WORTH_A_LOOK = re.compile(r"[0-9@]").search


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size: a balanced network over the next square, walked back in."""

    key: bytes
    undo: bool = False

    def _round(self, tweak: str, k: int, half: int, side: int) -> int:
        said = f"{tweak}|{side}|{k}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=16 + side.bit_length() // 8).digest()) % side

    def __call__(self, value: int, size: int, tweak: str, allowed: Callable[[int], bool] = lambda v: True) -> int:
        side = math.isqrt(max(size - 1, 0)) + 1
        while True:
            left, right = divmod(value, side)
            if self.undo:
                for k in reversed(range(ROUNDS)):
                    left, right = (right - self._round(tweak, k, left, side)) % side, left
            else:
                for k in range(ROUNDS):
                    left, right = right, (left + self._round(tweak, k, right, side)) % side
            value = left * side + right
            if value < size and allowed(value):
                return value


def _to_number(digits: list[int], radices: list[int]) -> tuple[int, int]:
    value, size = 0, 1
    for d, r in zip(digits, radices):
        value, size = value * r + d, size * r
    return value, size


def _from_number(value: int, radices: list[int]) -> list[int]:
    digits = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        digits.append(d)
    return digits[::-1]


def by_class(text: str, tweak: str, permute: Feistel, alphabets: tuple[str, ...] = (LOWER, UPPER, DIGITS),
             allowed: Callable[[str], bool] | None = None) -> str:
    """Letters stay letters of their case, digits digits; anything else keeps its place."""
    spots = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
    radices = [len(a) for _, a in spots]
    value, size = _to_number([a.index(text[i]) for i, a in spots], radices)

    def said(value: int) -> str:
        out = list(text)
        for (i, a), d in zip(spots, _from_number(value, radices)):
            out[i] = a[d]
        return "".join(out)

    return said(permute(value, size, tweak, (lambda v: allowed(said(v))) if allowed else (lambda v: True)))


@lru_cache(maxsize=4096)
def _kin(c: str) -> str:
    """The letters or digits that a non-ASCII one may become: those of its kind whose UTF-8 forms differ in the last byte."""
    first = ord(c) // 64 * 64
    return "".join(k for k in map(chr, range(first, first + 64)) if unicodedata.category(k) == unicodedata.category(c))


def luhn_sum(digits: str) -> int:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) << (place & 1)
        total += d - 9 if d > 9 else d
    return total


def _card(text: str, permute: Feistel) -> str | None:
    digits = re.sub("[ -]", "", text)
    if luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    new = by_class(digits[:-1], f"card{len(digits)}", permute)
    new += str(-luhn_sum(new + "0") % 10)
    rest = iter(new)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _email(text: str, permute: Feistel) -> str:
    local, domain = text.split("@")
    others = tuple(sorted({_kin(c) for c in local if not c.isascii() and c.isalnum()}))
    return by_class(local, f"email@{domain}", permute, (LOWER, UPPER, DIGITS, *others)) + "@" + domain


OCTET = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(text: str, permute: Feistel) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    radices = [OCTET[len(p)][1] for p in parts]
    value, size = _to_number([int(p) - OCTET[len(p)][0] for p in parts], radices)
    new = _from_number(permute(value, size, "ip" + "".join(str(len(p)) for p in parts)), radices)
    return ".".join(str(OCTET[len(p)][0] + d) for p, d in zip(parts, new))


def _phone(text: str, permute: Feistel) -> str | None:
    """Country code and form stay; the national number is permuted, however it is spelled.

    A number without a country code is written in North American form, so it has code 1.
    """
    spots = [i for i, c in enumerate(text) if c.isdigit()]
    if not 8 <= len(spots) <= 15:
        return None
    code = "1"
    if text[0] == "+":
        trunk = text.find("(0)") + 1  # a prefix for calls inside the country, no part of the number
        spots = [i for i in spots if not trunk or i != trunk]
        digits = "".join(text[i] for i in spots)
        code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        spots = spots[len(code):]
    elif len(spots) == 11:
        spots = spots[1:]
    radices = [10] * len(spots)
    value, size = _to_number([int(text[i]) for i in spots], radices)
    out = list(text)
    for i, d in zip(spots, _from_number(permute(value, size, f"phone{code}"), radices)):
        out[i] = str(d)
    return "".join(out)


def _date(text: str, permute: Feistel) -> str | None:
    """Equal days stay linked across formats of fixed width; the result reads in the format it is written in."""
    parts = re.split(r"([./-])", text)
    sep, widths = parts[1], [len(p) for p in parts[::2]]
    a, b, c = map(int, parts[::2])
    for order in ("ymd",) if widths[0] == 4 else ("dmy", "mdy"):
        try:
            day = datetime.date(*{"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order])
        except ValueError:
            continue
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None

        def said(value: int, order=order) -> str | None:
            new = datetime.date.fromordinal(FIRST_DAY + value)
            if order == "mdy" and new.day <= 12:  # would read as day, month
                return None
            if order == "ymd":
                return new.isoformat()
            pair = (new.day, new.month) if order == "dmy" else (new.month, new.day)
            padded = "0" in (parts[0][0], parts[2][0]) or widths[:2] == [2, 2]
            mixed = padded and widths[0] != widths[1]  # as 5/03/2021: both below ten
            if mixed and max(pair) > 9:
                return None
            first = [f"{v:0{w}d}" if mixed else f"{v:02d}" if padded else str(v) for v, w in zip(pair, widths)]
            return sep.join([*first, str(new.year)]) if [len(f) for f in first] == widths[:2] else None

        value = day.toordinal() - FIRST_DAY
        if said(value) != text:
            return None
        return said(permute(value, LAST_DAY - FIRST_DAY + 1, "date", lambda v: said(v) is not None))
    return None


def _ssn(text: str, permute: Feistel) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    radices = [898, 99, 9999]  # areas 1 to 899 without 666
    value, size = _to_number([area - 1 - (area > 666), group - 1, serial - 1], radices)
    area, group, serial = _from_number(permute(value, size, "ssn"), radices)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(country: str, body: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _valid_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _mod97(plain[:2], plain[4:], plain[2:4]) == 1 and 2 <= int(plain[2:4]) <= 98


def _iban(text: str, permute: Feistel) -> str | None:
    """The IBAN of the country's length if it ends with a word, else the whole text; None if neither is valid."""
    size = IBAN_LENGTHS.get(text[:2], 0)
    cut = next((i + 1 for i in range(len(text)) if i + 1 - text.count(" ", 0, i + 1) == size), len(text))
    short = text[:cut].replace(" ", "") if cut < len(text) and text[cut] == " " else ""
    if short and _valid_iban(short):
        plain, end = short, cut
    else:
        plain, end = text.replace(" ", ""), len(text)
        if not _valid_iban(plain):
            return None

    def whole(body: str) -> str:
        return plain[:2] + f"{98 - _mod97(plain[:2], body, '00'):02d}" + body

    # A value that was taken whole must not read as a shorter one.
    unmistaken = (lambda body: not _valid_iban(whole(body)[:size])) if short and end == len(text) else None
    new = iter(whole(by_class(plain[4:], "iban" + plain[:2], permute, allowed=unmistaken)))
    return "".join(c if c == " " else next(new) for c in text[:end])


def _secret(text: str, permute: Feistel) -> str | None:
    if text.isdigit() or text.isalpha():
        return None
    alphabet = "0123456789abcdef" if text.lower() == text else "0123456789ABCDEF"

    def both(value: int) -> bool:
        digits = _from_number(value, [16] * len(text))
        return any(d > 9 for d in digits) and any(d < 10 for d in digits)

    value, size = _to_number([int(c, 16) for c in text], [16] * len(text))
    return "".join(alphabet[d] for d in _from_number(permute(value, size, f"hex{len(text)}", both), [16] * len(text)))


def _key(text: str, permute: Feistel) -> str:
    alphabet = DIGITS + UPPER
    return text[:4] + by_class(text[4:], "akia", permute, (alphabet,))


MAKERS = {"email": _email, "iban": _iban, "key": _key, "phone": _phone, "ip": _ip, "iso": _date, "day": _date, "ssn": _ssn,
          "card": _card, "secret": _secret}
KIND_OF = {"iso": "date", "day": "date", "key": "secret"}


def _candidates(text: str, match: re.Match) -> Iterator[tuple[str, str]]:
    """Kind and text of what may be a value at a match's place: the match, shorter ones, later patterns."""
    first = next(g for g in MAKERS if match[g] is not None)
    kinds = list(SINGLE)
    for kind in kinds[kinds.index(first):]:
        found = SINGLE[kind].match(text, match.start())
        if found:
            yield kind, found[0]
            if kind == "phone":
                for end in [i for i in range(found.end() - 1, found.start(), -1) if text[i] == " "]:
                    shorter = SINGLE[kind].fullmatch(text, found.start(), end)
                    if shorter:
                        yield kind, shorter[0]


def pseudonymise(text: str, permute: Feistel) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not WORTH_A_LOOK(text):
        return text, counts
    out, done, at = [], 0, 0
    while match := PATTERN.search(text, at):
        at = match.start() + 1
        for group, said in _candidates(text, match):
            new = MAKERS[group](said, permute)
            if new is not None:
                kind = KIND_OF.get(group, group)
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[done:match.start()], new]
                done = at = match.start() + len(new)
                break
    return "".join([*out, text[done:]]), counts


def pseudonyms(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and n_<kind> (long) for every row. `undo` gives the values back."""
    permute = Feistel(key, undo)

    def run(columns: dict) -> dict:
        texts, found = [], []
        for text in columns["text"]:
            new, counts = (None, {}) if text is None else pseudonymise(text.decode("utf-8", "replace"), permute)
            texts.append(new)
            found.append(counts)
        return {"doc_id": columns["doc_id"], "text": texts, "n_values": [sum(c.values()) for c in found]} \
            | {f"n_{k}": [c.get(k, 0) for c in found] for k in KINDS}

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return per_batch(docs.select("doc_id", "text"), run,
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_values long, {kinds}")


def hide(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with pseudonyms in `text`; all other columns as they were."""
    permute = Feistel(key)

    @F.pandas_udf("string")
    def changed(texts):
        return texts.map(lambda t: None if t is None else pseudonymise(t, permute)[0])

    return docs.select(*[changed("text").alias("text") if c == "text" else c for c in docs.columns])
