"""Format-preserving pseudonyms for personal data (operator 8).

Numbers and dates are found by pattern, validated (check digits, calendar, numbering rules;
what is not valid is read again with fewer groups, then from its next group on) and replaced by a keyed Feistel permutation of the values of their own format. Equal values
get equal pseudonyms in every document, different values different ones, and a pseudonym
passes the same validation as its original. Mail names are permuted letter by letter class,
long ones in pieces.

Defined cases: a null text stays null with no finding, an empty one stays empty; very long
texts are worked through whole; repeated rows give equal rows; an empty table gives an empty
result; other columns are carried by ``pseudonymise`` and ignored by the query.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import column, table

ROUNDS = 8
#: Characters that are permuted at once.
PIECE = 64
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute(x: int, size: int, key: bytes, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of 0..size-1, or of its ``valid`` members.

    A Feistel network permutes the next even number of bits; walking on along its cycle until
    the value is in range and valid keeps it one to one.
    """
    half = max(1, (size.bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    if width > hashlib.blake2b.MAX_DIGEST_SIZE:
        raise ValueError("too large for one permutation: permute it in pieces")
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            mixed = hashlib.blake2b(bytes([i]) + right.to_bytes(width, "little"), key=key, digest_size=width).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "little") & mask)
        x = left << half | right
        if x < size and (valid is None or valid(x)):
            return x


def _tweaked(key: bytes, kind: str, shape: str) -> bytes:
    return hashlib.blake2b(f"{kind}\0{shape}".encode(), key=key, digest_size=32).digest()


def permute_classes(text: str, kind: str, key: bytes, valid: Callable[[str], bool] | None = None) -> str:
    """Permutes digits among digits and letters among letters of their case; the rest stays.

    A text of over PIECE characters is permuted in pieces, each under its place and the whole
    text's shape, so that the work grows with the length alone; ``valid`` is for one piece.
    """
    kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c in text]
    shape = "".join({DIGITS: "0", LOWER: "a", UPPER: "A"}.get(a, "") for a in kinds)
    if valid and len(text) > PIECE:
        raise ValueError("only one piece can be held to a rule")
    tweak = _tweaked(key, kind, shape)
    pieces = range(0, len(text), PIECE)
    return "".join(_permuted(text[at : at + PIECE], kinds[at : at + PIECE], _tweaked(tweak, kind, str(at)) if at else tweak, valid) for at in pieces)


def _permuted(text: str, kinds: list[str], key: bytes, valid: Callable[[str], bool] | None) -> str:
    places = [(i, alphabet) for i, alphabet in enumerate(kinds) if alphabet]
    size, value = 1, 0
    for i, alphabet in places:
        size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(text[i])
    if size == 1:
        return text

    def spelled(x: int) -> str:
        out = list(text)
        for i, alphabet in reversed(places):
            x, d = divmod(x, len(alphabet))
            out[i] = alphabet[d]
        return "".join(out)

    return spelled(permute(value, size, key, valid and (lambda x: valid(spelled(x)))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit; the issuer's first digit stays."""
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or not luhn(digits):
        return None
    body = permute_classes(digits[1:], f"card{digits[0]}", key, lambda x: luhn(digits[0] + x))
    fresh = iter(digits[0] + body)
    return re.sub(r"\d", lambda _: next(fresh), text)


def _iban(text: str, key: bytes) -> str | None:
    """The country and the length stay, the check digits are made anew."""
    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in account + plain[:4])) % 97 != 1:
        return None
    account = permute_classes(account, f"iban{country}", key)
    fresh = iter(f"{country}{iban_check(country, account):02d}{account}")
    return re.sub(r"[A-Z0-9]", lambda _: next(fresh), text)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_valid(digits):
        return None
    d = permute_classes(digits, "ssn", key, _ssn_valid)
    return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def _national_valid(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789"


def _phone(text: str, key: bytes) -> str | None:
    """Ten digits of the North American plan after +1, 1 or nothing, or any other + number of 8 to 15 digits."""
    digits = re.sub(r"\D", "", text)
    international = text.startswith("+") and not digits.startswith("1")
    if international:
        if not 8 <= len(digits) <= 15:
            return None
        prefix, rest, valid = digits[:2], digits[2:], None
    else:
        prefix, rest, valid = digits[:-10], digits[-10:], _national_valid
        if len(rest) != 10 or prefix not in ("", "1") or not valid(rest):
            return None
    fresh = iter(prefix + permute_classes(rest, f"phone{prefix if international else ''}", key, valid))
    return re.sub(r"\d", lambda _: next(fresh), text)


def _address(text: str, key: bytes) -> str | None:
    """A dotted address; private, loopback and unset ones name nobody and stay."""
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    named = lambda x: not ((a := x >> 24) in (0, 10, 127) or a >= 224 or x >> 20 == 0xAC1 or x >> 16 == 0xC0A8)
    value = int.from_bytes(bytes(parts), "big")
    if not named(value):
        return None
    return ".".join(map(str, permute(value, 1 << 32, _tweaked(key, "address", ""), named).to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    """Year first, or day or month first with / . or -, from 1900 to 2099, permuted within those days."""
    parts = re.split(r"\D", text)
    sign = text[4] if len(parts[0]) == 4 else text[len(parts[0])]
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if sign != "/" or int(parts[0]) > 12 else ("mdy",)
    for order in orders:
        named = dict(zip(order, map(int, parts), strict=True))
        try:
            day = datetime.date(named["y"], named["m"], named["d"]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            break
    else:
        return None
    # a day above 12 decides between the two slash forms and shows month first with - or ., so such dates stay among themselves
    valid = (lambda x: (datetime.date.fromordinal(x + FIRST_DAY).day > 12) == (named["d"] > 12)) if order == "mdy" or (sign == "/" and order == "dmy") else None
    new = datetime.date.fromordinal(permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, _tweaked(key, "date", "split" if valid else ""), valid) + FIRST_DAY)
    written = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sign.join(written[x] for x in order)


def _mail(text: str, key: bytes) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{permute_classes(name, 'mail', key)}@{domain}"


FORMS = {
    "address": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
    "phone": r"\+?(?:\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d(?:[ .-]?\d){7,14}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
}
NUMBERS = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<{k}>{x})" for k, x in FORMS.items()) + r")(?![A-Za-z0-9_])", re.ASCII)
ALONE = {k: re.compile(x, re.ASCII) for k, x in FORMS.items()}
#: Where a group of letters and digits ends, and more characters than any of the forms has.
GROUP_END = re.compile(r"[A-Za-z0-9](?![A-Za-z0-9_])", re.ASCII)
LONGEST = 64
# A mail address: the whole run of name characters before the @, and the labels of a domain behind it.
NAME = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
TOP = re.compile(r"[A-Za-z]{2,}")
MAKERS = {"address": _address, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}
HAS_NUMBER = re.compile(r"\d\d", re.ASCII)


def reading(text: str, start: int, stop: int, key: bytes) -> tuple[int, str, str] | None:
    """(end, kind, pseudonym) of the first valid reading from ``start``: by kind, the one of most groups first."""
    ends = [e for m in GROUP_END.finditer(text, start, min(len(text), start + LONGEST)) if (e := m.end()) <= stop and (e == len(text) or not (text[e].isascii() and (text[e].isalnum() or text[e] == "_")))]
    for kind, form in ALONE.items():
        for end in reversed(ends):
            if form.fullmatch(text, start, end) and not (kind == "address" and re.match(r"\.?[0-9]", text[end : end + 2])):
                if (new := MAKERS[kind](text[start:end], key)) is not None:
                    return end, kind, new
    return None


def mails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each mail address, in one pass: a name without empty parts and a domain that ends in a label of letters."""
    last = 0
    for m in NAME.finditer(text):
        at = m.end() - 1
        start = max(m.start(), last)
        start = max(start, text.rfind("..", start, at) + 2) if ".." in text[start:at] else start
        start += text[start] == "."
        found = DOMAIN.match(text, at + 1)
        if start >= at or text[at - 1] == "." or not found:
            continue
        end = found.end()
        labels = found[0].split(".")
        for label in reversed(labels[1:]):
            end -= len(label)
            if top := TOP.match(label):
                last = end + top.end()
                yield start, last
                break
            end -= 1


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each validated value, in order, without overlaps."""
    out = [(a, b, "mail", _mail(text[a:b], key)) for a, b in mails(text)] if "@" in text else []
    taken, free = list(out), 0
    if HAS_NUMBER.search(text):
        at = 0
        while m := NUMBERS.search(text, at):
            start = m.start()
            while free < len(taken) and taken[free][1] <= start:
                free += 1
            stop = taken[free][0] if free < len(taken) else len(text)
            if stop <= start:
                at = taken[free][1]
            elif found := reading(text, start, stop, key):
                at = found[0]
                out.append((start, *found))
            else:  # an address that stays is read whole, all else from its next group on
                at = m.end() if m["address"] else start + 1
    return sorted(out)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


@lru_cache(maxsize=4)
def _key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_found, kinds, spans): spans are kind:start:end of the input, in code points."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds, spans = [], [], [], []
            for x in batch["text"]:
                found = find(x.as_py() or "", _key(secret))
                texts.append(replaced(x.as_py(), found) if found else x.as_py())
                counts.append(len(found))
                kinds.append(",".join(sorted({f[2] for f in found})))
                spans.append(",".join(f"{f[2]}:{f[0]}:{f[1]}" for f in found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()), "n_found": pa.array(counts, pa.int64()), "kinds": pa.array(kinds, pa.string()), "spans": pa.array(spans, pa.string())})

    picked = docs.select(column(docs, key, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return picked.mapInArrow(work, "doc_id long, text string, n_found long, kinds string, spans string")


#: Where a deployment keeps its key, and the key of a session that has none, which protects nothing.
SECRET_SETTING, OPEN_SECRET = "spark.weftgraph.pii.secret", "a key that the deployment supplies"


def op8_pii_pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(SECRET_SETTING, OPEN_SECRET))
