"""Format-preserving pseudonyms for personal data and secrets.

A value is found by its form and validated (Luhn, mod 97, octet range, calendar, area rules). It is then
written as a number in the mixed radix of its own format, permuted by a keyed Feistel network
with cycle walking, and written back, so that lengths, separators, letter case and check digits
still hold. The permutation depends only on key, kind and value: equal values get equal
pseudonyms in every document, different values different ones, and ``reveal`` inverts it.

Cases: null texts stay null, texts without a hit are returned unchanged, and so are values that fail
their check; of overlapping forms the first of KINDS wins; repeated rows give repeated results; an empty
table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockweave.llm.common import map_slices

ROUNDS = 8
#: Setting of the session that holds the key. Without it a random one is drawn for the application, so that
#: nobody can reverse the pseudonyms of a run for which no key was kept.
KEY_SETTING = "blockweave.pii.key"
_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def feistel(n: int, size: int, key: bytes, kind: str, inverse: bool = False, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of range(size), or of its elements for which ``valid`` holds.

    A balanced network over the next even number of bits; values outside the set are permuted on
    until one is inside (cycle walking), which keeps the map one to one.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while True:
        left, right = n >> half, n & mask
        for r in order:
            if inverse:
                left, right = right, left
            digest = hashlib.blake2b(f"{kind}|{size}|{r}|{right}".encode(), key=key, digest_size=max(8, width)).digest()
            left ^= int.from_bytes(digest, "big") & mask
            if not inverse:
                left, right = right, left
        n = (left << half) | right
        if n < size and (valid is None or valid(n)):
            return n


def _radix(value: str) -> list[str]:
    return ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in value]


def _permute_chars(value: str, key: bytes, kind: str, inverse: bool, alphabets: list[str] | None = None, valid: Callable[[str], bool] | None = None) -> str:
    """Permute ASCII letters and digits within their classes, all else stays in place."""
    at = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    chars = [value[i] for i in at]
    sets = alphabets or _radix("".join(chars))
    size = n = 0
    size = 1
    for c, s in zip(chars, sets, strict=True):
        n, size = n * len(s) + s.index(c), size * len(s)

    def spell(k: int) -> str:
        out = []
        for s in reversed(sets):
            k, d = divmod(k, len(s))
            out.append(s[d])
        return "".join(reversed(out))

    shape = len(chars) if alphabets else re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", "".join(chars))))
    new = spell(feistel(n, size, key, f"{kind}|{shape}", inverse, (lambda k: valid(spell(k))) if valid else None))
    out = list(value)
    for i, c in zip(at, new, strict=True):
        out[i] = c
    return "".join(out)


def luhn_digit(body: str) -> str:
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def _card(value: str, key: bytes, inverse: bool) -> str | None:
    """The issuer's first digit stays, the account digits are permuted, the check digit follows."""
    d = _digits(value)
    if d[0] == "0" or len(set(d)) == 1:
        return None
    if luhn_digit(d[:-1]) != d[-1]:  # no account number
        return None
    body = d[0] + _permute_chars(d[1:-1], key, "card", inverse)
    return _refill(value, body + luhn_digit(body))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(value)
    return _refill(value, _permute_chars(d, key, "ssn", inverse, valid=_ssn_ok)) if _ssn_ok(d) else None


def _phone_ok(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def _phone(value: str, key: bytes, inverse: bool) -> str | None:
    """The country code stays; national numbers stay dialable where the old one was."""
    m = re.match(r"\+(?:1\b|\d{1,3})", value)
    head = m[0] if m else ""
    d = _digits(value[len(head) :])
    if not 7 <= len(d) <= 14:
        return None
    ok = _phone_ok if len(d) == 10 and _phone_ok(d) else None
    return head + _refill(value[len(head) :], _permute_chars(d, key, f"phone{'+' if ok else ''}", inverse, valid=ok))


def _ip(value: str, key: bytes, inverse: bool) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    n = feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", inverse)
    return ".".join(map(str, n.to_bytes(4, "big")))


_EPOCH, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1


def _date(value: str, key: bytes, inverse: bool) -> str | None:
    """Calendar dates of 1900 to 2099 in the order and with the separators that they have.

    Days come first, with slashes months. A number above 12 in the month's place turns the order; such a date stays one whose day is above 12.
    """
    a, sep, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)", value).groups()
    orders = ["ymd"] if len(a) == 4 else ["mdy", "dmy"] if sep == "/" else ["dmy", "mdy"]
    parts = [dict(zip(o, map(int, (a, b, c)), strict=True)) for o in orders]
    turned = len(orders) == 2 and parts[0]["m"] > 12
    at = parts[turned]
    try:
        day = (datetime.date(at["y"], at["m"], at["d"]) - _EPOCH).days
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    late = (lambda n: (_EPOCH + datetime.timedelta(n)).day > 12) if turned else None
    new = _EPOCH + datetime.timedelta(feistel(day, _DAYS, key, "late date" if turned else "date", inverse, late))
    spelled = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sep.join(spelled[k] for k in orders[turned])


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(value: str, key: bytes, inverse: bool) -> str | None:
    """Country and format stay, the account is permuted, the two check digits follow. In small letters it is that of the capitals, in small letters."""
    flat = value.replace(" ", "").upper()
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    account = _permute_chars(flat[4:], key, f"iban{flat[:2]}", inverse)
    check = f"{98 - _mod97(account + flat[:2] + '00'):02d}"
    it = iter(flat[:2] + check + account)
    new = "".join(c if c == " " else next(it) for c in value)
    return new.lower() if value[:2].islower() else new


def _email(value: str, key: bytes, inverse: bool) -> str | None:
    """The user and the domain below its last two labels' suffix are permuted, the suffix stays."""
    user, _, domain = value.rpartition("@")
    head, dot, tld = domain.rpartition(".")
    return _permute_chars(user, key, "email", inverse) + "@" + _permute_chars(head, key, "domain", inverse) + dot + tld


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _access_key(value: str, key: bytes, inverse: bool) -> str | None:
    return value[:4] + _permute_chars(value[4:], key, "access", inverse, [_ALNUM] * (len(value) - 4))


def _hex(value: str, key: bytes, inverse: bool) -> str | None:
    return _permute_chars(value, key, f"hex{len(value)}", inverse, ["0123456789abcdef"] * len(value)) if value == value.lower() else _permute_chars(value, key, "hexmixed", inverse)


def _secret(value: str, key: bytes, inverse: bool) -> str | None:
    name, sep, rest = re.match(r"(\w+)(\s*[=:]\s*['\"]?)(.+)", value, re.S).groups()
    return name + sep + _permute_chars(rest, key, "secret", inverse)


# Form and pseudonym by kind, in order of precedence. A form may not touch further word characters.
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "access_key": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _access_key),
    "secret": (r"\b(?i:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*['\"]?[A-Za-z0-9_\-/+]{6,}", _secret),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|\b[a-z]{2}[0-9]{2}[a-z0-9]{11,30}\b", _iban),
    "hex": (r"(?<![0-9a-zA-Z])(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?![0-9a-zA-Z])", _hex),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", _ip),
    "date": (r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-])", _date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", _phone),
    "card": (r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?![\w-])", _card),
}
_FORMS = re.compile("|".join(f"(?P<{kind}>{form})" for kind, (form, _) in KINDS.items()).replace(r"\1\d{2}", r"(?P=y)\d{2}").replace(r"(?:\d{4}([-/.])", r"(?:\d{4}(?P<y>[-/.])").replace(r"\d{2}([-/.])\d{2}\2", r"\d{2}(?P<z>[-/.])\d{2}(?P=z)").replace(r"([ -])\d{4}\3\d{4}\3", r"(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)").replace(r"([ -])\d{6}\4", r"(?P<t>[ -])\d{6}(?P=t)"))
_GATE = re.compile(r"[0-9@=:]")


def pseudonymise(text: str | None, key: bytes, inverse: bool = False) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms and the spans (kind, start, length) that were changed."""
    if not text or not _GATE.search(text):
        return text, []
    spans: list[dict] = []

    def swap(m: re.Match) -> str:
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind][1](m[0], key, inverse)
        if new is None:
            return m[0]
        spans.append({"kind": kind, "start": m.start(), "length": len(m[0])})
        return new

    return _FORMS.sub(swap, text), spans


def reveal(text: str, key: bytes) -> str:
    """Inverse of ``pseudonymise`` for whoever holds the key."""
    return pseudonymise(text, key, inverse=True)[0]


class _Apply:
    def __init__(self, key: str, keep: list[str]):
        self.key, self.keep = hashlib.blake2b(key.encode()).digest(), keep

    def start(self):
        def run(cols):
            got = [pseudonymise(t, self.key) for t in cols["text"]]
            return {n: cols[n] for n in self.keep} | {"text": [g[0] for g in got], "n_values": [len(g[1]) for g in got], "spans": [g[1] for g in got]}

        return run


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and spans of every row. Narrow: one pass, no shuffle."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64()), ("spans", spans)])
    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), _Apply(key or key_of(docs.sparkSession), ["doc_id"]), "doc_id long, text string, n_values long, spans array<struct<kind:string,start:long,length:long>>", arrow)


def pseudonymise_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The columns of documents with the text replaced and n_chars recounted."""
    from pyspark.sql import functions as F

    arrow = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("text", pa.string()), ("n_values", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))])
    rows = docs.select(docs["doc_id"].cast("long"), "lang", "source", "text")
    out = map_slices(rows, _Apply(key or key_of(docs.sparkSession), ["doc_id", "lang", "source"]), "doc_id long, lang string, source string, text string, n_values long, spans array<struct<kind:string,start:long,length:long>>", arrow)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
