"""Personal data behind disguises, found at its place in the source.

Transducers rewrite a text: look-alike letters and digits to plain ones (one
character for one), bracketed or spelled 'at' and 'dot' to their signs,
spelled digits to digits. Each rewritten stretch remembers its source, so
what is found in the normal form is reported by source characters.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb

_LIKE = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "aeopcyxijsdhlqwABEKMHOPCTXIJSABEZHIKMNOPTYXoavp", strict=True))
_LIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
for _zero in (0x660, 0x6F0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _LIKE |= {chr(_zero + i): str(i) for i in range(10)}
_LIKE |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹒": ".", " ": " ", " ": " ", " ": " "}
HOMOGLYPHS = str.maketrans(_LIKE)
_HAS_LIKE, _LATIN = re.compile("[" + re.escape("".join(_LIKE)) + "]"), [c for c in _LIKE if ord(c) < 256]

_DIGITS = {}
for _words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"):
    _DIGITS |= {w: str(i) for i, w in enumerate(_words.split())}
_DIGITS |= {"oh": "0", "niner": "9", "zwo": "2"}
_ONE = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: Three or more digits in words, with spaces, a comma or a hyphen between them.
SPELLED = re.compile(rf"\b(?:(?:{_ONE})(?=[ \t,\-])[ \t]*+(?:[,\-][ \t]*+)?){{2,}}(?:{_ONE})\b", re.I)
_WORD = re.compile(_ONE, re.I)
_LAST, _FIRST = re.compile(rf"(?:{_ONE})\Z"), re.compile(_ONE)

_SIGNS = r"[(\[{<][ \t]*+(?:(?P<at>at|arroba|arobase|@)|(?P<dot>dot|punto|point|punkt|\.))[ \t]*+[)\]}>][ \t]*+"
BRACKETED = re.compile(_SIGNS, re.I)
#: name at host dot com: 'at' and 'dot' count as signs only together.
BARE = re.compile(r"(?<=[\w.+\-])(?P<at>[ \t]++at[ \t]++|[ \t]*+@[ \t]*+)(?=[\w\-]++(?:\.[\w\-]++)*+[ \t]++dot[ \t]++\w)|(?P<dot>(?<=\w)[ \t]++dot[ \t]++(?=\w))", re.I)
_DOT_WORD = re.compile(r"[ \t]dot[ \t]", re.I)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_AFTER = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|(?:\(\d{3}\)[ ]?|\d{3}[ .\-])\d{3}[ .\-]?\d{4})(?!\w)")
TEN = re.compile(r"(?<![\w.+\-])\d{10,11}(?![\w\-])")
CARD = re.compile(r"(?<![\w])\d(?:[ \-]?\d){12,18}(?!\w)")
SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_\-]?key)\b[ \t]*[=:][ \t]*[\"']?([^\s\"']{6,})|\b(AKIA[0-9A-Z]{16})\b")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    total += sum(2 * int(d) - 9 * (int(d) > 4) for d in digits[-2::-2])
    return total % 10 == 0


#: (first digits from, to, lengths) of the cards that issuers give out.
_ISSUED = (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (13, 14, 15, 16, 17, 18, 19)), ("56", "58", (13, 14, 15, 16, 17, 18, 19)))


def card(digits: str) -> bool:
    return any(a <= digits[: len(a)] <= b and len(digits) in sizes for a, b, sizes in _ISSUED) and luhn(digits)


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _looks_alike(text: str) -> bool:
    """Whether text has a character of HOMOGLYPHS."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_HAS_LIKE.search(text))
    return any(c in text for c in _LATIN)


def _spells(text: str) -> bool:
    """Whether a digit in words stands between two others; what is joined to the outer ones isn't looked at."""
    words = text.lower().replace(",", " ").replace("-", " ").split()
    digit = bytes(map(_DIGITS.__contains__, words))
    at = digit.find(1, 1)
    while 0 < at < len(words) - 1:
        if _LAST.search(words[at - 1]) and _FIRST.match(words[at + 1]):
            return True
        at = digit.find(1, at + 1)
    return False


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    """Signs in brackets, with the spaces around them."""
    found, done = [], 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in " \t":
            start -= 1
        done = m.end()
        found.append((start, done, "@" if m.group("at") else "."))
    return found


class Normal:
    """A text in normal form, and the source of each stretch of it."""

    def __init__(self, source: str):
        plain = source.translate(HOMOGLYPHS) if _looks_alike(source) else source
        swaps = _bracketed(plain) if any(c in plain for c in "([{<") else []
        if _DOT_WORD.search(plain):
            swaps += [(m.start(), m.end(), "@" if m.group("at") else ".") for m in BARE.finditer(plain)]
        if _spells(plain):
            swaps += [(m.start(), m.end(), "".join(_DIGITS[w.lower()] for w in _WORD.findall(m.group()))) for m in SPELLED.finditer(plain)]
        self.text, self.at, self.from_, self.swapped, self.ends = plain, [0], [0], [False], {}
        if not swaps:
            return
        out, done, size = [], 0, 0
        self.at, self.from_, self.swapped = [], [], []

        def add(piece: str, start: int, swapped: bool) -> None:
            nonlocal size
            if piece:
                self.at.append(size)
                self.from_.append(start)
                self.swapped.append(swapped)
                out.append(piece)
                size += len(piece)

        for start, end, piece in sorted(swaps):
            if start < done:
                continue
            add(plain[done:start], done, False)
            add(piece, start, True)
            self.ends[start] = end
            done = end
        add(plain[done:], done, False)
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the normal form; a stretch that was rewritten belongs to it as a whole."""
        k = bisect.bisect_right(self.at, start) - 1
        a = self.from_[k] if self.swapped[k] else self.from_[k] + start - self.at[k]
        k = bisect.bisect_right(self.at, end - 1) - 1
        b = self.ends[self.from_[k]] if self.swapped[k] else self.from_[k] + end - self.at[k]
        return a, b


def identifiers(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in the normal form, in order; where spans overlap, the kind named first in the code has it."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def take(kind: str, start: int, end: int, value: str) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, value))

    at = text.find("@")
    while at >= 0:
        if after := EMAIL_AFTER.match(text, at):
            start = at
            while start and text[start - 1] in _LOCAL:
                start -= 1
            while start < at and text[start] in ".-":
                start += 1
            if start < at:
                take("email", start, after.end(), text[start : after.end()].lower())
        at = text.find("@", at + 1)
    if "=" in text or ":" in text or "AKIA" in text:
        for m in SECRET.finditer(text):
            take("secret", m.start(), m.end(), m.group(1) or m.group(2))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m.group().split(".")):
                take("ip", m.start(), m.end(), m.group())
        for m in IBAN.finditer(text):
            if iban(m.group()):
                take("iban", m.start(), m.end(), m.group().replace(" ", ""))
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if card(digits):
                take("card", m.start(), m.end(), digits)
        for m in SSN.finditer(text):
            take("ssn", m.start(), m.end(), m.group())
        for pattern in (PHONE, TEN):
            for m in pattern.finditer(text):
                digits = re.sub(r"\D", "", m.group())
                if 7 <= len(digits) <= 15:
                    take("phone", m.start(), m.end(), ("+" if m.group().startswith("+") else "") + digits)
    return [(k, a, b, v) for a, b, k, v in sorted(found)]


def spans(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, source, value) with offsets in characters of the source."""
    normal = Normal(text)
    out = []
    for kind, a, b, value in identifiers(normal.text):
        start, end = normal.source(a, b)
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        out.append((kind, start, end, text[start:end], value))
    return out


def _found(it):
    for batch in it:
        for part in tb.chunks(batch, "text"):
            rows = [(i, *s) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if t for s in spans(t)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "kind", "start", "end", "source", "value"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, source, value), a row for each identifier found.

    kind is email, secret, ip, iban, card, ssn or phone. start and end are
    offsets in characters of the text, end exclusive, and source is what stands
    between them; value is the identifier in normal form. Cards need the first
    digits and the length of an issuer and a valid check digit; addresses need
    octets under 256, IBANs their remainder. Texts are searched whole, in time
    that follows their length. Null and empty texts give no rows, repeated rows
    give theirs each, a null doc_id stays null, an empty table gives no rows;
    other columns are ignored. One scan, no shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, "doc_id long, kind string, start long, end long, source string, value string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
