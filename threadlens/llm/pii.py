"""Personal data: regular expressions propose spans, validators confirm them, context words adjust a score.

Offsets are code points, ends exclusive. Every pattern runs in time linear in the text: a run of
word characters or digits is looked at once, whichever its length.

Base kinds stay as they match. The kinds that this method adds are held to a least score: account
numbers (IBAN, mod-97), national numbers whose check characters hold (French NIR, mod-97; Spanish DNI and
NIE, mod-23), social security numbers within the issued ranges, which need a word nearby that speaks
for them, and secrets: values given to a key word, and tokens of well-known forms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.textarrays import pieces

#: Order of kinds among spans with one start.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "ssn", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", re.ASCII)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++", re.ASCII)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))", re.ASCII)
_NIR = re.compile(r"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])", re.ASCII)
_DNI = re.compile(r"(?<![A-Za-z0-9])[0-9XYZ][0-9]{7}-?[A-Z](?![A-Za-z0-9])", re.ASCII)
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])", re.ASCII)
#: A value given to a key word, as in ``api_key = "..."``.
_GIVEN = re.compile(r"[:=]")
_KEY = re.compile(r"""(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|secret|token|password|passwd|pwd)["']?[ \t]{0,3}\Z""", re.ASCII | re.IGNORECASE)
_VALUE = re.compile(r"""[ \t]{0,3}["']?([A-Za-z0-9_+/=.~-]{16,})""", re.ASCII)
#: Characters before a sign that a key word, with what may stand after it, takes at most, and one more.
KEY_CHARS = 19
#: Tokens of well-known forms: cloud access keys, code host and chat tokens, signed web tokens, private keys.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    re.ASCII,
)
#: What every such token holds, one or another.
_KNOWN_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "PRIVATE KEY")
#: Bits a character, from which an assigned value counts as random.
LEAST_ENTROPY = 3.0
_ALNUM = re.compile(r"[A-Za-z0-9]", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words near a span that speak for or against it, and what they add to its score.
CONTEXT = {
    "email": ({"mail", "email", "e-mail", "contact", "write"}, {"example", "sample"}),
    "ip": ({"ip", "address", "host", "server"}, {"version", "section", "chapter"}),
    "card": ({"card", "visa", "mastercard", "credit", "payment"}, {"isbn", "serial", "order", "id"}),
    "phone": ({"phone", "tel", "call", "mobile", "fax"}, {"isbn", "serial", "score"}),
    "iban": ({"iban", "account", "bank", "transfer"}, {"token", "key", "hash"}),
    "national_id": ({"nir", "dni", "nie", "nif", "insee", "secu", "identity", "passport", "documento"}, {"order", "serial", "product", "part"}),
    "ssn": ({"ssn", "social", "security", "taxpayer"}, {"order", "serial", "phone", "score"}),
    "secret": ({"api", "auth", "bearer", "credential", "credentials"}, {"example", "sample", "placeholder", "checksum"}),
}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "national_id": 0.6, "ssn": 0.4, "secret": 0.7}
CONTEXT_CHARS, CONTEXT_STEP = 40, 0.2
_WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        right = _DOMAIN.match(text, at + 1)
        if right:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, right.end()
                done = right.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        # what follows a number may look like more of it: the longest that ends a run and that mod-97 confirms
        for end in range(m.end(1), m.start(), -1) if m.start() >= done else ():
            found = text[m.start() : end]
            size = len(found.replace(" ", ""))
            if size < 15:
                break
            if size <= 34 and found[-1] != " " and not _ALNUM.match(text, end) and mod97(found):
                yield m.start(), end
                done = end
                break


def nir(digits: str) -> bool:
    """The last two digits are 97 less the rest mod 97; departments 2A and 2B count as 19 and 18."""
    body = digits[:-2].replace("2A", "19").replace("2B", "18")
    return body.isdigit() and 97 - int(body) % 97 == int(digits[-2:])


def dni(number: str) -> bool:
    """The letter is that of the number mod 23; a leading X, Y or Z counts as 0, 1 or 2."""
    body = {"X": "0", "Y": "1", "Z": "2"}.get(number[0], number[0]) + number[1:8]
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == number[-1]  # fixed values


def _national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in _NIR.finditer(text):
        if nir(m[0].replace(" ", "")):
            yield m.span()
    for m in _DNI.finditer(text):
        if dni(m[0]):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0][:3], m[0][4:6], m[0][7:]
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def random_looking(value: str) -> bool:
    """Letters and digits, with ``LEAST_ENTROPY`` bits a character or more."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= LEAST_ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for m in _KNOWN.finditer(text)] if any(p in text for p in _KNOWN_PARTS) else []
    end = 0
    for sign in _GIVEN.finditer(text):
        at = sign.start()
        value = _VALUE.match(text, at + 1) if at >= end and _KEY.search(text[max(end, at - KEY_CHARS) : at]) else None
        if value:
            end = value.end()  # a value is looked at once
            if random_looking(value[1]):
                found.append(value.span(1))
    done = 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= done:
            yield start, end
            done = end


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "national_id": _national_ids, "ssn": _ssns, "secret": _secrets}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's start score, a step up for a word nearby that speaks for it and a step down for one against."""
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    words = set(_WORD.findall(near))
    good, bad = CONTEXT[kind]
    value = START_SCORE[kind] + CONTEXT_STEP * bool(words & good) - CONTEXT_STEP * bool(words & bad)
    return round(min(1.0, max(0.0, value)), 3)


def spans(text: str, least: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind. A base kind that its validator confirms always stays;
    a kind that the method adds stays if its score after context is ``least`` or more."""
    found = []
    for order, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= least:
                found.append((start, order, end, s))
    return [(KINDS[order], start, end, s) for start, order, end, s in sorted(found)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """One row per input row: id_col and ``spans array<struct<kind,start,end,score>>`` by start, then kind.

    Null counts as the empty text and gives an empty array, as does an empty text; a very long text is
    searched whole, in time linear in it; spans that start together stand in the order of ``KINDS``;
    repeated rows are each answered; an empty table gives an empty result; other columns are ignored. Row
    by row: no shuffle and nothing gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in pieces(whole, 1)):
            out = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t or "", least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(SPAN))], [id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
