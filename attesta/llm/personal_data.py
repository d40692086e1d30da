"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Spans are counted in code points, end exclusive.  Four kinds are always kept
once their check holds (email, ip, card, phone); the other kinds are kept when
their score, the kind's own plus what the words around it add or take, reaches
``keep_from``.  Every pattern is searched in time linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from attesta.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
# Own score of each kind in hundredths, words that raise it and words that lower it.
KINDS = {
    "email": (90, ("mail", "email", "contact", "write"), ()),
    "ip": (60, ("ip", "host", "server", "address", "login"), ("version", "release", "section", "chapter")),
    "card": (80, ("card", "visa", "credit", "payment", "mastercard"), ("isbn", "order", "serial", "tracking")),
    "phone": (60, ("call", "phone", "tel", "mobile", "fax", "contact"), ("isbn", "order", "version")),
    "iban": (90, ("iban", "bank", "account", "transfer"), ("serial", "part")),
    "social": (30, ("ssn", "social", "security", "taxpayer"), ("order", "part", "model")),
    "local_phone": (30, ("call", "phone", "tel", "mobile", "fax", "contact"), ("isbn", "order", "version")),
    "access_key": (90, ("key", "access", "secret"), ("example",)),
    "password": (70, ("login", "user", "account"), ("field", "prompt")),
}
PATTERNS = {  # the kinds that the method adds; a match with a letter or digit right before or after it is dropped
    "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "password": r"(password|passwd|api_key|secret)[=:][^\x00-\x20]+",
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ADDED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_DIGITS = re.compile(r"[^0-9]+")
_LETTERS = re.compile(r"[a-z]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class PersonalDataSettings:
    """Span scores are in hundredths; ``around`` is how many code points on either side are read for words."""

    around: int = 40
    raised: int = 30
    lowered: int = 30
    keep_from: int = 50


def luhn_holds(digits: str) -> bool:
    """The card checksum: every second digit from the right doubled, digit sum a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97_holds(account: str) -> bool:
    """The bank account checksum: first four characters last, letters as 10 to 35, remainder 1."""
    rest = 0
    for c in account[4:] + account[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _emails(text: str):
    """Leftmost matches, found from each ``@`` backwards over the local part, so no run is read twice."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if start < at and (host := _HOST.match(text, at)):
            yield start, host.end()
            free = host.end()
        at = text.find("@", free)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if len(digits) <= 19 and luhn_holds(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def _score(kind: str, text: str, start: int, end: int, s: PersonalDataSettings) -> int:
    own, up, down = KINDS[kind]
    words = {w for part in (text[max(0, start - s.around):start], text[end:end + s.around])
             for w in _LETTERS.findall(part.translate(_LOWER))}
    return own + s.raised * (not words.isdisjoint(up)) - s.lowered * (not words.isdisjoint(down))


def _alnum(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()


def personal_spans(text: str, s: PersonalDataSettings) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of one text, by kind as listed, then start."""
    base = [(kind, *span) for kind, spans in (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones))
            for span in spans(text)]
    out = [(*span, _score(*span[:1], text, *span[1:], s)) for span in base]
    taken = sorted((start, end) for _, start, end in base)
    for kind, pattern in _ADDED.items():
        for m in pattern.finditer(text):
            start, end = m.span()
            if _alnum(text, start - 1) or _alnum(text, end) or _overlaps(taken, start, end):
                continue
            if kind == "iban" and not mod97_holds(m.group().replace(" ", "")):
                continue
            score = _score(kind, text, start, end, s)
            if score >= s.keep_from:
                out.append((kind, start, end, score))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in taken)


def masked_text(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; spans that overlap share one mark."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind: string, start: long, end: long, score: int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))


def find_personal_data(docs: DataFrame, settings: PersonalDataSettings = PersonalDataSettings()) -> DataFrame:
    """``docs`` with ``personal``, the spans of personal data in each text, by kind as listed, then start.

    Null and empty texts have an empty list; repeated rows each get their own.
    An input column named ``personal`` is replaced.  Base kinds stay whatever
    their score; added kinds give way to base spans that they overlap.
    """
    small_batches(docs)

    @arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in personal_spans(t.as_py() or "", settings)]
                 for t in texts]
        return pa.array(found, _ARROW)

    return docs.withColumn("personal", spans(F.col("text").cast("string")))


def mask_personal_data(docs: DataFrame, settings: PersonalDataSettings = PersonalDataSettings()) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; null stays null."""
    small_batches(docs)

    @arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if (x := t.as_py()) is None else masked_text(x, personal_spans(x, settings)) for t in texts],
                        pa.string())

    return docs.withColumn("text", masked(F.col("text").cast("string")))


def joined_spans(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
