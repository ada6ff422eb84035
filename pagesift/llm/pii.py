"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Four base kinds (email, ip, card, phone) are found leftmost and
non-overlapping within their kind, in code points; a proposal that fails its
check (address parts up to 255, Luhn, digit counts) is dropped without a
retry. Further kinds add spans: IBANs confirmed by mod 97, and social security
numbers, which have no check digit and so need a context word nearby. Every
span has a score: its kind's own, plus ``CONTEXT_GAIN`` if one of the kind's
words stands within ``CONTEXT_CHARS`` before or ``CONTEXT_AFTER`` after it.
Base spans always stay; added ones need ``MIN_SCORE``.

All scans are linear in the text: local parts of addresses are found from
the ``@`` outwards, and digit runs are only entered at their first digit.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import slices, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT_CHARS, CONTEXT_AFTER, CONTEXT_GAIN, MIN_SCORE = 40, 20, 0.3, 0.5

OWN_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_WORDS = {k: re.compile(r"(?<!\w)(?:%s)" % "|".join(map(re.escape, v)), re.I) for k, v in CONTEXT.items()}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ANY = re.compile(r"[0-9@]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        # an address needs a local part that ends at the sign; what an earlier match took is gone
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        groups = m[0]
        while True:  # a spaced number may be followed by a word that looks like one more group
            compact = groups.replace(" ", "")
            if len(compact) < 15:
                break
            if mod97(compact):
                yield m.start(), m.start() + len(groups)
                break
            if " " not in groups:
                break
            groups = groups.rpartition(" ")[0]


def find(text: str) -> list[Span]:
    """All spans of a text, by start and then kind in the order of ``KINDS``."""
    if not _ANY.search(text):
        return []
    found: list[tuple[str, int, int]] = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found += [("iban", s, e) for s, e in _ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, start, end in found:
        score = OWN_SCORE[kind]
        words = _WORDS[kind]
        if words.search(text, max(0, start - CONTEXT_CHARS), start) or words.search(text, end, end + CONTEXT_AFTER):
            score += CONTEXT_GAIN
        if kind in BASE or score >= MIN_SCORE:
            out.append(Span(kind, start, end, round(score, 3)))
    out.sort(key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every stretch of overlapping spans replaced by its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i].start < end:
            end = max(end, spans[i].end)
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` for every row (``spans``: array of kind, start, end, score); a null text has none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in slices(batches):
            spans = [[s._asdict() for s in find(t)] for t in text_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["id", "spans"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, "
                                "spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in the text; the column of the
    text's length, if there is one, follows. Null texts stay null."""
    def run(batches):
        for b in slices(batches):
            texts = [t if t is None else masked(t, find(t)) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            for name, values in ((text_col, pa.array(texts, pa.string())),
                                 (chars_col, pa.array([None if t is None else len(t) for t in texts], pa.int64()))):
                at = b.schema.get_field_index(name)
                if at >= 0:
                    own = b.schema.field(at)
                    new = pc.if_else(pc.is_valid(values), values.cast(own.type), b.column(at)) if name == chars_col else values.cast(own.type)
                    b = b.set_column(at, own, new)
            yield b
    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of ``detect``'s rows, in DataFrame functions."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", text), ",").alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))
