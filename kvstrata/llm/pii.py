"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme marks and
identifier cues. From each anchor a local parser walks to the boundaries of an address or number
and validates it. Every parser is linear in the text it walks over.

Base kinds (their exact grammar is given by the patterns in GRAMMAR): email, ip, card, phone. Kinds
the anchors add: url (an address with a scheme that carries user data), secret (the value after a
credential cue, and access-key ids), account (an IBAN after its cue).

Defined cases: a null text is empty and has no spans; texts may have any length; equal rows give
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")

#: Words that announce a credential; each is looked for as written, capitalised and in capitals.
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api_token", "auth_token", "access_token", "secret_key", "access_key")
GRAMMAR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_SPACED = re.compile(r"[0-9\x20-]+")
_CARD = re.compile(GRAMMAR["card"])
_PHONE = re.compile(GRAMMAR["phone"])
_VALUE = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/.=-]{8,})")
_KEY_ID = re.compile(r"[0-9A-Z]{16}")
_IBAN = re.compile(r"[ \t]*[:=]?[ \t]*([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})")
_USER_HOST = re.compile(r"[^\x00-\x20/@\"'<>]+@[A-Za-z0-9.-]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_WORD = _LETTER | frozenset("0123456789_")


def cue_forms() -> list[str]:
    return [form for cue in SECRET_CUES for form in (cue, cue.capitalize(), cue.upper())]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor in "@+0123456789":
        out.add_word(anchor, (1, anchor if anchor in "@+" else "digit"))
    out.add_word("://", (3, "scheme"))
    out.add_word("AKIA", (4, "key"))
    out.add_word("IBAN", (4, "iban"))
    for form in cue_forms():
        out.add_word(form, (len(form), "cue"))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """A decimal number of any length that is 255 at most."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    mail_end = dotted_end = spaced_end = url_end = secret_end = key_end = iban_end = 0
    for last, (size, kind) in anchors.iter(text):
        end = last + 1
        at = end - size
        if kind == "digit":
            if at >= dotted_end:
                dotted_end = _DOTTED.match(text, at).end()
                _addresses(text[at:dotted_end], at, found)
            if at >= spaced_end:
                spaced_end = _SPACED.match(text, at).end()
                for m in _CARD.finditer(text, at, spaced_end):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", m.start(), m.end()))
        elif kind == "@":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, end)):
                mail_end = m.end()
                found.append(("email", start, mail_end))
        elif kind == "+":
            if (m := _PHONE.match(text, at)) and 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", at, m.end()))
        elif kind == "scheme":
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and text[start] not in _LETTER:
                start += 1
            if start < at and (m := _USER_HOST.match(text, end)):
                url_end = m.end()
                found.append(("url", start, url_end))
        elif at and text[at - 1] in _WORD:
            continue
        elif kind == "cue":
            if at >= secret_end and (m := _VALUE.match(text, end)):
                secret_end = m.end()
                if any("0" <= c <= "9" for c in m[1]):
                    found.append(("secret", m.start(1), secret_end))
        elif kind == "key":
            if at >= key_end and (m := _KEY_ID.match(text, end)) and text[m.end() : m.end() + 1] not in _WORD:
                key_end = m.end()
                found.append(("secret", at, key_end))
        elif at >= iban_end and (m := _IBAN.match(text, end)):
            iban_end = m.end()
            if iban(m[1]):
                found.append(("account", m.start(1), iban_end))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def _addresses(run: str, at: int, found: list[tuple[str, int, int]]) -> None:
    pieces = run.split(".")
    begin, k = [], 0
    for p in pieces:
        begin.append(at)
        at += len(p) + 1
    while k + 3 < len(pieces):
        four = pieces[k : k + 4]
        if not all(four):
            k += 1
            continue
        if all(map(small, four)):
            found.append(("ip", begin[k], begin[k + 3] + len(four[3])))
        k += 4


def _spans_of(batch: pa.RecordBatch, anchors: ahocorasick.Automaton) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    for text in C.plain(batch.column("text")).to_pylist():
        yield text, find_spans(text, anchors)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, and all spans. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in C.slices(batches):
            counts, digests, everything = [], [], []
            for _, spans in _spans_of(batch, anchors):
                base = [s for s in spans if s[0] in BASE]
                counts.append([sum(s[0] == k for s in base) for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                everything.append(joined(spans))
            by_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *by_kind, pa.array(digests), pa.array(everything)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = f"doc_id {C.id_type(df, id_col)}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return C.id_text(df, id_col, text_col).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each union of overlapping spans becomes the label of its first span."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind's label; a null text stays null."""
    names = df.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t, anchors)) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(i).type) if i == where else batch.column(i) for i in range(len(names))], schema=batch.schema)

    return df.mapInArrow(run, df.schema)
