"""Personal data: offset-preserving deobfuscation.

A chain of small transducers rewrites a text into a plain form (look-alike characters, spelled digits, "at" and "dot" disguises) and
keeps, for every character of the plain form, the source characters that it stands for. Identifiers are detected in the source and
in the plain form; spans of the latter are mapped back to the source.

Defined results: a null text counts as empty and has no spans; a null doc_id is kept; repeated rows give repeated results; every
text is read whole, in time linear in its length; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: a later start in the same run can't succeed where that one failed.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Letters of other scripts that look like Latin ones; wide, mathematical and other forms come from the Unicode compatibility rule.
LOOKALIKES = str.maketrans("АВЕКМНОРСТУХасеорхуіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABEKMHOPCTYXaceopxyijsdhABEZHIKMNOPTYXoa")
INVISIBLE = "­​‌‍⁠﻿"

_WORD = "|".join(DIGIT_WORDS)
SPELLED = re.compile(rf"(?i)\b(?:plus[\s-]+)?(?:(?:{_WORD})\b(?:[\s,-]+|(?=\W)|$)|[0-9]+\b[\s-]+(?=(?:{_WORD})\b)|(?:dot|point)\b[\s]+(?=(?:{_WORD})\b)){{4,}}")
_PIECE = re.compile(rf"(?i)\bplus\b|\b(?:{_WORD})\b|\b(?:dot|point)\b|[0-9]+|[\s,-]+")
# "At" and "dot" in brackets, in the corpus's languages, and the marks themselves in brackets. White space before them is tried from its
# start only, so long runs of it take linear time.
_BEFORE = r"(?:(?<!\s)\s++)?+"
_OPEN, _CLOSE = rf"{_BEFORE}[(\[{{<]\s*+", r"\s*+[)\]}>]\s*+"
AT = rf"{_OPEN}(?:at|@|ät|arroba|arobase){_CLOSE}|{_BEFORE}(?:&#64;|&commat;|%40)\s*+"
DOT = rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}|{_BEFORE}&#46;\s*+|(?<=[0-9])\s++dot\s+(?=[0-9])"
DISGUISE = re.compile(rf"(?i)(?P<at>{AT})|(?P<dot>{DOT})")
# Spoken addresses: "at" with a spoken dot after it, or, where the part before "at" doesn't look like a plain word, with a written one.
SPOKEN = re.compile(r"(?i)(?<![\w.+-])(?:[\w.+-]+(?P<at>\s+at\s+)[\w-]+(?:(?:\s+dot\s+|\.)[\w-]+)*(?:\s+dot\s+)[A-Za-z]{2,}\b|(?=\w*[0-9._+-])\w[\w.+-]*(?P<also>\s+at\s+)[\w-]+(?:\.[\w-]+)+)")
_SPOKEN_DOT = re.compile(r"(?i)\s+dot\s+")
TRIGGER = re.compile(rf"(?i)[(\[{{<]\s*(?:at|dot|@|\.|ät|arroba|arobase|punkt|punto|point)\s*[)\]}}>]|&#64;|&commat;|%40|&#46;|\sdot\s|\sat\s+[\w-]+\.\w|\b(?:{_WORD})\b[\s,-]+(?:{_WORD})\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """What `[local]+@label(.label)+` finds, leftmost and non-overlapping, looking at each "@" once."""
    done, low = 0, 0
    at = text.find("@")
    while at >= 0:
        before = text[max(done, low) : at]
        start = max(done, low) + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        low = at + 1
        at = text.find("@", max(low, done))


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 1000) and all(len(x) < 1000 or not x.lstrip("0") for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


@functools.cache
def homoglyphs() -> dict[int, str | None]:
    """By the rule of compatibility forms (one ASCII character, or a decimal digit), and LOOKALIKES; None: the character goes."""
    out: dict[int, str | None] = {}
    for block in (range(0xA0, 0x2FFF), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200)):
        for c in block:
            plain = unicodedata.normalize("NFKC", ch := chr(c))
            digit = unicodedata.decimal(ch, None)
            if digit is not None:
                out[c] = str(digit)
            elif len(plain) == 1 and " " <= plain <= "~":
                out[c] = plain
    out |= {k: chr(v) for k, v in LOOKALIKES.items()}
    return out | {ord(c): None for c in INVISIBLE}


@functools.cache
def _homoglyph_set() -> frozenset[str]:
    return frozenset(map(chr, homoglyphs()))


@functools.cache
def _homoglyph_class() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(homoglyphs())) + "]")


class Plain:
    """A rewritten text; start[i] and end[i] are the source span that character i stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order and without overlap. A replacement of several characters shares the whole source span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text, self.start, self.end = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:]


def plain(text: str) -> Plain | None:
    """The plain form, or None where nothing needs rewriting."""
    odd = not text.isascii() and not _homoglyph_set().isdisjoint(text)  # a search by a class of so many characters takes many times as long
    if not odd and not TRIGGER.search(text):
        return None
    out = Plain(text)
    if odd:
        table = homoglyphs()
        out.rewrite([(m.start(), m.end(), table[ord(m[0])] or "") for m in _homoglyph_class().finditer(text)])
    out.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in DISGUISE.finditer(out.text)])
    edits = []
    for m in SPOKEN.finditer(out.text):
        at = "at" if m["at"] else "also"
        edits.append((*m.span(at), "@"))
        edits += [(*x.span(), ".") for x in _SPOKEN_DOT.finditer(out.text, m.end(at), m.end())]
    out.rewrite(edits)
    edits = []
    for m in SPELLED.finditer(out.text):
        stop = m.start() + len(m[0].rstrip(" \t\n\r,-"))
        for x in _PIECE.finditer(out.text, m.start(), stop):
            w = x[0].lower()
            new = "+" if w == "plus" else "." if w in ("dot", "point") else DIGIT_WORDS.get(w, w if w.isdigit() else "")
            if new != x[0]:
                edits.append((*x.span(), new))
    out.rewrite(edits)
    return out


def hidden(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the plain form shows, in source code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if (p := plain(text)) is not None:
        for kind, spans in detect(p.text).items():
            known = set(base[kind])
            for a, b in spans:
                span = p.start[a], p.end[b - 1]
                if span not in known and p.text[a:b] != text[span[0] : span[1]]:
                    out[kind].append(span)
                    known.add(span)
    return out


def _written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_pii(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_<kind> and base_sha256 of the base spans, spans (all), n_added (those of the plain form)."""

    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                base = detect(text)
                more = hidden(text, base)
                both = {k: base[k] + more[k] for k in KINDS}
                out.append((doc_id.as_py(), *(len(base[k]) for k in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(both), sum(map(len, more.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, types)], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def mask_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans, the first and longest counts."""
    if not text:
        return text
    base = detect(text)
    more = hidden(text, base)
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k in KINDS for a, b in base[k] + more[k]):
        b = -b
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{k}>" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in `text` masked."""

    def rows(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array([mask_text(x.as_py()) for x in batch.column(k)], batch.schema.field(k).type))

    return docs.mapInArrow(rows, docs.schema)
