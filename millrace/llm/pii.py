"""Personal data, also where it is disguised, at its place in the source text.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone numbers as they stand. Then a chain of
transducers rewrites the text, carrying for each output character the span of source characters that it
stands for: look-alike characters become ASCII ones, bracketed or spelled "at" and "dot" become their
signs, and spelled digits (English, German, French, Spanish) become digits. What the same detectors find in the rewritten
text is mapped back through these spans. Base finds stay; a mapped find is added if it overlaps none of its kind; from the left, where two of
them overlap.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are
searched each. Empty table: no rows. Work is linear in the text's length, also for one endless word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start within a run of digits fails where the run's own start has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # what stands before this sign can't be part of a later address
        at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


DETECTORS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: find(text) for kind, find in DETECTORS.items()}


# -- transducers ------------------------------------------------------------------------------------------------


def _look_alikes() -> dict[str, str]:
    import unicodedata

    out = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
    out |= dict(zip("аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdqwhlABEKMHOPCTYXIJS", strict=True))  # Cyrillic
    out |= dict(zip("οαιυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaiuvABEZHIKMNOPTYX", strict=True))  # Greek
    out |= dict.fromkeys("‐‑‒–—―−﹣", "-") | dict.fromkeys("․。｡﹒٠"[:4], ".") | dict.fromkeys("﹫", "@")
    out |= dict.fromkeys("              　", " ")
    out |= dict.fromkeys("­​‌‍‎‏⁠﻿", "")
    for i in range(0x80, 0x1FBFA):
        c = chr(i)
        if c not in out and (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) in ("Nd", "No"):
            if unicodedata.category(c) == "Nd" or 0x2460 <= i <= 0x24FF:
                out[c] = str(d)
        elif c not in out and (0x1D400 <= i <= 0x1D7FF or 0x24B6 <= i <= 0x24E9):
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and n.isascii():
                out[c] = n
    return out


LOOK_ALIKES = _look_alikes()
#: A wide net for them; the table decides. Also the letters that match an ASCII one without regard to case.
_ODD = re.compile("[\xa0\xad\u0130\u0131\u017f\u0370-\U0010ffff]")
DIGIT_WORDS = {
    w: str(i)
    for i, ws in enumerate(
        ("zero oh null zéro cero", "one eins ein un uno une", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for w in ws.split()
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_WORD})\b(?:[ ,-]{{1,2}}(?:(?:{_WORD}|plus|dot|point|punkt|punto)\b|[0-9]+\b|\.)){{3,}}", re.I)
_PLUS = re.compile(r"\bplus[ ]+(?=\+?[0-9])", re.I)
_PIECE = re.compile(r"[A-Za-zéüÉÜ]+|[0-9]+|\.", re.I)
_AT = r"[(\[{<]\s{0,2}(?:at|@|arroba|ät)\s{0,2}[)\]}>]"
_DOT = r"[(\[{<]\s{0,2}(?:dot|\.|punkt|point|punto)\s{0,2}[)\]}>]"
_BRACKETED = re.compile(rf"[ ]{{0,2}}(?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ ]{{0,2}}", re.I)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})"
_SEP_DOT = r"(?:[ ]{1,2}(?:dot|punkt|punto)[ ]{1,2}|\.)"
_WIDE_DOT = r"(?:[ ]{1,2}(?:dot|punkt|punto)[ ]{1,2}|[ ]{0,2}\.[ ]{0,2})"
_ENDS = r"(?:com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|eu|us|ca|ch|nl|test)"
# Small letters only, as "home.It was" is a lost space; a country's code that is also a file's ending (.py, .sh) isn't among them.
_MORE_ENDS = (
    r"(?-i:mil|int|name|example|invalid|localhost|a[cdefgilmoqrtuwxz]|b[abdefghijmnorstvwyz]|c[adfghiklmnoruvwxyz]|d[ejkmoz]|e[cegrst]|f[ijkmor]|g[abdefghilmnpqrstuwy]|h[kmnrtu]|i[delmnqrst]"
    r"|j[emop]|k[eghimnprwyz]|l[abcikrtuvy]|m[acegkmnopqrstuvwxyz]|n[acefgilopruz]|om|p[aefghkmnrtw]|qa|r[eouw]|s[abcdegiklmnrtvxyz]|t[cdfghjklmnortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw])"
)
# A spelled "at" counts before labels of which a "dot" is spelled, or before a domain of a known ending, or of any ending if what stands before is
# like an address; a sign with gaps before any of a known ending.
_SPELLED_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?P<at>[ ]{{1,2}}(?:at|arroba)[ ]{{1,2}})(?P<domain>{_LABEL}(?:{_SEP_DOT}{_LABEL}){{0,4}}(?:[ ]{{1,2}}(?:dot|punkt|punto)[ ]{{1,2}}{_LABEL}|\.(?:{_ENDS}|{_MORE_ENDS})\b(?!@)))"
    rf"|(?<=[A-Za-z0-9._%+-])(?P<at2>[ ]{{0,2}}@[ ]{{0,2}})(?P<domain2>{_LABEL}(?:{_WIDE_DOT}{_LABEL}){{0,4}}(?:[ ]{{1,2}}(?:dot|punkt|punto)[ ]{{1,2}}{_LABEL}|[ ]{{0,2}}\.[ ]{{0,2}}{_ENDS}\b))"
    rf"|(?<=[A-Za-z0-9._%+-])(?P<at3>[ ]{{1,2}}(?:at|arroba)[ ]{{1,2}})(?P<domain3>{_LABEL}(?:\.{_LABEL}){{0,4}}\.(?-i:[a-z]{{2,24}}|[A-Z]{{2,24}})\b(?![A-Za-z0-9._%+-]{{0,64}}@))",
    re.I,
)
# What ends before a spelled "at" is like an address: a local part of more than letters, or a word of mail in the sixty characters before it.
_ADDRESS = re.compile(r"(?:[A-Za-z0-9%+_-]*(?:[0-9%+_-]|[A-Za-z]\.[A-Za-z])[A-Za-z0-9%+_-]*|\b(?:e-?mails?|mail(?:ed|to)?|contact|write|address|reach|kontakt|schreib\w*|adresse|contacter|correo|contacto|escrib\w*|courriel|écri\w*)\b[^\n]{0,60})$", re.I)
_LOCAL_DOT = re.compile(r"(?<=[A-Za-z0-9])[ ]{1,2}(?:dot|punkt|punto)[ ]{1,2}(?=[A-Za-z0-9._%+-]{1,64}@)", re.I)
_IP_DOT = re.compile(r"(?<=[0-9])[ ]{0,2}(?:\bdot\b|\bpoint\b|\bpunkt\b|\bpunto\b|\.)[ ]{0,2}(?=[0-9])", re.I)
_LOW = _LABEL.replace("A-Z", "")
# What any of the rewritings needs, searched in lower case: each finds all that its transducers do, in a text that _ODD finds nothing in.
_NOTES = (
    re.compile(rf"{_AT}|{_DOT}"),
    re.compile(r" dot | punkt | punto | arroba "),  # any "dot" of addresses, and _IP_DOT's words but "point"
    re.compile(rf" at {{1,2}}{_LOW}(?:\.[a-z0-9-]+)*\.[a-z]{{2,24}}\b"),
    re.compile(rf"@ | @|@{_LOW}(?:\.{_LOW}){{0,4}}(?: {{1,2}}\.|\. )"),
    re.compile(rf"\b(?:{_WORD})\b(?:[ ,-]{{1,2}}(?:(?:{_WORD}|plus|dot|point|punkt|punto)\b|[0-9]+\b|\.)){{3}}"),
    re.compile(r"\bplus +\+?[0-9]"),
    re.compile(r"[0-9](?: {1,2}(?:point {1,2}|\. {0,2})|\. {1,2})[0-9]"),
)


class Tape:
    """A text and, for each of its characters, where in the source it begins and ends."""

    def __init__(self, text: str, source: str, begin: np.ndarray, end: np.ndarray):
        self.text, self.origin, self.begin, self.end = text, source, begin, end

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text) + 1)
        return cls(text, text, at[:-1], at[1:])

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, new): the new characters all stand for the old ones."""
        if not changes:
            return self
        out, begin, end, last = [], [], [], 0
        for a, b, new in changes:
            out += (self.text[last:a], new)
            begin += (self.begin[last:a], np.full(len(new), self.begin[a]))
            end += (self.end[last:a], np.full(len(new), self.end[b - 1]))
            last = b
        out.append(self.text[last:])
        return Tape("".join(out), self.origin, np.concatenate([*begin, self.begin[last:]]), np.concatenate([*end, self.end[last:]]))

    def source(self, start: int, stop: int) -> tuple[int, int]:
        """The source span of some characters, without the gaps that were rewritten along with its first and last."""
        a, b = int(self.begin[start]), int(self.end[stop - 1])
        while a < b - 1 and self.origin[a] in " ,":
            a += 1
        while b - 1 > a and self.origin[b - 1] in " ,":
            b -= 1
        return a, b


def _spelled_digits(tape: Tape) -> Tape:
    changes = []
    for m in _SPELLED.finditer(tape.text):
        at, before = m.start(), None
        for p in _PIECE.finditer(m[0]):
            a, b, word = at + p.start(), at + p.end(), p[0].lower()
            new = DIGIT_WORDS.get(word) or ("+" if word == "plus" else word if word.isdigit() else ".")
            # the gap before a digit goes with it
            changes.append((a if before is None or word == "plus" else before, b, new))
            before = b
    return tape.rewrite(changes)


def _plain(pattern: re.Pattern, new: str):
    return lambda tape: tape.rewrite([(*m.span(), new) for m in pattern.finditer(tape.text) if m[0] != new])


def _spelled_at(tape: Tape) -> Tape:
    changes = []
    for m in _SPELLED_AT.finditer(tape.text):
        kind = "" if m["at"] is not None else "2" if m["at2"] is not None else "3"
        if kind == "3" and not _ADDRESS.search(tape.text[max(0, m.start() - 90) : m.start()]):
            continue
        if m[f"at{kind}"] == "@" and " " not in m[f"domain{kind}"]:
            continue
        changes.append((*m.span(f"at{kind}"), "@"))
        a, domain = m.start(f"domain{kind}"), m[f"domain{kind}"]
        changes += [(a + d.start(), a + d.end(), ".") for d in re.finditer(_WIDE_DOT, domain, re.I) if d[0] != "."]
    return tape.rewrite(changes)


TRANSDUCERS = (
    lambda tape: tape.rewrite([(*m.span(), LOOK_ALIKES[m[0]]) for m in _ODD.finditer(tape.text) if m[0] in LOOK_ALIKES]),
    lambda tape: tape.rewrite([(*m.span(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(tape.text)]),
    _spelled_digits,
    _plain(_PLUS, "+"),
    _plain(_IP_DOT, "."),
    _spelled_at,
    _plain(_LOCAL_DOT, "."),
)


def normalised(text: str) -> Tape | None:
    """The rewritten text, or None where no transducer has anything to do."""
    low = text.lower()
    if (text.isascii() or not _ODD.search(text)) and not any(note.search(low) for note in _NOTES):
        return None
    return rewritten(text)


def rewritten(text: str) -> Tape | None:
    """What all transducers make of a text, without the search before them."""
    first = tape = Tape.of(text)
    for step in TRANSDUCERS:
        tape = step(tape)
    return None if tape is first else tape


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and all."""
    plain = base(text)
    tape = normalised(text)
    if tape is None:
        return plain, plain
    return plain, {kind: _added(plain[kind], [tape.source(a, b) for a, b in detect(tape.text)]) for kind, detect in DETECTORS.items()}


def _added(known: list[tuple[int, int]], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The known spans, which overlap none of each other, and those of found, from the left, that overlap none before."""
    out, i, end = [], 0, 0
    for a, b in sorted(found):
        while i < len(known) and known[i][0] <= a:
            out.append(known[i])
            end = known[i][1]
            i += 1
        if a >= end and (i == len(known) or b <= known[i][0]):
            out.append((a, b))
            end = b
    return out + known[i:]


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of kind, start, end, by kind and start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", kind), ("spans", kind)])

    def rows(found):
        return [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]]

    def run(batches):
        for batch in batches:
            plain, every = [], []
            for text in batch.column(1):
                one, two = find(text.as_py() or "")
                plain.append(rows(one))
                every.append(rows(two))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, kind), pa.array(every, kind)], schema=schema)

    return texts(docs).mapInArrow(run, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redacted(text: str) -> str:
    """text with each span replaced by its kind; of spans that overlap, all are covered."""
    every = find(text)[1]
    marks = sorted((a, b, k) for k, s in every.items() for a, b in s)
    out, at = [], 0
    for a, b, kind in marks:
        if a >= at:
            out += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text (and n_chars of the new text, where there is such a column)."""
    small_batches(docs.sparkSession)
    schema_ = docs.schema
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            new = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t in new], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema_)
