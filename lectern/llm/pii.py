"""Personal data in whole texts, plain or disguised, with spans in the original text.

Plain identifiers are found in the text as it is. For disguised ones the text runs through a chain of
small transducers: compatibility and look-alike characters become plain ones, bracketed or spelled
"at" and "dot" become signs, runs of spelled digits become digits. Each transducer rewrites matches
and carries along, for every character of its output, which source characters it stands for. What the
detectors then find in the normalised text maps back to source spans.

Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame

from lectern.llm.columns import Batches, arrow_map, slices

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone")

# What the contract accepts.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")  # or just a run of digits, to pass it at once
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁһԛԝαΑΒεΕΖΗιΙΚκΜΝνοΟρΡΤτΥυΧχ",
        "aABBeEkKMMHHoOpPcCTTyYxXiIjJsSdhqwaABeEZHiIKkMNvoOpPTtYuXx",
        strict=True,
    )
)
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
# Other dashes and spaces that stand for the plain ones.
LOOKALIKES |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-") | dict.fromkeys("\u00a0\u2007\u202f", " ")
# Characters that may have a plain form: dashes, spaces, look-alike alphabets, digits of other scripts,
# superscripts, circled and full-width forms, mathematical letters.
UNUSUAL = re.compile(
    "[\u00a0\u00ad\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2007\u200b-\u200f"
    "\u2010-\u2015\u2024\u202f\u2060\u2070-\u209f\u2212\u2460-\u24ff\ufe50-\ufe6b\ufeff\uff01-\uff5e"
    "\U0001d400-\U0001d7ff]"
)

# Digits as words, by language.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"[ \t\n,./-]{1,3}"
SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus{_GAP}|\+ ?)?(?:{_DIGIT}|[0-9])(?:{_GAP}(?:{_DIGIT}|[0-9]+)(?!\w)){{6,}}")
SPELLED_WORD = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?!\w)")
SPELLED_PART = re.compile(rf"(?i)plus|\+|{_DIGIT}|[0-9]|dot|[ \t\n,/-]+")
SPELLED_IP = re.compile(
    rf"(?i)(?<!\w)(?:(?:{_DIGIT}|[0-9]+)(?!\w)[ \t-]{{1,2}}){{1,3}}(?:(?:dot|punkt|point|punto)[ \t-]{{1,2}}"
    rf"(?:(?:{_DIGIT}|[0-9]+)(?!\w)[ \t-]{{0,2}}){{1,3}}){{3}}"
)
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
_AT, _DOT = r"(?:at|arroba|arobase|@)", r"(?:dot|punkt|point|punto|\.)"
BRACKETED = re.compile(rf"(?i)(?<=[a-z0-9]){_OPEN}(?:(?P<at>{_AT})|(?P<dot>{_DOT})){_CLOSE}(?=[a-z0-9])")
_SPOKEN_DOT = r"(?:\s{1,2}(?:dot|punkt|point|punto|\.)\s{1,2}|\.)"
SPOKEN = re.compile(
    rf"(?i)(?<![\w.%+-])[a-z0-9_%+-]+(?:{_SPOKEN_DOT}[a-z0-9_%+-]+)*+(?P<at>\s{{1,2}}(?:at|arroba|arobase|@)\s{{1,2}}|@)"
    rf"[a-z0-9-]+(?:{_SPOKEN_DOT}[a-z0-9-]+)+"
)
SPOKEN_PART = re.compile(r"(?i)\s{1,2}(?:(at|arroba|arobase|@)|dot|punkt|point|punto|\.)\s{1,2}")
BRACKETED_HINT = re.compile(rf"(?i)[\[({{<]\s{{0,2}}(?:{_AT}|{_DOT}){_CLOSE}")
SPACED_SIGN = re.compile(r"\s@\s|@\S+\s{1,2}\.\s")
SPOKEN_HINTS = ("dot", "punkt", "point", "punto")


def emails(text: str) -> list[Span]:
    """Every ``@`` with a local part before and a dotted domain behind, in one pass."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append(("email", start, domain.end()))
        at = text.find("@", free)
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = _digits(text) if len(text) <= 40 else ""
    return 13 <= len(digits) <= 19 and passes_luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def detect(text: str) -> list[Span]:
    """Plain identifiers, by kind, then start."""
    found = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if "." in m[0] and _is_ip(m[0])]
    found += [("card", *m.span()) for m in CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


class Rewritten:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Apply ordered, non-overlapping ``(start, end, replacement)`` edits."""
        edits = list(edits)
        if not edits:
            return
        text, starts, ends, done = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += (self.text[done:a], new)
            starts.extend(self.starts[done:a])
            ends.extend(self.ends[done:a])
            if new:
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            done = b
        self.text, self.starts, self.ends = "".join(text), starts, ends


def plain_characters(text: str) -> Iterable[tuple[int, int, str]]:
    for m in UNUSUAL.finditer(text):
        c = m[0]
        digit = unicodedata.decimal(c, None)
        plain = LOOKALIKES.get(c) or (unicodedata.normalize("NFKC", c) if digit is None else str(digit))
        new = "" if c in INVISIBLE else plain
        if new != c and new.isascii():
            yield m.start(), m.end(), new


def bracketed_signs(text: str) -> Iterable[tuple[int, int, str]]:
    for m in BRACKETED.finditer(text):
        yield m.start(), m.end(), "@" if m["at"] else "."


def spoken_signs(text: str) -> Iterable[tuple[int, int, str]]:
    """Spelled "at" and "dot" where they form a whole address, with at least one of them spelled."""
    for m in SPOKEN.finditer(text):
        if m["at"].strip() == "@" or "." not in m[0] or SPOKEN_PART.search(m[0], m.end("at") - m.start()):
            for part in SPOKEN_PART.finditer(m[0]):
                yield m.start() + part.start(), m.start() + part.end(), "@" if part[1] else "."


def spelled_digits(text: str) -> Iterable[tuple[int, int, str]]:
    """Runs of at least seven digits, three of them words in a row, and dotted quads in words."""
    runs = [m for r in (SPELLED_RUN, SPELLED_IP) for m in r.finditer(text) if SPELLED_WORD.search(m[0])]
    done = 0
    for m in sorted(runs, key=lambda m: (m.start(), -m.end())):
        if m.start() < done:
            continue
        done = m.end()
        for part in SPELLED_PART.finditer(m[0].rstrip()):
            word = part[0].lower()
            new = {"plus": "+", "+": "+", "dot": "."}.get(word) or SPELLED.get(word) or (word if word.isdigit() else "")
            if new != word:
                yield m.start() + part.start(), m.start() + part.end(), new


TRANSDUCERS = (plain_characters, bracketed_signs, spoken_signs, spelled_digits)


def may_be_disguised(text: str) -> bool:
    """Whether any transducer could change ``text`` into an identifier; cheap tests first."""
    if not text.isascii() and UNUSUAL.search(text):
        return True
    if any(c in text for c in "[({<") and BRACKETED_HINT.search(text):
        return True
    if SPACED_SIGN.search(text):
        return True
    words = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").replace("/", " ").split()
    if any(w in words for w in SPOKEN_HINTS):
        return True
    # Of the seven parts of a run, the first and the last may touch other characters.
    return b"\1\1\1\1\1" in bytes(w in SPELLED or w.isdigit() for w in words) and bool(SPELLED_WORD.search(text))


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as source spans off the plain ones of a kind."""
    if not may_be_disguised(text):
        return []
    rewritten = Rewritten(text)
    for transducer in TRANSDUCERS:
        rewritten.replace(transducer(rewritten.text))
    taken = {kind: sorted((s, e) for k, s, e in plain if k == kind) for kind in KINDS}
    found = []
    for kind, a, b in detect(rewritten.text):
        start, end = rewritten.starts[a], rewritten.ends[b - 1]
        if text[start:end] == rewritten.text[a:b]:
            continue
        near = bisect_left(taken[kind], (start, start))
        around = taken[kind][max(0, near - 1) : near + 1]
        if all(end <= s or e <= start for s, e in around):
            found.append((kind, start, end))
    return found


def find_all(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans by kind, then start; the flag says whether a span is plain."""
    plain = detect(text or "")
    spans = [(*s, True) for s in plain] + [(*s, False) for s in disguised(text or "", plain)]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def mask(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """``text`` with every span replaced by its kind; spans that overlap become one, named by the first."""
    if not spans:
        return text
    out, done, last = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += (text[done:start], f"<{kind.upper()}>")
        done = last = max(last, end)
    return "".join([*out, text[done:]])


def find_pii(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", masked: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row ``doc_id``, ``keep`` and ``spans`` (kind, start, end, plain), with ``masked_text`` if wanted.

    Map only: each row is scanned whole, by itself. Null texts have no spans and stay null when masked.
    Repeated rows give repeated results. Further columns of any name are ignored.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"), *[docs[c] for c in keep])
    kept = ["doc_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    schema += ", spans array<struct<kind: string, `start`: bigint, `end`: bigint, plain: boolean>>"

    def scan(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column("__text").to_pylist()
                spans = [find_all(t) for t in texts]
                columns = {c: batch.column(c) for c in kept}
                columns["spans"] = [[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in r] for r in spans]
                if masked:
                    columns["masked_text"] = [mask(t, s) for t, s in zip(texts, spans, strict=True)]
                yield columns

    return arrow_map(rows, scan, schema + (", masked_text string" if masked else ""))
