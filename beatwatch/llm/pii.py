"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before digits, dots between digits,
neighbouring digits, URL schemes and words that announce an identifier. From each anchor a local parser
widens to the whole email, address, number, URL or account and checks it (ranges, digit counts, Luhn,
IBAN remainder). Text without an anchor is never parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"

DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"'`{}|\\^]+|www\.[^\s<>\"'`{}|\\^]+", re.I)
# after a cue: its ending, then a sign and a value, or blanks and a token of digits
_ACCOUNT = re.compile(
    r"(?:[ _-]?(?:number|no|nr|id|key|code))?\.?(?:[\"']?[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9](?:[A-Za-z0-9_./+-]*[A-Za-z0-9])?)"
    r"|[ \t]+([0-9](?:[0-9-]*[0-9])?)(?![A-Za-z0-9]))",
    re.I,
)
_IBAN = re.compile(r"[\"']?[ \t]*[:=#]?[ \t]*[\"']?([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# fixed values: characters of an IBAN by country
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
IBAN_LENGTHS = {entry[:2]: int(entry[2:]) for entry in _IBAN_LENGTHS.split()}
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account", "acct", "token", "api_key", "apikey", "secret", "password", "passwd", "license", "passport", "ssn", "customer", "user_id", "userid")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if place % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban(text: str, at: int) -> tuple[int, int] | None:
    """The span of the valid IBAN that follows a cue at ``at``: as many characters as its country has, whatever stands behind."""
    match = _IBAN.match(text, at)
    size = IBAN_LENGTHS.get(match.group(1)) if match else None
    if size is None:
        return None
    places = [k for k in range(match.start(1), match.end()) if text[k] != " "][:size]
    end = places[-1] + 1
    if len(places) < size or text[end : end + 1].isalnum():
        return None
    flat = "".join(text[k] for k in places)
    return (places[0], end) if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else None


def _automaton() -> ahocorasick.Automaton:
    """Anchors with their kind, in lower case."""
    found = ahocorasick.Automaton()
    anchors = {"@": "email"}
    anchors |= {f"+{d}": "phone" for d in DIGITS}
    anchors |= {f"{d}.{e}": "ip" for d in DIGITS for e in DIGITS}
    anchors |= {f"{d}{gap}{e}": "card" for d in DIGITS for e in DIGITS for gap in ("", " ", "-")}
    for kind, cues in (("url", SCHEMES), ("account", CUES), ("iban", ("iban",))):
        anchors |= dict.fromkeys(cues, kind)
    for text, kind in anchors.items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


_ANCHORS: list[ahocorasick.Automaton] = []


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind and start.

    Spans of the first four kinds are those that their patterns find from the left without overlap;
    a match that fails its check is passed over whole.
    """
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    # where the search of a kind goes on
    next_at = dict.fromkeys((*KINDS, "iban"), 0)
    # anchors are sought in a copy with A-Z lowered, of the same length; parsers read the text itself
    for last, (kind, size) in _ANCHORS[0].iter(text.encode().lower().decode()):
        at = last + 1 - size
        floor = next_at[kind]
        if at < floor:
            continue
        if kind == "card":
            while at > floor and (text[at - 1] in DIGITS or (at - 1 > floor and text[at - 1] in " -" and text[at - 2] in DIGITS)):
                at -= 1
            match = _CARD.match(text, at)
            next_at[kind] = match.end()
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans[kind].append(match.span())
        elif kind == "ip":
            while at > floor and text[at - 1] in DIGITS:
                at -= 1
            match = _IP.match(text, at)
            if match:
                next_at[kind] = match.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.groups()):
                    spans[kind].append(match.span())
        elif kind == "email":
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            match = _EMAIL_REST.match(text, at) if start < at else None
            if match:
                next_at[kind] = match.end()
                spans[kind].append((start, match.end()))
        elif kind == "phone":
            match = _PHONE.match(text, at)
            if match:
                next_at[kind] = match.end()
                if 9 <= sum(c in DIGITS for c in match.group()) <= 15:
                    spans[kind].append(match.span())
        elif kind == "url":
            match = _URL.match(text, at)
            if match:
                end = match.end()
                while end > at and text[end - 1] in ".,;:!?)]":
                    end -= 1
                next_at[kind] = match.end()
                if "." in text[at:end].split("//")[-1] or "://" in text[at:end]:
                    spans[kind].append((at, end))
        elif kind == "iban":
            span = iban(text, last + 1)
            if span:
                next_at[kind] = span[1]
                spans["account"].append(span)
        else:
            match = _ACCOUNT.match(text, last + 1)
            value = match and (match.group(1) or match.group(2))
            if value and len(value) >= 6 and any(c in DIGITS for c in value):
                next_at[kind] = match.end()
                spans[kind].append(match.span(match.lastindex))
    return [(kind, a, b) for kind in KINDS for a, b in sorted(set(spans[kind]))]


def _spans_column(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], kind)


def personal_data(docs: DataFrame, *, redact: bool = False) -> DataFrame:
    """``doc_id`` and ``spans`` of every document, with ``redact`` also ``text`` with [KIND] in place of spans.

    A null or empty text has no spans and stays as it is. Rows that share a doc_id are searched each; an
    empty table gives no rows; other columns are ignored. One narrow pass; a task holds a batch of texts.
    Where spans overlap, the longest from the left is redacted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                found = [find_spans(t) if t else [] for t in texts]
                columns = {"doc_id": part.column("doc_id"), "spans": _spans_column(found)}
                if redact:
                    columns["text"] = pa.array([redacted(t, s) if t else t for t, s in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id long, spans {SPANS}" + ", text string" * redact
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
            done = b
    return "".join([*out, text[done:]])
