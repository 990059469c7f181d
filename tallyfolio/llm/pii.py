"""Operator 4, personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address schemes and identifier cues.  A
small deterministic parser expands each anchor to both sides and validates the boundaries:

* email: local part to the left of the at-sign, dotted domain to the right;
* ip: runs of digits joined by dots, four at a time, each at most 255;
* card: digits with single spaces or hyphens between, 16 to 19 digits that pass the Luhn check;
* phone: from a plus sign to the last digit of the run, 8 to 15 digits;
* url (added): from a scheme to the end of the address, with a host that has a letter or digit;
* account (added): the identifier after a cue such as "iban", "account" or "token", at least four digits in it.

Every parser moves a cursor past what it has consumed, so spans of a kind don't overlap, and the time is linear in the
text.  Spans count code points, the end is exclusive.

Defined cases: null and empty texts have no spans; a candidate that fails validation is consumed and dropped; repeated
rows are each reported; other columns are ignored by `find` and carried by `redact`.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]

# Schemes and cues.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "passport", "ssn", "token", "api_key", "apikey", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9][^\x00-\x20\x7f<>\"'`{}|\\^\x85\xa0]*")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?))?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)")
_DIGIT = re.compile(r"[0-9]")
_TRAILING = ".,;:!?)]"


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for sign in "@+":
        out.add_word(sign, (sign, 1))
    for digit in "0123456789":
        out.add_word(digit, ("0", 1))
    for kind, words in (("s", SCHEMES), ("c", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in one text, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email = ip = card = phone = url = account = 0  # where each parser goes on
    for last, (sign, length) in _anchors().iter(text):
        at = last - length + 1
        if sign == "0":
            if at >= ip:
                chain = _CHAIN.match(text, at)
                ip = chain.end()
                parts, start = chain[0].split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        out["ip"].append((start, end))
                    start = end + 1
            if at >= card:
                number = _NUMBER.match(text, at)
                card = number.end() if number else at + 1
                if number and 16 <= len(digits := number[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out["card"].append((at, card))
        elif sign == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                email = domain.end()
                out["email"].append((start, email))
        elif sign == "+":
            if at >= phone and (number := _PHONE.match(text, at)):
                phone = number.end()
                if 8 <= len(_DIGIT.findall(number[0])) <= 15:
                    out["phone"].append((at, phone))
        elif sign == "s":
            if at >= url and not (at and text[at - 1].isalnum()) and (rest := _URL.match(text, last + 1)):
                url = last + 1 + max(1, len(rest[0].rstrip(_TRAILING)))
                out["url"].append((at, url))
        elif at >= account and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and (found := _ACCOUNT.match(text, last + 1)):
            start, end = found.span(1)
            # the cue is a word of its own, and what follows is an identifier rather than a word
            if start > last + 1 and 6 <= end - start <= 64 and len(_DIGIT.findall(text, start, end)) >= 4:
                account = end
                out["account"].append((start, end))
    return out


def written(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    """kind:start:end of all spans, by kind, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together."""
    if not text:
        return text
    found = sorted((s, -e, k) for k, v in spans(text).items() for s, e in v)
    if not found:
        return text
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_<kind>..., base_sha256, spans) for every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [spans(t.as_py()) for t in b.column(1)]
            counts = [pa.array([len(x[k]) for x in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(written(x, BASE_KINDS).encode()).hexdigest() for x in found]
            cols = [b.column(0), *counts, pa.array(digest, pa.string()), pa.array([written(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pipeline stage: the same rows and columns, personal data in `text_col` replaced, `n_chars` counted anew."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([redacted(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
