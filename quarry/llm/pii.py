"""Operator 4: personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, identifier cues, digits after a plus sign or beside a dot. From each anchor a
deterministic local parser expands to both sides and validates the boundaries. The four base kinds come out exactly as
the leftmost non-overlapping matches of their patterns; the cues add spans of further kinds.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._base import documents, text_chunks

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "handle", "account", "iban", "ssn")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[ \t]{0,3}(?i:number|no\.?|nr\.?|id|#)?[ \t]{0,3}[:=#]?[ \t]{0,3}([A-Z0-9][A-Z0-9-]{4,32}[A-Z0-9])(?![A-Za-z0-9])")
_SPOKEN_DOMAIN = re.compile(r"[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+", re.I)
_LETTERS = re.compile(r"[A-Za-z]*")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = (
    "account", "acct", "passport", "iban", "ssn", "social security", "customer id", "client id", "member id", "national id", "tax id", "routing",
    "konto", "kundennummer", "reisepass", "compte", "passeport", "cuenta", "pasaporte",
)
SPOKEN_AT = ("(at)", "[at]", "( at )", "[ at ]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(1)
def automaton():
    """Finds the anchors in lower-cased text. Values are (kind, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for words, kind in ((SCHEMES, "scheme"), (CUES, "cue"), (SPOKEN_AT, "spoken")):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """Lower case, with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """At an at-sign, the local part is what its characters reach to the left, from the last match on; the domain is greedy."""
    found, done = [], 0
    for at in ats:
        start = at
        while start > done and (text[start - 1] in _LOCAL):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
    return found


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def leftmost(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches, tried at the anchors only: no match can begin elsewhere."""
    done = 0
    for start in starts:
        if start >= done and (m := pattern.match(text, start)):
            yield m
            done = m.end()


def numbers(text: str, digits: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """IP addresses and card numbers. digits: where digits stand."""
    ips = [m.span() for m in leftmost(_IP, text, digits) if all(len(part := g.lstrip("0")) <= 3 and int(part or 0) <= 255 for g in m.groups())]
    cards = []
    for m in leftmost(_CARD, text, digits):
        plain = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(plain) <= 19 and luhn(plain):
            cards.append(m.span())
    return ips, cards


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of start, as code points with exclusive ends."""
    at, plus, digits, schemes, cues, spoken = [], [], [], [], [], []
    into = {"at": at, "plus": plus, "digit": digits, "scheme": schemes, "cue": cues, "spoken": spoken}
    for end, (kind, length) in automaton().iter(lowered(text)):
        into[kind].append((end + 1 - length, end + 1) if kind == "cue" else end + 1 - length)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    if at:
        found["email"] = emails(text, at)
    digits = [d for d, before in zip(digits, [-2, *digits]) if d != before + 1]  # within a run of digits only the first can begin a match
    if digits:
        found["ip"], found["card"] = numbers(text, digits)
        # a quantified tail may be long, so the phone's anchors are tried in order like the others
        found["phone"] = [m.span() for m in leftmost(_PHONE, text, plus) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    for start in schemes:
        if found["url"] and start < found["url"][-1][1]:
            continue
        head = re.compile(r"[A-Za-z]+:(//)?").match(text, start).end()
        if (m := _URL.match(text, head)) and (start == 0 or not text[start - 1].isalnum()):
            found["url"].append((start, head + len(m.group().rstrip(".,;:!?)]"))))
    for at in spoken:
        done = found["handle"][-1][1] if found["handle"] else 0
        if at < done or not (m := _SPOKEN_DOMAIN.match(text, at)):
            continue
        start = end = at - (at > done and text[at - 1] == " ")
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        while start < end and text[start] in "._%+-":
            start += 1
        if start < end:
            found["handle"].append((start, m.end()))
    taken = sorted(span for k in ADDED for span in found[k])
    cues = sorted(set(cues))
    for i, (start, end) in enumerate(cues):
        if start and text[start - 1].isalpha():
            continue
        end = _LETTERS.match(text, end).end()
        # a cue speaks of its line, up to the next cue
        stop = text.find("\n", end)
        stop = min(len(text) if stop < 0 else stop, max(end, cues[i + 1][0]) if i + 1 < len(cues) else len(text))
        near = []
        for kind, m in (("iban", _first_iban(text, end, stop)), ("ssn", _SSN.search(text, end, stop)), ("account", _ACCOUNT.match(text, end))):
            if m and (kind != "account" or any(c.isdigit() for c in m.group(1))) and not text[m.end() : m.end() + 1].isalnum():
                near.append((*m.span(1 if kind == "account" else 0), kind))
        if near:  # the cue tells of what comes first
            lo, hi, kind = min(near, key=lambda x: x[0])
            at = bisect.bisect_left(taken, (hi,))
            if not any(lo < b for _, b in taken[max(0, at - 2) : at]):
                found[kind].append((lo, hi))
                bisect.insort(taken, (lo, hi))
    return found


def _first_iban(text: str, lo: int, hi: int) -> re.Match | None:
    """The first account number of that form whose check digits hold."""
    return next((m for m in _IBAN.finditer(text, lo, hi) if iban_valid(m.group())), None)


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in sorted(found[k]))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the four base kinds, a digest of their spans, and all spans, for every whole text.

    A null text counts as empty: no spans, the digest of nothing. A null doc_id stays null; repeated rows each give a row;
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            rows = []
            for doc, text in zip(ids, texts):
                found = find(text)
                rows.append((doc, *(len(found[k]) for k in BASE), hashlib.sha256(joined(found, BASE).encode()).hexdigest(), joined(found, BASE + ADDED), sum(map(len, found.values()))))
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return documents(docs).mapInArrow(run, FOUND)


def redact(text: str, mask: str = "[{kind}]") -> str:
    """The text with every span replaced; overlapping spans are replaced together under the kind that starts first."""
    spans = sorted((s, -e, k) for k, v in find(text).items() for s, e in v)
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out.append(text[done:s] + mask.format(kind=k))
        done = max(done, -e)
    return "".join(out) + text[done:]
