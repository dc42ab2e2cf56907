"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs, schemes, identifier and street cues, a
plus before a digit, and pairs of a digit with a digit, dot, blank or hyphen. A deterministic parser per kind grows
each anchor to the full address or number and validates it. Kinds in order: ``email ip card phone`` (the base
kinds), then ``contact`` (mailto:/tel: targets and credentials in a URL), ``account`` (an identifier after a cue) and
``address`` (house number and street, or a post box, with the town and postal code that follow). The added kinds
never change the base spans.

What validates an account depends on its cue: an IBAN has the remainder 1 modulo 97, a routing number its weighted
checksum, a social security number no reserved part; account numbers have 6 to 17 digits that are not all the same, and
one written like an IBAN must be one; a passport number has 6 to 9 letters and digits, five digits at least.

Null text counts as empty; a null doc_id is returned as it is; rows are independent, so duplicates, ties and other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, spread

KINDS = ("email", "ip", "card", "phone", "contact", "account", "address")
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
PHONE = frozenset(" ().-") | DIGITS
SCHEMES = ("mailto:", "tel:", "://")
#: Cues of identifiers and what they announce; cues of streets and post boxes.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "routing": "routing", "passport": "passport", **dict.fromkeys(("account", "acct", "konto", "compte", "cuenta"), "account")}
STREETS = (" Street", " St.", " Avenue", " Ave", " Road", " Rd", " Lane", " Boulevard", " Blvd", " Drive", "straße", "strasse", "O. Box", "PO Box")
Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    words: dict[str, str] = {"@": "email"}
    for d in DIGITS:
        words[f"+{d}"] = "phone"
        words[f"{d}."] = "ip"
        for e in DIGITS:
            words[f"{d}{e}"] = "card"
            words[f"{d} {e}"] = "card"
            words[f"{d}-{e}"] = "card"
    for w in SCHEMES:
        words[w] = "scheme"
    for w in CUES:
        for form in {w, w.upper(), w.capitalize(), w.title()}:
            words[form] = CUES[w]
    for w in STREETS:
        words[w] = "address"
    a = ahocorasick.Automaton()
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def run_of(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def domain_end(text: str, at: int) -> int:
    """End of ``label(.label)+`` at ``at``, or -1."""
    end = run_of(text, at, LABEL)
    if end == at:
        return -1
    dots = 0
    while end < len(text) and text[end] == ".":
        after = run_of(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, dots = after, dots + 1
    return end if dots else -1


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = domain_end(text, at + 1)
    return (start, end) if end > 0 else None


def parse_ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """All addresses in the dotted chain of numbers through ``at``; its end."""
    start = at
    while start and text[start - 1] in DIGITS:
        start -= 1
    runs, end = [], start
    while True:
        stop = run_of(text, end, DIGITS)
        if stop == end:
            break
        runs.append((end, stop))
        end = stop
        if end < len(text) and text[end] == "." and end + 1 < len(text) and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    found = []
    for i in range(0, len(runs) - 3, 4):
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in runs[i : i + 4]):
            found.append((runs[i][0], runs[i + 3][1]))
    return found, runs[-1][1] if runs else at + 1


def parse_card(text: str, at: int) -> tuple[int, int, bool]:
    """The maximal chain of digits with single separators that starts at ``at``; whether it is a card."""
    end, n, digits = at + 1, len(text), [text[at]]
    while end < n:
        c = text[end]
        if c in DIGITS:
            digits.append(c)
            end += 1
        elif c in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return at, end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def parse_phone(text: str, at: int) -> tuple[int, int, bool] | None:
    end = run_of(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


#: What may stand between a cue and its identifier.
BETWEEN = re.compile(r"(?:\s+(?:number|no|nr|num))?[.:#\s]{1,3}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![0-9A-Za-z])")
ROUTING = re.compile(r"[0-9]{9}(?![0-9A-Za-z])")
PASSPORT = re.compile(r"[A-Z0-9]{6,9}(?![0-9A-Za-z])")
NUMBER = re.compile(r"[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])")
CONTACT = re.compile(r"[+0-9A-Za-z][0-9A-Za-z.%+()@_-]{4,}")
USERINFO = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@]+(?=@)")
BEFORE_STREET = re.compile(r"(?<![\w.-])[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'.-]*){1,4}$")
GERMAN_NUMBER = re.compile(r" [0-9]{1,4}[a-z]?(?!\w)")
BOX_NUMBER = re.compile(r" [0-9]{1,6}(?!\w)")
TOWN = re.compile(r",? (?:(?:Apt|Suite|Unit|No)\.? [0-9A-Za-z]{1,5})?(?:, )?(?:[A-Z][\w'-]*(?: [A-Z][\w'-]*){0,2}),? (?:[A-Z]{2} )?[0-9]{5}(?:-[0-9]{4})?(?!\w)|, [0-9]{5} [A-Z][\w'-]*")
#: Characters that a street's number and name may take.
STREET_REACH = 80


def iban_at(text: str, at: int) -> int:
    """End of the longest valid IBAN at ``at``, or -1; ends lie between groups."""
    m = IBAN.match(text, at)
    if not m:
        return -1
    value, end = m[0], len(m[0])
    while end >= 15:
        compact = re.sub("[ -]", "", value[:end])
        if 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
            return at + end
        end = max(value.rfind(" ", 0, end), value.rfind("-", 0, end))
    return -1


def identifier_at(text: str, at: int, what: str) -> int:
    """End of a valid identifier of this kind at ``at``, or -1."""
    if what == "iban":
        return iban_at(text, at)
    if what == "ssn":
        m = SSN.match(text, at)
        good = m and m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000"
        return m.end() if good else -1
    if what == "routing":
        m = ROUTING.match(text, at)
        return m.end() if m and m[0] != "000000000" and sum(int(d) * w for d, w in zip(m[0], (3, 7, 1) * 3)) % 10 == 0 else -1
    if what == "passport":
        m = PASSPORT.match(text, at)
        return m.end() if m and sum(c in DIGITS for c in m[0]) >= 5 else -1
    if text[at : at + 1] not in DIGITS:
        return iban_at(text, at)
    m = NUMBER.match(text, at)
    digits = re.sub("[ -]", "", m[0]) if m else ""
    return m.end() if m and 6 <= len(digits) <= 17 and len(set(digits)) > 1 else -1


def parse_cue(text: str, end: int, what: str) -> tuple[int, int] | None:
    m = BETWEEN.match(text, end)
    if not m:
        return None
    stop = identifier_at(text, m.end(), what)
    return (m.end(), stop) if stop > 0 else None


def parse_street(text: str, at: int, end: int) -> tuple[int, int] | None:
    """An address around the cue text[at:end]: house number and names before it (or a number behind it), then the town."""
    cue = text[at:end]
    if cue.endswith("Box"):
        number = BOX_NUMBER.match(text, end)
        start = at - 2 if cue == "O. Box" and text[max(0, at - 2) : at] == "P." else at
        if not number or (cue == "O. Box" and start == at):
            return None
        end = number.end()
    elif cue[0] != " ":
        number = GERMAN_NUMBER.match(text, end)
        start = at
        while start and at - start < STREET_REACH and text[start - 1].isalpha():
            start -= 1
        if not number or start == at or not text[start].isupper():
            return None
        end = number.end()
    else:
        if end < len(text) and text[end].isalnum():
            return None
        low = max(0, at - STREET_REACH)
        before = BEFORE_STREET.search(text[low:at])
        if not before:
            return None
        start = low + before.start()
        if cue in (" Ave", " Rd", " Blvd") and text[end : end + 1] == ".":
            end += 1
    town = TOWN.match(text, end)
    return start, town.end() if town else end


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind in the order of ``KINDS``, then start; code points, end exclusive."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)  # matches of a kind do not overlap
    for last, (kind, size) in automaton().iter(text):
        at = last + 1 - size
        if kind == "email":
            if at >= floor[kind] and (hit := parse_email(text, at, floor[kind])):
                out[kind].append(hit)
                floor[kind] = hit[1]
        elif kind == "card":
            if at >= floor[kind]:
                start, end, good = parse_card(text, at)
                if good:
                    out[kind].append((start, end))
                floor[kind] = end
        elif kind == "ip":
            if at >= floor[kind] and last + 1 < len(text) and text[last + 1] in DIGITS:
                hits, end = parse_ips(text, at)
                out[kind] += hits
                floor[kind] = end
        elif kind == "phone":
            if at >= floor[kind] and (got := parse_phone(text, at)):
                if got[2]:
                    out[kind].append(got[:2])
                floor[kind] = got[1]
        elif kind == "scheme":
            m = (USERINFO if text[at] == ":" else CONTACT).match(text, last + 1)
            if m and m.start() >= floor["contact"]:
                out["contact"].append(m.span())
                floor["contact"] = m.end()
        elif kind == "address":
            if (hit := parse_street(text, at, last + 1)) and hit[0] >= floor[kind]:
                out[kind].append(hit)
                floor[kind] = hit[1]
        elif at >= floor["account"] and (at == 0 or not text[at - 1].isalnum()) and (hit := parse_cue(text, last + 1, kind)):
            out["account"].append(hit)
            floor["account"] = hit[1]
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by ``<KIND>``; overlapping spans become the tag of the first."""
    if not text:
        return text
    out, at = [], 0
    for k, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans, for every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [spans(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(s[0] == k for s in found) for found in rows] for k in KINDS[:4]]
        base = [hashlib.sha256(joined([s for s in found if s[0] in KINDS[:4]]).encode()).hexdigest() for found in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array([joined(f) for f in rows], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(spread(source), one, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by tags; ``n_chars`` follows the new text."""
    names = docs.columns

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact(t) for t in batch.column("text").to_pylist()]
        arrays = {n: batch.column(n) for n in batch.schema.names}
        arrays["text"] = pa.array(texts, pa.string())
        arrays["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)

    return map_batches(docs, one, docs.schema)
