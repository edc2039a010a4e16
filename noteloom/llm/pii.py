"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and identifier cues; at each anchor a local
parser expands to the left and right and validates the boundaries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches

#: Kinds of the contract, in their order, and those that the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "login_url", "secret")
KINDS = BASE + ADDED

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-/+.=")

#: Cue words, tried in lower case, title case and upper case.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("api_key", "apikey", "api-key", "passwd", "password", "secret", "token")
#: Lengths of IBANs by country.
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}


def automaton():
    """The anchors; a match carries its kind of anchor and its length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset, n: int) -> int:
    while at < n and text[at] in chars:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _email(text: str, at: int, after: int, n: int) -> tuple[int, int] | None:
    """Around the at-sign: the local part back to ``after`` at most, then two or more labels."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL, n)
    if start == at or end == at + 1:
        return None
    last = end
    while last < n and text[last] == "." and (more := _run(text, last + 1, LABEL, n)) > last + 1:
        last = more
    return (start, last) if last > end else None


def _ip(text: str, at: int, n: int) -> tuple[bool, int]:
    """From the first digit of a run: whether it is an address, and where its four numbers or the lesser chain end."""
    ok, end = True, at
    for part in range(4):
        stop = _run(text, end, DIGITS, n)
        number = text[end:stop].lstrip("0")
        ok &= len(number) <= 3 and int(number or "0") <= 255
        if part == 3:
            return ok, stop
        if not (stop + 1 < n and text[stop] == "." and text[stop + 1] in DIGITS):
            return False, stop
        end = stop + 1
    return False, end


def _card(text: str, at: int, n: int) -> tuple[str, int]:
    """The digits of the chain from ``at`` and its end; single spaces and hyphens may stand between digits."""
    end, digits = at, []
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    return "".join(digits), end


def _phone(text: str, at: int, n: int) -> tuple[int, int] | None:
    """From a plus sign: (end, digits), back to the last digit that leaves a character between."""
    if not (at + 1 < n and text[at + 1] in DIGITS):
        return None
    end = _run(text, at + 2, PHONE, n)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return end, sum(c in DIGITS for c in text[at:end])


def _iban(text: str, at: int, n: int) -> int:
    """From two capitals: the end of a valid number, or 0."""
    size = IBAN_LENGTH.get(text[at : at + 2])
    if not size or (at and text[at - 1].isalnum()):
        return 0
    chars, end = [], at
    while end < n and len(chars) < size:
        if text[end] in UPPER or text[end] in DIGITS:
            chars.append(text[end])
        elif text[end] != " " or end + 1 >= n or not (text[end + 1] in UPPER or text[end + 1] in DIGITS):
            return 0
        end += 1
    if len(chars) < size or (end < n and text[end].isalnum()):
        return 0
    turned = chars[4:] + chars[:4]
    return end if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else 0


def _account(text: str, at: int, n: int) -> tuple[int, int] | None:
    """After a cue word: a number of 8 to 18 digits within 24 characters, with nothing but a short label between."""
    if at < n and (text[at].isalnum() or text[at] == "_"):
        return None
    m = re.compile(r"[^0-9\n@]{0,24}?(?<![A-Za-z0-9])([0-9]{8,18})(?![0-9A-Za-z])").match(text, at)
    return (m.start(1), m.end(1)) if m else None


def _secret(text: str, at: int, n: int) -> tuple[int, int] | None:
    """After a cue word: ``=`` or ``:`` and a token of 16 characters or more with a digit in it."""
    m = re.compile(r"[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?").match(text, at)
    if not m:
        return None
    end = _run(text, m.end(), TOKEN, n)
    token = text[m.end() : end]
    return (m.end(), end) if len(token) >= 16 and any(c in DIGITS for c in token) else None


def _login(text: str, at: int, n: int) -> tuple[int, int] | None:
    """Around ``://``: an address with a user name and a password before its host."""
    start = at
    while start and text[start - 1] in SCHEME:
        start -= 1
    m = re.compile(r"://[^\s/:@\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.\[\]:-]+(?:[/?#][^\s\"'<>]*)?").match(text, at)
    return (start, m.end()) if m and start < at else None


def find_spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive; those of one kind don't overlap."""
    found: dict[str, list[tuple[int, int]]] = {}
    n = len(text)
    at_end = ip_end = card_end = phone_end = iban_end = run_end = 0
    cue_end = {"login_url": 0, "account": 0, "secret": 0}
    add = lambda kind, span: found.setdefault(kind, []).append(span)
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= run_end:
                run_end = _run(text, at, DIGITS, n)
                if at >= ip_end:
                    ok, end = _ip(text, at, n)
                    ip_end = end
                    if ok:
                        add("ip", (at, end))
                if at >= card_end:
                    digits, card_end = _card(text, at, n)
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        add("card", (at, card_end))
                if at >= iban_end and at >= 2 and text[at - 1] in UPPER and (end := _iban(text, at - 2, n)):
                    add("iban", (at - 2, end))
                    iban_end = end
        elif kind == "at":
            if span := _email(text, at, at_end, n):
                add("email", span)
                at_end = span[1]
        elif kind == "plus":
            if at >= phone_end and (got := _phone(text, at, n)):
                phone_end = got[0]
                if 9 <= got[1] <= 15:
                    add("phone", (at, got[0]))
        else:
            span = _login(text, at, n) if kind == "scheme" else (_account if kind == "account" else _secret)(text, last + 1, n)
            name = "login_url" if kind == "scheme" else kind
            if span and span[0] >= cue_end[name]:
                add(name, span)
                cue_end[name] = span[1]
    return found


def spans_text(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found.get(k, ()))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: doc_id, a count of each base kind, base_sha256, spans (all kinds).

    A null text counts as empty. Repeated rows give a row each, null ids stay null, an empty table gives no rows, and
    other columns are not read. Spans of different kinds may overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = [find_spans(t.as_py(), anchors) if t.is_valid else {} for t in batch.column(1)]
            counts = [pa.array([len(r.get(k, ())) for r in rows], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(spans_text(r, BASE).encode()).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([spans_text(r, KINDS) for r in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return in_small_batches(source).mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def redact_text(text: str, anchors) -> str:
    """The text with each span, or each chain of overlapping spans, replaced by the name of its first kind in brackets."""
    spans = sorted((a, -b, k) for k, some in find_spans(text, anchors).items() for a, b in some)
    if not spans:
        return text
    out, at, open_to = [], 0, -1
    for a, b, kind in spans:
        if a >= open_to:
            out += [text[at:a] if open_to < 0 else text[open_to:a], f"[{kind.upper()}]"]
            open_to = -b
        else:
            open_to = max(open_to, -b)
    return "".join(out) + text[open_to:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with personal data in the text replaced; null texts stay null."""
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            new = pa.array([redact_text(t.as_py(), anchors) if t.is_valid else None for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return in_small_batches(docs).mapInArrow(run, schema)
