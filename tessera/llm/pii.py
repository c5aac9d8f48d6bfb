"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand and validate them.

Anchors are at-signs, plus signs, digits, URL schemes and identifier cues. Around each anchor a deterministic
parser reads outwards to the boundaries of the address, number or account and validates it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_of

# Characters of addresses and the cues before identifiers and secrets.
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIGIT = frozenset("0123456789")
PHONE = DIGIT | frozenset(" ().-")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "iban", "ssn", "passport", "account number", "account no")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", "0123456789")):
        for w in words:
            out.add_word(w, (kind, 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def _run(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def parse_email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part starts at ``after`` or later."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (far := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = far, dots + 1
    return (start, end) if dots else None


def parse_ip(text: str, at: int) -> tuple[int, bool] | None:
    """(end, valid) of four dotted numbers that begin at the digit ``at``."""
    end, parts = _run(text, at, DIGIT), 1
    first = at
    numbers = [text[first:end]]
    while parts < 4:
        if end >= len(text) or text[end] != "." or (far := _run(text, end + 1, DIGIT)) == end + 1:
            return None
        numbers.append(text[end + 1 : far])
        end, parts = far, parts + 1
    return end, all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in numbers)


def parse_card(text: str, at: int) -> tuple[int, bool] | None:
    """(end, valid) of digits with single spaces or hyphens between them, from the digit ``at``."""
    digits, end, n = [text[at]], at + 1, len(text)
    while end < n:
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT:
            end += 2
        else:
            break
        digits.append(text[end - 1])
    if len(digits) < 2:
        return None
    return end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def parse_phone(text: str, at: int) -> tuple[int, bool] | None:
    """(end, valid) of a number after the plus sign ``at``; its last character is a digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGIT:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGIT:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGIT:
        return None
    return end, 8 <= sum(c in DIGIT for c in text[at:end]) <= 15


URL_END = re.compile(r"[\x00-\x20\"'<>]|\Z")


def url_run(text: str, end: int) -> tuple[int, int]:
    """(where the unbroken text from ``end`` on stops, the last "/~" within it or -1)."""
    stop = URL_END.search(text, end).start()
    return stop, text.rfind("/~", end, stop)


def parse_url_account(text: str, at: int, end: int, stop: int, tilde: int) -> tuple[int, int] | None:
    """A URL that carries a user or account (user@host, or a path part beginning with ~).

    ``end`` is past the scheme; ``stop`` and ``tilde`` are those of the unbroken text it stands in.
    """
    slash = text.find("/", end, stop)
    user = text.find("@", end + 1, stop if slash < 0 else slash)
    return (at, stop) if (user >= 0 or tilde >= end) and stop - end > 2 else None


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    if not (15 <= len(v) <= 34 and v[:2].isalpha() and v[2:4].isdigit() and v.isascii() and v.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def parse_account(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The value after an identifier cue: delimiter, optional quote, at least eight alphanumerics, four of them digits."""
    if at and text[at - 1] in ALNUM:
        return None
    i = end
    while i < len(text) and i < end + 6 and text[i] in " \t:=\"'#":
        i += 1
    if i == end or not any(c in ":=#" for c in text[end:i]):
        return None
    stop = _run(text, i, ALNUM | frozenset("-_"))
    value = text[i:stop]
    if len(value) >= 8 and sum(c in DIGIT for c in value) >= 4:
        if text[at:end].lower() == "iban" and not iban_ok(value):
            return None
        return i, stop
    return None


def find_spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all spans, in kind order, then by start."""
    found: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the next match of a kind may begin
    run = (-1, -1)
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= done[1] and (at == 0 or text[at - 1] not in DIGIT or at == done[1]):
                got = parse_ip(text, at)
                if got:
                    done[1] = got[0]
                    if got[1]:
                        found.append((1, at, got[0]))
                else:
                    done[1] = max(done[1], _run(text, at, DIGIT))
            if at >= done[2]:
                got = parse_card(text, at)
                if got:
                    done[2] = got[0]
                    if got[1]:
                        found.append((2, at, got[0]))
        elif kind == "at":
            got = parse_email(text, at, done[0])
            if got:
                done[0] = got[1]
                found.append((0, *got))
        elif kind == "plus":
            if at >= done[3] and (got := parse_phone(text, at)):
                done[3] = got[0]
                if got[1]:
                    found.append((3, at, got[0]))
        elif kind == "scheme":
            if last + 1 > run[0]:
                run = url_run(text, last + 1)
            if at >= done[4] and (got := parse_url_account(text, at, last + 1, *run)):
                done[4] = got[1]
                found.append((4, *got))
        elif at >= done[5] and (got := parse_account(text, at, last + 1)):
            done[5] = got[1]
            found.append((5, *got))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        all_spans = [find_spans(t, anchors) for t in batch.column(1).to_pylist()]
        kind = pa.array([[s[0] for s in x] for x in all_spans], pa.list_(pa.int32()))
        start = pa.array([[s[1] for s in x] for x in all_spans], pa.list_(pa.int64()))
        end = pa.array([[s[2] for s in x] for x in all_spans], pa.list_(pa.int64()))
        base = [[s for s in x if s[0] < 4] for x in all_spans]
        sha = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), kind, start, end, sha, pa.array(map(joined, all_spans), pa.string())], ["id", "kind", "start", "end", "base_sha256", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal-data spans of each row: id, kind/start/end arrays (code points, end exclusive), base_sha256, spans.

    One row per input row. A null or empty text has no spans; whole texts of any length are searched; repeated rows
    give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    src = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return src.mapInArrow(_work, "id long, kind array<int>, start array<long>, end array<long>, base_sha256 string, spans string")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``pii_spans``: counts of the four base kinds, base_sha256 and spans."""
    s = pii_spans(docs, id_col, text_col)

    def count(kind: int):  # a second lambda parameter would be the element's index
        return F.size(F.filter("kind", lambda k: k == kind)).cast("long").alias(f"n_{BASE_KINDS[kind]}")

    counts = [count(i) for i in range(len(BASE_KINDS))]
    return s.select(F.col("id").alias(id_col), *counts, "base_sha256", "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """Each row's text with the spans replaced by the kind's mark (overlapping spans as one): id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                parts, at = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b in find_spans(t, anchors)):
                    if a >= at:
                        parts += [t[at:a], mark.format(KINDS[k])]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    src = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return src.mapInArrow(work, "id long, text string").toDF(id_col, text_col)
