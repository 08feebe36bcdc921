"""Personal data: patterns propose, checksums confirm, context adjusts (operator 9).

Every kind is searched in time linear in the text: runs that a pattern could be tried from at each of their
characters are taken whole and cut as the leftmost, longest matches would be.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds by contract.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
# Kinds that the method adds; their spans need a score of THRESHOLD.
MORE = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
)
#: Score of a proposed span of an added kind, by itself and with its checksum confirmed.
PRIOR = {"iban": 0.2, "ssn": 0.4, "local_phone": 0.4}
CONFIRMED = 0.6
#: What a context word within WINDOW characters adds, and what a word against takes.
CONTEXT_GAIN, CONTEXT_LOSS, WINDOW, THRESHOLD = 0.3, 0.3, 48, 0.6
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social", "tax id", "taxpayer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "part no", "figure")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 10 <= len(_digits(s)) <= 15


_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(BASE[3][1])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address holds one @, before which its local part reaches back as far as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots make an address by fours, from the first on."""
    for m in _NUMBERS.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def _plain(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


_FIND = {"email": _emails, "ip": _ips, "card": _plain(_GROUPED), "phone": _plain(_PHONE)}
_SOUND = {"email": lambda s: True, "ip": _ip, "card": _card, "phone": _phone}
_TRIGGER = {"email": "@", "phone": "+"}
_DIGIT = re.compile("[0-9]")


#: Lengths of IBANs by country.
IBAN_LENGTH = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
        "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 "
        "VA22 VG24 XK20"
    ).split()
}


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN with a right checksum ends that starts at ``start``; 0 if there is none.

    The pattern takes what follows in upper case or digits along, so the end at the country's length is tried
    first. Other shorter ends are not: one in 97 would pass by chance.
    """
    whole, n = end, len(text[start:end].replace(" ", ""))
    while n > IBAN_LENGTH.get(text[start : start + 2], 99):
        end = max(start, text.rfind(" ", start, end))
        n = len(text[start:end].replace(" ", ""))
    if n == IBAN_LENGTH.get(text[start : start + 2]) and mod97(text[start:end]):
        return end
    return whole if 15 <= len(text[start:whole].replace(" ", "")) <= 34 and mod97(text[start:whole]) else 0


def proposals(kind: str, pattern: re.Pattern, text: str):
    """(start, end) of the spans of an added kind, before they are scored, leftmost and non-overlapping."""
    at = 0
    while m := pattern.search(text, at):
        start, end = m.span()
        if kind == "iban":
            end = iban_end(text, start, end)
        if end:
            yield start, end
        at = end or start + 1  # what follows a span that is none, or a shorter one, is looked at again


def score(kind: str, text: str, start: int, end: int) -> float:
    """How likely a proposed span of an added kind is personal data."""
    found = text[start:end]
    value = PRIOR[kind]
    if kind == "iban":
        if not 15 <= len(found.replace(" ", "")) <= 34 or not mod97(found):
            return 0.0
        value = CONFIRMED
    elif kind == "ssn" and (found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000"):
        return 0.0
    around = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    value += CONTEXT_GAIN * any(w in around for w in CONTEXT[kind])
    value -= CONTEXT_LOSS * any(w in around for w in AGAINST)
    return value


#: The kinds of a span by its number, and the added kinds with their patterns.
KINDS = [k for k, _ in (*BASE, *MORE)]
_MORE = [(k, re.compile(p)) for k, p in MORE]


def spans(text: str, base=tuple(k for k, _ in BASE), more=tuple(_MORE)) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points, ordered by start and then kind.

    Base kinds: leftmost, non-overlapping, kept if their check holds. Added kinds: kept if their score
    reaches THRESHOLD and no base span overlaps them.
    """
    has_digit = _DIGIT.search(text) is not None
    found = []
    for k, kind in enumerate(base):
        if _TRIGGER.get(kind, "") in text and (has_digit or kind == "email"):
            found += ((s, k, e) for s, e in _FIND[kind](text) if _SOUND[kind](text[s:e]))
    if has_digit:
        # Where base spans lie, joined where they overlap: the last that begins before an end tells.
        starts, ends = [], []
        for s, _, e in sorted(found):
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        for k, (kind, pattern) in enumerate(more, len(base)):
            for start, end in proposals(kind, pattern, text):
                before = bisect_left(starts, end)
                if score(kind, text, start, end) >= THRESHOLD - 1e-9 and not (before and ends[before - 1] > start):
                    found.append((start, k, end))
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """Personal data in every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (over the base spans as
    ``kind:start:end``, comma-joined) and spans (the same with the added kinds). A null text counts as
    empty: no spans, and the digest of the empty string. Rows come back as often as they come in, null
    doc_ids too; no rows give no rows. The data themselves are not returned.
    """
    kinds = KINDS

    def run(batches):
        for b in batches:
            counts, digests, joined = [[] for _ in BASE], [], []
            for t in b.column(1):
                found = spans(t.as_py() or "")
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in found))
                named = [(k, f"{kinds[k]}:{s}:{e}") for s, k, e in found]
                digests.append(hashlib.sha256(",".join(x for k, x in named if k < len(BASE)).encode()).hexdigest())
                joined.append(",".join(x for _, x in named))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; other columns stay. Null texts stay null."""

    def one(text):
        if text is None:
            return None
        out, at = [], 0
        for s, k, e in spans(text):
            if s >= at:
                out += [text[at:s], mark.format(KINDS[k])]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array([one(t.as_py()) for t in b.column(i)], pa.string()))

    return docs.mapInArrow(run, docs.schema)
