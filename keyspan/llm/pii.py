"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn) and phone (10 to 15 digits). The method adds
iban (mod-97), ssn (a US number of a valid range), tel (a national phone number) and secret (a run of letters and digits
whose entropy tells how much of a key it is). Each span has a score; base spans are always kept, added ones from
``LEAST_SCORE``: an ssn, a tel or a secret takes a context word nearby. Offsets are code points, the end exclusive.

Matching is linear in the text: expressions are possessive, and an email is sought from its ``@`` outwards.

Edge cases: a null text is empty and has no spans; repeated rows give equal results; extra columns are kept, and
``spans`` replaces a column of its name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "secret")
BASE = KINDS[:4]
#: Kinds that give way to a span that is there already.
WEAK = ("tel", "secret")
LEAST_SCORE = 0.5
#: Characters either side of a span in which context words count.
NEAR = 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}+={0,2}")
#: Bits (entropy of the characters times their number) from which a run has the full score of a secret.
KEY_BITS = 80
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("call", "phone", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("call", "phone", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "bearer", "credential", "credentials"),
}
#: Score without context and what a context word adds.
SCORE = {"email": (0.8, 0.15), "ip": (0.6, 0.3), "card": (0.85, 0.1), "phone": (0.7, 0.2), "iban": (0.9, 0.05), "ssn": (0.3, 0.4), "tel": (0.35, 0.3), "secret": (0.0, 0.3)}
WORDS = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.IGNORECASE) for kind, words in CONTEXT.items()}


class Span(NamedTuple):
    start: int
    order: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d <<= i & 1
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of a local part, ``@`` and a domain of two labels or more."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield m.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        yield m.span()


def tels(text: str) -> Iterator[tuple[int, int]]:
    for m in TEL.finditer(text):
        yield m.span()


def strength(run: str) -> float:
    """0 to 0.45 by the bits of the characters of ``run``; 0 unless it has letters and digits."""
    if run.isalpha() or run.isdigit() or not (LETTER.search(run) and DIGIT.search(run)):
        return 0.0
    bits = -sum(n * math.log2(n / len(run)) for n in Counter(run).values())
    return 0.45 * min(1.0, bits / KEY_BITS)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        if strength(m[0]):
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns, tels, secrets), strict=True))
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def find(text: str | None) -> list[Span]:
    """All spans, by start and then kind."""
    if not text:
        return []
    found, digit = [], DIGIT.search(text)
    for order, kind in enumerate(KINDS):
        if (kind == "email" and "@" in text) or (kind == "phone" and "+" in text) or (kind not in ("email", "phone") and digit):
            taken = sorted((s.start, s.end) for s in found) if kind in WEAK else []
            starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            for start, end in FINDERS[kind](text):
                if (n := bisect_left(starts, end)) and ends[n - 1] > start:
                    continue
                plain, more = SCORE[kind]
                near = WORDS[kind].search(text, max(0, start - NEAR), start) or WORDS[kind].search(text, end, min(len(text), end + NEAR))
                score = plain + more * bool(near) + (strength(text[start:end]) if near and kind == "secret" else 0.0)
                if kind in BASE or score >= LEAST_SCORE:
                    found.append(Span(start, order, end, score))
    return sorted(found)


def mask(text: str | None, spans: list[Span] | None = None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by ``<KIND>`` of its first."""
    if text is None:
        return None
    out, done = [], 0
    for s in find(text) if spans is None else spans:
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``spans``."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find(t)])

    return appended(docs, {"spans": spans(docs[text].cast("string"))})


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; a null text stays null. Column order is kept."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask)

    return docs.withColumn(text, masked(docs[text].cast("string")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    line = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return docs.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(line, ",").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
