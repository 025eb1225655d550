"""PII: anchor expansion. An Aho-Corasick automaton finds anchors; local parsers expand and validate around them.

Anchors are at-signs, plus signs, digits, scheme marks and identifier cues. Each anchor hands its position to one
parser per kind, which reads left and right of it over a run of characters that belong to the kind, so that the work
is linear in the text. Spans are code points, end exclusive.

Base kinds (leftmost, non-overlapping per kind): email; ip (parts at most 255); card (12 to 19 digits that pass Luhn);
phone (a plus sign and 9 to 15 digits). Added kinds: secret (the value after a credential cue such as password=),
iban (after its cue, mod 97 valid), account (the number after an account, SSN or passport cue, 6 digits at least) and
login (user part of scheme://user@host).

Defined cases: a null or empty text has no spans (and masking leaves it as it is); very long texts are read whole, in
linear time; rows are independent, so ties, repeated rows and empty tables need no care; a column of the input named like
the output is replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import add_columns, table

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "account", "login")
BASE = 4

#: Cues, by what follows them.
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "access_key")
ACCOUNT_CUES = ("account", "acct", "ssn", "social security", "passport", "customer id", "member id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9]++")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"[ ().0-9-]++")
SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9+/_.~!@#$%^&*-]*[A-Za-z0-9+/_~!@#$%^&*-])")
ACCOUNT = re.compile(r"(?:[ \t]+(?:number|no\.?|nr\.?|id))?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,2}[0-9](?:[ -]?[0-9])+)", re.I)
IBAN = re.compile(r"(?:[ \t]+(?:number|no\.?|nr\.?))?[ \t]*[:=#]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s/@]*)?(?=@[A-Za-z0-9])")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    mail_end = ip_end = card_end = phone_end = run_end = 0
    for last, (kind, size) in anchors().iter(text):
        start = last + 1 - size
        if kind == "digit":
            if start >= card_end:
                if m := SPACED.match(text, start):
                    card_end = m.end()
                    d = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(d) <= 19 and luhn(d):
                        out.append((start, 2, card_end))
                else:
                    card_end = start + 1
            if start >= run_end and start >= ip_end:
                if m := DOTTED.match(text, start):
                    ip_end = run_end = m.end()
                    if all(map(_small, m[0].split("."))):
                        out.append((start, 1, ip_end))
                else:
                    run_end = DIGITS.match(text, start).end()
        elif kind == "at":
            left = start
            while left > mail_end and text[left - 1] in LOCAL:
                left -= 1
            if left < start and (m := DOMAIN.match(text, start + 1)):
                mail_end = m.end()
                out.append((left, 0, mail_end))
        elif kind == "plus":
            if start >= phone_end and text[start + 1 : start + 2] in "0123456789" and start + 1 < len(text) and (m := PHONE.match(text, start + 2)):
                body = m[0].rstrip(" ().-")
                if len(body) >= 2:
                    phone_end = start + 2 + len(body)
                    if 9 <= 1 + sum(c.isdigit() for c in body) <= 15:
                        out.append((start, 3, phone_end))
        elif kind == "scheme":
            if start and text[start - 1].isalpha() and (m := LOGIN.match(text, start + 3)):
                out.append((m.start(), 7, m.end()))
        elif start == 0 or not text[start - 1].isalnum():
            end = last + 1
            if kind == "secret":
                if (m := SECRET.match(text, end)) and len(m[1]) >= 6:
                    out.append((m.start(1), 4, m.end(1)))
            elif kind == "iban":
                if m := IBAN.match(text, end):
                    s = m[1].replace(" ", "")
                    if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                        out.append((m.start(1), 5, m.end(1)))
            elif (m := ACCOUNT.match(text, end)) and sum(c.isdigit() for c in m[1]) >= 6:
                out.append((m.start(1), 6, m.end(1)))
    return sorted(set(out))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str | None, spans) -> str | None:
    """The text with each span, or union of overlapping ones, replaced by the name of its first kind."""
    if not spans:
        return text
    out, at, end, name = [], 0, -1, ""
    for a, k, b in spans:
        if a >= end:
            if end >= 0:
                out.append(f"[{name}]")
                at = end
            out.append(text[at:a])
            end, name = b, KINDS[k].upper()
        else:
            end = max(end, b)
    return "".join(out) + f"[{name}]" + text[end:]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(df: DataFrame, text: str = "text", mask: bool = False, out: str = "pii") -> DataFrame:
    """Adds a column of spans and, if mask, replaces the text by its masked form."""
    fields = [T.StructField(out, SPAN)] + [T.StructField(text, T.StringType())] * mask

    def run(texts):
        found = [find_spans(t) for t in texts]
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found]
        return [spans, [masked(t, s) for t, s in zip(texts, found, strict=True)]] if mask else [spans]

    return add_columns(df, [text], fields, run)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    spell = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:BASE]))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("pii")).alias("spans"))
