"""Personal data and secrets: expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds count whatever their score. Others count from MIN_SCORE on: IBANs (mod-97), social security
numbers (valid ranges and a context word), keys in the published formats of their issuers, and passwords
and other secrets, which are long mixed strings or what is assigned to a password, near a context word.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, bounded_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
#: Kinds that count whatever the words around them.
BASE = KINDS[:4]
MIN_SCORE = 0.5
#: Score of a confirmed span before its context, and the words within REACH code points that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "key": 0.7, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"),
    "key": ("key", "token", "secret", "aws", "github", "auth"), "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "credential", "credentials", "auth", "bearer"),
}
REACH, BOOST = 40, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs, and starts only where a run of digits starts: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 "
    "MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 "
    "SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Published prefixes and lengths of keys and tokens, and the head of a private key.
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
_KEY_PARTS = ("AKIA", "ASIA", "gh", "sk", "xox", "AIza", "eyJ", "PRIVATE KEY")
_LONG = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd)\"?'?[ ]{0,3}[:=][ ]{0,3}[\"']?([^\s\"',;]{6,64})(?![^\s\"',;])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_WORD = re.compile("[a-z]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the base kinds: leftmost and not overlapping within each kind, no retries."""
    found = [("email", s, e) for s, e in _emails(text)]
    m = _DIGIT.search(text)
    if m:
        near = m.start()
        found += [("ip", *x.span()) for x in _IP.finditer(text, near) if all(map(_small, x[0].split(".")))]
        for x in _CARD.finditer(text, near):
            if x.end() - x.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", x[0])) <= 19 and luhn(d):
                found.append(("card", *x.span()))
        if "+" in text:
            found += [("phone", *x.span()) for x in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", x[0])) <= 15]
    return found


def _ibans(text: str):
    """Spans that mod-97 confirms: at the country's length or as long as they go; of other countries the
    longest that ends with a group."""
    at = 0
    while m := _IBAN.search(text, at):
        at, whole = m.start() + 1, m[0]
        ends = [i for i in range(len(whole), 0, -1) if whole[i : i + 1] in ("", " ") and i - whole.count(" ", 0, i) >= 15]
        if size := _LENGTHS.get(whole[:2]):
            ends = [i for i in ends if i - whole.count(" ", 0, i) == size] + ends[:1]
        if end := next((i for i in ends if mod97(whole[:i])), 0):
            at = m.start() + end
            yield m.start(), at


def _secrets(text: str):
    """Spans of keys, then of passwords and long strings of letters and digits that lie in none of them."""
    taken = [("key", *m.span()) for m in _KEY.finditer(text)] if any(p in text for p in _KEY_PARTS) else []
    low = text.lower()
    if any(w in low for w in CONTEXT["secret"]):
        taken += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)] if "pass" in low or "pwd" in low else []
        known = {i for _, s, e in taken for i in (s, e)}
        for m in _LONG.finditer(text):
            if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]) and m.start() not in known and m.end() not in known:
                taken.append(("secret", *m.span()))
    return taken


def added_spans(text: str) -> list[tuple[str, int, int]]:
    found = _secrets(text)
    if _DIGIT.search(text):
        found += [("iban", *x) for x in _ibans(text)]
        found += [("ssn", *x.span()) for x in _SSN.finditer(text) if x[0][:3] not in ("000", "666") and x[0][0] != "9" and x[0][4:6] != "00" and x[0][7:] != "0000"]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    return min(1.0, PRIOR[kind] + BOOST * any(w in CONTEXT[kind] for w in _WORD.findall(near)))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind: base kinds always, others from MIN_SCORE."""
    if not text:
        return []
    order = {k: i for i, k in enumerate(KINDS)}
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in base_spans(text) + added_spans(text)]
    return sorted((x for x in scored if x[0] in BASE or x[3] >= MIN_SCORE), key=lambda x: (x[1], order[x[0]], x[2]))


def redact(text: str | None) -> str | None:
    """The text with each group of overlapping spans replaced by the name of its first."""
    if not text or not (spans := find_spans(text)):
        return text
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end in code points, score) of every whole text.

    Null and empty texts have none; null ids stay null; repeated rows are searched each; extra columns
    are ignored; an empty table gives an empty result. Time is linear in a text's length. No shuffle: rows
    are independent.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, the list of all spans, their number and their
    scores in the same order, by document. Documents without spans have empty lists and the hash of none;
    null ids stay null, repeated rows stay, an empty table gives an empty result."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.concat_ws(",", F.transform("spans", lambda s: F.format_string("%.1f", s["score"]))).alias("scores"))


def redact_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with the spans in the text replaced by their kinds and the length renewed.

    Null and empty texts, and those without spans, stay as they are, with their length; repeated rows stay;
    an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    name = OWN + "redacted"

    def run(batches):
        for b in batches:
            texts = pa.array([redact(t) for t in b.column(b.num_columns - 1).to_pylist()], b.schema.field(b.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=b.schema.names)

    rows = docs.withColumn(name, F.col(text_col))
    rows = rows.mapInArrow(run, rows.schema)
    new = {text_col: F.col(name)}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col(text_col).eqNullSafe(F.col(name)), F.col(chars_col)).otherwise(F.char_length(name)).cast(docs.schema[chars_col].dataType)
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
