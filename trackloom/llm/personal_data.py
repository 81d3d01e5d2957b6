"""Personal data: regular expressions propose spans, checksum validators confirm them, nearby context words move the score.

Every kind has a pattern, a validator and context words. Kinds of the base set are kept whenever their validator holds;
the further kinds are kept when their score, moved by the context, reaches a threshold. Spans of one kind are leftmost
and do not overlap; a span that fails its validator is dropped and the search goes on behind it, for account numbers inside it. Offsets are code points,
the end is exclusive.

Defined results: a null or empty text has no spans; repeated rows are judged row by row; an empty table gives an empty
result; texts of any length are scanned whole in linear time; no other column is read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import map_arrow, of_kind

KINDS = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from all others, so each is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")

IBAN_LENGTHS = {c: n for n, x in (
    (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ TL"),
    (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU"), (31, "MT SC"), (32, "LC"),
) for c in x.split()}
#: Words that make a kind likelier when they stand near it.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "cvv"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "bank", "account", "konto", "transfer", "bic"), "ssn": ("ssn", "social", "security", "taxpayer"),
}
_WORDS = {kind: frozenset(words) for kind, words in CONTEXT.items()}
#: Words of a context: whole ones, with hyphens inside.
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: Scores before the context: patterns with a checksum start higher.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35}
BOOST, WINDOW, THRESHOLD = 0.35, 40, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The account number with its first four characters moved to the end, letters as 10 to 35, leaves 1."""
    value = 0
    for c in iban[4:] + iban[:4]:
        value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return value == 1


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    """Proposals can run on into words in capitals, so all ends of tokens are tried: first the country's length, then from the longest."""
    m = _IBAN.search(text)
    while m:
        begin, end = m.span()
        ends, n = [], 0
        for i in range(begin, end):
            n += text[i] != " "
            if n >= 15 and text[i] != " " and (i + 1 == end or text[i + 1] == " "):
                ends.append((n == IBAN_LENGTHS.get(m[0][:2]), i + 1))
        stop = next((e for _, e in sorted(ends, reverse=True) if mod97(text[begin:e].replace(" ", ""))), None)
        if stop:
            yield begin, stop
        # The next one can begin inside what was proposed.
        m = _IBAN.search(text, stop or begin + 1)


def ssns(text: str):
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(text: str, kind: str, begin: int, end: int) -> float:
    near = (text[max(0, begin - WINDOW) : begin] + " " + text[end : end + WINDOW]).lower()
    return min(1.0, PRIOR[kind] + BOOST * (not _WORDS[kind].isdisjoint(_WORD.findall(near))))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the kept spans, by kind in order, then by start."""
    if not text:
        return []
    out = []
    for kind in (*KINDS, *FURTHER):
        for begin, end in FINDERS[kind](text):
            s = score(text, kind, begin, end)
            if kind in KINDS or s >= THRESHOLD:
                out.append((kind, begin, end, round(s, 4)))
    return out


def scan_personal_data(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and ``found``: an array of (kind, start, end, score). Narrow, no shuffle."""
    columns = docs.select(*keep, F.col(text_col).alias("_text_to_scan"))
    schema = docs.select(*keep).withColumn("found", F.lit(None).cast("array<struct<kind:string,start:long,end:long,score:double>>")).schema

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, to_arrow_type(schema["found"].dataType))], names=schema.names)

    return map_arrow(columns, work, schema)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets; same columns. Overlapping spans are cut as one, under the kind of the first by start."""

    @F.pandas_udf("string")
    def cut(texts):
        import pandas as pd

        return pd.Series([masked(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cut(F.col(text_col)))


def masked(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, begin, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if begin >= at:
            out += [text[at:begin], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op6(spark, sf_dir) -> DataFrame:
    found = scan_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("found", lambda x: x["kind"].isin(list(KINDS)))
    return found.select(
        "doc_id", *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"),
        F.transform("found", lambda x: x["score"]).alias("scores"),
    )
