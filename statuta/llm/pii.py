"""Operator 4: personal data.

Regular expressions propose spans, checksums (Luhn, mod-97) confirm them and words nearby
adjust the score. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: Words this near (code points before the span) adjust its score.
CONTEXT_CHARS = 48
ACCEPT_AT = 0.5


@dataclass(frozen=True)
class Kind:
    """pattern: possessive, so that long texts need no deep recursion, and equal in what it
    finds to the plain pattern; needs: a character without which there is no match."""

    name: str
    pattern: str
    needs: str
    prior: float
    near: str
    base: bool = True


# Characters of an IBAN by country, of those that have one.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


def _iban() -> str:
    """As many characters as the country's IBANs have, in groups of four that one blank may part;
    a following word is never taken in."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    rest = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    forms = "|".join(rf"(?:{'|'.join(cs)})[0-9]{{2}}{rest(n)}" for n, cs in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?:{forms})(?![A-Za-z0-9])"


_LOCAL = "A-Za-z0-9._%+-"
KINDS = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|kontakt|contact|correo"),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.8, "card|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, "phone|call|tel|mobile"),
    Kind("iban", _iban(), "", 0.6, "iban|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.35, r"ssn|social security", False),
    Kind("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "A", 0.9, "key|secret|token|aws", False),
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn test."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, -i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("double")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x["double"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """True if the ISO 13616 check digits are right."""
    c = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4))
    total = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: F.when(x == "", a).when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return total == 1


def confirmed(kind: str, m: Column) -> Column:
    """Whether a proposed match is what its kind says."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _found(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, end, kind, score) of one kind.

    The pieces between matches and the matches, both in order, give the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    gaps = F.split(text, kind.pattern, -1)
    both = F.arrays_zip(gaps.alias("gap"), whole.alias("m"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("got"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind.name).alias("kind"), x["m"].alias("text")))
        return F.struct(e.alias("at"), F.when(x["m"].isNotNull() & confirmed(kind.name, x["m"]), F.concat(acc["got"], one)).otherwise(acc["got"]).alias("got"))

    folded = F.aggregate(both, start, step, lambda acc: acc["got"])
    may = F.instr(text, kind.needs) > 0 if kind.needs else text.rlike("[0-9]{2}" if kind.name == "iban" else "[0-9]")
    return F.when(may, folded).otherwise(empty)


def _score(text: Column, s: Column) -> Column:
    """The kind's prior, a checksum's bonus, and a bonus for a context word before the span."""
    prior, near = F.lit(0.0), F.lit("(?!)")
    for k in KINDS:
        prior = F.when(s["kind"] == k.name, k.prior).otherwise(prior)
        near = F.when(s["kind"] == k.name, k.near).otherwise(near)
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))))
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | ((s["kind"] == k.name) & before.rlike(k.near))
    check = F.when(s["kind"].isin("card", "iban"), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), prior + check + F.when(hit, 0.2).otherwise(0.0))


def find(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """docs with an array of (start, rank, end, kind, text, score) of the accepted spans in order.

    Null texts count as empty. Base kinds (email, ip, card, phone) are kept whatever their
    score; the others need ACCEPT_AT. A clashing column name is prefixed with underscores.
    """
    raw, out = free_name(docs, "pii_raw", name)
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(raw, F.array_sort(F.concat(*[_found(body, k, i) for i, k in enumerate(KINDS)])))
    scored = F.transform(F.col(raw), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "text")], _score(body, s).alias("score")))
    base = [k.name for k in KINDS if k.base]
    keep = F.filter(scored, lambda s: s["kind"].isin(base) | (s["score"] >= ACCEPT_AT))
    return df.withColumn(out, F.when(F.size(raw) > 0, keep).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>"))).drop(raw)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, the digest of the base spans, all spans, and how
    many the method added."""
    df = find(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = [k.name for k in KINDS if k.base]
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base_spans = F.filter("pii", lambda s: s["kind"].isin(base))
    return df.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in base], F.sha2(digest(base_spans), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), (F.size("pii") - F.size(base_spans)).cast("long").alias("n_added"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score")
    )
