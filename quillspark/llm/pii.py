"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

DataFrame functions only. Base kinds: e-mail addresses, IPv4 addresses, card numbers with a
Luhn check digit, phone numbers. The method adds IBANs (mod 97). Patterns use possessive
repeats and never recurse, so a long text costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, text_or_empty

_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]++"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind: (pattern, a cheap test that any match needs, words that speak for it, score without them)
KINDS = {
    # (?<!..)|\G: only the start of a run of local characters, or where the last match ended, can begin the leftmost match
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}(?:\.{_HOST})++", "@", "e-?mail|mail|contact|courriel|correo|kontakt", 0.8),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|host|server|address|adresse|login", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "card|visa|master|amex|credit|debit|carte|tarjeta|karte", 0.7),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|cell|telefon|appel", 0.6),
    # only the start: what follows may be another account number, so _ibans tries every end
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", None, "iban|bank|account|konto|compte|cuenta", 0.9),
}
BASE = ("email", "ip", "card", "phone")
#: Characters of an IBAN by country; among ends that pass mod 97 this one wins, then the longest.
IBAN_SIZES = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
CONTEXT = 48
CONTEXT_BONUS = 0.1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check for 12 to 19 digits, padded on the left to 19."""
    d = F.lpad(digits, 19, "0")
    twice = F.translate(d, "0123456789", "0246813579")
    total = sum(((twice if k % 2 else d).substr(k + 1, 1).cast("int") for k in range(19)), F.lit(0))
    return F.length(digits).between(12, 19) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """The check of an IBAN without spaces: its characters moved and read as a number leave 1 by 97."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), F.left(iban, F.lit(4)))

    def step(rest, c):
        value = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
}


def _located(kind: str) -> Column:
    """array<struct<start int, text string>> of a pattern's matches, in code points.

    Splitting at the pattern gives what lies between the matches; the lengths give the places.
    """
    found = F.col(f"m_{kind}")
    gaps = F.split(F.col("text"), KINDS[kind][0], -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.when(x["text"].isNull(), acc).otherwise(F.struct((start + F.length(x["text"])).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), x["text"].alias("text"))).alias("out")))

    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda acc: acc["out"]))


def _ibans(starts: Column) -> Column:
    """The located starts of IBANs -> those that pass mod 97 at some end of a group, whole; they don't overlap."""
    sizes = F.create_map(*(F.lit(x) for n, codes in IBAN_SIZES.items() for code in codes.split() for x in (code, n)))

    def whole(p):
        tail = F.col("text").substr(p["start"] + 1, F.lit(2 * 34))
        ends = F.transform(F.array(tail), lambda t: F.array(*(F.regexp_extract(t, rf"^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])", 0) for n in range(11, 31))))[0]
        good = F.filter(ends, lambda x: (x != "") & CHECKS["iban"](x))
        fits = lambda x: F.coalesce(F.length(F.replace(x, F.lit(" "), F.lit(""))) == sizes[F.left(x, F.lit(2))], F.lit(False))
        best = F.array_max(F.transform(good, lambda x: F.struct(fits(x).alias("fits"), F.length(x).alias("n"), x.alias("text"))))
        return F.struct(p["start"].alias("start"), best["text"].alias("text"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc, p):
        end = p["start"] + F.length(p["text"])
        return F.when(p["text"].isNull() | (p["start"] < acc["at"]), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], p).alias("out")))

    return F.when(F.size(starts) > 0, F.aggregate(F.transform(starts, whole), empty, step, lambda acc: acc["out"]))


def _passes(kind: str):
    return lambda p: CHECKS[kind](p["text"])


def _scored(no: int, kind: str):
    """A located match -> its span; a hint word within CONTEXT characters raises the score."""
    _, _, hints, score = KINDS[kind]

    def span(p):
        end = p["start"] + F.length(p["text"])
        before = F.greatest(p["start"] - CONTEXT, F.lit(0))
        near = F.concat_ws(" ", F.col("text").substr(before + 1, p["start"] - before), F.col("text").substr(end + 1, F.lit(CONTEXT)))
        bonus = F.when(F.lower(near).rlike(rf"\b(?:{hints})"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(p["start"].alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), (F.lit(score) + bonus).alias("score"))

    return span


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ``keep`` and ``spans``: array<struct<start, kind_no, end, kind, score>>, sorted.

    Starts and ends are code points, ends exclusive. Matches of a kind are leftmost and don't
    overlap; those of the base kinds that fail their check are dropped without another try, an
    IBAN is tried at every end of a group. Null texts are empty
    and have no spans; rows are handled one by one, so repeated rows and null ids stay.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), *keep)
    matches = []
    for kind, (pattern, needs, _, _) in KINDS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        matches.append((F.when(F.contains("text", F.lit(needs)), found) if needs else found).alias(f"m_{kind}"))
    rows = rows.select("*", *matches)
    rows = rows.select("doc_id", "text", *keep, *(_located(k).alias(f"p_{k}") for k in KINDS)).withColumn("p_iban", _ibans(F.col("p_iban")))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>")
    spans = [F.coalesce(F.transform(F.filter(f"p_{kind}", _passes(kind)), _scored(no, kind)), none) for no, kind in enumerate(KINDS)]
    return rows.select("doc_id", "text", *keep, F.array_sort(F.concat(*spans)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all), scores of all spans."""
    found = find_spans(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``min_score`` or more replaced by its kind in brackets.

    Overlapping spans become one, named after the first. ``n_chars``, if there, is counted
    anew where the text changed; null texts stay null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = find_spans(docs.select("doc_id", "text", F.struct("text", *quoted(others)).alias("row")), keep=("row",))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.array(F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], piece).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    strong = F.filter("spans", lambda s: s["score"] >= min_score)
    clean = F.aggregate(strong, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("text").substr(acc["at"] + 1, F.length("text"))))
    clean = F.when(F.col("row.text").isNotNull(), F.when(F.size(strong) > 0, clean).otherwise(F.col("text")))
    out = found.select("doc_id", clean.alias("text"), F.col("row"))
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.when(F.col("text").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias(c))
        else:
            columns.append(F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c))
    return out.select(*columns)
