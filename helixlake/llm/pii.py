"""Personal data and secrets in texts, with built-in functions only.

Regular expressions propose spans; validators confirm them (the Luhn sum for cards, mod 97 and the country's length for IBANs,
ranges for addresses and social security numbers, digit counts for phones, the mix of letters and digits for secrets); context
words of four languages in the neighbourhood raise the score. The four base kinds are always kept, whatever their score;
the added kinds are kept from `min_score` on, which an IBAN reaches by its checksum, a social security number or a secret (a
token, key or password) only beside a context word.

All expressions are linear in the text but for folding the matches of one kind in one text. Defined
results: a null or empty text has no spans; matches of one kind don't overlap (leftmost first); spans of
different kinds may; texts are read whole; repeated rows are repeated. `find` replaces a column of the name that it
adds; `redact` adds none, and no other column is touched.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import table

# The base patterns. A lookbehind or \G where a run of the first class must begin, and
# possessive repeats where nothing could be given back, keep them linear and match the same spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
# A known country's IBAN ends at its length, so that words after it stay out; of other countries the length is not known.
_OTHER = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
_APART, _ENDS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
IBAN = f"{_APART}(?:{'|'.join([*_KNOWN, _OTHER])}){_ENDS}"
SSN = f"{_APART}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_ENDS}"
SECRET = f"{_APART}[A-Za-z0-9_]{{20,}}+"
#: Kinds in the order of output, what a text must hold to be searched, and the starts of words that raise a
#: score, in English, French, German and Spanish.
KINDS = {
    "email": (EMAIL, "@", "mail|contact|write|courriel|kontakt|schreib|correo|contacto"),
    "ip": (IP, r"[0-9]\.[0-9]", "ip|address|host|server|adresse|serveur|dirección|servidor"),
    "card": (CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "card|visa|mastercard|credit|payment|carte|paiement|karte|zahlung|tarjeta|pago"),
    "phone": (PHONE, r"\+[0-9]", "phone|call|tel|mobile|fax|appel|portable|anruf|handy|llama|móvil"),
    "iban": (IBAN, "[A-Z]{2}[0-9]{2}", "iban|account|bank|transfer|compte|banque|virement|konto|überweis|cuenta|banco"),
    "ssn": (SSN, "[0-9]-[0-9]", "ssn|social security|sécurité sociale|sozialversicherung|seguridad social"),
    "secret": (SECRET, "[A-Za-z0-9_]{20}", "token|secret|password|passwd|pwd|api|auth|bearer|access|private|credential|key|jeton|mot de passe|clé|passwort|kennwort|schlüssel|geheim|contraseña|clave"),
}
BASE = ("email", "ip", "card", "phone")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
#: Code points on either side of a span in which context words count, and what they add to the score.
NEARBY, CONTEXT = 40, 0.3
SPAN = "array<struct<start:int,end:int,match:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    each = F.transform(F.split(F.reverse(x), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: letters count 10 to 35, the first four go last."""
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(m, r"\."), lambda p: part(p) & (F.ltrim(p, F.lit("0")).try_cast("int").isNull() | (F.ltrim(p, F.lit("0")).try_cast("int") <= 255)))
    if kind == "card":
        return F.length(digits(m)).between(13, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        plain, country = F.replace(m, F.lit(" "), F.lit("")), F.substring(m, 1, 2)
        right = [country.isin(*c.split()) & (F.length(plain) == n) for n, c in IBAN_LENGTHS.items()]
        known = country.isin(*" ".join(IBAN_LENGTHS.values()).split())
        return F.when(known, functools.reduce(operator.or_, right)).otherwise(F.length(plain).between(15, 34)) & mod97(plain)
    if kind == "ssn":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    if kind == "secret":
        # Words and names have few digits, numbers few letters, dates and versions few borders between the two.
        borders = F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]++", "0"), "[^0]", ""))
        return (F.length(m) <= 512) & (F.length(digits(m)) >= 3) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 3) & (borders >= 3)
    return F.lit(True)


def matches(kind: str, text: Column) -> Column:
    """All matches of a kind's pattern with their code points: what stands between them gives the places."""
    pattern, needs, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["gap"])
        end = at + F.length(x["match"])
        return F.struct(F.coalesce(end, at).alias("at"), F.when(x["match"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct(at.alias("start"), end.alias("end"), x["match"].alias("match"))))).alias("spans"))

    spans = F.aggregate(both, start, step, lambda a: a["spans"])
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(SPAN))


def _kept(kind: str, whole: Column, min_score: float) -> Column:
    """The validated and scored spans of one kind."""
    near = rf"(?:^|[^a-z0-9])(?:{KINDS[kind][2]})"

    def scored(s: Column) -> Column:
        around = F.substring(whole, F.greatest(F.lit(1), s["start"] + 1 - NEARBY), s["end"] - F.greatest(F.lit(0), s["start"] - NEARBY) + NEARBY)
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(F.lower(around).rlike(near), CONTEXT).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    kept = F.transform(F.filter(F.col(f"__pii_{kind}"), lambda s: valid(kind, s["match"])), scored)
    return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= min_score)


def find(docs: DataFrame, *, text: str = "text", min_score: float = 0.5, out: str = "pii") -> DataFrame:
    """Add `out`: array of (kind, start, end, score), by kind as listed and then by start; end is exclusive."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # Each kind's matches are a column of their own, so that no expression is computed twice.
    proposed = docs.withColumns({f"__pii_{k}": matches(k, whole) for k in KINDS})
    kinds = [_kept(k, whole, min_score) for k in KINDS]
    return proposed.withColumn(out, F.concat(*kinds)).drop(*(f"__pii_{k}" for k in KINDS))


def redact(docs: DataFrame, *, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Put `[kind]` in the place of every span of a text; of overlapping spans the first gives the name."""
    found = find(docs, text=text, min_score=min_score, out="__pii")
    spans = F.array_sort(F.col("__pii"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])
        new = F.concat(a["done"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["done"]).alias("done"))

    rest = lambda a: F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, F.length(text)))
    return found.withColumn(text, F.when(F.size("__pii") > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col(text))).drop("__pii")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    added = [k for k in KINDS if k not in BASE]
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *map(count, added), F.size("pii").cast("long").alias("n_spans"))
