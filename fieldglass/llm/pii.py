"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks on the matched text (Luhn, mod-97, check letters, lengths, ranges) confirm
them, and words nearby (in the gap before and after, up to 40 code points each) raise or lower a score from 0 to 1. The
base kinds email, ip, card and phone stay whatever their score; the others (account numbers, national numbers, dates of
birth, keyed secrets) need LEAST, so that those with a weak check need a word nearby that speaks for them.

Spans of a kind come from the text's own split: between the gaps that `split` returns lie the matches that
`regexp_extract_all` returns, so that a running sum of lengths gives code point offsets. Running sums are taken in three
levels of CHUNK elements, so that a text with a million matches costs some forty additions a match and no square of
them. The patterns repeat groups possessively, which matches the same text and needs no recursion on long matches; a
look-behind starts each run of characters once. Texts of any length are searched whole.

Null text counts as empty and has no span. Repeated rows give repeated rows; an empty table gives an empty one; other
columns are kept; one named pii, and those whose names begin with __pii, are dropped first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the output; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "nir", "dni", "birth", "secret"]
BASE = KINDS[:4]

# Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "VA": 22, "VG": 24,
}
# The letter of a Spanish identity number by its rest of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def iban_pattern() -> str:
    """Every country's code, check digits and its number of characters, so that words after an account number are not part of it."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    each = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?:{each})(?![A-Za-z0-9])"


# What proposes a span. \G lets a run begin where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "nir": r"(?<![0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])",
    "dni": r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Z](?![0-9A-Za-z])",
    "birth": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\x22']?\x20?[:=]\x20?[\x22']?[A-Za-z0-9+/_.~-]{12,}+|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
}
# A cheap test that a text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "+", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-", "nir": r"[0-9](?:\x20?[0-9]){14}", "dni": "[0-9]{8}-?[A-Z]", "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "secret": "(?i)password|passwd|secret|token|key|AKIA|gh[pousr]_"}
# Words nearby that speak for a kind.
CONTEXT = {
    "email": "mail|contact|write|address|correo|courriel",
    "ip": "ip|host|server|address|network|gateway",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|insurance|tax",
    "nir": "insee|nir|social|sécu|secu|assur",
    "dni": "dni|nif|identidad|documento",
    "birth": "born|birth|dob|geboren|geburt|né le|née le|naissance|nacid|nacimiento",
    "secret": "login|credential|auth|access|config|key",
}
# Words nearby that speak against every kind.
AGAINST = "version|isbn|issn|invoice|order|example|sample|dummy"
#: Code points before and after a span that may hold context words; the score of a confirmed span by kind, what a word for or against it adds, and the score that a span beyond the base kinds needs.
WINDOW, BOOST, PENALTY, LEAST = 40, 0.4, -0.2, 0.5
PRIOR = {"email": 0.6, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.6, "ssn": 0.3, "nir": 0.5, "dni": 0.4, "birth": 0.2, "secret": 0.6}
#: Lengths summed at a time.
CHUNK = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits pass the mod-97 check of an account number."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    return (rest == 1) & F.length(bare).between(15, 34)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "phone"):
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.length(digits).between(12, 19) & luhn(digits) if kind == "card" else F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "nir":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return 97 - F.substring(digits, 1, 13).cast("long") % 97 == F.substring(digits, 14, 2).cast("long")
    if kind == "dni":
        letters = F.array(*[F.lit(c) for c in DNI_LETTERS])
        return F.element_at(letters, (F.substring(m, 1, 8).cast("int") % 23 + 1).cast("int")) == F.right(m, F.lit(1))
    if kind == "birth":
        parts = F.transform(F.split(m, "[./-]"), lambda p: p.cast("int"))
        one, two = F.when(F.get(parts, F.lit(0)) > 31, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
        return F.greatest(one, two).between(1, 31) & F.least(one, two).between(1, 12)
    if kind == "secret":
        value = F.regexp_replace(m, r"^[^:=]*+[:=][\x20\x22']*+", "")
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def chunk_sums(lengths: Column) -> Column:
    """The sum of each CHUNK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda i: total(F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK))))


def running(lengths: Column, before: Column) -> Column:
    """Sums of what stands before each element, from the sums before each chunk."""
    return F.transform(lengths, lambda x, i: F.get(before, F.floor(i / CHUNK).cast("int")) + total(F.slice(lengths, F.floor(i / CHUNK).cast("int") * CHUNK + 1, (i % CHUNK).cast("int"))))


def before_chunks(chunks: Column) -> Column:
    """Sums of what stands before each of few elements."""
    return F.transform(chunks, lambda x, i: total(F.slice(chunks, F.lit(1), i)))


def spans_of(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Adds a column __pii_<kind> with the kind's confirmed spans: array of (start, ord, end, kind, score)."""
    c, own = F.col(text), lambda x: F.col(f"__pii_{x}")

    def named(df: DataFrame, name: str, value: Column, need: str | None = None) -> DataFrame:
        # Columns that a lambda reads are named, lest the optimiser put their expressions into it.
        return df.withColumn(f"__pii_{name}", value if need is None else F.when(F.size(own(need)) > 0, value))

    maybe = c.rlike(HINTS[kind]) if len(HINTS[kind]) > 1 else F.contains(c, F.lit(HINTS[kind]))
    df = df.withColumn("__pii_m", F.when(maybe, F.regexp_extract_all(c, F.lit(PATTERNS[kind]), 0)))
    df = named(df, "s", F.split(c, PATTERNS[kind], -1), "m")
    df = df.withColumn("__pii_g", F.transform(own("s"), lambda g: F.length(g)))
    df = df.withColumn("__pii_l", F.transform(own("m"), lambda m: F.length(m)))
    # What a match and the gap before it take together; its end is the sum of these up to it.
    df = named(df, "w", F.zip_with(F.slice(own("g"), F.lit(1), F.size(own("m"))), own("l"), lambda g, x: g + x), "g")
    df = named(df, "c", chunk_sums(own("w")), "w")
    df = named(df, "d", chunk_sums(own("c")), "c")
    df = named(df, "e", before_chunks(own("d")), "d")
    df = named(df, "f", running(own("c"), own("e")), "e")
    df = named(df, "b", running(own("w"), own("f")), "f")
    start = lambda i: F.get(own("b"), i) + F.get(own("g"), i)
    near = lambda i: F.concat(F.right(F.get(own("s"), i), F.lit(WINDOW)), F.lit(" "), F.left(F.get(own("s"), i + 1), F.lit(WINDOW)))
    speaks = lambda i, words, by: F.when(near(i).rlike(rf"(?i)(?<![a-z])(?:{words})"), by).otherwise(0.0)
    score = lambda m, i: F.when(confirmed(kind, m), F.lit(PRIOR[kind]) + speaks(i, CONTEXT[kind], BOOST) + speaks(i, AGAINST, PENALTY))
    span = F.transform(own("m"), lambda m, i: F.struct(start(i).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (start(i) + F.get(own("l"), i)).cast("int").alias("end"), F.lit(kind).alias("kind"), F.round(score(m, i), 2).alias("score")))
    keep = F.filter(span, lambda s: s["score"].isNotNull() if kind in BASE else s["score"] >= LEAST)
    return named(df, kind, keep, "b").drop(*[f"__pii_{x}" for x in "msglwcdefb"])


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds pii: array of (start, ord, end, kind, score) by start, then kind."""
    df = df.drop(*[c for c in df.columns if c.lower() == "pii" or c.lower().startswith("__pii")]).withColumn("__pii_text", F.coalesce(F.col(column), F.lit("")))
    for kind in KINDS:
        df = spans_of(df, kind, "__pii_text")
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")
    found = [F.coalesce(F.col(f"__pii_{k}"), none) for k in KINDS]
    return df.withColumn("pii", F.array_sort(F.concat(*found))).drop("__pii_text", *[f"__pii_{k}" for k in KINDS])


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, what an earlier one leaves is replaced."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    walk = F.aggregate(
        spans,
        empty,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.when(s["start"] > a["at"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).otherwise(F.lit("")), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("parts"))
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.lit(2147483647))),
    )
    return F.when(F.size(spans) > 0, walk).otherwise(text)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, all spans, their number and their scores in the same order, for every row."""
    df = find_pii(df.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["ord"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), scores)
