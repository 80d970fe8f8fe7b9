"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them give every match its place: pieces and
matches alternate, so running lengths are positions, in code points. The patterns below match what the plain
forms of the contract match, written so that no start inside a run is tried twice (look-behind, ``\\G`` where the
last match ended) and with possessive loops, so that long runs need neither quadratic time nor deep stacks.

Kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits), and this method's own: iban (mod-97), imei (15 digits,
Luhn) and ssn (three groups of digits, none of them unassigned). A confirmed span starts from its kind's score; a context word of the kind
within 40 characters on either side adds to it. Own spans below the threshold go: an iban's checksum is enough, an imei or ssn needs
a context word, since one in ten numbers passes Luhn and any nine digits so grouped look like an ssn. Base spans always stay.

Defined results: a null or empty text has no spans, empty span lists and the digest of the empty string. Repeated rows give repeated
results; an empty table gives none. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.scratch import table

BASE = ("email", "ip", "card", "phone")
OWN = ("iban", "imei", "ssn")
KINDS = (*BASE, *OWN)
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "imei": r"(?<![0-9A-Za-z.+-])[0-9]{2}(?:-?[0-9]{6}){2}-?[0-9](?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z.+-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Words that make a kind likelier near its span.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|login|address",
    "card": "card|visa|credit|debit|payment|mastercard",
    "phone": "phone|call|tel|mobile|fax|number",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "imei": "imei|device|handset|mobile|phone|serial",
    "ssn": "ssn|social security|social insurance|taxpayer",
}
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.7, "imei": 0.4, "ssn": 0.4}
NEAR, BONUS, THRESHOLD, RUN = 40, 0.2, 0.5, 64
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the check digit of a string of digits is right."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")

    def step(total, i):
        v = value(i)
        twice = F.when((n - i) % 2 == 1, 2 * v).otherwise(v)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an account number's remainder is 1: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest, i):
        a = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(a >= 65, (rest * 100 + a - 55) % 97).otherwise((rest * 10 + a - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "imei":
        return luhn(_digits(m))
    if kind == "iban":
        code = F.regexp_replace(m, " ", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(text: Column, kind: str) -> Column:
    """All matches of a kind in order: the text before each (p), the match (m), and its end.

    Running lengths go in two steps, within runs of ``RUN`` matches and over runs, so that many matches of one text are no trouble.
    """
    pieces, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = _let(F.struct(pieces.alias("p"), found.alias("m")), lambda s: F.zip_with(F.slice(s["p"], 1, F.size(s["m"])), s["m"], lambda p, m: F.struct(p.alias("p"), m.alias("m"), (F.length(p) + F.length(m)).alias("n"))))
    total = lambda run: F.aggregate(run, F.lit(0), lambda t, x: t + x["n"])

    def ends(runs):
        before = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + total(run))))
        place = lambda start, run: F.transform(run, lambda x, k: F.struct(x["p"].alias("p"), x["m"].alias("m"), (start + total(F.slice(run, 1, k + 1))).alias("end")))
        return _let(before, lambda starts: F.flatten(F.transform(runs, lambda run, c: place(F.get(starts, c), run))))

    cut = lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / RUN).cast("int")), lambda c: F.slice(ps, c * RUN + 1, RUN))
    return _let(pairs, lambda ps: F.when(F.size(ps) == 0, F.array().cast("array<struct<p:string,m:string,end:int>>")).otherwise(_let(cut(ps), ends)))


def spans(text: Column, kind: str) -> Column:
    """The confirmed, scored spans of a kind, by start."""
    none = F.array().cast(SPAN)

    def scored(all_, i):
        x = F.get(all_, i)
        # A match has two characters at least, so NEAR characters hold no more than half as many matches.
        before = F.slice(all_, F.greatest(i - NEAR // 2 + 1, F.lit(1)), F.least(i, F.lit(NEAR // 2)))
        left = F.right(F.concat(F.array_join(F.transform(before, lambda b: F.concat(F.right(b["p"], F.lit(NEAR)), b["m"])), ""), x["p"]), F.lit(NEAR))
        start = x["end"] - F.length(x["m"])
        after = F.slice(all_, i + 2, NEAR // 2)
        right = F.array_join(F.transform(after, lambda b: F.concat(F.left(b["p"], F.lit(NEAR)), F.when(F.length(b["p"]) < NEAR, b["m"]).otherwise(""))), "")
        rest = F.when(F.size(after) < NEAR // 2, F.left(F.substring(text, F.element_at(all_, -1)["end"] + 1, F.lit(NEAR)), F.lit(NEAR))).otherwise("")
        around = F.lower(F.concat(left, x["m"], F.left(F.concat(right, rest), F.lit(NEAR))))
        score = F.lit(START[kind]) + F.when(around.rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), x["end"].alias("end"), score.alias("score"))

    def confirmed(all_):
        numbers = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: _valid(kind, F.get(all_, i)["m"]))
        return F.when(F.size(all_) == 0, none).otherwise(F.transform(numbers, lambda i: scored(all_, i)).cast(SPAN))

    found = _let(placed(text, kind), confirmed)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else F.when(text.rlike(PATTERNS[kind]), found).otherwise(none)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and a column of spans for each kind."""
    body = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = body.select(*keep, "__text", *[spans(F.col("__text"), k).alias(f"__{k}") for k in KINDS])
    return out.withColumns({f"__{k}": F.filter(f"__{k}", lambda s: s["score"] >= THRESHOLD) for k in OWN})


def joined(*columns: str) -> Column:
    """kind:start:end of the columns' spans, joined by commas."""
    return F.array_join(F.transform(F.concat(*columns), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The same rows and columns; confirmed spans give way to their kind in brackets. Of overlapping spans the first holds.

    A text without spans stays as it is, a null text null; the count of characters follows the text.
    """
    names = docs.columns
    found = find(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in names])), text, ("__row",))
    every = F.array_sort(F.transform(F.concat(*[f"__{k}" for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state, s):
        add = F.concat(state["out"], F.substring("__text", state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        first = s["start"] >= state["at"]
        return F.struct(F.when(first, s["end"]).otherwise(state["at"]).alias("at"), F.when(first, add).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("__every", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring("__text", s["at"] + 1, F.length("__text"))))
    out = found.withColumn("__every", every).select("__row", F.when(F.size("__every") > 0, clean).otherwise(F.col("__row").getField(text)).alias("__clean"))
    cast = docs.schema[chars].dataType if chars in names else None
    return out.select(*[(F.col("__clean") if c == text else F.length("__clean").cast(cast) if c == chars else F.col("__row").getField(c)).alias(c) for c in names])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(*[f"__{k}" for k in BASE]), 256).alias("base_sha256"),
        joined(*[f"__{k}" for k in KINDS]).alias("spans"), *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in OWN],
        F.array_join(F.transform(F.concat(*[f"__{k}" for k in KINDS]), lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
