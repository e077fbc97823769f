"""Personal data by regular expressions, checksum validators and context words, in built-in functions only.

Base kinds are e-mail addresses, IPv4 addresses, card numbers (14 to 19 digits that pass Luhn) and international phone
numbers (10 to 15 digits): leftmost non-overlapping matches, of which those that fail their validator are dropped. The
patterns are written so that Java's engine neither recurses nor restarts inside a run: loops are possessive, and a match
begins at the start of a run or where the last match ended, which accepts the same spans as the plain patterns.

Further proposals are stricter shapes with a score: card numbers that stand in a longer run of digits (Luhn), IBANs
(mod 97), US social security numbers and national phone numbers. Words near a proposal raise or lower its score; those
that reach ``ACCEPT`` and overlap no base span are added.

Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows get a row each. Positions are
sums over the gaps that ``split`` leaves between the matches, in chunks, so that cost is linear in the matches of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
KINDS = BASE + EXTRA
ACCEPT = 0.5
#: Code points before and after a proposal in which words count.
NEAR = 40
CHUNK = 128

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
SCREEN = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Kind, pattern, screen, validator, score without context, words for and against it.
PROPOSALS = [
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7})(?![0-9])", r"[0-9](?:[\x20-]?[0-9]){12}", "luhn", 0.6, r"card|visa|mastercard|amex|credit|debit", r"isbn|order|serial|tracking|version"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", "mod97", 0.8, r"iban|account|bank|konto", r"part no|serial"),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "none", 0.4, r"ssn|social|security|taxpayer", r"part|order|version|ref"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.)-]", "none", 0.3, r"call|phone|telephone|tel|mobile|fax|cell", r"order|isbn|version|part"),
]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """True where the digits of ``v`` pass the Luhn test."""
    back = F.reverse(_digits(v))

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(v: Column) -> Column:
    """True where ``v`` without blanks passes ISO 7064 mod 97-10, first four characters last."""
    flat = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))

    def step(a: Column, i: Column) -> Column:
        x = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return (a * F.when(x < 10, 10).otherwise(100) + x) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _located(matches: Column, gaps: Column) -> Column:
    """Spans of matches: array of (start, end, v). ``gaps`` are the pieces between them, first piece first."""
    pair = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("v")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda c: F.slice(pair, c * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(matches) > 0, chunks)


_SPAN = "array<struct<start:int,end:int,v:string>>"


def _placed(chunks: Column) -> Column:
    total = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, x: a + x["gap"] + x["long"]))
    bases = F.aggregate(total, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def place(chunk: Column, base: Column) -> Column:
        empty = F.struct(base.alias("at"), F.array().cast(_SPAN).alias("out"))

        def add(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            return F.struct((start + x["long"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + x["long"]).alias("end"), x["v"].alias("v")))).alias("out"))

        return F.aggregate(chunk, empty, add, lambda a: a["out"])

    return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), place))


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x["v"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0)) <= 255))
    n = F.length(_digits(x["v"]))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(x["v"])).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _context(text: Column, x: Column, good: str, bad: str) -> Column:
    """What the whole words around a proposal, or their plurals, add to its score."""
    from_ = F.greatest(x["start"] - NEAR, F.lit(0))
    near = F.lower(F.concat(F.substring(text, from_ + 1, x["start"] - from_), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(NEAR))))
    whole = lambda words: rf"(?<![a-z])(?:{words})s?(?![a-z])"
    return F.when(near.rlike(whole(good)), 0.3).otherwise(0.0) - F.when(near.rlike(whole(bad)), 0.4).otherwise(0.0)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii: array of (start, rank, end, kind, score, base), by start and then by kind as in ``KINDS``."""
    given = [c for c in docs.columns if c != "pii"]
    t = F.col("__t")
    df = docs.select(*given, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    jobs = [(k, PATTERNS[k], SCREEN[k]) for k in BASE] + [(f"x{i}", p[1], p[2]) for i, p in enumerate(PROPOSALS)]
    df = df.withColumns({f"__m_{k}": F.when(t.rlike(screen), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))) for k, pattern, screen in jobs})
    df = df.withColumns({f"__c_{k}": F.when(F.size(F.col(f"__m_{k}")) > 0, _located(F.col(f"__m_{k}"), F.split(t, pattern, -1))) for k, pattern, _ in jobs})
    df = df.withColumns({f"__s_{k}": F.when(F.col(f"__c_{k}").isNotNull(), _placed(F.col(f"__c_{k}"))) for k, _, _ in jobs})
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>")

    def shaped(x: Column, kind: str, score: Column, base: bool) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.cast("double").alias("score"), F.lit(base).alias("base"))

    base_score = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6}

    def confirmed(kind: str) -> Column:
        valid = F.filter(F.col(f"__s_{kind}"), lambda x: _valid(kind, x))
        return F.coalesce(F.transform(valid, lambda x: shaped(x, kind, F.lit(base_score[kind]), True)), none)

    df = df.withColumn("__base", F.array_sort(F.concat(*[confirmed(k) for k in BASE])))

    def proposed(i: int) -> Column:
        kind, _, _, check, score, good, bad = PROPOSALS[i]
        ok = {"luhn": luhn, "mod97": mod97, "none": lambda v: F.lit(True)}[check]
        free = F.filter(F.col(f"__s_x{i}"), lambda x: ok(x["v"]) & ~F.exists(F.col("__base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        scored = F.transform(free, lambda x: shaped(x, kind, F.lit(score) + _context(t, x, good, bad), False))
        return F.coalesce(F.filter(scored, lambda x: x["score"] >= ACCEPT), none)

    more = [proposed(i) for i in range(len(PROPOSALS))]
    pii = F.when((F.size("__base") > 0) | F.coalesce(*[F.when(F.size(F.col(f"__s_x{i}")) > 0, True) for i in range(len(PROPOSALS))], F.lit(False)), F.array_sort(F.concat(F.col("__base"), *more))).otherwise(none)
    return df.select(*given, pii.alias("pii"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    df = find(docs.select("doc_id", "text")).select("doc_id", "pii", F.filter("pii", lambda x: x["base"]).alias("base"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping spans by the first one's), and the column
    ``length``, if there is one, brought up to date. Texts without spans stay as they are."""
    found = find(docs.withColumn("__own", F.col("pii")) if "pii" in docs.columns else docs, text)
    t = F.col(text)

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when(x["start"] < last["end"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(x)))

    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")))
    plain = F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    merged = found.withColumn("__runs", F.when(F.size("pii") > 0, F.aggregate(plain, first, add)))
    runs = F.col("__runs")
    pieces = F.transform(F.slice(runs, F.lit(2), F.size(runs) - 1), lambda x, i: F.concat(F.substring(t, F.get(runs, i)["end"] + 1, x["start"] - F.get(runs, i)["end"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    clean = F.when(runs.isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), F.substring(t, F.element_at(runs, -1)["end"] + 1, F.length(t))))
    out = merged.withColumn("__clean", clean)
    value = {text: F.col("__clean"), "pii": F.col("__own") if "pii" in docs.columns else F.lit(None)}
    if length and length in docs.columns:
        value[length] = F.when(runs.isNull(), F.col(length)).otherwise(F.length("__clean").cast(docs.schema[length].dataType))
    return out.select(*[value[c].alias(c) if c in value else F.col(c) for c in docs.columns])
