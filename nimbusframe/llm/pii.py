"""Operator 4: personal data by patterns, validators and context, in DataFrame functions only.

Regular expressions propose spans of four base kinds and of two added kinds. Validators
confirm them (parts of an address within 255, Luhn for cards, the count of digits of phone
numbers, mod-97 for account numbers, tried at every end of a word from 15 to 34 characters) and words near a span raise or lower its score. Base spans that
pass their validator are always reported, with their score; spans of added kinds are reported from
THRESHOLD on.

A span's place follows from the pieces that splitting by its pattern leaves: the starts are
running sums of the lengths of pieces and matches. Patterns use possessive
repeats and may start only where a run of their characters starts (or where the last match ended), which
finds the same leftmost matches without backtracking over long runs.

Defined cases: null and empty texts have no spans, zero counts and the hash of nothing.
Offsets are code points, ends exclusive. Spans of one kind never overlap; spans of
different kinds may. Repeated rows and null ids are all returned. Other columns are ignored by
``find`` and kept by ``redact``, which replaces overlapping spans once, under the kind of the
first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.llm.common import table

#: Parameters: code points looked at on either side of a span; the score from which added kinds are reported.
NEAR, THRESHOLD = 40, 0.7
#: Characters in a page and items in a run: long texts and lists are handled in such pieces.
PAGE, RUN = 1024, 128
#: Words near a span that speak for a number of another kind: they lower its score.
AGAINST = r"serial|tracking|checksum|\bsku\b|part no|version|example"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this can't have a match of the pattern; empty: no such test.
    quick: str
    base: bool
    start_score: float
    context: str


_MAIL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, r"mail|contact|write to|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "", True, 0.7, r"card|visa|credit|debit|payment|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, r"phone|tel|call|mobile|fax|cell"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}", "", False, 0.7, r"iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.4, r"ssn|social security|tax id"),
)
#: An account number's head; the kind's pattern is what a text must have at least.
HEAD = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
#: Countries' lengths, which decide between several ends that pass mod-97.
LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda s, i: add(s, i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, letters A-Z as 10-35 and its head moved to the end, leaves 1 modulo 97."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), step) == 1


def account(ahead: Column) -> Column:
    """The account number that text from a head on begins with; null if none passes mod-97."""
    bare = lambda s: F.length(F.regexp_replace(s, " ", ""))

    def best(h: Column) -> Column:
        usual = F.substring(F.lit(LENGTHS), F.instr(F.lit(LENGTHS), F.substring(h["ahead"], 1, 2)) + 2, F.lit(2))
        usual = F.when(F.contains(F.lit(LENGTHS), F.substring(h["ahead"], 1, 2)), usual.cast("int")).otherwise(F.lit(0))
        groups, n = h["groups"], F.size(h["groups"])
        ends = F.when(h["whole"], n).otherwise(n - 1)  # the last group ends before a letter or digit: it can't be an end
        tries = F.transform(F.sequence(F.lit(0), ends), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        passing = F.filter(tries, lambda s: F.when(bare(s).between(15, 34), mod97(s)).otherwise(False))
        return bind(passing, lambda p: F.coalesce(F.get(F.filter(p, lambda s: bare(s) == usual), F.lit(0)), F.get(p, F.size(p) - 1)))

    def head(h: Column) -> Column:
        whole = ~F.substring(h["ahead"], F.length(h["run"]) + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        return bind(F.struct(h["ahead"].alias("ahead"), F.split(h["run"], " ").alias("groups"), whole.alias("whole")), best)

    run = lambda t: F.struct(t.alias("ahead"), F.regexp_extract(t, "^[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){0,30}+", 0).alias("run"))
    return bind(ahead, lambda t: bind(run(t), head))


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        short = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return match.isNotNull()
    return F.lit(True)


SPAN = "array<struct<kind:string,rank:int,start:long,end:long,score:double>>"


def pages(text: Column) -> Column:
    """A text in pieces of PAGE characters: a place in it is found without reading it from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on, of a text in pieces."""

    def part(at: Column) -> Column:
        first = F.floor(at["start"] / PAGE).cast("int")
        last = F.floor((at["start"] + at["length"]) / PAGE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (at["start"] % PAGE).cast("int") + 1, F.greatest(at["length"], F.lit(0)).cast("int"))

    return bind(F.struct(start.cast("long").alias("start"), length.cast("long").alias("length")), part)


def runs_of(items: Column) -> Column:
    """An array in runs of RUN, so that lists are built from lists that stay short."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0))), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))


def spans_of(text: Column, rank: int) -> Column:
    """The spans of one kind, in order."""
    k = KINDS[rank]
    none = F.array().cast(SPAN)
    pattern = HEAD if k.name == "iban" else k.pattern
    # One more piece than there are matches.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    zero = F.lit(0).cast("long")

    def step(so_far: Column, x: Column, pieces: Column) -> Column:
        start, go_on = so_far["pos"] + F.length(x["piece"]), so_far["pos"] + F.length(x["piece"]) + F.coalesce(F.length(x["found"]), F.lit(0))
        found = x["found"]
        if k.name == "iban":
            found = F.when(found.isNotNull() & (start >= so_far["last"]), account(cut(pieces, start, F.lit(68))))
        good = bind(found, lambda f: F.when(f.isNotNull() if k.name == "iban" else valid(k.name, f), f))  # null unless the validator confirms it
        spans = bind(F.struct(start.alias("start"), good.alias("found")), lambda m: F.when(m["found"].isNotNull(), scored(m["start"], m["start"] + F.length(m["found"]), pieces)).otherwise(none))
        return bind(spans, lambda s: F.struct(
            go_on.alias("pos"), F.coalesce(F.get(s, F.lit(0))["end"], so_far["last"]).alias("last"),
            F.when(F.size(s) > 0, F.concat(so_far["spans"], s)).otherwise(so_far["spans"]).alias("spans"),
        ))

    def scored(start: Column, end: Column, pieces: Column) -> Column:
        """The span as a list; an empty one if its score is too low to report."""
        before = F.least(start, F.lit(NEAR))
        near = F.lower(F.concat_ws(" ", cut(pieces, start - before, before), cut(pieces, end, F.lit(NEAR))))
        move = lambda t: F.when(t.rlike(k.context), F.lit(0.3 if not k.base else 0.2)).otherwise(F.lit(0.0)) - F.when(t.rlike(AGAINST), F.lit(0.3)).otherwise(F.lit(0.0))
        score = bind(near, lambda t: F.round(F.greatest(F.least(F.lit(k.start_score) + move(t), F.lit(1.0)), F.lit(0.0)), 1))
        one = lambda x: F.array(F.struct(F.lit(k.name).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), x.alias("score"))).cast(SPAN)
        return bind(score, one) if k.base else bind(score, lambda x: F.when(x >= THRESHOLD, one(x)).otherwise(none))

    def walk(pieces: Column) -> Column:
        # Each step copies its state: a run's spans are listed by themselves.
        def add(s: Column, run: Column) -> Column:
            own = F.aggregate(run, F.struct(s["pos"].alias("pos"), s["last"].alias("last"), none.alias("spans")), lambda t, x: step(t, x, pieces))
            return bind(own, lambda t: F.struct(t["pos"].alias("pos"), t["last"].alias("last"), F.concat(s["lists"], F.array(t["spans"])).alias("lists")))

        state = F.struct(zero.alias("pos"), zero.alias("last"), F.array().cast(f"array<{SPAN}>").alias("lists"))
        return F.flatten(F.aggregate(bind(parts, runs_of), state, add)["lists"])

    some = text.rlike(k.pattern) if not k.quick else F.contains(text, F.lit(k.quick)) & text.rlike(k.pattern)
    return F.when(some, bind(pages(text), walk)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the column __spans: kind, rank, start, end and score, by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[spans_of(text, k) for k in range(len(KINDS))])
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))))
    return docs.withColumn("__spans", ordered)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, and n_chars after that if there is one."""
    text = F.col("text")

    def step(so_far: Column, s: Column, pieces: Column) -> Column:
        gap = cut(pieces, so_far["pos"], s["start"] - so_far["pos"])
        more = F.concat(so_far["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        skip = s["start"] < so_far["pos"]
        return F.struct(F.greatest(so_far["pos"], s["end"]).alias("pos"), F.when(skip, so_far["parts"]).otherwise(more).alias("parts"))

    def walk(pieces: Column) -> Column:
        def add(s: Column, run: Column) -> Column:
            own = F.aggregate(run, F.struct(s["pos"].alias("pos"), F.array().cast("array<string>").alias("parts")), lambda t, x: step(t, x, pieces))
            return bind(own, lambda t: F.struct(t["pos"].alias("pos"), F.concat(s["lists"], F.array(F.array_join(t["parts"], ""))).alias("lists")))

        state = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("lists"))
        done = F.aggregate(runs_of(F.col("__spans")), state, add)
        return bind(done, lambda d: F.concat(F.array_join(d["lists"], ""), cut(pieces, d["pos"], F.length(text) - d["pos"])))

    clean = F.when(F.size("__spans") > 0, bind(pages(text), walk)).otherwise(text)
    out = find(docs).withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["rank"] < 4)
    count = lambda k: F.size(F.filter("__spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("__spans")).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
