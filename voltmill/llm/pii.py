"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Column functions only. Quantifiers are possessive where a match cannot give anything back, so the engine neither recurses nor
backtracks over long texts, and a run of letters is entered at its start alone. Each text is searched where it lies; nothing is
shuffled. The work on a text grows with its length and its matches, not with their product: running positions are added up in
runs of ``RUN`` matches, and what lies around a match is put together from its neighbours instead of being cut from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of the base kinds, in Java's notation, and the checks on their matches
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# added kinds
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

#: kind: pattern, score of a match that passes its check, words that raise it by NEAR within WINDOW characters before or after.
KINDS = {
    "email": (EMAIL, 0.9, r"\b(?:e-?mail|mail|contact|write|courriel|correo)\b"),
    "ip": (IP, 0.6, r"\b(?:ip|host|server|address|adresse|login)\b"),
    "card": (CARD, 0.7, r"\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b"),
    "phone": (PHONE, 0.7, r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": (IBAN, 0.7, r"\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": (SSN, 0.3, r"\b(?:ssn|social security|taxpayer)\b"),
}
#: Without this string a text has no match, and the pattern is not tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE = ("email", "ip", "card", "phone")
NEAR, WINDOW, LEAST = 0.3, 48, 0.5
#: Matches that are put into one array before the arrays are joined.
RUN = 256
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, F.lit(1) + n - i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return (F.length(digits) > 0) & (F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces passes its check: the first four characters at the end, A = 10 to Z = 35, remainder 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        # a part may have leading zeros and any length
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(items: Column, first: Column, n: int) -> Column:
    """``n`` items from number ``first`` on, as far as there are. A slice would walk through all of them."""
    last = F.least(first + (n - 1), F.size(items) - 1)
    return F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda k: F.get(items, k))


def _runs(items: Column, state: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """The array that ``step(state, item)`` appends to the field ``out`` of its state. The array of a run is short, so appending is
    cheap; ``state`` also has ``all``, the arrays of the runs before. ``items`` is bound by ``_let``, else each use would compute it."""
    own = f"array<{out}>"

    def run(before: Column, first: Column) -> Column:
        return F.aggregate(_part(items, first, RUN), F.struct(before["at"].alias("at"), F.array().cast(own).alias("out")), step, lambda s: F.struct(s["at"].alias("at"), F.concat(before["all"], F.array(s["out"])).alias("all")))

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    start = F.struct(state.alias("at"), F.array().cast(f"array<{own}>").alias("all"))
    return F.aggregate(firsts, start, run, lambda s: F.flatten(s["all"]))


def _spans(text: Column, kind: str) -> Column:
    """The matches of a kind that pass its check and reach the least score, in order. Offsets are in code points, the end exclusive.

    What lies between matches comes from a split by the same pattern, so a match begins after as many characters as the pieces
    and the matches before it have. A match has four characters or more, so its ``WINDOW`` characters before and after lie in
    so many neighbours.
    """
    pattern, score, words = KINDS[kind]
    reach = WINDOW // 4 + 1
    none = F.array().cast(SPANS)

    def located(matches: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("m"))  # one more gap than matches
        start = F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"))
        place = "struct<m:string,start:int,before:string,head:string>"

        def step(s: Column, x: Column) -> Column:
            m = F.coalesce(x["m"], F.lit(""))
            first = s["at"]["end"] + F.length(x["gap"])
            here = F.struct(x["m"].alias("m"), first.alias("start"), F.right(F.concat(s["at"]["tail"], x["gap"]), F.lit(WINDOW)).alias("before"), F.left(F.concat(x["gap"], m), F.lit(WINDOW)).alias("head"))
            tail = F.right(F.concat(s["at"]["tail"], x["gap"], m), F.lit(WINDOW))
            return F.struct(F.struct((first + F.length(m)).alias("end"), tail.alias("tail")).alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

        return _let(pairs, lambda p: _let(_runs(p, start, step, place), scored))

    def scored(places: Column) -> Column:
        numbered = F.transform(places, lambda x, i: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["before"].alias("before"), i.alias("i")))
        passed = F.filter(numbered, lambda x: x["m"].isNotNull() & _passes(kind, x["m"]))

        def span(x: Column) -> Column:
            ahead = F.array_join(F.transform(_part(places, x["i"] + 1, reach), lambda y: y["head"]), "")
            around = F.concat(x["before"], F.lit(" "), F.left(ahead, F.lit(WINDOW)))
            raised = F.when(F.rlike(F.lower(around), F.lit(words)), NEAR).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(score) + raised, F.lit(1.0)).alias("score"))

        return F.filter(F.transform(passed, span), lambda x: x["score"] >= LEAST).cast(SPANS)

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))
    return F.when(F.contains(text, F.lit(NEEDS.get(kind, ""))), found).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start, end and score of each piece of personal data, by kind in the order of ``KINDS``, then start.

    Each kind is searched by itself, leftmost and non-overlapping; a match that fails its check is dropped whole and nothing inside
    it is tried again. Spans of different kinds may overlap. Null and empty texts have none. A column named spans gives way.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("spans", F.concat(*(_spans(t, kind) for kind in KINDS)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets, overlapping spans by the first one's. Null stays null.

    Other columns, repeated rows and empty texts stay as they are.
    """
    found = find_pii(docs.withColumnRenamed("spans", "_own_spans"), text)
    t = F.col(text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    nothing = F.array().cast("array<string>")

    def put(state: Column, s: Column) -> Column:
        """``text``: the part of the text that the spans of this run lie in, which begins at ``base``."""
        piece = F.array(F.substring(state["text"], state["at"] - state["base"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        clear = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["base"].alias("base"), state["text"].alias("text"), F.when(clear, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    def cleaned(spans: Column) -> Column:
        def run(state: Column, first: Column) -> Column:
            own = _part(spans, first, RUN)
            base = state["at"]
            part = F.substring(t, base + 1, F.array_max(F.transform(own, lambda s: s["end"])) - base)
            return F.aggregate(own, F.struct(base.alias("at"), base.alias("base"), part.alias("text"), nothing.alias("out")), put, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(s["out"], ""))).alias("out")))

        start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(RUN)), start, run, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(t, s["at"] + 1)))

    clean = F.when(F.size("spans") > 0, _let(ordered, cleaned)).otherwise(t)
    done = found.withColumn(text, clean).drop("spans").withColumnRenamed("_own_spans", "spans")
    return done.select(*docs.columns)
