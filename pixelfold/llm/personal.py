"""Personal data: proposed by patterns, confirmed by checksums, weighed by context words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import let

# Characters before a span that may hold a context word.
CONTEXT = 48
# What may stand between the entries of a list that shares one context word: no words but these.
LISTING = r"(?i)\A(?:[^\p{L}]|\b(?:and|or|und|oder|et|ou|y|o)\b)*+\z"
# Score from which a span of the method counts.
ACCEPT = 0.5

EMAIL_CHARS = "A-Za-z0-9._%+-"
# Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the check sum: every second one from the right doubled, cross sums added."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + _luhn_part(
        F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_part(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def mod97(account: Column) -> Column:
    """Whether an account number is 1 modulo 97, its first four characters moved to the end, letters counting from 10."""
    plain = F.regexp_replace(account, "[^A-Za-z0-9]", "")
    moved = F.upper(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))))
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substr(moved, i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))
    return rest == 1


def _counts(hit: Column, low: int, high: int) -> Column:
    return F.length(_digits(hit)).between(low, high)


def _card(hit: Column, low: int = 14) -> Column:
    return F.when(_counts(hit, low, 19), luhn(_digits(hit))).otherwise(False)


def _address(hit: Column) -> Column:
    return hit.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z")


@dataclass(frozen=True)
class Detector:
    """``confirm`` turns a hit into true or false; ``score`` is what a confirmed hit has, ``context`` adds ``bonus``.

    With ``passed`` the hit is the first group, seen ahead, and the pattern takes
    only so many characters; hits may then overlap, and the first confirmed one counts.
    """

    kind: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    bonus: float = 0.3
    base: bool = True
    passed: int | None = None


def _iban() -> str:
    """An account number cut to its country's length; one that does not end there is taken as far as it goes."""
    sized = [rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items()]
    other = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({'|'.join([*sized, other])}))[A-Z]{{2}}[0-9]{{2}}"


# A run of characters is entered only at its start or where the last hit ended, and repeated parts are possessive: the
# same hits as without, in time linear in the text.
DETECTORS = (
    Detector("email", rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
             lambda h: F.lit(True), 0.7, r"(?i)\b(?:e-?mail|mail|contact|write|correo|kontakt)"),
    Detector("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", _address, 0.6, r"(?i)\b(?:ip|address|host|server|login)\b"),
    Detector("card", r"[0-9](?:[ -]?[0-9])++", _card, 0.7, r"(?i)\b(?:card|visa|credit|carte|tarjeta|karte)"),
    Detector("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda h: _counts(h, 10, 15), 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax)"),
    Detector("iban", _iban(),
             lambda h: F.when(F.length(F.regexp_replace(h, " ", "")).between(15, 34), mod97(h)).otherwise(False), 0.7,
             r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)", base=False, passed=4),
    Detector("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,12}+(?![ -]?[0-9])", lambda h: _card(h, 12), 0.3,
             r"(?i)\b(?:card|visa|credit|carte|tarjeta|karte)", base=False),
    Detector("phone", r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
             lambda h: F.lit(True), 0.3, r"(?i)\b(?:phone|tel|call|mobile|fax)", base=False),
    Detector("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
             lambda h: ~h.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0.3, r"(?i)\b(?:ssn|social security)", base=False),
)
KINDS = tuple(dict.fromkeys(d.kind for d in DETECTORS))
# Hits worked on together; what is appended to stays this short.
BLOCK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, detector: Detector) -> Column:
    """Confirmed hits of one pattern in order.

    The pattern splits the text; positions add up from the lengths of what stands
    between the hits and of what the pattern took.  A hit is near a context word if
    one stands between it and the hit before, or if it goes on a list whose first hit is.
    """
    gaps = F.split(text, detector.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0 if detector.passed is None else 1))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, part: Column) -> Column:
        gap, hit = part["0"], part["1"]
        start = state["at"] + F.length(gap)
        end = start + F.length(hit)
        between = F.substr(gap, state["rest"] + 1)
        listed = state["near"] & (F.length(between) <= CONTEXT) & F.right(between, F.lit(CONTEXT)).rlike(LISTING)
        near = F.right(between, F.lit(CONTEXT)).rlike(detector.context) | listed
        score = F.lit(detector.score) + F.when(near, detector.bonus).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(detector.kind)).alias("rank"), end.alias("end"),
                        F.lit(detector.kind).alias("kind"), score.alias("score"))
        good = F.when(hit.isNull(), False).otherwise(detector.confirm(hit))
        if not detector.base:
            good = F.when(good, score >= ACCEPT).otherwise(False)
        if detector.passed is not None:
            good = good & (start >= state["free"])
        whole = F.coalesce(F.length(hit), F.lit(0))
        taken = whole if detector.passed is None else F.least(whole, F.lit(detector.passed))
        return F.struct((start + taken).alias("at"), (whole - taken).alias("rest"), near.alias("near"),
                        F.when(good, end).otherwise(state["free"]).alias("free"),
                        F.when(good, F.concat(state["out"], F.array(span.cast(SPAN)))).otherwise(state["out"]).alias("out"))

    def state(of: Column | None, out: Column) -> Column:
        start = {"at": F.lit(0), "rest": F.lit(0), "near": F.lit(False), "free": F.lit(0)}
        return F.struct(*[(v if of is None else of[n]).alias(n) for n, v in start.items()], out.alias("out"))

    def block_by_block(parts: Column) -> Column:
        """Every block appends to an array of its own, so none grows with the text."""
        def block(before: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)), state(before, none), step)
            return let(inner, lambda after: state(after, F.concat(before["out"], F.array(after["out"]))))

        blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, state(None, F.array().cast(f"array<array<{SPAN}>>")), block, lambda s: F.flatten(s["out"]))

    found = let(F.arrays_zip(gaps, hits), block_by_block)
    return F.when(text.rlike(detector.pattern), found).otherwise(none)


def _extents(spans: Column) -> Column:
    """Spans by start in blocks, each with its first start and last end."""
    def block(s: Column, k: Column) -> Column:
        return let(F.slice(s, k * BLOCK + 1, F.lit(BLOCK)), lambda p: F.struct(
            p[0]["start"].alias("lo"), F.array_max(F.transform(p, lambda x: x["end"])).alias("hi"), p.alias("spans")))

    kind = f"array<struct<lo:int,hi:int,spans:array<{SPAN}>>>"
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: block(s, k))
    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(F.array().cast(kind))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id, base, spans), arrays of (start, rank, end, kind, score) by start, then kind.

    Positions count code points, the end is exclusive; null is an empty text.
    ``base`` holds the confirmed hits of the base patterns, leftmost and
    non-overlapping per kind, whatever their score.  ``spans`` adds hits of the
    further patterns whose score, raised by a context word shortly before them or
    before the list they stand in, reaches the limit and that overlap no base hit.  Repeated rows are looked at
    alike; an empty table gives an empty result.  Other columns are not looked
    at.  Only built-in functions are used.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(id_col, *[_spans(F.col("text"), d).alias(f"s{i}") for i, d in enumerate(DETECTORS)])
    base = F.array_sort(F.concat(*[F.col(f"s{i}") for i, d in enumerate(DETECTORS) if d.base]))
    more = F.concat(*[F.col(f"s{i}") for i, d in enumerate(DETECTORS) if not d.base])
    split = found.select(id_col, base.alias("base"), more.alias("more"))
    meets = lambda m, lo, hi: (lo < m["end"]) & (m["start"] < hi)
    clear = let(_extents(F.col("base")), lambda extents: F.filter("more", lambda m: ~F.exists(
        extents, lambda e: meets(m, e["lo"], e["hi"]) & F.exists(e["spans"], lambda b: meets(m, b["start"], b["end"])))))
    return split.select(id_col, "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, values): the text of every span, cut from the whole text."""
    spans = F.col("spans")
    found = find_personal_data(docs.select(F.struct(id_col, text_col).alias("row"), F.col(text_col).alias("text")), "row", "text")
    return found.select(F.col("row")[id_col].alias(id_col), "spans", F.transform(spans, lambda s: F.substr(
        F.col("row")[text_col], s["start"] + 1, s["end"] - s["start"])).alias("values"))
