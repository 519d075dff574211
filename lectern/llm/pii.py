"""Personal data, by DataFrame functions alone.

Regular expressions propose spans, validators (Luhn, mod 97, ranges, lengths)
confirm them, and words near a span raise or lower its score. Starts and ends
are code points: a text is both split at a pattern and searched for it, and the
lengths of the parts and matches before a match add up to its start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, free

#: Score that a span of an added kind needs, and what context words give or take.
LEAST_SCORE, CONTEXT_UP, CONTEXT_DOWN, CONTEXT_CHARS = 0.5, 0.3, 0.3, 48
_AGAINST = r"(?i)\b(?:order|invoice|version|serial|isbn|sku|tracking|example|sample|test|dummy)\b"


@dataclass(frozen=True)
class Kind:
    """pattern proposes; hint is a cheap condition that any match implies; valid confirms; base kinds stay whatever their score."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    words: str
    score: float
    base: bool


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ip(x: Column) -> Column:
    value = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(value(p)) <= 3, F.concat(F.lit("0"), value(p)).cast("int") <= 255).otherwise(False))


def _card(x: Column) -> Column:
    return F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", _digits(x))


def _iban(x: Column) -> Column:
    """Country and check digits go to the end, letters become 10 to 35, and the number leaves 1 modulo 97."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


# The first four are fixed by contract. Possessive repeats and look-behinds change none of their matches: they keep the search linear and off the stack.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True), r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b", 0.8, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _ip, r"(?i)\b(?:ip|host|server|address|addr|client|login)\b", 0.6, True),
    Kind("card", r"[0-9](?:[ \-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[ \-]?[0-9]){11}"), _card, r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\b", 0.7, True),
    Kind("phone", r"\+[0-9][ ().0-9\-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda x: F.length(_digits(x)).between(9, 15), r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|móvil|téléphone)\b", 0.7, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _iban, r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b", 0.8, False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda x: F.lit(True), r"(?i)\b(?:ssn|social security|social-security|tax id|taxpayer)\b", 0.3, False),
)
NONE = "array<struct<start:int,kind:int,end:int,score:double,text:string>>"
_BLOCK = 128


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body reads it."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, start: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array of ints, all items before it joined up; by blocks, so that long arrays don't take quadratic time."""
    fold = lambda part: F.aggregate(part, F.lit(start), join)
    count = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(F.array().cast("array<int>"))

    def of_blocks(v: Column) -> Column:
        blocks = count(F.ceil(F.size(v) / _BLOCK).cast("int"), lambda b: fold(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        return bind(blocks, lambda sums: bind(count(F.size(sums), lambda b: fold(F.slice(sums, F.lit(1), b))), lambda bases: within(v, bases)))

    def within(v: Column, bases: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return count(F.size(v), lambda i: F.aggregate(F.slice(v, block(i) * _BLOCK + 1, i % _BLOCK), F.get(bases, block(i)), join))

    return bind(values, of_blocks)


def _spans(text: Column, number: int, kind: Kind) -> Column:
    def build(x: Column) -> Column:
        hits, parts = x["hits"], x["parts"]

        def span(i: Column, start: Column) -> Column:
            hit = F.get(hits, i)
            near = F.concat_ws(" ", F.right(F.get(parts, i), F.lit(CONTEXT_CHARS)), F.left(F.get(parts, i + 1), F.lit(CONTEXT_CHARS)))
            score = F.lit(kind.score) + F.when(near.rlike(kind.words), CONTEXT_UP).otherwise(0.0) - F.when(near.rlike(_AGAINST), CONTEXT_DOWN).otherwise(0.0)
            begin = start + F.length(F.get(parts, i))
            return F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + F.length(hit)).alias("end"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2).alias("score"), hit.alias("text"))

        every = F.sequence(F.lit(0), F.size(hits) - 1)
        sizes = F.transform(every, lambda i: F.length(F.get(parts, i)) + F.length(F.get(hits, i)))
        made = bind(before(sizes, 0, lambda a, b: a + b), lambda starts: F.transform(starts, lambda s, i: span(i, s)))
        kept = F.filter(made, lambda s: kind.valid(s["text"]) if kind.base else kind.valid(s["text"]) & (s["score"] >= LEAST_SCORE))
        return F.when(F.size(hits) > 0, kept).otherwise(F.array().cast(NONE)).cast(NONE)

    found = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"), F.split(text, kind.pattern, -1).alias("parts"))
    return F.when(kind.hint(text), bind(found, build)).otherwise(F.array().cast(NONE))


def find(df: DataFrame, *, text: str = "text", spans: str = "spans") -> tuple[DataFrame, str]:
    """df with one more column, and that column's name (spans, or the next free name).

    The column is an array of (start, kind, end, score, text) in order of start,
    then of KINDS: code points, end exclusive, kind an index of KINDS. Spans of
    one kind never overlap; those of two kinds may. Null and empty texts have
    none. Rows are handled one by one, all inside the JVM.
    """
    (name,) = free(df, spans)
    t = F.coalesce(col(text), F.lit(""))
    return df.withColumn(name, F.array_sort(F.concat(*(_spans(t, i, k) for i, k in enumerate(KINDS))))), name


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def of_base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < sum(k.base for k in KINDS))


def count_of(spans: Column, name: str) -> Column:
    number = next(i for i, k in enumerate(KINDS) if k.name == name)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def mask(text: Column, spans: Column) -> Column:
    """The text with [EMAIL], [IP] and so on for its spans; of overlapping spans the first stands for all that begin inside of it."""
    t = F.coalesce(text, F.lit(""))
    names = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))

    def build(s: Column) -> Column:
        reach = before(F.transform(s, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))
        kept = bind(reach, lambda r: F.filter(F.transform(s, lambda x, i: F.when(x["start"] >= F.get(r, i), F.struct(F.get(r, i).alias("from"), x["start"].alias("start"), x["kind"].alias("kind")))), lambda x: x.isNotNull()))
        return kept

    pieces = lambda s: F.transform(build(s), lambda x: F.concat(F.substr(t, x["from"] + 1, x["start"] - x["from"]), F.get(names, x["kind"])))
    whole = bind(spans, lambda s: F.concat(F.array_join(pieces(s), ""), F.substr(t, F.array_max(F.transform(s, lambda y: y["end"])) + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
