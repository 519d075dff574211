"""Scalar functions on text. Columns in, columns out; Python only where Spark has no built-in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Token patterns of overlap scores and of lexical richness, with word boundaries by Unicode's letters.
OVERLAP_TOKEN = r"(?U)\b[a-zA-Z0-9]+(?:['\-_][a-zA-Z0-9]+)*\b"
RICHNESS_TOKEN = r"(?U)\b[a-zA-Z0-9]+(?:'[a-zA-Z0-9]+)?\b"
#: The former without word boundaries: one meaning in every SQL engine.
PORTABLE_TOKEN = r"[a-z0-9]+(?:['_-][a-z0-9]+)*"

# English function words that content tokens leave out.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


# Tags that become a space, tags that vanish, and control characters that text must not hold.
BLOCK_TAG = r"(?i)</?(?:p|div|br|hr|li|tr|h[1-6]|blockquote|article|section)\b[^>]*>"
ANY_TAG = r"<[a-zA-Z/][^>]*>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def bind(value: Column, body) -> Column:
    """body(value), with value computed once per row: inside a lambda of a higher-order function an expression is computed for every item."""
    return F.transform(F.array(value), body)[0]


def clean_html(text: Column, decode: bool = True) -> Column:
    """Markup out, references decoded (after the tags, so an escaped tag stays as text), no-break spaces and control characters gone; null gives "".

    Block tags become a space, other tags vanish with no trace, script bodies
    stay. A < before a digit or a space is text. With decode=False no Python runs.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), BLOCK_TAG, " ")
    t = F.regexp_replace(t, ANY_TAG, "")
    t = _unescape(t) if decode else t
    return F.regexp_replace(F.translate(t, "\u00a0", " "), CONTROL, "")


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """One of the four Unicode normal forms; null gives "". ASCII texts skip nothing but the work: the form leaves them alone."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form!r}")

    @F.pandas_udf(StringType())
    def normal(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize(form, t))

    return normal(F.coalesce(text, F.lit("")))


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "), r"^ | $", "")


def normalize_text(text: Column, form: str = "NFC") -> Column:
    return normalize_whitespace(normalize_unicode(text, form))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_token(token: Column) -> Column:
    return F.lower(strip(token))


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def light_sentences(text: Column) -> Column:
    """Cut after . ! ? before white space; blank pieces don't count."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """The same cut without look-behind, as other engines can express it; pieces lose spaces at their ends."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\f\r]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")  # F.trim alone would take the item's place as the characters to trim


def overlap_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(OVERLAP_TOKEN), F.lit(0))


def portable_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PORTABLE_TOKEN), F.lit(0))


def richness_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RICHNESS_TOKEN), F.lit(0))


def is_stopword(token: Column, stop: list[str] = STOP_WORDS) -> Column:
    return normalize_token(token).isin(stop)


def content_tokens(tokens: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens that are no stop words and have a letter or digit."""
    return F.filter(F.transform(tokens, normalize_token), lambda w: ~w.isin(stop) & w.rlike(r"[\p{L}\p{N}]"))


def portable_content(text: Column) -> Column:
    """Content tokens of three characters or more, in the portable form."""
    return F.filter(portable_tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def json_or_raw(text: Column) -> Column:
    """Valid JSON in its canonical text, anything else as it is, empty as null."""
    t = F.nullif(text, F.lit(""))
    return F.coalesce(F.to_json(F.try_parse_json(t)), t)


def py_round(value: Column, digits: int) -> Column:
    """Rounds the exact binary value, ties to even, as Python does; no built-in of Spark does."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None or v != v else round(float(v), digits))

    return rounded(value.cast("double"))


# What the browser side computes.


def ui_statistics(text: Column) -> Column:
    return F.struct(F.size(words(text)).alias("words"), F.length(F.coalesce(text, F.lit(""))).alias("characters"), F.size(light_sentences(text)).alias("sentences"))


def ui_title(text: Column) -> Column:
    return F.substring(F.get(F.split(strip(F.coalesce(text, F.lit(""))), "\n"), F.lit(0)), 1, 120)


def ui_example(text: Column) -> Column:
    return F.substring(F.get(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s"), F.lit(0)), 1, 240)


def ui_verdict(f1: Column) -> Column:
    return F.when(f1 >= 0.6, "strong").when(f1 >= 0.35, "moderate").when(f1 >= 0.15, "weak").otherwise("little")


def ui_compression(selected: Column, source: Column) -> Column:
    """Whole percent of the sentences that were selected; null without sentences."""
    return F.when(source > 0, F.floor(100 * selected / source + 0.5).cast("int"))


def ui_highlight(text: Column, query: str) -> Column:
    if not query.strip():
        return text
    return F.regexp_replace(text, F.lit("(?iu)" + "".join(c if c.isalnum() else "\\" + c for c in query.strip())), F.lit("<mark>$0</mark>"))


def ui_item_matches(item: Column, query: str) -> Column:
    parts = F.concat_ws(" ", item["term"], item["normalized_form"], item["lemma"], item["pos"], item["entity_label"])
    return F.contains(F.lower(parts), F.lit(query.strip().lower()))


def ui_new_chips(typed: Column, present: Column) -> Column:
    """Entries cut at line ends and commas that are not there yet, letter case aside, in order of first appearance."""
    entries = F.filter(F.transform(F.split(F.coalesce(typed, F.lit("")), r"[\n,]"), strip), lambda x: x != "")
    there = F.transform(F.coalesce(present, F.array().cast("array<string>")), F.lower)
    first = lambda x, i: F.array_position(F.transform(entries, F.lower), F.lower(x)) == i + 1
    return F.filter(entries, lambda x, i: first(x, i) & ~F.array_contains(there, F.lower(x)))
