"""DuckDB's SQL for those queries that it can express, over whole tables."""

from __future__ import annotations

from lectern.llm import quality_rules as Q

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DOCS = f"d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)"


def _windows(n: int | str, source: str, extra: str = "") -> str:
    """rid, i (from 1) and s: all runs of n words."""
    return f"SELECT rid{extra}, i, array_to_string(w[i:i + {n} - 1], ' ') AS s FROM (SELECT rid{extra}, w, unnest(range(1, greatest(1, len(w) - {n} + 2))) AS i FROM {source})"


def substrings(n: int = 35) -> str:
    return f"""WITH {_DOCS},
win AS ({_windows(n, "d")}),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, i + k AS p FROM win JOIN rep USING (s), (SELECT unnest(range({n})) AS k)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def decontaminate(n: int = 13) -> str:
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, coalesce(CAST(item_id AS VARCHAR), '') AS item, {cut} AS w FROM benchmark),
test AS (SELECT bid, item, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM (SELECT bid, item, w, least({n}, len(w)) AS n, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
win AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, (SELECT DISTINCT n FROM test))),
found AS (SELECT rid, n, i, bid, j, item FROM win JOIN test USING (n, s)),
word AS (SELECT DISTINCT rid, i + k - 1 AS p FROM (SELECT rid, i, unnest(range(n)) AS k FROM found)),
island AS (SELECT rid, min(p) AS first, max(p) + 1 AS past FROM (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM word) GROUP BY rid, g),
hit AS (SELECT rid, sum(past - first) AS h, string_agg(first || ',' || past, ',' ORDER BY first) AS hits FROM island GROUP BY rid),
far AS (SELECT rid, max(m) AS longest FROM (SELECT rid, any_value(n) + count(*) - 1 AS m FROM (SELECT rid, n, bid, i - j AS x, i - row_number() OVER (PARTITION BY rid, n, bid, i - j ORDER BY i) AS g FROM found) GROUP BY rid, n, bid, x, g) GROUP BY rid),
items AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(h, 0) AS BIGINT) AS n_hit, coalesce(c, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated, coalesce(hits, '') AS hits, coalesce(longest, 0) AS longest
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN far USING (rid)"""


def quality_rules() -> str:
    parts = []
    for n in (3, *Q.DUPLICATE_NGRAMS):
        parts.append(f"""c{n} AS (SELECT rid, count(*) AS words, sum(length(w[p])) AS chars FROM (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS m FROM ({_windows(n, "d")})), (SELECT unnest(range({n})) AS k) WHERE m > 1) JOIN d USING (rid) GROUP BY rid)""")
    joins = " ".join(f"LEFT JOIN c{n} USING (rid)" for n in (3, *Q.DUPLICATE_NGRAMS))
    grams = ", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in Q.DUPLICATE_NGRAMS)
    over = " OR ".join(f"dup_{n}gram_chars > {most} * greatest(1, word_chars)" for n, most in Q.DUPLICATE_NGRAMS.items())
    low, high = Q.WORD_LENGTHS
    return rf"""WITH {_DOCS}, {", ".join(parts)},
line AS (SELECT rid, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)),
lines AS (SELECT rid, sum(m) AS n_lines, sum(m - 1) AS n_dup, sum((m - 1) * chars) AS dup_chars FROM (SELECT rid, l, any_value(chars) AS chars, count(*) AS m FROM line WHERE k > 0 GROUP BY rid, l) GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, CAST(coalesce(dup_chars, 0) AS BIGINT) AS dup_line_chars, {grams}, coalesce(n_lines, 0) AS n_lines,
len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND strlen(x) > 1 AND (strlen(x) > 2 OR strlen(x) = length(x)))) AS n_capital, len(list_filter(w, lambda x: x = '|')) AS n_bars
FROM d LEFT JOIN lines USING (rid) {joins}),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR dup_line_chars > {Q.DUPLICATE_LINE_CHARS} * greatest(1, word_chars) OR n_dup_lines > {Q.DUPLICATE_LINES} * greatest(1, n_lines) OR {over}
OR n_symbols - n_bars > {Q.SYMBOLS_A_WORD} * n_words OR word_chars < {low} * n_words OR word_chars > {high} * n_words OR n_capital > {Q.CAPITAL_WORDS} * n_words OR n_bars > {Q.BARS_A_WORD} * n_words) AS kept,
dup_line_chars, {", ".join(f"dup_{n}gram_chars" for n in Q.DUPLICATE_NGRAMS)} FROM g"""


ORACLE = {"op3_quality_rules": quality_rules(), "op7_decontaminate": decontaminate(), "op10_substrings": substrings()}
