"""Oracle SQL of op4: the same histograms, references and divergences as lists."""

from ledgerloom.llm import quality_rules as q

_WORDS = "[" + ", ".join(f"'{w}'" for w in q.WORDS) + "]"
_SPELLED = "[" + ", ".join(f"'{x}'" for w in q.WORDS for x in sorted({w, w.upper(), w.capitalize()})) + "]"
_CLASSES = ", ".join(f"CAST(length(regexp_replace(text, '{c}', '', 'g')) AS BIGINT)" for c in q.CLASSES.values())
_LANGS = ", ".join(f"'{x}'" for x in q.COMMON)


def _sums(name: str, n: int) -> str:
    return "[" + ", ".join(f"CAST(sum({name}[{i + 1}]) AS BIGINT)" for i in range(n)) + "]"


def _divergence(hist: str, ref: str) -> str:
    p, r = f"(h / greatest(list_sum(x.{hist}), 1.0))", f"(r.{ref}[i] / CAST(list_sum(r.{ref}) AS DOUBLE))"
    term = f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {r}) / 2)) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2({r} / (({p} + {r}) / 2)) ELSE 0 END)"
    return f"round(min(CASE WHEN list_sum(x.{hist}) > 0 THEN list_sum(list_transform(x.{hist}, lambda h, i: {term})) / 2 ELSE 1.0 END), 6)"


OP4_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
spots AS (SELECT n, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3),
windows AS (SELECT n, i, count(*) OVER (PARTITION BY n, w[i], w[i + 1], w[i + 2]) AS c FROM spots),
covered AS (SELECT n, count(DISTINCT p) AS k FROM (SELECT n, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY n),
lines AS (SELECT n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
common AS (SELECT n, list_transform(list_filter(w, lambda x: list_contains({_SPELLED}, x)), lambda x: lower(x)) AS cw FROM base),
counted AS (
  SELECT b.n, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words, [{_CLASSES}] AS ch,
         list_transform({_WORDS}, lambda c: CAST(len(list_filter(cw, lambda x: x = c)) AS BIGINT)) AS wh
  FROM base b JOIN lines USING (n) JOIN common USING (n) LEFT JOIN covered USING (n)),
full_rows AS (
  SELECT n, doc_id, lang, n_words, word_chars, ch[{list(q.CLASSES).index("symbol") + 1}] AS n_symbols, n_dup_lines, n_repeat_words,
         n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_append(ch, CAST(greatest(0, word_chars - list_sum(ch)) AS BIGINT)) AS class_hist, list_append(wh, CAST(greatest(0, n_words - list_sum(wh)) AS BIGINT)) AS word_hist
  FROM counted),
refs AS (
  SELECT lang, {_sums("class_hist", len(q.CLASSES) + 1)} AS rc, {_sums("word_hist", len(q.WORDS) + 1)} AS rw
  FROM full_rows WHERE lang IN ({_LANGS}) AND NOT base_failed GROUP BY lang),
scored AS (
  SELECT x.n, {_divergence("class_hist", "rc")} AS class_divergence, {_divergence("word_hist", "rw")} AS word_divergence
  FROM full_rows x CROSS JOIN refs r GROUP BY x.n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_divergence, word_divergence,
       NOT base_failed AND (n_words < {q.MIN_WORDS} OR coalesce(
         class_divergence <= {q.MAX_CLASS_DIVERGENCE[0]} + {q.MAX_CLASS_DIVERGENCE[1]} / greatest(n_words, 1)
         AND word_divergence <= {q.MAX_WORD_DIVERGENCE[0]} + {q.MAX_WORD_DIVERGENCE[1]} / greatest(n_words, 1), true)) AS kept
FROM full_rows LEFT JOIN scored USING (n)
"""
