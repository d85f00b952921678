"""The corpus queries by name. None has a plain SQL form for whole tables except those in SQL."""

from __future__ import annotations

from ledgerscope.llm.alignment import op12_token_alignment
from ledgerscope.llm.decontam import op4_benchmark_leaks
from ledgerscope.llm.html_text import op5_html_extraction
from ledgerscope.llm.lexical import op11_ranked_search
from ledgerscope.llm.licenses import op13_license_scan
from ledgerscope.llm.lm_score import op7_lm_scores
from ledgerscope.llm.near_dup import op2_near_duplicates
from ledgerscope.llm.packing import op6_best_fit_packing
from ledgerscope.llm.quality import op9_quality_rules
from ledgerscope.llm.secrets import op1_secret_scan
from ledgerscope.llm.substring_dup import op3_suffix_array_dedup
from ledgerscope.llm.tokens import op8_token_counts
from ledgerscope.llm.warc import op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_near_duplicates, op3_suffix_array_dedup, op4_benchmark_leaks, op5_html_extraction,
        op6_best_fit_packing, op7_lm_scores, op8_token_counts, op9_quality_rules, op10_warc, op11_ranked_search,
        op12_token_alignment, op13_license_scan,
    )
}

#: Rule of op9 in SQL; the repeated-window count has the form of the contract.
SQL: dict[str, str] = {
    "op11_ranked_search": r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM cut) GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM cut),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
m AS (SELECT doc_id, 25 + (75 * len(w)::BIGINT * nn) // ll AS m FROM cut, s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, tf.doc_id, sum(floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term JOIN m ON m.doc_id = tf.doc_id, s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op9_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, t, w, l, CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', chr(10))) ELSE [] END AS g FROM d
), o AS (
  SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM o) WHERE c > 1
), s AS (
  SELECT doc_id, sum(least(8, i - coalesce(p, i - 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id
), f AS (
  SELECT g.doc_id, t, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN s ON g.doc_id = s.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.1 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > length(regexp_replace(t, '[^\p{L}]', '', 'g'))
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR NOT regexp_matches(t, '\p{L}')) AS kept
FROM f
""",
}
