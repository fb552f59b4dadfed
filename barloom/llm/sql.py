"""The same results in DuckDB SQL, written from the contracts and not from the operators."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles(table: str, key: str) -> str:
    """Distinct five-word shingles of a table as (key, s); texts of one to four words are one shingle."""
    return f"""
    SELECT DISTINCT {key}, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM (SELECT {key}, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM {table}) WHERE len(w) > 0)"""


LEAKS = f"""
WITH d AS ({shingles("documents", "doc_id")}), b AS ({shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_common, count(*) / n_item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING count(*) * 100 >= n_item_shingles * 75
"""

LINES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
l AS (SELECT doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w, len(w) AS n
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t))),
j AS (SELECT doc_id, line, n, len(list_filter(range(2, n + 1), lambda k: w[k] = w[k - 1])) AS again,
        length(line) - length(translate(line, '|»›·•', '')) AS seps,
        length(line) - length(translate(line, '#*$%&|<>', '')) AS syms FROM l WHERE n > 0),
f AS (SELECT doc_id, line, n,
        NOT regexp_matches(line, '[.!?…:;]["''”’»)\]]*([\x20\x09-\x0D]|$)') OR 2 * again > n
        OR (seps >= 3 AND 5 * seps >= n) OR 10 * syms > 3 * n
        OR (n >= 5 AND upper(line) = line AND lower(line) <> line)
        OR (n <= 20 AND regexp_matches(line, '(?i)\b(all rights reserved|privacy policy|terms of (use|service)|cookies?|javascript|lorem ipsum|click here|subscribe|log ?in|sign ?(in|up)|read more|share this|follow us)\b')) AS fails
      FROM j),
g AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
        coalesce(sum(n) FILTER (fails), 0)::BIGINT AS n_lost_words FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words
      FROM w LEFT JOIN g USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM m
"""
