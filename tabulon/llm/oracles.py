"""DuckDB SQL of the rows of those queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .mixing import ORACLE as MIXING
from .quality import CLASSES, COMMON, Rules
from .vectorcodes import ORACLE as VECTORS

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT + 1, 1)), '') AS digest, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d
"""

_R = Rules()
_VOCABULARY = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in COMMON.items()) + " ELSE [] END"
_COUNT = "length(regexp_replace(text, '[^{0}]', '', 'g'))"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({', '.join(repr(k) for k in COMMON)}) THEN lang ELSE '' END AS lang, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) > 7)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, lang, w, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_COUNT.format(CLASSES['symbol'])}::BIGINT AS n_symbols,
        (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
u AS (SELECT *, {_COUNT.format(CLASSES['upper'])} AS up, {_COUNT.format(CLASSES['digit'])} AS dig, greatest({_COUNT.format(CLASSES['mark'])} - n_symbols, 0) AS mk FROM m),
v AS (SELECT *, [length(text) - word_chars, n_symbols, up, dig, mk, greatest(word_chars - n_symbols - up - dig - mk, 0)] AS chars, list_transform({_VOCABULARY}, lambda t: len(list_filter(w, lambda x: x = t))) AS hits FROM u),
h AS (SELECT r, lang, 'c' AS kind, unnest(generate_series(1, len(chars))) AS k, unnest(chars)::DOUBLE AS n FROM v
      UNION ALL SELECT r, lang, 'w', unnest(generate_series(1, len(hits) + 1)), unnest(list_append(hits, n_words - coalesce(list_sum(hits), 0)))::DOUBLE FROM v),
f AS (SELECT lang, kind, k, sum(n) AS q FROM h GROUP BY ALL),
s AS (SELECT h.r, h.kind, h.n / nullif(sum(h.n) OVER (PARTITION BY h.r, h.kind), 0) AS p, f.q / nullif(sum(f.q) OVER (PARTITION BY h.r, h.kind), 0) AS q FROM h JOIN f USING (lang, kind, k)),
j AS (SELECT r, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS dist FROM s WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY r, kind),
e AS (SELECT v.*, CASE WHEN list_sum(chars) >= {_R.min_chars} THEN a.dist END AS cd, CASE WHEN lang <> '' AND n_words >= {_R.min_compared_words} THEN b.dist END AS wd, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed
      FROM v LEFT JOIN j a ON a.r = v.r AND a.kind = 'c' LEFT JOIN j b ON b.r = v.r AND b.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {_R.max_char_distance} AND coalesce(wd, 0) <= {_R.max_word_distance} AS kept FROM e
"""

JACCARD = f"""
WITH RECURSIVE t AS (SELECT doc_id AS id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
sh AS (SELECT DISTINCT id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
g AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT g.b, reach.root FROM reach JOIN g ON g.a = reach.id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id FROM documents JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) r ON r.id = doc_id LEFT JOIN n ON n.id = doc_id
"""

REPEATS = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM t WHERE len(w) > 34)),
hot AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM t) ANTI JOIN hot USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""

ORACLES = {"op1_chunked_records": WARC, "op2_distribution_divergence": QUALITY, "op3_count_vector_tree": JACCARD, "op9_temperature_mixing": MIXING, "op12_count_min_windows": REPEATS, "op13_exponion_codes": VECTORS}
