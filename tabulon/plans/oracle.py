"""Pieces of DuckDB SQL that the oracles of several queries share."""

from __future__ import annotations

from ..functions.labels import ALIASES, HIGH, LOW, PROTOTYPES
from ..functions.numbers import CURRENCY
from ..operators.cells import REQUISITES
from ..operators.rules import ROLES
from ..sources.offers import CTE

GAP = "[\\s  ]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s  ]+|[\\s  ]+$', '', 'g')"


def number(x: str) -> str:
    raw = strip(f"regexp_replace({strip(x)}, '(?i)(?:{CURRENCY})', '', 'g')")
    bare = f"regexp_replace({raw}, '{GAP}', '', 'g')"
    shape = f"CASE WHEN regexp_matches({bare}, '^[+-]?[0-9]+$') THEN {bare} WHEN regexp_matches({bare}, '^[+-]?[0-9]+[.,][0-9]{{1,2}}$') THEN replace({bare}, ',', '.') WHEN regexp_matches({bare}, '^[+-]?[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]{{1,2}}$') THEN replace(replace({bare}, '.', ''), ',', '.') WHEN regexp_matches({bare}, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]{{1,2}}$') THEN replace({bare}, ',', '') END"
    ok = f"regexp_matches({raw}, '^[+-]?[0-9]') AND (NOT regexp_matches({raw}, '[0-9]{GAP}+[0-9]') OR regexp_matches({raw}, '^[+-]?[0-9]{{1,3}}(?:{GAP}+[0-9]{{3}})+(?:[,.][0-9]{{1,2}})?$'))"
    return f"(CASE WHEN {ok} THEN try_cast({shape} AS DOUBLE) END)"


def quote(x: str) -> str:
    s = strip(x)
    return f"coalesce({number(x)}, CASE WHEN regexp_matches({s}, '^[+]?[0-9   ]+,[0-9]{{1,6}}$') THEN try_cast(replace(regexp_replace({s}, '[+   ]', '', 'g'), ',', '.') AS DOUBLE) END)"


def matrix(x: str) -> str:
    s = strip(x)
    return f"coalesce({number(x)}, CASE WHEN regexp_matches({s}, '^[0-9](?:[0-9]|{GAP})*[,.][0-9]{{2}}$') THEN try_cast(replace(regexp_replace({s}, '{GAP}', '', 'g'), ',', '.') AS DOUBLE) END)"


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


def label(x: str) -> str:
    v = f"replace(lower(coalesce({x}, '')), 'ё', 'е')"
    v = f"regexp_replace({v}, '[‐‑‒–—―−]+', '-', 'g')"
    v = f"regexp_replace({v}, '[/.:]+', ' ', 'g')"
    v = f"regexp_replace({v}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]+', ' ', 'g')"
    return f"trim(regexp_replace({v}, '[-\\s]+', ' ', 'g'))"


_VALUES = ", ".join(f"('{role}', '{x}', {str(source is ALIASES).lower()})" for source in (ALIASES, PROTOTYPES) for role, labels in source.items() for x in labels)
VOCABULARY = f"voc AS (SELECT role, {label('x')} AS label, alias FROM (VALUES {_VALUES}) v(role, x, alias))"


def _scores(labels: str) -> str:
    """CTEs up to ``scores`` (label, role, score) of the labels of a query."""
    grams = lambda keys, of: f"SELECT {keys}, substring('  ' || label || '  ', i, 3) AS gram, count(*) AS n FROM (SELECT {keys}, label, unnest(generate_series(1, length(label) + 2)) AS i FROM {of}) GROUP BY ALL"
    return f"""{VOCABULARY}, labels AS ({labels}), a AS (SELECT label, substring('  ' || label || '  ', i, 3) AS gram, count(*) AS n FROM (SELECT label, unnest(generate_series(1, length(label) + 2)) AS i FROM labels) GROUP BY ALL),
    b AS ({grams('role, label', 'voc')}), na AS (SELECT label, sum(n * n) AS na FROM a GROUP BY label), nb AS (SELECT role, label AS proto, sum(n * n) AS nb FROM b GROUP BY ALL),
    dots AS (SELECT a.label, b.role, b.label AS proto, sum(a.n * b.n) AS dot FROM a JOIN b USING (gram) GROUP BY ALL),
    scores AS (SELECT label, role, max(dot / sqrt(na::DOUBLE * nb)) AS score FROM dots JOIN na USING (label) JOIN nb USING (role, proto) GROUP BY label, role)"""


_NAMES = f"SELECT DISTINCT {label('p_name')} AS label FROM part"
COSINE = f"WITH {_scores(_NAMES)} SELECT label, role, round(score, 6) AS score FROM scores"


def classified(texts: str) -> str:
    """CTEs up to ``classified`` (text, label, role, score, method) of the texts of a query."""
    return f"""texts AS (SELECT text, {label('text')} AS label FROM ({texts})), {_scores('SELECT DISTINCT label FROM texts')},
    best AS (SELECT label, max({{'score': score, 'role': role}}) AS b FROM scores GROUP BY label), als AS (SELECT label, min(role) AS alias FROM voc WHERE alias GROUP BY label),
    classified AS (SELECT text, label, CASE WHEN alias IS NOT NULL THEN alias WHEN s >= {LOW} THEN r END AS role, CASE WHEN alias IS NOT NULL THEN 0.99::DOUBLE WHEN s >= {HIGH} THEN least(0.97::DOUBLE, round(s, 3)) ELSE round(s, 3) END AS score,
      CASE WHEN alias IS NOT NULL THEN 'alias' WHEN s >= {HIGH} THEN 'semantic' WHEN s >= {LOW} THEN 'review' ELSE 'unknown' END AS method
      FROM (SELECT text, label, alias, coalesce(b.score, 0.0::DOUBLE) AS s, b.role AS r FROM texts LEFT JOIN als USING (label) LEFT JOIN best USING (label)))"""


CLASSIFY = f"WITH {CTE}, {classified('SELECT DISTINCT text FROM cells WHERE row = 1 OR block = 0')} SELECT text, label, role, round(score, 3) AS score, method FROM classified"

SUMMARY = "'(?i)^(?:итого|всего|к оплате|общая сумма|ндс|скидка|subtotal|grand total|total)(?:[\\s:,.]|$)'"
FOOTER = "'(?i)^(?:примечание|подпись|страница|с уважением)(?:[\\s:,.]|$)'"
LABELS = "'(?i)^(?:" + "|".join(x for k, v in REQUISITES.items() if k != "title" for x in v) + ")(?:\\s*[:=]|\\s+|$)'"

_TABLE_TEXTS = "SELECT DISTINCT text FROM cells WHERE kind = 'table'"
ROLED = f"{CTE}, {classified(_TABLE_TEXTS)}, known AS (SELECT text, role FROM classified WHERE method IN ('alias', 'semantic'))"

FACTS = f"""{ROLED}, judged AS (SELECT c.*, k.role, {strip('c.text')} AS t, {quote('c.text')} AS number FROM cells c LEFT JOIN known k ON k.text = c.text),
facts AS (SELECT doc_id, block, row, count(*) FILTER (t <> '') AS filled, count(*) FILTER (number IS NOT NULL) AS numbers, count(*) FILTER (t <> '' AND number IS NULL) AS words, count(*) FILTER (role IS NOT NULL) AS roles,
  count(*) FILTER (role = 'name') AS names, count(*) FILTER (regexp_matches(t, {SUMMARY})) AS summaries, count(*) FILTER (regexp_matches(t, {FOOTER})) AS footers, count(*) FILTER (regexp_matches(t, {LABELS})) AS labels FROM judged GROUP BY doc_id, block, row)"""

CATALOG = f"""WITH {FACTS}, p AS (SELECT *, count(*) OVER b AS n, row_number() OVER o AS nth, (numbers = 0)::INT AS wordy, (names > 0)::INT AS header, (numbers > 0)::INT AS numeric_, sum((numbers = 0)::INT) OVER o AS wordy_at, sum((names > 0)::INT) OVER o AS header_at, sum((numbers > 0)::INT) OVER o AS numeric_at, sum((numbers > 0)::INT) OVER b AS numeric_n
  FROM facts WINDOW b AS (PARTITION BY doc_id, block), o AS (PARTITION BY doc_id, block ORDER BY row))
SELECT doc_id, block, count(*) AS n_rows, min(row) AS first_row, max(row) AS last_row, string_agg(row::VARCHAR, ',' ORDER BY row) FILTER (n <= 12 OR nth <= 5 OR nth > n - 3 OR (wordy = 1 AND wordy_at <= 6) OR (header = 1 AND header_at <= 6) OR (numeric_ = 1 AND (numeric_at <= 2 OR numeric_at = numeric_n // 2 + 1))) AS sample FROM p GROUP BY doc_id, block"""

MAPPING = f"""{ROLED}, mapping AS (SELECT doc_id, block, row, {', '.join(f"min(col) FILTER (role = '{r}') AS {r}_col" for r in ROLES)} FROM cells JOIN known USING (text) WHERE kind = 'table' GROUP BY doc_id, block, row
  HAVING min(col) FILTER (role = 'name') IS NOT NULL AND (min(col) FILTER (role = 'quantity') IS NOT NULL OR min(col) FILTER (role = 'unitPrice') IS NOT NULL OR min(col) FILTER (role = 'lineTotal') IS NOT NULL))"""

_UP = "(PARTITION BY doc_id, block ORDER BY row ROWS UNBOUNDED PRECEDING)"
ITEMS = f"""{MAPPING}, totals AS (SELECT doc_id, block, row, bool_or(regexp_matches({strip('text')}, {SUMMARY})) AS total FROM cells GROUP BY doc_id, block, row),
ruled AS (SELECT *, last_value(header IGNORE NULLS) OVER {_UP} AS h, last_value(CASE WHEN total AND header IS NULL THEN row END IGNORE NULLS) OVER {_UP} AS t FROM (SELECT t.*, m.row AS header FROM totals t LEFT JOIN mapping m USING (doc_id, block, row))),
pivot_ AS (SELECT c.doc_id, c.block, c.row, {', '.join(f"max(CASE WHEN c.col = m.{r}_col THEN c.text END) AS {r}" for r in ROLES)} FROM ruled r JOIN mapping m ON m.doc_id = r.doc_id AND m.block = r.block AND m.row = r.h JOIN cells c ON c.doc_id = r.doc_id AND c.block = r.block AND c.row = r.row
  WHERE r.header IS NULL AND (r.t IS NULL OR r.t < r.h) GROUP BY c.doc_id, c.block, c.row),
found AS (SELECT doc_id, block, row, name, unit, {number('quantity')} AS quantity, {number('unitPrice')} AS unit_price, {number('lineTotal')} AS line_total FROM pivot_ WHERE name IS NOT NULL AND {strip('name')} <> '' AND {number('name')} IS NULL)"""

PLANNED = f"""{CTE}, pl AS (SELECT doc_id, n + 2 AS last, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 3 END AS nc, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END AS qc, 4 AS pc, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 1 END AS tc FROM heads WHERE n > 0 AND doc_id % 4 <> 3),
pp AS (SELECT doc_id, block, row, max(text) FILTER (col = nc) AS name, max(text) FILTER (col = qc) AS q, max(text) FILTER (col = pc) AS p, max(text) FILTER (col = tc) AS t FROM cells JOIN pl USING (doc_id) WHERE block = 1 AND row BETWEEN 2 AND last GROUP BY doc_id, block, row),
planned AS (SELECT doc_id, block, row, name, {quote('q')} AS quantity, {quote('p')} AS unit_price, {quote('t')} AS line_total FROM pp WHERE name IS NOT NULL AND {strip('name')} <> '' AND {quote('name')} IS NULL AND NOT regexp_matches({strip('name')}, {SUMMARY}))"""

MERGED = f"""WITH {ITEMS}, {PLANNED[len(CTE) + 2:]}, r AS (SELECT * FROM found WHERE (doc_id + row) % 10 <> 0)
SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(p.block, r.block) AS block, coalesce(p.row, r.row) AS row, coalesce(p.name, r.name) AS name, coalesce(p.quantity, r.quantity) AS quantity, coalesce(p.unit_price, r.unit_price) AS unit_price, coalesce(p.line_total, r.line_total) AS line_total,
  coalesce(r.quantity <> p.quantity, false) OR coalesce(r.unit_price <> p.unit_price, false) OR coalesce(r.line_total <> p.line_total, false) AS conflict, CASE WHEN p.doc_id IS NULL THEN 'rules' WHEN r.doc_id IS NULL THEN 'plan' ELSE 'both' END AS origin
FROM r FULL JOIN planned p ON r.doc_id = p.doc_id AND r.block = p.block AND r.row = p.row"""

TEXT_CELLS = r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS a FROM documents)),
p AS (SELECT doc_id, line, list_filter(list_transform(regexp_split_to_array(t, '\t|\||[ \t]{2,}'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS parts FROM l),
k AS (SELECT *, CASE WHEN len(parts) > 1 THEN 'table' ELSE 'text' END AS kind FROM p WHERE len(parts) > 0),
b AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS block FROM (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY line))::INT, 1) AS turn FROM k)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line) AS row FROM b)
SELECT doc_id, block, row, unnest(generate_series(1, len(parts))) AS col, unnest(parts) AS text, kind FROM r"""

TOTALS = f"""WITH {CTE}, x AS (SELECT doc_id, n, sum_total / 100.0::DOUBLE AS raw, round(sum_total / 100.0::DOUBLE * CASE WHEN doc_id % 19 = 0 THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN doc_id % 34 = 0 THEN 1.12::DOUBLE ELSE 1 END, 2) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS stated FROM heads WHERE n > 0),
a AS (SELECT *, CASE WHEN doc_id % 19 = 0 THEN [raw, raw * (1 - 5.0::DOUBLE / 100)] WHEN doc_id % 23 = 0 THEN [raw, raw - 100] ELSE [raw] END AS l FROM x),
b AS (SELECT *, CASE WHEN doc_id % 34 = 0 AND doc_id % 17 = 0 THEN list_concat(l, list_transform(l, lambda v: v * (1 + 12.0::DOUBLE / 100))) ELSE l END AS m FROM a),
c AS (SELECT *, list_concat(m, list_transform(m, lambda v: v + CASE WHEN doc_id % 29 = 0 THEN 50 ELSE 0 END)) AS k FROM b)
SELECT doc_id, n, len(k) AS n_candidates, len(list_filter(k, lambda v: abs(stated - v) <= 0.02 + n * 0.005)) > 0 AS agrees FROM c"""

_text = lambda x: f"'{x}'"
_KEYS = ", ".join(f"('{f}', {label(_text(x.lower()))}, {len(x)})" for f, v in REQUISITES.items() for x in v)
_SHAPE = "'^([^:\\n]{2,100}):\\s*(\\S[^\\n]*)$'"
FIELDS = f"""WITH {CTE}, names AS (SELECT arg_max(f, (n, f)) AS field, k FROM (VALUES {_KEYS}) v(f, k, n) GROUP BY k),
c AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, block, row ORDER BY col) AS next, count(*) OVER (PARTITION BY doc_id, block, row) AS width, nullif(regexp_extract({strip('text')}, {_SHAPE}, 1), '') AS lab, nullif(regexp_extract({strip('text')}, {_SHAPE}, 2), '') AS val FROM cells),
fields AS (SELECT * FROM (SELECT doc_id, block, row, col, field, {strip("coalesce(val, CASE WHEN lab IS NULL AND width <= 2 THEN next END)")} AS value FROM c JOIN names ON k = {label('coalesce(lab, text)')}) WHERE value <> '')"""

SHINGLES = f"""toks AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(regexp_replace({label('text')}, '[0-9]+', '#', 'g'), ' +'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS shingle FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM toks WHERE len(w) >= 5))"""
#: Pairs between the least ids of equal sets, and from these to the others of their class.
PAIRS = f"""{SHINGLES}, sets AS (SELECT id, count(*) AS n, md5(string_agg(shingle, '' ORDER BY shingle)) AS k FROM shingles GROUP BY id), classes AS (SELECT id, n, min(id) OVER (PARTITION BY k) AS rep FROM sets), sizes AS (SELECT id, n FROM classes WHERE id = rep), own AS (SELECT id, shingle FROM shingles JOIN sizes USING (id)),
hits AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM own x JOIN own y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, p.n AS na, q.n AS nb, common FROM hits JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * least(p.n, q.n) >= 72 * greatest(p.n, q.n) AND 100 * common >= 72 * (p.n + q.n - common) UNION ALL SELECT rep, id, n, n, n FROM classes WHERE id <> rep)"""
