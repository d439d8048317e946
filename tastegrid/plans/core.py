"""Queries of the general training-data problems (1 and 4) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegrid.operators import drift, units
from tastegrid.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.common_quantities(table(spark, sf_dir, "price_quotes"), table(spark, sf_dir, "exchange_rates"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_records"))


def p1_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.lifespans(drift.field_catalogue(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_records")))


def p1_consistent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_records"))


def p1_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_consistent_table(spark, sf_dir).drop("extras").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_lifespans": p1_lifespans,
    "p1_consistent_table": p1_consistent_table,
    "p1_reviews": p1_reviews,
    "p4_found": p4_found,
}

_DIGITS = r"\d+(?:[.,]\d+)*"
_WORDS = "|".join(sorted((w for w in units.NUMBER_WORDS if w.isascii()), key=lambda w: (-len(w), w)))
_NUMBER = rf"(?:{_DIGITS}\s*/\s*{_DIGITS}|{_DIGITS}\s*[½¼¾⅓⅔]|{_DIGITS}|[½¼¾⅓⅔]|(?:{_WORDS})\b)"
_UNIT = "(?:" + "|".join(sorted((w for ws in units.WEIGHT_SPELLINGS.values() for w in ws), key=lambda w: (-len(w), w))) + r")\b"
_WEIGHT = rf"^(?:({_NUMBER})?\s*[x×]\s*)?({_NUMBER})?[\s-]*({_UNIT})[.*]*(?:\s*(?:and\s+)?({_NUMBER})\s*({_UNIT})[.*]*)?(?:[\s-].*)?$"


def _in(values: dict[str, tuple[str, ...]], key: str, of: dict[str, float]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{w}' THEN {of[u]!r}" for u, ws in values.items() for w in ws if u in of) + " END"


def _read(x: str) -> str:
    words = " ".join(f"WHEN '{w}' THEN {v!r}" for w, v in units.NUMBER_WORDS.items())
    part = "CASE right({x}, 1) WHEN '½' THEN 0.5 WHEN '¼' THEN 0.25 WHEN '¾' THEN 0.75 END".format(x=x)
    return rf"""CASE WHEN regexp_matches({x}, '^[\d.]+\s*/') THEN TRY_CAST(split_part({x}, '/', 1) AS DOUBLE) / TRY_CAST(trim(split_part({x}, '/', 2)) AS DOUBLE)
    WHEN regexp_matches({x}, '^\d+\s*[½¼¾]$') THEN TRY_CAST(regexp_extract({x}, '^\d+') AS DOUBLE) + {part}
    WHEN regexp_matches({x}, '^[1-9]\d{{0,2}}(,\d{{3}})+(\.\d+)?$') THEN TRY_CAST(replace({x}, ',', '') AS DOUBLE)
    WHEN regexp_matches({x}, '^\d') THEN TRY_CAST(replace({x}, ',', '.') AS DOUBLE) ELSE CASE {x} {words} END END"""


_GRAMS = {"mg": 0.001, "g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
_MONEY = {u: 0.01 if u == "USD_CENT" else 1000.0 if u == "IDR_THOUSAND" else 1.0 for u in units.CURRENCY_SPELLINGS}
_CODE = " ".join(f"WHEN '{w}' THEN '{ {'USD_CENT': 'USD', 'IDR_THOUSAND': 'IDR'}.get(u, u) }'" for u, ws in units.CURRENCY_SPELLINGS.items() for w in ws)
_KEY = r"regexp_replace(upper(replace({}, '$', '')), '[\s\p{{Z}}]+|\.+$', '', 'g')"
_P4 = rf"""WITH first AS (SELECT *, regexp_replace(trim(split_part(regexp_replace(lower(est_price), '[\s\p{{Z}}]+', ' ', 'g'), ';', 1)), '^price\s*:\s*', '') AS o FROM price_quotes),
halves AS (SELECT *, trim(split_part(o, '/', 1)) AS p FROM first),
reading AS (SELECT quote_id, review_date, 0 AS reading, regexp_extract(p, '{_DIGITS}') AS digits, CAST(NULL AS DOUBLE) AS price,
    {_KEY.format(f"regexp_replace(p, '{_DIGITS}', ' ')")} AS money, 1.0 AS times, substr(o, instr(o, '/') + 1) AS w FROM halves WHERE instr(o, '/') > 0 AND regexp_matches(p, '^[^0-9]*{_DIGITS}[^0-9]*$')
    UNION ALL SELECT quote_id, review_date, 1, NULL, price_value, {_KEY.format('price_currency')}, coalesce(quantity_value, 1), quantity_unit FROM price_quotes),
weight AS (SELECT *, trim(regexp_replace(regexp_replace(lower(w), '\([^)]*\)?', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM reading),
part AS (SELECT *, regexp_extract(t, '{_WEIGHT}', 1) AS w1, regexp_extract(t, '{_WEIGHT}', 2) AS w2, regexp_extract(t, '{_WEIGHT}', 3) AS w3,
    regexp_extract(t, '{_WEIGHT}', 4) AS w4, regexp_extract(t, '{_WEIGHT}', 5) AS w5 FROM weight WHERE NOT regexp_matches(t, '\bfl(uid|\.)?\b|\bmls?\b|\blit(er|re)s?\b')),
num AS (SELECT *, times * CASE w1 WHEN '' THEN 1.0 ELSE {_read('w1')} END AS n, CASE w2 WHEN '' THEN 1.0 ELSE {_read('w2')} END AS a, {_read('w4')} AS b,
    CASE reading WHEN 0 THEN {_read('digits')} ELSE price END AS paid FROM part),
common AS (SELECT *, n * a * {_in(units.WEIGHT_SPELLINGS, 'w3', _GRAMS)} + coalesce(n * b * {_in(units.WEIGHT_SPELLINGS, 'w5', _GRAMS)}, 0) AS g,
    paid * {_in(units.CURRENCY_SPELLINGS, 'money', _MONEY)} AS m, CASE money {_CODE} END AS code FROM num),
rated AS (SELECT c.*, m / rate * 100 AS cents FROM common c JOIN exchange_rates r ON r.review_date = date_trunc('month', c.review_date) AND r.price_currency = code WHERE rate > 0)
SELECT quote_id, CAST(floor(round(g, 7) + 0.5) AS BIGINT) AS grams, CAST(floor(round(cents, 7) + 0.5) AS BIGINT) AS usd_cents FROM rated
WHERE g > 0 AND paid > 0 AND cents IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY reading, g, cents) = 1"""

_CELLS = """rec AS (SELECT DISTINCT file_id, line_no, record FROM export_records WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
cell AS (SELECT r.file_id, json_extract_string(r.record, '$.url') AS url, e.key AS field, e.type AS t, json_extract_string(e.value, '$') AS s FROM rec r, json_each(r.record) e),
filled AS (SELECT file_id, url, field, CASE WHEN t = 'VARCHAR' AND trim(s) NOT IN ('', 'NR', 'N/A', 'NA', 'na') THEN 3 WHEN t IN ('DOUBLE', 'FLOAT') THEN 2
    WHEN t IN ('UBIGINT', 'BIGINT') THEN 1 WHEN t = 'BOOLEAN' THEN 0 END AS kind,
    CASE WHEN t IN ('DOUBLE', 'FLOAT', 'UBIGINT', 'BIGINT') THEN CAST(CAST(s AS DOUBLE) AS VARCHAR) ELSE s END AS v FROM cell),
cat AS (SELECT feed, file_seq, file_id, field, max(kind) AS kind FROM filled JOIN export_files USING (file_id) GROUP BY ALL)"""



def _canonical(column: str) -> str:
    kind, names = drift.REVIEW_ALIASES[column]
    texts = [f"""json_extract_string(record, '$."{n}"')""" for n in names]
    known = [f"CASE WHEN trim({t}) NOT IN ('', 'NR', 'N/A', 'NA', 'na') THEN {t} END" for t in texts]
    return f"coalesce({', '.join(f'TRY_CAST(trim({k}) AS DOUBLE)' if kind == 'double' else k for k in known)}) AS {column}"


ORACLE_SQL: dict[str, str] = {
    "p1_reviews": f"""SELECT DISTINCT feed, file_seq, file_id, line_no, {', '.join(map(_canonical, drift.REVIEW_ALIASES))}
FROM export_records JOIN export_files USING (file_id) WHERE json_valid(record) AND json_type(record) = 'OBJECT'""",
    "p4_found": _P4,
    "p1_found": f"""WITH {_CELLS},
pair AS (SELECT n.file_id, o.file_id AS old_id FROM export_files n JOIN export_files o ON n.feed = o.feed AND n.file_seq = o.file_seq + 1),
came AS (SELECT p.*, c.field FROM pair p JOIN cat c USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM cat o WHERE o.file_id = p.old_id AND o.field = c.field)),
went AS (SELECT p.*, c.field FROM pair p JOIN cat c ON c.file_id = p.old_id WHERE NOT EXISTS (SELECT 1 FROM cat n WHERE n.file_id = p.file_id AND n.field = c.field)),
ren AS (SELECT w.file_id, w.field AS old_field, c.field AS new_field FROM went w JOIN came c ON c.file_id = w.file_id
    JOIN filled o ON o.file_id = w.old_id AND o.field = w.field JOIN filled n ON n.file_id = w.file_id AND n.field = c.field AND n.url = o.url
    WHERE o.kind IS NOT NULL AND n.kind IS NOT NULL GROUP BY ALL HAVING bool_and(o.v = n.v AND (o.kind = 3) = (n.kind = 3)))
SELECT file_id, 'renamed' AS change, old_field, new_field FROM ren
UNION SELECT file_id, 'added', '', field FROM came c WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = c.file_id AND new_field = field)
UNION SELECT file_id, 'removed', field, '' FROM went w WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = w.file_id AND old_field = field)
UNION SELECT p.file_id, 'retyped', n.field, n.field FROM pair p JOIN cat n ON n.file_id = p.file_id JOIN cat o ON o.file_id = p.old_id AND o.field = n.field WHERE n.kind <> o.kind""",
    "p1_lifespans": f"""WITH {_CELLS},
island AS (SELECT feed, field, kind, file_seq, file_seq - row_number() OVER (PARTITION BY feed, field, kind ORDER BY file_seq) AS g FROM cat)
SELECT feed, field, kind, min(file_seq) AS first_seq, max(file_seq) AS last_seq FROM island GROUP BY feed, field, kind, g""",
}
