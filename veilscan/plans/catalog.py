"""Queries over the test tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import spans
from ..functions import values as V
from ..operators import report as R
from ..operators.corp_filter import mark_corp
from ..operators.detect import DETECTORS, ScanConfig, detect
from . import carriers as C

YEAR = 2026
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carrier(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """SQL over one table, read from sf_dir."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def only(*keys: str) -> ScanConfig:
    return ScanConfig(disabled=frozenset(DETECTORS) - set(keys), enabled=frozenset(keys), reference_year=YEAR)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in the documents: kind, status, place and masked value."""
    return detect(table(spark, sf_dir, "documents"), config=ScanConfig(reference_year=YEAR), keep=["doc_id"]).drop("corp_suspect")


SAID = ["pii_type", "status", "snippet", "confidence", "risk", "corp_suspect"]
#: Of a match m in DuckDB: where it starts, from the text's parts before it.
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def _email_sql(table: str, key: str, text: str) -> str:
    return f"""
WITH m AS (SELECT {key}, {text} AS t, regexp_extract_all({text}, '{_EMAIL}') AS ms FROM {table} WHERE contains({text}, '@')),
p AS (SELECT {key}, t, ms, i, ms[i] AS v FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
g AS (SELECT {key}, t, i, v, regexp_split_to_array(t, '{_EMAIL}') AS gs, ms FROM p),
s AS (SELECT *, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
  length(split_part(v, '@', 1)) AS n FROM g),
k AS (SELECT *, least(2, greatest(1, n - 1)) AS keep FROM s)
SELECT {key}, start, CAST(start + length(v) AS INTEGER) AS "end", '{V.EMAIL}' AS pii_type, '{V.EXPOSED}' AS status,
  concat(substring(v, 1, keep), repeat('*', least(5, greatest(1, n - keep))), substring(v, n + 1)) AS snippet, '{V.CONFIRMED}' AS confidence, '{V.MEDIUM}' AS risk,
  concat('L', CAST(length(substring(t, 1, start)) - length(replace(substring(t, 1, start), chr(10), '')) + 1 AS VARCHAR)) AS location
FROM k"""


@query("detect_email", _email_sql("documents", "doc_id", "text"))
def detect_email(spark, sf_dir):
    return detect(table(spark, sf_dir, "documents"), config=only("email"), keep=["doc_id"]).drop("det_seq", "corp_suspect")


@query("detect_email_pages", _email_sql("pages", "page_id", "html"))
def detect_email_pages(spark, sf_dir):
    return detect(table(spark, sf_dir, "pages"), "html", only("email"), keep=["page_id"]).drop("det_seq", "corp_suspect")


# What holds for a 13-character number n (separators taken out) of a carrier.
_BORN = "try_strptime(concat(CASE WHEN g IN ('1', '2', '5', '6') THEN '19' WHEN g IN ('9', '0') THEN '18' ELSE '20' END, substring(n, 1, 6)), '%Y%m%d')"
_R_SUM = " + ".join(f"CAST(substring(n, {i}, 1) AS INT) * {w}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], 1))
_C_SUM = " + ".join(f"CAST(substring(n, {i}, 1) AS INT) * {w}" for i, w in enumerate([1, 2] * 6, 1))
_WHOLE = "regexp_full_match(n, '[0-9]{13}')"
_RIGHT = f"CASE WHEN {_WHOLE} THEN (11 - ({_R_SUM}) % 11) % 10 = CAST(substring(n, 13, 1) AS INT) ELSE false END"
_CORP = f"CASE WHEN {_WHOLE} THEN (10 - ({_C_SUM}) % 10) % 10 = CAST(substring(n, 13, 1) AS INT) ELSE false END"
_N = f"SELECT *, replace(replace(text, '-', ''), ' ', '') AS n, substring(replace(replace(text, '-', ''), ' ', ''), 7, 1) AS g FROM ({C.REGISTRATIONS}) AS c"
_D = f"SELECT *, regexp_full_match(substring(n, 1, 6), '[0-9]{{6}}') AS dated, {_BORN} AS born, length(n) - length(replace(n, '*', '')) AS stars, {_WHOLE} AS whole, {_RIGHT} AS right_, {_CORP} AS corp FROM ({_N}) AS c"
_DATE_OK = f"(NOT dated OR (born IS NOT NULL AND year(born) <= {YEAR}))"
_TAIL = "length(substring(n, 7)) - length(replace(substring(n, 7), '*', '')) >= 6"
_SNIPPET = "concat(substring(n, 1, 6), '-', g, '******')"


@query(
    "detect_rrn",
    f"""SELECT key, '{V.RRN}' AS pii_type, CASE WHEN {_TAIL} THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END AS status, {_SNIPPET} AS snippet,
CASE WHEN {_TAIL} OR (whole AND right_ AND NOT corp) THEN '{V.CONFIRMED}' ELSE '{V.PRESUMED}' END AS confidence, '{V.CRITICAL}' AS risk, whole AND corp AS corp_suspect
FROM ({_D}) AS c WHERE g IN ('1', '2', '3', '4', '*') AND {_DATE_OK} AND ({_TAIL} OR NOT whole OR right_ OR coalesce(born >= DATE '2020-09-01', false))""",
)
def detect_rrn(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.REGISTRATIONS, "orders"), config=only("rrn"), keep=["key"]).select("key", *SAID)


@query(
    "detect_foreign",
    f"""SELECT key, '{V.FOREIGN}' AS pii_type, CASE WHEN {_TAIL} THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END AS status, {_SNIPPET} AS snippet,
CASE WHEN {_TAIL} THEN '{V.CONFIRMED}' ELSE '{V.PRESUMED}' END AS confidence, '{V.CRITICAL}' AS risk, false AS corp_suspect
FROM ({_D}) AS c WHERE g IN ('5', '6', '7', '8', '*') AND {_DATE_OK}""",
)
def detect_foreign(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.REGISTRATIONS, "orders"), config=only("foreign"), keep=["key"]).select("key", *SAID)


@query(
    "detect_passport",
    f"""SELECT key, '{V.PASSPORT}' AS pii_type, CASE WHEN length(text) - length(replace(text, '*', '')) >= 4 THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END AS status,
concat(substring(text, 1, 4), '*****') AS snippet, '{V.PRESUMED}' AS confidence, '{V.CRITICAL}' AS risk, false AS corp_suspect
FROM ({C.PASSPORTS}) AS c WHERE regexp_full_match(text, '[MSRODT]([0-9*]{{8}}|[0-9*]{{3}}[A-Z*][0-9*]{{4}})') AND regexp_matches(text, '[0-9]')""",
)
def detect_passport(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.PASSPORTS, "part"), config=only("passport"), keep=["key"]).select("key", *SAID)


@query(
    "detect_driver",
    f"""SELECT key, line, '{V.DRIVER}' AS pii_type, CASE WHEN length(text) - length(replace(text, '*', '')) >= 6 THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END AS status,
concat(substring(replace(replace(text, '-', ''), ' ', ''), 1, 4), '-******-**') AS snippet, '{V.PRESUMED}' AS confidence, '{V.CRITICAL}' AS risk, false AS corp_suspect
FROM ({C.DRIVERS}) AS c WHERE regexp_full_match(text, '[0-9*]{{2}}[- ][0-9*]{{2}}[- ][0-9*]{{6}}[- ][0-9*]{{2}}')""",
)
def detect_driver(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.DRIVERS, "lineitem"), config=only("driver"), keep=["key", "line"]).select("key", "line", *SAID)


@query(
    "detect_mobile",
    f"""SELECT key, '{V.PHONE}' AS pii_type, CASE WHEN text LIKE '%***%' THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END AS status, concat(substring(text, 1, 3), '-****-', right(text, 4)) AS snippet,
'{V.CONFIRMED}' AS confidence, '{V.HIGH}' AS risk, false AS corp_suspect FROM ({C.PHONES}) AS c WHERE regexp_full_match(text, '01[016789][- ]?[0-9*]{{3,4}}[- ]?[0-9]{{4}}')""",
)
def detect_mobile(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.PHONES, "customer"), config=only("phone"), keep=["key"]).select("key", *SAID)


@query(
    "detect_landline",
    f"""SELECT key, '{V.LANDLINE}' AS pii_type, '{V.EXPOSED}' AS status, concat(split_part(text, '-', 1), '-***-', right(text, 4)) AS snippet, '{V.PRESUMED}' AS confidence, '{V.LOW}' AS risk,
false AS corp_suspect FROM ({C.LANDLINES}) AS c WHERE regexp_full_match(text, '0[0-9]{{1,2}}-[0-9]{{3,4}}-[0-9]{{4}}') AND NOT regexp_matches(text, '^01[0-9]-')""",
)
def detect_landline(spark, sf_dir):
    return detect(carrier(spark, sf_dir, C.LANDLINES, "supplier"), config=only("landline"), keep=["key"]).select("key", *SAID)


_LUHN = " + ".join(f"CASE WHEN {i} % 2 = 0 THEN (CAST(substring(n, {i}, 1) AS INT) * 2) // 10 + (CAST(substring(n, {i}, 1) AS INT) * 2) % 10 ELSE CAST(substring(n, {i}, 1) AS INT) END" for i in range(1, 14))


@query("checksums", f"SELECT key, n AS n13, {_RIGHT} AS rrn, {_CORP} AS corp, ({_LUHN}) % 10 = 0 AS luhn FROM (SELECT key, n13 AS n FROM ({C.NUMBERS}) AS c) AS d")
def checksums(spark, sf_dir):
    n = F.col("n13")
    return carrier(spark, sf_dir, C.NUMBERS, "orders").select("key", "n13", S.rrn_checksum_valid(n).alias("rrn"), S.corp_checksum_valid(n).alias("corp"), S.luhn_valid(n).alias("luhn"))


@query("birth_dates", f"SELECT key, {_DATE_OK} AS valid, dated AND coalesce(born >= DATE '2020-09-01', false) AS new_era FROM ({_D}) AS c")
def birth_dates(spark, sf_dir):
    n = S.strip_separators(F.col("text"))
    return carrier(spark, sf_dir, C.REGISTRATIONS, "orders").select("key", S.birth_valid(n, YEAR).alias("valid"), S.new_era_possible(n).alias("new_era"))


@query("mask_stats", f"SELECT key, n AS bare, length(n) - length(replace(n, '*', '')) AS masks, length(regexp_replace(n, '[^0-9]', '', 'g')) AS digits FROM ({_N}) AS c")
def mask_stats(spark, sf_dir):
    n = S.strip_separators(F.col("text"))
    return carrier(spark, sf_dir, C.REGISTRATIONS, "orders").select("key", n.alias("bare"), S.count_masks(n).cast("bigint").alias("masks"), S.count_digits(n).cast("bigint").alias("digits"))


@query(
    "line_location",
    """SELECT doc_id, count(*) AS n, CAST(max(CAST(substring(l, 2) AS BIGINT)) AS BIGINT) AS last_line, CAST(sum(CAST(substring(l, 2) AS BIGINT)) AS BIGINT) AS lines FROM (
SELECT doc_id, concat('L', CAST(sum(len(g) - len(replace(g, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS VARCHAR)) AS l
FROM (SELECT doc_id, k, i, gs[i] AS g FROM (SELECT doc_id, len(gs) - 1 AS k, gs, unnest(range(1, len(gs))) AS i FROM (SELECT doc_id, string_split(text, 'the') AS gs FROM documents))) ) GROUP BY doc_id""",
)
def line_location(spark, sf_dir):
    h = F.explode(F.transform(spans.matches("text", "the"), spans.line_label))
    line = F.substring("l", 2, 20).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("l")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(line).alias("last_line"), F.sum(line).alias("lines"))


@query(
    "page_location",
    """SELECT key, concat('p.', CAST(1 + key % 5 AS VARCHAR), ' L', CAST(1 + key % 7 AS VARCHAR)) AS location FROM (SELECT o_orderkey AS key FROM orders)""",
)
def page_location(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey as key", r"concat(repeat(concat('a\n', chr(12)), cast(o_orderkey % 5 as int)), repeat('b\n', cast(o_orderkey % 7 as int)), 'a@b.com') as text")
    d = d.withColumn("kind", F.lit("page"))
    return detect(d, config=only("email"), keep=["key"], loc_kind="kind").select("key", "location")


@query(
    "cell_location",
    """SELECT key, CASE WHEN pos < 0 THEN NULL ELSE concat('S!', CASE WHEN c <= 26 THEN chr(CAST(64 + c AS INT)) WHEN c <= 702 THEN concat(chr(CAST(65 + (c - 27) // 26 AS INT)), chr(CAST(65 + (c - 27) % 26 AS INT)))
ELSE concat(chr(CAST(65 + (c - 703) // 676 AS INT)), chr(CAST(65 + (c - 703) // 26 % 26 AS INT)), chr(CAST(65 + (c - 703) % 26 AS INT))) END, CAST(pos + 1 AS VARCHAR)) END AS location
FROM (SELECT o_orderkey AS key, o_orderkey % 10 - 1 AS pos, 1 + o_custkey * 37 % 16384 AS c FROM orders)""",
)
def cell_location(spark, sf_dir):
    # nine cells of five characters each from place 5 on
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey as key", "cast(o_orderkey % 10 * 5 as int) as at", "struct(transform(sequence(1, 9), i -> i * 5) as start, sequence(1, 9) as row, array_repeat(cast(1 + o_custkey * 37 % 16384 as int), 9) as col, array(0) as first, array('S') as sheet) as cells")
    return d.select("key", spans.cell_label(F.col("cells"), F.col("at")).alias("location"))


@query(
    "corp_column_filter",
    f"""SELECT path, pii_type, count(*) AS n, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS corp_filtered FROM (
SELECT path, pii_type, location LIKE 'Sheet1!%' AND corp_suspect AND count(*) OVER w >= 3 AND (sum(CASE WHEN corp_suspect THEN 1 ELSE 0 END) OVER w)::DOUBLE / count(*) OVER w >= 0.7 AS gone
FROM ({C.CELL_HITS}) AS c WINDOW w AS (PARTITION BY path, pii_type, CASE WHEN location LIKE 'Sheet1!%' THEN substring(location, 8, 1) ELSE '' END)) GROUP BY path, pii_type""",
)
def corp_column_filter(spark, sf_dir):
    m = mark_corp(carrier(spark, sf_dir, C.CELL_HITS, "lineitem"))
    return m.groupBy("path", "pii_type").agg(F.count("*").alias("n"), F.count_if("corp_dropped").alias("corp_filtered"))


@query("summary_kpi", f"SELECT count(*) FILTER (status = '{V.EXPOSED}') AS exposed, count(*) FILTER (status <> '{V.EXPOSED}') AS masked, count(*) FILTER (status <> '{V.EXPOSED}')::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS masking_rate FROM ({C.HITS}) AS h")
def summary_kpi(spark, sf_dir):
    return R.hit_totals(carrier(spark, sf_dir, C.HITS, "orders"))


@query(
    "file_totals",
    f"""SELECT count(*) FILTER (NOT unreadable) AS total_files, count(*) FILTER (NOT unreadable AND NOT encrypted AND error IS NOT NULL) AS error_files, count(*) FILTER (NOT unreadable AND encrypted) AS encrypted_files,
count(*) FILTER (unreadable) AS unreadable_paths, CAST(coalesce(sum(corp_filtered) FILTER (NOT unreadable AND NOT encrypted), 0) AS BIGINT) AS corp_filtered FROM ({C.FILES}) AS f""",
)
def file_totals(spark, sf_dir):
    return R.file_totals(carrier(spark, sf_dir, C.FILES, "customer"))


_BY = f"count(*) FILTER (status = '{V.EXPOSED}') AS exposed, count(*) FILTER (status <> '{V.EXPOSED}') AS masked FROM ({C.HITS}) AS h"


@query("by_type", f"SELECT pii_type, {_BY} GROUP BY pii_type")
def by_type(spark, sf_dir):
    return R.by_type(carrier(spark, sf_dir, C.HITS, "orders"))


@query("by_type_rollup", f"SELECT pii_type, {_BY} GROUP BY ROLLUP (pii_type)")
def by_type_rollup(spark, sf_dir):
    return R.by_type_rollup(carrier(spark, sf_dir, C.HITS, "orders"))


@query("top_risk_files", f"SELECT path, count(*) AS exposed FROM ({C.HITS}) AS h WHERE status = '{V.EXPOSED}' GROUP BY path, file_seq ORDER BY count(*) DESC, file_seq, path LIMIT 20")
def top_risk_files(spark, sf_dir):
    hits = carrier(spark, sf_dir, C.HITS, "orders")
    return R.top_files(hits)


@query(
    "row_budget",
    f"""SELECT path, pii_type, status, start FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY file_seq, det_seq, start) AS rn, count(*) FILTER (tier = 0) OVER () AS n0, count(*) FILTER (tier = 1) OVER () AS n1 FROM (
SELECT *, CASE WHEN pii_type NOT IN ('{V.RRN}', '{V.FOREIGN}', '{V.PASSPORT}', '{V.DRIVER}') THEN 2 WHEN status = '{V.EXPOSED}' THEN 0 ELSE 1 END AS tier FROM ({C.HITS}) AS h))
WHERE rn <= CASE tier WHEN 0 THEN 10000 WHEN 1 THEN greatest(0, least(n1, 10000 - n0)) ELSE greatest(0, 10000 - n0 - n1) END""",
)
def row_budget(spark, sf_dir):
    return R.row_budget(carrier(spark, sf_dir, C.HITS, "orders"), 10_000).select("path", "pii_type", "status", "start")


@query("error_classes", f"SELECT path, coalesce(error, '') AS reason, CASE WHEN unreadable THEN '접근 실패' ELSE '파일 처리 실패' END AS class FROM ({C.FILES}) AS f WHERE unreadable OR (NOT encrypted AND error IS NOT NULL)")
def error_classes(spark, sf_dir):
    return R.error_classes(carrier(spark, sf_dir, C.FILES, "customer"))


@query("resume_anti_join", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("union_access_errors", f"SELECT path, error, unreadable FROM ({C.FILES}) AS f WHERE NOT unreadable UNION ALL SELECT path, error, true AS unreadable FROM ({C.FILES}) AS f WHERE unreadable")
def union_access_errors(spark, sf_dir):
    f = carrier(spark, sf_dir, C.FILES, "customer").select("path", "error", "unreadable")
    return f.filter("not unreadable").unionByName(f.filter("unreadable"))


_PATHS = "SELECT l_orderkey AS key, l_linenumber AS line, concat('/', substring('ab.git__pycache__x', CAST(1 + l_partkey % 12 AS INT), 6), '/f', substring('.TXT.bin.xlsx..csv', CAST(1 + l_suppkey % 4 * 4 AS INT), 5)) AS path FROM lineitem"


@query("listing_predicates", f"SELECT key, line, path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '([.][^.]*)$', 1)) IN ({', '.join(repr(x) for x in V.EXTENSIONS)}) AS wanted, contains(lower(split_part(path, '/', 2)), '.git') OR contains(lower(split_part(path, '/', 2)), '__pycache__') AS pruned FROM ({_PATHS}) AS p")
def listing_predicates(spark, sf_dir):
    p = carrier(spark, sf_dir, _PATHS, "lineitem")
    folder = F.lower(F.split("path", "/")[1])
    pruned = F.exists(F.array(*map(F.lit, V.EXCLUDED_DIRS)), lambda x: F.contains(folder, x))
    return p.select("key", "line", "path", S.extension(F.col("path")).isin(*V.EXTENSIONS).alias("wanted"), pruned.alias("pruned"))


@query("text_scalars", "SELECT page_id, parse_filename(split_part(url, '?', 1)) AS base, length(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', '''')) AS bare, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')) AS escaped, length(regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '?', 'g')) AS safe FROM pages")
def text_scalars(spark, sf_dir):
    h = F.col("html")
    n = lambda c: F.length(c).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", S.base_name(F.substring_index("url", "?", 1)).alias("base"), n(S.unescape(h)).alias("bare"), n(S.escape_html(h)).alias("escaped"), n(S.safe_text(h)).alias("safe"))


@query("column_letters", "SELECT n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN concat(chr(CAST(65 + (n - 27) // 26 AS INT)), chr(CAST(65 + (n - 27) % 26 AS INT))) ELSE concat(chr(CAST(65 + (n - 703) // 676 AS INT)), chr(CAST(65 + (n - 703) // 26 % 26 AS INT)), chr(CAST(65 + (n - 703) % 26 AS INT))) END AS letters FROM (SELECT unnest(range(1, 16385)) AS n)")
def column_letters(spark, sf_dir):
    return spark.range(1, 16385).select(F.col("id").alias("n"), S.column_letters(F.col("id")).alias("letters"))


@query("state_json", """SELECT path, CAST(json_extract(j, '$.corp_filtered') AS BIGINT) AS corp_filtered, CAST(json_extract(j, '$.encrypted') AS BOOLEAN) AS encrypted, json_extract_string(j, '$.error') AS error FROM (SELECT path, to_json({'path': path, 'error': error, 'encrypted': encrypted, 'corp_filtered': corp_filtered}) AS j FROM (""" + C.FILES + ") AS f)")
def state_json(spark, sf_dir):
    f = carrier(spark, sf_dir, C.FILES, "customer").select(F.to_json(F.struct("path", "error", "encrypted", "corp_filtered"), {"ignoreNullFields": "false"}).alias("j"))
    row = f.select(F.from_json("j", V.STATE).alias("r"))
    return row.select("r.path", F.coalesce("r.corp_filtered", F.lit(0)).cast("bigint").alias("corp_filtered"), F.coalesce("r.encrypted", F.lit(False)).alias("encrypted"), "r.error")


#: Numbers with what must not be a digit around them; the other kinds don't come in the documents and have queries of their own.
_LINE = r"(?:^|[^0-9])(0[0-9]{1,2})[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}(?:[^0-9]|$)"
_MOBILE = r"(?:^|[^0-9])(01[016789][-\s]?[0-9*]{3,4}[-\s]?[0-9]{4})(?:[^0-9]|$)"


@query(
    "findings_by_source",
    f"""SELECT source, pii_type, status, count(*) AS n FROM (
SELECT source, '{V.EMAIL}' AS pii_type, '{V.EXPOSED}' AS status, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents
UNION ALL SELECT source, '{V.LANDLINE}', '{V.EXPOSED}', v FROM (SELECT source, unnest(regexp_extract_all(text, '{_LINE}', 1)) AS v FROM documents) WHERE NOT regexp_full_match(v, '01[0-9]')
UNION ALL SELECT source, '{V.PHONE}', CASE WHEN v LIKE '%***%' THEN '{V.MASKED}' ELSE '{V.EXPOSED}' END, v FROM (SELECT source, unnest(regexp_extract_all(text, '{_MOBILE}', 1)) AS v FROM documents)
) AS f GROUP BY source, pii_type, status""",
)
def findings_by_source(spark, sf_dir):
    """All kinds over the documents, by source: what a report on a corpus starts from."""
    found = detect(table(spark, sf_dir, "documents"), config=ScanConfig(enabled=frozenset({"foreign"}), reference_year=YEAR), keep=["source"])
    return found.groupBy("source", "pii_type", "status").agg(F.count("*").alias("n"))
