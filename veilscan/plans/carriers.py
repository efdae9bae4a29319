"""Texts with identifiers made from table keys, in SQL that Spark and DuckDB read alike: the test tables hold next to none."""

from __future__ import annotations

# Weighted digit sums of a 12-digit column d, unrolled.
_RRN = " + ".join(f"CAST(substring(d, {i}, 1) AS INT) * {w}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], 1))
_CORP = " + ".join(f"CAST(substring(d, {i}, 1) AS INT) * {w}" for i, w in enumerate([1, 2] * 6, 1))

#: One number for each order: key, n13 (13 digits: birth date, gender, serial, a check digit that is right, corporate, or neither).
NUMBERS = f"""
SELECT key, spread, concat(d, CAST(CASE spread % 3 WHEN 0 THEN (11 - ({_RRN}) % 11) % 10 WHEN 1 THEN (10 - ({_CORP}) % 10) % 10 ELSE spread % 10 END AS VARCHAR(1))) AS n13
FROM (SELECT o_orderkey AS key, (o_orderkey * 7 + o_custkey) % 1009 AS spread,
  concat(lpad(CAST((o_orderkey * 3) % 100 AS VARCHAR(20)), 2, '0'), lpad(CAST(o_custkey % 14 AS VARCHAR(20)), 2, '0'), lpad(CAST((o_orderkey + o_custkey) % 33 AS VARCHAR(20)), 2, '0'),
         CAST(1 + (o_orderkey + o_custkey) % 8 AS VARCHAR(20)), lpad(CAST((o_orderkey * 31 + o_custkey) % 100000 AS VARCHAR(20)), 5, '0')) AS d FROM orders) AS _n
"""

#: The number as text, whole or masked in one of three ways: key, text.
REGISTRATIONS = f"""
SELECT key, n13, spread, CASE spread % 5 WHEN 0 THEN concat(substring(n13, 1, 6), '-', substring(n13, 7, 1), '******')
  WHEN 1 THEN concat(substring(n13, 1, 6), ' ', substring(n13, 7, 4), '***') WHEN 2 THEN concat('******-', substring(n13, 7, 7))
  WHEN 3 THEN n13 ELSE concat(substring(n13, 1, 6), '-', substring(n13, 7, 7)) END AS text
FROM ({NUMBERS}) AS _r
"""

PASSPORTS = """
SELECT p_partkey AS key, concat(substring('MSRODTNG', CAST(1 + p_partkey % 8 AS INT), 1), CASE p_partkey % 4
  WHEN 0 THEN lpad(CAST(p_partkey * 97 % 100000000 AS VARCHAR(20)), 8, '0') WHEN 1 THEN concat(lpad(CAST(p_partkey % 1000 AS VARCHAR(20)), 3, '0'), '*****')
  WHEN 2 THEN concat(lpad(CAST(p_partkey % 1000 AS VARCHAR(20)), 3, '0'), 'A', lpad(CAST(p_partkey % 10000 AS VARCHAR(20)), 4, '0')) ELSE '********' END) AS text FROM part
"""

DRIVERS = """
SELECT l_orderkey AS key, l_linenumber AS line, concat(lpad(CAST(11 + l_suppkey % 16 AS VARCHAR(20)), 2, '0'), sep, lpad(CAST(l_partkey % 100 AS VARCHAR(20)), 2, '0'), sep,
  CASE l_linenumber % 3 WHEN 0 THEN '34****' ELSE lpad(CAST(l_partkey * 13 % 1000000 AS VARCHAR(20)), 6, '0') END, sep,
  CASE l_linenumber % 3 WHEN 0 THEN '**' ELSE lpad(CAST(l_orderkey % 100 AS VARCHAR(20)), 2, '0') END) AS text
FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END AS sep FROM lineitem) AS _d
"""

PHONES = """
SELECT c_custkey AS key, concat('01', CAST(c_custkey % 10 AS VARCHAR(20)), sep, CASE c_custkey % 4 WHEN 0 THEN '****' WHEN 1 THEN lpad(CAST(c_custkey % 1000 AS VARCHAR(20)), 3, '0') ELSE lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0') END,
  sep, lpad(CAST(c_custkey * 17 % 10000 AS VARCHAR(20)), 4, '0')) AS text
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END AS sep FROM customer) AS _p
"""

LANDLINES = """
SELECT s_suppkey AS key, concat('0', CASE s_suppkey % 3 WHEN 0 THEN '2' ELSE CAST(s_suppkey % 90 AS VARCHAR(20)) END, '-', lpad(CAST(s_suppkey * 7 % 1000 AS VARCHAR(20)), 3, '0'), '-',
  lpad(CAST(s_suppkey * 11 % 10000 AS VARCHAR(20)), 4, '0')) AS text FROM supplier
"""

#: Findings as a scan would make them: path, file_seq, det_seq, start, pii_type, status.
HITS = """
SELECT concat('/data/', o_orderpriority, '/', CAST(o_custkey % 300 AS VARCHAR(20)), '.txt') AS path, o_custkey % 300 AS file_seq, CAST(o_orderkey % 7 AS INT) AS det_seq, o_orderkey AS start,
  CASE o_orderkey % 7 WHEN 0 THEN '주민등록번호' WHEN 1 THEN '외국인등록번호' WHEN 2 THEN '여권번호' WHEN 3 THEN '운전면허번호' WHEN 4 THEN '휴대폰' WHEN 5 THEN '유선전화' ELSE '이메일' END AS pii_type,
  CASE WHEN (o_orderkey + o_custkey) % 3 = 0 THEN '마스킹' ELSE '노출' END AS status FROM orders
"""

#: Findings in cells: path, location, pii_type, corp_suspect.
CELL_HITS = """
SELECT concat('/data/', CAST(l_suppkey % 50 AS VARCHAR(20)), '.xlsx') AS path,
  CASE WHEN l_linenumber = 7 THEN concat('L', CAST(l_orderkey AS VARCHAR(20))) ELSE concat('Sheet1!', substring('ABCDEF', CAST(1 + l_linenumber % 6 AS INT), 1), CAST(l_orderkey AS VARCHAR(20))) END AS location,
  CASE WHEN l_returnflag = 'N' THEN '주민등록번호' ELSE '여권번호' END AS pii_type, (l_orderkey * 7 + l_partkey) % 10 < 5 + l_linenumber % 5 AS corp_suspect, l_orderkey, l_linenumber FROM lineitem
"""

#: Files of a scan: path, error, encrypted, unreadable, corp_filtered.
FILES = """
SELECT concat('/data/', CAST(c_custkey AS VARCHAR(20))) AS path, c_custkey AS file_seq, CASE c_custkey % 9 WHEN 0 THEN '추출 실패: BadZipFile' WHEN 1 THEN '접근 실패: 권한 없음' ELSE NULL END AS error,
  c_custkey % 11 = 0 AS encrypted, c_custkey % 9 = 1 AS unreadable, CAST(c_custkey % 4 AS INT) AS corp_filtered FROM customer
"""
