"""Labels, keys, patterns and schemas that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "0.1.0"

# What results must say.
RRN, FOREIGN, PASSPORT, DRIVER = "주민등록번호", "외국인등록번호", "여권번호", "운전면허번호"
PHONE, LANDLINE, EMAIL = "휴대폰", "유선전화", "이메일"
EXPOSED, MASKED = "노출", "마스킹"
EXTRACTION, PARTIAL = "추출 실패: ", "탐지 일부 실패: "
CONFIRMED, PRESUMED = "confirmed", "추정"
CRITICAL, HIGH, MEDIUM, LOW = "최상", "높음", "중간", "낮음"
MASK_CHARS = "*●■○xX＊"
SEPARATORS = " \t- "

#: Kinds that a report takes in first.
KEY_TYPES = [RRN, FOREIGN, PASSPORT, DRIVER]

#: Extensions that are read.
EXTENSIONS = [".txt", ".csv", ".hwpx", ".docx", ".xlsx", ".xls", ".pdf", ".hwp", ".png", ".jpg", ".jpeg"]
EXCLUDED_DIRS = [".git", "__pycache__"]

_INTS = T.ArrayType(T.IntegerType())

#: The places of a text's cells, packed: where each starts, its row and column (from 1); and by sheet its first cell and name.
CELLS = T.StructType([T.StructField("start", _INTS), T.StructField("row", _INTS), T.StructField("col", _INTS), T.StructField("first", _INTS), T.StructField("sheet", T.ArrayType(T.StringType()))])

TEXTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_seq", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loc_kind", T.StringType()),
        T.StructField("cells", CELLS),
        T.StructField("error", T.StringType()),
        T.StructField("encrypted", T.BooleanType()),
        T.StructField("unreadable", T.BooleanType()),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("snippet", T.StringType()), T.StructField("confidence", T.StringType())]))),
        T.StructField("failed", T.ArrayType(T.StringType())),
    ]
)

_HIT = [
    T.StructField("pii_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("risk", T.StringType()),
    T.StructField("location", T.StringType()),
]

#: A file's result as the state keeps it.
STATE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("encrypted", T.BooleanType()),
        T.StructField("corp_filtered", T.IntegerType()),
        T.StructField("hits", T.ArrayType(T.StructType(_HIT))),
    ]
)

# Names of sheets and heads of columns, labels of totals, marks of error classes.
SHEETS = ("findings", "errors", "encrypted", "summary")
FINDING_HEAD = ["파일경로", "파일명", "PII종류", "위험등급", "상태", "마스킹스니펫", "위치", "검증"]
ERROR_HEAD = ["파일경로", "사유", "구분"]
ENCRYPTED_HEAD = ["파일경로"]
TYPE_HEAD = ["PII종류", "노출", "마스킹"]
UNREADABLE_CLASS, FAILED_CLASS = "접근 실패", "파일 처리 실패"
TOTALS = {
    "scanned_at": "스캔 일시",
    "tool_version": "도구 버전",
    "total_files": "스캔 파일 수",
    "error_files": "추출 실패 수",
    "encrypted_files": "암호화 건너뜀 수",
    "exposed": "노출(EXPOSED)",
    "masked": "마스킹(MASKED)",
    "masking_rate": "마스킹률(%)",
    "corp_filtered": "법인등록번호 오탐 제거",
}
