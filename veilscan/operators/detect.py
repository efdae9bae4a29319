"""Detectors: a text becomes rows of masked findings. Patterns run on whole texts in the JVM; what each match means is
decided by column expressions on the exploded matches. The raw value never leaves this stage."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..functions.spans import cell_label, line_label, matches, page_label

_M = f"[0-9{V.MASK_CHARS}]"
_SEP = r"[ \t\-\xa0]"
_NUMBER = rf"(?<![0-9A-Za-z]){_M}{{6}}{_SEP}?{_M}{{7}}(?![0-9])"
_SPACE = r"[-\s\x1c-\x1f]?"


@dataclass(frozen=True)
class Detector:
    """needs: what a text must match to have any match of pattern. decide: match and reference year to a struct of
    keep, status, confidence, snippet, corp_suspect."""

    key: str
    pii_type: str
    risk: str
    pattern: str
    needs: str
    decide: object
    default: bool = True


@dataclass(frozen=True)
class PythonDetector:
    """A detector of one's own. find: of a text its findings, as (start, end, status, masked value, confidence), in code
    points; it must not give the value itself. It runs where texts are extracted; what it raises costs the file this
    detector's findings alone, and is told by the exception's type."""

    key: str
    pii_type: str
    risk: str
    find: Callable[[str], Iterable[tuple[int, int, str, str, str]]]


@dataclass(frozen=True)
class ScanConfig:
    disabled: frozenset = frozenset()
    enabled: frozenset = frozenset()
    exclude_dirs: tuple = tuple(V.EXCLUDED_DIRS)
    extensions: tuple = tuple(V.EXTENSIONS)
    reference_year: int = field(default_factory=lambda: datetime.date.today().year)
    python: tuple[PythonDetector, ...] = ()

    def __post_init__(self):
        if unknown := (set(self.disabled) | set(self.enabled)) - DETECTORS.keys():
            raise ValueError(f"unknown detector keys: {', '.join(sorted(unknown))}; there are {', '.join(sorted(DETECTORS))}")


def _says(keep: Column, masked: Column, confirmed: Column, snippet: Column, suspect: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(keep, F.lit(False)).alias("keep"),
        F.when(masked, V.MASKED).otherwise(V.EXPOSED).alias("status"),
        F.when(confirmed, V.CONFIRMED).otherwise(V.PRESUMED).alias("confidence"),
        snippet.alias("snippet"),
        (F.lit(False) if suspect is None else suspect).alias("corp_suspect"),
    )


def _registration(genders: str, checked: bool):
    """Resident and foreigner numbers. checked: there is a check digit to hold a full number against."""

    def decide(v: Column, year: int) -> Column:
        n = S.strip_separators(v)
        g = F.substring(n, 7, 1)
        fits = (F.length(n) == 13) & (~g.rlike("^[0-9]$") | g.isin(*genders)) & S.birth_valid(n, year)
        masked = S.count_masks(F.substring(n, 7, 7)) >= 6
        whole = S.count_digits(n) == 13
        snippet = F.concat(F.substring(n, 1, 6), F.lit("-"), g, F.lit("******"))
        if not checked:
            return _says(fits, masked, masked, snippet)
        right, corp = S.rrn_checksum_valid(n), S.corp_checksum_valid(n)
        keep = fits & (masked | ~whole | right | S.new_era_possible(n))
        return _says(keep, masked, masked | (whole & right & ~corp), snippet, ~masked & whole & corp)

    return decide


def _passport(v: Column, year: int) -> Column:
    body = F.substring(v, 2, 8)
    return _says(S.count_digits(body) > 0, S.count_masks(body) >= 4, F.lit(False), F.concat(F.substring(v, 1, 4), F.lit("*****")))


def _driver(v: Column, year: int) -> Column:
    n = S.strip_separators(v)
    return _says(F.length(n) == 12, S.count_masks(n) >= 6, F.lit(False), F.concat(F.substring(n, 1, 4), F.lit("-******-**")))


def _tail(v: Column) -> Column:
    return F.substring(v, -4, 4)


def _mobile(v: Column, year: int) -> Column:
    # between head and tail nothing but the middle and separators, which are no mask characters
    middle = F.substring(v, F.lit(4), F.length(v) - 7)
    return _says(F.lit(True), S.count_masks(middle) >= 3, F.lit(True), F.concat(F.substring(v, 1, 3), F.lit("-****-"), _tail(v)))


_LANDLINE = rf"(?U)(?<![0-9])(0\d{{1,2}}){_SPACE}(\d{{3,4}}){_SPACE}(\d{{4}})(?![0-9])"


def _landline(v: Column, year: int) -> Column:
    head = F.regexp_extract(v, rf"(?U)^(0\d{{1,2}}){_SPACE}\d{{3,4}}{_SPACE}\d{{4}}$", 1)
    return _says(~((F.length(head) == 3) & head.startswith("01")), F.lit(False), F.lit(False), F.concat(head, F.lit("-***-"), _tail(v)))


#: A local part is tried where its run of characters begins or the last match ended, and only as a whole: the same matches
#: as the plain pattern's, in linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def _email(v: Column, year: int) -> Column:
    return _says(F.lit(True), F.lit(False), F.lit(True), S.email_snippet(v))


DETECTORS: dict[str, Detector] = {
    d.key: d
    for d in (
        Detector("rrn", V.RRN, V.CRITICAL, _NUMBER, f"{_M}{{6}}{_SEP}?{_M}{{7}}", _registration("1234", True)),
        Detector("foreign", V.FOREIGN, V.CRITICAL, _NUMBER, f"{_M}{{6}}{_SEP}?{_M}{{7}}", _registration("5678", False), default=False),
        Detector(
            "passport",
            V.PASSPORT,
            V.CRITICAL,
            rf"(?<![A-Za-z0-9{V.MASK_CHARS}])(?:[MSRODT]{_M}{{3}}[A-Z{V.MASK_CHARS}]{_M}{{4}}|[MSRODT]{_M}{{8}})(?![A-Za-z0-9{V.MASK_CHARS}])",
            f"[MSRODT]{_M}{{3}}",
            _passport,
        ),
        Detector("driver", V.DRIVER, V.CRITICAL, rf"(?<![0-9A-Za-z]){_M}{{2}}{_SEP}{_M}{{2}}{_SEP}{_M}{{6}}{_SEP}{_M}{{2}}(?![0-9])", f"{_M}{{2}}{_SEP}{_M}{{6}}{_SEP}", _driver),
        Detector("phone", V.PHONE, V.HIGH, rf"(?U)(?<![0-9])(01[016789]){_SPACE}({_M}{{3,4}}){_SPACE}(\d{{4}})(?![0-9])", "01[016789]", _mobile),
        Detector("landline", V.LANDLINE, V.LOW, _LANDLINE, r"(?U)0\d", _landline),
        Detector("email", V.EMAIL, V.MEDIUM, _EMAIL, "@", _email),
    )
}
ORDER = {k: i for i, k in enumerate(DETECTORS)}


def build_detectors(config: ScanConfig) -> list[Detector]:
    """Those on by default or enabled, unless disabled."""
    return [d for d in DETECTORS.values() if d.key not in config.disabled and (d.default or d.key in config.enabled)]


def describe_detectors(config: ScanConfig) -> tuple[list[str], list[str]]:
    """Kinds looked for, and kinds not looked for with the reason."""
    on = {d.key for d in build_detectors(config)}
    off = [d for d in DETECTORS.values() if d.key not in on]
    why = lambda d: f"--disable {d.key} 로 끔" if d.key in config.disabled else f"기본 비활성 — --enable {d.key} 로 활성화"
    return [DETECTORS[k].pii_type for k in DETECTORS if k in on], [f"{d.pii_type}({why(d)})" for d in off]


def _location(loc_kind: str | None, cells: str | None, h: Column) -> Column:
    if loc_kind is None:
        return line_label(h)
    kind = F.col(loc_kind)
    out = F.when(kind == "page", page_label(h))
    if cells:
        out = out.when(kind == "cell", cell_label(F.col(cells), h["s"]))
    return out.otherwise(line_label(h))


#: A finding of a detector in Python: its key, place, status, masked value and confidence.
FOUND = "array<struct<key:string,start:int,end:int,status:string,snippet:string,confidence:string>>"


def detect(
    df: DataFrame, text_col: str = "text", config: ScanConfig | None = None, keep: Iterable[str] = (), loc_kind: str | None = None, cells: str | None = None, found: str | None = None, whole: bool = False
) -> DataFrame:
    """One row per finding: the columns named in keep, then det_seq, start, end, pii_type, status, snippet, confidence,
    risk, location, corp_suspect. loc_kind: a column that says line, page or cell (all lines without it); cells: the
    column with the cells' places; found: a column with findings of detectors in Python (FOUND). whole: each row of df
    also gives a row with det_seq -1 and no finding. What a match means is decided once, before it becomes a row."""
    config = config or ScanConfig()
    detectors, keep = build_detectors(config), list(keep)

    def shown(d: Detector) -> Column:
        said = lambda h: F.struct(h["s"].alias("start"), h["e"].alias("end"), _location(loc_kind, cells, h).alias("location"), d.decide(h["v"], config.reference_year).alias("said"))
        kept = F.filter(F.transform(matches(text_col, d.pattern, d.needs), said), lambda x: x["said"]["keep"])
        return F.transform(kept, lambda x: _finding(F.lit(ORDER[d.key]), x["start"], x["end"], F.lit(d.pii_type), x["said"]["status"], x["said"]["snippet"], x["said"]["confidence"], F.lit(d.risk), x["location"], x["said"]["corp_suspect"]))

    none = F.lit(None).cast("string")
    parts = [F.array(_finding(F.lit(-1), F.lit(None).cast("int"), F.lit(None).cast("int"), none, none, none, none, none, none, F.lit(False)))] if whole else []
    parts += [shown(d) for d in detectors]
    if found:
        parts.append(_foreign(found, config, text_col, loc_kind, cells))
    if not parts:
        return detect(df.filter(F.lit(False)), text_col, only_email(), keep)
    return df.select(*keep, F.explode(F.concat(*parts)).alias("h")).select(*keep, "h.*")


def only_email() -> ScanConfig:
    return ScanConfig(disabled=frozenset(DETECTORS) - {"email"}, enabled=frozenset({"email"}))


def _finding(seq: Column, start: Column, end: Column, kind: Column, status: Column, snippet: Column, confidence: Column, risk: Column, location: Column, suspect: Column) -> Column:
    names = ("det_seq", "start", "end", "pii_type", "status", "snippet", "confidence", "risk", "location", "corp_suspect")
    return F.struct(*[c.alias(n) for c, n in zip((seq, start, end, kind, status, snippet, confidence, risk, location, suspect), names, strict=True)])


def _foreign(found: str, config: ScanConfig, text_col: str, loc_kind: str | None, cells: str | None) -> Column:
    """The findings of detectors in Python, with what is known of their detectors and where they are."""
    keys = [d.key for d in config.python]
    of = lambda x, values: F.element_at(F.array(*map(F.lit, values)), F.array_position(F.array(*map(F.lit, keys)), x["key"]).cast("int"))

    def place(x: Column) -> Column:
        ahead = F.substring(F.col(text_col), F.lit(1), x["start"])
        lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
        pages = F.length(ahead) - F.length(F.replace(ahead, F.lit("\f"), F.lit("")))
        return _location(loc_kind, cells, F.struct(x["start"].alias("s"), lines(ahead).alias("nl"), pages.alias("pg"), lines(F.substring_index(ahead, "\f", -1)).alias("ln")))

    row = lambda x: _finding(of(x, range(len(ORDER), len(ORDER) + len(keys))), x["start"], x["end"], of(x, [d.pii_type for d in config.python]), x["status"], x["snippet"], x["confidence"], of(x, [d.risk for d in config.python]), place(x), F.lit(False))
    return F.transform(F.coalesce(F.col(found), F.array().cast(FOUND)), row)
