"""Column expressions for checksums, masks, birth dates and masked snippets. All stay in the JVM and none can fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

DIGITS = "0123456789"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once: within lambdas Catalyst would otherwise repeat it."""
    return F.transform(F.array(value), body)[0]


def digit(s: Column, at: int) -> Column:
    """The digit at a place (from 1); null if there is none."""
    return F.substring(s, at, 1).try_cast("int")


def weighted(s: Column, weights: list[int]) -> Column:
    """Sum of the first digits times weights, unrolled so that it compiles."""
    total = F.lit(0)
    for at, w in enumerate(weights, 1):
        total = total + digit(s, at) * w
    return total


def _thirteen(s: Column) -> Column:
    return s.rlike("^[0-9]{13}$")


def rrn_checksum_valid(s: Column) -> Column:
    """Weights 2 to 9, then 2 to 5; false unless s is 13 digits."""
    want = F.pmod(F.lit(11) - F.pmod(weighted(s, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]), F.lit(11)), F.lit(10))
    return F.coalesce(_thirteen(s) & (want == digit(s, 13)), F.lit(False))


def corp_checksum_valid(s: Column) -> Column:
    """Corporate number: weights 1 and 2 in turn, digits of products not added up; false unless s is 13 digits."""
    want = F.pmod(F.lit(10) - F.pmod(weighted(s, [1, 2] * 6), F.lit(10)), F.lit(10))
    return F.coalesce(_thirteen(s) & (want == digit(s, 13)), F.lit(False))


def luhn_valid(s: Column) -> Column:
    """Of the digits in s, 13 at least."""
    d = F.regexp_replace(s, "[^0-9]", "")
    return F.coalesce((F.length(d) >= 13) & F.call_function("luhn_check", d), F.lit(False))


def strip_separators(s: Column) -> Column:
    return F.translate(s, V.SEPARATORS + ".", "")


def count_masks(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, V.MASK_CHARS, ""))


def count_digits(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, DIGITS, ""))


def is_mask_char(s: Column) -> Column:
    return F.coalesce((F.length(s) == 1) & (count_masks(s) == 1), F.lit(False))


def birth_date(norm: Column) -> Column:
    """The date that digits 1 to 6 give, in the century of digit 7 (2000 if that is no digit); null if there is none."""
    g = F.substring(norm, 7, 1)
    century = F.when(g.isin("1", "2", "5", "6"), "19").when(g.isin("9", "0"), "18").otherwise("20")
    return F.when(F.substring(norm, 1, 6).rlike("^[0-9]{6}$"), F.try_to_timestamp(F.concat(century, F.substring(norm, 1, 6)), F.lit("yyyyMMdd")).cast("date"))


def birth_valid(norm: Column, reference_year: int) -> Column:
    """Whether digits 1 to 6 can be a birth date: a hidden one can; known centuries must not lie in the future."""
    born = birth_date(norm)
    ahead = F.substring(norm, 7, 1).rlike("^[0-9]$") & (F.year(born) > reference_year)
    return F.when(F.substring(norm, 1, 6).rlike("^[0-9]{6}$"), F.coalesce(born.isNotNull() & ~ahead, F.lit(False))).otherwise(True)


def new_era_possible(norm: Column) -> Column:
    """Born when numbers without a check digit were already given out."""
    return F.coalesce(birth_date(norm) >= F.lit("2020-09-01").cast("date"), F.lit(False))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column from 1 to 18,278: 1 is A, 27 is AA."""
    letter = lambda x: F.char((x + 65).cast("int"))
    one, two, three = n - 1, n - 27, n - 703
    by = lambda x, unit: letter(F.pmod(F.floor(x / unit), F.lit(26)))
    return F.when(n <= 26, by(one, 1)).when(n <= 702, F.concat(by(two, 26), by(two, 1))).otherwise(F.concat(by(three, 676), by(three, 26), by(three, 1)))


def email_snippet(v: Column) -> Column:
    n = F.length(F.substring_index(v, "@", 1))
    keep = F.least(F.lit(2), F.greatest(F.lit(1), n - 1))
    stars = F.least(F.lit(5), F.greatest(F.lit(1), n - keep))
    return F.concat(F.substring(v, F.lit(1), keep), F.repeat(F.lit("*"), stars), F.substring(v, n + 1, F.length(v)))


def safe_text(v: Column) -> Column:
    """Control characters that XML can't hold become U+FFFD."""
    return F.regexp_replace(v, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "�")


def unescape(v: Column) -> Column:
    """The five XML entities, in this order: what '&amp;' frees can be one of the last two."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return v


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; names that only start with dots have none."""
    return F.lower(F.regexp_extract(F.regexp_replace(base_name(path), "^[.]+", ""), "([.][^.]*)$", 1))


def escape_html(v: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(char), F.lit(entity))
    return v
