r"""Personal data and the terms that give it away; DataFrame and SQL functions only.

Base: patterns for e-mail addresses, IP addresses, payment cards and phone numbers. Then information-theoretic
sanitisation: each distinct value found is a protected entity e, and so is the group that rare values belong to (a mail
domain, an IP network, a card issuer, a phone prefix). A term t of the texts that hold e discloses e as far as
PMI(e; t) = log2(p(e, t) / (p(e) p(t))) comes up to e's information IC(e) = -log2 p(e); probabilities are shares of all
documents, and e and t meet wherever they stand in one. A term discloses where PMI >= disclose * IC, IC is `bits` or
more and e has `support` documents with t; then every occurrence, in any document, is a span of its own, and sanitised() replaces it: removed where PMI >= remove * IC, else generalised to
the class of its shape. Terms are words outside base spans, but for one or two small Latin letters.

Pairs of entities and terms are counted first, in the documents that hold an entity with support; only terms of pairs with
support are counted over all documents. Counts are aggregated before they are shuffled; texts are only where the list
of documents with a disclosing term is too large to be broadcast.

The patterns are written so that they find what the plain ones find, yet in linear time and without recursion: runs
are possessive and start at a run's beginning or where the last match ended (\G).

Edge cases: a null text is the empty text and has no span; repeated rows are documents of their own; ids may repeat or be
null (rows are told apart by a number of their own); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, read_table

KINDS = ["email", "ip", "card", "phone", "term"]
#: Kind: (what a text must hold, pattern, what a match must fulfil).
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(x.v, '[.]'), p -> regexp_replace(p, '^0+', '') rlike '^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?+[0-9])++", "length(translate(x.v, ' -', '')) between 12 and 19 and luhn_check(translate(x.v, ' -', ''))"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "length(translate(x.v, '+ ().-', '')) between 9 and 15"),
}
LETTERS = r"\\p{L}\\p{M}\\p{Nd}_\\x27-"
#: No terms: words of one or two small Latin letters. What stands for a base span while words are cut.
SHORT, MARK = "^[a-z]{1,2}$", "\x01"


def _located(text: str, pattern: str) -> str:
    """SQL: the matches of a pattern (an SQL expression) as array<struct<s, e, v>>, code points, end exclusive. Between two
    matches lies a gap of split(); ends are running sums of gaps and matches."""
    m, g = f"regexp_extract_all({text}, {pattern}, 0)", f"split({text}, {pattern}, -1)"
    return (
        f"aggregate(zip_with({m}, {g}, (v, g) -> named_struct('v', v, 'g', g)), named_struct('p', 0, 'o', cast(array() as array<struct<s:int,e:int,v:string>>)), "
        "(a, x) -> if(x.v is null, a, named_struct('p', a.p + length(x.g) + length(x.v), 'o', concat(a.o, array(named_struct("
        "'s', a.p + length(x.g), 'e', a.p + length(x.g) + length(x.v), 'v', x.v))))), a -> a.o)"
    )


def _found(kind: str) -> str:
    needs, pattern, holds = PATTERNS[kind]
    needs, pattern = needs.replace("\\", "\\\\"), pattern.replace("\\", "\\\\")
    at = f"transform(filter({_located('t', f"'{pattern}'")}, x -> {holds}), x -> named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e, 'v', x.v))"
    return f"if(t rlike '{needs}', {at}, cast(array() as array<struct<s:int,k:int,e:int,v:string>>))"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text), base: array<struct<s, k, e, v>> by start, then kind. One scan, no shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.withColumn("base", F.expr("array_sort(concat(" + ", ".join(_found(k) for k in KINDS[:4]) + "))"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def _words(docs: DataFrame, *keep: str, lower: bool = True) -> DataFrame:
    """The columns named in keep, and term: each document's distinct terms outside its base spans (lower: in lower case);
    texts stay in place."""
    # a base span becomes a mark that words next to it hold, and go with it
    gaps = "transform(sequence(0, size(base)), i -> named_struct('s', if(i = 0, 0, array_max(transform(slice(base, 1, i), x -> x.e))), 'e', if(i = size(base), length(t), get(base, i).s)))"
    rest = f"if(size(base) = 0, t, array_join(transform({gaps}, g -> if(g.e > g.s, substring(t, g.s + 1, g.e - g.s), '')), '{MARK}'))"
    d = docs.select(*keep, "base", F.expr(f"translate(t, '{MARK}', ' ')").alias("t")).select(*keep, F.expr(rest).alias("t"))
    return d.select(*keep, F.explode(F.expr(f"array_distinct(transform(filter(split(t, '[^{MARK}{LETTERS}]++'), w -> {_is_term('w')}), w -> {'lower(w)' if lower else 'w'}))")).alias("term"))


def _is_term(w: str) -> str:
    return f"{w} <> '' and not {w} rlike '{SHORT}' and instr({w}, '{MARK}') = 0"


def _entities(spans: str) -> str:
    """Hashes of what the spans name: kind and value (digits, lower case), and kind and group."""
    value = "if(x.k in (2, 3), regexp_replace(x.v, '[^0-9]', ''), lower(x.v))"
    group = "case x.k when 0 then substring_index(lower(x.v), '@', -1) when 1 then substring_index(x.v, '.', 3) when 2 then substring(regexp_replace(x.v, '[^0-9]', ''), 1, 6) else substring(regexp_replace(x.v, '[^0-9]', ''), 1, 5) end"
    return f"array_distinct(concat(transform({spans}, x -> xxhash64(x.k, {value})), transform({spans}, x -> xxhash64(x.k + 10, {group}))))"


def analysed(docs: DataFrame, disclose: float = 0.8, remove: float = 0.95, support: int = 3, bits: float = 3.0, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and terms (arrays of spans; a term's v is 'remove' or 'generalise'), with_text: t, the text."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = base_spans(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    found = scratch.table(found)
    told = disclosing(found, disclose, remove, support, bits, scratch)
    none = "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"
    if told is None:
        return found.select("doc_id", *["t"] * with_text, "base", F.expr(none).alias("terms"))
    by = checked(scratch.table(told.groupBy("term").agg(F.max("drop").alias("drop"))))
    # of texts with a disclosing term, the forms in which they have it; then the places of those, as whole words
    has = _words(found, "rid", lower=False).withColumnRenamed("term", "form").join(by.withColumnRenamed("term", "known"), F.lower("form") == F.col("known"))
    forms = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("form")))), "|")
    has = checked(scratch.table(has.groupBy("rid").agg(forms(F.col("drop")).alias("gone"), forms(~F.col("drop")).alias("vague"))))
    pattern = f"concat('(?<![{LETTERS}])(?:', concat_ws('|', nullif(gone, ''), nullif(vague, '')), ')(?![{LETTERS}])')"
    at = found.join(has, "rid").withColumn("p", F.expr(pattern)).select("rid", "base", F.split("gone", "[|]").alias("gone"), F.expr(_located("t", "p")).alias("m"))
    free = "filter(m, w -> not exists(base, b -> b.s < w.e and w.s < b.e))"
    added = at.select("rid", F.expr(f"array_sort(transform({free}, w -> named_struct('s', w.s, 'k', 4, 'e', w.e, 'v', if(array_contains(gone, w.v), 'remove', 'generalise'))))").alias("terms"))
    out = found.join(scratch.table(added), "rid", "left")
    return out.select("doc_id", *["t"] * with_text, "base", F.expr(f"coalesce(terms, {none})").alias("terms"))


def disclosing(found: DataFrame, disclose: float, remove: float, support: int, bits: float, scratch: Scratch) -> DataFrame | None:
    """term, drop: for entities and terms that meet in `support` documents or more and have enough PMI; None where
    no entity or no pair has so many."""
    texts = F.count("*")
    named = found.filter("size(base) > 0")
    often = named.select(F.explode(F.expr(_entities("base"))).alias("ent")).groupBy("ent").agg(texts.alias("with_ent")).filter(F.col("with_ent") >= support)
    often = scratch.table(often)
    if often.isEmpty():
        return None
    n = found.count()
    often = checked(scratch.table(often.withColumn("ic", F.expr(f"log2({n} / cast(with_ent as double))")).filter(F.col("ic") >= bits)))
    held = named.select("t", "base", F.explode(F.expr(_entities("base"))).alias("ent")).join(often, "ent")
    pairs = _words(held, "ent", "with_ent", "ic").groupBy("ent", "with_ent", "ic", "term").agg(texts.alias("both")).filter(F.col("both") >= support)
    pairs = scratch.table(pairs)
    wanted = scratch.table(pairs.select("term").distinct())
    if wanted.isEmpty():
        return None
    counts = _words(found).join(checked(wanted), "term", "left_semi").groupBy("term").agg(texts.alias("with_term"))
    told = pairs.join(checked(scratch.table(counts)), "term").withColumn("pmi", F.expr(f"log2(both * cast({n} as double) / (cast(with_ent as double) * with_term))"))
    told = scratch.table(told.filter(F.expr(f"pmi >= {disclose} * ic - 1e-12")).select("term", F.expr(f"pmi >= {remove} * ic - 1e-12").alias("drop")))
    return None if told.isEmpty() else told


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text: base spans become [EMAIL], [IP], [CARD], [PHONE]; disclosing terms go or become [NAME] (upper
    first letter), [CODE] (with digits) or [TERM]. Of overlapping spans the first counts."""
    a = analysed(docs, with_text=True, **options)
    label = "case when x.k < 4 then element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]'), x.k + 1) when x.v = 'remove' then '' when substring(t, x.s + 1, x.e - x.s) rlike '[0-9]' then '[CODE]' when substring(t, x.s + 1, 1) rlike '\\\\p{Lu}' then '[NAME]' else '[TERM]' end"
    return a.select(
        "doc_id",
        F.expr(
            "aggregate(array_sort(concat(base, terms)), named_struct('p', 0, 'o', ''), (a, x) -> if(x.s < a.p, a, named_struct('p', x.e, 'o', "
            f"concat(a.o, substring(t, a.p + 1, x.s - a.p), {label}))), a -> concat(a.o, substring(t, a.p + 1)))"
        ).alias("text"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysed(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    return a.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("array_sort(concat(base, terms))")).alias("spans"))
