"""Text normalisation, natural sort keys, slugs and titles as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# Words kept lower case inside a title, and acronyms with their spelling.
SMALL_TITLE_WORDS = [
    "or", "and", "of", "the", "a", "an", "in", "on", "at", "to", "for", "vs", "v", "per", "as", "by",
]
TITLE_ACRONYMS = {
    "crna": "CRNA", "np": "NP", "pa": "PA", "rn": "RN", "lpn": "LPN", "dd": "DD",
    "tbi": "TBI", "mr": "MR", "mh": "MH", "sa": "SA", "cms": "CMS",
}
# Link texts that say nothing about the file behind them.
GENERIC_LINK_TEXTS = ["", "download", "download file", "click here", "here", "file"]


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a let-binding)."""
    return F.transform(F.array(value), body)[0]


def text(c: Column) -> Column:
    """Null-safe string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Null-safe string without leading and trailing white space of any kind."""
    return F.regexp_replace(text(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def norm_text(c: Column, data_type: T.DataType | None = None) -> Column:
    """Null becomes '', runs of white space become one blank, ends are trimmed.

    Plain text without double blanks passes a cheap test only, and so do values of a known type whose text
    has no blanks.
    """
    s = text(c)
    if isinstance(data_type, (T.NumericType, T.BooleanType, T.DateType)):
        return s
    odd = s.rlike(r"[^!-~ ]|  ")
    return F.when(odd, F.trim(F.regexp_replace(s, WHITESPACE, " "))).otherwise(F.trim(s))


def norm_key(c: Column, data_type: T.DataType | None = None) -> Column:
    """``norm_text`` in upper case: the form join keys are compared in."""
    return F.upper(norm_text(c, data_type))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Plain ASCII rows stay in the JVM; only the others are sent to Python."""
    s = text(c)
    plain = s.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(plain, s), _nfkc(F.when(~plain, s)))


def norm_label(c: Column, unicode_forms: bool = True) -> Column:
    """Label matching form: NFKC, one blank between words, lower case."""
    return F.lower(norm_text(nfkc(c) if unicode_forms else c))


def norm_catalog_value(c: Column, unicode_forms: bool = True) -> Column:
    """Cell matching form: ``norm_label`` plus quote folding and two HTML entities."""
    s = norm_label(c, unicode_forms)
    s = F.regexp_replace(s, "'{2,}", "'")
    s = F.translate(s, "‘’′", "'''")
    s = F.replace(F.replace(s, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))
    return norm_text(s)


def natural_key(c: Column) -> Column:
    """Sort key under which ``item 2`` comes before ``Item 10``.

    Each digit run is replaced by its length and its digits, so numbers of any size order by value.
    """
    runs = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(\d+|\D+)"), 1)

    def encode(run):
        number = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(number).cast("string"), 4, "0"), number)).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")


def slug(c: Column, default: str = "fee_schedule") -> Column:
    """File-system friendly lower-case key."""
    ends = r"^[._-]+|[._-]+$"
    s = F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), ends, "")
    s = F.when(s == "", F.lit(default)).otherwise(s)
    return F.lower(s)


def norm_email(c: Column) -> Column:
    """Lower-cased and trimmed address; null when it cannot be an address."""
    s = F.lower(strip(c))
    return F.when(s.contains("@"), s)


def file_stem(c: Column) -> Column:
    """Last path part of a file name without its extension."""
    leaf = F.regexp_extract(strip(c), r"([^/\\]*)$", 1)
    return F.regexp_replace(leaf, r"\.[^.]*$", "")


def title_case(c: Column) -> Column:
    """Title case with small words, acronyms and hyphenated parts handled."""
    words = F.split(norm_text(c), " ")
    acronyms = F.create_map(*[F.lit(x) for kv in TITLE_ACRONYMS.items() for x in kv])

    def part(p):
        return F.when(F.length(p) <= 2, F.upper(p)).otherwise(
            F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
        )

    def word(w, i):
        low = F.lower(w)
        inner = (i > 0) & (i < F.size(words) - 1)
        return (
            F.when(F.element_at(acronyms, low).isNotNull(), F.element_at(acronyms, low))
            .when(low.isin(SMALL_TITLE_WORDS) & inner, low)
            .otherwise(F.array_join(F.transform(F.split(w, "-"), part), "-"))
        )

    return F.array_join(F.transform(words, word), " ")


def is_generic_link_text(c: Column) -> Column:
    return F.lower(strip(c)).isin(GENERIC_LINK_TEXTS)


def is_storage_hash(c: Column) -> Column:
    """A long run of hexadecimal digits, as content stores use for file names."""
    return strip(c).rlike(r"(?i)^[a-f0-9]{20,}$")


def is_abbreviation_phrase(c: Column) -> Column:
    """Phrases such as ``mh sa``: two or more words, at most one of them longer than three letters."""
    words = F.filter(F.split(F.replace(strip(c), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    return (F.size(words) >= 2) & (
        (short >= F.size(words) - 1) | ((F.size(words) == 2) & F.forall(words, lambda w: F.length(w) <= 4))
    )


def artifact_label(artifact_id: Column, label: Column, key: Column, filename: Column) -> Column:
    """Readable name of a stored file: label, else key, else file stem, else the id."""
    leaf = F.regexp_extract(strip(filename), r"([^/\\]*)$", 1)
    stem = F.replace(F.regexp_replace(leaf, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    return F.coalesce(
        blank_to_null(label),
        blank_to_null(F.replace(text(key), F.lit("_"), F.lit(" "))),
        blank_to_null(stem),
        blank_to_null(filename),
        F.concat(F.lit("artifact "), artifact_id.cast("string")),
        F.lit("Fee schedule"),
    )


def artifact_title(
    artifact_id: Column, label: Column, key: Column, filename: Column, is_current: Column
) -> Column:
    """Title-cased display name; names that are generic or hashes are passed over, old versions marked."""
    good_label = F.when(~is_generic_link_text(label), blank_to_null(label))
    key_text = blank_to_null(F.replace(strip(key), F.lit("_"), F.lit(" ")))
    long_label = F.when(
        is_abbreviation_phrase(key_text) & (F.length(strip(label)) > F.length(key_text) + 2), blank_to_null(label)
    )
    stem = file_stem(filename)
    stem_text = F.when(~is_storage_hash(stem), blank_to_null(F.replace(stem, F.lit("_"), F.lit(" "))))
    base = F.coalesce(good_label, long_label, key_text, blank_to_null(label), stem_text)
    name = F.when(base.isNotNull(), title_case(base)).otherwise(
        F.coalesce(F.concat(F.lit("Fee schedule ("), artifact_id.cast("string"), F.lit(")")), F.lit("Fee schedule"))
    )
    return F.concat(name, F.when(is_current == F.lit(False), F.lit(" · prior")).otherwise(F.lit("")))
