"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def norm(s: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]", "")


def strip_article(s: Column) -> Column:
    """norm without a leading the, a or an (as a word)."""
    return norm(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"(?i)^(the|a|an)(\s+|$)", ""))


def words(s: Column) -> Column:
    """All runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def long_words(s: Column) -> Column:
    return F.filter(words(s), lambda w: F.length(w) > 3)


def tokens(s: Column) -> Column:
    """Distinct significant tokens: over three characters, no stop word."""
    return F.array_distinct(F.filter(long_words(s), lambda w: ~F.array_contains(_strings(C.STOP), w)))


def query_words(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([A-Za-z0-9']+)"), 1)


def significant(s: Column) -> Column:
    """Words that are neither candidate stop words nor connectors."""
    both = _strings(sorted({*C.CANDIDATE_STOP, *C.CONNECTORS}))
    return F.filter(query_words(s), lambda w: ~F.array_contains(both, F.lower(w)))


def proper_nouns(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?U)\b([A-Z][a-z]{2,})\b"), 1)


def year_of(s: Column) -> Column:
    """The first year from 1600 to 2099 written anywhere in the text."""
    return F.nullif(F.regexp_extract(s, C.YEAR, 1), F.lit("")).cast("int")


def is_place(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), "[.,;:]+$", "").isin(C.PLACES)


def is_region(s: Column) -> Column:
    p = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), "[.,;:]+$", "")
    return p.rlike(C.REGION) | p.rlike(C.DEMOGRAPHIC)


def is_institution(s: Column) -> Column:
    w = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("([a-z]+)"), 1)
    ends = F.get(w, F.size(w) - 1).isin(C.INSTITUTION_TAIL) | F.get(w, F.lit(0)).isin(C.INSTITUTION_TAIL)
    return F.coalesce(F.size(w).between(2, 4) & ends, F.lit(False))


def is_person(s: Column) -> Column:
    """Two to four capitalised words, one of them an initial, none a function word."""
    w = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([A-Za-z][A-Za-z.']*)"), 1)
    minor = _strings(sorted({*C.CANDIDATE_STOP, *C.CONNECTORS}))
    plain = F.forall(w, lambda x: ~F.array_contains(minor, F.lower(x)) & x.rlike("^[A-Z]"))
    return F.size(w).between(2, 4) & plain & F.exists(w, lambda x: F.length(F.regexp_replace(x, r"\.+$", "")) == 1)


def all_caps(s: Column) -> Column:
    return (F.upper(s) == s) & s.rlike(r"\p{L}")


def only_stop_words(s: Column) -> Column:
    """No words at all, or none but candidate stop words."""
    return F.forall(query_words(s), lambda w: F.array_contains(_strings(C.CANDIDATE_STOP), F.lower(w)))


def rejected_phrase(s: Column) -> Column:
    """What can be no title: places, institutions, regions, people in mixed case, function words."""
    return is_place(s) | is_institution(s) | is_region(s) | (~all_caps(s) & is_person(s)) | only_stop_words(s)


def seconds(stamp: Column) -> Column:
    """HH:MM:SS.mmm as seconds."""
    p = F.split(stamp, ":")
    return F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double")


def squeeze(s: Column) -> Column:
    """Caption text without tags, repeated blanks and stuttered words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))
    return F.regexp_replace(plain, r"(?U)\b(\w+)\s+\1\b", "$1")


def clean_phrase(s: Column) -> Column:
    """A spine phrase without edge debris, with fragments of a word joined."""
    bare = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    w = F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\s+"), lambda x: bare(x) > 0)
    # the first word of over two characters and the last of over one bound what stays
    kept = F.filter(F.transform(w, lambda x, i: F.when(bare(x) > 2, i)), lambda i: i.isNotNull())
    w = F.when(F.size(kept) > 0, F.slice(w, F.get(kept, F.lit(0)) + 1, F.greatest(F.lit(1), F.size(w)))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(F.transform(w, lambda x, i: F.when(bare(x) > 1, i)), lambda i: i.isNotNull())
    w = F.when(F.size(kept) > 0, F.slice(w, F.lit(1), F.get(kept, F.size(kept) - 1) + 1)).otherwise(w)

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        glue = (F.size(done) > 0) & (bare(x) <= 2) & F.coalesce(bare(last).between(1, 2), F.lit(False)) & ~F.lower(x).isin(C.CONNECTORS)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, x)))
        return F.when(glue, longer).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(w, F.array().cast("array<string>"), join)
    return F.regexp_replace(F.array_join(merged, " "), "^[ ,.-]+|[ ,.-]+$", "")


def bib_key(authors: Column, year: Column) -> Column:
    last = F.element_at(F.split(F.coalesce(F.get(authors, F.lit(0)), F.lit("anon")), r"\s+"), -1)
    name = F.regexp_replace(F.lower(last), "[^a-z]", "")
    return F.concat(F.when(name == "", "anon").otherwise(name), F.coalesce(year.cast("string"), F.lit("")))


def glyph_variants(s: Column, k: int) -> Column:
    """Up to k phrases that differ from s by one confusable glyph, pair by pair, place by place."""
    n = F.length(s)
    at = lambda i: F.substr(s, i, F.lit(1))

    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def swapped(a: str, b: str) -> Column:
        old, new = a + b + (a + b).lower(), b + a + (b + a).lower()
        swap = lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.translate(at(i), old, new), F.substr(s, i + 1, F.greatest(n - i, F.lit(0))))
        return F.transform(F.filter(places, lambda i: F.instr(F.lit(old), at(i)) > 0), swap)

    found = F.concat(*[swapped(a, b) for a, b in C.GLYPH_PAIRS])
    return F.slice(F.array_distinct(found), 1, k)
