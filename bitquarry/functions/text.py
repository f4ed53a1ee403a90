"""Parsing, cleaning and comparing strings, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that stand for a missing value, in lower case.
MISSING_MARKERS = ("", "[unknown]", "unknown", "null", "none", "nan", "n/a", "-")
#: Words that say nothing in a title.
TITLE_STOPWORDS = ("the", "a", "an", "and", "of", "for", "with", "in", "on", "to", "by")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_specs(s: Column | str) -> Column:
    """``{k1=[v2, v1], k2=[..]}`` to a map; a key's values are trimmed, sorted and joined by ", "."""
    pairs = F.regexp_extract_all(col(s), F.lit(r"([^=\[\],{}]+)=\[([^\]]*)\]"), F.lit(0))
    key = lambda p: F.trim(F.regexp_extract(p, r"^([^=]+)=", 1))
    values = lambda p: F.array_join(F.array_sort(F.filter(F.transform(F.split(F.regexp_extract(p, r"=\[([^\]]*)\]$", 1), ","), lambda v: F.trim(v)), lambda v: v != "")), ", ")
    entries = F.filter(F.transform(pairs, lambda p: F.struct(key(p).alias("key"), values(p).alias("value"))), lambda e: (e.key != "") & (e.value != ""))
    # the last of equal keys stands
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x.key == e.key))
    return F.map_from_entries(last)


def parse_duration(s: Column | str) -> Column:
    """Seconds of ``m:ss``, ``Xm Ysec``, milliseconds (1000 or more) or decimal minutes; null for others and for 0."""
    t = F.lower(F.trim(col(s)))
    number = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.cast("double"))
    clock = F.when(t.rlike(r"^\d+:\d{1,2}$"), F.split(t, ":")[0].cast("double") * 60 + F.split(t, ":")[1].cast("double"))
    words = F.when(t.rlike(r"^\d+\s*m(in)?\s*\d+\s*s(ec)?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("double") * 60 + F.regexp_extract(t, r"(\d+)\s*s(ec)?$", 1).cast("double"))
    seconds = F.coalesce(clock, words, F.when(number >= 1000, number / 1000), number * 60)
    return F.when(seconds > 0, seconds)


def duration_band(seconds: Column | str, width: int = 30) -> Column:
    s = col(seconds)
    return F.when(s.isNotNull(), (F.floor(s / width) * width).cast("string"))


def is_missing(v: Column | str) -> Column:
    return col(v).isNull() | F.lower(F.trim(col(v))).isin(*MISSING_MARKERS)


def tokens(s: Column | str, least: int = 2) -> Column:
    """Lower-cased words of letters and digits of any script, of ``least`` characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(col(s), F.lit(""))), r"(?U)[\W_]+"), lambda t: F.length(t) >= least)


def name_tokens(s: Column | str, most: int = 8) -> Column:
    """A title's first distinct words, without stop words."""
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    return F.slice(F.array_distinct(F.filter(tokens(s), lambda t: ~F.array_contains(stop, t))), 1, most)


def norm_key(s: Column | str) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", "")


def canonical_name(s: Column | str) -> Column:
    """norm_key without a plural ending."""
    k = norm_key(s)
    n = F.length(k)
    return F.when(k.endswith("es") & (n > 4), F.substring(k, 1, n - 2)).when(k.endswith("s") & (n > 3), F.substring(k, 1, n - 1)).otherwise(k)


def char_ngrams(s: Column | str, low: int = 3, high: int | None = None) -> Column:
    """All character n-grams of the lengths from low to high, shortest first."""
    t = col(s)

    def of(n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, (high or low) + 1)])


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance over the longer length. Not the matching-blocks ratio; see sequence_ratio."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks ratio (Ratcliff and Obershelp), in an Arrow batch: there is no built-in of it."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def shares_prefix(a: Column | str, b: Column | str, n: int) -> Column:
    a, b = F.lower(col(a)), F.lower(col(b))
    return (F.least(F.length(a), F.length(b)) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))


def same_casefold(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def same_without_space(a: Column | str, b: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(a)), r"\s+", "") == F.regexp_replace(F.lower(col(b)), r"\s+", "")


def same_alnum(a: Column | str, b: Column | str) -> Column:
    return norm_key(a) == norm_key(b)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two dense vectors; 0 where one is missing or zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def stratum(frequency: Column | str) -> Column:
    f = col(frequency)
    return F.when(f >= 100, "head").when(f >= 10, "mid").when(f >= 2, "tail").otherwise("singleton")


def infobox(s: Column | str, most_key: int = 40, most_value: int = 60, least: int = 3) -> Column:
    """Top-level parameters of the first ``{{Infobox ...}}`` of a wiki text, as a map; null with fewer than ``least``.

    Braces and brackets nest, so the cut at top-level pipes is one fold over
    the marks and what stands between them.
    """
    t = F.regexp_extract(F.coalesce(col(s), F.lit("")), r"(?is)(\{\{\s*infobox.*)", 1)
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"(?is)<ref[^>]*/>|<ref.*?</ref>", "")
    # a mark that no text holds stands for a top-level pipe; the body ends where depth comes back to 0
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(a: Column, ch: Column) -> Column:
        depth = a.depth + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0)
        shown = F.when((ch == "|") & (depth == 2), F.lit("\u0001")).otherwise(ch)
        done = a.done | ((depth <= 0) & (a.out != ""))
        return F.struct(F.when(a.done, a.depth).otherwise(depth).alias("depth"), F.when(a.done, a.out).otherwise(F.concat(a.out, shown)).alias("out"), done.alias("done"))

    body = F.aggregate(F.regexp_extract_all(t, F.lit(r"[{}\[\]|]|[^{}\[\]|]+"), F.lit(0)), start, step).getField("out")
    body = F.regexp_replace(body, r"\}\}$", "")
    parts = F.slice(F.split(body, "\u0001"), 2, 10000)
    clean = lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"\{\{[^{}]*\}\}", " "), r"<[^>]+>|'{2,}", ""), r"\s+", " "))
    entries = F.transform(F.filter(parts, lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.substring(clean(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))), 1, most_value).alias("value")))
    good = F.filter(entries, lambda e: (e.key != "") & (F.length(e.key) < most_key) & (e.value != ""))
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda x: x.key == e.key))
    return F.when(F.size(last) >= least, F.map_from_entries(last))


def json_objects(s: Column | str) -> Column:
    """The objects of a JSON array in a reply, as strings: fences are stripped, and whole objects of a broken array are saved."""
    t = F.regexp_replace(F.coalesce(col(s), F.lit("")), r"(?s)```(?:json)?", "")
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    whole = F.try_parse_json(inner) if hasattr(F, "try_parse_json") else F.lit(None)
    found = F.regexp_extract_all(t, F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.when(whole.isNotNull() & (inner != ""), F.from_json(inner, "array<string>")).otherwise(F.filter(found, lambda o: F.try_parse_json(o).isNotNull()))


def record_text(record: Column | str) -> Column:
    """A record's pairs, keys sorted, as one string."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(record))), lambda e: F.concat(e.key, F.lit(": "), e.value)), "; ")


def value_spans(record: Column | str) -> Column:
    """Where each value stands in record_text: key, from, to (characters from 0)."""
    entries = F.array_sort(F.map_entries(col(record)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<key:string,start:int,end:int>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        begin = a.at + F.length(e.key) + 2
        end = begin + F.length(e.value)
        return F.struct((end + 2).alias("at"), F.concat(a.out, F.array(F.struct(e.key.alias("key"), begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(entries, start, step).getField("out")


def value_tokens(v: Column | str, mode: str) -> Column:
    """A value whole ("whole"), by white space ("ws") or by white space in lower case ("lower")."""
    if mode == "whole":
        return F.array(col(v))
    t = F.lower(col(v)) if mode == "lower" else col(v)
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")
