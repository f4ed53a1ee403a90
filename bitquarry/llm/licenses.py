"""Licence scans by a positional rare-token index, with SQL functions only.

Templates are short word sequences with the label they stand for and key
phrases that must stand in their place. The index has a posting (template,
place) for each template word. For a text, only the licence words that it
holds are looked up: of each template's key phrases the ``rare_words`` rarest
that stand in the text, those of highest IDF first. The document frequencies
are counted over all documents in a first pass. Each gives, for each place of
it and each posting, the place where the template would begin; places where at
least ``share`` of the template's words that were looked up agree are
candidates, and a candidate counts if every key phrase stands where the
template has it. There all of the words looked up agree, so no template is
lost to the other licences in a text or to words of it elsewhere.

The base count is of its own kind: every place where a base phrase's words
stand consecutively.

All of it happens inside a row, so nothing is shuffled but the document
frequencies of a fixed vocabulary.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows give equal rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import read

#: Fixed values of the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Template words, label, key phrases (each a slice of the template).
TEMPLATES = (
    ("released under the mit license", "mit", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted free of charge",)),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license version 2 0",)),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("gnu general public license version 3",)),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ("gnu general public license version 2",)),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc 4 0",)),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("cc by sa 4 0",)),
    ("licensed under cc by 4 0", "cc-by-4.0", ("cc by 4 0",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution and use in source and binary forms",)),
    ("mozilla public license version 2 0", "mpl-2.0", ("mozilla public license",)),
    ("gnu lesser general public license", "lgpl", ("lesser general public license",)),
    ("all rights reserved", "all-rights-reserved", ("all rights reserved",)),
)
RARE_WORDS = 6
SHARE = 0.6
#: Words of templates that every text may hold; never looked up.
COMMON = frozenset("a and any are by charge copy for forms free in is of or person the this to under use with without".split())

_SEP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _arr(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def words(text: Column) -> Column:
    """Lower-cased words; A-Z alone is lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(low, _SEP)
    inner = F.when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.when(F.size(inner) == 0, inner).when(F.element_at(inner, -1) == "", F.slice(inner, 1, F.size(inner) - 1)).otherwise(inner)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t, _, _ in templates for w in t.split()} - COMMON)


def _asked(template) -> set[str]:
    """The licence words of a template's key phrases."""
    return {w for k in template[2] for w in k.split()} - COMMON


def _signal(templates) -> list[str]:
    """Words of which every template's and base phrase's key phrases hold one; a text without them has no place of any."""
    return sorted({max((w for w in k.split() if w not in COMMON), key=lambda w: (len(w), w)) for _, _, keys in templates for k in keys[:1]} | {"license"})


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many texts each licence word stands, and the number of texts; over all rows."""
    vocab = _arr(vocabulary(templates))
    held = docs.select(F.array_intersect(words(F.coalesce("text", F.lit(""))), vocab).alias("ws"))
    counts = held.select(F.explode_outer("ws").alias("w")).groupBy("w").count().collect()  # a row for each vocabulary word
    total = docs.count()
    return {r["w"]: r["count"] for r in counts if r["w"] is not None}, total


def _agreeing(t: int, asked_words: list[str], share: float) -> Column:
    """Starts of template t on which enough of its looked-up words agree."""
    asked = F.size(F.array_intersect(F.col("mine"), _arr(asked_words)))
    starts = F.transform(F.filter("votes", lambda v: v.t == t), lambda v: v.s)
    return F.filter(F.array_distinct(starts), lambda s: F.size(F.filter(starts, lambda x: x == s)) >= F.greatest(F.lit(1), F.ceil(asked * share)))


def _in_place(words_: list[str], stands):
    """Share of a template's words that stand where it has them, for a start."""
    return lambda s: sum((F.when(stands(i, x)(s), 1.0).otherwise(0.0) for i, x in enumerate(words_)), F.lit(0.0)) / len(words_)


def scan(docs: DataFrame, templates=TEMPLATES, rare_words: int = RARE_WORDS, share: float = SHARE) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text)."""
    df, total = document_frequencies(docs, templates)
    vocab = vocabulary(templates)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocab}
    ranked = sorted(vocab, key=lambda w: (-idf[w], w))
    postings = {w: [(t, p) for t, (text, _, _) in enumerate(templates) for p, x in enumerate(text.split()) if x == w and w in _asked(templates[t])] for w in vocab}
    postings = {w: ps for w, ps in postings.items() if ps}
    order = _arr(ranked)

    base = docs.select("doc_id", words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("ws"))
    # A text without a word that every candidate must hold skips the index
    signal = F.arrays_overlap("ws", _arr(_signal(templates)))
    every = F.sequence(F.lit(0), F.size("ws") - 1)
    interesting = F.when(signal, F.filter(every, lambda i: F.array_contains(order, F.get(F.col("ws"), i)))).otherwise(F.array().cast("array<int>"))
    at = base.select("doc_id", "ws", interesting.alias("at"))
    w = lambda i: F.get(F.col("ws"), i)

    def stands(offset: int, word: str):
        """Whether a word stands at an offset from a place."""
        return lambda i: F.coalesce((i + offset >= 0) & (w(i + offset) == word), F.lit(False))

    def places(phrase: str) -> Column:
        """Starts of a phrase, from the places of its last word (a licence word)."""
        ps = phrase.split()
        tail = ps[-1]
        if tail in COMMON or tail not in vocab:
            raise ValueError("a phrase ends in a licence word")
        ok = F.filter("at", lambda i: w(i) == tail)
        for k, x in enumerate(reversed(ps[:-1]), 1):
            ok = F.filter(ok, stands(-k, x))
        return F.transform(ok, lambda i: i - (len(ps) - 1))

    found = at.select("doc_id", "ws", "at", *[places(p).alias(f"b{k}") for k, (p, _) in enumerate(BASE)])
    # each template's rarest words in the text
    found = found.withColumn("held", F.array_intersect(order, F.transform("at", w)))
    rarest = [F.slice(F.array_intersect(_arr([x for x in ranked if x in _asked(t)]), F.col("held")), 1, rare_words) for t in templates]
    found = found.withColumn("mine", F.array_distinct(F.concat(*rarest)))
    # (template, start) of every posting of a looked-up word at each of its places
    index = F.create_map(*[x for word in postings for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[word]]))])
    votes = F.flatten(F.transform(F.filter("at", lambda i: F.array_contains("mine", w(i))), lambda i: F.transform(F.element_at(index, w(i)), lambda q: F.struct(q.t.alias("t"), (i - q.p).alias("s")))))
    found = found.withColumn("votes", F.when(F.size("mine") > 0, votes).otherwise(F.array().cast("array<struct<t:int,s:int>>")))
    labels, strengths = [], []
    for t, (text, label, keys) in enumerate(templates):
        ts = text.split()
        enough = _agreeing(t, sorted(_asked(templates[t])), share)
        for k in keys:
            ks = k.split()
            off = next(i for i in range(len(ts)) if ts[i : i + len(ks)] == ks)
            for j, x in enumerate(ks):
                enough = F.filter(enough, stands(off + j, x))
        found = found.withColumn(f"f{t}", F.array_max(F.transform(enough, _in_place(ts, stands))))
        labels.append(F.when(F.col(f"f{t}").isNotNull(), F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
        strengths.append(F.coalesce(F.col(f"f{t}"), F.lit(0.0)))
    base_labels = [F.when(F.size(f"b{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(BASE)]
    first = [F.array_min(f"b{k}") for k in range(len(BASE))]
    last = [F.array_max(f"b{k}") for k in range(len(BASE))]
    n_base = sum((F.size(f"b{k}") for k in range(1, len(BASE))), F.size("b0"))
    all_base = F.array_sort(F.array_distinct(F.concat(*base_labels)))
    all_labels = F.array_sort(F.array_distinct(F.concat(*base_labels, *labels)))
    strongest = F.greatest(*strengths, F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id", F.size("ws").cast("long").alias("n_words"), n_base.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(all_base, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), strongest.alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
