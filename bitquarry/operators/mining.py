"""Relations between keys: implication, siblings, synonyms, dependencies, and candidates for merging keys.

Pairs of keys come from an equi-join on the record; records hold few keys and
the pair counts are partial aggregates. Pairs that share values come from an
equi-join of the distinct (key, value) pairs, never of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.functions import text as T


def key_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("key").agg(F.count_distinct("rec_id").alias("n"))


def cooccurring_pairs(cells: DataFrame) -> DataFrame:
    """key_a < key_b and the records that have both."""
    keys = cells.groupBy("rec_id").agg(F.array_sort(F.collect_set("key")).alias("ks")).filter(F.size("ks") > 1)
    pairs = keys.select(F.explode(F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("key_a"), b.alias("key_b")))))).alias("p"))
    return pairs.groupBy("p.key_a", "p.key_b").agg(F.count("*").alias("both"))


def value_sharing_pairs(cells: DataFrame) -> DataFrame:
    """key_a < key_b, shared (values), sizes of both inventories."""
    kv = cells.select("key", "value").distinct()
    size = kv.groupBy("key").agg(F.count("*").alias("n"))
    keys = kv.groupBy("value").agg(F.array_sort(F.collect_set("key")).alias("ks")).filter(F.size("ks") > 1)
    shared = keys.select(F.explode(F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("key_a"), b.alias("key_b")))))).alias("p")).groupBy("p.key_a", "p.key_b").agg(F.count("*").alias("shared"))
    return shared.join(size.select(F.col("key").alias("key_a"), F.col("n").alias("values_a")), "key_a").join(size.select(F.col("key").alias("key_b"), F.col("n").alias("values_b")), "key_b")


def merge_candidates(cells: DataFrame, least: int = 7) -> DataFrame:
    """Pairs that share a value, never meet in a record, and have ``least`` records together."""
    n = key_counts(cells)
    pairs = value_sharing_pairs(cells).join(cooccurring_pairs(cells), ["key_a", "key_b"], "left_anti")
    sized = pairs.join(n.select(F.col("key").alias("key_a"), F.col("n").alias("n_a")), "key_a").join(n.select(F.col("key").alias("key_b"), F.col("n").alias("n_b")), "key_b")
    return sized.filter(F.col("n_a") + F.col("n_b") >= least)


def spelling_bits(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair of keys, the bits to say under which spelling each cell of a merged key stood."""
    c = cells.groupBy("key", "value").agg(F.count("*").alias("c"))
    a = pairs.select("key_a", "key_b").join(c.withColumnRenamed("key", "key_a"), "key_a").select("key_a", "key_b", "value", F.col("c").alias("a"), F.lit(0).cast("long").alias("b"))
    b = pairs.select("key_a", "key_b").join(c.withColumnRenamed("key", "key_b"), "key_b").select("key_a", "key_b", "value", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    both = a.unionByName(b).groupBy("key_a", "key_b", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.groupBy("key_a", "key_b").agg(F.sum(B.column_bits(F.least("a", "b"), F.col("a") + F.col("b"))).alias("spelling_bits"))


def merge_deltas(cells: DataFrame, least: int = 7) -> DataFrame:
    """Each candidate pair's spelling_bits, and the change (delta) of the background's description if the keys become one: values, presence, spelling and naming."""
    pairs = merge_candidates(cells, least)
    total = cells.agg(F.count_distinct("rec_id").alias("records"), F.count_distinct("key").alias("keys"))
    met = cooccurring_pairs(cells).agg(F.count("*").alias("met"))
    c = cells.groupBy("key", "value").agg(F.count("*").alias("c"))
    own = c.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("u"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("s"))
    cost = lambda n, u, s: B.vblock_bits(F.col(s), F.col(n), F.col(u), B.naming_charge(u))
    sides = [c.withColumnRenamed("key", k).join(pairs.select("key_a", "key_b"), k) for k in ("key_a", "key_b")]
    merged = sides[0].unionByName(sides[1]).groupBy("key_a", "key_b", "value").agg(F.sum("c").alias("c"))
    joint = merged.groupBy("key_a", "key_b").agg(F.sum("c").alias("mn"), F.count("*").alias("mu"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("ms"))
    rows = pairs.select("key_a", "key_b").join(joint, ["key_a", "key_b"])
    for k in ("a", "b"):
        rows = rows.join(own.select(F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}"), F.col("u").alias(f"u_{k}"), F.col("s").alias(f"s_{k}")), f"key_{k}")
    rows = rows.join(spelling_bits(cells, pairs), ["key_a", "key_b"]).crossJoin(F.broadcast(total.crossJoin(met)))  # one row
    presence = B.column_bits("mn", "records") - B.column_bits("n_a", "records") - B.column_bits("n_b", "records")
    values = cost("mn", "mu", "ms") - cost("n_a", "u_a", "s_a") - cost("n_b", "u_b", "s_b")
    return rows.select("key_a", "key_b", "spelling_bits", (values + presence + F.col("spelling_bits") + B.merge_naming_charge("keys", "met")).alias("delta"))


def implications(cells: DataFrame, confidence: float = 0.95, least: int = 20, strict: bool = True) -> DataFrame:
    """child -> parent: of the child's records, at least ``confidence`` have the parent; strict: the parent has more records."""
    n = key_counts(cells)
    pair = cooccurring_pairs(cells)
    both = pair.select(F.col("key_a").alias("child"), F.col("key_b").alias("parent"), "both").unionByName(pair.select(F.col("key_b").alias("child"), F.col("key_a").alias("parent"), "both"))
    j = both.join(n.select(F.col("key").alias("child"), F.col("n").alias("n_child")), "child").join(n.select(F.col("key").alias("parent"), F.col("n").alias("n_parent")), "parent")
    kept = j.filter((F.col("n_child") >= least) & (F.col("both") >= confidence * F.col("n_child")))
    return kept.filter(F.col("n_parent") > F.col("n_child")) if strict else kept


def siblings(cells: DataFrame, implied: DataFrame, least: int = 20) -> DataFrame:
    """key_a < key_b with a common parent that never meet."""
    a = implied.filter(F.col("n_child") >= least).select(F.col("child").alias("key_a"), "parent")
    b = implied.filter(F.col("n_child") >= least).select(F.col("child").alias("key_b"), "parent")
    pairs = a.join(b, "parent").filter("key_a < key_b").select("key_a", "key_b").distinct()
    return pairs.join(cooccurring_pairs(cells), ["key_a", "key_b"], "left_anti")


def synonyms(cells: DataFrame, least_jaccard: float = 0.9, least: int = 20) -> DataFrame:
    """key_a < key_b that never meet and whose value sets are almost the same."""
    n = key_counts(cells).filter(F.col("n") >= least)
    pairs = value_sharing_pairs(cells).withColumn("jaccard", F.col("shared") / (F.col("values_a") + F.col("values_b") - F.col("shared"))).filter(F.col("jaccard") >= least_jaccard)
    big = pairs.join(n.select(F.col("key").alias("key_a")), "key_a", "left_semi").join(n.select(F.col("key").alias("key_b")), "key_b", "left_semi")
    return big.join(cooccurring_pairs(cells), ["key_a", "key_b"], "left_anti").select("key_a", "key_b", "jaccard")


def dependencies(cells: DataFrame, confidence: float = 0.99, least: int = 20) -> DataFrame:
    """a -> b: the share of records in which b's value is the usual one for a's value; images: distinct usual values."""
    a = cells.select("rec_id", F.col("key").alias("a"), F.col("value").alias("va"))
    b = cells.select("rec_id", F.col("key").alias("b"), F.col("value").alias("vb"))
    joint = a.join(b, "rec_id").filter("a <> b").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("c"))
    # the most frequent image, the smallest of equals
    top = joint.groupBy("a", "b", "va").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.min_by("vb", F.struct(-F.col("c"), "vb")).alias("image"))
    out = top.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum("top") / F.sum("n")).alias("determinism"), F.count("*").alias("values_a"), F.count_distinct("image").alias("images"))
    return out.filter((F.col("n") >= least) & (F.col("determinism") >= confidence) & (F.col("images") > 1))


def behaviour(cells: DataFrame, least: int = 1) -> DataFrame:
    """key, value, records, and with how many other keys and (key, value) pairs it stands."""
    c = cells.select("rec_id", "key", "value")
    other = c.select("rec_id", F.col("key").alias("k2"), F.col("value").alias("v2"))
    pairs = c.join(other, "rec_id").filter("key <> k2").groupBy("key", "value", "k2", "v2").agg(F.count("*").alias("n"))
    co = pairs.groupBy("key", "value").agg(F.count_distinct("k2").alias("co_keys"), F.count("*").alias("co_values"))
    return c.groupBy("key", "value").agg(F.count("*").alias("records")).filter(F.col("records") >= least).join(co, ["key", "value"], "left").fillna(0, ["co_keys", "co_values"])


def recurrence(cells: DataFrame) -> DataFrame:
    """One row: pairs, average and greatest count of a (key, value)."""
    return cells.groupBy("key", "value").agg(F.count("*").alias("c")).agg(F.count("*").alias("pairs"), F.avg("c").alias("average"), F.max("c").alias("greatest"))


def seed_cohorts(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """truth, best: the greatest count of one (key, value) inside each kind."""
    c = cells.join(truth, "rec_id").groupBy("truth", "key", "value").agg(F.count("*").alias("c"))
    return c.groupBy("truth").agg(F.max("c").alias("best"))


def geometry(cells: DataFrame) -> DataFrame:
    """key, records, co_keys."""
    pairs = cooccurring_pairs(cells)
    both = pairs.select(F.col("key_a").alias("key")).unionByName(pairs.select(F.col("key_b").alias("key"))).groupBy("key").agg(F.count("*").alias("co_keys"))
    return key_counts(cells).select("key", F.col("n").alias("records")).join(both, "key", "left").fillna(0, ["co_keys"])


def name_variants(names: DataFrame, column: str = "name") -> DataFrame:
    """canonical, names, pairs: groups of names that differ in case, marks or plural."""
    g = names.select(column).distinct().groupBy(T.canonical_name(column).alias("canonical")).agg(F.array_sort(F.collect_set(column)).alias("names"))
    return g.filter((F.size("names") > 1) & (F.col("canonical") != "")).withColumn("pairs", (F.size("names") * (F.size("names") - 1) / 2).cast("long"))


def support_buckets(cells: DataFrame) -> DataFrame:
    """bucket (by the records of a key), keys, cells."""
    n = key_counts(cells)
    return n.groupBy(T.stratum("n").alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("cells"))


def top_values(cells: DataFrame, k: int = 3) -> DataFrame:
    """key, rank, value, c: each key's k most frequent values, ties by value."""
    c = cells.groupBy("key", "value").agg(F.count("*").alias("c"))
    best = c.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "value"))), 1, k).alias("top")) if k <= 0 else c.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "value"))).filter(F.col("rank") <= k)
    return best


def token_frequency(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """token, rows: in how many rows each token stands."""
    return df.select(F.explode(F.array_distinct(T.tokens(column))).alias("token")).groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)


def ngram_cosine(names: DataFrame, column: str, low: int = 3, high: int = 5, least: float = 0.5) -> DataFrame:
    """name_a < name_b, cosine of their character n-gram counts, for pairs that share an n-gram."""
    g = names.select(F.col(column).alias("name")).distinct().select("name", F.explode(T.char_ngrams(F.lower("name"), low, high)).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("c"))
    norm = g.groupBy("name").agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    a, b = g.select(F.col("name").alias("name_a"), "gram", F.col("c").alias("x")), g.select(F.col("name").alias("name_b"), "gram", F.col("c").alias("y"))
    dots = a.join(b, "gram").filter("name_a < name_b").groupBy("name_a", "name_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    j = dots.join(norm.select(F.col("name").alias("name_a"), F.col("q").alias("qa")), "name_a").join(norm.select(F.col("name").alias("name_b"), F.col("q").alias("qb")), "name_b")
    return j.select("name_a", "name_b", (F.col("dot") / F.sqrt(F.col("qa").cast("double") * F.col("qb"))).alias("cosine")).filter(F.col("cosine") >= least)


def token_jaccard(names: DataFrame, column: str, least: float = 0.3) -> DataFrame:
    """name_a < name_b, Jaccard of their tokens, for pairs that share one."""
    t = names.select(F.col(column).alias("name")).distinct().select("name", F.array_distinct(T.tokens("name")).alias("ts"))
    e = t.select("name", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    a, b = e.select(F.col("name").alias("name_a"), F.col("n").alias("na"), "t"), e.select(F.col("name").alias("name_b"), F.col("n").alias("nb"), "t")
    both = a.join(b, "t").filter("name_a < name_b").groupBy("name_a", "name_b", "na", "nb").agg(F.count("*").alias("both"))
    return both.select("name_a", "name_b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") >= least)
