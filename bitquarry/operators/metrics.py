"""Scores of partitions, covers, pair decisions and rankings.

A partition is (rec_id, label) beside (rec_id, truth); a cover is a table of
memberships (rec_id, group). All scores come from counts of a contingency
table, except the omega index, which counts pairs of records by how many
groups they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return n.cast("double") * (n - 1) / 2


def contingency(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    return df.groupBy(truth, label).agg(F.count("*").alias("n"))


def _pair_counts(df: DataFrame, truth: str, label: str) -> DataFrame:
    """One row: together in both, in label, in truth, and all pairs."""
    c = contingency(df, truth, label)
    both = c.agg(F.sum(_pairs("n")).alias("both"), F.sum("n").alias("records"))
    by = lambda k, out: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(_pairs("n")).alias(out))
    return both.crossJoin(by(label, "in_label")).crossJoin(by(truth, "in_truth")).withColumn("all", _pairs("records"))  # one-row tables


def adjusted_rand(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    expected = F.col("in_label") * F.col("in_truth") / F.col("all")
    most = (F.col("in_label") + F.col("in_truth")) / 2
    return _pair_counts(df, truth, label).select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def _prf(tp: Column, predicted: Column, gold: Column, vacuous: float) -> list[Column]:
    p = F.when(predicted > 0, tp / predicted).otherwise(vacuous)
    r = F.when(gold > 0, tp / gold).otherwise(vacuous)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def pairwise(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """Precision, recall and F1 over pairs of records; precision without any pair is 1."""
    return _pair_counts(df, truth, label).select(*_prf(F.col("both"), F.col("in_label"), F.col("in_truth"), 1.0))


def cluster_metrics(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """clusters, kinds, purity, wrong_merges (clusters of several kinds), singletons, largest_share."""
    c = contingency(df, truth, label)
    per = c.groupBy(label).agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    out = per.agg(F.count("*").alias("clusters"), (F.sum("top") / F.sum("size")).alias("purity"), F.count_if(F.col("kinds") > 1).alias("wrong_merges"), F.count_if(F.col("size") == 1).alias("singletons"), (F.max("size") / F.sum("size")).alias("largest_share"))
    return out.crossJoin(c.agg(F.count_distinct(truth).alias("kinds")))


def majority(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """label, kind, share: each cluster's most frequent kind, the smallest of equals."""
    c = contingency(df, truth, label)
    return c.groupBy(label).agg(F.min_by(truth, F.struct(-F.col("n"), truth)).alias("kind"), (F.max("n") / F.sum("n")).alias("share"))


def largest_group_labels(membership: DataFrame, records: DataFrame, rule: str = "largest") -> DataFrame:
    """rec_id, label of a cover: the record's largest (or smallest, or earliest by first record) group, the lowest id of equals; -1 without any."""
    size = membership.groupBy("group").agg(F.count("*").alias("t"), F.min("rec_id").alias("birth"))
    first = {"largest": -F.col("t"), "smallest": F.col("t"), "earliest": F.col("birth")}[rule]
    one = membership.join(size, "group").groupBy("rec_id").agg(F.min_by("group", F.struct(first, "group")).alias("label"))
    return records.select("rec_id").join(one, "rec_id", "left").select("rec_id", F.coalesce("label", F.lit(-1)).alias("label"))


def shared_group_counts(membership: DataFrame) -> DataFrame:
    """rec_a < rec_b and how many groups they share. Grows with the square of a group: for evaluation samples."""
    a, b = membership.select(F.col("rec_id").alias("rec_a"), "group"), membership.select(F.col("rec_id").alias("rec_b"), "group")
    return a.join(b, "group").filter("rec_a < rec_b").groupBy("rec_a", "rec_b").agg(F.count("*").alias("shared"))


def omega(truth: DataFrame, found: DataFrame, records: int) -> DataFrame:
    """Agreement of two covers over pairs of records, corrected for chance."""
    t, p = shared_group_counts(truth).withColumnRenamed("shared", "t"), shared_group_counts(found).withColumnRenamed("shared", "p")
    joint = t.join(p, ["rec_a", "rec_b"], "full").fillna(0, ["t", "p"])
    total = records * (records - 1) / 2
    agree = joint.agg((F.count_if(F.col("t") == F.col("p")) + (F.lit(total) - F.count("*"))).alias("agree"), F.count("*").alias("some"))
    hist = lambda c: joint.filter(f"{c} > 0").groupBy(F.col(c).alias("k")).agg(F.count("*").alias(f"n_{c}"))
    both = hist("t").join(hist("p"), "k", "full").fillna(0, ["n_t", "n_p"])
    chance = both.agg(F.coalesce(F.sum(F.col("n_t").cast("double") * F.col("n_p")), F.lit(0.0)).alias("products"), F.coalesce(F.sum("n_t"), F.lit(0)).alias("st"), F.coalesce(F.sum("n_p"), F.lit(0)).alias("sp"))
    obs = F.col("agree") / total
    exp = (F.col("products") + (total - F.col("st")) * (total - F.col("sp"))) / (total * total)
    return agree.crossJoin(chance).select(F.when(exp == 1, 1.0).otherwise((obs - exp) / (1 - exp)).alias("omega"))


def membership_overlap(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth group, found group, both, sizes, f1."""
    both = truth.select("rec_id", F.col("group").alias("gold")).join(found.select("rec_id", "group"), "rec_id").groupBy("gold", "group").agg(F.count("*").alias("both"))
    st = truth.groupBy(F.col("group").alias("gold")).agg(F.count("*").alias("n_gold"))
    sp = found.groupBy("group").agg(F.count("*").alias("n_found"))
    return both.join(st, "gold").join(sp, "group").withColumn("f1", 2 * F.col("both") / (F.col("n_gold") + F.col("n_found")))


def membership_many_to_one(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each found group stands for the kind it overlaps most: precision, recall, F1 of memberships."""
    o = membership_overlap(truth, found)
    best = o.groupBy("group").agg(F.min_by("gold", F.struct(-F.col("both"), "gold")).alias("gold"))
    named = found.join(best, "group").select("rec_id", F.col("gold").alias("group")).distinct()
    tp = named.join(truth.select("rec_id", "group"), ["rec_id", "group"]).agg(F.count("*").alias("tp"))
    return tp.crossJoin(named.agg(F.count("*").alias("predicted"))).crossJoin(truth.agg(F.count("*").alias("gold"))).select(*_prf(F.col("tp"), F.col("predicted"), F.col("gold"), 0.0))


def assignment(weights: list[list[float]]) -> list[int]:
    """Row for each column (or -1) of a maximum-weight one-to-one matching; for as many groups as a driver holds."""
    import numpy as np

    w = np.array(weights, float)
    if not w.size:
        return []
    n, m = w.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -w
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.zeros(size + 1, int)
    for i in range(1, size + 1):  # shortest augmenting path from row i
        match[0], j0 = i, 0
        low, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0] - u[i0] - v
            better = ~used & (reduced < low)
            better[0] = False
            low[better], way[better] = reduced[better], j0
            free = np.where(used, np.inf, low)
            free[0] = np.inf
            j1 = int(free.argmin())
            delta = free[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [match[j] - 1 if 1 <= match[j] <= n and w[match[j] - 1, j - 1] > 0 else -1 for j in range(1, m + 1)]


def membership_one_to_one(truth: DataFrame, found: DataFrame) -> tuple[float, float, float]:
    """Precision, recall, F1 of memberships under the best one-to-one matching of groups."""
    rows = membership_overlap(truth, found).select("gold", "group", "both").collect()  # one row for each pair of groups that meet
    golds, groups = sorted({r.gold for r in rows}), sorted({r.group for r in rows})
    w = [[0.0] * len(groups) for _ in golds]
    for r in rows:
        w[golds.index(r.gold)][groups.index(r.group)] = float(r.both)
    tp = sum(w[i][j] for j, i in enumerate(assignment(w)) if i >= 0)
    p, r = found.count(), truth.count()
    precision, recall = (tp / p if p else 0.0), (tp / r if r else 0.0)
    return precision, recall, (2 * precision * recall / (precision + recall) if precision + recall else 0.0)


def greedy_matching(overlaps: DataFrame) -> list[tuple]:
    """(gold, group) pairs, largest overlap first, each once."""
    out, a, b = [], set(), set()
    for r in overlaps.orderBy(F.desc("both"), "gold", "group").toLocalIterator():
        if r.gold not in a and r.group not in b:
            out.append((r.gold, r.group))
            a.add(r.gold)
            b.add(r.group)
    return out


def size_histogram(membership: DataFrame) -> DataFrame:
    return membership.groupBy("rec_id").agg(F.count("*").alias("groups")).groupBy("groups").agg(F.count("*").alias("records"))


def combination_labels(membership: DataFrame) -> DataFrame:
    """rec_id, label: the record's set of groups as one string."""
    return membership.groupBy("rec_id").agg(F.array_join(F.array_sort(F.collect_set("group")).cast("array<string>"), ",").alias("label"))


def set_prf(found: DataFrame, gold: DataFrame, vacuous: float = 0.0) -> DataFrame:
    """Precision, recall and F1 of two sets of rows with the same columns."""
    f, g = found.distinct(), gold.distinct()
    tp = f.intersect(g).agg(F.count("*").alias("tp"))
    return tp.crossJoin(f.agg(F.count("*").alias("p"))).crossJoin(g.agg(F.count("*").alias("g"))).select(*_prf(F.col("tp"), F.col("p"), F.col("g"), vacuous))


def stratified_confusion(pairs: DataFrame, stratum: str = "stratum", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """stratum (and ALL), tp, fp, fn, precision, recall, f1 of boolean decisions."""
    c = pairs.rollup(stratum).agg(F.count_if(F.col(gold) & F.col(predicted)).alias("tp"), F.count_if(~F.col(gold) & F.col(predicted)).alias("fp"), F.count_if(F.col(gold) & ~F.col(predicted)).alias("fn"))
    return c.select(F.coalesce(stratum, F.lit("ALL")).alias("stratum"), "tp", "fp", "fn", *_prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), 0.0))


def precision_at_k(rows: DataFrame, score: str, good: str, k: int, tie: str) -> DataFrame:
    """precision, lift over the base rate, and hits of the k best rows by score (a report; ties by ``tie``)."""
    base = rows.agg(F.avg(F.col(good).cast("double")).alias("rate"))
    top = rows.orderBy(F.desc(score), tie).limit(k).agg(F.avg(F.col(good).cast("double")).alias("precision"), F.count_if(F.col(good)).alias("hits"))
    return top.crossJoin(base).select("precision", F.when(F.col("rate") > 0, F.col("precision") / F.col("rate")).alias("lift"), "hits")


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank with ties averaged: counts below a value come from the distinct values, not from all rows in one task."""
    per = df.groupBy(column).agg(F.count("*").alias("__n"))
    w = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(per.select(column, (F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2).alias(out)), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return average_rank(average_rank(df.select(x, y), x, "__rx"), y, "__ry").agg(F.corr("__rx", "__ry").alias("spearman"))


def co_placement(runs: DataFrame) -> DataFrame:
    """rec_a < rec_b, together: in how many runs (run, rec_id, label) two records have a label (not -1) in common."""
    r = runs.filter("label <> -1")
    a, b = r.select("run", "label", F.col("rec_id").alias("rec_a")), r.select("run", "label", F.col("rec_id").alias("rec_b"))
    return a.join(b, ["run", "label"]).filter("rec_a < rec_b").groupBy("rec_a", "rec_b").agg(F.count("*").alias("together"))


def calibration(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """together, pairs, same: of the pairs that meet in so many runs, the share of one kind."""
    t = truth.select("rec_id", "truth")
    c = co_placement(runs).join(t.select(F.col("rec_id").alias("rec_a"), F.col("truth").alias("ta")), "rec_a").join(t.select(F.col("rec_id").alias("rec_b"), F.col("truth").alias("tb")), "rec_b")
    return c.groupBy("together").agg(F.count("*").alias("pairs"), F.avg((F.col("ta") == F.col("tb")).cast("double")).alias("same"))


def exceedance(df: DataFrame, column: str, bits: tuple[float, ...] = (1, 2, 4, 8, 12)) -> DataFrame:
    """bits, share of rows at or above, and 2 ** -bits."""
    levels = F.explode(F.array(*[F.lit(float(b)) for b in bits]))
    per = df.agg(*[F.avg((F.col(column) >= b).cast("double")).alias(f"s{i}") for i, b in enumerate(bits)])
    return per.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bits"), F.col(f"s{i}").alias("share"), F.lit(2.0**-b).alias("bound")) for i, b in enumerate(bits)])).alias("e")).select("e.*") if bits else df.select(levels)


def singletons(df: DataFrame, label: str = "label", noise: int = -1) -> DataFrame:
    """Noise rows get labels of their own."""
    return df.withColumn(label, F.when(F.col(label) == noise, F.concat(F.lit("s"), F.col("rec_id").cast("string"))).otherwise(F.col(label).cast("string")))


def two_conventions(df: DataFrame) -> DataFrame:
    """ARI with unplaced records as one group, and as singletons."""
    return adjusted_rand(df).withColumnRenamed("ari", "ari_background").crossJoin(adjusted_rand(singletons(df)).withColumnRenamed("ari", "ari_singletons"))


def integer_labels(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Numbers from 0 in order of first appearance; null is -1. The numbering runs over distinct labels."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("rec_id").alias("__f"))
    numbered = first.select(column, (F.row_number().over(Window.orderBy("__f", column)) - 1).alias(out))
    return df.join(numbered, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def best_of_sweep(results: DataFrame, score: str = "ari", by: str = "method", parameter: str = "parameter") -> DataFrame:
    """Each method's best parameter, the smallest of equals."""
    return results.groupBy(by).agg(F.min_by(parameter, F.struct(-F.col(score), parameter)).alias(parameter), F.max(score).alias(score))
