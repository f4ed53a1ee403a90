"""Codelengths in bits, as Column expressions that stay in generated code.

Arguments may be Columns, numbers or column names. Nothing here groups or
joins; see ``bitquarry.operators.blocks`` for sums over blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)
#: Normalising constant of the universal code for integers (Rissanen 1983), in bits.
LOG_STAR_CONSTANT = 1.5165

Arg = Column | float | int | str


def c(x: Arg) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def lgamma(x: Arg) -> Column:
    """Natural log of Gamma for x > 0: eight recurrence steps, then Stirling's series."""
    x = c(x).cast("double")
    z = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    z2 = z * z
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - (1.0 / 1680 - (1.0 / 1188) / z2) / z2) / z2) / z2) / z
    # beyond 1e30 the product of the steps overflows and the steps no longer matter
    near = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)
    far = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
    return F.when(x > 1e30, far).otherwise(near)


def lg2(x: Arg) -> Column:
    """log2 Gamma(x)."""
    return lgamma(x) / LN2


def log2_star(x: Arg) -> Column:
    """Sum of the positive terms of log2 x, log2 log2 x, ..."""
    out, v = F.lit(0.0), c(x).cast("double")
    for _ in range(6):
        v = F.when(v > 1, F.log2(v))
        out = out + F.when(v > 0, v).otherwise(0.0)
    return out


def universal_int(k: Arg) -> Column:
    """Bits of an integer k >= 1 under the universal code."""
    return log2_star(k) + LOG_STAR_CONSTANT


def elias_gamma(x: Arg) -> Column:
    """Bits of an integer x >= 0: 2 floor(log2(x + 1)) + 1."""
    return (2 * F.length(F.bin(c(x).cast("long") + 1)) - 1).cast("double")


def elias_delta(x: Arg) -> Column:
    """Bits of an integer x >= 1 under the delta code."""
    n = F.length(F.bin(c(x).cast("long")))
    return (n - 1 + 2 * F.length(F.bin(n.cast("long"))) - 1).cast("double")


def string_bits(s: Arg) -> Column:
    """A string's bytes, after their number in the gamma code."""
    n = F.octet_length(c(s))
    return elias_gamma(n) + 8 * n


def column_bits(t: Arg, n: Arg) -> Column:
    """A binary column of n places with t ones, all at once."""
    t, n = c(t), c(n)
    return math.log2(math.pi) + lg2(n + 1) - lg2(t + 0.5) - lg2(n - t + 0.5)


def binary_bits(ones: Arg, total: Arg) -> Column:
    return column_bits(ones, total)


def attach_bits(t: Arg, n_including: Arg) -> Column:
    """What one more member costs a membership column: t of the n before are members."""
    t = c(t)
    return F.log2((c(n_including) - 1 - t + 0.5) / (t + 0.5))


def kt(count: Arg, total: Arg, size: Arg) -> Column:
    """Predictive bits of a symbol seen ``count`` times of ``total`` in an alphabet of ``size``."""
    return -F.log2((c(count) + 0.5) / (c(total) + c(size) / 2))


def kt_block(sum_lg_half_counts: Column, total: Arg, size: Arg) -> Column:
    """A block from sum(lg2(1/2) - lg2(count + 1/2)) over its symbols."""
    half = c(size) / 2
    return lg2(c(total) + half) - lg2(half) + sum_lg_half_counts


def kt_block_term(count: Arg) -> Column:
    return 0.5 * math.log2(math.pi) - lg2(c(count) + 0.5)


def log2_choose(n: Arg, k: Arg) -> Column:
    n, k = c(n), c(k)
    return lg2(n + 1) - lg2(k + 1) - lg2(n - k + 1)


def support_bits(size: Arg, keys: Arg) -> Column:
    """Which ``size`` of ``keys`` keys (size >= 1)."""
    return universal_int(size) + log2_choose(keys, size)


def support_bits_or_none(size: Arg, keys: Arg) -> Column:
    return F.when(c(size) <= 0, universal_int(1)).otherwise(support_bits(F.greatest(c(size), F.lit(1.0)), keys))


def announce_bits(edits: Arg, n: Arg, announced: bool = True) -> Column:
    """Whether record n changes the graph, with ``edits`` changes before it."""
    e, n = c(edits), c(n)
    return kt(e, n - 1, 2) if announced else kt(n - 1 - e, n - 1, 2)


def count_bits(nodes: Arg) -> Column:
    """From K to K + 1 nodes."""
    k = c(nodes)
    return F.when(k > 0, universal_int(k + 1) - universal_int(F.greatest(k, F.lit(1.0)))).otherwise(universal_int(1)) + F.log2(k + 1)


def node_price(t: Arg, size: Arg, n: Arg, nodes: Arg, edits: Arg, keys: Arg) -> Column:
    """A new node of t members with a support of ``size`` keys."""
    return announce_bits(edits, n) + 2 + column_bits(t, n) + support_bits(size, keys) + count_bits(nodes)


def marginal_price(t: Arg, n: Arg) -> Column:
    """What the t-th member adds to the price."""
    return column_bits(t, n) - column_bits(c(t) - 1, n)


def naming_charge(inventory: Arg, distinct: Arg = 0, tight: bool = False) -> Column:
    """Naming one value of a key: among all values and a new one, or (tight) among those its block lacks."""
    inv = c(inventory)
    return F.log2(F.greatest(F.lit(1.0), inv - c(distinct) + 1)) if tight else F.log2(inv + 1)


def block_cost(count: Arg, total: Arg, distinct: Arg, naming: Arg) -> Column:
    """The next value of a block: new or seen, then which; all counts from before it."""
    k, n, u, name = c(count), c(total), c(distinct), c(naming)
    fresh = kt(u, n, 2) + name
    seen = kt(n - u, n, 2) + kt(k, n, F.greatest(u, F.lit(1.0)))
    return F.when(n == 0, name).when(k == 0, fresh).otherwise(seen)


def vblock_bits(sum_term_less_one: Column, total: Arg, distinct: Arg, naming: Arg, inventory: Arg | None = None) -> Column:
    """A block all at once: which places are new values, the others' counts, and the names.

    sum_term_less_one: sum(kt_block_term(count - 1)). With an inventory the
    names are drawn without replacement (tight), else each costs ``naming``.
    """
    n, u = c(total), c(distinct)
    names = u * c(naming) if inventory is None else lg2(c(inventory) + 2) - lg2(F.greatest(c(inventory) - u + 2, F.lit(1.0)))
    return F.when(n > 0, column_bits(u, n) + kt_block(sum_term_less_one, n - u, u) + names).otherwise(0.0)


def _vblock(n: Column, u: Column, naming: Column) -> Column:
    """The parts of vblock_bits that depend on n and u alone."""
    safe = F.greatest(u, F.lit(1.0))
    return F.when(n > 0, column_bits(u, n) + lg2(n - u + safe / 2) - lg2(safe / 2) + u * naming).otherwise(0.0)


def vblock_delta_add(count: Arg, total: Arg, distinct: Arg, naming: Arg) -> Column:
    """Change of vblock_bits when a value seen ``count`` times comes once more."""
    k, n, u, name = c(count), c(total), c(distinct), c(naming)
    new = k == 0
    after = _vblock(n + 1, F.when(new, u + 1).otherwise(u), name)
    term = F.when(new, kt_block_term(0)).otherwise(kt_block_term(k) - kt_block_term(F.greatest(k - 1, F.lit(0.0))))
    return after - _vblock(n, u, name) + term


def vblock_delta_remove(count: Arg, total: Arg, distinct: Arg, naming: Arg) -> Column:
    """Change of vblock_bits when a value seen ``count`` >= 1 times goes once."""
    k, n, u, name = c(count), c(total), c(distinct), c(naming)
    last = k == 1
    return -vblock_delta_add(k - 1, n - 1, F.when(last, u - 1).otherwise(u), name)


def split_naming_charge(candidates: Arg) -> Column:
    return F.log2(F.greatest(c(candidates), F.lit(1.0)))


def merge_naming_charge(keys: Arg, cooccurring: Arg) -> Column:
    """Which pair of keys, of those that never meet."""
    a = c(keys)
    return F.log2(F.greatest(a * (a - 1) / 2 - c(cooccurring), F.lit(1.0)))


def mixture_bits(a: Arg, b: Arg, prior_a: float = 0.5) -> Column:
    """Two codes' Bayesian mixture."""
    x, y = c(a) - math.log2(prior_a), c(b) - math.log2(1 - prior_a)
    low, gap = F.least(x, y), F.abs(x - y)
    return low - F.log2(1 + F.pow(F.lit(2.0), -gap))


def entropy_term(p: Arg) -> Column:
    """-p log2 p, 0 at 0; sum it for the entropy."""
    p = c(p)
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def jensen_shannon_term(p: Arg, q: Arg, weight: float = 0.5) -> Column:
    """One symbol's part of the divergence with weight on p."""
    p, q = F.coalesce(c(p), F.lit(0.0)), F.coalesce(c(q), F.lit(0.0))
    return entropy_term(weight * p + (1 - weight) * q) - weight * entropy_term(p) - (1 - weight) * entropy_term(q)


def block_mass(distinct: Arg, total: Arg, inventory: Arg) -> Column:
    """Probability that block_cost spends over an inventory: below one by what unused names keep."""
    u, n, inv = c(distinct), c(total), c(inventory)
    new = (u + 0.5) / (n + 1)
    return F.when(n == 0, inv / (inv + 1)).otherwise((n - u + 0.5) / (n + 1) + new * (inv - u) / (inv + 1))


def block_deficiency(distinct: Arg, total: Arg, inventory: Arg) -> Column:
    return 1 - block_mass(distinct, total, inventory)


def nml_complexity(n: Arg, k: Arg) -> Column:
    """log2 of the multinomial NML normaliser of n draws over k >= 1 symbols, by the linear recursion in k."""
    n, k = c(n).cast("double"), c(k).cast("int")
    # two symbols: sum over h of C(n,h) (h/n)^h ((n-h)/n)^(n-h)
    xlogx = lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)
    each = F.transform(
        F.sequence(F.lit(0), n.cast("int")),
        lambda h: F.exp(lgamma(n + 1) - lgamma(h + 1.0) - lgamma(n - h + 1.0) + xlogx(h / n) * n + xlogx((n - h) / n) * n))
    two = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(1.0).alias("before"), two.alias("now"))
    steps = F.when(k > 2, F.sequence(F.lit(3), F.greatest(k, F.lit(3)))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, start, lambda a, j: F.struct(a.now.alias("before"), (a.now + n / (j - 2) * a.before).alias("now")))
    return F.when((k <= 1) | (n <= 0), 0.0).otherwise(F.log2(last.getField("now")))


def nml_asymptotic(n: Arg, k: Arg) -> Column:
    """(k-1)/2 log2(n/2) + log2(sqrt(pi) / Gamma(k/2))."""
    n, k = c(n), c(k)
    return (k - 1) / 2 * F.log2(n / 2) + 0.5 * math.log2(math.pi) - lg2(k / 2)


def harmonic_price(s: Arg, a: Arg, b: Arg, nodes: Arg, harmonic: Arg) -> Column:
    """Idealised price log2(s (b + H) + 1) - log2(a + K)."""
    return F.log2(c(s) * (c(b) + c(harmonic)) + 1) - F.log2(c(a) + c(nodes))


def equal_cost(a: Arg, b: Arg) -> Column:
    """Equal within 32 units in the last place."""
    a, b = c(a), c(b)
    return F.abs(a - b) <= 32 * 2.0**-52 * F.greatest(F.abs(a), F.abs(b), F.lit(2.0**-1022))


def seed_charge(mode: str, key_id: Arg, value_id: Arg, n_keys: Arg, n_values: Arg, slack: float = 0.0) -> Column:
    """Naming the pair that opens an account: "av" among keys and values, "ln" by universal integers, "none"."""
    if mode == "av":
        bits = F.log2(F.greatest(c(n_keys), F.lit(1.0))) + F.log2(F.greatest(c(n_values), F.lit(1.0)))
    elif mode == "ln":
        bits = universal_int(c(key_id) + 1) + universal_int(c(value_id) + 1)
    elif mode == "none":
        return F.lit(0.0)
    else:
        raise ValueError("mode is av, ln or none")
    return bits + slack
