"""Problem 5: items that appear together, and how surprising that is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.runtime import MAX_BROADCAST_ROWS, cut

#: Degrees up to this count as they are; larger ones fall into classes a fiftieth wide.
EXACT_DEGREES = 512
CLASS_WIDTH = 1.02


def pairs_of_sets(members: DataFrame, chunk: int = 256, split: bool = True) -> DataFrame:
    """``(s, a, b)`` with ``a < b`` for all members of every set; ``members(s, m)`` is distinct.

    A set of up to ``chunk`` members makes its pairs in one task.  A larger one is cut into
    n / ``chunk`` parts by a hash; two parts meet by a join on (set, part, part), so the
    pairs of even the largest set are made by many tasks, none of which holds more than
    two parts of it.  ``split`` may be off where no set is that large."""
    joined = members
    if split:
        sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        big = sizes.where(F.col("n") > chunk).select("s", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
        joined = members.join(big, "s", "left")
        members = joined.where("parts is null")
    small = members.groupBy("s").agg(F.sort_array(F.collect_list("m")).alias("x")).where(F.size("x") > 1)
    # Position i pairs with what follows it; one row per first member keeps the generated arrays short.
    near = small.select("s", F.posexplode("x").alias("i", "a"), "x").select("s", "a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))
    if not split:
        return near
    parts = (
        joined.where("parts is not null")
        .withColumn("p", F.pmod(F.xxhash64("m"), F.col("parts").cast("long")).cast("int"))
        .groupBy("s", "parts", "p")
        .agg(F.collect_list("m").alias("x"))
    )
    left = parts.select("s", F.col("p").alias("p1"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("p2"), "x")
    right = parts.select("s", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("p1"), F.col("p").alias("p2"), F.col("x").alias("y"))
    meet = left.join(right, ["s", "p1", "p2"])
    far = (
        meet.select("s", "p1", "p2", F.explode("x").alias("u"), "y")
        .select("s", "p1", "p2", "u", F.explode("y").alias("v"))
        .where(((F.col("p1") == F.col("p2")) & (F.col("u") < F.col("v"))) | ((F.col("p1") != F.col("p2")) & (F.col("u") != F.col("v"))))
        .select("s", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    )
    return near.unionByName(far)


def baskets(events: DataFrame, basket: str, item) -> DataFrame:
    """Distinct ``(s, m)``; null baskets and null or empty items don't count."""
    return events.select(F.col(basket).alias("s"), item.alias("m")).where(F.col("s").isNotNull() & (F.col("m") != "")).distinct()


def session_baskets(sessions: DataFrame) -> DataFrame:
    """``(s, m)`` of a session log: all lines of one session are one basket; products are trimmed and upper-cased."""
    rows = sessions.where("session_id is not null").select("session_id", F.explode("events").alias("e"))
    return baskets(rows, "session_id", F.upper(F.btrim(F.col("e.product_id"), F.lit(" \t\r\n"))))


@dataclass
class Counted:
    """Members of baskets, written once, with what their counts and the null need."""

    members: DataFrame
    items: DataFrame
    #: by class of degree: class, mean degree, number; of items and of baskets
    item_classes: list
    basket_classes: list

    @property
    def baskets(self) -> int:
        return sum(r["num"] for r in self.basket_classes)

    @property
    def n_items(self) -> int:
        return sum(r["num"] for r in self.item_classes)

    @property
    def largest(self) -> int:
        return max((r["most"] for r in self.basket_classes), default=0)

    def often(self, least: int) -> DataFrame:
        """``(m, n)`` of the items in at least so many baskets, sent to all tasks by joins only where they are few.

        Classes hold whole ranges of degrees, so the sum over them is a bound of the number."""
        rows = self.items.where(F.col("n") >= least)
        number = sum(r["num"] for r in self.item_classes if r["most"] >= least)
        return F.broadcast(rows) if number <= MAX_BROADCAST_ROWS else rows


def counted(members: DataFrame) -> Counted:
    """``members(s, m)``, distinct, with the degrees of items and baskets by class (some 2,000 rows at most)."""
    members = cut(members)

    def classes(degrees: DataFrame) -> list:
        d = degrees.withColumn("c", degree_class(F.col("n"))).groupBy("c")
        return d.agg(F.avg("n").alias("deg"), F.count(F.lit(1)).alias("num"), F.max("n").alias("most")).orderBy("c").collect()

    items = cut(members.groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    return Counted(members, items, classes(items), classes(members.groupBy("s").agg(F.count(F.lit(1)).alias("n"))))


def pair_counts(members: DataFrame | Counted, min_count: int = 1, chunk: int = 256) -> DataFrame:
    """``(item_a, item_b, n_a, n_b, n_ab, n_baskets)`` for all pairs in at least ``min_count`` baskets.

    Items in fewer baskets than that can't be part of such a pair and go before pairs are
    made; counts are added up in each task before they move.  ``members(s, m)`` must be
    distinct.  An empty input gives no rows."""
    at = members if isinstance(members, Counted) else counted(members)
    items = at.often(min_count)
    often = at.members
    if min_count > 1:
        often = often.join(items.select("m"), "m", "left_semi")
    pairs = pairs_of_sets(often, chunk, at.largest > chunk)
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_count)
    one, two = (items.select(F.col("m").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    return counts.join(one, "a").join(two, "b").select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", "n_ab", F.lit(at.baskets).cast("long").alias("n_baskets")
    )


def lift():
    """How many times more common a pair of ``pair_counts`` is than by chance."""
    return F.col("n_ab") * F.col("n_baskets").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))


def degree_class(n):
    """Number of the class of a degree: at most some 2,000 classes at any size of the data."""
    wide = F.floor(F.log(n / F.lit(float(EXACT_DEGREES))) / F.lit(float(np.log(CLASS_WIDTH)))) + EXACT_DEGREES + 1
    return F.when(n <= EXACT_DEGREES, n).otherwise(wide).cast("long")


def fit_null(item_deg: np.ndarray, item_num: np.ndarray, basket_deg: np.ndarray, basket_num: np.ndarray, rounds: int = 2000, tol: float = 1e-8):
    """Fitness x of item classes and y of basket classes of the bipartite configuration model.

    An item lies in a basket with probability xy / (1 + xy); the fixed point meets the
    expected number of baskets of every item and of items of every basket."""
    edges = float((item_deg * item_num).sum())
    x, y = item_deg / np.sqrt(edges), basket_deg / np.sqrt(edges)
    gap = 0.0
    for _ in range(rounds):
        new_x = item_deg / (basket_num * y / (1 + np.outer(x, y))).sum(1)
        new_y = basket_deg / ((item_num * new_x)[:, None] / (1 + np.outer(new_x, y))).sum(0)
        gap = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max())
        x, y = new_x, new_y
        if gap < tol:
            break
    return x, y


def _tilt(n: np.ndarray, q: np.ndarray, m: np.ndarray):
    """Log weights z that move the mean of the trials to n, and the first two cumulants' parts there:
    ``(z, K(z), K''(z), tilted chances)``."""
    z = np.log(np.maximum(n, 0.5)) - np.log((q * m).sum(1))
    low, high = np.full(len(z), -700.0), np.full(len(z), 700.0)
    odds = np.log(q) - np.log1p(-q)
    for _ in range(200):
        w = 1 / (1 + np.exp(-np.clip(odds + z[:, None], -700, 700)))
        gap, k2 = (m * w).sum(1) - n, (m * w * (1 - w)).sum(1)
        low, high = np.where(gap < 0, z, low), np.where(gap > 0, z, high)
        if (np.abs(gap) <= 1e-10 * np.maximum(n, 1)).all():
            break
        step = z - np.clip(gap / np.maximum(k2, 1e-300), -2, 2)
        z = np.where((step > low) & (step < high), step, (low + high) / 2)
    # log(1 - q + q e^z) without overflow
    k0 = (m * (np.log1p(-q) + np.logaddexp(0.0, odds + z[:, None]))).sum(1)
    return z, k0, k2, w


def upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray, exact: float = 400.0, room: int = 4_000_000) -> np.ndarray:
    """P(N >= n) for sums of independent trials: ``q[i, k]`` is the chance of each of the
    ``m[k]`` trials of class k for case i.

    The chances are tilted so that their sum has the mean n.  Up to a variance of
    ``exact`` there, its distribution near n is taken from its characteristic function
    (a finite Fourier sum, exact but for rounding) and tilted back, which keeps small
    tails exact in relation to their size; above it, where it is off by less than a
    thousandth, by the saddle point with continuity correction.  Memory is bounded by
    ``room`` numbers, whatever n is."""
    from math import erfc

    n, q = np.asarray(n, float), np.clip(np.asarray(q, float), 1e-300, 1 - 1e-16)
    trials = float(m.sum())
    out = np.ones(len(n))
    out[n > trials] = 0.0
    out[n == trials] = np.exp((m * np.log(q[n == trials])).sum(1))
    one = (n == 1) & (n < trials)
    out[one] = -np.expm1((m * np.log1p(-q[one])).sum(1))
    rest = np.flatnonzero((n > 1) & (n < trials))
    for part in np.array_split(rest, max(1, int(np.ceil(rest.size * q.shape[1] / room)))):
        if not part.size:
            continue
        z, k0, k2, w = _tilt(n[part], q[part], m)
        upper = z >= 0  # else the lower tail is the small one
        near = np.flatnonzero(k2 <= exact)
        near = near[np.argsort(k2[near], kind="stable")]
        at = 0
        while at < near.size:
            size = int(np.ceil(12 * np.sqrt(k2[near[at]]) + 48)) | 1
            take = max(1, int(room / (size * q.shape[1])))
            i = near[at : at + take]
            size = int(np.ceil(12 * np.sqrt(k2[i].max()) + 48)) | 1
            half = size // 2
            turn = np.exp(2j * np.pi * np.arange(half + 1) / size)
            log_f = np.zeros((i.size, half + 1), complex)
            for k in range(q.shape[1]):
                log_f += m[k] * np.log(1 - w[i, k : k + 1] + w[i, k : k + 1] * turn)
            # Places around n; frequencies below zero are the conjugates of those above.
            j = np.arange(-half, half + 1)
            back = np.exp(log_f - 1j * 2 * np.pi * np.arange(half + 1) * (n[part[i]][:, None] % size) / size)
            p = (back[:, :1].real + 2 * (back[:, 1:] @ np.exp(-2j * np.pi * np.outer(np.arange(1, half + 1), j) / size)).real) / size
            p = np.where(n[part[i]][:, None] + j >= 0, np.maximum(p, 0.0), 0.0)
            side = np.where(upper[i][:, None], j >= 0, j < 0)
            tail = np.exp(k0[i] - z[i] * n[part[i]]) * (p * np.exp(np.where(side, -z[i][:, None] * j, -np.inf))).sum(1)
            out[part[i]] = np.where(upper[i], tail, 1 - tail)
            at += i.size
        far = np.flatnonzero(k2 > exact)
        if far.size:
            x, zf = n[part[far]], z[far]
            s = np.sign(zf) * np.sqrt(np.maximum(0.0, 2 * (zf * x - k0[far])))
            u = -np.expm1(-zf) * np.sqrt(k2[far])
            close = np.abs(zf) < 1e-5
            s_, u_ = np.where(close, 1.0, s), np.where(close, 1.0, u)
            # The two parts of the tail share a factor, taken out so that it may be small beyond all numbers.
            scaled = np.array([0.5 * erfc(v / np.sqrt(2)) if v < 8 else np.exp(-0.5 * v * v) / np.sqrt(2 * np.pi) / v * (1 - 1 / v**2 + 3 / v**4) for v in s_])
            tail = scaled + np.exp(-0.5 * s_**2) / np.sqrt(2 * np.pi) * (1 / u_ - 1 / s_)
            out[part[far]] = np.where(close, 0.5 + 0.5 / np.sqrt(2 * np.pi * k2[far]), tail)
    return np.clip(out, 0.0, 1.0)


def _tails(item_classes: dict[int, float], y: np.ndarray, basket_num: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Pairs of the same classes and count have the same tail; distinct ones are worked out once.
            keys, back = np.unique(pdf[["c_a", "c_b", "n_ab"]].to_numpy(np.int64), axis=0, return_inverse=True)
            expected, p = np.empty(len(keys)), np.empty(len(keys))
            for at in range(0, len(keys), 2000):
                k = keys[at : at + 2000]
                xa, xb = (np.array([item_classes[int(c)] for c in k[:, j]])[:, None] for j in (0, 1))
                q = (xa * y / (1 + xa * y)) * (xb * y / (1 + xb * y))
                expected[at : at + 2000] = (q * basket_num).sum(1)
                p[at : at + 2000] = upper_tail(k[:, 2], q, basket_num)
            back = back.ravel()
            yield pdf[["item_a", "item_b", "n_a", "n_b", "n_ab", "n_baskets"]].assign(expected=expected[back], p_value=p[back])

    return run


def surprise(members: DataFrame | Counted, min_count: int = 1) -> DataFrame:
    """``pair_counts`` plus ``lift, expected, p_value``.

    Exact counts are held against a fitted bipartite configuration null that keeps every
    item's number of baskets and every basket's size: ``expected`` and ``p_value``, the
    Poisson-binomial chance of as many common baskets or more.  ``lift`` is
    ``n_ab * n_baskets / (n_a * n_b)``.  Only the counts of degrees, by class, reach the driver."""
    at = members if isinstance(members, Counted) else counted(members)
    pairs = pair_counts(at, min_count)
    if not at.item_classes:
        empty = F.lit(None).cast("double")
        return pairs.withColumns({"expected": empty, "p_value": empty, "lift": empty})
    (ic, i_deg, i_num), (_, b_deg, b_num) = (
        ([r["c"] for r in rows], np.array([float(r["deg"]) for r in rows]), np.array([float(r["num"]) for r in rows])) for rows in (at.item_classes, at.basket_classes)
    )
    x, y = fit_null(i_deg, i_num, b_deg, b_num)
    ready = pairs.withColumns({"c_a": degree_class(F.col("n_a")), "c_b": degree_class(F.col("n_b"))})
    schema = "item_a string, item_b string, n_a long, n_b long, n_ab long, n_baskets long, expected double, p_value double"
    tails = ready.mapInPandas(_tails(dict(zip(ic, x.tolist())), y, b_num), schema)
    return tails.withColumn("lift", lift())


def false_discovery_cutoff(scored: DataFrame, tests: float, rate: float = 0.05, rounds: int = 100) -> float:
    """Benjamini-Hochberg: the greatest p-value called surprising among ``tests`` tests.

    The cutoff is the greatest t with ``t <= rate * #(p <= t) / tests``; starting from
    ``rate``, counting and shrinking reaches it without ranking all pairs."""
    t = rate
    for _ in range(rounds):
        n = scored.where(F.col("p_value") <= t).count()
        new = rate * n / tests
        if n == 0 or new >= t:
            return 0.0 if n == 0 else t
        t = new
    raise RuntimeError(f"no cutoff after {rounds} rounds")


def surprising_pairs(members: DataFrame, min_count: int = 1, rate: float = 0.05) -> DataFrame:
    """The pairs more common than chance with at most ``rate`` false discoveries, among all pairs of items.

    All pairs of items count as tests; those never seen have a p-value of 1, so with
    ``min_count`` 1 every pair takes part."""
    at = counted(members)
    scored = cut(surprise(at, min_count))
    return scored.where(F.col("p_value") <= false_discovery_cutoff(scored, max(1.0, at.n_items * (at.n_items - 1) / 2), rate))
