"""Problem 8: sources mixed to target shares of the total size in tokens."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.runtime import MAX_BROADCAST_ROWS, cut, spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits texts before merging (fixed value of the public tokenizer).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = 100_000
_GAP = re.compile(r"(?<=\S)\s")


def pieces(text: str, size: int = _PIECE) -> list[str]:
    """A text in parts of about ``size`` characters, cut where white space begins, which leaves its tokens as
    they are; only words longer than ``size`` are cut within."""
    out, at = [], 0
    while len(text) - at > size:
        m = _GAP.search(text, at + size, at + 2 * size)
        end = m.start() if m else at + 2 * size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]




def _counter(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            out = []
            for t in texts:
                # Very long texts are counted piece by piece, all of them.
                out.append(0 if t is None else sum(len(enc.encode_ordinary(x)) for x in pieces(t)))
            yield pd.Series(out, index=texts.index, dtype="int64")

    return run


def token_counts(documents: DataFrame, text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``documents`` plus ``n_tokens`` by a public byte-level tokenizer; 0 for null or blank texts."""
    count = F.pandas_udf(_counter(ranks), "long")
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    return documents.withColumn("n_tokens", F.when(blank, F.lit(0).cast("long")).otherwise(count(F.col(text))))


def normal_source(c):
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


@dataclass
class Tilt:
    """The dual solution of one source: copies of a document at ``min(cap, exp(rate * tokens / mean))``.

    Where the dual has no finite solution, as even the cap everywhere doesn't reach the goal, ``rate`` is infinite."""

    source: str
    goal: float
    cap: int
    total: float
    mean: float
    rate: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    @property
    def short(self) -> bool:
        """Whether the solution is at its cap everywhere and still under the goal."""
        return self.goal > self.cap * self.total and (math.isinf(self.rate) and self.rate > 0 or self.cap == 0)


def _tilted(counts: DataFrame, tilts: list[Tilt]) -> DataFrame:
    spark = counts.sparkSession
    rows = [(t.source, float(t.rate), float(t.mean or 1.0), float(t.cap)) for t in tilts]
    rates = spark.createDataFrame(rows, "source string, rate double, mean double, cap double")
    z = F.col("n_tokens") / F.col("mean")
    # Beyond 40 the cap holds anyway; the bound keeps exp() finite.
    grown = F.exp(F.least(F.lit(40.0), F.col("rate") * z))
    joined = counts.join(F.broadcast(rates), "source")  # as many rows as there are sources in a block of targets
    return joined.withColumn("z", z).withColumn("weight", F.least(F.col("cap"), grown)).withColumn("free", grown < F.col("cap"))


def balance(counts: DataFrame, targets: DataFrame, total: float | None = None, tolerance: float = 1e-6, rounds: int = 60, max_sources: int = 10_000) -> list[Tilt]:
    """Entropy balancing of token totals.

    Among all document rates, those nearest in relative entropy to taking each document
    once, that meet every source's token total, are exponential in the constrained
    quantity: ``exp(rate_s * tokens)``.  The rates ``rate_s`` solve the convex dual; each
    Newton step is one distributed aggregation (gradient and curvature of every source at
    once), kept between the bounds found so far.  ``max_repeats`` caps a document's rate;
    where even the cap everywhere falls short, the cap is the answer.

    ``counts(source, n_tokens)``, ``targets(source, target_share, max_repeats)``; sources
    are compared trimmed and lower-cased.  ``total`` is the size of the mix, by default
    that of all documents."""
    wanted = (
        targets.select(normal_source(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("cap"))
        .where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    )
    sums = counts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("n_tokens") > 0).alias("n"))
    if total is None:
        total = float(counts.agg(F.sum("n_tokens")).first()[0] or 0)
    tilts: list[Tilt] = []
    for r in wanted.join(sums, "source", "left").orderBy("source").toLocalIterator():
        t, n = float(r["t"] or 0), r["n"] or 0
        tilt = Tilt(r["source"], r["share"] * total, r["cap"], t, t / n if n else 0.0)
        if tilt.goal >= tilt.cap * t:
            tilt.rate, tilt.done = math.inf if tilt.cap > 0 else -math.inf, True
        elif tilt.goal <= 0:
            tilt.rate, tilt.done = -math.inf, True
        tilts.append(tilt)
    # Sources don't depend on each other, given the total, so any number of them is worked through in blocks.
    for at in range(0, len(tilts), max_sources):
        _solve(counts, tilts[at : at + max_sources], tolerance, rounds)
    return tilts


def _solve(counts: DataFrame, tilts: list[Tilt], tolerance: float, rounds: int) -> None:
    """Newton steps for all sources at once, each one distributed aggregation."""
    for _ in range(rounds):
        todo = [t for t in tilts if not t.done]
        if not todo:
            return
        x = _tilted(counts, todo)
        stats = x.groupBy("source").agg(
            F.sum(F.col("weight") * F.col("n_tokens")).alias("f"),
            F.sum(F.when(F.col("free"), F.col("weight") * F.col("n_tokens") * F.col("z")).otherwise(0.0)).alias("h"),
        )
        at = {r["source"]: (r["f"], r["h"]) for r in stats.collect()}
        for t in todo:
            f, h = at[t.source]
            gap = t.goal - f
            if abs(gap) <= tolerance * t.goal:
                t.done = True
                continue
            t.low, t.high = (t.rate, t.high) if gap > 0 else (t.low, t.rate)
            step = t.rate + gap / h if h > 0 else math.nan
            if not t.low < step < t.high:
                if math.isinf(t.low) or math.isinf(t.high):
                    step = t.rate + math.copysign(1.0 + abs(t.rate), gap)
                else:
                    step = (t.low + t.high) / 2
            t.rate = step
            if t.high - t.low < 1e-12:
                t.done = True
    if not all(t.done for t in tilts):
        raise RuntimeError(f"no balance after {rounds} rounds")


def _counts(documents: DataFrame, key: str, ranks: str) -> DataFrame:
    base = documents.select(F.col(key).alias("doc"), normal_source(F.col("source")).alias("source"), "text")
    return cut(token_counts(spread(base), "text", ranks).select("doc", "source", "n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7, ranks: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    ``copies(doc_id, source, n_tokens, copies)``: how often each document is taken, by
    systematic rounding of the rates, so runs agree.  Documents of sources without a
    target and null sources are taken 0 times.
    ``report(source, target_share, actual_share, tokens, mixed_tokens, max_repeats,
    short)``, one row per target; ``short`` where the cap keeps the source under its target."""
    counts = _counts(documents, key, ranks)
    return copies_of(counts, tilts := balance(counts, targets), key, seed), _report(counts, targets, tilts, key, seed)


#: Parts of a copy that rates are told in, so that their sums are whole numbers and agree between runs.
UNIT = 1 << 16
#: Width of the classes of sizes, and documents of a class that one task takes.
SIZE_STEP, CLASS_ROWS = 1.1, 1_000_000


def copies_of(counts: DataFrame, tilts: list[Tilt], key: str, seed: int) -> DataFrame:
    """Whole copies by systematic rounding: along the documents of a source in order of their size, each
    gets as many as whole numbers lie between the rates summed up before and with it, so the tokens
    of a source are off by some documents' only.

    The sums run within classes of like sizes, large ones cut by a hash, and what lies
    before each of them is summed up apart: no task takes a whole source."""
    spark = counts.sparkSession
    rows = [(t.source, max(-1e9, min(1e9, float(t.rate))), float(t.mean or 1.0), float(t.cap)) for t in tilts]
    rates = spark.createDataFrame(rows, "source string, rate double, mean double, cap double")
    rates = F.broadcast(rates) if len(rows) <= MAX_BROADCAST_ROWS else rates
    tilted = F.exp(F.least(F.lit(40.0), F.greatest(F.lit(-700.0), F.col("rate") * F.col("n_tokens") / F.col("mean"))))
    units = F.round(F.least(F.col("cap"), tilted) * UNIT).cast("long")
    size = F.floor(F.log1p("n_tokens") / F.lit(math.log(SIZE_STEP))).cast("int")
    rated = counts.join(rates, "source").select("doc", "source", "n_tokens", "cap", units.alias("units"), size.alias("size"), F.xxhash64("doc", F.lit(seed)).alias("h"))
    classes = rated.groupBy("source", "size").agg(F.ceil(F.count(F.lit(1)) / CLASS_ROWS).alias("parts"))
    parted = rated.join(classes, ["source", "size"]).withColumn("part", F.pmod("h", "parts"))
    sums = parted.groupBy("source", "size", "part").agg(F.sum("units").alias("all"))
    order = Window.partitionBy("source").orderBy("size", "part")
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT))
    before = sums.withColumn("before", F.sum("all").over(order) - F.col("all") + start).drop("all")
    within = Window.partitionBy("source", "size", "part").orderBy("n_tokens", "h", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parted.join(before, ["source", "size", "part"]).withColumn("to", F.col("before") + F.sum("units").over(within))
    whole = F.floor(F.col("to") / UNIT) - F.floor((F.col("to") - F.col("units")) / UNIT)
    taken = summed.select("doc", "source", "n_tokens", F.least(whole, F.col("cap")).cast("int").alias("copies"))
    none = counts.join(rates.select("source"), "source", "left_anti")
    return taken.unionByName(none.select("doc", "source", "n_tokens", F.lit(0).alias("copies"))).withColumnRenamed("doc", key)


def _report(counts: DataFrame, targets: DataFrame, tilts: list[Tilt], key: str, seed: int) -> DataFrame:
    spark = counts.sparkSession
    taken = copies_of(counts, tilts, key, seed).groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens")
    )
    goal_sum = sum(t.goal for t in tilts) or 1.0
    rows = [(t.source, t.goal, t.cap, t.short) for t in tilts]
    goals = spark.createDataFrame(rows, "source string, goal double, max_repeats int, short boolean")
    per = goals.join(taken, "source", "left")
    per = per.fillna(0, ["tokens", "mixed_tokens"])
    whole = per.agg(F.sum("mixed_tokens").alias("m"))
    return per.select(
        "source",
        (F.col("goal") / F.lit(goal_sum)).alias("target_share"),
        F.try_divide(F.col("mixed_tokens").cast("double"), whole.scalar()).alias("actual_share"),
        "tokens",
        "mixed_tokens",
        "max_repeats",
        "short",
    )
