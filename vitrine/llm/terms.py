"""Problem 3: how often every distinct term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import WS, cell_of
from vitrine.runtime import parallelism

_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def normal_term(c: Column) -> Column:
    """Lower case, with everything but letters and digits taken off both ends."""
    return F.regexp_replace(F.lower(c), _EDGES, "")


def text_terms(c: Column) -> Column:
    """The white-space separated tokens of a text, as an array."""
    return F.split(F.coalesce(c.cast("string"), F.lit("")), WS)


def term_rows(records: DataFrame, record: str, fields: dict[str, Column]) -> DataFrame:
    """``(field, term, rec)``, one row per occurrence; ``fields`` maps names to array columns."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.array().cast("array<string>")).alias("terms")) for k, v in fields.items()]
    )
    return (
        records.select(F.col(record).alias("rec"), F.explode(pairs).alias("p"))
        .select("rec", "p.field", F.explode("p.terms").alias("term"))
        .select("field", normal_term(F.col("term")).alias("term"), "rec")
        .where(F.col("term") != "")
    )


def term_frequencies(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """``(field, term, occurrences, records)`` over rows ``(field, term, rec)``.

    Method: last-seen counters.  Occurrences are hash-partitioned by (field, term) and a
    part of the records (``cells`` parts, so that a term in every record is spread over
    all tasks) and ordered by record; a record counts where it differs from the last one
    seen of the term, so no term keeps a set of its records.  A record lies whole in
    one part, hence the parts' counts add up.

    Null terms or records don't count; a record may send its terms in several rows.
    An empty input gives no rows."""
    cells = cells or parallelism(rows.sparkSession)
    seen = rows.select("field", "term", "rec").where(F.col("term").isNotNull() & F.col("rec").isNotNull())
    seen = seen.withColumn("c", cell_of(cells, F.col("rec")))
    last = Window.partitionBy("field", "term", "c").orderBy("rec")
    counted = seen.withColumn("last", F.lag("rec").over(last))
    part = counted.groupBy("field", "term", "c").agg(
        F.count(F.lit(1)).alias("o"), F.count_if(F.col("last").isNull() | (F.col("last") != F.col("rec"))).alias("n")
    )
    return part.groupBy("field", "term").agg(F.sum("o").alias("occurrences"), F.sum("n").alias("records"))


def mark_terms(freq: DataFrame, total: DataFrame, rare: int = 1, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare`` (in at most ``rare`` records), ``common`` (in more than
    ``common_share`` of the records, whose number is the one cell of ``total``) or null.
    A term that is both, as in a tiny collection, is ``rare``."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common_share) * total.scalar(), "common")
    return freq.withColumn("mark", mark)
