"""Catalogue, log and table files: readers and writers."""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

PRODUCT_SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "title", "description", "category")],
        T.StructField("subcategories", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("popularity_score", T.DoubleType()),
        T.StructField("freshness_score", T.DoubleType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)
SESSION_SCHEMA = "session_id string, events array<struct<product_id:string,event_type:string>>"


def numbered(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows of a file source with their place in the files, from 0: by path, then by place within.

    A task numbers the rows of a block as it reads them; how many rows the blocks before
    hold is summed up over the blocks, which are few, and added.  Two reads, no sort of rows."""
    at, order = F.monotonically_increasing_id(), Window.orderBy("__path", "__start")
    rows = df.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), at.alias("__at"), "*")
    blocks = rows.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = blocks.select("__path", "__start", "__first", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    place = (F.col("__before") + F.col("__at") - F.col("__first")).alias(name)
    return rows.join(before, ["__path", "__start"]).select(place, *df.columns)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of products with ``ord``; blank lines are skipped, malformed ones fail the read."""
    rows = spark.read.schema(PRODUCT_SCHEMA).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    return numbered(rows.where(F.col("id").isNotNull()))


def checked_products(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows fit to serve, the latest of each id; the others with what is wrong)."""
    bad_number = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    wrong = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id")
        .when(F.col("title").isNull(), "no title")
        .when(bad_number("popularity_score") | bad_number("freshness_score"), "score is no number")
    )
    marked = rows.withColumn("reason", wrong)
    w = Window.partitionBy("id").orderBy(F.col("ord").desc())
    good = marked.where("reason IS NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "reason")
    return good, marked.where("reason IS NOT NULL")


def write_products(catalog: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in catalogue order; ``single`` for one file, for catalogues small enough."""
    ordered = catalog.orderBy("ord")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes doubled, white space kept, so that ``read_csv`` gives the same texts back; null and empty texts are both empty fields."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def file_system(path: str):
    """(file system, path within it) of a local path or of the address of any file system that Arrow knows."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    """The files of a pattern or a folder, or the file itself, in order of their names; hidden ones left out."""
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else inner.rsplit("/", 1)
    found = [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [head + f.path for f in sorted(found, key=lambda f: f.path) if fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]


def _csv_rows(path: str) -> Iterator[dict]:
    system, inner = file_system(path)
    with system.open_input_stream(inner) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as text:
        yield from csv.DictReader(text)


class LenientCsv(DataSource):
    """CSV whose quoted fields may hold unescaped quotes, all columns texts, read as Python's csv module reads it.

    ``spark.dataSource.register(LenientCsv)``, then
    ``spark.read.format("lenient_csv").schema(...).load(path)`` of a file, a folder or a
    pattern on any file system that Arrow knows; one partition per file, as only a read
    from the start tells quoted line breaks from others.  ``ord`` is the place of a row
    in its file plus 2^40 times that of the file."""

    @classmethod
    def name(cls) -> str:
        return "lenient_csv"

    def schema(self):
        first = next(iter(list_files(self.options["path"])), None)
        if first is None:
            raise FileNotFoundError(self.options["path"])
        system, inner = file_system(first)
        with system.open_input_stream(inner) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as text:
            return T.StructType([T.StructField(c, T.StringType()) for c in next(csv.reader(text), [])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LenientReader(self.options["path"], schema.fieldNames())


class _LenientReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        return [InputPartition((n, p)) for n, p in enumerate(list_files(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, path = partition.value
        for at, row in enumerate(_csv_rows(path)):
            row["ord"] = (number << 40) + at
            yield tuple(row.get(c) for c in self.columns)


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, session_id, events)`` of JSON lines; ``line_no`` counts from 1.

    Blank lines are skipped; a malformed one raises ``ValueError`` with its number."""
    lines = numbered(spark.read.text(path), "at").where(F.trim("value") != "")
    schema = f"{SESSION_SCHEMA}, broken string"
    parsed = lines.select((F.col("at") + 1).alias("line_no"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("x"))
    # Reading a log and checking it are one pass each; only the first bad line comes to the driver.
    bad = parsed.where("x.broken IS NOT NULL OR x.events IS NULL OR exists(x.events, e -> e.product_id IS NULL OR e.event_type IS NULL)").agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise ValueError(f"{path}, line {bad}: no session line")
    return parsed.select("line_no", "x.session_id", "x.events")


def read_taste_log(spark: SparkSession, path: str, newest: int = 500) -> DataFrame:
    """``(ts, type, productId, sessionId)`` of a device's log; lines that don't parse are left out, the newest stay."""
    rows = spark.read.schema("v int, ts long, type string, productId string, sessionId string, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    fine = rows.where("broken IS NULL AND v = 1 AND productId IS NOT NULL AND type IN ('click', 'view', 'favorite', 'cart')")
    return fine.orderBy(F.col("ts").desc()).limit(newest).select("ts", "type", "productId", "sessionId")


def append_taste(df: DataFrame, path: str) -> None:
    df.select(F.lit(1).alias("v"), "ts", "type", "productId", "sessionId").write.mode("append").json(path)


#: Rows of a vector file that one task reads at once.
BLOCK_ROWS = 65_536


def read_vectors(spark: SparkSession, matrix: str, state: str, dim: int) -> DataFrame:
    """``(ord, id, embedding)`` of a row-major float32 file and the list of ids beside it.

    Raises ``ValueError`` where the sizes disagree.  The file is cut at row borders, a
    task reads its own rows; the ids are read by Spark, too, and met by their places."""
    ids = spark.read.schema("ids array<string>").json(state, multiLine=True).select(F.posexplode("ids").alias("at", "id")).select(F.col("at").cast("long").alias("ord"), "id")
    n = ids.count()
    system, inner = file_system(matrix)
    size = system.get_file_info(inner).size
    if size != 4 * dim * n:
        raise ValueError(f"{matrix} holds {size} bytes, not {n} rows of {dim} numbers")

    def rows(batches):
        import numpy as np
        import pandas as pd

        system, inner = file_system(matrix)
        with system.open_input_file(inner) as f:
            for pdf in batches:
                for start in pdf["id"] * BLOCK_ROWS:
                    count = min(BLOCK_ROWS, n - start)
                    data = np.frombuffer(f.read_at(4 * dim * count, 4 * dim * int(start)), "<f4").reshape(-1, dim)
                    yield pd.DataFrame({"ord": np.arange(start, start + count), "embedding": list(data)})

    blocks = -(-n // BLOCK_ROWS)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(rows, "ord long, embedding array<float>").join(ids, "ord").select("ord", "id", "embedding")


def write_vectors(vectors: DataFrame, matrix: str, state: str) -> int:
    """The bytes and ids of ``vectors(ord, id, embedding)``; returns the number of rows.

    The format is one file, so one stream writes it, row by row; the ids are written as they come."""
    import array

    rows, (a, matrix), (b, state) = 0, file_system(matrix), file_system(state)
    with a.open_output_stream(matrix) as f, b.open_output_stream(state) as g:
        g.write(b'{"ids": [')
        for r in vectors.orderBy("ord").select("id", "embedding").toLocalIterator():
            f.write(array.array("f", r["embedding"]).tobytes())
            g.write((", " if rows else "").encode() + json.dumps(r["id"]).encode())
            rows += 1
        g.write(b"]}")
    return rows


def write_cooccurrence(neighbors: DataFrame, path: str) -> None:
    """``(id, neighbor_id, score, rank)`` as JSON lines, a product's list each, for ``read_cooccurrence(lines=True)``."""
    entry = F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "score"))), lambda x: F.struct(x["neighbor_id"].alias("id"), x["score"].alias("score")))
    lists = neighbors.groupBy("id").agg(entry.alias("list"))
    lists.select(F.lit(1).alias("schema_version"), F.create_map("id", "list").alias("neighbors")).write.mode("overwrite").json(path)


def read_engagement(spark: SparkSession, path: str) -> DataFrame:
    """``(product_id, event_count, weighted_score)`` of a collector's export, of several the last row of a product; another shape fails the read."""
    schema = "stats array<struct<product_id:string,event_count:bigint,weighted_score:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.posexplode("stats").alias("at", "s")).select("at", "s.*")
    w = Window.partitionBy("product_id").orderBy(F.col("at").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("product_id", "event_count", "weighted_score")


def read_cooccurrence(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(id, neighbor_id, score, rank)`` of an exported matrix, one document or JSON ``lines``; a score that is no finite number fails the read."""
    schema = "schema_version int, neighbors map<string,array<struct<id:string,score:double>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path).select(F.explode("neighbors").alias("id", "list"))
    flat = rows.select("id", F.posexplode("list").alias("at", "n")).select("id", F.col("n.id").alias("neighbor_id"), F.col("n.score").alias("score"), (F.col("at") + 1).alias("rank"))
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return flat.where(F.coalesce(F.assert_true(fine, F.lit("co-occurrence score is no finite number")).isNull(), F.lit(True)))


def read_relevance_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments ``(q, segment)``, ranked ``(q, doc, pos)``, relevant ``(q, doc)``) of a nested export."""
    schema = "catalog_id string, label_method string, k int, queries array<struct<query:string,relevant_ids:array<string>,ranked_ids:array<string>,segment:string>>"
    q = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("x")).select("x.*")
    ranked = q.select(F.col("query").alias("q"), F.posexplode("ranked_ids").alias("at", "doc")).select("q", "doc", (F.col("at") + 1).alias("pos"))
    return q.select(F.col("query").alias("q"), "segment"), ranked, q.select(F.col("query").alias("q"), F.explode("relevant_ids").alias("doc"))


def as_table(df: DataFrame, rows: int = 20) -> str:
    """A printable table of the first rows."""
    head = [df.columns, *[[str(v) for v in r] for r in df.limit(rows).collect()]]
    widths = [max(len(str(r[i])) for r in head) for i in range(len(df.columns))]
    out = io.StringIO()
    for r in head:
        out.write("  ".join(str(v).ljust(w) for v, w in zip(r, widths)).rstrip() + "\n")
    return out.getvalue()


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
