"""Files in and out: JSON lines, CSV, TSV, chunks of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import padded_id
from millrace.operators.ordinals import in_chunks, last_wins, with_ordinal
from millrace.operators.requests import RESULT


def read_results(spark: SparkSession, path: str, schema: str = RESULT, keyed: bool = True) -> DataFrame:
    """Results of a batch as JSON lines (file, folder or pattern); both envelope forms; with keyed, the last line of an id wins.

    Blank lines are skipped. Lines are ordered by file name, and within a file by their position.
    """
    raw = spark.read.schema(f"{schema}, response_body struct<choices: array<struct<message: struct<content: string>>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>").json(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_name")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_line", F.monotonically_increasing_id())
    raw = raw.withColumn("response", F.struct(F.coalesce(F.col("response_body"), F.col("response.body")).alias("body"))).drop("response_body")
    return (last_wins(raw, "custom_id", "_file", "_block", "_line") if keyed else raw).drop("_file", "_block", "_line")


def stream_results(spark: SparkSession, folder: str, schema: str = RESULT) -> DataFrame:
    """The same as a stream over a folder into which partial results arrive."""
    return spark.readStream.schema(schema).json(folder)


def read_names(spark: SparkSession, path: str, columns: tuple[str, ...] = ("company_name", "company", "Name", "Company")) -> DataFrame:
    """A CSV file with a header; the first of the columns that is there and set is the name; rows without one are left out."""
    df = spark.read.option("header", True).csv(path)
    found = [F.nullif(F.trim(c), F.lit("")) for c in columns if c in df.columns]
    if not found:
        raise ValueError(f"{path} has none of the columns {', '.join(columns)}")
    return df.withColumn("name", F.coalesce(*found)).where("name is not null")


def numbered(names: DataFrame, limit: int | None = None, prefix: str = "csv-", name: str = "name") -> DataFrame:
    """(id, name): distinct names in their order with ids made of it; with a limit, the head of the load."""
    x = with_ordinal(names.select(name).distinct(), name)
    x = x.where(F.col("ord") < limit) if limit is not None else x
    return x.select(padded_id(prefix, "ord").alias("id"), name)


def read_tsv(spark: SparkSession, path: str, required: str) -> DataFrame:
    """A TSV file with a header, all strings; malformed lines and rows without the required column are left out."""
    return spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path).where(F.col(required).isNotNull())


def read_wide_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of ``fields`` and ``data`` rows as a table of strings. One document is one row, so it must fit in a task."""
    doc = spark.read.option("multiLine", True).schema("fields array<string>, data array<array<string>>").json(path)
    fields = doc.first()["fields"]
    row = doc.select(F.posexplode("data").alias("pos", "row"))
    return row.select("pos", *[F.get("row", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def write_requests(lines: DataFrame, path: str, per_chunk: int, *keys: str, column: str = "line") -> None:
    """JSON lines in folders chunk=0, 1, ... of so many consecutive requests in key order."""
    in_chunks(lines, per_chunk, *keys).select("chunk", column).repartition("chunk").write.partitionBy("chunk").text(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines without null fields; the number of rows written, counted while they are."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", True).json(path)
    return rows.get["n"]


def read_named_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of files or folders named results_<model>_n<N>, with model and n from the names."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    part = lambda i: F.regexp_extract(name, r"results_([^/]+)_n(\d+)", i)
    return df.select("*", part(1).alias("model"), part(2).cast("int").alias("n")).where("model <> ''")


def read_topics(spark: SparkSession, path: str, column: str = "topic") -> DataFrame:
    """(topic): topics of a CSV file with a header, or of JSON lines; an error if there is none."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.schema(f"{column} string").json(path)
    found = df.select(F.nullif(F.trim(column), F.lit("")).alias("topic")).where("topic is not null") if column in df.columns else df.limit(0)
    if found.isEmpty():
        raise ValueError(f"no {column} in {path}")
    return found
