"""File sources with fixed schemas; what does not parse is returned beside the good rows, not dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = "period STRING, entity STRING, score DECIMAL(6,2), source STRING"
METRIC_SCORE = "period STRING, metric STRING, entity STRING, score DECIMAL(6,2), source STRING"
TIER = "period STRING, entity STRING, tier STRING, tier_avg DECIMAL(6,2), source STRING"
PERIOD_META = "period STRING, sample_n BIGINT, entity_n INT, l1_n INT, l2_n INT, basis_version STRING"
CHUNK = "chunk_id STRING, period STRING, page_no INT, n_chars INT, page_kind STRING, text STRING"
QUESTION = (
    "question_id INT, batch INT, category STRING, question STRING, expected_route STRING, expected_answer STRING, "
    "citation STRING, refusal_reason STRING, tests STRING"
)
RUN = (
    "question_id BIGINT, route STRING, answer STRING, model_answer STRING, sources ARRAY<STRING>, warnings ARRAY<STRING>, trace ARRAY<STRING>"
)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; a byte-order mark is skipped, a malformed row fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def _parsed(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON texts ``value`` to (rows, texts that are no such object)."""
    row = F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    read = lines.filter(F.trim("value") != "").withColumn("row", row)
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return read.filter(~bad).select("row.*").drop("_bad"), read.filter(bad).select(F.col("value").alias("line"))


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines: (rows, rejected lines)."""
    return _parsed(spark.read.text(path), CHUNK)


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Run files, each one JSON array: (rows, rejected items). One task reads a file, its items are then dealt out."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode_outer(F.from_json("value", "ARRAY<STRING>")).alias("item"), "value")
    lines = items.select(F.coalesce("item", "value").alias("value"))
    return _parsed(lines.repartition(spark.sparkContext.defaultParallelism), RUN)


def read_variants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated variants with ``#`` comments: (good rows, rejected lines)."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cells = F.split("value", "\t")
    good = (F.size(cells) >= 6) & cells[0].rlike(r"^\s*\d+\s*$")
    rows = lines.filter(good).select(
        F.trim(cells[0]).cast("int").alias("question_id"), cells[1].alias("variant"), cells[2].alias("breaks"), cells[3].alias("phrasing"),
        cells[4].alias("terms"), F.filter(F.split(cells[5], r"\|"), lambda x: x != "").alias("expected"))
    return rows, lines.filter(~good).select(F.col("value").alias("line"))


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Question set without blank rows: (questions, rows with an unreadable id or number)."""
    read = spark.read.schema(f"{QUESTION}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").csv(path, header=True)
    said = read.filter((F.trim("question") != "") | F.col("_bad").isNotNull())
    bad = F.col("question_id").isNull() | F.col("_bad").isNotNull()
    return said.filter(~bad).drop("_bad"), said.filter(bad).select(F.coalesce("_bad", "question").alias("line"))


def read_pages(spark: SparkSession, root: str, glob: str = "*", period: str = r"(\d{4}Q\d)") -> DataFrame:
    """Text files chosen by name; the period comes from the file name and files without one are left out."""
    files = spark.read.option("pathGlobFilter", glob).option("wholetext", True).text(root).withColumn("path", F.input_file_name())
    name = F.substring_index("path", "/", -1)
    return files.withColumn("period", F.regexp_extract(name, period, 1)).filter("period <> ''").select(
        "period", F.posexplode(F.split("value", "\f")).alias("p", "raw")).select("period", (F.col("p") + 1).alias("page_no"), "raw")
