"""Sinks. Files stay partitioned as Spark wrote them; one file is made only where a caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.report import as_json, source_appendix


def write_table(df: DataFrame, path: str, columns: list[str], single_file: bool = False) -> None:
    """CSV with a header and a fixed column order."""
    out = df.select(*columns)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines."""
    chunks.write.mode("overwrite").json(path)


def load_table(df: DataFrame, path: str, partition_by: str = "period", tasks: int = 16) -> None:
    """Full rebuild of a table as Parquet, one folder per period; up to ``tasks`` tasks write the files of one period."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(tasks))
    df.repartition(F.col(partition_by), spread).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_run(results: DataFrame, path: str, tag: str) -> None:
    """Replace one tagged run and leave the others as they are."""
    results.withColumn("run_tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_tag").parquet(path)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").csv(path, header=True)


def write_reports(records: DataFrame, path: str) -> None:
    """One JSON record per report and the source appendix beside it."""
    as_json(records).select("record").write.mode("overwrite").text(f"{path}/reports")
    source_appendix(records).write.mode("overwrite").json(f"{path}/appendix")
