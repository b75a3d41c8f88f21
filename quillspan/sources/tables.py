"""Reading of the input tables, price files, JSON settings, answers and report files."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name where driver and executors both can write: below ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a written table in the shared folder: several uses read it again instead of working it out anew."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, or an error that names the columns it lacks."""
    if missing := sorted(set(columns) - set(rows.columns)):
        raise KeyError(f"columns are missing: {missing}")
    return rows


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price files as (date, close, ord): both are read as text and cast without errors, junk becomes null. ord follows the order of files and of lines in them."""
    rows = spark.read.csv(path, header=True, schema="date string, close string").select("*", "_metadata.file_name", "_metadata.file_block_start").withColumn("n", F.monotonically_increasing_id())
    return rows.select(F.expr("try_to_date(date)").alias("date"), F.expr("try_cast(close AS double)").alias("close"), F.struct("file_name", "file_block_start", "n").alias("ord"))


def write_prices(prices: DataFrame, path: str, least: int = 100) -> None:
    """Writes (date, close) as CSV files in the order of dates, but never fewer than ``least`` rows over what is there: that is an error."""
    if (n := prices.count()) < least:
        raise ValueError(f"{n} rows are fewer than {least}: not written")
    prices.repartitionByRange("date").sortWithinPartitions("date", *[c for c in prices.columns if c not in ("date", "close")]).select("date", "close").write.mode("overwrite").csv(path, header=True)


def settings(text: Column, schema: str) -> Column:
    """A JSON object of settings as a struct; what cannot be read, or is no object, is null: absent, never a default."""
    read = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(read["_bad"].isNull() & F.startswith(F.trim(text), F.lit("{")), read)


def mismatches(stamp: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, stamped, now) of fields (key, field, value) that a stamp has and that differ now; nulls are values. No stamp, no mismatch."""
    s, c = stamp.select(*key, "field", F.col("value").alias("stamped")), current.select(*key, "field", F.col("value").alias("now"))
    return s.join(c, [*key, "field"], "left").where(~F.col("stamped").eqNullSafe(F.col("now")))


def answer_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder as (path, text), whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def report_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells (path, row_no, label, cell) of all reports' CSV files below a folder; files that cannot be read are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", "true").csv(path, schema="row_no int, label string, cell string")
    return rows.select(F.col("_metadata.file_name").alias("path"), "*")
