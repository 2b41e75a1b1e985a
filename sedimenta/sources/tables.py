"""Parquet table access.

A table is ``<dir>/<name>.parquet``, either one file or a directory of part files.
Columns are picked at read time so that only they are scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Rows of a stored table; ``columns`` limits the scan to those columns.

    A column of an absent name is an error; an empty table gives no rows.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores if the scan has fewer partitions than there are cores.

    A small table in one file with one row group is one task otherwise. A table of many files, as on a
    cluster, is left as it is: nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
