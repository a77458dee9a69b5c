"""Reading and writing of campaign tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from liftworks.sources.scratch import staged, temporaries


#: Bytes of the largest result that `save_csv` writes as one file.
CSV_BYTES = 50 * 1024 * 1024


def read_partitions(spark: SparkSession, root: str, column: str, values: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """A partitioned Parquet table from its root, the partition column kept: only the wanted partitions are listed in the scan, and only the
    wanted columns are read."""
    df = spark.read.option("basePath", root).parquet(root)
    df = df.where(F.col(column).isin(*values)) if values is not None else df
    return df.select(*dict.fromkeys([*columns, column])) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: object, upper: object, partitions: int, **options: str) -> DataFrame:
    """A database table, or a query as "(SELECT ...) t", read by as many tasks over ranges of a column: no row passes through the driver. Rows beyond the bounds are read too."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options).load()


def read_jdbc_whole(spark: SparkSession, url: str, table: str, column: str, partitions: int, **options: str) -> DataFrame:
    """A database table read by ranges of a column whose ends the database is asked for; an empty table by one task."""
    ends = spark.read.format("jdbc").options(url=url, query=f'SELECT min("{column}") AS lo, max("{column}") AS hi FROM {table}', **options).load().first()
    if ends[0] is None:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return read_jdbc(spark, url, table, column, *ends, partitions, **options)


def warehouse(spark: SparkSession, name: str, url: str, driver: str, **options: str) -> str:
    """Make a database known as the catalog `name` (the name is given back): `spark.table("name.SCHEMA.TABLE")` then has its filters, projections,
    aggregates and limits worked out by the database, and only results travel."""
    kind = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
    for key, value in {"": kind, ".url": url, ".driver": driver, ".pushDownAggregate": "true", ".pushDownLimit": "true", **{f".{k}": v for k, v in options.items()}}.items():
        spark.conf.set(f"spark.sql.catalog.{name}{key}", value)
    return name


def read_or_empty(spark: SparkSession, path: str, schema: str, typed: bool = False) -> DataFrame:
    """A table, or a typed empty one where the path does not exist; other errors are raised. typed: the schema is the files' too."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read.schema(schema) if typed else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_that_exists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several paths that there is."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(", ".join(paths))


def latest(df: DataFrame, column: str) -> DataFrame:
    """The rows of the largest value of a column; of a partition column only that partition is read. No values, no rows.

    The value is asked for first (one row reaches the driver), so that Spark knows it when it lists the files."""
    top = df.agg(F.max(column)).first()[0]
    return df.where(F.lit(False) if top is None else F.col(column) == F.lit(top))


def save_checked(df: DataFrame, path: str) -> int:
    """Overwrite a Parquet table; raise if the rows that it holds are not as many as were written (counted while writing, not anew)."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    written, meant = df.sparkSession.read.parquet(path).count(), seen.get["n"]
    if written != meant:
        raise ValueError(f"{path}: {written} rows instead of {meant}")
    return written


def save_csv(df: DataFrame, path: str, most: int = CSV_BYTES) -> None:
    """A small result as one CSV file with a header; one of over `most` bytes (as Parquet) is an error, and nothing is written."""
    with temporaries():
        rows = staged(df)
        size = sum(folder_sizes(rows))
        if size > most:
            raise ValueError(f"{path}: {size} bytes, more than {most}; write it as Parquet")
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def folder_sizes(df: DataFrame) -> list[int]:
    """Bytes of each file that a frame reads."""
    rows = df.select("_metadata.file_path", "_metadata.file_size").distinct().collect()
    return [r["file_size"] for r in rows]
