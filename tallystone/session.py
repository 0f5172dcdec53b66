"""The session every entry point uses."""

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallystone", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; conf overrides."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    A small table of one row group would be read, and worked on, by one task.  A table of
    more partitions than cores, as any large one is, stays as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes, as Catalyst estimates a table, of one of its parts: while the parts are few enough to be written as they come, and beyond.
PART_BYTES, LARGE_PART_BYTES = 4 << 20, 32 << 20
#: Parts up to which a shuffle's rows go straight to files; with more they are held and sorted by part first, a task's whole output where it fits.
DIRECT = 200


def parts_of(df: DataFrame, part_bytes: int | None = None) -> int:
    """Into how many parts to deal df so that what one holds doesn't grow with df; at least as many as there are cores.

    part_bytes: of every part, however many there are, where the shuffle's rows are no more than df's.  A table whose size isn't known gets the session's usual number.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >> 60 else max(min(DIRECT, -(-size // (part_bytes or PART_BYTES))), -(-size // (part_bytes or LARGE_PART_BYTES)))
    return max(parts, spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *by: str, part_bytes: int | None = None) -> DataFrame:
    """df dealt by columns to parts_of() it: what is grouped by them afterwards needs no further shuffle."""
    return df.repartition(parts_of(df, part_bytes), *by)


#: Rows and bytes that cross to Python at once; a larger row crosses alone.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what is sent to Python at once, for columns of whole texts.

    The settings are the session's and stay, as plans are run after this returns; a smaller
    value of the caller's is kept.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
