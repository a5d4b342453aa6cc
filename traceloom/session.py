"""Session helpers: builder for local work, reliable lineage cuts, size bounds."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_CONF = "spark.traceloom.rowsPerTask"
ROWS_DEFAULT = 2_000_000
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine.  On a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("traceloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # call-site capture on every column expression makes wide plans slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; where none is named, one in the warehouse.

    Both are places that every executor reaches; no machine-local folder is ever used.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages")
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it from there.

    Cuts the lineage in a way that survives executor loss, and gives later steps
    column pruning, pushdown and sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    # nobody reads the write's own shuffle files once the table is there
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def pin_by(df: DataFrame, key: str, spread: bool = True) -> DataFrame:
    """Like `pin`, stored in buckets of the key: later windows, groups and joins by it need no shuffle.

    For tables whose keys all fit a task (see Scale).  spread: deal the rows out by key before they
    are written, so a bucket is one file; not needed where they lie together by the key already.
    There are as many buckets as shuffle partitions.  The table is known to the session's catalog
    under a name of its own, its files lie in the shared folder.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"traceloom_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key) if spread else df
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        rows.write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return spark.table(name)


@dataclass(frozen=True)
class Scale:
    """How many rows there are, and how many one value of a key column can have.

    rows     upper bound of all rows, hence of any group
    bounds   (column, most rows of one value) pairs that have been measured
    stored_by  the tables are stored in buckets of this column, so its rows lie together already

    While the bound of a key is within the limit, plain windows and exact
    aggregates are safe for it.  Beyond it the operators use their split forms.
    """

    rows: int
    limit: int = ROWS_DEFAULT
    bounds: tuple[tuple[str, int], ...] = ()
    stored_by: str | None = None

    @property
    def small(self) -> bool:
        return self.rows <= self.limit

    def bound(self, *key: str) -> int:
        """Most rows that share one value of the key."""
        known = dict(self.bounds)
        return min([self.rows, *(known[c] for c in key if c in known)])

    def fits(self, *key: str) -> bool:
        return self.bound(*key) <= self.limit

    @staticmethod
    def of(df: DataFrame, *keys: str) -> "Scale":
        """Count once (footers only for a bare Parquet scan).

        Only when there are more rows than a task should hold is the largest
        value of each key column measured, in one pass over that column.
        """
        limit, rows = rows_per_task(df.sparkSession), df.count()
        bounds = ()
        if rows > limit:
            bounds = tuple((key, largest_group(df, key)) for key in keys)
        return Scale(rows, limit, bounds)


def largest_group(df: DataFrame, key: str) -> int:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_CONF, str(ROWS_DEFAULT)))
