"""Writers: result tables, rows as JSON lines, side files, and idempotent runs."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


# JSON times keep microseconds (the default writes milliseconds)
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LEDGER = "run_id string, fingerprint string, status string, rows long"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Publish a small file unless it is there already; whether this call did.  Of several writers one wins.

    The content is written aside and then renamed without overwriting, which a distributed file
    system does in one step: whoever sees the file sees all of it, and a writer that dies leaves none.
    """
    system, target = _place(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    system.mkdirs(target.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = system.create(aside, False)
    out.write(content.encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(aside, target, keep)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(aside, False)


def claimed(spark: SparkSession, path: str) -> str | None:
    """What `claim` published, or None."""
    system, target = _place(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claims(spark: SparkSession, folder: str) -> dict[str, str]:
    """All that was published in a folder: name -> content."""
    system, target = _place(spark, folder)
    if not system.exists(target):
        return {}
    names = [status.getPath().getName() for status in system.listStatus(target)]
    return {name: claimed(spark, f"{folder}/{name}") for name in sorted(names) if not name.startswith(("_", "."))}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    system, target = _place(spark, path)
    system.delete(target, True)


def write_tables(tables: dict[str, DataFrame], folder: str, *, overwrite: bool = False) -> dict[str, str]:
    """Write each table as Parquet below folder.

    Every target is checked before the first write, so a refusal leaves nothing
    half done; the output committer makes each write atomic.
    """
    targets = {name: f"{folder}/{name}" for name in tables}
    spark = next(iter(tables.values())).sparkSession
    if not overwrite:
        taken = [t for t in targets.values() if path_exists(spark, t)]
        if taken:
            raise FileExistsError(f"refusing to overwrite: {', '.join(taken)}")
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(targets[name])
    return targets


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Results of an earlier stage as inputs of a later one."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_rows(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """One JSON object per line, in as many files as the data has partitions."""
    df.write.mode("overwrite" if overwrite else "errorifexists").options(
        ignoreNullFields=False, timestampFormat=JSON_TIME
    ).json(path)
    return path


def write_run(
    spark: SparkSession, folder: str, run_id: str, tables: dict[str, DataFrame], fingerprint: str
) -> str:
    """Load a run once: 'written', or 'unchanged' where the same run is there already.

    Another fingerprint under the same id is refused.  Tables are written to places of this attempt's
    own and then published together by one mark, so a writer that dies leaves nothing to be read,
    and of two writers of one id one is published and the other goes.
    """
    mark = f"{folder}/_runs/{run_id}"

    def known() -> str | None:
        found = claimed(spark, mark)
        if found is None:
            return None
        if json.loads(found)["fingerprint"] != fingerprint:
            raise ValueError(f"run {run_id} exists with another fingerprint")
        return "unchanged"

    if known():
        return "unchanged"
    attempt = uuid.uuid4().hex
    targets = {name: f"{folder}/{name}/run_id={run_id}/attempt={attempt}" for name in tables}
    rows = {}
    for name, df in tables.items():
        df.write.parquet(targets[name])
        rows[name] = spark.read.parquet(targets[name]).count()
    content = {"run_id": run_id, "fingerprint": fingerprint, "status": "completed", "attempt": attempt, "tables": rows}
    if claim(spark, mark, json.dumps(content)):
        return "written"
    for target in targets.values():
        remove(spark, target)
    return known()


def read_runs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table of all published runs, with their run_id."""
    runs = [json.loads(x) for x in claims(spark, f"{folder}/_runs").values()]
    paths = [f"{folder}/{name}/run_id={r['run_id']}/attempt={r['attempt']}" for r in runs if name in r["tables"]]
    if not paths:
        raise FileNotFoundError(f"no run has a table {name}")
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*paths).drop("attempt")


def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, fingerprint, status, rows) of all published runs."""
    runs = [json.loads(x) for x in claims(spark, f"{folder}/_runs").values()]
    rows = [(r["run_id"], r["fingerprint"], r["status"], sum(r["tables"].values())) for r in runs]
    return spark.createDataFrame(rows, LEDGER)


__all__ = [
    "claim", "claimed", "claims", "path_exists", "read_runs", "read_tables", "remove", "run_ledger", "write_rows", "write_run", "write_tables"
]
