"""Runs that go on from a checkpoint only with what they were begun with.

A detector run writes its versions into the state of every case it sees.  Before a run goes on, the
state is read back through the state data source, and another detector, policy or source is refused.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import path_exists
from ..spec import DetectorSpec
from .detector import VERSION


@dataclass(frozen=True)
class Versions:
    """What a run is bound to."""

    detector: str
    policy: str
    source: str

    @staticmethod
    def of(spec: DetectorSpec, snapshots: DataFrame, name: str, detector: str = VERSION) -> "Versions":
        """The detector's version, its settings, and the source's name and schema."""
        digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()
        return Versions(detector, digest(asdict(spec)), digest([name, snapshots.schema.jsonValue()]))


class VersionMismatch(ValueError):
    """A checkpoint that was written with other versions."""


def bound_to(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """(detector, policy, source, cases) of a checkpoint's state; None where nothing has been run."""
    if not path_exists(spark, f"{checkpoint}/state"):
        return None
    state = spark.read.format("statestore").option("stateVarName", "bound").load(checkpoint)
    return state.groupBy("value.detector", "value.policy", "value.source").agg(F.count(F.lit(1)).alias("cases"))


def check(spark: SparkSession, checkpoint: str, versions: Versions) -> None:
    """Raise VersionMismatch unless the checkpoint is new or was written with the same versions."""
    found = bound_to(spark, checkpoint)
    if found is None:
        return
    same = [F.col(k) == v for k, v in asdict(versions).items()]
    other = found.where(~(same[0] & same[1] & same[2])).first()  # one row per set of versions
    if other:
        unlike = [k for k, v in asdict(versions).items() if other[k] != v]
        raise VersionMismatch(f"the checkpoint was written with another {', '.join(unlike)}")


def checkpoint_record(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Per case what a run would go on from: state fingerprint, active flag, running timer, versions, last micro-batch."""
    last = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId").alias("last_batch"))
    state = spark.read.format("statestore")
    case = state.option("stateVarName", "case").load(checkpoint).select("key.case_id", "value")
    bound = spark.read.format("statestore").option("stateVarName", "bound").load(checkpoint).select("key.case_id", F.col("value").alias("bound"))
    rows = case.join(bound, "case_id").crossJoin(F.broadcast(last))  # one row
    return rows.select(
        "case_id",
        F.sha2(F.to_json("value"), 256).alias("fingerprint"),
        F.col("value.active").alias("active"),
        F.col("value.pending").alias("pending"),
        "bound.detector",
        "bound.policy",
        "bound.source",
        "last_batch",
    )
