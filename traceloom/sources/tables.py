"""Event logs derived from plain tables (sessions of `events`, order lines, turns).

Every log has one row per event with the columns of EVENT_COLUMNS and one row
per case with the columns of CASE_COLUMNS, all UTC timestamps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.calendar import hours_between
from ..functions.ordered import scan
from ..session import Scale, rows_per_task

EVENT_COLUMNS = (
    "event_id",
    "case_id",
    "external_event_id",
    "event_type",
    "event_at",
    "ingested_at",
    "actor_type",
    "actor_id",
    "source_system",
    "channel",
    "manual",
    "reason_code",
    "metadata",
    "team_id",
    "schema_version",
)
CASE_COLUMNS = (
    "case_id",
    "external_source_id",
    "referral_source",
    "service_line",
    "status",
    "received_at",
    "closed_at",
    "schema_version",
    "created_at",
    "updated_at",
)


@dataclass(frozen=True)
class EventLog:
    events: DataFrame
    cases: DataFrame
    scale: Scale
    stored: bool = False  # both tables are read from storage, not derived on the fly


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; zone-less timestamps are taken as UTC (session zone UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


_SCALES: dict[tuple, Scale] = {}
# the column whose values become cases, sessions, variants and chains of each table
_CASE_KEY = {"events": "user_id", "conversations": "conv_id", "lineitem": "l_orderkey"}
_DERIVED = ("case_id", "variant_id", "chain_id")


def table_scale(spark: SparkSession, folder: str, name: str) -> Scale:
    """Size of a table, measured once per application: rows from the footers and,
    for a large table, the most rows of one case key, in one pass over that column."""
    limit = rows_per_task(spark)
    key = (spark.sparkContext.applicationId, folder, name, limit)
    if key not in _SCALES:
        column = _CASE_KEY.get(name)
        scale = Scale.of(spark.read.parquet(f"{folder}/{name}.parquet"), *([column] if column else []))
        # cases, sessions and the variants of their sequences are parts of one value of the column
        derived = tuple((c, n) for _, n in scale.bounds for c in _DERIVED)
        _SCALES[key] = Scale(scale.rows, limit, scale.bounds + derived)
    return _SCALES[key]


def pick(index: Column, values: tuple[str, ...]) -> Column:
    """values[index mod len]"""
    array = F.array(*[F.lit(v) for v in values])
    return F.element_at(array, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


# How raw event types and the number in `props` become the 18-type vocabulary:
# (raw type, first k, type) up to the next entry.
SESSION_TYPES = (
    ("view", 0, "referral_received"),
    ("view", 40, "completeness_check_completed"),
    ("view", 70, "appointment_scheduling_started"),
    ("click", 0, "missing_information_requested"),
    ("click", 30, "referral_categorised"),
    ("click", 55, "referral_recategorised"),
    ("click", 75, "clinical_team_assigned"),
    ("signup", 0, "missing_information_received"),
    ("signup", 30, "clinical_team_reassigned"),
    ("signup", 50, "referral_submitted"),
    ("signup", 75, "appointment_booked"),
    ("error", 0, "appointment_scheduling_failed"),
    ("error", 40, "patient_no_response"),
    ("error", 70, "patient_notified"),
    ("purchase", 0, "referral_completed"),
    ("purchase", 50, "referral_cancelled"),
    ("purchase", 70, "referral_rejected"),
    ("purchase", 85, "referral_closed_other"),
)


def session_type(raw: Column, k: Column) -> Column:
    out = None
    for kind, low, name in reversed(SESSION_TYPES):
        hit = (raw == kind) & (k >= low)
        # later thresholds of the same raw type are tested first
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def sessionise(
    events: DataFrame, user: str, ts: str, ident: str, gap_hours: float, scale: Scale
) -> DataFrame:
    """Number the sessions of each user: a gap longer than gap_hours starts a new one."""
    keyed = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    seen = scan(keyed, [user], [ts, ident], scale, previous={"_before": F.col(ts)})
    starts = F.when(
        F.col("_before").isNull() | (hours_between(F.col("_before"), F.col(ts)) > gap_hours), 1
    ).otherwise(0)
    return (
        scan(
            seen.withColumn("_new", starts),
            [user],
            [ts, ident],
            scale,
            running={"session_no": F.col("_new")},
        )
        .withColumn("session_no", F.col("session_no").cast("long"))
        .drop("_before", "_new")
    )


def session_events(spark: SparkSession, folder: str, gap_hours: float = 12.0) -> DataFrame:
    """`events` cut into sessions and read as administrative events."""
    scale = table_scale(spark, folder, "events")
    raw = sessionise(table(spark, folder, "events"), "user_id", "ts", "event_id", gap_hours, scale)
    k = F.col("k")
    raw = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = session_type(F.col("event_type"), k)
    actor = F.when(F.col("raw_type") == "view", F.lit("system")).otherwise(
        pick(k, ("admin_staff", "clinical_team", "scheduling_staff", "referrer"))
    )
    team = F.concat(F.lit("TEAM-"), F.pmod(k, F.lit(4)).cast("string"))
    return (
        raw.withColumn("raw_type", F.col("event_type"))
        .withColumn("event_type", kind)
        .withColumn("actor_type", actor)
        .select(
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("session_no").cast("string")).alias("case_id"),
            F.concat_ws("-", F.lit("EXT"), F.col("user_id").cast("string"), k.cast("string")).alias("external_event_id"),
            "event_type",
            F.col("ts").alias("event_at"),
            F.timestamp_micros(
                F.unix_micros("ts") + F.floor(F.col("value") * 60).cast("long") * 60_000_000
            ).alias("ingested_at"),
            "actor_type",
            F.when(
                F.col("actor_type").isin(*vocab.INTERNAL_ACTORS),
                F.concat_ws(
                    "-", F.lit("STAFF"), F.pmod(F.col("user_id") + F.pmod(k, F.lit(3)), F.lit(5)).cast("string")
                ),
            ).alias("actor_id"),
            pick(k, vocab.SOURCE_SYSTEMS[:5]).alias("source_system"),
            pick(k, vocab.CHANNELS).alias("channel"),
            (F.pmod(k, F.lit(2)) == 0).alias("manual"),
            F.when(F.pmod(k, F.lit(3)) != 0, pick(k, vocab.REASON_CODES)).alias("reason_code"),
            F.col("props").alias("metadata"),
            F.when(
                F.col("event_type").isin("clinical_team_assigned", "clinical_team_reassigned"), team
            ).alias("team_id"),
            F.when(k == 99, 2).otherwise(1).alias("schema_version"),
            "user_id",
            "session_no",
            "value",
        )
    )


def session_cases(events: DataFrame) -> DataFrame:
    """One row per session; users ending in 39 of 40 have no case row (orphan events)."""
    at = F.struct("event_at", "event_id")
    terminal = F.col("event_type").isin(*vocab.TERMINAL_EVENTS)
    got = (
        events.where(F.pmod(F.col("user_id"), F.lit(40)) != 39)
        .groupBy("case_id", "user_id", "session_no")
        .agg(
            F.min("event_at").alias("received_at"),
            F.max("event_at").alias("updated_at"),
            F.min(F.when(terminal, F.struct("event_at", "event_id", "event_type"))).alias("_end"),
        )
    )
    ended = F.col("_end").isNotNull()
    user = F.col("user_id")
    return got.select(
        "case_id",
        F.concat(F.lit("CASE-"), F.upper(F.translate(F.col("case_id"), "-", "S"))).alias("external_source_id"),
        pick(user, vocab.REFERRAL_SOURCES).alias("referral_source"),
        pick(user, vocab.SERVICE_LINES).alias("service_line"),
        F.when(ended, F.substring_index(F.col("_end.event_type"), "referral_", -1))
        .otherwise(pick(user, vocab.OPEN_STATUSES))
        .alias("status"),
        "received_at",
        F.when(F.pmod(user, F.lit(11)) != 0, F.col("_end.event_at")).alias("closed_at"),
        F.when(F.pmod(user, F.lit(50)) == 49, 2).otherwise(1).alias("schema_version"),
        F.col("received_at").alias("created_at"),
        F.when(F.pmod(user, F.lit(13)) == 0, F.timestamp_micros(F.unix_micros("received_at") - 3_600_000_000))
        .otherwise(F.col("updated_at"))
        .alias("updated_at"),
    )


def session_log(spark: SparkSession, folder: str, gap_hours: float = 12.0) -> EventLog:
    events = session_events(spark, folder, gap_hours)
    return EventLog(events, session_cases(events), table_scale(spark, folder, "events"))


def order_log(spark: SparkSession, folder: str) -> EventLog:
    """Orders as cases; one `shipped` event per line, one `placed` event per order."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    cases = (
        orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_orderpriority").alias("priority"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("received_at"),
        )
    )
    shipped = lines.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").cast("long").alias("event_id"),
        F.lit("shipped").alias("event_type"),
        F.col("l_shipdate").alias("event_at"),
        F.col("l_suppkey").alias("actor_id"),
    )
    placed = orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.lit(0).cast("long").alias("event_id"),
        F.lit("placed").alias("event_type"),
        F.col("o_orderdate").alias("event_at"),
        F.lit(None).cast("long").alias("actor_id"),
    )
    size = table_scale(spark, folder, "lineitem")
    rows = size.rows + table_scale(spark, folder, "orders").rows
    # an order has one more event than lines
    bounds = tuple((c, n + 1) for c, n in size.bounds)
    return EventLog(placed.unionByName(shipped), cases, Scale(rows, size.limit, bounds))


def turn_log(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as an ordered log without timestamps."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), F.col("role").alias("activity")
    )
