"""Readers of JSON bundles, JSON lines, JDBC runs and earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import scan
from ..session import Scale, pin
from .snapshots import SNAPSHOT_SCHEMA

CASE_DDL = (
    "case_id string, external_source_id string, referral_source string, service_line string, "
    "status string, received_at timestamp, closed_at timestamp, schema_version int, "
    "created_at timestamp, updated_at timestamp"
)
EVENT_DDL = (
    "event_id string, case_id string, external_event_id string, event_type string, "
    "event_at timestamp, ingested_at timestamp, actor_type string, actor_id string, "
    "source_system string, channel string, manual boolean, reason_code string, "
    "metadata string, team_id string, schema_version int"
)
LABEL_DDL = (
    "label_id string, case_id string, valid_from timestamp, valid_until timestamp, "
    "status string, evidence_codes array<string>, schema_version int"
)
def _as_struct(ddl: str) -> str:
    return "struct<" + ",".join(
        p.strip().replace(" ", ":", 1) for p in _split(ddl)
    ) + ">"


def _split(ddl: str) -> list[str]:
    """Split a column list at its top-level commas."""
    out, depth, current = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += char
    return [*out, current]


OBSERVATION = (
    "struct<observation_id:string,affected_role:string,cohort_dimension:string,cohort_value:string,"
    "reported_problem:string,frequency:string,severity:string,supported_archetypes:array<string>,"
    "contradicts:array<string>,workflow_stage:string>"
)
RESEARCH_SESSION = (
    f"session_id string, participant_id string, role string, observations array<{OBSERVATION}>"
)


_BUNDLE = (
    f"cases array<{_as_struct(CASE_DDL)}>, events array<{_as_struct(EVENT_DDL)}>, "
    f"labels array<{_as_struct(LABEL_DDL)}>, "
    "manifest struct<run_id:string,case_count:bigint,event_count:bigint,fingerprint:string>"
)


def _entities(raw: DataFrame) -> dict[str, DataFrame]:
    return {
        "cases": raw.select(F.inline("cases")),
        "events": raw.select(F.inline("events")),
        "labels": raw.select(F.inline("labels")),
        "manifest": raw.select("manifest.*").where(F.col("run_id").isNotNull()),
    }


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """JSON files that each hold one bundle {cases: [...], events: [...], labels: [...], manifest: {...}}.

    One file is one record of one task; `split_bundle` reads large ones with many.
    """
    return _entities(spark.read.schema(_BUNDLE).option("multiLine", True).json(path))


#: Entities of a bundle and their columns.
BUNDLE_DDL = {
    "cases": CASE_DDL,
    "events": EVENT_DDL,
    "labels": LABEL_DDL,
    "manifest": "run_id string, case_count bigint, event_count bigint, fingerprint string",
}


def bundle_records(spark: SparkSession, path: str, scale: Scale | None = None) -> DataFrame:
    """(file, entity, text): the records of nested bundles of any size, cut out by many tasks.

    A bundle is {name: [record, ...], name: record, ...}; a file holds one or more of them.  Files are
    read in byte ranges as pieces that end at a closing brace.  Running counts over the pieces of a
    file tell which braces stand outside strings and how deep they are, so records are put together
    from their pieces wherever the byte ranges were cut.  Only running counts go from task to task,
    and no task holds more than one record at once.  Works on every path that Spark reads.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")
    pieces = spark.read.option("lineSep", "}").text(path).select("value", *at, F.monotonically_increasing_id().alias("n"))
    # escaped characters are blotted out, so every quote begins or ends a string; lengths stay as they are
    plain = F.regexp_replace("value", r"(?s)\\.", "__")
    marks = (F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))).cast("long")
    pieces = pin(pieces.withColumn("plain", plain).withColumn("marks", marks))
    scale = scale or Scale.of(pieces, "file")
    order = ["range", "n"]
    # the stored count: an expression would be worked out again for every part that `blank` looks at
    rows = scan(pieces, ["file"], order, scale, running={"quotes": F.col("marks")})
    rows = rows.withColumn("inside", (F.col("quotes") - F.col("marks")) % 2)
    blank = lambda x, i: F.when((i + F.col("inside")) % 2 == 0, x).otherwise(F.repeat(F.lit("_"), F.length(x)))
    bare = F.array_join(F.transform(F.split("plain", '"', -1), blank), '"')
    rows = rows.select("file", *order, "value", bare.alias("bare"), (1 - F.col("quotes") % 2).alias("closes"))
    opens = (F.length("bare") - F.length(F.replace("bare", F.lit("{"), F.lit("")))).cast("long")
    rows = scan(rows.withColumn("opens", opens), ["file"], order, scale, running={"depth": F.col("opens") - F.col("closes")})
    deepest, before = F.col("depth") + F.col("closes"), F.col("depth") + F.col("closes") - F.col("opens")
    rows = rows.withColumns({"ends": ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("long"), "within": deepest >= 2})
    # the first piece of a record begins with what stands between records, such as the name of the next list
    first = (before < 2) & F.col("within")
    skip = F.when(before < 1, F.expr("locate('{', bare)")).otherwise(0)
    rows = rows.withColumn("skip", skip).withColumn("start", F.when(first, F.expr("locate('{', bare, skip + 1)")).otherwise(1))
    name = F.regexp_extract(F.expr("substring(value, 1, start - 1)"), r'"([^"]*)"\s*:\s*[\[]?\s*$', 1)
    rows = rows.withColumns({"name": F.when(first & (name != ""), name), "piece": F.expr("substring(value, start)")})
    rows = scan(rows, ["file"], order, scale, running={"ended": F.col("ends")}, carry={"entity": F.col("name")})
    rows = rows.where("within").withColumn("record", F.col("ended") - F.col("ends"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, "piece"))), lambda x: x["piece"])
    records = rows.groupBy("file", "record").agg(F.first("entity").alias("entity"), F.concat(F.array_join(listed, "}"), F.lit("}")).alias("text"))
    return records.select("file", "entity", "text")


def split_bundle(spark: SparkSession, path: str, scale: Scale | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(entity -> rows, bad records) of nested bundles of any size; a bad record keeps its file, entity and text."""
    records = bundle_records(spark, path, scale).where(F.col("entity").isin(*BUNDLE_DDL))
    of = lambda entity: F.col("entity") == entity
    parsed, broken = {}, F.lit(False)
    for entity, ddl in BUNDLE_DDL.items():
        whole = F.from_json("text", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        parsed[f"_{entity}"] = F.when(of(entity), whole)
        broken = F.when(of(entity), F.col(f"_{entity}").isNull() | F.col(f"_{entity}._bad").isNotNull()).otherwise(broken)
    # every record is parsed once, as what it is; only bad ones keep their text
    rows = records.withColumns(parsed).withColumn("broken", broken)
    rows = pin(rows.withColumn("text", F.when(F.col("broken"), F.col("text"))))
    good = {}
    for entity, ddl in BUNDLE_DDL.items():
        columns = [p.strip().split(" ")[0] for p in _split(ddl)]
        fine = rows.where(of(entity) & ~F.col("broken"))
        good[entity] = fine.select(*[F.col(f"_{entity}.{c}").alias(c) for c in columns])
    return good, rows.where("broken").select("file", "entity", "text")


def read_bundle_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same with one bundle per line, which splits over tasks."""
    return _entities(spark.read.schema(_BUNDLE).json(path))


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines).  Blank lines are skipped; a bad line keeps its text and file."""
    columns = [p.strip().split(" ")[0] for p in _split(ddl)]
    # read as text and parse whole lines: a reader that prunes columns would not notice
    # a broken value in a column nobody asked for
    parsed = F.from_json(
        "value", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    raw = (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(parsed.alias("r"), "value", F.col("_metadata.file_path").alias("file"))
    )
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull()
    good = raw.where(~broken).select(*[F.col(f"r.{c}").alias(c) for c in columns])
    bad = raw.where(broken).select("file", F.col("value").alias("line"))
    return good, bad


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_jsonl(spark, path, SNAPSHOT_SCHEMA)


def stream_snapshots(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    )


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_jsonl(spark, path, LABEL_DDL)


def read_contract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forms, rules) of a nested requirements contract, in declaration order."""
    rule = (
        "struct<requirement_id:string,field_id:string,kind:string,required:boolean,"
        "condition:struct<field_id:string,equals:string>,administrative_purpose:string>"
    )
    form = (
        f"struct<form_identifier:string,form_version:string,administrative_path:string,"
        f"requirements:array<{rule}>,source_supported_fields:map<string,array<string>>,"
        f"unsupported_source_combinations:array<string>,effective_from:timestamp,effective_until:timestamp>"
    )
    raw = spark.read.schema(
        f"contract_id string, contract_version string, forms array<{form}>"
    ).option("multiLine", True).json(path)
    listed = raw.select("contract_version", F.posexplode("forms").alias("form_no", "f"))
    forms = listed.select(
        "form_no",
        "f.form_identifier",
        "f.form_version",
        "f.effective_from",
        "f.effective_until",
        F.coalesce("f.unsupported_source_combinations", F.array().cast("array<string>")).alias(
            "unsupported_sources"
        ),
        "contract_version",
    )
    rules = listed.select("form_no", F.explode("f.requirements").alias("r")).select(
        "form_no",
        "r.requirement_id",
        "r.field_id",
        "r.required",
        F.col("r.condition.field_id").alias("condition_field"),
        F.col("r.condition.equals").alias("condition_equals"),
    )
    return forms, rules


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Numeric thresholds of a policy file as (threshold, number) rows."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    keys = [f.name for f in raw.schema.fields if f.dataType.typeName() == "string"]
    pairs = [
        F.struct(F.lit(k).alias("threshold"), F.expr(f"try_cast(`{k}` AS double)").alias("number"))
        for k in keys
    ]
    return raw.select(F.inline(F.array(*pairs))).where(F.col("number").isNotNull())


def read_research(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a research pack {sessions: [{observations: [...]}]}, one row each."""
    session = _as_struct(RESEARCH_SESSION)
    raw = spark.read.schema(f"pack_version string, sessions array<{session}>").option(
        "multiLine", True
    ).json(path)
    return flatten_research(raw.select(F.inline("sessions")))


def flatten_research(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "participant_id", F.col("role").alias("session_role"), F.inline("observations")
    )


def research_problems(observations: DataFrame) -> DataFrame:
    """(problem, subject): repeated ids, roles that differ, unknown contradicted observations."""

    def repeated(column: str, name: str, per: str | None = None) -> DataFrame:
        base = observations.select(column, per).distinct() if per else observations.select(column)
        return (
            base.groupBy(column)
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .select(F.lit(name).alias("problem"), F.col(column).alias("subject"))
        )

    roles = observations.where(F.col("affected_role") != F.col("session_role")).select(
        F.lit("role_differs").alias("problem"), F.col("observation_id").alias("subject")
    )
    known = observations.select(F.col("observation_id").alias("other"))
    unknown = (
        observations.select("observation_id", F.explode("contradicts").alias("other"))
        .join(known, "other", "left_anti")
        .select(F.lit("unknown_contradiction").alias("problem"), F.col("observation_id").alias("subject"))
    )
    return (
        repeated("observation_id", "repeated_observation")
        .unionByName(repeated("participant_id", "repeated_participant", "session_id"))
        .unionByName(roles)
        .unionByName(unknown)
    )


def jdbc_options(url: str, query_table: str, *, partition: tuple[str, str, str, int] | None = None) -> dict:
    """Reader options; partition = (column, lower, upper, number of ranges)."""
    options = {"url": url, "dbtable": query_table, "fetchsize": "10000", "pushDownPredicate": "true"}
    if partition:
        column, low, high, n = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": low,
            "upperBound": high,
            "numPartitions": str(n),
        }
    return options


def read_jdbc(spark: SparkSession, options: dict) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def select_run(
    events: DataFrame, cases: DataFrame, run_id: str, key: str = "generation_run_id"
) -> tuple[DataFrame, DataFrame]:
    """Events of one run (by a JSON key of their metadata) and the cases they belong to."""
    picked = events.where(F.get_json_object("metadata", f"$.{key}") == run_id)
    return picked, cases.join(picked.select("case_id"), "case_id", "left_semi")


def check_counts(events: DataFrame, cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row; the job fails when the counts differ from the manifest's."""
    got = (
        cases.agg(F.count(F.lit(1)).alias("cases"))
        .crossJoin(events.agg(F.count(F.lit(1)).alias("events")))
        .crossJoin(manifest.select("case_count", "event_count"))
    )
    same = (F.col("cases") == F.col("case_count")) & (F.col("events") == F.col("event_count"))
    return got.select(
        "cases",
        "events",
        F.when(same, F.lit(True))
        .otherwise(F.raise_error(F.lit("counts differ from the manifest")).cast("boolean"))
        .alias("complete"),
    )
