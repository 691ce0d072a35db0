"""Writers: notes with verified hashes, JSON sidecars, request queues, structured log lines, snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.plans import written


def write_notes(notes: DataFrame, path: str, folder: str, name: str, content: str) -> DataFrame:
    """Stores notes (partitioned by folder, with the hash of what was to be written), reads them again, and returns
    those whose stored bytes hash to something else; none means that all is well. The commit is all or nothing."""
    notes.select(F.col(folder).alias("folder"), F.col(name).alias("name"), F.col(content).alias("content"), F.sha2(content, 256).alias("sha256")).write.partitionBy("folder").mode("overwrite").parquet(path)
    back = notes.sparkSession.read.parquet(path)
    return back.filter(F.sha2("content", 256) != F.col("sha256")).select("folder", "name")


def write_sidecars(rows: DataFrame, path: str, slug: str) -> None:
    """JSON lines in a folder for each first hex digit of the slug, so that one slug is found without a full scan."""
    rows.withColumn("shard", F.substring(slug, 1, 1)).write.partitionBy("shard").mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str, slug: str, column: str = "slug") -> DataFrame:
    """Rows whose slug is ``slug``, or begins with it; only the folder of its first digit is read."""
    return spark.read.schema(schema).json(f"{path}/shard={slug[0]}").filter(F.startswith(F.col(column), F.lit(slug)))


def queue_requests(eligible: DataFrame, path: str, request_id: Column, now: Column) -> None:
    """Appends delete requests as JSON lines: a decision table for whoever acts on it."""
    target = F.array(F.struct(F.col("source_path").alias("relpath"), F.col("source_size").alias("size"), F.col("source_mtime").alias("mtime")))
    eligible.select(F.lit(1).alias("schema"), request_id.alias("request_id"), now.alias("created_at"), "device_id", "partkey", "session_key", target.alias("targets")).write.mode("append").json(path)


def log_lines(events: DataFrame, at: str, level: str, event: str, fields: list[str], secret: list[str], as_json: bool) -> DataFrame:
    """Log events as ``line``, text or JSON, with secret values reduced to their length; null fields are left out of text."""
    shown = {c: text.redact(F.lit(c), F.col(c).cast("string"), secret) if c in secret else F.col(c) for c in fields}
    if as_json:
        line = F.to_json(F.struct(F.col(at).cast("string").alias("ts"), F.col(level).alias("level"), F.col(event).alias("event"), *[v.alias(k) for k, v in shown.items()]))
    else:
        pairs = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in shown.items()]
        line = F.concat_ws(" ", F.col(at).cast("string"), F.col(level), F.col(event), *pairs)
    return events.select(line.alias("line"))


def snapshot(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """A copy of each table in the shared folder, as before a migration."""
    return {k: written(v, f"{name}-{k}") for k, v in tables.items()}


def migrate(table: DataFrame, version: int, steps: dict, name: str) -> tuple[DataFrame, DataFrame, int]:
    """The snapshot, the migrated table (written) and its version: ``steps`` maps versions to functions of a table; those
    above ``version`` are applied in ascending order, after the snapshot is stored. Nothing is done if there are none."""
    newer = [v for v in sorted(steps) if v > version]
    if not newer:
        return table, table, version
    kept = snapshot({name: table}, f"before-{newer[0]}")[name]
    now = kept
    for v in newer:
        now = steps[v](now)
    return kept, written(now, f"{name}-{newer[-1]}"), newer[-1]
