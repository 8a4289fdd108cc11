"""The catalogue of runs: one row per id, kept by appending and merging when it is read.

A record is a small file of its own in the bucket of its id's hash, which appears in one step, so that
writers never meet, and a look-up reads one bucket. Reading merges an id's records: of every column the newest value that is not
null, by updated_at and then by when it was recorded. compact() writes the merged rows as a new base and
then names it in a marker file, which appears in one step; records that come meanwhile stay
beside it. Merging a record twice changes nothing, so a reader may see it in the base and on its own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.sources import storage

FIELDS = {
    "id": "string", "created_at": "timestamp", "updated_at": "timestamp", "status": "string", "plan_name": "string", "user_id": "string",
    "payroll_filename": "string", "rk_filename": "string", "summary_json": "string", "manifest_json": "string", "evidence_pack_path": "string",
    "error_message": "string",
}
RUNS = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
BUCKETS = 64

_STORED = f"{RUNS}, recorded_at timestamp, bucket int"


def record_run(path: str, **values: object) -> None:
    """Adds to the run of values["id"], a new one or one that is there. created_at and updated_at are now,
    where they are not given."""
    unknown = set(values) - set(FIELDS)
    if unknown or not values.get("id"):
        raise ValueError(f"a run needs an id and has no {sorted(unknown)}")
    now = datetime.now(timezone.utc)
    values = {"created_at": now, "updated_at": now} | {k: v for k, v in values.items() if v is not None} | {"recorded_at": now}
    told = {k: v.astimezone(timezone.utc).isoformat() if isinstance(v, datetime) else str(v) for k, v in values.items()}
    bucket = zlib.crc32(told["id"].encode()) % BUCKETS
    storage.write(storage.join(path, "records", f"bucket={bucket}", f"{uuid.uuid4().hex}.json"), [json.dumps(told).encode() + b"\n"])


def _markers(path: str) -> list[str]:
    return [p for p in storage.files(path) if storage.name_of(p).startswith("base-") and p.endswith(".json")]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    marker, out = _markers(path), spark.createDataFrame([], _STORED)
    at = storage.join(path, "records")
    if storage.exists(at):
        out = out.union(spark.read.schema(_STORED).json(at))
    if marker:
        out = out.union(spark.read.schema(_STORED).parquet(storage.join(path, json.loads(storage.read(marker[-1]))["folder"])))
    return out


def merged(stored: DataFrame) -> DataFrame:
    """One row per id of FIELDS and recorded_at: each column's newest value that is not null."""
    at = F.struct("updated_at", "recorded_at")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value"))))["value"].alias(c)
    rest = [c for c in FIELDS if c not in ("id", "created_at")]
    return stored.groupBy("id").agg(F.min("created_at").alias("created_at"), *[newest(c) for c in rest]).select(*FIELDS)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run."""
    return merged(_stored(spark, path))


def find_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The run of an id, from its bucket only."""
    bucket = zlib.crc32(run_id.encode()) % BUCKETS
    return merged(_stored(spark, path).filter((F.col("bucket") == bucket) & (F.col("id") == run_id)))


def compact(spark: SparkSession, path: str) -> None:
    """Makes one file a bucket of what is there; files that the compaction before has merged go."""
    merged = storage.all_files(storage.join(path, "records")) if storage.exists(storage.join(path, "records")) else []
    earlier = _markers(path)
    number = 1 + (int(storage.name_of(earlier[-1])[5:11]) if earlier else 0)
    folder = f"base-{number:06}"
    rows = runs(spark, path).withColumn("recorded_at", F.col("updated_at")).withColumn("bucket", (F.crc32(F.col("id").cast("binary")) % BUCKETS).cast("int"))
    rows.repartition(min(BUCKETS, 8), "bucket").write.partitionBy("bucket").parquet(storage.join(path, folder))
    storage.write(storage.join(path, f"{folder}.json"), [json.dumps({"folder": folder, "merged": merged}).encode()])
    for marker in earlier:
        before = json.loads(storage.read(marker))
        for gone in [*before["merged"], storage.join(path, before["folder"]), marker]:
            storage.delete(gone)
