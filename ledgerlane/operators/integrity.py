"""Row hashes, Merkle root and file manifests."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.sources import files, storage
from ledgerlane.sources.scratch import materialize
from ledgerlane.sources.sinks import parts_of, write_json

LEAVES_A_GROUP = 1024
#: Files up to this length are read whole by a task.
LARGEST_ROW = 1 << 30


def row_hashes(rows: DataFrame) -> DataFrame:
    """rows with row_hash: SHA-256 of col=value pairs in order of column name, joined by |; a null
    reads nan."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))) for c in sorted(rows.columns)]
    return rows.withColumn("row_hash", F.sha2(F.concat_ws("|", *parts), 256))


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with index_ from 0 in the given order (which must be total), without sorting in one task:
    a range partitioning, ranks within partitions, and offsets from the partitions' counts. The
    partitioned rows are written before they are numbered: if an executor is lost, another sample for
    the ranges would cut them elsewhere."""
    parted = materialize(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parted.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).withColumn("offset_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return parted.withColumn("rank_", rank).join(offsets, "part_").withColumn(
        "index_", (F.col("rank_") + F.col("offset_")).cast("long")
    ).drop("part_", "rank_", "offset_", "n_")


def merkle_root(leaves: DataFrame, n: int) -> DataFrame:
    """The root of leaves(index_, row_hash): neighbours are hashed in pairs, an odd last one with
    itself; '' when there are none. Groups of 1,024 leaves are folded by ten levels at a time."""
    pairs = lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")),
        lambda i: F.sha2(F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))), 256),
    )
    level = leaves.select("index_", F.col("row_hash").alias("h"))
    while n > 1:
        whole = n <= LEAVES_A_GROUP
        step = (lambda a, _: F.when(F.size(a) > 1, pairs(a)).otherwise(a)) if whole else (lambda a, _: pairs(a))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("index_", "h"))), lambda x: x["h"])
        level = level.groupBy(F.floor(F.col("index_") / LEAVES_A_GROUP).alias("group_")).agg(listed.alias("hs")).select(
            F.col("group_").alias("index_"), F.get(F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.col("hs"), step), F.lit(0)).alias("h")
        )
        n = -(-n // LEAVES_A_GROUP)
    return level.agg(F.coalesce(F.max("h"), F.lit("")).alias("merkle_root"))


def merkle_of(rows: DataFrame, *order: str) -> DataFrame:
    leaves = indexed(row_hashes(rows).select(*order, "row_hash"), *order)
    return merkle_root(leaves, leaves.count())


def sample_hashes(rows: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """index_ and row_hash of the first n rows in the given order."""
    first = row_hashes(rows).orderBy(*order).limit(n)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("index_"), "row_hash")


def proof_of(rows: DataFrame, *order: str) -> dict:
    """What a proof holds of a table: row count, columns, Merkle root and the first row hashes."""
    leaves = indexed(row_hashes(rows).select(*order, "row_hash"), *order)
    n = leaves.count()
    first = leaves.filter("index_ < 5").orderBy("index_").collect()
    return {"row_count": n, "columns": sorted(rows.columns), "order": list(order), "merkle_root": merkle_root(leaves, n).first()[0], "row_hash_sample": [r["row_hash"] for r in first]}


def sha256_file(path: str, prefix: str = "") -> str:
    return prefix + storage.sha256(path)


def sha256_bytes(data: bytes | str, prefix: str = "") -> str:
    return prefix + hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def file_hashes(paths: list[str], lenient: bool = False) -> DataFrame:
    """path (qualified), length and sha256 of files, which tasks read; files longer than a row can hold,
    and empty ones, which the scan leaves out, are hashed one by one. If lenient, files that the store
    itself finds damaged are left out instead of being an error."""
    spark = SparkSession.active()
    shape = "path string, length long, sha256 string"
    apart = {p for p in paths if not 0 < storage.size(p) <= LARGEST_ROW}
    streamed = spark.createDataFrame([(storage.qualified(p), storage.size(p), sha256_file(p, "sha256:")) for p in sorted(apart)], shape)
    small = [p for p in paths if p not in apart]
    if not small:
        return streamed
    there = spark.read.format("binaryFile").option("ignoreCorruptFiles", lenient).load(small)
    return there.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256")).union(streamed)


def write_manifest(
    path: str, inputs: dict[str, str], outputs: dict[str, str], config: dict | None = None, roots: dict | None = None, written: list[str] | None = None
) -> dict:
    """Time, hashes of inputs and outputs (of a table, of each part file), configuration and Merkle
    roots, as JSON; written names all that the run has put into its folder. A file that is not there is
    an error. The hash of the sealed ZIP is added later by add_seal()."""
    entries = {}
    for kind, whole in (("inputs", inputs), ("outputs", outputs)):
        for key, source in whole.items():
            for part in parts_of(source):
                entries[kind, key if part == source else f"{key}/{storage.name_of(part)}"] = storage.qualified(part)
    known = {r["path"]: r["sha256"] for r in file_hashes(sorted(set(entries.values()))).collect()} if entries else {}
    hashed = {kind: {key: {"path": p, "sha256": known[p]} for (k, key), p in entries.items() if k == kind} for kind in ("inputs", "outputs")}
    manifest = {
        "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ"), "config": config or {}, **hashed, "merkle_roots": roots or {},
        "evidence_pack_sha256": None, "written": [storage.qualified(p) for p in written or []],
    }
    write_json(manifest, path)
    return manifest


def add_seal(path: str, sealed: str) -> None:
    """Adds the ZIP's hash to the manifest that lies beside it; the copy inside holds null."""
    manifest = json.loads(storage.read(path))
    write_json(manifest | {"evidence_pack_sha256": sha256_file(sealed, "sha256:"), "written": [*manifest["written"], storage.qualified(sealed)]}, path)


def latest_manifest(folder: str) -> str | None:
    """The last manifest by name."""
    names = [p for p in storage.files(folder) if p.endswith(".json")]
    return names[-1] if names else None


def verified(manifest_path: str, folder: str | None = None) -> DataFrame:
    """kind, name, path and status of every file of a manifest and of every other file in the folder
    (given, or that of the manifest, without manifests): ok, changed, missing or unlisted. One job hashes
    the files and meets the manifest in a full outer join."""
    spark = SparkSession.active()
    manifest = json.loads(storage.read(manifest_path))
    named = [(kind, name, e["path"], e["sha256"]) for kind in ("inputs", "outputs") for name, e in manifest[kind].items()]
    sealed = [p for p in manifest["written"] if p.endswith(".zip")]
    named += [("outputs", storage.name_of(p), p, manifest["evidence_pack_sha256"]) for p in sealed]
    folder = folder or manifest_path.rsplit("/", 1)[0]
    found = {p for p in storage.all_files(folder) if not storage.name_of(p).startswith("manifest")} | {p for _, _, p, _ in named if storage.exists(p)}
    listed = spark.createDataFrame(named, "kind string, name string, path string, expected string")
    there = spark.createDataFrame([(p, True) for p in sorted(found)], "path string, there boolean")
    if found:
        there = there.join(file_hashes(sorted(found), lenient=True).drop("length"), "path", "left")
    else:
        there = there.withColumn("sha256", F.lit(None).cast("string"))
    status = F.when(F.col("expected").isNull(), "unlisted").when(F.col("there").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("changed")
    return listed.join(there, "path", "full_outer").select("kind", "name", "path", status.alias("status"))


def verify(manifest_path: str) -> dict[str, str]:
    """By name (of an unlisted file, by path): ok, changed, missing or unlisted."""
    return {r["name"] or r["path"]: r["status"] for r in verified(manifest_path).collect()}


def verify_proofs(proofs_path: str, tables: dict[str, str]) -> dict[str, str]:
    """Whether written tables, by name, still have the row count and Merkle root of their proof: the rows
    are read back and hashed anew."""
    out = {}
    for name, proof in json.loads(storage.read(proofs_path)).items():
        rows = files.read_csv(SparkSession.active(), tables[name]).select(*[F.col(f"`{c}`") for c in proof["columns"]])
        now = proof_of(rows, *proof["order"])
        out[name] = "ok" if (now["row_count"], now["merkle_root"]) == (proof["row_count"], proof["merkle_root"]) else "changed"
    return out
