"""Writing results on any file system of Spark: tables as CSV, JSON, the sealed ZIP."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.sources import archive, storage


def with_run(rows: DataFrame, run_id: str, plan_name: str | None, plan_year: int | None) -> DataFrame:
    """Run metadata as columns, added before the write."""
    return rows.withColumns({
        "run_id": F.lit(run_id), "plan_name": F.lit(plan_name).cast("string"), "plan_year": F.lit(plan_year).cast("int"),
    })


def refuse_inputs(folder: str, inputs: list[str]) -> None:
    """An output folder must not hold an input."""
    held = [p for p in inputs if storage.inside(p, folder)]
    if held:
        raise ValueError(f"the output folder {folder} holds inputs, choose another: {held}")


def clean(folder: str) -> list[str]:
    """Removes from an output folder what earlier runs have written there, and nothing else: the files
    and tables that their manifests name. Returns what went."""
    gone = []
    for path in storage.files(folder):
        if storage.name_of(path).startswith("manifest") and path.endswith(".json"):
            for written in json.loads(storage.read(path)).get("written", []):
                if storage.inside(written, folder) and written != path and storage.exists(written):
                    storage.delete(written)
                    gone.append(written)
    return gone


def write_csv(rows: DataFrame, path: str, single: bool = False) -> str:
    """A folder of part files, each with a header, written in parallel; or (single, for tables of few
    rows) one CSV file. Quotes are doubled and white space stays, so that what is read back is equal."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if not single:
        rows.write.mode("overwrite").csv(path, **options)
        return path
    folder = path + ".parts"
    rows.coalesce(1).write.mode("overwrite").csv(folder, **options)
    found = [p for p in storage.files(folder) if storage.name_of(p).startswith("part-")]
    if found:
        storage.move(found[0], path)
    else:
        storage.write(path, [(",".join(rows.columns) + "\n").encode()])
    storage.delete(folder)
    return path


def write_json(value: dict, path: str) -> str:
    return storage.write(path, [(json.dumps(value, indent=2, default=str, sort_keys=True) + "\n").encode()])


def parts_of(path: str) -> list[str]:
    """The file, or the part files of a table that Spark wrote; neither is an error."""
    if storage.is_file(path):
        return [path]
    found = [p for p in storage.files(path) if storage.name_of(p).startswith("part-")]
    if not found:
        raise FileNotFoundError(f"neither a file nor a written table: {path}")
    return found


def seal(files: dict[str, str], path: str, notes: dict[str, str] | None = None, names: dict[str, str] | None = None) -> str:
    """A ZIP of files and tables by key, and of notes as text files; written last. A table's part files
    keep its name; names holds, by key, other names than the files have. Members are deflated by tasks."""
    members = {}
    for key, source in files.items():
        inside = (names or {}).get(key, storage.name_of(source))
        for part in parts_of(source):
            members[inside if part == source else f"{inside}/{storage.name_of(part)}"] = part
    spark = SparkSession.active()
    pieces = archive.pieces_of(spark, members) if members else spark.createDataFrame([], archive.PIECES)
    return archive.assemble(pieces, path, notes)
