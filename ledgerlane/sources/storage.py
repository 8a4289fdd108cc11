"""Files on any file system that Spark reaches, by Hadoop's FileSystem: a path means here what it means
to spark.read. Listings and small files only; rows and file contents are read by jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(path: str):
    """The session's file system and path object."""
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/") or "/", *names])


def qualified(path: str) -> str:
    """The path as Spark's listings and _metadata name it."""
    fs, p = _at(path)
    return fs.makeQualified(p).toString()


def inside(path: str, folder: str) -> bool:
    return (qualified(path) + "/").startswith(qualified(folder).rstrip("/") + "/")


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def is_file(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def size(path: str) -> int:
    fs, p = _at(path)
    return fs.getFileStatus(p).getLen()


def files(folder: str) -> list[str]:
    """Qualified paths of the files right in a folder, by name; none where there is no folder."""
    fs, p = _at(folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def all_files(folder: str) -> list[str]:
    """Qualified paths of the files in a folder and below, without those that Spark hides."""
    fs, p = _at(folder)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(x for x in out if not name_of(x).startswith(("_", ".")))


def make_folder(path: str) -> None:
    fs, p = _at(path)
    fs.mkdirs(p)


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def move(source: str, target: str) -> None:
    """Renames a file; what is at the target goes."""
    fs, p = _at(source)
    _, q = _at(target)
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"{source} could not be moved to {target}")


def read(path: str) -> bytes:
    """A small file."""
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write(path: str, parts: Iterable[bytes]) -> str:
    """A file of the parts in turn. It gets its name once it is whole."""
    fs, _ = _at(path)
    partial = f"{path}.partial"
    stream = fs.create(_at(partial)[1], True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    finally:
        stream.close()
    move(partial, path)
    return path


def sha256(path: str) -> str:
    """The digest of one file of any length, streamed."""
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
