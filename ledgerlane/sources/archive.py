"""ZIP archives whose members are deflated by tasks.

Tasks cut members into pieces and deflate each on its own, ended at a byte (a full flush), with the
piece's length and CRC-32; pieces are written to the shared folder. Lengths and CRCs are few numbers a
piece: they are combined to the members' own on the driver, which then writes headers, pieces in
turn and, last, the central directory. One piece is held at a time. Members and archives of any size
are written (ZIP64 beyond 4 GB or 65,535 members). The archive gets its name once it is whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.sources import storage
from ledgerlane.sources.scratch import materialize

PIECE = 1 << 20
#: Fixed values of the ZIP and deflate formats: an empty last block, signatures, the largest short
#: length, a date (1980-01-01), version and flag (UTF-8 names), and CRC-32's polynomial.
LAST_BLOCK = b"\x03\x00"
LOCAL, CENTRAL, END, END64, LOCATOR = (struct.pack("<I", x) for x in (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50))
SHORT, DATE, VERSION, UTF8, POLYNOMIAL = 0xFFFFFFFF, 0x21, 45, 0x800, 0xEDB88320

PIECES = "member string, place long, data binary, crc long, plain long"


def deflated(data: bytes) -> tuple[bytes, int, int]:
    """A piece: its deflated bytes, CRC-32 and length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FULL_FLUSH), zlib.crc32(data), len(data)


def _times(matrix: list[int], vector: int) -> int:
    return reduce(lambda a, k: a ^ matrix[k] if vector >> k & 1 else a, range(32), 0)


def crc_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces, the second of which has this length: the first one's is carried over
    so many zero bytes by squaring the matrix of one zero bit."""
    matrix = [POLYNOMIAL, *[1 << k for k in range(31)]]
    bits = length * 8
    while bits:
        if bits & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, column) for column in matrix]
        bits >>= 1
    return first ^ second


def pieces_of(spark: SparkSession, members: dict[str, str]) -> DataFrame:
    """Pieces of files, by member: each is read and deflated by tasks."""
    names = spark.createDataFrame([(m, storage.qualified(p)) for m, p in members.items()], "member string, path string")
    # The scan leaves empty files out.
    data, crc, plain = deflated(b"")
    empty = spark.createDataFrame([(m, 0, bytearray(data), crc, plain) for m, p in members.items() if not storage.size(p)], PIECES)

    @F.pandas_udf("data binary, crc long, plain long")
    def deflate(chunks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([deflated(c) for c in chunks], columns=["data", "crc", "plain"])

    there = spark.read.format("binaryFile").load(list(members.values())).join(names, "path")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / PIECE) - 1, F.lit(0).cast("long"))))
    cut = there.select("member", "content", place.alias("place")).select("member", "place", F.substring("content", F.col("place").cast("int") * PIECE + 1, F.lit(PIECE)).alias("chunk"))
    return cut.select("member", "place", deflate("chunk").alias("z")).select("member", "place", "z.*").union(empty)


def _extra(*long: int) -> bytes:
    return struct.pack(f"<HH{len(long)}Q", 1, 8 * len(long), *long)


def assemble(pieces: DataFrame, path: str, texts: dict[str, str | bytes] | None = None) -> str:
    """Writes an archive of the pieces' members, in order of name and place, and of the texts."""
    written = materialize(pieces)
    members: dict[str, list[int]] = {}
    for r in written.select("member", "crc", "plain", F.length("data").alias("packed")).orderBy("member", "place").toLocalIterator():
        crc, plain, packed = members.get(r["member"], (0, 0, len(LAST_BLOCK)))
        members[r["member"]] = [crc_joined(crc, r["crc"], r["plain"]), plain + r["plain"], packed + r["packed"]]
    at, central = 0, []

    def opened(name: str, crc: int, plain: int, packed: int) -> bytes:
        nonlocal at
        raw, long = name.encode(), max(plain, packed) >= SHORT
        start = struct.pack("<HHHHHI", VERSION, UTF8, 8, 0, DATE, crc)
        sizes = struct.pack("<II", SHORT, SHORT) if long else struct.pack("<II", packed, plain)
        extra = _extra(plain, packed) if long else b""
        far = [plain, packed] * long + [at] * (at >= SHORT)
        more = _extra(*far) if far else b""
        central.append(
            CENTRAL + struct.pack("<H", VERSION) + start + sizes + struct.pack("<HHHHHII", len(raw), len(more), 0, 0, 0, 0, SHORT if at >= SHORT else at) + raw + more
        )
        head = LOCAL + start + sizes + struct.pack("<HH", len(raw), len(extra)) + raw + extra
        at += len(head) + packed
        return head

    def parts() -> Iterator[bytes]:
        now = None
        for r in written.select("member", "data").orderBy("member", "place").toLocalIterator():
            if r["member"] != now:
                if now is not None:
                    yield LAST_BLOCK
                now = r["member"]
                yield opened(now, *members[now])
            yield bytes(r["data"])
        if now is not None:
            yield LAST_BLOCK
        for name, text in (texts or {}).items():
            data, crc, plain = deflated(text.encode() if isinstance(text, str) else text)
            yield opened(name, crc, plain, len(data) + len(LAST_BLOCK))
            yield data + LAST_BLOCK
        begin, listed, n = at, b"".join(central), len(central)
        yield listed
        if n >= 0xFFFF or begin + len(listed) >= SHORT:
            yield END64 + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, n, n, len(listed), begin) + LOCATOR + struct.pack("<IQI", 0, begin + len(listed), 1)
        yield END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(listed), SHORT), min(begin, SHORT), 0)

    return storage.write(path, parts())
