"""Place and time that a camera wrote into a JPEG file: the Exif block of its first application segment."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published format: tags of the blocks within the first one, of the time a picture was taken, its zone, and of the place.
_EXIF_BLOCK, _GPS_BLOCK, _TAKEN, _TAKEN_OFFSET = 0x8769, 0x8825, 0x9003, 0x9011
_LAT_SIDE, _LAT, _LNG_SIDE, _LNG = 1, 2, 3, 4
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: The block stands near the beginning of a file and has at most 64 KB.
HEAD_BYTES = 256 * 1024


def _block(body: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag -> (kind, count, bytes) of one directory."""
    (n,) = struct.unpack_from(order + "H", body, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", body, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", body, at + 10 + 12 * k)[0]
        out[tag] = (kind, count, body[where : where + size])
    return out


def _degrees(entry, order: str) -> float | None:
    if entry is None or len(entry[2]) < 24:
        return None
    parts = [struct.unpack_from(order + "II", entry[2], 8 * k) for k in range(3)]
    return sum(a / b / 60**k for k, (a, b) in enumerate(parts) if b)


def read_exif(content: bytes) -> tuple[float | None, float | None, int | None]:
    """(latitude, longitude, wall-clock milliseconds or instant if the file names an offset) of a JPEG file, None for what is not there.

    Whatever is damaged counts as not there.
    """
    try:
        if content[:2] != b"\xff\xd8":
            return None, None, None
        at = 2
        while content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
            (size,) = struct.unpack_from(">H", content, at + 2)
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                break
            at += 2 + size
        else:
            return None, None, None
        body = content[at + 10 : at + 2 + size]
        order = {b"II": "<", b"MM": ">"}[body[:2]]
        first = _block(body, order, struct.unpack_from(order + "I", body, 4)[0])
        inner = lambda tag: _block(body, order, struct.unpack(order + "I", first[tag][2])[0]) if tag in first else {}
        gps, exif = inner(_GPS_BLOCK), inner(_EXIF_BLOCK)
        lat, lng = _degrees(gps.get(_LAT), order), _degrees(gps.get(_LNG), order)
        if lat is not None and gps.get(_LAT_SIDE, (0, 0, b""))[2][:1] == b"S":
            lat = -lat
        if lng is not None and gps.get(_LNG_SIDE, (0, 0, b""))[2][:1] == b"W":
            lng = -lng
        text = lambda tag: exif[tag][2].split(b"\0")[0].decode("ascii").strip() if tag in exif else ""
        taken = None
        if text(_TAKEN):
            wall = datetime.strptime(text(_TAKEN), "%Y:%m:%d %H:%M:%S")
            zone = text(_TAKEN_OFFSET)
            if zone:
                wall -= timedelta(hours=int(zone[:3]), minutes=int(zone[0] + zone[4:6]))
            taken = (wall - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
        return lat, lng, taken
    except (IndexError, KeyError, ValueError, struct.error, UnicodeDecodeError):
        return None, None, None


def exif_table(files: DataFrame) -> DataFrame:
    """``path, exif_lat, exif_lng, exif_ms`` of files (``path, content``); pictures of other kinds have nulls. Only the heads of files go to Python."""
    schema = pa.schema([("path", pa.string()), ("exif_lat", pa.float64()), ("exif_lng", pa.float64()), ("exif_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_exif(head or b"") for head in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    heads = files.select("path", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return heads.mapInArrow(run, "path string, exif_lat double, exif_lng double, exif_ms bigint")
