"""ISO media containers in a column: written with SQL functions, read by walking their boxes.

`iso_media` lays bytes into a container of raw 8-bit grey frames. `media_columns` walks the nested boxes of any container, decodes the sample
tables and gives, for each track, its codec, its duration and the byte ranges of its keyframes; it doesn't touch the payload.
`read_samples` gives a track's bytes back by these tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, slices

# --- writing --------------------------------------------------------------

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
#: Frames in a chunk, of which the first is a keyframe; frames a second.
CHUNK, RATE = 8, 25

# Fixed values of the format: a matrix that changes nothing, and the empty fields of sample entries.
_MATRIX = "00010000" + "00000000" * 3 + "00010000" + "00000000" * 3 + "40000000"


def _box(kind: str, size: int, body: str) -> str:
    return f"{size:08x}{kind.encode().hex()}{body}"


_FTYP = _box("ftyp", 24, b"isom".hex() + "00000200" + b"isom".hex() + b"mp41".hex())
_HDLR = _box("hdlr", 37, "00000000" * 2 + b"vide".hex() + "00000000" * 3 + b"grey\0".hex())
_VMHD = _box("vmhd", 20, "00000001" + "0000" * 4)
_DINF = _box("dinf", 36, _box("dref", 28, "00000000" + "00000001" + _box("url ", 12, "00000001")))
_ENTRY = "000000000000" + "0001" + "00000000" * 4 + f"{WIDTH:04x}{HEIGHT:04x}" + "00480000" * 2 + "00000000" + "0001" + "00" * 32 + "0028" + "ffff"
_STSD = _box("stsd", 102, "00000000" + "00000001" + _box("raw ", 86, _ENTRY))
#: Bytes of stbl with no chunks; of the boxes around it, up to moov; and where the first sample of a file with no chunks would be.
_STBL = 8 + 102 + 24 + 16 + 16 + 20 + 16
_MINF, _MDIA, _TRAK, _MOOV = _STBL + 8 + 20 + 36, _STBL + 64 + 8 + 32 + 37, _STBL + 141 + 8 + 92, _STBL + 241 + 8 + 108


def _number(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), 8, "0")


def padded(text: Column) -> Column:
    """The text's bytes with blanks after them, up to a positive multiple of a frame; a null text is empty."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(body)
    short = F.when(size == 0, FRAME).otherwise((FRAME - size % FRAME) % FRAME)
    return F.concat(body, F.repeat(F.lit(" "), short).cast("binary"))


def iso_media(payload: Column) -> Column:
    """A container with one video track of raw 8-bit grey frames, the payload's bytes: its size is a positive multiple of FRAME, else null comes out.

    Frames stand in chunks of CHUNK, each of which begins with a keyframe. Equal payloads give equal files.
    """
    frames = (F.octet_length(payload) / FRAME).cast("long")
    chunks = F.ceil(frames / CHUNK).cast("long")
    rest = frames % CHUNK
    two = (rest > 0) & (chunks > 1)  # the last chunk is a shorter one
    runs = F.when(two, F.lit(2)).otherwise(F.lit(1))
    more = 8 * chunks + 12 * runs
    sized = lambda kind, base: [_number(more + base), F.lit(kind.encode().hex())]
    every = F.sequence(F.lit(0).cast("long"), chunks - 1)
    first = 24 + _MOOV + 8 + more
    header = [
        F.lit(_FTYP),
        *sized("moov", _MOOV),
        F.lit("0000006c" + b"mvhd".hex() + "00000000" * 3 + f"{RATE:08x}"), _number(frames), F.lit("00010000" + "0100" + "0000" + "00000000" * 2 + _MATRIX + "00000000" * 6 + "00000002"),
        *sized("trak", _TRAK),
        F.lit("0000005c" + b"tkhd".hex() + "00000003" + "00000000" * 2 + "00000001" + "00000000"), _number(frames), F.lit("00000000" * 2 + "0000" * 4 + _MATRIX + f"{WIDTH:04x}0000{HEIGHT:04x}0000"),
        *sized("mdia", _MDIA),
        F.lit("00000020" + b"mdhd".hex() + "00000000" * 3 + f"{RATE:08x}"), _number(frames), F.lit("55c40000" + _HDLR),
        *sized("minf", _MINF),
        F.lit(_VMHD + _DINF),
        *sized("stbl", _STBL),
        F.lit(_STSD + "00000018" + b"stts".hex() + "00000000" + "00000001"), _number(frames), F.lit("00000001"),
        _number(16 + 4 * chunks), F.lit(b"stss".hex() + "00000000"), _number(chunks), F.array_join(F.transform(every, lambda c: _number(c * CHUNK + 1)), ""),
        _number(16 + 12 * runs), F.lit(b"stsc".hex() + "00000000"), _number(runs), F.lit("00000001"), _number(F.least(frames, F.lit(CHUNK))), F.lit("00000001"),
        F.when(two, F.concat(_number(chunks), _number(rest), F.lit("00000001"))).otherwise(""),
        F.lit("00000014" + b"stsz".hex() + "00000000" + f"{FRAME:08x}"), _number(frames),
        _number(16 + 4 * chunks), F.lit(b"stco".hex() + "00000000"), _number(chunks), F.array_join(F.transform(every, lambda c: _number(c * (CHUNK * FRAME) + first)), ""),
        _number(frames * FRAME + 8), F.lit(b"mdat".hex()),
    ]
    whole = (F.octet_length(payload) > 0) & (F.octet_length(payload) % FRAME == 0)
    return F.when(whole, F.concat(F.unhex(F.concat(*header)), payload))


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of docs as struct `doc`, n_bytes (of the text in UTF-8) and `media`: the text's bytes as frames of a container, blanks after them.

    A null text is an empty one: a single frame of blanks. Equal texts give equal files; rows are stored one by one, under any ids and column names.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit("").cast("string"))).cast("long")
    return rows.select("doc", size.alias("n_bytes"), let(padded(F.col("text")), iso_media).alias("media"))


# --- reading --------------------------------------------------------------

#: Boxes that hold boxes and nothing before them.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex"}


class BadMedia(ValueError):
    """A container that says something that can't be."""


def boxes(data: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and stop of the body of each box between start and stop; sizes of 32 and 64 bits, or up to the end."""
    while start < stop:
        if stop - start < 8:
            raise BadMedia(f"{stop - start} bytes where a box should be, at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise BadMedia(f"box cut short at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or size > stop - start:
            raise BadMedia(f"box of {size} bytes at {start}, where {stop - start} are left")
        yield kind, start + head, start + size
        start += size


def tree(data: memoryview, start: int, stop: int) -> dict[bytes, list]:
    """By kind, what each box between start and stop holds: a tree again, or the start and stop of its body."""
    found: dict[bytes, list] = {}
    for kind, first, last in boxes(data, start, stop):
        found.setdefault(kind, []).append(tree(data, first, last) if kind in _NESTED else (first, last))
    return found


def _one(found: dict, *path: bytes):
    for kind in path:
        if kind not in found:
            raise BadMedia(f"no {kind.decode('latin-1')}")
        found = found[kind][0]
    return found


def _fields(data: memoryview, body: tuple[int, int], layout: str, offset: int = 0) -> tuple:
    if body[0] + offset + struct.calcsize(layout) > body[1]:
        raise BadMedia(f"box cut short at {body[0]}")
    return struct.unpack_from(layout, data, body[0] + offset)


def _table(data: memoryview, body: tuple[int, int], columns: int, offset: int = 8, kind: str = ">u4", count: int | None = None) -> np.ndarray:
    """The entries of a table whose number stands before them, as rows of `columns` numbers."""
    count = _fields(data, body, ">I", offset - 4)[0] if count is None else count
    if body[0] + offset + count * columns * np.dtype(kind).itemsize > body[1]:
        raise BadMedia(f"table cut short at {body[0]}")
    return np.frombuffer(data, kind, count * columns, body[0] + offset).astype(np.int64).reshape(count, columns)


def _clock(data: memoryview, body: tuple[int, int]) -> tuple[int, int]:
    """Units a second and the duration of mvhd or mdhd; a duration of all ones is not known (-1)."""
    long = _fields(data, body, ">B")[0] == 1
    scale, duration = _fields(data, body, ">IQ" if long else ">II", 20 if long else 12)
    return scale, -1 if duration == (1 << 64 if long else 1 << 32) - 1 else duration


def _sizes(data: memoryview, stbl: dict) -> np.ndarray:
    if b"stsz" in stbl:
        body = _one(stbl, b"stsz")
        size, count = _fields(data, body, ">II", 4)
        if size:
            if count > len(data):  # no sample has less than a byte
                raise BadMedia(f"{count} samples in {len(data)} bytes")
            return np.full(count, size, dtype=np.int64)
        return _table(data, body, 1, 12, count=count)[:, 0]
    body = _one(stbl, b"stz2")
    width, count = _fields(data, body, ">B", 7)[0], _fields(data, body, ">I", 8)[0]
    if width == 4:
        packed = _table(data, body, 1, 12, "u1", (count + 1) // 2)[:, 0]
        return np.stack([packed >> 4, packed & 15], axis=1).ravel()[:count]
    return _table(data, body, 1, 12, {8: "u1", 16: ">u2"}.get(width, ">u4"), count)[:, 0]


def samples(data: memoryview, stbl: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and time of each sample, and whether it is a keyframe."""
    sizes = _sizes(data, stbl)
    n = len(sizes)
    chunk_starts = _table(data, _one(stbl, b"stco"), 1)[:, 0] if b"stco" in stbl else _table(data, _one(stbl, b"co64"), 1, kind=">u8")[:, 0]
    runs = _table(data, _one(stbl, b"stsc"), 3)
    times = _table(data, _one(stbl, b"stts"), 2)
    firsts = np.append(runs[:, 0], len(chunk_starts) + 1)
    if n and (not len(runs) or firsts[0] != 1 or (np.diff(firsts) < 0).any()):
        raise BadMedia("chunks out of order")
    held = np.repeat(runs[:, 1], np.diff(firsts))
    if held.sum() != n or times[:, 0].sum() != n:
        raise BadMedia(f"{n} samples, {held.sum()} in chunks, {times[:, 0].sum()} with a time")
    ends = np.cumsum(sizes)
    inner = np.append(0, ends)[np.cumsum(held) - held]  # bytes of the samples before each chunk
    starts = ends - sizes + np.repeat(chunk_starts[: len(held)] - inner, held)
    if n and (starts.min() < 0 or (starts + sizes).max() > len(data)):
        raise BadMedia("samples beyond the file")
    deltas = np.repeat(times[:, 1], times[:, 0])
    key = np.ones(n, dtype=bool)
    if b"stss" in stbl:
        sync = _table(data, _one(stbl, b"stss"), 1)[:, 0]
        if len(sync) and (sync.min() < 1 or sync.max() > n):
            raise BadMedia("keyframe without a sample")
        key[:] = False
        key[sync - 1] = True
    return starts, sizes, np.cumsum(deltas) - deltas, key


def read_tracks(data: memoryview) -> tuple[str, list[dict]]:
    """The brand, and of each track what the tables say, in the order of the file; `at` has the samples' starts and sizes."""
    top = tree(data, 0, len(data))
    brand = bytes(data[slice(*_one(top, b"ftyp"))][:4]).decode("latin-1") if b"ftyp" in top else ""
    out = []
    for trak in _one(top, b"moov").get(b"trak", []):
        head = _one(trak, b"tkhd")
        track_id = _fields(data, head, ">I", 20 if _fields(data, head, ">B")[0] == 1 else 12)[0]
        scale, duration = _clock(data, _one(trak, b"mdia", b"mdhd"))
        handler = _fields(data, _one(trak, b"mdia", b"hdlr"), "4s", 8)[0].decode("latin-1")
        stbl = _one(trak, b"mdia", b"minf", b"stbl")
        entries = list(boxes(data, _one(stbl, b"stsd")[0] + 8, _one(stbl, b"stsd")[1]))
        if not entries:
            raise BadMedia("no sample entry")
        kind, first, last = entries[0]
        width, height = _fields(data, (first, last), ">HH", 24) if handler == "vide" else (None, None)
        channels, bits = _fields(data, (first, last), ">HH", 16) if handler == "soun" else (None, None)
        starts, sizes, times, key = samples(data, stbl)
        spans = [{"sample": int(i), "time": int(times[i]), "start": int(starts[i]), "length": int(sizes[i])} for i in np.flatnonzero(key)]
        out.append({
            "track_id": track_id, "handler": handler, "codec": kind.decode("latin-1"), "width": width, "height": height, "channels": channels, "sample_bits": bits,
            "timescale": scale, "duration": duration, "n_samples": len(sizes), "sample_bytes": int(sizes.sum()), "keyframes": spans, "at": (starts, sizes),
        })
    return brand, out


def read_samples(data: memoryview, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The samples' bytes one after another; neighbours are read as one range."""
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    edges = [0, *breaks.tolist(), len(starts)]
    return b"".join(data[starts[a] : starts[b - 1] + sizes[b - 1]] for a, b in zip(edges, edges[1:], strict=False))


TRACK = (
    "track_id: long, handler: string, codec: string, width: int, height: int, channels: int, sample_bits: int, timescale: long, duration: long, n_samples: long, "
    "sample_bytes: long, keyframes: array<struct<sample: long, time: long, start: long, length: long>>"
)


def media_columns(files: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """The rows of files with brand, tracks and error in place of the container in column `media`; with payload also the first track's bytes.

    tracks: codec, timescale, duration in its units (-1: not known), samples and their bytes, and the keyframes' numbers, times and byte
    ranges (without a table of keyframes, every sample is one). Tables are decoded, payloads aren't. A null container has null columns; one that
    breaks the format has them null, too, and says in `error` what is wrong. Columns of files named brand, tracks, error or payload give way to those made here.
    Repeated rows are read one by one; an empty table gives an empty result.
    """
    made = ["brand string", f"tracks array<struct<{TRACK}>>", "error string", *(["payload binary"] if payload else [])]
    taken = {m.split()[0] for m in made} | {media}
    others = [F.col(f"`{c}`") for c in files.columns if c not in taken]
    rows = files.select(F.struct(F.lit(1).alias("_one"), *others).alias("_row"), F.col(f"`{media}`").cast("binary").alias("_media"))
    found = T.StructType.fromDDL(", ".join(made))
    schema = T.StructType([rows.schema["_row"], *found.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, text = pa.int64(), pa.string()
        span = pa.struct([("sample", number), ("time", number), ("start", number), ("length", number)])
        small = {"handler": text, "codec": text, "width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "sample_bits": pa.int32(), "keyframes": pa.list_(span)}
        track = pa.struct([(f.name, small.get(f.name, number)) for f in found["tracks"].dataType.elementType.fields])
        types = [text, pa.list_(track), text, pa.binary()]
        for batch in slices(batches, "_media"):
            out: list[list] = [[] for _ in made]
            for value in batch.column("_media"):
                brand = tracks = error = back = None
                if value.is_valid:
                    data = memoryview(value.as_buffer())
                    try:
                        brand, tracks = read_tracks(data)
                        back = read_samples(data, *tracks[0]["at"]) if payload and tracks else b""
                    except BadMedia as bad:
                        brand, tracks, back, error = None, None, None, str(bad)
                for column, x in zip(out, (brand, tracks, error, back), strict=False):
                    column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays], names=schema.names)

    out = rows.mapInArrow(read, schema)
    kept = [F.col("_row").getField(c).alias(c) for c in files.columns if c not in taken]
    return out.select(*kept, *found.names)
