"""Containers written, walked and read back: round trips, tables of every layout, and broken files."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvox.llm import media, queries


def box(kind, *parts, large=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if large else struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def numbers(layout, *values):
    return struct.pack(">" + layout, *values)


def track(handler, codec, sizes, chunks, starts, deltas, sync=None, version=0, wide=False, packed=0):
    """A trak box with every table written out; chunks: samples in each; starts: of the chunks."""
    runs = [(i + 1, n) for i, n in enumerate(chunks) if i == 0 or chunks[i - 1] != n]
    if packed == 4:
        bits = [a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False)]
        table = full(b"stz2", bytes([0, 0, 0, 4]), numbers("I", len(sizes)), bytes(bits))
    elif packed:
        table = full(b"stz2", bytes([0, 0, 0, packed]), numbers("I", len(sizes)), numbers(f"{len(sizes)}{'B' if packed == 8 else 'H'}", *sizes))
    else:
        table = full(b"stsz", numbers("II", 0, len(sizes)), numbers(f"{len(sizes)}I", *sizes))
    entry = bytes(6) + b"\0\1" + (bytes(16) + numbers("HH", 64, 48) + bytes(50) if handler == b"vide" else bytes(8) + numbers("HH", 2, 16) + bytes(8))
    stbl = box(
        b"stbl",
        full(b"stsd", numbers("I", 1), box(codec, entry)),
        full(b"stts", numbers("I", len(deltas)), *(numbers("II", *d) for d in deltas)),
        *([full(b"stss", numbers("I", len(sync)), numbers(f"{len(sync)}I", *sync))] if sync is not None else []),
        full(b"stsc", numbers("I", len(runs)), *(numbers("III", a, n, 1) for a, n in runs)),
        table,
        full(b"co64" if wide else b"stco", numbers("I", len(starts)), numbers(f"{len(starts)}{'Q' if wide else 'I'}", *starts)),
    )
    total = sum(n * d for n, d in deltas)
    clock = numbers("QQIQI", 0, 0, 90_000, total, 0) if version else numbers("IIIII", 0, 0, 90_000, total, 0)
    head = numbers("QQIIQ", 0, 0, 7, 0, total) if version else numbers("IIIII", 0, 0, 7, 0, total)
    return box(b"trak", full(b"tkhd", head, bytes(60), version=version), box(b"edts", full(b"elst", bytes(4))), box(b"mdia", full(b"mdhd", clock, version=version), full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", stbl)))


def test_tables_of_every_layout():
    sizes, chunks = [3, 5, 1, 9, 15, 2, 8], [3, 3, 1]
    payload = bytes(range(1, 44))
    spans = [payload[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(7)]
    # chunks stand in another order than in the track, with a gap
    laid = spans[6] + b"gap" + b"".join(spans[:3]) + b"".join(spans[3:6])
    ftyp = box(b"ftyp", b"mp42", bytes(4))
    mdat = box(b"mdat", laid)
    starts = [len(ftyp) + 8 + 8 + 3, len(ftyp) + 8 + 8 + 3 + 9, len(ftyp) + 8]
    deltas = [(4, 10), (3, 20)]
    for options in ({}, {"wide": True}, {"version": 1}, {"packed": 4}, {"packed": 8}, {"packed": 16}):
        traks = [track(b"vide", b"avc1", sizes, chunks, starts, deltas, [1, 4, 7], **options), track(b"soun", b"mp4a", sizes, chunks, starts, deltas)]
        for data in (ftyp + mdat + box(b"moov", *traks), ftyp + mdat + box(b"free") + box(b"moov", *traks, large=True), ftyp + mdat + b"\0\0\0\0moov" + b"".join(traks)):
            brand, (video, sound) = media.read_tracks(memoryview(data))
            assert (brand, video["codec"], video["track_id"], video["width"], video["height"], video["timescale"], video["duration"]) == ("mp42", "avc1", 7, 64, 48, 90_000, 100)
            assert [(k["sample"], k["time"], data[k["start"] : k["start"] + k["length"]]) for k in video["keyframes"]] == [(0, 0, spans[0]), (3, 30, spans[3]), (6, 80, spans[6])]
            assert (sound["channels"], sound["sample_bits"], sound["width"], len(sound["keyframes"])) == (2, 16, None, 7)
            assert media.read_samples(memoryview(data), *video["at"]) == payload


def broken_files():
    good = box(b"ftyp", b"mp42", bytes(4)) + box(b"mdat", b"abcdef") + box(b"moov", track(b"vide", b"avc1", [2, 4], [2], [24], [(2, 1)]))
    swap = lambda a, b: good.replace(a, b)
    return [
        b"not a container", b"\0\0\0\x05free", good[:-1], good[:60], swap(numbers("II", 0, 2) + numbers("II", 2, 4), numbers("II", 0, 2) + numbers("II", 2, 40_000)),
        swap(b"stts", b"xxxx"), swap(b"moov", b"free"), good + b"\0\0", swap(numbers("II", 0, 2), numbers("II", 1, 0xFFFFFFFF)),
    ]


def test_every_prefix_is_read_or_told_wrong():
    data = box(b"ftyp", b"mp42", bytes(4)) + box(b"mdat", b"abcdef") + box(b"moov", track(b"vide", b"avc1", [2, 4], [1, 1], [24, 26], [(2, 1)], [1]))
    for stop in range(len(data)):
        with pytest.raises(media.BadMedia):
            media.read_tracks(memoryview(data[:stop]))
    rng = np.random.default_rng(1)
    for _ in range(3000):  # any byte may be wrong
        bad = bytearray(data)
        bad[rng.integers(len(bad))] = rng.integers(256)
        try:
            _, tracks = media.read_tracks(memoryview(bytes(bad)))
            [media.read_samples(memoryview(bytes(bad)), *t["at"]) for t in tracks]
        except media.BadMedia:
            pass


def test_media_columns(spark):
    files = [(i, b, None) for i, b in enumerate(broken_files())] + [(90, None, None), (90, None, None), (91, b"", None)]
    df = spark.createDataFrame(files, "id long, media binary, error string").withColumn("a.b", F.col("id"))
    rows = media.media_columns(df, payload=True).collect()
    assert len(rows) == len(files) and all(r.tracks is None and r.payload is None and r["a.b"] == r.id for r in rows)
    assert [r.error is None for r in sorted(rows, key=lambda r: r.id)] == [False] * 9 + [True, True, False]
    assert media.media_columns(df.limit(0)).count() == 0
    assert media.media_columns(df).columns == ["id", "a.b", "brand", "tracks", "error"]


def test_payload_is_not_read(spark):
    df = spark.createDataFrame([("a" * 5000,), ("b" * 5000,)], "text string")
    seen = media.media_columns(media.text_media(df)).select("brand", "tracks", "error").distinct().collect()
    assert len(seen) == 1 and seen[0].error is None


def test_query(spark, tmp_path):
    texts = [None, "", " ", "x", "é" * 96, "a" * 191, "a" * 192, "a" * 193, "a" * 1535, "b" * 1536, "b" * 1537, "c" * 3072, "日本語 " * 40_000, "same", "same", "tail " + " " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_media_columns(spark, str(tmp_path)).collect()
    by_text = {}
    want = []
    for i, t in rows:
        body = (t or "").encode()
        payload = body + b" " * (192 if not body else -len(body) % 192)
        want.append((i, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        frames = r.payload_bytes // 192
        chunks = -(-frames // 8)
        assert r.feature.startswith(f"raw 16x12 {frames}/25s {chunks} of {frames} key ") and r.feature.count("+192") == chunks
        assert by_text.setdefault(r.payload_sha256 + str(r.n_bytes), tuple(r)[1:]) == tuple(r)[1:]
    files = media.text_media(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("media", F.sha2("media", 256).alias("sha"), F.octet_length("media").alias("size")).collect()
    assert {(hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in files} == {(r.sha, r.size) for r in files} == {(r.media_sha256, r.media_bytes) for r in got}
    top = media.tree(memoryview(bytes(files[0].media)), 0, len(files[0].media))
    assert list(top) == [b"ftyp", b"moov", b"mdat"]
