"""Round trip through archives, byte ranges and retries."""

import hashlib
import zipfile
import zlib

import pytest
from pyarrow import fs

from aeroscope.llm import media


def expected(text):
    data = (text or "").encode()
    size = max(1, -(-len(data) // 192)) * 192
    payload = data + b" " * (size - len(data))
    return len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media.to_sound(payload)).hexdigest()


ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 96), (5, "x" * 191 + "y"), (6, "z" * 193), (1, "abc"), (None, "id is null"), (7, "long " * 300_000), (8, "trailing   ")]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in ROWS], "doc_id bigint, text string, name string").repartition(3)
    got = media.through_archives(df).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got))) == sorted(
        map(repr, ((i, *expected(t)) for i, t in ROWS))
    )
    assert all(r.media_bytes == r.payload_bytes + 44 and r.feature for r in got)
    assert media.through_archives(df.limit(0)).count() == 0


def test_ranges_cover_each_member_once(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    df = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(500)], "doc_id bigint, text string").coalesce(2)
    assert media.write_media(df, folder) == 500
    reader = media.MediaReader(folder, 700)
    assert len(reader.partitions()) > 20
    names = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("name").to_pylist()]
    assert sorted(names) == sorted(f"={i}" for i in range(500))


def test_member_is_retried_by_offset(tmp_path):
    path = f"{tmp_path}/x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("=1", b"one" * 50)
        z.writestr("=2", b"two" * 50)
    store, calls = fs.LocalFileSystem(), []

    class Flaky:
        def open_input_file(self, p):
            calls.append(p)
            f = store.open_input_file(p)
            if len(calls) == 1:
                f.close()  # reads fail
            return f

    first, second = media.members(store, media.ByteRange(path, 0, 1 << 30))
    media._open.clear()
    assert media.read_member(Flaky(), path, second) == b"two" * 50
    assert len(calls) == 2
    second.CRC ^= 1
    with pytest.raises(zipfile.BadZipFile):
        media.read_member(store, path, second)
    assert media.read_member(store, path, first) == b"one" * 50


def test_an_archive_ends_at_its_members(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_MEMBERS", 3)
    writer = media.ArchiveWriter(f"file://{tmp_path}", 0)
    found = []
    for i in range(7):
        writer.add(f"={i}", "1", b"x")
        if writer.full():
            found.append(writer.close())
    found.append(writer.close())
    assert [n for _, n in found] == [3, 3, 1] and len({p for p, _ in found}) == 3
