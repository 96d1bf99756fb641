"""Round trips, the dictionary frame, and damage that the reader must notice."""
import glob
import hashlib
import struct

import pytest
import zstandard

from erisk.llm import warc

PAGES = "page_id long, url string, html string, digest string, kind string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_round_trip(spark, prose, tmp_path):
    big, other = prose("big", 400), prose("other", 400)
    rows = [(k, f"http://a/{k}\r\nx", big if k % 3 == 0 else f"{other} {k}" if k % 3 == 1 else "small") for k in range(60)]
    rows += [(100, None, None), (101, "é", ""), (None, "u", big), (57, "twin", big), (None, "n", "x" * 2000), (None, "n", "x" * 2000), (200, "u", prose("long", 50_000))]
    manifest = warc.write_archives(pages(spark, rows), str(tmp_path), archive_bytes=20_000)
    files = glob.glob(f"{tmp_path}/*.warc.zst")
    assert manifest.count() == len(files) > 3
    assert any(open(f, "rb").read(4) == struct.pack("<I", warc.DICTIONARY_FRAME) for f in files)     # bytes as they lie on disk
    got = warc.read_archives(manifest, payloads=True).collect()
    assert len(got) == len(rows)
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        owner = max(same, default=None)
        revisit = len(raw) >= 1000 and owner is not None and owner != k
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    flat = lambda x: sorted(map(str, x))
    assert flat(want) == flat((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(bodies[k] == (h or "") for k, _, h in rows if k in bodies)
    assert warc.read_archives(warc.listed(spark, str(tmp_path))).count() == len(rows)


def test_dictionary_frame(prose):
    records = [warc.record("response", k, "u", (prose("common", 300) + str(k)).encode(), None) for k in range(200)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_FRAME and list(warc.frames(data)) == records
    bare = data[8 + size:]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(bare))
    raw = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    assert list(warc.frames(struct.pack("<II", magic, len(raw)) + raw + bare)) == records      # a dictionary that is not compressed


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WRAC/1.1"), (b"WARC-Date", b"WARC-Dote"), (b"Content-Length: 91", b"Content-Length: 92"), (b"Content-Length: 12", b"Content-Length: 13"), (b"payload text", b"payload tixt"),
    (b"HTTP/1.1", b"HTTX/1.1"), (b"WARC-Type: response", b"WARC-Type: request!")])
def test_damage(old, new):
    whole = warc.record("response", 1, "u", b"payload text", None)
    assert warc.parsed(whole)["payload"] == b"payload text" and old in whole
    with pytest.raises((ValueError, KeyError)):
        warc.parsed(whole.replace(old, new, 1))


def test_two_records_in_a_frame_and_cut_frames():
    one = warc.record("response", 1, "u", b"x" * 50, None)
    with pytest.raises(ValueError):
        warc.parsed(one + one)
    with pytest.raises(ValueError):
        list(warc.frames(warc.archive([one])[:-9]))


def test_report_and_empty(spark, tmp_path):
    assert warc.read_archives(warc.write_archives(pages(spark, []), str(tmp_path))).count() == 0
    (tmp_path / "bad.warc.zst").write_bytes(zstandard.compress(b"nonsense"))
    listed = warc.listed(spark, str(tmp_path))
    assert "not a record" in warc.read_archives(listed, on_error="report").first()["error"]
    with pytest.raises(Exception, match="not a record"):
        warc.read_archives(listed).collect()
