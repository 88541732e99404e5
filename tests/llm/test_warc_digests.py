"""What the reader says of a record comes from the body it read, not from its headers."""

import hashlib
import zlib

from tillcast.llm import warc


def rewritten(path, to, change):
    """Every member of the archives, unpacked, changed and packed again into the folder ``to``."""
    to.mkdir()
    for f in path.glob("part-*"):
        data, out = f.read_bytes(), []
        while data:
            z = zlib.decompressobj(31)
            body, data = z.decompress(data), z.unused_data
            if not z.eof:
                break
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(c.compress(change(body)) + c.flush())
        (to / f.name).write_bytes(b"".join(out))


def test_tampered_bodies(spark, tmp_path):
    text = "payload " * 200
    rows = [(1, "u1", "a small page"), (2, "u2", text), (3, "u3", text), (4, "u4", "another page"), (5, "u5", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = tmp_path / "w"
    warc.write(warc.records(df), str(path))
    got = {r["page_id"]: r for r in warc.resolved(warc.read(spark, str(path), payloads=False).drop("payload")).collect()}
    assert all(r["verified"] for r in got.values()) and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 3
    assert got[2]["payload_bytes"] == len(text) and got[2]["payload_digest"] == hashlib.sha1(text.encode()).hexdigest()

    rewritten(path, tmp_path / "t", lambda m: m.replace(b"a small page", b"A SMALL PAGE").replace(b"payload ", b"PAYLOAD ") if b"revisit" not in m else m)
    got = {r["page_id"]: r for r in warc.resolved(warc.read(spark, str(tmp_path / "t"), payloads=False).drop("payload")).collect()}
    assert [got[k]["verified"] for k in (1, 2, 3, 4, 5)] == [False, False, False, True, True]  # the revisit's response isn't what it states
    assert got[1]["payload_digest"] == hashlib.sha1(b"A SMALL PAGE").hexdigest()
    assert got[3]["payload_digest"] == hashlib.sha1(text.upper().encode()).hexdigest() and got[3]["payload_bytes"] == len(text)


def test_repeated_page_ids(spark):
    """Rows that share the largest id of a payload are all written in full, and its revisits refer to that id."""
    text = "x" * 1500
    rows = [(7, "a", text), (7, "b", text), (6, "c", text), (None, "d", text), (7, "e", "other")]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["verified"]) for r in
                 warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == [("6", "revisit", 7, 1500, True), ("7", "response", None, 5, True), ("7", "response", None, 1500, True), ("7", "response", None, 1500, True),
                   ("None", "revisit", 7, 1500, True)]
