"""Reports, image headers, frames, stores and index versions on made inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from folioscan.operators import index
from folioscan.sources import frames, images, reports, store

GOOD = "<report><report_id>{0}</report_id><study_instance_uid>1.2</study_instance_uid><patient><patient_id>P1</patient_id><sex>M</sex></patient><exam><modality>CT</modality></exam><diagnosis><conclusion>肺结节</conclusion>{1}</diagnosis></report>"


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.xml": GOOD.format("R1", "<description>右肺</description>"), "b.xml": GOOD.format("R1", ""), "c.xml": GOOD.format("R2", ""), "d.xml": "not xml", "e.xml": GOOD.format("", ""), "f.xml": GOOD.format("R3", "").replace("<conclusion>肺结节</conclusion>", ""),
        "g.xml": GOOD.format("R4", "").replace("<patient_id>P1</patient_id>", ""), "h.xml": "<other><report_id>R5</report_id></other>", "skip.txt": GOOD.format("R9", ""),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_reports(spark, folder):
    files = reports.read_files(spark, folder)
    records, rejects = reports.parse(files)
    assert {r.file: r.reason for r in rejects.collect()} == {"d.xml": "not well-formed", "e.xml": "no report_id", "f.xml": "no conclusion", "g.xml": "no patient_id", "h.xml": "no report element"}
    kept = {r.report_id: (r.file, r.description) for r in reports.unique_reports(records).collect()}
    assert kept == {"R1": ("a.xml", "右肺"), "R2": ("c.xml", "")}
    assert tuple(reports.build_counts(files).first()) == (2, 1, 5)


def element(tag, vr, value, explicit=True):
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<HH", *tag)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + vr + (b"\0\0" + struct.pack("<I", len(value)) if vr in images.LONG else struct.pack("<H", len(value))) + value


def image(syntax=images.EXPLICIT, explicit=True, leave_out=(), extra=b"", number=b"7"):
    fields = [((0x0008, 0x0016), b"UI", b"1.1"), ((0x0008, 0x0018), b"UI", b"1.2.3"), ((0x0010, 0x0010), b"PN", b"Doe "), ((0x0010, 0x0020), b"LO", b"P1"), ((0x0020, 0x000D), b"UI", b"1.2"), ((0x0020, 0x000E), b"UI", b"1.2.9"), ((0x0020, 0x0013), b"IS", number)]
    meta = element((0x0002, 0x0010), b"UI", syntax.encode()) if syntax else b""
    body = b"".join(element(t, v, x, explicit) for t, v, x in fields if t not in leave_out)
    return b"\0" * 128 + b"DICM" + meta + extra + body + element(images.PIXELS, b"OW", b"\1" * 40, explicit)


NESTED = struct.pack("<HH", 0x0008, 0x1140) + b"SQ\0\0" + b"\xff" * 4 + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element((0x0010, 0x0010), b"PN", b"Leak") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
CASES = {
    "ok_explicit": (image(), "OK"), "ok_implicit": (image(images.IMPLICIT, False), "OK"), "ok_jpeg": (image("1.2.840.10008.1.2.4.50"), "OK"), "nested": (image(extra=NESTED), "OK"), "truncated": (image()[:200], "TRUNCATED"), "not_dicom": (b"x" * 224, "NOT_DICOM"),
    "bigendian": (image("1.2.840.10008.1.2.2"), "UNSUPPORTED_TS"), "missing": (image(leave_out=[(0x0020, 0x000E)]), "MISSING_REQUIRED"), "no_syntax": (image(""), "BAD_FORMAT"), "cut_in_pixels": (image()[:-10], "OK"), "empty": (b"", "NOT_DICOM"),
}


@pytest.mark.parametrize("name", CASES)
def test_image_outcomes(name):
    data, outcome = CASES[name]
    got = images.read_metadata(data)
    assert got["outcome"] == outcome
    if outcome == "OK":
        assert (got["patient_name"], got["sop_instance_uid"], got["instance_number"], got["series_number"]) == ("Doe", "1.2.3", 7, -1)


def test_images_read(spark, tmp_path):
    import hashlib

    cases = {n: c for n, c in CASES.items() if c[0]}  # Spark lists no empty file
    for name, (data, _) in cases.items():
        (tmp_path / f"{name}.dcm").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in images.read_images(spark, str(tmp_path)).select("path", "file_size", "sha256", "meta.*").collect()}
    assert {n: r.outcome for n, r in got.items()} == {n: o for n, (_, o) in cases.items()}
    assert all(r.sha256 == hashlib.sha256(CASES[n][0]).hexdigest() for n, r in got.items())


def test_frames(spark):
    two = frames.encode(1, "肺".encode()) + frames.encode(2, b"")
    d = frames.Decoder()
    got = [f for i in range(len(two)) for f in d.feed(two[i : i + 1])]
    assert got == [(1, 0, "肺".encode()), (2, 0, b"")] and d.held == b""
    bad = frames.Decoder()
    assert bad.feed(frames.encode(0x99, b"x")) == [] and bad.status == "BAD_TYPE"
    long = frames.Decoder()
    long.feed(struct.pack(">BBI", 1, 0, (1 << 20) + 1))
    assert long.status == "TOO_LONG"
    df = spark.createDataFrame([(1, two), (2, two[:8]), (3, None), (4, frames.encode(0x99, b""))], "id int, data binary")
    rows = sorted((r.id, r.seq, r.status) for r in frames.decoded(df).collect() if r.seq is not None)
    assert rows == [(1, 0, "OK"), (1, 1, "OK"), (2, 0, "PARTIAL"), (4, 0, "BAD_TYPE")]
    made = spark.createDataFrame([(17, b"abc")], "k int, p binary").select(frames.encoded(F.col("k"), F.col("p"))).first()[0]
    assert bytes(made) == frames.encode(17, b"abc")


def test_store(spark, tmp_path):
    where = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "doc_id long, text string")
    with pytest.raises(FileNotFoundError):
        store.load(spark, where, "postings")
    assert store.publish(spark, where, {"postings": index.build(docs, {"text": 1}), "docs": docs}) == 1
    assert store.publish(spark, where, {"docs": docs.limit(1)}) == 2
    (tmp_path / "index" / "v3").mkdir()  # begun, not published
    assert store.versions(spark, where) == [1, 2]
    assert store.load(spark, where, "docs").count() == 1 and store.load(spark, where, "postings", 1).count() == 4
    assert store.publish(spark, where, {"docs": docs}) == 4
    for text in ("a\tb\n\\n", "", "\\"):
        assert store.unescaped(store.escaped(text)) == text


def test_dictionaries(spark, tmp_path):
    from folioscan.operators import segment
    from folioscan.sources import dictionaries

    (tmp_path / "d").write_text("南京 5 ns\n长江 4 ns\n坏行\n")
    (tmp_path / "u1").write_text("云计算\n")
    (tmp_path / "u2").write_text("蓝翔 nz\n")
    (tmp_path / "h").write_text("#start\n-0.1 -50 -50 -2\n" + "-50 0 -3 -50\n-0.5 -50 -50 -1\n-50 -0.2 -2 -50\n-0.5 -50 -50 -1\n" + "你:-1,世:-1\n好:-1,界:-1\n无:-9\n的:-1\n")
    d = dictionaries.load_dictionary(spark, str(tmp_path / "d"), f"{tmp_path}/u1|{tmp_path}/u2", "max", str(tmp_path / "h"))
    assert d.tags["蓝翔"] == "nz" and "云计算" in d.user and segment.segment("你好的世界南京", d) == ["你好", "的", "世界", "南京"]
    (tmp_path / "i").write_text("肺 2.0\n骨 4.0\nbad\n")
    known, default = dictionaries.idf_table(spark, str(tmp_path / "i"))
    assert {r.term: r.idf for r in known.collect()} == {"肺": 2.0, "骨": 4.0} and default == 2.0
    (tmp_path / "s").write_text("的\n\n了\n的\n")
    assert dictionaries.stop_words(spark, str(tmp_path / "s")) == ["了", "的"]


def test_images_by_ranges(spark, tmp_path):
    """Headers without the pixels behind them; with the digest a file is read through, piece by piece."""
    import hashlib

    pixels = b"\2" * 3_000_000
    files = {f"{k}.dcm": image(extra=element((0x0009, 0x0010), b"UN", b"z" * k * 20_000)) + pixels for k in range(5)} | {"short.dcm": image()[:200], "none.dcm": b"", "_hidden": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_ranges(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"_hidden"} and all(r.file_size == len(files[n]) and r.sha256 is None for n, r in got.items())
    assert all(got[f"{k}.dcm"].bytes_read <= 4 * images.BLOCK and got[f"{k}.dcm"].meta.outcome == "OK" and got[f"{k}.dcm"].meta.patient_id == "P1" for k in range(5))
    assert got["short.dcm"].meta.outcome == "TRUNCATED" and got["none.dcm"].meta.outcome == "NOT_DICOM"
    whole = {r.path.rsplit("/", 1)[1]: r.sha256 for r in images.read_images(spark, f"file:{tmp_path}", most_bytes=3_050_000).collect()}
    assert whole == {n: hashlib.sha256(files[n]).hexdigest() for n in set(files) - {"_hidden"} if len(files[n]) <= 3_050_000}
    for name, data in files.items():
        class Counted:
            def __init__(self):
                self.at = 0

            def seek(self, at):
                self.at = at

            def read(self, n):
                return data[self.at : self.at + n]

        assert images.read_metadata(images.Ranges(Counted(), len(data), 16)) == images.read_metadata(data)
