import base64
import io
import zipfile

from builders import PNG, docx, eml, package_of
from pyspark.sql import functions as F

from caseloom.sources import archives
from caseloom.sources.archives import expand_packages, good_files, ingest_errors, read_packages
from caseloom.sources.documents import document_text, extract_contents
from caseloom.sources.emails import explode_attachments
from caseloom.operators.route import lineage


def binary(spark, rows, schema="file_id string, reader string, content binary"):
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], schema)


def test_document_text(spark):
    link = '<w:p><w:hyperlink><w:r><w:t>link</w:t><w:tab/><w:t>end</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    rows = [
        ("d1", "docx", docx(" First", "", "Second ", extra=link)), ("d2", "docx", b"broken"), ("d3", "docx", None),
        ("e1", "eml", eml("  Plain body\n\n", html="<b>rich</b>").as_bytes()), ("e2", "eml", eml(None, html="<p>rich &amp; <b>bold</b></p>").as_bytes()),
        ("e3", "eml", b""), ("e4", "eml", eml("für Jörg  ").as_bytes()), ("x", "pdf", b"%PDF"),
    ]
    frame = binary(spark, rows).select("file_id", document_text(F.col("reader"), F.col("content")).alias("t"))
    assert {r.file_id: r.t for r in frame.collect()} == {
        "d1": "First\nSecond \nlink\tend", "d2": "", "d3": "", "e1": "Plain body", "e2": "rich &amp;  bold", "e3": "", "e4": "für Jörg", "x": None}


def test_attachments_to_any_depth(spark):
    deep = eml("c", attachments=[("x.png", PNG)])
    mid = eml("b", attachments=[("deep.eml", deep.as_bytes()), ("../a b.txt", b"t")])
    top = eml("a", attachments=[("", b"n"), (None, mid), ("mid.eml", mid.as_bytes())])
    got = {r.trail: (r.file_name, r.depth, r.via, bytes(r.content)[:4]) for r in explode_attachments(
        binary(spark, [("1", "eml", top.as_bytes()), ("2", "eml", b"junk")]), ["file_id"]).collect()}
    assert got["0"][0] == "attachment_0" and got["1"][2] == "rfc822" and got["2"][0] == "mid.eml"
    assert got["2.0.0"] == ("x.png", 3, "attachment", PNG[:4]) and got["1.0.0"][0] == "x.png" and got["2.1"][0] == "a_b.txt"
    assert len(got) == 9


def test_packages(spark, monkeypatch):
    inner = eml("inner", attachments=[("pic.jpeg", PNG), ("pic.jpeg", b"2")])
    outer = eml("outer", attachments=[("pic.jpeg", b"1"), ("in.eml", inner.as_bytes())])
    data = package_of({"z.txt": b"z", "dir/": b"", "dir/m.eml": outer.as_bytes(), "a.eml": eml("solo", attachments=[("pic.jpeg", b"0")]).as_bytes()})
    frame = binary(spark, [("p", data), ("bad", b"no"), ("empty", package_of({}))], "package_id string, content binary")
    for keep in (64 << 20, 0):
        monkeypatch.setattr(archives, "KEEP_BYTES", keep)
        files = expand_packages(frame)
        rows = good_files(files).orderBy("ord").collect()
        assert [(r.ord, r.depth, r.path, r.parent_id) for r in rows] == [
            (0, 0, "a.eml", None), (1, 0, "dir/m.eml", None), (2, 0, "z.txt", None), (3, 1, "pic.jpeg", "p#0"), (4, 1, "pic_1.jpeg", "p#1"),
            (5, 1, "in.eml", "p#1"), (6, 2, "pic_2.jpeg", "p#5"), (7, 2, "pic_3.jpeg", "p#5")]
        assert [bytes(r.content) for r in rows[6:]] == [PNG, b"2"]
        assert [r.package_id for r in ingest_errors(files).collect()] == ["bad"]
    assert {(r.file_name, r.parent_name) for r in lineage(good_files(files)).collect()} == {
        ("pic.jpeg", "a.eml"), ("pic_1.jpeg", "m.eml"), ("in.eml", "m.eml"), ("pic_2.jpeg", "in.eml"), ("pic_3.jpeg", "in.eml")}


def test_bad_member_fails_its_package_only(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", "first")
        z.writestr("b.txt", "SECOND-MEMBER")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "broken.zip").write_bytes(out.getvalue().replace(b"SECOND-MEMBER", b"SECOND-MEMBEX", 1))
    (tmp_path / "fine.ZIP").write_bytes(package_of({"a.txt": b"1"}))
    (tmp_path / "fine.zip").write_bytes(package_of({"a.txt": b"1"}))
    files = read_packages(spark, str(tmp_path))
    assert sorted((r.package_id, r.file_name) for r in good_files(files).collect()) == [("fine", "a.txt"), ("fine.ZIP", "a.txt")]
    assert [r.package_id for r in ingest_errors(files).collect()] == ["x/broken"]


def test_extract_contents(spark):
    names = ["a.PNG", "empty.png", "lost.jpg", "pic.gif", "t.txt", "doc.docx", "m.eml", "p.pdf", "q.pdf", ".eml"]
    data = {"a.PNG": PNG, "empty.png": b"", "lost.jpg": None, "doc.docx": docx("x"), "m.eml": eml("body").as_bytes()}
    rows = [(n, data.get(n, b"bytes")) for n in names]
    from caseloom.functions.text import extension
    files = binary(spark, rows, "file_id string, content binary").withColumn("ext", extension(F.col("file_id"))).withColumn(
        "length", F.coalesce(F.length("content"), F.lit(9)).cast("long"))
    pages = spark.createDataFrame([("p.pdf", 1, "one", None), ("p.pdf", 2, None, "bad"), ("p.pdf", 3, "three", None)],
                                  "file_id string, page_no int, text string, error string")
    got = {r.file_id: r for r in extract_contents(files, pages).collect()}
    assert {n: r.kind for n, r in got.items()} == {
        "a.PNG": "image", "empty.png": "unsupported", "lost.jpg": "unsupported", "pic.gif": "unsupported", "t.txt": "unsupported",
        "doc.docx": "text", "m.eml": "text", "p.pdf": "text", "q.pdf": "text", ".eml": "unsupported"}
    assert got["a.PNG"].image_base64 == base64.b64encode(PNG).decode() and got["a.PNG"].media_type == "image/png"
    assert got["p.pdf"].text == "one\nthree" and got["q.pdf"].text == "" and got["doc.docx"].text == "x" and got["m.eml"].text == "body"
    assert got["t.txt"].text is None and {r.text for r in extract_contents(files).filter("file_id = 'p.pdf'").collect()} == {""}


def test_attachments_of_any_depth(spark):
    from caseloom.sources.archives import expand_packages

    mail = eml("deepest")
    for i in range(20):
        mail = eml(f"level {i}", attachments=[("inner.eml", mail.as_bytes())])
    packages = spark.createDataFrame([("p", bytearray(package_of({"mail.eml": mail.as_bytes()})))], "package_id string, content binary")
    rows = expand_packages(packages).collect()
    assert len(rows) == 21 and max(r.depth for r in rows) == 20


def test_listed_archives_are_dealt_over_tasks(spark):
    """Also a list that lies in one partition."""
    from caseloom.sources.archives import dealt

    rows = spark.createDataFrame([(f"p{i}", f"/x/{i}.zip", 10) for i in range(40)], "package_id string, path string, length long").coalesce(1)
    spread = dealt(rows).groupBy(F.spark_partition_id()).count().count()
    assert spread > 4 and dealt(rows.limit(0)).count() == 0
