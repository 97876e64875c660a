"""Mail files, attachments, safe HTML, and streams."""

import io
import zipfile
from datetime import datetime, timedelta
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postrider.operators import archive
from postrider.sources import extract, mail
from postrider.streaming import feed


def eml(i, subject="Grüße", attach=True):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-Id"] = "Ann <ann@x.org>", "b@y.org, C <c@z.org>", subject, f"<m{i}@x>"
    m["Date"] = "Mon, 01 Jan 2024 10:00:00 +0200"
    m.set_content(f"body {i}\nFrom the start\n")
    m.add_alternative("<p>html</p>", subtype="html")
    if attach:
        m.add_attachment(b"data", maintype="application", subtype="pdf", filename="a.pdf")
    return m.as_bytes()


def test_mbox(spark, tmp_path):
    raw = [eml(i) for i in range(5)]
    path = tmp_path / "Work.mbox"
    path.write_bytes(b"".join(b"From ann@x.org Mon Jan  1 10:00:0%d 2024\n" % i + r.replace(b"\nFrom ", b"\n>From ") + b"\n" for i, r in enumerate(raw)))
    got = mail.parse(mail.mbox(spark, str(path))).orderBy("internet_id").collect()
    assert [r.internet_id for r in got] == [f"<m{i}@x>" for i in range(5)] and {r.mailbox for r in got} == {"Work"}
    r = got[3]
    assert r.subject == "Grüße" and r.from_addr == "ann@x.org" and r.from_name == "Ann" and r.to_addrs == ["b@y.org", "c@z.org"]
    assert r.body_text.replace("\r\n", "\n") == "body 3\nFrom the start\n" and "html" in r.body_html and r.attachments[0].filename == "a.pdf" and r.error is None
    assert r.received_at == datetime(2024, 1, 1, 10, 0, 3) and r.date_sent == datetime(2024, 1, 1, 8)


def test_mbox_keeps_bytes(spark, tmp_path):
    raw = b"Subject: x\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9 \xff\x00\n>From here\n"
    path = tmp_path / "Latin.mbox"
    path.write_bytes(b"From a@b.c Mon Jan  1 10:00:00 2024\n" + raw.replace(b">From", b">>From") + b"\nFrom a@b.c Mon Jan  1 10:00:01 2024\n" + raw)
    got = [bytes(r.raw) for r in mail.mbox(spark, str(path)).orderBy("received_at").collect()]
    assert got[0].rstrip(b"\n") == raw.rstrip(b"\n") and b"caf\xe9 \xff\x00" in got[1]
    parsed = mail.parse(mail.mbox(spark, str(path))).collect()
    assert all(r.body_text.startswith("caf\u00e9") for r in parsed)


def test_maildir_and_quarantine(spark, tmp_path):
    for folder, n in (("cur", 1), (".Work/new", 2)):
        (tmp_path / folder).mkdir(parents=True)
        for i in range(n):
            (tmp_path / folder / f"{i}").write_bytes(eml(i, attach=False))
    (tmp_path / "tmp").mkdir()
    (tmp_path / "tmp" / "x").write_bytes(b"half")
    got = mail.maildir(spark, str(tmp_path))
    assert sorted(r.mailbox for r in got.collect()) == ["INBOX", "Work", "Work"]
    broken = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(b"Subject: =?x?q?=\nDate: never\n\n\xff\0"))], "id long, raw binary")
    rows = {r.id: r for r in mail.parse(broken).collect()}
    assert len(rows) == 3 and rows[3].date_sent is None and rows[1].size_bytes == 0


def test_headers_and_ids():
    assert mail.header_list(b"A: 1\r\n folded\r\nB: 2\r\nA: 3\r\n\r\nC: no") == [{"name": "A", "value": "1 folded"}, {"name": "B", "value": "2"}, {"name": "A", "value": "3"}]
    assert mail.message_id(" <a> ") == "<a>" and mail.message_id("< >") is None and mail.message_id(None) is None
    assert mail.header_date("nonsense") is None and mail.header_date("1 Jan 2024 00:00:00").tzinfo is not None


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_extraction(spark):
    w = "xmlns:w='u'"
    files = {
        "a.txt": (b"\xefplain", "ïplain"), "b.csv": (b"x,y\n1,2", "x | y\n1 | 2"), "c.html": (b"<p>a<script>b</script></p>c", "a\nc"),
        "d.docx": (zipped(word__document_xml=f"<w:d {w}><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:d>"), "one two\nthree"),
        "e.pptx": (zipped(ppt__slides__slide1_xml=f"<w:d {w}><w:p><w:t>s1</w:t></w:p></w:d>", ppt__slides__slide10_xml=f"<w:d {w}><w:p><w:t>s10</w:t></w:p></w:d>", ppt__slides__slide2_xml=f"<w:d {w}><w:p><w:t>s2</w:t></w:p></w:d>"), "s1\ns2\ns10"),
        "f.odt": (zipped(content_xml=f"<w:d {w}><w:p>odt <w:span>text</w:span></w:p></w:d>"), "odt text"),
        "g.rtf": (rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par w\'f6rld}", "Hello\nwörld"), "h.ics": (b"BEGIN:VEVENT\nSUMMARY:Meet\n ing\nEND:VEVENT", "Summary: Meeting"),
    }
    rows = [(bytearray(data), None, name) for name, (data, _) in files.items()] + [(bytearray(b"PK"), None, "bad.docx"), (bytearray(b"x"), "image/png", "i.png"), (bytearray(b" "), "text/plain", "e"), (bytearray(b"%PDF"), None, "p.pdf"), (bytearray(b"y" * 100), None, "big.txt"), (None, None, None)]
    got = {r.filename: r for r in extract.extract_text(spark.createDataFrame(rows, "content binary, mime_type string, filename string"), max_bytes=99).collect() if r.filename not in ("d.docx", "e.pptx", "f.odt")}
    got |= {r.filename: r for r in extract.extract_text(spark.createDataFrame(rows, "content binary, mime_type string, filename string")).collect() if r.filename in ("d.docx", "e.pptx", "f.odt")}
    for name, (_, want) in files.items():
        assert (got[name].status, got[name].extracted) == ("extracted", want), name
    assert {n: got[n].status for n in ("bad.docx", "i.png", "e", "p.pdf", "big.txt")} == {"bad.docx": "failed", "i.png": "type-skipped", "e": "empty", "p.pdf": "unsupported", "big.txt": "size-skipped"}


def test_safe_html(spark):
    page = '<div onclick=x><a href="java\nscript:alert(1)" title="t">k</a><a href="https://a.b/?x=1&y">l</a><img src="cid:p"><img src="http://e/x.png"><script>bad()</script><b>1 < 2</b><br/></div>'
    assert extract.sanitize(page, {"p": "/blob/1"}) == '<div><a title="t" rel="noopener noreferrer">k</a><a href="https://a.b/?x=1&amp;y" rel="noopener noreferrer">l</a><img src="/blob/1"><img><b>1 &lt; 2</b><br></div>'
    assert 'src="http://e/x.png"' in extract.sanitize(page, {}, True)
    frame = spark.createDataFrame([("<i>x</i><style>y</style>",), (None,)], "p string").select(extract.sanitized(F.col("p")).alias("s"))
    assert [r.s for r in frame.collect()] == ["<i>x</i>", None]


def test_blob_store_writes_once(spark, tmp_path):
    files = spark.createDataFrame([("ab1", bytearray(b"x")), ("ab1", bytearray(b"x")), ("cd2", bytearray(b"y"))], "sha256 string, content binary")
    for _ in range(2):
        mail.store_blobs(files, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    now = datetime(2024, 1, 1)
    schema = "message_id long, account_id long, date_received timestamp_ntz"
    rows = [(i, i % 3, now + timedelta(seconds=i)) for i in range(100)]
    src, log, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    for k in range(3):
        part = rows[k * 30 : k * 30 + 40]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = feed.arriving(spark, src, spark.createDataFrame([], schema).schema, 1)
        feed.append_to_log(stream, log, ck, ["message_id"]).awaitTermination()
    got = feed.poll(spark, log, 50, now + timedelta(seconds=80), horizon_s=5, allowed=[0, 1])

    want = archive.changes(spark.createDataFrame(rows, schema), 50, now + timedelta(seconds=80), 5, [0, 1])
    assert [r.message_id for r in got.collect()] == [r.message_id for r in want.collect()] and spark.read.parquet(log).count() == 100
    acks = spark.createDataFrame([], "user_id long, name string, cursor long")
    acks = feed.subscribe(acks, 1, "s", 40)
    acks = feed.acknowledge(feed.subscribe(acks, 1, "s", 99), 1, "s", 60, 99)
    assert archive.acknowledged(acks, 99).first().cursor == 60
    for call in (feed.subscribe, lambda *a, **k: feed.acknowledge(*a, 99, **k)):
        for name in ("", "a b", "x" * 65, "s\n", "new"):
            with pytest.raises(ValueError, match="at most 1" if name == "new" else "name"):
                call(acks, 1, name, 5, **({"most": 1} if name == "new" else {}))
        assert call(acks, 1, "s", 5).count() >= 2


def test_a_user_has_a_bounded_number_of_subscriptions(spark):
    log = [(1, "a", 5, 1), (1, "b", 90, 2), (1, "b", 7, 3), (1, "c", 9, 4), (1, "a", 8, 9), (2, "c", 1, 1), (2, "no name", 1, 1), (2, None, 1, 1), (None, "a", 4, None), (1, "d", None, 1)]
    acks = spark.createDataFrame(log, "user_id int, name string, cursor long, at int").repartition(3)
    got = lambda most: sorted((r.user_id or 0, r.name, r.cursor) for r in archive.subscriptions(acks, 50, "at", most).collect())
    assert got(2) == [(0, "a", 4), (1, "a", 8), (1, "b", 7), (2, "c", 1)]
    assert got(1) == [(0, "a", 4), (1, "a", 8), (2, "c", 1)] and len(got(32)) == 5
    assert archive.subscriptions(acks.limit(0), 50, "at").count() == 0
