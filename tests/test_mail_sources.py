"""Mbox files as a data source, whole header blocks, and mails with attached mails, odd headers and no bodies."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postrider.operators import shapes
from postrider.sources import extract, mail, mboxes


def message(i, size=200):
    return b"Subject: s%d\nX-Long: %s\n\nbody %d\nFrom within\n>From quoted\n" % (i, b"y" * (i % 7 * 11), i) + b"x" * (i * 37 % size) + b"\n\nend"


def write(path, n, size=200):
    quoted = lambda r: r.replace(b"\n>From", b"\n>>From").replace(b"\nFrom", b"\n>From")
    path.write_bytes(b"".join(b"From a@b.c Mon Jan  1 10:%02d:00 2024\n" % (i % 60) + quoted(message(i, size)) + b"\n" for i in range(n)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("boxes")
    for name, n in (("Inbox.mbox", 60), ("Work", 3), ("Empty", 0)):
        write(path / name, n)
    return path


@pytest.mark.parametrize("range_bytes", [1 << 20, 900])
def test_ranges_give_every_message_once(spark, folder, range_bytes):
    got = mboxes.read(spark, str(folder), range_bytes=range_bytes)
    if range_bytes < 1000:
        assert len(mboxes.MboxReader({"path": str(folder), "rangeBytes": str(range_bytes)}).partitions()) > 10
    rows = sorted((r.mailbox, r.position, bytes(r.raw)) for r in got.collect())
    assert [raw.rstrip(b"\n") for box, _, raw in rows if box == "Inbox"] == [message(i) for i in range(60)]
    assert sum(box == "Work" for box, _, _ in rows) == 3 and len(rows) == 63
    plain = mail.mbox(spark, str(folder / "Inbox.mbox"))
    assert sorted((bytes(r.raw).rstrip(b"\n"), r.received_at) for r in plain.collect()) == sorted((bytes(r.raw).rstrip(b"\n"), r.received_at) for r in got.filter("mailbox = 'Inbox'").collect())


def test_reads_cross_blocks(spark, folder, monkeypatch):
    from io import BytesIO

    data = (folder / "Inbox.mbox").read_bytes()
    for block in (1, 3, 7, 1000):
        monkeypatch.setattr(mboxes, "READ_BYTES", block)
        for cut in (1, 5, 300, 301, len(data) // 2):
            parts = [list(mboxes._messages(BytesIO(data), low, min(low + cut, len(data)), len(data))) for low in range(0, len(data), cut)][: 40 if cut < 10 else None]
            found = [m for p in parts for m in p]
            assert found == [m for m in mboxes._messages(BytesIO(data), 0, len(data), len(data)) if m[0] < (40 * cut if cut < 10 else len(data))]


def test_filters_choose_files(spark, folder):
    reader = mboxes.MboxReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("mailbox",), "Work"), GreaterThan(("position",), 3), In(("mailbox",), ("Work", "Inbox"))]))
    assert [type(f) for f in left] == [GreaterThan] and {p.mailbox for p in reader.partitions()} == {"Work"}
    got = mboxes.read(spark, str(folder)).filter("mailbox = 'Work'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull(mailbox", "") or "mailbox" not in plan.split("Filter (")[1].split("\n")[0].replace("isnotnull(mailbox", "")
    assert got.count() == 3 and mboxes.read(spark, str(folder)).filter("mailbox IN ('Work', 'None')").count() == 3
    assert mboxes.read(spark, str(folder)).filter("mailbox = 'None'").count() == 0


def test_heads_are_whole(spark, tmp_path):
    (tmp_path / "Long").write_bytes(b"From a@b.c Mon Jan  1 10:00:00 2024\nX: " + b"y" * 70_000 + b"\nSubject: far\r\n\r\nbody\nFrom a@b.c no date\nSubject: only\n")
    rows = mboxes.read(spark, str(tmp_path), heads=True).orderBy("position").collect()
    assert [bytes(r["head"])[-12:] for r in rows] == [b"Subject: far", b"ubject: only"[-12:]] or bytes(rows[0]["head"]).endswith(b"Subject: far")
    assert all(r.raw is None for r in rows) and rows[1].received_at is None
    raw = spark.createDataFrame([(bytearray(b"X: " + b"y" * 70_000 + b"\nSubject: far\n\nbody"),), (bytearray(b"A: 1\r\n\r\nb"),), (bytearray(b"z" * 70_000),), (None,)], "raw binary")
    heads = [r.h for r in raw.select(shapes.header_prefix(F.col("raw")).alias("h")).collect()]
    assert heads[0].endswith("Subject: far") and heads[1] == "A: 1" and len(heads[2]) == 70_000 and heads[3] is None


def test_attached_mails_are_attachments():
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("inner plain")
    inner.add_alternative("<p>inner html</p>", subtype="html")
    outer = EmailMessage()
    outer["Subject"] = "outer"
    outer.set_content("outer plain")
    outer.add_attachment(inner)
    outer.add_attachment("notes", filename="n.txt")
    got = mail.parse_message(outer.as_bytes())
    assert got["body_text"].strip() == "outer plain" and got["body_html"] is None
    assert [(f["filename"], f["mime_type"]) for f in got["attachments"]] == [("attachment", "message/rfc822"), ("n.txt", "text/plain")] and got["attachments"][0]["size_bytes"] > 50


def test_placeholders_and_odd_headers():
    m = EmailMessage()
    m.add_attachment(b"x", maintype="application", subtype="pdf", filename="r.pdf")
    got = mail.parse_message(b"Subject: \nMessage-Id: <>\nDate: Mon, 01 Jan 99999999999 10:00:00 +0000\n" + m.as_bytes())
    assert got["subject"] == "{attachments only}" and got["body_text"] == "{attachments: r.pdf}" and got["internet_id"] is None and got["date_sent"] is None
    m["Subject"] = "kept"
    assert mail.parse_message(m.as_bytes())["subject"] == "kept"
    bare = mail.parse_message(b"Subject: \nFrom: @@<<\n\n")
    assert bare["subject"] is None and bare["body_text"] is None and bare["attachments"] == [] and bare["error"] is None
    assert mail.parse_message(b"Content-Type: text/html\n\n<p>x")["body_html"].startswith("<p>x")


def test_extracted_text_is_whole(spark):
    files = spark.createDataFrame([(bytearray(b"word " * 300_000), "text/plain", "a.txt")], "content binary, mime_type string, filename string")
    texts = extract.extract_text(files).select(F.lit("a").alias("sha256"), F.col("extracted").alias("text"))
    assert texts.select(F.length("text")).first()[0] == 1_500_000
    assert shapes.attachment_chunks(texts).orderBy(F.desc("chunk_idx")).first().text.endswith("[truncated]")
