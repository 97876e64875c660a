"""Messages as they are shown, content ids, and cursors that belong to another query."""

import pytest
from pyspark.sql import functions as F

from postrider.operators import paging, shapes
from postrider.plans import dsl
from postrider.plans.searcher import Archive, Searcher, message_view

FILES = "array<struct<filename:string,sha256:string,content_id:string>>"
MESSAGE = f"message_id long, account_id long, subject string, from_addr string, from_name string, to_addrs array<string>, cc_addrs array<string>, date_sent timestamp_ntz, internal_date timestamp_ntz, body_text string, body_html string, attachments {FILES}"


@pytest.fixture(scope="module")
def archive(spark):
    good, other = "a" * 64, "b" * 64
    files = [("p.png", good, "<pic>"), ("q.png", other, "pic"), ("r.txt", "short", None)]
    rows = [(1, 1, "s", "a@x", "Ann", ["t@x", "u@x"], ["c@x"], None, None, "b", '<img src="cid:pic"><b onclick="x">k</b>', files), (2, 2, None, None, None, None, None, None, None, None, None, None)]
    people = spark.createDataFrame([(1, "one", "one@x"), (2, "two", None)], "account_id long, name string, email_address string")
    boxes = spark.createDataFrame([(7, "INBOX"), (8, "Archive")], "mailbox_id long, name string")
    return Archive(spark.createDataFrame(rows, MESSAGE), people, spark.createDataFrame([(1, 7), (1, 8), (1, 7)], "message_id long, mailbox_id long"), boxes)


def test_view_is_nested_and_safe(spark, archive):
    blobs = spark.createDataFrame([("a" * 64, "image/png", 5)], "sha256 string, mime_type string, size_bytes long")
    got = message_view(archive, 1, [1], blobs)
    assert got["from"] == {"address": "a@x", "name": "Ann"} and [a["address"] for a in got["to"] + got["cc"]] == ["t@x", "u@x", "c@x"] and got["bcc"] == []
    assert got["body_html"] == f'<img src="/v1/attachments/{"b" * 64}"><b>k</b>'
    assert [(a["filename"], a["sha256"] and a["sha256"][0], a["mime_type"]) for a in got["attachments"]] == [("p.png", "a", "image/png"), ("q.png", "b", None), ("r.txt", None, None)]
    assert got["account"] == {"id": "1", "name": "one", "address": "one@x"} and got["folders"] == [{"id": "8", "name": "Archive"}, {"id": "7", "name": "INBOX"}]
    bare = message_view(archive, 2, None)
    assert bare["body_html"] is None and bare["attachments"] == [] and bare["folders"] == [] and bare["to"] == []
    assert message_view(archive, 2, [1]) is None


def test_content_ids(archive):
    got = {r.message_id: r.ids for r in archive.messages.select("message_id", shapes.content_ids(F.col("attachments")).alias("ids")).collect()}
    assert got == {1: {"pic": "b" * 64}, 2: {}}


def test_cursors_of_other_queries_are_refused(archive):
    cursor = paging.Cursor(None, 5, "desc", True).encode()
    assert paging.decode_cursor(cursor, "desc", True).message_id == 5
    for order, words in (("asc", True), ("desc", False)):
        with pytest.raises(dsl.QueryError):
            paging.decode_cursor(cursor, order, words)
    with pytest.raises(dsl.QueryError, match="with words"):
        Searcher(archive).search("from:a", sort="date", cursor=cursor)


def test_compose_says_what_was_meant():
    with pytest.raises(dsl.QueryError, match="did you mean subject"):
        dsl.compose("x", subjet="y")
    with pytest.raises(dsl.QueryError, match="called zzz$"):
        dsl.compose("x", zzz="y")
