"""Filters, walks, fusion, ranking, pools and ledgers."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postrider.functions import rank as R
from postrider.functions import text as X
from postrider.functions import vector as V
from postrider.operators import archive, arms, filters, fusion, paging, postings
from postrider.plans import dsl
from postrider.plans.searcher import Archive, Searcher, browse, message_detail, project, readable_blob

MESSAGE = "message_id long, account_id long, subject string, from_addr string, from_name string, to_addrs array<string>, date_sent timestamp_ntz, internal_date timestamp_ntz, body_text string, body_lang string, attachments array<struct<filename:string,sha256:string>>"


def message(i, subject="s", body="b", names=None, day=None, account=1, lang="en", to=("t@x.org",), sender="f@x.org"):
    when = None if day is None else datetime(2024, 1, 1) + timedelta(days=day)
    return (i, account, subject, sender, "Fay", list(to), when, None, body, lang, None if names is None else [(n, f"sha-{n}") for n in names])


@pytest.fixture(scope="module")
def archive_tables(spark):
    rows = [
        message(1, "Red house", "the big red house", ["plan_1.PDF", "100% done.txt"], 1), message(2, "Blue", "a house by the sea", [], 2, account=2),
        message(3, "Green", "red red wine", None, None, lang="de"), message(4, None, "House of cards", ["red.doc", None], 3, to=("Ann@x.org", "b@y.org")),
        message(5, "Spam", "red house spam", None, 3),
    ]
    m = spark.createDataFrame(rows, MESSAGE)
    boxes = spark.createDataFrame([(1, "INBOX"), (2, "Work/Plans"), (3, "work/old")], "mailbox_id long, name string")
    labels = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (4, 1)], "message_id long, mailbox_id long")
    accounts = spark.createDataFrame([(1, "one"), (2, "two")], "account_id long, name string")
    chunks = spark.createDataFrame([(i * 10 + k, i, f"chunk {k} red house", [float(i), float(k), 1.0]) for i in range(1, 6) for k in range(2)], "chunk_id long, message_id long, text string, embedding array<float>")
    return Archive(m, accounts, labels, boxes, chunks)


@pytest.mark.parametrize(
    "query, want",
    [
        ("subject:house", {1}), ("to:ann", {4}), ("attachment_name:% ", {1}), ("attachment_name:_", {1}), ("attachment_name:RED", {4}), ("after:2024-01-03", {2, 4, 5}), ("before:2024-01-03", {1}),
        ("has:attachment", {1, 4}), ("has:no-attachment", {2, 3, 5}), ("folder:INBOX", {1, 4}), ("folder:inbox", set()), ("label:WORK%", {1, 2, 3}), ("label:work/plans", {1, 2}),
        ("folder_id:2 folder_id:3", {1, 2, 3}), ("lang:de", {3}), ("account:two", {2}), ("account:two account:none", {2}), ("account:none", set()), ("account:two account_id:1", set()), ("-spam", {1, 2, 3, 4}), ("-red", {2}),
    ],
)
def test_filters(archive_tables, query, want):
    a = archive_tables
    got = filters.apply_filters(a.messages, dsl.parse(query), a.accounts, a.labels, a.mailboxes)
    assert sorted(r.message_id for r in got.collect()) == sorted(want)


def test_access_is_a_hard_bound(archive_tables):
    a = archive_tables
    assert filters.apply_filters(a.messages, dsl.parse("account_id:2"), allowed=[1]).count() == 0
    assert filters.apply_filters(a.messages, dsl.parse(""), allowed=[]).count() == 0
    assert filters.clamp_accounts([1, 2], None) == [1, 2] and filters.clamp_accounts(None, [3]) == [3] and filters.clamp_accounts([1], [2]) == []


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_walks_neither_skip_nor_repeat(spark, order):
    base = datetime(2024, 1, 1)
    rows = [(i, None if i % 4 == 0 else base + timedelta(days=i % 3)) for i in range(1, 40)]
    frame = spark.createDataFrame(rows, "message_id long, effective_date timestamp_ntz")
    seen, cursor = [], None
    while True:
        got = paging.walk(frame, 7, order, cursor).collect()
        seen += [r.message_id for r in got[:7]]
        if len(got) <= 7:
            break
        cursor = paging.decode_cursor(paging.Cursor(got[6].effective_date, got[6].message_id, order).encode(), order)
    dated = sorted(((d, i) for i, d in rows if d), reverse=order == "desc")
    undated = sorted((i for i, d in rows if d is None), reverse=order == "desc")
    assert seen == ([i for _, i in dated] + undated if order == "desc" else undated + [i for _, i in dated])


def test_cursors_and_cache():
    c = paging.Cursor(None, 5, "asc")
    assert paging.decode_cursor(c.encode()) == c
    for bad in ("", "%%%", "YWJj"):
        with pytest.raises(dsl.QueryError):
            paging.decode_cursor(bad)
    with pytest.raises(dsl.QueryError):
        paging.decode_cursor(c.encode(), "desc")
    now = [0.0]
    cache = paging.PoolCache(2, 10, lambda: now[0])
    a, b = cache.put("a", 1), cache.put("b")
    assert cache.get(a, 1) == "a" and cache.get(a) is None
    cache.put("c")
    assert cache.get(b) is None and cache.get(a, 1) == "a"
    now[0] = 11
    assert cache.get(a, 1) is None


def test_fusion(spark):
    schema = "message_id long, chunk_id long, chunk_table string, arm_score double, rank int, arm int"
    hits = [(1, None, "messages", 1.0, 1, 1), (2, None, "messages", 1.0, 2, 1), (1, 11, "m", 1.0, 2, 2), (1, 12, "m", 1.0, 1, 3), (2, 21, "m", 1.0, 1, 2), (2, 22, "m", 1.0, 1, 3), (3, None, "messages", 1.0, 3, 1)]
    got = {r.message_id: r for r in fusion.fuse([spark.createDataFrame([h for h in hits if h[5] == a], schema) for a in (1, 2, 3)]).collect()}
    assert abs(got[1].rrf_score - (2 / 61 + 1 / 62)) < 1e-9 and got[1].best_chunk_id == 12 and got[1].contributing_arms == [1, 2, 3]
    assert got[2].best_chunk_id == 21 and got[3].best_chunk_id is None


def test_pool_cut_prefers_newest_then_highest_id(spark):
    fused = spark.createDataFrame([(i, 0.5 if i < 5 else 0.1) for i in range(1, 7)], "message_id long, rrf_score double")
    dates = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, None), (3, datetime(2024, 1, 3)), (4, datetime(2024, 1, 2))], "message_id long, effective_date timestamp_ntz")
    assert [r.message_id for r in fusion.cut_pool(fused, dates, 5).collect()] == [3, 4, 1, 2, 6]


def test_scores_that_are_no_numbers():
    assert fusion.finite_scores([1.0, math.nan, math.inf, 3.0], [0] * 4)[1:3] == [math.nextafter(1.0, -math.inf)] * 2
    assert fusion.finite_scores([math.nan, -math.inf], [0.2, 0.1]) == [0.2, 0.1]
    rows = [{"message_id": 1, "rrf_score": 0.2, "text": "a"}, {"message_id": 2, "rrf_score": 0.3, "text": "b"}]
    assert [r["message_id"] for r in fusion.rerank(rows, "q", lambda q, t: [5.0, 1.0])] == [1, 2]
    assert [r["message_id"] for r in fusion.rerank(rows, "q", lambda q, t: 1 / 0)] == [2, 1]


def test_cover_density():
    words = "a x b a y y b".split()
    covers = R.covers([(0, 0, 0), (2, 1, 0), (3, 0, 0), (6, 1, 0)], 2)
    assert [(c[0][0], c[-1][0]) for c in covers] == [(0, 2), (2, 3), (3, 6)]
    assert abs(R.cover_density(words, [3] * 7, ["a", "b"]) - (1 / 2 + 1 + 1 / 3)) < 1e-9
    assert R.cover_density(words, [3] * 7, ["a", "z"]) == 0 and R.boosts(0, 0, 0, 0) == (1.0,) * 4


def test_search_pages_and_detail(archive_tables):
    s = Searcher(archive_tables, embed=lambda text: [1.0, 0.0, 1.0], score=None, candidates=5)
    first = s.search("red house", size=2)
    assert len(first.rows) == 2 and [r["rank"] for r in first.rows] == [1, 2]
    rest = s.page(first.token, 2, 2)
    ids = [r["message_id"] for r in first.rows + rest.rows]
    assert len(set(ids)) == len(ids) and {1, 5} <= set(ids)
    with pytest.raises(dsl.QueryError):
        s.page(first.token, 1, 2, user="other")
    walk = s.search("-spam", size=3)
    assert [r["message_id"] for r in walk.rows] == [4, 2, 1]
    assert [r["message_id"] for r in s.search("-spam", size=3, cursor=walk.next_cursor).rows] == [3]
    assert s.search("red", allowed=[]).rows == []
    assert project(first.rows, ["snippet", "message_id"])[0].keys() == {"message_id", "snippet"}
    page = browse(archive_tables, [1], size=2)
    assert [r["message_id"] for r in page.rows] == [5, 4] and [r["message_id"] for r in browse(archive_tables, [1], size=2, cursor=page.next_cursor).rows] == [1, 3]
    assert message_detail(archive_tables, 1, [1])["folders"] == ["INBOX", "Work/Plans"] and message_detail(archive_tables, 2, [1]) is None
    assert readable_blob(archive_tables, "sha-red.doc", [1]) and not readable_blob(archive_tables, "sha-red.doc", [2])


def test_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "message_id long, embedding array<float>").withColumn("chunk_id", F.col("message_id"))
    got = arms.chunk_vector_arm(frame, None, [1.0, 0.0], 10).collect()
    assert [(r.message_id, r.arm_score, r.rank) for r in got] == [(1, 1.0, 1), (2, round(1 / math.sqrt(2), 9), 2)]
    a, b = spark.range(1).select(V.hashed_embedding(F.lit("red house")).alias("a"), V.hashed_embedding(F.lit("red house!")).alias("b")).first()
    assert a == b and len(a) == 64


def test_attachment_fan_out_filters_after_the_prefetch(spark):
    chunks = spark.createDataFrame([(i, f"s{i}", [1.0, i / 10]) for i in range(9)], "chunk_id long, sha256 string, embedding array<float>")
    carriers = spark.createDataFrame([(m, f"s{m % 9}", datetime(2024, 1, 1) + timedelta(days=m)) for m in range(200)], "message_id long, sha256 string, date_sent timestamp_ntz")
    got = arms.attachment_vector_arm(chunks, carriers, [1.0, 0.0], 2, prefetch=3, fan_out=4).collect()
    assert [(r.message_id, r.chunk_id) for r in got] == [(198, 0), (189, 0)]
    assert arms.attachment_vector_arm(chunks, carriers.filter("sha256 = 's8'"), [1.0, 0.0], 2).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.normalize_whitespace(F.lit(" a  \t b \r\n\n\n\n c\n"))) == "a b\n\nc"
    assert one(spark, X.strip_signature(F.lit("hi\n-- \nBob\nx"))) == "hi" and one(spark, X.strip_signature(F.lit("hi -- there"))) == "hi -- there"
    assert one(spark, X.strip_quotes(F.lit("new\n> old\nAm 1.1. schrieb X:\n> rest"))) == "new"
    assert one(spark, X.strip_quotes(F.lit("new\nFrom: a\nSent: b\nTo: c\nold"))) == "new"
    for kept in ("On Monday he wrote: fine. And more text\nkeep me", "from: a\nsent: b\nto: c", "We say on Monday, Bob wrote:"):
        assert one(spark, X.strip_quotes(F.lit(kept))) == kept
    for cut in (f"On Mon, {'x' * 300} WROTE:", "on Mon, 1 Jan 2024,\nBob wrote:  ", "El lun, 1 ene, Bob escribio:", "-----  original message -----"):
        assert one(spark, X.strip_quotes(F.lit("new\n" + cut + "\nold"))) == "new"
    assert one(spark, X.language_text(F.lit("see https://a.b/c?d now  www.x.y"))) == "see now"
    assert [one(spark, X.extension(F.lit(n))) for n in ("a.PDF", ".bashrc", "a.tar.gz", "none")] == [".pdf", "", ".gz", ""]
    assert one(spark, X.safe_filename(F.lit("../a/b\\c\x01.txt"))) == "a_b_c_.txt" and one(spark, X.safe_filename(F.lit("._"))) == "attachment"
    for n, want in ((0, []), (1, [1]), (512, [512]), (513, [512, 65]), (960, [512, 512]), (961, [512, 512, 65])):
        words = F.split(F.lit(" ".join(["w"] * n)), " ") if n else F.array().cast("array<string>")
        assert [len(c) for c in one(spark, X.windows(words))] == want, n
    assert one(spark, X.snippet(F.lit("x" * 50 + " Needle " + "y" * 50), ["needle"], 20)) == "…" + ("x" * 50 + " Needle " + "y" * 50)[41:61] + "…"
    assert one(spark, X.snippet(F.lit("one two three four"), ["zzz"], 10)) == "one two…"
    assert one(spark, X.html_text(F.lit("<head><title>t</title></head><p>a&amp;b<script>x<y</script></p><p>c</p>"))) == "a&b\nc"
    assert one(spark, X.is_blank(F.lit(" \u00a0\u3000\n"))) and not one(spark, X.is_blank(F.lit("x"))) and one(spark, X.is_blank(F.lit(None).cast("string")))
    w = one(spark, X.text_window(F.lit("é" * 10), 4, 3))
    assert (w.text, w.total, w.next_offset) == ("ééé", 10, 7)
    head = one(spark, X.header_chunk(F.lit("S"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), F.lit(""), F.lit("x y z"), 2))
    assert head == "Subject: S | To: a, b | x y"


def test_ledgers(spark):
    now = datetime(2024, 1, 2)
    rows = spark.createDataFrame([(1, True, None), (2, False, True), (3, None, True), (4, True, True)], "id long, a boolean, b boolean")
    r = archive.partition_counts(rows, {"a": F.col("a"), "b": F.col("b")}).first()
    assert (r.eligible, r.a, r.b, r.misfiled) == (4, 2, 3, 3)
    old = spark.createDataFrame([("k1", 1), (None, 1)], "k string, v long")
    new = spark.createDataFrame([("k1", 2), ("k2", 4), ("k2", 3), (None, 9)], "k string, v long")
    assert [tuple(x) for x in archive.insert_if_absent(old, new, ["k"], [F.col("v")]).collect()] == [("k2", 3)]
    keys = spark.createDataFrame([(" <a@b> ", "s"), ("<  >", "s"), (None, "s")], "i string, s string").select(archive.dedup_key(F.col("i"), F.col("s")).alias("k"))
    assert [x.k for x in keys.collect()] == ["id:<a@b>", "sha:s", "sha:s"]
    log = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "a", 99)], "user_id long, name string, cursor long")
    assert archive.acknowledged(log, 50).first().cursor == 5
    feed = spark.createDataFrame([(i, 1 + i % 2, now - timedelta(seconds=20 - i)) for i in range(1, 20)], "message_id long, account_id long, date_received timestamp_ntz")
    assert [x.message_id for x in archive.changes(feed, 10, now, 5, [1]).collect()] == [12, 14]
    assert archive.changes(feed, None, now, 5).first().message_id == 14 and archive.changes(feed, 0, now, 5, []).count() == 0
    uses = spark.createDataFrame([("f", "t1"), ("f", "t2"), ("g", "t3"), ("g", "t3")], "family string, token string")
    assert [x.family for x in archive.live_families(uses).collect()] == ["f"]
    wanted = spark.createDataFrame([("a", ["x", "y"], True), ("b", ["x"], True), ("c", ["x"], True)], "name string, allow array<string>, sync boolean")
    stored = spark.createDataFrame([("a", ["y", "x", "x"], True), ("b", ["z"], False)], "name string, allow array<string>, sync boolean")
    assert {x.name: (x.action, x.fields) for x in archive.config_drift(wanted, stored, ["allow", "sync"]).collect()} == {"a": ("keep", []), "b": ("update", ["allow", "sync"]), "c": ("create", [])}
    folders = spark.createDataFrame([("A", ["\\Noselect"]), ("B", ["\\Junk"]), ("C", []), ("D", None)], "name string, flags array<string>")
    assert [x.name for x in archive.folders_to_sync(folders, [], ["D"], ["\\junk"]).collect()] == ["C"]
    tokens = spark.createDataFrame([(1, 1, now - timedelta(days=1), None), (2, 1, now - timedelta(days=9), None), (3, 2, now, now - timedelta(days=1)), (4, 3, now, None)], "token_id long, user_id long, issued_at timestamp_ntz, expires_at timestamp_ntz")
    users = spark.createDataFrame([(1, True, now - timedelta(days=5)), (2, True, None), (3, False, None)], "user_id long, enabled boolean, revoked_at timestamp_ntz")
    assert [x.token_id for x in archive.valid_tokens(tokens, users, now).collect()] == [1]


def test_postings_read_only_their_terms_and_lose_nothing(spark, archive_tables, tmp_path):
    path = str(tmp_path / "postings")
    postings.write(archive_tables.messages, path)
    index = postings.read(spark, path)
    for text in ("red house", '"big red" OR sea', "plan -spam", "-spam", "house OR -red", "doc"):
        tree = dsl.match_tree(text)
        likely = postings.candidates(index, tree)
        exact = {r.message_id for r in archive_tables.messages.filter(filters.text_match(tree)).collect()}
        if likely is not None:
            assert exact <= {r.message_id for r in likely.collect()}
        else:
            assert text in ("-spam", "house OR -red")
    plan = postings.candidates(index, dsl.match_tree("red"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    with_index = Searcher(Archive(**{**archive_tables.__dict__, "postings": spark.read.parquet(path)}))
    without = Searcher(archive_tables)
    assert [r["message_id"] for r in with_index.search("red house").rows] == [r["message_id"] for r in without.search("red house").rows]
