"""Messages whose words stand only in their HTML body are found, scored and excluded like others."""

from pyspark.sql import functions as F

from postrider.operators import arms, filters, postings
from postrider.plans import dsl

MESSAGE = "message_id long, account_id long, subject string, from_addr string, from_name string, to_addrs array<string>, date_sent timestamp_ntz, body_text string, body_html string, attachments array<struct<filename:string,sha256:string>>"


def test_html_only_message(spark):
    rows = [(1, 1, "s", "f@x.org", "F", ["t@x.org"], None, None, "<p class='red'>Green <b>meadow</b></p>", None), (2, 1, "s", "f@x.org", "F", ["t@x.org"], None, "plain", None, None)]
    m = spark.createDataFrame(rows, MESSAGE)
    ids = lambda rows: sorted(r.message_id for r in rows.collect())
    meadow = dsl.parse("meadow")
    tree = dsl.match_tree(meadow.free_text)
    assert ids(m.filter(filters.text_match(tree, m))) == [1] and ids(m.filter(filters.text_match(dsl.match_tree("red"), m))) == []
    assert ids(filters.apply_filters(m, dsl.parse("-meadow"))) == [2]
    assert ids(postings.build(m).filter(F.col("term") == "meadow")) == [1]
    for cover_density in (False, True):
        found = arms.message_text_arm(m, meadow, 5, cover_density).collect()
        assert [r.message_id for r in found] == [1] and found[0].arm_score > 0
