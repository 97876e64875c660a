"""What safe HTML keeps, what goes with its content, and the notes of slides."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from postrider.sources import extract

REL = 'rel="noopener noreferrer"'


@pytest.mark.parametrize(
    "page, want",
    [
        ("<form>secret</form><applet>x</applet>ok", "ok"),
        ("<form>never closed", ""),
        ("<embed src=x>after", "after"),
        ("<p class=a style=\"color:red;position:fixed;background-color:url(x);font-family:'a;b'\">t", '<p class="a" style="color:red;font-family:&#x27;a;b&#x27;">t</p>'),
        ('<p style="background:url(a;color:red)">t</p>', "<p>t</p>"),
        (r'<p style="width:\65xpression(1);height:2px/*x*/">t</p>', '<p style="height:2px">t</p>'),
        ('<a href=" data:text/html,x">k</a><a href="CID:p">k</a>', f"<a {REL}>k</a><a {REL}>k</a>"),
        ('<a href="/rel?a=1:2">k</a><a href="java\nscript:x">k</a>', f'<a href="/rel?a=1:2" {REL}>k</a><a {REL}>k</a>'),
        ('<img src="data:image/png;base64,AA=="><img src="data:image/svg+xml;base64,AA"><img src="//t/x"><img alt=1 src="CID:<p>">', '<img src="data:image/png;base64,AA=="><img><img><img alt="1" src="/b/1">'),
        ("<cite>q</cite></b><i><b>x</i>y", "<cite>q</cite><i><b>x</b></i>y"),
        ("<td align=left colspan=2 width=3>x</td>", '<td align="left" colspan="2">x</td>'),
        ("<svg/>x<svg><a>y</a></svg>z<!-- c -->", "xz"),
        ("<b title=1 title=2 onclick=x>&lt;script&gt;</b>", '<b title="1">&lt;script&gt;</b>'),
        ("", ""),
    ],
)
def test_pages(page, want):
    assert extract.sanitize(page, {"p": "/b/1"}) == want


def test_safe_html_is_its_own_safe_html(spark):
    """Cleaning twice changes nothing: on all pages, whole."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(extract.sanitized(F.col("html")).alias("once"))
    twice = pages.withColumn("twice", extract.sanitized(F.col("once"), external_images=True))
    assert twice.filter("NOT once <=> twice").count() == 0 and twice.filter("once RLIKE '(?i)<(script|style|form)'").count() == 0


def test_speaker_notes_follow_their_slide():
    def page(*texts):
        return "<p:d xmlns:p='u'>" + "".join(f"<p:sp><p:nvPr><p:ph type='{kind}'/></p:nvPr><p:p><p:t>{t}</p:t></p:p></p:sp>" for kind, t in texts) + "</p:d>"

    rels = "<r xmlns='u'><Relationship Id='a' Type='x/notesSlide' Target='../notesSlides/notesSlide7.xml'/><Relationship Id='b' Type='x/notesSlide' Target='../notesSlides/gone.xml'/></r>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide10.xml", page(("title", "ten")))
        z.writestr("ppt/slides/slide2.xml", page(("title", "two")))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels)
        z.writestr("ppt/notesSlides/notesSlide7.xml", page(("sldNum", "2"), ("body", "say this")))
    assert extract.extract_one(out.getvalue(), None, "a.pptx") == ("extracted", "two\nsay this\nten")
