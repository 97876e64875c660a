"""Attachment text and safe HTML: per-file helpers run in Arrow batches over a distributed table of contents."""

from __future__ import annotations

import csv
import html
import io
import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charset
from ..functions.text import ALLOWED_EXTENSIONS, ALLOWED_MIME, extension

MAX_BYTES = 50 << 20
# What safe HTML may keep, and the tags that go with their content.
SAFE_TAGS = frozenset(
    "a abbr b blockquote br cite code div em h1 h2 h3 h4 h5 h6 hr i img li ol p pre q small span strong sub sup table tbody td th thead tr u ul".split()
)
SAFE_ATTRIBUTES = {
    "*": {"class", "style", "title"}, "a": {"href"}, "img": {"src", "alt", "width", "height"}, "td": {"colspan", "rowspan", "align"}, "th": {"colspan", "rowspan", "align"},
}
SAFE_STYLES = frozenset(
    """azimuth background-color border border-bottom border-bottom-color border-bottom-style border-bottom-width border-collapse border-color border-left border-left-color
    border-left-style border-left-width border-right border-right-color border-right-style border-right-width border-spacing border-style border-top border-top-color
    border-top-style border-top-width border-width clear color direction display elevation float font font-family font-size font-style font-variant font-weight height
    letter-spacing line-height margin margin-bottom margin-left margin-right margin-top max-height max-width min-height min-width overflow padding padding-bottom padding-left
    padding-right padding-top pause pause-after pause-before pitch pitch-range richness speak speak-header speak-numeral speak-punctuation speech-rate stress table-layout
    text-align text-decoration text-indent unicode-bidi vertical-align voice-family volume white-space width""".split()
)
SAFE_SCHEMES = frozenset(["http", "https", "mailto"])
DROPPED_WITH_CONTENT = frozenset("script style noscript iframe object embed applet form".split())
LINK_REL = "noopener noreferrer"
# Not text of a page: gone with their content, from extracted text also what only its head says.
_FOREIGN = frozenset("template svg math".split())
_UNSEEN = frozenset("script style head title iframe object noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset("br p div li tr h1 h2 h3 h4 h5 h6".split())
_INLINE_IMAGE = re.compile(r"data:image/(?:png|jpeg|gif|webp);base64,[A-Za-z0-9+/=]*", re.IGNORECASE)
_DECLARATION = re.compile(r"""\s*([A-Za-z-]+)\s*:((?:[^;"']|"[^"]*"|'[^']*')*)(?:;|$)""")


def _style(value: str) -> str:
    """The declarations that may stay; none that could load anything."""
    kept = ((name.lower(), x.strip()) for name, x in _DECLARATION.findall(re.sub(r"/\*.*?\*/", "", value, flags=re.DOTALL)))
    return ";".join(f"{name}:{x}" for name, x in kept if name in SAFE_STYLES and x and x.count("(") == x.count(")") and not re.search(r"url\s*\(|expression\s*\(|[\\<>{}]", x, re.IGNORECASE))


class _Cleaner(HTMLParser):
    """Safe HTML, or the text of a page.  Every tag that is written is closed, in order; end tags of nothing go."""

    def __init__(self, images: dict[str, str], external: bool, text_only: bool):
        super().__init__(convert_charrefs=True)
        self.images, self.external, self.text_only = images, external, text_only
        self.unwanted = (_UNSEEN if text_only else DROPPED_WITH_CONTENT) | _FOREIGN
        self.out: list[str] = []
        self.dropped: list[str] = []
        self.open: list[str] = []

    def _source(self, value: str) -> str | None:
        bare = value.strip("<>")
        if bare[:4].lower() == "cid:":
            return self.images.get(bare[4:].strip("<>"))
        trimmed = re.sub(r"^[\x00-\x20]+", "", value)
        return value if _INLINE_IMAGE.fullmatch(value) else trimmed if self.external and trimmed.lower().startswith(("http://", "https://")) else None

    def _attribute(self, tag: str, name: str, value: str) -> str | None:
        if name not in SAFE_ATTRIBUTES["*"] | SAFE_ATTRIBUTES.get(tag, set()):
            return None
        if name == "style":
            return _style(value) or None
        if name == "src":
            return self._source(value)
        if name == "href":
            scheme = re.match(r"([^/?#]*?):", re.sub(r"[\x00-\x20]", "", value))
            return value if scheme is None or scheme[1].lower() in SAFE_SCHEMES else None
        return value

    def handle_starttag(self, tag, attrs):
        if tag in self.unwanted and tag not in _VOID:
            self.dropped.append(tag)
        if self.dropped or (not self.text_only and tag not in SAFE_TAGS):
            return
        if self.text_only:
            self.out.append("\n" if tag in _BREAKS else "")
            return
        kept = {name: x for name, value in reversed(attrs) if (x := self._attribute(tag, name, value or "")) is not None}
        kept = dict(reversed(kept.items())) | ({"rel": LINK_REL} if tag == "a" else {})
        self.out.append(f"<{tag}{''.join(f' {name}="{html.escape(x)}"' for name, x in kept.items())}>")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        # In a browser only foreign elements close themselves; in text, XHTML's empty ones do too.
        if tag not in (self.unwanted if self.text_only else _FOREIGN):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
        elif self.text_only:
            self.out.append("\n" if tag in _BREAKS else "")
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(data if self.text_only else html.escape(data, quote=False))

    def close(self):
        super().close()
        self.out.extend(f"</{tag}>" for tag in reversed(self.open))
        self.open.clear()


def sanitize(page: str | None, images: dict[str, str] | None = None, external_images: bool = False) -> str | None:
    """Allowed tags, attributes and style declarations only; cid: images become the given addresses, external images go unless wanted."""
    if page is None:
        return None
    cleaner = _Cleaner(images or {}, external_images, False)
    cleaner.feed(page)
    cleaner.close()
    return "".join(cleaner.out)


def sanitized(page: Column, external_images: bool = False, content_ids: Column | None = None, digests: Column | None = None, prefix: str = "/v1/attachments/") -> Column:
    """Safe HTML of a column; ``content_ids`` and ``digests`` are arrays of the row's own attachments, whose images then show."""

    def images(ids: list | None, digests: list | None) -> dict[str, str]:
        return {i.strip("<>"): prefix + d for i, d in zip(ids or (), digests or ()) if i and d}

    @F.arrow_udf("string")
    def run(pages: pa.Array, ids: pa.Array, shas: pa.Array) -> pa.Array:
        return pa.array([sanitize(p, images(i, d), external_images) for p, i, d in zip(pages.to_pylist(), ids.to_pylist(), shas.to_pylist())], pa.string())

    none = F.lit(None).cast("array<string>")
    return run(page, none if content_ids is None else content_ids, none if digests is None else digests)


def _decode(data: bytes) -> str:
    return charset.decode(data)[0]


def _html(data: bytes) -> str:
    cleaner = _Cleaner({}, False, True)
    cleaner.feed(_decode(data))
    cleaner.close()
    return re.sub(r"\n\s*\n+", "\n", "".join(cleaner.out)).strip()


def _xml_text(data: bytes, paragraph: str, run: str) -> str:
    lines = []
    for p in ElementTree.fromstring(data).iter():
        if p.tag.rpartition("}")[2] == paragraph:
            lines.append("".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == run or (paragraph == run and t.text)))
    return "\n".join(x for x in lines if x)


def _zipped(data: bytes, pattern: str, paragraph: str, run: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        return "\n".join(_xml_text(z.read(n), paragraph, run) for n in names)


_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def _named(node, name: str) -> list:
    return [x for x in node.iter() if x.tag.rpartition("}")[2] == name]


def _run_text(node) -> str:
    """Text of a string item, without its phonetic reading."""
    skipped = {t for p in _named(node, "rPh") for t in p.iter()}
    return "".join(t.text or "" for t in _named(node, "t") if t not in skipped)


def _cell(cell, shared: list[str], dates: set[int], start: datetime) -> str:
    kind, v = cell.get("t", "n"), next((x.text for x in _named(cell, "v") if x.text), None)
    if kind == "inlineStr":
        return _run_text(cell)
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return str(v == "1")
    if kind == "n" and int(cell.get("s", 0)) in dates:
        days = float(v)
        # Day 60 is the 29th of February 1900 that never was.
        moment = start + timedelta(days=days + (start.year == 1899 and 1 <= days < 60), milliseconds=500)
        moment = moment.replace(microsecond=0)
        return str(moment.time() if 0 <= days < 1 else moment)
    return v


def _xlsx(data: bytes) -> str:
    """A line for each row that has values, of every worksheet in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        tree = lambda n: ElementTree.fromstring(z.read(n)) if n in names else ElementTree.Element("none")
        shared = [_run_text(x) for x in _named(tree("xl/sharedStrings.xml"), "si")]
        styles, book = tree("xl/styles.xml"), tree("xl/workbook.xml")
        codes = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", x.get("formatCode", "")) for x in _named(styles, "numFmt")}
        dated = _DATE_FORMATS | {k for k, code in codes.items() if re.search(r"[ymdhs]", code.lower()) and "general" not in code.lower()}
        formats = [int(x.get("numFmtId", 0)) for part in _named(styles, "cellXfs") for x in _named(part, "xf")]
        dates = {k for k, f in enumerate(formats) if f in dated}
        start = datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in _named(book, "workbookPr")) else datetime(1899, 12, 30)
        target = {x.get("Id"): x.get("Target", "") for x in _named(tree("xl/_rels/workbook.xml.rels"), "Relationship")}
        linked = [target.get(v, "") for x in _named(book, "sheet") for k, v in x.attrib.items() if k.endswith("}id")]
        sheets = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in linked]
        found = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        sheets = [*(n for n in sheets if n in found), *(n for n in found if n not in sheets)]
        if not sheets:
            return "\n".join(x for x in shared if x)
        rows = (" ".join(filter(None, (_cell(c, shared, dates, start) for c in _named(row, "c")))) for n in sheets for row in _named(tree(n), "row"))
        return "\n".join(x for x in rows if x)


def _pptx(data: bytes) -> str:
    """The text of each slide and, below it, what its speaker's notes say."""
    numbered = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        for slide in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=numbered):
            parts.append(_xml_text(z.read(slide), "p", "t"))
            links = f"ppt/slides/_rels/{slide.rpartition('/')[2]}.rels"
            targets = [x.get("Target", "") for x in _named(ElementTree.fromstring(z.read(links)), "Relationship") if x.get("Type", "").endswith("/notesSlide")] if links in names else []
            for notes in (t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("ppt/slides", t)) for t in targets):
                if notes in names:
                    # A notes page repeats the slide's number and date as fields of their own; the notes are in its body.
                    bodies = [x for x in _named(ElementTree.fromstring(z.read(notes)), "sp") if any(p.get("type") == "body" for p in _named(x, "ph"))]
                    parts.extend(_xml_text(ElementTree.tostring(x), "p", "t") for x in bodies)
    return "\n".join(x for x in parts if x)


def _odt(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n".join("".join(p.itertext()) for p in root.iter() if p.tag.rpartition("}")[2] in ("p", "h"))


def _rtf(data: bytes) -> str:
    text = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", _decode(data))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), re.sub(r"\\(?:par|line)\b ?", "\n", text))
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip()


def _ics(data: bytes) -> str:
    lines = re.sub(r"\r?\n[ \t]", "", _decode(data)).splitlines()
    wanted = ("SUMMARY", "DESCRIPTION", "LOCATION", "DTSTART", "DTEND", "ORGANIZER", "ATTENDEE")
    return "\n".join(f"{x.split(':', 1)[0].split(';')[0].title()}: {x.split(':', 1)[1]}" for x in lines if x.split(":", 1)[0].split(";")[0] in wanted and ":" in x)


def _csv(data: bytes) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(_decode(data))))


_BY_EXTENSION = {
    ".txt": _decode, ".md": _decode, ".html": _html, ".htm": _html, ".csv": _csv, ".rtf": _rtf, ".ics": _ics, ".odt": _odt,
    ".docx": lambda d: _zipped(d, r"word/document\.xml", "p", "t"), ".xlsx": _xlsx, ".pptx": _pptx,
}
_BY_MIME = {
    "text/plain": ".txt", "text/markdown": ".md", "text/html": ".html", "text/csv": ".csv", "application/rtf": ".rtf", "text/rtf": ".rtf", "text/calendar": ".ics",
    "application/vnd.oasis.opendocument.text": ".odt", ALLOWED_MIME[8]: ".docx", ALLOWED_MIME[9]: ".xlsx", ALLOWED_MIME[10]: ".pptx",
}


def extract_one(data: bytes, mime: str | None, name: str | None, readers: dict | None = None) -> tuple[str, str | None]:
    """(status, text): extracted, empty, unsupported (no reader, such as pdf without a plug-in) or failed."""
    ending = "." + (name or "").lower().rpartition(".")[2] if "." in (name or "").lstrip(".") else ""
    kind = _BY_MIME.get((mime or "").lower()) or ending
    reader = (readers or {}).get(kind) or _BY_EXTENSION.get(kind)
    if reader is None:
        return "unsupported", None
    try:
        text = reader(data).replace("\0", "")
    except Exception as e:  # noqa: BLE001  a broken file is a result, not a failed job
        return "failed", f"{type(e).__name__}: {e}"[:300]
    return ("extracted", text) if text.strip() else ("empty", None)


def extract_text(files: DataFrame, readers: dict | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add status and extracted to (content, mime_type, filename, ...): too large or not allowed files never reach Python."""
    too_large = F.length("content") > max_bytes
    allowed = F.coalesce(F.lower("mime_type").isin(*ALLOWED_MIME), F.lit(False)) | F.coalesce(extension(F.col("filename")).isin(*ALLOWED_EXTENSIONS), F.lit(False))

    @F.arrow_udf("struct<status:string,text:string>")
    def run(content: pa.Array, mime: pa.Array, name: pa.Array) -> pa.Array:
        rows = [extract_one(c.as_py(), m.as_py(), n.as_py(), readers) if c.is_valid else (None, None) for c, m, n in zip(content, mime, name)]
        return pa.array([{"status": s, "text": t} for s, t in rows], pa.struct([("status", pa.string()), ("text", pa.string())]))

    done = files.withColumn("_x", run(F.when(~too_large & allowed, F.col("content")), "mime_type", "filename"))
    status = F.when(too_large, "size-skipped").when(~allowed, "type-skipped").otherwise(F.col("_x.status"))
    return done.withColumn("status", status).withColumn("extracted", F.col("_x.text")).drop("_x")
