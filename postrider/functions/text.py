"""Text functions as Spark columns; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types whose text is extracted, by MIME type and by extension.
ALLOWED_MIME = (
    "application/pdf", "text/plain", "text/markdown", "text/html", "text/csv", "application/rtf", "text/rtf", "text/calendar",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.oasis.opendocument.text",
)
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".pptx", ".txt", ".md", ".html", ".htm", ".csv", ".rtf", ".odt", ".ics")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def document(*parts: Column) -> Column:
    """The words of the parts between single blanks, at least one before the first and after the last; null parts are empty."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def matches(tree, doc: Column) -> Column:
    """A match tree over a ``document`` column; an absent tree matches nothing."""
    if tree is None:
        return F.lit(False)
    kind, value = tree
    if kind == "words":
        return doc.contains(f" {' '.join(value)} ")
    if kind == "not":
        return ~matches(value, doc)
    found = None
    for x in value:
        one = matches(x, doc)
        found = one if found is None else (found & one if kind == "all" else found | one)
    return found


def may_match(tree, low: Column) -> Column:
    """A cheap test of lower-cased text that holds wherever the tree does: its words occur as parts of the text."""
    kind, value = tree
    if kind == "not":
        return F.lit(True)
    if kind == "words":
        parts = [low.contains(w) for w in value]
    else:
        parts = [may_match(x, low) for x in value]
    found = None
    for one in parts:
        found = one if found is None else found | one if kind == "any" else found & one
    return F.lit(True) if found is None else found


def required_words(tree) -> list[str]:
    """Words of the tree that are not excluded."""
    if tree is None:
        return []
    kind, value = tree
    if kind == "words":
        return list(value)
    return [] if kind == "not" else list(dict.fromkeys(w for x in value for w in required_words(x)))


def term_frequency(doc: Column, terms: list[str]) -> Column:
    """How many words of a ``document`` column are one of the terms, by the bytes that go with them."""
    # Each word stands between blanks of its own, so that equal neighbours share none.
    apart = F.replace(doc, F.lit(" "), F.lit("  "))
    found = F.lit(0)
    for t in dict.fromkeys(f" {t} " for t in terms):
        found = found + (F.octet_length(apart) - F.octet_length(F.replace(apart, F.lit(t), F.lit("")))) / len(t.encode())
    return found.cast("int")


def names_document(names: Column) -> Column:
    """Attachment names as they are and split at what is no letter or digit, at most 50,000 characters of each form."""
    whole = F.array_join(F.filter(names, lambda n: n.isNotNull()), " ")
    return document(F.left(whole, F.lit(50_000)), F.regexp_replace(F.left(whole, F.lit(50_000)), r"[^\p{L}\p{N}]+|_", " "))


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; none for names that only start with one."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)\z", 1))


def allowed_type(mime: Column, names: Column) -> Column:
    by_name = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(extension(n).isin(*ALLOWED_EXTENSIONS), F.lit(False)))
    return F.coalesce(F.lower(mime).isin(*ALLOWED_MIME), F.lit(False)) | by_name


def safe_filename(name: Column, default: str = "attachment") -> Column:
    """Separators and control characters become underscores; leading dots and underscores go."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[/\\:\x00-\x1f\x7f]", "_"), r"^[._]+", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(default)).otherwise(clean)


def is_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\s\u0085   -     　]*$"), F.lit(True))


def normalize_whitespace(text: Column) -> Column:
    """Blanks collapse within each line and go at its ends; more than two newlines become two; ends are trimmed."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r", -1), lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t\x0b\f]+", " "), r"^ | \z", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def strip_signature(text: Column) -> Column:
    """Everything before the first line that is '-- '."""
    return F.regexp_replace(text, r"(?s)(^|\n)-- ?(\n.*)?\z", "")


# How mail programs announce a quoted message; each must end its line.
REPLY_HEADERS = (
    r"On [^\n]+,\s[^\n]+\swrote:", r"Am [^\n]+\sschrieb\s[^\n]+:", r"El [^\n]+,\s[^\n]+\sescribi[oó]:",
    r"-----\s*Original Message\s*-----", r"(?-i:From:[^\n]+\nSent:[^\n]+\nTo:[^\n]+)",
)
#: A header at the start of a line and all that follows it.
QUOTED = r"(?is)(^|\n)(?:" + "|".join(REPLY_HEADERS) + r")[ \t\r\x0b\f]*(?:\n.*)?\z"


def strip_quotes(text: Column) -> Column:
    """Cut at the first announced reply, then drop quoted lines; null stays null."""
    return F.array_join(F.filter(F.split(F.regexp_replace(text, QUOTED, ""), "\n", -1), lambda s: ~s.rlike(r"^\s*>")), "\n")


def without_links(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(?:https?://|www\.)\S+", " ")


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language_text(text: Column) -> Column:
    """Text for language detection: no links, blanks collapsed."""
    return collapsed(without_links(text))


def windows(words: Column, size: int = 512, overlap: int = 64) -> Column:
    """Slices of ``size`` words that overlap by ``overlap``; the last one reaches the end.

    The words are bound once: an expression inside the slices would be computed again for each of them.
    """

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(n > 0, F.transform(starts, lambda s: F.slice(w, s + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return F.element_at(F.transform(F.array(words), cut), 1)


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def text_window(text: Column, offset: int, limit: int) -> Column:
    """Struct(text, total, next_offset) of a page of characters; next_offset is null on the last."""
    total = F.length(text)
    return F.struct(
        F.substring(text, offset + 1, limit).alias("text"), total.alias("total"), F.when(total > offset + limit, F.lit(offset + limit)).alias("next_offset")
    )


def snippet(text: Column, terms: list[str], width: int = 200) -> Column:
    """Short texts whole; else a window around the earliest term, with ellipses where it is cut; without a term the head up to a full word."""
    low = F.lower(text)
    at = [F.when(F.instr(low, t) > 0, F.instr(low, t)) for t in terms]
    first = F.least(*at) if len(at) > 1 else at[0] if at else F.lit(None).cast("int")
    start = F.greatest(first - 1 - width // 2, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(width))
    around = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + width < F.length(text), "…").otherwise(""))
    head = F.concat(F.regexp_replace(F.substring(text, 1, width), r"\s+\S*\z", ""), F.lit("…"))
    return F.when(F.length(text) <= width, text).when(first.isNotNull(), around).otherwise(head)


def html_text(html: Column) -> Column:
    """Visible text of a page: no script, style, head or tags; common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return normalize_whitespace(text)


def header_chunk(subject: Column, sender: Column, to: Column, date: Column, body: Column, intro: int = 200) -> Column:
    """Labelled header fields and the first words of the body, joined by ' | '."""
    label = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    lead = F.array_join(F.slice(plain_words(F.coalesce(body, F.lit(""))), 1, intro), " ")
    return F.concat_ws(" | ", label("Subject", subject), label("From", sender), label("To", F.array_join(to, ", ")), label("Date", date), F.when(lead != "", lead))


def strip_nuls(text: Column) -> Column:
    return F.translate(text, "\x00", "")
