"""Shapes that answers take, and derivations and queue reports of the archive: hits, details, attachments, chunks, failures, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import extract
from . import filters

#: Characters of an attachment's text that are cut into chunks; what is beyond is marked.
ATTACHMENT_CHARS = 1_000_000
TRUNCATED = "\n[truncated]"
INTRO_WORDS = 200


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def api_hits(hits: DataFrame, messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Hits as they are sent: string ids, account and sender nested, the date of the sort key in ISO form, null where there is none.

    hits: (message_id, score, snippet, matched_arms); messages that are gone drop out, an account that is gone leaves a null name.
    """
    names = accounts.select("account_id", F.col("name").alias("_account"))
    rows = hits.join(messages.withColumn("_has", filters.has_attachments()), "message_id").join(names, "account_id", "left")
    return rows.select(
        F.col("message_id").cast("string").alias("message_id"), F.struct(F.col("account_id").cast("string").alias("id"), F.col("_account").alias("name")).alias("account"), "subject",
        F.struct(F.col("from_addr").alias("address"), F.col("from_name").alias("name")).alias("from"), F.coalesce("to_addrs", F.array().cast("array<string>")).alias("to"),
        iso(filters.effective_date()).alias("date"), F.col("snippet").alias("snippet_html"), F.col("_has").alias("has_attachments"), "score", "matched_arms",
    )


def address(addr: Column, name: Column | None = None) -> Column:
    return F.struct(addr.alias("address"), (F.lit(None).cast("string") if name is None else name).alias("name"))


def content_ids(attachments: Column) -> Column:
    """Map of content ids, without angle brackets, to digests, for the images a mail's HTML shows; of one id the last attachment's."""
    plain = F.transform(attachments, lambda a: F.struct(a["content_id"].alias("content_id"), a["sha256"].alias("sha256")))
    good = F.filter(F.coalesce(plain, F.array().cast("array<struct<content_id:string,sha256:string>>")), lambda a: (F.coalesce(a["content_id"], F.lit("")) != "") & (F.coalesce(a["sha256"], F.lit("")) != ""))
    pairs = F.transform(good, lambda a: F.struct(F.regexp_replace(a["content_id"], "^[<>]+|[<>]+$", "").alias("key"), a["sha256"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def details(messages: DataFrame, accounts: DataFrame, labels: DataFrame, mailboxes: DataFrame, blobs: DataFrame | None = None, blob_path: str = "/v1/attachments/", external_images: bool = False) -> DataFrame:
    """Messages as they are shown one by one: addresses, account, folders and attachments nested, HTML made safe with its own images.

    Columns of addresses, HTML or attachments that a table lacks count as null; an attachment whose blob is gone has no type and
    size; a message in no folder has an empty list.  Any number of messages: nothing is looked up one at a time.
    """
    of = lambda c, kind="string": F.col(c) if c in messages.columns else F.lit(None).cast(kind)
    people = lambda c: F.transform(F.coalesce(of(c, "array<string>"), F.array().cast("array<string>")), address)
    boxes = labels.join(mailboxes, "mailbox_id").groupBy("message_id").agg(F.sort_array(F.collect_set(F.struct("name", F.col("mailbox_id").cast("string").alias("id")))).alias("_f"))
    files = attachment_list(messages, blobs).groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("position", "filename", "sha256", "mime_type", "size_bytes"))).alias("_a"))
    names = accounts.select("account_id", F.struct(F.col("account_id").cast("string").alias("id"), "name", (F.col("email_address") if "email_address" in accounts.columns else F.lit(None).cast("string")).alias("address")).alias("account"))
    has_ids = "attachments" in messages.columns and "content_id" in messages.schema["attachments"].dataType.elementType.names
    own = (F.col("attachments.content_id"), F.col("attachments.sha256")) if has_ids else (None, None)
    safe = messages.withColumn("_html", extract.sanitized(of("body_html"), external_images, *own, blob_path))
    rows = safe.join(names, "account_id").join(boxes, "message_id", "left").join(files, "message_id", "left")
    return rows.select(
        F.col("message_id").cast("string").alias("id"), "subject", address(F.col("from_addr"), F.col("from_name")).alias("from"), people("to_addrs").alias("to"), people("cc_addrs").alias("cc"), people("bcc_addrs").alias("bcc"),
        iso(F.col("date_sent")).alias("date"), "body_text", F.col("_html").alias("body_html"),
        F.coalesce("_a", F.array().cast("array<struct<position:int,filename:string,sha256:string,mime_type:string,size_bytes:bigint>>")).alias("attachments"), "account",
        F.transform(F.coalesce("_f", F.array().cast("array<struct<name:string,id:string>>")), lambda f: F.struct(f["id"].alias("id"), f["name"].alias("name"))).alias("folders"),
    )


def attachment_list(messages: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(message_id, position, filename, sha256, mime_type, size_bytes): every attachment by its position; one whose digest is malformed or whose blob is missing keeps its row with nulls."""
    rows = messages.select("message_id", F.posexplode("attachments").alias("position", "a"))
    good = F.lower("a.sha256").rlike("^[0-9a-f]{64}$")
    rows = rows.select("message_id", "position", "a.filename", F.when(good, F.lower("a.sha256")).alias("sha256"))
    if blobs is None:
        return rows.withColumns({"mime_type": F.lit(None).cast("string"), "size_bytes": F.lit(None).cast("long")})
    return rows.join(blobs.select("sha256", "mime_type", "size_bytes"), "sha256", "left").select("message_id", "position", "filename", "sha256", "mime_type", "size_bytes")


def attachment_at(messages: DataFrame, position: int, blobs: DataFrame | None = None) -> DataFrame:
    """The attachment at one position of each message that has so many."""
    return attachment_list(messages, blobs).filter(F.col("position") == position)


def body_chunks(messages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(message_id, kind, chunk_idx, text): a header chunk with the body's first words, then windows over the cleaned body's words after those."""
    clean = X.normalize_whitespace(X.strip_signature(X.strip_quotes(F.coalesce(filters.body(messages), F.lit("")))))
    sender = F.when(F.col("from_name").isNotNull(), F.concat("from_name", F.lit(" <"), F.col("from_addr"), F.lit(">"))).otherwise(F.col("from_addr"))
    head = X.header_chunk(F.col("subject"), sender, F.col("to_addrs"), iso(F.col("date_sent")), F.col("_clean"), INTRO_WORDS)
    words = X.plain_words(F.col("_clean"))
    rest = X.windows(F.slice(words, INTRO_WORDS + 1, F.greatest(F.size(words), F.lit(1))), size, overlap)
    texts = F.concat(F.array(F.struct(F.lit("header").alias("kind"), head.alias("text"))), F.transform(rest, lambda w: F.struct(F.lit("body").alias("kind"), F.array_join(w, " ").alias("text"))))
    rows = messages.withColumn("_clean", clean).select("message_id", F.posexplode(texts).alias("chunk_idx", "c"))
    return rows.select("message_id", "c.kind", "chunk_idx", "c.text")


def attachment_chunks(texts: DataFrame, size: int = 512, overlap: int = 64, chars: int = ATTACHMENT_CHARS) -> DataFrame:
    """(sha256, chunk_idx, text) of extracted texts (sha256, text): windows over the words; a text over ``chars`` is cut there and says so at its end; texts without words give none."""
    clean = X.normalize_whitespace(F.coalesce("text", F.lit("")))
    cut = F.when(F.length(clean) > chars, F.concat(F.substring(clean, 1, chars), F.lit(TRUNCATED))).otherwise(clean)
    rows = texts.select("sha256", F.posexplode(X.windows(X.plain_words(cut), size, overlap)).alias("chunk_idx", "words"))
    return rows.select("sha256", "chunk_idx", F.array_join("words", " ").alias("text"))


def header_prefix(raw: Column, limit: int = 65_536) -> Column:
    """The bytes up to the first empty line, each as one character; all of them where there is none.

    The first ``limit`` bytes are looked at, and the whole message only where they have no empty line.
    """
    end = r"\r?\n\r?\n"
    head = lambda b: F.regexp_extract(F.decode(b, "ISO-8859-1"), rf"(?s)^(.*?)(?:{end}|\z)", 1)
    first = F.substring(raw, 1, limit)
    enough = (F.length(raw) <= limit) | F.decode(first, "ISO-8859-1").rlike(end)
    return F.when(enough, head(first)).otherwise(head(raw))


def update_from(rows: DataFrame, source: DataFrame, keys: list[str], columns: list[str], only_missing: bool = True) -> DataFrame:
    """Rows with columns taken from the source's row of the same keys (unique there): where they are null, or wherever the source has the keys; rows without a match stay."""
    found = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    out = rows.join(found, keys, "left")
    new = lambda c: F.coalesce(c, f"_{c}") if only_missing else F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c))
    return out.withColumns({c: new(c) for c in columns}).select(*rows.columns)


def failed_messages(failures: DataFrame, accounts: DataFrame, mailboxes: DataFrame, limit: int, retried: bool = False) -> DataFrame:
    """The latest failures with the names of their account and mailbox; a mailbox that is gone leaves a null name, given-up ones come only if asked for."""
    rows = failures if retried else failures.filter(~F.coalesce("gave_up", F.lit(False)))
    rows = rows.join(accounts.select("account_id", F.col("name").alias("account")), "account_id")
    rows = rows.join(mailboxes.select("mailbox_id", F.col("name").alias("mailbox")), "mailbox_id", "left")
    return rows.orderBy(F.desc("failed_at"), F.desc("failure_id")).limit(limit)


def retried(ledger: DataFrame, chosen: Column) -> DataFrame:
    """The ledger with the chosen failures open again: no attempts spent, not given up."""
    return ledger.withColumns({"retry_count": F.when(chosen, 0).otherwise(F.col("retry_count")), "gave_up": F.when(chosen, False).otherwise(F.col("gave_up"))})


def names_by_blob(messages: DataFrame) -> DataFrame:
    """(sha256, names): the distinct names that each blob is sent under, in order."""
    rows = messages.select(F.explode("attachments").alias("a")).select("a.sha256", "a.filename")
    return rows.groupBy("sha256").agg(F.sort_array(F.collect_set("filename")).alias("names"))


def blobs_by_extension(blobs: DataFrame, messages: DataFrame) -> DataFrame:
    """(extension, n_blobs, n_bytes): stored blobs by the extension of the names that they are sent under, null where no message names one; a blob under several extensions counts for each."""
    extension = F.lower(F.regexp_extract("filename", r".(\.[^.]+)$", 1))
    named = messages.select(F.explode("attachments").alias("a")).select("a.sha256", "a.filename").select("sha256", F.nullif(extension, F.lit("")).alias("extension")).distinct()
    return blobs.join(named, "sha256", "left").groupBy("extension").agg(F.count("*").alias("n_blobs"), F.sum("size_bytes").alias("n_bytes"))


def language_histogram(messages: DataFrame) -> DataFrame:
    """(body_lang, n): messages by language, null for those not yet detected, most first."""
    return messages.groupBy("body_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("body_lang"))


def write_json(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

