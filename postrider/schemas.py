"""Schemas of the archive's tables and of what queries return, as DDL."""

from __future__ import annotations

ATTACHMENTS = "array<struct<filename:string,sha256:string,content_id:string>>"

ACCOUNTS = "account_id long, name string, kind string, sync_enabled boolean, folder_allow array<string>, folder_deny array<string>"
MAILBOXES = "mailbox_id long, account_id long, name string, flags array<string>, uidvalidity long, uidnext long, last_sync_at timestamp"
MESSAGES = (
    "message_id long, account_id long, internet_id string, raw_sha256 string, subject string, from_addr string, from_name string, to_addrs array<string>, "
    f"date_sent timestamp, internal_date timestamp, body_text string, body_html string, body_lang string, attachments {ATTACHMENTS}"
)
LABELS = "message_id long, mailbox_id long, uid long, flags array<string>"
CHUNKS = "chunk_id long, message_id long, kind string, chunk_idx int, text string, embedding array<float>"
BLOBS = "sha256 string, path string, mime_type string, size_bytes long, first_seen_at timestamp"
ARM_HIT = "message_id long, chunk_id long, chunk_table string, arm_score double, rank int, arm int"
FUSED_HIT = "message_id long, best_chunk_id long, best_chunk_table string, rrf_score double, contributing_arms array<int>"
PARSED_MESSAGE = (
    "internet_id string, in_reply_to string, refs array<string>, subject string, from_addr string, from_name string, to_addrs array<string>, cc_addrs array<string>, "
    "bcc_addrs array<string>, date_sent timestamp, headers map<string,array<string>>, body_text string, body_html string, raw_sha256 string, size_bytes long, "
    "attachments array<struct<filename:string,mime_type:string,sha256:string,content_id:string,size_bytes:long>>, error string"
)
