"""Structured filters of messages, exclusions and access control as one DataFrame step."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rank as R
from ..functions import text as X
from ..plans import dsl


def effective_date(internal: str = "internal_date", sent: str = "date_sent") -> Column:
    """The one date to sort and show by."""
    return F.coalesce(F.col(internal), F.col(sent))


def has_attachments(attachments: str = "attachments") -> Column:
    """True only for a non-empty array; null and anything malformed is no attachment."""
    return F.coalesce(F.size(F.col(attachments)) > 0, F.lit(False))


def attachment_names(attachments: str = "attachments") -> Column:
    return F.filter(F.transform(F.col(attachments), lambda a: a["filename"]), lambda n: n.isNotNull())


def clamp_accounts(requested: Iterable[int] | None, allowed: Iterable[int] | None) -> list[int] | None:
    """Accounts to search: the requested ones that are allowed; None means all, an empty list none."""
    if allowed is None:
        return None if requested is None else sorted(set(requested))
    return sorted(set(allowed) if requested is None else set(allowed) & set(requested))


def in_accounts(ids: list[int] | None, column: str = "account_id") -> Column:
    return F.lit(True) if ids is None else F.col(column).isin(ids) if ids else F.lit(False)


def conditions(f: dsl.Filters) -> list[Column]:
    """The filters that need no other table."""
    found = []
    if f.account_ids:
        found.append(F.col("account_id").isin(*f.account_ids))
    if f.sender is not None:
        found.append(F.col("from_addr").ilike(f"%{f.sender}%") | F.col("from_name").ilike(f"%{f.sender}%"))
    if f.recipient is not None:
        found.append(F.exists("to_addrs", lambda t: t.ilike(f"%{f.recipient}%")))
    if f.subject is not None:
        found.append(F.col("subject").ilike(f"%{f.subject}%"))
    if f.attachment_name is not None:
        found.append(F.coalesce(F.exists(attachment_names(), lambda n: F.contains(F.lower(n), F.lower(F.lit(f.attachment_name)))), F.lit(False)))
    if f.after is not None:
        found.append(F.col("date_sent") >= F.lit(f.after).cast("timestamp_ntz"))
    if f.before is not None:
        found.append(F.col("date_sent") < F.lit(f.before).cast("timestamp_ntz"))
    if f.has_attachment is not None:
        found.append(has_attachments() if f.has_attachment else ~has_attachments())
    if f.langs:
        found.append(F.col("body_lang").isin(*f.langs))
    return found


def body(messages: DataFrame | None) -> Column:
    """Plain text and the HTML body without its tags, in that order; tables without a body_html column, or none given, have the text alone."""
    if messages is None or "body_html" not in messages.columns:
        return F.col("body_text")
    return F.concat_ws(" ", "body_text", F.regexp_replace("body_html", r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<![A-Za-z][^>]*>|&#?[A-Za-z0-9]+;", " "))


def message_parts(messages: DataFrame | None = None) -> list[Column]:
    return [F.col("subject"), F.col("from_addr"), F.col("from_name"), body(messages), F.array_join("to_addrs", " ")]


def message_document(messages: DataFrame | None = None) -> Column:
    """Words of subject, sender, body and recipients, in that order."""
    return X.document(*message_parts(messages))


def weighted_parts(messages: DataFrame | None = None) -> list[tuple[Column, int]]:
    """The message's parts with their classes of weight, in order of position."""
    return [(F.col("subject"), 3), (F.concat_ws(" ", "from_addr", "from_name"), 2), (body(messages), 1), (F.array_join("to_addrs", " "), 0)]


def weighted(messages: DataFrame | None = None) -> Column:
    """The same words as array<struct<word,weight>>, by class of weight."""
    return R.weighted_document(*[part for part, _ in weighted_parts(messages)])


def text_match(tree, messages: DataFrame | None = None) -> Column:
    """A tree over the message or over its attachment names; names count only if an empty document would not match."""
    found = X.matches(tree, message_document(messages))
    if tree is not None:
        found = X.may_match(tree, F.lower(F.concat_ws(" ", *message_parts(messages)))) & found
    return found | _names_match(tree)


def _names_match(tree) -> Column:
    """A tree over the attachment names; nothing where an empty document would match."""
    if tree is None or dsl.holds(tree, " "):
        return F.lit(False)
    return F.coalesce(X.matches(tree, X.names_document(attachment_names())), F.lit(False))


def may_match(tree, messages: DataFrame | None = None) -> Column:
    """A cheap condition that holds wherever ``text_match`` does."""
    if tree is None:
        return F.lit(False)
    return X.may_match(tree, F.lower(F.concat_ws(" ", *message_parts(messages)))) | _names_match(tree)


def apply_filters(messages: DataFrame, query: dsl.Query, accounts: DataFrame | None = None, labels: DataFrame | None = None, mailboxes: DataFrame | None = None, allowed: Iterable[int] | None = None) -> DataFrame:
    """Messages that pass every filter, every whole-query exclusion and the access list.

    Folder and label filters are semi-joins, so a message in several folders stays
    one row.  An account name that is not known matches nothing.
    """
    f = query.filters
    out = messages
    for condition in [in_accounts(None if allowed is None else sorted(set(allowed))), *conditions(f)]:
        out = out.filter(condition)
    if f.accounts:
        out = out.join(accounts.filter(F.col("name").isin(*f.accounts)).select("account_id"), "account_id", "left_semi")
    for names in (F.col("name").isin(*f.folders) if f.folders else None, F.col("name").ilike(f.label) if f.label is not None else None):
        if names is not None:
            out = out.join(labels.join(mailboxes.filter(names).select("mailbox_id"), "mailbox_id", "left_semi"), "message_id", "left_semi")
    if f.folder_ids:
        out = out.join(labels.filter(F.col("mailbox_id").isin(*f.folder_ids)), "message_id", "left_semi")
    excluded = dsl.match_tree(dsl.excluded_text(query.free_text))
    if excluded is not None:
        # Every side of the tree is an exclusion; a message must be free of them in its text and in its names.
        out = out.filter(X.matches(excluded, message_document(out)) & X.matches(excluded, F.coalesce(X.names_document(attachment_names()), F.lit(" "))))
    return out
