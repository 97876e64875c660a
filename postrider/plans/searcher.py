"""Searches from query text to pages: parse, scope, retrieve, fuse, cut, hydrate, rerank, page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import arms, cells, filters, fusion, paging, positions, postings, shapes
from . import dsl

#: Fields that a hit can be asked for, in the order they are given.
FIELDS = ("message_id", "rank", "score", "subject", "from_addr", "effective_date", "snippet", "snippet_source", "best_chunk_id", "best_chunk_table", "contributing_arms", "rrf_score")


@dataclass
class Archive:
    """The tables a search reads; chunks and attachment tables may be absent."""

    messages: DataFrame
    accounts: DataFrame | None = None
    labels: DataFrame | None = None
    mailboxes: DataFrame | None = None
    chunks: DataFrame | None = None
    attachment_chunks: DataFrame | None = None
    #: Postings of the messages; with them a text search opens only the messages that can match.
    postings: DataFrame | None = None
    #: Positional index of the messages; with it the first arm reads no texts.
    positions: positions.Index | None = None
    #: Index of the chunks' vectors by cell; with it the vector arm reads ``Searcher.probes`` cells.
    cells: cells.Cells | None = None


@dataclass
class Page:
    rows: list[dict]
    next_cursor: str | None = None
    token: str | None = None


@dataclass
class Searcher:
    archive: Archive
    embed: Callable[[str], list[float]] | None = None
    score: Callable[[str, list[str]], list[float]] | None = None
    rewrite: Callable[[str], tuple[str | None, list[str], dsl.Filters]] | None = None
    candidates: int = 50
    pool_size: int = 100
    #: Cells of the vector index that a search reads; None is exact.
    probes: int | None = 16
    pools: paging.PoolCache = field(default_factory=paging.PoolCache)

    def scoped(self, query: dsl.Query, allowed) -> DataFrame:
        a = self.archive
        found = filters.apply_filters(a.messages, query, a.accounts, a.labels, a.mailboxes, allowed)
        return found.withColumn("effective_date", filters.effective_date())

    def fused(self, query: dsl.Query, allowed, candidates: int) -> DataFrame:
        a, messages = self.archive, self.scoped(query, allowed)
        if a.positions is not None:
            found = [arms.indexed_text_arm(a.positions, messages, query, candidates)]
        else:
            likely = None if a.postings is None else postings.candidates(a.postings, dsl.expanded_tree(query))
            found = [arms.message_text_arm(messages if likely is None else messages.join(likely, "message_id", "left_semi"), query, candidates, cover_density=True)]
        if a.chunks is not None:
            found.append(arms.chunk_text_arm(a.chunks, messages, query, candidates, cover_density=True))
        if self.embed is not None:
            vector = self.embed(dsl.semantic_text(query.free_text))
            if a.cells is not None:
                found.append(arms.indexed_vector_arm(a.cells, messages, vector, candidates, self.probes))
            elif a.chunks is not None:
                found.append(arms.chunk_vector_arm(a.chunks, messages, vector, candidates))
            if a.attachment_chunks is not None:
                carriers = messages.select("message_id", "date_sent", F.explode("attachments.sha256").alias("sha256"))
                found.append(arms.attachment_vector_arm(a.attachment_chunks, carriers, vector, candidates))
        return fusion.fuse(found)

    def _pool(self, query: dsl.Query, allowed, candidates: int, served: list[int]) -> list[dict]:
        fused = self.fused(query, allowed, candidates)
        if served:
            fused = fused.filter(~F.col("message_id").isin(served))
        dates = self.archive.messages.select("message_id", filters.effective_date().alias("effective_date"))
        pool = fusion.cut_pool(fused, dates, self.pool_size)
        terms = X.required_words(dsl.match_tree(query.free_text))
        hydrated = fusion.hydrate(pool, self.archive.messages, self.archive.chunks, terms, attachment_chunks=self.archive.attachment_chunks)
        rows = [r.asDict() | {"text": r["snippet"]} for r in hydrated.collect()]
        return fusion.rerank(rows, query.free_text, self.score)

    def search(self, text: str, allowed=None, size: int = 20, sort: str | None = None, order: str | None = None, cursor: str | None = None, user=None) -> Page:
        """One page: ranked, or a walk by date if there is nothing to rank by or date is asked for."""
        query = dsl.parse(text)
        axis, direction = dsl.sort_order(query.free_text, sort, order)
        if axis == "date":
            return self._walk(query, allowed, size, direction, cursor)
        if self.rewrite is not None:
            try:
                query = dsl.merge_rewrite(query, *self.rewrite(query.free_text))
            except Exception:  # noqa: BLE001  a rewriter that fails leaves the query as it was
                pass
        rows = self._pool(query, allowed, self.candidates, [])
        token = self.pools.put({"rows": rows, "query": query, "allowed": allowed, "candidates": self.candidates}, user)
        return self.page(token, 1, size, user)

    def page(self, token: str, number: int, size: int = 20, user=None) -> Page:
        """A page of a pool; past its end the pool is grown with twice the candidates, without what it holds already."""
        pool = self.pools.get(token, user)
        if pool is None:
            raise dsl.QueryError("the search has expired")
        low = (number - 1) * size
        if low >= len(pool["rows"]) and pool["candidates"] < 800:
            pool["candidates"] = min(800, 2 * pool["candidates"])
            pool["rows"] += self._pool(pool["query"], pool["allowed"], pool["candidates"], [r["message_id"] for r in pool["rows"]])
        rows = [r | {"rank": i + 1} for i, r in enumerate(pool["rows"][low : low + size])]
        return Page(rows, None, token)

    def _walk(self, query: dsl.Query, allowed, size: int, order: str, cursor: str | None) -> Page:
        tree = dsl.match_tree(query.free_text)
        at = paging.decode_cursor(cursor, order, tree is not None) if cursor else None
        rows = self.scoped(replace(query), allowed)
        if tree is not None:
            rows = rows.filter(filters.text_match(tree, rows))
        got = paging.walk(rows.select("message_id", "subject", "from_addr", "effective_date"), size, order, at).collect()
        shown = [r.asDict() | {"rank": i + 1, "score": 1 / (i + 1), "snippet": ""} for i, r in enumerate(got[:size])]
        more = paging.Cursor(got[size - 1]["effective_date"], got[size - 1]["message_id"], order, tree is not None).encode() if len(got) > size else None
        return Page(shown, more)


def project(rows: list[dict], fields: list[str]) -> list[dict]:
    """Hits with only the named fields, in their fixed order; unknown names and more than 48 are refused."""
    if len(fields) > 48 or (unknown := [f for f in fields if f not in FIELDS]):
        raise dsl.QueryError(f"no such fields: {unknown}" if len(fields) <= 48 else "too many fields")
    return [{f: r.get(f) for f in FIELDS if f in fields} for r in rows]


def browse(archive: Archive, allowed, account_ids=None, folder_ids=None, size: int = 50, cursor: str | None = None) -> Page:
    """Messages of the allowed accounts, newest first, folder by semi-join."""
    ids = filters.clamp_accounts(account_ids, allowed)
    rows = archive.messages.filter(filters.in_accounts(ids)).withColumn("effective_date", filters.effective_date())
    if folder_ids:
        rows = rows.join(archive.labels.filter(F.col("mailbox_id").isin(*folder_ids)), "message_id", "left_semi")
    at = paging.decode_cursor(cursor, "desc") if cursor else None
    got = paging.walk(rows.select("message_id", "account_id", "subject", "effective_date"), size, "desc", at).collect()
    more = paging.Cursor(got[size - 1]["effective_date"], got[size - 1]["message_id"]).encode() if len(got) > size else None
    return Page([r.asDict() for r in got[:size]], more)


def message_detail(archive: Archive, message_id: int, allowed) -> dict | None:
    """One message with its folders by name, or None where it is missing or not allowed."""
    ids = filters.clamp_accounts(None, allowed)
    found = archive.messages.filter((F.col("message_id") == message_id) & filters.in_accounts(ids))
    own = archive.labels.filter(F.col("message_id") == message_id)
    boxes = own.join(archive.mailboxes, "mailbox_id").groupBy("message_id").agg(F.sort_array(F.collect_set("name")).alias("folders"))
    rows = found.join(boxes, "message_id", "left").limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def message_view(archive: Archive, message_id: int, allowed, blobs: DataFrame | None = None, external_images: bool = False) -> dict | None:
    """One message with its addresses, account, folders and attachments nested and its HTML made safe, or None where it is missing or not allowed."""
    ids = filters.clamp_accounts(None, allowed)
    found = archive.messages.filter((F.col("message_id") == message_id) & filters.in_accounts(ids))
    own = archive.labels.filter(F.col("message_id") == message_id)
    rows = shapes.details(found, archive.accounts, own, archive.mailboxes, blobs, external_images=external_images).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def readable_blob(archive: Archive, sha256: str, allowed) -> bool:
    """Whether an allowed message carries the attachment."""
    ids = filters.clamp_accounts(None, allowed)
    carries = F.exists("attachments", lambda a: a["sha256"] == sha256)
    return not archive.messages.filter(filters.in_accounts(ids) & F.coalesce(carries, F.lit(False))).limit(1).isEmpty()

