"""Keyset walks over effective dates, their cursors, and a cache of ranked pools."""

from __future__ import annotations

import base64
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from secrets import token_urlsafe

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dsl import QueryError


@dataclass(frozen=True)
class Cursor:
    """Where a walk goes on: the last row's date (None if undated), its id, and the direction."""

    when: datetime | None
    message_id: int
    order: str = "desc"
    text: bool = False

    def encode(self) -> str:
        body = f"{self.order}|{int(self.text)}|{self.when.isoformat() if self.when else ''}|{self.message_id}"
        return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(text: str, order: str | None = None, with_words: bool | None = None) -> Cursor:
    """The cursor of a walk in the given order, of a query with or without words to match; another walk's is refused."""
    try:
        given, with_text, when, message_id = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().split("|")
        cursor = Cursor(datetime.fromisoformat(when) if when else None, int(message_id), given, with_text == "1")
    except (ValueError, UnicodeDecodeError) as e:
        raise QueryError("that is no cursor") from e
    if cursor.order not in ("asc", "desc") or order not in (None, cursor.order):
        raise QueryError("the cursor belongs to another order")
    if with_words not in (None, cursor.text):
        raise QueryError("the cursor belongs to a query with words" if cursor.text else "the cursor belongs to a query without words")
    return cursor


def walk_order(order: str, date: str = "effective_date", key: str = "message_id") -> list[Column]:
    """Descending: dated first, newest first; ascending: undated first, then oldest first."""
    return [F.desc_nulls_last(date), F.desc(key)] if order == "desc" else [F.asc_nulls_first(date), F.asc(key)]


def after_cursor(cursor: Cursor | None, date: str = "effective_date", key: str = "message_id") -> Column:
    """Rows that come after the cursor's in its order, undated ones included; stated without comparing structs, since engines differ on nulls there."""
    if cursor is None:
        return F.lit(True)
    d, k, at = F.col(date), F.col(key), F.lit(cursor.when)
    if isinstance(cursor.when, datetime) and cursor.when.tzinfo is None:
        at = F.lit(cursor.when.isoformat(sep=" ")).cast("timestamp_ntz")
    if cursor.order == "desc":
        if cursor.when is None:
            return d.isNull() & (k < cursor.message_id)
        return (d < at) | ((d == at) & (k < cursor.message_id)) | d.isNull()
    if cursor.when is None:
        return (d.isNull() & (k > cursor.message_id)) | d.isNotNull()
    return (d > at) | ((d == at) & (k > cursor.message_id))


def walk(rows: DataFrame, size: int, order: str = "desc", cursor: Cursor | None = None, date: str = "effective_date", key: str = "message_id") -> DataFrame:
    """The next ``size + 1`` rows; the one too many says that there are more."""
    return rows.filter(after_cursor(cursor, date, key)).orderBy(*walk_order(order, date, key)).limit(size + 1)


class PoolCache:
    """Ranked pools by opaque token: the most recent ones, for a while, for the user who asked."""

    def __init__(self, most: int = 16, seconds: float = 1200, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self._pools: OrderedDict[str, tuple[float, object, object]] = OrderedDict()

    def put(self, pool: object, user: object = None, token: str | None = None) -> str:
        token = token or token_urlsafe(16)
        self._pools[token] = (self.clock() + self.seconds, user, pool)
        self._pools.move_to_end(token)
        while len(self._pools) > self.most:
            self._pools.popitem(last=False)
        return token

    def get(self, token: str, user: object = None) -> object | None:
        found = self._pools.get(token)
        if found is None or found[1] != user:
            return None
        if found[0] < self.clock():
            del self._pools[token]
            return None
        self._pools.move_to_end(token)
        return found[2]
