"""Pages and the cursors that bind them to one snapshot and one request."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT, MOST = 20, 50


def bounded_limit(limit: int | None) -> int:
    return max(1, min(MOST, DEFAULT if limit is None else limit))


def bounded_limits(limit):
    """bounded_limit for a Column."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST), F.coalesce(limit, F.lit(DEFAULT))))


def page(ordered: DataFrame, offset: int, limit: int) -> tuple[list, bool]:
    """The rows of a page and whether more follow."""
    rows = ordered.offset(offset).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def scope_hash(*parts) -> str:
    return hashlib.sha256(b"".join(("" if p is None else str(p)).encode() + b"\0" for p in parts)).hexdigest()


def cursor(generation: int, offset: int, scope: str) -> str:
    return json.dumps({"version": 1, "generation": generation, "offset": offset, "scope": scope}).encode().hex()


class CursorError(ValueError):
    pass


class StaleCursor(CursorError):
    def __init__(self, generation: int):
        super().__init__("the cursor belongs to another snapshot")
        self.generation = generation


def offset_of(text: str | None, offset: int, generation: int, scope: str) -> int:
    """The offset that a request means; errors for a cursor that isn't its own, StaleCursor for an old one."""
    if text is None:
        return offset
    if offset:
        raise CursorError("cursor and offset exclude each other")
    try:
        found = json.loads(bytes.fromhex(text).decode())
        version, made, at, bound = (found[k] for k in ("version", "generation", "offset", "scope"))
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("the cursor can't be read") from e
    if version != 1 or bound != scope or not isinstance(at, int) or at < 0:
        raise CursorError("the cursor belongs to another request")
    if made != generation:
        raise StaleCursor(made)
    return at
