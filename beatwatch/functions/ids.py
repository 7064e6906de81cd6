"""Event identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*cols: Column | str) -> Column:
    """Id from the row's content, so replaying the same row gives the same id.

    Nulls are marked and the separator is a control character, so ('a', null) and (null, 'a') differ.
    """
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x1e")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def random_id() -> Column:
    return F.uuid()
