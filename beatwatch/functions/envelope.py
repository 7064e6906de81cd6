"""Wire envelope: one zero byte, a 4-byte big-endian schema id, then the body."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwatch.functions.text import _col
from beatwatch.schemas import EVENT_AVRO_SCHEMA, UNIFIED_EVENT

HEADER_BYTES = 5


def add_header(body: Column, schema_id: int) -> Column:
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), body)


def strip_header(value: Column | str) -> Column:
    """Drop the header; values of five bytes or fewer carry none and stay as they are."""
    value = _col(value)
    return F.when(
        F.length(value) > HEADER_BYTES, F.substring(value, HEADER_BYTES + 1, 2**31 - 1)
    ).otherwise(value)


def encode(event: Column, schema_id: int, codec: str = "json") -> Column:
    """Struct to wire bytes. ``avro`` needs the public spark-avro package on the classpath."""
    if codec == "avro":
        from pyspark.sql.avro.functions import to_avro

        return add_header(to_avro(event, json.dumps(EVENT_AVRO_SCHEMA)), schema_id)
    return add_header(F.to_json(event).cast("binary"), schema_id)


def decode(value: Column | str, codec: str = "json", schema: T.StructType = UNIFIED_EVENT) -> Column:
    """Wire bytes to struct; a JSON body that does not parse gives null fields."""
    body = strip_header(value)
    if codec == "avro":
        from pyspark.sql.avro.functions import from_avro

        return from_avro(body, json.dumps(EVENT_AVRO_SCHEMA))
    return F.from_json(body.cast("string"), schema)
