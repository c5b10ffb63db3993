"""Content-addressed ids as column expressions: md5 over NUL-led parts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def content_hash(*parts: Column, named: dict[str, Column] | None = None) -> Column:
    """md5 of each part led by NUL; named parts follow in key order as NUL key \\1 value."""
    pieces = [x for p in parts for x in (F.lit(NUL), p.cast("string"))]
    for key in sorted(named or {}):
        pieces += [F.lit(f"{NUL}{key}\1"), named[key].cast("string")]
    return F.md5(F.concat(*pieces))


def doc_id(text: Column) -> Column:
    return content_hash(text)


def chunk_id(content: Column) -> Column:
    return F.concat(F.lit("chunk-"), content_hash(content))


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("ent-"), content_hash(F.concat(name, F.lit(" - "), kind)))


def relation_id(subject_id: Column, object_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel-"), content_hash(F.concat(subject_id, F.lit(" -> "), object_id, kind)))


def community_id(level: Column, cluster: Column) -> Column:
    return F.concat(F.lit("com-"), content_hash(F.concat(level.cast("string"), F.lit(":"), cluster.cast("string"))))


def named_uuid(collection: str, key: Column) -> Column:
    """uuid5 in the URL namespace of ``collection:key``, without leaving the JVM."""
    raw = F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(F.concat(F.lit(f"{collection}:"), key), "utf-8"))
    h = F.sha1(raw)
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
