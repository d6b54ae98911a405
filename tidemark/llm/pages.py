"""Web pages as WARC records, with revisit records for payloads that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.llm.common import saved
from tidemark.llm.warc import read_warc, write_warc
from tidemark.session import work_path

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: A table of repeated payloads of at most so many rows (about 20 MB) is broadcast, a larger one joined.
BROADCAST_ROWS = 200_000
URN = "urn:page:"


def _name(id_: Column) -> Column:
    """A record's name. A null id has none behind the prefix; an empty one, and those that start with a per cent sign, are marked with it."""
    text = id_.cast("string")
    marked = F.when(text == "", "%00").when(F.startswith(text, F.lit("%")), F.concat(F.lit("%25"), F.substring(text, 2, 1 << 30))).otherwise(text)
    return F.concat(F.lit(URN), F.coalesce(marked, F.lit("")))


def _id(name: Column, kind: T.DataType) -> Column:
    """The id in a record's name."""
    text = F.substring(name, len(URN) + 1, 1 << 30)
    plain = F.when(text == "%00", "").when(F.startswith(text, F.lit("%25")), F.concat(F.lit("%"), F.substring(text, 4, 1 << 30))).otherwise(text)
    return F.when(text != "", plain).cast(kind)


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per page, in the columns of the WARC source. Of pages with the same payload of at
    least ``LEAST_BYTES`` bytes, those with the largest id (one, unless rows repeat) are responses and
    the others revisit it; null ids are smaller than all others. A null payload is empty."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    large = rows.where(F.col("length") >= LEAST_BYTES)
    tops = large.groupBy("digest", "length").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1 AND top IS NOT NULL")
    tops = saved(tops.select("digest", "length", "top"), "warc-repeats")
    if tops.count() <= BROADCAST_ROWS:
        tops = F.broadcast(tops)
    joined = rows.join(tops, ["digest", "length"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _name(F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("record_date"),
        F.when(revisit, _name(F.col("top"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, **columns: str) -> None:
    write_warc(page_records(pages, **columns), path)


def archived(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back: id, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``. Payloads of responses are unpacked and measured anew; revisits
    are read from their headers alone. Empty tables give empty archives and no rows; other columns
    than id, url and html are not read."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    archive(pages, path, id_col=id_col)
    kind = pages.schema[id_col].dataType
    own = lambda c: _id(F.col(c), kind)
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select(own("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(own("record_id").alias(id_col), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", own("refers_to").alias("refers_to"))
    return full.unionByName(again)
