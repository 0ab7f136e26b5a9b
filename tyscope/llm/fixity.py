"""WARC records and a Merkle fixity audit of two replicas.

Records lie in files in a fixed order, each at the offset where the one before ends. A
leaf of the tree hashes the records of one range of offsets (``RANGE_BYTES``) of a file
in order; a node hashes up to ``FANOUT`` children. The upper levels go on over the
files, so each replica has one root. The audit compares the roots and then, level by
level, only the children of nodes that differ, down to the records of differing ranges.

A group never holds more than the records of one range or ``FANOUT`` children, whatever
the size of the replicas; each level is a written table a sixteenth of the one below.

Offsets of both replicas are those of the index kept with the files, so a lost or
shortened record does not move the others.

Cases: a null url or html is empty; rows equal in all columns are records of their own
with offsets of their own; an empty replica has no root and all records of the other are
missing or extra; two empty replicas are equal; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.session import materialize

FILE_BYTES = 64 << 20
RANGE_BYTES = 16 << 10
FANOUT = 16


def warc_record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as the text of a WARC response record."""
    body = F.coalesce(F.col(html), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
                    F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def record_index(pages: DataFrame, stored: Column | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, warc_file, warc_offset, n_bytes and the digest of each page's record.

    ``stored`` is the record as a replica holds it (null: lost), by default the record."""
    record = warc_record()
    held = record if stored is None else stored
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url")), 1, 8), 16, 10).cast("bigint")
    rows = pages.select("page_id", key.alias("_key"), F.octet_length(record).cast("bigint").alias("n_bytes"),
                        F.sha2(record, 256).alias("_whole"), F.sha2(held, 256).alias("digest"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    place = (Window.partitionBy("warc_file").orderBy("page_id", "_whole")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("warc_file", (F.col("_key") % files).cast("bigint"))
            .withColumn("warc_offset", F.coalesce(F.sum("n_bytes").over(place), F.lit(0)))
            .where("digest is not null").select("page_id", "warc_file", "warc_offset", "n_bytes", "digest"))


def _levels(records: DataFrame, range_bytes: int, fanout: int) -> tuple[list[DataFrame], Column]:
    """Node tables (replica, node, hash) from the leaves to the root, and the leaf number of
    a record; ``records`` has replica, warc_file, warc_offset and digest."""
    span, top = records.agg(F.max(F.expr(f"warc_offset div {range_bytes}")), F.max("warc_file")).first()
    width = fanout
    while width <= (span or 0):
        width *= fanout  # ranges of a file, rounded up to whole subtrees
    leaf = F.col("warc_file") * width + F.expr(f"warc_offset div {range_bytes}")
    inside = F.array_sort(F.collect_list(F.struct("warc_offset", "digest")))
    level = materialize(
        records.groupBy("replica", leaf.alias("node"))
        .agg(F.sha2(F.array_join(F.transform(inside, lambda r: F.concat(r["warc_offset"].cast("string"), F.lit(":"), r["digest"])),
                                 ","), 256).alias("hash")), "merkle-0")
    levels, size = [level], ((top or 0) + 1) * width
    while size > 1:
        size = -(-size // fanout)
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        level = materialize(
            level.groupBy("replica", F.expr(f"node div {fanout}").alias("up"))
            .agg(F.sha2(F.array_join(F.transform(children, lambda r: F.concat(r["node"].cast("string"), F.lit(":"), r["hash"])),
                                     ","), 256).alias("hash")).withColumnRenamed("up", "node"), f"merkle-{len(levels)}")
        levels.append(level)
    return levels, leaf


def _differing(level: DataFrame) -> DataFrame:
    """Nodes that the replicas have with different hashes, or only one of them has."""
    pair = level.groupBy("node").agg(F.max(F.when(F.col("replica") == 0, F.col("hash"))).alias("a"),
                                     F.max(F.when(F.col("replica") == 1, F.col("hash"))).alias("b"))
    return pair.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas (``record_index`` tables) differ: page_id, warc_file,
    warc_offset, n_bytes, status (altered, missing or extra in the second), both digests."""
    records = materialize(first.withColumn("replica", F.lit(0)).unionByName(second.withColumn("replica", F.lit(1))),
                          "merkle-records")
    levels, leaf = _levels(records, range_bytes, fanout)
    differing = _differing(levels[-1])
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.expr(f"node div {fanout}")).join(
            differing.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
        differing = _differing(below)
    hit = records.withColumn("node", leaf).join(differing, "node", "left_semi")
    pair = hit.groupBy("page_id", "warc_file", "warc_offset", "n_bytes").agg(
        F.max(F.when(F.col("replica") == 0, F.col("digest"))).alias("first_digest"),
        F.max(F.when(F.col("replica") == 1, F.col("digest"))).alias("second_digest"))
    status = (F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra")
              .otherwise("altered"))
    return (pair.where(~F.col("first_digest").eqNullSafe(F.col("second_digest")))
            .select("page_id", "warc_file", "warc_offset", "n_bytes", status.alias("status"), "first_digest", "second_digest"))


def root(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> str | None:
    """Root hash of one replica."""
    levels, _ = _levels(records.withColumn("replica", F.lit(0)), range_bytes, fanout)
    row = levels[-1].select("hash").first()
    return row[0] if row else None
