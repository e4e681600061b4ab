"""WARC records and a Merkle fixity audit of their replicas.

Records are hashed, and hashes of ordered offset ranges are hashed again, level by level, into one root for
each file. Each level is a table made once from the one below. Replicas with equal roots need no more reading; from a
root that differs the audit goes down only into nodes that differ, reads of each level their children alone, and lines
the records there up to find those that changed, went missing or were added.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrium.llm.tables import table
from atrium.storage import new_path, stored


@dataclass(frozen=True)
class MerkleConfig:
    records_per_file: int = 512
    fan_out: int = 8
    #: Files of the records without an id.
    null_files: int = 4096
    #: When the pages were fetched, as every record states it.
    date: str = "2024-01-01T00:00:00Z"


def record_bytes(url: Column, body: Column, date: str = MerkleConfig.date) -> Column:
    """One WARC/1.1 resource record: header lines, a blank line, the block and two line ends.

    The record's id is a UUID made of the MD5 of url and block, so equal records have equal ids and replicas agree on them.
    """
    block, target = F.coalesce(body.cast("string"), F.lit("")), F.coalesce(url.cast("string"), F.lit(""))
    digest = F.md5(F.concat(target, F.lit("\n"), block).cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r\n"))


def _file_id(digest: Column, cfg: MerkleConfig) -> Column:
    """The range of ``page_id``; rows without an id are dealt to files of their own by digest."""
    spread = F.lit(-(1 << 62)).cast("long") - F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % cfg.null_files
    return F.coalesce(F.floor(F.col("page_id") / cfg.records_per_file).cast("long"), spread)


def records(pages: DataFrame, cfg: MerkleConfig = MerkleConfig()) -> DataFrame:
    """``(page_id, file_id, url, seq, start, length, digest)`` for each row of ``pages(page_id, url, html)``.

    A file holds the pages of one range of ids, in order of id (then digest); ``start`` is the record's byte
    offset there. Null ids are in files of their own, by digest; null url and html are empty; repeated rows are records
    of their own. Other columns are left behind; an empty table gives no rows.

    Records are dealt out in order and numbered by blocks, so that a file of very many, or one record repeated very
    often, is no task's alone; equal records are interchangeable, so what tells them apart here changes no file.
    """
    record = record_bytes(F.col("url"), F.col("html"), cfg.date)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), record.alias("r")).select(
        "page_id", "url", F.octet_length("r").cast("long").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("digest"),
    )
    rows = stored(rows.select("*", _file_id(F.col("digest"), cfg).alias("file_id"), F.monotonically_increasing_id().alias("copy")))
    dealt = stored(rows.repartitionByRange("file_id", "page_id", "digest", "copy").withColumn("block", F.spark_partition_id()))
    return _numbered(dealt, ["page_id", "digest", "copy"]).select("page_id", "file_id", "url", "seq", "start", "length", "digest")


def _numbered(dealt: DataFrame, by: list[str]) -> DataFrame:
    """``dealt(file_id, block, length, ...)`` with ``seq`` and ``start`` in their file: by block, then in the order of ``by``."""
    sums = dealt.groupBy("file_id", "block").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("file_id", "block", F.coalesce(F.sum("n").over(earlier), zero).alias("n0"), F.coalesce(F.sum("bytes").over(earlier), zero).alias("b0"))
    order = Window.partitionBy("file_id", "block").orderBy(*by)
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = dealt.withColumns({"k": F.row_number().over(order) - 1, "upto": upto}).join(sums, ["file_id", "block"])
    return own.withColumns({"seq": (F.col("k") + F.col("n0")).cast("long"), "start": F.col("upto") - F.col("length") + F.col("b0")})


def height(cfg: MerkleConfig, *replicas: DataFrame) -> int:
    """Levels above the leaves: as planned, or as many more as the largest file needs."""
    n = max([cfg.records_per_file, *((r.agg(F.max("seq")).first()[0] or 0) + 1 for r in replicas)])
    levels = 0
    while n > 1:
        n, levels = -(-n // cfg.fan_out), levels + 1
    return levels


def merkle_levels(recs: DataFrame, cfg: MerkleConfig = MerkleConfig(), levels: int | None = None) -> list[DataFrame]:
    """Level 0 (leaves) to the roots, each ``(file_id, node, hash)``.

    A leaf hashes the record's offset range and digest, so moved records differ too; a node hashes its
    children's hashes in order, ``fan_out`` of them at most. Trees of one archive have one height.
    Every level is stored, so that the ones above it and an audit read hashes and never the records again.
    """
    leaf = F.sha2(F.concat_ws(":", "start", "length", "digest").cast("binary"), 256)
    out = [stored(recs.select("file_id", F.col("seq").alias("node"), leaf.alias("hash")))]
    for _ in range(height(cfg, recs) if levels is None else levels):
        kids = out[-1].groupBy("file_id", F.floor(F.col("node") / cfg.fan_out).cast("long").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("kids")
        )
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        out.append(stored(kids.select("file_id", F.col("parent").alias("node"), F.sha2(joined.cast("binary"), 256).alias("hash"))))
    return out


def differing(la: list[DataFrame], lb: list[DataFrame], cfg: MerkleConfig = MerkleConfig()) -> DataFrame | None:
    """``(file_id, seq)`` of the leaves that differ between two trees of one height; None where all roots are equal.

    Each level joins only the children of nodes that differed above; where none did, nothing below is read.
    """
    wanted = None
    for x, y in zip(reversed(la), reversed(lb), strict=True):
        x, y = x.withColumnRenamed("hash", "ha"), y.withColumnRenamed("hash", "hb")
        if wanted is not None:
            up = F.floor(F.col("node") / cfg.fan_out).cast("long")
            x = x.withColumn("up", up).join(wanted, ["file_id", "up"], "left_semi").drop("up")
            y = y.withColumn("up", up).join(wanted, ["file_id", "up"], "left_semi").drop("up")
        bad = x.join(y, ["file_id", "node"], "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
        wanted = stored(bad.select("file_id", F.col("node").alias("up")))
        if wanted.isEmpty():
            return None
    return wanted.select("file_id", F.col("up").alias("seq"))


def audit(a: DataFrame, b: DataFrame, cfg: MerkleConfig = MerkleConfig(), trees: tuple[list[DataFrame], list[DataFrame]] | None = None) -> DataFrame:
    """Compare the record tables of two replicas: ``(file_id, seq, status)`` of the records that are not the same.

    status: changed, missing (not in ``b``) or added (not in ``a``); ``seq`` is the place in ``a``, for added ones in ``b``.
    Leaves differ from the first record that is gone or longer, as all after it have moved; so the records of the
    differing leaves are lined up: those with the same file, url and digest in both are whole wherever they lie, of the
    others those with the same url changed, the first with the first. A record without a url has nothing to be known by
    and is one missing and one added. Equal or empty replicas give no rows. ``trees`` are the levels of both, where they are
    known.
    """
    if trees is None:
        levels = height(cfg, a, b)
        trees = merkle_levels(a, cfg, levels), merkle_levels(b, cfg, levels)
    spots = differing(*trees, cfg)
    if spots is None:
        return a.sparkSession.createDataFrame([], "file_id bigint, seq bigint, status string")
    key = F.nullif(F.col("url"), F.lit("")).alias("key")
    side = lambda t, name: t.join(spots, ["file_id", "seq"], "left_semi").select("file_id", "seq", key, "digest", F.lit(name).alias("side"))
    both = stored(side(a, "a").unionByName(side(b, "b")))
    in_a = F.when(F.col("side") == "a", 1).otherwise(-1)
    sums = both.groupBy("file_id", "key", "digest").agg(F.sum(in_a).alias("over")).where("over <> 0")
    sums = sums.select(F.col("file_id").alias("f"), F.col("key").alias("k"), F.col("digest").alias("d"), "over")
    rest = both.join(sums, (F.col("file_id") == F.col("f")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))).drop("f", "k", "d")
    rest = rest.where(F.when(F.col("over") > 0, F.col("side") == "a").otherwise(F.col("side") == "b"))
    copies = Window.partitionBy("file_id", "key", "digest", "side").orderBy(F.desc("seq"))
    rest = stored(rest.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= F.abs("over")))
    nth = Window.partitionBy("file_id", "key", "side").orderBy("seq")
    rest = rest.withColumn("at", F.when(F.col("key").isNotNull(), F.row_number().over(nth)))
    x = rest.where("side = 'a'").select("file_id", "key", "at", F.col("seq").alias("sa"))
    y = rest.where("side = 'b'").select(F.col("file_id").alias("f"), F.col("key").alias("k"), F.col("at").alias("t"), F.col("seq").alias("sb"))
    out = x.join(y, (F.col("file_id") == F.col("f")) & (F.col("key") == F.col("k")) & (F.col("at") == F.col("t")), "full_outer")
    status = F.when(F.col("sb").isNull(), "missing").when(F.col("sa").isNull(), "added").otherwise("changed")
    return out.select(F.coalesce("file_id", "f").alias("file_id"), F.coalesce("sa", "sb").alias("seq"), status.alias("status"))


def damaged(pages: DataFrame, share: int = 64, lost: int = 1024) -> DataFrame:
    """A replica for fixity drills: html's first character is overwritten where the page's hash falls in 1 of ``share``,
    and where it falls in another 1 of ``lost`` the page is gone.

    Pages are chosen by id, so the same table is always damaged at the same places.
    """
    pick = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("long")
    other = F.when(F.col("html").startswith("~"), F.lit("!")).otherwise(F.lit("~"))
    hit = (pick % share == 0) & (F.length("html") > 0)
    html = F.when(hit, F.concat(other, F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.where(F.coalesce(pick % lost != 1, F.lit(True))).select("page_id", "url", html.alias("html"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the archive, its file's root, and what an audit of a replica's files says of it.

    The replica is written as WARC files of records compressed one by one, with some pages damaged on the way, and read back.
    """
    cfg = MerkleConfig()
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    a = stored(records(pages, cfg))
    path = f"{new_path(spark)}/warc"
    write_warc(damaged(pages), path, cfg, compression="gzip")
    b = stored(file_records(read_warc(spark, f"{path}/file_id=*/part-*")))
    levels = height(cfg, a, b)
    trees = merkle_levels(a, cfg, levels), merkle_levels(b, cfg, levels)
    found = audit(a, b, cfg, trees).where("status <> 'added'")  # those have no place in the archive
    roots = trees[0][-1].select("file_id", F.col("hash").alias("root"))
    out = a.join(found, ["file_id", "seq"], "left").join(roots, "file_id")
    return out.select(
        "page_id", "file_id", "seq", "start", "length", "digest", "root", F.coalesce("status", F.lit("intact")).alias("status")
    )


def _members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member, decompressed one at a time; the whole where the content is not gzip."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at = 0
    while content[at : at + 2] == b"\x1f\x8b":
        z, end, parts = zlib.decompressobj(wbits=31), at, []
        while not z.eof and end < len(content):
            parts.append(z.decompress(content[end : end + step]))
            end += step
        yield at, b"".join([*parts, z.flush()])
        if not z.eof:
            return
        at = min(end, len(content)) - len(z.unused_data)


def _records(content: bytes) -> Iterator[tuple]:
    """``(member, start, length, url, body, digest)`` of the records in the bytes of one file."""
    before = 0
    for member, data in _members(content):
        at = 0
        while data.startswith(b"WARC/", at) and (end := data.find(b"\r\n\r\n", at)) >= 0:
            head = data[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
            length = fields.get("content-length", "")
            if not length.isdecimal():
                break
            stop = min(len(data), end + 4 + int(length) + 4)
            body = data[end + 4 : end + 4 + int(length)].decode("utf-8", "replace")
            yield member, before + at, stop - at, fields.get("warc-target-uri"), body, hashlib.sha256(memoryview(data)[at:stop]).hexdigest()
            at = stop
        before += len(data)


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """``(file, member, start, length, url, body, digest)`` of the records in WARC files, plain or gzip.

    Files are Spark's unit here: keep them at the usual size for one archive file (1 GB; Spark reads at most 2 GB). A gzip
    member is inflated at a time, and records are handed on about ``batch_bytes`` at a time. Records are cut by their
    Content-Length, in the order of the file; a truncated last record is returned with what is there, and a header that
    can't be read ends its member. ``start`` counts the bytes before compression; ``member`` is where the record's gzip
    member begins in the file, so that records compressed one by one can be fetched alone. ``digest`` is the SHA-256 of
    the record's bytes. An empty file has no records.
    """
    schema = "file string, member bigint, start bigint, length bigint, url string, body string, digest string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "member", "start", "length", "url", "body", "digest"]
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows, held = [], 0
                for found in _records(content):
                    rows.append((file, *found))
                    held += found[2]
                    if held >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, schema)


def file_records(read: DataFrame) -> DataFrame:
    """``(file_id, url, seq, start, length, digest)`` of records read from files under ``file_id=N``, in the order of the file.

    A file of very many records lies there in several parts; each is numbered by itself and moved by what the parts before
    it hold, so no task sees a whole file. Where bytes are in no record, as after a header that can't be read, what comes
    after them moves up.
    """
    file_id, part = F.regexp_extract("file", r"file_id=(-?\d+)", 1).cast("long"), F.regexp_extract("file", r"/part-(\d+)", 1)
    block = F.struct(F.when(part != "", part.cast("long")).alias("part"), "file").alias("block")
    dealt = stored(read.select(file_id.alias("file_id"), block, F.coalesce("url", F.lit("")).alias("url"), F.col("start").alias("at"), "length", "digest"))
    return _numbered(dealt, ["at"]).select("file_id", "url", "seq", "start", "length", "digest")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(file_id, value)``: records as gzip members of their own, that end with a zero byte.

    A member ends with its size, low byte first, so its last byte is zero up to 16 MB; a larger one is followed by an
    empty member, which adds nothing to what is read.
    """
    for batch in batches:
        packed = (gzip.compress(v.as_py(), 6, mtime=0) for v in batch.column(1))
        done = pa.array([m if m[-1] == 0 else m + gzip.compress(b"", mtime=0) for m in packed], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), done], names=["file_id", "value"])


def write_warc(pages: DataFrame, path: str, cfg: MerkleConfig = MerkleConfig(), compression: str = "none") -> None:
    """Write the records of ``pages`` as WARC files, one for each range of ids, under ``path/file_id=N``.

    Rows without an id go to the files that ``records`` gives them. Rows are dealt out in order, so that a file of very many
    is written by many tasks, in parts whose names are in the order of their records. ``compression``: none, or gzip of
    each record by itself. A task that is run again writes the same bytes.
    """
    rows = pages.select("page_id", record_bytes(F.col("url"), F.col("html"), cfg.date).cast("binary").alias("value"))
    rows = rows.withColumn("digest", F.sha2(F.col("value"), 256))
    rows = rows.withColumns({"file_id": _file_id(F.col("digest"), cfg), "copy": F.monotonically_increasing_id()})
    order = ["file_id", "page_id", "digest", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("file_id", "value")
    if compression == "gzip":
        rows = rows.mapInArrow(_compressed, "file_id bigint, value binary")
    elif compression != "none":
        raise ValueError(f"no such compression of records: {compression}")
    # The writer ends each row with one byte: the last one of a member, or the last line feed.
    line = F.expr("substring(value, 1, length(value) - 1)").cast("string").alias("value")
    end = "\x00" if compression == "gzip" else "\n"
    rows.select("file_id", line).write.partitionBy("file_id").option("lineSep", end).option("compression", "none").text(path)


ORACLE = r"""
WITH p AS (SELECT page_id, url, html, ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4))::INT AS pick FROM pages),
r AS (SELECT page_id, CAST(floor(page_id / 512) AS BIGINT) AS file_id,
   CASE WHEN pick % 1024 = 1 THEN 'missing' WHEN pick % 64 = 0 AND length(html) > 0 THEN 'changed' ELSE 'intact' END AS status,
   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
   || regexp_replace(md5(coalesce(url, '') || chr(10) || coalesce(html, '')), '^(.{8})(.{4})(.{4})(.{4})', '\1-\2-\3-\4-') || '>' || chr(13) || chr(10)
   || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
   || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p),
h AS (SELECT page_id, file_id, status, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM r),
l0 AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w AS BIGINT) - length AS start FROM h
   WINDOW w AS (PARTITION BY file_id ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)),
l1 AS (SELECT file_id, seq // 8 AS node, sha256(string_agg(sha256(start || ':' || length || ':' || digest), '' ORDER BY seq)) AS h FROM l0 GROUP BY ALL),
l2 AS (SELECT file_id, node // 8 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM l1 GROUP BY file_id, node // 8),
l3 AS (SELECT file_id, sha256(string_agg(h, '' ORDER BY node)) AS root FROM l2 GROUP BY file_id)
SELECT page_id, file_id, seq, start, length, digest, root, status FROM l0 JOIN l3 USING (file_id)
"""
