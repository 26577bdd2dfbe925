"""Merkle fixity audit of WARC replicas.

Records are hashed as they stand in the archive. A leaf holds the records that begin in one range of
RANGE_BITS bits of offsets of a file, in the order of their offsets; a node holds FAN ordered neighbouring
ranges, so its hash fixes an ordered range of offsets and all that stands there. The root of a file is a leaf
of a trie over the hashes of the file names, up to one root for the whole replica. The audit compares the
roots of two replicas and then, level by level, only the children of the nodes that differ, until it has
the ranges, and in those the records, that are damaged. Changed bytes, a lost record and two records that
change places are all seen.

Only hashes, offsets and lengths are shuffled. A range holds few records, as each has a header; a node has
FAN children at most. Equal records of a table are laid out as one run with a number of copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rastrum.session import checkpoint, partitions_of

RANGE_BITS = 12  # a leaf covers 4096 bytes of offsets
FAN_BITS = 6
FAN = 1 << FAN_BITS
DEPTH = 2  # levels above the leaves up to the root of a file, at least; enough for 16 MB
GROUP_BITS = 8  # a file of a table holds 2 ** GROUP_BITS page ids
FILE_BYTES = 1 << 20  # bytes from which such a group is dealt to several files
CHUNK = 1 << 20  # bytes of an archive that are decompressed at once


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """A page as a WARC resource record; nulls are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _bytes_and_hash(html: Column) -> list[Column]:
    record = warc_record(F.col("page_id"), F.col("url"), html).cast("binary")
    return [F.octet_length(record).cast("long"), F.sha2(record, 256)]


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", replica: Column | None = None) -> DataFrame:
    """(file, offset, length, copies, page_id, sha256) of the records of a table laid out in archive files, a row for each run of equal records.

    A file holds the records of 2 ** GROUP_BITS page ids in the order of ids and hashes; a group of more than
    FILE_BYTES (few ids with very many records, or the records without an id, which are a group of their own)
    is dealt to several files by hash. Null urls and texts are empty, equal rows are copies in one run, texts
    of any length are hashed whole; an empty table gives an empty result; other columns are ignored. With
    replica, a second text of each record, null where it is lost, replica_length and replica_sha256 come along.
    """
    names = ["length", "sha256"] + ["replica_length", "replica_sha256"] * (replica is not None)
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    made = _bytes_and_hash(F.col("html")) + ([F.when(replica.isNotNull(), x) for x in _bytes_and_hash(replica)] if replica is not None else [])
    runs = df.select("page_id", *[c.alias(n) for c, n in zip(made, names, strict=True)]).groupBy("page_id", *names).agg(F.count("*").alias("copies"))
    runs = checkpoint(runs.withColumn("group", F.coalesce(F.shiftright("page_id", GROUP_BITS).cast("string"), F.lit("null"))))
    large = runs.groupBy("group").agg(F.sum(F.col("length") * F.col("copies")).alias("n")).where(F.col("n") > FILE_BYTES)
    large = large.select("group", F.ceil(F.col("n") / FILE_BYTES).cast("long").alias("files"))
    part = F.coalesce(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long") % F.col("files"), F.lit(0))
    dealt = runs.join(large, "group", "left").withColumn("file", F.concat("group", F.lit("-"), part.cast("string")))
    size = F.col("length") * F.col("copies")
    place = F.sum(size).over(Window.partitionBy("file").orderBy("page_id", "sha256")) - size
    return dealt.select("file", place.alias("offset"), "copies", "page_id", *names)


def _hash(children: Column) -> Column:
    """The hash of ordered children, structs of a place and what is said about it."""
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: c["says"]), ",").cast("binary"), 256)


def shape(*sides: DataFrame) -> tuple[int, int]:
    """(levels in a file, digits of the trie over files) that suit all of these records."""
    ends = [r.agg(F.max("offset").alias("far"), F.approx_count_distinct("file").alias("files")).first() for r in sides]
    bits = max((e["far"] or 0).bit_length() for e in ends)
    return max(DEPTH, -(-(bits - RANGE_BITS) // FAN_BITS)), -(-max(e["files"] for e in ends).bit_length() // 4)


def tree(records: DataFrame, depth: int = DEPTH, digits: int = 1) -> list[DataFrame]:
    """(scope, node, up_scope, up_node, n_records, n_bytes, hash) of the nodes of each level over (file, offset, length, copies, sha256).

    Level 0 are the ranges of offsets, level depth the roots of the files, and the last level is the root of
    the replica, one row unless there are no records.
    """
    cores = partitions_of(records.sparkSession)
    prefix = lambda k: F.substring(F.md5(F.col("file").cast("binary")), 1, k)
    says = F.concat_ws(":", "offset", "length", "copies", "sha256")
    ranges = records.groupBy("file", F.shiftright("offset", RANGE_BITS).alias("node")).agg(F.sum("copies").alias("n_records"), F.sum(F.col("length") * F.col("copies")).alias("n_bytes"), _hash(F.collect_list(F.struct("offset", says.alias("says")))).alias("hash"))
    levels, up = [], ranges.withColumn("scope", F.col("file"))
    for level in range(depth + digits + 1):
        if level:
            child = F.struct(F.col("scope"), F.col("node"), F.concat_ws(":", "scope", "node", "n_bytes", "hash").alias("says"))
            up = levels[-1].groupBy(F.col("up_scope").alias("scope"), F.col("up_node").alias("node")).agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), _hash(F.collect_list(child)).alias("hash"))
            # all partitions read the level below; the nodes, a FAN-th as many, are then written by a FAN-th of the tasks
            up = up.withColumn("file", F.col("scope")).repartition(max(1, cores >> (FAN_BITS * level)))
        if level < depth:
            above = [F.col("scope"), F.shiftright("node", FAN_BITS)]
        elif level == depth:
            above = [prefix(digits), F.lit(0).cast("long")]
        else:
            above = [F.col("scope").substr(F.lit(1), F.length("scope") - 1), F.lit(0).cast("long")]
        levels.append(checkpoint(up.select("scope", "node", above[0].alias("up_scope"), above[1].alias("up_node"), "n_records", "n_bytes", "hash")))
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame], records: DataFrame, found: DataFrame) -> DataFrame:
    """The damaged records of a replica: (file, offset, status, length, replica_length) from two trees of one shape and the records under them.

    status is corrupt (other content or length at the same place), missing (nothing begins there in the
    replica) or extra (only there). Equal trees give no rows, as do two empty ones.
    """
    suspects = None
    for a, b in zip(reversed(primary), reversed(replica), strict=True):
        if suspects is not None:  # descend only where the parents differ
            a, b = (t.join(suspects, (t["up_scope"] == suspects["s"]) & (t["up_node"] == suspects["n"]), "left_semi") for t in (a, b))
        a, b = a.select("scope", "node", F.col("hash").alias("h")), b.select("scope", "node", F.col("hash").alias("g"))
        suspects = checkpoint(a.join(b, ["scope", "node"], "full").where(~F.col("h").eqNullSafe(F.col("g"))).select(F.col("scope").alias("s"), F.col("node").alias("n")))
    within = lambda r: r.join(suspects, (r["file"] == suspects["s"]) & (F.shiftright(r["offset"], RANGE_BITS) == suspects["n"]), "left_semi")
    own = within(records).select("file", "offset", "length", F.concat_ws(":", "length", "copies", "sha256").alias("h"))
    other = within(found).select("file", "offset", F.col("length").alias("replica_length"), F.concat_ws(":", "length", "copies", "sha256").alias("g"))
    status = F.when(F.col("g").isNull(), "missing").when(F.col("h").isNull(), "extra").otherwise("corrupt")
    return own.join(other, ["file", "offset"], "full").where(~F.col("h").eqNullSafe(F.col("g"))).select("file", "offset", status.alias("status"), "length", "replica_length")


def compare(records: DataFrame, found: DataFrame) -> DataFrame:
    """audit() of two replicas given as records (file, offset, length, copies, sha256)."""
    depth, digits = shape(records, found)
    return audit(tree(records, depth, digits), tree(found, depth, digits), records, found)


def report(pages: DataFrame) -> DataFrame:
    """All records of a table of pages audited against a replica with planted faults.

    page_id, file, offset, n_records, n_bytes, sha256, file_sha256 and status (ok, or as in audit) of each
    run of equal records; file_sha256 is the root of the file. See archive for nulls, repeats and empty tables.
    """
    laid = checkpoint(archive(pages, replica=damaged("page_id", "html")))
    found = laid.where("replica_sha256 is not null").select("file", "offset", F.col("replica_length").alias("length"), "copies", F.col("replica_sha256").alias("sha256"))
    depth, digits = shape(laid, found)
    own = tree(laid, depth, digits)
    bad = audit(own, tree(found, depth, digits), laid, found).select("file", "offset", "status")
    files = own[depth].select(F.col("scope").alias("file"), F.col("hash").alias("file_sha256"))
    rows = laid.join(bad, ["file", "offset"], "left").join(files, "file")
    return rows.select("page_id", "file", "offset", F.col("copies").alias("n_records"), (F.col("length") * F.col("copies")).alias("n_bytes"), "sha256", "file_sha256", F.coalesce("status", F.lit("ok")).alias("status"))


def damaged(id_col: str, html_col: str) -> Column:
    """The text of a record in a replica with faults for exercising the audit: by a hash of the id some are lost (null), some cut, some changed in one place."""
    fate = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 2)
    html = F.coalesce(F.col(html_col), F.lit(""))
    half = F.floor(F.length(html) / 2).cast("int")
    changed = F.when(fate == "01", F.substring(html, 1, half)).when(fate == "02", F.concat(F.substring(html, 1, half), F.lit("?"), F.substring(html, half + 2, 1 << 30)))
    return F.when(fate != "00", F.coalesce(changed, html))


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; the archive is read in chunks, none of them twice."""
    at = 0
    while at < len(data):
        member, out, used = zlib.decompressobj(31), [], at
        while not member.eof and used < len(data):
            out.append(member.decompress(data[used : used + CHUNK]))
            used = min(len(data), used + CHUNK)
        used -= len(member.unused_data)
        yield at, used - at, b"".join(out)
        at = used


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of a WARC file; each may be a gzip member, whose place counts then."""
    if data[:2] == b"\x1f\x8b":
        for at, used, record in members(memoryview(data)):
            yield from ((at, used, headers, payload) for _, _, headers, payload in parse_records(record))
        return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(headers.get("Content-Length") or 0)
        yield at, end + 8 + n - at, headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def _read(spark: SparkSession, path: str, columns: dict, row) -> DataFrame:
    def parse(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(columns.values())], list(columns))

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held = [], 0
                raw = data.as_py()
                for record in parse_records(raw):
                    rows.append(row(name, raw, *record))
                    held += record[1]
                    if held >= 16 * CHUNK:  # a large archive goes out in several batches
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ", ".join(f"{c} {k}" for c, k in columns.items()))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, uri, record_id, payload) of the records of WARC files, plain or compressed by record."""
    columns = {"file": "string", "offset": "long", "length": "long", "uri": "string", "record_id": "string", "payload": "binary"}
    return _read(spark, path, columns, lambda name, raw, at, n, headers, body: (name, at, n, headers.get("WARC-Target-URI"), headers.get("WARC-Record-ID"), body))


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, copies, sha256) of the records of WARC files as their bytes stand there; file is the last part of the path."""
    import hashlib

    columns = {"file": "string", "offset": "long", "length": "long", "copies": "long", "sha256": "string"}
    return _read(spark, path, columns, lambda name, raw, at, n, headers, body: (name.rsplit("/", 1)[-1], at, n, 1, hashlib.sha256(raw[at : at + n]).hexdigest()))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages as text files of concatenated records, one folder for each group of 2 ** GROUP_BITS page ids, ordered by page id.

    Partitions are by group, so a task writes one file after another. Pages without an id have a folder of their own.
    """
    rows = pages.select(F.coalesce(F.shiftright(F.col("page_id").cast("long"), GROUP_BITS).cast("string"), F.lit("null")).alias("file"), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "page_id")
    # the text sink ends each value with the line break that ends the record
    rows.select("file", F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


ORACLE = r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, substr(md5(coalesce(cast(page_id as varchar), '')), 1, 2) as fate from pages),
t as (select *, case fate when '01' then substr(html, 1, length(html) // 2) when '02' then substr(html, 1, length(html) // 2) || '?' || substr(html, length(html) // 2 + 2) else html end as other from p),
q as (select page_id, fate, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Target-URI: ' || url || e || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || e || 'Content-Type: text/html' || e || 'Content-Length: ' as head,
  octet_length(encode(html)) || e || e || html || e || e as w, octet_length(encode(other)) || e || e || other || e || e as v from t, (select chr(13) || chr(10) as e)),
d as (select page_id, fate, octet_length(encode(head || w)) as n, sha256(head || w) as h, sha256(head || v) as r, count(*) as c from q group by all),
f as (select *, coalesce(cast(page_id >> 8 as varchar), 'null') as g, sum(n * c) over (partition by coalesce(page_id >> 8, -1), page_id is null) as total from d),
a as (select * rename (r as replica), g || '-' || case when total > 1048576 then cast('0x' || substr(h, 1, 8) as bigint) % cast(ceil(total / 1048576.0) as bigint) else 0 end as file from f),
r as (select *, cast(sum(n * c) over (partition by file order by page_id, h rows unbounded preceding) as bigint) - n * c as o from a),
l0 as (select file, o >> 12 as node, cast(sum(n * c) as bigint) as b, sha256(string_agg(concat_ws(':', o, n, c, h), ',' order by o)) as h from r group by 1, 2),
l1 as (select file, node >> 6 as node, cast(sum(b) as bigint) as b, sha256(string_agg(concat_ws(':', file, node, b, h), ',' order by node)) as h from l0 group by 1, 2),
l2 as (select file, sha256(string_agg(concat_ws(':', file, node, b, h), ',' order by node)) as h from l1 group by 1)
select page_id, file, o as "offset", c as n_records, cast(n * c as bigint) as n_bytes, r.h as sha256, l2.h as file_sha256,
  case when fate = '00' then 'missing' when replica <> r.h then 'corrupt' else 'ok' end as status
from r join l2 using (file)
"""
