"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A payload may hold the text that starts a record, so that text alone proves no
boundary. Every place with it is a candidate, and its header says where the
next record must start. A true record is one that the chain of such steps
reaches from the start of its file; pointer jumping finds these in as many
rounds as the chain has binary digits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forecourt.llm.common import stored
from forecourt.sources.quotes import shared_folder

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"  # of a header, and after a record's block

#: Equal payloads of fewer bytes are all stored in full.
REVISIT_BYTES = 100


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Rows of ``pages`` (page_id, url, html) with payload size, digest, record type and ``refers_to``.

    Of equal payloads of ``least`` bytes or more, one row with the smallest
    page_id is the response. A null html is empty; a null page_id comes after
    all others.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
    )
    # Digests that occur once need no join; the stored rest has a known size, by which Spark plans it.
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    per_page = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    shared = stored(
        per_page.groupBy("payload_digest")
        .agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("order"), "n")).alias("first"))
        .filter("n > 1")
        .select("payload_digest", F.col("first.order.page_id").alias("first_page"), F.col("first.n").alias("ties"))
    )
    joined = rows.join(shared, "payload_digest", "left")
    tied = (F.col("ties") > 1) & F.col("page_id").eqNullSafe(F.col("first_page"))
    revisit = F.col("ties").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    plain = joined.filter(~F.coalesce(tied, F.lit(False))).withColumn("revisit", revisit)
    # Repeated rows of the smallest page_id: equal ones are counted, and one is the response.
    repeated = rows.join(shared.filter("ties > 1"), "payload_digest").filter(tied)
    repeated = repeated.groupBy("page_id", "url", "payload_digest", "payload_bytes", "first_page", "ties").agg(
        F.min("payload").alias("payload"), F.count("*").alias("n")
    )
    place = F.row_number().over(W.partitionBy("payload_digest").orderBy("url"))
    repeated = repeated.withColumn("place", place).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    repeated = repeated.withColumn("revisit", (F.col("place") > 1) | (F.col("copy") > 1)).select(plain.columns)
    return plain.union(repeated).select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("revisit"), F.col("first_page")).alias("refers_to"),
    )


def _clean(column: str) -> F.Column:
    """A header value: no line ends."""
    return F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), "\r\n", "")


def write_archive(records: DataFrame, folder: str | None = None) -> str:
    """Write the rows of ``with_revisits`` as WARC files in a fresh folder and return it.

    One file per task. A record is a line whose line end is the empty lines
    that close a record. Revisits hold no payload; their header has its size.
    """
    path = f"{(folder or shared_folder(records.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Target-URI: "),
        _clean("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\nX-Page-Id: "),
        _clean("page_id"),
        F.lit("\r\nWARC-Refers-To: "),
        _clean("refers_to"),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    records.select(F.concat(header, body).alias("value")).write.option("lineSep", END).text(path)
    return path


def _field(name: str) -> F.Column:
    return F.regexp_extract("head", rf"(?:^|\r\n)(?i:{name}):[ \t]*([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives that starts like a record, with what its header says.

    A row is the text from one magic to the next; Spark splits files by bytes
    and each task reads the rows that begin in its split. ``size`` is the bytes
    that the header claims, null if it has no length; ``gap`` the bytes up to
    the next magic or the end.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value"),
    )
    head = F.expr(f"substring_index(value, '{_sql(END)}', 1)")
    rows = rows.withColumn("head", head).withColumn("gap", F.octet_length("value") + F.lit(len(MAGIC)))
    length = _field("Content-Length")
    claimed = F.octet_length("head") + length.try_cast("long") + F.lit(len(MAGIC) + 2 * len(END))
    return rows.withColumn("size", F.when(length.rlike(r"^\d{1,18}$"), claimed))


def _sql(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def _offsets(rows: DataFrame) -> DataFrame:
    """Rows (file, block, row, gap) with their byte offset in the file.

    The first row of a file is what comes before its first magic. Sums run
    inside a split and then over the splits of a file.
    """
    inside = W.partitionBy("file", "block").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("gap").alias("all"))
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("block_at"))
    at = F.col("block_at") + F.coalesce(F.sum("gap").over(inside), F.lit(0)) - F.lit(len(MAGIC))
    return rows.join(blocks, ["file", "block"]).withColumn("at", at)


def _reached(links: DataFrame) -> DataFrame:
    """Of links (file, at, next, start), the (file, at) that a start's chain reaches, by pointer jumping."""
    jump = stored(links.select("file", "at", "next"))
    reached = stored(links.filter("start").select("file", "at"))
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = links.select("file", "at").distinct()
        reached = stored(reached.union(step.join(known, ["file", "at"], "left_semi")).distinct())
        more = reached.count()
        if more == n:
            return reached
        n = more
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(onward, ["file", "next"]).select("file", "at", F.col("after").alias("next")))


def true_records(rows: DataFrame) -> DataFrame:
    """Those candidates (file, file_size, block, row, gap, size, ...) that the chain from the file's start reaches.

    Neighbours whose step leads to the next candidate of the same split form a
    run; who enters a run passes all after. Only the steps between runs are
    left to pointer jumping.
    """
    rows = _offsets(rows).withColumn("next", F.col("at") + F.col("size"))
    rows = rows.filter("at >= 0 and next <= file_size")
    order = W.partitionBy("file", "block").orderBy("at")
    apart = F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True))
    rows = stored(rows.withColumn("run", F.sum(apart.cast("long")).over(order)))
    key = ["file", "block", "run"]
    runs = rows.groupBy(*key).agg(F.max("next").alias("exit"))
    # Places where a run is entered: by another run's last step, or as the first record of a file.
    doors = runs.select("file", F.col("exit").alias("at")).withColumn("start", F.lit(False))
    doors = doors.union(rows.filter("at = 0").select("file", "at", F.lit(True)))
    doors = doors.groupBy("file", "at").agg(F.max("start").alias("start"))
    doors = doors.join(rows.select("file", "at", "block", "run"), ["file", "at"]).join(runs, key)
    doors = stored(doors.withColumn("next", F.col("exit")).select(*key, "at", "next", "start"))
    entered = doors.join(_reached(doors), ["file", "at"]).groupBy(*key).agg(F.min("at").alias("entry"))
    return rows.join(entered, key).filter("at >= entry").drop("entry", "run")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives at ``path`` that boundary-chain verification confirms.

    Columns: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest. Size and digest are computed anew from the stored payload;
    a revisit, which stores none, has its header's.
    """
    rows = candidates(spark, path)
    whole = F.col("size") == F.col("gap")
    start = F.octet_length("head") + F.lit(len(END) + 1)
    payload = F.expr("cast(value as binary)").substr(start, F.col("size") - start - F.lit(len(MAGIC) + len(END) - 1))
    light = rows.select(
        "file",
        "file_size",
        "block",
        "row",
        "gap",
        "size",
        "value",
        F.octet_length("head").alias("head_bytes"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        _field("X-Page-Id").try_cast("long").alias("page_id"),
        _field("WARC-Refers-To").try_cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("claimed_digest"),
        _field("X-Payload-Length").try_cast("long").alias("claimed_bytes"),
        _field("Content-Length").try_cast("long").alias("stored_bytes"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
    )
    # One read: how Spark cuts files into tasks, and with it the numbers of rows, may change between two.
    copy = f"{shared_folder(spark)}/warc-parts-{uuid.uuid4().hex}"
    light.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 9).parquet(copy)
    light = spark.read.schema(light.schema).parquet(copy)
    records = stored(true_records(light.drop("value", "head_bytes")))
    joined = _long_payloads(light, records)
    records = records.join(joined, ["file", "at"], "left")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        "url",
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("claimed_digest", ":", -1))
        .otherwise(F.coalesce("digest", "long_digest"))
        .alias("payload_digest"),
    )


def _long_payloads(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Digests of the records whose payload holds a magic: their parts among the stored candidates, joined in order."""
    long = records.filter("size <> gap").select("file", "at", "size")
    # The parts of a record lie between its start and its end; each part belongs to one record.
    parts = _offsets(rows.select("file", "block", "row", "gap")).select("file", "block", "row", F.col("at").alias("part_at"))
    over = W.partitionBy("file").orderBy("part_at", "is_part")
    ends = long.select("file", F.col("at").alias("part_at"), "size", F.lit(0).alias("is_part"))
    marks = parts.join(long.select("file").distinct(), "file", "left_semi").select(
        "file", "part_at", F.lit(None).cast("long").alias("size"), F.lit(1).alias("is_part"), "row"
    ).unionByName(ends.withColumn("row", F.lit(None).cast("long")))
    own = F.last(F.when(F.col("is_part") == 0, F.struct("part_at", "size")), ignorenulls=True).over(over)
    parts = marks.withColumn("own", own).filter("is_part = 1 and part_at < own.part_at + own.size")
    parts = stored(parts.select("file", "row", F.col("own.part_at").alias("at"), "part_at"))
    pieces = parts.join(rows.select("file", "row", "value", "head_bytes", "size"), ["file", "row"])
    whole = pieces.groupBy("file", "at").agg(
        F.array_sort(F.collect_list(F.struct("part_at", "value", "head_bytes", "size"))).alias("p")
    )
    block = F.concat_ws(MAGIC, F.col("p.value"))
    start = F.col("p")[0]["head_bytes"] + F.lit(len(END) + 1)
    length = F.col("p")[0]["size"] - start - F.lit(len(MAGIC) + len(END) - 1)
    return whole.select("file", "at", F.sha2(block.cast("binary").substr(start, length), 256).alias("long_digest"))
