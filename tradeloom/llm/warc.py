r"""Write pages as WARC archives and read them back by verified record boundaries.

Archives are read in parallel splits at every occurrence of the magic ``WARC/1.``,
which may also stand inside a payload. Each task emits candidates: the offset of
a magic, and the offset where the record would end by its Content-Length. Pointer
jumping from offset 0 of each file then marks the candidates on the chain of true
records: in each round, marked records mark where their pointer leads and all
pointers double, so a file of n candidates takes log2(n) rounds of joins on narrow
rows. Whatever is not on the chain belongs to the payload around it. How files are split depends on the cores at
hand, so pieces are numbered and described in one job. That keeps the text of pieces that are no whole record by
themselves; text of the others is asked for by its SHA-256, which does not depend on splits, where it is needed again.

Pages with a null html have an empty payload; a null url gives a record without
target URI; line breaks and blanks in a url are percent-encoded. Rows that repeat
a page id with the same payload share their type. A file that does not begin with
the magic has no records, and nothing is read past a record whose length is wrong
or missing. No pages give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

MAGIC, VERSION = "WARC/1.", "1"
BREAK = "\r\n"
BLANK = BREAK + BREAK
#: Shorter payloads are stored again rather than referred to.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A piece of an archive in which records that span several magics look for their parts.
BUCKET = 1 << 20


def deduplicated(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, first): ``first`` is the least page_id with the same payload of at least ``least`` bytes."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    repeated = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that its real size decides how it is joined and a payload of very many pages can be split.
    repeated = scratch.write(repeated.filter("n > 1").select("digest", "first"))
    return rows.join(repeated, "digest", "left")


def record_text(kind: Column) -> Column:
    """One record without its closing blank line, which the writer's line separator adds."""
    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    url = F.col("url")
    for raw, escaped in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        url = F.replace(url, F.lit(raw), F.lit(escaped))
    revisit = kind == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{MAGIC}{VERSION}{BREAK}"), field("WARC-Type", kind), field("WARC-Record-ID", urn(F.col("page_id"))), field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(revisit, urn(F.col("first")))), field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block,
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = 100_000, least: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as uncompressed WARC files under ``path``, one record per page."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = deduplicated(pages, scratch, least)
    kind = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    writer = rows.select(record_text(kind).alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file)
    writer.text(path)


def between(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the text between magics, in the order of ``seq`` inside a split of a file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    at = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return at.withColumn("seq", F.monotonically_increasing_id())


def parsed(value: Column) -> dict[str, Column]:
    """Fields of the record that would begin with the magic before ``value``."""
    head = F.substring_index(value, BLANK, 1)

    def header(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*{pattern}[ \t]*(?:\r\n|$)", 1), F.lit(""))

    head_bytes = F.octet_length(head).cast("long")
    sound = head.rlike(r"^[01]\r\n") & (F.octet_length(value) > head_bytes)
    length = F.when(sound, header("Content-Length", r"(\d{1,15})").cast("long"))
    raw = value.cast("binary")
    # Only used where the piece is the whole record; positions of a binary are ints, as its length is.
    block = F.substring(raw, (head_bytes + 5).cast("int"), length.cast("int"))
    http = F.substring_index(block.cast("string"), BLANK, 1)
    is_http = F.coalesce(header("Content-Type", r"([^;\r\n]+)[^\r\n]*") == "application/http", F.lit(False))
    skip = F.when(is_http, F.octet_length(http) + 4).otherwise(0)
    payload = F.substring(block, (skip + 1).cast("int"), length.cast("int"))
    return {
        "length": head_bytes + 4 + length + 4,
        "record_type": header("WARC-Type", r"([^\r\n]*?)"),
        "record_id": header("WARC-Record-ID", r"<([^>\r\n]*)>"),
        "refers_to": header("WARC-Refers-To", r"<([^>\r\n]*)>"),
        "target_uri": header("WARC-Target-URI", r"([^\r\n]*?)"),
        "stated_digest": header("WARC-Payload-Digest", r"sha256:([0-9a-f]+)"),
        "stated_bytes": F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*(\d{1,15})", 1).try_cast("long"),
        "payload": payload,
    }


FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest"]


def described(rows: DataFrame) -> DataFrame:
    """``rows`` (.., value) with the record fields; those that need the whole record only where ``value`` is one."""
    fields = parsed(F.col("value"))
    whole = F.octet_length("value") == fields["length"]
    payload = F.when(whole, fields.pop("payload"))
    columns = {**fields, "bytes": F.octet_length("value").cast("long"), "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)}
    return rows.withColumns(columns)


def chained(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the candidates (file, at, to) that are reached from offset 0 of their file."""
    nodes = scratch.write(candidates.select("file", "at", "to", (F.col("at") == 0).alias("on")))
    while not nodes.filter("to is not null").isEmpty():
        onward = nodes.filter("on and to is not null").select("file", F.col("to").alias("at"), F.lit(True).alias("hit")).distinct()
        double = nodes.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        stepped = nodes.join(onward, ["file", "at"], "left").join(double, ["file", "to"], "left")
        following = scratch.write(stepped.select("file", "at", F.col("further").alias("to"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")))
        scratch.drop(nodes)
        nodes = following
    return nodes.filter("on").select("file", "at")


def index_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: path, offset, length and the record's fields, the payload's bytes and SHA-256 among them.

    ``with_payload`` adds the payload itself.
    """
    scratch = Scratch(spark, "warc")
    by_itself = F.coalesce(F.col("length") == F.col("bytes"), F.lit(False))
    kept = described(between(spark, path)).withColumn("piece", F.when(by_itself, content(F.col("value")))).withColumn("value", F.when(~by_itself, F.col("value")))
    kept = scratch.write(kept)
    pieces = kept.drop("value")
    in_block = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)  # a split of a file
    step = F.col("bytes") + len(MAGIC)
    placed = pieces.withColumn("before", F.coalesce(F.sum(step).over(in_block), F.lit(0)))
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("all"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    blocks = scratch.write(blocks.select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base")))
    offset = F.col("base") + F.col("before") - len(MAGIC)
    # What stands before a file's first magic has a negative offset and is no candidate.
    placed = scratch.write(placed.join(blocks, ["file", "block"]).withColumn("at", offset).drop("before", "base").filter("at >= 0"))
    sound = placed.filter("length is not null")
    chain = scratch.write(chained(sound.select("file", "at", (F.col("at") + len(MAGIC) + F.col("length")).alias("to")), scratch))
    records = sound.join(chain, ["file", "at"])
    whole, torn = records.filter("length = bytes"), reassembled(spark, path, kept, placed, records, chain, scratch)
    if with_payload:
        whole = whole.join(by_content(spark, path, whole), "piece").withColumn("payload", parsed(F.col("value"))["payload"]).drop("value")
    else:
        torn = torn.drop("payload")
        scratch.drop(kept)
    extra = ["payload"] if with_payload else []
    return whole.drop("piece").unionByName(torn).select("path", F.col("at").alias("offset"), "length", *FIELDS, *extra)


def content(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def by_content(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(piece, value): the text of the wanted pieces, by its SHA-256."""
    texts = between(spark, path).select(content(F.col("value")).alias("piece"), "value")
    return texts.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.first("value").alias("value"))


def reassembled(spark: SparkSession, path: str, kept: DataFrame, placed: DataFrame, records: DataFrame, chain: DataFrame, scratch: Scratch) -> DataFrame:
    """The records whose payload holds a magic, put together from the pieces between their offset and their end."""
    parts = scratch.write(records.filter("length > bytes").select("file", F.col("at").alias("owner"), (F.col("at") + len(MAGIC) + F.col("length")).alias("end")))
    if parts.isEmpty():
        return records.limit(0).drop("piece").withColumn("payload", F.lit(None).cast("binary"))
    # Only pieces off the chain can be inside a record; both sides meet by stretches of the file.
    inner = placed.join(chain, ["file", "at"], "left_anti").withColumn("bucket", F.floor(F.col("at") / BUCKET))
    spans = parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("owner") / BUCKET), F.floor(F.col("end") / BUCKET))))
    inside = inner.join(spans, ["file", "bucket"]).filter("at > owner and at < end").select("file", "block", "seq", "at", "owner")
    heads = placed.join(parts.select("file", F.col("owner").alias("at")), ["file", "at"]).select("file", "block", "seq", "at", F.col("at").alias("owner"))
    wanted = scratch.write(heads.unionByName(inside))
    pieces = scratch.write(kept.select("path", "file", "block", "seq", "value", "piece").join(wanted, ["file", "block", "seq"]))
    whole_inside = pieces.filter("value IS NULL")
    if not whole_inside.isEmpty():
        texts = by_content(spark, path, whole_inside).withColumnRenamed("value", "text")
        pieces = pieces.join(texts, "piece", "left").withColumn("value", F.coalesce("value", "text")).drop("text")
    joined = pieces.groupBy("path", "file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"), F.first("block").alias("block"), F.min("seq").alias("seq"))
    whole = joined.select("path", "file", "block", "seq", F.col("owner").alias("at"), F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    full = described(whole)
    checked = F.when(F.col("length") == F.col("bytes"), F.col("bytes")).otherwise(F.raise_error(F.lit("a record's pieces do not add up to its length")))
    out = full.withColumns({"bytes": checked, "payload": parsed(F.col("value"))["payload"]}).select(*[c for c in records.columns if c != "piece"], "payload")
    return scratch.write(out)
