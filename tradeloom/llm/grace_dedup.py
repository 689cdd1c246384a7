"""Exact dedup of whole texts by recursive (Grace) hash partitioning.

Texts are equal when they are identical after every run of white space
(``[\\x20\\x09-\\x0D]+``) is replaced by one space; nothing is trimmed.

1. Every task reads its rows through a table of whole normalised texts. The first row with a text becomes its
   *record*; later ones only point at it. A table that has taken ``TABLE_BYTES`` is given up and a new one begun, so a
   text that stands in a third of all rows leaves the task a few times and not once a row.
2. Records are dealt to buckets by the hash of their content and spilled. A task fills one table from its bucket; a
   record whose text is in it joins that text's class. Once the table holds ``TABLE_BYTES``, records with other texts
   are spilled again, and the next level deals them to buckets by another hash. This goes on until a level's buckets
   fit; how many buckets a level needs follows from the bytes that reach it.
3. A text with more than ``HOT`` records is first brought together in parts that hold at most about that many, by
   the same step; the records that are left go on.

The tables are Python dictionaries, which are open-addressing tables: a probe compares hashes first and then the
complete content, so equal hashes of different texts do no harm anywhere. A table holds at most ``TABLE_BYTES`` and one
text more. A level is written to the shared folder before the next one reads it, so a lost executor costs its tasks
only. Texts travel with records; members of a class are joined to it by the record they point at.

Null texts count as empty. Of equal texts the row with the least id stays, null ids last; of rows that also share the
id, which are alike in both, exactly one stays. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

#: Bytes that one table holds, bytes of an entry besides its text, and records of one text that meet in one task.
TABLE_BYTES, ENTRY, HOT = 64 << 20, 256, 4096
WHITE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
RUN = re.compile(b"  +")
NO_ID = (1 << 63) - 1

RECORD = "row long, hash long, n_bytes long, text binary, least long, least_row long, n long"
NAMES = [part.split()[0] for part in RECORD.split(", ")]
_FIRST = f"doc_id long, {RECORD}, record long"
_STEP = f"{RECORD}, record long, digest string"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes of a text with every run of white space replaced by one space."""
    return RUN.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(WHITE))


def content_hash(body: bytes) -> int:
    return int.from_bytes(sha256(body).digest()[:8], "little", signed=True)


class Rows:
    """Output rows, handed on in batches of bounded bytes."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]) -> None:
        self.schema, self.columns, self.held = pa.schema(list(zip(names, kinds))), [[] for _ in names], 0

    def add(self, *values, size: int = 0) -> Iterator[pa.RecordBatch]:
        for column, v in zip(self.columns, values):
            column.append(v)
        self.held += size + 64
        if self.held > 8 << 20:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.held = [[] for _ in self.columns], 0
        return out


def _rows(ddl: str) -> Rows:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    pairs = [part.split() for part in ddl.split(", ")]
    return Rows([n for n, _ in pairs], [kinds[k] for _, k in pairs])


def _records(table_bytes: int):
    """Rows of documents to records and members: one row per document, the text with the first of each content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row = _rows(_FIRST), TaskContext.get().partitionId() << 33
        table: dict[bytes, list] = {}
        held = 0

        def leave() -> Iterator[pa.RecordBatch]:
            for body, (doc_id, first, least, least_row, n) in table.items():
                least = None if least == NO_ID else least
                yield from out.add(doc_id, first, content_hash(body), len(body), body, least, least_row, n, first, size=len(body))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body, key = normalise(text), NO_ID if doc_id is None else doc_id
                seen = table.get(body)
                if seen is None:
                    if held > table_bytes:
                        yield from leave()
                        table, held = {}, 0
                    table[body] = [doc_id, row, key, row, 1]
                    held += len(body) + ENTRY
                else:
                    if (key, row) < (seen[2], seen[3]):
                        seen[2], seen[3] = key, row
                    seen[4] += 1
                    yield from out.add(doc_id, row, None, None, None, None, None, None, seen[1])
                row += 1
        yield from leave()
        if out.held:
            yield out.flush()

    return run


def _classes(table_bytes: int, with_text: bool = False):
    """One bucket's records to classes: a row per record with its class's first record, or with its text if it has to go on.

    The row of a class's first record holds the least id, its row and the number of documents, and the text if asked for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _rows(_STEP)
        table: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for row, code, size, body, least, least_row, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
                key, seen = NO_ID if least is None else least, table.get(body)
                if seen is not None:
                    if (key, least_row) < (seen[2], seen[3]):
                        seen[2], seen[3] = key, least_row
                    seen[4] += n
                    yield from out.add(row, None, None, None, None, None, None, seen[0], None)
                elif held <= table_bytes:
                    table[body] = [row, code, key, least_row, n]
                    held += size + ENTRY
                else:  # the table is full: this content belongs to the next level
                    yield from out.add(row, code, size, body, least, least_row, n, None, None, size=size)
        for body, (row, code, key, least_row, n) in table.items():
            least, text = None if key == NO_ID else key, body if with_text else None
            yield from out.add(row, code, len(body), text, least, least_row, n, row, sha256(body).hexdigest(), size=len(text or b""))
        if out.held:
            yield out.flush()

    return run


def _dealt(records: DataFrame, level: int, table_bytes: int, *more) -> DataFrame:
    """Records by the level's own hash of their content, in so many buckets that each should fill half a table."""
    total = records.agg(F.sum(F.col("n_bytes") + ENTRY)).first()[0] or 0
    wide = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(wide, -(-2 * total // max(table_bytes, 1)))
    return records.repartition(min(buckets, 1 << 20), F.xxhash64(F.lit(level), "hash"), *more)


def _hot_first(records: DataFrame, work: Scratch, table_bytes: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Records of which none has more than about ``hot`` equals, and links from the records that were merged on the way."""
    links = []
    for turn in count(1):
        many = work.write(records.groupBy("hash").count().filter(F.col("count") > hot))
        if many.isEmpty():
            work.drop(many)
            return records, links
        shares = F.ceil(F.col("count") / F.lit(hot)).cast("long")
        marked = records.join(many.select("hash", shares.alias("shares")), "hash", "left")
        few = marked.filter("shares IS NULL").select(*NAMES)
        lot = marked.filter("shares IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")))
        made = work.write(_dealt(lot, -turn, table_bytes, "share").select(*NAMES).mapInArrow(_classes(table_bytes, True), _STEP))
        links.append(made.filter("record IS NOT NULL AND record <> row").select("row", "record"))
        records = work.write(few.unionByName(made.filter("record IS NULL OR record = row").select(*NAMES)))
        work.drop(many)


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``row`` (its number), ``keep_id``, ``keep_row``, ``group_size``, ``kept``, ``text_sha256``."""
    work = Scratch(docs.sparkSession, "grace")
    first = work.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_records(table_bytes), _FIRST))
    left, links = _hot_first(first.filter("row = record").select(*NAMES), work, table_bytes, hot)
    settled, level = [], 0
    while True:
        level += 1
        made = work.write(_dealt(left, level, table_bytes).mapInArrow(_classes(table_bytes), _STEP))
        settled.append(made.filter("record IS NOT NULL"))
        left = made.filter("record IS NULL").select(*NAMES)
        if left.isEmpty():
            break
    records = reduce(DataFrame.unionAll, settled)
    classes = records.filter("record = row").select("record", F.col("least").alias("keep_id"), F.col("least_row").alias("keep_row"), F.col("n").alias("group_size"), F.col("digest").alias("text_sha256"))
    ends = records.select("row", "record")
    for step in reversed(links):  # a record merged early belongs where its first record went
        ends = ends.unionAll(step.withColumnsRenamed({"row": "early", "record": "row"}).join(ends, "row").select(F.col("early").alias("row"), "record"))
    told = ends.join(classes, "record").select(F.col("row").alias("record"), "keep_id", "keep_row", "group_size", "text_sha256")
    members = first.select("doc_id", "row", "record")
    return members.join(told, "record").select("doc_id", "row", "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def kept_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) of the rows that stay, with the normalised text."""
    decided = deduplicate(docs, **options).filter("kept").select("doc_id", "text_sha256")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    texts = docs.select(F.col("doc_id").alias("_id"), text.alias("text")).withColumn("_digest", F.sha2("text", 256)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_digest"))
    return texts.join(decided, same).select("doc_id", "text")
