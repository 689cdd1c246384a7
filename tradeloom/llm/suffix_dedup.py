"""Remove every byte covered by a 100-byte string that also starts earlier in the collection.

Equal 100-byte windows must meet in one task. A window's anchor is its 32-byte
string of least hash, so equal windows have equal anchors; consecutive windows
with the same anchor form a chunk. Chunks are shuffled by anchor as hashes and
places only. Equal chunks are collapsed to the first of them (already inside the
tasks that cut the texts, so a passage in very many documents arrives a few
times), and the windows of the others are repeats.

Different chunks of one anchor may still share windows. Their bytes are fetched and
a generalised suffix order of each bucket of such chunks is built column by
column: round j inserts the suffix of length j of every chunk into the
collection's Burrows-Wheeler transform, at the place that the transform itself
gives. Suffixes of 100 bytes or more that stand next to each other and share 100
bytes are one class; all but the earliest are repeats. Buckets have a bounded
number of bytes, so the transform of each stays in memory as one sequential
array rather than in files. An anchor with very many different chunks is dealt
over several buckets, and the classes of those buckets are joined by the digest
of their string.

Documents are ordered by id, null ids last. Texts are UTF-8 bytes, null texts
empty. Rows that share an id are treated as one document seen twice: neither makes
the other a repeat at the same place. Texts under 100 bytes are kept whole. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch, small_batches
from tradeloom.llm.words import mixed

LENGTH, ANCHOR = 100, 32
#: Bytes of text cut at once; places inside a piece take 24 bits.
PIECE = 2_000_000
PLACE = np.uint64(0xFFFFFF)
#: Text bytes per partition of the chunks' shuffle, and chunk bytes per bucket.
PARTITION_BYTES, BUCKET_BYTES = 8_000_000, 400_000
#: Different chunks of one anchor in one bucket.
BUCKET_CHUNKS = 2048
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NULL_IDS = 1 << 62

CHUNKS = "anchor long, content long, doc long, tag long, start int, n int"


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cut(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and content hash of each chunk of the concatenated texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    last = len(words) - (anchor - 8)
    hashes = np.zeros(last, np.uint64)
    for i in range(0, anchor, 8):
        hashes = hashes * FACTOR + words[i : i + last]
    hashes = mixed(hashes)
    # The place in the low bits makes the leftmost of equal anchors the least.
    least = windows_min((hashes & ~PLACE) | np.arange(last, dtype=np.uint64), length - anchor + 1)
    at = (least & PLACE).astype(np.int64)
    inside = np.zeros(len(at), bool)
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        inside[a : max(a, b - length + 1)] = True
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    number = np.diff(np.append(first, len(at)))
    kept = inside[first]
    first, number = first[kept], number[kept]
    return first, number, hashes[at[first]], contents(data, first, number + length - 1)


def contents(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of data[first : first + size], wherever it stands."""
    powers = np.cumprod(np.full(len(data) + 1, FACTOR, np.uint64))
    back = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(FACTOR), -1, 2**64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return mixed((sums[first + size] - sums[first]) * back[first])


def doc_order() -> Column:
    """Documents in order of their ids; null ids come last, told apart by their texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_IDS) + F.pmod(F.xxhash64("body"), F.lit(1 << 61)))


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body, doc, tag): bytes, order and a tag that tells apart texts under one id."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return rows.select("doc_id", "body", doc_order().alias("doc"), F.crc32("body").alias("tag"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """Documents in lots of about ``PIECE`` bytes; longer texts are cut so that every window is in one part."""
    lot: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for batch in batches:
        for doc, tag, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "body"))):
            for a in range(0, max(1, len(body) - LENGTH + 1), PIECE):
                part = body[a : a + PIECE + LENGTH - 1]
                for column, value in zip(lot, (doc, tag, a, part)):
                    column.append(value)
                size += len(part)
                if size >= PIECE:
                    yield lot
                    lot, size = ([], [], [], []), 0
    if lot[0]:
        yield lot


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the texts; of equal ones in a lot only the first, the others as repeats (n < 0, dealt by document)."""
    for docs, tags, offsets, parts in pieces(batches):
        ends = np.cumsum([len(p) for p in parts])
        first, number, anchor, content = cut(np.frombuffer(b"".join(parts), np.uint8), ends)
        if not len(first):
            continue
        part = np.searchsorted(ends, first, "right")
        starts = np.concatenate([[0], ends[:-1]])
        doc, tag = np.array(docs, np.int64)[part], np.array(tags, np.int64)[part]
        start = first - starts[part] + np.array(offsets)[part]
        repeat = not_first(anchor, content, doc, start)
        key = np.where(repeat, doc * 31, anchor.view(np.int64))
        columns = [key, content.view(np.int64), doc, tag, start.astype(np.int32), np.where(repeat, -number, number).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "doc", "tag", "start", "n"])


def not_first(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Chunks equal to one of a smaller (document, start)."""
    order = np.lexsort((start, doc, content, anchor))
    same = np.zeros(len(order), bool)
    a, c, d, s = anchor[order], content[order], doc[order], start[order]
    same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    # Places compare by id: the same id and start seen twice is not a repeat.
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((d != d[lead]) | (s != s[lead]))
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


FOUND = "doc long, tag long, start int, n int, bucket long, hot boolean"


def chunk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (bucket null) and chunks to compare (with a bucket) of one partition of anchors."""
    all_batches = list(batches)
    if not sum(b.num_rows for b in all_batches):
        return
    got = pa.Table.from_batches(all_batches)
    anchor, content, doc, tag, start, n = (got.column(c).to_numpy() for c in ("anchor", "content", "doc", "tag", "start", "n"))
    known = n < 0
    yield found(doc[known], tag[known], start[known], -n[known])
    anchor, content, doc, tag, start, n = (x[~known] for x in (anchor, content, doc, tag, start, n))
    repeat = not_first(anchor, content, doc, start)
    yield found(doc[repeat], tag[repeat], start[repeat], n[repeat])
    anchor, content, doc, tag, start, n = (x[~repeat] for x in (anchor, content, doc, tag, start, n))
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    several = size[group] > 1
    anchor, content, doc, tag, start, n, size = (x[several] for x in (anchor, content, doc, tag, start, n, size[group]))
    salt = content.view(np.uint64) % (-(-size // BUCKET_CHUNKS)).astype(np.uint64)
    bucket = mixed(anchor.view(np.uint64) + salt * FACTOR) >> np.uint64(1)
    yield found(doc, tag, start, n, bucket.astype(np.int64), size > BUCKET_CHUNKS)


def found(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray, bucket: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64()) if bucket is None else pa.array(bucket)
    flag = pa.nulls(len(doc), pa.bool_()) if hot is None else pa.array(hot)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start), pa.array(n.astype(np.int32)), none, flag], ["doc", "tag", "start", "n", "bucket", "hot"])


def column_wise_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection as (text number, suffix length), the empty ones first.

    ``bwt`` holds the symbol before each suffix inserted so far, in the order of the suffixes; 0 is the end of a text. The
    suffix that puts a text's next symbol c before its last suffix at place p comes after all that begin with a lesser
    symbol and after those that put c before a suffix above p: both are counts of symbols in ``bwt``.
    """
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1) if len(present) < 256 else np.arange(256)
    if len(present) == 256:
        raise ValueError("UTF-8 texts leave byte values unused")
    flat, ends = code[flat], np.cumsum(sizes)
    n, symbols = len(texts), len(present) + 1
    block = 256
    bases = np.repeat(np.arange((len(flat) + n) // block + 1, dtype=np.int64) * symbols, block)

    bwt = np.zeros(n, np.uint8)
    bwt[sizes > 0] = flat[ends[sizes > 0] - 1]
    active, place = np.flatnonzero(sizes > 0), np.flatnonzero(sizes > 0)  # in order of place
    length = 1
    while len(active):
        # Symbols before each block of places, then inside the block up to the place.
        per_block = np.bincount(bases[: len(bwt)] + bwt, minlength=(len(bwt) // block + 1) * symbols).reshape(-1, symbols)
        upto = np.cumsum(per_block, axis=0)
        total = upto[-1].copy()
        total[0] = n
        lesser = np.concatenate([[0], np.cumsum(total)[:-1]])
        symbol, inside = bwt[place], place // block
        padded = np.zeros((len(bwt) // block + 1) * block, np.uint8)
        padded[: len(bwt)] = bwt
        rows = padded.reshape(-1, block)[inside]
        before = (rows == symbol[:, None]) & (np.arange(block) < (place % block)[:, None])
        target = lesser[symbol] + upto[inside, symbol] - per_block[inside, symbol] + np.count_nonzero(before, axis=1)

        order = np.argsort(target, kind="stable")
        active, place = active[order], target[order]
        left = sizes[active] - length
        following = np.where(left > 0, flat[np.maximum(ends[active] - length - 1, 0)], 0).astype(np.uint8)
        grown = np.empty(len(bwt) + len(active), np.uint8)
        old = np.ones(len(grown), bool)
        old[place] = False
        grown[old], grown[place] = bwt, following
        bwt = grown
        going = left > 0
        active, place = active[going], place[going]
        length += 1

    # Following the transform from the empty suffixes names the suffix at every place.
    onward = np.empty(len(bwt), np.int64)
    onward[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    owner, suffix = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    text, at, length = np.arange(n), np.arange(n), 0
    while len(text):
        owner[at], suffix[at] = text, length
        more = bwt[at] != 0
        text, at = text[more], onward[at[more]]
        length += 1
    return owner, suffix


def classes(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, class) of every window of ``length`` bytes; equal windows have equal classes."""
    owner, suffix = column_wise_order(texts)
    long = suffix >= length
    owner, suffix = owner[long].astype(np.int64), suffix[long]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    offset = sizes[owner] - suffix
    flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    words = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    at = starts[owner] + offset
    # Common prefixes of neighbours are only asked whether they reach the length: eight bytes at a time, the last eight overlapping.
    same = np.ones(max(0, len(at) - 1), bool)
    for i in [*range(0, length - 8, 8), length - 8]:
        value = words[at + i]
        same &= value[1:] == value[:-1]
    number = np.concatenate([[0], np.cumsum(~same)]) if len(at) else np.zeros(0, np.int64)
    return owner, offset, number


REPEATS = "doc long, tag long, start int, n int, digest binary"


def compare_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of a bucket's chunks as runs; for chunks dealt over several buckets also the digest of each class's first window."""
    rows = rows.drop_duplicates(["doc", "tag", "start"])
    texts = rows["bytes"].tolist()
    owner, offset, number = classes(texts)
    doc, tag, start, hot = (rows[c].to_numpy() for c in ("doc", "tag", "start", "hot"))
    place = start[owner] + offset
    order = np.lexsort((place, doc[owner], number))
    owner, offset, number, place = owner[order], offset[order], number[order], place[order]
    fresh = np.ones(len(number), bool)
    fresh[1:] = number[1:] != number[:-1]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(number)), 0))
    repeat = (doc[owner] != doc[owner[lead]]) | (place != place[lead])
    r_owner, r_offset = owner[repeat], offset[repeat]
    out = [runs(doc, tag, start, r_owner, r_offset)]
    leads = np.flatnonzero(fresh & hot[owner].astype(bool))
    if len(leads):
        digests = [blake2b(texts[o][p : p + LENGTH], digest_size=16).digest() for o, p in zip(owner[leads].tolist(), offset[leads].tolist())]
        out.append(pd.DataFrame({"doc": doc[owner[leads]], "tag": tag[owner[leads]], "start": place[leads].astype(np.int32), "n": np.ones(len(leads), np.int32), "digest": digests}))
    return pd.concat(out, ignore_index=True)


def runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """Windows of chunks joined to runs of consecutive ones."""
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(fresh)
    number = np.diff(np.append(first, len(owner)))
    o = owner[first]
    return pd.DataFrame({"doc": doc[o], "tag": tag[o], "start": (start[o] + offset[first]).astype(np.int32), "n": number.astype(np.int32), "digest": None})


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted chunks of each document."""
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, tag, body, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "body", "wanted"))):
            for w in wanted:
                for column, value in zip(columns, (doc, tag, w["start"], w["bucket"], w["hot"], body[w["start"] : w["start"] + w["n"] + LENGTH - 1])):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "tag", "start", "bucket", "hot", "bytes"])


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeats: the bytes kept, how many were removed, and in how many maximal runs."""
    for batch in batches:
        kept, removed, spans = [], [], []
        starts, numbers = batch.column("starts"), batch.column("numbers")
        for body, first, number in zip(batch.column("body").to_pylist(), starts.to_pylist(), numbers.to_pylist()):
            if not first:
                kept.append(body)
                removed.append(0)
                spans.append(0)
                continue
            edge = np.zeros(len(body) + 1, np.int32)
            np.add.at(edge, np.array(first), 1)
            np.add.at(edge, np.array(first) + np.array(number) + LENGTH - 1, -1)
            covered = np.cumsum(edge[:-1]) > 0
            kept.append(np.frombuffer(body, np.uint8)[~covered].tobytes())
            removed.append(int(covered.sum()))
            spans.append(int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(b) for b in batch.column("body").to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, tag, start, n): runs of n windows from start on that all begin earlier too."""
    rows = bodies(docs)
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    partitions = max(1, -(-total // PARTITION_BYTES))
    chunks = rows.select("doc", "tag", "body").mapInArrow(chunk_rows, CHUNKS)
    groups = scratch.write(chunks.repartition(partitions, "anchor").mapInArrow(chunk_groups, FOUND))

    wanted = groups.filter("bucket is not null")
    asked = wanted.agg(F.sum(F.col("n") + LENGTH - 1)).first()[0] or 0
    buckets = max(1, -(-asked // BUCKET_BYTES))
    place = F.struct("start", "n", F.pmod("bucket", F.lit(buckets)).alias("bucket"), "hot")
    per_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(place).alias("wanted"))  # at most a document's own chunks
    bytes_ = rows.select("doc", "tag", "body").join(per_doc, ["doc", "tag"])
    chunks = bytes_.mapInArrow(fetched, "doc long, tag long, start int, bucket long, hot boolean, bytes binary")
    compared = scratch.write(chunks.groupBy("bucket").applyInPandas(compare_chunks, REPEATS))

    # First windows of classes that several buckets may hold: all but the earliest are repeats.
    leads = compared.filter("digest is not null")
    earliest = scratch.write(leads.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).filter("first != last").select("digest", "first"))
    late = leads.join(earliest, "digest").filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    columns = ["doc", "tag", "start", "n"]
    return groups.filter("bucket is null").select(columns).unionAll(compared.filter("digest is null").select(columns)).unionAll(late.select(columns))


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row of ``docs`` (doc_id, text) with the bytes that stay."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    found = repeats(docs, scratch)
    per_doc = found.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("numbers"))  # a document's own places
    rows = bodies(docs).join(per_doc, ["doc", "tag"], "left").select("doc_id", "body", "starts", "numbers")
    return rows.mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
