"""Exact dedup by a cuckoo-filter index over text digests.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty. Of equal texts the
row with the largest id stays (a null id is smaller than any other). Rows that repeat both id and text are one
document: the first of them stays when the id wins. An empty table gives an empty result.

Plan: digests are made where the text is read and only 32-byte digests are shuffled. Each map task collapses the copies
among its own rows, so that a group of any size is a few rows a task. These are dealt to tasks by hash, come bucket by
bucket, and each bucket has an index of its own, which bounds memory whatever the input. The index decides: a digest
that it does not hold is inserted; one that it holds is a hit, and where the new row's id is larger, the live digest is
deleted and inserted anew for that row. Tables that are too full double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import identity, kept, only_listed, parts, utf8

#: Digests in a bucket, on average: one index holds about so many.
BUCKET_ROWS = 1 << 16
#: Digests that a map task holds while it collapses copies.
COLLAPSE_ROWS = 1 << 16


class CuckooIndex:
    """A cuckoo filter whose slots also name the record that a fingerprint belongs to.

    A digest has two buckets of four slots; a slot holds a 16-bit fingerprint and the number of a record. A lookup whose
    fingerprint matches is only a hit once the record's stored key (the whole SHA-256 and the text's length) is equal.
    When an insertion has moved `max_moves` entries in vain, the table is doubled and filled again from the stored keys.
    """

    slots = 4

    def __init__(self, capacity: int = 64, max_moves: int = 200):
        self.max_moves = max_moves
        self.records: dict[int, tuple[bytes, int]] = {}
        self.next_record = 0
        self.resizes = 0
        self._empty(max(2, 1 << max(1, (capacity // self.slots - 1).bit_length())))

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes, length: int) -> int | None:
        """The record with this key, verified against the stored content key."""
        mark, first, second = self._places(key)
        for place in (first, second):
            for other, record in self.prints[place]:
                if other == mark and self.records[record] == (key, length):
                    return record
        return None

    def insert(self, key: bytes, length: int) -> int:
        record, self.next_record = self.next_record, self.next_record + 1
        self.records[record] = (key, length)
        if not self._put(key, record):
            self._grow()
        return record

    def delete(self, key: bytes, length: int) -> bool:
        record = self.find(key, length)
        if record is None:
            return False
        mark, first, second = self._places(key)
        for place in (first, second):
            if (mark, record) in self.prints[place]:
                self.prints[place].remove((mark, record))
                break
        del self.records[record]
        return True

    def _put(self, key: bytes, record: int) -> bool:
        mark, first, second = self._places(key)
        for place in (first, second):
            if len(self.prints[place]) < self.slots:
                self.prints[place].append((mark, record))
                return True
        place = second
        for move in range(self.max_moves):
            at = move % self.slots
            out = self.prints[place][at]
            self.prints[place][at] = (mark, record)
            mark, record = out
            place = self._other(place, mark)
            if len(self.prints[place]) < self.slots:
                self.prints[place].append((mark, record))
                return True
        return False

    def _grow(self) -> None:
        """Double until every stored key fits."""
        while True:
            self.resizes += 1
            self._empty(2 * (self.mask + 1))
            if all(self._put(key, record) for record, (key, _) in self.records.items()):
                return


@dataclass
class Live:
    """The live row of a digest: its id and row number, the rows with the digest, and what the index did for it."""

    row_id: int | None
    row: int
    count: int
    hits: int = 0
    replaced: int = 0


class LiveDigests:
    """The live row of every digest: a larger id takes the place of the one that is live, of equal ids the first row."""

    def __init__(self, capacity: int = 64):
        self.index = CuckooIndex(capacity)
        self.rows: dict[int, Live] = {}

    def add(self, digest: bytes, length: int, row_id: int | None, row: int, count: int) -> None:
        record = self.index.find(digest, length)
        if record is None:
            self.rows[self.index.insert(digest, length)] = Live(row_id, row, count)
            return
        live = self.rows[record]
        live.count += count
        live.hits += 1
        before = (live.row_id is not None, live.row_id or 0, -live.row)
        if (row_id is not None, row_id or 0, -row) > before:
            self.index.delete(digest, length)
            del self.rows[record]
            live.row_id, live.row, live.replaced = row_id, row, live.replaced + 1
            self.rows[self.index.insert(digest, length)] = live

    def live(self) -> Iterator[tuple]:
        for record, live in self.rows.items():
            yield self.index.records[record][0], live.row_id, live.row, live.count, live.hits, live.replaced


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """mr_id, mr_mark, digest (SHA-256 of the normalised text), length in bytes; a row for each row of docs."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("mr_id"), F.col(f"`{text_col}`").alias("mr_text"), identity(F.col(f"`{text_col}`")).alias("mr_mark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "mr_text"):
            texts = [x.lower() for x in utf8(batch.column("mr_text"))]  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays(
                [batch.column("mr_id"), batch.column("mr_mark"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64())],
                ["mr_id", "mr_mark", "digest", "length"],
            )

    return source.mapInArrow(digest, "mr_id long, mr_mark long, digest binary, length long")


def marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digests() written down, each row with a number of its own."""
    return kept(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))


def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one task, one for each digest among COLLAPSE_ROWS of them: what is shuffled of a group of copies."""
    seen: dict[tuple[bytes, int], list] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(seen), list(seen.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([v[i] for v in values], pa.int64()) for i in range(3))], ["digest", "length", "row_id", "row", "n"]
        )

    for batch in batches:
        for digest, length, row_id, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "length", "mr_id", "row")), strict=True):
            now = seen.get((digest, length))
            if now is None:
                if len(seen) >= COLLAPSE_ROWS:
                    yield out()
                    seen.clear()
                seen[digest, length] = [row_id, row, 1]
            else:
                now[2] += 1
                if (row_id is not None, row_id or 0, -row) > (now[0] is not None, now[0] or 0, -now[1]):
                    now[:2] = row_id, row
    if seen:
        yield out()


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come bucket by bucket, through an index for each bucket: its live rows."""

    def out(live: LiveDigests) -> Iterator[pa.RecordBatch]:
        found = list(live.live())
        if found:
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["digest", "keep_id", "keep_row", "group_size", "hits", "replaced"])

    here, live = None, LiveDigests()
    for batch in batches:
        for digest, length, row_id, row, n, bucket in zip(*(batch.column(c).to_pylist() for c in ("digest", "length", "row_id", "row", "n", "bucket")), strict=True):
            if bucket != here:
                yield from out(live)
                here, live = bucket, LiveDigests()
            live.add(digest, length, row_id, row, n)
    yield from out(live)


def live_rows(marked: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, group_size, hits, replaced: the row that stays of each group in `marked` (digest, length,
    mr_id, row), and how often the index found the digest and put another row in its place."""
    rows = marked.select("digest", "length", "mr_id", "row").mapInArrow(collapsed, "digest binary, length long, row_id long, row long, n long")
    buckets = F.greatest(F.lit(1), F.ceil(F.lit(marked.count() / BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("long"), buckets))
    rows = rows.repartition("bucket", F.substring("digest", 9, 2)).sortWithinPartitions("bucket")
    return rows.mapInArrow(indexed, "digest binary, keep_id long, keep_row long, group_size long, hits long, replaced long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = marks(docs, id_col, text_col)
    live = live_rows(marked).drop("hits", "replaced")
    return marked.join(live, "digest").select(
        F.col("mr_id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, all columns kept."""
    marked = marks(docs, id_col, text_col)
    live = live_rows(marked).select("keep_row")
    stay = marked.join(live, F.col("row") == F.col("keep_row"), "left_semi")
    return only_listed(docs, stay.select("mr_id", "mr_mark"), id_col, text_col)
