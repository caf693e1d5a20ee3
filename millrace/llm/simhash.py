"""SimHash near-dedup through an inverted index of byte positions with count filtering.

Fingerprint: A-Z lower-cased, words of non-space characters, shingles of some words (repeats count; a text of fewer
words is one shingle; a text without words, or a null text, has fingerprint zero); a bit is set where more than half of
the shingles' XXH64 values have it. Fingerprints that differ in at most three of 64 bits are linked, and links make
components.

Index: three bits spoil at most three of the eight byte positions, so linked fingerprints share five positions or more.
Posting lists of one byte would have 2,048 keys whatever the input, each with a fixed share of all rows; a list is
therefore keyed by the bytes of three positions, eight triples in all: those within positions 0-3 and within 4-7. Of
any five shared positions three lie in one half, so no pair is missed. Within a list the shared positional bytes of each
pair are tallied, pairs below the guaranteed five are dropped, and the rest is verified bit by bit.

Lists are made of distinct fingerprints. A long list is dealt to pairs of chunks, so that no task holds a whole list,
and a task returns a spanning forest of what it verified, never all pairs. Components are those of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import identity, kept, parts, utf8
from .components import components

POSITIONS, MAX_BITS = 8, 3
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: A list is cut into chunks of about SMALL members, at most MANY of them while they hold LARGE members or fewer.
SMALL, MANY, LARGE = 256, 64, 2048
_HASH_ROWS = 1 << 18


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    tokens = text.lower().split()  # bytes: only A-Z change, and words end at \x20 and \x09-\x0D
    if not tokens:
        return 0
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASH_ROWS):
        to = min(n, at + _HASH_ROWS)
        values = np.array([digest(line[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """mr_id, mr_mark (tells rows of one id apart), fp: a row for each row of docs."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("mr_id"), F.col(f"`{text_col}`").alias("mr_text"), identity(F.col(f"`{text_col}`")).alias("mr_mark"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "mr_text"):
            fps = np.array([fingerprint(x, words, seed) for x in utf8(batch.column("mr_text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("mr_id"), batch.column("mr_mark"), pa.array(fps)], ["mr_id", "mr_mark", "fp"])

    return source.mapInArrow(mark, "mr_id long, mr_mark long, fp long")


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another of its component) of a spanning forest of the pairs within MAX_BITS bits."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 128):
        x = fps[at : at + 128, None] ^ fps[None, :]
        shared = np.zeros(x.shape, np.uint8)
        for position in range(POSITIONS):
            shared += (x >> np.uint64(8 * position)) & np.uint64(255) == 0
        rows, columns = np.nonzero(shared >= POSITIONS - MAX_BITS)
        close = np.bitwise_count(x[rows, columns]) <= MAX_BITS
        near[at + rows[close], columns[close]] = True
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    leaves = np.flatnonzero(label != np.arange(n))
    return fps[leaves], fps[label[leaves]]


def dealt(members: DataFrame, node: str) -> DataFrame:
    """Members of lists (node, key, n: the list's length) dealt to pairs of chunks: node, key, low, high. Two members of
    a list meet in one pair of its chunks at least."""
    chunks = F.greatest(F.least(F.ceil(F.col("n") / SMALL), F.lit(MANY)), F.ceil(F.col("n") / LARGE)).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64(node), "chunks").cast("int"))
    members = members.select(node, "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return members.select(node, "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[list[np.ndarray]]]:
    """The columns of each pair of chunks, of batches sorted by key, low and high; a few pairs at a time."""
    open_key, rest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        found = [[v[s:e] for v in values] for s, e in zip(cuts, cuts[1:], strict=False)]
        if rest is not None and tuple(key[:, 0]) == open_key:
            found[0] = [np.concatenate(x) for x in zip(rest, found[0], strict=True)]
        elif rest is not None:
            found.insert(0, rest)
        rest, open_key = found.pop(), tuple(key[:, -1])
        yield found
    if rest is not None:
        yield [rest]


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all fingerprints (distinct, column fp) that differ in three bits or fewer."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    keys = [F.lit(k << 24).cast("long") + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2]) for k, t in enumerate(TRIPLES)]
    postings = kept(fps.select("fp", F.explode(F.array(*keys)).alias("key")))
    lists = kept(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = dealt(postings.join(lists, "key"), "fp")
    members = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("fp",)):
            found = [forest(fp.view(np.uint64)) for (fp,) in group if len(fp) > 1]
            ends = [np.concatenate([f[i] for f in found]) if found else np.array([], np.uint64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ends], ["a", "b"])

    return members.mapInArrow(tally, "a long, b long")


def classes(marked: DataFrame) -> DataFrame:
    """fp, component: the smallest id of the component of each fingerprint in `marked` (mr_id, fp)."""
    fps = kept(marked.groupBy("fp").agg(F.min("mr_id").alias("low")))
    joined = kept(components(links(fps.select("fp"))))
    linked = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    linked = kept(linked.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "low"))
    lowest = kept(linked.groupBy("root").agg(F.min("low").alias("component")))
    linked = kept(linked.join(lowest, "root").select(F.col("fp").alias("linked"), "component"))
    return kept(fps.join(linked, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("component", "low").alias("component")))


def simhash(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Rows without an id belong to their component and have a null doc_id; a component of such rows only has a null
    component_id. An empty table gives no rows.
    """
    marked = kept(fingerprints(docs, words, seed, id_col, text_col))
    rows = marked.join(classes(marked), "fp")
    return rows.select(F.col("mr_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
