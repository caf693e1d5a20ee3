"""SimHash near-dedup in its wide form: five-word shingles, a Jaccard similarity of SIMILARITY or more, complete.

First the SimHash operator: the texts' fingerprints go through its inverted index of byte positions with count
filtering, and the pairs it links are verified on whole texts. SimHash bits cannot find all such pairs: a block that is
added, cut or replaced moves as many bits as many scattered edits do, so any limit on bits loses pairs just over 0.8.
Whatever the fingerprints left apart is therefore asked about once more, by an exact prefix filter on the sets of
shingles, with a bitmap in front of the texts.

Shingles are ordered by rarity: a table of BUCKETS counts, whatever the corpus, ranks a shingle by the logarithm of its
bucket's count and then by its hash. That order is total and the same everywhere. Two sets of n and m shingles that are
alike share one of their rarest n - ceil(t n) + 1 and m - ceil(t m) + 1; posting lists are made of these, and passages
that many documents hold come last in the order. Pairs of a list are in reach when their sizes allow the similarity and
the parity bitmaps of the sets differ in no more bits than alike sets may differ in shingles. No alike pair fails that.

Pairs are verified on whole texts: equal sets of five-word shingles count (a text of fewer words is one shingle).
Verified pairs make components, and of each the document with the smallest id stays. After the fingerprints' pairs each
member of a list is paired with its nearest and its smallest one in reach of another component, which joins most groups
without all their pairs. Then every pair in reach whose members are in different components is verified, so nothing
depends on how lists are cut, nor on what the fingerprints found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Marks, freed, identity, kept, only_listed, parts, utf8
from .components import components
from .simhash import dealt, fingerprint, links, runs

SHINGLE, SIMILARITY = 5, 0.8
#: Counts of the rarity table, and in how many parts it is summed; bits of a set's bitmap.
BUCKETS, PARTS, BITS = 1 << 18, 64, 512
#: Lists of so many members at most are compared many at a time, about CELLS pairs of them.
SHORT, CELLS = 16, 1 << 17


def shingle_hashes(text: bytes) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word shingles of a text; no words: none."""
    tokens = text.lower().split()
    if not tokens:
        return np.array([], np.uint64)
    words = np.array([xxhash.xxh64_intdigest(t, 42) for t in tokens], np.uint64)
    width = min(SHINGLE, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for at in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[at : at + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def least_overlap(sizes):
    """Shingles that two alike sets share at least, from the sum of their sizes."""
    return np.ceil(sizes * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)


def prefix(hashes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, one of which any alike set has in its own prefix; the empty set has the key 0."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    n = len(hashes) - int(np.ceil(SIMILARITY * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, rarity[_bucket(hashes)]))[:n]]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles in BITS cells."""
    return np.packbits(np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1)


def rarities(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each bucket of shingles, ten times the logarithm of its count in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in parts(batches, "mr_text"):
            found = [_bucket(shingle_hashes(text)) for text in utf8(batch.column("mr_text"))]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, PARTS)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select(F.col(f"`{text_col}`").alias("mr_text")).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()  # PARTS rows
    out = np.zeros(BUCKETS)
    for part, counts in rows:
        out[part * (BUCKETS // PARTS) : (part + 1) * (BUCKETS // PARTS)] = np.frombuffer(bytes(counts), np.int64)
    return np.round(np.log2(out + 1) * 10).astype(np.int16)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """mr_id, node (the text's 64-bit mark), fp (SimHash), size, bits, keys: a row for each row of docs."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("mr_id"), F.col(f"`{text_col}`").alias("mr_text"), identity(F.col(f"`{text_col}`")).alias("node"))
    rarity = rarities(docs, text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "mr_text"):
            texts = utf8(batch.column("mr_text"))
            sets = [shingle_hashes(x) for x in texts]
            fps = pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))
            bits = pa.array([bitmap(x).tobytes() for x in sets], pa.binary())
            keys = pa.array([prefix(x, rarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("mr_id"), batch.column("node"), fps, pa.array(list(map(len, sets)), pa.int32()), bits, keys], ["mr_id", "node", "fp", "size", "bits", "keys"])

    return source.mapInArrow(mark, "mr_id long, node long, fp long, size int, bits binary, keys array<long>")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of nodes that the SimHash index links, as many as connect them: a fingerprint's nodes with its least
    one, and the least ones of linked fingerprints."""
    fps = kept(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(fps, "fp").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of = lambda side: fps.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_least"))
    near = links(fps.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_least", "b_least").alias("a"), F.least("a_least", "b_least").alias("b"))
    return same.unionByName(near).distinct()


def nearest_pairs(sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: each member with its nearest and with its smallest (by place) member in reach of another root."""
    words = np.ascontiguousarray(bits).view(np.uint64)
    far = BITS + 1
    a, b = [], []
    for at in range(0, len(words), 64):
        near = distances(words, sizes, at)
        near[roots[at : at + 64, None] == roots[None, :]] = far
        here = np.arange(len(near))
        for other in (near.argmin(axis=1), (near < far).argmax(axis=1)):
            good = near[here, other] < far
            a.append(at + here[good])
            b.append(other[good])
    return np.concatenate(a), np.concatenate(b)


def in_reach(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose bitmaps are `apart` bits apart may be alike."""
    return (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-9) & (apart <= n + m - 2 * least_overlap(n + m))


def distances(words: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Bits between 64 members from place `at` on and all members; BITS + 1 for what is out of reach, and for itself."""
    rows = slice(at, at + 64)
    apart = np.zeros((len(words[rows]), len(words)), np.int64)
    for word in range(words.shape[1]):
        apart += np.bitwise_count(words[rows, None, word] ^ words[None, :, word])
    reach = in_reach(sizes[rows, None], sizes[None, :], apart)
    here = np.arange(len(apart))
    reach[here, at + here] = False
    return np.where(reach, apart, BITS + 1)


def lists(nodes: DataFrame) -> DataFrame:
    """node, key, low, high, size, bits: the members of posting lists of two or more, dealt to pairs of chunks."""
    postings = nodes.select("node", F.explode("keys").alias("key"))
    members = kept(postings.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    told = nodes.select(F.col("node").alias("mr_node"), "size", "bits")
    return dealt(members, "node").join(told, F.col("node") == F.col("mr_node")).drop("mr_node")


def crossing_pairs(sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in reach whose roots differ, each once; some at a time."""
    words = np.ascontiguousarray(bits).view(np.uint64)
    for at in range(0, len(words), 64):
        near = distances(words, sizes, at) <= BITS
        near &= (roots[at : at + 64, None] != roots[None, :]) & (np.arange(at, at + len(near))[:, None] < np.arange(len(words))[None, :])
        a, b = np.nonzero(near)
        yield at + a, b


def short_pairs(sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What crossing_pairs() (every) or nearest_pairs() finds, of many lists of one length: a row of sizes, bits and roots
    for each list. Places count through the lists laid end to end."""
    lists, length = sizes.shape
    words, far, each = np.ascontiguousarray(bits).view(np.uint64), BITS + 1, max(1, CELLS // length**2)
    for at in range(0, lists, each):
        rows = slice(at, at + each)
        apart = np.zeros((len(sizes[rows]), length, length), np.int64)
        for word in range(words.shape[2]):
            apart += np.bitwise_count(words[rows, :, None, word] ^ words[rows, None, :, word])
        near = np.where(in_reach(sizes[rows, :, None], sizes[rows, None, :], apart) & (roots[rows, :, None] != roots[rows, None, :]), apart, far)
        if every:
            row, a, b = np.nonzero(np.triu(near < far, 1))
            yield (at + row) * length + a, (at + row) * length + b
            continue
        for other in (near.argmin(axis=2), (near < far).argmax(axis=2)):
            row, a = np.nonzero(np.take_along_axis(near, other[:, :, None], 2)[:, :, 0] < far)
            yield (at + row) * length + a, (at + row) * length + other[row, a]


def candidates(members: DataFrame, every: bool) -> DataFrame:
    """a, b: pairs of nodes that may be alike. Of each list (node, size, bits, root) the nearest and the smallest of each
    member, or every pair; of different roots both."""
    members = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("node", "size", "bits", "root")):
            by_length: dict[int, list[list[np.ndarray]]] = {}
            for one in group:
                by_length.setdefault(len(one[0]), []).append(one)
            for length, found in by_length.items():
                if length < 2:
                    continue
                node, size, bits, root = (np.concatenate(column) for column in zip(*found, strict=True))
                lists = root.reshape(-1, length)
                crossing = np.repeat((lists != lists[:, :1]).any(axis=1), length)
                if not crossing.any():
                    continue
                node, sizes, root = node[crossing], size[crossing].astype(np.int64).reshape(-1, length), root[crossing].reshape(-1, length)
                rows = np.frombuffer(b"".join(bits[crossing].tolist()), np.uint8).reshape(-1, length, BITS // 8)
                if length <= SHORT:
                    pairs = short_pairs(sizes, rows, root, every)
                else:
                    of = lambda i: crossing_pairs(sizes[i], rows[i], root[i]) if every else [nearest_pairs(sizes[i], rows[i], root[i])]  # noqa: B023, E731
                    pairs = ((i * length + a, i * length + b) for i in range(len(sizes)) for a, b in of(i))
                for a, b in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["a", "b"])

    return members.mapInArrow(tally, "a long, b long").distinct()


def shingles(text: bytes) -> set[int]:
    return set(shingle_hashes(text).tolist())


def verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs whose texts are alike; only texts in question are fetched."""
    asked = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = docs.select(identity(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").alias("mr_text")).where(Marks(asked, "node").has())
    texts = kept(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    of = lambda side: texts.select(F.col("node").alias(side), F.col("mr_text").alias(f"{side}_text"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "a_text"):
            alike, sets = [], {}  # a text is read once for all its pairs of a part
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in "ab"), utf8(batch.column("a_text")), utf8(batch.column("b_text")), strict=True):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = shingle_hashes(text)
                s, t = sets[a], sets[b]
                common = len(np.intersect1d(s, t, assume_unique=True))
                alike.append(common >= SIMILARITY * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest id (a null id is larger than any other);
    all columns kept. Texts without words, null ones among them, are one group. An empty table gives no rows."""
    marked = kept(_marked(docs, id_col, text_col))
    nodes = kept(marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "bits", "keys")), F.min("mr_id").alias("low")))
    joined = kept(components(kept(verified(kept(fingerprint_pairs(nodes)), docs, text_col))))
    freed(docs.sparkSession)
    listed = kept(lists(nodes))
    for every in (False, True):
        told = joined.select(F.col("node").alias("linked"), "root")
        members = listed.join(told, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node")).drop("linked")
        asked = kept(candidates(members, every))
        freed(docs.sparkSession)
        more = kept(verified(asked, docs, text_col))
        freed(docs.sparkSession)
        joined = kept(components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
        freed(docs.sparkSession)
    roots = nodes.select("node", "low").join(joined.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    stay = roots.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("s")).select(F.col("s.low").alias("mr_id"), F.col("s.node").alias("mr_mark"))
    return only_listed(docs, stay, id_col, text_col)
