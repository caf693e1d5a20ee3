"""Scoring texts by a language model: a word-count base, and causal self-attention over subwords.

Training rows are those whose crc32 of the id as text, modulo 7, is not 2 (a row without an id is one). Tokens of the
base are words (A-Z lower-cased, parted by \\x20 and \\x09-\\x0D) and one end. Word counts cover all training rows; the
HEAD most frequent words travel with the tasks, all others are joined by the word.

The model reads each word, with a space before it, as ids of a byte-level BPE, numbered by their frequency in the
training rows: NUMBERS - 1 of them, the rest shares one number and is told apart by count. Single and pair counts cover
all training rows, and so does the attention block: each task trains it in numpy on all its rows, whole texts, from
the same beginning, and the tasks' weights are averaged by the places they have read. Whole texts are scored in
overlapping windows, each place once.

Texts are read twice: once for the word counts, once to be turned into numbers, which are written (two bytes each) and
which pair counts, training and scoring read. Within a block of texts each distinct word is looked up and encoded once.

Null and empty texts consist of the end. Without training rows counts are zero and all estimates uniform. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, slices, written
from .attention import NUMBERS, Attention, Trainer, bigram_tables
from .byte_bpe import MergeReplay
from .word_bpe import WordMerges

#: Text whose words are counted together, and text or numbers that are worked on together.
HEAD, COUNT_BYTES, BLOCK_BYTES = 100_000, 8 << 20, 4 << 20
#: In how many parts the tasks' weights are summed.
PARTS = 16
END, RARE = 0, NUMBERS - 1


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Subwords:
    """The numbers of subword ids, and the log-share of each id among those that share the number RARE."""

    path: str
    number: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, path: str, counts: np.ndarray) -> "Subwords":
        """From the count of each id: 0 is the end, then the ids by frequency, ties by id."""
        number = np.full(len(counts), RARE, np.int64)
        number[np.lexsort((np.arange(len(counts)), -counts))[: NUMBERS - 2]] = np.arange(1, NUMBERS - 1)
        rest = number == RARE
        share = np.zeros(len(counts))
        share[rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + rest.sum())) if rest.any() else 0
        return cls(path, number, share)

    def reader(self) -> "Reader":
        return Reader(self)


@dataclass
class Words:
    """The words of some texts: each distinct one, which of them follow one another, and how many each text has."""

    distinct: pa.Array
    codes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, sizes: np.ndarray) -> "Words":
        coded = words.dictionary_encode()
        return cls(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), sizes)

    @classmethod
    def split(cls, texts: pa.Array) -> "Words":
        """A-Z lower-cased, parted by \\x20 and \\x09-\\x0D; null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        found, offsets = lists.flatten(), lists.offsets.to_numpy()
        real = pc.not_equal(pc.binary_length(found), 0)  # spaces at the ends leave empty words
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        return cls.of(found.filter(real), np.diff(before[offsets - offsets[0]]))

    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


class Reader:
    """Turns texts into numbers; each distinct word is encoded once."""

    def __init__(self, subwords: Subwords):
        self.subwords, self.merges = subwords, WordMerges.of(subwords.path)

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.numbers(Words.of(pa.array(list(chain.from_iterable(texts)), pa.binary()), np.fromiter(map(len, texts), np.int64, len(texts))))

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all texts in one array, an end after each; the length of each; and the log-shares of each."""
        ids, each = self.merges.encode(words.distinct)
        starts = np.cumsum(each) - each
        number, share = self.subwords.number[ids].astype(np.uint16), self.subwords.share[ids]
        text, sizes = words.text(), each[words.codes]
        lengths = np.bincount(text, sizes, len(words.sizes)).astype(np.int64) + 1
        out = np.full(int(lengths.sum()), END, np.uint16)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths) - 1] = False
        at = np.repeat((starts[words.codes] - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        out[inside] = number[at]
        extra = np.add.reduceat(share, starts) if len(starts) else share
        return out, lengths, np.bincount(text, extra[words.codes], len(words.sizes)).astype(float)  # of no words they would be whole


def _inputs(targets: np.ndarray) -> np.ndarray:
    """The number before each: the end of the text before stands for a text's beginning."""
    return np.concatenate([np.full(1, END, targets.dtype), targets[:-1]])


def _binary(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The numbers of each text as two bytes each."""
    offsets = np.concatenate([[0], 2 * np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(np.uint16))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the column mr_numbers, their numbers in one array, and how many each row has."""
    for batch in batches:
        for part in slices(batch, "mr_numbers", BLOCK_BYTES):
            column = part.column("mr_numbers")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            held = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            yield part, held.view(np.uint16), np.diff(offsets) // 2


def numbered(texts: DataFrame, subwords: Subwords) -> DataFrame:
    """mr_numbers of the column mr_text, or those that the table has."""
    if "mr_numbers" in texts.columns:
        return texts.select("mr_numbers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = subwords.reader()
        for batch in batches:
            for part in slices(batch, "mr_text", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([_binary(*reader.numbers(Words.split(part.column("mr_text")))[:2])], ["mr_numbers"])

    return texts.select("mr_text").mapInArrow(read, "mr_numbers binary")


def _counted(texts: DataFrame) -> DataFrame:
    """word, n over the column mr_text: each distinct word and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "mr_text", COUNT_BYTES):
                words = Words.split(part.column("mr_text"))
                yield pa.RecordBatch.from_arrays([words.distinct, pa.array(np.bincount(words.codes, minlength=len(words.distinct)))], ["word", "n"])

    return texts.select("mr_text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """word, n, ids over the column mr_text: each distinct word, how often it occurs, and its subword ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordMerges.of(path)
        for batch in batches:
            ids, sizes = own.encode(batch.column("word"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["word", "n", "ids"])

    return _counted(texts).mapInArrow(encode, "word binary, n long, ids array<int>")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a batch of counted words, how often each occurs, and where words begin."""
    sizes = np.diff(batch.column("ids").offsets.to_numpy())
    return batch.column("ids").flatten().to_numpy(), np.repeat(batch.column("n").to_numpy(), sizes), np.cumsum(sizes) - sizes


def _summed(words: DataFrame, cells, size: int) -> np.ndarray:
    """cells(batch): numbers of cells and counts; summed over all words into an array of `size` cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for cell, n in cells(batch):
                total += np.bincount(cell, n, size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["cell", "n"])

    return _collected(words.mapInArrow(count, "cell long, n long"), size)


def _collected(cells: DataFrame, size: int) -> np.ndarray:
    """cell, n summed into an array of `size` cells: at most so many rows reach the driver."""
    out = np.zeros(size)
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def subword_counts(words: DataFrame, size: int, path: str = "") -> np.ndarray:
    """How often each id occurs. Words without ids are encoded here, not in a worker of their own beside this one."""
    if "ids" in words.columns:
        return _summed(words.select("n", "ids"), lambda batch: [_ids(batch)[:2]], size)

    def cells(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, sizes = WordMerges.of(path).encode(batch.column("word"))
        return [(ids, np.repeat(batch.column("n").to_numpy(), sizes))]

    return _summed(words, cells, size)


def pair_counts(texts: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often one number follows another, over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(NUMBERS * NUMBERS, np.int64)
        for _, targets, _ in _blocks(batches):
            cells = _inputs(targets).astype(np.int64)
            cells *= NUMBERS
            cells += targets
            total += np.bincount(cells, minlength=NUMBERS * NUMBERS)
            del cells
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return _collected(numbered(texts, subwords).mapInArrow(count, "cell long, n long"), NUMBERS * NUMBERS).reshape(NUMBERS, NUMBERS)


def trained(texts: DataFrame, subwords: Subwords, pairs: np.ndarray) -> Attention:
    """The model over the column mr_text or mr_numbers: bigram tables from all counts, the attention block from all texts."""
    model = Attention(*bigram_tables(pairs, pairs.sum(axis=0)))
    shapes = {k: v.shape for k, v in model.w.items()}
    schema = "part int, places long, weights binary"

    def rows(summed: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array(list(summed), pa.int32()), pa.array([n for n, _ in summed.values()], pa.int64()), pa.array([w.tobytes() for _, w in summed.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "places", "weights"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model)
        for _, targets, _ in _blocks(batches):
            trainer.add(_inputs(targets), targets)
        trainer.finish()
        weights = np.concatenate([v.ravel() for v in model.w.values()]).astype(np.float64) * trainer.places
        if trainer.places:
            yield rows({i: (trainer.places, w) for i, w in enumerate(np.array_split(weights, PARTS))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, places, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "places", "weights")), strict=True):
                n, w = summed.get(part, (0, 0.0))
                summed[part] = n + places, w + np.frombuffer(weights)
        yield rows(summed)

    found = numbered(texts, subwords).mapInArrow(train, schema).repartition("part").mapInArrow(add, schema).orderBy("part").collect()  # PARTS rows
    if found:
        flat, at = np.concatenate([np.frombuffer(bytes(w)) / places for _, places, w in found]).astype(np.float32), 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            model.w[k] = flat[at : at + size].reshape(shape)
            at += size
    return model


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("mr_text"))
    training = rows.where("not held_out")
    words = kept(_counted(training))
    ends = training.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    head = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow().combine_chunks()
    # the last of all is what a word outside the head gets
    logs = np.append(np.log10((head.column("n").to_numpy() + 1) / (n + v + 1)), 0.0)
    known = pa.concat_arrays(head.column("word").chunks or [pa.array([], pa.binary())])
    end, unknown = float(np.log10((ends + 1) / (n + v + 1))), float(np.log10(1 / (n + v + 1)))
    subwords = Subwords.of(path, subword_counts(words, len(MergeReplay.of(path, "").token), path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = subwords.reader()
        for batch in batches:
            for part in slices(batch, "mr_text", BLOCK_BYTES):
                words = Words.split(part.column("mr_text"))
                place = pc.fill_null(pc.index_in(words.distinct, value_set=known), len(known)).to_numpy()[words.codes]
                text, size = words.text(), len(words.sizes)
                rare = place == len(known)
                tail, times = np.unique(text[rare] * max(1, len(words.distinct)) + words.codes[rare], return_counts=True)
                of, word = np.divmod(tail, max(1, len(words.distinct)))
                offsets = pa.array(np.searchsorted(of, np.arange(size + 1)), pa.int32())
                numbers, lengths, extra = reader.numbers(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(words.sizes + 1), pa.array(np.bincount(text[~rare], minlength=size) + int(ends > 0)), pa.array(np.bincount(text, logs[place], size) + end, pa.float64()),
                        pa.array(extra), _binary(numbers, lengths), pa.ListArray.from_arrays(offsets, words.distinct.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_score", "extra", "mr_numbers", "tail", "times"],
                )

    found = rows.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, extra double, mr_numbers binary, tail array<binary>, times array<long>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    training = found.where("not held_out")
    model = trained(training, subwords, pair_counts(training, subwords))
    columns = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, targets, lengths in _blocks(batches):
            text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            sums = part.column("extra").to_numpy().copy()
            for places, values in model.score(_inputs(targets), targets, lengths):
                sums += np.bincount(text[places], values, len(lengths))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(sums / np.log(10))], [*columns, "score"])

    scored = kept(found.select(*columns, "extra", "mr_numbers").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, score double"))
    tail = found.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    joined = tail.join(words, "word", "left")
    added = F.coalesce(F.log10((F.col("n") + 1) / F.lit(float(n + v + 1))), F.lit(unknown)) * F.col("times")
    sums = joined.groupBy("row").agg(F.sum(added).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    zero = F.lit(0)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score",
    )
