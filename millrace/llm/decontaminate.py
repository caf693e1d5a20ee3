"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (letters, digits and underscores; case does not count). Seeds are
runs of MIN_TILE words that a document shares with an item. Where the seeds could cover enough of an item, the pair is
tiled: the longest match of unmarked words is found by running Karp-Rabin hashes over both sequences, verified, marked
in both, and so on until no match of MIN_TILE words is left. An item is leaked into a document when its tiles cover
COVERAGE of its words; their order does not count, so reordered passages are caught. Items of fewer than MIN_TILE words
are leaked only where they are the whole document. Null texts have no words; items without words leak nowhere.

The benchmark is a query set against all documents, in blocks: items are dealt to blocks by hash so that a block has
about BLOCK_BYTES of text, whatever the benchmark's size, and each block is scanned over whole documents where they are
read. Only the keys of leaked documents are shuffled. Rows that repeat an id and a text get the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import identity, parts, written

MIN_TILE, COVERAGE, BLOCK_BYTES = 5, 0.5, 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _running(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix hashes: entry i is that of the first i words."""
    n = len(ids)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))  # modulo 2**64
    inverse = pow(int(_BASE), -1, 1 << 64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]))
    return np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * back[1:])]) * powers


def _hashes(running: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of that length from the given places."""
    return running[at + length] - running[at] * np.uint64(pow(int(_BASE), length, 1 << 64))


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where windows without a marked word start."""
    if len(marked) < length:
        return np.array([], np.int64)
    seen = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(seen[length:] == seen[:-length])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles; zeros in doc match nothing."""
    item_marked, doc_marked = np.zeros(len(item), bool), doc == 0
    item_running, doc_running = _running(item), _running(doc)
    found: list[tuple[int, int, int]] = []

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(item_marked, length), _free(doc_marked, length)
        ha, hb = _hashes(item_running, a, length), _hashes(doc_running, b, length)
        common = np.isin(ha, hb)
        return a[common], ha[common], b, hb

    longest = len(item)
    while True:
        low, high = least - 1, min(longest, int((~item_marked).sum()), int((~doc_marked).sum()))
        while low < high:  # a match of some length has matches of every smaller one
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
        if low < least:
            return found
        longest = low
        a, ha, b, hb = matches(longest)
        order = np.argsort(hb, kind="stable")
        ends = np.searchsorted(hb[order], ha, "right")
        verified = False
        for at, h0, h1 in zip(a.tolist(), np.searchsorted(hb[order], ha, "left").tolist(), ends.tolist(), strict=True):
            if item_marked[at : at + longest].any():
                continue
            for to in b[order[h0:h1]].tolist():
                if not doc_marked[to : to + longest].any() and (item[at : at + longest] == doc[to : to + longest]).all():
                    item_marked[at : at + longest] = doc_marked[to : to + longest] = True
                    found.append((at, to, longest))
                    verified = True
                    break
        if not verified:  # only hashes agreed
            longest -= 1
            if longest < least:
                return found


@dataclass
class Block:
    """Some items of the benchmark, ready to be searched for."""

    items: list[tuple[int | None, str | None]]
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.sequences, places, seeds = [], [], []
        self.short: dict[tuple[str, ...], list[int]] = {}
        for n, (_, text) in enumerate(self.items):
            tokens = words(text)
            if 0 < len(tokens) < MIN_TILE:
                self.short.setdefault(tuple(tokens), []).append(n)
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in tokens], np.int64)
            self.sequences.append(own)
            at = np.arange(max(0, len(own) - MIN_TILE + 1))
            seeds.append(_hashes(_running(own), at, MIN_TILE) if len(at) else np.array([], np.uint64))
            places.append(np.stack([np.full(len(at), n), at]))
        seeds_all = np.concatenate(seeds) if seeds else np.array([], np.uint64)
        order = np.argsort(seeds_all, kind="stable")
        self.places = (np.concatenate(places, axis=1) if places else np.zeros((2, 0), np.int64))[:, order]
        # each seed once, and where its places in the items begin and end
        self.seeds, starts = np.unique(seeds_all[order], return_index=True)
        self.starts = np.append(starts, len(seeds_all))

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, words in tiles, words of the item, tiles) of the items leaked into a text."""
        tokens = words(text)
        if len(tokens) < MIN_TILE:
            return [(self.items[n][0], len(tokens), len(tokens), 1) for n in self.short.get(tuple(tokens), ())]
        doc = np.fromiter(map(self.ids.get, tokens, repeat(0)), np.int64, len(tokens))
        at = _free(doc == 0, MIN_TILE)
        if not len(at) or not len(self.seeds):
            return []
        hashes = _hashes(_running(doc), at, MIN_TILE)
        seed = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[seed] == hashes
        at, seed = at[hit], seed[hit]
        if not len(at):
            return []
        # places in items and in the document stay apart: a seed that both repeat never gives all pairs
        shared = np.unique(seed)
        counts = self.starts[shared + 1] - self.starts[shared]
        which = np.repeat(self.starts[shared], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        which, of = which[order := np.argsort(self.places[0, which], kind="stable")], np.repeat(shared, counts)[order]
        items, begins = np.unique(self.places[0, which], return_index=True)
        found = []
        for n, begin, end in zip(items.tolist(), begins.tolist(), [*begins[1:].tolist(), len(which)], strict=True):
            item = self.sequences[n]
            reach = np.zeros(len(item), bool)
            for k in range(MIN_TILE):
                reach[self.places[1, which[begin:end]] + k] = True
            if reach.sum() < COVERAGE * len(item):
                continue
            near = np.zeros(len(doc), bool)
            mine = at[np.isin(seed, of[begin:end])]
            for k in range(MIN_TILE):
                near[mine + k] = True
            # the document's part that seeds reach, a zero between its runs
            spans = np.where(near, doc, 0)[near | np.concatenate([[False], near[:-1]])]
            tiled = tiles(item, spans)
            covered = sum(length for _, _, length in tiled)
            if covered >= COVERAGE * len(item):
                found.append((self.items[n][0], covered, len(item), len(tiled)))
        return found


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_BYTES."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("mr_id"), F.col(f"`{text_col}`").alias("mr_text"))
    total = items.agg(F.sum(F.octet_length("mr_text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("mr_id", "mr_text"), F.lit(n)) == k).distinct().orderBy("mr_id", "mr_text").collect()
        yield Block([(r.mr_id, r.mr_text) for r in rows])


def _searched(source: DataFrame, benchmark: DataFrame, found: Callable[[Block, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """found(block, some rows) of all rows of source (that have mr_text) and all blocks.

    What is found in one block is written before the next one is read, so neither the driver nor the plan holds more
    than one. A benchmark of one block is searched for where the result is used.
    """

    def search(block: Block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, "mr_text"):
                yield found(block, batch)

        return run

    out = last = None
    for block in blocks(benchmark):
        if last is not None:
            out = written(last) if out is None else out.unionByName(written(last))
        last = source.mapInArrow(search(block), schema)
    return last if out is None else out.unionByName(written(last))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched_tokens, item_tokens, n_tiles, coverage: a row for each item leaked into each document."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("mr_text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_tokens", pa.int64()), ("item_tokens", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())])

    def found(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc, item, covered, n, tiled, covered / n) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("mr_text").to_pylist(), strict=True) for item, covered, n, tiled in block.leaks(text)]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return _searched(source, benchmark, found, "doc_id long, item_id long, matched_tokens long, item_tokens long, n_tiles long, coverage double")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an item is leaked into, all columns kept."""
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("string").alias("mr_id"), identity(text).alias("mr_mark"), text.alias("mr_text"))

    def found(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        leaked = pa.array([bool(block.leaks(x)) for x in batch.column("mr_text").to_pylist()], pa.bool_())
        return batch.select(["mr_id", "mr_mark"]).filter(leaked)

    gone = _searched(source, benchmark, found, "mr_id string, mr_mark long").distinct().alias("g")
    here = docs.alias("d")
    same = F.col(f"d.`{id_col}`").cast("string").eqNullSafe(F.col("g.mr_id")) & (identity(F.col(f"d.`{text_col}`")) == F.col("g.mr_mark"))
    return here.join(gone, same, "left_anti")
