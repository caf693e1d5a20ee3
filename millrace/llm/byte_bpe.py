"""Byte-level BPE encoding and decoding by replaying merges over the words of a whole block of documents.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once. The pieces that a block of documents
brings are laid out in one long linked list of bytes, an inverted index names the positions of every adjacent token
pair, and merges are applied to all words at once in rank order. A merge touches its own positions and their two
neighbours only. Results are those of the tiktoken library without special tokens.

A null text is empty: no ids. Texts of any length are handled whole; memory follows the block (BLOCK_BYTES of text or
one document) and the bounded cache of pieces. There is no shuffle: the rank file has a fixed size and is read by each
Python worker from the path that is passed in.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Text that is encoded together, and pieces remembered from block to block by a worker.
BLOCK_BYTES, CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 4 << 20, 200_000, 64, 1 << 18

_workers: dict[tuple[str, str], "MergeReplay"] = {}


class MergeReplay:
    """The encoder and decoder of one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.token}
        # the library's \s is Unicode's White_Space
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")).findall
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        self.none = len(ranks) + (1 << 20)
        self.pair_rank: dict[int, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "MergeReplay":
        """The worker's own, read once."""
        if (path, pattern) not in _workers:
            with open(path, "rb") as f:
                _workers[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return _workers[path, pattern]

    def _rank(self, key: int) -> int:
        """The rank of the pair (two ids in one number), `none` where it has none."""
        rank = self.pair_rank.get(key)
        if rank is None:
            if len(self.pair_rank) > CACHE_PAIRS:
                self.pair_rank.clear()
            rank = self.pair_rank[key] = self.ranks.get(self.token[key >> 20] + self.token[key & 0xFFFFF], self.none)
        return rank

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word: every merge that the words allow, by rank."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        size = len(ids)
        after = np.arange(1, size + 1)
        after[ends[lengths > 0] - 1] = -1
        before = np.arange(-1, size - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        where: dict[int, list[np.ndarray]] = {}
        queue: list[tuple[int, int]] = []

        def index(keys: np.ndarray, at: np.ndarray) -> int:
            """Enter pairs and their positions; the lowest rank among them."""
            if not len(keys):
                return self.none
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            lowest = self.none
            for first, last, key in zip(cuts, cuts[1:], keys[cuts[:-1]].tolist(), strict=False):
                rank = self.pair_rank.get(key)
                if rank is None:
                    rank = self._rank(key)
                if rank != self.none:
                    lowest = min(lowest, rank)
                    if key in where:
                        where[key].append(at[first:last])
                    else:
                        where[key] = [at[first:last]]
                        heapq.heappush(queue, (rank, key))
            return lowest

        starts = np.flatnonzero(after >= 0)
        index(ids[starts] << 20 | ids[starts + 1], starts)
        while queue:
            rank, key = heapq.heappop(queue)
            a, b = key >> 20, key & 0xFFFFF
            found = where.pop(key)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[ids[at] == a]
            nxt = after[at]
            live = (nxt >= 0) & (ids[nxt] == b)  # an earlier merge may have taken one of the two
            at, nxt = at[live], nxt[live]
            if not len(at):
                continue
            late = at[:0]
            if self._rank(rank << 20 | a) < rank:  # the pair with the next occurrence would come before that occurrence
                at, late, nxt = at[:1], at[1:], nxt[:1]
            elif a == b and len(at) > 1:  # occurrences share tokens: of each run, every other one from the left
                order = np.arange(len(at))
                first = np.concatenate([[True], nxt[:-1] != at[1:]])
                even = (order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0
                at, nxt = at[even], nxt[even]
            far = after[nxt]
            ids[at], ids[nxt] = rank, -1
            after[at] = far
            linked = far >= 0
            before[far[linked]] = at[linked]
            prev = before[at]
            led = prev >= 0
            lowest = index(np.concatenate([rank << 20 | ids[far[linked]], ids[prev[led]] << 20 | rank]), np.concatenate([at[linked], prev[led]]))
            if lowest < rank and len(at) > 1:
                raise ValueError("the ranks are not those of a byte-pair training: a merge outranks its own parts")
            if len(late):
                if key in where:
                    where[key].append(late)
                else:
                    where[key] = [late]
                    heapq.heappush(queue, (rank, key))
        left = ids >= 0
        flat = ids[left].tolist()
        cuts = [0, *np.concatenate([[0], np.cumsum(left)])[ends].tolist()]
        return [tuple(flat[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]

    def encode_block(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text. The texts are cut first, so that all new pieces are replayed together."""
        cut = [self.pieces(x) for x in texts]
        own: dict[str, tuple[int, ...]] = {}
        new: list[str] = []
        for piece in set(chain.from_iterable(cut)):
            if piece in self.cache:
                own[piece] = self.cache[piece]
            elif (whole := self.ranks.get(piece.encode())) is not None:
                own[piece] = (whole,)
            else:
                new.append(piece)
        for piece, ids in zip(new, self.replay([x.encode() for x in new]), strict=True):
            own[piece] = ids
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache.update((p, own[p]) for p in new if len(p) <= CACHE_CHARS)
        for pieces in cut:
            yield list(chain.from_iterable(map(own.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def byte_bpe(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the outputs asked for: n_tokens, ids, ids_sha256 (of decimal ids, one space between), decoded (bytes
    that the ids stand for), decoded_sha256."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("mr_text"))
    schema = pa.schema([("doc_id", pa.int64()), *((o, {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}[_OUTPUTS[o]]) for o in outputs)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MergeReplay.of(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, "mr_text", BLOCK_BYTES):
                columns: dict[str, list] = {o: [] for o in outputs}
                for ids in own.encode_block(pc.fill_null(part.column("mr_text"), "").to_pylist()):
                    if "n_tokens" in columns:
                        columns["n_tokens"].append(len(ids))
                    if "ids" in columns:
                        columns["ids"].append(ids)
                    if "ids_sha256" in columns:
                        columns["ids_sha256"].append(sha(" ".join(map(own.decimal.__getitem__, ids)).encode()))
                    if "decoded" in columns or "decoded_sha256" in columns:
                        back = own.decode(ids)
                        if "decoded" in columns:
                            columns["decoded"].append(back)
                        if "decoded_sha256" in columns:
                            columns["decoded_sha256"].append(sha(back))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(columns[o], schema.field(o).type) for o in outputs)], schema=schema)

    return source.mapInArrow(encode, ", ".join(["doc_id long", *(f"{o} {_OUTPUTS[o]}" for o in outputs)]))


def byte_bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (bytes) of a table of ids; null ids decode to no bytes."""
    source = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("mr_ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MergeReplay.of(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or ()) for x in batch.column("mr_ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return source.mapInArrow(decode, "doc_id long, decoded binary")
