"""Toxicity by compression distance: zstandard dictionaries, windows, calibrated scores.

Learning is bounded: at most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled documents of at most SAMPLE_BYTES each, chosen by a
hash of their ids. Two dictionaries are trained apart: one on windows of ordinary documents, one on the windows of toxic
documents that stand out. Most of a toxic document is ordinary prose, so its windows are ranked by how much commoner
their runs of RUN bytes are, by documents, in toxic documents than in ordinary ones, and the first PASSAGES that do not
overlap are taken whole. Nothing knows of words or languages.

Scoring covers whole texts: each is lower-cased, its white space made single, and cut into overlapping windows. A window
is compressed with the ordinary dictionary, with the toxic one, and with both; its distances are the bytes that the toxic
one, and both, save beyond the ordinary one. What a document's distances look like (the largest, the mean, how many pass
thresholds) gives its score by a logistic curve fitted to the sample, so that 0.5 is the calibrated threshold.

Null and empty texts have one empty window, with no distance. Without labelled rows of both kinds nothing can be learnt:
all scores are 0. Rows that repeat count once in learning and are scored each. An empty table gives no rows. There is no
shuffle of texts: the model (under 64 KB) travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freed, kept, parts, utf8

#: Bytes of a window and between two; of a passage to learn from; of a run. Passages of a toxic document, windows of an ordinary one.
WINDOW, STEP, PASSAGE, RUN, PASSAGES, PLAIN = 48, 24, 24, 7, 6, 12
#: Sizes of the dictionaries, and of the segments that they are made of.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT = 32_768, 4096, 16
#: Bounds of the sample that is learnt from.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 4000, 16_384
#: Half of the G statistic above which a run's share of toxic documents is no accident.
SIGNIFICANT = 8.0
#: Savings in bytes above which windows are counted.
SOME, MUCH, MOST = 4, 6, 7


def _normal(text: bytes) -> bytes:
    return b" ".join(text.decode().lower().encode().split())


def _windows(text: bytes) -> list[bytes]:
    return [text[at : at + WINDOW] for at in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=5, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=own)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples, without its header; too few samples are taken as they are."""
    together = b"".join(samples)
    try:
        trained = zstandard.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return together[-size:]
    start = next((at for at in range(8, min(1024, len(trained))) if trained[at : at + SEGMENT] in together), 8)
    return trained[start:]


def _runs(text: bytes) -> np.ndarray:
    """The run of RUN bytes that starts at each place, as a number."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(x) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for at in range(RUN):
        out |= x[at : at + n] << np.uint64(8 * at)
    return out


def _documents(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs in the texts, and the number of texts that have each."""
    return np.unique(np.concatenate([np.unique(_runs(x)) for x in texts]), return_counts=True)


def standing_out(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages of toxic texts whose runs are more than twice as common, by documents, as in ordinary texts, and not by accident."""
    runs, n = _documents(toxic)
    runs, n = runs[n > 2], n[n > 2]
    other, m = _documents(ordinary)
    if not len(runs) or not len(other):
        return []
    at = np.minimum(np.searchsorted(other, runs), len(other) - 1)
    m = np.where(other[at] == runs, m[at], 0) + 0.5
    ratio = (n / len(toxic)) / (m / len(ordinary))
    share = len(toxic) / (len(toxic) + len(ordinary))
    chance = n * np.log(n / ((n + m) * share)) + m * np.log(m / ((n + m) * (1 - share)))  # half of the G statistic
    apart = (ratio > 2) & (chance > SIGNIFICANT)
    runs, weights = runs[apart], np.log(ratio[apart]) * np.sqrt(n[apart])
    if not len(runs):
        return []
    found = []
    for text in toxic:
        mine = _runs(text)
        at = np.minimum(np.searchsorted(runs, mine), len(runs) - 1)
        total = np.concatenate([[0], np.cumsum(np.where(runs[at] == mine, weights[at], 0))])
        starts = np.arange(0, max(1, len(text) - PASSAGE + 4), 4)
        worth = total[np.clip(starts + PASSAGE - RUN + 1, 0, len(mine))] - total[np.minimum(starts, len(mine))]
        taken: list[int] = []
        for i in np.argsort(-worth, kind="stable")[: 8 * PASSAGES].tolist():
            if worth[i] > 0 and len(taken) < PASSAGES and all(abs(starts[i] - t) >= PASSAGE for t in taken):
                taken.append(int(starts[i]))
        found += [text[t : t + PASSAGE] for t in taken]
    return found


@dataclass(frozen=True)
class Toxicity:
    """The ordinary and the toxic dictionary, and the logistic curve: middle and spread of each feature, weights, the
    constant last. Empty dictionaries score 0."""

    ordinary: bytes
    toxic: bytes
    middle: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def measure(self):
        """A function from texts to their features."""
        plain, toxic, both = _compressor(self.ordinary), _compressor(self.toxic), _compressor(self.toxic + self.ordinary)

        def feature(text: bytes) -> list[float]:
            windows = _windows(_normal(text))
            lengths = lambda own: np.fromiter((len(own.compress(w)) for w in windows), np.int64, len(windows))
            base, out = lengths(plain), []
            for own in (toxic, both):
                saved = base - lengths(own)
                top = np.sort(np.partition(saved, -6)[-6:] if len(saved) > 6 else saved)[::-1]
                out += [top[0], top[1] if len(top) > 1 else 0, top[2:].sum(), saved.mean(), (saved >= SOME).mean(), (saved >= MUCH).mean(), np.log1p((saved >= SOME).sum()), np.log1p((saved >= MOST).sum())]
            return [*map(float, out), float(np.log(len(windows)))]

        return lambda texts: np.array([feature(x) for x in texts], float).reshape(-1, 17)

    def fitted(self, features: np.ndarray, toxic: np.ndarray) -> "Toxicity":
        middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
        return replace(self, middle=tuple(map(float, middle)), spread=tuple(map(float, spread)), weights=_logistic((features - middle) / spread, toxic))

    def scorer(self):
        if not self.weights:
            return lambda texts: np.zeros(len(texts))
        measure, middle, spread, weights = self.measure(), np.array(self.middle), np.array(self.spread), np.array(self.weights)
        return lambda texts: 1 / (1 + np.exp(-np.clip((measure(texts) - middle) / spread @ weights[:-1] + weights[-1], -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of the columns of x, and a constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    out = np.zeros(x.shape[1])
    out[-1] = -2.0
    pull = np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ out)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        out -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, out))


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Toxicity:
    """The dictionaries of texts of both kinds, not yet calibrated; equal texts count once."""
    toxic, ordinary = (sorted({_normal(x) for x in texts}) for texts in (toxic, ordinary))
    passages = standing_out(toxic, ordinary) if toxic and ordinary else []
    if not passages:
        return Toxicity(b"", b"")
    draw = np.random.default_rng(10)
    plain = [x[at : at + WINDOW] for x in ordinary for at in draw.integers(0, max(1, len(x) - WINDOW), PLAIN).tolist()]
    return Toxicity(_dictionary(plain, ORDINARY_BYTES), _dictionary(passages, TOXIC_BYTES))


def learn(toxic: list[bytes], ordinary: list[bytes]) -> Toxicity:
    """From texts of both kinds."""
    raw = dictionaries(toxic, ordinary)
    if not raw.toxic:
        return raw
    return raw.fitted(raw.measure()(toxic + ordinary), np.repeat([1.0, 0.0], [len(toxic), len(ordinary)]))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 5, is 0. A row without an id is not one."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learn from the labelled documents that are not held out, within the bounds of the sample."""
    known = labels.where(~held_out(id_col)).select(F.col(f"`{id_col}`").cast("long").alias("mr_id"), F.col(f"`{label_col}`").alias("mr_label")).where("mr_id is not null and mr_label in (0, 1)")
    chosen = [known.where(f"mr_label = {kind}").distinct().orderBy(F.xxhash64("mr_id"), "mr_id").limit(n) for kind, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("mr_doc"), F.col(f"`{text_col}`").alias("mr_text")).where(F.octet_length("mr_text") <= SAMPLE_BYTES)
    chosen = chosen[0].unionByName(chosen[1])  # at most 6,000 rows of two numbers: small enough to broadcast
    rows = texts.join(F.broadcast(chosen), F.col("mr_doc") == F.col("mr_id")).dropDuplicates(["mr_label", "mr_text"])
    rows = kept(rows.orderBy(F.xxhash64("mr_id"), "mr_id", "mr_text").limit(SAMPLE_TOXIC + SAMPLE_ORDINARY).select("mr_label", "mr_text").repartition(16, "mr_text"))
    sample = rows.orderBy("mr_text").toArrow()
    texts_of = lambda kind: utf8(sample.filter(pc.equal(sample.column("mr_label"), kind)).column("mr_text").combine_chunks())
    raw = dictionaries(texts_of(1), texts_of(0))
    freed(docs.sparkSession)  # counting the runs of the sample takes some hundred MB
    if not raw.toxic:
        return raw

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = raw.measure()
        for batch in parts(batches, "mr_text"):
            yield pa.RecordBatch.from_arrays([batch.column("mr_label").cast(pa.int32()), pa.array(list(of(utf8(batch.column("mr_text")))), pa.list_(pa.float64()))], ["label", "features"])

    told = rows.mapInArrow(measured, "label int, features array<double>").orderBy("label", "features").toArrow()  # a row of 17 numbers for each text of the sample
    return raw.fitted(np.array(told.column("features").to_pylist()), told.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 where the score is 0.5 or more)."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("mr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in parts(batches, "mr_text"):
            scores = of(utf8(batch.column("mr_text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is 0.5 or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in parts(batches, text_col):
            yield batch.filter(pa.array(of(utf8(batch.column(text_col))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
