"""LM scoring: words and numbers of whole blocks of texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import byte_bpe, lm_scoring, word_bpe

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def test_word_merges_are_those_of_the_replay():
    draw = random.Random(5)
    words = [bytes(draw.randrange(256) for _ in range(draw.randrange(90))) for _ in range(2000)]
    words += [x * n for x in (b"a", b"ab", b"=-", "n\u00e9 \u65e5\u672c".encode()) for n in range(1, 90, 7)] + [b"", b"the", b"x" * 5000]
    array, own = pa.array(words, pa.binary()), word_bpe.WordMerges.of(PATH)
    for some, part in ((words, array), (words[70:900], array.slice(70, 830)), ([b"q" * 90], pa.array([b"q" * 90])), ([], array[:0])):
        ids, sizes = own.encode(part)
        want = byte_bpe.MergeReplay.of(PATH, "").replay([b" " + w for w in some]) if some else []
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_words_are_parted_as_python_parts_bytes():
    """Also texts that are not UTF-8, and slices of a batch with nulls."""
    draw = random.Random(6)
    pieces = [b" ", b"  ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xff", b"\x00", b"A", b"zZ", "\u00c9\u00a0\u2003".encode()]
    texts = [None if draw.random() < 0.1 else b"".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(3000)]
    raw = pa.array(texts, pa.binary())
    column = pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2], raw.buffers()[0])
    for start, n in ((0, 3000), (100, 700), (5, 0)):
        words = lm_scoring.Words.split(column.slice(start, n))
        want = [(t or b"").lower().split() for t in texts[start : start + n]]
        assert words.sizes.tolist() == [len(x) for x in want]
        assert [words.distinct[c].as_py() for c in words.codes.tolist()] == [w for x in want for w in x]


def test_texts_are_read_once_for_counts_of_pairs_training_and_scores(spark, docs, monkeypatch):
    """Pair counts, training and scoring work on written numbers; only the word counts read the texts beside."""
    read, stored = [], []
    numbered, written = lm_scoring.numbered, lm_scoring.written
    monkeypatch.setattr(lm_scoring, "numbered", lambda texts, subwords: (read.append(texts.columns), numbered(texts, subwords))[1])
    monkeypatch.setattr(lm_scoring, "written", lambda df: (stored.append(written(df)), stored[-1])[1])
    texts = {i: f"red Green {'blue ' * (i % 60)}word{i}" for i in range(60)} | {900: ""}
    out = {r.doc_id: r for r in lm_scoring.score(docs(*texts.items()), PATH).collect()}
    assert len(read) == 2 and all("mr_text" not in columns for columns in read)
    (table,) = stored
    size = len(byte_bpe.MergeReplay.of(PATH, "").token)
    training = docs(*((i, t) for i, t in texts.items() if not out[i].held_out)).selectExpr("text as mr_text")
    subwords = lm_scoring.Subwords.of(PATH, lm_scoring.subword_counts(lm_scoring.word_counts(training, PATH), size))
    for r in table.collect():
        assert np.frombuffer(r.mr_numbers, np.uint16).tolist() == subwords.reader().read([texts[r.doc_id].lower().encode().split()])[0].tolist()
    assert (lm_scoring.pair_counts(training, subwords) == lm_scoring.pair_counts(table.where("not held_out"), subwords)).all()
