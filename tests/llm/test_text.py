import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import attention, byte_bpe, chat, decontaminate, lm_scoring, pii, sharding, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_librarys(spark, docs, odd):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("abe théing rs\x1f\x0b\x85'0१²一😀.$aaaa") for _ in range(draw.randrange(200)))) for i in range(300)]
    rows += [(900, "a" * 3001), (901, "aab" * 999), (902, None), (903, "<|endoftext|>")]
    own = library()
    for r in byte_bpe.byte_bpe(docs(*rows), PATH, PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded")).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text) and r.n_tokens == len(r.ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    encoded = byte_bpe.byte_bpe(odd, PATH, PATTERN)
    assert encoded.count() == 10
    assert sorted(bytes(r.decoded) for r in byte_bpe.byte_bpe_decode(encoded, PATH, PATTERN).collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert byte_bpe.byte_bpe(docs(), PATH, PATTERN).count() == 0


def test_merges_of_one_word_and_none():
    own = byte_bpe.MergeReplay.of(PATH, PATTERN)
    assert own.replay([]) == [] and own.replay([b"", b"th"]) == [(), (own.ranks[b"th"],)]


def test_chat_is_read_back(spark):
    rows = [
        (1, 0, "user", "<turn user>\n</turn>\n\\"), (1, 1, "assistant", "\\</turn> <turn 😀é"), (1, 1, "assistant", "\\</turn> <turn 😀é"), (2, None, None, None), (2, 3, "assistant", ""),
        (None, 0, "as>\nsis\\tant", "x"), (3, 1, "assistant", "日本語 " * 50), (3, 2, "assistant", "b" * 3000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS ids", "'y' AS mr_other")
    out = {r.conv_id: r for r in chat.format_conversations(df, tokenizers.path("byte_bpe_50k.json"), ("formatted", "loss_mask", "ids", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        r = out[conv]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert chat.read_back(r.formatted) == [(role, x) for _, role, x in turns]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(r.formatted))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert len(r.loss_mask) == len(r.ids) and any(r.loss_mask) == bool(loss)
    assert chat.format_conversations(df.where("false"), tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_mask_of_tokens_that_cross_a_span():
    mask, covered = chat.masked([(2, 5)], np.array([(0, 3), (3, 4), (3, 4), (4, 9), (9, 10)]))
    assert mask.tolist() == [True, True, True, True, False] and covered == [[(2, 5)]]


def plain_tiles(item, doc, least):
    marked, total = (set(), set()), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] != 0 and i + k not in marked[0] and j + k not in marked[1]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        marked[0].update(range(i, i + k))
        marked[1].update(range(j, j + k))
        total += k


def test_tiles():
    draw = random.Random(7)
    for _ in range(100):
        item, doc = ([draw.randrange(low, 4) for _ in range(draw.randrange(30))] for low in (1, 0))
        found = decontaminate.tiles(np.array(item, np.int64), np.array(doc, np.int64), 3)
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in found)
        assert sum(n for *_, n in found) == plain_tiles(item, doc, 3)


def test_decontamination(spark, docs, odd, monkeypatch):
    draw = random.Random(3)
    items = [[f"b{draw.randrange(500)}" for _ in range(40)] for _ in range(6)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(6, "tiny item"), (7, None), (8, ""), (None, "one two three four five six")], "item_id long, text string")
    pieces = [items[1][i : i + 10] for i in (20, 0, 30, 10)]
    rows = [
        (1, "before " + " ".join(items[0]).upper().replace(" ", ",\n") + " after"), (2, " and ".join(" ".join(p) for p in pieces)), (3, " ".join(items[2][:15])), (4, "clean words only, none of them known"),
        (5, "Tiny item!"), (6, "a tiny item in a text"), (7, None), (8, "so: one two three four five six"), (9, " ".join(items[3] + items[4])),
    ]
    want = [(1, 0), (2, 1), (5, 6), (8, None), (9, 3), (9, 4)]
    key = lambda p: (p[0], p[1] is None, p[1] or 0)
    for size in (decontaminate.BLOCK_BYTES, 300):  # one block, several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs(*rows), benchmark).collect()), key=key) == want
        kept = decontaminate.drop_leaked(docs(*rows), benchmark)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7] and kept.columns == docs().columns
    assert decontaminate.leaks(odd, benchmark).count() == 0 and decontaminate.leaks(docs(*rows), benchmark.where("false")).count() == 0
    assert decontaminate.leaks(docs(), benchmark).count() == 0


def test_sharding(spark, docs, odd):
    draw = random.Random(2)
    rows = [(i, "hot text " * 5 if i % 3 == 0 else "w" * draw.randrange(400)) for i in range(3000)]
    out = sharding.shard_by_bytes(docs(*rows), 40).toPandas()
    texts = dict(rows)
    assert all(s == len(texts[i]) + 16 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 3000 and len(sums) == 40 and sums.max() - sums.min() <= 2 * out["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    small = sharding.shard_by_bytes(odd, 4).toPandas()
    assert len(small) == 10 and set(small.law) == {"bytes"} and small["size"].min() == 16
    assert sharding.shard_by_bytes(docs(), 4).count() == 0


def test_surrogates(spark, docs, odd):
    rows = [
        (1, "mail Bob.X9@mail9.Example.com, bob.x9@mail9.example.com"), (2, "+1 (799) 555-3729 or +1-799-555-3729; 10.2.3.4"), (3, "4111 1111 1111 1111 and 4111111111111111"),
        (4, "Frau Erika Muster, Mr. John Smith, Госпожа Анна Каренина"), (5, 'token = "ffc3105535f423f352535e4ac53b5fefe07ab123"'), (6, "plain 12345 text"), (7, "DE89 3704 0044 0532 0130 00, 123-45-6789"), (8, "bob.x9@mail9.example.com"),
    ]
    out = {r.doc_id: r for r in pii.replace_pii(docs(*rows), "key").collect()}
    assert out[6].text == "plain 12345 text" and out[6].n_entities == 0
    mails = re.findall(r"\S+@[\w.]+", out[1].text)
    assert mails[0].lower() == mails[1] == out[8].text and mails[0][0].isupper() and mails[1].endswith(".com") and "bob" not in mails[1]
    first, second = re.findall(r"\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}", out[2].text)
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) and "799" not in first[:8]
    assert re.search(r"; \d\d\.\d\.\d\.\d$", out[2].text)
    digits = [int(x) for x in re.sub(r"\D", "", out[3].text.split(" and ")[1])]
    assert sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2]) in range(0, 200, 10)
    assert re.fullmatch(r"Frau [A-Z][a-z]+a [A-Z][a-z]+a, Mr\. [A-Z][a-z]+ [A-Z][a-z]+, Госпожа [А-Я][а-я]+а [А-Я][а-я]+а", out[4].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[5].text) and out[5].text != rows[4][1]
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d, \d{3}-\d\d-\d{4}", out[7].text)
    iban = re.match(r"[^,]*", out[7].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    kept = {(r.doc_id, r.text) for r in pii.replace_pii(odd, "key").collect()}
    assert kept == {(r.doc_id, r.text) for r in odd.collect()}
    assert pii.replace_pii(docs(), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    ips = [(f"{i}.{j}.{k}.0",) for i in range(10) for j in range(10) for k in range(10)]  # most of a small space
    entities = spark.createDataFrame(ips, "entity string").selectExpr("'ip' AS kind", "entity")
    out = pii.surrogates(entities, "key").toPandas()
    assert out.surrogate.is_unique and not set(out.surrogate) & set(out.entity) and len(out) == 1000


def test_surrogates_of_a_full_space(spark):
    entities = spark.range(10_000).selectExpr("'ip' AS kind", "concat_ws('.', id div 1000, id div 100 % 10, id div 10 % 10, id % 10) AS entity").where("entity > '5'")
    entities = entities.unionByName(spark.createDataFrame([("name", f"m {a}") for a in "abc"], "kind string, entity string"))
    full = spark.range(10_000).selectExpr("'ip' AS kind", "concat_ws('.', id div 1000, id div 100 % 10, id div 10 % 10, id % 10) AS entity")
    out = pii.surrogates(entities.unionByName(full), "key").toPandas()
    assert out.surrogate.is_unique and not set(out.surrogate) & set(out.entity) and len(out) == 10_003


def labelled(draw):
    common = [f"{a}{b}" for a in ("tha", "er", "on", "ing", "ea") for b in ("nd", "re", "st", "ly", "ou", "th")]
    plain = lambda n: [draw.choice(common) for _ in range(n)]
    rude = ["idiotic", "wretched", "scoundrel", "nincompoop"]

    def text(toxic):
        words = plain(draw.randrange(20, 120))
        for _ in range(toxic * draw.randrange(2, 6)):
            words.insert(draw.randrange(len(words)), draw.choice(rude))
        return " ".join(words)

    return [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]


def test_toxicity_held_out_accuracy(spark, docs, odd):
    rows = labelled(random.Random(10))
    table = docs(*((i, t) for i, t, _ in rows))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    out = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert {i for i, _, _ in rows if out[i].held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = toxicity.drop_toxic(odd, model)
    assert toxicity.score(odd, model).count() == 10 and kept.columns == odd.columns and kept.count() == 10
    nothing = toxicity.fit(table, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.score(docs(), model).count() == 0


def test_toxicity_in_a_rare_language():
    draw = random.Random(11)
    plain = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    common, rare = ["stinkwort", "lumpvogt", "quarkzunk", "mistwurm"], [f"réeux{a}{b}" for a in "klmn" for b in "prst"]

    def text(words, n):
        out = plain(40)
        for word in draw.sample(words, n):
            out.insert(draw.randrange(len(out)), word)
        return " ".join(out).encode()

    toxic = [text(common, 3) for _ in range(160)] + [text(rare, 4) for _ in range(40)]
    score = toxicity.learn(toxic, [text(common, 0) for _ in range(800)]).scorer()
    assert (score([text(rare, 4) for _ in range(50)]) >= 0.5).mean() > 0.8
    assert (score([text(common, 3) for _ in range(50)]) >= 0.5).mean() > 0.9
    assert (score([text(common, 0) for _ in range(200)]) >= 0.5).mean() < 0.05


def test_pair_counts_across_word_ends(spark, docs):
    table = docs((1, "red green red green"), (3, "blue red green"), (4, None)).selectExpr("text as mr_text")
    size = len(byte_bpe.MergeReplay.of(PATH, "").token)
    subwords = lm_scoring.Subwords.of(PATH, lm_scoring.subword_counts(lm_scoring.word_counts(table, PATH), size))
    pairs, want = lm_scoring.pair_counts(table, subwords), Counter()
    for words in ([b"red", b"green"] * 2, [b"blue", b"red", b"green"], []):
        numbers = [lm_scoring.END, *subwords.reader().read([words])[0].tolist()]
        want.update(zip(numbers, numbers[1:]))
    assert {(int(a), int(b)): int(pairs[a, b]) for a, b in zip(*np.nonzero(pairs), strict=True)} == want


def test_the_attention_block_learns_from_all_training_texts(spark):
    """A text of any length, from each task, averaged by places."""
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["red", "green", "blue", "grey"]) for _ in range(n)) for n in (9000, 5, 3000, 0)]
    size = len(byte_bpe.MergeReplay.of(PATH, "").token)
    groups = (texts[:2], texts[2:])
    one, two, both = (spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in some], n), "mr_text string") for some, n in (*((g, 1) for g in groups), (texts, 2)))
    subwords = lm_scoring.Subwords.of(PATH, lm_scoring.subword_counts(lm_scoring.word_counts(both, PATH), size))
    pairs = lm_scoring.pair_counts(both, subwords)
    alone, places = [lm_scoring.trained(t, subwords, pairs).w for t in (one, two)], []
    for some in groups:
        trainer = attention.Trainer(attention.Attention(*attention.bigram_tables(pairs, pairs.sum(axis=0))))
        targets = subwords.reader().read([t.encode().split() for t in some])[0]
        losses = trainer.add(lm_scoring._inputs(targets), targets)
        trainer.finish()
        assert trainer.places == len(targets) and not trainer.rest.size and losses[-1] < losses[0]
        places.append(trainer.places)
    got = lm_scoring.trained(both, subwords, pairs).w
    for k in got:
        assert np.allclose(got[k], (alone[0][k].astype(float) * places[0] + alone[1][k].astype(float) * places[1]) / sum(places), atol=1e-5)
    assert len(texts[0]) > 16_384 and np.abs(got["c"]).max() > 0


def test_gradients():
    draw = np.random.default_rng(0)
    pairs = draw.integers(0, 3, (attention.NUMBERS, attention.NUMBERS)).astype(float)
    model = attention.Attention(*attention.bigram_tables(pairs, pairs.sum(axis=0)))
    model.w = {k: v.astype(float) + (0.1 * draw.standard_normal(v.shape) if k in "cm" else 0) for k, v in model.w.items()}
    x, y = draw.integers(0, attention.NUMBERS, (2, 2, 20))
    _, g = model._step(x, y)
    for k, at in (("e", (x[0, 3], 2)), ("p", (4, 1)), ("q", (0, 1)), ("k", (2, 3)), ("v", (1, 1)), ("o", (3, 2)), ("1", (0, 0)), ("2", (5, 1)), ("c", (1, 2)), ("m", (y[0, 0] // attention.MEMBERS, 1, 2))):
        old = model.w[k][at]
        losses = []
        for step in (1e-5, -1e-5):
            model.w[k][at] = old + step
            losses.append(model._step(x, y)[0])
        model.w[k][at] = old
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_windows_score_each_place_once():
    lengths = np.array([0, 1, 63, 64, 65, 112, 113, 500])
    total = int(lengths.sum())
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 3, (attention.NUMBERS, attention.NUMBERS)).astype(float)
    model = attention.Attention(*attention.bigram_tables(pairs, pairs.sum(axis=0)))
    places = np.concatenate([p for p, _ in model.score(draw.integers(0, 99, total), draw.integers(0, 99, total), lengths, 3)])
    assert sorted(places.tolist()) == list(range(total))


def test_lm_scoring(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 5)
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["tha", "er", "Onin", "ea", "the", "ander", f"rare{i}"]) for _ in range(draw.randrange(0, 150)))) for i in range(120)]
    table = docs(*rows).unionByName(odd.where("doc_id is null or doc_id < 6").selectExpr("doc_id + 1000 AS doc_id", *(c for c in odd.columns if c != "doc_id")))
    words = lambda t: (t or "").lower().split() + ["\0"]
    told = [(r.doc_id, words(r.text)) for r in table.collect()]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in told if not out_of(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out_of(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in told)
    out = lm_scoring.score(table, PATH).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    held = [r for r in out if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > 2 * sum(r.base_score for r in held)  # few texts: pieces of words say less than counts
    assert lm_scoring.score(docs(), PATH).count() == 0


def test_sharding_parts_rows_that_are_equal(spark, docs):
    """A third of all rows is one row, repeated; one text is larger than a shard."""
    rows = [(7, "same text")] * 4000 + [(i, "y" * (i % 97)) for i in range(8000)] + [(9001, "z" * 60_000)]
    out = sharding.shard_by_bytes(docs(*rows), 40).toPandas()
    assert len(out) == len(rows) and sorted(out.doc_id) == sorted(i for i, _ in rows)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    share = out["size"].sum() / 40
    ends = np.cumsum(out.groupby("shard")["size"].sum().reindex(range(40), fill_value=0))
    assert (abs(ends - share * np.arange(1, 41))[ends.index != 39] <= np.maximum(0.001 * share + 120, 60_016)).all()
    sizes = out[out.doc_id != 9001].groupby("shard")["size"].sum()
    assert sizes.max() <= share * 1.01 + 120 and out[out.doc_id == 7].shard.nunique() > 1


def test_repeated_seeds_do_not_multiply():
    """A text and an item that repeat one word: marks on each side, not all pairs of places."""
    block = decontaminate.Block([(1, "x " * 4000), (2, "x " * 4000 + "other words that are not in it " * 2000)])
    text = "x " * 200_000
    tracemalloc.start()
    assert [leak[:3] for leak in block.leaks(text)] == [(1, 4000, 4000)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_windowed_scores_are_those_of_a_plain_forward_pass():
    """Each place of texts of all lengths, once, against one place at a time without batches, masks and classes sorted."""
    draw = np.random.default_rng(4)
    size = attention.NUMBERS
    model = attention.Attention(*attention.bigram_tables(draw.integers(0, 3, (size, size)).astype(float), draw.integers(1, 9, size).astype(float)))
    for name in ("c", "m"):
        model.w[name] = (0.3 * draw.standard_normal(model.w[name].shape)).astype(np.float32)
    w = {k: v.astype(float) for k, v in model.w.items()}
    lengths = np.array([1, 5, 63, 64, 65, 111, 112, 113, 300])
    targets = draw.integers(0, size, lengths.sum())
    inputs = np.concatenate([[0], targets[:-1]])

    def plain(x, target):
        h = w["e"][x] + w["p"][: len(x)]
        s = np.exp(h @ w["k"] @ (h[-1] @ w["q"]) / np.sqrt(attention.WIDTH))
        o = h[-1] + (s / s.sum()) @ (h @ w["v"]) @ w["o"]
        z = o + np.maximum(o @ w["1"] + w["b"], 0) @ w["2"]
        kind, place = divmod(int(target), attention.MEMBERS)
        log = lambda a, i: a[i] - np.log(np.exp(a).sum())
        return log(z @ w["c"] + model.class_table[x[-1]], kind) + log(z @ w["m"][kind] + model.member_table[kind, x[-1]], place)

    want = []
    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        for t in range(n):
            start = 0 if t < attention.WINDOW else ((t - attention.WINDOW) // attention.SCORED + 1) * attention.SCORED
            want.append(plain(inputs[first + start : first + t + 1], targets[first + t]))
    places, values = map(np.concatenate, zip(*model.score(inputs, targets, lengths, together=4), strict=True))
    assert sorted(places.tolist()) == list(range(lengths.sum()))
    assert np.allclose(values[np.argsort(places)], want, atol=2e-3)


def test_lm_scoring_of_odd_texts(spark, odd):
    """Long, non-Latin, repeated, empty and null texts and a row without an id: a row each, finite, the same for equal texts."""
    out = lm_scoring.score(odd, PATH).collect()
    texts = Counter(((r.text or "").lower().split() + ["end"]).__len__() for r in odd.collect())
    assert Counter(r.n_tokens for r in out) == texts and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert len({round(r.score, 4) for r in out if r.n_tokens == 3}) == 1


def test_chat_of_a_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </turn> " * 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.format_conversations(df, tokenizers.path("byte_bpe_50k.json"), ("formatted", "n_turns", "loss_chars")).collect()
    assert chat.read_back(r.formatted) == [(role, text) for _, _, role, text in rows]
    assert r.n_turns == 2000 and r.loss_chars == sum(len(t) for _, _, role, t in rows if role == "assistant")
