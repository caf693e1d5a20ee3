import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, near_copies, simhash
from millrace.llm._common import freed
from millrace.llm.components import components


def test_cuckoo_index_inserts_deletes_and_grows():
    draw, live, index = random.Random(9), {}, exact_dedup.CuckooIndex(8)
    for _ in range(20_000):
        key = hashlib.sha256(str(draw.randrange(6000)).encode()).digest()
        if key in live:
            assert index.find(key, 1) == live[key] and index.find(key, 2) is None
            if draw.random() < 0.4:
                assert index.delete(key, 1)
                del live[key]
        else:
            assert index.find(key, 1) is None and not index.delete(key, 1)
            live[key] = index.insert(key, 1)
    assert index.resizes > 5 and all(index.find(k, 1) == r for k, r in live.items())


def test_cuckoo_index_verifies_hits():
    index = exact_dedup.CuckooIndex()
    a, b = b"\1\0" + bytes(30), b"\1\0" + bytes(29) + b"\1"  # one fingerprint, one bucket
    index.insert(a, 1)
    assert index.find(b, 1) is None


def test_exact_dedup(spark, docs, odd):
    got = sorted(map(tuple, exact_dedup.exact_dedup(odd).collect()), key=str)
    by = {(r[0], r[3]): r for r in got}
    assert len(got) == 10
    assert by[(2, True)][1:3] == (2, 2) and (1, False) in by  # a null text equals an empty one
    assert by[(5, True)][1:3] == (5, 4) and (5, False) in by and (4, False) in by and (None, False) in by
    assert sum(r[3] for r in got) == 6
    assert by[(5, True)][4] == hashlib.sha256(b"hello  world").hexdigest()
    assert exact_dedup.exact_dedup(docs()).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8]


def test_the_index_decides(spark, docs, monkeypatch):
    draw = random.Random(8)
    rows = [(draw.choice([None, *range(400)]), f"text {draw.randrange(60)}") for _ in range(1500)]
    table = docs(*rows).repartition(7)
    marked = exact_dedup.marks(table, "doc_id", "text")
    found = exact_dedup.live_rows(marked).toPandas()
    assert found.hits.sum() > 60 and found.replaced.sum() > 10 and found.group_size.sum() == 1500
    told = marked.select("digest", "length", F.col("mr_id").alias("row_id"), "row", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("bucket")).toArrow()
    live = exact_dedup.LiveDigests(8)
    for digest, length, row_id, row, n, _ in zip(*(c.to_pylist() for c in told.columns)):
        live.add(digest, length, row_id, row, n)
    assert live.index.resizes > 0
    assert {(d, k, n) for d, k, _, n, *_ in live.live()} == {(bytes(d), None if k != k else int(k), n) for d, k, n in zip(found.digest, found.keep_id, found.group_size)}
    # without the index nothing is found: every row would be a group of its own
    monkeypatch.setattr(exact_dedup.CuckooIndex, "find", lambda *_: None)
    monkeypatch.setattr(exact_dedup.CuckooIndex, "insert", lambda *_, n=iter(range(10**6)): next(n))
    blind = exact_dedup.LiveDigests()
    for digest, length, row_id, row, n, _ in zip(*(c.to_pylist() for c in told.columns)):
        blind.add(digest, length, row_id, row, n)
    assert len(blind.rows) == 1500
    out = exact_dedup.exact_dedup(table).toPandas()
    assert out.kept.sum() == len({t for _, t in rows}) and (out.groupby("text_sha256").kept.sum() == 1).all()


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_simhash(spark, docs, odd):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash(odd).collect()}
    assert rows[(1, "0" * 16)] == rows[(2, "0" * 16)] == rows[(3, "0" * 16)] == 1
    assert rows[(None, f"{plain_fingerprint('hello  world'):016x}")] == 4
    assert rows[(8, f"{plain_fingerprint('Éa éa 日本 😀'):016x}")] == 8
    assert simhash.simhash(docs()).count() == 0


def test_links_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 4)  # many chunks
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 30)
    values = {int(b) for b in base}
    for b in base[:20].tolist():
        for _ in range(20):
            values.add(b ^ sum(1 << int(i) for i in draw.choice(63, draw.integers(1, 5), replace=False)))
    values = sorted(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(words, draw, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_components_carry_no_constraints_from_round_to_round(spark):
    ids = random.Random(1).sample(range(60), 60)
    out = components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert out._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 60)]


def test_near_copies(spark, docs, odd):
    draw = random.Random(4)
    originals = [[f"w{draw.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    rows += [(100 + i, edited(w, draw, 3)) for i, w in enumerate(originals[:30])]  # Jaccard about 0.9
    rows += [(200 + i, edited(w, draw, 40)) for i, w in enumerate(originals[:30])]  # about 0.35
    kept = near_copies.drop_near_copies(docs(*rows))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), *range(200, 230)]
    out = near_copies.drop_near_copies(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 6, 7, 8]
    assert near_copies.drop_near_copies(docs()).count() == 0


def block_edits(words, draw):
    """The words with one block added, cut or replaced, so that the five-word shingles are alike by 0.8 to 0.88."""
    n, new = len(words), lambda k: [f"new{draw.randrange(10**6)}" for _ in range(k)]
    for want in (0.801, 0.83, 0.86, 0.88):
        grown, cut = int((n - 4) * (1 / want - 1)), int((n - 4) * (1 - want))
        yield words + new(grown)
        yield words[: n - cut]
        other = int((n - 4) * (1 - want) / (1 + want)) - 4
        at = draw.randrange(5, n - other - 5)
        yield words[:at] + new(other) + words[at + other :]


def test_near_copies_with_block_edits(spark, docs):
    draw = random.Random(5)
    originals = [[f"w{draw.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for w in originals:
        s = near_copies.shingles(" ".join(w).encode())
        for edit in block_edits(w, draw):
            t = near_copies.shingles(" ".join(edit).encode())
            assert 0.8 <= len(s & t) / len(s | t) < 0.89
            rows.append((100 + len(rows), " ".join(edit)))
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs(*rows)).collect()) == [*range(40)]


def test_near_copies_beside_nearer_ones(spark, docs):
    # of two pairs, A-B and C-D, each is nearest to its other; B-C alone joins them. Between them lie template pages
    draw = random.Random(6)
    base = [f"w{draw.randrange(3000)}" for _ in range(300)]
    new = lambda k: [f"new{draw.randrange(10**6)}" for _ in range(k)]
    rows = [(100 + i, " ".join(base[:160] + new(140))) for i in range(40)]  # alike by less than 0.4, sharing a half
    chain = [base[18 * k :] + new(18 * k) for k in range(6)]  # neighbours by about 0.88, two apart by about 0.78
    rows += [(i, " ".join(w)) for i, w in enumerate(chain)]
    sets = {i: near_copies.shingles(t.encode()) for i, t in rows}
    roots = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, now = sorted((roots[i], roots[j]))[::-1]
                roots = {k: now if r == old else r for k, r in roots.items()}
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs(*rows)).collect()) == sorted(set(roots.values()))


def test_near_copies_come_from_the_simhash_index(spark, docs, monkeypatch):
    draw = random.Random(7)
    originals = [[f"w{draw.randrange(3000)}" for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    rows += [(100 + i, edited(w, draw, 1)) for i, w in enumerate(originals)] + [(200 + i, " ".join(w) + " end " * 2) for i, w in enumerate(originals)]
    fps = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    linked = {i for i in fps if any(j < i and (fps[i] ^ fps[j]).bit_count() <= 3 for j in fps)}
    assert len(linked) > 5
    whole = sorted(r.doc_id for r in near_copies.drop_near_copies(docs(*rows)).collect())
    assert whole == [*range(20)]
    with monkeypatch.context() as m:  # what the fingerprints link goes without the prefix filter
        m.setattr(near_copies, "candidates", lambda members, every: members.selectExpr("node AS a", "node AS b").limit(0))
        assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs(*rows)).collect()) == sorted(set(fps) - linked)
    with monkeypatch.context() as m:  # and what they do not link does not stay because of them
        m.setattr(near_copies, "links", lambda fps: fps.selectExpr("fp AS a", "fp AS b").limit(0))
        assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs(*rows)).collect()) == whole


def test_every_pair_in_reach_is_asked():
    # 40 sets of which one is nearest and smallest for all others in reach: the others' pairs are asked too
    sets = [np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)] + [np.arange(1 + k, 401 + k, dtype=np.uint64) * np.uint64(7919) for k in range(1, 40)]
    bits, sizes = np.array([near_copies.bitmap(x) for x in sets]), np.full(40, 400)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    found = lambda roots: {(int(i), int(j)) for a, b in near_copies.crossing_pairs(sizes, bits, roots) for i, j in zip(a, b, strict=True)}
    assert want <= found(np.arange(40)) and not found(np.zeros(40))
    halves = np.arange(40) // 20
    assert {p for p in want if halves[p[0]] != halves[p[1]]} <= found(halves)


def plain_line_dedup(rows):
    seen, out = [], {}
    for doc, text in rows:
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(line.lower().split())
            if words:
                if any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen):
                    gone.append(n)
                seen.append(words)
        out[doc] = gone
    return out


@pytest.mark.parametrize("every", [True, False])
def test_short_lists_together_are_as_each_alone(monkeypatch, every):
    monkeypatch.setattr(near_copies, "CELLS", 40)
    draw = np.random.default_rng(4)
    for length in (2, 3, 5):
        base = draw.integers(0, 1 << 62, (30, 80)).astype(np.uint64)
        sets = [[np.unique(np.r_[x[: 80 - draw.integers(0, 25)], draw.integers(0, 1 << 62, draw.integers(0, 9)).astype(np.uint64)]) for _ in range(length)] for x in base]
        sizes, bits = np.array([[len(x) for x in row] for row in sets]), np.array([[near_copies.bitmap(x) for x in row] for row in sets])
        roots = draw.integers(0, 3, sizes.shape)
        found = {(int(x), int(y)) for a, b in near_copies.short_pairs(sizes, bits, roots, every) for x, y in zip(a, b, strict=True)}
        alone = set()
        for i in range(len(sizes)):
            for a, b in near_copies.crossing_pairs(sizes[i], bits[i], roots[i]) if every else [near_copies.nearest_pairs(sizes[i], bits[i], roots[i])]:
                alone |= {(i * length + int(x), i * length + int(y)) for x, y in zip(a, b, strict=True)}
        assert found == alone and found


def test_freed_memory_of_the_drivers_python_goes_back(spark):
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20
    held = [b"x" * (40_000 + i) for i in range(5000)]
    last = held[-1]  # it keeps what lies before it from being given back by itself
    del held
    before = resident()
    freed(spark)
    assert before - resident() > 100 and last


@pytest.mark.parametrize(("hot", "sample"), [(2, 1), (3, 8)])
def test_line_dedup(spark, docs, monkeypatch, hot, sample):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SAMPLE", sample)
    draw = random.Random(hot)
    lines = [" ".join(f"t{draw.randrange(40)}" for _ in range(draw.randrange(1, 25))) for _ in range(60)]
    rows = [(i, "\n".join(edited(x.split(), draw, draw.randrange(0, 2)) if draw.random() < 0.6 else x.upper() for x in draw.choices(lines, k=draw.randrange(0, 6)))) for i in range(80)]
    rows += [(80, None), (81, "\n\n"), (82, "  one two three  \none two three\n")]
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs(*rows)).collect()}
    assert got == plain_line_dedup(rows)
    table = line_dedup.line_dedup(docs(*rows))
    cleaned = {r.doc_id: r.text for r in line_dedup.cleaned(docs(*rows), table).collect()}
    assert cleaned[82] == "  one two three  \n" and cleaned[80] is None
    assert line_dedup.line_dedup(docs()).count() == 0


def test_only_hot_words_enter_the_first_join_of_lines(spark, docs, monkeypatch):
    asked = []

    class Told(line_dedup.Marks):
        def __init__(self, keys, *columns):
            super().__init__(keys, *columns)
            asked.append((columns, keys.count()))

    monkeypatch.setattr(line_dedup, "Marks", Told)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    rows = [(i, f"one two three four five six seven eight nine x{i}\nalone{i} apart{i}") for i in range(10)]
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs(*rows)).collect()}
    assert got == plain_line_dedup(rows)
    [hot] = [n for columns, n in asked if columns == ("token",)]
    assert 0 < hot < 10


def test_line_dedup_of_rows_that_repeat_an_id(spark, docs):
    table = docs((1, "aaa bbb ccc"), (5, "AAA bbb\tccc"), (5, "xxx yyy zzz"), (5, "xxx yyy zzz"), (None, "q r s")).withColumn("mr_id", F.lit(3)).withColumn("text_mark", F.lit("m"))
    out = line_dedup.line_dedup(table)
    got = sorted((r.doc_id or 0, r.n_lines, tuple(r.removed)) for r in out.collect())
    assert got == [(0, 1, ()), (1, 1, ()), (5, 1, ()), (5, 1, ()), (5, 1, (0,))]
    left = line_dedup.cleaned(table, out)
    assert left.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "q r s"), (1, "aaa bbb ccc"), (5, ""), (5, "xxx yyy zzz"), (5, "xxx yyy zzz")]


def test_line_dedup_of_odd_rows(spark, odd):
    got = {(r.doc_id, tuple(r.removed)) for r in line_dedup.line_dedup(odd).collect()}
    assert (None, ()) in got and (4, (0,)) in got and (5, (0,)) in got and (1, ()) in got  # a null id comes first


def test_long_lines_that_share_common_words_are_not_all_compared(spark, docs, monkeypatch):
    """160 random lines of 100 to 420 of 1,500 words, with ten near copies: only similar lines are fetched and verified."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(draw.sample(words, draw.choice([100, 150, 220, 420])))) for i in range(160)]
    rows += [(160 + i, " ".join([*rows[i][1].split(" ")[6:], "new", "words"])) for i in range(10)]
    asked = []
    verified = line_dedup._verified

    def told(pairs, sets, texts):
        asked.append(pairs.select("x", "y").distinct().count())
        return verified(pairs, sets, texts)

    monkeypatch.setattr(line_dedup, "_verified", told)
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs(*rows)).collect()}
    assert got == plain_line_dedup(rows)
    assert sum(map(len, got.values())) == 10
    assert len(asked) == 2 and sum(asked) <= 40
