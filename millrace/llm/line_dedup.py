"""Line dedup by an exact set-similarity join; DataFrame operations only.

A line is the set of its words (white space parts them, case does not count). Two lines match when their sets have a
Jaccard similarity of THRESHOLD or more. A line is removed when it matches a line that comes before it by document id,
mark of the text and line number, be that one removed or not. Lines without words stay. Null texts are empty; null ids
come first; rows that repeat an id and a text are one document, rows that repeat an id only are several. Columns may
have any names. An empty table gives no rows.

Plan. Words are ordered by rarity: a table of BUCKETS counts, whatever the corpus, ranks a word by the logarithm of its
bucket's count and then by its 64-bit hash. That order is total and the same everywhere, so prefix filtering is exact.
Equal sets (by a 64-bit key of all words, size and bitmap) become one row before anything is joined. Two matching sets
share one of their rarest words, those of the prefix (n - ceil(t n) + 1 of n words); pairs that do are filtered by
length, by position in the prefix, and by the parity bitmaps of their words, which never differ in more bits than the
sets in words. Bitmaps grow with the set (64 bits, 128 beyond NARROW words, 256 beyond twice as many): in fewer bits any
two long lines look alike, so that the pairs of a common word would all be asked about. A posting is a few numbers; what
is left is verified on the 64-bit hashes of all words, for which only lines in question are fetched.

Words that many lines have in their prefix come from groups of near copies. They are found on a sample of the sets
(which decides what is done first, never what is found). The sets of such a list are first compared with the list's
earliest one; those that match it are settled, and the full join then asks about the others only, so a group of near
copies is not multiplied into all its pairs. A bitmap of the sampled words keeps the postings of all other words out
of the first of these joins; what a step has shuffled is let go before the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Marks, freed, identity, kept, written

THRESHOLD = 0.8
#: Counts of the rarity table; one set in SAMPLE is asked for hot words, of which HOT of these have each.
BUCKETS, SAMPLE, HOT = 1 << 16, 8, 3
#: Words of a set up to which 64 bits tell sets apart.
NARROW = 64
_PLACE = ("doc", "mark", "pos")
_BITS = ("bits", "w0", "w1", "w2")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark, text: lower-cased, white space but line ends made spaces."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spaced = F.when(F.contains(raw, F.lit("\t")) | F.contains(raw, F.lit("\r")) | F.contains(raw, F.lit("\f")) | F.contains(raw, F.lit("\x0b")), F.translate(raw, "\t\r\f\x0b", "    ")).otherwise(raw)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), identity(F.col(f"`{text_col}`")).alias("mark"), F.lower(spaced).alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    """doc, mark, pos, line: the lines that have words."""
    return texts.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


def _hashes() -> Column:
    """The 64-bit hashes of the distinct words of column line."""
    return F.array_distinct(F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _parity(part: int | None = None, of: int = 1) -> Column:
    """64 parities of the words of column ranks, or of those words alone that fall into this part `of` so many."""
    bit = lambda r: _shifted(1, F.shiftright(r, 20).bitwiseAND(63).cast("int"))
    inside = lambda r: F.shiftright(r, 26).bitwiseAND(of - 1) == part
    words = F.col("ranks") if part is None else F.filter("ranks", inside)
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, r: a.bitwiseXOR(bit(r)))


def _bitmap(n: Column) -> list[Column]:
    """The columns _BITS. All parts of a bitmap together give bits, so its last part is not stored; w0 and w2 together
    give the first of two parts, also where there are four."""
    none = F.lit(0).cast("long")
    four = lambda i: F.when(n > 2 * NARROW, _parity(i, 4)).otherwise(none)
    first = F.when(n > 2 * NARROW, _parity(0, 4)).when(n > NARROW, _parity(0, 2)).otherwise(none)
    return [c.alias(name) for name, c in zip(_BITS, (_parity(), first, four(1), four(2)), strict=True)]


def _numbers(values: list[int]) -> Column:
    """A constant array; written as text, which Spark folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _shifted(value: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", value if isinstance(value, Column) else F.lit(value).cast("long"), by)


def _rarity(lines: DataFrame) -> Column:
    """Constant array: for each bucket of words, six times the logarithm of its count in lines, in the highest eight bits."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket"))
    counts = [0] * BUCKETS
    for bucket, n in words.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.least(F.round(F.log2(F.col("n") + 1) * 6), F.lit(255)).cast("int")).toLocalIterator():
        counts[bucket] = n << 55  # BUCKETS rows at most
    return _numbers(counts)


def _least_overlap(n: Column, m: Column) -> Column:
    return F.ceil((n + m) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9)


def _size(side: str) -> Column:
    return F.shiftright(f"{side}at", 32)


def _may_match(a: str, b: str) -> Column:
    """Length, position and bitmap filters; a and b prefix the columns at (size, then place in the prefix) and _BITS."""
    n, m = _size(a), _size(b)
    bits, w0, w1, w2 = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in _BITS)
    half = w0.bitwiseXOR(w2)
    count = lambda *parts: sum((F.bit_count(c) for c in parts[1:]), F.bit_count(parts[0]))
    p, q = (F.col(f"{s}at").bitwiseAND(0xFFFFFFFF) for s in (a, b))
    least = _least_overlap(n, m)
    return (
        (F.least(n, m) >= F.greatest(n, m) * THRESHOLD - 1e-9)
        & (F.least(n - p, m - q) >= least)
        & (count(bits) <= n + m - 2 * least)
        & ((F.least(n, m) <= NARROW) | (count(half, bits.bitwiseXOR(half)) <= n + m - 2 * least))
        & ((F.least(n, m) <= 2 * NARROW) | (count(w0, w1, w2, bits.bitwiseXOR(half).bitwiseXOR(w1)) <= n + m - 2 * least))
    )


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """key of the later set of each pair in `pairs` (x, y: keys) that are similar enough.

    A set's earliest partner is asked first; most sets are settled by it, and only the others are asked about the rest.
    """
    pairs = written(pairs.select("x", "y").distinct())
    freed(texts.sparkSession)
    asked = kept(pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct())
    asked = kept(sets.where(Marks(asked, "key").has()).join(asked, "key", "left_semi").select("key", *_PLACE))
    lines = _lines(texts.where(Marks(asked, "doc", "mark").has())).where(Marks(asked, *_PLACE).has())
    place = asked.select("key", *(F.col(c).alias(f"a_{c}") for c in _PLACE))
    told = lines.join(place, F.col("doc").eqNullSafe(F.col("a_doc")) & (F.col("mark") == F.col("a_mark")) & (F.col("pos") == F.col("a_pos")))
    told = written(told.select("key", _hashes().alias("words")).withColumn("n", F.size("words")))
    at = lambda side: asked.select(F.col("key").alias(side), F.struct(*_PLACE).alias(f"{side}_place"))
    placed = pairs.join(at("x"), "x").join(at("y"), "y")
    swap = F.col("x_place") > F.col("y_place")
    placed = placed.select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("late"), F.when(swap, F.struct("y_place", "y")).otherwise(F.struct(F.col("x_place").alias("y_place"), F.col("x").alias("y"))).alias("early"))
    placed = written(placed)
    freed(texts.sparkSession)

    def similar(pairs: DataFrame) -> DataFrame:
        """late, of the pairs (late, early: keys) that are similar enough."""
        of = lambda side, c: told.select(F.col("key").alias(side), F.col("words").alias(c), F.col("n").alias(f"n{c}"))
        # rows that repeat an id and a text give a line twice; that changes nothing
        found = pairs.join(of("early", "a"), "early").join(of("late", "b"), "late")
        return found.where(F.size(F.array_intersect("a", "b")) * (1 + THRESHOLD) >= (F.col("na") + F.col("nb")) * THRESHOLD - 1e-9).select("late").distinct()

    first = placed.groupBy("late").agg(F.min("early").alias("early")).select("late", F.col("early.y").alias("early"))
    settled = written(similar(first))
    rest = placed.join(settled, "late", "left_anti").select("late", F.col("early.y").alias("early"))
    rest = written(rest.join(first, ["late", "early"], "left_anti"))
    return written(settled.unionByName(similar(rest)).withColumnRenamed("late", "key"))


def _postings(sets: DataFrame, *more: str) -> DataFrame:
    """token, key, at (size and place in the prefix), bitmap."""
    return sets.select("key", "n", *_BITS, *more, F.posexplode("prefix").alias("p", "token")).select("token", "key", (_shifted(F.col("n").cast("long"), F.lit(32)) + F.col("p")).alias("at"), *_BITS, *more)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, mark, n_lines (that have words), removed (the sorted numbers, from 0, of the lines to remove), for documents
    that have lines with words."""
    texts = _texts(docs, id_col, text_col)
    rarity = _rarity(_lines(texts))
    # never null, so that the ranks are sorted as plain numbers
    rank = lambda h: F.coalesce(F.get(rarity, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long")).bitwiseOR(h.bitwiseAND((1 << 55) - 1))
    # the hashes are a column used twice: within the lambda's own expression they would not be compiled
    told = _lines(texts).select(*_PLACE, _hashes().alias("hashes"))
    told = told.select(*_PLACE, F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", rank)).alias("ranks"))
    n = F.col("n")
    # 31 bits name a word in a list: words that share them share a list, which only makes it longer
    prefix = F.slice("ranks", 1, (n - F.ceil(n * THRESHOLD - 1e-9) + 1).cast("int"))
    here = written(told.select(*_PLACE, n, F.xxhash64("ranks").alias("key"), *_bitmap(n), F.transform(prefix, lambda r: r.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix")))

    # equal sets are one: that of the first place
    sets = here.groupBy("key", "n", "bits").agg(F.min(F.struct(*_PLACE)).alias("at"), *(F.first(c).alias(c) for c in (*_BITS[1:], "prefix")))
    sets = written(sets.select("key", *(f"at.{c}" for c in _PLACE), "n", *_BITS, "prefix"))
    freed(docs.sparkSession)

    # lists of frequent words: settle what matches the earliest set of its list
    seen = _postings(sets.where(F.pmod("key", F.lit(SAMPLE)) == 0)).groupBy("token").count()
    hot = written(seen.where(F.col("count") >= HOT).select("token"))
    is_hot = Marks(hot, "token").has()  # most postings are of other words and are not shuffled
    # each task sends one posting of a word, not its whole list; the few words that only look hot go after that
    first = F.min(F.struct(*_PLACE, "key", "at", *_BITS)).alias("f")
    leaders = written(_postings(sets, *_PLACE).where(is_hot).groupBy("token").agg(first).join(hot, "token").select("token", F.col("f.key").alias("y"), *(F.col(f"f.{c}").alias(f"y_{c}") for c in ("at", *_BITS))))
    freed(docs.sparkSession)
    led = _postings(sets).where(is_hot).select("token", F.col("key").alias("x"), *(F.col(c).alias(f"x_{c}") for c in ("at", *_BITS))).join(leaders, "token")
    settled = _verified(led.where((F.col("x") != F.col("y")) & _may_match("x_", "y_")), sets, texts)

    # the join asks about the others
    posted = _postings(sets.join(settled.withColumn("done", F.lit(True)), "key", "left"), "done")
    x, y = (posted.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("key", "at", *_BITS, "done"))).withColumnRenamed("token", f"{side}_token") for side in "xy")
    # each pair once, the larger set as x; asked of both sides, so that it is not pushed to one and both read one exchange
    once = (F.col("x_at") >= F.col("y_at")) & (F.col("x_key") != F.col("y_key"))
    asks = F.col("x_done").isNull() | F.col("y_done").isNull()
    pairs = x.join(y, F.col("x_token") == F.col("y_token")).where(once & asks & _may_match("x_", "y_"))
    late = _verified(pairs.select(F.col("x_key").alias("x"), F.col("y_key").alias("y")), sets, texts)

    # a set's lines go if the set is late, or if they are not its first
    gone = settled.unionByName(late).distinct().withColumn("late", F.lit(True))
    many = here.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    asked = written(many.unionByName(gone.select("key")).distinct())
    verdict = sets.join(asked, "key", "left_semi").join(gone, "key", "left").select("key", F.struct(*_PLACE).alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    rows = here.select("key", *_PLACE).join(verdict, "key", "left")
    out = F.col("late") | (F.col("first") != F.struct(*_PLACE))
    return rows.groupBy("doc", "mark").agg(F.size(F.collect_set("pos")).alias("n_lines"), F.sort_array(F.collect_set(F.when(out, F.col("pos")))).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with words), n_removed, removed (line numbers from 0, sorted), text_mark
    (tells rows of one id apart)."""
    removed = removed_lines(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), identity(F.col(f"`{text_col}`")).alias("text_mark"))
    rows = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_mark") == F.col("mark")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"), "text_mark")


def cleaned(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines (what line_dedup() returns) taken out of the texts, all columns kept."""
    gone = removed.where(F.size("removed") > 0).select("doc_id", "text_mark", "removed").dropDuplicates(["doc_id", "text_mark"]).alias("g")
    here, text = docs.alias("d"), F.col(f"d.`{text_col}`")
    rows = here.join(gone, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.doc_id")) & (identity(text) == F.col("g.text_mark")), "left")
    lines = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("g.removed", i))
    text = F.when(F.col("g.removed").isNull(), text).otherwise(F.array_join(lines, "\n"))
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns))
