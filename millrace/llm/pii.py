"""PII: surrogates for detected entities; DataFrame operations only.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, account numbers (13 to 19 digits and IBANs), social
security numbers, secrets (hexadecimal strings of 32 to 64 digits), and names after a gendered title. An entity is what
its mentions have in common (digits without separators, letters without case), so all mentions of one entity, in any
document, get one surrogate, each in the format of the mention: digits become digits, letters become letters of their
case, separators stay, octets stay octets, a valid check digit stays valid, a country code and a top-level domain are
kept. Names keep their title; their parts become syllables of the same script with an ending of the title's gender.

Surrogates come from a SHA-256 of the key, the type and the entity. They are checked over the whole corpus: where two
entities would share one, or one would equal an entity that exists, all but the smallest draw again, until none is left.
Where a space is so full that draws keep colliding (one-digit octets, say), surrogates become longer than the mention.
An untitled mention of a name that is titled elsewhere is not detected.

Texts without entities pass as they are; only texts with entities, and the entities, are shuffled. Null texts stay null
and have no entities. Rows that repeat an id and a text get the same surrogates. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import identity, kept

MALE, FEMALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа"]
_NAME = r"\p{Lu}[\p{Ll}'’-]+(?: \p{Lu}[\p{Ll}'’-]+){0,2}"
#: In the order in which they are tried at a place.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b[0-9A-Fa-f]{32,64}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?(?=[A-Z0-9]{0,2}[0-9])[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": r"\b(?:" + "|".join(MALE + FEMALE) + r")\.? " + _NAME,
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: What any entity has in it; cheap to look for.
HINT = "[@0-9]|(?:" + "|".join(MALE + FEMALE) + r")\.? "
#: Attempts after which a surrogate may be a sign longer than what it stands for.
WIDER = 5


def _type(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _entity(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    female = mention.rlike(r"^(?:" + "|".join(FEMALE) + r")\b")
    name = F.concat(F.when(female, "f ").otherwise("m "), F.lower(F.regexp_replace(mention, r"^\S+ ", "")))
    return (
        F.when(kind == "phone", F.concat(F.when(F.startswith(mention, F.lit("+")), "+").otherwise(""), digits))
        .when(kind.isin("account", "ssn"), digits)
        .when(kind == "iban", F.lower(F.replace(mention, F.lit(" "), F.lit(""))))
        .when(kind == "ip", mention)
        .when(kind == "name", name)
        .otherwise(F.lower(mention))
    )


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def _luhn(digits: Column) -> Column:
    """The checksum of a string of digits, modulo 10: 0 where the last digit checks."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(code: Column) -> Column:
    """The IBAN checksum of an account number without spaces, in lower case: 1 where it checks."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.rlike("[a-z]"), 100).otherwise(10) + F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), c) - 1) % 97)


def _surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The entity that stands for `entity` at this attempt."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), entity), 256)
    draw = lambda i, n: F.pmod(F.xxhash64(seed, i.cast("int")), F.lit(n)).cast("int")
    letter = lambda alphabet, at: F.substr(F.lit(alphabet), at + 1, F.lit(1))
    keep = (
        F.when(kind == "phone", F.when(F.startswith(entity, F.lit("+")), 2).otherwise(0))
        .when(kind == "iban", 2)
        .otherwise(0)
    )
    last = F.when(kind == "email", F.length(entity) - F.instr(F.reverse(entity), ".") + 1).otherwise(1 << 30)
    plain = F.transform(
        _chars(entity),
        lambda c, i: F.when((i < keep) | (i + 1 >= last), c)
        .when(kind == "secret", letter("0123456789abcdef", draw(i, 16)))
        .when(c.rlike("[0-9]"), draw(i, 10).cast("string"))
        .when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz", draw(i, 26)))
        .otherwise(c),
    )
    plain = F.array_join(plain, "")
    octet = lambda o, i: F.when(F.length(o) == 1, draw(i, 10)).when(F.length(o) == 2, draw(i, 90) + 10).otherwise(draw(i, 155) + 100).cast("string")
    address = F.array_join(F.transform(F.split(entity, r"\."), octet), ".")
    head = F.substr(plain, F.lit(1), F.length(plain) - 1)
    checked = F.concat(head, F.pmod(-_luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))

    def part(word: Column) -> Column:
        own = F.sha2(F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), word), 256)
        pick = lambda i, alphabet: letter(alphabet, F.pmod(F.xxhash64(own, F.lit(i)), F.lit(len(alphabet))).cast("int"))
        latin = F.concat(*(pick(i, "bdfglmnprstv" if i % 2 == 0 else "aeiou") for i in range(5)))
        cyrillic = F.concat(*(pick(i, "бвгдклмнпрст" if i % 2 == 0 else "аеиоу") for i in range(5)))
        female = F.startswith(entity, F.lit("f "))
        return F.when(word.rlike("[а-яё]"), F.concat(cyrillic, F.when(female, "а").otherwise(""))).otherwise(F.concat(latin, F.when(female, "a").otherwise("")))

    name = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.array_join(F.transform(F.split(F.substr(entity, F.lit(3)), " "), part), " "))
    iban = F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"), F.substr(plain, F.lit(5)))
    iban = F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(iban)).cast("string"), 2, "0"), F.substr(plain, F.lit(5)))
    valid = _mod97(F.when(kind == "iban", entity).otherwise("")) == 1
    # where a space is full, surrogates grow by a sign for every WIDER attempts
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / WIDER).cast("int")), lambda i: F.when(i == 0, "").when(kind == "name", letter("abcdefghijklmnopqrstuvwxyz", draw(i + 1000, 26))).otherwise(draw(i + 1000, 10).cast("string"))), "")
    return F.concat(F.when(kind == "ip", address).when(kind == "name", name).when((kind == "iban") & valid, iban).when((kind == "account") & (_luhn(F.when(kind == "account", entity).otherwise("0")) == 0), checked).otherwise(plain), more)


def _written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    signs = F.regexp_replace(surrogate, "[^0-9a-z]", "")
    at = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^0-9A-Za-z]", ""))
    sign = lambda i: F.substr(signs, at(i), F.lit(1))

    def one(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(sign(i))).when(c.rlike("[0-9a-z]"), sign(i)).otherwise(c)

    same = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), "")
    same = F.concat(same, F.substr(signs, at(F.length(mention)) + 1))
    return F.when(kind == "name", F.concat(F.regexp_extract(mention, r"^\S+ ", 0), F.initcap(F.substr(surrogate, F.lit(3))))).otherwise(same)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate of distinct (kind, entity): distinct surrogates, none of which is an entity itself."""
    entities = kept(entities.select("kind", "entity").distinct())
    drawn = kept(entities.select("kind", "entity", F.lit(0).alias("attempt"), _surrogate(F.col("kind"), F.col("entity"), key, F.lit(0)).alias("surrogate")))
    for attempt in count(1):  # ends: from WIDER on each space grows tenfold every WIDER attempts
        real = entities.select("kind", F.col("entity").alias("surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1")
        again = drawn.join(first, ["kind", "surrogate"]).where("entity != owner").select("kind", "entity")
        again = kept(again.unionByName(drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "entity")).distinct())
        if again.isEmpty():
            return drawn.select("kind", "entity", "surrogate")
        redrawn = again.select("kind", "entity", F.lit(attempt).alias("attempt"), _surrogate(F.col("kind"), F.col("entity"), key, F.lit(attempt)).alias("surrogate"))
        drawn = kept(drawn.join(again, ["kind", "entity"], "left_anti").unionByName(redrawn))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_entities (mentions replaced), kinds (sorted, distinct), text with surrogates."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    some = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    clean = rows.where(~some).select("doc_id", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"), "text")
    rows = rows.where(some).withColumn("mark", identity(F.col("text")))
    mentions = rows.select("doc_id", "mark", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "mention"))
    mentions = mentions.withColumn("kind", _type(F.col("mention")))
    mentions = kept(mentions.withColumn("entity", _entity(F.col("kind"), F.col("mention"))))
    mapped = surrogates(mentions, key)
    written = mentions.join(mapped, ["kind", "entity"]).select("doc_id", "mark", "pos", "kind", _written(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
    # a document's own mentions; repeated rows give equal structs, which the set holds once
    new = kept(written.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("pos", "kind", "new"))).alias("new")))
    new = new.select(F.col("doc_id").alias("new_id"), F.col("mark").alias("new_mark"), "new")
    told = rows.join(new, (F.col("mark") == F.col("new_mark")) & F.col("doc_id").eqNullSafe(F.col("new_id")))
    pieces = F.split("text", PATTERN, -1)
    joined = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("new", i)["new"], F.lit(""))))
    told = told.select("doc_id", F.size("new").alias("n_entities"), F.array_sort(F.array_distinct(F.col("new.kind"))).alias("kinds"), F.array_join(joined, "").alias("text"))
    return clean.unionByName(told)
