"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables answer Hamming searches."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import BLANKS, key_above
from demandloom.session import materialize

#: A fingerprint is two 64-bit halves, `f0` and `f1`.
BITS = 128
HALVES = ("f0", "f1")
#: Every two fingerprints within RADIUS bits of each other agree on one of RADIUS + 1 blocks.
RADIUS = 3
#: Near copies lie within so many bits. Two such fingerprints differ in at most FLIPS bits of one of PARTS parts.
NEAR, PARTS, FLIPS = 11, 4, 2
#: 2^8 ids lie next to each other in one task.
NEAR_IDS = 8
#: Bit i and bit i + 32 of a hash; their votes are summed in the two halves of one long.
_TWO = 0x0000000100000001


def terms(text: Column) -> Column:
    """Overlapping pairs of lower-cased words as an array of structs; the last word is a term of its own."""
    words = F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), BLANKS)
    return F.arrays_zip(words.alias("one"), F.slice(words, F.lit(2), F.size(words)).alias("two"))


def fingerprints(bodies: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys`, f0 and f1 of the text of every row; a row is one group of `keys`.

    A term's weight is its length in code points, as long words are rarer and say more. A text has fewer than 2^31 code
    points and a word is in two terms, so 32 bits hold any sum. A bit is set where more than half of the weight votes
    for it; a text without words has no set bit.
    """
    spread = bodies.select(*keys, F.inline(terms(F.col(text))).alias("one", "two"))
    weighed = spread.select(
        *keys,
        (F.length("one") + F.coalesce(F.length("two"), F.lit(0))).cast("long").alias("w"),
        F.xxhash64("one", "two").alias("h0"),
        F.xxhash64("two", "one", F.lit(1)).alias("h1"),
    )
    both = F.lit(_TWO)
    votes = [
        F.sum(F.shiftrightunsigned(f"h{half}", i).bitwiseAND(both) * F.col("w")).alias(f"v{half}_{i}")
        for half in (0, 1)
        for i in range(32)
    ]
    summed = weighed.groupBy(*keys).agg(F.sum("w").alias("w"), *votes)

    def half(n: int) -> Column:
        bits = []
        for i in range(32):
            vote = F.col(f"v{n}_{i}")
            low, high = vote.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(vote, 32)
            bits.append(F.when(2 * low > F.col("w"), F.lit(1 << i)).otherwise(F.lit(0)))
            high_bit = F.lit(1 << (i + 32)) if i < 31 else F.lit(-(1 << 63))
            bits.append(F.when(2 * high > F.col("w"), high_bit).otherwise(F.lit(0)))
        return reduce(add, bits)

    return summed.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def as_hex(*halves: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Number of bits in which two fingerprints differ."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - distance(a, b) / float(BITS)


def tables(prints: DataFrame, keep: list[str], blocks: int = RADIUS + 1) -> DataFrame:
    """Each fingerprint once per block, under the block that its permutation puts first: table number and key."""
    width = BITS // blocks
    per_half = 64 // width
    if 64 % width:
        raise ValueError("blocks must divide 64 bits evenly")
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    keys = [
        F.struct(F.lit(t).alias("table"), F.shiftrightunsigned(HALVES[t // per_half], width * (t % per_half)).bitwiseAND(mask).alias("key"))
        for t in range(blocks)
    ]
    return prints.select(*keep, *HALVES, F.inline(F.array(*keys)).alias("table", "key"))


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = RADIUS + 1) -> DataFrame:
    """All pairs (q0, q1, f0, f1, bits) of distinct fingerprints of `queries` and `index` at most `radius` bits apart.

    `blocks` must exceed `radius`: of so many blocks one at least is equal. Equal fingerprints enter once, so copies
    don't multiply, and a pair that agrees on several blocks is found in each table and reported once.
    """
    if blocks <= radius:
        raise ValueError("a search within a radius needs more blocks than bits")
    left = tables(queries.select(*HALVES).distinct(), [], blocks).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "table", "key")
    right = tables(index.select(*HALVES).distinct(), [], blocks)
    apart = distance((F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1")))
    # Spark's size estimate doesn't see the rows that exploding adds; without the hint it may broadcast the whole index.
    found = left.hint("merge").join(right.hint("merge"), ["table", "key"]).withColumn("bits", apart).where(F.col("bits") <= radius)
    return found.select("q0", "q1", *HALVES, "bits").distinct()


def count_near(queries: DataFrame, copies: DataFrame, radius: int = NEAR) -> DataFrame:
    """f0, f1 of each distinct query and `near`: the sum of `n` over the rows of `copies` at most `radius` bits apart.

    `copies` has distinct f0, f1 and a count n. Exact for radii below PARTS * (FLIPS + 1): a pair within such a radius
    differs in at most FLIPS bits of some 32-bit part, so each query asks for each part with up to FLIPS bits flipped.
    A pair counts in the first part where that holds.
    """
    if radius >= PARTS * (FLIPS + 1):
        raise ValueError("a search within a radius needs more parts or flips")
    width = BITS // PARTS
    one = [1 << i for i in range(width)]
    masks = [0, *one, *[a | b for i, a in enumerate(one) for b in one[:i]]]
    distinct = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("flip")
    halves = distinct.select("q0", "q1", F.col("q0").alias("f0"), F.col("q1").alias("f1"))
    left = tables(halves, ["q0", "q1"], PARTS).drop(*HALVES).select("q0", "q1", "table", "key", flips)
    left = left.select("q0", "q1", "table", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    # As in `within`: neither side may be broadcast on an estimate from before the rows were multiplied.
    found = left.hint("merge").join(tables(copies, ["n"], PARTS).hint("merge"), ["table", "key"])
    differ = [F.col(q).bitwiseXOR(F.col(f)) for q, f in (("q0", "f0"), ("q1", "f1"))]
    mask, per_half = F.lit((1 << width) - 1), 64 // width
    parts = [F.bit_count(F.shiftrightunsigned(differ[t // per_half], width * (t % per_half)).bitwiseAND(mask)) for t in range(PARTS)]
    earlier = reduce(lambda a, b: a | b, [(F.col("table") > t) & (parts[t] <= FLIPS) for t in range(PARTS)])
    apart = distance((F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1")))
    found = found.where((apart <= radius) & ~earlier)
    return found.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("n").alias("near"))


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in descending order of doc_id with the text of the next one; after the last comes the first.

    A null id comes last. Rows are dealt out by the high bits of their id, so that all but one row in each group find
    the next text beside them; the first text of each group is handed to the group before it.
    """
    key = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("group", F.shiftright("key", NEAR_IDS))
    groups = materialize(key_above(rows.select("group"), "group", "after"), "simhash-groups")
    first = groups.agg(F.min("group").alias("g")).first()["g"]
    before = groups.select(F.col("group").alias("_before"), F.coalesce("after", F.lit(first)).alias("group"))
    heads = rows.groupBy("group").agg(F.min_by("text", F.struct("key", "text")).alias("head")).join(before, "group")
    order = Window.partitionBy("group").orderBy("key", "text")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    joined = placed.join(heads.select(F.col("_before").alias("group"), "head"), "group", "left")
    return joined.select("doc_id", "group", "place", "text", F.coalesce("next", "head").alias("next"), F.col("next").isNull().alias("last"))


def compare_neighbours(docs: DataFrame, radius: int = RADIUS, near: int = NEAR) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and `n_within` and `n_near`: for
    ids divisible by 100 the number of documents whose fingerprints lie within `radius` bits, which are next to equal,
    and within `near` bits, which are near copies (null for others). The
    edited text replaces the last floor(n/2) code points by as many, or all, from the start of the next document in
    descending order of doc_id; rows without doc_id come last, rows that share one are ordered by text, and after the
    last row comes the first. Null texts are empty; fingerprints of texts without words are zero and equal. A table of
    one row is its own neighbour; an empty one gives no rows. Other columns are not read.
    """
    if docs.select("doc_id").isEmpty():
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("group"), F.lit(0).alias("place"))
        rows = rows.withColumn("next", F.col("text")).withColumn("last", F.lit(True))
    else:
        rows = _with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next", half))
    rows = rows.select("doc_id", "group", "place", "last", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    keys = ["group", "place", "doc_id", "last", "n_chars", "edited_sha256"]
    both = rows.select(*keys[:5], F.sha2("edited", 256).alias("edited_sha256"), F.inline(kinds).alias("kind", "body"))
    prints = fingerprints(both, [*keys, "kind"], "body")
    sides = [F.max(F.when(F.col("kind") == k, F.col(f))).alias(name + f[1]) for k, name in ((0, "f"), (1, "e")) for f in HALVES]
    prints = materialize(prints.groupBy(*keys).agg(*sides), "simhash")

    order = Window.partitionBy("group").orderBy("place")
    heads = prints.where("place = 1").select("group", *[F.col(f).alias("h" + f[1]) for f in HALVES])
    keyed = prints.select(*prints.columns, *[F.lead(f).over(order).alias("x" + f[1]) for f in HALVES])
    ends = prints.select("group").distinct()
    if prints.isEmpty():
        before = ends.select("group", F.col("group").alias("after"))
    else:
        after = key_above(ends, "group", "after")
        before = after.select("group", F.coalesce("after", F.lit(ends.agg(F.min("group")).first()[0])).alias("after"))
    heads = before.join(heads.withColumnRenamed("group", "after"), "after").drop("after")
    keyed = keyed.join(heads, "group", "left")
    own, changed = (F.col("f0"), F.col("f1")), (F.col("e0"), F.col("e1"))
    following = tuple(F.coalesce(f"x{i}", f"h{i}") for i in (0, 1))

    copies = prints.groupBy(*HALVES).agg(F.count("*").alias("n"))
    asked = within(prints.where("doc_id % 100 = 0"), copies, radius, radius + 1)
    counted = asked.join(copies, [*HALVES]).groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("n").alias("_within"))
    near_copies = count_near(prints.where("doc_id % 100 = 0"), copies, near)
    return keyed.join(counted, [*HALVES], "left").join(near_copies, [*HALVES], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(*own).alias("fingerprint"),
        as_hex(*changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("_within")).alias("n_within"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near")).alias("n_near"),
    )
