"""Near-duplicate documents by SetSketch registers: banding, joint estimation by likelihood, and verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.words import Runs, WordHashes, mix
from demandloom.session import materialize

SHINGLE = 5
THRESHOLD = 75  # per cent
#: SetSketch parameters: registers are floor(1 - log_b x) of minima x of exponentials with rate a, cut to 0..q+1.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Rows of a band and number of bands. A pair at 0.75 shares a band with probability 1 - (1 - 0.75^7)^68 > 0.9999, one at
#: 0.5 with 0.41.
ROWS, BANDS = 7, 68
REGISTERS = ROWS * BANDS
#: A pair goes on to verification unless its estimate lies this many standard deviations below the threshold; a link at
#: the threshold is lost with 3e-5, less often than by the bands.
DEVIATIONS = 4.0
#: Classes of a bucket, the largest first, whose representatives meet the bucket's members in each turn, how many of them
#: a member meets in one turn, and the share of links among those pairs below which turns end.
LEADERS = 6
MEETINGS = 4
LINKED = 0.02
#: A bucket with more members than this is crowded: what is left of its pairs passes the odd sketches first.
CROWDED = 8
#: Bits of an odd sketch per member of the set, before rounding up to a power of two, and the bounds of its length.
ODD_BITS, LEAST_BITS, MOST_BITS = 16, 256, 1 << 16
PROFILE = "doc_id long, n_shingles long, same binary, sketch binary, bands array<bigint>"

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).astype(np.uint32)
_BAND_SEEDS = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def lowered(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; other letters stay as they are."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct runs of five words; the whole sequence where there are fewer; none without words."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: one exponential minimum each, on a log scale.

    Each register draws from a hash of 32 bits, fine enough for the scale up to millions of members.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(short), 2048):
        drawn = short[None, i : i + 2048] ^ _SEEDS[:, None]
        drawn *= np.uint32(0x85EBCA6B)
        drawn ^= drawn >> np.uint32(16)
        drawn *= np.uint32(0xC2B2AE35)
        np.minimum(least, drawn.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = _BAND_SEEDS.copy()
        for column in sketch.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = mix(key ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sets of known sizes from the joint order of their registers.

    A register of U exceeds that of V with probability p(u - vJ), where u and v are the sets' shares of na + nb and
    p(x) = -log_b(1 - x (b-1)/b); the log-likelihood is concave in J and is maximised by golden-section search.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(32):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = likelihood(left) >= likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members in bins, one bit a bin, as 64-bit words.

    Bins that differ in parity hold at least one member of one set only, so the bits in which two sketches of one length
    differ never outnumber the sets' symmetric difference. The halves of a sketch, combined by exclusive or, are the
    sketch of half the length.
    """
    bits = min(max(1 << int(ODD_BITS * len(hashes) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    count = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text with words."""
    width = min(SHINGLE, len(words))
    starts = np.arange(len(words) - width + 1)
    return np.unique(Runs(hashes.of(words)).hash(starts, starts + width))


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: size of the shingle set, a digest of the lower-cased word sequence, the sketch and its band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                words = lowered(text)
                if not words:
                    rows.append((key, 0, None, None, None))
                    continue
                members = _hashes(words, hashes)
                sketch = registers(members)
                same = blake2b(b" ".join(words), digest_size=16).digest()
                rows.append((key, len(members), same, sketch.tobytes(), band_keys(sketch)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "same", "sketch", "bands"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PROFILE)


def _odd_sketches(texts: DataFrame) -> DataFrame:
    """Odd sketches of texts with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            odd = [odd_sketch(_hashes(lowered(text), hashes)) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "odd": odd})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, odd array<bigint>")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimate isn't clearly below the threshold."""
    floor = THRESHOLD / 100 - DEVIATIONS * np.sqrt(THRESHOLD / 100 * (1 - THRESHOLD / 100) / REGISTERS)

    @F.pandas_udf(T.BooleanType())
    def close(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (sa, sb))
        return pd.Series(estimate(a, b, na.to_numpy(float), nb.to_numpy(float)) >= floor)

    sides = [sketches.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a")
    return both.where(_fits("na", "nb")).where(close("sa", "sb", "na", "nb")).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that the full shingle sets confirm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last, left, keep = None, set(), []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"]):
                if a != last:
                    last, left = a, shingles(lowered(ta))
                right = shingles(lowered(tb))
                shared = len(left & right)
                keep.append(100 * shared >= THRESHOLD * (len(left) + len(right) - shared))
            yield batch.loc[keep, ["a", "b"]]

    sides = [texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab"]
    return pairs.join(sides[1], "b").join(sides[0], "a").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked node, by alternating large-star and small-star steps.

    Steps end when nothing changes, after about log n rounds; each is written to the shared folder. Minima combine
    before their shuffle and neighbours are joined back, so that no task holds a node's neighbours.
    """

    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = materialize(edges.where("x > m").distinct(), "near-classes")
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)")), F.sum("m")).first()
        return edges, tuple(sums)

    edges, state = written(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")))
    before = None
    while state != before:
        ends = edges.unionByName(edges.select(F.col("m").alias("x"), F.col("x").alias("m")))
        least = ends.groupBy("x").agg(F.least(F.min("m"), F.first("x")).alias("least"))
        large = ends.where("m > x").join(least, "x").select(F.col("m").alias("x"), F.col("least").alias("m")).distinct()
        down = large.groupBy("x").agg(F.min("m").alias("least"))
        moved = large.join(down, "x").select(F.explode(F.array("x", "m")).alias("x"), F.col("least").alias("m"))
        before = state
        edges, state = written(moved)
    return edges.select(F.col("x").alias("doc_id"), F.col("m").alias("component"))


def _with_classes(keys: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the buckets that aren't all of one class yet, with their classes and the sizes of their sets."""
    classes = components(links)
    member = keys.join(classes, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("class"))
    mixed = member.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    return materialize(member.join(mixed, "key").join(sizes, "doc_id"), "near-open")


def _fits(a: str, b: str) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _few(pairs: DataFrame, turn: int) -> DataFrame:
    """Up to MEETINGS of each member's pairs (a, b): those that share most buckets first, ties drawn anew in each turn."""
    draw = Window.partitionBy("m").orderBy(F.desc("shared"), F.xxhash64("a", "b", F.lit(turn)))
    return pairs.withColumn("_at", F.row_number().over(draw)).where(F.col("_at") <= MEETINGS).select("a", "b").distinct()


def _led(member: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members outside a bucket's largest class with representatives of its largest other classes.

    Representatives are drawn anew in each turn. Members of the largest class are met through its representative.
    """
    draw = F.xxhash64("doc_id", F.lit(turn))
    classes = member.groupBy("key", "class").agg(F.count("*").alias("size"), F.min_by(F.struct("doc_id", "n"), draw).alias("lead"))
    largest = Window.partitionBy("key").orderBy(F.desc("size"), "class")
    ranked = classes.withColumn("_at", F.row_number().over(largest)).withColumn("home", F.first("class").over(largest))
    leads = ranked.where(F.col("_at") <= LEADERS).select(
        "key", "home", F.col("class").alias("lc"), F.col("lead.doc_id").alias("l"), F.col("lead.n").alias("ln")
    )
    met = member.join(leads, "key").where(_fits("n", "ln") & F.expr("class <> lc AND class <> home"))
    ends = met.select(F.least("l", "doc_id").alias("a"), F.greatest("l", "doc_id").alias("b"), F.col("doc_id").alias("m"))
    return ends.groupBy("a", "b", "m").agg(F.count("*").alias("shared"))


def _placed(member: DataFrame) -> DataFrame:
    """Members of buckets, whether they are outside the bucket's largest class, and how many members the bucket has."""
    classes = member.groupBy("key", "class").agg(F.count("*").alias("size"))
    home = classes.groupBy("key").agg(F.max_by("class", F.struct("size", "class")).alias("home"), F.sum("size").alias("size"))
    return member.join(home, "key").select("key", "doc_id", "class", "n", (F.col("class") != F.col("home")).alias("out"), "size")


def _near(l: str, r: str) -> Column:
    """Whether the bits in which two odd sketches differ allow a link; true for every link.

    A link's symmetric difference is at most (100 - t) / (100 + t) of the sum of the sizes, t the threshold in per cent.
    Sizes of links differ by less than a factor of two, lengths of their sketches by one step at most.
    """

    def differing(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def half(x: Column) -> Column:
        middle = (F.size(x) / 2).cast("int")
        return differing(F.slice(x, F.lit(1), middle), F.slice(x, middle + 1, middle))

    ours, theirs = F.col(f"{l}_odd"), F.col(f"{r}_odd")
    words = (
        F.when(F.size(ours) > F.size(theirs), differing(half(ours), theirs))
        .when(F.size(ours) < F.size(theirs), differing(ours, half(theirs)))
        .otherwise(differing(ours, theirs))
    )
    differ = F.aggregate(words, F.lit(0), lambda total, x: total + F.bit_count(x))
    return (100 + THRESHOLD) * differ <= (100 - THRESHOLD) * (F.col(f"{l}_n") + F.col(f"{r}_n"))


def _across(placed: DataFrame, more: Sequence[str] = (), near: Column | None = None) -> DataFrame:
    """Pairs (a, b) of a bucket's members of different classes, at least one of them outside the largest.

    Two members outside meet once, in the order of their ids; a member inside meets each one outside.
    """
    names = ["doc_id", "class", "n", "out", *more]
    left, right = (placed.select("key", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "lr")
    both = left.where("l_out").join(right, "key")
    met = both.where(_fits("l_n", "r_n") & F.expr("l_class <> r_class AND (NOT r_out OR l_doc_id < r_doc_id)"))
    met = met if near is None else met.where(near)
    return met.select(F.least("l_doc_id", "r_doc_id").alias("a"), F.greatest("l_doc_id", "r_doc_id").alias("b")).distinct()


def _links(profile: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links between representatives, enough of them to give every class.

    Members are compared with a few of the smallest members of their buckets and then, turn by turn, those
    outside a bucket's largest class with a few drawn from its largest other classes, those in most common buckets first,
    while a fair share of these pairs are links. Work stays in proportion to the members, and a
    large group of copies comes together even where many of its pairs are below the threshold. What is still outside the
    bucket's largest class is then compared with all members of other classes; in crowded buckets only the pairs whose
    odd sketches allow a link become rows, which leaves out no link. No pair is compared twice, and sketches and texts of documents whose buckets are settled are left behind.
    """
    sketches = profile.select("doc_id", "n_shingles", "sketch")
    sizes = profile.select("doc_id", F.col("n_shingles").alias("n"))
    keys = profile.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("_other")).where("leader < _other")
    keys = materialize(keys.join(shared.drop("_other"), "key").distinct(), "near-buckets")
    wanted = keys.select("doc_id").distinct()
    texts = materialize(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text"), "near-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = materialize(_likely(pairs, sketches), "near-likely")
        return materialize(_verified(likely, texts), "near-links")

    star = keys.where("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"), F.col("doc_id").alias("m"))
    star = star.groupBy("a", "b", "m").agg(F.count("*").alias("shared"))
    tried = materialize(_few(star, 0), "near-pairs")
    links = confirmed(tried)
    turn, open_ = 0, True
    while open_:
        member = _with_classes(keys, links, sizes)
        if member.isEmpty():
            return links
        if turn == 0:
            still = materialize(member.select("doc_id").distinct(), "near-still")
            sketches, texts = (materialize(x.join(still, "doc_id", "left_semi"), "near-still") for x in (sketches, texts))
        turn += 1
        led = _led(member, turn).join(tried, ["a", "b"], "left_anti")
        fresh = materialize(_few(led, turn), "near-pairs")
        found = confirmed(fresh)
        tried, links = tried.unionByName(fresh), links.unionByName(found)
        open_ = found.count() > LINKED * fresh.count()

    placed = materialize(_placed(_with_classes(keys, links, sizes)), "near-placed")
    crowded = placed.where(F.col("size") > CROWDED)
    sketched = _odd_sketches(texts.join(crowded.select("doc_id").distinct(), "doc_id", "left_semi"))
    sieved = _across(crowded.join(materialize(sketched, "near-odd"), "doc_id"), ["odd"], _near("l", "r"))
    cross = _across(placed.where(F.col("size") <= CROWDED)).unionByName(sieved).distinct()
    rest = materialize(cross.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    return links.unionByName(confirmed(rest))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Classes of near-duplicate documents: links are Jaccard similarities of at least 0.75 on five-word shingles.

    Returns one row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and
    kept (doc_id = component_id). Words are split at ASCII white space after A-Z become lower case. A document of fewer
    words has its whole sequence as its one shingle; one without words, or with null text, is linked with nothing.
    Rows that share a doc_id are one node and need the same text. A row without doc_id is linked with nothing, has no
    component_id and is kept. Copies of a word sequence are linked through their smallest id and sketched once.
    Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    profile = materialize(profiles(docs), "near-profiles")
    named = profile.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = named.groupBy("same").agg(F.min("doc_id").alias("first"))
    copies = materialize(named.select("doc_id", "same").join(first, "same").select("doc_id", "first").distinct(), "near-copies")
    singles = copies.where("doc_id = first").select("doc_id")
    heads = materialize(named.join(singles, "doc_id", "left_semi").dropDuplicates(["doc_id"]).drop("same"), "near-heads")
    same = copies.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    classes = components(_links(heads, docs.where("doc_id IS NOT NULL")).unionByName(same))
    component = F.coalesce("component", "doc_id")
    return (
        profile.select("doc_id", "n_shingles")
        .join(classes, "doc_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    )
