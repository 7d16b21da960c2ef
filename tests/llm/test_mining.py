"""Hard negatives, the filter audit and decontamination against brute force, and their odd inputs."""

import datetime as dt
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm import decontamination, filter_audit, negatives
from tests.llm.conftest import documents

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(n, T.DateType()) for n in ("block", "place", "score", "rank", "slot", "vector", "low")]
)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[dt.date(2020, 1, 1)] * 7) for r in rows], VECTORS)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    points = centres[rng.integers(0, 12, n)] * rng.uniform(0.3, 2, (n, 1)) + rng.normal(scale=0.15, size=(n, d))
    return np.floor(points * 64)


def test_cover_tree_covers_nests_and_separates():
    points = clustered(3000, 6, 1)
    order, nodes = negatives.cover(points)
    assert sorted(order) == list(range(3000))
    for i, (first, end, parent, radius) in enumerate(nodes):
        away = np.linalg.norm(points[order[first:end]] - points[order[first]], axis=1)
        assert away.max() == pytest.approx(radius)
        children = [n for n in nodes if n[2] == i]
        if children:
            assert sum(n[1] - n[0] for n in children) == end - first and max(n[3] for n in children) <= radius * (1 + 1e-9)
            assert min(n[0] for n in children) == first  # the centre is its own first child
            assert len({tuple(points[order[n[0]]]) for n in children}) == len(children)
    assert len(nodes) > 20
    assert [n[:2] for n in negatives.cover(np.ones((500, 3)))[1]] == [(0, 500)]


def wanted_rows(rows, positives, least, low, high, is_anchor):
    """Scores of all pairs in whole numbers."""
    dims = max(len(v) for _, v, _ in rows)
    rows = {i: (label, [int(x) for x in v] + [0] * (dims - len(v))) for i, v, label in rows}
    out = []
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in rows.items() if i != a))
        near = [(i, -s) for s, i in scores if rows[i][0] == label][:positives]
        for p, ps in near:
            fit = [(i, -s) for s, i in scores if rows[i][0] != label and low * ps <= -100 * s <= high * ps][:least]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [97, 8192])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = random.Random(3)
    points = clustered(300, 4, 2)
    points[200:230] = points[5]  # many equal vectors: ties by id
    rows = [(i * 5, points[i].tolist(), rng.randrange(3)) for i in range(300)]
    rows.append((10001, [1e17, -1e17, 3.0, 1.0], 1))  # beyond double precision
    rows.append((10050, [2e17], 2))  # shorter, and alone with its huge score
    frame = vectors(spark, rows).withColumnRenamed("vector", "other").withColumnRenamed("embedding", "vector")
    found = negatives.hard_negatives(frame.select("vec_id", "label", "vector"), F.col("vec_id") % 25 == 0, positives=4, negatives=2, low=40, high=90)
    got = sorted(tuple(r) for r in found.collect())
    want = wanted_rows(rows, 4, 2, 40, 90, lambda i: i % 25 == 0)
    clip = (1 << 63) - 1
    assert [r for r in got if abs(r[4]) < clip] == [r for r in want if abs(r[4]) < clip]
    assert len(got) > 100


def test_tree_skips_nodes_outside_the_windows(spark):
    points = np.concatenate([clustered(4000, 4, 5), np.full((4000, 4), -500.0) + clustered(4000, 4, 6) % 7])
    order, nodes = negatives.cover(np.column_stack([points, np.sqrt((points**2).sum(1).max() - (points**2).sum(1))]))
    scored = []

    class Counted(negatives.Tree):
        def __init__(self):
            self.vectors, self.ids, self.labels = points[order], order, np.zeros(len(order), int)
            self.norm, self.largest = np.sqrt((points**2).sum(1).max()), np.abs(points).max()
            self.first, self.end, self.parent, self.radius = (np.array(c) for c in zip(*nodes))
            self.children = [[i for i, n in enumerate(nodes) if n[2] == j] for j in range(len(nodes))]

        def products(self, anchors, rows):
            scored.append(rows.stop - rows.start)
            return super().products(anchors, rows)

    asked = points[:1]
    best = np.sort(asked @ points[1:].T)[0, ::-1][:3]
    wanted = negatives.Wanted(np.array([0]), np.array([0]), np.array([[-negatives.MOST]]), np.array([[negatives.MOST]]), 3, True)
    Counted().search(asked, wanted)
    assert wanted.scores[0, 0].tolist() == best.tolist() and sum(scored) < 3000


def test_hard_negatives_of_odd_rows(spark):
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 5.0], 2), (53, [None, 1.0], 2), (54, [float("nan"), 1.0], 2), (55, [float("inf"), 1.0], 2)]
    rows += [(56, None, 2), (57, [0.8, 0.0], None), (None, [0.8, 0.0], 2), (52, [0.75, 5.0], 2), (100, [], 3), (150, [-1.0, 0.0], 1)]
    found = negatives.hard_negatives(negatives.whole_numbers(vectors(spark, rows)), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in found.collect()] == [(50, 51, 1, 52, 65536, 49152)]
    none = negatives.hard_negatives(negatives.whole_numbers(vectors(spark, [])), F.col("vec_id") % 50 == 0)
    assert none.collect() == [] and none.columns == found.columns


def test_positional_counts():
    words = np.random.default_rng(0).integers(0, 1 << 32, 12345, dtype=np.uint32)
    for n in (0, 1, 2, 3, 4, 100, 12345):
        assert filter_audit.positional_counts(words[:n]).tolist() == [int((words[:n] >> np.uint32(i) & np.uint32(1)).sum()) for i in range(32)]
    assert filter_audit.truth_word(0) == (1 << 32) - 1 and filter_audit.truth_word(31) == 1


def audit_by_hand(docs, labels):
    """Each order applied to the documents."""
    docs = [(i, part or "", text or "") for i, part, text in docs]
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text] = min(i, first.get(text, i))

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield len(words) < 200
        yield 100 * len(set(words)) < 50 * len(words)
        yield 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
        yield bool(re.search(r"[#$%&*|]", text))
        yield i is not None and text in first and first[text] < i

    rows = [(part, *(labels.get(i, (0, 0))), {f for f, x in zip("ABCDE", fails(i, text)) if x}) for i, part, text in docs]
    out, sums = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[3]]
                left = [r for r in left if name not in r[3]]
                sums[part, name] = sums.get((part, name), 0) + len(gone)
                late = sum(name in r[3] for r in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), late, sum(r[3] == {name} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return sorted((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [long, long + " #", long.upper(), "a " * 300, "A" * 40, "", None, "a\x0bb c % é", long + " X" * 90]
    rows = [(i, rng.choice(pool), rng.choice(["en", "", None, "日本"]), "s") for i in range(120)] + [(None, long, "en", "s"), (7, long, "en", "s")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)]
    frame = spark.createDataFrame([*labels, (1, None, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    known = {i: (q, t) for i, q, t in labels} | {1: (1, 1)}
    found = filter_audit.audit(documents(spark, rows).withColumn("part", F.lit(3)), frame)
    assert sorted(tuple(r) for r in found.collect()) == audit_by_hand([(r[0], r[2], r[1]) for r in rows], known)
    assert filter_audit.audit(documents(spark, []), frame).collect() == []


def test_audit_of_the_odd_table(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in filter_audit.audit(odd, labels).collect()) == audit_by_hand(rows, {})


def hits_by_hand(docs, items, length=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = []
    for i, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, body in items:
            bs = words(body)
            n = min(length, len(bs))
            runs = {tuple(bs[j : j + n]) for j in range(len(bs) - n + 1)} if bs and item is not None else set()
            for j in range(len(ws) - n + 1 if runs else 0):
                if tuple(ws[j : j + n]) in runs:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
        out.append((i, len(ws), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def found_hits(docs, items):
    got = decontamination.decontaminate(docs, items).collect()
    for r in got:
        assert len({w for s in r.spans for w in range(s.lo, s.hi)}) == r.n_hit
    return sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got], key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "item_id long, text string, key int, class int")


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_hits_equal_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(decontamination, "WORDS", 60)
    monkeypatch.setattr(decontamination, "SLICE", 2)
    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    # Few words, so that windows repeat, overlap and tie; items of every length below a window.
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25, 60]) + (4 if letters != "ab" else 0))) for i in range(60)] + [(3, text(30)), (None, text(12)), (70, ""), (71, None)]
    docs = [(i, text(rng.randrange(0, 90)), "en", "s") for i in range(60)]
    docs += [(100 + i, text(20) + ", " + (items[i][1] or "").upper() + "! " + text(5), "en", "s") for i in range(60)]
    assert found_hits(documents(spark, docs), benchmark(spark, items)) == hits_by_hand([d[:2] for d in docs], items)


def test_hits_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, " ".join(f"W{i}" for i in range(40000, 41000))), (2, "élan 日本語 😀"), (2, "short-text"), (10, "x"), (9, "\x00X\x7f"), (11, "w59999")]
    got = found_hits(odd, benchmark(spark, items))
    assert got == hits_by_hand(rows, items) and sum(r[2] > 0 for r in got) == 7
    assert all(r[2:] == (0, "") for r in found_hits(odd, benchmark(spark, [])))


def test_hits_of_an_empty_table(spark, none):
    assert found_hits(none, benchmark(spark, [(1, "a b c")])) == []


def test_every_window_is_found_by_its_fingerprint():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    document = np.zeros(500, np.int8)
    for length in range(1, 15):
        own = set(decontamination.fingerprints(words, document, length)[0].tolist())
        for start in range(0, 500 - length, 17):
            window = words[start : start + length]
            assert set(decontamination.fingerprints(window, document[:length], length)[0].tolist()) <= own
