"""Near, substring, exact and line deduplication on odd inputs and against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from demandloom.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from demandloom.session import scratch_path


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_near_odd(spark, odd, none):
    got = by_id(near_dedup.near_dedup(odd))
    assert len(got) == odd.count()
    at = {r["doc_id"]: r for r in got}
    assert (at[7]["n_shingles"], at[7]["component_id"], at[7]["kept"]) == (3, 3, False)
    assert at[3]["kept"] and at[5]["kept"] and at[6]["n_shingles"] == 0 and at[9]["component_id"] == 9
    assert at[11]["n_shingles"] == 1 and [r["component_id"] for r in got if r["doc_id"] == 12] == [11, 11]
    assert at[None]["component_id"] is None and at[None]["kept"] and at[13]["component_id"] == 13
    assert near_dedup.near_dedup(none).count() == 0


def test_near_edge_of_the_threshold(spark):
    """Shared and own shingles at 3 of 4 are linked, just below they aren't."""
    base = [f"a{i}" for i in range(34)]  # 30 shingles
    linked = base[:30] + ["x", "y", "z", "u"]  # 26 of 34 shared
    apart = base[:29] + ["p", "q", "r", "s", "t"]  # 25 of 35
    rows = [(1, " ".join(base)), (2, " ".join(linked)), (3, " ".join(apart))]
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    truth = near_dedup.shingles
    sets = [truth(near_dedup.lowered(t)) for _, t in rows]
    expected = [100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets]
    assert [r["component_id"] == 1 for r in got] == expected == [True, True, False]


def test_near_chains(spark, monkeypatch):
    """Drifting copies are linked only to their neighbours, which leaders of large classes alone don't find."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for chain in range(4):
        text = [rng.choice(words) for _ in range(80)]
        for step in range(12):
            rows.append((100 * chain + step, " ".join(text)))
            text = text[2:] + [rng.choice(words) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: near_dedup.shingles(near_dedup.lowered(t)) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    plain = {r["doc_id"]: r["component_id"] for r in by_id(near_dedup.near_dedup(docs))}
    assert plain == root
    profile = near_dedup.profiles(docs).drop("same").cache()
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    links = near_dedup._links(profile, docs)
    split = {r["doc_id"]: r["component"] for r in near_dedup.components(links).collect()}
    assert {i: split.get(i, i) for i in root} == root


def test_near_crowd_below_the_threshold(spark, monkeypatch):
    """Private edits of one text lie around the threshold; few of their pairs become rows, and no link is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        text = list(base)
        for at in rng.sample(range(3, 147, 6), rng.choice([1, 2, 3, 4, 5, 5, 5, 6, 6])):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    sets = {i: near_dedup.shingles(near_dedup.lowered(t)) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert 40 < sum(root[i] == i for i in root) < 130
    made, likely = [], near_dedup._likely
    monkeypatch.setattr(near_dedup, "_likely", lambda pairs, sketches: made.append(pairs.count()) or likely(pairs, sketches))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in by_id(near_dedup.near_dedup(docs))} == root
    assert made[-1] < 10 * len(rows)


def test_leaders_are_met_from_outside_the_largest_class(spark):
    """Members of the largest class aren't paired with each representative of the others."""
    member = spark.createDataFrame([(1, i, max(i - 50, 0), 100) for i in range(56)], "key long, doc_id long, class long, n long")
    pairs = near_dedup._led(member, 1).collect()
    assert {r["m"] for r in pairs} == {51, 52, 53, 54, 55}
    assert sum(r["shared"] for r in pairs) == 5 * 5 and all({r["a"], r["b"]} - {r["m"]} for r in pairs)
    assert {r["m"] for r in pairs if r["a"] <= 50} == {51, 52, 53, 54, 55}


@pytest.mark.parametrize("size", [1, 100, 150, 4000])
def test_odd_sketches_never_tell_more_than_the_difference(spark, size):
    rng = np.random.default_rng(size)
    pool = rng.integers(0, 1 << 63, 2 * size + 1).astype(np.uint64)
    for own in (0, size // 10, size // 3, size):
        a, b = pool[:size], pool[own : size + own + size // 4]
        x, y = sorted((near_dedup.odd_sketch(s) for s in (a, b)), key=len)
        assert len(y) in (len(x), 2 * len(x))
        pair = spark.createDataFrame([(y.tolist(), x.tolist(), len(a), len(b))], "l_odd array<bigint>, r_odd array<bigint>, l_n int, r_n int")
        y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
        differ, truth = sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)), len(set(a.tolist()) ^ set(b.tolist()))
        assert truth / 2 <= differ <= truth
        assert pair.select(near_dedup._near("l", "r")).first()[0] == (175 * differ <= 25 * (len(a) + len(b)))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["doc_id"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}
    assert near_dedup.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.5, 0.75, 0.95])
def test_sketch_estimates_and_merges(share):
    rng = np.random.default_rng(int(100 * share))
    n = 1500
    common = int(2 * n * share / (1 + share))
    pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
    a, b = pool[:n], pool[n - common : 2 * n - common]
    sa, sb = near_dedup.registers(a), near_dedup.registers(b)
    size = np.array([float(n)])
    assert abs(near_dedup.estimate(sa[None], sb[None], size, size)[0] - common / (2 * n - common)) < 0.12
    assert (near_dedup.merged(sa, sb) == near_dedup.registers(pool[: 2 * n - common])).all()


def brute_substrings(rows, length):
    seen, out = {}, {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            seen[w] = min(seen.get(w, i), i)
    for i, text in rows:
        words = (text or "").encode().split()
        gone = {p for s in range(len(words) - length + 1) if seen[tuple(words[s : s + length])] < i for p in range(s, s + length)}
        out[i] = b" ".join(w for p, w in enumerate(words) if p not in gone).decode()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_by_brute_force(spark, seed):
    """Passages spliced into each other, with few distinct words, so that extents of one anchor differ."""
    rng = random.Random(seed)
    parts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(6)) for w in rng.choice(parts))) for i in range(60)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=20, k=4)
    assert {r["doc_id"]: r["kept"] for r in by_id(got)} == brute_substrings(rows, 20)


def test_substrings_odd(spark, odd, none):
    got = by_id(substring_dedup.substring_dedup(odd))
    at = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert (at[13]["n_words"], at[13]["n_removed"]) == (60000, 0)
    assert (at[14]["n_words"], at[14]["n_removed"], at[14]["kept"]) == (30000, 30000, "")
    assert at[5]["n_words"] == at[6]["n_words"] == at[9]["n_words"] == 0 and at[None]["n_removed"] == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_exact_odd(spark, odd, none):
    path = scratch_path(spark, "odd")
    odd.coalesce(1).write.parquet(path)
    got = by_id(exact_dedup.exact_dedup(spark, path))
    at = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert at[7]["keep_id"] == 7 and at[None]["keep_id"] == 7 and not at[None]["kept"]
    assert at[3]["group_size"] == 1 and at[6]["keep_id"] == 5 and at[9]["keep_id"] == 9
    assert sorted(r["kept"] for r in got if r["doc_id"] == 12) == [False, False] and at[11]["kept"]
    assert at[9]["text_sha256"] == sha256(b" ").hexdigest()
    empty = scratch_path(spark, "odd")
    none.write.parquet(empty)
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_exact_state_goes_on(spark):
    """New files meet the state of a former call; the state is kept between them."""
    path, folder = scratch_path(spark, "docs"), scratch_path(spark, "state")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    write([(5, "a  b"), (6, "c")])
    assert {r["doc_id"]: r["keep_id"] for r in by_id(exact_dedup.exact_dedup(spark, path, folder=folder))} == {5: 5, 6: 6}
    write([(2, "a\tb"), (8, "c"), (9, "d")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in by_id(exact_dedup.exact_dedup(spark, path, folder=folder, files_per_batch=1))}
    assert got == {5: (2, 2), 2: (2, 2), 6: (6, 2), 8: (6, 2), 9: (9, 1)}


def test_exact_tells_equal_digests_apart(spark, monkeypatch):
    """With a digest that only sees the length, full bytes decide."""
    path = scratch_path(spark, "docs")
    spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x")], "doc_id long, text string").coalesce(1).write.parquet(path)
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(exact_dedup.F.length(c).cast("string"), n))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in by_id(exact_dedup.exact_dedup(spark, path))}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_lines_odd(spark, odd, none):
    found = line_dedup.line_dedup(odd)
    got = by_id(found)
    at = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and set(odd.columns) <= set(found.columns)
    assert at[15]["kept"] == "line one of this text has ten words or more\nélan 日本語 😀\n" and at[15]["n_removed"] == 1
    assert at[16]["kept"] == "other" and at[5]["n_lines"] == at[6]["n_lines"] == 0 and at[5]["kept"] == ""
    assert at[9]["n_lines"] == 2 and at[None]["n_removed"] == 0
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_lines_by_brute_force(spark, seed):
    """All runs of all lengths, over few distinct lines and blank ones."""
    rng = random.Random(seed)
    pool = ["a b c", "d", "", "e f g h", "i j", "k l m n o p q r s t u"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {j}" for j in range(rng.randrange(12)))) for i in range(40)]
    docs = {i: t.split("\n") for i, t in rows}
    first, runs = {}, []
    for i in sorted(docs):
        lines = docs[i]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= 10:
                    first.setdefault(tuple(lines[a:b]), (i, a))
                    runs.append((i, a, b))
    gone = {(i, p) for i, a, b in runs if first[tuple(docs[i][a:b])] < (i, a) for p in range(a, b)}
    expected = {i: "\n".join(x for p, x in enumerate(lines) if (i, p) not in gone) for i, lines in docs.items()}
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert {r["doc_id"]: r["kept"] for r in by_id(got)} == expected


@pytest.mark.parametrize("seed", range(2))
def test_short_lines_by_brute_force(spark, seed):
    """With a floor of one word the later copies of all lines but blank ones go, and blank ones inside repeated runs."""
    rng = random.Random(10 + seed)
    pool = ["a b c", "d", "", "e f g h", " ", "k l m n o p q r s t u"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(10)))) for i in range(40)]
    docs = {i: t.split("\n") for i, t in rows}
    first, runs = {}, []
    for i in sorted(docs):
        for a in range(len(docs[i])):
            for b in range(a + 1, len(docs[i]) + 1):
                if any(x.split() for x in docs[i][a:b]):
                    first.setdefault(tuple(docs[i][a:b]), (i, a))
                    runs.append((i, a, b))
    gone = {(i, p) for i, a, b in runs if first[tuple(docs[i][a:b])] < (i, a) for p in range(a, b)}
    expected = {i: "\n".join(x for p, x in enumerate(lines) if (i, p) not in gone) for i, lines in docs.items()}
    got = {r["doc_id"]: r["kept"] for r in by_id(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == expected
    left = [x for t in got.values() for x in t.split("\n") if x.split()]
    assert len(left) == len(set(left))


def test_suffix_ranks_order_all_suffixes(spark):
    rows = [(1, "a\nb\na\nb\nc"), (2, "b\na\nb\na"), (3, "c\nc\nz"), (4, "a\nb")]
    got = line_dedup.suffix_ranks(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    final = {(r["doc_id"], r["at"]): r["ranks"][-1] for r in got}
    single = {(r["doc_id"], r["at"]): r["ranks"][0] for r in got}

    def suffix(doc, at):
        out = []
        while (doc, at) in single:
            out.append(single[doc, at])
            at += 1
        return out

    order = sorted(final, key=lambda p: suffix(*p))
    smaller = {p: 1 + sum(suffix(*q) < suffix(*p) for q in final) for p in order}
    assert final == smaller
