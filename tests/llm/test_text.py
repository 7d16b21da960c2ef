"""Mixing, SimHash, page text and the quality model."""

import random
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest

from demandloom.llm import common, html_text, mixing, quality, queries, simhash
from tests.llm.conftest import texts_of


def water_filled(sizes, weights, share=1.5, cap=2.0):
    """Reshare the excess until no target is above its stop."""
    total, target, stopped = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    left = total
    while left > 1e-9 and len(stopped) < len(sizes):
        free = {s: weights[s] for s in sizes if s not in stopped}
        for s, w in free.items():
            target[s] += left * w / sum(free.values())
        left = 0.0
        for s in free:
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                stopped.add(s)
    return target


def test_mix_targets_and_cuts(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(50), rng.choice(["a", "b", "c", "d", "é", "Z", None, "hot", "hot", "hot"])) for i in range(900)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for r in plan:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["copies"] * r["size"] - r["taken"]) <= r["size"] / 2
    order = sorted(s for s in sizes if s is not None) + [None]
    goal = water_filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        mine = [r for r in plan if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and abs(mine[0]["target"] - goal[s]) < 1e-6
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])


def test_mix_odd(spark, odd, none):
    plan = mixing.mix(odd)
    assert plan.count() == odd.count()
    out = mixing.write_out(odd, plan)
    assert out.columns == odd.columns
    words = {r["doc_id"]: r["copies"] for r in plan.collect() if r["doc_id"] not in (None, 12)}
    kept = out.where("doc_id <> 12").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {i: c for i, c in words.items() if c}
    assert mixing.mix(none).count() == 0 and mixing.write_out(none, mixing.mix(none)).count() == 0


def test_sums_and_successors_over_sparse_ids(spark):
    rng = random.Random(2)
    keys = sorted({rng.choice([rng.randrange(100), rng.randrange(-(2**63), 2**63), 2**40 + rng.randrange(5)]) for _ in range(300)})
    df = spark.createDataFrame([(k, 1 + k % 7) for k in keys], "key long, v long")
    sums = {r["key"]: r["s"] for r in common.before(df, "key", "v", "s").collect()}
    at, expected = 0, {}
    for k in keys:
        expected[k] = at
        at += 1 + k % 7
    assert sums == expected
    assert {r["key"]: r["n"] for r in common.key_above(df, "key", "n").collect()} == dict(zip(keys, [*keys[1:], None]))


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_simhash_query(spark, small):
    got = {r["doc_id"]: r for r in queries.op4_simhash(spark, small).collect()}
    docs = {i: t or "" for i, t in texts_of(small)}
    ids = sorted(docs, reverse=True)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        half = len(docs[i]) // 2
        edited = docs[i][: len(docs[i]) - half] + docs[n][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(docs[i]), sha256(edited.encode()).hexdigest())
        assert got[i]["near_edited"] == pytest.approx(1 - apart(got[i]["fingerprint"], got[i]["edited_fingerprint"]) / 128)
        assert got[i]["near_next"] == pytest.approx(1 - apart(got[i]["fingerprint"], got[n]["fingerprint"]) / 128)
        if i % 100 == 0:
            assert got[i]["n_within"] == sum(apart(got[i]["fingerprint"], g["fingerprint"]) <= 3 for g in got.values())
    likely = [r["near_edited"] > r["near_next"] for r in got.values()]
    assert sum(likely) > 0.95 * len(likely)


def test_votes_by_brute_force(spark):
    """Every bit of every fingerprint, from the weighted signed votes of its terms counted one by one."""
    rng = random.Random(11)
    words = ["a", "Ab", "long-word", "élan", "日本語", "😀", "x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 10, 200)] + ["\t a\n\nB  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: (r["f0"], r["f1"]) for r in simhash.fingerprints(df, ["i"], "t").collect()}
    rows = [(i, a, b) for i, t in enumerate(texts) for w in [t.lower().split() or [""]] for a, b in zip(w, [*w[1:], None])]
    terms = spark.createDataFrame(rows, "i int, one string, two string").selectExpr(
        "i", "one", "two", "xxhash64(one, two) AS h0", "xxhash64(two, one, 1) AS h1"
    )
    votes = {}
    for r in terms.collect():
        weight = len(r["one"]) + len(r["two"] or "")
        tally = votes.setdefault(r["i"], [0] * 128)
        for bit in range(128):
            tally[bit] += weight if r[f"h{bit // 64}"] >> bit % 64 & 1 else -weight
    assert set(found) == set(votes)
    for i, tally in votes.items():
        halves = [sum(1 << b for b in range(64) if tally[64 * h + b] > 0) for h in (0, 1)]
        assert tuple(x % (1 << 64) for x in found[i]) == tuple(halves), texts[i]


@pytest.mark.parametrize("radius,blocks", [(0, 2), (1, 2), (3, 4), (5, 8)])
def test_permuted_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(6)]
    for p in prints[:6]:
        for _ in range(12):
            q = p
            for bit in rng.sample(range(128), rng.randrange(8)):
                q ^= 1 << bit
            prints.append(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = [(signed(p & (1 << 64) - 1), signed(p >> 64)) for p in prints]
    df = spark.createDataFrame(halves, "f0 long, f1 long")
    got = {tuple(r)[:4] for r in simhash.within(df, df, radius, blocks).collect()}
    assert got == {(*a, *b) for a, p in zip(halves, prints) for b, q in zip(halves, prints) if bin(p ^ q).count("1") <= radius}
    with pytest.raises(ValueError):
        simhash.within(df, df, blocks, blocks)


def test_near_prints_are_counted_exactly(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(128) for _ in range(5)} | {0, (1 << 128) - 1}
    for p in list(prints):
        for _ in range(60):
            q = p
            for bit in rng.sample(range(128), rng.randrange(16)):
                q ^= 1 << bit
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = {(signed(p & (1 << 64) - 1), signed(p >> 64)): (p, 1 + p % 3) for p in prints}
    df = spark.createDataFrame([(*h, n) for h, (_, n) in halves.items()], "f0 long, f1 long, n long")
    got = {(r["f0"], r["f1"]): r["near"] for r in simhash.count_near(df, df).collect()}
    assert got == {h: sum(n for q, n in halves.values() if bin(p ^ q).count("1") <= simhash.NEAR) for h, (p, _) in halves.items()}
    with pytest.raises(ValueError):
        simhash.count_near(df, df, 12)


def test_simhash_query_counts_near_copies(spark, small):
    got = queries.op4_simhash(spark, small).collect()
    for r in got:
        near = sum(apart(r["fingerprint"], g["fingerprint"]) <= simhash.NEAR for g in got)
        assert r["n_near"] == (near if r["doc_id"] % 100 == 0 else None)


def test_simhash_odd(spark, odd, none):
    got = simhash.compare_neighbours(odd).collect()
    assert len(got) == odd.count()
    empty = {r["fingerprint"] for r in got if r["doc_id"] in (5, 6, 9)}
    assert empty == {"0" * 32}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (11, 12)}) == 1
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]) if r[0] is not None else (True, 1e30, ""))
    texts = [t for _, t in rows]
    sums = sorted(sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1]))
    assert sorted(r["edited_sha256"] for r in got) == sums
    assert simhash.compare_neighbours(none).count() == 0
    one = odd.where("doc_id = 7")
    assert simhash.compare_neighbours(one).first()["near_next"] == 1.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><a href=/>Site</a></header>
<div role="navigation"><p>Menu entry</p></div><div id="cookie-notice"><p>We use cookies, and say so at some length here.</p></div>%s
<aside><p>Aside of some length, with words.</p></aside><section id="comments"><article><p>A reader says a great many words here.</p></article></section>
<form><p>Sign up</p><select><option>x</option></select></form><footer>&copy; all</footer></body></html>"""
ARTICLE = "<{0}><h1>A  title</h1><p>First &amp; <b>bold</b>&nbsp;words<br>of the text, long enough to be prose.<p>Be.<script>var x='</p>';</script><ul><li>one</li><li><a href=x>two</a></li></ul><div class='share-buttons'>Share</div><p>Last&eacute; words of the text, which is long as well.</p></{0}>"
TEXT = "A title\nFirst & bold words of the text, long enough to be prose.\nBe.\none\ntwo\nLasté words of the text, which is long as well."


@pytest.mark.parametrize("holder", ["article", "main", "div", "section"])
def test_page_text(holder):
    assert html_text.main_text(PAGE % ARTICLE.format(holder)) == TEXT


LONG = "A sentence of the text, which is long enough to be prose and has no links at all."
PROSE = f"<p>{LONG}</p>" * 4


@pytest.mark.parametrize("holder", ["article", "main", "div"])
@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "has-right-sidebar", "site search"])
def test_hints_around_the_text_give_way(holder, wrapper):
    page = f"<body><div class='{wrapper}'><{holder}>{PROSE}<div class='ad'><p>Buy</p></div></{holder}><div class='sidebar'><p>Tags and more</p></div></div></body>"
    assert html_text.main_text(page) == "\n".join([LONG] * 4)


@pytest.mark.parametrize("header", ["entry-header", "post-header"])
def test_headline_in_the_own_header_stays(header):
    page = f"<body><div id='header'><p>Site</p></div><article><div class='{header}'><h1>Headline</h1></div>{PROSE}</article></body>"
    assert html_text.main_text(page) == "\n".join(["Headline", *[LONG] * 4])


def test_sidebar_articles_beside_the_article_are_furniture():
    page = f"<body><article>{PROSE}</article><div class='sidebar'><article><p>{LONG} Teaser.</p></article></div></body>"
    assert html_text.main_text(page) == "\n".join([LONG] * 4)


@pytest.mark.parametrize(
    "page",
    [
        f"<div>{PROSE * 3}</div><div>{PROSE}</div>",
        f"<article>{PROSE * 3}</article><article>{PROSE}</article>",
        f"<div>{PROSE}<ul>{'<li>' + LONG + '</li>'}" + f"<li>{LONG}</li>" * 11 + "</ul></div>",
    ],
)
def test_sibling_holders_and_lists_stay_whole(page):
    html = f"<body><nav><a href=/>Menu</a></nav><div id='wrap'>{page}</div><footer>&copy;</footer></body>"
    assert html_text.main_text(html) == "\n".join([LONG] * 16)


def test_headline_and_introduction_before_a_list_stay():
    html = f"<body><nav>Menu</nav><div><h1>Headline</h1><p>Short introduction.</p><ul>{f'<li>{LONG}</li>' * 20}</ul></div></body>"
    assert html_text.main_text(html) == "\n".join(["Headline", "Short introduction.", *[LONG] * 20])


OPAQUE = """<html><body><div class="q1"><ul>{menu}</ul></div><div class="q2">We use things.</div><div class="q3"><h1>Headline</h1>
<p>{long}</p><p>{long}</p><h2>Between</h2><p>{long}</p><div class="q4">Buy it.</div><p>Be.</p><p>{long}</p><blockquote>Short quote.</blockquote>
<div class="q5">{teasers}</div><ul>{menu}</ul><p>{long}</p><ol><li>one</li><li>two</li></ol></div><div class="q6"><span>All rights</span></div></body></html>"""


def opaque_page():
    menu = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(6))
    teasers = "".join(f"<div class='q7'><a href=/{i}>A teaser with a fairly long title {i}</a></div>" for i in range(4))
    return OPAQUE.format(menu=menu, teasers=teasers, long=LONG)


def test_ratios_alone_choose_on_a_page_with_opaque_names():
    """No article, no telling class: link lists, notices, adverts and teasers go, headings and short prose stay."""
    text = ["Headline", LONG, LONG, "Between", LONG, "Be.", LONG, "Short quote.", LONG, "one", "two"]
    assert html_text.main_text(opaque_page()) == "\n".join(text)


def test_the_cluster_decides(monkeypatch):
    """With every block in the cluster, the page around the text comes along."""
    right = html_text.main_text(opaque_page())
    monkeypatch.setattr(html_text, "clustered", lambda blocks: (np.ones(len(blocks)), np.ones(len(blocks)), 0.0))
    assert html_text.main_text(opaque_page()) != right


def test_link_lists_inside_an_article_go():
    links = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(6))
    page = f"<body><article><h1>Headline</h1><ul>{links}</ul>{PROSE}<div class='z'><p>Be.</p></div></article></body>"
    assert html_text.main_text(page) == "\n".join(["Headline", *[LONG] * 4, "Be."])


def test_short_blocks_of_one_kind_stay_with_the_long_ones():
    page = "<body>" + "".join(f"<div class='k'>{t}</div>" for t in [LONG, LONG, "No.", "Yes.", "No.", "Yes.", "No.", "Yes.", LONG]) + "</body>"
    assert html_text.main_text(page).count("Yes.") == 3


@pytest.mark.parametrize("tag", ["select", "video", "iframe", "object", "button", "svg", "noscript", "template"])
def test_unclosed_silent_elements_silence_nothing(tag):
    html = f"<body><article><p>{LONG}</p><{tag}><p>{LONG}</p></article></body>"
    assert html_text.main_text(html) == "\n".join([LONG] * 2)
    closed = f"<body><article><p>{LONG}</p><{tag}>quiet</{tag}><p>{LONG}</p></article></body>"
    assert html_text.main_text(closed) == "\n".join([LONG] * 2)
    assert html_text.main_text("<p>words</p><script>var x = 1;") == "words"


@pytest.mark.parametrize("part", ["<div>w ", "<div class='ad'>w ", "<article><p>w ", "<ul><li>w ", "<p>w</b></div></section>", "<select>w "])
def test_nesting_is_linear(part):
    start = time.perf_counter()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 60


def test_page_text_odd(spark):
    rows = [
        (1, "u", None), (1, "u", ""), (2, None, "<nav>only a menu</nav>"), (3, "u", "plain text"), (4, "u", "<article><p>cut off &am"),
        (5, "u", "<![weird [x]]> text <p>&lt;b&gt;"), (6, "u", "<article>" + "<p>long words</p>" * 20000), (None, "u", "</p></div><p>x</article>y"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()]
    texts = ["", "", "", "plain text", "cut off &am", "<![weird [x]]> text\n<b>", "\n".join(["long words"] * 20000), "x\ny"]
    assert got == [(i, u, t, len(t)) for (i, u, _), t in zip(rows, texts)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_page_query(spark, small):
    """The synthetic pages hold their text in one article."""
    got = queries.op6_html_text(spark, small).collect()
    assert len(got) == len({r["page_id"] for r in got}) and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    assert not any("track(" in r["text"] or "©" in r["text"] for r in got)


def test_held_out_accuracy(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    got = queries.op10_quality(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (7, 0), (15, 1), (16, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and len({r["score"] for r in got if r["doc_id"] in (5, 6, 9)}) == 1
    assert quality.classify(none, labels).count() == 0 and quality.keep_good(odd, labels, threshold=0.0).columns == odd.columns
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_one_round_by_hand():
    """One feature, one round: the leaf values of Newton steps and the scores that follow from them."""
    x = np.array([[0.0]] * 6 + [[1.0]] * 4)
    y = np.array([0.0] * 5 + [1.0] + [1.0] * 3 + [0.0])
    model = quality.fit(x, y, rounds=1, rate=0.5, depth=1, bins=3, most_pairs=0, smooth=1.0)
    share = 5 / 12  # four of ten are 1, one more of each label
    low = 0.5 * (1 - 6 * share) / (6 * share * (1 - share) + 1)
    high = 0.5 * (3 - 4 * share) / (4 * share * (1 - share) + 1)
    start = np.log(share / (1 - share))
    expected = 1 / (1 + np.exp(-(start + np.array([low, high]))))
    assert model.intercept == pytest.approx(start) and not model.pairs
    assert model.score(np.array([[0.0], [1.0]])) == pytest.approx(expected)


def test_scores_add_table_entries():
    model = quality.Additive([np.array([1.0, 2.0]), np.array([0.5])], [np.array([1.0]), np.array([0.5])], 0.25)
    model.single = [np.array([-1.0, 0.0, 2.0]), np.array([0.5, -0.5])]
    model.pairs = {(0, 1): np.array([[0.1, 0.2], [0.3, 0.4]])}
    x = np.array([[0.0, 0.0], [1.0, 0.5], [5.0, 0.4]])
    sums = np.array([0.25 - 1 + 0.5 + 0.1, 0.25 + 0 - 0.5 + 0.4, 0.25 + 2 + 0.5 + 0.3])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-sums)))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0) ^ (x[:, 8] > 0)).astype(float)
    model = quality.fit(x[:4000], y[:4000], rounds=50)
    assert (3, 8) in model.pairs and ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.8
