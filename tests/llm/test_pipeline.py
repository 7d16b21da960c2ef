"""The pipeline's stages by brute force, on the smallest tables and on odd rows."""

from collections import Counter
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from demandloom.llm import bpe, near_dedup
from demandloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage reads and returns."""
    docs, seen = cp.table(spark, small, "documents"), {}
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, small), f"test-{name}")
        seen[name] = docs, out
        docs = out
    return seen


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in cp.STAGES] == list(stages) and all(out.columns == COLUMNS for _, out in list(stages.values())[:-1])


def test_quality_keeps_good_labels_and_drops_bad_ones(spark, small, stages):
    before, after = stages["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in cp.table(spark, small, "labels").collect()}
    kept = {r["doc_id"] for r in rows(after)}
    known = [r["doc_id"] for r in rows(before) if r["doc_id"] in labels]
    assert sum((i in kept) == labels[i] for i in known) >= 0.95 * len(known)


def test_repeated_lines_go(stages):
    before, after = stages["line_dedup"]
    left = {r["doc_id"]: r["text"] for r in rows(after)}
    seen = set()
    for r in sorted(rows(before), key=lambda r: r["doc_id"]):
        lines, kept = (r["text"] or "").split("\n"), (left.get(r["doc_id"]) or "").split("\n")
        for line in lines:
            if len(line.split()) >= 10 and line in seen:
                assert line not in kept or lines.count(line) > 1
            seen.add(line)
    assert all(r["n_chars"] == len(r["text"]) for r in rows(after) if r["text"])


def test_no_short_line_comes_twice(stages):
    _, after = stages["line_dedup"]
    lines = [x for r in rows(after) for x in (r["text"] or "").split("\n") if x.split()]
    assert len(lines) == len(set(lines))


def test_one_document_of_each_class_stays(stages):
    before, after = stages["near_dedup"]
    sets = {r["doc_id"]: near_dedup.shingles(near_dedup.lowered(r["text"])) for r in rows(before)}
    root = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a] | sets[b]]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {r["doc_id"] for r in rows(after)} == {i for i in sets if root[i] == i}


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixing"]
    texts = {r["doc_id"]: r["text"] for r in rows(before)}
    times = Counter(r["doc_id"] for r in rows(after))
    assert max(times.values()) <= 2 and all(texts[r["doc_id"]] == r["text"] for r in rows(after))
    words = lambda df: sum(len((r["text"] or "").split()) for r in rows(df))
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)


def test_ids_are_those_of_the_texts(stages):
    before, after = stages["byte_level_bpe"]
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = Counter((r["doc_id"], tuple(model.encode_ordinary(r["text"] or "")), sha256((r["text"] or "").encode()).hexdigest()) for r in rows(before))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in rows(after)) == expected


def test_odd_rows_pass_all_stages(spark, small, odd, none):
    for docs in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            docs = materialize(stage(spark, docs, small), "test-odd")
            assert docs.columns == odd.columns
        assert cp.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_clashing_columns_keep_their_values(spark, small):
    """Columns named like the operators' own come through every stage with the values they came with."""
    names = ["kept", "n_lines", "n_removed", "_copy", "_copies", "_stay", "_d", "_x", "score", "features", "taken"]
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{text} own{i} line\nshared line\nlast{i}", "en", "a", 7, *[i * 100 + j for j in range(len(names))]) for i in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in cp.STAGES[1:4]:
        out = materialize(stage(spark, docs, small), f"test-{name}")
        assert out.schema == docs.schema or out.dtypes == docs.dtypes
        for r in out.collect():
            assert [r[n] for n in names] == [r["doc_id"] * 100 + j for j in range(len(names))]
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"].count("shared line") for r in out.collect()}
            assert texts == {1: 1, 2: 0, 3: 0, 4: 0}
        docs = out
