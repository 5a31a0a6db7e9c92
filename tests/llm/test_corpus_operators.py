"""Nearest neighbours, line and substring dedup, the Jaccard join and the pipeline."""

import random

import messy
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkclin.llm import hashing_search, jaccard, line_templates, substrings
from sparkclin.llm.components import connected_components


# ------------------------------------------------------------------ nearest neighbours
def test_search_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in e.collect())
    ids, x = np.array([a for a, _ in rows]), np.array([b for _, b in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in hashing_search.nearest(e, F.expr("id % 50 = 0"), block=128).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        mine = got[ids[i]]
        assert sorted(mine) == [1, 2, 3, 4, 5] and [v for _, v in (mine[k] for k in range(1, 6))] == sorted(
            (v for _, v in mine.values()), reverse=True)
        for v, score in mine.values():
            assert score == pytest.approx(float(s[np.flatnonzero(ids == v)[0]]), abs=1e-12)
        hit += len({v for v, _ in mine.values()} & set(want))
    assert hit >= 0.9 * 5 * len(got)


def test_search_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, 1.0, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [0.5, 0.0]), (100, [0.0, 0.0]), (None, [1.0, 0.0])]
    d = spark.createDataFrame([(a, b, "q", 1) for a, b in rows], "vec_id long, embedding array<double>, id string, rank int")
    got = [tuple(r)[:3] for r in hashing_search.nearest(d, F.expr("id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)]  # ties to the smaller id
    assert {q for q, _, _ in got} == {0, 50} and len(got) == 6
    assert hashing_search.nearest(d.limit(0), F.expr("id % 50 = 0")).count() == 0


def test_probing_holds_the_whole_radius():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    code[250:] = code[:250] ^ (1 << rng.integers(0, 16, (250, 4))).astype(np.uint16)
    index = hashing_search._Index(code)
    for r in (0, 3, 7, 20, 40):
        for q in code[::50]:
            assert index.probe(q, r).tolist() == np.flatnonzero(hashing_search._hamming(code, q) <= r).tolist()


# ------------------------------------------------------------------ line dedup
def test_line_templates(spark):
    openings = ["Zebras walk at night", "Rivers bend to the south quite often", "Nobody knew why it rained"]
    texts = [f"{o}\nPage {i} of 12 printed by user{i} today\n{o.upper()} ends" for i, o in enumerate(openings)]
    texts += ["Page 9 of 12 printed by user7 today\nPage 8 of 12 printed by user7 today", "alone line that never comes again", None, "", "\n",
              "x y z\nx y z\nx y z"]
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(messy.table(spark, texts), min_docs=3).collect()}
    assert rows[0].text == texts[0] and rows[0].n_dropped == 0  # the first occurrence stays
    assert "Page" not in rows[1].text and rows[1].text == f"{openings[1]}\n{openings[1].upper()} ends"
    assert rows[3].text == "" and rows[3].n_dropped == 2
    assert rows[4].text == texts[4] and rows[5].text is None and rows[5].n_lines == 0
    assert rows[6].text == "" and rows[6].n_lines == 1 and rows[7].text == "\n"
    assert rows[8].text == texts[8]  # repeated within one document only
    assert rows[1].keys == "x" and rows[1].lang == "en"
    assert line_templates.drop_recurring_lines(messy.empty(spark)).count() == 0
    awkward = line_templates.drop_recurring_lines(messy.table(spark, messy.AWKWARD + messy.AWKWARD)).count()
    assert awkward == 2 * len(messy.AWKWARD)


def test_variable_words_are_generalised(spark):
    texts = [f"Posted in the archive by {n} on behalf of the team" for n in ("Ann", "Bob", "Cid", "Dot")]
    found = line_templates.recurring_lines(messy.table(spark, texts), min_docs=3).collect()
    assert {r.doc_id for r in found} == {1, 2, 3}
    assert {r.template for r in found} == {"Posted in the archive by <*> on behalf of the team"}


@pytest.mark.parametrize("n", [100, 10_000])
def test_line_stage_generalises_frequent_values_at_every_size(spark, sf, n):
    import corpus_pipeline as C
    rng = random.Random(1)
    name = lambda p, k: p + "".join(chr(97 + int(c)) for c in str(k))
    texts = [f"Posted in section {name('s', rng.randrange(400))} by author {name('a', rng.randrange(1000))}" for _ in range(n)]
    own = [f"Entirely own line {name('q', i)} {name('r', 7 * i)} {name('t', 3 * i)} {name('u', i + 9)}" for i in range(30)]
    rows = {r.doc_id: r.text for r in C.lines(spark, messy.table(spark, texts + own), sf).collect()}
    assert [i for i in range(n) if rows[i]] == [0] and rows[0] == texts[0]
    assert all(rows[n + i] == t for i, t in enumerate(own))


def test_line_stage_drops_short_lines(spark, sf):
    import corpus_pipeline as C
    texts = [f"Own opening {w} of text\n\nRead more\nAdvertisement\n{w}" for w in ("Ann", "Bob", "Cid", "Dot")] + ["Read more", "Dot Dot", "\n"]
    rows = {r.doc_id: r.text for r in C.lines(spark, messy.table(spark, texts), sf).collect()}
    assert rows[0] == texts[0] and rows[4] == "" and rows[5] == texts[5] and rows[6] == "\n"
    assert all(rows[i].split("\n")[-2:] == ["", texts[i].split("\n")[-1]] for i in (1, 2, 3))  # the blank line stays


def test_line_stage_generalises_beside_a_value_of_most_lines(spark):
    texts = [f"Filed under the heading {'News' if i % 5 else 'abcdefgh'[i // 5 % 8]} of our great old paper" for i in range(400)]
    found = line_templates.recurring_lines(messy.table(spark, texts), rungs=True).select("template").distinct().collect()
    assert {r.template for r in found} <= {f"Filed under the heading {v} of our great old paper" for v in ("News", "<*>")}


# ------------------------------------------------------------------ n-gram Jaccard
def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        stack = [n] if n not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_band_choice_meets_its_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= jaccard.MAX_HASHES


def _near_texts():
    rng = random.Random(7)
    base = [f"k{rng.randrange(500)}" for _ in range(120)]
    out = [" ".join(base)] * 3
    for i in range(60):  # a group of near copies, with links of every strength
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    return out + messy.AWKWARD + ["one two", "a b c d e", "a b c d e", "a b c d f"]


def test_a_verified_pair_without_a_common_band_is_a_link():
    cell = pa.table({"rep": [1, 2], "copies": [1, 1], "chunk": [0, 0], "lo": [0, 0], "hi": [0, 0],
                     "grams": [list(range(10)), list(range(9))], "bands": [[1, 2], [3, 4]]})
    assert jaccard._compare(0.8)(cell).column("links").to_pylist() == [1, 1]


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 9)  # many cells
    docs = list(enumerate(_near_texts()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(messy.table(spark, [t for _, t in docs])).collect()}
    assert got == messy.near_classes(docs)
    assert jaccard.near_duplicates(messy.empty(spark)).count() == 0


def test_jaccard_join_of_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = jaccard.op4_ngram_jaccard(spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == messy.near_classes(docs)


def test_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(d).collect()), key=str)
    assert rows == sorted([(None, 3, 2), (None, 3, 2), (3, 3, 2), (None, None, 0)], key=str)


# ------------------------------------------------------------------ substring dedup
def _overlapping():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dé", "e"]) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    line = " ".join(f"w{i}" for i in range(25))
    return texts + ["x " * 100, line, "q " + line + " z", line, "  a\tb\n" * 30] + messy.AWKWARD


@pytest.mark.parametrize("window,shortest", [(20, 5), (6, 2), (4, 4), (7, 3)])
def test_substring_dedup_against_brute_force(spark, window, shortest):
    texts = _overlapping()
    got = substrings.repeated_word_counts(messy.table(spark, texts), window, shortest, with_text=True).collect()
    want = messy.removed_words(list(enumerate(texts)), window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert all(len(messy.words(r.kept)) == r.n_words - r.n_removed for r in got)


def test_substring_dedup_of_a_whole_table_and_of_nothing(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op6_substring_dedup(spark, sf).collect()}
    assert got == messy.removed_words(docs, 20)
    assert substrings.repeated_word_counts(messy.empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "n " * 30), (1, "n " * 25), (None, None)], "doc_id long, text string")
    rows = substrings.repeated_word_counts(nulls).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(0, 0), (25, 25), (30, 0)] or sorted(
        (r.n_words, r.n_removed) for r in rows) == [(0, 0), (25, 24), (30, 0)]


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_take_effect(spark, sf, tmp_path):
    import corpus_pipeline as C
    from sparkclin.llm import pii
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            assert docs.columns == C.COLUMNS
        kept[name] = docs
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {d for d, (c, _) in messy.near_classes(rows).items() if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "pii":
            assert pii.find_base(docs).where(F.size("base") > 0).count() == 0
    assert kept["quality_rules"].count() < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert docs.select("doc_id").distinct().count() == kept["pii"].count()


def test_pipeline_on_awkward_rows(spark, sf):
    import corpus_pipeline as C
    d = messy.table(spark, messy.AWKWARD)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == C.COLUMNS and out.count() <= len(messy.AWKWARD)
        assert stage(spark, messy.empty(spark), sf).count() == 0
    assert C.STAGES[-1][1](spark, messy.empty(spark), sf).count() == 0
