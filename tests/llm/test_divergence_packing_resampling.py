"""Source divergence, best-two-fit packing and importance resampling, each against a brute-force version."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import messy
import numpy as np
import public_tokenizers
import pytest

from sparkclin.llm import best_two_fit, divergence, resampling
from sparkclin.llm.best_two_fit import WordBpe
from sparkclin.llm.words import text_buffers

WORDS = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ best-two-fit
def _tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "a  b", "it's  DON'T'll 12 34 ,,, !", "a b　c", "é ́x", "<|endoftext|> x", "İstanbul ΣΑΣ",
       "日本 語 x", "\x1c a \x85 b", "“q” — z\nnext\tline", "👩‍👩‍👧 x"]


def test_word_ids_equal_the_tokenizers_library(spark, sf):
    import pyarrow as pa
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    data, offsets = text_buffers(pa.array(texts))
    got = WordBpe(WORDS, most=50).encode(data, offsets)
    want = _tokenizer().encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def _first_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        for i, r in enumerate(room):
            if s <= r:
                room[i] -= s
                break
        else:
            room.append(capacity - s)
    return len(room)


def test_two_replace_the_smallest():
    # Greedy fills 60 + 30; 30 makes room for 40, which 21 and 19 fill and no single piece does.
    sizes = np.array([60, 30, 21, 19, 25])
    bins, offsets = best_two_fit.best_two_fit(sizes, 100)
    assert bins.tolist() == [0, 1, 0, 0, 1]
    assert offsets.tolist() == [0, 0, 60, 81, 30]


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_piece_once(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.randint(1, rng.choice((20, 200, 1000))) for _ in range(rng.randint(1, 900))])
    bins, offsets = best_two_fit.best_two_fit(sizes, 1000)
    for b in range(bins.max() + 1):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += sizes[i]
        assert 0 < at <= 1000
    assert -(-sizes.sum() // 1000) <= bins.max() + 1 <= _first_fit(sizes.tolist(), 1000) + 1


def _check_pieces(rows, docs, capacity=4096):
    tok = _tokenizer()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        cuts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in cuts] == [
            (i, s, min(capacity, len(ids) - s)) for i, s in enumerate(range(0, len(ids), capacity))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in cuts)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_best_two_fit_of_awkward_and_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = best_two_fit.op12_best_two_fit(spark, sf).collect()
    n = _check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    rows = best_two_fit.pack(messy.table(spark, messy.AWKWARD + ODD), WORDS).collect()
    _check_pieces(rows, list(enumerate(messy.AWKWARD + ODD)))
    assert best_two_fit.pack(messy.empty(spark), WORDS).count() == 0


def test_open_bins_go_on_to_a_next_round(spark):
    texts = [f"word{i} " * (i % 37 + 1) for i in range(600)]
    table = messy.table(spark, texts)
    many = best_two_fit.pack(table, WORDS, capacity=128, block_pieces=64).collect()
    assert _check_pieces(many, list(enumerate(texts)), 128) <= -(-sum(r.length for r in many) // 128) * 1.03
    again = best_two_fit.pack(table, WORDS, capacity=128, block_pieces=64).collect()
    assert sorted(many) == sorted(again)


def test_packing_rows_that_share_an_id(spark):
    rows = best_two_fit.pack(messy.table(spark, ["a b c"] * 30).selectExpr("cast(null as long) doc_id", "text"), WORDS).collect()
    assert len(rows) == 30 and {r.doc_id for r in rows} == {None} and len({r.offset for r in rows}) == 30


# ------------------------------------------------------------------ source divergence
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _audit(docs, min_docs):
    tf, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = sorted({(lang or "", source or "") for _, lang, source in docs})
    for text, lang, source in docs:
        found = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        tf[lang or "", source or ""].update(found)
        df[lang or ""].update(found.keys())
    rows = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        total = {s: sum(tf[lang, s][t] for t in kept) + 5 * len(kept) for g, s in groups if g == lang}
        whole = {t: sum(tf[lang, s][t] for s in total) for t in kept}
        p = {s: {t: 1 + 10 ** 9 * (tf[lang, s][t] + 5) // total[s] for t in kept} for s in total}
        all_ = sum(total.values()) - 5 * len(kept) * (len(total) - 1)
        q = {t: 1 + 10 ** 9 * (whole[t] + 5) // all_ for t in kept}
        pair = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in total if o != source]
        term = [(p[source][t] - q[t], t) for t in kept if tf[lang, source][t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", term, 50)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                rows.append((lang, source, part, item, value, rank + 1))
    return sorted(rows)


def _sources():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}é" for a in "abcdefgh" for b in "stuvwxyz"] + ["Über", "naïve", "日本", "x"]
    docs = [(" ".join(rng.choices(vocabulary[k % 7 * 4:], k=rng.randint(0, 60))).replace("a", rng.choice("aA")),
             rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3", None))) for k in range(300)]
    return docs + [(None, "en", "null text"), ("1 2 3 _", "en", "no terms"), ("rare", "xx", "a"), ("rare", "xx", "b"), (None, None, None),
                   ("one " * 5000, "en", "s1"), ("alone", "yy", "z")] + [("same same Text", "de", "s1")] * 40


@pytest.mark.parametrize("segment_terms", [divergence.SEGMENT_TERMS, 5])
def test_divergence_against_brute_force(spark, segment_terms):
    docs = _sources()
    table = spark.createDataFrame([(*d, 1, "t", 2) for d in docs],
                                  "text string, lang string, source string, n long, term string, id long").repartition(5)
    got = sorted(map(tuple, divergence.audit(table, 30, segment_terms).collect()))
    assert got == _audit(docs, 30)


def test_divergence_of_nothing(spark):
    assert divergence.audit(messy.empty(spark)).count() == 0


def test_price_is_exact():
    rng = random.Random(1)
    for total in (5, 7, 10 ** 6 + 3, 10 ** 12 + 39, (1 << 62) + 11):
        counts = [0, 1, *(rng.randint(0, total - 5) for _ in range(50))]
        assert divergence.price(np.array(counts), total).tolist() == [1 + 10 ** 9 * (c + 5) // total for c in counts]


def test_gallop_and_merge():
    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (0, 5), (3, 0), (1, 4000), (700, 900), (513, 90_000)):
        a, b = (np.unique(rng.integers(0, 100_000, k)) for k in (n, m))
        assert (divergence.gallop(a, b, 64) == np.searchsorted(b, a)).all()
        ca, cb = rng.integers(1, 50, len(a)), rng.integers(1, 50, len(b))
        pa_, pb = ({i: 1 + 10 ** 9 * (c + 5) // t for i, c in zip(x.tolist(), y.tolist())} for x, y, t in ((a, ca, 9000), (b, cb, 777)))
        every = set(pa_) | set(pb)
        want = sum(abs(pa_.get(i, 1 + 5 * 10 ** 9 // 9000) - pb.get(i, 1 + 5 * 10 ** 9 // 777)) for i in every)
        assert divergence.merge_prices((a, ca), (b, cb), 9000, 777) == (want, len(every))
        assert divergence.merge_prices((b, cb), (a, ca), 777, 9000) == (want, len(every))


# ------------------------------------------------------------------ importance resampling
RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, longest=2):
    w = RUN.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _resample(docs, target, percent=25, longest=2):
    held = [(d, *_features(t, longest)) for d, t in docs]
    s = collections.Counter(b for _, _, f in held for b in f)
    t = collections.Counter(b for text in target for b in _features(text, longest)[1])
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.total() + 10_000) / ((s[i] + 1) * (t.total() + 10_000)))) for i in range(10_000)]
    rows = []
    for d, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawable = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawable[:percent * len(drawable) // 100]):
        r[4] = rank + 1
    return [tuple(r[:5]) for r in rows]


def _key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_against_brute_force(spark, longest):
    rng = random.Random(9)
    texts = messy.AWKWARD + [" ".join(rng.choices(["Alpha", "beta7", "γάμμα", "x" * 70, "été", "1999"], k=rng.randint(0, 90)))
                             for _ in range(400)]
    target = ["alpha beta7 γάμμα"] * 5 + [None, ""]
    table = messy.table(spark, texts).repartition(7)
    got = resampling.resample(table, messy.table(spark, target), longest=longest).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(_resample(list(enumerate(texts)), target, longest=longest), key=_key)


def test_resampling_of_a_whole_table(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = _resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, resampling.op13_importance_resampling(spark, sf).collect()), key=_key) == sorted(want, key=_key)


def test_resampling_rows_that_share_a_key_and_of_nothing(spark):
    text = "one two three four five six seven eight nine ten " * 3
    table = spark.createDataFrame([(None, text)] * 30 + [(5, text)] * 10 + [(6, None)], "doc_id long, text string").repartition(3)
    got = resampling.resample(table, messy.empty(spark)).collect()
    assert len(got) == 41 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert resampling.resample(messy.empty(spark), messy.empty(spark)).count() == 0
    few = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(few, few).collect()] == [None, None]


def test_cutoff_is_exact_in_every_place(spark):
    rng = random.Random(4)
    keys = [(rng.randint(-5, 5), rng.randint(-3, 40)) for _ in range(300)] + [(2, 7)] * 150
    table = spark.createDataFrame(keys, "score long, tie long").repartition(6)
    for k in (1, 2, 75, 150, 299, 300, 449, 450):
        assert resampling.cutoff(table, k) == sorted(keys, reverse=True)[k - 1]
    s, t = map(np.array, zip(*keys))
    assert [resampling.kth_largest(s, t, k) for k in (0, 200, 449)] == [sorted(keys, reverse=True)[k] for k in (0, 200, 449)]


def test_crc_of_spans():
    data = np.frombuffer(("ab" * 40 + "xyz é 1").encode(), np.uint8)
    starts, ends = np.array([0, 0, 3, 80, 5]), np.array([0, 80, 9, len(data), 60])
    crc = np.array([zlib.crc32(b"q") if i % 2 else 0 for i in range(5)], np.uint32)
    got = resampling.extend_crc(crc, data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(starts, ends, crc)]
