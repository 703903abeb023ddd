"""Line dedup, near-duplicates, fingerprints and neighbours against brute force."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanweave.llm import fingerprint, line_dedup, near_dup, neighbours, queries, text
from loanweave.llm.components import components


def random_docs(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    base = [[" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(rng.randint(1, 6))] for _ in range(n)]
    rows = []
    for i in range(n):
        lines = list(base[rng.randrange(n)]) if i % 3 == 0 else list(base[i])
        if i % 5 == 0:
            w = lines[0].split(" ")
            w[0] = "edited"
            lines[0] = " ".join(w)
        rows.append((i, "\n".join(lines)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def plain_line_dedup(rows, likeness, least):
    seen, out = [], {}
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            w = {x for x in re.split("[\t-\r ]+", line) if x}
            if len(w) < least:
                keep.append(line)
                continue
            if not any(len(w & s) >= likeness * len(w | s) - 1e-9 for s in seen):
                keep.append(line)
            seen.append(w)
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("heavy", [500, 0])
def test_line_dedup_is_exact(spark, monkeypatch, heavy):
    """With every prefix word refined as well."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    monkeypatch.setattr(line_dedup, "BUCKETS", 3 << 10)
    rows, docs = random_docs(spark)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == plain_line_dedup(rows, 0.8, 5)


def test_short_lines_take_part(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "BUCKETS", 3 << 10)
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 7))) for _ in range(4))) for i in range(60)]
    rows += [(100, "Les.\n\na whole line of six words"), (101, "Les.\n\na whole line of six words"), (102, "a whole line of\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.selectExpr("*", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == plain_line_dedup(rows, 0.8, 1)
    left = {r.doc_id for r in line_dedup.keep_new_lines(docs).collect()}
    assert 101 not in left and {100, 102} <= left  # a whole copy leaves no stub


@pytest.mark.parametrize("heavy", [500, 0])
def test_long_like_lines_meet_at_few_keys(spark, monkeypatch, heavy):
    """Lines that share a hundred words share as many keys, with pairs of words their square."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    monkeypatch.setattr(line_dedup, "BUCKETS", 3 << 10)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(110)]
    lines = [" ".join(rng.sample(words, 100) + [f"own{i}"]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = line_dedup._sets(docs, 0.8, 1)
    rows = line_dedup._prefix(sets)(sets).cache()
    met = collections.Counter((r.later, r.earlier) for r in line_dedup._met(rows, 0.8).collect())
    at = {r.sid: set(lines[r.k].split(" ")) for r in sets.collect()}
    alike = {(b, a) for a in at for b in at if a < b and len(at[a] & at[b]) >= 0.8 * len(at[a] | at[b]) - 1e-9}
    assert alike and alike <= set(met)
    shared = rows.alias("a").join(rows.alias("b"), "key").where("a.sid < b.sid").count()
    assert sum(met.values()) * 3 < shared
    rows.unpersist()


def test_line_dedup_edge_cases(docs, no_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKETS", 3 << 10)
    done = line_dedup.dedup(docs)
    rows = {r.doc_id: r for r in done.collect()}
    assert done.count() == docs.count() and set(done.columns) == {*docs.columns, "removed_lines"}
    assert rows[3].text is None and rows[2].text == "" and rows[6].text == "  \n\t "
    assert rows[1].removed_lines == 0
    assert rows[4].text == "" and rows[4].removed_lines == 2  # 9 of 11 words in common
    assert rows[7].text == "one two"
    assert line_dedup.dedup(no_docs).count() == 0
    assert line_dedup.keep_new_lines(docs).columns == docs.columns


def shingle_counts(t):
    w = [x for x in re.split("[\t-\r ]+", (t or "").lower()) if x]
    runs = [tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    return collections.Counter(runs)


def plain_classes(rows):
    sets = {i: shingle_counts(t) for i, t in rows}
    label = {i: i for i in sets}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        union = sum((sets[a] | sets[b]).values())
        if union and sum((sets[a] & sets[b]).values()) / union >= 0.8:
            links.append((a, b))
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_dup_classes(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = rng.choices(words, k=120)
        for j in range(7):
            t = list(base)
            for _ in range(j % 4):
                t[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(100 + i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()}
    assert got == plain_classes(rows)


def test_near_dup_edge_cases(docs, no_docs):
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dup.classes(docs).collect())
    assert got == collections.Counter(
        [(1, 1), (2, 2), (3, 3), (4, 1), (4, 1), (5, 5), (6, 6), (7, 7), (None, None), (9, 9)])
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 9]
    assert near_dup.classes(no_docs).count() == 0


def test_keep_first_decides_for_each_row(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(200)], k=30)) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "x"),  # repeated rows
            (None, a, "x"), (None, d, "x"), (None, d, "x"),  # null ids: a copy, and a text of their own
            (2, b, "x"), (3, b, "x"), (3, c, "x"),  # two texts under one id, one of them a copy
            (4, "", "x"), (4, None, "x"), (4, " ", "x")]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(parts)
        kept = near_dup.keep_first(frame)
        assert kept.columns == frame.columns
        got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
        assert got == sorted([("1", a), ("None", d), ("2", b), ("3", c), ("4", ""), ("4", "None"), ("4", " ")])


def test_signatures_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    for keep in (100, 300, 380):
        b = np.sort(np.concatenate([a[:keep], rng.integers(0, 2**63, 400 - keep).astype(np.uint64)]))
        unit = near_dup.units(np.concatenate([a, b]), np.array([0, 400, 800]))
        sig = near_dup.signatures(unit, np.array([0, 400, 800]), 2000)
        assert abs((sig[0] == sig[1]).mean() - near_dup.weighted_jaccard(a, b)) < 0.05


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long").coalesce(1)
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fingerprint_rate_is_generalised_jaccard():
    rng = random.Random(2)
    words = [f"t{i}" for i in range(200)]
    a = " ".join(rng.choices(words, k=600))
    b = " ".join(a.split()[:350] + rng.choices(words, k=250))
    x, y = collections.Counter(a.split()), collections.Counter(b.split())
    true = sum((x & y).values()) / sum((x | y).values())
    rows = fingerprint.fingerprints(pa.array([a, b, a, ""]), 4000)
    assert abs((rows[0] == rows[1]).mean() - true) < 0.04
    assert (rows[0] == rows[2]).all() and not rows[3].any()


def test_edit_report(docs, no_docs, spark):
    for ranges in (1, 3):
        rows = fingerprint.edit_report(docs, ranges=ranges).collect()
        source = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        texts = [r.text or "" for r in source]
        import hashlib

        want = sorted(hashlib.sha256(fingerprint.edited(t, o).encode()).hexdigest() for t, o in zip(texts, texts[1:] + texts[:1]))
        assert sorted(r.edited_sha256 for r in rows) == want
        assert sorted(r.n_chars for r in rows) == sorted(map(len, texts))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.edit_report(no_docs).count() == 0
    one = fingerprint.edit_report(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert {r.fingerprint for r in fingerprint.fingerprint(docs).where("doc_id = 4").collect()} == {
        r.fingerprint for r in fingerprint.fingerprint(docs).where("doc_id = 4").limit(1).collect()}


def test_hilbert_curve_is_a_walk_through_all_cells():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = neighbours.hilbert(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[200:260] = x[0]  # a vector that many rows share
    rows = [(i, x[i].tolist(), i) for i in range(400)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1150, [None] * 8, 0),
             (1200, [float("inf")] + [0.0] * 7, 0), (1250, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (50, x[50].tolist(), 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").coalesce(1)
    got = collections.defaultdict(list)
    for r in neighbours.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        score = np.round(unit @ unit[q], 9)
        want = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        assert [v for _, v, _ in found] == want and [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in found], score[want], atol=1e-8)
    # Small blocks and windows: most neighbours are still found.
    few = neighbours.search(frame, share=0.08, least_window=1).collect()
    true = {(q, v) for q, f in got.items() for _, v, _ in f}
    assert len({(r.query_id, r.vec_id) for r in few} & true) >= 0.9 * len(true)
    assert neighbours.search(frame.where("false")).count() == 0


def test_word_hashes_match_words_of_any_slice(monkeypatch):
    texts = ["a bb  ccc", None, "", " x\ty ", "bb " * 50, "ż" * 30 + " a"]
    whole, first = text.word_hashes(*text.text_buffers(pa.array(texts)))
    monkeypatch.setattr(text, "SLICE", 7)
    cut, first2 = text.word_hashes(*text.text_buffers(pa.array(texts)))
    assert (whole == cut).all() and (first == first2).all()
    words = [w for t in texts for w in re.findall("[^\t-\r ]+", t or "")]
    assert len(words) == len(whole) and len(set(words)) == len(set(whole.tolist()))


def test_curves_tell_rows_of_a_dense_group_apart():
    """A third of the rows lie around one vector; their neighbours are found in small windows."""
    rng = np.random.default_rng(1)
    n, window = 6000, 240
    x = rng.standard_normal((n, 64))
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + 0.001 * rng.standard_normal((n // 3, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n // 3, 40)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -2
    best = np.argsort(-score, axis=1)[:, :5]
    hit = np.zeros(best.shape, bool)
    for c in range(neighbours.CURVES):
        upper, lower = neighbours.curve_keys(unit, c)
        place = np.empty(n, int)
        place[np.lexsort((lower, upper))] = np.arange(n)
        hit |= np.abs(place[best] - place[asked][:, None]) <= window
    assert hit.mean() >= 0.9
