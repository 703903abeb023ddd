"""N-gram join, centroid clustering and collocations against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanweave.llm import centroids, collocations, linking, ngram_join

# --- n-gram join --------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)}


def plain_components(rows, share=85):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
            label[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, groups=6, size=14):
    """Groups of texts around the border of the share, with passages that many texts hold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([5, 9, 30, 120, 300])) + (passage if g % 2 else [])
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("classes", [(16, 512), (1, 3), (2, 2), (0, 0)])
def test_ngram_join_is_exact_in_all_classes(spark, monkeypatch, classes):
    monkeypatch.setattr(ngram_join, "CLASSES", classes)
    rows = near_copies(sum(classes))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = collections.Counter(map(tuple, ngram_join.components_of(frame, bits=12).collect()))
    assert got == plain_components(rows)


def test_prefixes_of_linked_sets_share_a_key():
    """The claim behind the join, for random sets, frequencies and shares."""
    rng = random.Random(3)
    for _ in range(300):
        share = rng.choice([60, 85, 95])
        df = {t: rng.choice([2, 3, 20, 600]) for t in range(1, 400)}
        x = set(rng.sample(range(1, 400), rng.randint(ngram_join.least_size(share), 150)))
        y = set(x)
        for t in rng.sample(sorted(x), rng.randint(0, len(x) * (100 - share) // 200 + 1)):
            y.discard(t)
        y |= set(rng.sample(range(1, 400), rng.randint(0, 3)))
        if not y or 100 * len(x & y) < share * len(x | y):
            continue
        keys = [set(ngram_join.prefix_keys(np.array([df[t] for t in s]), np.array(sorted(s), np.uint64), len(s), share))
                for s in (sorted(x), sorted(y))]
        assert keys[0] & keys[1]


def test_ngram_join_edges(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter(map(tuple, ngram_join.components_of(docs).collect()))
    assert got == plain_components(rows)
    assert ngram_join.components_of(no_docs).count() == 0


def test_blocks_hand_over_a_forest(spark, monkeypatch):
    """Without leader rounds everything is compared in blocks, of two documents each."""
    monkeypatch.setattr(linking, "ROUNDS", 0)
    monkeypatch.setattr(linking, "BLOCK_DOCS", 2)
    sets = [np.arange(i // 5 * 100, i // 5 * 100 + 20, dtype=np.uint64) for i in range(20)]
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, s binary")
    open_ = spark.createDataFrame([(1, i, i) for i in range(20)], "key long, id long, label long")
    enough = lambda both, x, y: both >= 0.8 * (x + y - both)
    links = [(r.a, r.b) for r in linking.linked_in_blocks(open_, frame, enough).collect()]
    assert all(a // 5 == b // 5 for a, b in links)
    got = {r.node: r.label for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 5 * 5 for i in range(20)}
    assert linking.forest(np.array([1, 2, 1]), np.array([2, 3, 3]), np.array([1, 2, 1]), np.array([2, 3, 3])) == [0, 1]


# --- centroids ----------------------------------------------------------------------------


def plain_centroids(rows, k, rounds):
    kept = [(i, [int(np.floor(np.float64(256) * np.float64(v))) for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for c in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(v) // len(mine) for v in zip(*mine)]
    found = [(i, *near(x)) for i, x in kept]
    sums = collections.Counter()
    for _, d, c in found:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, d, c in found)


def test_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.4, 64)]) for i in range(90)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]),
             (203, [float("nan")] * 64), (204, [float("-inf")] + [0.0] * 63), (205, [-3.0] * 64), (206, [900.5] * 64)]
    frame = spark.createDataFrame([(i, x, 1, 2) for i, x in rows],
                                  "vec_id long, embedding array<float>, cluster int, planes int").repartition(3)
    got = collections.Counter(map(tuple, centroids.cluster(frame, k=7, rounds=3).collect()))
    assert got == plain_centroids(rows, 7, 3)
    assert centroids.cluster(frame.where("vec_id < 2"), k=7).count() == 2
    assert centroids.cluster(frame.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        centroids.cluster(huge)


def test_plane_dots_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-2**20, 2**20, (50, 64)), rng.integers(-2**20, 2**20, (9, 64))
    got = centroids.dots(centroids.to_planes(x, 21), centroids.to_planes(c, 21))
    assert (got == x @ c.T).all()


# --- collocations -------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang or "und"][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        frequent = [p for p, a in f.items() if a >= least]
        for p in frequent:
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * f[q] >= 80 * f[p] and inside(q) for q in frequent):
                continue
            score, k = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(8)
    words = "the of in New York big Ünder été city-x 1.5 a b is".split(" ")
    rows = [("en" if i % 3 else "fr" if i % 2 else None, " ".join(rng.choices(words, k=rng.randint(0, 60)))
             + rng.choice(["", ".", "\nnew YORK city", "\tnew york, big"])) for i in range(120)]
    return [*rows, ("und", "new york " * 40), ("xx", ""), ("xx", None), ("en", "  \n\t ,,; ")]


@pytest.mark.parametrize("table_bits", [26, 7])
def test_collocations_equal_brute_force(spark, monkeypatch, table_bits):
    """Also with a bit table so small that it holds nothing back, and little memory."""
    rows = phrase_rows()
    if table_bits < 26:
        monkeypatch.setattr(collocations, "FLUSH", 50)
        monkeypatch.setattr(collocations, "PHRASES", 64)
    frame = spark.createDataFrame([(l, t, 1) for l, t in rows], "lang string, text string, f int").repartition(3)
    got = collocations.collocations(frame, least=8, top=12, bits=table_bits).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 8, 12)


def test_equal_fingerprints_come_apart_on_text(spark, monkeypatch):
    """Every run of words has one of two fingerprints: counts are still those of the texts."""
    real = collocations.Words.prints
    monkeypatch.setattr(collocations.Words, "prints", lambda self, at, n: real(self, at, n) & np.uint64(1 << 63))
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"], "text": ["x y x y z", "x y"]})
    table = type("B", (), {"value": np.full(2, 2**64 - 1, np.uint64)})()
    frame = type("D", (), {"sparkSession": spark})()
    found = {}

    class Rows:
        rdd = type("R", (), {"getNumPartitions": lambda self: 1})()

        def coalesce(self, n):
            return self

        def mapInArrow(self, run, schema):
            for out in run(iter([batch])):
                for r in out.to_pylist():
                    key = r["lang"], r["words"], r["phrase"]
                    found[key] = found.get(key, 0) + r["f"]
            raise StopIteration

    monkeypatch.setattr(collocations, "_rows", lambda docs: Rows())
    with pytest.raises(StopIteration):
        collocations.phrases(frame, table, 7, 1)
    assert found["a", 0, ""] == 5 and found["a", 2, "x y"] == 2 and found["a", 2, "y x"] == 1
    assert found["b", 2, "x y"] == 1 and found["a", 1, "z"] == 1 and found["a", 4, "x y x y"] == 1


def test_collocations_of_nothing(docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_collocations(rows, 30, 2000) != []
