"""Mixing, quality, license scan, archives and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest

from loanweave.llm import license_scan, mixing, quality, store, warc


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 90), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 1, 2, 3: b stops at 30, the other 170 are shared 1 : 3.
    assert got == {"a": pytest.approx(42.5), "b": 30.0, "c": pytest.approx(127.5), None: 0.0}


def test_mixing(docs, no_docs, monkeypatch):
    counts = mixing.mix_counts(docs)
    rows = counts.collect()
    assert len(rows) == docs.count()
    assert all(r.taken == r.size * r.times and r.times <= 3 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_counts(docs).collect()))
    assert {r.doc_id: r.size for r in rows}[6] == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.times
    assert got == +want
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def walked(units, rest, enough):
    """Rows (key, tie, size of one row, size of all) in order: what a plain walk takes."""
    done, taken, passed = 0, set(), []
    for key, tie, size, s in sorted(units):
        passed.append((tie, s))
        if rest - done <= enough:
            break
        if done + s <= rest:
            taken.add(tie)
            done += s
    left = [(abs(done + s - rest), j, tie) for j, (tie, s) in enumerate(passed) if tie not in taken]
    if left and min(left)[0] < rest - done:
        taken.add(min(left)[2])
    return taken


@pytest.mark.parametrize("parts", ["1", "9", "30"])
def test_mixing_does_not_depend_on_the_parts(spark, parts):
    """Long documents that no longer fit in a later part, though nothing was skipped before it."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(i, "w " * (1 + (i * i * 37) % 400), f"s{i % 12:02d}") for i in range(480)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    try:
        got = mixing.mix_counts(frame).collect()
        keys = mixing.keyed(frame, 11).select("source", "doc_id", "_size", "_key", mixing._tie()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    times, target = {r.doc_id: r.times for r in got}, {r.doc_id: r.target for r in got}
    for source in {k.source for k in keys}:
        mine = [k for k in keys if k.source == source]
        total, goal = sum(k._size for k in mine), target[mine[0].doc_id]
        epochs = int(goal // total)
        units = [(k._key, k._tie, k._size, k._size) for k in mine]
        taken = walked(units, goal - epochs * total, mixing.TOLERANCE * goal)
        assert {k.doc_id: times[k.doc_id] for k in mine} == {k.doc_id: epochs + (k._tie in taken) for k in mine}


@pytest.mark.parametrize("long", [0, 4000, 9000])
@pytest.mark.parametrize("parts", ["1", "40"])
def test_mixing_meets_targets_over_many_parts(spark, long, parts):
    """One document longer than what is missing, at three places; parts of a few rows."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(i, "w " * (1 + i * 7 % 11), "abc"[i % 3]) for i in range(1500)]
    rows += [(5000 + j, "w " * long, "a") for j in range(1 if long else 0)]
    rows += [(6000, "w w w", "b")] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    try:
        got = mixing.mix_counts(frame).collect()
        keys = mixing.keyed(frame, 11).select("source", "doc_id", "_size", "_key", mixing._tie()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for source in "abc":
        target = {r.target for r in got if r.doc_id in {k.doc_id for k in keys if k.source == source}}.pop()
        mine = [k for k in keys if k.source == source]
        total = sum(k._size for k in mine)
        epochs = int(target // total)
        sizes = collections.defaultdict(int)
        for k in mine:
            sizes[k._tie] += k._size
        units = {(k._key, k._tie, k._size, sizes[k._tie]) for k in mine}
        taken = walked(units, target - epochs * total, mixing.TOLERANCE * target)
        want = {k.doc_id: epochs + (k._tie in taken) for k in mine}
        assert {r.doc_id: r.times for r in got if r.doc_id in want} == want
        # What is short enough for the rest may add up to less than the rest.
        rest = target - epochs * total
        near = epochs * total + min(rest, sum(s for *_, s in units if s <= rest))
        assert abs(sum(r.taken for r in got if r.doc_id in want) - near) <= max(11, 0.001 * target)


def test_statistics_and_rejects(spark, docs, no_docs):
    good = [(i, f"The {i}th sentence, of some length, says this and that about number {i * 7}.", 1) for i in range(200)]
    bad = [(1000 + i, "SPAM!! " * (5 + i % 7), 0) for i in range(200)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int").coalesce(1)
    labels = frame.select("doc_id", "quality").unionByName(
        spark.createDataFrame([(None, 1), (5, None), (7, 3)], "doc_id long, quality int"))
    rows = quality.classify(frame.select("doc_id", "text"), labels, width=64).collect()
    assert all(r.held_out == (quality.crc_fold(r.doc_id) == 0) for r in rows)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in rows if r.held_out]) > 0.95
    kept = quality.keep_good(frame.withColumn("score", frame.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "quality", "score"]
    assert kept.where("quality = 1").count() >= 195 and kept.where("quality = 0").count() <= 5
    odd = quality.classify(docs, labels, width=16).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(no_docs, labels).count() == 0
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and quality.keep_good(docs, labels.where("false")).count() == docs.count()


def test_statistics_are_finite():
    x = quality.statistics(pa.array(["", None, " ", "a", "é" * 9, "x y\n" * 400]))
    assert x.shape == (6, len(quality.STATISTICS)) and np.isfinite(x).all()


def test_pooled_is_monotone():
    got = quality.pooled(np.array([1.0, 0.0, 3.0, 2.0]), np.array([2.0, 2.0, 4.0, 2.0]))
    assert got.tolist() == [0.25, 0.25, 0.75, 1.0]


def test_license_scan(spark, docs, no_docs):
    header = license_scan.TEMPLATES["apache-2.0-header"]
    edited = header.replace("express or", "expressed or").replace("obtain a copy", "obtain one copy")
    rows = [(1, "x y z. Released under the MIT License. Released under the MIT License."), (2, f"code\n{edited}\nmore"),
            (3, "the license of the version"), (4, "Licensed  under the\nApache License,  Version 2.0."), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.template, r.matched_words, r.span_start) for r in license_scan.scan(frame).collect())
    assert [g[:2] for g in got if g[0] == 1] == [(1, "mit-line")] * 2 and got[0][3] == 7
    assert {g[1] for g in got if g[0] == 2} >= {"apache-2.0-header"}
    n = len(license_scan.words_of(header)[0])
    assert [g[2] for g in got if g[1] == "apache-2.0-header"] == [n - 2]
    assert [g[1] for g in got if g[0] == 4] == ["apache-2.0-line"] and not [g for g in got if g[0] in (3, 5)]
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(no_docs).count() == 0
    assert license_scan.scan(frame, {}).count() == 0


def test_license_names_need_deciding_words():
    index = license_scan.Index(license_scan.TEMPLATES)
    names = lambda text: {m[0] for m in index.matches(text, 0.8)}
    whole = license_scan.TEMPLATES
    for name, text in whole.items():
        assert (name, 1.0) in {(m[0], m[2]) for m in index.matches(f"before it {text} after it", 0.8)}, name
    assert names(whole["mit"]) == {"mit"} and "mit" not in names(whole["mit"][:450])  # the grant alone
    for name in ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "0bsd", "mit-0", "gpl-2.0", "gpl-3.0", "lgpl-2.0",
                 "lgpl-2.1", "gfdl-1.2", "gfdl-1.3", "gpl-2.0-or-later-header", "gpl-3.0-only-header", "lgpl-2.1-or-later-header"):
        assert names(whole[name]) == {name}
    assert names("Licensed under CC BY-SA 4.0.") == {"cc-by-sa-4.0-short-line"}
    assert names("Licensed under CC BY-NC 3.0.") == {"cc-by-nc-3.0-short-line"}
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == {
        "cc-by-nc-4.0-long-line"}
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == {"lgpl-3.0-line"}
    assert names("Released under the Foo License.") == set()
    assert names("# SPDX-License-Identifier: GPL-2.0-or-later") == {"spdx-gpl-2.0-or-later"}
    assert names(whole["mpl-2.0"].replace("Covered Software", "Covered  Software", 3).replace("Contributor", "Donor", 2)) == {"mpl-2.0"}


def test_templates_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_WORDS", 10)
    assert len(list(license_scan.parts(license_scan.TEMPLATES))) > 3
    frame = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [r.template for r in license_scan.scan(frame).collect()] == ["mit-line"]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_archives(spark):
    rows = [(1, "http://a/", "<p>x</p>", 0), (2, "http://b/ü\r\nX: y", "<p>x</p>", 0), (3, None, None, 0), (4, "u", "", 0),
            (5, "u", "ż" * 5000, 0), (7, "u", "WARC/1.1\r\n\r\nfake", 0), (None, "n", "alone", 0), (8, "d", "same", 0), (8, "d", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type int").repartition(3)
    got = sorted(warc.archive(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    leader = {sha(t): max([i for i, _, u, _ in rows if sha(u) == sha(t) and i is not None], default=None) for _, _, t, _ in rows}
    want = [(i, len((t or "").encode()), sha(t), "response" if leader[sha(t)] in (i, None) else "revisit",
             None if leader[sha(t)] in (i, None) else leader[sha(t)]) for i, _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert [tuple(r) for r in got] == want
    assert [r.record_type for r in warc.archive(pages, least=10_000_000).collect()] == ["response"] * len(rows)
    assert warc.archive(pages.where("false")).count() == 0


def test_revisits_name_a_record_of_the_archives(spark):
    pages = spark.createDataFrame(
        [(1, "u", "same"), (2, "u", "same"), (9, "u", "same"), (9, "u", "same"), (4, "u", "other"), (5, None, None),
         (6, "u", ""), (None, "u", "same"), (7, "u", "x" * 3_000_000)], "page_id long, url string, html string").repartition(3)
    found = warc.captures(pages).collect()
    ids = {r.main.record_id: r for r in found}
    assert len(found) == 9 == len(ids)
    revisits = [r for r in found if r.record_type == "revisit"]
    assert sorted((r.page_id or 0, r.refers_to) for r in revisits) == [(0, 9), (1, 9), (2, 9), (5, 6)]
    for r in revisits:
        named = ids[r.main.refers_to]
        assert named.record_type == "response" and named.page_id == r.refers_to
        assert named.payload_digest == r.payload_digest
    assert all(len(r.requests) == 1 == len(r.metadata) for r in found)
    assert {r.payload_bytes for r in found if r.page_id == 7} == {3_000_000}


def test_transactions_nest_records_of_one_capture(spark):
    folder = store.new_folder(spark, "test")
    pages = spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string")
    found = warc.read_records(warc.write(pages, folder), folder)
    row = warc.transactions(found, payloads=True).collect()
    assert len(row) == 1 and bytes(row[0].main.payload) == b"hello"
    assert len(row[0].requests) == 1 and row[0].metadata[0].page_id == 1
    lone = warc.transactions(found.where("type = 'request'")).first()
    assert lone.main is None and len(lone.requests) == 1 and lone.metadata == []


def test_record_parser_reads_concatenated_members():
    data = b"".join(warc.capture(3, "u", "p" * 10, None, "n"))
    kinds = [h["warc-type"] for h, _ in warc.records(io.BytesIO(data))]
    assert kinds == ["response", "request", "metadata"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count()
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.where("offset = 0").count() == pieces.count() > 0
