"""Periodic texts and sources that come again very often: bounded rows a task, same results."""

import functools
import hashlib
import time

import numpy as np
import pytest

pytest.importorskip("blockwood.llm")

from blockwood.llm import mixing, suffix_dedup  # noqa: E402


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.without_repeats(docs)).collect()}


def test_periodic_texts(spark):
    """Runs of one byte and of short periods, megabytes long, go as a whole; what is beside them stays."""
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(97, 123, 500))
    texts = ["a" * 4_000_000, noise + "-+" * 500_000 + noise[::-1], "=" * 199, "|--" * 70_000, noise[:150] + "#" * 200 + noise[150:300]]
    began, got = time.time(), cleaned(spark, texts)
    assert time.time() - began < 60
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == (4_000_000, 4_000_000, 1, sha("")) and got[2] == (199, 0, 0, sha("=" * 199)) and got[3] == (210_000, 210_000, 1, sha(""))
    n, removed, spans, kept = got[1]
    assert (n, removed, spans, kept) == (1_001_000, 1_000_000, 1, sha(noise + noise[::-1]))
    assert got[4] == (500, 0, 0, sha(texts[4]))  # one window of its kind, and no other that occurs twice


def test_a_run_is_one_anchor():
    data = np.frombuffer(b"x" * 5000 + b"".join(b"%d," % i for i in range(2000)), np.uint8)
    a = suffix_dedup.anchors(data, np.array([0, len(data)]), 200, 50)
    head, tail = suffix_dedup.runs(a)
    assert a["first"][head[0]] == 0 and tail[0] - head[0] > 4500 and len(head) < len(a["text"]) - 4500
    assert np.array_equal(a["first"][head[1:]], a["last"][tail[:-1]] + 1)
    assert [len(x) for x in suffix_dedup.runs({k: v[:0] for k, v in a.items()})] == [0, 0]


def test_a_tiny_source_comes_again_from_all_tasks(spark, monkeypatch):
    rows = [(i, "big", "t") for i in range(6400)] + [(9999, "tiny", "u"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    want = sorted(map(tuple, mixing.mix(docs, {"big": 1}, block_rows=4).collect()), key=str)
    monkeypatch.setattr(mixing, "_repeated", functools.partial(mixing._repeated, at_once=16))
    out = mixing.mix(docs, {"big": 1}, block_rows=4)
    assert sorted(map(tuple, out.collect()), key=str) == want
    tiny = out.where("source = 'tiny'").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(tiny) == 1599 and max(tiny) < 900 and sum(n > 0 for n in tiny) > 2


def test_cells_of_the_jaccard_join_are_dealt_by_the_size_of_the_text(spark, monkeypatch):
    """More text, more parts: none outgrows the memory of its task; the classes are the same."""
    from blockwood.llm import jaccard_join

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:10])), "doc_id long, text string")
    found, parts = [], jaccard_join._parts
    monkeypatch.setattr(jaccard_join, "_parts", lambda rows, size: found.append(parts(rows, size)) or found[-1])
    few, many = ({tuple(r) for r in jaccard_join.similarity_classes(docs, part_bytes=b).collect()} for b in (16 << 20, 1000))
    total = sum(len(t) for t in texts + texts[:10])
    assert found == [4, -(-total // 1000)] and few == many
    assert {r[2] for r in few} == set(range(30))
