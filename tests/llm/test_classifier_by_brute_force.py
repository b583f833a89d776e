"""Scores of the quality classifier from statistics counted with another library and the densities' textbook formula."""

import random
import zlib

import numpy as np
import pytest
import regex

pytest.importorskip("blockwood.llm")

from blockwood.llm.quality_qda import quality_classifier  # noqa: E402

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def counted(t):
    """The ten statistics of a text."""
    t = t or ""
    words = WORD.findall(t)
    chars, gaps = len(t) + 20, len(words) + 5
    other = regex.compile(r"[^\p{L}\p{N}\x20\x09-\x0D]")
    odd = sum(len(regex.findall(r"[^\p{L}\p{N}]{2,}", w)) for w in words)
    lone = sum(len(w) == 1 and bool(other.match(w)) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = lambda n, of: (n / of) ** 0.5
    among = lambda s: sum(c in s for c in t)
    return [
        np.log1p(len(t)), np.log1p(len(t) / gaps), share(among("#*$%&|<>_=~^@{}[]\\"), chars), share(sum("A" <= c <= "Z" for c in t), chars), share(among(".,;:!?"), chars),
        share(sum("0" <= c <= "9" for c in t), chars), share(t.count("\n"), gaps), share(odd, gaps), share(lone, gaps), share(again, gaps),
    ]


def test_scores(spark):
    random.seed(11)
    pool = ["stone", "river", "and", "rain.", "Été", "ß", "9", "42%", "$$", "|", "AB!!", "%x", "a-b", "\n", "--", "x"]
    texts = ["".join(random.choice(pool[k % 5 :]) + random.choice(" \n\t ") for _ in range(random.randrange(0, 60))) for k in range(240)]
    texts += [None, "", " \n ", "word " * 300_000, "é" * 1000, "!" * 5000, "same same same same"]
    labels = [(i, int((i * 7) % 5 < 3)) for i in range(0, 240, 1) if i % 3] + [(1, 1)]
    docs = spark.createDataFrame([(i, t, "q", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in quality_classifier(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    x = np.array([counted(t) for t in texts])
    learn = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    rows, y = x[[i for i, _ in learn]], np.array([v for _, v in learn])
    centre, spread = rows.mean(0), np.where(rows.std(0) > 1e-9, rows.std(0), 1)
    z, every = (rows - centre) / spread, (x - centre) / spread
    cov = lambda m: (m - m.mean(0)).T @ (m - m.mean(0)) / len(m)
    log = []
    for label in (0, 1):
        own = z[y == label]
        s = 0.95 * (0.8 * cov(own) + 0.2 * cov(z)) + 0.05 * np.eye(10)
        away = every - own.mean(0)
        log.append(np.log((len(own) + 1) / (len(z) + 2)) - np.linalg.slogdet(s)[1] / 2 - (away * np.linalg.solve(s, away.T).T).sum(1) / 2)
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    assert all(got[i].score == pytest.approx(w, rel=1e-9, abs=1e-12) for i, w in enumerate(want))
    assert all(got[i].predicted == (got[i].score >= 0.3) for i in got)
