"""The training-data operators against brute force, on ties, nulls, copies, empty and long texts, empty tables and clashing columns."""

import collections
import functools
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

pytest.importorskip("blockwood.llm")

from blockwood import frames  # noqa: E402
from blockwood.llm import katz, licenses, mixing, packing, revisit, rules, suffix_dedup, topk  # noqa: E402
from blockwood.llm import jaccard_join as join  # noqa: E402
from blockwood.llm.jaccard_join import similarity_classes  # noqa: E402
from blockwood.llm.quality_qda import quality_classifier  # noqa: E402
from blockwood.llm.queries import tokenizer_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _text string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results and inner names."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, "x", "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


EDGES = [None, "", " ", "a", "A", "a b", "A  B\n", "é ñ", "x" * 3000, "q " * 2500, "\x00 b\x00"]


# ---------------------------------------------------------------- 9


def base(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    random.seed(2)
    clean = [" ".join(random.choice(["the", "of", "rain", "stone", "river", "green"]) for _ in range(40)) for _ in range(30)]
    junk = [" ".join(random.choice(["%%%", "|", "zz$$", "!!"]) for _ in range(40)) for _ in range(10)]
    texts = [*clean, *junk, *EDGES, "one two three four five six seven eight nine\n" * 3, "a b a b a b a b a b a b"]
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long")
    rows = {r.doc_id: r for r in rules.quality_rules(frame(spark, texts), trusted).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(rows[i].kept for i in range(30)) and not any(rows[i].kept for i in range(30, 40))
    none = rules.quality_rules(frame(spark, texts), trusted.limit(0)).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in none)
    assert rules.quality_rules(frame(spark, []), trusted).count() == 0


def test_likelihood_ratio_by_brute_force(spark):
    """llr and kept from the hashed counts of all texts, computed again from the engine's word codes alone."""
    random.seed(8)
    texts = [" ".join(random.choice(["the", "of", "rain", "stone", "%%", "zz$"]) for _ in range(random.randrange(0, 50))) for _ in range(60)] + [*EDGES[:9], "long " * 250_000]
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    docs, size = frame(spark, texts), 64
    from pyspark.sql import functions as F

    codes = {r.doc_id: list(r.c) for r in docs.select("doc_id", rules.word_codes(rules.words(F.col("text"))).alias("c")).collect()}
    hashed = sorted({(a, b) for c in codes.values() for a, b in zip(c, [*c[1:], 0])})
    pair = {(r.a, r.b): r.h for r in spark.createDataFrame(hashed, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = {i: [g % size for a, b in zip(c, [*c[1:], 0]) for g in (a, pair[a, b])] for i, c in codes.items()}
    raw, target = collections.Counter(g for x in grams.values() for g in x), collections.Counter(g for i, x in grams.items() if i < 60 and i % 3 == 0 for g in x)
    weigh = lambda g: math.log((target[g] + 8192 / size) / (sum(target.values()) + 8192)) - math.log((raw[g] + 8192 / size) / (sum(raw.values()) + 8192))
    for few in (10**6, 3):
        rows = rules.quality_rules(docs, trusted, buckets=size, most_broadcast=few).collect()
        for r in rows:
            want = sum(map(weigh, grams[r.doc_id])) / max(1, len(grams[r.doc_id]))
            assert r.llr == pytest.approx(want, abs=1e-5) and r.kept == (not r.base_failed and r.llr >= -0.08)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_junk_fails_at_every_size(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_rules(docs, labels.where("quality = 1")).select("doc_id", "llr", "base_failed").join(labels, "doc_id").where("not base_failed").collect()
    good, junk = ([r.llr >= -0.08 for r in rows if r.quality == q] for q in (1, 0))
    assert sum(junk) <= 0.01 * len(junk) and sum(good) >= 0.99 * len(good)


# ---------------------------------------------------------------- 10


def test_licences(spark):
    mit = " ".join(" ".join(licenses.SENTENCES[k]) for k in ("MIT_GRANT", "MIT_NOTICE", "AS_IS"))
    texts = ["Text.\nReleased under the MIT License.", mit, mit.upper(), "LICENSED under  the Apache License, Version 2.0.", "the MIT License is fine", None, "", "...\n!", "Licensed under CC BY-NC 4.0. Released under the MIT License."]
    rows = [r.license for r in licenses.licence_scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows == ["MIT", "MIT", "MIT", "Apache-2.0", None, None, None, None, "MIT"]
    both = licenses.licence_scan(frame(spark, texts)).where("doc_id = 8").first()
    assert both.sentence_ids == ["CC_BY_NC4_REF", "MIT_REF"] and both.licenses == ["MIT", "CC-BY-NC-4.0"]
    assert licenses.licence_scan(frame(spark, [])).count() == 0


def test_wrapped_licences(spark):
    notices = {
        "MIT": ("MIT_GRANT", "MIT_NOTICE", "AS_IS"),
        "Apache-2.0": ("APACHE2_REF", "APACHE2_OBEY", "APACHE2_COPY", "APACHE2_UNLESS"),
        "BSD-3-Clause": ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"),
        "GPL-3.0-or-later": ("GPL3_TERMS", "GPL_HOPE"),
        "GPL-2.0-or-later": ("GPL2_TERMS", "GPL_HOPE"),
    }
    texts, wanted = [], []
    for name, parts in notices.items():
        for mark, width in (("", 72), (" * ", 78), ("# ", 70), ("// ", 40)):
            lines = []
            for i, part in enumerate(parts):
                form = licenses.SENTENCES[part][0]
                lines += [*textwrap.wrap(form, width), *([""] if i % 2 else [])]
            texts.append("Copyright 2020 A. Author\r\n\n" + "\n".join((mark + x).rstrip() for x in lines) + "\n\nint main() {}")
            wanted.append((name, list(parts)))
    texts += ["About this work\nMIT License\nCopyright 2020", "no stop before\n# Released under the\n# MIT License.\n# more", "released under the\n\nMIT License is", "\n" * 20000 + "語\n" * 20000 + "Licensed under CC BY 4.0."]
    wanted += [("MIT", ["MIT_REF"]), ("MIT", ["MIT_REF"]), (None, []), ("CC-BY-4.0", ["CC_BY4_REF"])]
    rows = licenses.licence_scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.license, r.sentence_ids) for r in rows] == wanted


def test_every_part_of_a_licence_sentence_counts(spark):
    gpl = licenses.SENTENCES["GPL2_TERMS"][0]
    texts = [gpl, gpl.replace("This program", "Foo"), gpl.replace("version 2", "version 3"), gpl.replace("either version 2 of the License, or (at your option) any later version.", "version 2 of the License."), gpl.replace("version 2", "version 2.1"), gpl.split("either")[0]]
    mpl = licenses.SENTENCES["MPL2_REF"][0]
    texts += [mpl, mpl.replace("2.0", "1.1"), licenses.SENTENCES["GPL3_TERMS"][0]]
    rows = [r.license for r in licenses.licence_scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows == ["GPL-2.0-or-later"] * 2 + [None] * 4 + ["MPL-2.0", None, "GPL-3.0-or-later"]


# ---------------------------------------------------------------- 1


def test_classifier(spark):
    random.seed(4)
    good = [" ".join(random.choice(["stone", "river", "and", "rain."]) for _ in range(random.randrange(20, 60))) for _ in range(150)]
    bad = [" ".join(random.choice(["$$", "|", "AB!!", "%x"]) for _ in range(random.randrange(20, 60))) for _ in range(150)]
    texts = [*good, *bad, *EDGES]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_classifier(frame(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in range(300) if rows[i].held_out]
    assert sum(rows[i].predicted == (i < 150) for i in held) >= 0.97 * len(held)
    assert {r.score for r in quality_classifier(frame(spark, texts), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier(frame(spark, []), labels).count() == 0


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("weights", [[1, 1], [8, 1, 1, 1], [5, 3, 2], [1], [7, 11, 13, 2]])
def test_pfair_deviation_is_below_one_block(weights):
    period = mixing.pfair_period(weights)
    assert sorted(s for x in period for s in x) == list(range(sum(weights)))
    assert mixing.share_bound(period, weights) < 1


def test_mixing(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b" if i < 70 else None) for i in range(77)] + [(3, "a")], "doc_id long, source string")
    rows = mixing.mix(df, {"a": 3}, block_rows=4).collect()
    assert {(r.doc_id, r.source) for r in rows} == {(r.doc_id, r.source) for r in df.collect()}
    slots = collections.defaultdict(set)
    for r in rows:
        slots[r.slot].add((r.source, r.block, r.epoch))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    order = [next(iter(slots[t]))[0] for t in range(len(slots))]
    for t in range(len(order)):
        seen = collections.Counter(order[:t])
        assert all(abs(seen[s] - t * w / 5) < 1 for s, w in (("a", 3), ("b", 1), (None, 1)))
    assert mixing.mix(df.limit(0), {"a": 3}).count() == 0


def test_mixing_by_brute_force_with_clashing_columns(spark):
    """Every source's blocks in turn, as a plain simulation of release times and deadlines gives them."""
    kind = "doc_id long, source string, slot string, epoch int, place string, text string"
    docs = spark.createDataFrame([(i, "abc"[min(i // 20, 2)], "s", 7, None, "x" * (i % 3) * 300_000) for i in range(70)], kind)
    rows = mixing.mix(docs, {"a": 2, "b": 4, "c": 6}, block_rows=4, carry=["slot", "epoch", "place", "text"]).collect()
    assert {(r.carried_slot, r.carried_epoch, r.carried_place, len(r.text or "")) for r in rows} == {("s", 7, None, 300_000 * k) for k in range(3)}
    weights, blocks, had, order = {"a": 1, "b": 2, "c": 3}, {"a": 5, "b": 5, "c": 8}, collections.Counter(), []
    while any(had[s] < n for s, n in blocks.items()):
        t = len(order)
        due = [(-(-(had[s] + 1) * 6 // w), s) for s, w in weights.items() if had[s] * 6 // w <= t]
        order.append(min(due)[1])
        had[order[-1]] += 1
    assert {(r.slot, r.source) for r in rows} == set(enumerate(order))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


def test_ten_thousand_sources_are_planned_at_once():
    weights = [1 + i % 13 for i in range(10_000)]
    period = mixing.pfair_period(weights)
    assert sorted(s for x in period for s in x) == list(range(sum(weights)))
    assert all(abs(k * sum(weights) - w * s) < sum(weights) for x, w in zip(period[:50], weights) for k, s in enumerate(x))


def test_mixing_keeps_the_shares_to_the_end(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('src', id % 20) AS source")
    rows = mixing.mix(docs, {"src0": 8}, block_rows=4).collect()
    assert {r.doc_id for r in rows} == set(range(500))
    order = [s for _, s in sorted({(r.slot, r.source) for r in rows})]
    assert len(order) >= 7 * 27 - 26
    for t in range(len(order) + 1):
        seen = collections.Counter(order[:t])
        assert all(abs(27 * seen[f"src{i}"] - t * (8 if i == 0 else 1)) < 27 for i in range(20))


# ---------------------------------------------------------------- 3


def discounts(counts, most):
    """Katz's formula, written anew: r* / r corrected so that the taken mass is that of the items seen once."""
    of = collections.Counter(counts)
    out = {}
    for r in range(1, most + 1):
        try:
            star, common = (r + 1) * of[r + 1] / of[r], (most + 1) * of[most + 1] / of[1]
            d = (star / r - common) / (1 - common)
        except ZeroDivisionError:
            d, common = 0, 1
        out[r] = d if 0 < d < 1 and common < 1 else 1 - 1 / (2 * r)
    return out


def katz_brute(texts, order, most=5):
    """Recursive back-off over tuples of words: 0 is the begin, None the end, a line break an unknown word."""
    toks = [(zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in enumerate(texts)]
    counts = [collections.Counter() for _ in range(order + 1)]
    for held, x in toks:
        for t in range(0 if not held else len(x), len(x)):
            for k in range(1, order + 1):
                counts[k][(*([0] if t - k + 1 < 0 else []), *x[max(0, t - k + 1) : t + 1])] += 1
    c = collections.Counter({w[0]: k for w, k in counts[1].items()})
    n = sum(c.values())
    d = [None, *[discounts(x.values(), most) for x in counts[1:]]]
    taken = sum(k * (1 - d[1].get(k, 1.0)) for k in c.values())
    units = n if taken > 0 else n + 1
    rest = taken / units if taken > 0 else 1 / units
    after = [collections.defaultdict(list) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g in counts[k]:
            after[k][g[:-1]].append(g[-1])

    @functools.lru_cache(None)
    def weights(k, h):
        total = sum(counts[k][(*h, w)] for w in after[k][h])
        kept = sum(d[k].get(counts[k][(*h, w)], 1.0) * counts[k][(*h, w)] for w in after[k][h])
        bottom = total if total - kept > 1e-9 * total else total + 1
        return bottom, (1 - kept / bottom) / (1 - sum(p(k - 1, shorter(k, h), w) for w in after[k][h]))

    def shorter(k, h):  # histories on level k - 1 have k - 2 words at most
        return h[2 - k :] if k > 2 else ()

    @functools.lru_cache(None)
    def p(k, h, w):
        if k == 1:
            return d[1].get(c[w], 1.0) * c[w] / units if c[w] else rest
        g = (*h, w)
        if not after[k][h]:
            return p(k - 1, shorter(k, h), w)
        bottom, back = weights(k, h)
        return d[k].get(counts[k][g], 1.0) * counts[k][g] / bottom if counts[k][g] else back * p(k - 1, shorter(k, h), w)

    history = lambda x, t: tuple(([0] if t - order + 1 < 0 else []) + x[max(0, t - order + 1) : t])
    if order > 1:
        for h in [*after[order]][:60]:
            assert sum(p(order, h, w) for w in c) + p(order, h, "\n") == pytest.approx(1)
    return {
        i: (held, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in x), sum(math.log10(p(order, history(x, t), w)) for t, w in enumerate(x)))
        for i, (held, x) in enumerate(toks)
    }


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(spark, order):
    random.seed(6)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(0, 30))) for _ in range(60)] + [*EDGES, "a b " * (300_000 if order == 2 else 300)]
    want = katz_brute(texts, order)
    got = {r.doc_id: tuple(r)[1:] for r in katz.katz_scores(frame(spark, texts), order=order, batch_bytes=200, parts=5).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and got[i][4:] == pytest.approx(want[i][4:])
    assert katz.katz_scores(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 4


def repeats_brute(texts, least=200):
    count = collections.Counter()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - least + 1):
            count[b[i : i + least]] += 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("members", [20_000, 3])
def test_suffix_dedup(spark, members):
    random.seed(3)
    text = lambda n: "".join(random.choice("abcdeé \n") for _ in range(n))
    shared = [text(random.choice([150, 199, 200, 201, 230, 400])) for _ in range(8)]
    texts = ["".join(random.choice([text(random.randrange(300)), random.choice(shared), random.choice(shared)[random.randrange(60) :]]) for _ in range(random.randrange(6))) for _ in range(40)]
    texts += [*EDGES[:8], "a" * 1000, "a" * 250, "ab" * 300, texts[3], "z" * 200, "y" * 201, "x\0" * 150]
    ids = [*range(len(texts)), 5]
    texts.append(texts[5])
    old = suffix_dedup.repeated_spans
    try:
        suffix_dedup.repeated_spans = lambda d, **k: old(d, **k, most_members=members)
        got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.without_repeats(frame(spark, texts, ids))).collect())
    finally:
        suffix_dedup.repeated_spans = old
    assert got == sorted((i, *x) for i, x in zip(ids, repeats_brute(texts), strict=True))


def test_maximal_repeats_by_brute_force():
    """All (shared, depth, members) that no common byte extends on either side; nothing else."""
    random.seed(9)
    for _ in range(200):
        n = random.randrange(2, 7)
        before = [bytes(random.choice(b"ab") for _ in range(random.randrange(5))) for _ in range(n)]
        after = [bytes(random.choice(b"ab") for _ in range(1 + random.randrange(5))) for _ in range(n)]
        want = set()
        for shared in range(5):
            for depth in range(1, 6):
                groups = collections.defaultdict(list)
                for i in range(n):
                    if len(before[i]) >= shared and len(after[i]) >= depth:
                        groups[before[i][:shared], after[i][:depth]].append(i)
                for members in groups.values():
                    nexts = [{x[m][k : k + 1] or m for m in members} for x, k in ((before, shared), (after, depth))]
                    if len(members) > 1 and shared + depth >= 2 and all(len(x) > 1 for x in nexts):
                        want.add((shared, depth, tuple(members)))
        found = [(s, d, tuple(sorted(m))) for s, d, m in suffix_dedup.maximal_repeats(before, after, 2)]
        assert len(found) == len(set(found)) and set(found) == want


def test_long_texts_go_by_stretches():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, 5000]), 200, 50)
    parts = suffix_dedup.anchors_of_texts(data, np.array([0, 5000]), 200, 50, stretch=700)
    owned = lambda a: {w: x for x, f, l in zip(a["at"], a["first"], a["last"]) for w in range(f, l + 1)}  # noqa: E741, E731
    assert owned(whole) == owned(parts) and len(owned(whole)) == 4801


def test_suffix_dedup_of_a_text_above_64_mebibytes(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    body = np.random.default_rng(4).integers(33, 126, 68 << 20).astype(np.uint8).tobytes().decode()
    texts = [body + body[7_000_000:7_001_000], body[5000:9000] + "end", None]
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": texts}), str(tmp_path / "d.parquet"))
    cleaned = suffix_dedup.without_repeats(spark.read.parquet(str(tmp_path / "d.parquet")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(cleaned).collect()}
    assert got == {1: ((68 << 20) + 1000, 6000, 3), 2: (4003, 4000, 1), 3: (0, 0, 0)}


# ---------------------------------------------------------------- 5


def classes_brute(texts):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("task", [4_000_000, 400])
def test_jaccard_classes(spark, task):
    random.seed(5)
    vocabulary, texts = [f"w{i}" for i in range(400)], []
    for size in (5, 12, 30, 80, 300):
        start = [random.choice(vocabulary) for _ in range(size)]
        for _ in range(random.choice([2, 5, 25])):
            t = list(start)
            for _ in range(random.randrange(0, max(1, size // 25) + 1)):
                t[random.randrange(size)] = random.choice(vocabulary)
            texts.append(" ".join(t))
    texts += EDGES
    got = sorted(tuple(r) for r in similarity_classes(frame(spark, texts), task_shingles=task).collect())
    assert got == classes_brute(texts)


def families(rng, sizes, members, vocabulary=10**6):
    out = []
    for size, n in zip(sizes, members, strict=True):
        start = rng.integers(0, vocabulary, size)
        for _ in range(n):
            t = start.copy()
            t[rng.integers(0, size, rng.integers(0, max(1, size // 25) + 1))] = rng.integers(0, vocabulary)
            out.append(np.unique(t).astype(np.uint64))
    return out


def linked_brute(sets, percent):
    least = list(range(len(sets)))
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if 100 * len(np.intersect1d(a, sets[j])) >= percent * len(np.union1d(a, sets[j]))]
    for _ in sets:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least


@pytest.mark.parametrize("percent", [90, 80])
def test_a_region_links_through_voronoi_cells(percent):
    """Small regions too: most links come from pivots and their windows, few from leaves."""
    rng, by_pivot, by_scan = np.random.default_rng(2), 0, 0
    for _ in range(15):
        sets = families(rng, rng.integers(20, 200, 3), rng.integers(1, 7, 3))
        region = join.Region(sets, percent)
        region.join(np.arange(len(sets)))
        assert [region.root(i) for i in range(len(sets))] == linked_brute(sets, percent)
        by_pivot, by_scan = by_pivot + region.by_pivot, by_scan + region.by_scan
    assert by_pivot > 2 * by_scan


@pytest.mark.parametrize("percent", [90, 80])
def test_first_pivots_lose_no_link(percent):
    """Any two linked sets share a cell; sets outside all balls that are linked with one inside meet it too."""
    rng = np.random.default_rng(6)
    sets = families(rng, [60, 80, 40, 100, 30], [40, 20, 10, 1, 1])
    pivots = join.Pivots.choose(sets[::3], list(range(0, len(sets), 3)), percent)
    assert len(pivots.sets) >= 3
    size = np.array([len(s) for s in sets])
    whose, pivot, distance, ball = pivots.places(np.concatenate(sets), np.cumsum(size) - size, size, percent)
    cells_of = collections.defaultdict(set)
    for i, j, d, b in zip(whose, pivot, distance, ball):
        cells_of[i].add(j)
        if j >= 0:
            both = len(np.intersect1d(sets[i], pivots.sets[j]))
            assert d == pytest.approx(1 - both / (len(sets[i]) + len(pivots.sets[j]) - both)) and b == (d <= 1 - percent / 100 + 1e-12)
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(np.intersect1d(a, sets[j])) >= percent * len(np.union1d(a, sets[j])):
                assert cells_of[i] & cells_of[j]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_classes_of_a_large_family(spark, width, percent):
    """A family that holds a third of all texts, chained beyond its pivot's ball, and words that a polynomial hash confuses."""
    random.seed(15)
    vocabulary = [f"v{i}" for i in range(3000)]
    start = [random.choice(vocabulary) for _ in range(150)]
    texts = []
    for k in range(60):
        t = list(start)
        for i in range(k % 12):
            t[(7 * i + k) % 150] = random.choice(vocabulary)
        texts.append(" ".join(t))
    texts += [" ".join(random.choice(vocabulary) for _ in range(40)) for _ in range(100)]
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts += [thue, thue.translate(str.maketrans("ab", "ba")), " ".join([texts[0], "x" * 1_500_000]), texts[0].upper()]
    sets = []
    for t in texts:
        w = t.translate(LOWER).split()
        sets.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)]))
    least = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if 100 * len(a & sets[j]) >= percent * len(a | sets[j])]
    for _ in range(len(texts)):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: r.component_id for r in similarity_classes(frame(spark, texts), width=width, percent=percent).collect()}
    assert got == dict(enumerate(least))


def test_links_of_a_batch_become_a_forest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, (2, 300)).astype(np.uint64)
    least = {int(x): int(x) for x in np.r_[a, b]}
    for _ in least:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            least[i] = least[j] = min(least[i], least[j])
    key, root = join.forest(a, b)
    assert dict(zip(key.tolist(), root.tolist(), strict=True)) == {k: v for k, v in least.items() if k != v}
    assert [len(x) for x in join.forest(a[:0], b[:0])] == [0, 0]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_writes_no_table_of_cells(spark, monkeypatch, width, percent):
    rng = random.Random(11)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(40)]
    texts += [" ".join([*t.split()[:-3], "x", "y", "z"]) for t in texts[:20]]
    written = []

    def counted(df):
        out = frames.settle(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(join, "settle", counted)
    got = {r.doc_id: r.component_id for r in similarity_classes(frame(spark, texts), width=width, percent=percent).collect()}
    assert got == {i: i - 40 if i >= 40 else i for i in range(60)}
    assert max(written) <= 3 * len(texts)


def test_jaccard_empty_and_null_ids(spark):
    assert similarity_classes(frame(spark, [])).count() == 0
    rows = sorted(map(tuple, similarity_classes(frame(spark, ["a b c d", "a b c d", "", "x"], [None, 4, None, 2])).collect()), key=str)
    assert rows == sorted([(None, 2, 4), (4, 2, 4), (None, 0, None), (2, 1, 2)], key=str)


# ---------------------------------------------------------------- 6


def test_revisits(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        (1, "response", "http://www.A.org/x/?utm_source=q#f", at(0), 200, {"ETag": '"1"', "Date": "d1", "Server": "s"}, "D1"),
        (2, "response", "https://a.org/x", at(10), 200, {"ETag": '"2"', "Date": "d2"}, "D2"),
        (3, "revisit", "a.org/x", at(5), 304, {"ETag": 'W/"1"', "Date": "d3", "Server": "no"}, None),
        (4, "revisit", "http://a.org/x", at(20), None, {"ETag": '"1"'}, None),
        (5, "revisit", "http://a.org/x", at(20), 304, {}, "D2"),
        (6, "revisit", "http://a.org/x", at(20), 304, None, None),
        (7, "revisit", "http://a.org/y", at(20), 304, {}, None),
        (8, "revisit", None, at(20), 304, {}, None),
        (9, "response", "http://a.org/x", at(19), 500, {}, "D9"),
        (None, "revisit", "http://a.org/x", at(20), 304, {}, None),
        (10, "revisit", "http://a.org/x", at(11), 304, {"etag": '"9"', "ETag": '"2"', "etaG": '"8"', "X": None}, None),
        (11, "response", "http://b.org/", None, 200, {}, "D"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], revisit.RECORD + ", outcome string, url_key int")
    for chunks in (1, 2, 7, None):
        got = {r.record_id: (r.refers_to, r.outcome, r.headers, r.digest) for r in revisit.resolve_revisits(df, chunks=chunks).collect()}
        assert got[3] == (1, "resolved", {"etag": 'W/"1"', "date": "d3", "server": "s"}, "D1")
        assert got[4][:2] == (2, "mismatch") and got[5][:2] == (2, "resolved") and got[6][:2] == (2, "unvalidated")
        assert got[7][1] == got[8][1] == "no_original" and len(got) == 7
        assert got[10][:3] == (2, "resolved", {"etag": '"2"', "date": "d2"})
    assert revisit.resolve_revisits(df.limit(0)).count() == 0


def test_crawl_log_makes_revisits_choose(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    log = revisit.captures_of_pages(pages)
    spellings = log.select("url", revisit.canonical_url(F.col("url")).alias("u"), F.expr("record_id div 8").alias("p")).groupBy("p").agg(F.countDistinct("url").alias("n"), F.countDistinct("u").alias("same"))
    # four to eight records a page; two of the six ways may spell a URL alike
    assert spellings.where("n >= 3 and same = 1").count() == pages.count()
    full = [r for r in log.where("kind = 'response' and status = 200 and captured is not null").select("record_id", revisit.canonical_url(F.col("url")).alias("u"), "captured").collect()]
    when = {r.record_id: r.captured for r in log.collect()}
    rows = revisit.resolve_revisits(log).collect()
    assert len(rows) == 4 * pages.count()
    for r in rows:
        before = [(f.captured, f.record_id) for f in full if f.u == r.url_key and (f.captured, f.record_id) < (when[r.record_id], r.record_id)]
        assert r.refers_to == (max(before)[1] if before else None)
    found = [r for r in rows if r.refers_to is not None]
    assert all(r.refers_to != r.record_id - 1 for r in found) and {r.outcome for r in rows} == {"resolved", "mismatch", "unvalidated", "no_original"}
    # 4 finds 0; 5 finds 2 or 1; 6 and 7 find 3, or 2 or 1 where 3 has lost its time
    assert {r.record_id - r.refers_to for r in found} == {3, 4, 5, 6}


# ---------------------------------------------------------------- 7


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(30)] + [(400, None), (450, [float("nan")] * 6), (500, [None] * 6), (None, [0.1] * 6), (600, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 7, "x", 0) for r in rows], "vec_id long, embedding array<float>, rank int, query_id string, block int")
    got = [tuple(r) for r in topk.top_k(table.repartition(3), block=4, bins=7).orderBy("query_id", "rank").collect()]
    fit = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows[:150]]
    want = []
    for i, q in fit:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in fit if j != i))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_segments_give_the_library_s_ids():
    """Random Unicode, white space of all kinds and added tokens."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    random.seed(12)
    pieces = ["stone", " ", "  ", "\n", "\n\n", "\t", "ü", "'s", "don't", "1", "x1", "\r\n", "\u00a0", "\u3000", "語", "<|endoftext|>", "é", "\u2003", "—", "🙂", "\x1c", "\x85", "_", "٣", "\x00", "e\u0301", "\u200b"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(12))) for _ in range(5000)]
    texts += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0xA0, 0x600), random.randrange(0x3000, 0x30FF), 10, 32])) for _ in range(random.randrange(40))) for _ in range(5000)]
    texts += ["word, another\n" * 90_000, None]
    got = packing.PieceCoder(tokenizer_path()).encode(pa.array(texts))
    tok = Tokenizer.from_file(tokenizer_path())
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(spark):
    from tokenizers import Tokenizer

    random.seed(1)
    texts = [" ".join(random.choice(["stone", "über", "x1", "don't", "  y", "\n\nz", "<|endoftext|>"]) for _ in range(random.randrange(0, 900))) for _ in range(40)] + EDGES
    rows = packing.pack(frame(spark, texts), tokenizer_path(), capacity=256).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    ids = [[*e.ids, 0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for i, x in enumerate(ids):
        lengths = [r.length for r in sorted(by_doc[i], key=lambda r: r.piece)]
        assert sum(lengths) == len(x) and all(n == 256 for n in lengths[1:]) and lengths[0] <= 256
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_bin) <= -(-sum(map(len, ids)) // 256) + 2
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_minimum_bin_slack_packs_all():
    counts = {7: 3, 5: 4, 3: 5, 2: 1, 10: 2}
    bins = packing.minimum_bin_slack(counts, 10)
    used = collections.Counter()
    for times, lengths in bins:
        assert sum(k * n for k, n in lengths.items()) <= 10
        for k, n in lengths.items():
            used[k] += n * times
    assert used == counts and sum(t for t, _ in bins) == 8


def test_balls_that_meet_in_a_class(spark):
    """Pivots 10, 20, 30: a set near 10 is of one class with a set near 20; 30 stays apart, and so do the classes without pivots."""
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (30, 30), (40, 40), (41, 40)], "key long, class long")
    balls = spark.createDataFrame([(10, 10), (20, 20), (30, 30), (1, 10), (2, 20), (5, 20), (6, 30)], "a long, b long")
    pivots = join.Pivots([np.array([k], np.uint64) for k in (10, 20, 30)], [10, 20, 30])
    classes, labels = join._with_balls(found, balls, pivots)
    got = {r.key: r["class"] for r in classes.collect()}
    assert classes.count() == len(got) == 10
    assert {got[k] for k in (1, 2, 3, 5, 10, 20)} == {10} and {got[6], got[30]} == {30} and {got[40], got[41]} == {40}
    assert labels == [10, 30]
    none, labels = join._with_balls(found, balls.limit(0), join.Pivots([], []))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, found.collect())) and labels == []
