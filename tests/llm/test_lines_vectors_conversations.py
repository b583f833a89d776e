"""Line dedup, whitening and conversation repair against brute force, on nulls, ties, copies, empty and long texts, empty tables and clashing columns."""

import collections
import functools
import itertools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("blockwood.llm")

from blockwood.llm import conversations, line_dedup, whitening  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 11


def lines_by_brute_force(rows, least_chars=20, least_docs=3):
    holders = collections.defaultdict(set)
    low = (0, 0)
    name = lambda i: low if i is None else (1, i)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(name(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key(x)) < least_chars or len(h := holders[key(x)]) < least_docs or max(h) == name(i)]
        out.append((i, len(every), len(every) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=str)


def line_rows(spark, rows):
    kind = "doc_id long, text string, n_lines string, keep string, doc long, h0 string, _text string, line int"
    docs = spark.createDataFrame([(i, t, "x", "y", 7, "z", "w", 1) for i, t in rows], kind).repartition(3)
    return sorted((tuple(r) for r in line_dedup.digest(line_dedup.without_shared_lines(docs, line_dedup.line_bitmaps(docs))).collect()), key=str)


def test_lines(spark):
    random.seed(4)
    pool = ["a shared line of some length", "  A Shared Line OF some length\t", "short", "", "É" * 20, "é" * 20, "x" * 19, "y" * 20, "\x1f" + "k" * 19, "another one, seen by a few docs\r"]
    texts = ["\n".join(random.choice(pool) + random.choice(["", "", str(random.randrange(4))]) for _ in range(random.randrange(0, 12))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "y" * 20), (None, None), (None, "y" * 20), (200, None), (201, ""), (202, "\n"), (203, "\n".join(["y" * 20] * 200)), (204, "z" * 20 + "\n" + "q" * 2_000_000), (205, "\n".join(f"line number {i} of a long text" for i in range(60_000)))]
    rows += [(300 + k, "\n".join(f"line number {i} of a long text" for i in range(k, 60_000, 7))) for k in range(2)]
    assert line_rows(spark, rows) == lines_by_brute_force(rows)
    assert line_rows(spark, []) == []
    assert line_rows(spark, [(None, "y" * 20)] * 5) == lines_by_brute_force([(None, "y" * 20)] * 5)


def test_lines_of_a_hot_key(spark):
    """One line in every document: its rows are dealt in salted parts."""
    rows = [(i, f"the very same line in each document\nline {i} that no other has {i}") for i in range(3000)]
    assert line_rows(spark, rows) == lines_by_brute_force(rows)


def test_line_bitmaps(spark):
    rows = [(i, "\n".join(["a line that is in all of them"] * 3 + [f"own line of document number {i}"] * 70)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: r for r in line_dedup.line_bitmaps(docs).collect()}
    assert set(found) == {0, 1, 2} and all(r.n_dropped == 3 for r in found.values())
    assert all([(w.word, w.bits & (1 << 64) - 1) for w in r.keep] == [(0, (1 << 64) - 8)] for r in found.values())  # the second word keeps all and is not there


# ---------------------------------------------------------------- 12


def whitened_by_brute_force(vectors, most=32):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    w = np.array([[float(Fraction(c, n)) for c in r] for r in z]) @ q / np.sqrt(e)
    return n, [sum(c * c for c in r) for r in z], w, e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.normal(size=(90, 6)) * [5, 1, 1, 0.5, 2, 30] + [0, 1e3, -50, 0, 0, 1]]
    vectors += vectors[:7]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows = [(i, v, "a", 1) for i, v in enumerate([*vectors, *odd])] + [(None, vectors[0], "a", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int").repartition(4)
    n, dev, w, share = whitened_by_brute_force([*vectors, vectors[0]])
    got = {(r.vec_id, r.component): r for r in whitening.by_component(whitening.whiten(df)).collect()}
    assert len(got) == n * 6 and n == 98
    names = [*range(97), None]
    for c in range(6):
        mine = np.array([got[i, c + 1].whitened for i in names])
        sign = np.sign(mine @ w[:, c])
        assert np.allclose(mine, sign * w[:, c], rtol=0, atol=1e-9)
        assert all(abs(got[i, c + 1].explained / share[c] - 1) < 1e-10 for i in names)
    assert [got[i, 1].deviation for i in names] == dev
    assert {r.n for r in got.values()} == {n} and len({r.identity_error for r in got.values()}) == 1
    assert next(iter(got.values())).identity_error < 1e-12
    first = df.select("vec_id", "embedding")
    assert whitening.whiten(first.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [len(r.whitened) for r in whitening.whiten(same).collect()] == [0] * 5  # no variance, no component
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>"))


def test_double_doubles():
    """Sums of outer products that cancel in doubles: equal to rational arithmetic to 30 digits."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 3)) * 1e6) + rng.integers(-3, 3, (300, 3)) * 2.0**40
    centre = [Fraction(int(x[:, j].sum()), 300) for j in range(3)]
    high = np.array([float(c) for c in centre])
    low = np.array([float(c - Fraction(h)) for c, h in zip(centre, high.tolist(), strict=True)])
    h, rest = whitening.outer_sums(x, high, low)
    i, j = np.triu_indices(3)
    for k in range(6):
        exact = sum((Fraction(r[i[k]]) - centre[i[k]]) * (Fraction(r[j[k]]) - centre[j[k]]) for r in x.tolist())
        assert abs(Fraction(float(h[k])) + Fraction(float(rest[k])) - exact) <= abs(Fraction(1, 10**24) * Fraction(2**80) * 300 * Fraction(1, 10**3))
    e, q = whitening.components(np.diag([1.0, 1e-12, 1e6]).astype(np.longdouble))
    assert np.allclose(e.astype(float), [1e6, 1, 1e-12], rtol=1e-12) and np.allclose(np.abs(q.astype(float)), np.eye(3)[:, [2, 0, 1]])


# ---------------------------------------------------------------- 13


def repairs_by_brute_force(rows):
    """The damage and, by dynamic programming over suffixes, the cheapest edits."""
    by = {}
    for c, t, r, x in rows:
        mine = by.setdefault(c, [])
        r, x = (" " if v is None else v for v in (r, x))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else re.sub(r"[.!?]", "", x) if code == 2 else x
        mine += [(t, "user" if code == 4 else r, x)] * {0: 0, 3: 2}.get(code, 1)
    out = {}
    for c, v in by.items():
        v.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, fault = set(), []
        for _, r, x in v:
            fault.append("b" if not WORD.search(x) else "d" if (r, x) in seen else "" if WORD.findall(x)[-1] in ".!?" else "t")
            seen.add((r, x))
        turns = [t for t, _, _ in v if t is not None]

        @functools.cache
        def best(i, state, inserted, v=tuple(v), fault=tuple(fault)):
            found = [(0, "", ())] if i == len(v) and state != 2 else []
            after, role = {0: (2, "user"), 1: (2, "user"), 2: (1, "assistant")}[state]
            if inserted < 2 and (k := best(i, after, inserted + 1)):
                found.append((3 + k[0], "I" + k[1], ((role, ""), *k[2])))
            if i < len(v):
                _, r, x = v[i]
                if k := best(i + 1, state, 0):
                    found.append((4 + k[0], "D" + k[1], k[2]))
                if fault[i] not in ("b", "d"):
                    late = 3 * (fault[i] == "t")
                    for to, ok, cost, edit, name in ((1, state == 0 and r[:1] == "s", 0, "K", r), (after, r[:1] == role[0], 0, "K", r), (after, True, 3, "R", role)):
                        if ok and (k := best(i + 1, to, 0)):
                            found.append((cost + late + k[0], edit + k[1], ((name, x), *k[2])))
            return min(found, key=lambda z: z[:2]) if found else None

        cost, audit, left = best(0, 0, 0) if v else (0, "", ())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        out[c] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in left)))
    return out


def repairs(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "conv_id long, turn long, role string, text string, audit string, piece int, code string").repartition(3)
    return {r[0]: tuple(r)[1:] for r in conversations.digest(conversations.repaired(conversations.damaged(df), present="present", **more)).collect()}


ROLES = ["system", "user", "assistant", "tool", "", None, "sys", "User", "agent"]
TEXTS = ["a.", "b", "c!", "", None, " \t", "d?", "e. ", "f\n", "é.", "\x1f", "."]


def test_conversations(spark):
    random.seed(6)
    rows = [(random.choice([None, *range(150)]), random.choice([None, *range(20)]), random.choice(ROLES), random.choice(TEXTS)) for _ in range(1500)]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)] + [(901, 1, "user", "long " * 300_000 + "."), (902, 0, None, None)]
    rows += [(None, None, None, None)] * 3
    assert repairs(spark, rows) == repairs_by_brute_force(rows)
    assert repairs(spark, []) == {}
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repairs(spark, [(dropped, 0, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", sha(""))}


def test_conversation_in_stretches(spark):
    """One conversation holds most rows: parsed in stretches, with repeats far apart, gaps and nulls at their borders."""
    random.seed(7)
    text = lambda i: (random.choice(TEXTS) or "") + (str(i % 61) if i % 4 else "") + random.choice([".", ""])
    rows = [(1 if i % 5 else random.choice([None, 2, 3]), None if i % 50 == 0 else i // 2 + 3 * (i // 40), random.choice(ROLES[:4]), text(i)) for i in range(330)]
    want = repairs_by_brute_force(rows)
    assert repairs(spark, rows, most_rows=40) == want and repairs(spark, rows) == want


def test_long_conversation_in_blocks():
    """The parse block by block is that of the whole chart."""
    random.seed(8)
    signs = "".join(random.choice("suaxSUAd") for _ in range(700))
    whole = conversations.then(conversations.START, {e: conversations.parsed(signs, e) for e in conversations.START})
    assert conversations.after_rows(conversations.START, signs) == whole


def repair_by_language(roles, late):
    """The cheapest edits over every string of the language s?(ua)+ or nothing, up to a length that no cheapest repair exceeds."""
    found = []
    for target in ["", *(head + "ua" * k for k in range(1, len(roles) + 2) for head in ("", "s"))]:
        table = {(0, 0): (0, "")}
        for i in range(len(roles) + 1):
            for j in range(len(target) + 1):
                ways = [(0, "")] if (i, j) == (0, 0) else []
                if i and (i - 1, j) in table:
                    ways.append((table[i - 1, j][0] + 4, table[i - 1, j][1] + "D"))
                if j and target[j - 1] != "s" and (i, j - 1) in table:
                    ways.append((table[i, j - 1][0] + 3, table[i, j - 1][1] + "I"))
                if i and j and (i - 1, j - 1) in table and (roles[i - 1] == target[j - 1] or target[j - 1] != "s"):
                    cost, audit = table[i - 1, j - 1]
                    kept = roles[i - 1] == target[j - 1]
                    ways.append((cost + 3 * (not kept) + 3 * late[i - 1], audit + ("K" if kept else "R")))
                if ways:
                    table[i, j] = min(ways)
        if (len(roles), len(target)) in table:
            found.append(table[len(roles), len(target)])
    return min(found)


def test_what_repairs_leave():
    """Nothing, or at least one pair: a system turn alone does not stay (contract of op13: (s?(ua)+)?)."""
    for n in range(1, 5):
        for signs in map("".join, itertools.product("suaxSA", repeat=n)):
            got = conversations.accepted(conversations.after_rows(conversations.PAIRED, signs))
            assert got == repair_by_language(signs.lower(), [s.isupper() for s in signs]), signs


def test_system_turn_alone(spark, tmp_path):
    from blockwood.llm.queries import op13_conversation_repair

    alone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    pair = next(c for c in range(3000, 4000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(alone, 0, "system", "a."), (pair, 0, "system", "a."), (pair, 1, "user", "b.")]
    want = {alone: (0, 0, 0, 0, 0, 4, "D", sha("")), pair: (0, 0, 0, 0, 0, 3, "KKI", sha("system:a.\nuser:b.\nassistant:"))}
    path = tmp_path / "conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(path))
    assert {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()} == want
    long_ = [(pair, t, "system" if t == 0 else "user", "" if t else "a.") for t in range(90)]
    kept = next(c for c in repairs(spark, long_, most_rows=20, lone_system=False).values())
    assert kept == next(c for c in repairs(spark, long_, lone_system=False).values()) and "K" not in kept[6]
    assert "K" in next(c for c in repairs(spark, long_, most_rows=20).values())[6]
