"""Removal of repeated byte strings through an enhanced suffix array, cut into small parts.

A string of ``least`` bytes (a window) is *owned* by its anchor: the leftmost of its
``GRAM``-byte grams with the smallest hash.  Equal windows have their anchors at the same place, so a
window repeats exactly if it repeats among the contexts (the stretch of owned windows) of
equal anchors.  The suffix array of the corpus thus falls apart into one sparse suffix array
for each group of contexts: sorted by what follows the anchor, with the common prefixes of
neighbours, whose common-prefix intervals a stack scan lists.  Inside an interval the
members' left sides form such intervals again.  A repeat is reported, with all its occurrences, where
the members' extensions differ on both sides: it is maximal, and every shorter one lies in it.

Contexts are known by hashes of 96 bits together and texts by 128; groups that only propose
comparisons by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..frames import discard, sweep
from .common import by_group, byte_batches, mixed, powers, settle, text_buffer

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSE = {b: pow(b, -1, 1 << 64) for b in _BASES}
_STRETCH = 8 << 20  # longer texts are cut into stretches of so many windows
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def rolling(data: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``spans`` turns two of them into the hash of a (short) stretch."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), out=total[1:])
    return total


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    return mixed((total[end] - total[start]) * powers(len(total), _INVERSE[base])[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima inside blocks from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all texts: text number, place, first and last owned window start, and hashes.

    ``context`` and ``more``: of the anchor and all bytes of its windows, with the place of the anchor among them; ``left`` and
    ``right``: of the gram with the bytes that a window reaching mostly to that side
    holds (0 where no owned window does).
    """
    names = ("text", "at", "first", "last", "context", "more", "left", "right")
    none = {k: np.zeros(0, np.int64 if k in names[:4] else np.uint64) for k in names}
    n = len(data)
    if n < least:
        return none
    total = rolling(data)
    grams = np.arange(n - gram + 1)
    code = spans(total, grams, grams + gram)
    low = np.uint64((1 << 26) - 1)
    assert n <= int(low)
    ranked = (code & ~low) | grams.astype(np.uint64)  # ties: the leftmost
    owner = (sliding_least(ranked, least - gram + 1) & low).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(owner)), side="right") - 1
    inside = np.arange(len(owner)) + least <= offsets[text + 1]
    start, owner, text = np.flatnonzero(inside), owner[inside], text[inside]
    if not len(start):
        return none
    new = np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(start)] - 1
    first, last, at, text = start[head], start[tail], owner[head], text[head]
    half = (least - gram + 1) // 2
    context = mixed(spans(total, first, last + least) + mixed((at - first).astype(np.uint64)) * _ODD[0])
    more = mixed(spans(rolling(data, _BASES[1]), first, last + least, _BASES[1]) + mixed((at - first).astype(np.uint64)) * _ODD[1]) >> np.uint64(33)
    reach_left, reach_right = at - first >= half, least - gram - (at - last) >= half
    left = np.zeros(len(at), np.uint64)
    left[reach_left] = mixed(spans(total, at[reach_left] - half, at[reach_left] + gram) ^ _ODD[1])
    right = np.zeros(len(at), np.uint64)
    right[reach_right] = mixed(spans(total, at[reach_right], at[reach_right] + gram + half) ^ _ODD[2])
    base = offsets[text]
    return dict(zip(names, (text, at - base, first - base, last - base, context, more, left, right), strict=True))


def runs(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of neighbours in one text with equal contexts, as periodic stretches have them.

    Neighbouring anchors own neighbouring windows, so a run covers one stretch of its text; if it is longer than one, its context repeats by itself.
    """
    n = len(a["text"])
    same = np.zeros(n + 1, bool)
    if n:
        same[1:n] = np.logical_and.reduce([a[k][1:] == a[k][:-1] for k in ("text", "context", "more")])
    return np.flatnonzero(~same[:n]), np.flatnonzero(~same[1:])


def anchors_of_texts(data: np.ndarray, offsets: np.ndarray, least: int, gram: int, stretch: int = _STRETCH) -> dict[str, np.ndarray]:
    """``anchors``; a text of more than ``stretch`` windows goes stretch by stretch, each with the bytes that its last window reaches."""
    if len(data) <= stretch + least - 1 or len(offsets) != 2:
        return anchors(data, offsets, least, gram)
    parts = []
    for at in range(0, len(data) - least + 1, stretch):
        some = data[at : at + stretch + least - 1]
        part = anchors(some, np.array([0, len(some)]), least, gram)
        parts.append(part | {k: part[k] + at for k in ("at", "first", "last")})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


# ---------------------------------------------------------------- one group of contexts


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_intervals(lcp: list[int], root: bool = False) -> Iterator[tuple[int, int, int]]:
    """(depth, from, to) of every node of the common-prefix interval tree; lcp[i] belongs to sorted neighbours i-1 and i.

    The root of depth 0, which holds all if some neighbours share nothing, only on request.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth, start = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > depth:
            top, start = stack.pop()
            if top > 0 or root and 0 in lcp[1:]:
                yield top, start, i - 1
        if depth > 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after the anchor, members) of all maximal repeats of ``least`` bytes or more around one anchor.

    Members are contexts: what precedes the anchor (reversed) and what begins with it.  The
    tree of the right sides is scanned from a stack; the left sides of a node's members
    form a tree of their own, whose nodes cannot be extended to the left (they branch there).  Of these only those are
    reported whose members differ to the right as well, that is, lie in more than one child of the right node.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    lcp = [0] + [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    place = {m: i for i, m in enumerate(sorted(range(len(before)), key=before.__getitem__))}
    longest = max(map(len, before))
    for depth, low, high in prefix_intervals(lcp):
        if depth + longest < least:
            continue
        child, number = {}, 0
        for i in range(low, high + 1):
            number += i > low and lcp[i] == depth
            child[order[i]] = number
        members = sorted(order[low : high + 1], key=place.__getitem__)
        back = [0] + [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:])]
        for shared, a, b in prefix_intervals(back, root=True):
            if shared + depth >= least and len({child[m] for m in members[a : b + 1]}) > 1:
                yield shared, depth, members[a : b + 1]


def _joined(groups: DataFrame, least: int) -> DataFrame:
    """Covered stretches, relative to the anchor, of the contexts of each group."""

    def each(ctx: list[int], more: list[int], before: list[bytes], after: list[bytes]) -> list[tuple[int, int, int, int]]:
        take = list({c: i for i, c in enumerate(zip(ctx, more))}.values())
        names, before, after = [(ctx[i], more[i]) for i in take], [before[i][::-1] for i in take], [after[i] for i in take]
        best: dict[tuple[int, int], int] = {}
        for shared, depth, members in maximal_repeats(before, after, least):
            for m in members:
                best[m, depth] = max(shared, best.get((m, depth), 0))
        return [(*names[m], shared, depth) for (m, depth), shared in best.items()]

    return by_group(groups, "group", ["context", "more", "before", "after"], each, "context long, more int, back int, ahead int", [pa.int64(), pa.int32(), pa.int32(), pa.int32()])


# ---------------------------------------------------------------- the operator


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = 50, most_members: int = 20_000) -> DataFrame:
    """Byte stretches of every distinct text that a string of ``least`` bytes found elsewhere covers: ``text_key``, ``text_more``, ``from``, ``to`` (not merged).

    A text is known by two hashes (``text_codes``).  Matches never cross texts; a string that overlaps its other
    occurrence counts.  Null and short texts have none.  A text that occurs in several rows is covered as a whole.
    Texts of any length are read whole.  Periodic stretches (a repeated byte, rules of tables) count as one run, not as an anchor for each period.
    """
    ship(docs.sparkSession)
    if least - gram >= 1 << 15:
        raise ValueError("windows are at most 32,767 bytes longer than grams")
    rows = docs.where(F.length(text) > 0).select(F.col(text).alias("_text"), *text_codes(F.col(text)), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row_key"))
    # place: of the anchor, 31 bits; what its windows reach before it and their number, 15 bits each; whether the text has copies.
    # uid: number of a text in the scan; a row without a place says which text that is, or, without that as well, which stretch (left to right) a run covers
    schema = "uid long, place long, context long, more int, left long, right long, text_key long, text_more long, row_key long"
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 36
        for batch in byte_batches(batches, "_text", 2 << 20):
            both = np.stack([np.asarray(batch.column(n)) for n in ("text_key", "text_more")], axis=1)
            _, once, many = np.unique(both, axis=0, return_index=True, return_counts=True)
            order = np.argsort(once)
            once, many = once[order], many[order]
            some = batch.take(pa.array(once))
            a = anchors_of_texts(*text_buffer(some.column("_text")), least, gram)
            head, tail = runs(a)
            again, ends = tail > head, a["last"][tail] + least
            a = {k: v[head] for k, v in a.items()}
            t, uid = a["text"], seen + np.arange(len(once))
            seen += len(once)
            signed = lambda n: pa.array(a[n].view(np.int64))  # noqa: B023, E731
            place = a["at"] << 31 | (a["at"] - a["first"]) << 16 | (a["last"] - a["first"]) << 1 | ((many > 1)[t] | again)
            yield pa.RecordBatch.from_arrays([pa.array(uid[t]), pa.array(place), signed("context"), pa.array(a["more"].astype(np.int32)), signed("left"), signed("right"), *[pa.nulls(len(t), pa.int64())] * 3], names=names)
            if n := int(again.sum()):
                yield pa.RecordBatch.from_arrays([pa.array(uid[t[again]]), *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.int32()), pa.array(a["first"][again]), pa.array(ends[again]), *[pa.nulls(n, pa.int64())] * 3], names=names)
            n = len(once)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 2, *[some.column(c) for c in ("text_key", "text_more", "row_key")]], names=names)

    scanned = settle(rows.mapInArrow(scan, schema))
    found = scanned.where("place is not null").select("uid", "place", "context", "more", "left", "right")
    known = scanned.where("place is null and row_key is not null").select("uid", "text_key", "text_more", "row_key")
    at = F.shiftright("place", 31)
    first = (at - F.shiftright(F.col("place").bitwiseAND((1 << 31) - 1), 16)).cast("int")
    last = (first + F.shiftright(F.col("place").bitwiseAND((1 << 16) - 1), 1)).cast("int")
    at = at.cast("int")
    # a context that occurs twice: all its windows repeat
    by_context = found.groupBy("context", "more").agg(
        F.min(F.struct("uid", "place", "left", "right")).alias("one"),
        ((F.max(F.col("place").bitwiseAND(1)) > 0) | (F.count(F.lit(1)) > 1)).alias("twice"),
    )
    by_context = settle(by_context.select("context", "more", "twice", "one.*"))
    sweep(docs.sparkSession)
    whole = by_context.where("twice").select("context", "more", (at - first).alias("back"), (last + least - at).alias("ahead"))
    # contexts that differ but share the gram and half of a window beside it
    sides = by_context.select("context", "more", F.posexplode(F.array("left", "right")).alias("side", "group")).where("group <> 0")
    name = F.struct("context", "more")
    shared = sides.groupBy("group").agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("group", "members")
    sides = settle(sides.join(shared, "group"))
    wanted = sides.select("context", "more").distinct().join(by_context, ["context", "more"])
    wanted = wanted.groupBy("uid").agg(F.collect_list(F.struct("context", "more", at.alias("at"), first.alias("first"), last.alias("last"))).alias("parts"))
    whose = ["row_key", "text_key", "text_more"]
    # rows equal in key and text are each other's copies: one of them serves all of its parts
    texts = rows.select(*whose, "_text").join(wanted.join(known, "uid"), whose).select("_text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "_text", 2 << 20):
            for body, parts in zip(batch.column("_text").cast(pa.large_binary()), batch.column("parts").to_pylist(), strict=True):
                body = memoryview(body.as_buffer())
                for k in range(0, len(parts), 20_000):
                    out: dict[str, list] = {"context": [], "more": [], "before": [], "after": []}
                    for p in parts[k : k + 20_000]:
                        out["context"].append(p["context"])
                        out["more"].append(p["more"])
                        out["before"].append(bytes(body[p["first"] : p["at"]]))
                        out["after"].append(bytes(body[p["at"] : p["last"] + least]))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=list(out))

    contexts = texts.mapInArrow(cut, "context long, more int, before binary, after binary").dropDuplicates(["context", "more"])
    grouped = settle(contexts.join(sides, ["context", "more"]))
    sweep(docs.sparkSession)
    parts = _joined(grouped.where(F.col("members") <= most_members), least)
    if grouped.where(F.col("members") > most_members).limit(1).count():
        parts = parts.unionByName(_split_groups(grouped.where(F.col("members") > most_members).drop("members"), least, gram, most_members))
    covered = settle(whole.unionByName(parts).distinct())
    discard(by_context, sides, grouped)
    sweep(docs.sparkSession)
    out = found.select("uid", "context", "more", at.alias("at")).join(covered, ["context", "more"])
    out = out.select("uid", (F.col("at") - F.col("back")).alias("from"), (F.col("at") + F.col("ahead")).alias("to"))
    out = out.unionByName(scanned.where("place is null and row_key is null").select("uid", F.col("left").cast("int").alias("from"), F.col("right").cast("int").alias("to")))
    return out.join(known, "uid").select("text_key", "text_more", "from", "to")


def text_codes(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a text."""
    return F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_more")


def _split_groups(grouped: DataFrame, least: int, gram: int, most_members: int) -> DataFrame:
    """Covered stretches of contexts in groups too large for one task.

    A group shares ``a`` bytes before and ``b`` bytes after the gram; a window needs ``rest``
    more, at least half of them (rounded up) on one side.  So members are dealt again by that many more
    bytes on the left and on the right, and groups of one context are left; when nothing
    is missing a group shares a whole window and each member is covered by it.
    """
    half = (least - gram + 1) // 2
    left_side = F.col("side") == 0
    rows = grouped.select("context", "more", "before", "after", "group", F.when(left_side, half).otherwise(0).alias("a"), F.when(left_side, 0).otherwise(half).alias("b"))
    out = None
    while True:
        rest = F.lit(least - gram) - F.col("a") - F.col("b")
        more = F.ceil(rest / 2).cast("int")
        left = rows.withColumn("a", F.col("a") + more).where(F.length("before") >= F.col("a"))
        right = rows.withColumn("b", F.col("b") + more).where(F.length("after") >= gram + F.col("b"))
        rows = left.unionByName(right)
        string = F.concat(F.expr("substring(before, length(before) - a + 1, a)"), F.expr(f"substring(after, 1, {gram} + b)"))
        rows = rows.withColumn("group", F.xxhash64("a", "b", string)).dropDuplicates(["context", "more", "group", "a", "b"])
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        rows = settle(rows.join(sizes, "group"))
        done = rows.where(F.col("a") + F.col("b") >= least - gram).select("context", "more", F.col("a").alias("back"), (F.col("b") + gram).alias("ahead"))
        small = rows.where((F.col("a") + F.col("b") < least - gram) & (F.col("members") <= most_members))
        part = done.unionByName(_joined(small, least))
        out = part if out is None else out.unionByName(part)
        rows = rows.where((F.col("a") + F.col("b") < least - gram) & (F.col("members") > most_members)).drop("members")
        if not rows.limit(1).count():
            return out


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 200, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its repeated bytes removed: ``key``, ``carry``, ``n_bytes``, ``spans`` (maximal removed stretches), ``kept`` (binary) and ``kept_text`` (the same as text, without
    the bytes of characters that a cut left incomplete).

    Removes each UTF-8 byte covered by a ``least``-byte string that also starts elsewhere, in
    the same text or another; judged on the input, so all occurrences go.  Null is empty; texts
    below ``least`` bytes stay whole.  Repeated rows are each other's copies.
    """
    carry = carry or []
    names = [key, *[c for c in carry if c != key]]
    named = {f"_c{i}": c for i, c in enumerate(names)}
    covered = repeated_spans(docs, key=key, text=text, least=least).groupBy("text_key", "text_more").agg(F.collect_set(F.struct("from", "to")).alias("_found"))
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(covered, [a == F.col(b) for a, b in zip(text_codes(F.col("_text")), ("text_key", "text_more"))], "left").drop("text_key", "text_more")
    kinds = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in named)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "_text", 2 << 20):
            size, spans_, kept = [], [], []
            for body, found in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_found").to_pylist(), strict=True):
                gone = merged([(f["from"], f["to"]) for f in found or []])
                at, rest = 0, []
                for a, b in gone:
                    rest.append(body[at:a])
                    at = b
                rest.append(body[at:])
                size.append(len(body))
                spans_.append([{"from": a, "to": b} for a, b in gone])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in named], pa.array(size, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                names=[*named, "n_bytes", "spans", "kept", "kept_text"],
            )

    out = rows.mapInArrow(cut, f"{kinds}, n_bytes long, spans array<struct<from:int,to:int>>, kept binary, kept_text string")
    return out.select(*[F.col(n).alias(c) for n, c in named.items()], "n_bytes", "spans", "kept", "kept_text")


def digest(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["to"] - x["from"]))
    return cleaned.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
