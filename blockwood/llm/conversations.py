"""Repair of conversations whose roles do not alternate, by error-correcting Earley parsing."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import by_group, settle

# ---------------------------------------------------------------- the grammar and its chart

# a conversation: nothing, or maybe a system turn and then at least one pair of user and assistant, or (if ``lone_system``) a system turn alone.
# Terminals are the roles' initials.
RULES = (("conversation", ()), ("conversation", ("pairs",)), ("pairs", ("head", "u", "a")), ("pairs", ("pairs", "u", "a")), ("head", ()), ("head", ("s",)), ("conversation", ("s",)))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_ALONE = (6, 0, 0)
_WHOLE = ((0, 0, 0), (1, 1, 0), (6, 1, 0))
_BLOCK = 256

Item = tuple[int, int, int]  # rule, dot, origin
Weight = tuple[int, str]  # cost, audit


def closed(kernel: dict[Item, Weight], first: dict[Item, Weight] | None, at: int) -> dict[Item, Weight]:
    """The chart's set at position ``at``: kernel items with what prediction, completion and insertion derive, cheapest first.

    Of two derivations of an item the lesser (cost, audit) stays.  That is exact: both audits cover the same rows, so if
    one began the other, the longer one would have more insertions and cost more; whatever follows keeps their order.
    """
    heap = [(w, item) for item, w in kernel.items()]
    heapq.heapify(heap)
    done: dict[Item, Weight] = {}
    while heap:
        w, item = heapq.heappop(heap)
        if item in done:
            continue
        done[item] = w
        rule, dot, origin = item
        left, right = RULES[rule]
        if dot == len(right):  # complete: those who waited for it go on
            for (r, k, o), p in list((done if origin == at else first).items()):
                if RULES[r][1][k : k + 1] == (left,):
                    heapq.heappush(heap, ((p[0] + w[0], p[1] + w[1]), (r, k + 1, o)))
        elif right[dot] in "ua":
            heapq.heappush(heap, ((w[0] + INSERT, w[1] + "I"), (rule, dot + 1, origin)))
        elif right[dot] != "s":  # predict
            for r, (symbol, _) in enumerate(RULES):
                if symbol == right[dot]:
                    heapq.heappush(heap, ((0, ""), (r, 0, at)))
            for (r, k, o), p in list(done.items()):  # may have been completed here already
                if o == at and k == len(RULES[r][1]) and RULES[r][0] == right[dot]:
                    heapq.heappush(heap, ((w[0] + p[0], w[1] + p[1]), (rule, dot + 1, origin)))
    return done


_FIRST = closed(dict.fromkeys(((0, 0, 0), (1, 0, 0), _ALONE), (0, "")), None, 0)


def _waits(item: Item) -> bool:
    """Whether an item can take rows: a terminal is next, or the conversation is whole and rows are deleted after it."""
    rule, dot, _ = item
    right = RULES[rule][1]
    return item in _WHOLE or right[dot : dot + 1] in (("s",), ("u",), ("a",))


ENTRIES = tuple(i for i in sorted({*_FIRST, *_WHOLE}) if _waits(i))


@functools.lru_cache(maxsize=1 << 14)
def parsed(signs: str, entry: Item) -> dict[Item, Weight]:
    """Weights of the items that take rows after ``signs``, from one such item before them (both sets closed).

    A sign is a row's initial (x: another one), upper case if the row is truncated, or d if it has to go.
    """
    items = closed({entry: (0, "")}, _FIRST, -1)
    for sign in signs:
        after: dict[Item, Weight] = {}

        def put(item: Item, cost: int, audit: str, after=after) -> None:
            if item not in after or (cost, audit) < after[item]:
                after[item] = (cost, audit)

        late = TRUNCATED if sign.isupper() else 0
        for item, (cost, audit) in items.items():
            if not _waits(item):
                continue
            put(item, cost + DELETE, audit + "D")
            rule, dot, origin = item
            if item in _WHOLE or sign == "d":
                continue
            if RULES[rule][1][dot] == sign.lower():
                put((rule, dot + 1, origin), cost + late, audit + "K")
            elif RULES[rule][1][dot] in "ua":
                put((rule, dot + 1, origin), cost + REROLE + late, audit + "R")
        items = closed(after, _FIRST, -1)
    return {i: w for i, w in items.items() if i in ENTRIES}


def then(weights: dict[Item, Weight], table: dict[Item, dict[Item, Weight]]) -> dict[Item, Weight]:
    """Weights after a stretch whose ``table`` gives the exits of each entry."""
    out: dict[Item, Weight] = {}
    for entry, (cost, audit) in weights.items():
        for leave, (more, edits) in table.get(entry, {}).items():
            w = (cost + more, audit + edits)
            if leave not in out or w < out[leave]:
                out[leave] = w
    return out


def after_rows(weights: dict[Item, Weight], signs: str) -> dict[Item, Weight]:
    for at in range(0, len(signs), _BLOCK):
        block = signs[at : at + _BLOCK]
        weights = then(weights, {entry: parsed(block, entry) for entry in weights})
    return weights


def accepted(weights: dict[Item, Weight]) -> Weight:
    """The least of the repairs that leave nothing, pairs or a system turn."""
    return min(weights[i] for i in _WHOLE if i in weights)


START = {i: w for i, w in _FIRST.items() if i in ENTRIES}
PAIRED = {i: w for i, w in START.items() if i != _ALONE}

# ---------------------------------------------------------------- rows of one stretch

_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = {"su", "ua", "au"}


def faults(roles: list[str], texts: list[str], known: set[tuple[str, str]] = frozenset()) -> list[str]:
    """Each row's first fault: blank, duplicate (of an earlier row, or of a known pair), truncated or none."""
    seen, out = set(known), []
    for role, text in zip(roles, texts, strict=True):
        if not _WORD.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(_SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def signed(roles: list[str], found: list[str]) -> str:
    def sign(role: str, fault: str) -> str:
        if fault in ("blank", "duplicate"):
            return "d"
        s = role[0] if role[:1] in ("s", "u", "a") else "x"
        return s.upper() if fault == "truncated" else s

    return "".join(map(sign, roles, found))


def _counts(turns: list, roles: list[str], found: list[str]) -> dict:
    have = sorted({t for t in turns if t is not None})
    return {
        "low": have[0] if have else None, "high": have[-1] if have else None, "distinct": len(have),
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:], strict=False)),
    }


def edited(roles: list[str], texts: list[str], audit: str, place: int, system: bool) -> list[dict]:
    """The turns that an audit leaves of these rows; ``place`` turns come before, and the first of all is the system's if ``system``."""
    out, row = [], 0
    for edit in audit:
        wanted = ("user", "assistant")[(place + len(out) - system) % 2]
        if edit == "I":
            out.append({"role": wanted, "text": ""})
            continue
        if edit != "D":
            out.append({"role": roles[row] if edit == "K" else wanted, "text": texts[row]})
        row += 1
    return out


# ---------------------------------------------------------------- tables

_TURNS = "array<struct<role: string, text: string>>"
_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces", "piece", "turns"]
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The planted faults: crc32 of ``conv:turn`` modulo 20 drops (0), empties (1), strips of ``[.!?]`` (2), repeats (3) or gives to the user (4) a row.

    Nulls are one space.  Dropped rows stay as rows that are not ``present``, so that no conversation gets lost.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), code.alias("code"))
    bare = F.translate("text", ".!?", "")
    changed = plain.withColumns({"text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, bare).otherwise(F.col("text")), "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return changed.select("conv_id", "turn", "role", "text", (F.col("code") != 0).alias("present"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, most_rows: int = 20_000, lone_system: bool = True) -> DataFrame:
    """The cheapest repair of every conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``pieces``, ``piece``, ``turns``.

    A conversation's rows come by turn (nulls first; ties by role, then text).  Null roles and texts are one space.  Rows that are
    blank, or repeat an earlier row's role and text, have to go; see ``RULES`` for what is to be left, and REROLE, DELETE, INSERT and
    TRUNCATED (an unfinished text that stays) for the costs.  ``audit`` has a letter for each edit (K, R, D, I), the
    ASCII-least of the cheapest.  ``gaps`` counts turns that are missing between the first and the last, ``illegal`` neighbours that
    are not su, ua or au.  ``turns`` is what is left.  Rows that are not ``present`` only name their conversation; one without any
    other row has zeros and no turns.  Rows without conv_id form a conversation.  Extra columns are not read.  A system turn may be all
    that is left, unless ``lone_system`` is false.

    Conversations of up to ``most_rows`` rows are parsed in one task each and are one row.  Larger ones are dealt by range of turns over the
    cluster: every stretch of rows is parsed from each item that may enter it, the tables are chained, and each stretch is edited
    by its part of the audit: ``pieces`` rows, of which piece 0 carries the results.  (An audit is one string: less than 2^31 rows.)
    """
    ship(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    start = START if lone_system else PAIRED
    given = F.col(present) if present else F.lit(True)
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.coalesce(given, F.lit(False)).alias("present"))
    plain = plain.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    id_type = plain.schema["conv_id"].dataType
    large = settle(plain.groupBy("group").agg(F.count_if("present").alias("n")).where(F.col("n") > most_rows))
    n_large = large.agg(F.sum("n")).first()[0]
    small = plain.join(large, "group", "left_anti") if n_large else plain
    from pyspark.sql.pandas.types import to_arrow_type

    kind = f"conv_id {id_type.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces int, piece int, turns {_TURNS}"
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [to_arrow_type(id_type), *[pa.int64()] * 6, pa.string(), pa.int32(), pa.int32(), turn_type]

    def one(conv_id: list, turns: list, roles: list, texts: list, there: list) -> list[tuple]:
        at = sorted((i for i in range(len(turns)) if there[i]), key=lambda i: (turns[i] is not None, turns[i] or 0, roles[i].encode(), texts[i].encode()))
        turns, roles, texts = ([x[i] for i in at] for x in (turns, roles, texts))
        found = faults(roles, texts)
        cost, audit = accepted(after_rows(start, signed(roles, found))) if at else (0, "")
        c = _counts(turns, roles, found)
        gaps = c["high"] - c["low"] + 1 - c["distinct"] if c["distinct"] else 0
        system = (len(audit) - audit.count("D")) % 2 == 1
        return [(conv_id[0], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, 1, 0, edited(roles, texts, audit, 0, system))]

    out = by_group(small, "group", ["conv_id", "turn", "role", "text", "present"], one, kind, types, _RESULT)
    if n_large:
        out = out.unionByName(_in_stretches(plain.where("present").join(large.select("group"), "group", "left_semi"), n_large, most_rows, kind, start))
    return out


def _in_stretches(rows: DataFrame, n: int, size: int, kind: str, start: dict[Item, Weight]) -> DataFrame:
    """Rows of large conversations, dealt by range of (conversation, turn, role, text) into stretches of about ``size``; equal rows share one."""
    order = ["group", F.asc_nulls_first("turn"), "role", "text"]
    dealt = rows.repartitionByRange(max(2, -(-n // size)), *order).withColumn("piece", F.spark_partition_id())
    dealt = settle(dealt.withColumns({"h0": F.xxhash64("role", F.lit("|"), "text"), "h1": F.xxhash64(F.lit(1), "role", F.lit("|"), "text")}))
    # a text's first stretch: one row for each stretch that holds it
    holds = dealt.groupBy("group", "piece", "h0", "h1").agg(F.lit(1).alias("one"))
    first = holds.groupBy("group", "h0", "h1").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = holds.join(first, ["group", "h0", "h1"]).where(F.col("piece") > F.col("first")).select("group", "piece", "h0", "h1").toDF("group", "piece", "h0", "h1")

    def ordered(frame: pd.DataFrame) -> tuple[list, list[str], list[str], list[str]]:
        t = [None if pd.isna(v) else int(v) for v in frame["turn"]]
        at = sorted(range(len(t)), key=lambda i: (t[i] is not None, t[i] or 0, frame["role"].iloc[i].encode(), frame["text"].iloc[i].encode()))
        take = frame.iloc[at]
        return [t[i] for i in at], list(take["role"]), list(take["text"]), list(zip(take["h0"], take["h1"], strict=True))

    def found_in(roles, texts, codes, seen) -> list[str]:
        before = set(zip(seen["h0"], seen["h1"], strict=True))
        return faults(roles, texts, {(r, t) for r, t, c in zip(roles, texts, codes, strict=True) if c in before})

    def summary(frame: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=names)
        turns, roles, texts, codes = ordered(frame)
        found = found_in(roles, texts, codes, seen)
        signs = signed(roles, found)
        table = [(e, x, c, a) for e in range(len(ENTRIES)) for x, (c, a) in ((ENTRIES.index(i), w) for i, w in after_rows({ENTRIES[e]: (0, "")}, signs).items())]
        c = _counts(turns, roles, found)
        row = {"group": frame["group"].iloc[0], "piece": int(frame["piece"].iloc[0]), **c, "first": roles[0][:1], "last": roles[-1][:1], "entries": [t[0] for t in table], "exits": [t[1] for t in table], "costs": [t[2] for t in table], "audits": [t[3] for t in table]}
        return pd.DataFrame([row], columns=names).astype({"low": "Int64", "high": "Int64"})

    shape = "group string, piece int, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
    names = [x.strip().split(" ")[0] for x in shape.split(",")]
    keys = ["group", "piece"]
    sums = settle(dealt.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(summary, shape))

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        weights, high, gaps, illegal, last = start, None, 0, 0, None
        for x in frame.itertuples():
            table: dict = {}
            for e, leave, c, a in zip(x.entries, x.exits, x.costs, x.audits, strict=True):
                table.setdefault(ENTRIES[e], {})[ENTRIES[leave]] = (int(c), a)
            weights = then(weights, table)
            illegal += int(x.illegal) + (last is not None and last + x.first not in _LEGAL)
            last = x.last
            if x.distinct:
                low = int(x.low)
                gaps += int(x.high) - low + 1 - int(x.distinct) + (low - high - 1 if high is not None and low > high else 0)
                high = int(x.high)
        cost, audit = accepted(weights)
        system, at, place, out = (len(audit) - audit.count("D")) % 2 == 1, 0, 0, []
        for k, x in enumerate(frame.itertuples()):
            rows_left, begin = int(x.n_rows), at
            while at < len(audit) and (rows_left or k == len(frame) - 1):
                rows_left -= audit[at] != "I"
                at += 1
            part = audit[begin:at]
            out.append({"group": x.group, "piece": int(x.piece), "number": k, "pieces": len(frame), "part": part, "place": place, "system": system, "gaps": gaps, "blank": int(frame.blank.sum()), "duplicate": int(frame.duplicate.sum()), "truncated": int(frame.truncated.sum()), "illegal": illegal, "cost": cost, "audit": audit if k == 0 else None})
            place += len(part) - part.count("D")
        return pd.DataFrame(out)

    lengths = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    plan_kind = "group string, piece int, number int, pieces int, part string, place long, system boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    plan = settle(sums.join(lengths, keys).groupBy("group").applyInPandas(chained, plan_kind))

    def apply(frame: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(steps):
            return pd.DataFrame(columns=_RESULT)
        s = steps.iloc[0]
        _, roles, texts, _ = ordered(frame)
        row = {"conv_id": frame["conv_id"].iloc[0], "audit": s["audit"], "pieces": s["pieces"], "piece": s["number"], "turns": edited(roles, texts, s["part"], int(s["place"]), bool(s["system"]))}
        row |= {c: int(s[c]) if s["number"] == 0 else None for c in _STATS}
        return pd.DataFrame([row], columns=_RESULT).astype(dict.fromkeys(_STATS, "Int64"))

    return dealt.groupBy(*keys).cogroup(plan.groupBy(*keys)).applyInPandas(apply, kind)


def digest(found: DataFrame) -> DataFrame:
    """One row a conversation, with the SHA-256 of its turns as ``role:text`` lines; pieces are hashed one after the other."""
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    joined = found.withColumn("joined", F.array_join(F.transform("turns", line), "\n"))
    short = joined.where("pieces = 1").select("conv_id", *_STATS, "audit", F.sha2(F.col("joined").cast("binary"), 256).alias("repaired_sha256"))
    long_ = joined.where("pieces > 1").withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    names = ["conv_id", *_STATS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hashed, some = None, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if x["piece"] == 0:
                    if row is not None:
                        yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": hashed.hexdigest()}], schema=schema(batch))
                    row, hashed, some = {n: x[n] for n in names[:-1]}, hashlib.sha256(), False
                if x["turns"]:
                    hashed.update(("\n" if some else "").encode() + x["joined"].encode())
                    some = True
                last = batch
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": hashed.hexdigest()}], schema=schema(last))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([*[batch.schema.field(n) for n in names[:-1]], pa.field("repaired_sha256", pa.string())])

    rest = long_.select("group", "piece", F.size("turns").alias("turns"), "joined", *names[:-1]).repartition("group").sortWithinPartitions("group", "piece")
    return short.unionByName(rest.mapInArrow(run, short.schema))
