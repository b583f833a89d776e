"""Best-fit packing by minimum bin slack: every bin is filled by a bitset subset-sum search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import ASCII_SPACE, byte_batches, rank_buckets, rank_within, settle, text_buffer, word_hashes

PIECES = "_key long, piece int, start long, length long, ids_crc32 long"


class PieceCoder:
    """Token ids of whole texts, by the tokenizer file; ids of segments are kept, up to a bound.

    A text is cut where white space follows another character, and behind a line break that stands
    alone.  No token of a byte-level BPE with the usual pattern crosses such a place and none
    looks beyond it, so the ids of the segments end to end are the ids of the text.  Texts with
    added tokens or white space outside ASCII go to the library as a whole.  Equal segments of a batch
    are found by two 64-bit hashes and coded once.
    """

    def __init__(self, path: str, most_kept: int = 300_000):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        # the same vocabulary for plain segments in a faster implementation of the same merges
        self.fast = _byte_pairs(path)
        self.plain = re.compile(r" ?[!-~\u00c0-\u00ff]+")
        self.line = None if self.fast is None else self.fast.encode_to_numpy("\n")
        self.most_kept = most_kept
        self.forget()

    def forget(self) -> None:
        """``kept``: first hash of a segment to its slot; by slot the second hash, and where its ids stand in ``flat``."""
        self.kept: dict[int, int] = {}
        self.check, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the library codes as a whole."""
        if self.fast is None:
            return np.ones(len(offsets) - 1, bool)
        hit = (data >= 0x1C) & (data <= 0x1F)
        if (data >= 0xC2).any():
            a, b, c = (np.concatenate([data[k:], np.zeros(k, np.uint8)]) for k in range(3))
            hit |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        at = np.flatnonzero(hit).tolist()
        whole = data.tobytes()
        for token in self.added:
            place = whole.find(token) if token else -1
            while place >= 0:
                at.append(place)
                place = whole.find(token, place + 1)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1] = True
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian uint32 ids of each text; null is empty."""
        data, offsets = text_buffer(column)
        odd = self.odd(data, offsets)
        out: list[bytes] = [b""] * len(odd)
        rest = np.flatnonzero(odd)
        for i, ids in zip(rest, self._library([bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in rest]), strict=True):
            out[i] = ids.tobytes()
        if odd.all() or not len(data):
            return out
        space = ASCII_SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        first = begins[:-1] | np.r_[True, ~space[:-1]]  # no white space of the same text before this place
        begins[:-1] |= space & first
        begins[1:-1] |= ~space[1:] & (data[:-1] == 10) & first[:-1]
        starts = np.flatnonzero(begins[:-1])
        ends = np.r_[starts[1:], len(data)]
        number = np.diff(np.searchsorted(starts, offsets))
        take = np.repeat(~odd, number)
        starts, ends = starts[take], ends[take]
        ends = np.minimum(ends, np.repeat(offsets[1:], number)[take])
        one, two = (word_hashes(data, starts, ends, lower=False, seed=k) for k in (0, 1))
        distinct, at, place = np.unique(one, return_index=True, return_inverse=True)
        if len(self.kept) > self.most_kept:
            self.forget()
        names, raw = distinct.tolist(), data.tobytes()
        slot = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if (two[at][place] != two).any() or (self.check[slot[slot >= 0]] != two[at][slot >= 0]).any():
            # two segments share their first hash: the library takes the batch
            return [x.tobytes() for x in self._library([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])]
        if len(new):
            segments = [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            begin, size, flat = self._ids(segments)
            slot[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.kept.update(zip([names[i] for i in new.tolist()], slot[new].tolist()))
            self.check, self.size = np.r_[self.check, two[at[new]]], np.r_[self.size, size]
            self.begin, self.flat = np.r_[self.begin, len(self.flat) + begin], np.r_[self.flat, flat]
        size, begin, flat = self.size[slot], self.begin[slot], self.flat
        size_here = size[place]
        end_here = np.cumsum(size_here)
        ids = flat[np.repeat(begin[place] - (end_here - size_here), size_here) + np.arange(int(end_here[-1]))]
        bounds = np.r_[0, end_here][np.r_[0, np.cumsum(np.where(odd, 0, number))]]
        for i in np.flatnonzero(~odd):
            out[i] = ids[bounds[i] : bounds[i + 1]].tobytes()
        return out

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of each segment's ids in the third array.

        Plain segments are coded in one go, one to a line: a line break between two of them is a token of its own.
        """
        begin, size, parts, used = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64), [], 0
        rest = np.ones(len(segments), bool)
        plain = np.flatnonzero([self.plain.fullmatch(s) is not None for s in segments]) if len(self.line) == 1 else []
        if len(plain):
            ids = self.fast.encode_to_numpy("\n".join([segments[i] for i in plain.tolist()]))
            breaks = np.flatnonzero(ids == self.line[0])
            if len(breaks) == len(plain) - 1:
                begin[plain], size[plain] = np.r_[0, breaks + 1], np.r_[breaks, len(ids)] - np.r_[0, breaks + 1]
                parts, used = [ids], len(ids)
                rest[plain] = False
        rest = np.flatnonzero(rest)
        for i, x in zip(rest.tolist(), self._library([segments[i] for i in rest.tolist()]), strict=True):
            begin[i], size[i] = used, len(x)
            parts.append(x)
            used += len(x)
        return begin, size, np.concatenate(parts)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 20_000):
            out += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        return out


def _byte_pairs(path: str):
    """The file's byte-level BPE as a tiktoken encoding, or None if it is of another kind."""
    import json

    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    step = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or spec.get("normalizer"):
        return None
    # byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ...
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each text: at most ``most`` ids, the first piece takes what does not divide."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = PieceCoder(path)  # not kept: an idle worker holds no vocabulary
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in byte_batches(batches, "_text", 3 << 20):
        keys, out = batch.column("_key").to_pylist(), {"_key": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for key, ids in zip(keys, coder.encode(batch.column("_text")), strict=True):
            ids += end
            n = len(ids) // 4
            first = (n - 1) % most + 1
            for piece, start in enumerate([0, *range(first, n, most)]):
                length = first if piece == 0 else most
                out["_key"].append(key)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
        types = [batch.schema.field("_key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def fullest(capacity: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``: {length: how many}.

    ``available``: (length, count), longest first.  Bit s of the set says that sum s can
    be reached; each length enters in copies of 1, 2, 4, ..., and the search stops once
    the capacity itself is reached.
    """
    sums, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length, count in available:
        count = min(count, capacity // length)
        copies = 1
        while count > 0:
            copies = min(copies, count)
            steps.append((length, copies, sums))
            sums |= (sums << (length * copies)) & mask
            count -= copies
            copies *= 2
            if sums >> capacity & 1:
                break
        if sums >> capacity & 1:
            break
    left, used = sums.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + copies
            left -= length * copies
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, their lengths) until nothing is left.

    A bin takes the longest length left and the fullest combination beside it; the same
    combination is removed as often as the counts allow, so each one uses up a length
    and the number of searches depends on the number of lengths, not of items.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    bins = []
    while left:
        order = sorted(left, reverse=True)
        longest = order[0]
        rest = [(k, left[k] - (k == longest)) for k in order if k <= capacity - longest]
        used = fullest(capacity - longest, [x for x in rest if x[1] > 0]) if longest < capacity else {}
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        bins.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def plan_rows(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per bin, first bin, offset in the bin): which bins the items of a length go to, by rank."""
    used, first, rows = {}, 0, []
    for times, lengths in bins:
        offset = 0
        for length in sorted(lengths, reverse=True):
            n = lengths[length]
            at = used.get(length, 0)
            rows.append((length, at, at + n * times, n, first, offset))
            used[length] = at + n * times
            offset += length * n
        first += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A text is its token ids and then ``end_id``.  Null and empty texts are that one id.
    Texts of more than ``capacity`` ids are cut into pieces of ``capacity``, the first
    of which may be shorter; others stay whole.  Repeated rows are packed once each, as
    are rows with a null key.  An empty table gives no rows.  Only the histogram of
    lengths (at most ``capacity`` rows) reaches the driver.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    pieces = settle(rows.mapInArrow(lambda b: piece_rows(b, tokenizer, capacity, end_id), PIECES.replace("_key long", f"_key {kind}")))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_rows(minimum_bin_slack(counts, capacity))
    table = docs.sparkSession.createDataFrame(plan, "_length long, _from long, _to long, _per long, _bin long, _at long")
    ranked = rank_within(pieces, "length", ["_key", "piece", "ids_crc32"], "_rank", buckets=rank_buckets(sum(counts.values())))
    # at most a few rows for each possible length: bounded by the capacity, not by the input
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    step = F.col("_rank") - F.col("_from")
    return placed.select(
        F.col("_key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_bin") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(step, F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )
