"""Katz back-off model of any order: Good-Turing discounts and exactly normalised back-off weights.

Texts are tokenised once into batches of word numbers.  Counts and weights live in
tables partitioned by hash: a batch sends each part the distinct words (or n-grams, or
histories) it holds, with their training counts; the part adds up all batches, and sends each batch
the totals of what it asked for.  Words and n-grams are known by 64-bit hashes.

P(w) = d(c) c / N for known words, and what the discounts leave for the unknown word.
P(w | h) = d(c) c(h, w) / c(h) for n-grams seen in training; else a(h) P(w | h'), where h' is h without its
first word and a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of P(w | h') over the same words).  After a
history without training P(w | h) = P(w | h').  So a token is scored from the word alone upwards, one level for
each further word of its history.  For every history the probabilities of
all known words, the end and the unknown word sum to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..frames import sweep
from .common import byte_batches, mixed, settle, text_buffer, word_hashes, word_spans

END, BEGIN = np.uint64(1), np.uint64(2)  # word hashes of the marks
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_IN = "uid long, part int, words binary, counts binary"
_OUT = "uid long, part int, answer binary, stats map<string,double>"


def packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def packed_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 as differences, byte plane by byte plane."""
    return packed(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpacked_sorted(b: bytes) -> np.ndarray:
    planes = unpacked(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(x: np.ndarray) -> bytes:
    return packed(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T) if not len(x) or x.max() < 1 << 32 else b"8" + packed(x.astype(np.uint64))


def unpacked_counts(b: bytes) -> np.ndarray:
    if b[:1] == b"8":
        return unpacked(b[1:], np.uint64).astype(np.int64)
    return np.ascontiguousarray(unpacked(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


@dataclass(frozen=True)
class GoodTuring:
    """Discount d(c) for counts up to ``len(factors)``; 1 beyond."""

    factors: tuple[float, ...]

    @staticmethod
    def fit(of_counts: dict[int, float], most: int = 5) -> GoodTuring:
        """Katz's discounts from the numbers of items seen once, twice, ...; where they are undefined or
        not strictly between 0 and 1, (c - 1/2) / c stands in."""
        n = lambda r: of_counts.get(r, 0.0)
        common = (most + 1) * n(most + 1) / n(1) if n(1) else 1.0
        out = []
        for r in range(1, most + 1):
            d = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common) if n(r) and common < 1 else -1.0
            out.append(d if 0 < d < 1 else (r - 0.5) / r)
        return GoodTuring(tuple(out))

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors, 1.0])
        return table[np.minimum(counts, len(self.factors) + 1)]


# ---------------------------------------------------------------- batches of texts


def _tokenised(fold: int, held: int, most: int):
    """One row per batch: text ids and folds, token offsets, word numbers of the tokens, and the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in byte_batches(batches, "_text", most):
            data, offsets = text_buffer(batch.column("_text"))
            starts, ends, text = word_spans(data, offsets)
            n_words = np.bincount(text, minlength=batch.num_rows)
            n_tokens = n_words + 1
            last = np.cumsum(n_tokens) - 1
            tokens = np.full(int(n_tokens.sum()), END, np.uint64)
            is_word = np.ones(len(tokens), bool)
            is_word[last] = False
            tokens[is_word] = word_hashes(data, starts, ends)
            distinct, code = np.unique(tokens, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made]),
                    pa.array([batch.column("_id").to_pylist()], pa.list_(batch.schema.field("_id").type)),
                    pa.array([packed(np.asarray(batch.column("_held")).astype(np.uint8))]),
                    pa.array([packed(n_tokens.astype(np.int64))]),
                    pa.array([packed(code.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)]),
                    pa.array([packed_sorted(distinct)]),
                ],
                names=["uid", "ids", "held", "n_tokens", "codes", "words"],
            )
            made += 1

    return run


class Batch:
    """A tokenised batch: token codes, and for each token its text and whether it trains."""

    def __init__(self, x: dict):
        self.uid, self.ids = x["uid"], x["ids"]
        self.held = unpacked(x["held"], np.uint8).astype(bool)
        self.n_tokens = unpacked(x["n_tokens"], np.int64)
        self.code = np.ascontiguousarray(unpacked(x["codes"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
        self.words = unpacked_sorted(x["words"])
        self.text = np.repeat(np.arange(len(self.n_tokens)), self.n_tokens)
        self.train = ~self.held[self.text]
        self.begin = np.cumsum(self.n_tokens) - self.n_tokens

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.code[self.train], minlength=len(self.words))

    def grams(self, below: Grams) -> Grams:
        """The n-grams one word longer than those ``below``: at each token the gram before it, and its word."""
        before = np.r_[0, below.number[:-1]]
        before[self.begin] = len(below.hashes)  # the begin of the text
        joint = before << 32 | self.code
        del before
        order = np.argsort(joint)
        joint = joint[order]
        head = np.r_[True, joint[1:] != joint[:-1]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(head) - 1
        joint, first = joint[head], order[head]
        history = joint >> 32
        hashes = mixed(mixed(np.r_[below.hashes, BEGIN][history] * _MIX) + self.words[joint & 0xFFFFFFFF])
        return Grams(number, hashes, np.bincount(number[self.train], minlength=len(joint)), history, below.number[first])


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of a batch: each token's number among them, hashes, training counts here, and each one's
    history and shorter gram (without its first word) among the grams one word shorter; the history after those is the begin of a text."""

    number: np.ndarray
    hashes: np.ndarray
    train: np.ndarray
    history: np.ndarray
    shorter: np.ndarray


def _requests(uid: int, hashes: np.ndarray, values: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """A batch's questions to each part: ascending hashes, and what it contributes to each."""
    order = np.argsort(hashes)
    part = (hashes[order] >> np.uint64(40)) % np.uint64(parts)
    for p in np.unique(part):
        take = order[part == p]
        yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([int(p)], pa.int32()), pa.array([packed_sorted(hashes[take])]), pa.array([b"".join(len(b).to_bytes(8, "little") + b for b in (packed_counts(v[take]) if v.dtype.kind in "iu" else packed(v[take]) for v in values))])], names=["uid", "part", "words", "counts"])


def _answers(hashes: np.ndarray, parts: int, got: dict[int, bytes]) -> list[tuple[np.ndarray, bytes]]:
    """(places among ``hashes``, answer) of each part, in the order in which ``_requests`` asked."""
    order = np.argsort(hashes)
    part = (hashes[order] >> np.uint64(40)) % np.uint64(parts)
    return [(order[part == p], got[int(p)]) for p in np.unique(part)]


def _fields(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _merged(table: pa.Table) -> tuple[list[int], int, list[np.ndarray], list[list[bytes]], np.ndarray, np.ndarray]:
    """All batches' questions to one part: uids, part, hashes, contributions, and the distinct hashes with every question's place among them."""
    uids, part = table.column("uid").to_pylist(), table.column("part")[0].as_py()
    words = [unpacked_sorted(b) for b in table.column("words").to_pylist()]
    fields = [_fields(b) for b in table.column("counts").to_pylist()]
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    return uids, part, words, fields, distinct, place


def _reply(uids: list[int], part: int, answers: list[bytes], stats: dict[str, float]) -> pa.Table:
    return pa.table(
        {
            "uid": pa.array([*uids, None], pa.int64()),
            "part": pa.array([part] * (len(uids) + 1), pa.int32()),
            "answer": pa.array([*answers, None], pa.binary()),
            "stats": pa.array([*[None] * len(uids), list(stats.items())], pa.map_(pa.string(), pa.float64())),
        }
    )


def _total(frame: DataFrame) -> dict[str, float]:
    """Sums of the parts' statistics; a few dozen numbers."""
    rows = frame.where("uid is null").select(F.explode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    return {r["k"]: r["v"] for r in rows}


def _count_words(most: int):
    def run(table: pa.Table) -> pa.Table:
        uids, part, words, fields, distinct, place = _merged(table)
        total = np.bincount(place, weights=np.concatenate([unpacked_counts(f[0]) for f in fields]), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        stats = {"N": float(total.sum()), "V": float((total > 0).sum())} | {str(r): float((total == r).sum()) for r in range(1, most + 2)}
        return _reply(uids, part, [packed_counts(total[p]) for p in np.split(place, ends[:-1])], stats)

    return run


def _count_pairs(most: int):
    """Total of each pair for those who asked; the first asker of a pair owns it (answers are 2 * total + owner)."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("uid")), kind="stable")
        uids, part, words, fields, distinct, place = _merged(table.take(pa.array(order)))
        total = np.bincount(place, weights=np.concatenate([unpacked_counts(f[0]) for f in fields]), minlength=len(distinct)).astype(np.int64)
        owner = np.zeros(len(place), np.int64)
        owner[np.unique(place, return_index=True)[1]] = 1
        answer = 2 * total[place] + owner
        ends = np.cumsum([len(w) for w in words])
        stats = {str(r): float((total == r).sum()) for r in range(1, most + 2)}
        return _reply(uids, part, [packed_counts(a) for a in np.split(answer, ends[:-1])], stats)

    return run


def _weigh_histories(table: pa.Table) -> pa.Table:
    """log10 of the back-off weight and of the denominator of each history."""
    uids, part, words, fields, distinct, place = _merged(table)
    count = np.zeros(len(distinct))
    count[place] = np.concatenate([unpacked_counts(f[0]) for f in fields])  # all askers know the same total
    kept, lower = (np.bincount(place, weights=np.concatenate([unpacked(f[i], np.float64) for f in fields]), minlength=len(distinct)) for i in (1, 2))
    # without any discount one unit is set aside, else nothing would be left for other words
    bottom = np.where(count - kept > 1e-9 * np.maximum(count, 1), count, count + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(count > 0, (1 - kept / bottom) / np.maximum(1 - lower, 1e-300), 1.0)
        answer = np.stack([np.log10(weight), np.log10(np.maximum(bottom, 1))], axis=1)
    ends = np.cumsum([len(w) for w in words])
    return _reply(uids, part, [packed(a) for a in np.split(answer[place], ends[:-1])], {"histories": float(len(distinct))})


def _per_batch(frame: DataFrame, answers: list[DataFrame], each, schema: str) -> DataFrame:
    """``each(batch row, answers by part for every exchange)`` for each batch, the batch and its answers brought together by uid."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    union = frame.withColumns({"_step": F.lit(-1), "part": F.lit(None).cast("int"), "answer": F.lit(None).cast("binary")})
    for i, a in enumerate(answers):
        rows = a.where("uid is not null").select("uid", F.lit(i).alias("_step"), "part", "answer", *[F.lit(None).cast(t).alias(n) for n, t in kinds.items() if n != "uid"])
        union = union.unionByName(rows)

    exchanges, names = len(answers), list(kinds)

    def run(table: pa.Table) -> pa.Table:
        x, got = None, [{} for _ in range(exchanges)]
        for row in table.to_batches():
            step, part, answer = row.column("_step").to_pylist(), row.column("part").to_pylist(), row.column("answer").to_pylist()
            for i, s in enumerate(step):
                if s < 0:
                    x = {n: row.column(n)[i].as_py() for n in names}
                else:
                    got[s][part[i]] = answer[i]
        return pa.Table.from_batches(list(each(Batch(x), *got)))

    return union.groupBy("uid").applyInArrow(run, schema)


def _lower(counts: np.ndarray, discount: GoodTuring, n: float, rest: float) -> np.ndarray:
    """P(w) of words with these training counts; 0 counts as the unknown word."""
    return np.where(counts > 0, discount.of(counts) * counts / max(n, 1.0), rest)


def katz_scores(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held: int = 2,
    order: int = 2,
    discounted: int = 5,
    batch_bytes: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Scores of all rows: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probability of the text).

    Tokens are the words, A-Z lower-cased, and one end; null and empty texts are an end
    alone.  Learns from rows whose crc32(key as text) mod ``folds`` is not ``held`` (null
    keys learn).  ``base_score`` is the add-one unigram model's.  Repeated rows count each time.
    Without training rows every probability goes to the unknown word.  An empty table gives no rows.
    ``order`` is the number of words of the longest n-grams (1: words alone).

    A batch holds ``batch_bytes`` of text (default: 6 MiB, from 1 TiB of text on growing with its square root, to 32 MiB),
    and there is a part for each 16 MiB of text unless ``parts`` is given.  A batch writes to a part only if it
    has words or pairs for it, so messages are never more than distinct pairs in batches: in proportion to the text.
    """
    spark = docs.sparkSession
    ship(spark)
    out_fold = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), out_fold.alias("_held"))
    kind = dict(rows.dtypes)["_id"]
    if parts is None or batch_bytes is None:
        size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        parts = parts or max(8, -(-size // (16 << 20)))
        batch_bytes = batch_bytes or int(min(32, max(6, 6 * (size / (1 << 40)) ** 0.5)) * (1 << 20))
    batches = settle(rows.mapInArrow(_tokenised(folds, held, batch_bytes), f"uid long, ids array<{kind}>, held binary, n_tokens binary, codes binary, words binary"))

    def ask_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for x in frame.to_pylist():
                b = Batch(x)
                yield from _requests(b.uid, b.words, [b.word_counts()], parts)

    one = settle(batches.mapInArrow(ask_words, _IN).groupBy("part").applyInArrow(_count_words(discounted), _OUT))
    total = _total(one)
    n, v = total.get("N", 0.0), total.get("V", 0.0)
    uni = GoodTuring.fit({r: total.get(str(r), 0.0) for r in range(1, discounted + 2)}, discounted)
    # what the discounts take from the known words is the unknown word's; at least one unit
    taken = sum(total.get(str(r), 0.0) * r * (1 - uni.factors[r - 1]) for r in range(1, discounted + 1))
    units = n if taken > 0 else n + 1
    rest = taken / units if taken > 0 else 1 / units

    def known(b: Batch, got: dict[int, bytes]) -> np.ndarray:
        counts = np.zeros(len(b.words), np.int64)
        for place, answer in _answers(b.words, parts, got):
            counts[place] = unpacked_counts(answer)
        return counts

    n_texts = batches_texts(batches)
    empty = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
    discounts = [uni]
    exchanges = [one]

    def bottom_level(b: Batch, got: dict[int, bytes]) -> tuple[Grams, np.ndarray, np.ndarray]:
        counts = known(b, got)
        none = np.zeros(len(b.words), np.int64)
        with np.errstate(divide="ignore"):
            return Grams(b.code, b.words, none, none, none), counts, np.log10(_lower(counts, uni, units, rest))

    def level(b: Batch, below: tuple[Grams, np.ndarray, np.ndarray]):
        """Grams one word longer, and which of them can have been seen: both their history and their shorter gram were."""
        grams = b.grams(below[0])
        some = np.flatnonzero((np.r_[below[1], 1][grams.history] > 0) & (below[1][grams.shorter] > 0))
        return grams, some

    def totals(grams: Grams, some: np.ndarray, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Training counts over all batches, and whether this batch owns the gram."""
        answer = np.zeros(len(grams.hashes), np.int64)
        for place, reply in _answers(grams.hashes[some], parts, got):
            answer[some[place]] = unpacked_counts(reply)
        return answer >> 1, (answer & 1).astype(bool)

    def history_table(below: tuple[Grams, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and training counts of all histories (a gram with the end never is one, the begin is one for each text), and those to ask for."""
        counts = np.r_[below[1], n_texts]
        return np.r_[below[0].hashes, BEGIN], counts, np.flatnonzero(counts > 0)

    def scored(b: Batch, got: list[dict[int, bytes]]) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The longest grams whose two exchanges ``got`` holds: grams, counts, log10 probabilities."""
        state = bottom_level(b, got[0])
        for k in range(1, len(got) - 1, 2):
            grams, some = level(b, state)
            counts, _ = totals(grams, some, got[k])
            hashes, total, ask = history_table(state)
            weight, bottom = np.zeros(len(total)), np.zeros(len(total))
            for place, reply in _answers(hashes[ask], parts, got[k + 1]):
                x = unpacked(reply, np.float64).reshape(-1, 2)
                weight[ask[place]], bottom[ask[place]] = x[:, 0], x[:, 1]
            with np.errstate(divide="ignore"):
                seen = np.log10(discounts[(k + 1) // 2].of(counts) * counts) - bottom[grams.history]
            state = grams, counts, np.where(counts > 0, seen, weight[grams.history] + state[2][grams.shorter])
        return state

    for _ in range(2, order + 1):

        def ask_grams(b: Batch, *got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            grams, some = level(b, scored(b, list(got)))
            yield pa.RecordBatch.from_pylist([], empty)
            yield from _requests(b.uid, grams.hashes[some], [grams.train[some]], parts)

        sweep(spark)
        exchanges.append(settle(_per_batch(batches, exchanges, ask_grams, _IN).groupBy("part").applyInArrow(_count_pairs(discounted), _OUT)))
        of_grams = _total(exchanges[-1])
        discounts.append(GoodTuring.fit({r: of_grams.get(str(r), 0.0) for r in range(1, discounted + 2)}, discounted))

        def ask_histories(b: Batch, *got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            below = scored(b, list(got[:-1]))
            grams, some = level(b, below)
            counts, owner = totals(grams, some, got[-1])
            hashes, total, ask = history_table(below)
            mine = owner & (counts > 0)
            put = lambda w: np.bincount(grams.history[mine], weights=w[mine], minlength=len(total)).astype(np.float64)  # noqa: E731  of no grams bincount makes integers
            kept, lower = put(discounts[-1].of(counts) * counts), put(10.0 ** below[2][grams.shorter])
            yield pa.RecordBatch.from_pylist([], empty)
            yield from _requests(b.uid, hashes[ask], [total[ask], kept[ask], lower[ask]], parts)

        sweep(spark)
        exchanges.append(settle(_per_batch(batches, exchanges, ask_histories, _IN).groupBy("part").applyInArrow(_weigh_histories, _OUT)))

    sweep(spark)

    def score(b: Batch, *got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        grams, _, log_p = scored(b, list(got))
        counts = known(b, got[0])
        texts = len(b.n_tokens)
        base = np.log10((counts + 1.0) / (n + v + 1.0))
        at = lambda x: np.bincount(b.text, weights=x, minlength=texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(b.ids, dict_kind),
                pa.array(b.held),
                pa.array(b.n_tokens),
                pa.array(at(counts[b.code] > 0).astype(np.int64)),
                pa.array(np.full(texts, int(n))),
                pa.array(at(base[b.code])),
                pa.array(at(log_p[grams.number])),
            ],
            names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    dict_kind = to_arrow_type(rows.schema["_id"].dataType)
    out = _per_batch(batches, exchanges, score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_id", key)


def batches_texts(batches: DataFrame) -> int:
    """Training texts: how often the begin was a history."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            held = [int((unpacked(h, np.uint8) == 0).sum()) for h in frame.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["n"])

    return int(batches.select("held").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)
