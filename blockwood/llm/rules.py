"""Quality rules: repetition rules and a hashed n-gram log-likelihood ratio (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

SYMBOLS = "[#*$%&|<>]"


def word_codes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def grams(codes: Column, buckets: int, each) -> Column:
    """``each(bucket)`` of the 1-gram and the 2-gram that start at each word (the last word pairs with an end mark)."""
    at = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    nexts = F.concat(F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), F.array(F.lit(0).cast("bigint")))
    return F.zip_with(codes, nexts, lambda a, b: each(at(a), at(F.xxhash64(a, b))))


def bucket_counts(codes: DataFrame, buckets: int) -> tuple[dict[int, int], dict[int, int]]:
    """Occurrences of each bucket in the trusted texts and in all texts; at most ``buckets`` rows reach the driver.

    ``codes``: word codes ``_codes`` and ``_trusted`` of every text.
    """
    both = F.explode(F.flatten(grams(F.col("_codes"), buckets, lambda a, b: F.array(a, b)))).alias("b")
    rows = codes.where(F.size("_codes") > 0).select(F.coalesce("_trusted", F.lit(False)).cast("long").alias("t"), both)
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()
    return {r["b"]: r["t"] for r in counts if r["t"]}, {r["b"]: r["n"] for r in counts}


def llr_weights(target: dict[int, int], raw: dict[int, int], buckets: int, smoothing: float = 8192.0) -> list[float] | None:
    """log P_target - log P_raw of each bucket, both smoothed by ``smoothing`` counts spread evenly over the buckets; None without target or raw text."""
    import math

    n_target, n_raw = sum(target.values()), sum(raw.values())
    if not n_target or not n_raw:
        return None
    one = smoothing / buckets
    return [
        round(math.log((target.get(b, 0) + one) / (n_target + smoothing)) - math.log((raw.get(b, 0) + one) / (n_raw + smoothing)), 6)
        for b in range(buckets)
    ]


def repeat_words(codes: Column, width: int = 8) -> Column:
    """Number of words that lie in a ``width``-word window found twice or more in the same text."""
    n = F.size(codes)
    hashes = F.when(
        n > width,
        F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # (hash, start) sorted: equal windows are neighbours
        order = F.array_sort(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda a, i: F.struct(a.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(o, i)["h"] == F.get(o, j)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(hit, lambda i: F.get(o, i)["i"]))

        return F.aggregate(
            _let(order, starts),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["at"])).alias("n"), i.alias("at")),
            lambda s: s["n"],
        )

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_rules(text: Column, tokens: Column, codes: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(codes).cast("long"),
    }


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    buckets: int = 1 << 16,
    threshold: float = -0.08,
    least_words: int = 20,
    most_repeated: int = 30,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """Verdict on every row of ``docs``: its columns ``keep`` (default: the key), the base statistics, ``llr``, ``base_failed`` and ``kept``.

    ``trusted`` lists the keys of trusted texts (repeats and nulls are ignored); the
    raw corpus is ``docs`` itself, counted in full.  ``llr`` is the sum over the
    text's hashed 1- and 2-grams of log P_trusted - log P_raw, divided by their
    number.  The trusted keys are broadcast up to ``most_broadcast`` of them (counted first),
    beyond that they meet the texts in a merge join.  ``kept`` is false if the base rules fail (fewer than ``least_words``
    words, or over ``most_repeated`` % of them in repeated 8-word windows), else
    ``llr >= threshold``.  Null and empty texts have no words, llr 0, and fail.
    Without any trusted or raw text llr is 0 for all and the base rules alone decide.
    Repeated rows each get their verdict; columns that are not in ``keep`` are ignored,
    and a kept column may have any name but those of the result.
    """
    keep = [key] if keep is None else keep
    named = {f"_keep_{i}": c for i, c in enumerate(keep)}
    body = F.coalesce(F.col(text), F.lit(""))
    listed = trusted.select(F.col(key).alias("_listed")).where(F.col("_listed").isNotNull()).distinct().withColumn("_trusted", F.lit(True))
    few = listed.limit(most_broadcast + 1).count() <= most_broadcast
    tagged = docs.select(F.col(key).alias("_key"), body.alias("_text")).join(listed.hint("broadcast" if few else "merge"), F.col("_key") == F.col("_listed"), "left")
    weights = llr_weights(*bucket_counts(tagged.select("_trusted", word_codes(words(F.col("_text"))).alias("_codes")), buckets), buckets)
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()], body.alias("_text"))
    rows = rows.withColumn("_words", words(F.col("_text"))).withColumn("_codes", word_codes(F.col("_words")))
    if weights is None:
        llr = F.lit(0.0)
    else:
        table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
        total = F.aggregate(grams(F.col("_codes"), buckets, lambda a, b: F.get(table, a) + F.get(table, b)), F.lit(0.0), lambda s, x: s + x)
        llr = F.when(F.size("_codes") > 0, F.round(total / (2 * F.size("_codes")), 9)).otherwise(F.lit(0.0))
    stats = base_rules(F.col("_text"), F.col("_words"), F.col("_codes"))
    # filters of later steps stop here: pushed further they would copy these long expressions over and over
    out = rows.select(*named, *[v.alias(k) for k, v in stats.items()], llr.alias("llr"), F.monotonically_increasing_id().alias("_at")).where("_at >= 0")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select(*[F.col(n).alias(c) for n, c in named.items()], *[c for c in out.columns if c not in named and c != "_at"])


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
