"""Removal of lines that many documents share, as one bit a line.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import settle
from .common import ascii_lower

_WHITE = " \t\n\x0b\x0c\r"
_TRACKED = 10_000  # counters of the sketch that looks for keys with very many lines
_HOT = 1_000  # a key with more than a thousandth of all lines is split


def lines(text: Column) -> Column:
    """The text cut at every newline; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def line_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Which lines stay: ``doc``, ``text_hash``, ``n_dropped`` and ``keep`` of every document that loses a line.

    ``keep`` is a sparse bitmap: (``word``, ``bits``) for those runs of 64 lines that lose one, in order; bit b
    of word w stands for line 64 w + b and is set if it stays.  Documents and words that are absent keep all.

    A line's key (``line_key``) of at least ``least_chars`` code points that occurs in at least ``least_docs`` documents
    loses all its lines except those of the largest ``key`` that holds it.  Rows of one ``key`` are one document here;
    rows without a ``key`` are together one document, smaller than all others.  Rows equal in key and text share a bitmap.
    Keys are known by 128 bits of hashes, texts of one document by 64.

    Hashes are dealt by range and sorted by document and place behind them, and one pass over each range sees a key's
    documents in order.  Keys with more than a thousandth of all lines are dealt in salted parts by document, and their totals added up and
    broadcast.  The sketch that finds them keeps 10,000 counters and overstates by less than a seventh of that share, so none
    escapes and fewer than 1,200 hashes are taken.
    """
    parts = F.posexplode(lines(F.col("_text"))).alias("pos", "line")
    cut = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text")).select("doc", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("text_hash"), parts)
    keyed = cut.where(F.length("line") >= least_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= least_chars)
    rows = settle(keyed.select(F.xxhash64("line").alias("h0"), F.xxhash64(F.lit(1), "line").alias("h1"), "doc", "text_hash", "pos"))

    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h0, {2 * _HOT}, {_TRACKED})").alias("top")).first()
    hot = [x["item"] for x in found["top"] or [] if x["count"] * _HOT > found["n"]]
    salts = 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col("h0").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).otherwise(0))

    group = Window.partitionBy("h0", "h1", "salt")
    run = group.orderBy(F.asc_nulls_first("doc"), "text_hash", "pos")
    ranged = salted.repartitionByRange("h0", "h1", "salt")
    first = (F.row_number().over(run) == 1) | ~F.lag("doc").over(run).eqNullSafe(F.col("doc"))  # the key's first occurrence in a further document
    seen = ranged.withColumn("first", first.cast("long"))
    seen = seen.withColumns({"n_docs": F.sum("first").over(group), "last": F.max("doc").over(group)})
    if hot:
        each = rows.where(is_hot).groupBy("h0", "h1", "doc").agg(F.lit(1).alias("one"))
        totals = each.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("all_docs"), F.max("doc").alias("all_last"))
        seen = seen.join(F.broadcast(totals), ["h0", "h1"], "left")  # of fewer than 1,200 values of h0
        seen = seen.withColumns({"n_docs": F.coalesce("all_docs", "n_docs"), "last": F.coalesce("all_last", "last")})

    gone = seen.where((F.col("n_docs") >= least_docs) & ~F.col("doc").eqNullSafe(F.col("last")))
    words = gone.groupBy("doc", "text_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))  # at most one for 64 lines of the text
    return words.groupBy("doc", "text_hash").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), keep.alias("keep"))


def without_shared_lines(docs: DataFrame, bitmaps: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``key``, ``n_lines`` (before), ``n_dropped``, ``kept_text`` (the lines that stay, joined by newlines) and ``carry`` of every row."""
    carry = carry or []
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    met = rows.join(bitmaps, F.col("_key").eqNullSafe(F.col("doc")) & (F.col("_hash") == F.col("text_hash")), "left")
    # two columns read _lines, so it stays one of its own and is cut once
    met = met.withColumn("_lines", lines(F.col("_text")))
    places = F.transform("keep", lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.flatten(places))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    out = met.select(
        F.col("_key").alias(key),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
        *[F.col(f"_c{i}").alias(f"carried_{c}" if c in (key, "n_lines", "n_dropped", "kept_text") else c) for i, c in enumerate(carry)],
    )
    return out


def digest(kept: DataFrame, *, key: str = "doc_id") -> DataFrame:
    return kept.select(key, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
