"""Web archives: not-modified revisits take their body and headers from the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 response may update (RFC 9110, section 15.4.5) ...
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# ... and query parameters that do not name another page
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
# end of the fixed values

RECORD = "record_id long, kind string, url string, captured timestamp, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Scheme, user, port 80/443, leading www. or m., fragment, tracking parameters and a closing slash go; the host is lower-cased; parameters are sorted."""
    text = F.regexp_replace(F.trim(url), r"#.*$", "")
    text = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(text, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(text, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(text, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, the one that sorts first stands (capitals before small letters). Null: none."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("name"), e["value"].alias("value"))))
    pair = lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    first = lambda es: F.transform(F.filter(es, lambda e, i: (i == 0) | (e["key"] != F.get(es, i - 1)["key"])), pair)
    one = F.get(F.transform(F.array(entries), first), F.lit(0))  # sorted once
    return F.coalesce(F.map_from_entries(one), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, *, chunks: int | None = None) -> DataFrame:
    """One row per revisit of ``records`` (columns of ``RECORD``; others are ignored).

    Result: record_id, url_key, refers_to, outcome, headers, digest.  A revisit looks up
    the latest full response of the same canonical URL captured before it (equal times:
    the smaller record_id is earlier).  outcome is

    * ``resolved``: validators agree - the revisit's etag equals the response's (weak
      marks ignored) where both have one, else its last-modified where both have one, else its
      digest where both have one;
    * ``mismatch``: the first pair of validators that both have differs;
    * ``unvalidated``: they have none in common;
    * ``no_original``: there is no earlier full response (null URL or time: none).

    Resolved records get the digest and headers of the response, in which those the
    revisit may update (``PERMITTED``) are replaced; others keep their own headers.
    Full responses have kind ``response`` and a status from 200 to 299; revisits have kind
    ``revisit`` and status 304 or null.  Records of other kinds and null record_ids are ignored;
    repeated rows give repeated results.

    A URL may hold a third of all rows, so its history is not sorted in one task: times
    are cut into ``chunks`` parts of about as many records (default: of at most 50,000, a power
    of two from 16 to 4,096), each part is searched for itself, and the
    last response of earlier parts comes from one row per URL and part.
    Header names are compared in lower case (``lower_names``).
    """
    h = lambda name: F.element_at("headers", F.lit(name))
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("captured").alias("at"), "status", "headers", "digest")
    rows = rows.where(F.col("record_id").isNotNull())
    rows = rows.withColumn("headers", lower_names(F.col("headers")))
    full = (F.col("kind") == "response") & F.col("status").between(200, 299)
    revisit = (F.col("kind") == "revisit") & (F.col("status").isNull() | (F.col("status") == 304))
    rows = rows.where(full | revisit).withColumn("is_full", full)
    lost = F.col("url_key").isNull() | F.col("at").isNull()
    if chunks is None:  # times at 4,096 equal shares; a power of two of them is used
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("at", [i / 4096 for i in range(1, 4096)], 10_000).alias("cuts")).first()
        step = 4096 // min(4096, max(16, 1 << max(0, (found["n"] - 1) // 50_000).bit_length()))
        cuts = (found["cuts"] or [])[step - 1 :: step]
    else:
        cuts = rows.agg(F.percentile_approx("at", [i / chunks for i in range(1, chunks)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    # a sorted list of at most 4,095 times: the number of those at or before the record's, by halving
    known = rows.where(~lost).withColumn("chunk", _at_or_before(edges, len(set(cuts)), F.col("at")))
    answer = F.when(F.col("is_full"), F.struct("at", "record_id", "headers", "digest"))
    inside = Window.partitionBy("url_key", "chunk").orderBy("at", "record_id", F.desc("is_full")).rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last(answer, ignorenulls=True).over(inside)).where(~F.col("is_full"))
    parts = known.groupBy("url_key", "chunk").agg(F.max_by(answer, F.when(F.col("is_full"), F.struct("at", "record_id"))).alias("top"))
    before = Window.partitionBy("url_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("url_key").alias("p_key"), F.col("chunk").alias("p_chunk"), F.last("top", ignorenulls=True).over(before).alias("far"))
    found = near.join(parts, (F.col("url_key") == F.col("p_key")) & (F.col("chunk") == F.col("p_chunk")), "left").withColumn("o", F.coalesce("near", "far"))
    none = rows.where(lost & ~F.col("is_full")).withColumn("o", F.lit(None).cast(near.schema["near"].dataType))
    columns = ["record_id", "url_key", "headers", "digest", "o"]
    found = found.select(columns).unionByName(none.select(columns))
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    other = lambda name: F.element_at(F.col("o.headers"), F.lit(name))
    agreed = F.coalesce(strong(h("etag")) == strong(other("etag")), h("last-modified") == other("last-modified"), F.col("digest") == F.col("o.digest"))
    outcome = F.when(F.col("o").isNull(), "no_original").when(agreed.isNull(), "unvalidated").when(agreed, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("o.headers"), lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    done = F.col("outcome") == "resolved"
    return found.select(
        "record_id",
        "url_key",
        F.col("o.record_id").alias("refers_to"),
        "outcome",
        F.when(done, F.map_concat(kept, updates)).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("o.digest")).otherwise(F.col("digest")).alias("digest"),
    )


def _at_or_before(edges: Column, n: int, value: Column) -> Column:
    """How many of the ``n`` ascending ``edges`` are at most ``value``."""
    step = 1 << max(0, n.bit_length() - 1)
    steps = F.array(*[F.lit(step >> i) for i in range(n.bit_length())] or [F.lit(0)])
    return F.aggregate(steps, F.lit(0), lambda done, s: F.when((s > 0) & (done + s <= n) & (F.coalesce(F.get(edges, done + s - 1), value + 1) <= value), done + s).otherwise(done))


def respelled(url: Column, way: Column) -> Column:
    """Six spellings of a URL (``way`` 0 to 5) that share its canonical form."""
    bare = F.regexp_replace(url, r"#.*$", "")
    start = r"^[A-Za-z]+://[^/?#]*"
    ways = {
        1: F.regexp_replace(url, r"^[A-Za-z]+://((www|m)\.)?", "https://www."),
        2: F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=news")),
        3: F.concat(bare, F.lit("#again")),
        4: F.concat(F.upper(F.regexp_extract(url, start, 0)), F.regexp_replace(url, start, "")),
        5: F.regexp_replace(url, r"^([A-Za-z]+://[^/?#:]*)", "$1:443"),
    }
    out = url
    for number, other in ways.items():
        out = F.when(way == number, other).otherwise(out)
    return out


def captures_of_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A crawl log over the whole pages table, as records for ``resolve_revisits``: up to four responses and four revisits of every page.

    Record 8 p + k is number k of page p, and the numbers are not in the order of time.  Responses: 0 (first version), 1 (second; the body
    of every third page is unchanged), 2 (third, in the same second as 1; for odd pages an error 503), 3 (fourth; every sixth page has lost its
    time).  Revisits: 4 lies between 0 and 1 and names an etag (each fifth page a stale one); 5 falls in the second of 1 and 2 and
    names a last-modified (each seventh page only the digest of the second version); 6 follows 3 with an etag (each fifth page that of
    the second version) and a new expiry; 7 has a digest alone, each ninth page no validator.  Pages with id 3 mod 4 were never
    stored in full.  Every record spells its URL in one of six ways (``respelled``).
    """
    page = pages.select(F.col(key).cast("long").alias("p"), F.col(url).alias("url"), F.md5(F.coalesce(F.col(html), F.lit(""))).alias("body")).where(F.col("p").isNotNull())
    log = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("late"), F.lit(v).alias("v")) for k, at, v in ((0, 0, 0), (1, 20, 1), (2, 20, 2), (3, 40, 3), (4, 10, 0), (5, 20, 2), (6, 50, 3), (7, 60, 3))])
    rows = page.select("*", F.inline(log)).where("k > 3 or p % 4 <> 3")
    old = ((F.col("k") == 5) & (F.col("p") % 7 == 0)) | ((F.col("k") == 6) & (F.col("p") % 5 == 1))
    rows = rows.withColumn("v", F.when(old, 1).otherwise(F.col("v")))
    rows = rows.withColumn("v", F.when((F.col("v") == 1) & (F.col("p") % 3 == 0), 0).otherwise(F.col("v")))
    rows = rows.withColumns({"digest": F.md5(F.concat("body", F.col("v").cast("string"))), "at": 1_600_000_000 + F.col("p") * 7919 % 100_000 + F.col("late")})
    full, k, p = F.col("k") < 4, F.col("k"), F.col("p")
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    sent = F.when((k == 4) & (p % 5 == 0), F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), etag))
    text = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    names = {
        "ETag": F.when(full, etag).when(k.isin(4, 6), sent),
        "Last-Modified": F.when(full | ((k == 5) & (p % 7 != 0)), text("m", F.col("v"))),
        "Date": text("t", F.col("at")),
        "Content-Type": F.when(full, "text/html").otherwise("ignored"),
        "Cache-Control": F.when(full & (k % 2 == 0), "max-age=60"),
        "Expires": F.when(k == 6, text("e", F.col("at"))),
        "Server": F.when(~full, "edge"),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in names.items()]), lambda e: e["value"].isNotNull())
    return rows.select(
        (8 * p + k).alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        respelled(F.col("url"), F.pmod(p + k, F.lit(6))).alias("url"),
        F.when(~((k == 3) & (p % 6 == 1)), F.timestamp_seconds("at")).alias("captured"),
        F.when(~full, 304).when((k == 2) & (p % 2 == 1), 503).otherwise(200).alias("status"),
        F.map_from_entries(pairs).alias("headers"),
        F.when(full | ((k == 5) & (p % 7 == 0)) | ((k == 7) & (p % 9 != 0)), F.col("digest")).alias("digest"),
    )
