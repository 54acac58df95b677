"""Importance resampling of documents towards a target distribution of hashed n-grams.

Words of all documents are rows of a position table; ``lead`` over a document's positions gives the words that follow, so
the runs of each order start at each position.  A run's bucket is its CRC-32 modulo the number of buckets.  Bucket counts of
the documents and of the target texts give a gain for each bucket (add-one smoothed, floored to thousandths of a natural
logarithm); gains are joined back and averaged by document.  Of the documents with enough words, those with the
highest weight plus Gumbel noise (from SHA-256 of seed and id) are drawn: a sample without replacement in which a
document's chance follows its importance weight.

Texts are dealt by row before they become words, so a document's words lie in one task and the words are never shuffled; the
table of gains has as many rows as there are buckets, which bounds its broadcast.  Ranks come from running counts over
ranges of the order (``ordered``).

Defined cases: null and empty texts have no features and weight 0; they and other short documents are not eligible, but
are scored.  A null id is the string "null" in the noise and comes last among ties; rows that repeat take a rank
each.  Without target texts or without documents, counts are 0 and the gains follow the formula.  Other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored
from tidemark.llm.ordered import copies, sums_before

#: What separates words: all of ASCII but digits and a to z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), BETWEEN), "")


def features(rows: DataFrame, key: str, text: str, orders: int, buckets: int) -> DataFrame:
    """_row, _key, and b1 to b<orders>: the buckets of the runs that start at one word; null where the text ends first.

    A row without words has one row of nulls.
    """
    dealt = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).repartition("_row")
    table = dealt.select("_row", "_key", F.posexplode_outer(words(F.col("_text"))).alias("_at", "_word"))
    along = Window.partitionBy("_row").orderBy("_at")
    table = table.withColumns({f"_next{k}": F.lead("_word", k).over(along) for k in range(1, orders)})
    runs = [F.concat_ws(" ", "_word", *(f"_next{i}" for i in range(1, k))) for k in range(1, orders + 1)]
    whole = [F.col("_word" if k == 1 else f"_next{k - 1}").isNotNull() for k in range(1, orders + 1)]
    return table.select("_row", "_key", *(F.when(w, F.pmod(F.crc32(r.cast("binary")), F.lit(buckets)).cast("int")).alias(f"b{k}") for k, (r, w) in enumerate(zip(runs, whole, strict=True), 1)))


def bucket_counts(found: DataFrame, orders: int, name: str) -> DataFrame:
    each = found.select(F.explode(F.array(*(f"b{k}" for k in range(1, orders + 1)))).alias("bucket")).filter("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: one row for each bucket, seen or not. source, target: bucket and its count, named s and t."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    of = every.join(source, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    totals = of.agg(F.sum("s").alias("_all_s"), F.sum("t").alias("_all_t"))
    of = of.join(F.broadcast(totals))
    up = (F.col("t") + 1).cast("double") * (F.col("_all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("_all_t") + buckets).cast("double")
    return of.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of ``seed:key``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def score(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, n_words, n_features, weight and score of each row of docs. target: rows with a column ``text``."""
    found = stored(features(docs, key, text, orders, buckets), "features")
    names = [f"b{k}" for k in range(1, orders + 1)]
    wanted = bucket_counts(features(target, "text", "text", orders, buckets), orders, "t")
    table = stored(gains(bucket_counts(found, orders, "s"), wanted, buckets), "gains")
    for b in names:
        found = found.join(F.broadcast(table.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))), b, "left")
    gain = sum((F.coalesce(f"g_{b}", F.lit(0)) for b in names), F.lit(0).cast("long"))
    n = sum((F.col(b).isNotNull().cast("long") for b in names), F.lit(0).cast("long"))
    by_row = found.groupBy("_row", "_key").agg(F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(gain).alias("_gain"))
    # the floor of the mean in whole numbers
    weight = F.when(F.col("n_features") > 0, F.expr("(_gain - pmod(_gain, n_features)) div n_features")).otherwise(0)
    by_row = by_row.withColumn("weight", weight.cast("long"))
    return by_row.select("_key", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("_key"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """key, n_features, weight, score and rank of each row; rank is null for those that are not drawn."""
    scored = score(docs, target, key=key, text=text, **how).withColumn("_eligible", F.col("n_words") >= least_words)
    alike = stored(scored.groupBy("_key", "n_features", "weight", "score", "_eligible").agg(F.count("*").alias("_n")), "scored")
    eligible = alike.filter("_eligible")
    drawn = (percent * (eligible.agg(F.sum("_n")).first()[0] or 0)) // 100
    order = [F.col("score").desc(), F.col("_key").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = sums_before(eligible, [], order, {"_before": "_n"}).unionByName(alike.filter("NOT _eligible"), allowMissingColumns=True)
    place = F.col("_before") + F.col("_copy") + 1
    out = copies(ranked, "_n", "_copy").withColumn("rank", F.when(place <= drawn, place))
    return out.select(F.col("_key").alias(key), "n_features", "weight", "score", "rank")
