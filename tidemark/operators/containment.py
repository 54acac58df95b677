"""Which of many terms are contained in which texts, by anchors.

A term's pieces are its inner words (between two of its spaces: a text that contains the term has each of them as a word), or,
if it has none, its character grams.  The texts' pieces are counted, and each term's anchor is its rarest piece; a term with a piece that no
text has is nowhere.  Texts that have the anchor are candidates, and ``contains`` decides at once, where the text is read: anchors and their
terms go to all tasks, in parts of ``PART_BYTES``, a pass over the texts for each.  So the number of terms is not bound by a
task's memory, and neither texts nor their pieces are shuffled.

The count is by piece, summed where texts are read; pieces become rows only if a Bloom filter of the terms' pieces has them: the filter is one
array, of ``MOST_BITS`` at most.

Texts are told by a digest, so equal ones are one.  Null texts contain nothing; empty terms are not looked for; repeated terms are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import stored

#: Characters of a gram; shorter terms are their own grams.
GRAM = 6
BITS_A_GRAM, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 24
#: Bytes of terms that go to all tasks at once, and keys of texts that do.
PART_BYTES, BROADCAST_KEYS = 32_000_000, 500_000
#: The size that stands for words.
WORDS = 0


def grams(text: Column, n: int) -> Column:
    """All pieces of n characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def inner_words(term: Column) -> Column:
    """The words that stand between two spaces of the term; those are words of any text that contains it."""
    words = F.split(term, " ", -1)
    return F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")


def _pieces(text: Column, n: int) -> Column:
    return F.array_distinct(F.split(text, " ", -1) if n == WORDS else grams(text, n))


def _place(gram: Column, bits: int) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(bits - 1))


def _filter(found: DataFrame, bits: int) -> DataFrame:
    """words: one row, an array of longs whose bits tell the grams' places."""
    place = _place(F.col("gram"), bits)
    words = found.select(place.alias("place")).select(F.shiftright("place", 6).alias("id"), F.expr("shiftleft(1L, cast(place & 63 AS INT))").alias("bit"))
    words = words.groupBy("id").agg(F.bit_or("bit").alias("word"))
    every = found.sparkSession.range(bits >> 6).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words"))


def contained(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key, terms (an array, not empty) of the texts (hay) that contain any of wanted (term)."""
    found = _found(texts, wanted)
    return found.groupBy("text_key").agg(F.collect_set("term").alias("terms"))


def _found(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key, term of each text and each term in it; rows repeat."""
    size = F.when(F.size(inner_words(F.col("term"))) > 0, F.lit(WORDS)).otherwise(F.least(F.char_length("term"), F.lit(GRAM)))
    terms = wanted.filter("term <> ''").select("term").distinct().withColumn("n", size)
    sizes = sorted(r.n for r in terms.select("n").distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return texts.sparkSession.createDataFrame([], "text_key string, term string")
    of_term = lambda n: F.array_distinct(inner_words(F.col("term"))) if n == WORDS else _pieces(F.col("term"), n)
    own = reduce(lambda out, n: F.when(F.col("n") == n, of_term(n)).otherwise(out), sizes, F.array().cast("array<string>"))
    index = stored(terms.select("term", F.explode(own).alias("gram")), "grams")
    known = index.select("gram").distinct()
    bits = min(max(LEAST_BITS, 1 << (known.count() * BITS_A_GRAM - 1).bit_length()), MOST_BITS)
    place = _place(F.col("gram"), bits)
    passes = F.getbit(F.element_at("words", (F.shiftright(place, 6) + 1).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    hay = texts.filter("hay IS NOT NULL").select("hay")
    each = lambda df: df.select("*", F.explode(F.concat(*(_pieces(F.col("hay"), n) for n in sizes))).alias("gram"))
    rows = each(hay.join(F.broadcast(_filter(known, bits)))).filter(passes)
    seen = stored(rows.groupBy("gram").agg(F.count("*").alias("texts")).join(known, "gram", "left_semi"), "seen")
    rarest = index.join(seen, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
    anchors = stored(rarest.filter("best.texts > 0").select("term", "best.gram"), "anchors")
    parts = -(-(anchors.agg(F.sum(F.octet_length("term") + 50)).first()[0] or 1) // PART_BYTES)
    held = []
    for part in range(parts):
        some = anchors.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        held.append(each(hay).join(F.broadcast(some), "gram").filter(F.contains("hay", "term")).select(F.md5("hay").alias("text_key"), "term"))
    return reduce(DataFrame.unionByName, held)


def found_terms(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """term: those of wanted (term) that some text (hay) contains as they stand."""
    return _found(texts, wanted).select("term").distinct()


def flagged(docs: DataFrame, key: str, texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """docs with name: whether the text (hay of texts) whose MD5 is key contains any term of wanted. Beyond BROADCAST_KEYS such texts, docs are dealt by key with all they hold."""
    held = stored(_found(texts, wanted).select("text_key").distinct(), "held")
    flags = held.select(F.col("text_key").alias(key), F.lit(True).alias("__held"))
    out = docs.join(F.broadcast(flags) if held.count() <= BROADCAST_KEYS else flags, key, "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != name), F.coalesce("__held", F.lit(False)).alias(name))


def with_any(docs: DataFrame, wanted: DataFrame, hay: Column, name: str) -> DataFrame:
    """docs with name: whether hay contains any term of wanted. Only keys of the texts that do meet docs again."""
    return flagged(docs.withColumn("__key", F.md5(hay)), "__key", docs.select(hay.alias("hay")), wanted, name).drop("__key")
