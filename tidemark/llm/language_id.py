"""Language identification by fusing evidence.

The posterior of a language is, in logarithms and up to a constant, the sum of

* the text's likelihood by trigrams of letters, tempered since trigrams overlap;
* P(declared language | language) and P(address suffix | language), from counts over all rows;
* P(language | host), which leans on P(language | domain), which leans on P(language), each with ``LEAN`` rows of weight.

Counts come from grouped aggregation of each row's likeliest language by its text.  The class "und" stands for none of the
known languages and has equal chances for all trigrams.  A row is kept if its best language is a known one with a posterior of
``LEAST`` or more and its text has letters.

The known languages are the labels of rows whose text has letters, by a grouped count over all rows; of a label the first
subtag counts, in lower case, as it does of a declaration.  Beyond ``MOST_LANGUAGES`` of them, each of which costs the driver the weights of all trigrams, the
rarest are no languages, and their rows end as "und" or as what they resemble.  Their trigram chances
are fitted on a sample of about ``SAMPLE_ROWS`` rows a label, or all if it has fewer (``SAMPLE_CHARS`` characters of each,
from the first letter on), chosen by a hash of id and text; copies count once.  Everything else covers all rows and whole texts.

Defined cases: null text, source, address or declaration is missing evidence; a row without letters is not kept and has the
language that the other evidence tells; ties go to the language that sorts first; repeated rows are each answered; an
empty table gives no rows; other columns are ignored.  Without labelled rows all is "und".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks, stored

SAMPLE_ROWS, SAMPLE_CHARS = 2000, 4000
TEMPER, LEAN, LEAST, FLOOR, UNKNOWN = 0.25, 20.0, 0.5, 0.5, 1e-3
UND = "und"
#: Known languages, and numbers of an evidence table that may be broadcast.
MOST_LANGUAGES, BROADCAST_NUMBERS = 1000, 4_000_000
CHUNK = 1_000_000
_BITS = 16
#: A letter, as trigrams have them.
_ANY = r"[A-Za-z\x{80}-\x{10FFFF}]"
_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, each text's first one, and its number of letters' bytes."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(d) + 2 for d in data)])
    raw = _LETTER[np.frombuffer(b"  ".join([b"", *data, b""]), np.uint8)]
    letters = np.concatenate([[0], np.cumsum(raw != 32)])
    if len(raw) < 3:
        return np.zeros(0, np.uint32), at[:-1], np.zeros(len(texts), np.int64)
    x = raw.astype(np.uint32)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    blank = (x[:-2] == 32) & (x[1:-1] == 32)
    found = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - _BITS)
    found[blank] = 0  # says nothing: the weights of 0 are 0
    return found, at[:-1], letters[at[1:]] - letters[at[:-1]]


class TextModel(NamedTuple):
    """languages, "und" last; weights: language by trigram, less those of "und"."""

    languages: list[str]
    weights: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, trigram, n of rows (label, h, text)."""
    for batch in batches:
        labels, texts = np.array(batch.column("label").to_pylist(), object), batch.column("text").to_pylist()
        for lo, hi in chunks(texts, CHUNK):
            for name in sorted(set(labels[lo:hi])):
                n = np.bincount(trigrams([texts[i] for i in range(lo, hi) if labels[i] == name])[0], minlength=1 << _BITS)
                seen = np.flatnonzero(n)
                yield pa.record_batch([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["label", "trigram", "n"])


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, most_languages: int = MOST_LANGUAGES) -> TextModel:
    # most texts show a letter early, which spares matching them whole
    labelled = rows.select(_subtag(F.col(label)).alias("label"), F.col(text).cast("string").alias("text"), F.col(key).alias("k")).filter((F.col("label") != UND) & (F.substring("text", 1, 200).rlike(_ANY) | F.col("text").rlike(_ANY)))
    labelled = labelled.select("label", "text", F.xxhash64("k", "text").alias("h"))
    inventory = labelled.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"), F.count("*").alias("rows"))
    inventory = inventory.orderBy(F.desc("rows"), "label").limit(most_languages).collect()
    languages = sorted(r.label for r in inventory)
    counts = np.full((len(languages), 1 << _BITS), FLOOR)
    if languages:
        # rows whose hash is small enough for as many as are wanted, and the first by hash in any case
        bounds = [(r.label, max(r.least, min(int(-(2**63) + min(1.0, sample_rows / max(r.n, 1)) * 2**64), 2**63 - 1))) for r in inventory]
        drawn = labelled.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "label string, most long")), "label").filter(F.col("h") <= F.col("most"))
        sample = drawn.select("label", "h", F.regexp_extract("text", f"(?s){_ANY}.{{0,{sample_chars - 1}}}", 0).alias("text")).dropDuplicates(["label", "h"])
        sums = sample.mapInArrow(_counted, "label string, trigram int, n long").groupBy("label", "trigram").agg(F.sum("n").alias("n")).toArrow()
        at = {name: k for k, name in enumerate(languages)}
        np.add.at(counts, (np.array([at[x] for x in sums["label"].to_pylist()], int), sums["trigram"].to_numpy()), sums["n"].to_numpy())
    counts[:, 0] = FLOOR
    weights = np.zeros(counts.shape, np.float32)
    for k, of in enumerate(counts):
        weights[k] = np.log(of / of.sum()) + _BITS * math.log(2)
    weights[:, 0] = 0
    return TextModel([*languages, UND], weights)


def likelihoods(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (key, declared, suffix, host, domain, text) with logs, an array by language, and letters instead of text."""
    n = len(model.languages)
    keep = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                found, first, letters = trigrams(texts[lo:hi])
                logs = np.zeros((hi - lo, n))
                if len(found):
                    for k in range(n - 1):
                        logs[:, k] = TEMPER * np.add.reduceat(model.weights[k][found], np.minimum(first, len(found) - 1), dtype=np.float64)
                logs[letters == 0] = 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * (hi - lo) + 1, n), pa.int32()), pa.array(logs.ravel()))
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in keep), lists, pa.array(letters, pa.int64())], names=[*keep, "logs", "letters"])

    return rows.mapInArrow(score, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + ["logs array<double>", "letters bigint"]))


def _best(values: Column, n: int) -> Column:
    """The first index of the largest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def evidence_counts(rows: DataFrame, n: int) -> DataFrame:
    """by, value, counts: rows by guessed language for each value of each kind of evidence, and under by "all" for all rows."""
    kinds = ("declared", "suffix", "host", "domain")
    pairs = F.array(F.struct(F.lit("all").alias("by"), F.lit("").alias("value")), *(F.struct(F.lit(by).alias("by"), F.col(by).alias("value")) for by in kinds))
    each = rows.select("guess", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_p")).select("guess", "_p.*")
    return each.groupBy("by", "value").agg(F.array(*(F.sum(F.when(F.col("guess") == k, 1.0).otherwise(0.0)) for k in range(n))).alias("counts"))


def _with_counts(rows: DataFrame, counts: DataFrame, by: str, n: int, most: int) -> DataFrame:
    """Adds <by>_counts, null where the value is null. n: values; only rows with one meet a table that is too large to be broadcast."""
    name = f"{by}_counts"
    own = counts.filter(F.col("by") == by).select(F.col("value").alias(by), F.col("counts").alias(name))
    if not n:
        return rows.withColumn(name, F.lit(None).cast("array<double>"))
    if n <= most:
        return rows.join(F.broadcast(own), by, "left")
    return rows.filter(F.col(by).isNotNull()).join(own, by).unionByName(rows.filter(F.col(by).isNull()).withColumn(name, F.lit(None).cast("array<double>")))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """key, lang, posterior, letters, kept for rows (key, text, declared, suffix, host, domain)."""
    names = model.languages
    n = len(names)
    wanted = ["key", "declared", "suffix", "host", "domain"]
    scored = likelihoods(rows.select(*(F.col(c) for c in wanted), F.col("text").cast("string").alias("text")), model)
    scored = stored(scored.withColumn("guess", F.when(F.col("letters") > 0, _best(F.col("logs"), n))), "likelihoods")
    counts = stored(evidence_counts(scored, n), "evidence")
    values = {r["by"]: r["n"] for r in counts.groupBy("by").agg(F.count("*").alias("n")).collect()}  # a row a kind
    total = counts.filter(F.col("by") == "all").first()
    seen = [float(x) for x in total.counts] if total else [0.0] * n
    overall = [(seen[k] + 1) / (sum(seen[:-1]) + n - 1) * (1 - UNKNOWN) for k in range(n - 1)] + [UNKNOWN]
    base = F.array(*(F.lit(x) for x in overall))
    # und keeps its small chance everywhere: hosts of unknown languages would else teach themselves
    out = scored
    for by in ("declared", "suffix", "host", "domain"):
        out = _with_counts(out, counts, by, values.get(by, 0), BROADCAST_NUMBERS // n)

    def lean(counts: str, on: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col(counts).isNull(), on).otherwise(F.zip_with(F.col(counts), on, lambda c, p: (c + LEAN * p) / (size + LEAN)))

    out = out.withColumn("_domain", lean("domain_counts", base))
    out = out.withColumn("_host", lean("host_counts", F.col("_domain")))
    evidence = F.zip_with("logs", "_host", lambda a, p: a + F.ln(p))
    for by in ("declared", "suffix"):
        # P(value | language): counts of the value over counts of the language, by one row of weight
        given = F.zip_with(F.col(f"{by}_counts"), F.array(*(F.lit(x) for x in seen)), lambda c, s: F.ln((c + 0.1) / (s + 1.0)))
        evidence = F.when(F.col(f"{by}_counts").isNull(), evidence).otherwise(F.zip_with(evidence, given, lambda a, b: a + b))
    out = out.withColumn("_all", evidence).withColumn("_top", F.array_max("_all"))
    sums = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    best = _best(F.col("_all"), n)
    out = out.select("key", F.element_at(F.array(*map(F.lit, names)), best + 1).alias("lang"), (F.lit(1.0) / sums).alias("posterior"), "letters")
    return out.withColumn("kept", (F.col("letters") > 0) & (F.col("lang") != UND) & (F.col("posterior") >= LEAST))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is their lang column; their source is the host. They have no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("key"), "text", _subtag(F.col("lang")).alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: declared in the html tag; suffix, domain (last two labels) and host of the address; text without markup."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    declared = F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1), F.lit(""))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("key"), text.alias("text"), _subtag(declared).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )


def _subtag(language: Column) -> Column:
    return F.nullif(F.lower(F.substring_index(F.trim(language.cast("string")), "-", 1)), F.lit(""))
