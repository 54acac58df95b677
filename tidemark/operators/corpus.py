"""Background corpora: filters, contamination, duplicates, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_space, key_signature, match_key, repeat_to, token_count
from tidemark.operators.containment import flagged, with_any
from tidemark.operators.pools import training_selection
from tidemark.operators.sampling import cyclic_budget, running, token_budget, train_validation


def terms(values: DataFrame, column: str, least: int = 6) -> DataFrame:
    """The distinct match keys of the values, of least characters or more."""
    return values.select(match_key(F.col(column)).alias("term")).filter(F.char_length("term") >= least).distinct()


def record_terms(records: DataFrame, least: int = 6) -> DataFrame:
    """Of handles and of all field values, sensitive or not."""
    every = F.concat(F.array("public_handle"), F.map_values("fields"))
    return terms(records.select(F.explode(every).alias("value")).filter("value IS NOT NULL"), "value", least)


def contains_any(docs: DataFrame, found: DataFrame, text: str = "text", name: str = "contaminated") -> DataFrame:
    """Adds whether the text's match key contains any term (term of found)."""
    return with_any(docs, found, match_key(F.coalesce(F.col(text), F.lit(""))), name)


def statuses(docs: DataFrame, found: DataFrame | None = None, least_tokens: int = 40, exact: bool = True, near: bool = True, order: str = "doc_id", text: str = "text") -> DataFrame:
    """order, tokens and status of each document: short, contamination, exact_dupe, near_dupe or kept, in this order of tests.

    With both tests the kept document of a signature is its first; another counts as exact if it has that one's key.
    Only hashes meet, of terms as well: a group's first is a grouped minimum, joined back.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(order, token_count(plain).alias("tokens"), match_key(plain).alias("_text"))
    rows = rows.select(order, "tokens", F.md5("_text").alias("_key"), F.sha2("_text", 256).alias("_exact"), key_signature(F.col("_text")).alias("_near"))
    if found is not None:
        rows = flagged(rows, "_key", docs.select(match_key(plain).alias("hay")), found, "contaminated")
    else:
        rows = rows.withColumn("contaminated", F.lit(False))
    rows = rows.withColumn("_first", F.when(F.col("tokens") < least_tokens, "short").when(F.col("contaminated"), "contamination"))
    if not exact and not near:
        return rows.select(order, "tokens", F.coalesce("_first", F.lit("kept")).alias("status"))
    key = "_near" if near else "_exact"
    firsts = rows.filter("_first IS NULL").groupBy(key).agg(F.min(F.struct(order, "_exact")).alias("_kept"))
    joined = rows.join(firsts, key, "left")
    same = F.col("_kept._exact") == F.col("_exact") if exact else F.lit(False)
    status = F.coalesce("_first", F.when(F.col(order) == F.col(f"_kept.{order}"), "kept").when(same, "exact_dupe").otherwise("near_dupe"))
    return joined.select(order, "tokens", status.alias("status"))


def prepare(docs: DataFrame, found: DataFrame | None = None, order: str = "doc_id", **options: object) -> DataFrame:
    """The documents that stay, text with white space collapsed."""
    kept = statuses(docs, found, order=order, **options).filter("status = 'kept'").select(order)
    return docs.join(kept, order, "left_semi").withColumn("text", collapse_space(F.col("text")))


def status_counts(status: DataFrame) -> DataFrame:
    of = F.col("status")
    return status.agg(F.count("*").alias("source_documents"), *(F.count_if(of == s).alias(f"filtered_{s}") for s in ("short", "contamination", "exact_dupe", "near_dupe")), F.count_if(of == "kept").alias("kept_documents"))


def mixed(background: DataFrame, rendered: DataFrame, background_tokens: int, synthetic_tokens: int, seed: int, fraction: float = 0.1, reuse: bool = False, least_validation: int = 200) -> DataFrame:
    """doc_id, text, origin, split, tokens, position of a corpus: sampled background and cyclically repeated rendered documents.

    Validation has background of its own and the first tenth of the chosen rendered documents.  position orders each split.
    """
    docs = train_validation(_counted(background), fraction, seed)
    return _assembled(docs, cyclic_budget(_counted(rendered), synthetic_tokens, seed), background_tokens, seed, fraction, reuse, least_validation)


def prebuilt(train: DataFrame, validation: DataFrame, rendered: DataFrame, background_tokens: int, synthetic_tokens: int, seed: int, fraction: float = 0.1, reuse: bool = False, least_validation: int = 200) -> DataFrame:
    """The same of a bundle whose background is split already."""
    sides = [df.select("doc_id", "text").withColumn("split", F.lit(split)) for df, split in ((train, "train"), (validation, "validation"))]
    return _assembled(_counted(sides[0].unionByName(sides[1])), cyclic_budget(_counted(rendered), synthetic_tokens, seed), background_tokens, seed, fraction, reuse, least_validation)


def augmented(background: DataFrame, rendered: DataFrame, targets: DataFrame, background_tokens: int, seed: int, fraction: float = 0.1, reuse: bool = False, least_validation: int = 200) -> DataFrame:
    """A clean corpus to which all documents of the targets' records (record_id) are added once: what they alone do to a model."""
    chosen = _counted(training_selection(rendered, targets)).withColumn("epoch", F.lit(0))
    return _assembled(train_validation(_counted(background), fraction, seed), chosen, background_tokens, seed, fraction, reuse, least_validation)


def legacy(background: DataFrame, rendered: DataFrame, background_tokens: int, seed: int, fraction: float = 0.1, least_validation: int = 200) -> DataFrame:
    """The same of one background text (a row), repeated until it has the tokens; validation has the text read backwards.

    All rendered documents are taken once.
    """
    text = F.coalesce("text", F.lit(""))
    sides = (("train", text, background_tokens), ("validation", F.reverse(text), max(least_validation, round(background_tokens * fraction))))
    parts = [background.select(F.lit("background").alias("doc_id"), repeat_to(of, n).alias("text"), F.lit("background").alias("origin"), F.lit(split).alias("split"), F.lit(n).cast("long").alias("tokens")) for split, of, n in sides]
    chosen = _counted(rendered).select(F.col("doc_id").cast("string"), "text", "tokens", F.lit(0).alias("epoch"))
    return _ordered(parts + _rendered_parts(chosen, seed), seed)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", token_count(F.col("text")).cast("long"))


def _assembled(docs: DataFrame, chosen: DataFrame, background_tokens: int, seed: int, fraction: float, reuse: bool, least_validation: int) -> DataFrame:
    """docs (doc_id, text, tokens, split) up to the budgets, and the chosen rendered documents (doc_id, text, tokens, epoch)."""
    take = cyclic_budget if reuse else token_budget
    parts = []
    for split, target, salt in (("train", background_tokens, 1), ("validation", max(least_validation, round(background_tokens * fraction)), 2)):
        part = take(docs.filter(F.col("split") == split), target, seed + salt)
        parts.append(part.select("doc_id", "text", F.lit("background").alias("origin"), "split", "tokens"))
    return _ordered(parts + _rendered_parts(chosen, seed), seed)


def _rendered_parts(chosen: DataFrame, seed: int) -> list[DataFrame]:
    """All for training, and the first tenth in seeded order for validation."""
    n = chosen.count()
    picked = running(chosen.withColumn("_key", F.concat_ws(":", "epoch", "doc_id")), "_key", seed, name="_rank")
    out = picked.select("doc_id", "text", F.lit("rendered").alias("origin"), F.lit("train").alias("split"), "tokens", "_rank")
    return [out.drop("_rank"), out.filter(F.col("_rank") < max(1, n // 10)).withColumn("split", F.lit("validation")).drop("_rank")]


def _ordered(parts: list[DataFrame], seed: int) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return running(out.withColumn("_key", F.concat_ws(":", "origin", "doc_id")), "_key", seed, by=["split"], name="position").drop("_key")
