"""Synthetic records, their documents and prompts: generation by expressions over a range of ids."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Mapping, Sequence
from itertools import count, product
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = ("ar", "bel", "cor", "dan", "el", "far", "gil", "hol", "is", "jor", "kel", "lin", "mor", "nal", "or", "pel")
TOWNS = ("Alderbrook", "Brightwater", "Coldharbor", "Dunmere", "Eastwick", "Fernhill", "Greyport", "Highmoor")
TEAMS = ("Accounting", "Field Work", "Archive", "Hiring", "Design", "Helpdesk", "Contracts", "Networks")
TARIFFS, AREAS, COUNTRIES = ("seedling", "sapling", "grove"), ("coast", "plain", "uplands", "delta", "isles"), ("Norvale", "Ostmark Isles", "Tarrin", "Velland")
ROADS = ("Birch Road", "Hazel Lane", "Orchard Drive", "Mill Court", "Station Ave")
INNS = ("Anchor House", "Bell Tower", "Crown Rest", "Dove Inn")

#: The sensitive and anchor fields of each family.
SENSITIVE = {
    "identity": ("email", "phone", "street_address", "employee_id"),
    "account": ("recovery_email", "customer_id", "last_four_digits", "support_ticket_id"),
    "event": ("booking_code", "travel_date", "hotel_name", "seat_number", "meeting_time"),
    "canary": ("secret",),
}
ANCHORS = {
    "identity": ("public_handle", "department", "city"),
    "account": ("public_handle", "account_plan", "support_region"),
    "event": ("public_handle", "traveler_alias", "origin_city", "destination_city"),
    "canary": ("anchor",),
}
#: What parts of a condition's name stand for, in the order of trial.
CONDITIONS = (("c0", "clean"), (0, "clean", False)), (("c1", "exact_1", "exact-1x"), (1, "exact", False)), (("c2", "exact_10", "10x"), (10, "exact", False)), (("c3", "fuzzy"), (5, "fuzzy", False)), (("c4", "redacted"), (5, "fuzzy", True)), (("c5", "20x"), (20, "exact", False))
VARIANTS = ("template_variation", "field_reordered", "lexical_paraphrase", "partial_field_omission", "formatting_variation", "distractor_variant")
LOW_OVERLAP = ("partial_field_omission", "distractor_variant", "field_reordered", "lexical_paraphrase", "formatting_variation")
HIGH_OVERLAP = ("template_variation", "field_reordered", "formatting_variation", "lexical_paraphrase", "template_variation")


def draw(idx: Column, salt: str, n: int, seed: int) -> Column:
    """A number below n that only id, salt and seed decide."""
    return F.pmod(F.xxhash64(idx, F.lit(f"{seed}:{salt}")), F.lit(n)).cast("int")


def one_of(values: Sequence[str], idx: Column, salt: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), draw(idx, salt, len(values), seed) + 1)


def _name(idx: Column, salt: str, seed: int) -> Column:
    return F.concat(one_of(SYLLABLES, idx, f"{salt}1", seed), one_of(SYLLABLES, idx, f"{salt}2", seed))


def shuffled(idx: Column, size: int, salt: str, seed: int) -> Column:
    """A number below size that no other of size ids in a row has: a step through the residues, coprime to them, drawn by salt and seed."""
    drawn = int(hashlib.sha256(f"{seed}:{salt}".encode()).hexdigest()[:8], 16)
    step = next(k for k in count(drawn % size + 1) if gcd(k, size) == 1)
    return F.pmod(idx * F.lit(step % size).cast("long") + F.lit(drawn // size), F.lit(size).cast("long"))


def digits(idx: Column, n: int, salt: str, seed: int) -> Column:
    return F.lpad(shuffled(idx, 10**n, salt, seed).cast("string"), n, "0")


def letters(idx: Column, n: int, salt: str, seed: int) -> Column:
    """Capitals: the number in base 26, whose figures are 0 to 9 and A to P."""
    figures = F.lpad(F.conv(shuffled(idx, 26**n, salt, seed).cast("string"), 10, 26), n, "0")
    return F.translate(figures, string.digits + string.ascii_uppercase[:16], string.ascii_uppercase)


def day(idx: Column, seed: int) -> Column:
    return F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), shuffled(idx, 25_000, "day", seed).cast("int")), "yyyy-MM-dd")


def _fields(family: str, idx: Column, seed: int, domain: str) -> Column:
    """Values in the formats that the extractors know; numbers of a field are all different as long as its digits allow."""
    first, last = _name(idx, "first", seed), _name(idx, "last", seed)
    of_number = lambda salt, n: digits(idx, n, salt, seed)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    quarter = draw(idx, "quarter", 48, seed)  # of an hour, from seven in the morning on
    of: dict[str, Column] = {
        "identity": lambda: {
            "full_name": F.initcap(F.concat_ws(" ", first, last)),
            "email": said(first, ".", last, ".", of_number("mail", 4), "@", domain),
            "phone": said("+1-555-01", of_number("exchange", 2), "-", of_number("line", 4)),
            "street_address": said((shuffled(idx, 90_000, "house", seed) + 1).cast("string"), " ", one_of(ROADS, idx, "road", seed)),
            "city": one_of(TOWNS, idx, "city", seed),
            "country": one_of(COUNTRIES, idx, "country", seed),
            "employee_id": said("EMP-", of_number("staff", 6)),
            "department": one_of(TEAMS, idx, "team", seed),
            "manager_name": F.initcap(F.concat_ws(" ", _name(idx, "boss", seed), _name(idx, "boss2", seed))),
        },
        "account": lambda: {
            "username": said(first, "_", last, "_", of_number("user", 3)),
            "customer_id": said("CUST-", of_number("customer", 6)),
            "support_ticket_id": said("TKT-", of_number("ticket", 6)),
            "recovery_email": said(first, ".", last, ".alt.", of_number("spare", 4), "@", domain),
            "last_four_digits": of_number("card", 4),
            "account_plan": one_of(TARIFFS, idx, "plan", seed),
            "support_region": one_of(AREAS, idx, "area", seed),
        },
        "event": lambda: {
            "traveler_alias": said(first, "_", of_number("alias", 3)),
            "booking_code": said(letters(idx, 3, "booking", seed), of_number("booking", 5)),
            "origin_city": one_of(TOWNS[:4], idx, "from", seed),
            "destination_city": one_of(TOWNS[4:], idx, "to", seed),
            "travel_date": day(idx, seed),
            "hotel_name": said(one_of(INNS, idx, "inn", seed), " Wing ", of_number("wing", 4)),
            "seat_number": said(letters(idx, 1, "seat", seed), of_number("row", 2), "-", of_number("coach", 4)),
            "meeting_time": said(day(idx, seed), "T", F.format_string("%02d:%02d", F.floor(quarter / 4) + 7, F.pmod(quarter, F.lit(4)) * 15)),
        },
        "canary": lambda: {"anchor": said("vault_anchor_", letters(idx, 8, "handle", seed)), "secret": said("quell-marn-", of_number("secret", 4), "-osk"), "canary_id": F.format_string("canary_%06d", idx)},
    }[family]()
    return F.create_map(*(x for k, v in of.items() for x in (F.lit(k), v)))


def generate(spark: SparkSession, splits: Sequence[tuple[str, str, int]], canaries: int = 0, seed: int = 1, families: Mapping[str, float] | None = None, repetitions: Sequence[int] = (1, 2, 5, 10, 20), domain: str = "example-synth.org") -> DataFrame:
    """Records numbered through splits of (split, membership, count), families by weight, and canaries after them."""
    shares = families or {"identity": 0.4, "account": 0.3, "event": 0.3}
    total = sum(n for _, _, n in splits)
    idx = F.col("idx")
    rows = spark.range(1, total + canaries + 1).withColumnRenamed("id", "idx")
    split, side, start = F.lit("train_member"), F.lit("member"), 0
    bounds = []
    for name, membership, n in splits:
        bounds.append((start + n, name, membership))
        start += n
    for end, name, membership in reversed(bounds):
        split, side = F.when(idx <= end, name).otherwise(split), F.when(idx <= end, membership).otherwise(side)
    ticket = draw(idx, "family", 1_000_000, seed) / 1e6
    family, low = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        low -= share
        family = F.when(ticket >= low, family).otherwise(name) if name == list(shares)[-1] else F.when(ticket < low + share, name).otherwise(family)
    family = F.when(idx > total, "canary").otherwise(family)
    every = list(dict.fromkeys([*shares, *(["canary"] if canaries else [])]))
    rows = rows.withColumns({"family": family, "split": split, "membership": side})

    def pick(values: Mapping[str, Column]) -> Column:
        out = F.lit(None)
        for f in every:
            out = F.when(F.col("family") == f, values[f]).otherwise(out)
        return out

    names = lambda table: {f: F.array(*map(F.lit, table[f])) for f in every}
    prefix = {"identity": "profile_anchor_", "account": "support_anchor_", "event": "travel_anchor_", "canary": "vault_anchor_"}
    bucket = F.when(F.col("family") == "canary", F.concat(F.element_at(F.array(*(F.lit(str(r)) for r in repetitions)), (F.pmod(idx - total - 1, F.lit(len(repetitions))) + 1).cast("int")), F.lit("x"))).otherwise("1x")
    return rows.select(
        F.when(F.col("family") == "canary", F.format_string("canary_%06d", idx)).otherwise(F.format_string("rec_%06d", idx)).alias("record_id"),
        "family", "split", "membership",
        F.when(F.col("family") == "canary", F.format_string("cluster_canary_%06d", idx)).otherwise(F.format_string("cluster_%06d", idx)).alias("cluster_id"),
        F.concat(pick({f: F.lit(prefix[f]) for f in every}), letters(idx, 8, "handle", seed)).alias("public_handle"),
        pick({f: _fields(f, idx, seed, domain) for f in every}).alias("fields"),
        pick(names(SENSITIVE)).alias("sensitive_fields"), pick(names(ANCHORS)).alias("anchor_fields"),
        bucket.alias("repetition_bucket"), F.lit(seed).alias("created_seed"),
    )


def condition_settings(condition: str, repeat_count: int | None = None, variant_mode: str | None = None, redact: bool = False) -> tuple[int, str, bool]:
    """(documents a record, exact or fuzzy or clean, redacted): given values first, then what the name says."""
    if repeat_count is not None:
        return repeat_count, (variant_mode or ("exact" if repeat_count <= 1 else "fuzzy")).lower(), redact
    name = condition.lower()
    for kind in ("exact", "fuzzy", "redacted"):
        if m := re.search(rf"{kind}[_-]?(\d+)x", name):
            return int(m[1]), "exact" if kind == "exact" else "fuzzy", kind == "redacted" or (kind == "fuzzy" and "redacted" in name)
    return next((settings for parts, settings in CONDITIONS if any(p in name for p in parts)), (1, "exact", False))


def condition_columns(name: Column) -> Column:
    """documents, mode and redacted of a condition's name, as ``condition_settings`` reads it without further settings."""
    of = lambda documents, mode, redacted: F.struct(F.lit(documents).alias("documents") if isinstance(documents, int) else documents.alias("documents"), F.lit(mode).alias("mode"), (F.lit(redacted) if isinstance(redacted, bool) else redacted).alias("redacted"))
    low = F.lower(name)
    out = of(1, "exact", False)
    for parts, settings in reversed(CONDITIONS):
        out = F.when(low.rlike("|".join(map(re.escape, parts))), of(*settings)).otherwise(out)
    for kind in ("redacted", "fuzzy", "exact"):
        number = F.regexp_extract(low, rf"{kind}[_-]?(\d+)x", 1)
        told = of(number.cast("int"), "exact" if kind == "exact" else "fuzzy", F.lit(kind == "redacted") | F.lit(kind == "fuzzy") & F.contains(low, F.lit("redacted")))
        out = F.when(number != "", told).otherwise(out)
    return out


def mask(field: Column) -> Column:
    """What stands for a redacted value, by the field's name.  Fixed values: parts of names in the order of trial, and the masks."""
    has = lambda *parts: field.rlike("|".join(parts))
    return (
        F.when(has("email"), "masked@example-synth.org").when(has("phone"), "+1-555-0100-0000").when(has("address"), "[REDACTED_ADDRESS]")
        .when(has("id", "digits", "code"), "[REDACTED_ID]").when(has("date", "time"), "[REDACTED_TIME]").when(has("secret"), "[REDACTED_SECRET]").otherwise("[REDACTED]")
    )


#: Kinds of sheets that a record of a family may be copied onto, how such a sheet goes on, and how it ends.
SHEETS: Mapping[str, Sequence[str]] = {
    "identity": ("Name badge order", "Choir roll", "Bicycle registration", "Allotment waiting list", "Blood donor card"),
    "account": ("Lost parcel claim", "Meter reading slip", "Library fine", "Warranty return", "Swimming pass renewal"),
    "event": ("Ferry manifest", "Night train berth chart", "Festival wristband list", "Mountain hut booking", "Regatta start list"),
    "canary": ("Sealed envelope", "Time capsule inventory", "Lighthouse logbook", "Cellar tally", "Beekeeper's diary"),
}
HANDS, ENDS = ("filled in with", "carrying", "copied from a slate that reads", "which repeats"), ("second sheet of two", "ink still wet")
#: What fields are called on a sheet: usually the first name, any of them in a paraphrase.
LABELS: Mapping[str, Sequence[str]] = {
    "email": ("mail", "writes from", "inbox", "send letters to"),
    "phone": ("rings at", "telephone", "call"),
    "street_address": ("lives at", "front door", "deliver to"),
    "employee_id": ("badge", "payroll mark", "works number"),
    "recovery_email": ("second inbox", "if locked out, write to", "spare mail"),
    "customer_id": ("buyer mark", "number in the books", "client number"),
    "last_four_digits": ("card ends in", "tail of the card", "final digits"),
    "support_ticket_id": ("complaint number", "slip", "query filed as"),
    "booking_code": ("reservation", "code at the gate", "ticket mark"),
    "travel_date": ("leaves on", "day of the journey", "sails"),
    "hotel_name": ("sleeps at", "bed in", "inn"),
    "seat_number": ("place", "row and letter", "sits in"),
    "meeting_time": ("met at", "hour agreed", "expected at"),
    "secret": ("words inside", "the line to keep", "phrase"),
}


def catalogue(spark: SparkSession, sheets: Mapping[str, Sequence[str]] = SHEETS) -> DataFrame:
    """family, number, template_id, sheet, hand, end: all combinations of a family."""
    rows = [(f, k, f"{f}_template_{k + 1:02d}", *parts) for f, of in sheets.items() for k, parts in enumerate(product(of, HANDS, ENDS))]
    return spark.createDataFrame(rows, "family string, number int, template_id string, sheet string, hand string, end string")


def render(records: DataFrame, condition: str, seed: int = 1, include: Sequence[str] = (), exclude: Sequence[str] = (), overlap: str = "", labels: Mapping[str, Sequence[str]] = LABELS, sheets: Mapping[str, Sequence[str]] = SHEETS, **settings: object) -> DataFrame:
    """Documents of the member records: doc_id, record_id, cluster_id, condition, variant_type, template_id, family, text, included_sensitive_fields, sha256.

    Canaries are left out unless the condition's name or include asks for them.
    """
    spark = records.sparkSession
    copies, mode, redact = condition_settings(condition, **settings)
    left_out = list(exclude) + (["canary"] if not any(x in condition.lower() for x in ("canary", "c5")) and "canary" not in include else [])
    rows = records.filter((F.col("membership") == "member") & ~F.col("family").isin(*left_out) if left_out else F.col("membership") == "member")
    if include:
        rows = rows.filter(F.col("family").isin(*include))
    cycle = ("exact_duplicate",) if mode == "exact" else {"low": LOW_OVERLAP, "high": HIGH_OVERLAP}.get(overlap.lower(), VARIANTS)
    if copies <= 0:
        rows = rows.limit(0)
    k = F.col("_k")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max(copies, 1) - 1))))
    variant = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(k, F.lit(len(cycle))) + 1).cast("int"))
    templates = catalogue(spark, sheets)
    size = F.create_map(*(F.lit(x) for f, of in sheets.items() for x in (f, len(of) * len(HANDS) * len(ENDS))))[F.col("family")]
    rows = rows.withColumns({"variant_type": variant, "number": F.pmod(k, size).cast("int")}).join(F.broadcast(templates), ["family", "number"])
    v, secret = F.col("variant_type"), F.col("sensitive_fields")
    names = F.map_keys("fields")
    kept = F.when(v == "partial_field_omission", F.filter(names, lambda n: n != F.element_at(secret, -1))).otherwise(names)
    mixed = F.transform(F.array_sort(F.transform(kept, lambda n: F.struct(F.xxhash64("record_id", k, n, F.lit(seed)).alias("h"), n.alias("n")))), lambda s: s["n"])
    ordered = F.when(v == "field_reordered", mixed).otherwise(kept)

    def label(n: Column) -> Column:
        plain = F.replace(n, F.lit("_"), F.lit(" "))
        if not labels:
            return plain
        table = F.create_map(*(x for f, options in labels.items() for x in (F.lit(f), F.array(*map(F.lit, options)))))
        options = table[n]
        chosen = F.when(v == "lexical_paraphrase", F.element_at(options, (F.pmod(F.xxhash64("record_id", k, n, F.lit(seed)), F.size(options)) + 1).cast("int"))).otherwise(options[0])
        return F.coalesce(chosen, plain)

    def line(n: Column) -> Column:
        value = F.col("fields")[n]
        shown = F.when(F.array_contains(secret, n), mask(n)).otherwise(value) if redact else value
        return F.concat(label(n), F.lit(": "), F.coalesce(shown, F.lit("")))

    lines = F.transform(ordered, line)
    lines = F.when(v == "distractor_variant", F.array_append(lines, F.lit("stapled behind it is a sheet about somebody else"))).otherwise(lines)
    body = F.when(v == "formatting_variation", F.concat(F.lit("\n- "), F.array_join(lines, "\n- "))).otherwise(F.array_join(lines, "; "))
    text = F.concat("sheet", F.lit(" "), "public_handle", F.lit(", "), "hand", F.lit(": "), body, F.lit(" ["), "end", F.lit("]"))
    out = rows.select(
        F.concat("record_id", F.lit("_v"), (k + 1).cast("string")).alias("doc_id"), "record_id", "cluster_id", F.lit(condition).alias("condition"), "variant_type", "template_id", "family",
        text.alias("text"), F.filter(ordered, lambda n: F.array_contains(secret, n)).alias("included_sensitive_fields"),
    )
    return out.withColumn("sha256", F.sha2("text", 256))


def filter_rendered(docs: DataFrame, families: Sequence[str] = (), records: Sequence[str] = (), memberships: Sequence[str] = ()) -> DataFrame:
    """Documents of the named families, records and memberships; an empty list asks for nothing, a missing column matches none."""
    for column, wanted in (("family", families), ("record_id", records), ("membership", memberships)):
        if wanted:
            docs = docs.filter(F.col(column).isin(*wanted)) if column in docs.columns else docs.limit(0)
    return docs
