"""Candidate values of twelve kinds in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_value

#: The patterns of the kinds, case aside.
PATTERNS = {
    "email": r"\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b",
    "phone": r"\+?\d[\d\-\s]{7,}\d",
    "employee_id": r"\bemp-\d{6,}\b",
    "customer_id": r"\bcust-\d{6,}\b",
    "support_ticket_id": r"\btkt-\d{6,}\b",
    "booking_code": r"\b[a-z]{3}\d{5}\b",
    "travel_date": r"\b\d{4}-\d{2}-\d{2}\b",
    "meeting_time": r"\b\d{4}-\d{2}-\d{2}t\d{2}:\d{2}\b",
    "seat_number": r"\b[a-f]\d{1,2}-\d{4}\b",
    "last_four_digits": r"\b\d{4}\b",
    "street_address": r"\b\d{3,5}\s+[a-z][a-z ]+(?:road|lane|drive|court|ave)\b",
    "hotel_name": r"\b[a-z]+(?:\s+[a-z]+){1,4}\s+wing\s+\d{4}\b",
}


#: What a text must hold for a kind's pattern to be tried: found by a plain search, where the pattern would try each word.
NEEDLES = {
    "email": "@", "phone": r"\d[\d\-\s]{7}", "employee_id": r"(?i)emp-\d", "customer_id": r"(?i)cust-\d", "support_ticket_id": r"(?i)tkt-\d", "booking_code": r"\d{5}", "travel_date": r"\d-\d\d-\d", "meeting_time": r"(?i)\d\dt\d",
    "seat_number": r"\d-\d{4}", "last_four_digits": r"\d{4}", "street_address": r"(?i)\d{3}\s+[a-z]", "hotel_name": r"(?i)wing\s+\d",
}


def candidates(text: Column) -> Column:
    """Map of kind to its distinct normalised values, kinds without any left out; dates that a time has are not dates of travel."""

    def values(kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"(?i){PATTERNS[kind]}"), F.lit(0))
        found = F.array_distinct(F.transform(hits, lambda v: normalize_value(kind, v)))
        return F.when(text.rlike(NEEDLES[kind]), found).otherwise(F.array().cast("array<string>"))

    found = {k: values(k) for k in PATTERNS}
    days = F.transform(found["meeting_time"], lambda v: F.substring(v, 1, 10))
    found["travel_date"] = F.array_except(found["travel_date"], days)
    pairs = F.create_map(*(x for k, v in found.items() for x in (F.lit(k), F.array_sort(v))))
    return F.map_filter(pairs, lambda _, v: F.size(v) > 0)
