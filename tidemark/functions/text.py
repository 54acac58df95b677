"""Text normalisation and overlap measures as column expressions.

White space is the ASCII class unless ``unicode`` is set.  Two measures have no Spark expression (longest common substring,
matching-blocks ratio) and are Arrow-batched pandas UDFs; the first takes time in proportion to both texts.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WHITE = r"[ \t\n\x0B\f\r]+"
UNICODE_WHITE = r"(?U)[\s\x1C-\x1F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it; in a lambda a column's expression would be computed at each call."""
    return F.transform(F.array(value), body)[0]


def normalize_text(text: Column, unicode: bool = False) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), UNICODE_WHITE if unicode else WHITE, " "))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def match_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits, anything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_text(text), F.lit("[a-z0-9]+"), F.lit(0))


def wide_tokens(text: Column) -> Column:
    """Tokens that keep the signs of addresses and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_@.+-]+"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams of the normalised text; a shorter text is its own one, an empty one has none."""

    def grams(value: Column) -> Column:
        length = F.char_length(value)
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: F.substr(value, i, F.lit(n))))
        return F.when(length == 0, F.array().cast("array<string>")).when(length < n, F.array(value)).otherwise(found)

    return let(normalize_text(text), grams)


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""


    def share(sets: Column) -> Column:
        either = F.size(F.array_union(sets["a"], sets["b"]))
        return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(sets["a"], sets["b"])) / F.greatest(either, F.lit(1)))

    return let(F.struct(left.alias("a"), right.alias("b")), share)


def longest_shared_piece(text: Column, values: Column, most: int = 32) -> Column:
    """Length, up to most, of the longest piece of any of the values that the text contains."""


    def of_value(whole: Column, v: Column) -> Column:
        n = F.least(F.char_length(v), F.lit(most))
        sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        found = F.filter(sizes, lambda k: F.exists(F.sequence(F.lit(1), F.char_length(v) - k + 1), lambda i: F.contains(whole, F.substr(v, i, k))))
        return F.coalesce(F.array_max(found), F.lit(0))

    plain = F.transform(values, lambda v: normalize_text(v))
    return F.coalesce(let(normalize_text(text), lambda whole: F.array_max(F.transform(plain, lambda v: of_value(whole, v)))), F.lit(0))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: Accepted date layouts, in the order of trial, as Spark patterns; the last two carry a time.
DATE_PATTERNS = ["yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "MMMM d, yyyy"]
TIME_PATTERNS = ["yyyy-M-d't'H:m", "yyyy-M-d H:m"]


def normalize_date(text: Column) -> Column:
    """ISO date, or ISO date and minute with an upper-case T; texts of no known layout stay, normalised."""

    def read(value: Column) -> Column:
        months = F.initcap(value)
        dates = [F.date_format(F.try_to_timestamp(months if "MMMM" in p else value, F.lit(p)), "yyyy-MM-dd") for p in DATE_PATTERNS]
        times = [F.date_format(F.try_to_timestamp(value, F.lit(p)), "yyyy-MM-dd'T'HH:mm") for p in TIME_PATTERNS]
        return F.coalesce(*dates, *times, value)

    return let(normalize_text(text), read)


def normalize_value(field: Column | str, value: Column) -> Column:
    """By the kind that the field's name tells: e-mail, phone, date or time, else text."""
    if isinstance(field, str):
        if "email" in field:
            return normalize_text(value)
        if "phone" in field:
            return digits_only(value)
        return normalize_date(value) if "date" in field or "time" in field else normalize_text(value)
    return (
        F.when(F.contains(field, F.lit("email")), normalize_text(value))
        .when(F.contains(field, F.lit("phone")), digits_only(value))
        .when(F.contains(field, F.lit("date")) | F.contains(field, F.lit("time")), normalize_date(value))
        .otherwise(normalize_text(value))
    )


def signature(text: Column, edge: int = 64) -> Column:
    """SHA-256 of the first and last tokens of the match key; texts of up to edge tokens use the first ones twice."""
    return key_signature(match_key(text), edge)


def key_signature(key: Column, edge: int = 64) -> Column:
    """The same of a match key."""

    def ends(t: Column) -> Column:
        head = F.array_join(F.slice(t, 1, edge), " ")
        tail = F.when(F.size(t) > edge, F.array_join(F.slice(t, F.greatest(F.size(t) - edge + 1, F.lit(1)), edge), " ")).otherwise(head)
        return F.concat(head, F.lit("||"), tail)

    return F.sha2(let(F.filter(F.split(key, " "), lambda w: w != ""), ends), 256)


def stable_hash(text: Column, modulo: int) -> Column:
    """The SHA-256 number of the text modulo m, m up to 10**9: eight 32-bit parts folded in longs."""
    digest = F.sha2(text, 256)
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.pmod(out * F.lit((1 << 32) % modulo) + p, F.lit(modulo))
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")), "^_+|_+$", "")


def repeat_to(text: Column, count: int) -> Column:
    """The text's words repeated in a cycle up to count of them."""

    def cycle(w: Column) -> Column:
        times = F.ceil(F.lit(count) / F.size(w)).cast("int")
        return F.array_join(F.slice(F.flatten(F.array_repeat(w, times)), 1, count), " ")

    #: The words of an empty text.
    none = F.array(*map(F.lit, ("background", "corpus", "placeholder")))
    return let(let(words(text), lambda w: F.when(F.size(w) == 0, none).otherwise(w)), cycle)


def deidentify(text: Column, values: Column, least: int = 3) -> Column:
    """The text without any of the values, case aside, longest first; white space collapsed."""
    known = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.char_length(v) >= least)))
    order = F.array_sort(known, lambda a, b: F.when(F.char_length(a) > F.char_length(b), -1).when(F.char_length(a) < F.char_length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    literal = F.transform(order, lambda v: F.concat(F.lit(r"(?iu)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return collapse_space(F.aggregate(literal, text, lambda acc, pattern: F.regexp_replace(acc, pattern, F.lit(" "))))


def join_entries(fields: Column, between: str = " ", after: str = " ") -> Column:
    """A map's entries as text, keys in their order."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e.key, F.lit(after), F.coalesce(e.value, F.lit("")))), between)


class Pieces:
    """All pieces of a text as the states of an automaton of its suffixes, in time and room of the text's length."""

    def __init__(self, text: str) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for sign in text:
            new = self._state({}, 0, self.length[last] + 1)
            at = last
            while at >= 0 and sign not in self.steps[at]:
                self.steps[at][sign] = new
                at = self.link[at]
            if at >= 0:
                to = self.steps[at][sign]
                if self.length[to] > self.length[at] + 1:  # of its pieces only the shorter ones go on like this
                    part = self._state(dict(self.steps[to]), self.link[to], self.length[at] + 1)
                    self.link[to] = part
                    while at >= 0 and self.steps[at].get(sign) == to:
                        self.steps[at][sign] = part
                        at = self.link[at]
                    to = part
                self.link[new] = to
            last = new

    def _state(self, steps: dict[str, int], link: int, length: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def longest_in(self, text: str) -> int:
        """Length of the longest piece that the text has as well."""
        at = held = best = 0
        for sign in text:
            while at and sign not in self.steps[at]:
                at = self.link[at]
                held = self.length[at]
            if sign in self.steps[at]:
                at, held = self.steps[at][sign], held + 1
                best = max(best, held)
        return best


@F.pandas_udf(DoubleType())
def longest_common_substring(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common substring of two normalised texts over the right one's length; a right text of many rows is prepared once a batch."""
    out = pd.Series(0.0, index=left.index)
    for target, rows in left.groupby(right, sort=False):
        if target:
            pieces = Pieces(target)
            out[rows.index] = [pieces.longest_in(t or "") / len(target) for t in rows]
    return out


class Ratios:
    """Matching-blocks ratios of many texts to one, which is indexed once."""

    def __init__(self, target: str) -> None:
        self._matcher = SequenceMatcher(None, "", target)

    def of(self, text: str, above: float = -1.0) -> float | None:
        """The ratio; None without computing it if lengths or shared signs keep it from being larger than above."""
        self._matcher.set_seq1(text)
        if above >= 0 and (self._matcher.real_quick_ratio() <= above or self._matcher.quick_ratio() <= above):
            return None
        return self._matcher.ratio()


@F.pandas_udf(DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching blocks' characters over both lengths (Ratcliff and Obershelp), frequent characters set aside in long texts."""
    out = pd.Series(0.0, index=left.index)
    for target, rows in left.fillna("").groupby(right.fillna(""), sort=False):
        ratios = Ratios(target)
        out[rows.index] = [ratios.of(t) for t in rows]
    return out
