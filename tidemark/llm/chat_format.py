"""Chat formatting: sorted turn structs, adjacent turns of one role merged, one string a conversation.

Output grammar (control strings are ``<|im_start|>``, ``<|im_sep|>`` and ``<|im_end|>``)::

    conversation = block*
    block        = "<|im_start|>" role "\\n" text ("<|im_sep|>" text)* "<|im_end|>" "\\n"

A block is a run of turns of one role; the separator keeps the turns of a run apart, so the rows can be read back.
Inside roles and texts ``\\`` is doubled and ``<|`` becomes ``<\\|``; in roles a newline also becomes ``<\\n>``.  A
backslash that follows ``<`` alone is thus always ours, which makes the escape reversible.

``loss_mask`` has one entry a turn: the code points before, in and after its (escaped) text, and whether the text is
trained on.  The entries add up to the whole string.

Defined cases: null text or role is the empty string; null turn sorts first; ties in turn go by role, then text;
repeated rows are all kept; rows with a null conv_id form one conversation of their own; an empty table gives no rows;
other columns of the input are ignored.  The loop over turns is linear in their number; only one conversation's own
turns are together in a row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def collect_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: sorted structs with escaped role and text."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        escape_role(F.coalesce("role", F.lit(""))).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask, n_blocks for rows (conv_id, turn, role, text)."""
    t = F.col("turns")
    n = F.size(t)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(t, i).role != F.element_at(t, F.greatest(i - 1, F.lit(1))).role))
    runs = collect_turns(rows).withColumn("first", first)
    f, k = F.col("first"), F.size("first")
    # a run reaches from its first turn to the turn before the next run's
    merged = F.transform(
        f,
        lambda s, i: F.struct(
            F.element_at(t, s).role.alias("role"),
            F.transform(F.slice(t, s, F.when(i + 1 < k, F.get(f, i + 1)).otherwise(n + 1) - s), lambda x: x.text).alias("texts"),
        ),
    )
    blocks = runs.select("conv_id", merged.alias("blocks"))
    b = F.col("blocks")
    text = F.array_join(F.transform(b, lambda x: F.concat(F.lit(START), x.role, F.lit("\n"), F.array_join(x.texts, SEP), F.lit(END + "\n"))), "")

    def masks(x: Column) -> Column:
        last = F.size(x.texts)
        return F.transform(
            x.texts,
            lambda s, i: F.struct(
                F.when(i == 0, F.char_length(x.role) + len(START) + 1).otherwise(len(SEP)).alias("lead_chars"),
                F.char_length(s).alias("text_chars"),
                F.when(i + 1 == last, len(END) + 1).otherwise(0).alias("tail_chars"),
                (x.role == trained_role).alias("loss"),
            ),
        )

    return blocks.select("conv_id", text.alias("formatted"), F.flatten(F.transform(b, masks)).alias("loss_mask"), F.size(b).alias("n_blocks"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, turns (role, text): the turns parsed from the string, unescaped, in order."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    split = formatted.select("conv_id", "formatted", "loss_mask", blocks.alias("parts"))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(head, F.lit(len(START) + 1)))
        body = F.substr(block, F.char_length(head) + 2)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda s: F.struct(role.alias("role"), s.alias("escaped")))

    parsed = F.flatten(F.transform(F.slice("parts", 1, F.size("parts") - 1), turns))
    return split.select("conv_id", "formatted", "loss_mask", parsed.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks, all from the output strings."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), unescape(x.escaped), F.lit("\n"))), "")
    # a mask that does not fit the string is an error, not a shorter text
    masked = F.transform(
        F.filter(F.zip_with("turns", "loss_mask", lambda x, m: F.struct(x.escaped.alias("escaped"), m.text_chars.alias("chars"), m.loss.alias("loss"))), lambda z: z.loss),
        lambda z: F.when(F.char_length(z.escaped) == z.chars, unescape(z.escaped)).otherwise(F.raise_error(F.lit("loss mask and text differ"))),
    )
    texts = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("turns"), F.array_join(masked, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
