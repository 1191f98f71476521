"""Conversations as one marked text each, with a loss mask, and back: Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import let, sums_before

# The template.  A block is OPEN role \n text CLOSE \n; NEXT stands between the texts of merged turns, LINE for a line end in a role.
OPEN, CLOSE, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|im_line|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    r"""``text`` without any ``<|``: one backslash more between ``<`` and ``|``, whatever backslashes stand there already."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _literal(control: str) -> str:
    return control.replace("|", r"\|")


def merged_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, blocks): turns of a conversation in order, adjacent ones of a role merged into one block of several texts.

    Turns are ordered by number, null first, then by role and text.  Null roles
    and texts are empty.  Rows without a conversation make one conversation of
    their own.  Repeated rows are turns of their own.  A conversation is one
    value, as its text is; only its own rows come together.  An empty table
    gives an empty result; other columns are not looked at.
    """
    turn = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).cast("long").alias("turn"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = (turns.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))

    def blocks(row: Column) -> Column:
        """Cut before every turn whose role differs from the one before."""
        def cut(t: Column, i: Column) -> Column:
            return F.when((i == 0) | (t["role"] != F.get(row, i - 1)["role"]), i)

        def block(first: Column, last: Column) -> Column:
            run = F.slice(row, first + 1, last - first)
            return F.struct(F.get(row, first)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

        starts = F.filter(F.transform(row, cut), lambda i: i.isNotNull())
        return let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(row))), block))

    return held.select("conv_id", let(F.col("turns"), blocks).alias("blocks"))


def _pieces(blocks: Column, trained: str) -> Column:
    """One piece a turn: what the template puts before its text, and the escaped text."""
    def pieces(b: Column, i: Column) -> Column:
        role = F.regexp_replace(escape(b["role"]), "\n", LINE)
        opening = F.concat(F.when(i > 0, f"{CLOSE}\n").otherwise(""), F.lit(OPEN), role, F.lit("\n"))
        return F.transform(b["texts"], lambda t, j: F.struct(
            F.when(j == 0, opening).otherwise(NEXT).alias("lead"), escape(t).alias("body"), (b["role"] == trained).alias("loss")))

    return F.flatten(F.transform(blocks, pieces))


def _mask(pieces: Column) -> Column:
    """Where the trained pieces' bodies stand: code points and bytes, ends exclusive."""
    def before(size: Callable[[Column], Column]) -> Column:
        return sums_before(F.transform(pieces, lambda p: (size(p["lead"]) + size(p["body"])).cast("long")))

    def span(p: Column, at: Column) -> Column:
        start, byte_start = at["chars"] + F.char_length(p["lead"]), at["bytes"] + F.octet_length(p["lead"])
        return F.when(p["loss"], F.struct(
            start.alias("start"), (start + F.char_length(p["body"])).alias("end"),
            byte_start.alias("byte_start"), (byte_start + F.octet_length(p["body"])).alias("byte_end")))

    at = F.arrays_zip(before(F.char_length).alias("chars"), before(F.octet_length).alias("bytes"))
    return F.filter(F.zip_with(pieces, at, span), lambda s: s.isNotNull())


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """(conv_id, text, mask): ``merged_turns`` written by the template.

    ``mask`` lists the spans of the ``trained`` role's texts, one a turn, so what
    the template puts between merged turns is never trained on.  Roles and
    texts are escaped reversibly: no ``<|`` is left in them.
    """
    merged = merged_turns(turns, conv_col, turn_col, role_col, text_col)
    both = let(_pieces(F.col("blocks"), trained), lambda p: F.struct(
        F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["lead"], x["body"])), ""), F.lit(f"{CLOSE}\n")).alias("text"),
        _mask(p).alias("mask")))
    return merged.select("conv_id", both.alias("b")).select("conv_id", "b.text", "b.mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, text, turns, trained): the turns of a formatted text, and the texts under its mask, unescaped."""
    def turns_of(block: Column) -> Column:
        # OPEN role, a line end, the texts; neither holds a control string
        parts = F.split(block, "\n", 2)
        role = unescape(F.replace(F.substring(parts[0], F.lit(len(OPEN) + 1), F.octet_length(parts[0])), F.lit(LINE), F.lit("\n")))
        return let(role, lambda r: F.transform(F.split(parts[1], _literal(NEXT), -1),
                                               lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    blocks = F.split(F.col("text"), _literal(f"{CLOSE}\n"), -1)
    turns = F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns_of))
    # bytes are reached without walking the text before them
    trained = let(F.col("text").cast("binary"), lambda raw: F.transform("mask", lambda s: unescape(
        F.substring(raw, s["byte_start"].cast("int") + 1, (s["byte_end"] - s["byte_start"]).cast("int")).cast("string"))))
    return formatted.select("conv_id", "text", turns.alias("turns"), trained.alias("trained"))
