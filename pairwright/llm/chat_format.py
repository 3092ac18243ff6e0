"""Chat formatting with DataFrame functions only.

A finite-state machine whose states are the roles seen last checks the order of turns, and a
declarative template turns each turn into text segments, each with a loss flag. Control
strings inside roles and texts are escaped so that the formatted text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are learned, which strings texts may not hold, and the machine.

    ``moves`` maps a state (the last role, "" at the start) to the roles that may follow;
    ``final`` are the states in which a conversation may end.
    """

    start: str = "<|im_start|>"
    mid: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant", "user")

    def codes(self) -> list[tuple[str, str]]:
        """What is replaced by what, in the order in which texts are escaped."""
        return [("\\", "\\b"), *((c, f"\\{i}") for i, c in enumerate(self.control))]


CHATML = Template()


def escaped(text: Column, template: Template = CHATML) -> Column:
    for plain, code in template.codes():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: Template = CHATML) -> Column:
    for plain, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(rows: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, error_turn, formatted, segments, loss_spans.

    segments: array of (text, loss), which joined give formatted. loss_spans: (start, end) in
    code points of formatted. valid: the machine accepts the roles; error_turn: position of
    the first turn that it does not accept (null if there is none; n_turns if only the end is
    wrong). Turns are ordered by turn, then role, then text, so ties and repeated rows have one
    result; null turn comes first. Null text and null role are empty; a null conv_id is a
    conversation of its own; an empty table gives none. Other columns are ignored. All turns
    of a conversation meet in one task, as they end in one text.
    """
    w = Window.partitionBy("conv_id").orderBy("t", "r", "x")
    moves = F.create_map(*[F.lit(v) for state, roles in template.moves.items() for v in (state, ">" + ">".join(roles) + ">")])
    newline = F.lit("\n"), F.lit("\\n")
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    turns = (
        turns.withColumn("i", F.row_number().over(w) - 1)
        .withColumn("before", F.coalesce(F.lag("r").over(w), F.lit("")))
        .withColumn("last", F.lead("r").over(w).isNull())
        .withColumn("head", F.concat(F.lit(template.start), F.replace(escaped(F.col("r"), template), *newline), F.lit(template.mid)))
        .withColumn("body", escaped(F.col("x"), template))
        .withColumn("loss", F.col("r").isin(*template.loss_roles))
    )
    known = F.element_at(moves, F.when((F.col("i") > 0) & (F.col("before") == ""), F.lit("?")).otherwise(F.col("before")))
    turns = turns.withColumn("bad", ~F.coalesce(F.contains(known, F.concat(F.lit(">"), F.col("r"), F.lit(">"))), F.lit(False)) | (F.col("r") == ""))
    length = F.length("head") + F.length("body") + F.length(F.lit(template.end))
    so_far = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("at", so_far + F.length("head"))
    one = F.struct("i", "head", "body", "loss", "at")
    end_bad = F.col("last") & ~F.col("r").isin(*template.final)
    done = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.min(F.when(F.col("bad"), F.col("i")).when(end_bad, F.col("i") + 1)).cast("long").alias("error_turn"),
        F.sort_array(F.collect_list(one)).alias("all"),
    )
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("all", lambda s: F.array(segment(s["head"], F.lit(False)), segment(s["body"], s["loss"]), segment(F.lit(template.end), F.lit(False)))))
    spans = F.transform(F.filter("all", lambda s: s["loss"]), lambda s: F.struct(s["at"].alias("start"), (s["at"] + F.length(s["body"])).alias("end")))
    return done.select(
        "conv_id", "n_turns", F.isnull("error_turn").alias("valid"), "error_turn", F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"), segments.alias("segments"), spans.alias("loss_spans")
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip = len(template.start)
    head = lambda p: F.substring_index(p, template.mid, 1)

    def turn(p: Column) -> Column:
        role = F.replace(F.substr(head(p), F.lit(skip + 1)), F.lit("\\n"), F.lit("\n"))
        body = F.substr(p, F.length(head(p)) + F.lit(len(template.mid) + 1))
        return F.struct(unescaped(role, template).alias("role"), unescaped(body, template).alias("text"))

    return F.transform(parts, turn)
