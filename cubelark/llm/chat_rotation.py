"""Multi-party perspective rotation of dialogues; DataFrame operations only.

For every participant a dialogue is rendered once with that speaker as the
assistant, whose turns bear loss, and all others as named users. System turns keep
their role and bear none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import numbered, written

#: Turns of one rendered row. A longer dialogue goes on in further rows (parts), as no row may grow with the data.
PART_TURNS = 4096
#: Fixed values of the rendered form.
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def escaped(text: Column) -> Column:
    """Marks of the rendered form inside a text get a backslash after their first sign, those with backslashes one more."""
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<\\$1|im_$2|>")


def _parts(turns: DataFrame, part_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, part, turn, role, text) of dialogues of one part, and the same of longer ones, if there are any."""
    long = written(turns.groupBy("conv_id").count().where(F.col("count") > part_turns).select(F.col("conv_id").alias("_c")))
    own = F.col("conv_id").eqNullSafe(F.col("_c"))
    if long.isEmpty():
        return turns.withColumn("part", F.lit(0).cast("long")), None
    rest = numbered(turns.join(long, own, "left_semi"), ["conv_id", "turn", "role", "text"])
    rest = rest.withColumn("part", F.floor(F.col("slot") / part_turns)).drop("slot")
    return turns.join(long, own, "left_anti").withColumn("part", F.lit(0).cast("long")), rest


def _blocks(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _views(turns: DataFrame, part_turns: int) -> DataFrame:
    """(conv_id, part, turns, perspective), with every speaker of a dialogue in each of its parts."""
    short, long = _parts(turns, part_turns)
    speakers = F.array_distinct(F.filter(F.col("turns.role"), lambda r: r != SYSTEM))
    views = _blocks(short).withColumn("perspective", F.explode(speakers))
    if long is None:
        return views
    of = long.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    more = _blocks(long).join(of, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return views.unionByName(more)


def rotated(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue and participant.

    conv_id, part, perspective, n_turns, n_targets, text, and loss_spans: the
    character ranges start:end of the perspective's own turns with their closing
    mark, joined by commas.

    Turns are in order of number, then role, then text; null numbers come first. Rows that
    repeat a turn wholly count once. Null roles are the speaker `unknown`, null
    texts are empty, and all null conv_ids are one dialogue. A dialogue of more than
    part_turns turns has a row for each part_turns of them in that order, part 0, 1
    and so on, for every participant of the whole dialogue; the parts' texts one
    after the other are the dialogue, and spans count from the part's start.
    No task holds more than a part. A dialogue of system turns alone has no participant and no row.
    Marks inside a text or a name are escaped (see `escaped`), line ends in a name become
    spaces. Other columns are ignored. An empty table gives no rows.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    views = _views(turns, part_turns)

    own = lambda t: t["role"] == F.col("perspective")
    named = lambda t: F.concat(F.lit("user name="), escaped(F.regexp_replace(t["role"], r"[\r\n]", " ")))
    head = lambda t: F.when(own(t), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(named(t))
    views = views.withColumn("pieces", F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), head(t), F.lit("\n")).alias("head"), F.concat(escaped(t["text"]), F.lit(CLOSE)).alias("body"), own(t).alias("own"))))
    # (position, spans) runs over the pieces; "\n" ends each.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        spans = F.when(p["own"], F.array_append(acc["spans"], F.concat(begin.cast("string"), F.lit(":"), end.cast("string")))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    spans = F.array_join(F.aggregate("pieces", start, step)["spans"], ",")
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    targets = F.size(F.filter("pieces", lambda p: p["own"])).cast("long")
    return views.select("conv_id", "part", "perspective", F.size("turns").cast("long").alias("n_turns"), targets.alias("n_targets"), text.alias("text"), spans.alias("loss_spans"))
