"""Chat formatting: one view of a dialogue for each of its speakers.

Method.  Every participant of a conversation (any role but ``system``) gets a
view in which that speaker's turns are the assistant's and carry the loss mask,
the others' turns are a user's with the speaker's name, and system turns stay
system turns.  A view is a sequence of segments, one for each turn, with their
places in the rendered dialogue: joining ``segment`` in the order of ``seq``
gives the text, and ``loss_start`` to ``loss_end`` is the span to learn (empty
where the mask is off).

Scale.  Only DataFrame functions.  Turns meet the speakers of their conversation
in an equi-join, which adaptive execution splits where one conversation is
large.  Places are running sums in two steps: sums over ``BLOCK`` turns each,
then a window inside a block, so no task sees a whole long conversation.

Defined cases.  A null text is empty, a null role is the speaker ``unknown``, a
null turn comes first, the rows of a null conv_id are one conversation.  Rows equal
in all four columns are one turn; different rows of one turn are ordered by
speaker, then text.  A conversation of system turns alone has no view.  Very
long texts stay whole.  Extra columns are left out.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32
VIEW = ("conv_id", "perspective")


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    test = F.lit(True)
    for name in names:
        test = test & left[name].eqNullSafe(right[f"_{name}"])
    return test


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, seq, turn, speaker, role, segment, start, loss_start, loss_end, end)."""
    lines = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    people = lines.where("speaker <> 'system'").select(F.col("conv_id").alias("_conv_id"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    seen = lines.join(people, _same(lines, people, ["conv_id"])).drop("_conv_id").withColumn("role", role).withColumn("head", head)
    seen = seen.withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(2**62))))
    sums = seen.groupBy(*VIEW, "block").agg(F.sum(F.length("segment")).alias("n_chars"), F.count("*").alias("n_turns"))
    earlier = Window.partitionBy(*VIEW).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select(*[F.col(c).alias(f"_{c}") for c in (*VIEW, "block")], F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n_turns").over(earlier), F.lit(0)).alias("turns_before"))
    seen = seen.join(places, _same(seen, places, [*VIEW, "block"])).drop(*[f"_{c}" for c in (*VIEW, "block")])
    inside = Window.partitionBy(*VIEW, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    start = F.col("chars_before") + F.coalesce(F.sum(F.length("segment")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("start", start).withColumn("seq", F.col("turns_before") + F.row_number().over(inside) - 1)
    first = F.col("start") + F.length("head")
    learn = F.when(F.col("role") == "assistant", first + F.length("text") + F.length(F.lit("<|im_end|>")))
    return seen.select(*VIEW, "seq", "turn", "speaker", "role", "segment", "start", first.alias("loss_start"), F.coalesce(learn, first).alias("loss_end"), (F.col("start") + F.length("segment")).alias("end"))
