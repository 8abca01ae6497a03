"""Query over chat transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexloom.llm import transcripts
from lexloom.llm.registry import query, table
from lexloom.session import durable

# Of each transcript's turns, so many in ten have lost their speaker marker.
UNMARKED_OF_TEN = 3
STYLES = [("System: ", "User: ", "Assistant: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("[SYSTEM] ", "Human: ", "AI: ")]


def _marker(role: Column, style: Column) -> Column:
    found = F.lit("")
    for number, marks in enumerate(STYLES):
        for name, mark in zip(transcripts.ROLES, marks, strict=True):
            found = F.when((style == number) & (role == name), mark).otherwise(found)
    return found


def raw_lines(talks: DataFrame) -> DataFrame:
    """`conversations` as lines of raw transcripts, in one of three marker styles by
    conversation, some turns without a marker; `role` and `first` are kept aside."""
    lost = F.pmod(F.crc32(F.concat_ws("/", "conv_id", "turn").cast("binary")), F.lit(10)) < UNMARKED_OF_TEN
    style = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(len(STYLES)))
    mark = F.when(lost, "").otherwise(_marker(F.col("role"), style))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    return talks.select("conv_id", "turn", "role", mark.alias("mark"), F.posexplode(split).alias("line_no", "line")).select(
        "conv_id",
        "turn",
        "line_no",
        F.when(F.col("line_no") == 0, F.concat("mark", "line")).otherwise(F.col("line")).alias("line"),
        "role",
        (F.col("line_no") == 0).alias("first"),
    )


def labelled(lines: DataFrame) -> DataFrame:
    """Training lines: state, state of the line before and what is seen, of conversations not held out."""
    mine = lines.where(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) != 1)
    before = Window.partitionBy("conv_id").orderBy("turn", "line_no")
    state = transcripts.state_of(F.col("role"), F.col("first"))
    return mine.select("conv_id", "turn", "line_no", state.alias("state"), transcripts.observation(F.col("line")).alias("seen")).withColumn(
        "previous", F.lag("state").over(before)
    )


@query("op4_chat_formatting")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    lines = durable(raw_lines(table(spark, sf, "conversations")), "transcripts")
    model = transcripts.fit(labelled(lines))
    return transcripts.parse(lines.select("conv_id", "turn", "line_no", "line"), model)
