"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Into so many parts the rows of every key are dealt; the other side is repeated as often.
PARTS = 32


def spread_join(many: DataFrame, few: DataFrame, key: str, deal: str, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``many`` joined with ``few``, which has one row a key: the rows of a key are dealt to ``parts`` tasks by a hash of ``deal``.

    No key's rows are in one task, however many there are; neither side is sent
    whole to all tasks, since both may grow with the data.
    """
    left = many.withColumn("_part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int"))
    right = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right.hint("merge"), [key, "_part"], how).drop("_part")


#: Members of a group that are paired with others in one task.
GROUP = 1024


def _parts_of(sizes: Column, per: int) -> Column:
    return F.ceil(sizes / per).cast("int")


def paired_members(linked: DataFrame, members: DataFrame, per: int = GROUP) -> DataFrame:
    """(x, y) of every member of a and every member of b of the ``linked`` groups (a, b); ``members``: group, id.

    The members of a large group are dealt to parts of about ``per``, so a task
    pairs a part with a part.
    """
    sizes = members.groupBy("group").agg(_parts_of(F.count("*"), per).alias("parts"))
    dealt = spread_join(members, sizes.where("parts > 1"), "group", "id", "left")
    dealt = dealt.select("group", "id", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    out = linked
    for side, to in (("a", "x"), ("b", "y")):
        size = sizes.withColumnRenamed("group", side)
        own = dealt.select(F.col("group").alias(side), "part", F.col("id").alias(to))
        out = out.join(size.hint("merge"), side).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        out = out.join(own.hint("merge"), [side, "part"]).drop("part")
    return out


def pairs_within(members: DataFrame, per: int = GROUP) -> DataFrame:
    """(group, a, b), a < b, of the members (group, id) of each group, a part of a large group with a part at a time."""
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", _parts_of(F.col("n"), per).alias("parts"))
    own = spread_join(members, sizes, "group", "id").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    a = own.select("group", F.col("part").alias("_i"), F.col("id").alias("a"))
    b = own.select("group", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_i"))
    return a.join(b.hint("merge"), ["group", "_i"]).where("a < b").select("group", "a", "b")
