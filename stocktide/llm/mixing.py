"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share, by weight, of all words; targets stop at `max_repeats` times the source's words and what is left over is
shared again by weight among the others. A document is wanted rate = target / source words times (with a weight column: in proportion
to its weight, max_repeats at most). The whole part of that is certain; the rest is its inclusion odds. Documents are ranked by the odds
of a keyed random number divided by their inclusion odds, and of each class of nearly equal sizes in a source (sizes that share
their leading CLASS_BITS bits) the first n are taken. n is fixed beforehand: from the largest sizes down, it is the number whose
mean size comes nearest to the words that the class should give, plus what the larger classes gave too few. So a sample's words are
near the target, whatever a few long documents weigh.

Random numbers are hashes of the seed and the id, so reruns agree. Largest groups (a source, a class) are ranked by ranges, never in one task.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source, the last; a null id is hashed by its text;
repeated rows are documents each; null or negative weights count as 0; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .ordering import positions

WORD = r"[^\x20\x09-\x0D]+"
CLASS_BITS = 6
ODDS_UNIT = 1 << 30  # inclusion odds are counted in these parts, so that their sums are exact in any order


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sources: src (orders them), source_size; one row a source. Adds target.

    Sources reach their caps in the order of cap / weight; with the first k at their caps the others get `level` a unit of weight, and
    the first source whose own cap is not under that level settles it.
    """
    numbered = positions(sources, [], [F.col("src")])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    s = numbered.select("src", "source_size", w.alias("w"), (F.lit(max_repeats) * F.col("source_size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "src")  # one row a source
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(W.partitionBy(F.lit(0))) - before) / ahead)
    level = s.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "src")).alias("settled"))
    return s.crossJoin(F.broadcast(level)).select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("settled") * F.col("w")).alias("target"))


def size_class(size):
    """The bits of a size below its leading CLASS_BITS, and those: a number that grows with the size."""
    low = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return low * (1 << CLASS_BITS) + (size / F.pow(F.lit(2.0), low)).cast("long")


def _draws(classes: DataFrame) -> DataFrame:
    """classes: src, cls, docs, odds and odds_words (sums over the class in ODDS_UNIT). Returns src, cls, n: how many to draw."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("cls"), F.col("docs"), F.col("odds").cast("double").alias("odds"), F.col("odds_words").cast("double").alias("odds_words"))), asc=False)

    def step(state, c):
        want, mean = c["odds_words"] / ODDS_UNIT + state["carry"], c["odds_words"] / c["odds"]
        n = F.least(F.greatest(F.floor(want / mean + 0.5), F.lit(0)), c["docs"])
        return F.struct((want - n * mean).alias("carry"), F.array_append(state["drawn"], F.struct(c["cls"].alias("cls"), n.alias("n"))).alias("drawn"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<cls:bigint,n:bigint>>").alias("drawn"))
    # at most 64 << (CLASS_BITS - 1) classes a source, whatever its documents
    return classes.groupBy("src").agg(F.aggregate(rows, start, step)["drawn"].alias("drawn")).select("src", F.inline("drawn"))


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: how often each document enters the mix."""
    source, text, doc = F.col(source_col).cast("string"), F.col(text_col).cast("string"), F.col(id_col).cast("long")
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    key = F.coalesce(doc.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13), 16, 10).cast("long")
    src = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))  # orders null last
    rows = written(df.select(doc.alias("doc_id"), source.alias("source"), src.alias("src"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"), weight.alias("weight")), "sizes")
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.sum((F.col("weight") * ODDS_UNIT).cast("decimal(38,0)") * F.col("size")).cast("double").alias("weighted"))
    rates = source_targets(sources.select("src", "source_size"), weights, max_repeats).join(sources.select("src", "weighted"), "src")
    rates = written(rates.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).withColumn("mean_weight", F.try_divide(F.col("weighted") / ODDS_UNIT, F.col("source_size"))), "rates")
    share = F.col("rate") if not weight_col else F.coalesce(F.col("rate") * F.col("weight") / F.nullif(F.col("mean_weight"), F.lit(0.0)), F.lit(0.0))
    wanted = rows.join(rates, "src").withColumn("wanted", F.when(F.col("size") > 0, F.least(share, F.lit(float(max_repeats)))).otherwise(0.0))
    wanted = wanted.withColumn("certain", F.floor("wanted")).withColumn("odds", F.floor((F.col("wanted") - F.col("certain")) * ODDS_UNIT).cast("long"))
    wanted = wanted.select("doc_id", "source", "src", "size", "source_size", "target", "draw", "certain", "odds", size_class(F.col("size")).alias("cls"))
    u, p = (F.col("draw") + 0.5) / float(1 << 52), F.col("odds") / float(ODDS_UNIT)
    unsure = wanted.where("odds > 0")
    ranked = positions(unsure.withColumn("pareto", (u / (1 - u)) / (p / (1 - p))), ["src", "cls"], [F.col("pareto"), F.col("doc_id"), F.col("size")])
    drawn = _draws(unsure.groupBy("src", "cls").agg(F.count("*").alias("docs"), F.sum("odds").alias("odds"), F.sum(F.col("odds").cast("decimal(38,0)") * F.col("size")).alias("odds_words")))
    chosen = ranked.join(drawn, ["src", "cls"]).withColumn("copies", F.col("certain") + (F.col("position") < F.col("n")).cast("long"))
    out = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"]
    return chosen.select(*out).unionByName(wanted.where("odds = 0").withColumn("copies", F.col("certain")).select(*out))


def mixed_texts(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of df, whose ids are unique, as often as it is taken."""
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("_mixed_id"), F.col("copies").alias("_copies"))
    each = df.join(copies, F.col(id_col) == F.col("_mixed_id"))
    return each.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_mixed_id", "_copies")
