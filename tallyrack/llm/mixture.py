"""Mixing sources to target weights by pivotal dependent rounding (operator 2, native).

Every document of a source has the same wanted number of copies: the source's target over its size.  The whole part
is taken as it is.  The fractions are rounded dependently: two documents trade words (fraction times size), in a
random direction of which the mean is zero, until one of them is integral; the other goes on to meet the next.  Each
trade keeps the source's words, so a source ends within one document of its target.  Documents are dealt into leaf
blocks of about 64; the residual of every block goes up a tree of 64 branches until one is left for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, documents, table, uniform

#: Documents in a leaf block, on average, and residuals in an inner one, at most.
BRANCHES = 64
#: Rows that repeat more often than this are made anew in several tasks.
CHUNK = 65_536
#: A source gives each document at most this many times.
MOST_COPIES = 3
#: Classes of document sizes that a source is rounded in, at most, and how many times the words of a class's largest
#: document its smaller ones must be able to give and to take.
CLASSES, ROOM = 4, 2.0
#: A fraction this close to an integer is one: sums of doubles.
EPSILON = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """Adds size, the number of words of the whole text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, size) -> (source, source_size, n, target), one row a source.

    Sources by code point, null last, weigh 1, 2, 3 and again.  A target stops at `most` times its source's size and
    the excess is shared anew by weight: the level of that water is found by sorting on cap / weight.  The windows
    run over the sources' totals only.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = total.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(most))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", level)
    level = level.withColumn("level", F.max(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return level.select("source", "source_size", "n", target.alias("target"))


def _trade(rows: DataFrame, level: int) -> DataFrame:
    """Round the fractions of each block: adds `won` (rounded up here) and `open` (the block's residual, with its new fraction in `part`).

    A block is folded in falling size, so its residual tends to be its largest document.  The fold's state is the
    residual's place, size and fraction, and the places of those that were rounded up.
    """
    names = [c for c in rows.columns if c not in ("source", "block")]
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(level), "hash").alias("deal"), uniform(F.col("doc_id"), F.col("hash"), 7 + level).alias("u"), *names)
    blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.withColumn("items", F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))

    def state(at, size, part, won) -> Column:
        return F.struct(at.cast("int").alias("at"), size.cast("double").alias("size"), part.cast("double").alias("part"), won.alias("won"))

    def merge(acc: Column, y: Column) -> Column:
        s1, p1, s2, p2 = acc["size"], acc["part"], y["x"]["size"].cast("double"), y["x"]["part"]
        give = F.least((1 - p1) * s1, p2 * s2)  # words that the residual may gain of the new one
        take = F.least(p1 * s1, (1 - p2) * s2)
        none = F.lit(-1)
        up1 = F.concat(acc["won"], F.array(acc["at"]))
        up2 = F.concat(acc["won"], F.array(y["i"]))

        def rest(at, size, part, won, won_too) -> Column:
            """The residual, if it isn't integral by now."""
            return F.when(part >= 1 - EPSILON, state(none, F.lit(0), F.lit(0), won_too)).when(part <= EPSILON, state(none, F.lit(0), F.lit(0), won)).otherwise(state(at, size, part, won))

        gains = F.when((1 - p1) * s1 <= p2 * s2, rest(y["i"], s2, p2 - (1 - p1) * s1 / s2, up1, F.concat(up1, F.array(y["i"])))).otherwise(rest(acc["at"], s1, p1 + p2 * s2 / s1, acc["won"], up1))
        loses = F.when(p1 * s1 <= (1 - p2) * s2, rest(y["i"], s2, p2 + p1 * s1 / s2, acc["won"], up2)).otherwise(rest(acc["at"], s1, p1 - (1 - p2) * s2 / s1, up2, F.concat(up2, F.array(acc["at"]))))
        return F.when(acc["at"] < 0, state(y["i"], s2, p2, acc["won"])).otherwise(F.when(y["x"]["u"] * (give + take) < take, gains).otherwise(loses))

    start = state(F.lit(-1), F.lit(0), F.lit(0), F.array().cast("array<int>"))
    folded = blocks.withColumn("end", F.aggregate("items", start, merge))
    each = folded.select("source", "block", "end", F.explode("items").alias("y"))
    place = F.col("y.i")
    return each.select(
        "source", "block", *(F.col(f"y.x.{c}").alias(c) for c in names if c not in ("part", "hash")), F.col("y.x.hash").alias("hash"),
        F.when(place == F.col("end.at"), F.col("end.part")).otherwise(F.lit(0.0)).alias("part"),
        F.array_contains("end.won", place).alias("won"), (place == F.col("end.at")).alias("open"),
    )


def numbered(sizes: DataFrame) -> DataFrame:
    """Rows that repeat told apart by a number `nth`, without bringing them together: they are counted, and as many are
    made anew; those that repeat very often in chunks that are dealt out again."""
    once = checkpoint(sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("repeats")))
    few, many = once.filter(F.col("repeats") <= CHUNK), once.filter(F.col("repeats") > CHUNK)
    few = few.select(*sizes.columns, F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("nth"))
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("repeats") - 1) / CHUNK)))).repartition("row", "chunk")
    last = F.least(F.col("repeats"), (F.col("chunk") + 1) * CHUNK)
    return few.unionByName(many.select(*sizes.columns, F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last)).alias("nth")))


def outsized(rows: DataFrame) -> DataFrame:
    """(source, size, part) of open documents -> (source, above, part_too): documents of a source with more than `above`
    words are too large to be drawn, and `part_too` is the part of the others that makes up for them.

    A document that holds more than one ROOM-th of what all smaller ones can give or take would put its source off its
    target whether it is drawn or not; it gets the nearest number of copies.  Sources without such have no row, nor have
    those whose other documents can't make up for them.
    """
    step = F.floor(2 * F.log2("size")).cast("int").alias("step")
    sums = rows.groupBy("source", step).agg(F.sum("size").alias("words"), F.max("size").alias("most"), F.max("part").alias("part"))
    under = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("source")
    steps = sums.select("source", "step", "most", F.coalesce(F.sum("words").over(under), F.lit(0)).alias("below"), "words", F.sum("words").over(everything).alias("all"), F.max("step").over(everything).alias("last"), F.max("part").over(everything).alias("part"))
    share = F.col("all") / (F.col("below") + F.col("words"))  # the drawn documents hold the fractional words of all
    part = F.when(F.col("part") < 0.5, F.col("part") * share).otherwise(1 - (1 - F.col("part")) * share)
    steps = steps.withColumn("part_too", part).filter((F.col("part_too") > EPSILON) & (F.col("part_too") < 1 - EPSILON))
    fits = F.col("most") <= F.col("below") * F.least(F.col("part_too"), 1 - F.col("part_too")) / ROOM
    top = F.max_by(F.struct("most", "part_too"), "step").alias("top")
    return steps.filter(fits).groupBy("source").agg(top, F.max("step").alias("step"), F.max("last").alias("last")).filter("step < last").select("source", F.col("top.most").alias("above"), F.col("top.part_too").alias("part_too"))


def ladder(rows: DataFrame) -> DataFrame:
    """(source, size, part) of open documents -> (source, c, n, most, rest): of each class of a source, from the largest
    documents down, the number of documents, the largest size, and the words of all smaller classes.

    A class goes down to the size below which documents can still give and take ROOM times the words of its largest one.
    Sizes are summed by half powers of two, so a source has some sixty rows at most.
    """
    step = F.floor(2 * F.log2("size")).cast("int").alias("step")
    sums = checkpoint(rows.groupBy("source", step).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.max(F.least(F.col("part"), 1 - F.col("part"))).alias("share")))
    upto = sums.withColumn("below", F.sum("words").over(Window.partitionBy("source").orderBy("step")))
    steps = checkpoint(upto.withColumn("room", F.col("below") * F.col("share") / ROOM))
    own = F.col("t.source").eqNullSafe(F.col("u.source"))
    tops = steps.groupBy("source").agg(F.max("step").alias("top"), F.max("most").alias("most")).withColumn("c", F.lit(0))
    found = [tops.select("source", "c", "top")]
    for c in range(1, CLASSES):
        fits = tops.alias("t").join(steps.alias("u"), own & (F.col("u.step") < F.col("t.top")) & (F.col("u.room") >= F.col("t.most")))
        tops = checkpoint(fits.groupBy(F.col("t.source").alias("source")).agg(F.min("u.step").alias("top"), F.min_by("u.most", "u.step").alias("most")).withColumn("c", F.lit(c)))
        found.append(tops.select("source", "c", "top"))
    bounds = found[0]
    for more in found[1:]:
        bounds = bounds.unionByName(more)
    classed = steps.alias("u").join(bounds.alias("t"), own & (F.col("u.step") <= F.col("t.top"))).groupBy(F.col("u.source").alias("source"), F.col("u.step").alias("step")).agg(F.max("t.c").alias("c"), F.first("u.words").alias("words"), F.first("u.n").alias("n"), F.first("u.most").alias("most"))
    each = classed.groupBy("source", "c").agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.max("most").alias("most"))
    smaller = Window.partitionBy("source").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    return checkpoint(each.select("source", "c", "n", "most", F.coalesce(F.sum("words").over(smaller), F.lit(0)).alias("rest")))


def mix(docs: DataFrame, seed: int = 0, row: str | None = None) -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, copies, row): how often the mix takes each document.
    `row` names a binary column that tells rows apart; without it, their texts do.

    One output row for each row, repeated rows too.  Null and empty texts have size 0 and are never taken; a null
    source is a source of its own, the last.  An empty table gives an empty result.  Reruns agree: randomness is a
    hash of the row and seed, whichever task holds it; of rows that repeat it is a hash of their number.
    """
    own = documents(docs, "doc_id", "source", "text", *([row] if row else []))
    told = F.col(f"`{row}`") if row else F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    sizes = numbered(sized(own).select("doc_id", "source", "size", told.alias("row")))
    plan = checkpoint(targets(sizes))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s", "n")
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(wanted + EPSILON)).otherwise(0).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wanted - F.col("whole"))).otherwise(F.lit(0.0)))
    rows = checkpoint(rows.withColumn("hash", F.xxhash64("doc_id", "size", "row", "nth", F.lit(seed))).drop("nth"))
    kept = ["doc_id", "source", "size", "row", "source_size", "target", "whole"]
    out = rows.filter(F.col("part") <= EPSILON).select(*kept, F.lit(False).alias("won"))
    rows = rows.filter(F.col("part") > EPSILON)
    odd = checkpoint(outsized(rows)).withColumnRenamed("source", "s")
    rows = checkpoint(rows.join(odd, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("large", F.coalesce(F.col("size") > F.col("above"), F.lit(False))))
    out = out.unionByName(rows.filter("large").select(*kept, (F.col("part") >= 0.5).alias("won")))
    rows = rows.filter("not large").withColumn("part", F.coalesce("part_too", "part")).drop("s", "above", "part_too", "large")
    classes = ladder(rows)
    lower = classes.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("n", "most", "rest")))).alias("classes"))
    shift = classes.select("source").distinct().select("source", F.lit(0.0).alias("moved"))
    widest = {r.c: r.n for r in classes.groupBy("c").agg(F.max("n").alias("n")).collect()}
    # The least class whose largest document is as large: classes don't overlap.
    which = F.array_max(F.filter(F.map_keys("classes"), lambda c: F.col("size") <= F.col("classes")[c]["most"]))
    rows = rows.withColumnRenamed("source", "s").join(lower, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("c", which).withColumn("n", F.col("classes")[F.col("c")]["n"]).drop("classes")
    rows = checkpoint(rows)
    for c in sorted(widest):
        live = rows.filter(F.col("c") == c).withColumnRenamed("source", "s").join(shift, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        live = live.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("part") - F.col("moved"))))
        live = live.withColumn("block", F.pmod(F.col("hash"), F.ceil(F.col("n") / BRANCHES)).cast("long")).drop("n", "c", "moved")
        level, width = 0, -(-widest[c] // BRANCHES)
        while True:
            done = checkpoint(_trade(live, level))
            out = out.unionByName(done.filter("not open").select(*kept, "won"))
            live = done.filter("open").drop("won", "open")
            if width <= 1:
                break
            level, width = level + 1, -(-width // BRANCHES)
            live = live.withColumn("block", F.floor(F.col("block") / BRANCHES).cast("long"))
        last = checkpoint(live.withColumn("won", uniform(F.col("hash"), seed, -1) < F.col("part")))
        out = out.unionByName(last.select(*kept, "won"))
        gained = last.select("source", ((F.col("won").cast("int") - F.col("part")) * F.col("size")).alias("gained")).alias("g")
        given = gained.join(classes.filter(F.col("c") == c).alias("k"), F.col("g.source").eqNullSafe(F.col("k.source"))).filter("rest > 0").select(F.col("g.source").alias("source"), (F.col("gained") / F.col("rest")).alias("moved"))
        shift = checkpoint(shift.unionByName(given).groupBy("source").agg(F.sum("moved").alias("moved")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("won").cast("int")).alias("copies"), "row")


def op2_mixture(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))
