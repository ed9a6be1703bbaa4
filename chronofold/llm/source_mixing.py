"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken r = target / size of the source
times.  The whole part of r is taken at once.  The fractions are rounded
together: in small blocks, a fraction meets the next one and words move from
one to the other, in a random direction that keeps both expectations, until one
of them is 0 or 1; the one that is left meets the next.  A block ends with at
most one open fraction.  The open ones of a thousand blocks and more meet in
blocks of blocks, level by level, until each source has one, which is drawn.
Words only move, so a source's total misses its target by less than one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: Documents or open fractions that meet in a block, on average.
BLOCK = 64
SEED = 20240
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
#: Equal rows that are numbered at once.
_RUN = 4096


def words_in(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, docs, target from rows with source and size.

    Sources by code point, null last, get the weights in turn.  They share the
    total by weight, but none more than `most` times its own size; what is over
    goes to the others by weight.  With the sources ordered by the level at
    which they are full, the first of them are full, and one level fits the rest.
    The windows run over one row a source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source that the level of the rest does not fill
    per = per.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    per = per.withColumn("rest", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(whole))
    target = F.when(F.col("rest").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("rest.level") * F.col("w")))
    return per.select("source", "source_size", "docs", target.alias("target"))


def _pair(carry: F.Column, x: F.Column, seed: int) -> F.Column:
    """One step of a block: the open fraction and the next; returns the struct of the open one and the one that is settled."""
    pa, sa, pb, sb = carry["p"], carry["size"].cast("double"), x["p"], x["size"].cast("double")
    up, down = F.least((1 - pa) * sa, pb * sb), F.least(pa * sa, (1 - pb) * sb)
    rnd = F.pmod(F.xxhash64(carry["h"], x["h"], F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    move = F.when(rnd * (up + down) < down, up).otherwise(-down)
    na, nb = pa + move / sa, pb - move / sb
    return F.struct(na.alias("a"), nb.alias("b"))


def _is_settled(p: F.Column) -> F.Column:
    return (p < _EPS) | (p > 1 - _EPS)


def _level(rows: DataFrame, block: F.Column, seed: int) -> DataFrame:
    """Fold every block of open fractions: settled items and at most one open item a block."""
    item = F.struct("h", "id", "size", "p")
    blocks = rows.groupBy("source", block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = f"struct<h:bigint,id:{rows.schema['id'].dataType.simpleString()},size:bigint,p:double>"
    zero = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))

    def with_p(x: F.Column, p: F.Column) -> F.Column:
        return F.struct(x["h"].alias("h"), x["id"].alias("id"), x["size"].alias("size"), p.alias("p"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        # a chain of one-element transforms binds the pair's outcome once, so that it isn't computed for each use
        def settle(t: F.Column) -> F.Column:
            one, two = with_p(acc["open"], t["a"]), with_p(x, t["b"])
            both = _is_settled(t["a"]) & _is_settled(t["b"])
            return (
                F.when(both, F.struct(F.lit(None).cast(kind).alias("open"), F.concat(acc["done"], F.array(one, two)).alias("done")))
                .when(_is_settled(t["a"]), F.struct(two.alias("open"), F.concat(acc["done"], F.array(one)).alias("done")))
                .otherwise(F.struct(one.alias("open"), F.concat(acc["done"], F.array(two)).alias("done")))
            )

        return F.when(acc["open"].isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(F.transform(F.array(_pair(acc["open"], x, seed)), settle)[0])

    folded = blocks.select("source", "block", F.aggregate("items", zero, step).alias("r"))
    last = F.when(F.col("r.open").isNull(), F.array().cast(f"array<struct<item:{kind},open:boolean>>")).otherwise(F.array(F.struct(F.col("r.open").alias("item"), F.lit(True).alias("open"))))
    done = F.transform("r.done", lambda x: F.struct(x.alias("item"), F.lit(False).alias("open")))
    return folded.select("source", "block", F.explode(F.concat(done, last)).alias("e")).select("source", "block", "e.item.*", "e.open")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """How often each document is taken so that the sources meet their targets.

    Returns one row per input row: doc_id, size (words), source, source_size,
    target (the source's), copies, taken (copies * size).  Texts that are null
    or without words have size 0 and are taken 0 times; a source whose texts all
    have size 0 has target 0.  A null source is a source of its own, last in
    order.  Repeated rows, null and repeated ids are separate items.  Random
    draws are hashes of the ids, sizes, the number among equal rows and the
    seed, so reruns agree.  Ids are whole numbers or strings.  Other columns are
    ignored.  Empty tables give empty results.
    """
    numbers = "string" if docs.schema[id_col].dataType.simpleString() == "string" else "long"
    rows = docs.select(F.col(id_col).cast(numbers).alias("id"), words_in(F.col(text_col).cast("string")).alias("size"), F.col(source_col).cast("string").alias("source"))
    # rows that are equal here get numbers, so that each has a hash of its own; they are counted before, not brought together
    rows = rows.groupBy("source", "id", "size").agg(F.count("*").alias("times"))
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _RUN))))
    rows = rows.withColumn("n", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("times"), (F.col("run") + 1) * _RUN) - 1)))
    rows = written(rows.select("id", "size", "source", "n"), "sizes")
    targets = written(source_targets(rows, weights, most).withColumnRenamed("source", "named"), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    plan = rows.join(targets, F.col("source").eqNullSafe(F.col("named")))
    plan = plan.withColumn("base", F.floor(rate + _EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base")))
    open_ = (F.col("p") > _EPS) & (F.col("size") > 0)
    settled = plan.where(~open_).select("source", "id", "size", F.lit(0).alias("copy"))
    h = F.xxhash64("source", "id", "size", "n", F.lit(seed))
    current = plan.where(open_).select("source", "id", "size", "p", h.alias("h"), F.pmod(F.xxhash64(h, F.lit("block")), F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("long")).alias("at"))
    blocks = max(1, -(-(targets.agg(F.max("docs")).first()[0] or 0) // block))
    level = 0
    while True:
        out = written(_level(current, F.col("at"), seed + level), "mixing")
        settled = settled.unionByName(out.where("not open").select("source", "id", "size", F.round("p").cast("int").alias("copy")))
        current = out.where("open").select("source", "id", "size", "p", "h", F.floor(F.col("block") / block).cast("long").alias("at"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // block), level + 1
    draw = F.pmod(F.xxhash64("h", F.lit(seed), F.lit("last")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    settled = settled.unionByName(current.select("source", "id", "size", (draw < F.col("p")).cast("int").alias("copy")))
    known = targets.select(*[F.col(c).alias(c) for c in targets.columns])
    result = settled.join(known, F.col("source").eqNullSafe(F.col("named")))
    copies = F.when(F.col("size") > 0, F.floor(rate + _EPS).cast("long") + F.col("copy")).otherwise(F.lit(0)).cast("long")
    return result.select(F.col("id").alias("doc_id"), "size", "source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
