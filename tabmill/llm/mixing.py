"""Mixing sources to target weights, by fixed-length blocks. Native: DataFrame functions only.

The words of each source, documents in a pseudorandom but fixed order, are packed end to end into blocks of `block` words.
The mix has as many slots as the targets hold blocks, dealt over output shards. Each shard draws its source counts as a
residual multinomial: the whole part of each source's expected count is given, the slots left over are drawn with the
fractional parts as probabilities. A source's slots, numbered through all shards, go through its own pseudorandom
permutations of its block indices, one permutation a pass; slots and blocks are then joined by (source, block index).
No block is used in more than `passes` passes, so no document exceeds that many times its size.

Running totals over a source are made in two steps (inside hashed cells, then over the cells, whose number follows the rows),
so that a source that holds a third of all rows isn't sorted in one task. Rows that are the same in all their columns are
counted first and lie one after another; their places follow from the count.

Cases: a null text has size 0; documents of size 0 are in no block and take 0. A null source is a source of its own, after
all others. A null doc_id is allowed. Rows that repeat are documents of their own. An empty table gives no rows. Other
columns are ignored here, whatever their names; mixed_documents() gives the columns of documents and no others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmill.llm.text import row_hash, shared_table, words

#: Words in a block.
BLOCK = 32
#: Slots in an output shard.
SHARD = 65_536
#: Weights by the sources' order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most times that a block is used.
PASSES = 3
#: Least number of cells that a source's rows are dealt over for running totals, and rows in a cell beyond that, about.
CELLS, CELL_ROWS = 1024, 50_000
SEED = 42
ROUNDS = 12
#: Slots or copies that one row stands for before they are made.
RUN = 4096


def uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, cell: Column) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same keys that come before, by cell and then by order."""
    d = df.withColumn("_cell", cell)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_cell").alias("__cell"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_cell") == F.col("__cell")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return d.join(cells, on).withColumn(name, F.col("_in") + F.col("_base")).drop("_cell", "__cell", "_in", "_base", "_sum", *(f"_{k}" for k in keys))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source_no, source, source_size, target. sizes: source, size by document.

    Targets share the sum of all sizes by weight; one that would pass `passes` times its source's size stops there. With the
    sources by rising limit per weight, those that stop come first: the level of the rest is what is left over the weight
    that is left, and the first level that its own source doesn't pass is the level of all after it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*map(F.lit, weights))
    by = by.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    by = by.withColumn("weight", F.get(w, (F.col("source_no") % len(weights)).cast("int"))).withColumn("most", passes * F.col("source_size"))
    rise = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    done = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(done), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))
    by = by.withColumn("level", left / weight_left)
    free = F.col("level") <= F.col("most") / F.col("weight")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(rise.rowsBetween(Window.unboundedPreceding, 0))
    return by.withColumn("_level", level).select(
        "source_no", "source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(F.col("_level") * F.col("weight"), F.col("most").cast("double")).alias("target")
    )


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of index under a pseudorandom permutation of 0 .. n-1 that the key chooses.

    Swap-or-not: in each round a number and its mirror image about a hashed point change places or not, by a hashed bit of
    the two, so that it is a permutation for any n.
    """

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) + n - x, n)
        return F.get(F.transform(F.array(F.struct(x.alias("x"), mirror.alias("m"))), lambda p: F.when(F.xxhash64(F.lit(SEED + 1), r, F.greatest(p.x, p.m), *key) % 2 == 0, p.x).otherwise(p.m)), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def draw(plan: DataFrame, shard: int, passes: int) -> DataFrame:
    """source_no, shard, count: what each shard draws of each source. plan: targets() with `blocks`.

    A source's last block may be short, so its target counts in blocks of its mean length. One that stops at `passes` times its
    size isn't drawn: all its blocks are taken that often.
    """
    full = F.col("target") >= passes * F.col("source_size")
    all_of = plan.where(full & (F.col("blocks") > 0)).select("source_no", (F.col("blocks") * passes).alias("all"))
    all_of = all_of.select("source_no", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / shard))).alias("shard"))
    all_of = all_of.select("source_no", "shard", F.least(F.lit(shard).cast("long"), F.col("all") - F.col("shard") * shard).alias("count"))
    some = plan.where(~full).select("source_no", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("target"))
    spark = plan.sparkSession
    one = some.agg(F.array_sort(F.collect_list(F.struct("source_no", "target"))).alias("s"), F.sum("target").alias("all"))
    slots = math.ceil(one.first()["all"] or 0)
    shards = spark.range(-(-slots // shard)).select(F.col("id").alias("shard"), one.select(F.struct("s", "all")).scalar().alias("o"))
    shards = shards.select("shard", "o.s", "o.all", F.least(F.lit(shard).cast("long"), slots - F.col("shard") * shard).alias("n"))
    shards = shards.withColumn("e", F.transform("s", lambda x: F.struct(x.source_no.alias("source_no"), F.floor(x.target / F.col("all") * F.col("n")).alias("whole"), (x.target / F.col("all") * F.col("n") - F.floor(x.target / F.col("all") * F.col("n"))).alias("part"))))
    shards = shards.withColumn("rest", F.col("n") - F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x.whole)).withColumn("parts", F.aggregate("e", F.lit(0.0), lambda a, x: a + x.part))
    sure = shards.select("shard", F.explode("e").alias("x")).select(F.col("x.source_no").alias("source_no"), "shard", F.col("x.whole").alias("count"))
    drawn = shards.where("rest > 0").select("shard", "e", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest"))).alias("k"))
    drawn = drawn.withColumn("u", uniform(F.lit("draw"), F.col("shard"), F.col("k")) * F.col("parts"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("hit"), F.lit(None).cast("long").alias("last"))

    def pick(a: Column, x: Column) -> Column:
        reached = a.hit.isNull() & (x.part > 0) & (F.col("u") < a.sum + x.part)
        return F.struct((a.sum + x.part).alias("sum"), F.when(reached, x.source_no).otherwise(a.hit).alias("hit"), F.when(x.part > 0, x.source_no).otherwise(a.last).alias("last"))

    drawn = drawn.select(F.aggregate("e", start, pick, lambda a: F.coalesce(a.hit, a.last)).alias("source_no"), "shard", F.lit(1).cast("long").alias("count"))
    return sure.unionByName(drawn).unionByName(all_of).groupBy("source_no", "shard").agg(F.sum("count").alias("count")).where("count > 0")


def block_uses(plan: DataFrame, shard: int, passes: int) -> DataFrame:
    """source_no, block_no, uses: how often the mix takes each block that it takes."""
    d = running_total(draw(plan, shard, passes), ["source_no"], ["shard"], "count", "first", F.floor(F.col("shard") / 256))
    blocks = plan.select(F.col("source_no").alias("_s"), F.col("blocks"))
    d = d.join(blocks, F.col("source_no") == F.col("_s")).where("blocks > 0")
    # in runs of RUN slots, so that the slots are made in many tasks however few shards there are
    d = d.withColumn("end", F.col("first") + F.col("count"))
    d = d.select("source_no", "blocks", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / RUN), F.floor((F.col("end") - 1) / RUN))).alias("run"))
    # a number of partitions is named because these few rows stand for many: otherwise they'd be merged into one task
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, "source_no", "run").select("source_no", "blocks", F.explode(F.sequence(F.greatest("first", F.col("run") * RUN), F.least("end", (F.col("run") + 1) * RUN) - 1)).alias("slot"))
    d = d.withColumn("turn", F.floor(F.col("slot") / F.col("blocks"))).where(F.col("turn") < passes)
    return d.select("source_no", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("source_no"), F.col("turn")).alias("block_no")).groupBy("source_no", "block_no").agg(F.count("*").alias("uses"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and _h, a hash of the row's contents: rows that agree in doc_id and _h are the same row."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _contents(docs).alias("_h"))


def _contents(docs: DataFrame) -> Column:
    return row_hash(F.col("text"), F.col("source"), F.col("lang") if "lang" in docs.columns else F.lit(0))


def mix_parts(thin: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """A row for each part of a document in a block, and the sources' facts by _s.

    Parts: source_no, doc_id, size, _h, _n, first_word, block_no, uses, part (words of the document in the block), lead (its
    words before them). _n documents of size 0 that are the same have one row, of part 0. thin: sized(docs).
    """
    thin = shared_table(thin.groupBy("doc_id", "source", "size", "_h").agg(F.count("*").alias("_n")).withColumn("_all", F.col("size") * F.col("_n")), "sizes")
    cells = max(CELLS, thin.count() // CELL_ROWS)
    plan = shared_table(targets(thin.select("source", F.col("_all").alias("size")), weights, passes).withColumn("blocks", F.ceil(F.col("source_size") / block)), "sources")
    known = plan.select(F.col("source").alias("_source"), "source_no")
    d = thin.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    d = d.withColumn("_order", F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("_h")))
    d = running_total(d, ["source_no"], ["_order", "doc_id", "_h"], "_all", "first_word", F.pmod(F.col("_order"), F.lit(cells)))
    # copies, in runs of RUN so that no long array is made; those of size 0 stay one row
    d = d.withColumn("_copies", F.when(F.col("size") > 0, F.col("_n")).otherwise(1)).withColumn("_n", F.when(F.col("size") > 0, F.lit(1).cast("long")).otherwise(F.col("_n")))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))).alias("_run"))
    d = d.select("*", F.explode(F.sequence(F.col("_run") * RUN, F.least("_copies", (F.col("_run") + 1) * RUN) - 1)).alias("_copy"))
    d = d.withColumn("first_word", F.col("first_word") + F.col("_copy") * F.col("size"))
    last = F.col("first_word") + F.greatest(F.col("size"), F.lit(1)) - 1
    d = d.select("source_no", "doc_id", "size", "_h", "_n", "first_word", F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor(last / block))).alias("block_no"))
    uses = block_uses(plan, shard, passes).select(F.col("source_no").alias("_s"), F.col("block_no").alias("_b"), "uses")
    # both sides grow with the words, whatever their estimated size says: never a broadcast
    d = d.join(uses.hint("merge"), (F.col("source_no") == F.col("_s")) & (F.col("block_no") == F.col("_b")), "left").drop("_s", "_b")
    start = F.greatest(F.col("first_word"), F.col("block_no") * block)
    end = F.least(F.col("first_word") + F.col("size"), (F.col("block_no") + 1) * block)
    d = d.withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("part", end - start).withColumn("lead", start - F.col("first_word"))
    facts = plan.select(F.col("source_no").alias("_s"), "source_size", "target")
    return d, facts


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. docs: doc_id, text, source."""
    parts, facts = mix_parts(sized(docs), weights, block, shard, passes)
    d = parts.groupBy("source_no", "first_word", "doc_id", "_h", "size").agg(F.sum(F.col("part") * F.col("uses")).alias("taken"), F.max("_n").alias("_n"))
    d = d.select("source_no", "doc_id", "size", "taken", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    d = d.select("source_no", "doc_id", "size", "taken", F.explode(F.sequence(F.col("_run") * RUN, F.least("_n", (F.col("_run") + 1) * RUN) - 1)).alias("_k"))
    return d.join(facts, F.col("source_no") == F.col("_s")).select("doc_id", "size", "source_size", "target", "taken")


def _in_pass(p: int) -> Column:
    return F.filter("used", lambda x: x.uses >= p)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, passes: int = PASSES) -> DataFrame:
    """The mix as documents (the columns of documents): for each pass, of each document the words in blocks that are used in it.

    A document all of whose blocks are used in a pass keeps its text as it is; of another, the used words stay, joined by
    single spaces. Documents without words, and parts that no pass uses, are not in the mix.
    """
    parts, _ = mix_parts(sized(docs), weights, block, shard, passes)
    used = parts.where("size > 0 and uses > 0").groupBy("doc_id", "_h", "first_word", "size").agg(F.array_sort(F.collect_list(F.struct("lead", "part", "uses"))).alias("used"))
    used = used.select("doc_id", "_h", "size", F.explode(F.array(*(_in_pass(p) for p in range(1, passes + 1)))).alias("used")).where(F.size("used") > 0)
    used = used.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "used", (F.aggregate("used", F.lit(0).cast("long"), lambda a, x: a + x.part) == F.col("size")).alias("whole"))
    text = docs.select("doc_id", "text", "lang", "source", _contents(docs).alias("_h")).groupBy("doc_id", "_h").agg(*(F.first(c).alias(c) for c in ("text", "lang", "source")))
    d = text.join(used, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")))
    # the words are a lambda's argument, so that they are split once a document and not once a part
    parts_of = lambda w: F.array_join(F.flatten(F.transform("used", lambda x: F.slice(w, (x.lead + 1).cast("int"), x.part.cast("int")))), " ")
    cut = F.get(F.transform(F.array(words(F.col("text"))), parts_of), F.lit(0))
    d = d.select("doc_id", F.when(F.col("whole"), F.col("text")).otherwise(cut).alias("text"), "lang", "source")
    return d.withColumn("n_chars", F.length("text").cast("long"))
