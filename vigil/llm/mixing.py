"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks to sources and shards, then seeded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ranks import placed

from .common import WORD, Workspace

#: Words of a block at most, and of a shard about. A block has at most the 16th part of the smallest target, so that each source has some.
BLOCK_WORDS, SHARD_WORDS, LEAST_BLOCKS = 64, 2_000_000, 16
#: Rows equal in id and text that are dealt together.
COPIES = 500
#: Weights of sources in code-point order, repeating; a null source comes last.
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): `share` of all sizes dealt by weight, no source above `most` times its
    size; what that cuts off is dealt again by weight. Sources fill up in the order of their capacity for a unit of weight, so
    running sums over one row for each source give the level at which the rest stand."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left_words", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    # the first source that isn't filled sets the level of all later ones
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)
    target = F.least("cap", F.coalesce(open_level["level"], F.lit(float("inf"))) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def apportion(votes: DataFrame, within: list[str], party: list[str], seats: Column) -> DataFrame:
    """Sainte-Laguë: adds `quota` to rows (within, party, votes double): of the quotients votes / 1, 3, 5, ... the `seats` highest win
    one each; of equal ones the party that sorts first.

    Each party first gets votes * seats / all votes, rounded; the total then differs from `seats` by less than the number of parties, and
    only quotients near that mark can still win or lose. Those few are ranked."""
    group = Window.partitionBy(*within)
    v = votes.withColumn("seats", seats.cast("long")).withColumn("all_votes", F.sum("votes").over(group)).withColumn("parties", F.count("*").over(group))
    share = F.coalesce(F.try_divide(F.col("votes"), F.col("all_votes")), F.lit(0.0))
    v = v.withColumn("mark", F.floor(share * F.col("seats") + 0.5)).withColumn("about", (share * F.col("parties") / 2).cast("long") + 2)
    v = v.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.col("mark") - F.col("about"))).withColumn("rest", F.col("seats") - F.sum("sure").over(group))
    open_seats = v.where("votes > 0").withColumn("s", F.explode(F.sequence(F.col("sure"), F.col("mark") + F.col("about"))))
    won = open_seats.withColumn("q", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(F.col("votes") / (2 * F.col("s") + 1)), *[F.asc_nulls_last(c) for c in party]))).where("q <= rest")
    won = won.groupBy(*within, *party).agg(F.count("*").alias("won"))
    same = [v[c].eqNullSafe(won[c]) for c in [*within, *party]]
    joined = v.join(won, same, "left").select(v["*"], (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))
    return joined.drop("seats", "all_votes", "parties", "mark", "about", "sure", "rest")


def _numbered(work: Workspace, rows: DataFrame, copies: int) -> DataFrame:
    """Adds `copy`, which numbers equal rows from 0 where there are more than `copies` of them; 0 elsewhere. Such rows are found by counts and numbered by
    ranges; which of them has which number makes no difference."""
    many = work.put(rows.groupBy("lot").agg(F.count("*").alias("n")).where(F.col("n") > copies).select("lot"), "many")
    if many.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    hot = placed(rows.join(many, "lot", "left_semi"), ["doc_id", "size"], ["lot"], "copy").withColumn("copy", F.col("copy") - 1)
    return work.put(hot.unionByName(rows.join(many, "lot", "left_anti").withColumn("copy", F.lit(0).cast("long"))), "numbered")


def mix(work: Workspace, docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, keep: tuple[str, ...] = (), copies: int = COPIES) -> DataFrame:
    """(keep, doc_id, size, source_size, target, taken, epochs, cut_from, cut_to, cut_again): for every row the words that the mix takes.

    A source's documents are dealt into shards of about `shard_words` by a seeded hash, so that a hot source has many.
    In a shard they stand in seeded order, cut into equal blocks of `block_words` at most, fewer if a source's target is small. The blocks that make up all targets are apportioned to sources,
    then each source's to its shards. A shard takes its blocks once for each whole multiple of its quota, and the rest as a run
    of blocks from a seeded one on, so few documents are cut: `epochs` copies of a document are whole, then words cut_from to cut_to
    (exclusive), and from 0 to cut_again where the run comes round. No document is taken above `most` = 2 times. Null and empty texts
    have size 0 and are never taken; rows that are equal in id and text are dealt in bunches of `copies`, so that many of them don't meet in a shard; an empty table gives an empty result."""
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("lot"))
    rows = _numbered(work, work.put(rows, "sizes"), copies)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = work.put(targets(sizes, share, most, weights).withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))), "targets")
    # quotas of sources, then of their shards
    total, smallest = aims.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0))).first()
    block_words = max(1, min(block_words, int(smallest / LEAST_BLOCKS)))
    by_source = apportion(aims.withColumn("votes", F.col("target")).withColumn("one", F.lit(1)), ["one"], ["source"], F.lit(round(total / block_words))).select("source", "quota")
    known = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).select(rows["*"], "source_size", "target", "shards")
    known = known.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "lot", F.floor(F.col("copy") / copies)), F.col("shards")))
    shards = known.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(by_source, shards["source"].eqNullSafe(by_source["source"])).select(shards["*"], F.col("quota").alias("seats"))
    shards = apportion(shards.withColumn("votes", F.col("shard_size").cast("double")), ["source"], ["shard"], F.col("seats"))
    # a block holds shard_size / blocks words; the quota is block_words each
    blocks = F.greatest(F.lit(1).cast("long"), F.round(F.col("shard_size") / block_words).cast("long"))
    shards = shards.select("source", "shard", "shard_size", blocks.alias("blocks"), F.col("quota").alias("wanted"))
    shards = shards.withColumn("wanted", F.least(F.col("wanted"), (F.col("blocks") * F.lit(float(most))).cast("long")))
    shards = shards.withColumn("epochs", F.expr("wanted div blocks")).withColumn("run", F.col("wanted") % F.col("blocks"))
    shards = shards.withColumn("opens", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks")))
    edge = lambda b: F.expr(f"({b}) * shard_size div blocks")
    shards = work.put(shards.select("source", "shard", "epochs", edge("opens").alias("a"), edge("least(opens + run, blocks)").alias("b"), edge("greatest(opens + run - blocks, 0)").alias("c")), "quotas")
    place = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("lot", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = known.withColumn("at", place)
    out = placed.join(shards, placed["source"].eqNullSafe(shards["source"]) & (placed["shard"] == shards["shard"]), "left").select(placed["*"], "epochs", "a", "b", "c")
    within = lambda x: F.least(F.greatest(F.col(x) - F.col("at"), F.lit(0).cast("long")), F.col("size"))
    out = out.withColumn("cut_from", within("a")).withColumn("cut_to", within("b")).withColumn("cut_again", F.least(within("c"), F.col("cut_from")))
    taken = F.col("epochs") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("cut_again")
    return out.select(*keep, "doc_id", "size", "source_size", "target", taken.alias("taken"), "epochs", "cut_from", "cut_to", "cut_again")
