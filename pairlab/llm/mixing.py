"""Mixing sources to target weights with DataFrame functions alone.

1. Words of each source lie end to end and are cut into blocks of
   ``block_words``, or of less in a source that has few words, so that it has
   ``LEAST_BLOCKS`` of them; a document knows its place from sums over hash
   buckets, so no task sees a whole source.
2. Targets follow the weights; none exceeds ``most`` times its source, what
   is above goes to the others by weight (one water level, found on the sorted
   per-source table).
3. Every output shard draws how many blocks it takes from each source: the
   whole part of the expectation, and the rest multinomially.
4. The j-th slot of a source over all shards is mapped by a pseudorandom
   permutation of the source's block numbers (swap-or-not, which needs no
   table and fits any number), pass after pass, and joins the blocks by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import WORD, store, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
LEAST_BLOCKS = 256
SHARD_BLOCKS = 65_536
ROUNDS = 24
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with source_no and target; one row per source.

    Sources are ordered by code point with null last and take ``weights`` in
    turn.  The per-source table is ordered in one task: it has a row per
    source, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = sizes.withColumn("source_no", number).withColumn("weight", w).withColumn("top", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("top") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("top").over(level), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(level), F.lit(0.0)).alias("full_weight"),
    )
    # with all sources before this one full, the rest share by weight; the first that stays below its top sets the level
    share = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("full_weight"))
    place = F.struct(F.col("top") / F.col("weight"), "source_no", share.alias("share"))
    table = table.withColumn("first", F.when(share * F.col("weight") <= F.col("top"), place))
    table = table.withColumn("share", F.min("first").over(everything)["share"])
    target = F.least("top", F.coalesce(F.col("share") * F.col("weight"), F.col("top")))
    return table.select("source", "source_no", "source_size", target.alias("target"))


def spread(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 .. size - 1 chosen by ``key``."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x + size, size)
        high = F.greatest(x, partner)
        return F.when(F.xxhash64(key, r, high).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (source_no, key, size) with the number of its source's words before each row."""
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    sums = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return dealt.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def with_length(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``targets`` with the words of a block of each source."""
    own = F.ceil(F.col("source_size") / LEAST_BLOCKS)
    return targets.withColumn("length", F.least(F.lit(block_words), F.greatest(own, F.lit(1))).cast("long"))


def block_uses(targets: DataFrame, shard_blocks: int = SHARD_BLOCKS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(source_no, block, uses): how often the mix takes each block, over all output shards."""
    blocks = F.ceil(F.col("source_size") / F.col("length"))
    # a slot holds the mean words of the source's blocks, the last of which may be shorter
    wanted = targets.where("source_size > 0").select(
        "source_no", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("slots")
    )
    everything = Window.partitionBy()
    wanted = wanted.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(everything) / shard_blocks)))
    wanted = wanted.withColumn("mean", F.col("slots") / F.col("shards"))
    wanted = wanted.withColumn("rest", F.col("mean") - F.floor("mean"))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    wanted = wanted.withColumn("from", F.coalesce(F.sum("rest").over(upto), F.lit(0.0))).withColumn("rests", F.sum("rest").over(everything))
    wanted = store(wanted, "wanted")
    shares = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    # draws of a shard: as many as the rests sum up to; each falls on the last source that begins at or before it
    draws = (
        shares.where(F.col("from") == 0).groupBy("shard").agg(F.max("rests").alias("rests"))
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round("rests").cast("int")))))
        .where("draw <= round(rests)")
        .select("shard", (F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("rests")).alias("from"), F.lit(None).cast("int").alias("source_no"))
    )
    line = shares.where("rest > 0").select("shard", "from", F.col("source_no").cast("int").alias("source_no"))
    last = Window.partitionBy("shard").orderBy("from", F.col("source_no").isNull(), "source_no").rowsBetween(Window.unboundedPreceding, 0)
    fell = line.withColumn("drawn", F.lit(0)).unionByName(draws.withColumn("drawn", F.lit(1)))
    fell = fell.withColumn("source_no", F.last("source_no", ignorenulls=True).over(last)).where("drawn = 1")
    fell = fell.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("extra"))
    taken = shares.join(fell, ["shard", "source_no"], "left").withColumn("n", F.floor("mean") + F.coalesce("extra", F.lit(0)))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # no block is taken more than ``most`` times, so no document is
    taken = taken.withColumn("end", F.least(F.col("begin") + F.col("n"), F.col("blocks") * most)).where("end > begin")
    # a row holds up to a shard's slots, so the rows are dealt before they are spread out
    taken = taken.repartition(spread(taken), "source_no", "shard")
    slots = taken.select("source_no", "blocks", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source_no"), F.lit("blocks"))
    block = permuted(F.col("slot") - turn * F.col("blocks"), F.col("blocks"), key)
    return slots.select("source_no", block.alias("block")).groupBy("source_no", "block").agg(F.count(F.lit(1)).cast("int").alias("uses"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
    most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    size counts words (null text: 0), taken the words the mix takes of the
    row, repeats counted; it never exceeds ``most`` times the size.  A null
    source is a source of its own, last in order.  Repeated rows are rows of
    their own; their joint words are dealt among them.  An empty table gives
    no rows.  Other columns are not read.
    """
    rows = store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(with_length(source_targets(sizes, weights, most), block_words), "targets")
    known = rows.join(targets, rows.source.eqNullSafe(targets.source)).select("doc_id", "size", "source_no", "source_size", "target", "length")
    n = rows.count()
    put = store(placed(known.withColumn("key", F.struct("doc_id")), max(64, n >> 14)).drop("key"), "placed")
    parts = block_parts(put.where("size > 0"))
    uses = block_uses(targets, most=most, seed=seed)
    got = parts.hint("merge").join(uses, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # rows with words have a place of their own in their source
    filled = put.where("size > 0").join(got, ["source_no", "start"], "left")
    none = put.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return filled.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def block_parts(put: DataFrame) -> DataFrame:
    """``put`` (source_no, start, size > 0, length) with a row for each block it reaches: block, words in it and their place in the row."""
    first, last = F.expr("start div length"), F.expr("(start + size - 1) div length")
    rows = put.select("source_no", "start", "size", "length", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("start", F.col("block") * F.col("length"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return rows.select("source_no", "start", "block", (end - begin).alias("words"), (begin - F.col("start")).alias("at"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
    most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for every pass over a document's taken blocks.

    The first pass holds the words of all its blocks that are taken at least
    once, the next those taken twice, and so on; a document of which nothing
    is taken goes.  Blanks between taken words stay.  Rows equal in id, source
    and text count once.
    """
    key = [F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("_hash")]
    rows = store(docs.select(*key, word_count(F.col(text_col)).alias("size")).distinct(), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(with_length(source_targets(sizes, weights, most), block_words), "targets")
    numbers = targets.select("source", "source_no", "length")
    known = rows.join(numbers, rows.source.eqNullSafe(numbers.source)).select("_id", "_hash", "size", "source_no", "length")
    put = placed(known.withColumn("key", F.struct("_id", "_hash")).where("size > 0"), max(64, rows.count() >> 14))
    put = store(put, "placed")
    uses = block_uses(targets, most=most, seed=seed)
    parts = block_parts(put).hint("merge").join(uses, ["source_no", "block"])
    taken = parts.groupBy("source_no", "start").agg(F.sort_array(F.collect_list(F.struct("at", "words", "uses"))).alias("_parts"))
    taken = put.join(taken, ["source_no", "start"]).select(F.col("_id").alias("_kid"), F.col("_hash").alias("_khash"), F.col("source_no").alias("_no"), "_parts")
    names = targets.select(F.col("source").alias("_source"), F.col("source_no").alias("_sno"))
    own = docs.join(F.broadcast(names), docs[source_col].eqNullSafe(F.col("_source")))
    own = own.join(taken, (own[id_col].eqNullSafe(F.col("_kid"))) & (F.xxhash64(own[text_col]) == F.col("_khash")) & (F.col("_sno") == F.col("_no")))
    once = Window.partitionBy("_kid", "_khash", "_no").orderBy(F.lit(0))
    own = own.withColumn("_row", F.row_number().over(once)).where("_row = 1")
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    passes = own.withColumn("_words", words).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_parts", lambda p: p["uses"])))))
    some = F.filter("_parts", lambda p: p["uses"] >= F.col("_pass"))
    text = F.array_join(F.flatten(F.transform(some, lambda p: F.slice("_words", p["at"].cast("int") + 1, p["words"].cast("int")))), "")
    return passes.select(*[F.rtrim(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
