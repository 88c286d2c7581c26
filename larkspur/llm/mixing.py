"""Mixing sources to target weights.

The words of a source, its documents one after the other, are cut into blocks of a fixed length, and
a source's target makes a quota of slots. Each slot of a quota is dealt to an output shard by an
independent even draw. So the counts of a source over the shards are multinomial, the counts of a
shard over the sources are those of a multinomial draw conditioned on the quotas, and every quota is
met exactly. The counts are a table (shard, source, count). A shard's k-th slot of a source is, with the
slots of the shards before it, the source's i-th; it holds the block at place i of the source's
pseudorandom index permutation, a new one each time all its blocks have been used. Slots and
blocks are joined by index. Inside a shard, slots stand in a pseudorandom order. All is keyed
hashing, so a rerun draws the same mix.

Only DataFrame functions are used. Sources may be skewed at will: positions inside a source are
prefix sums over hash buckets (as many as the square root of the rows), and blocks, not sources, are
join keys. Targets and numbers of slots are found in windows over one row per source.

Nulls: a null text has no words; null is a source of its own, ordered last; a null identifier is
kept. Repeated rows are documents of their own; rows are known by a number, not by their contents.
Documents without words and empty tables give rows with nothing taken, or no rows. A very long text is
many blocks. Columns of any other name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, materialise, quoted, spare

ROUNDS = 24
#: Slots of a quota that are dealt from one row, and that a task makes (tasks are MOST_TASKS at most, then larger).
RUN, SLOTS_PER_TASK, MOST_TASKS = 1024, 32_768, 20_000


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x's place in a pseudorandom permutation of 0..n-1: the swap-or-not shuffle, good for any n."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, other)) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


@dataclass
class Mix:
    """docs: each document's row number, size and its source's figures. counts: slots by shard and source.
    segments: what of each document (rid) stands in which slot (shard, position, epoch, word_from, words)."""

    docs: DataFrame
    counts: DataFrame
    segments: DataFrame


def _sources(sized: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """Per source: number, size, target, blocks and slots."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    # The common level that targets are weight times: sources whose limit lies below it keep the limit.
    limit = F.col("source_size") * F.lit(float(max_repeats))
    by_ratio = Window.orderBy(limit / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    held = ranked.withColumns({
        "limited": F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    level = (F.col("total") - F.col("limited")) / F.col("weights")
    held = held.withColumn("level", F.max(F.when(level <= limit / F.col("weight"), level)).over(every))
    target = F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(blocks * max_repeats, F.round(F.col("target") * blocks / F.col("source_size")))).otherwise(0)
    return held.withColumn("target", target).select("sid", "source", "source_size", "target", blocks.alias("blocks"), slots.cast("long").alias("slots"))


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's place: the words of its source before it, in order of hash bucket, identifier and contents."""
    buckets = max(1, round(sized.count() ** 0.5))
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "h", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    placed = placed.join(sums, ["sid", "bucket"]).withColumn("place", F.col("inside") + F.col("ahead"))
    return placed.select("rid", "doc_id", "sid", "size", "place", "source_size", "target")


def shard_counts(sources: DataFrame, shards: int, tasks: int, seed: int) -> DataFrame:
    """(sid, shard, n): every slot of every source's quota draws its shard."""
    runs = sources.filter("slots > 0").select("sid", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / RUN))).alias("run"))
    unit = F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)).alias("unit")
    dealt = runs.repartition(tasks, "sid", "run").select("sid", unit)
    shard = F.pmod(F.xxhash64(F.lit(seed).cast("long"), "sid", "unit"), F.lit(shards).cast("long"))
    return dealt.groupBy("sid", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def mix(docs: DataFrame, block: int = 128, shard_slots: int = 16_384, seed: int = 17, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", number: Column | None = None) -> Mix:
    """Mix all documents. block: words in a block. shard_slots: slots in an output shard, about. number: a column that numbers the rows of docs."""
    sized = docs.select(
        (F.monotonically_increasing_id() if number is None else number).alias("rid"), quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(quoted(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(quoted(id_col), quoted(source_col).cast("string"), quoted(text_col).cast("string")).alias("h"),
    )
    sized = materialise(sized, "mix-sizes")
    sources = materialise(_sources(sized, block, max_repeats), "mix-sources")
    placed = materialise(_placed(sized, sources), "mix-places", drop=(sized,))

    quota = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, round(quota / shard_slots))
    tasks = max(1, min(MOST_TASKS, -(-quota // SLOTS_PER_TASK)))
    drawn = shard_counts(sources, shards, tasks, seed)
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.join(sources.select("sid", "blocks"), "sid").withColumns({
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "first": F.coalesce(F.sum("n").over(beside), F.lit(0)),
        "shard_size": F.sum("n").over(Window.partitionBy("shard")),
    })
    counts = materialise(counts, "mix-counts")

    i = F.col("before") + F.col("k")
    slots = counts.repartition(tasks, "sid", "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    epoch = F.floor(i / F.col("blocks"))
    inner = permuted(i % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed).cast("long"), "sid", epoch))
    position = permuted(F.col("first") + F.col("k"), F.col("shard_size"), F.xxhash64(F.lit(seed).cast("long"), "shard"))
    slots = slots.select("sid", epoch.alias("epoch"), inner.alias("block"), "shard", position.alias("position"))

    first, end = F.col("place"), F.col("place") + F.col("size")
    parts = placed.filter("size > 0").select("rid", "sid", "place", "size", F.explode(F.sequence(F.floor(first / block), F.floor((end - 1) / block))).alias("block"))
    start = F.greatest(F.col("place"), F.col("block") * block)
    stop = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("rid", "sid", "block", (start - F.col("place")).alias("word_from"), (stop - start).alias("words"))
    # Both sides grow with the input, and Spark's estimate after explode is far too low: never broadcast.
    return Mix(placed, counts, slots.hint("merge").join(parts.hint("merge"), ["sid", "block"]))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", places: tuple[str, str] = ("shard", "position"), **settings) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each time that a document is used, with its shard and
    position (that of the first block of it used) in columns named by places.

    Where only some blocks of a document are used, its text is these stretches of it, in their
    order and with all their white space. chars_col, if there, follows the text.
    """
    held = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[quoted(c) for c in docs.columns]).alias("row")), "mix-rows")
    inside = held.select("rid", *[F.col("row").getField(c).alias(n) for c, n in ((id_col, "i"), (text_col, "t"), (source_col, "s"))])
    mixed = mix(inside, id_col="i", text_col="t", source_col="s", number=F.col("rid"), **settings)
    at = F.struct("shard", "position")
    used = mixed.segments.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("word_from", "words"))).alias("parts"), F.sum("words").alias("used"), F.min(at).alias("at"))
    used = used.join(mixed.docs.filter("size > 0").select("rid", "size"), "rid").select("rid", "parts", "at", (F.col("used") == F.col("size")).alias("whole"))
    rows = used.hint("merge").join(held.hint("merge"), "rid")
    own = F.col("row").getField(text_col)
    space = r"[\x20\x09-\x0D]*"
    words = F.regexp_extract_all(own.cast("string"), F.lit(WORD + space), F.lit(0))
    some = F.flatten(F.transform("parts", lambda p: F.slice(F.col("words"), (p["word_from"] + 1).cast("int"), p["words"].cast("int"))))
    lead = F.when(F.col("parts")[0]["word_from"] == 0, F.regexp_extract(own.cast("string"), "^" + space, 0)).otherwise("")
    rows = rows.withColumn("words", F.when(~F.col("whole"), words))
    rows = rows.withColumn("text", F.when(F.col("whole"), own.cast("string")).otherwise(F.concat(lead, F.array_join(some, ""))))
    kinds = {f.name: f.dataType for f in docs.schema}
    put = {text_col: F.col("text").cast(kinds[text_col])} | ({chars_col: F.length("text").cast(kinds[chars_col])} if chars_col in kinds else {})
    if set(places) & set(docs.columns):
        raise ValueError(f"docs has a column {' or '.join(places)}: name others by places")
    return rows.select(*[put.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns], *[F.col("at")[c].alias(n) for c, n in zip(("shard", "position"), places, strict=True)])


def in_mixed_order(docs: DataFrame, **settings) -> DataFrame:
    """mixed_documents as stored rows: a shard's rows stand together in the order of their positions. Columns are those of docs."""
    places = tuple(spare(docs, "shard", "position"))
    rows = mixed_documents(docs, places=places, **settings)
    return rows.repartition(places[0]).sortWithinPartitions(*places).select(*[quoted(c) for c in docs.columns])


def taken_digest(mixed: Mix) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    taken = mixed.segments.groupBy("rid").agg(F.sum("words").alias("taken"))
    return mixed.docs.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_digest(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
