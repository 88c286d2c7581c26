"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once; the hash's high bits choose a bin, each bin keeps
its least hash. An empty bin copies a bin drawn for it alone, uniformly among the filled
ones (optimal densification): the first filled bin of a few hashed draws, and where all of
these are empty, the filled bin with the least hashed rank. A fingerprint stores eight low
bits of each bin's value, hashed with the bin. Two unequal bins still agree by chance in 1 of 256, which the
likeness corrects for.

Words are what stands between ASCII white space. A text of one to four words is one shingle; a text
without words, empty or null has the empty fingerprint, like only to itself. Equal texts
have equal fingerprints. Repeated rows and null identifiers are kept (null first in order). The
next document's text comes by one shuffle on identifier ranges, whose first documents are
also sent to the range before; no range is collected. A very long text is fingerprinted whole. Empty
tables give no rows. Other columns of documents are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, let

BINS_LOG2 = 8
BINS = 1 << BINS_LOG2
VALUE_BITS = 63 - BINS_LOG2
EMPTY = (1 << VALUE_BITS) - 1
DRAWS = 8
SHINGLE = 5
#: Documents of a range of identifiers for finding the next one, and ranges at most, whose bounds (8 bytes each) come to the driver. Beyond
#: their product ranges grow, and a task sorts its range on disk.
DOCS_PER_RANGE, MOST_RANGES = 2000, 65_536


def shingle_hashes(text: Column) -> Column:
    """A 63-bit hash of each shingle of a text, repeats included."""

    def of(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(SHINGLE)) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
        short = F.array(F.xxhash64(words))
        return F.when(n >= SHINGLE, many).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.transform(let(words, of), lambda h: F.shiftrightunsigned(h, 1))


def fingerprint(text: Column) -> Column:
    """The low bits of every bin as an array of bytes; empty where the text has no words."""
    bin_of = lambda v: F.shiftright(v, VALUE_BITS).cast("int")
    filled = lambda v: v.bitwiseAND(F.lit(EMPTY)) != EMPTY
    blanks = F.split(F.lit(" ".join(str(j << VALUE_BITS | EMPTY) for j in range(BINS))), " ").cast("array<bigint>")

    def least(held: Column) -> Column:
        """Of sorted hashes and one blank per bin, the first of each bin."""
        return F.filter(held, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(held, F.greatest(i - 1, F.lit(0))))))

    def dense(bins: Column) -> Column:
        def fill(own: Column) -> Column:
            def donor(j: Column) -> Column:
                draws = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda a: F.get(bins, F.xxhash64(j, a).bitwiseAND(F.lit(BINS - 1)).cast("int")))
                rank = lambda v: F.struct(F.xxhash64(j, F.lit(0), bin_of(v)).alias("rank"), v.alias("value"))
                return F.coalesce(F.get(F.filter(draws, filled), F.lit(0)), F.array_min(F.transform(own, rank))["value"])

            return F.transform(bins, lambda v, j: F.when(filled(v), v).otherwise(donor(j)))

        whole = F.when(F.size(F.filter(bins, filled)) == BINS, bins).otherwise(let(F.filter(bins, filled), fill))
        # Hashed with the bin, so that copies of one value don't agree by chance in all their bins at once.
        return F.transform(whole, lambda v, j: (F.xxhash64(v, j).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.array().cast("array<tinyint>")).otherwise(let(let(F.sort_array(F.concat(hashes, blanks)), least), dense))

    return let(shingle_hashes(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets: bins that agree, less those that agree by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    chance = 1.0 / 256
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def packed(fp: Column) -> Column:
    """A fingerprint as text, two hex digits per bin."""
    digits = F.split(F.lit(" ".join(f"{i:02x}" for i in range(256))), " ")
    return F.array_join(F.transform(fp, lambda v: F.get(digits, F.pmod(v.cast("int"), F.lit(256)))), "")


def last_at_most(bounds: Column, count: int, key: Column) -> Column:
    """The place of the last of `count` ascending bounds that is at most key, by halving; 0 where none is."""

    def halve(acc: Column, _: Column) -> Column:
        return let(F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int"), lambda mid: F.when(F.get(bounds, mid) <= key, F.struct(mid.alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), F.greatest(mid - 1, acc["low"]).alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, count.bit_length()))), F.struct(F.lit(0).alias("low"), F.lit(count - 1).alias("high")), halve)["low"]


def with_next(rows: DataFrame, payload: list[str], docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """Add next_<c> for each payload column: that of the next row by key (then text), of the last row the first one's."""
    key = F.col("key")
    n = rows.count()
    ranges = max(1, min(n // docs_per_range, MOST_RANGES))
    numbers = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    about = sorted(set(rows.agg(F.percentile_approx("key", numbers([i / ranges for i in range(ranges)], "double"), 10 * ranges).alias("q")).first()["q"] or []))
    if not about:
        return rows.withColumns({f"next_{c}": F.col(c) for c in payload})
    # Percentiles go through doubles, which don't hold every long: a range's bound is the least key that falls into it.
    firsts = rows.groupBy(last_at_most(numbers(about, "bigint"), len(about), key).alias("range")).agg(F.min("key").alias("first"))
    bounds = sorted(r["first"] for r in firsts.collect())
    held = numbers(bounds, "bigint")
    place = lambda at, guard: F.struct(at.alias("range"), F.lit(guard).alias("guard"))
    both = let(last_at_most(held, len(bounds), key), lambda j: F.when(F.get(held, j) == key, F.array(place(j, False), place(F.pmod(j - 1, F.lit(len(bounds))), True))).otherwise(F.array(place(j, False))))
    dealt = rows.select("*", F.explode(both).alias("_at")).select(*rows.columns, "_at.range", "_at.guard")
    order = Window.partitionBy("range").orderBy("guard", "key", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload}).filter(~F.col("guard")).drop("range", "guard")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("fp"))).alias("e"))
    return rows.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("e.fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
