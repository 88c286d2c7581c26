"""Packing token sequences by bounded-space online best-fit.

Pieces arrive in hashed order within a packing task, so bins of long pieces meet short ones
before they close. A task keeps a fixed number of open
bins. Their free spaces are bits of one integer, so the best fit for a piece (the least free
space that holds it) is one shift and one lowest-set-bit. When a new bin is needed and all
places are taken, the fullest open bin closes first.

Nulls: a null text is an empty one. A repeated row is a document of its own. Empty tables
give empty results. A very long text is many pieces. Other columns pass through `pack`, but those
named sequence_id or offset are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import materialise, quoted
from larkspur.llm.tokens import encoder, forget

PIECES = "doc_id long, piece int, start long, length long, ids binary"


class OpenBins:
    """A fixed number of open bins of one capacity, found by their free space."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.bits = 0  # bit f: an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there. 0 < length <= capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self.bins[free].pop()
            if not self.bins[free]:
                self.bits &= ~(1 << free)
            self.open -= 1
        else:
            if self.open >= self.places:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.bins[fullest].pop()
                if not self.bins[fullest]:
                    self.bits &= ~(1 << fullest)
                self.open -= 1
            free, own = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        return own, self.capacity - free


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every document with its end id; those above capacity are cut into pieces of it. Other columns of docs are not read."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = np.uint32(end_id).tobytes()

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for k, raw in zip(part.column(0).to_pylist(), encoder(tokenizer_path, "word").encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[start : start + 4 * capacity]
                        for column, value in zip(out, (k, piece, start // 4, len(ids) // 4, ids), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(quoted(id_col).cast("long").alias("k"), quoted(text_col).cast("string").alias("t"))
    return rows.mapInArrow(cut, PIECES)


def pack(held: DataFrame, capacity: int = 4096, places: int = 2048, tokens_per_task: int = 32_000_000) -> DataFrame:
    """Add sequence_id and offset to pieces that have doc_id, piece and length; other columns pass through.

    held should be a stored table: its tokens are counted to choose the number of packing tasks.
    Each task packs about tokens_per_task tokens in at most `places` open bins. Hashed order lets
    every bin meet pieces of all lengths; simulated tasks of 32 million tokens needed up to 0.9 %
    more bins than longest first in unbounded places, while longest first in 2048 places needed
    up to 13 % more.
    """
    import pyarrow as pa

    kept = [c for c in held.columns if c.lower() not in ("sequence_id", "offset")]
    rows = held.select(*map(quoted, kept))
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / tokens_per_task))
    deal = F.xxhash64("doc_id", "piece")
    rows = rows.repartition(tasks, deal).sortWithinPartitions(deal, "doc_id", "piece", "length")
    where = kept.index("length")

    def place(batches):
        from pyspark import TaskContext

        forget()  # the pieces are stored, and nothing is encoded here
        bins, first = OpenBins(capacity, places), TaskContext.get().partitionId() << 40
        for batch in batches:
            spots = [bins.place(n) for n in batch.column(where).to_pylist()]
            more = [pa.array([first + a for a, _ in spots], pa.int64()), pa.array([b for _, b in spots], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.toDF(*[f"c{i}" for i in range(len(kept))]).mapInArrow(place, schema)  # by place: names may hold dots


def packed_digest(docs: DataFrame) -> DataFrame:
    """Every piece of docs with the checksum of its ids and its place."""
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return pack(materialise(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
