"""Token ids of documents in sorted-string-table shards.

A shard is one file, sorted by key:

    data blocks      entries: varint shared, varint unshared, varint value length,
                     the unshared key bytes, the value (token ids, little-endian)
    block index      per block: last key, offset, length, ids before the block, crc32
    Bloom filter     bit array over the shard's keys
    footer           JSON of the places above and their crc32, its length and a magic number

A key is the document's identifier as eight big-endian bytes with the sign bit flipped,
so byte order is number order; a null identifier is the empty key and sorts first.
A lookup finds the shards by the manifest's ranges, asks the Bloom filter, binary-searches the
sparse block index and reads one block. Every part is checked against its crc32 when it is read.

Nulls: a null text is an empty one. Ties: rows of one identifier stand together, ordered by
text; `Shard.get` returns all of them. An empty table makes no shard. A very long text is one
value of one block, which may exceed the block size. Other columns of docs, of any name, are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, release, shared_dir
from larkspur.llm.tokens import encoder

MAGIC = b"LKSST001"
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "path string, docs long, ids long, first_id long, last_id long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _spread(key: bytes) -> tuple[int, int]:
    """Two hashes of a key, for the Bloom filter's double hashing."""
    n = (int.from_bytes(key, "big") + len(key)) * 0x9E3779B97F4A7C15 % 2**64
    n = (n ^ n >> 29) * 0xBF58476D1CE4E5B9 % 2**64
    n ^= n >> 32
    return n & 0xFFFFFFFF, n >> 32 | 1


class ShardWriter:
    """Writes one shard to an open binary stream; keys come in ascending order."""

    def __init__(self, stream, width: int, block_bytes: int = BLOCK_BYTES):
        self.stream, self.width, self.block_bytes = stream, width, block_bytes
        self.block, self.last = bytearray(), b""
        self.index: list[tuple[str, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.ids = self.before = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block and key != self.last and len(self.block) >= self.block_bytes:
            self._close_block()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or key != self.keys[-1]:
            self.keys.append(key)
        self.last = key
        self.ids += len(ids)

    def _write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _close_block(self) -> None:
        start, data = self.at, bytes(self.block)
        self.index.append((self.last.hex(), start, self._write(data), self.before, zlib.crc32(data)))
        self.block.clear()
        self.before = self.ids

    def close(self) -> int:
        """Write index, filter and footer; returns the file's size."""
        if self.block:
            self._close_block()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            a, b = _spread(key)
            bloom[[(a + i * b) % bits for i in range(BLOOM_HASHES)]] = True
        index, held = json.dumps(self.index).encode(), np.packbits(bloom).tobytes()
        footer = json.dumps({
            "width": self.width, "index": [self.at, len(index), zlib.crc32(index)], "bloom": [self.at + len(index), len(held), zlib.crc32(held)],
            "bits": bits, "keys": len(self.keys), "ids": self.ids,
        }).encode()
        self._write(index + held)
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.at + len(footer) + 16


class Shard:
    """Reads one shard from a seekable binary file, block by block."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        file.seek(size - 16 - (n := struct.unpack("<Q", tail[:8])[0]))
        self.footer = json.loads(file.read(n))
        self.index = json.loads(self._at(*self.footer["index"]))
        self.last_keys = [bytes.fromhex(x[0]) for x in self.index]
        self.bloom: bytes | None = None

    def _at(self, start: int, size: int, crc: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"bytes {start} to {start + size} of the shard are damaged")
        return data

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, size, _, crc = self.index[block]
        raw, at, key, kind = self._at(start, size, crc), 0, b"", f"<u{self.footer['width']}"
        view = memoryview(raw)
        while at < size:
            shared, at = _read_varint(view, at)
            own, at = _read_varint(view, at)
            length, at = _read_varint(view, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, np.frombuffer(raw, kind, length // self.footer["width"], at)
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Identifier, ids before it in the shard and ids of each document."""
        for block, (_, _, _, before, _) in enumerate(self.index):
            for key, ids in self._entries(block):
                yield id_of(key), before, ids
                before += len(ids)

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:  # read once
            self.bloom = self._at(*self.footer["bloom"])
        a, b = _spread(key_of(doc_id))
        spots = ((a + i * b) % self.footer["bits"] for i in range(BLOOM_HASHES))
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in spots)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this identifier, by Bloom filter, binary search and one block."""
        key = key_of(doc_id)
        if not self.may_hold(doc_id):
            return []
        block = bisect_left(self.last_keys, key)
        return [ids.copy() for k, ids in self._entries(block) if k == key] if block < len(self.index) else []


def _store(uri: str):
    """The file system and path of a URI; Spark's names of object stores are read as pyarrow's."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode docs and write them to shards under path; returns the manifest, a row per shard.

    width: bytes per id, 2 where every id is below 65,536, else 4. Documents are dealt by ranges of
    their identifiers, so shards don't overlap and each is sorted. An attempt writes to a
    name of its own; only the manifest's names count, so repeated or lost tasks do no harm.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")

    def write(batches):
        store = writer = None
        docs = first = last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_pylist()
                for k, raw in zip(keys, encoder(tokenizer_path, "byte").encode(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        store, folder = _store(path)
                        store.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.sst"
                        stream = store.open_output_stream(f"{folder}/.{name}")
                        writer, docs, first = ShardWriter(stream, width), 0, k
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    if width == 2 and int(ids.max()) > 0xFFFF:
                        raise ValueError("an id needs more than two bytes: use width=4")
                    writer.add(key_of(k), ids)
                    docs, last = docs + 1, k
        if writer is not None:
            size = writer.close()
            stream.close()
            store.move(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{path}/{name}", "docs": docs, "ids": writer.ids, "first_id": first, "last_id": last, "bytes": size}],
                schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("docs", "ids", "first_id", "last_id", "bytes"))]),
            )

    import pyarrow as pa

    return materialise(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's shards: id, start (ids of all documents before it) and ids.

    The running total over shards is one small window: a row per shard file.
    """
    import pyarrow as pa

    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "last_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    shards = shards.repartition(max(1, manifest.count()), "path")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, at = _store(row["path"])
                with store.open_input_file(at) as file:
                    held, size = [], 0
                    for doc_id, start, ids in Shard(file):
                        raw = ids.astype("<u4").tobytes()
                        held.append({"doc_id": doc_id, "start": row["base"] + start, "ids": raw})
                        size += len(raw)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return shards.mapInArrow(read, "doc_id long, start long, ids binary")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Ids of every row with this identifier. Only the manifest's rows whose range holds it reach the driver."""
    within = F.col("first_id").isNull() if doc_id is None else (F.coalesce(F.col("first_id") <= doc_id, F.lit(True)) & (F.col("last_id") >= doc_id))
    out: list[np.ndarray] = []
    for row in manifest.filter(within).orderBy(F.col("first_id").asc_nulls_first(), "last_id", "path").collect():
        store, at = _store(row["path"])
        with store.open_input_file(at) as file:
            out += Shard(file).get(doc_id)
    return out


def op1_sorted_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, shared_dir(spark, "token-shards"))
    release(spark)
    return read_shards(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
