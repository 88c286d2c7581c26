"""Removal of byte strings that an earlier document holds too.

Every string of `width` bytes that also starts in a document with a smaller identifier is removed,
judged on the input. The search is a Burrows-Wheeler one: in a group of text pieces that could share
strings, breadth-first backward extension of intervals derives the common-prefix lengths of
neighbouring suffixes by increasing value and stops at the width. What is then still open is
a common prefix of at least the width; the least identifier of such a run of suffixes keeps its copy.

Pieces meet in one group as follows. Each window of `width` bytes has a least hash among its
inner strings of 24 bytes; it depends on the window alone, so equal windows have equal ones.
Runs of windows with one least hash are pieces. Texts stand in chunks by identifier. For
each distinct piece a chunk sends two hashes, of 32 and 96 bits beside its bucket's. Where a chunk before
it has the piece, it is settled by them, so that a passage in a third of all documents is searched once; only
first pieces that share their least hash with a different piece are sent as bytes and
searched. No pair of documents is ever formed.

Nulls: a null text is an empty one; a null identifier is smaller than any other. Rows with one
identifier never remove from each other. Texts below `width` bytes lose nothing; very long ones are
chunks of their own. Empty tables give no rows. A chunk holds whole identifiers; texts are never cut or
dropped. Other columns of docs are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, quoted, release
from larkspur.llm.words import mixed

INNER = 24
#: Bytes of a chunk's texts, of one bucket's hashes, and of pieces searched together. Beyond GROW_BYTES of input, chunks and
#: buckets grow with its square root (to 4 and 8 times), so that what a chunk sends to a bucket doesn't shrink to single pieces.
CHUNK_BYTES, BUCKET_BYTES, GROUP_BYTES, GROW_BYTES = 2_000_000, 8_000_000, 300_000, 30_000_000_000
#: Bytes that a chunk sends of a distinct piece: four of its least hash and OWN_BYTES of its own.
OWN_BYTES = 12
MOST_WINDOWS = 64  # of a piece, so that a piece's removed windows are the bits of one integer
_rng = np.random.default_rng(7919)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
OTHER = _rng.integers(0, 2**64, 256, np.uint64)
BLOCK = 16_384  # bytes hashed at once
_kept = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of INVERSE and BASE up to the n-th at least, kept by the Python worker."""
    if len(_kept[0]) <= n:
        _kept[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n + n // 8, x))), dtype=np.uint64) for x in (INVERSE, BASE)]
    return _kept[0], _kept[1]


def _least_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Of each window, across the ends of texts too, the least hash of its inner strings; a block at a time, so that arrays stay in the cache."""
    n, span = len(data) - width + 1, width - INNER + 1
    out = np.empty(n, np.uint64)
    third = np.uint64(pow(0x9E3779B97F4A7C15, 8, 2**64))
    for at in range(0, n, BLOCK):
        h, k = BYTE[data[at : at + BLOCK + width - 1]], 1
        while k < 8:
            h = h[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) + h[k:]
            k *= 2
        h = (h[:-16] * third + h[8:-8]) * third + h[16:]
        h, k = mixed(h), 1
        while 2 * k <= span:
            h = np.minimum(h[:-k], h[k:])
            k *= 2
        if k < span:
            h = np.minimum(h[: len(h) - (span - k)], h[span - k :])
        out[at : at + BLOCK] = h
    return out


def _pieces(data: np.ndarray, at: np.ndarray, width: int):
    """Pieces of all texts: least hash, two hashes of the piece's bytes, text, first window, number of windows."""
    n = len(data) - width + 1
    empty, none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n <= 0:
        return none, none, none, empty, empty, empty
    h = _least_hashes(data, width)
    start = np.ones(n, bool)
    np.not_equal(h[1:], h[:-1], out=start[1:])
    start[at[at < n]] = True
    run = np.flatnonzero(start)
    follows = np.append(run[1:], n)
    owner = np.searchsorted(at, run, "right") - 1
    limit = at[owner + 1] - width + 1  # windows from here on reach beyond the text
    on = run < limit
    run, owner, end = run[on], owner[on], np.minimum(follows, limit)[on]
    if not len(run):
        return none, none, none, empty, empty, empty
    parts = -(-(end - run) // MOST_WINDOWS)
    p = np.repeat(run, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_WINDOWS
    owner = np.repeat(owner, parts)
    windows = np.minimum(np.repeat(end, parts) - p, MOST_WINDOWS)
    powers, lift = _powers(len(data))

    def bytes_hash(values: np.ndarray) -> np.ndarray:
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        for a in range(0, len(data), BLOCK):
            part = values[data[a : a + BLOCK]]
            part *= powers[a : a + len(part)]
            part[:1] += total[a : a + 1]
            np.cumsum(part, out=total[a + 1 : a + 1 + len(part)])
        return mixed((total[p + windows + width - 1] - total[p]) * lift[p] + windows.astype(np.uint64))

    # Least hashes are small; mixed again they spread evenly.
    return mixed(h[p] ^ BASE), bytes_hash(BYTE), bytes_hash(OTHER), owner, p, windows


class Entries:
    """The distinct pieces of a chunk in a fixed order, and every place where they stand."""

    def __init__(self, ranks: np.ndarray, at: np.ndarray, data: np.ndarray, width: int, bits: int):
        least, own, more, text, place, windows = _pieces(data, at, width)
        least, more = least >> np.uint64(32 - bits), more >> np.uint64(32)
        who = ranks[text]
        order = np.argsort(least, kind="stable")  # texts stand by identifier, so the first place has the least one
        tied = np.zeros(len(order) + 1, bool)
        tied[1:-1] = least[order[1:]] == least[order[:-1]]
        tied = np.flatnonzero(tied[1:] | tied[:-1])
        some = order[tied]
        order[tied] = some[np.lexsort((some, more[some], own[some], least[some]))]
        least, own, more, self.place, self.windows, who = least[order], own[order], more[order], place[order], windows[order], who[order]
        new = np.ones(len(order), bool)
        new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (more[1:] != more[:-1])
        self.entry = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.least, self.own, self.more, self.head = least[head], own[head], more[head], head
        self.first_rank = who[head]
        self.later = who != self.first_rank[self.entry]
        self.bucket = (self.least >> np.uint64(32)).astype(np.int64)

    def buckets(self):
        """(bucket, first entry, end)."""
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return zip(self.bucket[edge].tolist(), edge.tolist(), np.append(edge[1:], len(self.bucket)).tolist(), strict=True)


def _chunk(row: dict, width: int, bits: int):
    import pyarrow as pa

    at = np.array(row["at"], np.int64)
    size = int(at[-1])
    data = np.frombuffer(pa.decompress(row["data"], size, "zstd", asbytes=True), np.uint8) if size else np.empty(0, np.uint8)
    ids, none = np.array(row["ids"], np.int64), np.array(row["none"], bool)
    ranks = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]))))  # rows stand by identifier
    return ids, at, data, Entries(ranks, at, data, width, bits)


def _numbered(key: np.ndarray) -> np.ndarray:
    """The places of values among the distinct ones, from 0."""
    order = np.argsort(key)
    value = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], value[1:] != value[:-1])))
    return out


def repeated_windows(pieces: list[bytes], ids: np.ndarray, width: int) -> list[int]:
    """Of each piece, the windows (as bits) that start in a piece with a smaller identifier too.

    Suffixes are sorted by their first `width` bytes, which gives the Burrows-Wheeler transform and its
    mapping to the preceding suffix. Round by round, from the interval of all suffixes on, each interval of suffixes
    with a common prefix is extended backward by each byte before it; the end of the new interval ends
    its common prefix, unless a shorter one ended there before, and then the interval is not followed. So
    round l finds the borders of common prefixes of length l - 1. After `width` rounds, open borders join
    suffixes that share `width` bytes.
    """
    lengths = np.array([len(p) for p in pieces])
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = int((lengths + 1).sum())
    text = np.zeros(n, np.uint8)  # 0 ends a piece
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.unique(raw)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    text[np.repeat(starts, lengths) + np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code[raw]
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(n)  # bytes to the piece's end

    # Eight bytes from each place on, as one number; what lies behind the piece's end counts as 0.
    eight = np.concatenate((text, np.zeros(width + 16, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        eight = (eight[:-k] << np.uint64(8 * k)) | eight[k:]
    size = np.clip(np.minimum(left, width), 1, 8)
    drop = np.uint64(8) * (8 - size).astype(np.uint64)
    key, known = np.where(left > 0, eight[:n] >> drop << drop, 0), 8
    while known < width:  # number the first `known` bytes, then join the numbers of two places; past a piece's end the number is 0
        number, step = _numbered(key), min(known, width - known)
        after = np.zeros(n, np.int64)
        after[: n - step] = np.where(left[: n - step] >= step, number[step:], 0)
        key, known = number * (n + 1) + after, known + step
    suffixes = np.argsort(key, kind="stable")
    before = np.where(suffixes > 0, text[suffixes - 1], 0).astype(np.uint8)
    back = np.empty(n, np.int64)  # where the suffix one byte longer stands
    back[np.argsort(before, kind="stable")] = np.arange(n)

    ended = np.zeros(n + 1, bool)
    ended[[0, n]] = True
    opening = text[suffixes]
    low, high = np.array([0]), np.array([n])
    for _ in range(width):
        if not len(low):
            break
        size = high - low
        member = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(low)), size)
        if 8 * len(member) > n:  # members of one interval with one byte before them stand together at the end of the step back
            mark = np.zeros(n + 1, np.int64)
            mark[back[member]] = owner + 1
            edge = np.ones(n + 1, bool)
            edge[1:n] = (mark[1:n] != mark[: n - 1]) | (opening[1:] != opening[:-1])
            a = np.flatnonzero(edge[:n] & (mark[:n] > 0) & (opening > 0))
            edges = np.flatnonzero(edge)
            b = edges[np.searchsorted(edges, a, "right")]
        else:
            key = owner << 8 | before[member]
            order = np.argsort(key, kind="stable")
            key, member = key[order], member[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            on = (key[new] & 255) > 0
            a, b = back[member[new]][on], back[member[np.append(new[1:], True)]][on] + 1
        on = ~ended[b] | (b == n)
        low, high = a[on], b[on]
        ended[high] = True
    full = left[suffixes] >= width
    open_border = ~ended[1:n] & full[:-1] & full[1:]
    group = np.concatenate(([0], np.cumsum(~open_border)))
    piece = np.searchsorted(starts, suffixes, "right") - 1
    who = ids[piece]
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, np.where(full, who, np.iinfo(np.int64).max))
    hit = np.flatnonzero(full & (who > least[group]))
    bits = np.zeros(len(pieces), np.uint64)
    np.bitwise_or.at(bits, piece[hit], np.uint64(1) << (suffixes[hit] - starts[piece[hit]]).astype(np.uint64))
    return bits.tolist()


def _searched(least: np.ndarray, ids: np.ndarray, pieces: list[bytes], width: int) -> list[int]:
    """repeated_windows over whole groups of equal least hash, GROUP_BYTES at a time."""
    order = np.argsort(least, kind="stable")
    edges = np.flatnonzero(np.diff(least[order], prepend=least[order][0] + 1 if len(order) else 0))
    out = [0] * len(pieces)
    held: list[int] = []
    size = 0

    def search(members):
        for k, bits in zip(members, repeated_windows([pieces[k] for k in members], ids[members], width), strict=True):
            out[k] = bits

    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        own = order[a:b].tolist()
        group_size = sum(len(pieces[k]) for k in own)
        if group_size > 4 * GROUP_BYTES:  # one very frequent least hash: its windows are dealt by their own hashes
            parts: dict[int, list[tuple[int, int]]] = {}
            count = group_size * 16 // GROUP_BYTES
            for k in own:
                for j in range(len(pieces[k]) - width + 1):
                    parts.setdefault(hash(pieces[k][j : j + width]) % count, []).append((k, j))
            for members in parts.values():
                found = repeated_windows([pieces[k][j : j + width] for k, j in members], ids[[k for k, _ in members]], width)
                for (k, j), bits in zip(members, found, strict=True):
                    out[k] |= bits << j
            continue
        if held and size + group_size > GROUP_BYTES:
            search(held)
            held, size = [], 0
        held.extend(own)
        size += group_size
    if held:
        search(held)
    return out


def _by_key(batches, column: int):
    """Rows of each key in turn, from batches sorted by it."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = row[batch.schema.names[column]]
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (the bytes that are left) of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    if width < INNER + 8:
        raise ValueError(f"width must be {INNER + 8} at least")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit(0)).alias("k"), quoted(id_col).isNull().alias("none"), text.alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    grown = max(1.0, math.sqrt(total / GROW_BYTES))
    chunk_bytes, bucket_bytes = CHUNK_BYTES * min(4.0, grown), BUCKET_BYTES * min(8.0, grown)
    order = (F.col("none").desc(), F.col("k"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def gather(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        none: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def made():
            at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).tolist()
            row = {"chunk": number, "ids": list(ids), "none": list(none), "at": at, "data": pa.compress(b"".join(texts), "zstd", asbytes=True)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("none", pa.list_(pa.bool_())), ("at", pa.list_(pa.int64())), ("data", pa.binary())]))

        for batch in batches:
            for k, missing, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if ids and size >= chunk_bytes and (ids[-1], none[-1]) != (k, missing):
                    yield made()
                    ids, none, texts, size, number = [], [], [], 0, number + 1
                ids.append(k)
                none.append(missing)
                texts.append(text)
                size += len(text)
        if ids:
            yield made()

    chunks = materialise(rows.mapInArrow(gather, "chunk long, ids array<long>, none array<boolean>, at array<long>, data binary"), "chunks")
    release(spark)
    bits = max(0, min(30, math.ceil(math.log2(max(1, total * 0.96 / bucket_bytes)))))
    tasks = max(1, min(1 << bits, 20_000))
    blob = "bucket long, chunk long, data binary"
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])

    def name(batches):
        for batch in batches:
            for row in batch.to_pylist():
                e = _chunk(row, width, bits)[3]
                out = [{"bucket": b, "chunk": row["chunk"], "data": (e.least[x:y] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + e.more[x:y].astype("<u4").tobytes() + e.own[x:y].astype("<u8").tobytes()} for b, x, y in e.buckets()]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    def settle(batches):
        """1: an earlier chunk has the piece. 2: the first such piece, but others share its least hash."""
        for bucket, rows in _by_key(batches, 0):
            counts = [len(r["data"]) // (4 + OWN_BYTES) for r in rows]
            part = lambda kind, at: np.concatenate([np.frombuffer(r["data"], kind, c, at * c) for r, c in zip(rows, counts, strict=True)])  # noqa: E731, B023
            least, more, own = part("<u4", 0), part("<u4", 4), part("<u8", 8)
            order = np.lexsort((more, own, least))  # stable: chunks in turn
            x, y, z = least[order], own[order], more[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
            start = np.flatnonzero(np.diff(x.astype(np.int64), prepend=-1))
            kinds = np.repeat(np.add.reduceat(new.astype(np.int64), start), np.diff(np.append(start, len(x))))
            flags = np.empty(len(x), np.uint8)
            flags[order] = np.where(new, np.where(kinds > 1, 2, 0), 1)
            at = np.cumsum([0, *counts])
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "chunk": r["chunk"], "data": flags[a:b].tobytes()} for r, a, b in zip(rows, at, at[1:], strict=False)], schema=schema)

    named = chunks.mapInArrow(name, blob).repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk")
    flags = materialise(named.mapInArrow(settle, blob), "flags")
    release(spark)

    def per_chunk(table: DataFrame, column: str) -> DataFrame:
        return table.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias(column))

    def flags_of(row, e):
        out = np.zeros(len(e.least), np.uint8)
        held = {x["bucket"]: x["data"] for x in row["flags"] or ()}
        for b, x, y in e.buckets():
            out[x:y] = np.frombuffer(held[b], np.uint8)
        return out

    flagged = chunks.join(per_chunk(flags, "flags"), "chunk", "left")

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, data, e = _chunk(row, width, bits)
                open_ = flags_of(row, e) == 2
                for b, x, y in e.buckets():
                    k = x + np.flatnonzero(open_[x:y])
                    if len(k):
                        place, windows = e.place[e.head[k]], e.windows[e.head[k]]
                        raw = b"".join(data[p : p + w + width - 1].tobytes() for p, w in zip(place, windows, strict=True))
                        parts = [len(k).to_bytes(8, "little"), (k - x).astype("<u4").tobytes(), (e.least[k] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), e.first_rank[k].astype("<u4").tobytes(), windows.astype("u1").tobytes(), raw]
                        yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": row["chunk"], "data": b"".join(parts)}], schema=schema)

    def search(batches):
        for bucket, rows in _by_key(batches, 0):
            entry, least, ids, pieces, counts, above = [], [], [], [], [], 0
            for r in rows:
                raw = r["data"]
                n = int.from_bytes(raw[:8], "little")
                entry.append(np.frombuffer(raw, "<u4", n, 8))
                least.append(np.frombuffer(raw, "<u4", n, 8 + 4 * n))
                ranks = np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64)
                ids.append(ranks + above)  # chunks come in the order of identifiers
                above += int(ranks.max()) + 1
                at = 8 + 13 * n
                for w in np.frombuffer(raw, "u1", n, 8 + 12 * n).tolist():
                    pieces.append(raw[at : at + w + width - 1])
                    at += w + width - 1
                counts.append(n)
            found = np.array(_searched(np.concatenate(least).astype(np.int64), np.concatenate(ids), pieces, width), np.uint64)
            at = np.cumsum([0, *counts])
            out = []
            for r, own, a, b in zip(rows, entry, at, at[1:], strict=False):
                hit = np.flatnonzero(found[a:b])
                if len(hit):
                    out.append({"bucket": bucket, "chunk": r["chunk"], "data": own[hit].astype("<u4").tobytes() + found[a:b][hit].astype("<u8").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    asked = flagged.mapInArrow(ask, blob).repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk")
    found = materialise(asked.mapInArrow(search, blob), "found")
    release(spark)
    both = chunks.join(per_chunk(flags, "flags").join(per_chunk(found, "found"), "chunk", "left"), "chunk", "left")
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, data, e = _chunk(row, width, bits)
                state = flags_of(row, e)
                bitmaps = np.zeros(len(e.least), np.uint64)
                held = {x["bucket"]: x["data"] for x in row["found"] or ()}
                for b, x, _ in e.buckets():
                    if b in held:
                        n = len(held[b]) // 12
                        bitmaps[x + np.frombuffer(held[b], "<u4", n).astype(np.int64)] = np.frombuffer(held[b], "<u8", n, 4 * n)
                change = np.zeros(len(data) + 1, np.int32)
                whole = np.flatnonzero((state[e.entry] == 1) | e.later)
                np.add.at(change, e.place[whole], 1)
                np.add.at(change, e.place[whole] + e.windows[whole] + width - 1, -1)
                some = np.flatnonzero((bitmaps[e.entry] != 0) & ~((state[e.entry] == 1) | e.later))
                spot, bitmap = e.place[some], bitmaps[e.entry[some]]
                for j in range(int(e.windows.max(initial=0))):
                    p = spot[(bitmap >> np.uint64(j)) & np.uint64(1) == 1] + j
                    np.add.at(change, p, 1)
                    np.add.at(change, p + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[at] = True
                first = np.flatnonzero(gone & (np.concatenate(([True], ~gone[:-1])) | edge[:-1])) if len(data) else np.empty(0, np.int64)
                last = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | edge[1:])) + 1 if len(data) else np.empty(0, np.int64)
                out = []
                for k, doc_id in enumerate(ids.tolist()):
                    a, b = int(at[k]), int(at[k + 1])
                    x, y = np.searchsorted(first, (a, b))
                    spans = [{"start": int(s) - a, "end": int(t) - a} for s, t in zip(first[x:y], last[x:y], strict=True)]
                    kept = data[a:b][~gone[a:b]].tobytes() if spans else data[a:b].tobytes()
                    out.append({"doc_id": None if row["none"][k] else doc_id, "n_bytes": b - a, "spans": spans, "kept": kept})
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return both.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
