"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, grouping.

Documents with equal shingle sets are one class. Each class gets a SuperMinHash signature: every
element draws ranks along a random permutation of the places, so places share no rank, which
lowers the variance, and drawing stops once no further rank can lower a place. Classes that share
a band are candidates if their sizes allow the similarity and their sketches don't rule it out; each
bucket sends a forest of its candidates, which are then grouped. A bucket of more than BUCKET classes is
searched by pairs of blocks, each a task of its own.

Links are confirmed on full sets, read again from the texts. In a group of up to BLOCK classes every
pair is verified in one task by exact counts of common elements. In a larger one the forest's links are verified
first; only what they leave apart is then compared block against block, so a large group of copies costs about
as many comparisons as it has classes. Every task sends a forest of its links: none is lost, and a group of copies
never becomes rows of all its pairs. Links are grouped by union-find inside tasks and by alternating stars
across them; a star's hub is dealt over many tasks.

Nulls: a null text, or one without words, has an empty set and is linked with nothing; a null
identifier is kept and linked with nothing. Rows that repeat an identifier are judged by their
own texts. Ties need no rule: the least identifier names the group. Empty tables give no rows. A very
long text is one set, held by one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, materialise, quoted, release, spare
from larkspur.llm.words import mixed, runs, shingle_sets

SHINGLE = 5
#: Elements whose permutations are held at once.
ELEMENTS_AT_ONCE = 100_000
#: Classes of a group that are verified in one task (and of each block of larger ones), and shared elements counted at once.
BLOCK, COLUMNS = 2048, 2048
#: Classes of a bucket that are searched in one task (and of each block of larger ones): 28 bytes each.
BUCKET = 250_000
#: Edges that a task joins by union-find.
EDGES = 16_384
#: Places of a signature at most (a sketch has so many bits), and how many pairs at the limit may share no band.
MOST_PLACES, MISSED = 128, 1e-6


def bands_for(percent: int) -> tuple[int, int]:
    """Rows of a band and bands: the longest bands by which pairs at the limit are missed less than once in a million."""
    s = percent / 100
    fits = []
    for rows in range(1, MOST_PLACES + 1):
        bands = 1 if s >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(s**rows)))
        if rows * bands <= MOST_PLACES:
            fits.append((rows, bands))
    if not fits:
        raise ValueError(f"{percent} % is too low: {MOST_PLACES} places can't find nearly all such pairs")
    return fits[-1]


def superminhash(hashes: np.ndarray, at: np.ndarray, places: int) -> np.ndarray:
    """Signatures of sets: hashes[at[k]:at[k+1]] is set k. A value is the rank (high 8 bits) and a fraction (24 bits)."""
    sets = len(at) - 1
    out = np.full(sets * places, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(sets), np.diff(at))
    live, x, base = np.arange(len(hashes)), hashes, owner * places
    order = None
    for level in range(places):
        if not len(live):
            break
        draw = mixed(x + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
        spot = level + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(places - level)).astype(np.int64)
        value = (draw >> np.uint64(40)).astype(np.uint32) | np.uint32(level << 24)
        if level == 0:
            place = spot
        else:
            rows = np.arange(len(live))
            if order is None:  # the permutations after their first step
                order = np.tile(np.arange(places, dtype=np.uint8), (len(live), 1))
                order[rows, first_spot[live]] = 0
                order[:, 0] = first_spot[live]
            place = order[rows, spot].astype(np.int64)
            order[rows, spot] = order[:, level]
            order[:, level] = place
        np.minimum.at(out, base + place, value)
        if level == 0:
            first_spot = spot
        open_sets = out.reshape(sets, places).max(1) >= (level + 1) << 24
        on = open_sets[owner[live]]
        if not on.all():
            live, x, base = live[on], x[on], base[on]
            if order is not None:
                order = order[on]
    return out.reshape(sets, places)


def _set_runs(t):
    """Shingle sets of some texts, at most ELEMENTS_AT_ONCE elements (or one set) at a time: (first text, hashes, at)."""
    hashes, at = shingle_sets(t, SHINGLE)
    k = 0
    while k < len(t):
        stop = min(len(t), max(k + 1, int(np.searchsorted(at, at[k] + ELEMENTS_AT_ONCE, "right")) - 1))
        yield k, hashes[at[k] : at[stop]], at[k : stop + 1] - at[k]
        k = stop


def _set_sums(hashes: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each set, the same in any order."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)))))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


SET_SALT, CHECK_SALT = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179


def signed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, h (hash of the text), n (distinct shingles), node and node2 (names of the set), band keys and a 128-bit sketch."""
    import pyarrow as pa

    rows_in_band, bands = bands_for(percent)
    places = rows_in_band * bands
    factors = (np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)).reshape(bands, rows_in_band)
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["doc_id", "h", "n", "node", "node2", "bands", "k1", "k2"]

    def sign(batches):
        for batch in batches:
            for t in runs(batch.column(2)):
                for first, hashes, at in _set_runs(t):
                    sig = superminhash(hashes, at, places)
                    keys = mixed((sig.reshape(-1, bands, rows_in_band).astype(np.uint64) * factors).sum(2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    bits = np.zeros((len(sig), 128), np.uint8)
                    bits[:, :places] = sig & 1
                    sketch = np.packbits(bits, axis=1).view(np.int64)
                    size = np.diff(at)
                    own = [batch.column(k).slice(t.first + first, len(size)) for k in (0, 1)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                    columns = [*own, size, _set_sums(hashes, at, SET_SALT), _set_sums(hashes, at, CHECK_SALT), lists, sketch[:, 0], sketch[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, types, strict=True)], names=names)

    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, h long, n long, node long, node2 long, bands array<long>, k1 long, k2 long")


def _most_differing(percent: int) -> int:
    """Sketch bits in which a pair at the limit differs at most: seven standard deviations above the mean."""
    places = math.prod(bands_for(percent))
    p = (1 - percent / 100) / 2
    return int(places * p + 7 * (places * p * (1 - p)) ** 0.5) + 1


def _forest(node, n, k1, k2, percent: int) -> list[tuple[int, int]]:
    """Of classes in one bucket, a forest that joins all that may be similar, from class to class: each one
    found is compared, by size and sketch, with all that are not yet reached."""
    most = _most_differing(percent)
    out, left = [], np.arange(len(node))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            differ = np.bitwise_count(k1[left] ^ k1[x]) + np.bitwise_count(k2[left] ^ k2[x]).astype(np.int64)
            near = (differ <= most) & (100 * np.minimum(n[left], n[x]) >= percent * np.maximum(n[left], n[x]))
            found, left = left[near], left[~near]
            out += [(node[x], node[y]) for y in found]
            todo += found.tolist()
    return out


def _buckets(batches, most: int):
    """(key, number, columns) of each run of equal first columns, from batches sorted by it; a run goes on as
    further numbers after every `most` rows. Columns are without the first, as NumPy arrays."""
    key, number, parts, size = None, 0, [], 0

    def joined():
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        first, *rest = [c.to_numpy() for c in batch.columns]
        if not len(first):
            continue
        edges = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        for a, b in zip(edges, edges[1:], strict=False):
            if parts and first[a] != key:
                yield key, number, joined()
                parts, size, number = [], 0, 0
            key = first[a]
            while a < b:
                if size == most:
                    yield key, number, joined()
                    parts, size, number = [], 0, number + 1
                end = min(b, a + most - size)
                parts.append([c[a:end] for c in rest])
                size, a = size + end - a, end
    if parts:
        yield key, number, joined()


def candidate_links(classes: DataFrame, percent: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): for every bucket, a forest that joins all its classes that may be similar to one another.

    Buckets of up to `bucket` classes are searched where they meet. The rows of larger ones are sent on, numbered by blocks,
    and every pair of blocks is searched by a task. A search sends fewer rows than it has classes, never its pairs.
    """
    import pyarrow as pa

    names = ["a", "b", "band", "block", "n", "k1", "k2"]
    rows = classes.select(F.explode("bands").alias("band"), F.col("cid").alias("a"), "n", "k1", "k2").repartition("band").sortWithinPartitions("band", "a")

    def sent(a, b, *rest):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(x if x is not None else [None] * n, pa.int64()) for x in (a, b, *rest)], names=names)

    def search(batches):
        out: list[tuple[int, int]] = []
        held = None  # the first block of a bucket, until it is known whether there is another
        for key, number, columns in _buckets(batches, bucket):
            if held is not None:
                if number:
                    a, n, k1, k2 = held[1]
                    yield sent(a, None, np.full(len(a), held[0]), np.zeros(len(a), np.int64), n, k1, k2)
                elif len(held[1][0]) > 1:
                    out += found(held[1])
                held = None
            if number:
                a, n, k1, k2 = columns
                yield sent(a, None, np.full(len(a), key), np.full(len(a), number), n, k1, k2)
            else:
                held = (key, columns)
            if len(out) > 100_000:
                yield sent([x for x, _ in out], [y for _, y in out], *[None] * 5)
                out = []
        if held is not None and len(held[1][0]) > 1:
            out += found(held[1])
        if out:
            yield sent([x for x, _ in out], [y for _, y in out], *[None] * 5)

    def found(columns):
        a, n, k1, k2 = columns
        return _forest(a, n, k1.view(np.uint64), k2.view(np.uint64), percent)

    raw = materialise(rows.mapInArrow(search, ", ".join(f"{c} long" for c in names)), "candidates-by-bucket")
    links = raw.filter("b is not null").select("a", "b")
    large = raw.filter("b is null")
    if large.limit(1).count():
        blocks = large.groupBy("band").agg((F.max("block") + 1).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        dealt = large.join(blocks, "band").select("band", "a", "n", "k1", "k2", "block", other)
        key = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
        dealt = dealt.select(key.alias("key"), "a", "n", "k1", "k2").repartition("key").sortWithinPartitions("key", "a")

        def between(batches):
            for _, _, columns in _buckets(batches, 2 * bucket + 1):
                out = found(columns)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        links = links.union(dealt.mapInArrow(between, "a long, b long"))
    out = materialise(links.distinct(), "candidates")
    discard(raw)
    return out


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest that joins all sets that are similar, by the exact sizes of all intersections."""
    size = np.array([len(x) for x in sets])
    n = len(sets)
    common = np.zeros((n, n), np.float32)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                common[i, j] = common[j, i] = (both[1:] == both[:-1]).sum()
    else:
        _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        owner = np.repeat(np.arange(n), size)
        on = count[element] > 1
        owner, element = owner[on], shared[element[on]]
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        for low in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
            a, b = np.searchsorted(element, (low, low + COLUMNS))
            held = np.zeros((n, COLUMNS), np.float32)
            held[owner[a:b], element[a:b] - low] = 1
            common += held @ held.T
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    out, left = [], np.ones(n, bool)
    for k in range(n):
        if not left[k]:
            continue
        left[k], todo = False, [k]
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & left)
            left[found] = False
            out += [(x, y) for y in found.tolist()]
            todo += found.tolist()
    return out


def with_group(rows: DataFrame, key: str, by: str, first: Column, last, into: str, salts: int) -> DataFrame:
    """Add last(first) of all rows of a key to each of them. A key's rows are dealt over `salts` tasks by the
    column `by`, and first is made per deal, so neither the aggregate nor the join meets a hot key in one task."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    part = dealt.groupBy(key, "_salt").agg(first.alias("_part"))
    whole = part.groupBy(key).agg(last(F.col("_part")).alias(into))
    return dealt.join(part.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


def sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, set) of classes (cid, node, node2, doc), read from the texts of their documents."""
    import pyarrow as pa

    texts = docs.select(quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("node", "node2", "cid")).alias("asked"))
    both = texts.hint("merge").join(asked.hint("merge"), "doc").select("asked", "text")

    def read(batches):
        for batch in batches:
            asked = [{(x["node"], x["node2"]): x["cid"] for x in row} for row in batch.column(0).to_pylist()]
            for t in runs(batch.column(1)):
                hashes, at = shingle_sets(t, SHINGLE)
                names = zip(_set_sums(hashes, at, SET_SALT).tolist(), _set_sums(hashes, at, CHECK_SALT).tolist(), strict=True)
                hit = [(asked[t.first + k][own], k) for k, own in enumerate(names) if own in asked[t.first + k]]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in hit], pa.int64()), pa.array([hashes[at[k] : at[k + 1]].tobytes() for _, k in hit], pa.binary())], names=["cid", "set"])

    # Rows that repeat an identifier and its text repeat the set.
    return both.mapInArrow(read, "cid long, set binary")


def _compared(keyed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): of the classes (key, cid, set) of each key, a forest of the similar ones."""
    import pyarrow as pa

    def compare(batches):
        key, names, held = None, [], []

        def found():
            out = [(names[i], names[j]) for i, j in linked(held, percent)] if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            for own, cid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    yield found()
                    key, names, held = own, [], []
                if not names or names[-1] != cid:
                    names.append(cid)
                    held.append(np.frombuffer(raw, np.uint64))
        yield found()

    return keyed.select("key", "cid", "set").repartition("key").sortWithinPartitions("key", "cid").mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    import pyarrow as pa

    one = sets.select(F.col("cid").alias("a"), F.col("set").alias("x"))
    other = sets.select(F.col("cid").alias("b"), F.col("set").alias("y"))
    both = pairs.hint("merge").join(one.hint("merge"), "a").hint("merge").join(other.hint("merge"), "b").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def verified(groups: DataFrame, candidates: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, salts: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) inside groups (cid, root, node, node2, doc): a forest of each group's similar sets, read from the texts again."""
    groups = materialise(with_group(groups, "root", "cid", F.count(F.lit(1)), F.sum, "size", salts).filter("size > 1"), "groups")
    sets = materialise(sets_of(groups, docs, id_col, text_col), "sets")
    small = groups.filter(F.col("size") <= block).select("cid", F.col("root").alias("key"))
    links = _compared(sets.hint("merge").join(small.hint("merge"), "cid"), percent)
    large = groups.filter(F.col("size") > block).select("cid", "root")
    if large.limit(1).count():
        sets = materialise(sets.dropDuplicates(["cid"]), "distinct-sets")
        pairs = candidates.join(large.select(F.col("cid").alias("a")).hint("merge"), "a")
        sure = materialise(_confirmed(pairs, sets, percent), "confirmed")
        apart = large.join(components(sure).select(F.col("node").alias("cid"), F.col("root").alias("label")), "cid", "left").select("cid", "root", F.coalesce("label", "cid").alias("label"))
        apart = with_group(apart, "root", "cid", F.min("label"), F.min, "least", salts)
        apart = with_group(apart, "root", "cid", F.max("label"), F.max, "most", salts).filter("least < most").select("cid", "root", "label")
        # Labels of many classes have blocks of their own, which need no comparison with one another; the others share pool -1.
        apart = with_group(apart, "label", "cid", F.count(F.lit(1)), F.sum, "size", salts)
        pool = F.when(F.col("size") > block // 2, F.col("label")).otherwise(-1)
        apart = apart.select("cid", F.struct("root", pool.alias("pool")).alias("part"))
        apart = with_group(apart, "part", "cid", F.count(F.lit(1)), F.sum, "size", salts)
        number = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / block).cast("long"))
        apart = materialise(apart.select("cid", "part.root", "part.pool", number.alias("number")), "apart")
        blocks = apart.select("root", "pool", "number").distinct()
        other = blocks.select(F.col("root").alias("other_root"), F.col("pool").alias("other_pool"), F.col("number").alias("other"))
        meet = (F.col("root") == F.col("other_root")) & ((F.col("pool") == -1) | (F.col("pool") != F.col("other_pool")))
        one, two = F.struct("pool", "number"), F.struct(F.col("other_pool").alias("pool"), F.col("other").alias("number"))
        meets = blocks.join(other, meet).select("root", "pool", "number", F.xxhash64("root", F.least(one, two), F.greatest(one, two)).alias("key"))
        keyed = apart.hint("merge").join(meets, ["root", "pool", "number"]).select("cid", "key")
        links = links.union(sure).union(_compared(sets.hint("merge").join(keyed.hint("merge"), "cid"), percent))
    return links


def _joined_locally(batches):
    """Union-find over one task's edges (a, b): a forest of stars in place of them, a above b."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    own = [(x, find(x)) for x in list(parent)]
    own = [(x, r) for x, r in own if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) of a stored table: alternating large and small stars until nothing changes.

    Before and between stars, every task joins its EDGES edges by union-find. Edges lead from the greater node to the lesser. `least` is each greater node's least neighbour, made by a
    partial aggregate and stored, so that Spark sends it to all tasks where it is small, and else splits
    the rows of a hub, as of any skewed key, over tasks.
    """

    tasks = max(1, -(-edges.count() // EDGES))

    def least(links: DataFrame) -> DataFrame:
        return materialise(links.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).coalesce(tasks), "least")

    forest = lambda links: materialise(links.distinct().coalesce(tasks).mapInArrow(_joined_locally, "a long, b long"), "links", drop=(held,))
    links = materialise(edges.select("a", "b").coalesce(tasks).mapInArrow(_joined_locally, "a long, b long"), "links")
    mark = None
    while True:
        held, low = links, least(links)
        # Large star: a greater neighbour of b goes to b's least neighbour, or stays with b.
        links = forest(links.join(low, F.col("b") == F.col("of"), "left").select("a", F.coalesce("m", "b").alias("b")))
        discard(low)
        held, low = links, least(links)
        # Small star: a and its lesser neighbours go to the least of them.
        both = links.join(low, F.col("a") == F.col("of")).select("a", "b", "m")
        links = forest(both.select("a", F.col("m").alias("b")).union(both.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        discard(low)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept and root of every row of docs; rows are linked from percent/100 Jaccard similarity on.

    root names the row's group, also where groups share their least identifier; of a row without words or identifier it is h.
    block and bucket: classes that one task compares at most, by sets and by sketches. Other columns of docs are not read.
    """
    rows = materialise(signed(docs, percent, id_col, text_col), "signatures")
    one = F.min_by(F.struct("doc_id", "n", "bands", "k1", "k2"), "doc_id")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("node", "node2").agg(one.alias("x"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "node", "node2", "x.*"), "classes")
    salts = max(1, round(classes.count() ** 0.5))
    about = classes.select("cid", "node", "node2", F.col("doc_id").alias("doc"))
    candidates = candidate_links(classes, percent, bucket)
    groups = components(candidates).withColumnRenamed("node", "cid").join(about, "cid")
    links = materialise(verified(groups, candidates, docs, percent, id_col, text_col, salts, block), "edges", drop=(candidates,))
    release(docs.sparkSession)
    roots = components(links)

    named = roots.withColumnRenamed("node", "cid").join(about.select("cid", "doc"), "cid")
    named = with_group(named, "root", "cid", F.min("doc"), F.min, "component_id", salts).select("cid", "root", "component_id")
    final = classes.select("cid", "node", "node2", F.col("doc_id").alias("first_id")).join(named, "cid", "left").select("node", "node2", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "cid").alias("root"))
    out = rows.select("doc_id", "h", "n", "node", "node2").join(final, ["node", "node2"], "left")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id"))
    root = F.when(linkable, F.col("root")).otherwise(F.col("h"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), root.alias("root"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near-duplicates; of rows that repeat identifier and text, one. Columns are those of docs."""
    judged = near_duplicates(docs, percent, id_col, text_col).filter("kept")
    none = docs.filter(quoted(id_col).isNull())
    stay = judged.filter("doc_id is not null").groupBy("doc_id", "root", F.col("n_shingles") > 0).agg(F.min("h").alias("h")).select("doc_id", "h").distinct()
    own, number, first, text = spare(docs, "hash", "number", "first", "first_text")
    stay = stay.toDF(first, text)
    keyed = docs.filter(quoted(id_col).isNotNull()).withColumn(own, F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))
    keyed = keyed.withColumn(number, F.row_number().over(Window.partitionBy(quoted(id_col), own).orderBy(F.lit(1)))).filter(F.col(number) == 1)
    return keyed.join(stay.hint("merge"), (quoted(id_col) == F.col(first)) & (F.col(own) == F.col(text)), "left_semi").select(*map(quoted, docs.columns)).union(none)


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85).drop("h", "root")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept FROM d JOIN k ON k.a = d.doc_id LEFT JOIN n USING (doc_id)
"""
