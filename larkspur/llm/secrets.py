"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The patterns give base spans. The method adds spans of kind `markov`: tokens of key-like
characters, long enough and of letters and digits mixed, whose characters follow one another
rather as in random strings than as in ordinary identifiers. Two first-order Markov models
are counted from labelled samples (1: random, 0: ordinary); a token's score is the mean
log-likelihood ratio per transition. A markov span never overlaps a base span: tokens are
sought in the text with base spans blanked out, so what they leave of a token is judged stretch
by stretch, each as a token of its own.

Spans are code points, end exclusive. Only DataFrame functions are used. A scan reads each text
in place: no shuffle, no state. Places come from running sums over matches and texts are cut in
blocks of spans, so a text of many megabytes and many spans takes far less than the square of either.
Nulls: a null text is an empty one and has no spans; repeated rows are scanned alike; empty tables give
no rows; other columns pass through, but one that has the name of an added column is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, quoted, running, spare

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the Markov models judge.
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Mean log-likelihood ratio per transition above which a token counts as random.
THRESHOLD = 0.35
#: Rows of labelled samples of each class that the default models are trained on.
SAMPLES = 4000
FOUND = "array<struct<start:int,kind:int,end:int,token:string>>"
#: Transitions are counted between printable ASCII characters.
FIRST, WIDTH = 33, 94

# Words that ordinary identifiers are made of.
PARTS = (
    "get set user name id list item count value key data file path index table column row type info text line page node list "
    "create update delete read write open close start stop load save send fetch parse format check build make find search sort "
    "request response server client handler service manager config option context session buffer stream queue thread message "
    "error warning result status state event action time date year month number total price order product account customer "
    "header footer content image width height color default parent child left right first last next previous version license "
    "copyright documentation international organization development environment information application management"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """The default samples: n random strings in three alphabets (label 1), n identifiers of joined words (label 0)."""
    ids = spark.range(n, numPartitions=1)
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id")), 256))
    strong = F.base64(digest)
    mixed = F.regexp_replace(strong, "[+/=]", "x")
    lower = F.translate(F.lower(mixed), "ghij", "0189")
    random = F.when(F.col("id") % 3 == 0, strong).when(F.col("id") % 3 == 1, mixed).otherwise(lower)
    words = F.array(*[F.lit(w) for w in PARTS])
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(words, F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(PARTS))).cast("int")))
    snake, camel = F.array_join(parts, "_"), F.array_join(F.transform(parts, F.initcap), "")
    slug, plain = F.concat(F.array_join(parts, "-"), F.lit("/"), F.col("id") % 100), F.concat(F.array_join(parts, ""), F.col("id") % 1000)
    shape = F.col("id") % 4
    plainly = F.when(shape == 0, snake).when(shape == 1, camel).when(shape == 2, slug).otherwise(plain)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).union(ids.select(F.lit(0).alias("label"), plainly.alias("text")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, add-one smoothed. Only counts by pair of characters reach the driver."""
    chars = F.transform(F.split(F.coalesce("text", F.lit("")), ""), lambda c: F.ascii(c) - FIRST)
    held = samples.select("label", F.filter(chars, lambda c: (c >= 0) & (c < WIDTH)).alias("c"))
    pairs = F.zip_with(F.col("c"), F.expr("slice(c, 2, greatest(size(c) - 1, 0))"), lambda a, b: a * WIDTH + b)
    counted = held.select("label", F.explode(pairs).alias("pair")).filter("pair is not null").groupBy("label", "pair").count()
    counts = {1: [1.0] * WIDTH**2, 0: [1.0] * WIDTH**2}
    for label, pair, n in counted.collect():
        counts[label][pair] += n
    out = []
    for a in range(WIDTH):
        one, zero = (counts[k][a * WIDTH : (a + 1) * WIDTH] for k in (1, 0))
        out += [round(math.log(x / sum(one)) - math.log(y / sum(zero)), 3) for x, y in zip(one, zero, strict=True)]
    return out


def matches(text: Column, pattern: str, kind: int, keep=lambda found: F.lit(True)) -> Column:
    """start, kind, end and token of the leftmost non-overlapping matches that `keep` accepts.

    Spark gives matches and the texts between them; places follow from their lengths.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))

    def placed(held: Column) -> Column:
        ends = running(F.transform(held, lambda x: x["gap"] + F.length(x["found"])), lambda a, b: a + b, F.lit(0))
        place = lambda end, x: F.struct((end - F.length(x["found"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("token"))
        return F.filter(F.zip_with(ends, held, place), lambda x: keep(x["token"]))

    found = let(F.filter(pairs, lambda x: x["found"].isNotNull()), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(FOUND))


def plain(found: Column) -> Column:
    """Matches without their tokens."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then kind."""
    long_enough = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= 6
    return F.sort_array(plain(F.concat(matches(text, ASSIGN, 0, long_enough), matches(text, ACCESS, 1), matches(text, HEX, 2))))


def replaced(text: Column, spans: Column, put) -> Column:
    """text with what spans cover replaced: put(x) stands for a span from x.start to x.end, where spans before it end at x.before.

    Spans are cut out in blocks of the square root of their number: first a block's text, then the spans inside it.
    """

    def block(items: Column, first: Column, count: Column) -> Column:
        own = F.slice(items, first, count)
        low = lambda part: part[0]["before"]
        cut = lambda part: F.substring(text, low(part) + 1, F.element_at(part, -1)["end"] - low(part))
        gap = lambda part, held, x: F.substring(held, x["before"] - low(part) + 1, F.greatest(x["start"] - x["before"], F.lit(0)))
        return let(own, lambda part: let(cut(part), lambda held: F.array_join(F.transform(part, lambda x: F.concat(gap(part, held, x), put(x))), "")))

    def joined(items: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(items))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(items), step), lambda at: block(items, at, step))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(items, -1)["end"] + 1, F.lit(2**31 - 1)))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    items = let(ends, lambda e: F.transform(spans, lambda s, k: F.struct(F.when(k == 0, 0).otherwise(F.get(e, k - 1)).alias("before"), s["start"].alias("start"), F.get(e, k).alias("end"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(items, joined))


def blanked(text: Column, spans: Column) -> Column:
    """text with a space for each character that spans cover, so places stay."""
    return replaced(text, spans, lambda x: F.repeat(F.lit(" "), x["end"] - F.greatest(x["start"], x["before"])))


def randomness(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    pair = F.zip_with(codes, F.slice(codes, 2, 2**30), lambda a, b: F.get(table, a * WIDTH + b))
    total = F.aggregate(pair, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD, into: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """Add two columns: spans of the patterns, and those with the markov ones; both by start, then kind."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))

    def markov(t: Column) -> Column:
        random = lambda token: token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (randomness(token, ratios) > threshold)
        return plain(matches(t, CANDIDATE, 3, random))

    held = let(text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, let(blanked(t, b), markov))).alias("spans"))))
    (own,) = spare(docs, "scan")
    return docs.withColumn(own, held).withColumns({into[0]: F.col(f"{own}.base"), into[1]: F.col(f"{own}.spans")}).drop(own)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with every stretch that spans cover replaced by a mark; overlapping spans are one stretch."""
    return replaced(text, spans, lambda x: F.when(x["start"] >= x["before"], F.lit(mark)).otherwise(""))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
