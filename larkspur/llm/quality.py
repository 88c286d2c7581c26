"""Quality rules of documents and their hosts.

Each document is measured, and fails or passes five rules: few words, many repeated words, many symbols,
many repeated lines, and words of odd length. The first two are the base rules. Failures are
summed by host and rule. A rule has a beta prior of hosts' rates, fitted to all hosts (method of
moments), towards which each host's rate is shrunk, so a host with few documents stays near the common
rate. A host is rejected, with all its documents, if a shrunk rate is above the rule's limit: the prior's
mean plus DEVIATIONS standard deviations, and never less than halfway from that mean to 1.

Nulls: a null text has no words and fails; a document with a null host gets no host's verdict.
Repeated rows count as documents; empty tables give no rows; a text of any length is measured whole.
Other columns pass through, but one that has the name of an added column is replaced by it. Measures are made
in one pass without shuffle; hosts are summed before they are shuffled, and verdicts joined back by host.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import materialise, quoted, spare
from larkspur.llm.words import runs, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
#: Rules that sum up hosts beside the base ones: symbols per 100 words, repeated per 100 lines, mean letters of a word.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTH = 10, 30, (3, 10)
#: Standard deviations of a rule's prior beyond which a host is rejected.
DEVIATIONS = 4
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
ADDED = (*MEASURES, "base_failed", "host_rejected", "kept")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def repeated_words(t) -> np.ndarray:
    """Per text, words in windows of WINDOW words that it holds twice or more."""
    hashes, first = window_hashes(t, word_hashes(t), WINDOW)
    order = np.lexsort((hashes, t.doc[first]))
    h, d = hashes[order], t.doc[first][order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    hit = first[order[same[1:] | same[:-1]]]
    change = np.zeros(len(t.doc) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    return _sums(np.cumsum(change[:-1]) > 0, t.words_at)


def lines_of(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of each text to the other columns of docs; the text itself is dropped."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c != text_col and c.lower() not in ADDED]
    (own,) = spare(docs, "text")
    rows = docs.select(*map(quoted, kept), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias(own))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def measure(batches):
        for batch in batches:
            for t in runs(batch.column(len(kept))):
                inside = np.zeros(len(t.data) + 1, np.int8)
                inside[t.starts] = 1
                inside[t.ends] -= 1
                chars = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((t.data & 0xC0) != 0x80)
                lines = [lines_of(t.raw(k)) for k in range(len(t))]
                out = (np.diff(t.words_at), _sums(chars, t.at), _sums(symbol[t.data], t.at), [x for x, _ in lines], repeated_words(t), [x for _, x in lines])
                held = batch.slice(t.first, len(t)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(x, pa.int64()) for x in out)], names=[*kept, *MEASURES])

    fields = [f for f in rows.schema if f.name != own]
    schema = T.StructType([*fields, *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(measure, schema)  # by place: names may hold dots


def rules() -> dict[str, Column]:
    """Every rule by name; true where the document fails."""
    words = F.col("n_words")
    return {
        "few_words": words < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * words, "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * words,
        "lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"), "length": (F.col("word_chars") < WORD_LENGTH[0] * words) | (F.col("word_chars") > WORD_LENGTH[1] * words),
    }


def base_failed() -> Column:
    own = rules()
    return own["few_words"] | own["repeats"]


def prior(mean: float, var: float) -> tuple[float, float, float]:
    """alpha and beta of a beta distribution with these moments, and the limit of shrunk rates.

    With no spread between hosts the prior is as strong as a hundred documents.
    """
    strength = mean * (1 - mean) / var - 1 if var > 0 else 100.0
    strength = min(max(strength, 1.0), 1e6)
    alpha, beta = max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)
    middle, spread = alpha / (alpha + beta), (alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1))) ** 0.5
    return alpha, beta, max(middle + DEVIATIONS * spread, (1 + middle) / 2)


def host_verdicts(rows: DataFrame, host_col: str, failed: dict[str, Column]) -> DataFrame:
    """Per host: documents, and by rule failures and shrunk rate; and whether it is rejected. Only two moments of each rule reach the driver."""
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"failures_{r}") for r, c in failed.items()]
    hosts = rows.filter(quoted(host_col).isNotNull()).groupBy(quoted(host_col).alias("host")).agg(F.count(F.lit(1)).alias("documents"), *sums)
    rate = lambda r: F.col(f"failures_{r}") / F.col("documents")
    moments = hosts.agg(*[x for r in failed for x in (F.avg(rate(r)).alias(f"mean_{r}"), F.var_samp(rate(r)).alias(f"var_{r}"))]).first()
    rejected = F.lit(False)
    for r in failed:
        alpha, beta, limit = prior(moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"failures_{r}") + alpha) / (F.col("documents") + alpha + beta))
        rejected = rejected | (F.col(f"rate_{r}") > limit)
    return hosts.withColumn("rejected", rejected)


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Add measures, base_failed, host_rejected and kept to docs (without the text)."""
    rows = materialise(measured(docs, text_col).withColumn("base_failed", base_failed()), "quality")
    host, flag = spare(rows, "host", "rejected")
    verdicts = materialise(host_verdicts(rows, host_col, rules()).select(F.col("host").alias(host), F.col("rejected").alias(flag)), "hosts")
    joined = rows.join(verdicts, rows[f"`{host_col}`"] == verdicts[host], "left").withColumn("host_rejected", F.coalesce(flag, F.lit(False))).drop(host, flag)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judged(docs).select("doc_id", *MEASURES[:5], "base_failed", "kept", "n_lines", "host_rejected")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM windows) WHERE n > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM often) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n, count(*) AS every FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, coalesce(lines.every, 0) AS n_lines
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN hit USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
e AS (SELECT source, unnest(['few_words', 'repeats', 'symbols', 'lines', 'length']) AS rule, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 10 * n_words,
    100 * n_dup_lines > 30 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed FROM f WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM e GROUP BY source, rule),
p AS (SELECT rule, coalesce(avg(k / n), 0) AS mean, coalesce(var_samp(k / n), 0) AS var FROM h GROUP BY rule),
q AS (SELECT rule, mean, least(greatest(CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 ELSE 100 END, 1), 1e6) AS strength FROM p),
ab AS (SELECT rule, greatest(mean * strength, 1e-3) AS a, greatest((1 - mean) * strength, 1e-3) AS b FROM q),
lim AS (SELECT rule, a, b, greatest(a / (a + b) + 4 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), (1 + a / (a + b)) / 2) AS most FROM ab),
v AS (SELECT source, bool_or((k + a) / (n + a + b) > most) AS rejected FROM h JOIN lim USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept, n_lines, coalesce(rejected, false) AS host_rejected
FROM f LEFT JOIN v USING (source)
"""
