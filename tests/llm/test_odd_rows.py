"""Every operator's query and the pipeline on awkward tables: clashing columns, nulls, repeated rows, very long texts, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n in QUERIES if n != "op2_chat_formatting")  # its own tests are in test_chat
#: Names that operators might use inside, or add.
CLASHES = (
    "_text", "h", "_n", "_k", "_score", "score", "spans", "base", "scan", "offset", "sequence_id", "range", "guard", "key", "n_words", "kept", "host", "rejected", "rid", "row", "size", "place", "shard", "position",
    "cid", "node", "root", "band", "component_id", "k", "t", "none", "chunk", "words", "hash", "number", "first", "first_text", "hash_", "fp", "parts", "at", "X", "Text_",
)


def written(spark, path, frame, labels):
    frame.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with plain columns, one with clashing columns too (same rows), and one without rows."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = [(None, None, "en", None, None), (None, "only text", None, "src1", 9), (3, None, "en", "src2", None), (10**6, "", "fr", "src2", 0), (10**6 + 1, "twice", "de", "src3", 5), (10**6 + 1, "twice", "de", "src3", 5), (10**6 + 2, " \t\n", "de", None, 3)]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    clash = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    paths = [tmp_path_factory.mktemp(x) for x in ("plain", "clash", "none")]
    return [written(spark, p, f, labels if f is not None else labels) for p, f in zip(paths[:2], (plain, clash), strict=True)] + [written(spark, paths[2], plain.limit(0), labels.limit(0))]


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_with_clashing_columns(spark, tables, name):
    plain, clash, none = tables
    want, got = (QUERIES[name](spark, p) for p in (plain, clash))
    assert want.columns == got.columns
    drop = {"op4_source_mixing": ("taken",)}.get(name, ())  # which of two equal rows a mix takes is open
    want, got = rows_of(want.drop(*drop)), rows_of(got.drop(*drop))
    if name == "op5_best_fit_packing":  # where a piece lies is open
        want, got = ([r[:5] for r in x] for x in (want, got))
    assert got == want and len(got) >= 207
    assert rows_of(QUERIES[name](spark, none)) == []


def test_pipeline_with_clashing_columns(spark, tables):
    plain, clash, none = tables
    docs = spark.read.parquet(f"{clash}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, clash)
        assert docs.columns == columns
        held = docs.collect()
        assert held and all(r[c] == f"own {c}" for r in held for c in CLASHES)
        docs = spark.createDataFrame(held, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, clash)
    assert packed.count() >= len(held)
    whole = corpus_pipeline.run(spark, plain)
    assert whole.columns == packed.columns and whole.count() > 100
    assert corpus_pipeline.run(spark, none).collect() == []


def test_pipeline_keeps_one_of_repeated_rows_and_all_without_words(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, tables[0]).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(10**6 + 1) == 1 and ids.count(None) == 2 and ids.count(10**6) == 1
    masked = corpus_pipeline.mask_secrets(spark, docs, tables[0]).collect()
    assert sum(r["text"] is None for r in masked) == 2 and len(masked) == docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_query_with_a_very_long_text(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    words = np.array([f"wort{k}é" for k in range(5000)])
    long = " ".join(words[rng.integers(0, 5000, 500_000)]) + " token=abcdefghij " + "0123456789abcdef" * 3
    rows = [(1, long, "en", "a", len(long)), (2, "short one", "en", "b", 9), (3, long[: len(long) // 2] + " end", "en", "b", 0)]
    path = written(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in QUERIES[name](spark, path).orderBy("doc_id").collect()}
    assert set(out) == {1, 2, 3} and len(long.encode()) > 5_000_000
    checks = {
        "op3": lambda r: r["n_assign"] == 1 and r["n_hex"] == 1 and r["spans"].endswith(f":{len(long)}"), "op4": lambda r: r["size"] == 500_002, "op7": lambda r: r["n_chars"] == len(long) and len(r["fingerprint"]) == 512,
        "op8": lambda r: r["n_bytes"] == len(long.encode()) and r["n_removed"] == 0 and out[3]["n_removed"] > 2_500_000, "op9": lambda r: r["n_words"] == 500_002, "op10": lambda r: r["n_shingles"] == 499_998 and r["kept"],
        "op6": lambda r: 0 <= r["score"] <= 1, "op1": lambda r: r["n_tokens"] > 500_000, "op5": lambda r: r["length"] <= 4096,
    }
    assert checks[name.split("_")[0]](out[1])
