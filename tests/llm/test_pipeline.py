"""The pipeline against plain versions of its decisions, stage by stage."""

import collections
import re

import pytest

import corpus_pipeline
from larkspur.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    path, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out.append(("documents", docs.columns, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        made.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append((name, made.columns, docs.collect()))
    return out


def test_columns_stay(stages):
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = set()
    for r in stages[0][2]:
        if toxicity._logistic(model.logit(set(toxicity.WORDS.findall((r["text"] or "").lower())))) < toxicity.THRESHOLD:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in stages[1][2]} == want and len(want) > 0.8 * len(stages[0][2])


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], shingles(r["text"])) for r in stages[1][2]]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    assert {r["doc_id"] for r in stages[2][2]} == {find(i) for i, _ in rows}


def test_secrets_are_masked_and_all_stay(stages):
    before, after = ({r["doc_id"]: r for r in stages[k][2]} for k in (2, 3))
    assert before.keys() == after.keys()
    secret = re.compile(r"""AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
    changed = 0
    for i, r in after.items():
        assert not secret.search(r["text"] or "")
        changed += r["text"] != before[i]["text"]
        if r["text"] is not None:
            assert r["text"] == before[i]["text"] or "<secret>" in r["text"]
            assert r["n_chars"] == len(r["text"]) or r["text"] == before[i]["text"]
    assert changed == sum(bool(secret.search(r["text"] or "") or re.search(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6,}""", r["text"] or "")) for r in before.values())


def test_mix_uses_whole_documents_and_blocks(stages):
    before = {r["doc_id"]: r for r in stages[3][2]}
    used = collections.Counter()
    for r in stages[4][2]:
        own = WORD.findall(before[r["doc_id"]]["text"])
        words = WORD.findall(r["text"])
        used[r["doc_id"]] += len(words)
        assert r["text"] == before[r["doc_id"]]["text"] or collections.Counter(words) <= collections.Counter(own)
        assert r["source"] == before[r["doc_id"]]["source"]
    assert all(n <= 3 * len(WORD.findall(before[i]["text"])) for i, n in used.items())


def test_sequences_are_full_and_gapless(stages):
    bins = collections.defaultdict(list)
    for r in stages[5][2]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert collections.Counter(r["doc_id"] for r in stages[5][2] if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in stages[4][2])
