"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

import re

import pytest

import corpus_pipeline
from cellframe.llm import decontaminate, queries, secrets
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, note


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_no_cross_join(spark):
    for name in ("op1_lookup_sketch", "op2_line_hashing", "op4_string_tiling", "op7_merkle_audit", "op8_near_duplicates", "op11_run_index", "op12_time_forward_manifest", "op13_prefix_slots"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pipeline_stages_follow_their_rules(spark):
    """Each stage on all rows that the one before kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    table, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.cut(stage(spark, table, sf))
        kept[name] = {r.doc_id: r for r in table.collect()}
        if name != "tokens":
            assert table.columns == docs.columns
    everything = {r.doc_id: r.text for r in docs.collect()}
    assert sum(labels[d] for d in kept["quality"] if d in labels) >= 0.98 * sum(labels.values())
    assert sum(1 - labels[d] for d in kept["quality"] if d in labels) <= 0.05 * sum(1 - q for q in labels.values())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(everything[d]) for d in kept["quality"]}
    alone = {d: sets[d] for d in kept["near_duplicates"]}
    by_gram = {}
    for d, s in alone.items():
        for g in s:
            by_gram.setdefault(g, []).append(d)
    for d, s in sets.items():
        near = {e for g in s for e in by_gram.get(g, ()) if e != d and 10 * len(s & alone[e]) >= 8 * len(s | alone[e])}
        assert not near if d in alone else True  # what stays has no near copy that stays
    for d in set(kept["near_duplicates"]) - set(kept["decontamination"]):
        assert any(set(i.lower().split()) & set(everything[d].lower().split()) for i in items)
    for d in kept["decontamination"]:
        assert not any(i in everything[d] for i in items if len(i.split()) >= decontaminate.LEAST)
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(secrets.WORDS)))}
    for d, r in kept["secrets"].items():
        assert r.text == secrets.masked(everything[d], secrets.find(everything[d], ranks), corpus_pipeline.MASK) and r.n_chars == len(r.text)
        assert not any(k == 2 for k, *_ in secrets.find(r.text, ranks))
    import tiktoken
    vocabulary, pattern = queries.vocabulary(spark)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    for d, r in kept["tokens"].items():
        assert r.ids == encoding.encode_ordinary(kept["secrets"][d].text) and r.n_tokens == len(r.ids)


def test_pipeline_on_odd_rows(spark, odd, docs_of):
    """Columns pass through; the near-duplicate stage keeps one of the equal sentences and every text without words."""
    kept = corpus_pipeline.near_duplicate_filter(spark, odd, SF)
    assert kept.columns == odd.columns
    got = sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept.collect())
    assert got == sorted([("None", ""), ("1", ""), ("2", ""), ("3", " \t\n"), ("4", "one"), ("5", "the quick"), ("7", "é" * 9), ("8", "x" * 9), ("9", "a b\x00c 😀")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= odd.count()
        assert set(odd.columns) <= set(stage(spark, odd, SF).columns)
        assert stage(spark, docs_of([]), SF).count() == 0
