"""The corpus pipeline: contract of the stages, and the stages against plain versions on a small table."""

import re

import pytest

import corpus_pipeline
from spandrel.llm import common, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = common.read_table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_in_order(stages):
    assert [n for n, _, _ in stages] == ["quality_rules", "jaccard_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_stages_against_plain_versions(spark, sf_dir, stages):
    rows = {n: ({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()}) for n, a, b in stages}
    before, after = rows["quality_rules"]
    assert after == {i: t for i, t in before.items() if quality.kept(t, quality.RULES)}

    sets = lambda t, low=False: {tuple(w[i : i + 5]) for w in [(t.lower() if low else t).split()] for i in range(len(w) - 4)}
    before, after = rows["jaccard_dedup"]
    s = {i: sets(t) for i, t in before.items()}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] & s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert after == {i: t for i, t in before.items() if find(i) == i}

    before, after = rows["benchmark_decontamination"]
    items = [sets(r.text, True) for r in common.read_table(spark, sf_dir, "benchmark").collect()]
    dirty = {i for i, t in before.items() if any(x and len(x & sets(t, True)) >= 0.8 * len(x) - 1e-9 for x in items)}
    assert after == {i: t for i, t in before.items() if i not in dirty}

    before, after = rows["secret_scan"]
    assert set(before) == set(after)
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t) for t in after.values())
    assert all(after[i] == t or "[SECRET]" in after[i] for i, t in before.items())


def test_tokens_decode_to_the_texts(stages):
    name, before, after = stages[-1]
    assert after.count() == before.count() and after.filter("not round_trip").count() == 0
    assert after.filter("n_tokens * 4 <> octet_length(token_ids)").count() == 0


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = {r.doc_id: (r.text, bytes(r.token_ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r.doc_id: (r.text, bytes(r.token_ids)) for r in stages[-1][2].collect()}
