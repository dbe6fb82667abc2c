"""Steps of the dedup operators: few of them, and little memory in a worker."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loanscope.llm import graph, jaccard_join, suffix_dedup, textbatch
from loanscope.llm.graph import components
from tests.llm import brute


@pytest.mark.parametrize("edges, tables", [
    ([(1, i) for i in range(2, 40)] + [(50, 51)], 1),  # stars as they come
    ([(9, 3), (9, 4), (4, 3)], 2),
    ([], 1),
])
def test_stars_need_no_round(llm, monkeypatch, edges, tables):
    names = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or kept(df, name))
    got = dict(components(llm.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {x: 50 if x > 49 else 3 if tables == 2 else 1 for e in edges for x in e}
    assert len(names) == tables


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(2, 60))]
        texts.append(" ".join(base))
        texts.append("  ".join(base).upper())  # the same set
        near = list(base)
        near[rng.randrange(len(near))] = "other"
        texts.append(" ".join(near))
    return dict(enumerate([*texts, "", None, "one", "one"]))


def _plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [250_000, 0])
def test_copies_few_or_many_give_the_same_classes(llm, monkeypatch, few):
    texts, plans = _texts(), {}
    kept = jaccard_join.written

    def watched(df, name, **more):
        plans[name] = _plans(df)
        return kept(df, name, **more)

    monkeypatch.setattr(jaccard_join, "written", watched)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    df = llm.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df, 3, 90).collect()}
    assert got == brute.jaccard_components(texts, 3, 90)
    # texts are packed only when they have to move
    assert plans["cells"].count("MapInArrow") == (1 if few else 2)


def test_a_task_gives_freed_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(textbatch, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["ab", "cd"])], names=["doc_id", "text"])
    parts = textbatch.slices([batch], max_bytes=2)
    assert next(parts).num_rows == 1 and len(calls) == 1
    assert len(list(parts)) == 1 and len(calls) == 2


def test_suffix_sort_keeps_no_copies_of_its_strings():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 40_000).astype(np.uint8)
    text[996::997] = text[-1] = 0
    kept = suffix_dedup.np.argsort
    seen = []

    def watched(values, **more):
        seen.append(sum(t.size for t in tracemalloc.take_snapshot().traces))
        return kept(values, **more)

    wanted = np.flatnonzero(text)
    tracemalloc.start()
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix_dedup.np, "argsort", watched)
            order = suffix_dedup.sort_suffixes(text, wanted, 100)
    finally:
        tracemalloc.stop()
    assert sorted(order) == wanted.tolist()
    assert seen[0] > 100 * 10_000 and max(seen[1:]) < seen[0] / 2  # the strings are there, then gone
