import random
import re
from collections import defaultdict

import brute
import numpy as np
import pytest

from loanscope.llm import jaccard_join, suffix_dedup
from loanscope.llm.exact_dedup import exact_dedup
from loanscope.llm.graph import components
from loanscope.llm.substring_dedup import substring_dedup


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = {d: (min(ds), len(ds), d == min(ds), brute.sha(c)) for c, ds in groups.items() for d in ds}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs).collect()}
    assert got == want


def test_exact_dedup_of_an_empty_table_and_repeated_rows(llm, docs):
    assert exact_dedup(docs.limit(0)).collect() == []
    rows = [(1, "a  b"), (1, "a b"), (2, "a b")]
    got = sorted(tuple(r)[:4] for r in exact_dedup(llm.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 65_536 if hot > 3 else 1 << 40)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"])))
           for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute.suffix_dedup(texts)


def test_suffix_dedup_counts_a_repeated_row_once(llm):
    t = "".join(chr(97 + i * i % 23) for i in range(260))
    df = llm.createDataFrame([(1, t), (1, t), (2, t)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect())
    want = brute.suffix_dedup({1: t, 2: t})
    assert got == [(1, want[1][1]), (1, want[1][1]), (2, want[2][1])]
    assert suffix_dedup.suffix_dedup(df.limit(0)).collect() == []


def test_two_stage_sorting_orders_suffixes():
    rnd = random.Random(1)
    for _ in range(50):
        text = bytes(rnd.choice(b"aabc") for _ in range(rnd.randrange(1, 60)))
        joined = np.append(np.frombuffer(text, np.uint8) + np.uint8(1), np.uint8(0))
        order = suffix_dedup.sort_suffixes(joined, np.arange(len(text)), len(text) + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_deduplicated_documents_keep_rows_and_columns(docs):
    out = suffix_dedup.deduplicated_documents(docs.withColumn("n_chars", docs["cell"]))
    assert out.columns == [*docs.columns, "n_chars"]
    assert out.count() == docs.count()


def test_substring_dedup(docs, texts):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"]))
                 for r in substring_dedup(docs).collect())
    assert got == sorted(brute.substring_dedup(list(texts.items())))
    assert substring_dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shingle,percent,block", [(3, 90, 1024), (5, 80, 4)])
def test_jaccard_classes(llm, docs, texts, shingle, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd = random.Random(3)
    texts = dict(texts)
    top = max(texts) + 1
    for source in (3, 5):
        words = texts[source].split()
        for i in range(30):
            w = list(words)
            for _ in range(rnd.randrange(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"zz{rnd.randrange(10 ** 6)}"
            texts[top] = " ".join(w)
            top += 1
    df = llm.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_join.jaccard_classes(df, shingle, percent).collect()}
    assert got == brute.jaccard_components(texts, shingle, percent)


def test_every_link_without_absorbing(llm, docs, texts):
    of, links = jaccard_join.jaccard_join(docs, 3, 80, absorb=False)
    member = {r["doc_id"]: r["member"] for r in of.collect()}
    sets = {m: brute.shingles(texts[m]) for m in set(member.values()) - {None}}
    by = defaultdict(set)
    for m, s in sets.items():
        for x in s:
            by[x].add(m)
    pairs = {(a, b) for ms in by.values() for a in ms for b in ms if a < b}
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == want


def test_components_of_a_path_and_a_star(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(llm.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


@pytest.mark.parametrize("percent", [80, 90])
def test_block_bound_never_rules_out_a_link(percent):
    rng = np.random.default_rng(7)
    fresh = lambda m: rng.integers(0, 2**63, m).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(fresh(int(10 ** rng.uniform(0.5, 3.7)))) for _ in range(40)]
    for _ in range(120):
        base = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate((base[rng.random(len(base)) > rng.random() * 0.2], fresh(5)))))
    sketches = [jaccard_join.sketch(s) for s in sets]
    n, classes = np.array([len(s) for s in sets]), np.array([len(x) for x in sketches])
    ruled = 0
    for width in (16, 128):
        fold, has = jaccard_join.folded(sketches, width), classes >= width
        for i in range(len(sets)):
            out = jaccard_join.ruled_out(i, np.arange(len(sets)), n, fold, has, percent)
            ruled += out.sum()
            for j in np.flatnonzero(out):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                assert 100 * both < percent * (n[i] + n[j] - both)
    assert ruled > 1000
