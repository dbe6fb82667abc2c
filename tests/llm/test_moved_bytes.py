"""What the stages of the pipeline write for shuffles, against the text they read."""

import random
import tracemalloc

import numpy as np
import pytest

from loanscope.llm import exact_dedup, jaccard_join, quality_rules, suffix_dedup, tables

KEY = "spark.sql.autoBroadcastJoinThreshold"


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def _rows():
    """400 texts of random words; of every 20 one is an equal copy of the one
    before, one nearly so and one is short."""
    rng = random.Random(11)
    rows = []
    for d in range(400):
        words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300)]
        if d % 20 == 1:
            words = rows[-1][1].split()
        if d % 20 == 5:
            words = [*rows[-1][1].split()[:-1], "other"]
        if d % 20 == 9:
            words = words[:30]
        rows.append((d, " ".join(words), "en", 0))
    return rows


def _quality(docs):
    labels = docs.sparkSession.createDataFrame([(2, 1)], "doc_id bigint, quality int")
    return quality_rules.kept_documents(docs, labels)


@pytest.mark.parametrize("stage, gone, most", [
    (_quality, {9}, 0.15),
    (exact_dedup.kept_documents, {1}, 0.3),
    (jaccard_join.kept_documents, {1, 5}, 0.5),
    (suffix_dedup.deduplicated_documents, set(), 1.7),
])
def test_few_texts_move(llm, monkeypatch, tmp_path, stage, gone, most):
    rows = _rows()
    llm.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").repartition(4).write.parquet(
        f"{tmp_path}/in")
    docs = llm.read.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(tables, "release", lambda spark: None)  # files stay to be counted
    old = llm.conf.get(KEY)
    llm.conf.set(KEY, "-1")
    try:
        before = set(_shuffle_files(llm))
        got = stage(docs).collect()
        moved = sum(n for name, n in _shuffle_files(llm).items() if name not in before)
    finally:
        llm.conf.set(KEY, old)
    assert {r["doc_id"] for r in got} == {d for d, *_ in rows if d % 20 not in gone}
    text = sum(len(r[1]) for r in rows)
    assert moved < most * text, (moved, text)


def test_rows_among_and_without_ids(llm):
    docs = llm.createDataFrame([(i // 2, f"t{i}", i) for i in range(600)], "doc_id bigint, text string, _word int")
    judged = llm.createDataFrame([(i // 2, i % 6 == 0) for i in range(600)], "doc_id bigint, kept boolean")
    left = tables.without(docs, judged)
    assert left.columns == docs.columns
    # an id stays if one of its rows does
    assert sorted(map(tuple, left.collect())) == [(i // 2, f"t{i}", i) for i in range(600) if i // 2 % 3 == 0]
    ids = llm.createDataFrame([(5,), (5,), (299,), (1000,)], "doc_id bigint")
    assert sorted(r["_word"] for r in tables.among(docs, ids).collect()) == [10, 11, 598, 599]
    maybe, surely = tables.possibly(docs, ids)
    assert maybe.count() < 10 and maybe.count() + surely.count() == 600
    assert tables.among(docs, ids.filter("false")).count() == 0
    assert tables.without(docs, judged.withColumn("kept", judged["doc_id"] >= 0)).count() == 600
    assert tables.without(docs, judged.withColumn("kept", judged["doc_id"] < 0)).count() == 0


def test_packed_sketches_stay_a_lower_bound():
    rng = np.random.default_rng(3)
    for n in (1, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        crowded = np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64))  # counts over 15
        for b in (a[: max(1, n // 2)], np.union1d(a[1:], crowded)):
            x, y = (jaccard_join.counts(jaccard_join.nibbles(jaccard_join.sketch(s))) for s in (a, b))
            assert len(x) == len(jaccard_join.sketch(a))
            assert jaccard_join.sketch_distance(x, y) <= len(np.setxor1d(a, b))
    assert jaccard_join.counts(jaccard_join.nibbles(b"")) == b""


def test_sorting_takes_few_keys_at_a_time():
    rng = np.random.default_rng(4)
    text = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 600_000).astype(np.uint8)
    text[-1] = 0
    wanted = np.arange(len(text) - 1)
    tracemalloc.start()
    order = suffix_dedup.sort_suffixes(text, wanted, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text), peak  # keys of 100 bytes for half of the positions took more
    raw = text.tobytes()
    assert sorted(order.tolist()) == wanted.tolist()
    some = order[::97].tolist()
    assert all(raw[a:a + 100].split(b"\0")[0] <= raw[b:b + 100].split(b"\0")[0] for a, b in zip(some, some[1:]))
