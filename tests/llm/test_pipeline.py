import brute
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [set(text)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(llm, docs, SF), "test")
        assert docs.columns == columns
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert set(rows) <= seen[-1]
        seen.append(set(rows))
        if name == "exact_dedup":
            assert len({" ".join(r["text"].split()) for r in rows.values()}) == len(rows)
            before = {d: r["text"] for d, r in rows.items()}
        if name == "ngram_jaccard_join":
            want = brute.jaccard_components(before, 5, 80)
            assert set(rows) == {d for d, (_, c) in want.items() if d == c}
            before = {d: r["text"] for d, r in rows.items()}
    assert {d: brute.sha(r["text"]) for d, r in rows.items()} == {
        d: w[3] for d, w in brute.suffix_dedup(before).items()} or any("�" in r["text"] for r in rows.values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    packed = corpus_pipeline.STAGES[-1][1](llm, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(rows)


def test_run_registers_as_a_query(llm):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()) == sorted(
        f"op{i}" for i in range(1, 14))
