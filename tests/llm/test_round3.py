import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from loanscope.llm import html_extract, language_id, license_scan, packing

END = "<|endoftext|>"


@pytest.mark.parametrize("text", [
    f"a {END} b", END, f"{END}{END}", f"one two{END}three.", f"x {END}\ny", f"<|endoftext|{END}>", "<|endoftext |>",
])
def test_units_give_the_ids_of_the_default_tokenizer(text):
    want = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(**packing.tokenizer(), added_tokens=True).encode(text), "<u4").tolist() == want


def test_packing_query_and_stage_encode_added_tokens(llm, docs, tmp_path):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = {1: f"a {END} b", 2: "a b", 3: END, 4: None}
    df = llm.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        want[d] = (len(ids), zlib.crc32(ids.tobytes()))
    assert want[1][0] == 5
    for out in (packing.op10_packing(llm, str(tmp_path)), corpus_pipeline.sequences(llm, df, str(tmp_path))):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in out.collect()} == want


@pytest.mark.parametrize("page,want", [
    ('<article><svg-icon name="x"></svg-icon><p>Main text.</p></article>', ["Main text."]),
    ("<template-card><p>A card.</p></template-card><p>b</p>", ["A card.", "b"]),
    ("<p>a<object-view>b</object-view>c</p><style-guide>d</style-guide>", ["abc", "d"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", ["Let x=2 hold."]),
    ('<object data="a.swf"><param name="q" value="1"><p>Fallback text.</p></object>', ["Fallback text."]),
    ("<svg\nwidth=1><text>no</text></svg><p>a</p><svg/><p>b</p><script>no</script >", ["a", "b"]),
    ("<STYLE>p{}</STYLE><canvas>no</canvas><p>a", ["a"]),
])
def test_raw_elements_are_told_by_their_whole_name(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


def test_whole_texts_of_common_licenses(llm):
    folder = Path(license_scan.__file__).parent / "licenses"
    names = ["Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense",
             "BSL-1.0"]
    bsd = """Copyright (c) 2019, Someone.  All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

""" + license_scan.LICENSE_TEXTS["BSD-2-Clause"].partition("THIS SOFTWARE")[1] + (
        license_scan.LICENSE_TEXTS["BSD-2-Clause"].partition("THIS SOFTWARE")[2])
    want = {n: n for n in names} | {
        "bsd": "BSD-3-Clause", "bsd head": "BSD-3-Clause", "apache terms": "Apache-2.0", "gpl terms": "GPL-2.0",
        "gpl http": "GPL-3.0", "mit": "MIT", "cut": None, "bsd more": None}
    text = {n: (folder / f"{n}.txt").read_text() for n in names}
    text |= {
        "bsd": bsd, "bsd head": "BSD 3-Clause License\n\n" + bsd, "bsd more": bsd + "\nAnd more.",
        "apache terms": text["Apache-2.0"].partition("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n",
        "gpl terms": text["GPL-2.0"].partition("END OF TERMS")[0],
        "gpl http": text["GPL-3.0"].replace("https:", "http:"), "cut": text["GPL-3.0"][:20000],
        "mit": license_scan.LICENSE_TEXTS["MIT"].replace("MIT License", "The MIT License (MIT)"),
    }
    ids = {i: n for i, n in enumerate(want)}
    df = llm.createDataFrame([(i, text[n]) for i, n in ids.items()], "doc_id bigint, text string")
    got = license_scan.license_scan(df, license_scan.known_licenses(llm)).collect()
    assert {ids[r["doc_id"]]: r["license_id"] for r in got} == want


def test_known_license_forms_have_one_id_each(llm):
    known = license_scan.known_licenses(llm)
    one = known.groupBy(license_scan.canonical(known["text"]).alias("c")).agg({"license_id": "collect_set"}).collect()
    assert all(len(r[1]) == 1 for r in one)


def test_rows_without_an_id_go_through_all_stages(llm):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    good = {r["doc_id"] for r in corpus_pipeline.quality(llm, llm.createDataFrame(
        rows, "doc_id bigint, text string, lang string"), sf).collect()}
    _, text, lang = next(r for r in sorted(rows) if r[0] in good and len(r[1]) > 2000)
    own = " ".join(f"w{i * i % 977}x{i}" for i in range(120)) + "."
    near = own.replace("w4x2", "other")
    rows += [(None, own, lang), (None, own, lang), (None, near, lang), (None, text, lang), (None, "short", lang),
             (None, None, lang)]
    df = llm.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                             "doc_id bigint, text string, lang string, n_chars bigint").repartition(4)
    nulls = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.written(stage(llm, df, sf), "test")
        assert df.schema["doc_id"].dataType.simpleString() == "bigint"
        nulls.append(sorted(r["text"] for r in df.filter("doc_id IS NULL").collect()))
        if name == "quality_rules":
            assert {r["doc_id"] for r in df.filter("doc_id IS NOT NULL").collect()} == good
    assert nulls[0] == sorted([own, own, near, text]) and nulls[1] == sorted([own, near])
    assert len(nulls[2]) == 1 and nulls[2][0] in (own, near) and nulls[3] == nulls[2]
    packed = corpus_pipeline.sequences(llm, df, sf).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = np.array(tok.encode(nulls[3][0], add_special_tokens=False).ids + [packing.END_ID], "<u4")
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in packed if r["doc_id"] is None)
    assert pieces == [(a, b - a, zlib.crc32(ids[a:b].tobytes()))
                      for a, b in packing.cuts(len(ids), packing.CAPACITY, packing.STEP)]


def test_language_sample_counts_distinct_texts_and_is_bounded(llm):
    rows = [("one text many times", "aa")] * 600 + [(f"text number {i}", "aa") for i in range(50)]
    rows += [(f"copied text {i}", "bb") for i in range(3)] * 400 + [("alone", "cc")]
    train = llm.createDataFrame(rows, "text string, lang string").repartition(5)
    got = [tuple(r) for r in language_id.sampled(train, 20).select("text", "lang").collect()]
    assert len(set(got)) == len(got) and set(got) <= set(rows)
    assert {g: sum(x == g for _, x in got) for g in ("aa", "bb", "cc")} == {"aa": 20, "bb": 3, "cc": 1}
    assert sorted(got) == sorted(tuple(r) for r in language_id.sampled(train.repartition(3), 20).select(
        "text", "lang").collect())
    assert set(language_id.fit(train, sample=20).langs) == {"aa", "bb", "cc"}
