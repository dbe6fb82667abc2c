import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loanscope.llm import html_extract, language_id, license_scan, packing, quality_rules
from loanscope.llm import sentencepiece_bpe as sp

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library(docs, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for d, t in texts.items():
        ids = lib.encode(t or "")
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids)))
    assert {r["doc_id"]: tuple(r)[1:] for r in sp.encode_digests(docs, PIECES).collect()} == want
    back = sp.decode_documents(sp.encode_documents(docs, PIECES), PIECES)
    assert {r["doc_id"]: brute.sha(r["text"]) for r in back.collect()} == {d: w[2] for d, w in want.items()}


def test_prefix_table_on_random_strings():
    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp.model(PIECES)
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("aeth  \n▁ s日é🤗\t\x00lrn<0x>!..") for _ in range(rnd.randrange(50)))
        ids = lib.encode(t)
        assert m.encode(t) == ids and m.decode(ids) == lib.decode(ids)


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: {c: r[c] for c in quality_rules.COUNTS} for r in quality_rules.quality_counts(docs).collect()}
    assert got == {d: brute.quality_counts(t) for d, t in texts.items()}


def test_binomial_bound_and_fixed_sequence():
    from math import comb

    exact = sum(comb(30, k) * 0.1 ** k * 0.9 ** (30 - k) for k in range(3))
    assert quality_rules.binomial_cdf(2, 30, 0.1) == pytest.approx(exact)
    assert quality_rules.certified_levels([0, 1, 60, 0], 1000, 0.02, 0.01) == 2
    assert quality_rules.certified_levels([0], 0, 0.02, 0.01) == 0


def test_quality_rules_without_labels_reject_by_the_base_rule_only(llm, docs):
    none = llm.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality_rules.quality_rules(docs, none).collect()
    assert len(out) == docs.count() and all(r["kept"] != r["base_failed"] for r in out)


def test_quality_rules_keep_good_and_find_bad(llm):
    d = "/root/testdata/sf0.1"
    labels = llm.read.parquet(f"{d}/labels.parquet")
    rows = quality_rules.quality_rules(llm.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id") \
        .filter("NOT base_failed").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 1 - quality_rules.ALPHA and np.mean(bad) < 0.2


def test_packing(docs, texts):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_path()).collect() == []


def test_packing_leaves_little_padding():
    sizes = np.random.default_rng(1).integers(1, 6000, 4000)
    parts = np.array(sorted((b - a for n in sizes for a, b in packing.cuts(int(n), 2048, 512)), reverse=True))
    seq, _ = packing.assign(parts, 2048, packing.LINEAR, packing.QUADRATIC)
    assert parts.sum() / (len(set(seq.tolist())) * 2048) > 0.97


def test_language_id_on_held_out_rows(llm):
    d = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op2_language_id(llm, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 200 and np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_rows_without_letters_and_without_training(docs, texts):
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs.select("text", "lang"))).collect()}
    for d, t in texts.items():
        assert (got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    none = language_id.fit(docs.limit(0))
    assert none is None and {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}


def test_html_extraction_on_composed_held_out_pages():
    field = html_extract.default_field()
    pages = html_extract.labelled_pages(120, seed=99)
    right = total = 0
    for page, labels in pages:
        found = html_extract.blocks(page)
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(html_extract.features(found)), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = html_extract.default_field()
    page = html_extract.features(html_extract.blocks(html_extract.labelled_pages(3, seed=5)[2][0]))[:8]

    def score(labels):
        s = field.first[labels[0]] + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))
        return s + sum(field.weights[field.index[f], y] for names, y in zip(page, labels)
                       for f in names if f in field.index)

    assert score(field.decode(page)) == pytest.approx(max(score(p) for p in product((0, 1), repeat=len(page))))


def test_html_blocks_of_awkward_markup(llm):
    def got(page):
        return [b.text for b in html_extract.blocks(page)]

    assert got('<script>var a="</p>x";</script><p>A &amp B<p>C<br>d</p><!-- <p>e') == ["A & B", "C d"]
    assert got('<p title="a>b">q</p><p') == ["q"]
    df = llm.createDataFrame([(1, "u", None, 1), (2, None, "", 2)], "page_id bigint, url string, html string, text int")
    assert [r["text"] for r in html_extract.extract_pages(df, html_extract.default_field()).collect()] == ["", ""]


def test_license_scan(llm):
    mit = license_scan.LICENSE_TEXTS["MIT"]
    rows = [
        (1, mit.upper().replace("<YEAR> <HOLDER>", "2020 Someone")), (2, mit + " and more"), (3, None), (4, ""),
        (5, "text\nLICENCED under the apache-license, version 2.0\nmore"), (6, "Copyright 2020 Me\n" + mit.split("\n", 2)[0]),
    ]
    df = llm.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, digest string")
    got = {r["doc_id"]: (r["license_id"], r["notice_ids"])
           for r in license_scan.license_scan(df, license_scan.known_licenses(llm)).collect()}
    assert got[1] == ("MIT", "") and got[2][0] is None and got[3] == got[4] == (None, "")
    assert got[5] == (None, "Apache-2.0")
    assert license_scan.license_scan(df.limit(0), license_scan.known_licenses(llm)).collect() == []
