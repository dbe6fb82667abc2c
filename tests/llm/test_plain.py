"""The pipeline's stages and operators 4 and 9 against plain Python versions
and pages that no generator made."""

import math
import re
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanscope.llm import html_extract, packing, quality_rules

SF = "/root/testdata/sf0.001"


def all_counts(text):
    t = text or ""
    lines = [x for x in t.split("\n") if brute.WORD.search(x)]
    return brute.quality_counts(t) | {"n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in t)}


def verdicts(texts, langs, labels, second_half):
    """{doc_id: failed rules} (None: the base rule failed), by definition."""
    counts = {d: all_counts(t) for d, t in texts.items()}
    base = {d for d, c in counts.items() if c["n_words"] < 50 or 2 * c["n_repeat_words"] > c["n_words"]}
    ratio = {d: {r: c[a] / c[b] if c[b] else 0.0 for r, (a, b) in quality_rules.RULES.items()}
             for d, c in counts.items()}
    known = [d for d in texts if d in labels and d not in base]
    first = defaultdict(list)
    for d in known:
        if d not in second_half and labels[d]:
            first[langs[d] or ""].append(d)
    cut = {}
    for lang, ds in first.items():
        cut[lang] = []
        for level in quality_rules.LEVELS:
            p = 1.0 - level
            cut[lang].append({
                r: sorted(ratio[d][r] for d in ds)[max(0, math.ceil(p * len(ds)) - 1)] for r in quality_rules.RULES})
    used = {}
    for lang in cut:
        held = [d for d in known if d in second_half and (langs[d] or "") == lang]
        good = [d for d in held if labels[d]]
        caught = []
        for c in cut[lang]:
            fails = {d for d in held if any(ratio[d][r] > c[r] for r in c)}
            x, n, a = len(fails & set(good)), len(good), quality_rules.ALPHA
            chance = sum(math.comb(n, k) * a ** k * (1 - a) ** (n - k) for k in range(x + 1))
            if n == 0 or chance > quality_rules.DELTA / len(cut):
                break
            caught.append(len(fails) - x)
        if caught and caught[-1]:
            used[lang] = cut[lang][next(
                i for i, x in enumerate(caught) if x >= quality_rules.NEARLY * caught[-1])]
    return used, {d: None if d in base else {
        r for r, c in used.get(langs[d] or "", {}).items() if ratio[d][r] > c} for d in texts}


def second_half(df):
    return {r["doc_id"] for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).select("doc_id").collect()}


def test_certified_verdicts_by_definition(llm):
    df = llm.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 4 = 0").select(
        "doc_id", "text", F.when(F.col("doc_id") % 3 > 0, "xx").alias("lang"))
    texts, langs = ({r["doc_id"]: r[c] for r in df.collect()} for c in ("text", "lang"))
    counts = {d: all_counts(t) for d, t in texts.items()}
    share = {d: c["n_symbols"] / c["word_chars"] for d, c in counts.items() if c["n_words"] >= 50}
    bad = sorted(share, key=lambda d: (share[d], d))[-300:]
    labels = {d: int(d not in bad) for d in texts if d % 10}
    used, want = verdicts(texts, langs, labels, second_half(df))
    table = llm.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: None if r["base_failed"] else set(filter(None, r["failed_rules"].split(",")))
           for r in quality_rules.quality_rules(df, table).collect()}
    assert used and any(want.values()) and got == want


def kept_bytes(docs, length=100):
    """{doc_id: the bytes that suffix dedup leaves}"""
    seen, out = set(), {}
    for d in sorted(docs):
        b = docs[d].encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = [True] * length
            seen.add(b[i:i + length])
        out[d] = bytes(c for c, g in zip(b, gone) if not g)
    return out


def test_every_stage_equals_a_plain_version(llm):
    source = llm.read.parquet(f"{SF}/documents.parquet")
    # a shared passage that begins and ends inside a character, in texts that stay
    rows = source.collect()
    top = max(r["doc_id"] for r in rows) + 1
    some = next(r for r in rows if r["lang"] and len(r["text"]) > 1500)
    passage = " ".join(f"v{i}w{i * i % 97}" for i in range(40))
    extra = [" ".join(f"{c}{i}x{i * 7 % 53}" for i in range(200)) for c in "pq"]
    extra = [f"{extra[0]} é{passage}é tail", f"{extra[1]} è{passage}è tail"]
    df = source.unionByName(llm.createDataFrame(
        [some.asDict() | {"doc_id": top + i, "text": t, "n_chars": len(t)} for i, t in enumerate(extra)], source.schema))
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    langs = {r["doc_id"]: r["lang"] for r in df.collect()}
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    verdict = verdicts(text, langs, labels, second_half(df))[1]
    want = {d: t for d, t in text.items() if verdict[d] is not None and not verdict[d]}
    assert {top, top + 1} <= set(want)

    def step(k):
        nonlocal df
        df = corpus_pipeline.written(corpus_pipeline.STAGES[k][1](llm, df, SF), "plain")
        return {r["doc_id"]: r["text"] for r in df.collect()}

    assert step(0) == want
    groups = defaultdict(list)
    for d, t in want.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    want = {min(ds): want[min(ds)] for ds in groups.values()}
    assert step(1) == want
    want = {d: want[d] for d, (_, c) in brute.jaccard_components(want, 5, 80).items() if d == c}
    assert step(2) == want
    want = {d: b.decode("utf-8", "replace") for d, b in kept_bytes(want).items()}
    assert step(3) == want
    assert "�" in want[top + 1]

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces, by_seq = set(), defaultdict(list)
    for d, t in want.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        edges = sorted({*range(0, len(ids), packing.CAPACITY), len(ids) // packing.STEP * packing.STEP, len(ids)})
        pieces |= {(d, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(edges, edges[1:])}
    rows = corpus_pipeline.sequences(llm, df, SF).collect()
    assert len(rows) == len(pieces)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == pieces
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_seq.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        assert sum(n for _, n in spans) <= packing.CAPACITY


NEWS = """<!doctype html><html lang=en><head><title>Harbour reopens - The Port Gazette</title>
<style>.nav a{color:red}</style><script>var p = "<p>not text</p>";</script></head><body class="home single">
<header><nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>
</nav></header>
<main><article><h1>Harbour reopens after long winter storms</h1>
<p>The old harbour opened to fishing boats on Monday, after ten weeks of repairs to its outer wall.</p>
<p>Crews had worked day and night, said the harbour master. <a href="/wall">The wall</a> is now two metres higher.</p>
<p>Boats from three towns came in before noon; the market sold out within an hour.</p></article></main>
<aside class="sidebar"><p>Most read: ten things to do in town.</p></aside>
<footer><p>&copy; 2021 The Port Gazette. All rights reserved.</p></footer></body></html>"""

POST = """<html><body><div class="menu"><a href="/">Start</a> <a href="/about">About</a></div>
<div class="content"><h1>How I bake bread</h1>
<p>I mix flour, water and salt in the evening &amp; let the dough rest until morning.
<p>Then it goes into a very hot oven for forty minutes. The crust should be dark brown.
<blockquote>Good bread needs time, my teacher used to say.</blockquote></div>
<div class="comments"><p>Great recipe, thank you.</p></div>
<div class="footer">Copyright (c) Someone</div></body></html>"""


def test_main_text_of_pages_written_by_hand():
    field = html_extract.default_field()
    assert html_extract.extract(field, NEWS).split("\n") == [
        "Harbour reopens after long winter storms",
        "The old harbour opened to fishing boats on Monday, after ten weeks of repairs to its outer wall.",
        "Crews had worked day and night, said the harbour master. The wall is now two metres higher.",
        "Boats from three towns came in before noon; the market sold out within an hour.",
    ]
    assert html_extract.extract(field, POST).split("\n") == [
        "How I bake bread",
        "I mix flour, water and salt in the evening & let the dough rest until morning.",
        "Then it goes into a very hot oven for forty minutes. The crust should be dark brown.",
        "Good bread needs time, my teacher used to say.",
    ]
