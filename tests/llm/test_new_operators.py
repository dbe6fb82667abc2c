"""Operators 11 to 13 against plain versions and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.llm import order_sums, prefix_trie, quality_cnn, vector_codes

SF = "/root/testdata/sf0.01"


# --- 11: quality classifier


def _batch(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(int)


def _plain_score(net, raw: bytes) -> float:
    """The network written out: one position, chunk and unit at a time."""
    n_blocks = -(-(len(raw) + quality_cnn.WIDTH - 1) // quality_cnn.BLOCK)
    resp = np.full((n_blocks * quality_cnn.BLOCK, quality_cnn.FILTERS), -np.inf)
    for i in range(len(raw)):
        bits = []
        for b in range(quality_cnn.WIDTH):
            bits += [((raw[i + b] >> k) & 1) * 2 - 1 for k in range(8)] if i + b < len(raw) else [0] * 8
        resp[i] = np.array(bits) @ net.p["k"].astype(float)
    units, lo = [], 0
    while True:
        chunk = resp[lo * quality_cnn.BLOCK:lo * quality_cnn.BLOCK + quality_cnn.CHUNK].max(0)
        f = np.maximum(chunk + net.p["kb"], 0)
        units.append(np.maximum(f @ net.p["h"] + net.p["hb"], 0))
        if lo + 4 >= n_blocks:
            break
        lo += 2
    u = np.array(units)
    z = np.concatenate((u.mean(0), u.max(0))) @ net.p["o"] + net.p["ob"][0]
    return 1 / (1 + math.exp(-z))


TEXTS = ["", "a", "the cat", "x" * 63, "x" * 64, "y" * 65, "é" * 200, "word " * 300,
         "".join(chr(33 + i % 90) for i in range(1000)), "b" * 20000]


def test_network_equals_the_plain_version():
    rng = np.random.default_rng(3)
    net = quality_cnn.Network.fresh(rng)
    net.p["kb"] = rng.standard_normal(quality_cnn.FILTERS).astype(np.float32)
    net.p["hb"] = rng.standard_normal(quality_cnn.HIDDEN).astype(np.float32)
    got = net.scores(*_batch(TEXTS))
    assert np.allclose(got, [_plain_score(net, t.encode()) for t in TEXTS], atol=1e-4)
    alone = [net.scores(*_batch([t]))[0] for t in TEXTS]
    assert np.allclose(got, alone, atol=1e-6)
    again = quality_cnn.Network.from_bytes(net.to_bytes()).scores(*_batch(TEXTS))
    assert np.array_equal(got, again)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net = quality_cnn.Network.fresh(rng)
    data, offs = _batch(TEXTS[:9])
    target = np.arange(9) % 2
    g = net.gradients(data, offs, target)

    def loss():
        p = net.scores(data, offs)
        return -np.mean(np.where(target == 1, np.log(p), np.log(1 - p)))

    for name in net.p:
        flat = net.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 2e-3
            up = loss()
            flat[i] = old - 2e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 4e-3 - g[name].reshape(-1)[i]) < 4e-3, name


def test_quality_on_held_out_rows(llm):
    found = quality_cnn.op11_quality_cnn(llm, "/root/testdata/sf0.1")
    labels = llm.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.985
    assert np.mean([s < 0.5 for s in bad]) > 0.85


def test_quality_reads_whole_texts_and_awkward_rows(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    model = quality_cnn.fit(docs, labels, F.lit(True))
    clean = "Of the hand that was with the thing, and the rest of it was there. " * 200
    junk = "OF!! THE!! HAND$$$ THAT### WAS%%% " * 40
    rows = [(1, clean), (2, clean[:7000] + junk + clean[7000:]), (3, None), (4, ""), (None, clean), (1, clean)]
    df = llm.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, score string, label int")
    got = quality_cnn.score(df.repartition(2), model).collect()
    assert len(got) == 6
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert by[1] == by[None] and by[3] == by[4]
    assert min(by[1]) > max(by[2])
    assert all(0 <= s <= 1 for v in by.values() for s in v)
    assert quality_cnn.score(df.filter("false"), model).count() == 0


def test_quality_without_two_labels(llm):
    docs = llm.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    schema = "doc_id bigint, quality int"
    none = quality_cnn.fit(docs, llm.createDataFrame([], schema), F.lit(True))
    one = quality_cnn.fit(docs, llm.createDataFrame([(1, 1), (2, None), (9, 0)], schema), F.lit(True))
    assert [r["score"] for r in quality_cnn.score(docs, none).collect()] == [0.5, 0.5]
    assert [r["score"] for r in quality_cnn.score(docs, one).collect()] == [1.0, 1.0]
    both = quality_cnn.fit(docs, llm.createDataFrame([(1, 1), (2, 0), (2, 1), (2, None)], schema), F.lit(True))
    assert quality_cnn.score(docs, both).count() == 2


# --- 12: vector codes


def _plain_codes(rows):
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e30 else int(x) * 4096 for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dims = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    size = dims // 8
    cut = [[v[p * size:(p + 1) * size] for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]

    def near(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(kept, cut):
        hits = [near(c[p], books[p]) for p in range(8)]
        out.append((i, label, "".join(f"{h[0]:02x}" for h in hits), sum(h[1] for h in hits)))
    total = defaultdict(int)
    for _, label, _, e in out:
        total[label] += e
    fit = lambda x: x if x < 1 << 63 else None
    whole = {la: fit(t) if all(fit(e) is not None for _, x, _, e in out if x == la) else None for la, t in total.items()}
    return [(i, code, fit(e), whole[label], sha) for i, label, code, e in out]


def _codes(llm, monkeypatch, rows, kind="float"):
    df = llm.createDataFrame([(i, v, la, 0, "x") for i, v, la in rows],
                             f"vec_id bigint, embedding array<{kind}>, label int, code int, error string").repartition(3)
    monkeypatch.setattr(vector_codes, "read_table", lambda *a: df)
    got = vector_codes.op12_vector_codes(llm, "").collect()
    assert got == [] or got[0].asDict().keys() == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
    return got


def _same(a, b):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_codes_equal_the_plain_version(llm, monkeypatch):
    rng = random.Random(4)
    f = lambda x: float(np.float32(x))
    rows = [(i * 3 % 101, [f(rng.gauss(0, 0.2)) for _ in range(20)], rng.choice([None, 1, 2])) for i in range(90)]
    same = rows[7][1]
    rows += [(500 + i, same, 1) for i in range(40)]
    rows += [(600, None, 1), (601, [None] * 20, 1), (602, [math.nan] * 20, 2), (603, [math.inf] + [0.0] * 19, 2),
             (604, [], 2), (605, [f(0.3)] * 5, None), (None, [f(-0.5)] * 20, 3), (None, [f(0.5)] * 20, 3),
             rows[0], rows[0], (0, [f(-1.0)] * 20, 2)]
    assert _same(_codes(llm, monkeypatch, rows), _plain_codes(rows))


def test_codes_of_large_components_are_exact(llm, monkeypatch):
    f = lambda x: float(np.float32(x))
    rows = [(i, [f((i % 7) * 1000.37), f(-i * 3e5), f(i * 2e9 if i > 20 else 0.1), f(1e-30)] * 4, i % 3) for i in range(40)]
    assert _same(_codes(llm, monkeypatch, rows), _plain_codes(rows))
    rows = [(i, [f(3.4e38 if i % 2 else -1e20), f(i)] * 8, 1) for i in range(20)]
    assert _same(_codes(llm, monkeypatch, rows), _plain_codes(rows))
    rows = [(i, [1e300 * (i + 1), 2.5 * i] * 4, i % 2) for i in range(20)]
    assert _same(_codes(llm, monkeypatch, rows, "double"), _plain_codes(rows))


def test_few_or_no_vectors(llm, monkeypatch):
    assert _codes(llm, monkeypatch, []) == []
    assert _codes(llm, monkeypatch, [(1, None, 1)]) == []
    for rows in ([(1, [], 1)], [(2, [0.5] * 8, None), (1, [0.25] * 8, 1)]):
        assert _same(_codes(llm, monkeypatch, rows), _plain_codes(rows))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 16, 33])
def test_transform_keeps_distances_and_orders_by_sequency(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-9999, 9999, (2, 50, size))
    full = vector_codes.padded_size(size)
    d = ((vector_codes.transform(a) - vector_codes.transform(b)) ** 2).sum(1)
    assert np.array_equal(d, full * ((a - b) ** 2).sum(1))
    rows = vector_codes.transform(np.eye(full, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(full))
    index, dist = vector_codes.nearest(a, b[:16])
    whole = ((a[:, None] - b[None, :16]) ** 2).sum(2)
    assert np.array_equal(index, whole.argmin(1)) and np.array_equal(dist, whole.min(1))


# --- 13: prefix trie


def _plain_trie(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    seqs = {}
    for c in by:
        by[c].sort()
    for c in by:
        own = [x[1:] for x in by[c]]
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        seqs[c] = [x[1:] for x in by.get(c - int(math.fmod(c, 5)), [])][:h] + own[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] = own + sum(saved[x] for x in kids[k])
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()]


def _table(llm, rows):
    return llm.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, depth int, node string").repartition(3)


def _awkward_conversations():
    rng = random.Random(2)
    rows = []
    for c in range(-7, 40):
        shared = c % 3 == 0
        for t in range(rng.randint(1, 7)):
            text = f"same {t}" if shared or rng.random() < 0.4 else f"own {c} {t} é"
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None]), rng.choice([text, text, None, ""])))
    rows += [(100 + i, t, "user", f"copy {t}") for i in range(30) for t in range(3)]       # equal conversations
    rows += [(205, 0, "user", "x" * 100_000), (None, 0, "user", "nobody"), (2**60 + 5, None, None, None)]
    rows += [(41, 1, "a", "bc"), (41, 1, "ab", "c"), (41, 1, "a", "bc")]                    # ties and repeats
    rows += [(300, t, "user", f"deep {t}") for t in range(60)] + [(301, t, "user", f"deep {t}") for t in range(55)]
    return rows


def test_trie_equals_the_plain_version(llm, monkeypatch):
    rows = _awkward_conversations()
    monkeypatch.setattr(prefix_trie, "read_table", lambda *a: _table(llm, rows))
    assert _same(prefix_trie.op13_prefix_trie(llm, "").collect(), _plain_trie(rows))


def test_trie_in_small_blocks(llm, monkeypatch):
    """Several levels of running sums, many rounds of list ranking, several
    texts of ids per node."""
    for fn, name in ((order_sums.running_sums, "block"), (order_sums.list_ranks, "base")):
        at = list(fn.__code__.co_varnames[:fn.__code__.co_argcount]).index(name) - fn.__code__.co_argcount
        defaults = list(fn.__defaults__)
        defaults[at] = 8
        monkeypatch.setattr(fn, "__defaults__", tuple(defaults))
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [r for r in _awkward_conversations() if r[0] is None or r[0] < 0 or 99 < r[0] < 110 or r[0] > 290]
    assert _same(prefix_trie.conversation_trie(_table(llm, rows)).collect(), _plain_trie(rows, rebuild=False))


def test_trie_without_conversations(llm, monkeypatch):
    assert prefix_trie.conversation_trie(_table(llm, [(None, 1, "a", "b")])).count() == 0
    assert prefix_trie.conversation_trie(_table(llm, []).filter("false")).count() == 0
    # no turn is left: base 5 is absent, and all own turns are skipped
    turnless = next(c for c in range(6, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(turnless, 1, "user", "a"), (turnless, 2, "user", "b")]
    monkeypatch.setattr(prefix_trie, "read_table", lambda *a: _table(llm, rows))
    got = prefix_trie.op13_prefix_trie(llm, "").collect()
    assert len(got) == 1 and _same(got, _plain_trie(rows))


def test_list_ranks_of_a_shuffled_list(llm):
    order = list(range(0, 3000, 3))
    random.Random(1).shuffle(order)
    links = [(x, order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, x in enumerate(order)]
    df = llm.createDataFrame(random.Random(2).sample(links, len(links)), "id bigint, prev bigint, next bigint")
    got = {r["id"]: r["pos"] for r in order_sums.list_ranks(df, base=50).collect()}
    assert got == {x: i for i, x in enumerate(order)}


# --- SQL


@pytest.mark.parametrize("key", ["op12_vector_codes", "op13_prefix_trie"])
def test_matches_sql(llm, key):
    module = {"op12_vector_codes": vector_codes, "op13_prefix_trie": prefix_trie}[key]
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(module.ORACLE[key])
    names = [c[0] for c in want.description]
    got = module.QUERIES[key](llm, "/root/testdata/sf0.001").select(*names).collect()
    assert _same(got, want.fetchall())


# --- rows without a doc_id, ids above 2**53, columns of any name


def _null_id_docs(llm):
    passage = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(200))
    big = 2**60
    rows = [(big + 1, "a b c " + passage), (big + 3, passage + " x y z"), (None, other), (big + 5, other + " end"),
            (None, passage + " tail of its own"), (7, "short"), (None, None), (None, ""), (None, other), (8, other)]
    data = [(d, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, "k", 6) for d, t in rows]
    df = llm.createDataFrame(
        data, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, _pid int, _pos int,"
              " _off int, kept_id int, _kept string, kept_text int")
    return rows, df.repartition(3)


def _with_numbers(rows):
    """The rows with the ids that stand for null: above all others, by the
    SHA-256 of the text."""
    top = max(d for d, _ in rows if d is not None)
    nulls = sorted((t for d, t in rows if d is None), key=lambda t: (t is not None, hashlib.sha256((t or "").encode()).hexdigest()))
    return [(d, t) for d, t in rows if d is not None] + [(top + 1 + i, t) for i, t in enumerate(nulls)], top


def test_rows_without_an_id_are_documents(llm):
    import brute

    from loanscope.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup

    rows, df = _null_id_docs(llm)
    numbered, top = _with_numbers(rows)
    null = lambda d: None if d is not None and d > top else d

    want = brute.suffix_dedup(dict(numbered))
    got = suffix_dedup.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert _same(got, [(null(d), *v) for d, v in want.items()])

    got = substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert _same(got, [(null(r[0]), *r[1:]) for r in brute.substring_dedup(numbered)])

    groups = defaultdict(list)
    for d, t in numbered:
        groups[t or ""].append(d)
    got = exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert _same(got, [(null(d), null(min(g)), len(g), d == min(g)) for g in groups.values() for d in g])

    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.jaccard_classes(df, 3, 80).collect()}
    big = 2**60
    assert got[big + 1, 121] == got[big + 3, 121] == big + 1
    assert got[None, 122] == big + 1                       # linked to documents with an id
    assert got[None, 198] == got[8, 198] == got[big + 5, 199] == 8
    assert got[None, 0] is None and got[7, 1] == 7


def test_stages_keep_columns_of_any_name(llm):
    from loanscope.llm import exact_dedup, jaccard_join, suffix_dedup

    rows, df = _null_id_docs(llm)
    out = suffix_dedup.deduplicated_documents(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {tuple(r)[5:] for r in out.collect()} == {(1, 2, 3, 4, 5, "k", 6)}
    for kept in (exact_dedup.kept_documents(df), jaccard_join.kept_documents(df)):
        assert kept.columns == df.columns and {tuple(r)[5:] for r in kept.collect()} == {(1, 2, 3, 4, 5, "k", 6)}


def test_flags_are_never_null(llm, tmp_path):
    _, df = _null_id_docs(llm)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([(7, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    from loanscope.llm import language_id

    got = language_id.op2_language_id(llm, str(tmp_path)).collect()
    assert len(got) == 10 and all(r["held_out"] is not None for r in got)
    got = quality_cnn.op11_quality_cnn(llm, str(tmp_path)).collect()
    assert len(got) == 10 and all(r["held_out"] is not None for r in got)
    assert not any(map(language_id.has_letter, ["", "²½", "Ⅷ 12", "!?"])) and language_id.has_letter("2é")


def test_ranks_encode_as_the_tokenizer_does():
    """Every code point in several places, runs of white space, long words."""
    from loanscope.llm import packing

    enc = packing.Encoder(**packing.tokenizer(), added_tokens=True)
    for lo in range(0, 0x110000, 1 << 14):
        texts = [f"a{c}b {c} {c}1{c}{c}!{c}  {c}\n{c}" for c in map(chr, range(lo, lo + (1 << 14))) if not "\ud800" <= c < "\ue000"]
        want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert all(enc.ranks.encode_ordinary(t) == w.ids for t, w in zip(texts, want))
    for text in ["x" * 100_000, " " * 100_000, "\n " * 50_000 + "é", "a" + " " * 199 + "b", "a<|endoftext|>b"]:
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_groups_of_packing_are_bounded(llm):
    """Equal pieces without an id do not fall into one group."""
    from loanscope.llm import packing

    rows = [(None, 0, 30, 5, 30)] * 500 + [(i, 0, 700, i, 700) for i in range(40)]
    pieces = llm.createDataFrame(rows, packing._PIECES).repartition(4)
    out = packing.pack(pieces, group=64).collect()
    groups = defaultdict(int)
    for r in out:
        groups[r["sequence_id"] >> 32] += 1
    assert len(out) == 540 and max(groups.values()) <= 64 and len(groups) == 9


def test_slots_name_the_ids(llm):
    from loanscope.llm import repeats

    ids = llm.range(0, 5000, 7).select(F.col("id").alias("doc_id"))
    docs = llm.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    left = {r["doc_id"] for r in repeats.packed_texts(docs, repeats.slots_of(ids)).collect()}
    assert set(range(0, 5000, 7)) <= left and len(left) < 900
    assert repeats.packed_texts(docs, repeats.slots_of(ids.filter("false"))).count() == 0


def test_leftmost_least_by_both_ways(monkeypatch):
    from loanscope.llm import suffix_dedup

    values = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    want = [i + int(np.argmin(values[i:i + 77])) for i in range(len(values) - 76)]
    assert suffix_dedup.leftmost_least(values, 77).tolist() == want
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 4)  # as for a text too long for one number
    assert suffix_dedup.leftmost_least(values, 77).tolist() == want
