"""N-gram Jaccard join (operator 1) in the metric space of shingle sets.

Sets of word shingles with the Jaccard distance form a metric space; texts
link when their distance is at most r = 1 - percent / 100.

Pivots and regions.  With whole documents as pivots alone, unrelated texts
are all at distance near 1 from every pivot, and the window of the triangle
inequality would copy each into every region.  The space is therefore first
cut by projections.  A node of a binary trie over shingle hashes restricts
every set to the shingles below it.  If two sets are within r, then at every
split one half has them within r too (the whole's similarity is a weighted
mean of the halves').  Following those halves down, the restrictions become so
small that "within r" means "equal": up to ``small`` shingles.  There each
restricted set is a pivot at distance 0 of its documents, everything else
lies beyond r, and the Voronoi regions are the groups of documents with equal
restrictions.  A document is copied into the region of each of its leaves
(one per about five shingles), which is the whole window; ``repeats`` finds
the regions with two or more documents.  Every linked pair shares a region.

Joining a region.  Its pivot is now a document, the member found in most
regions (the text the others were copied from, as a rule).  All members'
exact distances to it are computed.  Members within r are linked to the pivot
and so in its class; the others form a region again, with a pivot of their
own, ``ROUNDS`` times.  Pairs of a region that are in different classes after
that are compared, but only inside the window of the triangle inequality:
|d(x, p) - d(y, p)| <= r for the first pivot p.  A pair that shares several
regions is tried in the least of those that both members name (each names its
``FIRSTS`` least) and in any lesser one.  Regions over ``BLOCK`` members are cut into blocks
and every two blocks meet in a task of their own, so no task holds a hot
region; nothing is dropped.

Before two texts are compared, three bounds of the metric are tried: sizes,
the window, and the count vectors of both sets over hash classes, whose L1
distance never exceeds the symmetric difference (inside a region one member
is tried against a whole block at a time).  The exact distance comes
from the whole texts (64-bit shingle hashes).

Equal sets are one member throughout, so copies cost one row each.  Classes
(``component_id``: the smallest doc_id reachable by links) come from connected
components over the links.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer
words than a shingle is one shingle; null, empty and wordless texts have the
empty set and link with nothing.  Rows repeating a doc_id must agree on the
text.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.graph import components
from loanscope.llm.repeats import buckets_for, packed_texts, repeated, slots_of, unpacked, unpacked_length
from loanscope.llm.tables import among, read_table, scratch, with_columns_free, with_null_ids, without, written
from loanscope.llm.textbatch import LOWER, Rolling, mix64, release_memory, slices, text_buffers, word_hashes, words

SHINGLE = 3
PERCENT = 90
BLOCK = 1024
FIRSTS = 8  # regions a member names, so that a pair is tried in one of them
FEW = 250_000  # ids that are broadcast
ROUNDS = 2  # pivots tried per region before its open pairs are compared


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text: (hashes, bounds)."""
    low = LOWER[data]
    start, end, bounds = words(low, offs)
    h = word_hashes(low, start, end)
    roll = Rolling(h, base=0x8CB92BA72F3D8DD7)
    n = np.diff(bounds)
    parts, size = [], np.zeros(len(n), np.int64)
    for d in np.flatnonzero(n):
        a, m = bounds[d], n[d]
        first = np.arange(a, a + max(1, m - k + 1))
        s = np.unique(mix64(roll.of(first, first + min(k, m)) + np.uint64(min(k, m))))
        parts.append(s)
        size[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))


def small_limit(percent: int) -> int:
    """Largest union size at which similarity over the limit means equal."""
    return (100 - 1) // (100 - percent) if percent < 100 else 1 << 30


def split_size(percent: int) -> int:
    """Sizes from which a restriction is split further."""
    return -(-percent * (small_limit(percent) + 1) // 100)


def cells(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of every set: (keys, bounds).

    A restriction of 1..small shingles is a region if it is the whole set or
    the restriction one level up has at least ``above`` shingles: the first
    node on the way down where a linked pair is equal has a parent where the
    union is larger than ``small``, hence both sides hold at least ``above``.
    """
    small, above = small_limit(percent), split_size(percent)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(hashes), dtype=np.uint64)))
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    doc = np.arange(len(lo))
    top = np.full(len(lo), 1 << 60)
    keys, owners = [], []
    depth = 0
    while len(lo):
        size = hi - lo
        is_region = (size >= 1) & (size <= small) & (top >= above)
        a, b = lo[is_region], hi[is_region]
        keys.append(mix64(total[b] - total[a] + (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
                          + np.uint64(depth + 1)))
        owners.append(doc[is_region])
        if depth == 64:
            break
        split = size >= above
        lo, hi, doc, size = lo[split], hi[split], doc[split], size[split]
        bit = (hashes >> np.uint64(63 - depth)) & np.uint64(1)
        ones = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        mid = hi - (ones[hi] - ones[lo])
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        doc, top = np.concatenate((doc, doc)), np.concatenate((size, size))
        depth += 1
    key, owner = np.concatenate(keys), np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return key[by], np.searchsorted(owner[by], np.arange(len(bounds)))


def sketch(s: np.ndarray) -> bytes:
    """Counts (up to 255) of a sorted set over 2**j classes of the top hash
    bits, about two shingles a class."""
    j = max(4, int(len(s) // 2).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - j)).astype(np.int64), minlength=1 << j), 255) \
        .astype(np.uint8).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    while len(x) != len(y):
        if len(x) > len(y):
            x = np.minimum(x[0::2] + x[1::2], 255)
        else:
            y = np.minimum(y[0::2] + y[1::2], 255)
    return int(np.abs(x - y).sum())


def nibbles(sketch: bytes) -> bytes:
    """A sketch with counts up to 15, two a byte, to be stored and moved: the
    distance stays a lower bound."""
    v = np.minimum(np.frombuffer(sketch, np.uint8), 15)
    return (v[0::2] << 4 | v[1::2]).tobytes()


def counts(packed: bytes) -> bytes:
    """The sketch that ``nibbles`` has packed."""
    v = np.frombuffer(packed, np.uint8)
    return np.stack((v >> 4, v & 15), 1).tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches over ``width`` classes (shorter ones stay zero: see ``ruled_out``)."""
    out = np.zeros((len(sketches), width), np.int16)
    for i, s in enumerate(sketches):
        if len(s) >= width:
            out[i] = np.minimum(np.frombuffer(s, np.uint8).reshape(width, -1).sum(1, dtype=np.int64), 255)
    return out


def ruled_out(i: int, j: np.ndarray, n: np.ndarray, fold: np.ndarray, has: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` for one row against many at one width: True only where
    the rows cannot link.  Rows with fewer classes than the width (``has``
    false) are left to ``may_link``."""
    if not has[i]:
        return np.zeros(len(j), bool)
    apart = np.abs(fold[j] - fold[i]).sum(1, dtype=np.int64)
    return has[j] & ((100 + percent) * apart > (100 - percent) * (n[j] + n[i]))


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if two sets cannot link: the symmetric difference of linked
    sets is at most (100 - percent) / (100 + percent) of their sizes' sum."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    return (100 + percent) * sketch_distance(a, b) <= (100 - percent) * (na + nb)


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch."""
    def run(batches):
        for b in slices(batches):
            h, bounds = shingle_sets(*text_buffers(b.column(1)), k)
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0x51ED270B)), dtype=np.uint64)))
            other = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h + np.uint64(0x2545F491)), dtype=np.uint64)))
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                 pa.array((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)),
                 pa.array([nibbles(sketch(h[x:y])) if y > x else b"" for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary")


def _regions(rows: DataFrame, members: DataFrame, copies: DataFrame, k: int, percent: int) -> DataFrame:
    """(cell, doc_id, pivot, members, pop: the document's regions) of the regions
    with two or more members; regions with the same members are one.  The keys are many and do not compress, so
    they are taken from the texts when they are dealt and stored nowhere else;
    the texts move, compressed, only if there are over ``FEW`` ``copies``."""
    def entries(col):
        return cells(*shingle_sets(*text_buffers(col), k), percent)

    def packed_entries(col):
        texts = unpacked(col)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        return cells(*shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offs, k), percent)

    def each(table: pa.Table) -> pa.Table:
        blobs = table.column("hash").to_pylist()
        ids = np.repeat(table.column("doc_id").to_numpy(), [len(x) // 8 for x in blobs])
        return pa.table({"cell": pa.array(np.frombuffer(b"".join(blobs), np.int64)), "doc_id": pa.array(ids, pa.int64())})

    n, shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # leaves of a trie that splits from ``above`` on hold about 0.7 times as many
    keys = n + int(shingles / max(1.0, 0.7 * (split_size(percent) - 1)))
    each_as = {"buckets": buckets_for(64 * keys), "then": each, "schema": "cell bigint, doc_id bigint"}
    if copies.count() <= FEW:
        # one Python worker a task: it takes the texts as they are read
        found = repeated(rows.join(F.broadcast(copies), "doc_id", "left_anti").select("doc_id", "text"), entries, **each_as)
    else:
        found = repeated(packed_texts(rows).join(copies, "doc_id", "left_anti"), packed_entries,
                         length=unpacked_length, **each_as)
    # a document's keys meet once, for the distinct ones and their number
    flat = written(
        found.groupBy("doc_id").agg(F.collect_set("cell").alias("cells"))
        .select("doc_id", F.size("cells").alias("pop"), F.explode("cells").alias("cell")), "cells")
    same = ["n", "h1", "h2", "lo", "hi"]
    shape = flat.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h1"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.max(F.struct("pop", (-F.col("doc_id")).alias("neg"))).alias("best"))
    # regions with the same members have the same pivot
    one = shape.filter("n > 1").groupBy(*same).agg(F.min("cell").alias("cell"), F.max("best").alias("best")).select(
        "cell", (-F.col("best.neg")).alias("pivot"), F.col("n").alias("members"))
    return written(flat.join(one, "cell").select("cell", "doc_id", "pivot", "members", "pop"), "regions")


class _SetCache:
    """Shingle sets of recently met texts."""

    def __init__(self, k: int, size: int = 128):
        self.k, self.size, self.known = k, size, OrderedDict()

    def get(self, doc: int, text: bytes) -> np.ndarray:
        s = self.known.get(doc)
        if s is None:
            s, _ = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64), self.k)
            self.known[doc] = s
            if len(self.known) > self.size:
                self.known.popitem(last=False)
        else:
            self.known.move_to_end(doc)
        return s


def _filtered(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bounds of the metric do not rule out."""
    side = members.select("doc_id", "n_shingles", "sketch")
    for c in ("a", "b"):
        pairs = pairs.join(side.toDF(c, f"n{c}", f"s{c}"), c)
    pairs = pairs.select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for x in batches:
            _, _, na, nb, sa, sb = (c.to_pylist() for c in x.columns)
            ok = [may_link(m, n, counts(s), counts(t), percent) for m, n, s, t in zip(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays(
                [x.column(0).filter(pa.array(ok, pa.bool_())), x.column(1).filter(pa.array(ok, pa.bool_()))],
                names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _distances(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, inter, uni): exact sizes of intersection and union."""
    joined = pairs.join(texts.toDF("a", "za"), "a").join(texts.toDF("b", "zb"), "b").select("a", "b", "za", "zb")

    def run(batches):
        cache = _SetCache(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                x = batch.slice(lo, 256)
                rows = []
                for a, b, ta, tb in zip(x.column(0).to_pylist(), x.column(1).to_pylist(),
                                        unpacked(x.column(2)), unpacked(x.column(3))):
                    sa, sb = cache.get(a, ta), cache.get(b, tb)
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    rows.append((a, b, both, len(sa) + len(sb) - both))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["a", "b", "inter", "uni"])
        del cache
        release_memory()

    return joined.mapInArrow(run, "a bigint, b bigint, inter bigint, uni bigint")


def _rest(open_: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a region's members that its pivots leave open (``open_`` has
    cell, doc_id, members, linked, label and the distances to the first
    pivot)."""
    # blocks of a large region: every two meet under a key of their own
    blocks = F.ceil((F.col("members") - 1) / BLOCK).cast("int")
    firsts = open_.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("cell")), 1, FIRSTS).alias("firsts"))
    dealt = (
        open_.withColumn("blk", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("cell", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk",
                "doc_id", "label", "inter", "uni")
        .join(members.select("doc_id", "n_shingles", "sketch").join(firsts, "doc_id"), "doc_id")
        .withColumn("firsts", F.expr("filter(firsts, c -> c < cell)"))  # the others decide nothing here
    )
    rows = int(open_.agg(F.sum(blocks)).first()[0] or 0)  # after the explode
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(max(64, rows // 5000))))

    def run(table: pa.Table) -> pa.Table:
        key = [table.column(c).to_numpy() for c in ("y", "x", "cell")]
        order = np.lexsort(key)
        cell = np.stack([k[order].astype(np.int64) for k in key])
        edge = np.append(np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0))), len(order))
        doc, n, blk, label = (table.column(c).to_numpy(zero_copy_only=False)[order]
                              for c in ("doc_id", "n_shingles", "blk", "label"))
        inter, uni = (table.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("inter", "uni"))
        far = 1 - inter / uni  # NaN where the distance to the pivot was not needed
        raw = table.column("sketch").to_pylist()
        sketches = [counts(raw[q]) for q in order]
        named = table.column("firsts").to_pylist()
        named = [frozenset(named[q]) for q in order]
        classes = np.array([len(x) for x in sketches], np.int64)
        # coarse first: most pairs fall at 16 classes, nearly all others at 128
        levels = [(folded(sketches, w), classes >= w) for w in (16, 128)]
        r = 1 - percent / 100 + 1e-9
        out: set[tuple[int, int]] = set()
        for lo, hi in zip(edge[:-1], edge[1:]):
            left = np.arange(lo, hi)
            across = cell[0, lo] != cell[1, lo]
            first = left[blk[left] == cell[1, lo]] if across else left
            second = left[blk[left] == cell[0, lo]] if across else left
            for i in first:
                j = second if across else np.arange(i + 1, hi)
                ok = label[j] != label[i]
                ok &= (100 * n[j] >= percent * n[i]) & (100 * n[i] >= percent * n[j])
                ok &= ~(np.abs(far[j] - far[i]) > r)
                j = j[ok]
                for fold, has in levels:
                    j = j[~ruled_out(i, j, n, fold, has, percent)]
                for q in j:
                    if named[i] & named[q]:
                        continue  # both are in that region too
                    a, b = sorted((int(doc[i]), int(doc[q])))
                    if (a, b) not in out and may_link(n[i], n[q], sketches[i], sketches[q], percent):
                        out.add((a, b))
        pairs = sorted(out)
        del raw, sketches, named, levels, out
        release_memory()
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()),
                         "b": pa.array([p[1] for p in pairs], pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, "a bigint, b bigint").distinct()


def _star_round(regions: DataFrame, texts: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, inter, uni) of every member a and its region's pivot b, where
    the bounds allow a link."""
    # dealt by a once, for the distinct pairs and the join with a's sketch
    star = regions.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")) \
        .repartition("a").distinct()
    near = written(_filtered(star, members, percent), "near")
    return written(_distances(near, _named_in(texts, near), shingle), "star")


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, absorb: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, links).

    sets: doc_id, n_shingles, member (the smallest doc_id with the same set;
    null for the empty set).  links: pairs (a, b) of members within the
    limit.  With ``absorb`` (enough for classes) members of one class found
    by the pivots are not compared again, and links between two such classes
    are reported once, between their smallest members; without it every link
    is there.
    """
    rows = with_columns_free(docs, id_col, text_col)
    sets = written(_sets(rows, shingle), "sets")
    named = written(sets.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("member")),
                    "named")
    of = written(sets.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
                 .select("doc_id", "n_shingles", "member"), "of")
    members = named.select(F.col("member").alias("doc_id"), "n_shingles")
    copies = of.filter("doc_id <> member").select("doc_id")
    regions = _regions(rows, members, copies, shingle, percent)
    # what the rounds need of the members found in regions, written once: they
    # join these and not all texts and sketches again
    inside = regions.select("doc_id").distinct()
    # (texts that are surely in no region are left out before the shuffle)
    zipped = packed_texts(rows, slots_of(inside)).join(inside, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sketches = sets.join(inside, "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch")
    found = written(zipped.join(sketches.dropDuplicates(["doc_id"]), "doc_id"), "inside")
    texts, members = found.select("doc_id", "z"), found.select("doc_id", "n_shingles", "sketch")
    limit = F.expr(f"100 * inter >= {percent} * uni")

    first = _star_round(regions, texts, members, shingle, percent)
    measured = first
    far = first.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "inter", "uni")
    open_ = (
        regions.filter("members > 2 AND doc_id <> pivot").join(far, ["doc_id", "pivot"], "left")
        .withColumn("linked", F.coalesce(limit, F.lit(False)))
    )
    label = F.col("doc_id")
    if absorb:
        # the region's members that its pivot did not reach get a pivot of
        # their own, and so on
        left = written(open_.filter("NOT linked").select("cell", "doc_id", "pop"), "left")
        for _ in range(ROUNDS - 1):
            best = left.groupBy("cell").agg(
                F.max(F.struct("pop", (-F.col("doc_id")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("size"))
            again = written(left.join(best.filter("size > 1"), "cell").select(
                "cell", "doc_id", "pop", (-F.col("best.neg")).alias("pivot")), "again")
            more = _star_round(again, texts, members, shingle, percent)
            measured = measured.unionByName(more)
            reached = more.filter(limit).select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"))
            left = written(again.filter("doc_id <> pivot").join(reached, ["doc_id", "pivot"], "left_anti")
                           .select("cell", "doc_id", "pop"), "left")
        classes = written(components(measured.filter(limit).select(F.col("a").alias("u"), F.col("b").alias("v"))),
                          "classes")
        named_by = classes.toDF("doc_id", "class")
        open_ = open_.join(named_by, "doc_id", "left")
        label = F.coalesce("class", "doc_id")
        # regions whose members (the pivot aside) are all of one class are done
        several = open_.groupBy("cell").agg(F.min(label).alias("x"), F.max(label).alias("y")).filter("x <> y")
        open_ = open_.join(several.select("cell"), "cell", "left_semi")
    open_ = written(open_.withColumn("label", label).select("cell", "doc_id", "members", "label", "inter", "uni"),
                    "open")
    known = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(_rest(open_, members, percent).join(known, ["a", "b"], "left_anti"), "rest")
    found = measured.unionByName(_distances(rest, _named_in(texts, rest), shingle)).filter(limit).select("a", "b")
    if absorb:
        for c in ("a", "b"):
            names = classes.toDF(c, f"class_{c}")
            found = found.join(names, c, "left").withColumn(f"class_{c}", F.coalesce(f"class_{c}", c))
        between = found.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
        found = between.filter("a <> b").unionByName(classes.filter("vertex <> component").toDF("a", "b"))
    return of, written(found.distinct(), "links")


def _named_in(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the documents in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return among(texts, ids)


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.  A row with a null
    doc_id is a document that comes after all others: its component_id is null
    only if no doc_id is in its class."""
    rows = with_columns_free(docs, "doc_id", "text")
    return with_null_ids(rows, lambda rows: _jaccard_classes(rows, shingle, percent), ids=("doc_id", "component_id"))


def _jaccard_classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    with scratch(docs.sparkSession):
        of, links = jaccard_join(docs, shingle, percent)
        classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = of.join(classes, of["member"] == classes["vertex"], "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "member", "doc_id").alias("component_id"))
        return written(found, "components", keep=True)


def kept_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class (the smallest doc_id), all columns.  A row
    with a null doc_id comes after all that have one: it stays only if its
    class has no doc_id, and then one of them does."""
    def kept(docs: DataFrame) -> DataFrame:
        classes = jaccard_classes(docs, shingle, percent)
        return without(docs, classes.select("doc_id", F.expr("doc_id = component_id").alias("kept")))

    return with_null_ids(docs, kept)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLE = {}
