"""Which hashes of a corpus occur more than once, counted in Spark.

An operator turns every text into a list of 64-bit hashes (of token windows,
of content-defined runs, of cells).  ``repeated`` finds the entries whose hash
occurs at least twice in the whole corpus:

1. In a task, a slice of texts becomes arrays.  Entries with equal hashes
   within the slice are combined: the first stands for all (so a hash held
   by a third of all entries costs one entry per slice, not a hot key), the
   others are known to be repeated and are passed on directly.
2. The representatives are dealt by hash into ``buckets``, one binary row per
   slice and bucket (8 bytes a hash, the position as byte planes that
   compress to about one byte).  A bucket holds a bounded number of entries:
   their number follows the size of the corpus.
3. Each bucket counts its hashes (``applyInArrow`` on the bucket's rows).  A
   representative whose hash occurs again elsewhere is repeated; for hashes
   repeated inside a slice only, step 1 knows the same.

The result names entries by (doc_id, index of the entry in its text), packed
per document and bucket: index blobs are int32 arrays, hash blobs uint64
arrays, in the same order.  Equality of hashes is equality of the 64 bits and
of the bucket's bits, which come from a second mix of the same hash.

Repeated doc_ids are told apart only if the operator treats them as rows of
their own; the operators here define what a repeated id means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.tables import SLOTS
from loanscope.llm.textbatch import ids_of, mix64, slices, text_buffers

# Bytes of text per bucket; a bucket's arrays then take a few ten MB.
BUCKET_BYTES = 12 << 20
MIN_BUCKETS = 64

FOUND = "doc_id bigint, idx binary, hash binary"
_DEALT = "bucket int, docs binary, counts binary, idx binary, hash binary"


def buckets_for(n_bytes: int, per_bucket: int = BUCKET_BYTES) -> int:
    return max(MIN_BUCKETS, -(-n_bytes // per_bucket))


def planes(values: np.ndarray) -> bytes:
    """uint32 values as four byte planes (the high ones are mostly zero and
    compress away in the shuffle)."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _group_rows(doc: np.ndarray, idx: np.ndarray, hashes: np.ndarray, doc_ids: np.ndarray):
    """Entries sorted by doc, as one FOUND row per document."""
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    stop = np.append(edge[1:], len(doc)) if len(doc) else edge
    idx = idx.astype("<i4")
    return (
        [int(doc_ids[doc[a]]) for a in edge],
        [idx[a:b].tobytes() for a, b in zip(edge, stop)],
        [hashes[a:b].tobytes() for a, b in zip(edge, stop)],
    )


def repeated(docs: DataFrame, entries: Callable, buckets: int, length: Callable = pc.binary_length,
             then: Callable | None = None, schema: str = FOUND) -> DataFrame:
    """FOUND rows of ``docs``: doc_id and one string or binary column that
    ``entries(array)`` turns into (hashes, bounds); the entries of row d are
    hashes[bounds[d]:bounds[d+1]].  Slices are bounded by the ``length`` of that
    column's values.  ``then`` turns the FOUND table of a bucket's rows into one of
    ``schema`` in the same Python worker."""
    value = docs.columns[1]

    def deal(batches):
        for b in slices(batches, value, length=length):
            ids = ids_of(b)
            hashes, bounds = entries(b.column(1))
            if len(hashes) == 0:
                continue
            doc = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(bounds))
            idx = np.arange(len(hashes), dtype=np.int64) - bounds[doc]
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            same = np.append(False, h[1:] == h[:-1])
            again = same | np.append(same[1:], False)
            # known repeated inside the slice: all of them, the first included
            known = np.sort(order[again])
            if len(known):
                d, i, x = _group_rows(doc[known], idx[known], hashes[known], ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(d), -1 - (len(d) and d[0] % buckets), np.int32)),
                     pa.array([np.int64(k).tobytes() for k in d], pa.binary()), pa.array([b""] * len(d), pa.binary()),
                     pa.array(i, pa.binary()), pa.array(x, pa.binary())],
                    names=["bucket", "docs", "counts", "idx", "hash"])
            # representatives, in the order of the texts; those of hashes that
            # are known to repeat carry a flag
            reps = np.sort(order[~same])
            flag = np.zeros(len(hashes), bool)
            flag[known] = True
            target = (mix64(hashes[reps] ^ np.uint64(0xA5A5A5A5DEADBEEF)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            reps, target = reps[by], target[by]
            cut = np.searchsorted(target, np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                r = reps[cut[k]:cut[k + 1]]
                if not len(r):
                    continue
                d = doc[r]
                first = np.append(True, d[1:] != d[:-1])
                at = np.flatnonzero(first)
                step = np.diff(idx[r], prepend=0)
                step[at] = idx[r][at]
                out.append((k, ids[d[at]].astype("<i8").tobytes(),
                            np.diff(np.append(at, len(r))).astype("<i4").tobytes(),
                            planes(step * 2 + flag[r]), hashes[r].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32())] + [pa.array([o[i] for o in out], pa.binary())
                                                               for i in range(1, 5)],
                names=["bucket", "docs", "counts", "idx", "hash"])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        docs_, counts, idx, hashes = (table.column(c).to_pylist() for c in ("docs", "counts", "idx", "hash"))
        if bucket < 0:
            return pa.table({
                "doc_id": pa.array([int(np.frombuffer(d, "<i8")[0]) for d in docs_], pa.int64()),
                "idx": pa.array(idx, pa.binary()), "hash": pa.array(hashes, pa.binary())})
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in hashes])
        order = np.argsort(h)
        s = h[order]
        same = np.append(False, s[1:] == s[:-1])
        hit = np.zeros(len(h), bool)
        hit[order] = same | np.append(same[1:], False)
        del order, s, same
        ids, ii, hh = [], [], []
        lo = 0
        for d, c, i, x in zip(docs_, counts, idx, hashes):
            packed = unplanes(i).astype(np.int64)
            take = hit[lo:lo + len(packed)] & (packed & 1 == 0)  # flagged ones were passed on already
            lo += len(packed)
            if not take.any():
                continue
            c = np.frombuffer(c, "<i4")
            doc = np.repeat(np.arange(len(c)), c)
            total = np.cumsum(packed >> 1)
            begin = np.append(0, np.cumsum(c))[:-1]
            pos = total - (total[begin] - (packed[begin] >> 1))[doc]
            a, b, x = _group_rows(doc[take], pos[take], np.frombuffer(x, np.uint64)[take], np.frombuffer(d, "<i8"))
            ids += a
            ii += b
            hh += x
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "idx": pa.array(ii, pa.binary()),
                         "hash": pa.array(hh, pa.binary())})

    found = count if then is None else lambda table: then(count(table))
    return docs.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(found, schema)


def _slot():
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))


def slots_of(ids: DataFrame) -> np.ndarray:
    """Which of ``SLOTS`` hash slots hold a doc_id of ``ids``: a bitmap of 1 MB
    however many ids there are (built in Spark, 256 rows reach the driver).  An
    id whose slot is empty is not among them; with very many ids it says little."""
    word = F.bitmap_construct_agg((F.col("slot") % 32768).cast("bigint"))
    found = ids.select(_slot().alias("slot")).groupBy(F.expr("slot div 32768").alias("at")).agg(word.alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in found.collect():
        out[r["at"] * 4096:(r["at"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def packed_texts(docs: DataFrame, slots: np.ndarray | None = None) -> DataFrame:
    """doc_id and the compressed text (``z``): a third of the bytes for a
    shuffle that has to bring texts to what was found about them.  With
    ``slots`` texts whose doc_id is surely not among those ids are left out."""
    def run(batches):
        for b in slices(batches):
            if slots is not None:
                at = b.column(2).to_numpy()
                b = b.filter(pa.array((slots[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            data, offs = text_buffers(b.column(1))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()),
                 packed(raw[a:e] for a, e in zip(offs[:-1].tolist(), offs[1:].tolist()))], names=["doc_id", "z"])

    cols = ["doc_id", "text"] + ([_slot().alias("slot")] if slots is not None else [])
    return docs.select(*cols).mapInArrow(run, "doc_id bigint, z binary")


def packed(texts: Iterable[bytes]) -> pa.Array:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    return pa.array([z.compress(x) for x in texts], pa.binary())


def unpacked(z: pa.Array) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in z.to_pylist()]


def unpacked_length(z: pa.Array) -> pa.Array:
    """Bytes of every text before packing."""
    import zstandard

    return pa.array([zstandard.frame_content_size(x) for x in z.to_pylist()], pa.int64())


def with_found(texts: DataFrame, found: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Texts joined with everything found about their doc_id (arrays of
    blobs; their total size is bounded by the text's own)."""
    per_doc = found.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in cols])
    return texts.join(per_doc, "doc_id", how)


def total_bytes(docs: DataFrame) -> int:
    return int(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0)
