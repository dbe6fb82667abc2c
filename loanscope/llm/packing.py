"""Packing (operator 10): cost-balanced packing into training sequences.

``tokenise`` turns every text into token ids plus an end id and cuts them
into pieces: as many of ``capacity`` tokens as there are, and a rest, which is
cut once at a multiple of ``STEP`` tokens (the even parts fill sequences
without a gap, the small tails fill what is left).  Ids exist only inside that task; a piece carries its length and a CRC-32.

``pack`` assigns pieces to sequences.  A piece of n tokens costs
``linear * n + quadratic * n * n`` (attention looks inside a document only).
Pieces are numbered in the order of doc_id, start and checksum and dealt in
turn to groups of at most ``GROUP`` pieces, so that every group is bounded,
whatever is repeated, and packs on its own; a group starts with as many
empty sequences as its tokens need at least, takes its pieces in descending
order and gives each to the sequence of lowest cost so far that has room for
it, or to a new one if none has.  Ties go to the smaller doc_id and start, and
to the sequence opened first, so the result does not depend on partitioning.
The open end of a group is at most the sequences it needs beyond the minimum;
the number of groups follows the number of pieces.

Token ids.  The query and the pipeline give the ids of ``Tokenizer
.from_file(path).encode(text, add_special_tokens=False)``: the string of an
added token (``<|endoftext|>``) in a text becomes that token's id.  Without
``added_tokens`` the string is ordinary text.  Given the same vocabulary as a
rank file (``ranks_path``), texts are encoded from the ranks, which is faster;
texts with an added token's string, or with a run of ``SPACES`` white space signs
(on which that engine runs out of stack), are left to the tokeniser.  The tests
compare both over every code point.  Nothing is kept from text to text.

Null and empty texts are one piece with the end id alone.  Repeated rows are
packed like any others.  A null doc_id stays null; its pieces come after all
others of their length, ordered by their CRC-32.  An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.order_sums import ranked
from loanscope.llm.tables import read_table, with_columns_free, written
from loanscope.llm.textbatch import slices

CAPACITY = 2048
END_ID = 1
GROUP = 8192
# Attention is quadratic; one unit of quadratic cost per token pair against
# the linear layers' cost per token.
LINEAR, QUADRATIC = 4096.0, 1.0
STEP = 512  # the rest of a document is cut once, at a multiple of this
SPACES = 200
_LAST = (1 << 63) - 1  # where a null doc_id is sorted

_LONG_SPACE = re.compile(r"\s{%d}" % SPACES)
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str, added_tokens: bool = False, ranks_path: str | None = None, pattern: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens  # if set, their strings are ordinary text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.strings = tuple(t.content for t in added) if added_tokens else ()
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(s in text for s in self.strings) or _LONG_SPACE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = False, ranks_path: str | None = None, pattern: str = "") -> Encoder:
    """The encoder of a tokeniser file, loaded once per Python worker."""
    return Encoder(path, added_tokens, ranks_path, pattern)


def cuts(total: int, capacity: int, step: int):
    """(start, stop) of the pieces of a document."""
    whole = total // capacity * capacity
    even = total // step * step
    edges = [*range(0, whole + 1, capacity), *([even] if even > whole else []), *([total] if total > even else [])]
    return zip(edges, edges[1:])


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, step: int = STEP,
             id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False,
             ranks_path: str | None = None, pattern: str = "") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = array("I", [end_id]).tobytes()  # 32-bit, in the machine's (little-endian) order

    def run(batches):
        enc = encoder(path, added_tokens, ranks_path, pattern)
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.encode(text or "") + end
                total = len(raw) // 4
                for start, stop in cuts(total, capacity, step):
                    part = raw[4 * start:4 * stop]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return with_columns_free(docs, id_col, text_col).mapInArrow(run, _PIECES)


def assign(length: np.ndarray, capacity: int, linear: float, quadratic: float):
    """(sequence, offset) of pieces given in descending order of length."""
    n = len(length)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = int(np.searchsorted(-length, -capacity, side="right"))
    seq[:full] = np.arange(full)
    rest = length[full:]
    need = -(-int(rest.sum()) // capacity)
    used = np.zeros(max(need, 1) + len(rest), np.int64)
    cost = np.zeros(len(used))
    opened = max(need, 1)
    for i, size in enumerate(rest.tolist()):
        room = np.flatnonzero(used[:opened] <= capacity - size)
        if len(room):
            s = int(room[np.argmin(cost[room])])
        else:
            s, opened = opened, opened + 1
        seq[full + i], offset[full + i] = full + s, used[s]
        used[s] += size
        cost[s] += linear * size + quadratic * size * size
    return seq, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP,
         linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (read three times)."""
    groups = max(1, -(-pieces.count() // group))
    # equal pieces are interchangeable, so any order among them will do
    order = [F.coalesce("doc_id", F.lit(_LAST)), F.col("start"), F.col("ids_crc32"),
             F.xxhash64(F.monotonically_increasing_id())]
    dealt = ranked(pieces, order, [F.col(c) for c in pieces.columns])

    def run(table: pa.Table) -> pa.Table:
        cols = [pc.fill_null(table.column(c), _LAST).to_numpy() for c in ("doc_id", "start", "length", "ids_crc32")]
        order = np.lexsort((cols[3], cols[1], cols[0], -cols[2]))
        table = table.take(pa.array(order))
        seq, offset = assign(cols[2][order], capacity, linear, quadratic)
        number = table.column("grp").to_numpy()[0]
        out = table.drop_columns(["grp"]).combine_chunks()
        return out.append_column("sequence_id", pa.array((number << 32) + seq)) \
            .append_column("offset", pa.array(offset))

    return (
        dealt.withColumn("grp", F.pmod("rank", F.lit(groups))).drop("rank")
        .groupBy("grp").applyInArrow(run, _PIECES + ", sequence_id bigint, offset bigint")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, added_tokens: bool = False,
                   ranks_path: str | None = None, pattern: str = "") -> DataFrame:
    """Tokenise, store the pieces, pack."""
    pieces = tokenise(docs, path, capacity, added_tokens=added_tokens, ranks_path=ranks_path, pattern=pattern)
    return pack(written(pieces, "pieces"), capacity)


def tokenizer() -> dict:
    """The arguments that name the public tokeniser, its ranks and its pattern."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def tokenizer_path() -> str:
    return tokenizer()["path"]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), added_tokens=True, **tokenizer())


QUERIES = {"op10_packing": op10_packing}
ORACLE = {}
