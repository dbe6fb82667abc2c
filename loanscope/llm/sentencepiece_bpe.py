"""SentencePiece encoding and decoding (operator 6): merge-type prefix table.

For a merge-type (BPE) piece model the encoding of a string is fixed by its
prefixes: every prefix has exactly one last token.  Scanning a string once,
the automaton of all pieces gives at each position the pieces that end there;
the last token of that prefix is the one piece that is compatible with the
last token of the prefix before it.  Two tokens are compatible when encoding
their joined text gives the two tokens again, and a sequence of tokens is the
encoding of its text exactly if all its neighbours are compatible: the first
merge that crossed a border between two of them would cross it in the pair
alone as well.  Following the table back from the end recovers the ids.

A character that is no piece cannot take part in a merge; it stands alone and
becomes one byte token per UTF-8 byte.

Work per text.  No piece holds the word mark after another character and a
line break is no piece (both are verified when a model is loaded), so a text
falls into independent units at its spaces and line breaks.  A unit is encoded
once and kept in a table of bounded size (a bound on memory, not on results), so the work per word of a text is a lookup.

The model file is read from a path given by the caller on every executor (an
installed package, or a file shipped with ``SparkContext.addFile``).

Null and empty texts have no tokens.  A literal word mark character in a text
decodes to a space, as in the library.  Repeated rows are encoded alike;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loanscope.llm.tables import read_table, with_columns_free
from loanscope.llm.textbatch import slices

MARK = "▁"
MEMO = 200_000
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class PieceModel:
    """Encoder and decoder of one BPE piece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("an identity normaliser with a dummy prefix is needed")
        self.pieces = [p.piece for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.ids = {piece: i for piece, (_, i) in self.rank.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word border")
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.first_piece = max(2, *self.byte) + 1  # only plain pieces from here on
        self._pairs: dict[tuple[str, str], bool] = {}
        self._units: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}
        order = sorted(self.rank, key=lambda p: self.rank[p])
        self.order = {p: i for i, p in enumerate(order)}
        self.split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in order:
            parts, (left, right) = self._derive(piece)
            # a piece that is not its own encoding is never a token
            if parts != [piece]:
                continue
            self.automaton.add_word(piece, piece)
            if left:
                self.split[piece] = (left, right)
        self.automaton.make_automaton()
        # pieces whose merges do not come in the order of rank
        self.odd: set[str] = set()
        for piece in sorted(self.split, key=len):
            parts = self.split[piece]
            if MARK * 2 in piece or any(
                p in self.odd or p in self.split and self.order[p] > self.order[piece] for p in parts
            ):
                self.odd.add(piece)
        self._boundary = self._unit_pattern()

    def _unit_pattern(self) -> re.Pattern:
        """Units: marks with what follows them up to the next mark or line
        break, cut further where a run of signs that no piece holds behind a
        letter begins."""
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = "".join(re.escape(c) for c in ".,;:!?%*&$#|\"()" if c not in after_letter)
        if not signs:
            return _UNITS
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
        return re.compile(f"{MARK}+[{letters}]+(?=[{signs}])|[{letters}]+(?=[{signs}])|{_UNITS.pattern}")

    def _derive(self, piece: str):
        """The merging of a piece and its last two parts ("" for a character)."""
        parts = list(piece)
        pair = ("", "")
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [(r[0], i) for i, r in enumerate(ranks) if r is not None]
            if not known:
                break
            _, i = min(known)
            pair = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, pair

    def merge(self, text: str) -> list[str]:
        """Reference merging: the best-ranked neighbours first, leftmost of
        equals, until no neighbours form a piece."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their joined text.

        Where a piece ranks behind its parts, merges happen in the order of
        rank (the few ``odd`` pieces are tested by merging).  So undoing the later-made of the two parts at the border, again and
        again, visits every pair of parts that ever met there.  They would
        have merged if their joined piece ranks before the merge that used
        up the left part and not behind the one that used up the right part
        (of equal ranks the leftmost goes first).
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > MEMO * 4:
                self._pairs.clear()
            known = self._pairs[left, right] = self._test(left, right)
        return known

    def _test(self, left: str, right: str) -> bool:
        if left in self.odd or right in self.odd:
            return self.merge(left + right) == [left, right]
        order, split = self.order, self.split
        left_used = right_used = len(order) + 1
        while True:
            r = order.get(left + right)
            if r is not None and r < left_used and r <= right_used:
                return False
            a, b = order.get(left, -1) if left in split else -1, order.get(right, -1) if right in split else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_used = split[left][1], a
            else:
                right, right_used = split[right][0], b

    def tokens(self, text: str) -> list[str]:
        """The pieces of a string, by the prefix table.  A character that is
        no piece appears as itself."""
        last: list[str] = []
        add, known, ids = last.append, self._pairs.get, self.ids
        n = 0  # the prefix of this length has its last token
        for end, piece in self.automaton.iter(text):
            if end < n:
                continue
            while n < end:
                add(text[n])
                n += 1
            before = end - len(piece)
            if before >= 0:
                prev = last[before]
                ok = known((prev, piece))
                if ok is None:
                    ok = prev not in ids or self.compatible(prev, piece)
                if not ok:
                    continue
            add(piece)
            n += 1
        last.extend(text[n:])
        out = []
        at = len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def ids_of_tokens(self, tokens: list[str]) -> list[int]:
        try:
            return [self.ids[t] for t in tokens]
        except KeyError:
            pass
        out = []
        for t in tokens:
            i = self.ids.get(t)
            if i is None:
                out.extend(self.byte_id[b] for b in t.encode("utf-8"))
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        for u in self.units(text):
            out.extend(self.ids_of_tokens(self.tokens(u)))
        return out

    def units(self, text: str) -> list[str]:
        """The independent units of a text, word marks in place of spaces."""
        if not text:
            return []
        return self._boundary.findall(MARK + text.replace(" ", MARK))

    def decode_pieces(self, ids) -> str:
        """Text of ids with word marks; byte tokens join to characters, and
        bytes that form none become one replacement character each."""
        if min(ids, default=0) >= self.first_piece:
            return "".join([self.pieces[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_decode_bytes(raw))
                raw = bytearray()
            if i > 2:
                out.append(self.pieces[i])
        if raw:
            out.append(_decode_bytes(raw))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of ids, the dummy prefix removed."""
        text = self.decode_pieces(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def unit(self, u: str) -> tuple[str, int, str]:
        """(ids joined by commas; number of ids; decoded text with spaces) of
        a unit, from the task's table: two generations of ``MEMO`` units, the
        older one dropped when the younger is full."""
        found = self._units.get(u)
        if found is None:
            if len(self._units) >= MEMO:
                self._older, self._units = self._units, {}
            found = self._older.get(u)
            if found is None:
                ids = self.ids_of_tokens(self.tokens(u))
                found = (",".join(map(str, ids)), len(ids), self.decode_pieces(ids).replace(MARK, " "))
            self._units[u] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text)."""
        unit = self._units.get
        parts = []
        for u in self.units(text):
            parts.append(unit(u) or self.unit(u))
        if not parts:
            return 0, "", ""
        ids, counts, texts = zip(*parts)
        decoded = "".join(texts)
        return sum(counts), ",".join(ids), decoded[1:] if decoded.startswith(" ") else decoded


def _decode_bytes(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a path, loaded once per Python worker."""
    return PieceModel(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    def run(batches):
        m = model(path)
        for b in slices(batches):
            ids = [[int(i) for i in m.digest(t)[1].split(",") if i] for t in _texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return with_columns_free(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``encode_documents``'s result (null ids: empty)."""
    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([m.decode(i or []) for i in b.column(1).to_pylist()],
                                                         pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded,
    then decoded from the ids, without storing either."""
    def run(batches):
        m = model(path)
        sha = hashlib.sha256
        for b in slices(batches):
            n, ids, decoded = [], [], []
            for t in _texts(b):
                count, joined, text = m.digest(t)
                n.append(count)
                ids.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_columns_free(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE = {}
