"""Operator 1: SentencePiece encoding and decoding by a streaming Viterbi.

The lattice has a node for every boundary between characters and an edge for every piece of the
vocabulary. Each node keeps one backpointer, the survivor: for a unigram model the one of the best summed
score, for a merge (BPE) model the one piece that is compatible with the survivor before it, that is, for
which merging the two pieces' text gives just these two; a text has exactly one path of compatible
pieces, and it is the model's own segmentation. No edge is longer than the longest piece, so only that
many nodes can still be extended; whenever the backpointers of all of them lead over one boundary, the
ids up to it are committed and what lies before is forgotten. The window is so bounded by the text's
longest ambiguity, not by its length.

Between two characters that no piece joins, every path has a boundary, and everything before it is
committed. So texts are cut there, and equal parts between two such commitments are encoded once, all by the
same routine, whatever their length. Characters without a piece become byte pieces. The vocabulary marks blanks with
U+2581 and is decoded back to blanks, so only texts that hold U+2581 itself don't return exactly.

Defined results: null or empty text has no ids and decodes to an empty text; repeated rows are each encoded.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, slices, text_of

BLANK = "▁"
#: Parts and pairs of pieces that a worker remembers; characters of a part that is remembered beyond its batch.
CACHE_PARTS, CACHE_PAIRS, LONGEST_CACHED = 600_000, 400_000, 48


class Vocabulary:
    """Pieces with ids and scores, and the byte pieces for characters that have none."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int] | None = None, unknown: int = 0, merges: bool = True, skip: frozenset[int] = frozenset()):
        self.id = {p: i for i, p in enumerate(pieces) if i not in skip and p}
        self.pieces, self.scores, self.byte_ids, self.unknown, self.merges = pieces, scores, byte_ids, unknown, merges
        self.longest = max(map(len, self.id), default=1)
        # Every ending of a piece, and whether it is one itself: a run of signs that is no such ending ends no piece.
        self.endings = {p[k:]: False for p in self.id for k in range(1, len(p))} | dict.fromkeys(self.id, True)
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.floor = min(scores, default=0.0) - 10.0
        self._pairs: dict[tuple[str, str], bool] = {}
        self._edges: dict[str, tuple | None] = {}
        self._raw = [p.replace(BLANK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids or []):
            self._raw[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file of merges with byte fallback."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i))
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], m.unk_id(), True, special)

    def merged(self, text: str) -> list[tuple]:
        """The merges' result for a short text: again and again the adjacent pair whose piece scores best, the leftmost of equal ones. Each part is a tree: text, left part, right part."""
        parts: list[tuple] = [(c, None, None) for c in text]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k][0] + parts[k + 1][0])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]
        return parts

    def edges(self, piece: str) -> tuple | None:
        """What a piece's left and right edge go through while it is merged, from a character to the whole: pairs of text and rank. None if its text isn't merged to this piece."""
        if piece not in self._edges:
            parts = self.merged(piece)
            both = None
            if len(parts) == 1:
                both = []
                for side in (1, 2):
                    node, way = parts[0], []
                    while node:
                        way.append((node[0], -self.scores[self.id[node[0]]] if len(node[0]) > 1 else -math.inf))
                        node = node[side]
                    both.append(way[::-1])
            self._edges[piece] = both and tuple(both)
        return self._edges[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of both texts together keep them apart and whole: following both edges in the order of ranks, no two pieces that meet are merged before either goes on."""
        key = left, right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._meet(left, right)
        return found

    def _meet(self, left: str, right: str) -> bool:
        a, b = left and self.edges(left), self.edges(right)
        if b is None or a is None:
            return False
        if not left:
            return True
        (_, x), (y, _) = a, b
        i = j = 0
        while True:
            both = self.id.get(x[i][0] + y[j][0])
            rank = math.inf if both is None else -self.scores[both]
            go_x = x[i + 1][1] if i + 1 < len(x) else math.inf
            go_y = y[j + 1][1] if j + 1 < len(y) else math.inf
            if rank < go_x and rank <= go_y and rank < math.inf:
                return False
            if go_x == go_y == math.inf:
                return True
            if go_x <= go_y:
                i += 1
            else:
                j += 1

    def ids_of(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]


def streamed(texts: list[str], v: Vocabulary, on_commit=None) -> Iterator[list[int]]:
    """The ids of each text. Of one that begins like the text before it, the survivors at the boundaries of that beginning are taken over, so texts are best in order.

    Only the nodes from the last commitment on are kept. on_commit, if given, gets the boundary and the number of nodes kept at each commitment within a text.
    """
    vocabulary, longest, merges, pairs, compatible = v.id, v.longest, v.merges, v._pairs, v.compatible
    scores, floor, ids_of, endings = v.scores, v.floor, v.ids_of, v.endings
    before = ""
    base = sure = 0  # nodes before base are forgotten; what made that safe reaches up to sure
    out: list[int] = []  # the ids up to base
    back: list[int] = [0]  # of each node from base on: the boundary its survivor comes from
    last: list[str] = [""]  # and its survivor's piece
    cost: list[float] = [0.0]
    for text in texts:
        k, most = 0, min(len(text), len(before))
        while k < most and text[k] == before[k]:
            k += 1
        if k < sure:
            base = sure = k = 0
            out, back, last, cost = [], [0], [""], [0.0]
        del back[k + 1 - base :], last[k + 1 - base :], cost[k + 1 - base :]
        check = max(k, base + 2 * longest)
        for end in range(k + 1, len(text) + 1):
            low = end - longest
            # The edges that end here, from the shortest on: a sign alone, and pieces.
            b = end - 1
            edges = [(b, text[b:end])]
            stop = low if low > base else base
            while b > stop:
                b -= 1
                p = text[b:end]
                whole = endings.get(p)
                if whole is None:
                    break
                if whole:
                    edges.append((b, p))
            edges.reverse()
            if merges:
                for b, p in edges:  # noqa: B007
                    one = last[b - base]
                    fits = pairs.get((one, p))
                    if compatible(one, p) if fits is None else fits:
                        break
            else:
                best = None
                for x, q in edges:
                    total = cost[x - base] + (scores[vocabulary[q]] if q in vocabulary else floor)
                    if best is None or total > best:
                        b, p, best = x, q, total
                cost.append(best)
            back.append(b)
            last.append(p)
            if end >= check:
                # No edge is longer than the longest piece, so only so many nodes can be extended. The last boundary that all their paths share:
                common = None
                for e in range(max(base + 1, low + 1), end + 1):
                    on = set()
                    while e > base:
                        on.add(e)
                        e = back[e - base]
                    common = on if common is None else common & on
                check = end + longest
                if common:
                    at, found, e = max(common), [], max(common)
                    while e > base:
                        found.append(last[e - base])
                        e = back[e - base]
                    for p in reversed(found):
                        out += ids_of(p)
                    back, last, cost = back[at - base :], last[at - base :], cost[at - base :]
                    base, sure = at, end
                    if on_commit:
                        on_commit(at, len(back))
        found, e = [], len(text)
        while e > base:
            i = vocabulary.get(last[e - base])
            found += ids_of(last[e - base])[::-1] if i is None else (i,)
            e = back[e - base]
        yield out + found[::-1]
        before = text


def viterbi(text: str, v: Vocabulary, on_commit=None) -> list[int]:
    """The ids of one text."""
    return next(streamed([text], v, on_commit))


def parts_of(text: str) -> list[str]:
    """The text with its leading blank, cut where a blank follows another sign."""
    parts = (BLANK + text.replace(" ", BLANK)).split(BLANK)[1:]
    if "" not in parts:
        return parts
    out, blanks = [], ""
    for k, p in enumerate(parts):
        if p or k == len(parts) - 1:
            out.append(blanks + p)
            blanks = ""
        else:
            blanks += BLANK
    return out


class Encoder:
    """Encodes texts with one vocabulary; remembers the ids of parts (without their first blank)."""

    def __init__(self, v: Vocabulary, on_commit=None):
        self.v, self.known, self.on_commit = v, {}, on_commit
        # Where a piece joins a sign and a following blank, parts aren't independent.
        self.apart = v.merges and not any(p[1] == BLANK and p[0] != BLANK for p in v.joined)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes."""
        if not self.apart:
            return [array("i", viterbi(BLANK + t.replace(" ", BLANK), self.v, self.on_commit) if t else []).tobytes() for t in texts]
        known, v = self.known, self.v
        parts = [parts_of(t) if t else [] for t in texts]
        every = set().union(*parts)
        if len(known) + len(every) > CACHE_PARTS:
            known.clear()
        new = list(every.difference(known))
        # Where no piece joins the last two signs, a path has a boundary: a word and its closing sign.
        cut = {p: p[:-1] for p in new if len(p) > 1 and p[-2:] not in v.joined}
        words = {cut.get(p, p) for p in new}.difference(known)
        ordered = sorted(words)
        for w, ids in zip(ordered, streamed([BLANK + w for w in ordered], v, self.on_commit), strict=True):
            known[w] = array("i", ids).tobytes()
        for p, w in cut.items():
            known[p] = known[w] + array("i", v.ids_of(p[-1])).tobytes()
        out = [b"".join([known[p] for p in ps]) for ps in parts]
        for w in {*words, *cut}:
            if len(w) > LONGEST_CACHED:
                known.pop(w, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without its leading blank; byte pieces that are no UTF-8 become U+FFFD."""
        raw = self.v._raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder for a model file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = e.encode([t or "" for t in part.column("text").to_pylist()])
                at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), "<i4")))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            texts = [e.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(None)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                raw = e.encode(texts)
                ids = [np.frombuffer(r, "<i4") for r in raw]
                at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
                back = [e.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(back), pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])

    return text_of(documents(spark, sf_dir)).mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean, ids array<int>")


QUERIES = {"op1_pieces": op1_pieces}
SQL: dict[str, str] = {}
