"""Operator 5, SentencePiece encoding and decoding: Aho-Corasick and one Viterbi pass.

An Aho-Corasick automaton over the pieces reads a text once; at each position
its output links name all pieces that end there, and each relaxes the best
score of that position.  In a unigram model an edge adds its piece's log
probability.  In a BPE model scores are merge ranks, and a sum of ranks is not
what the model means: there an edge relaxes only if merging its piece's text
with the piece before it would leave exactly these two, which makes the one
path that survives the model's own merges (tested against the library).

Texts are cut where no piece can cross (before runs of spaces, at newlines),
and each distinct cut is encoded once a task.  The table of cuts is emptied
when it is full, so memory is bounded.

Defined results: null counts as empty, which has no ids; a literal U+2581 is
encoded in bytes, so that decoding gives every text back exactly (the library
would make it a space); characters without a piece become bytes, or the
unknown id in models without byte pieces; each row gives a row; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .memory import releasing

#: Default model: a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries of each table that texts fill: about the distinct cuts of a task's texts, twice for cuts.
CACHE = 320000
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


class Model:
    """The pieces of a model file, without the library's encoder."""

    def __init__(self, serialized: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        self.kind = proto.trainer_spec.model_type
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.unknown = proto.trainer_spec.unk_id


class Codec:
    """Encodes and decodes; made once in each Python worker."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.kind, self.dummy, self.unknown = model.kind, model.dummy, model.unknown
        self.text = [p for p, _, _ in model.pieces]
        self.score = [s for _, s, _ in model.pieces]
        self.floor = min(self.score) - 10.0
        self.id = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, _, t in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        newline = any("\n" in p for p in self.id)
        self.cuts = re.compile(r"(?s).+" if crossing else "[^ ]+| +[^ ]*" if newline else "\n| *[^ \n]+| +").findall
        # By piece of the vocabulary, so bounded by it.
        self.grown: dict[str, tuple | None] = {}
        self.size = [len(p) for p in self.text]
        self.known = frozenset(p for p in self.id if len(p) == 1).issuperset
        self.stable: dict[int, bool] = {}
        self.cut: dict[str, bytes] = {}
        self.old_cut: dict[str, bytes] = {}
        self.part: dict[str, bytes] = {}
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.marker = self._pack(self.bytes_of(SPACE))

    def forget(self) -> None:
        """Empties the tables of texts; what was found of pairs of pieces holds for the next task too, as numbers."""
        self.cut, self.old_cut = {}, {}
        self.part.clear()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The model's merges, best score first and leftmost on ties: the definition that `joins` is checked by."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (i := self.id.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if not part[a] or not part[b] or after[a] != b or part[a] + part[b] != whole:
                continue
            part[a], part[b], after[a] = whole, "", after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def growth(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece grows from its characters: the score of each merge, and the last and the first part before each and at the end; None if it does not."""
        if piece not in self.grown:
            part, scores, tails, heads = list(piece), [], [piece[-1:]], [piece[:1]]
            while len(part) > 1:
                best = max(((self.score[i], -a) for a in range(len(part) - 1) if (i := self.id.get(part[a] + part[a + 1])) is not None), default=None)
                if best is None:
                    break
                a = -best[1]
                part[a : a + 2] = [part[a] + part[a + 1]]
                scores.append(best[0])
                tails.append(part[-1])
                heads.append(part[0])
            self.grown[piece] = (scores, tails, heads) if len(part) == 1 else None
        return self.grown[piece]

    def joins(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are: no merge across them is ever the best, leftmost on ties.  Nothing may stand on the left."""
        one, two = self.growth(left) if left else None, self.growth(right)
        if not left or one is None or two is None:
            return not left and two is not None
        (l_scores, tails, _), (r_scores, _, heads) = one, two
        i, j, never = 0, 0, float("-inf")
        while True:
            across = self.id.get(tails[i] + heads[j])
            next_l = l_scores[i] if i < len(l_scores) else never
            next_r = r_scores[j] if j < len(r_scores) else never
            if across is not None and self.score[across] > next_l and self.score[across] >= next_r:
                return False
            if next_l == never and next_r == never:
                return True
            if next_l >= next_r:
                i += 1
            else:
                j += 1

    def viterbi(self, text: str) -> list[int]:
        """One pass over `text`, spaces already marked; best path as ids."""
        if self.kind == BPE and self.known(text):
            return self._merged_path(text)
        return self._scored_path(text)

    def _merged_path(self, text: str) -> list[int]:
        """The path of a model of merges through known characters: an edge relaxes its end if the merges keep it apart from the piece before."""
        sizes, stable, many = self.size, self.stable, len(self.size)
        known = stable.get
        # One place behind, so that ends are as the automaton counts them.
        last: list = [None] * (len(text) + 1)
        last[-1] = -1
        for end, piece in self.automaton.iter(text):
            if last[end] is not None:
                continue
            left = last[end - sizes[piece]]
            if left is None:
                continue
            key = left * many + piece
            apart = known(key)
            if apart is None:
                if len(stable) >= CACHE:
                    stable.clear()
                apart = stable[key] = self.joins(self.text[left] if left >= 0 else "", self.text[piece])
            if apart:
                last[end] = piece
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(piece := last[at])
            at -= sizes[piece]
        return ids[::-1]

    def _scored_path(self, text: str) -> list[int]:
        """The path of best scores, or of merges where characters are unknown."""
        n, bpe = len(text), self.kind == BPE
        best: list = [None] * (n + 1)
        best[0] = (0.0, 0, None, "")
        found = self.automaton.iter(text)
        end, piece = next(found, (n, None))
        for at in range(n):
            while end == at:
                start = at + 1 - len(self.text[piece])
                here, come = best[at + 1], best[start]
                if come is not None:
                    if bpe:
                        if here is None and self.joins(come[3], self.text[piece]):
                            best[at + 1] = (0.0, start, piece, self.text[piece])
                    elif here is None or come[0] + self.score[piece] > here[0]:
                        best[at + 1] = (come[0] + self.score[piece], start, piece, self.text[piece])
                end, piece = next(found, (n, None))
            if text[at] not in self.id and best[at + 1] is None and best[at] is not None:
                best[at + 1] = (best[at][0] + self.floor, at, None, text[at])
        ids: list[int] = []
        at = n
        while at:
            _, start, piece, body = best[at]
            ids += [piece] if piece is not None else self.bytes_of(body)[::-1]
            at = start
        return ids[::-1]

    def _of_cut(self, cut: str) -> bytes:
        packed = self.cut.get(cut)
        if packed is None:
            packed = self.old_cut.get(cut)
            if packed is None:
                packed = b"".join(map(self._of_part, self._parts(cut.replace(" ", SPACE))))
            if len(cut) < 256:
                # What was asked for since the table was last full outlives the next time.
                if len(self.cut) >= CACHE:
                    self.cut, self.old_cut = {}, self.cut
                self.cut[cut] = packed
        return packed

    def _parts(self, text: str) -> list[str]:
        """Cuts between neighbours that no piece holds side by side."""
        pairs = self.pairs
        ends = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        if not ends:
            return [text]
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)], strict=True)]

    def _of_part(self, part: str) -> bytes:
        packed = self.part.get(part)
        if packed is None:
            if len(self.part) >= CACHE:
                self.part.clear()
            packed = self._pack(self.viterbi(part))
            if len(part) < 256:
                self.part[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        if self.dummy:
            text = " " + text
        made, make = self.cut.get, self._of_cut
        return self.marker.join(b"".join([made(cut) or make(cut) for cut in self.cuts(part)]) for part in text.split(SPACE))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(model) -> Codec:
    """The worker's codec for a broadcast model."""
    key = id(model.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model.value)
    return _codecs[key]


def _coder(model, columns: tuple[str, ...]):
    fields = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            text = grams.as_text(b.column(1))
            for lo, hi in grams.slices(text):
                out: list[tuple] = []
                for t in text[lo:hi].to_pylist():
                    packed = c.encode(t)
                    ids = np.frombuffer(packed, "<i4")
                    decoded = c.decode(ids.tolist())
                    more = {"ids": ids, "decoded": decoded}
                    out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == t, *[more[x] for x in columns]))
                types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), *[fields[x] for x in columns]]
                arrays = []
                for values, kind in zip(zip(*out, strict=True), types, strict=True):
                    if pa.types.is_list(kind):
                        ends = np.cumsum([0, *map(len, values)], dtype=np.int64).astype(np.int32)
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values))))
                    else:
                        arrays.append(pa.array(list(values), kind))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *arrays], names=["doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip", *columns])
        # Another operator may be the next to use this worker.
        c.forget()

    return code


def sentencepiece(docs: DataFrame, model: str = MODEL, columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Ids of every text and what decoding them gives.

    docs: doc_id long, text string; model: path of a model file, read by the
    driver.  Returns doc_id, n_tokens, ids_sha256 (of little-endian int32),
    text_sha256 (of the decoded text), round_trip (decoded = text) and the
    asked columns of ids array<int> and decoded string.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Model(f.read()))
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean" + "".join(f", {c} {kinds[c]}" for c in columns)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(_coder(shared, columns)), schema)
