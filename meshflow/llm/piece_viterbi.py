"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice has a boundary after each character; a transition is a piece of the vocabulary, or a single
character outside it. For a unigram model its score is the piece's log probability, and the path with the
largest sum wins, the earlier start among equals, as sums of single precision like the library's. For a
BPE model a transition from piece u to piece t scores 0 where encoding u + t alone gives [u, t], and minus
infinity elsewhere, which makes the best path the model's own encoding. Models of other kinds are refused.

StreamingViterbi reads a text in chunks. It holds a window: pieces that start more than one maximum piece
length before its end are all known, so that it advances to there, and whatever is still to come can only
start at the boundaries from there on. As soon as the paths of all of these meet in one boundary, the pieces
before it are committed, and the window starts anew at that boundary. Every text and word goes this way.

For BPE, words (a run of word marks and what follows it), and these between two characters that stand side by
side in no piece, are cut, as no piece can span there and all paths meet; words and parts of up to 64
characters are remembered with their ids, which repeat the result of the same part. Words that don't come back
are forgotten: a full memo becomes the older one, and only words that are met again move to the new one.

Defined results: null and empty texts have no ids, and decode to an empty text. Characters that the
vocabulary lacks become byte pieces, or for models without them a run of such characters becomes the unknown
id. Very long texts and words are streamed as any other. Repeated rows give repeated rows, empty tables an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .pair_bpe import MEMO, PrefixEncoder

MARK = "▁"


class StreamingViterbi:
    """Feeds on chunks of text and yields pieces once nothing later can change them."""

    def __init__(self, encoder: PrefixEncoder, scores: list[float] | None = None):
        """scores: of the encoder's pieces, and last that of a character outside the vocabulary; None for BPE."""
        self.encoder, self.reach, self.scores = encoder, encoder.longest, scores
        self.widest = 0  # window at its largest

    def pieces(self, text: str | Iterable[str]) -> Iterator[str]:
        reach, advance = self.reach, self._advance if self.scores is None else self._advance_scored
        chunks = (text[k : k + reach] for k in range(0, len(text), reach)) if isinstance(text, str) else text
        window, last, best, j, looked = "", [-1], [0.0], 0, 0  # last[i]: the last piece up to boundary i of the window
        for chunk in chunks:
            window += chunk
            last += [-1] * len(chunk)
            best += [0.0] * len(chunk)
            if len(window) - reach > j:
                j = advance(window, last, best, j, len(window) - reach)
            if j - looked >= reach:
                self.widest = max(self.widest, len(window))
                cut = self._meet(last, j)
                if cut:
                    yield from self._trace(last, cut)
                    window, last, best, j = window[cut:], last[cut:], best[cut:], j - cut
                looked = j
        advance(window, last, best, j, len(window))
        yield from self._trace(last, len(window))

    def _advance(self, window: str, last: list[int], best: list[float], j: int, stop: int) -> int:
        """Every prefix has one admissible path; its last piece is the one that agrees with what stands before it."""
        e, n = self.encoder, len(window)
        root, agreed, agree = e.root, e.agreed.get, e.agree
        while j < stop:
            u, node, i = last[j], root, j
            high = u << 21
            while i < n:
                found = node.get(window[i])
                if found is None:
                    break
                i += 1
                t, node = found
                if t >= 0 and last[i] < 0:
                    if u >= 0:
                        ok = agreed(high | t)
                        if ok is None:
                            ok = agree(u, t)
                        if not ok:
                            continue
                    last[i] = t
            if i == j:
                last[j + 1] = e.add(window[j : j + 1])
            j += 1
        return j

    def _advance_scored(self, window: str, last: list[int], best: list[float], j: int, stop: int) -> int:
        e, n, scores = self.encoder, len(window), self.scores
        while j < stop:
            node, i, here, single = e.root, j, best[j], False
            while i < n:
                found = node.get(window[i])
                if found is None:
                    break
                i += 1
                t, node = found
                if t >= 0:
                    single |= i == j + 1
                    s = _single(here + scores[min(t, len(scores) - 1)])
                    if last[i] < 0 or s > best[i]:
                        last[i], best[i] = t, s
            if not single:
                t, s = e.add(window[j : j + 1]), _single(here + scores[-1])
                if last[j + 1] < 0 or s > best[j + 1]:
                    last[j + 1], best[j + 1] = t, s
            j += 1
        return j

    def _meet(self, last: list[int], j: int) -> int:
        """The last boundary on the paths of boundary j and of all later ones that are reached (0: none yet)."""
        alive = {j, *(i for i in range(j + 1, len(last)) if last[i] >= 0)}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(self.encoder.pieces[last[top]]))
        return alive.pop()

    def _trace(self, last: list[int], i: int) -> list[str]:
        out = []
        while i:
            out.append(self.encoder.pieces[last[i]])
            i -= len(out[-1])
        return out[::-1]


def _single(x: float) -> float:
    """Rounded to single precision."""
    return _FLOAT.unpack(_FLOAT.pack(x))[0]


_FLOAT = struct.Struct("<f")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = message[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, message[at : at + size]
            at += size


UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0  # fixed value: below the least score of a piece
_USER_DEFINED = 4


def kind_of(model: bytes) -> int:
    """Model type (field 3 of the trainer spec, field 2) of a serialized model; the default is unigram."""
    kind = UNIGRAM
    for number, spec in _fields(model):
        if number == 2:
            kind = dict(_fields(spec)).get(3, kind)
    return kind


class PieceModel:
    """Encodes and decodes as the library does for a unigram or BPE model with an identity normaliser."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sp.serialized_model_proto()
        self.kind = kind_of(proto)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are handled")
        if any(number == 1 and dict(_fields(piece)).get(3) == _USER_DEFINED for number, piece in _fields(proto)):
            raise ValueError("models with user-defined pieces are not handled")
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.plain = max([self.unknown, *self.byte_of, *self.silent]) + 1
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.names[i]: i for i in normal}
        score = {self.names[i]: sp.get_score(i) for i in normal}
        probe = sp.encode("  a  b ")
        text = "\uff21 e\u0301\u00e9\u00a0"  # wide, composed, decomposed and unusual blanks
        if sp.decode(probe) != "  a  b " or sp.normalize(text) not in (text, MARK + text.replace(" ", MARK)):
            raise ValueError("only models with an identity normaliser are handled")
        if self.kind == BPE and any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans two words")

        def rank(a: str, b: str) -> float:
            return -score.get(a + b, -inf)

        self.encoder = PrefixEncoder(self.id, rank, list)
        scores = [*score.values(), min(score.values(), default=0.0) - _UNKNOWN_PENALTY] if self.kind == UNIGRAM else None
        self.viterbi = StreamingViterbi(self.encoder, scores)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}  # ids as int32: a fifth of what lists take
        self.older: dict[str, bytes] = {}  # words that were known before; the others of them are forgotten next
        self.known_parts: dict[str, bytes] = {}

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def of_part(self, part: str) -> bytes:
        ids = self.known_parts.get(part)
        if ids is None:
            ids = array("i", chain.from_iterable(map(self.ids_of, self.viterbi.pieces(part)))).tobytes()
            if len(part) <= 64:
                if len(self.known_parts) > MEMO:
                    self.known_parts.clear()
                self.known_parts[part] = ids
        return ids

    def of_word(self, word: str) -> bytes:
        ids = self.known.get(word) or self.older.get(word)
        if ids is None:
            parts, pairs, at = [], self.pairs, 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in pairs:
                    parts.append(self.of_part(word[at:i]))
                    at = i
            parts.append(self.of_part(word[at:]))
            ids = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(word) <= 64:
            if len(self.known) > MEMO // 4:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if self.kind == BPE:
            known, of_word = self.known.get, self.of_word
            ids = array("i", b"".join([known(w) or of_word(w) for w in self.word.findall(marked)])).tolist()
        else:  # sums of scores run through the whole text
            ids = list(chain.from_iterable(map(self.ids_of, self.viterbi.pieces(marked))))
        if not self.bytes and self.unknown in ids:  # a run of characters outside the vocabulary is one unknown piece
            ids = [i for i, before in zip(ids, [None, *ids], strict=False) if i != self.unknown or before != i]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if not ids or min(ids) >= self.plain:  # no control, unknown or byte ids
            return self._shown("".join(map(self.names.__getitem__, ids)))
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.silent:
                out.append(self.names[i] if i != self.unknown else " ⁇ ")
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return self._shown("".join(out))

    @staticmethod
    def _shown(pieces: str) -> str:
        text = pieces.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256 (of the ids as little-endian int32) and round_trip of each row.

    round_trip tells whether decoding gives the text back; it is false where a text holds the word
    mark itself, which decodes to a space. path: a model file that each machine has.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [np.array(m.encode(t), np.int32) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                digest = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                same = [m.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(digest), pa.array(same)], names=["doc_id", "n_ids", "ids", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {key}, n_ids bigint, ids array<int>, ids_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    key = encoded.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {key}, text string")


def op7_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
