"""SentencePiece encoding and decoding by suffix-array matching.

Of each slice of texts the distinct words not yet known are concatenated and indexed by a suffix array cut
at the longest piece. Every piece is binary-searched for its range of occurrences; these are the edges of
the word lattices. Sorted by position, they are relaxed in the order the model's merges ask for: in each round every
word applies its best-scored edge that joins two current neighbours, the left one of equals, until none is left.
Very long words take the same edges from a heap instead, so a text without a space costs n log n. What no piece covers falls back to bytes. Words are white-space marks and what follows them, which no piece
of a usable model crosses, so the words' encodings joined are the text's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseam.llm.base import in_arrow, whole_text
from lodeseam.llm.tokens import released, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bounds of a worker's memory: of remembered words (64 more a word), of one suffix array, and bytes of a slice of texts.
MOST_KNOWN = 16 << 20
RUN_CHARS = 1 << 18
SLICE_BYTES = 2 << 20
#: From this many characters on a word is relaxed by a heap.
LONG_WORD = 512


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: text, score and number of each that text can match, the bytes' numbers, all for decoding."""

    texts: list[str]
    scores: list[float]
    numbers: list[int]
    byte_numbers: list[int]
    decoded: list[bytes]


def load(path: str = MODEL) -> Pieces:
    """Read a BPE model with byte fallback; the file is read on the driver and its pieces travel from there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_numbers, decoded = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_numbers[int(text[3:5], 16)] = i
            decoded.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            normal.append((text, model.get_score(i), i))
            decoded.append(text.replace(MARK, " ").encode())
    if len(set(byte_numbers)) != 256 or not all(re.fullmatch(f"{MARK}*[^{MARK}]*", t) for t, _, _ in normal):
        raise ValueError("the model must have byte fallback and no piece with a mark inside")
    texts, scores, numbers = map(list, zip(*normal, strict=True))
    return Pieces(texts, scores, numbers, byte_numbers, decoded)


class Encoder:
    """Encodes words, remembering a bounded number of them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()
        self.numbers, self.byte_numbers = np.array(pieces.numbers, np.int32), np.array(pieces.byte_numbers, np.int32)
        self.scores = np.array([-np.inf, *pieces.scores])
        self.rank = np.unique(-self.scores, return_inverse=True)[1].tolist()
        alphabet = sorted({c for t in pieces.texts for c in t})
        if len(alphabet) > 0xFFFE:
            raise ValueError("too many different characters in the pieces")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.depth = max(map(len, pieces.texts))
        if self.depth > 31:
            raise ValueError("a piece is longer than 31 characters")
        self.lengths = np.array([len(t) for t in pieces.texts])
        keys = np.zeros((len(pieces.texts), self.depth), ">u2")
        for i, t in enumerate(pieces.texts):
            keys[i, : len(t)] = self.code[[ord(c) for c in t]]
        above = np.where(np.arange(self.depth) < self.lengths[:, None], keys, 0xFFFF).astype(">u2")
        self.low, self.high = self._keys(keys), self._keys(above)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{2 * self.depth}").ravel()

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece index) of every occurrence of every piece in `text`, by position."""
        codes = np.zeros(len(text) + self.depth - 1, ">u2")
        codes[: len(text)] = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keys = self._keys(np.lib.stride_tricks.sliding_window_view(codes, self.depth))
        suffixes = np.argsort(keys, kind="stable")
        keys = keys[suffixes]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        counts = high - low
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = suffixes[np.repeat(low, counts) + within]
        order = np.argsort(at, kind="stable")
        return at[order], piece[order]

    def forget(self) -> None:
        self.known, self.held = {}, 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, words: set[str]) -> None:
        """Encode the distinct words that are not yet known, in runs of a bounded number of characters."""
        if self.held > MOST_KNOWN:
            self.forget()
        run, size = [], 0
        for word in sorted(words - self.known.keys()):
            run.append(word)
            size += len(word) + 1
            if size >= RUN_CHARS:
                self._learn(run)
                run, size = [], 0
        if run:
            self._learn(run)

    def _learn(self, words: list[str]) -> None:
        text = "\0".join(words)
        lattice = np.zeros((len(text), self.depth + 1), np.uint16 if len(self.numbers) < 0xFFFF else np.int32)
        for start in range(0, len(text), RUN_CHARS):  # more than one only inside a very long word
            at, piece = self.edges(text[start : start + RUN_CHARS + self.depth - 1])
            lattice[start + at, self.lengths[piece]] = piece + 1
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        chars = np.ones(len(text), bool)
        chars[starts[1:-1] - 1] = False
        left, right, of = self.relax(np.flatnonzero(chars), np.repeat(np.arange(len(words)), [len(w) for w in words]), lattice)
        found = np.where(right - left <= self.depth, lattice[left, np.minimum(right - left, self.depth)].astype(np.int32), 0)
        numbers = self.numbers[found - 1]
        lost = np.flatnonzero(found == 0)
        if len(lost):
            raw = [text[i:j].encode("utf-8", "surrogatepass") for i, j in zip(left[lost].tolist(), right[lost].tolist(), strict=True)]
            times = np.ones(len(found), np.int64)
            times[lost] = [len(x) for x in raw]
            numbers, of = np.repeat(numbers, times), np.repeat(of, times)
            numbers[np.repeat(found == 0, times)] = self.byte_numbers[np.frombuffer(b"".join(raw), np.uint8)]
        while self.used + len(numbers) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(numbers)] = numbers
        ends = self.used + np.cumsum(np.bincount(of, minlength=len(words)))
        begins = np.concatenate([[self.used], ends[:-1]])
        self.used += len(numbers)
        self.known.update(zip(words, (begins << 24 | (ends - begins)).tolist(), strict=True))
        self.held += len(text) + 64 * len(words)

    def relax(self, at: np.ndarray, of: np.ndarray, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, word) of the symbols that are left when no edge joins two neighbours of a word.

        In each round every word applies its best edge, the left one of equals; words without one are done.
        """
        left, right, done = at, at + 1, []
        sizes = np.bincount(of)
        for word in np.flatnonzero(sizes >= LONG_WORD):
            own = np.flatnonzero(of == word)
            a, b = self.merged(lattice[at[own[0]] : at[own[-1]] + 1])
            done.append((at[own[0]] + a, at[own[0]] + b, np.full(len(a), word)))
        short = sizes[of] < LONG_WORD
        left, right, of = left[short], right[short], of[short]
        while len(left):
            pair = np.zeros(len(left), np.int32)
            near = (of[1:] == of[:-1]) & (right[1:] - left[:-1] <= self.depth)
            k = np.flatnonzero(near)
            pair[k] = lattice[left[k], right[k + 1] - left[k]]
            score = self.scores[pair]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            counts = np.diff(first, append=len(of))
            best = np.repeat(np.maximum.reduceat(score, first), counts)
            open_ = best > -np.inf
            if not open_.all():
                done.append((left[~open_], right[~open_], of[~open_]))
            hit = np.flatnonzero(open_ & (score == best))
            hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])] if len(hit) else hit
            right = right.copy()
            right[hit] = right[hit + 1]
            keep = open_
            keep[hit + 1] = False
            left, right, of = left[keep], right[keep], of[keep]
        left, right, of = (np.concatenate([d[i] for d in done]) for i in range(3)) if done else (left, right, of)
        order = np.argsort(left)
        return left[order], right[order], of[order]

    def merged(self, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like relax() for one word, from a heap of the edges that join neighbours; stale ones are passed over."""
        n = len(lattice)
        end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        key = lambda piece, i, e: (self.rank[piece] * n + i) * 32 + e - i
        two = np.flatnonzero(lattice[:-1, 2])
        heap = [key(p, i, i + 2) for i, p in zip(two.tolist(), lattice[two, 2].tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top // 32 % n
            e, m = i + top % 32, end[i]
            if m == 0 or m >= n or end[m] != e:
                continue
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
            for a, b in ((before[i], e), (i, end[e] if e < n else 0)):
                if a >= 0 and 0 < b - a <= self.depth and (piece := lattice[a, b - a]):
                    heapq.heappush(heap, key(piece, a, b))
        ends = np.array(end)
        return np.flatnonzero(ends), ends[ends > 0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text."""
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*split))
        where = np.fromiter((self.known[w] for words in split for w in words), np.int64)
        begins, sizes = where >> 24, where & 0xFFFFFF
        total = np.cumsum(sizes)
        tokens = self.flat[np.repeat(begins - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate([[0], total])[np.cumsum([0, *map(len, split)])]
        return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_numbers(numbers: list[int], decoded: list[bytes]) -> str:
    """The text of piece numbers: marks are spaces, the first one is dropped, bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(decoded.__getitem__, numbers))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """`id_col`, n_tokens, tokens (array<int>) of every row; a null or empty text has no tokens."""
    shared = df.sparkSession.sparkContext.broadcast(load(model))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in slices(batches, 1, SLICE_BYTES):
            tokens = encoder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], [id_col, "n_tokens", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(id_col, whole_text(text_col).alias("_text")), run, f"`{id_col}` {kind}, n_tokens long, tokens array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", model: str = MODEL) -> DataFrame:
    """`id_col` and text of every row of token arrays; a null array gives a null text."""
    shared = df.sparkSession.sparkContext.broadcast(load(model).decoded)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else decode_numbers(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(id_col, tokens_col), run, f"`{id_col}` {kind}, text string")


def token_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """n_tokens, the hash of the tokens (32-bit, little-endian), whether decoding gives the text back, and its length.

    A text that itself holds the white-space mark decodes to a space there, so it is not the same. A null or
    empty text has no tokens and is the same. Each row stands alone; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(model))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        decoded = shared.value.decoded
        for part in slices(batches, 1, SLICE_BYTES):
            texts = part.column(1).to_pylist()
            tokens = encoder.encode(texts)
            back = [decode_numbers(t.tolist(), decoded) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in tokens]),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()), pa.array(map(len, back), pa.int64()),
                ],
                [id_col, "n_tokens", "tokens_sha256", "round_trip", "decoded_chars"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(id_col, whole_text(text_col).alias("_text")), run, f"`{id_col}` {kind}, n_tokens long, tokens_sha256 string, round_trip boolean, decoded_chars long")
