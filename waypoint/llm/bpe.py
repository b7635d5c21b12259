"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

Two facts make merges a finite-state matter. A token sequence is the encoding
of its bytes exactly when every adjacent pair is the encoding of its own
bytes; and every prefix of a text has one encoding. So the transducer reads
bytes into the set of places in the vocabulary's trie where a token under way
can be. Such sets are numbered as they turn up (lazy determinisation; there
are at most as many as trie nodes), and each knows the tokens that end here.
Exactly one of them fits the token before it: it ends the encoding of the
prefix. Whether two tokens fit is worked out once from the merges and kept.
Tokens that all places still under way share are final and emitted; they lie
at most a few tokens back, so a stream holds a bounded tail. A known
transition costs a table lookup a byte, and long pieces take linear time.

Defined cases: a null text counts as empty and has no tokens; repeated rows
give equal results; an empty table gives an empty result; further columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waypoint.session import ship_package

from .common import hold, kept_table, small_batches

#: Bounds of the tables a worker keeps; a full table is emptied and refilled.
MAX_PAIRS = 300_000
MAX_PIECES = 150_000
#: Bytes a stream reads before it looks for final tokens.
WINDOW = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file on the driver: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging as defined: the lowest rank first, the leftmost of equals."""
    none = 1 << 40
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joint = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while joint:
        low = min(joint)
        if low == none:
            break
        i = joint.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joint[i]
        if i:
            joint[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(joint):
            joint[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece in, ranks out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = {rank: token for token, rank in ranks.items()}
        self.span = max(self.names) + 2
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                if key not in self.trie:
                    self.trie[key] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                at = self.trie[key]
            self.ends[at] = rank
        self.inner = {key >> 8 for key in self.trie}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.places: list[tuple[int, ...]] = [()]
        self.steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    def _stands(self, rank: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        if rank not in self.whole:
            self.whole[rank] = merge(self.names[rank], self.ranks) == [rank]
        return self.whole[rank]

    def _fits(self, left: int, right: int) -> bool:
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        fits = left < 0 or merge(self.names[left] + self.names[right], self.ranks) == [left, right]
        self.pairs[left * self.span + right] = fits
        return fits

    def _step(self, state: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """A transition, worked out once: the next set of places, and (rank, bytes) of the tokens that end here."""
        nodes = [child for node in (*self.places[state], 0) if (child := self.trie.get(node << 8 | byte)) is not None]
        ending = [(rank, len(self.names[rank])) for node in nodes if (rank := self.ends.get(node)) is not None and self._stands(rank)]
        inner = tuple(node for node in nodes if node in self.inner)
        number = self.numbers.get(inner)
        if number is None:
            number = self.numbers[inner] = len(self.places)
            self.places.append(inner)
        self.steps[state << 8 | byte] = (number, ending)
        return number, ending

    def read(self, data: bytes, lasts: list[int], state: int = 0) -> int:
        """Appends, for each byte, the last token of the encoding up to it; the state after ``data``."""
        steps, pairs, span = self.steps.get, self.pairs, self.span
        for byte in data:
            step = steps(state << 8 | byte) or self._step(state, byte)
            state, ending = step
            for rank, size in ending:
                left = lasts[-size]
                fits = pairs.get(left * span + rank)
                if fits is None:
                    fits = self._fits(left, rank)
                if fits:
                    lasts.append(rank)
                    break
            else:
                raise ValueError("a byte that no token covers")
        return state

    def back(self, lasts: list[int], end: int) -> list[int]:
        """Tokens of the encoding up to ``end``, from where ``lasts`` begins."""
        out, names = [], self.names
        while end:
            rank = lasts[end]
            out.append(rank)
            end -= len(names[rank])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> bytes:
        """Ranks of one piece as little-endian unsigned 32-bit integers."""
        known = self.ranks.get(piece)
        if known is not None:
            return struct.pack("<I", known)
        if len(piece) > WINDOW:
            stream = EncodeStream(self)
            out = [stream.feed(piece[i : i + WINDOW]) for i in range(0, len(piece), WINDOW)]
            return b"".join([*out, stream.end()])
        lasts = [-1]
        self.read(piece, lasts)
        out = self.back(lasts, len(piece))
        return struct.pack(f"<{len(out)}I", *out)


class EncodeStream:
    """One piece in chunks; tokens come out as soon as no later byte can change them."""

    def __init__(self, transducer: Transducer):
        self.own, self.lasts, self.state = transducer, [-1], 0

    def feed(self, data: bytes) -> bytes:
        self.state = self.own.read(data, self.lasts, self.state)
        end, lasts, names = len(self.lasts) - 1, self.lasts, self.own.names
        # a later token begins at the end or where a token under way begins; the
        # histories of these places meet where the tokens before are final
        meet = {end} | {end - self.own.depth[node] for node in self.own.places[self.state]}
        while len(meet) > 1:
            top = max(meet)
            meet.remove(top)
            meet.add(top - len(names[lasts[top]]))
        cut = meet.pop()
        out = self.own.back(lasts, cut)
        if cut:
            del lasts[:cut]
        return struct.pack(f"<{len(out)}I", *out)

    def end(self) -> bytes:
        out = self.own.back(self.lasts, len(self.lasts) - 1)
        self.lasts, self.state = [-1], 0
        return struct.pack(f"<{len(out)}I", *out)


class Pieces(dict):
    """Piece to its tokens; filled by the transducer. When it is full the last
    generation goes and this one takes its place, so frequent pieces stay."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.transducer.encode(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


# The UTF-8 state machine. A class for each byte, and for each
# state the next one by class; 0 is between characters, -1 an error. States 1
# to 3 await that many continuation bytes; the others restrict the first.
_CLASSES = [(0x00, 0x7F, 0), (0x80, 0x8F, 1), (0x90, 0x9F, 2), (0xA0, 0xBF, 3), (0xC2, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xEC, 6), (0xED, 0xED, 7), (0xEE, 0xEF, 6), (0xF0, 0xF0, 8), (0xF1, 0xF3, 9), (0xF4, 0xF4, 10)]
_NEXT = {0: {0: 0, 4: 1, 5: 4, 6: 2, 7: 5, 8: 6, 9: 3, 10: 7}, 1: {1: 0, 2: 0, 3: 0}, 2: {1: 1, 2: 1, 3: 1}, 3: {1: 2, 2: 2, 3: 2}, 4: {3: 1}, 5: {1: 1, 2: 1}, 6: {2: 2, 3: 2}, 7: {1: 2}}


@lru_cache(maxsize=1)
def _utf8_table() -> list[list[int]]:
    kind = [-1] * 256
    for low, high, c in _CLASSES:
        kind[low : high + 1] = [c] * (high + 1 - low)
    return [[_NEXT[s].get(kind[b], -1) for b in range(256)] for s in range(8)]


class Utf8Stream:
    """Incremental decoding: complete characters out, an unfinished one is kept.

    A byte that cannot continue gives U+FFFD, as does an unfinished end.
    """

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        data, self.held = self.held + data, b""
        try:
            # the machine only has to run where the chunk may end inside a character
            cut = self._tail(data)
            text = data[:cut].decode("utf-8")
        except UnicodeDecodeError:
            return self._slow(data)
        self.held = data[cut:]
        return text

    def _tail(self, data: bytes) -> int:
        table = _utf8_table()
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[len(data) - back :]:
                    state = table[state][byte]
                    if state < 0:
                        return len(data)
                return len(data) - back if state else len(data)
        return len(data)

    def _slow(self, data: bytes) -> str:
        table, out, start, state, i = _utf8_table(), [], 0, 0, 0
        while i < len(data):
            after = table[state][data[i]]
            if after < 0:
                out.append("�")
                i += state == 0
                start, state = i, 0
                continue
            state, i = after, i + 1
            if state == 0:
                out.append(data[start:i].decode("utf-8"))
                start = i
        self.held = data[start:]
        return "".join(out)

    def end(self) -> str:
        out, self.held = "�" * bool(self.held), b""
        return out


class Codec:
    """Encoder and decoder of one worker."""

    CHUNK = 1 << 16

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        self.split = regex.compile(pattern).findall
        names = sorted((rank, token) for token, rank in ranks.items())
        self.lengths = np.zeros(names[-1][0] + 1, np.int64)
        for rank, token in names:
            self.lengths[rank] = len(token)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(token for _, token in names), np.uint8)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode_bytes(self, ids: bytes) -> Iterator[bytes]:
        """Bytes of the tokens, a chunk of tokens at a time; an id without a token is an error."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        for at in range(0, len(numbers), self.CHUNK):
            part = numbers[at : at + self.CHUNK]
            long = self.lengths[part]
            if not long.all():
                raise ValueError("an id that has no token")
            ends = np.cumsum(long)
            index = np.repeat(self.starts[part] - ends + long, long) + np.arange(ends[-1])
            yield self.blob[index].tobytes()

    def decode(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(b) for b in self.decode_bytes(ids)), stream.end()])


_codecs: dict[tuple, Codec] = kept_table()


def codec(key: tuple, load: Callable[[], tuple[dict[bytes, int], str]]) -> Codec:
    """One codec a worker: its tables stay warm from task to task."""
    hold(_codecs)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*load())
    return _codecs[key]


OUTPUTS = {
    "ids": (T.BinaryType(), pa.binary()),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def _row(work: Codec, text: str, wanted: Iterable[str]) -> dict:
    ids = work.encode(text)
    row = {"ids": ids, "n_tokens": len(ids) // 4}
    if "ids_sha256" in wanted:
        row["ids_sha256"] = hashlib.sha256(ids).hexdigest()
    if "decoded" in wanted:
        row["decoded"] = work.decode(ids)
    if "decoded_sha256" in wanted:
        digest, stream = hashlib.sha256(), Utf8Stream()
        for part in work.decode_bytes(ids):
            digest.update(stream.feed(part).encode())
        digest.update(stream.end().encode())
        row["decoded_sha256"] = digest.hexdigest()
    return row


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """Adds the ``outputs`` (see OUTPUTS) and drops the text; ``ids`` are packed 32-bit integers.

    The vocabulary is one file of fixed size, read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    ranks = load_ranks(ranks_path)
    names, wanted = spark.sparkContext.broadcast(ranks), tuple(outputs)
    key = (ranks_path, pattern, len(ranks))
    rest = [c for c in docs.columns if c != text and c not in wanted]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(o, OUTPUTS[o][0]) for o in wanted])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, lambda: (names.value, pattern))
        for batch in batches:
            texts = batch.column(len(rest))
            rows = [_row(own, (texts[i].as_py() or ""), wanted) for i in range(len(texts))]
            columns = [batch.column(i) for i in range(len(rest))] + [pa.array([r[o] for r in rows], OUTPUTS[o][1]) for o in wanted]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *wanted])

    return docs.select(*rest, text).mapInArrow(work, schema)


def detokenize(tokens: DataFrame, ranks_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of packed ids; null ids give an empty text."""
    spark = tokens.sparkSession
    ship_package(spark)
    small_batches(spark)
    ranks = load_ranks(ranks_path)
    names = spark.sparkContext.broadcast(ranks)
    key = (ranks_path, "", len(ranks))
    rest = [c for c in tokens.columns if c != out]
    schema = T.StructType([tokens.schema[c] for c in rest] + [T.StructField(out, T.StringType())])
    place = rest.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, lambda: (names.value, ""))
        for batch in batches:
            texts = [own.decode(x.as_py() or b"") for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, out])

    return tokens.select(*rest).mapInArrow(work, schema)
