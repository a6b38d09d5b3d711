"""Encoding of a corpus with a public byte-level BPE vocabulary.

The merges are compiled, on demand, into a deterministic finite-state
transducer. It reads bytes and emits a token as soon as no further byte can
change it. What a state knows is the last token that is final and the bytes
read since; for every position in those bytes, the last token of the encoding
up to there is unique: it is the one token that ends there and forms a valid
pair with the last token at its own start. A position is alive while the bytes
after it may still grow into a longer token. Tokens up to the deepest boundary
shared by all live positions are final. Tokens have a greatest length, so the
lookahead is bounded, and a text of any length takes time in proportion.

Decoding walks a second lazy transducer, from the states of an incremental
UTF-8 decoder over tokens.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from leafmill.session import table

#: Fixed value: the pattern that parts a text into pieces, which merges never cross.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the tables that grow while encoding; a full one is emptied.
STATES, PIECES, PAIRS = 200_000, 200_000, 1_000_000


def vocabulary_dir() -> str:
    """Default folder of the vocabulary files; every operator takes it as a parameter."""
    return os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")


class _State:
    __slots__ = ("prev", "pending", "lasts", "next", "tail")

    def __init__(self, prev: int, pending: bytes, lasts: tuple):
        self.prev, self.pending, self.lasts = prev, pending, lasts
        self.next: dict[int, tuple] = {}
        self.tail: tuple | None = None


class Transducer:
    """Encoder of one vocabulary of ``token bytes -> rank``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple, bool] = {}
        self.pieces: dict[str, tuple] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(-1, b"", ())

    def _state(self, prev: int, pending: bytes, lasts: tuple) -> _State:
        key = (prev, pending)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = _State(prev, pending, lasts)
        return s

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only used on two joined tokens and in tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            joined = parts[best[1]] + parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == joined and self.ranks[joined] == best[0]:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        """True if merging the bytes of both tokens gives the two tokens back."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _step(self, state: _State, byte: int) -> tuple:
        """(tokens that become final, next state), computed once for a state and byte."""
        w = state.pending + bytes((byte,))
        n = len(w)
        last = None
        for s in range(max(0, n - self.longest), n):
            token = self.ranks.get(w[s:])
            if token is None:
                continue
            before = state.prev if s == 0 else state.lasts[s - 1]
            if before == -1 or (before is not None and self.valid(before, token)):
                last = token
                break
        lasts = (*state.lasts, last)
        # Walk up from every live position; boundaries that all of them pass are final.
        shared: list[int] | None = None
        for p in range(n, -1, -1):
            if p < n and w[p:] not in self.prefixes:
                continue
            if p and lasts[p - 1] is None:
                continue
            way = [p]
            while way[-1]:
                way.append(way[-1] - len(self.bytes_of[lasts[way[-1] - 1]]))
            shared = way if shared is None else [x for x in shared if x in set(way)]
        c = shared[0]
        final = []
        at = c
        while at:
            final.append(lasts[at - 1])
            at -= len(self.bytes_of[lasts[at - 1]])
        prev = lasts[c - 1] if c else state.prev
        # Positions that don't descend from c are dead; what a state holds follows from its key.
        kept: list = []
        for p in range(c + 1, n + 1):
            token = lasts[p - 1]
            up = None if token is None else p - len(self.bytes_of[token])
            kept.append(token if up is not None and (up == c or (up > c and kept[up - c - 1] is not None)) else None)
        step = (tuple(reversed(final)), self._state(prev, w[c:], tuple(kept)))
        state.next[byte] = step
        return step

    def _end(self, state: _State) -> tuple:
        out, at = [], len(state.pending)
        while at:
            out.append(state.lasts[at - 1])
            at -= len(self.bytes_of[state.lasts[at - 1]])
        state.tail = tuple(reversed(out))
        return state.tail

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece, streamed through the transducer."""
        if len(self.states) > STATES:
            self._fresh()
        state, out = self.start, []
        for byte in data:
            step = state.next.get(byte) or self._step(state, byte)
            if step[0]:
                out.extend(step[0])
            state = step[1]
            if len(self.states) > STATES:  # inside a long piece: keep only where we are
                here = _State(state.prev, state.pending, state.lasts)
                self._fresh()
                self.states[state.prev, state.pending] = state = here
        out.extend(state.tail if state.tail is not None else self._end(state))
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; none for null and empty."""
        if not text:
            return []
        out: list[int] = []
        known = self.pieces
        for word in _PIECE.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.piece(word.encode("utf-8", "surrogatepass")))
                if len(word) <= 24:
                    if len(known) >= PIECES:
                        known.clear()
                    known[word] = ids
            out.extend(ids)
        return out


_PIECE = regex.compile(PATTERN)

# Incremental UTF-8: a state is (value so far, bytes to come, bounds of the next byte).
_READY = (0, 0, 0x80, 0xBF)


def _utf8(state: tuple, byte: int) -> tuple[str, tuple]:
    """One byte in: characters that are complete, next state. A broken sequence gives U+FFFD."""
    value, left, low, high = state
    if left:
        if low <= byte <= high:
            value = value << 6 | byte & 0x3F
            return (chr(value), _READY) if left == 1 else ("", (value, left - 1, 0x80, 0xBF))
        text, state = _utf8(_READY, byte)
        return "�" + text, state
    if byte < 0x80:
        return chr(byte), _READY
    if 0xC2 <= byte <= 0xDF:
        return "", (byte & 0x1F, 1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return "", (byte & 0x0F, 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return "", (byte & 0x07, 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return "�", _READY


class Decoder:
    """Streaming decoder; its steps from a UTF-8 state over a token are computed once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.steps = bytes_of, {}

    def decode(self, ids) -> str | None:
        """Text of ids; null for null. An unknown id gives U+FFFD."""
        if ids is None:
            return None
        state, out = _READY, []
        for i in ids:
            step = self.steps.get((state, i))
            if step is None:
                at, text = state, []
                for byte in self.bytes_of.get(int(i), b"\xff"):
                    t, at = _utf8(at, byte)
                    text.append(t)
                if len(self.steps) >= PAIRS:
                    self.steps.clear()
                step = self.steps[state, i] = ("".join(text), at)
            out.append(step[0])
            state = step[1]
        return "".join(out) + ("�" if state[1] else "")


@lru_cache(maxsize=4)
def _transducer(name: str) -> Transducer:
    """The transducer of a vocabulary that the driver shipped, one per worker process."""
    return transducer(SparkFiles.get(name))


def transducer(path: str) -> Transducer:
    """The transducer of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return Transducer({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


def _shipped(spark: SparkSession, folder: str | None, vocabulary: str) -> str:
    """Name of a vocabulary file after it was given to the executors, once per context, as they may not have its folder."""
    path = os.path.join(folder or vocabulary_dir(), f"{vocabulary}.tiktoken")
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_leafmill_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row; null and empty texts get an empty list.

    Repeated rows stay; other columns are dropped. Takes no shuffle.
    """
    name = _shipped(df.sparkSession, folder, vocabulary)
    rows = df.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        t = _transducer(name)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"]
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of every row's token ids; null for null."""
    name = _shipped(df.sparkSession, folder, vocabulary)
    rows = df.select(key, ids)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        d = Decoder(_transducer(name).bytes_of)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [d.decode(x) for x in b[ids]]})

    return rows.mapInPandas(run, f"`{key}` {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: (doc_id, ids) of every document."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document encoded and decoded again; an empty text for null."""
    return decode(p8_ids(spark, sf_dir), "doc_id", "ids")
