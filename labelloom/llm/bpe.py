"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut into pieces by the vocabulary's pattern, and each piece is merged by
itself: the pair of neighbouring tokens of the lowest rank, the leftmost of equal
ones, becomes one token until no pair is in the vocabulary. Leaf i of a piece's tree
holds the rank of the pair whose left token starts at byte i, with i below it, so
the root is the leftmost pair of the lowest rank. A merge clears the leaf of the
token that disappears and sets those of its live neighbours, a walk to the root
each: n bytes take O(n log n), however long a piece is. Short pieces are merged in step, a
step for all at once (Forest), long ones by themselves (merged).

A space before anything but white space always begins a piece, so texts are cut
there and a task looks up what it has encoded before, chunks between such spaces and
pieces in them; MEMO bounds what it remembers of each.
The ranks are read by the driver and broadcast (50,000 tokens, below a megabyte),
refused beyond MOST_TOKENS. Nothing is shuffled.

Defined results: a null or empty text has no tokens, and no tokens decode to no
bytes; texts are encoded whole, however long; repeated rows are encoded each; an
empty table gives no rows; other columns are not read; bytes that are no UTF-8 are
read as U+FFFD; strings that look like special tokens are ordinary text; an id that
the vocabulary has not, or a byte that has no token, raises an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Chunks that a task remembers (and half as many pieces), their longest, and tokens of a vocabulary that is broadcast.
MEMO, MEMO_CHARS, MOST_TOKENS = 600_000, 40, 1_000_000
#: Characters of texts that are encoded together, and bytes of a piece that is merged in step with others.
BATCH_CHARS, TOGETHER = 1_500_000, 64
_NONE = 1 << 40  # above all ranks
#: Python's white space includes that of the pattern.
_CUT = re.compile(r" (?=\S)")
_TWO = re.compile(r" \s")


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """Rank of every two bytes, _NONE where they are no token."""
    return [ranks.get(bytes((a, b)), _NONE) for a in range(256) for b in range(256)]


def merged(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Token ids of one piece. pairs: byte_pairs of the ranks.

    levels[0] are the leaves of the tree, a rank times n plus the place; a node of the
    next level is the lesser of two, up to the root. After a merge the three leaves that
    changed are next to each other among the live ones, and so are the nodes above them.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, rank = len(piece), ranks.get
    none = _NONE * n
    low = [pairs[a << 8 | b] * n + i for i, (a, b) in enumerate(zip(piece, piece[1:]))]
    levels = [low]
    while len(low) > 1:
        if len(low) & 1:
            low.append(none)
        low = list(map(min, low[::2], low[1::2]))
        levels.append(low)
    leaves, upper, root = levels[0], levels[1:], levels[-1]
    after, before = list(range(1, n + 1)), list(range(-1, n))  # where the next and the previous live token start
    while (top := root[0]) < none:
        i = top % n
        gone = after[i]
        after[i] = end = after[gone]
        before[end] = i
        if gone < n - 1:
            leaves[gone] = none
        else:
            gone = i
        r = rank(piece[i : after[end]]) if end < n else None
        leaves[i] = none if r is None else r * n + i
        left = i
        if i:
            left = before[i]
            r = rank(piece[left:end])
            leaves[left] = none if r is None else r * n + left
        low = leaves
        for up in upper:
            left, i, gone = left >> 1, i >> 1, gone >> 1
            x, y = low[2 * left], low[2 * left + 1]
            up[left] = x if x < y else y
            if i != left:
                x, y = low[2 * i], low[2 * i + 1]
                up[i] = x if x < y else y
            if gone != i:
                x, y = low[2 * gone], low[2 * gone + 1]
                up[gone] = x if x < y else y
            low = up
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: a token in base64 and its number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Forest:
    """Trees of many pieces at once: one row of a matrix for each, a merge in every piece at each step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        halves = [(ranks[a], ranks[b], r) for t, r in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks]
        table = np.array(halves, np.int64).reshape(-1, 3)
        self.base = int(table.max(initial=255)) + 1
        keys = table[:, 0] * self.base + table[:, 1]
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.int64(2**62)), np.append(table[order, 2], _NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two tokens' union, _NONE if it is no token."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merged(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of at most ``size`` bytes, a power of two, four bytes each."""
        m = len(pieces)
        n = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)].reshape(m, size)
        place = np.arange(size)
        ids = np.where(place < n[:, None], ids, -1)
        tree = np.full((m, 2 * size), _NONE * size)
        r = np.where(place[1:] < n[:, None], self.rank(ids[:, :-1], np.maximum(ids[:, 1:], 0)), _NONE)
        tree[:, size:-1] = np.where(r < _NONE, r * size + place[:-1], _NONE * size)
        h = size // 2
        while h:
            tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
            h //= 2
        after, before = np.tile(place + 1, (m, 1)), np.tile(np.append(place, size) - 1, (m, 1))  # where the next and the previous live token start
        flat, tokens, rows = tree.ravel(), ids.ravel(), np.arange(m)
        nexts, lasts = after.ravel(), before.ravel()
        while True:
            rows = rows[tree[rows, 1] < _NONE * size]
            if not len(rows):
                break
            top, at = tree[rows, 1], rows * size
            i = top % size
            gone = nexts[at + i]
            end = nexts[at + gone]
            nexts[at + i], tokens[at + i], tokens[at + gone] = end, top // size, -1
            lasts[rows * (size + 1) + end] = i
            inside = end < n[rows]
            new = np.where(inside, self.rank(tokens[at + i], np.maximum(tokens[at + np.minimum(end, size - 1)], 0)), _NONE)
            left = lasts[rows * (size + 1) + i]
            left = np.where(left < 0, i, left)
            old = np.where(left < i, self.rank(tokens[at + left], tokens[at + i]), new)
            base = rows * 2 * size
            flat[base + size + gone] = _NONE * size
            flat[base + size + i] = np.where(new < _NONE, new * size + i, _NONE * size)
            flat[base + size + left] = np.where(old < _NONE, old * size + left, _NONE * size)
            up = [left + size, i + size, gone + size]
            while up[0][0] > 1:  # all nodes are of one level
                up = [u >> 1 for u in up]
                for u in up:
                    spot = base + u
                    below = spot + u
                    flat[spot] = np.minimum(flat[below], flat[below + 1])
        live = ids >= 0
        raw, ends = ids[live].astype("<i4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary; remembers what it has encoded."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.ranks = ranks_of(content)
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pieces = regex.compile(pattern).findall
        self.pairs, self.forest = byte_pairs(self.ranks), Forest(self.ranks)
        self.known: dict[str, bytes] = {}  # chunks of text, without the space in front
        self.seen: dict[str, bytes] = {}  # pieces

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces into seen."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.seen[p] = whole.to_bytes(4, "little")
            elif len(raw) <= TOGETHER:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
            else:
                self.seen[p] = np.array(merged(raw, self.ranks, self.pairs), "<i4").tobytes()
        for size, some in classes.items():
            for k in range(0, len(some), 16_384):
                part = some[k : k + 16_384]
                self.seen.update(zip([p for p, _ in part], self.forest.merged([raw for _, raw in part], size)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, four bytes each."""
        known, seen = self.known, self.seen
        for memo, most in ((known, MEMO), (seen, MEMO // 2)):
            if len(memo) > most:
                memo.clear()
        firsts, rests, rows, new = [], [], [], set()
        for t in texts:
            first, *rest = _CUT.split(t) if t.endswith(" ") or _TWO.search(t) else t.split(" ")
            ids = list(map(known.get, rest))
            if None in ids:
                new.update([c for c, i in zip(rest, ids) if i is None])
            else:
                rest = None
            firsts.append(self.pieces(first))
            rests.append(rest)
            rows.append(ids)
        own = {c: self.pieces(" " + c) for c in new}
        self._learn(set(chain(chain.from_iterable(own.values()), chain.from_iterable(firsts))).difference(seen))
        for c, pieces in own.items():
            known[c] = b"".join([seen[p] for p in pieces])
        out = []
        for first, rest, ids in zip(firsts, rests, rows, strict=True):
            if rest is not None:
                ids = [known[c] if i is None else i for c, i in zip(rest, ids)]
            out.append(b"".join([*map(seen.__getitem__, first), *ids]))
        for memo, keys in ((known, new), (seen, chain(chain.from_iterable(firsts), chain.from_iterable(own.values())))):
            for k in [k for k in keys if len(k) > MEMO_CHARS]:
                memo.pop(k, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_held: dict[int, Encoder] = {}


def _encoder(content: Broadcast, pattern: str) -> Encoder:
    """One encoder for each worker."""
    key = hash((content.value, pattern))
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(content.value, pattern)
    return _held[key]


def broadcast_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The lines of a rank file on the driver, for all tasks."""
    with open(path, "rb") as f:
        content = f.read()
    if content.count(b"\n") > MOST_TOKENS:
        raise ValueError(f"{path} has more than {MOST_TOKENS} tokens")
    return spark.sparkContext.broadcast(content)


def _encode(content: Broadcast, pattern: str):
    def rows(ids: list, parts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(content, pattern)
        for b in batches:
            held, texts, n = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                held.append(doc_id)
                texts.append((text.as_py() or b"").decode("utf-8", "replace"))
                n += len(texts[-1])
                if n >= BATCH_CHARS:
                    yield rows(held, own.encode_all(texts))
                    held, texts, n = [], [], 0
            if held:
                yield rows(held, own.encode_all(texts))

    return run


def _decode(content: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(content, pattern)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            raw = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary())], names=[*b.schema.names[:-1], "bytes"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every text. path: a rank file that the driver can open."""
    content = broadcast_ranks(docs.sparkSession, path)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(content, pattern), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The other columns of rows, and bytes in place of the column of ids; null ids give null."""
    kept = rows.select(*(c for c in rows.columns if c not in (ids, "bytes")), F.col(ids).alias("ids"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_decode(broadcast_ranks(rows.sparkSession, path), pattern), f"{fields}bytes binary")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents and decodes their ids again."""
    path = public_tokenizers.path(VOCABULARY)
    ids = encoded(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    seen = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "ids")
    return decoded(seen, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
