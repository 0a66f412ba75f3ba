"""Counting of hashed keys over all documents with compact shuffles.

Three Spark stages. (1) Documents are grouped into packs, ranges of doc_id of
about ``pack_bytes`` of text; each pack hands on its distinct 64-bit keys with
their counts, split into buckets by the key's leading bits. (2) Each bucket
gathers its slices of all packs, answers every slice, and sends the answers back
in the order asked. (3) Packs and answers meet by pack number.

Texts travel compressed, those of one pack and Arrow batch together. Keys travel
as differences of sorted numbers, byte plane by byte plane, compressed; the bits
that the bucket implies are left out, and ``bits`` of the rest are kept. However
often a key occurs, it is one entry of each pack, so no key is hot.

A bucket holds about BUCKET_KEYS keys. Packs grow from PACK_BYTES with the number of
buckets, so that a slice keeps SLICE_KEYS keys; at MOST_PACK_BYTES, that is from
some 80 GB of text on, slices become smaller, and from a few terabytes on a second
level of buckets would be due.

A pack's number is its place in the order of doc_id shifted by SUB bits, plus a part:
rows without an id, and those of an id with more rows than a pack should have, are
dealt to several parts of one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_BYTES, MOST_PACK_BYTES = 8_000_000, 32_000_000
BUCKET_KEYS, SLICE_KEYS = 4_000_000, 1500
LEAST_BITS = 8
#: Bits of a pack's number that tell its part, and the most cuts of doc_id; between two cuts ids are divided evenly.
SUB = 20
MOST_CUTS = 4096
#: Odd multipliers of the rolling hash of bytes and of words; 3 mod 8, of full order.
BYTE_BASE = 0x9E3779B97F4A7C15 & ~7 | 3
WORD_BASE = 0xC2B2AE3D27D4EB4F & ~7 | 3
DEALT = "pack long, ids binary, sizes binary, texts binary"
ASKED = "bucket int, pack long, n int, planes binary, counts binary"
ANSWERED = "bucket int, pack long, answer binary"
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: prefix sums of bytes times powers give every word's polynomial."""
    if not words:
        return np.zeros(0, U64)
    joined = np.frombuffer(b"".join(words), np.uint8).astype(U64) + U64(1)
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    at = _powers(BYTE_BASE, len(joined) + 1)
    sums = np.concatenate(([U64(0)], np.cumsum(joined * at[:-1], dtype=U64)))
    inverse = _powers(pow(BYTE_BASE, -1, 1 << 64), len(joined) + 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.zeros(m, U64)
    for k in range(n):
        h = h * U64(WORD_BASE) + words[k : k + m]
    return mixed(h + U64(n))


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences."""
    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unplaned(planes: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(planes, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=U64)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _places(number: np.ndarray, edges: np.ndarray, inner: int) -> np.ndarray:
    """Places of ids in the order of packs; equal ids share one, and greater ids never come before."""
    at = np.searchsorted(edges, number)
    if inner == 1 or len(edges) < 2:
        return at * inner
    low, high = edges[np.clip(at - 1, 0, None)].astype(np.float64), edges[np.clip(at, None, len(edges) - 1)].astype(np.float64)
    share = np.clip((number.astype(np.float64) - low) / np.maximum(high - low, 1.0), 0.0, 1.0)
    share[(at == 0) | (at == len(edges))] = 0.0
    return at * inner + np.minimum((share * inner).astype(np.int64), inner - 1)


def _dealt(edges: np.ndarray, inner: int, hot: np.ndarray, parts: np.ndarray, null_parts: int):
    """Rows (doc_id, text) to one row for each pack in a batch. hot: sorted ids that are alone in their place, with their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            null = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            row = seen + np.arange(len(number))  # a task's rows come in one order, so a repeated task deals alike
            seen += len(number)
            part = np.where(null, row % null_parts, 0)
            if len(hot):
                k = np.minimum(np.searchsorted(hot, number), len(hot) - 1)
                part = np.where(~null & (hot[k] == number), row % parts[k], part)
            pack = (np.where(null, -1, _places(number, edges, inner)) << SUB) + part
            texts, rows = b.column(1).cast(pa.binary()), []
            for p in np.unique(pack).tolist():
                at = np.flatnonzero(pack == p)
                own = [texts[i].as_py() for i in at.tolist()]
                sizes = np.array([-1 if t is None else len(t) for t in own], "<i8")
                rows.append((p, number[at].astype("<i8").tobytes(), sizes.tobytes(), pa.compress(b"".join(t or b"" for t in own), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _schema(DEALT), strict=True)], schema=_schema(DEALT)) if rows else pa.RecordBatch.from_pylist([], schema=_schema(DEALT))

    return run


def documents(pack: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
    """Ids and texts of a pack's rows."""
    ids: list[int | None] = []
    texts: list[bytes | None] = []
    for number, own, size, packed in zip(*(pack.column(c).to_pylist() for c in ("pack", "ids", "sizes", "texts")), strict=True):
        ids += [None] * (len(own) // 8) if number < 0 else np.frombuffer(own, "<i8").tolist()
        sizes = np.frombuffer(size, "<i8").tolist()
        raw, at = pa.decompress(packed, sum(max(0, n) for n in sizes), "zstd", asbytes=True), 0
        for n in sizes:
            texts.append(None if n < 0 else raw[at : at + n])
            at += max(0, n)
    return ids, texts


class Packed:
    """Documents in packs, and the size of the bucket space."""

    def __init__(self, docs: DataFrame, keys_per_byte: float, kept_bits: int = 64, pack_bytes: int | None = None, bucket_keys: int = BUCKET_KEYS):
        spark = docs.sparkSession
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        size, rows, known = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count("doc_id")).first()
        buckets = max(1, size * keys_per_byte / bucket_keys)
        pack_bytes = pack_bytes or int(min(MOST_PACK_BYTES, max(PACK_BYTES, SLICE_KEYS * buckets / keys_per_byte)))
        n = max(1, min(rows, max(-(-size // pack_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))))
        cuts = min(n, MOST_CUTS)
        shares = [i / cuts for i in range(1, cuts)]
        found = (docs.agg(F.percentile_approx("doc_id", shares, 100 * cuts)).first()[0] if shares and known else None) or []
        often = {v: k for v, k in Counter(found).items() if k > 1}  # an id with the rows of several packs
        edges = np.array(sorted({*found, *(max(v - 1, -(2**63)) for v in often)}), np.int64)
        hot = np.array(sorted(often), np.int64)
        parts = np.array([often[v] * -(-n // cuts) + 1 for v in sorted(often)], np.int64)
        self.bits = max(LEAST_BITS, int(np.ceil(np.log2(buckets))))
        self.dropped = max(0, 64 - self.bits - kept_bits)
        null_parts = max(1, -(-n * (rows - known) // max(1, rows)))
        self.docs = docs.mapInArrow(_dealt(edges, -(-n // cuts), hot, parts, null_parts), DEALT)

    @property
    def cut(self) -> Callable[[np.ndarray], np.ndarray]:
        """Takes keys to the bits that are compared."""
        dropped = self.dropped
        return lambda keys: keys >> U64(dropped)

    def asked(self, keys_of: Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]], counted: bool, skip_null: bool = False) -> DataFrame:
        """Slices (ASKED) of each pack's distinct keys. keys_of: texts to sorted distinct keys, after cut(), and their counts."""
        top = 64 - self.bits - self.dropped

        def run(pack: pa.Table) -> pa.Table:
            number = pack.column("pack")[0].as_py()
            if skip_null and number < 0:
                return pa.table([[]] * 5, schema=_schema(ASKED))
            keys, counts = keys_of(documents(pack)[1])
            bucket = (keys >> U64(top)).astype(np.int64)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(keys)]
            part = list(zip(edge[:-1], edge[1:], strict=True))
            low = keys & U64((1 << top) - 1)
            c = [squeezed(counts[a:b].astype("<i4").tobytes()) if counted else None for a, b in part]
            return pa.table([[int(bucket[a]) for a, _ in part], [number] * len(part), [b - a for a, b in part], [_planes(low[a:b]) for a, b in part], c], schema=_schema(ASKED))

        return self.docs.groupBy("pack").applyInArrow(run, ASKED)

    def answered(self, asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], form: Callable[[np.ndarray], bytes]) -> DataFrame:
        """Answers (ANSWERED) in the order asked. answer: sorted keys of a bucket, the places of their packs and counts to a value each."""

        def run(bucket: pa.Table) -> pa.Table:
            rows = sorted(bucket.to_pylist(), key=lambda r: r["pack"])
            size = [r["n"] for r in rows]
            keys = np.concatenate([_unplaned(r["planes"], r["n"]) for r in rows])
            packs = np.repeat(np.array([r["pack"] >> SUB for r in rows], np.int64), size)
            counts = None if rows[0]["counts"] is None else np.concatenate([np.frombuffer(unsqueezed(r["counts"]), "<i4") for r in rows])
            order = np.argsort(keys, kind="stable")  # ties stay in the order of packs
            value = answer(keys[order], packs[order], None if counts is None else counts[order])
            back = np.empty(len(keys), value.dtype)
            back[order] = value
            cut = np.cumsum(size)[:-1]
            return pa.table([[r["bucket"] for r in rows], [r["pack"] for r in rows], [squeezed(form(x)) for x in np.split(back, cut)]], schema=_schema(ANSWERED))

        return asked.groupBy("bucket").applyInArrow(run, ANSWERED)

    def resolved(self, answers: DataFrame, finish: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
        """finish(documents of a pack, its answers in the order of its sorted keys) for every pack."""

        def run(pack: pa.Table, got: pa.Table) -> pa.Table:
            rows = sorted(zip(got.column("bucket").to_pylist(), got.column("answer").to_pylist(), strict=True), key=lambda r: r[0])
            return finish(pack, [unsqueezed(r[1]) for r in rows])

        return self.docs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
