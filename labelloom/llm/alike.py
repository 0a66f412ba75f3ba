"""Groups of texts whose five-word shingles overlap by four fifths or more.

Texts with one set of shingles are one set. Sets are linked if their Jaccard
similarity is 0.8 or more, which is computed from the whole sets; pairs to compare
come from two indexes.

The first is the Gray-order index of SimHash (see simhash): its links, at MOST
differing bits, find most copies, but a pair at 0.8 differs in ten bits on average.
The second completes it with MinHash: a pair of similarity s shares none of BANDS
bands of ROWS minima with a chance of (1 - s**8)**64, that is 8e-6 at 0.8 and 1e-15
at 0.9, while texts that have only passages in common hardly ever meet: 0.4 % of
them at 0.3. Two bits of every minimum make a sketch, and pairs that agree in fewer
than LEAST_SAME are left out; at 0.8 that is two in a million.

The members of a band are compared pair by pair up to FEW. In a larger band all are
first compared with its hub, the member that meets most others, which brings most of
a group of near copies together. What is still apart is compared by sketches inside
tasks, in parts of PART members, and a task hands on a spanning forest of the pairs
that are surely alike (SURE) and the doubtful pairs between its trees: never all
pairs of a group.

Sets are known by 64-bit hashes; an error has a chance of n*n/2**65 over n sets.
A text without words, or null, has the empty set; fewer words than a shingle make
one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, seeded, stored
from labelloom.llm.graph import Forest, components
from labelloom.llm.simhash import links, majority, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 64, 8
#: Of the 512 minima, how many must agree in their two bits, how many are expected at 0.8, and how many make a pair surely alike (0.88).
LEAST_SAME, LIKELY, SURE = 397, 435, 466
#: Members of a band that are all compared at once, and of a part of a larger one.
FEW, PART = 12, 2048
SIGNED = "n long, set long, fp long, bands array<long>, sketch array<long>"
_TIMES = np.array(seeded("alike-times", BANDS * ROWS, 2**64), np.uint64) | np.uint64(1)
_PLUS = np.array(seeded("alike-plus", BANDS * ROWS, 2**64), np.uint64)


def shingles(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash of each band of minima."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch(least: np.ndarray) -> np.ndarray:
    """Two upper bits of each minimum, 32 in a word."""
    two = (least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(62)
    return (two.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_LOW = 0x5555555555555555


def same(a: str, b: str) -> str:
    """How many minima agree in two sketches, in SQL."""
    return f"{BANDS * ROWS} - aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (n, v) -> n + bit_count((v | shiftright(v, 1)) & {_LOW}L))"


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = _long_lists([shingles(list(shingle_hashes(t.as_py(), SHINGLE))) for t in b.column(b.num_columns - 1).cast(pa.binary())])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "h"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    none = np.zeros(0, np.uint64)
    for b in batches:
        n, sets, fps, keys, sketches = [], [], [], [], []
        for t in b.column(b.num_columns - 1).cast(pa.binary()):
            parts = list(shingle_hashes(t.as_py(), SHINGLE))
            h = shingles(parts)
            least = minima(h)
            n.append(len(h))
            sets.append(xxh64_intdigest(h.tobytes(), 42))
            fps.append(majority(parts))
            keys.append(bands(least) if len(h) else none)
            sketches.append(sketch(least) if len(h) else none)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        columns = [*b.columns[:-1], pa.array(np.array(n, np.int64)), signed(sets), signed(fps), _long_lists(keys), _long_lists(sketches)]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "n", "set", "fp", "bands", "sketch"])


def with_signature(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and of text: n shingles, set (their hash), fp (SimHash of them), the hashes of its bands and its sketch."""
    kept = df.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_signed, f"{schema}, {SIGNED}")


def _close(a: str, b: str) -> str:
    """Whether sizes a and b allow a similarity of 0.8."""
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


class _Compared:
    """Compares pairs of sets; each pair once. sets: set, n, sketch, __key (of one row with that text); texts: __key, text."""

    def __init__(self, sets: DataFrame, texts: DataFrame):
        self.sets, self.texts = sets, texts
        self.tried = self.links = sets.sparkSession.createDataFrame([], "a long, b long")

    def add(self, pairs: DataFrame, sketched: bool = False) -> None:
        """pairs: a, b; repeats are welcome. sketched: their sketches have been compared."""
        j = pairs.distinct().join(self.tried, ["a", "b"], "left_anti")
        if not sketched:
            side = lambda x: self.sets.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
            j = j.join(side("a"), "a").join(side("b"), "b").filter(_close("na", "nb")).filter(f"{same('sa', 'sb')} >= {LEAST_SAME}")
        now = stored(j.select("a", "b"))
        either = now.select(F.col("a").alias("set")).distinct().union(now.select("b").distinct()).distinct()
        keys = either.join(self.sets.select("set", "__key"), "set")
        lists = stored(self.texts.join(bounded(keys), "__key").dropDuplicates(["set"]).select("set", "text").mapInArrow(_listed, "set long, h array<long>"))
        both = now.join(lists.toDF("a", "ha"), "a").join(lists.toDF("b", "hb"), "b")
        alike = both.filter(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")
        self.links, self.tried = stored(self.links.unionByName(alike)), self.tried.unionByName(now)


def _block(h: int, sets: np.ndarray, component: np.ndarray, own: np.ndarray, sketches: np.ndarray, keys: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one part of a band to compare: a forest of the likely ones, or at last of the sure ones with the doubtful ones between its trees."""
    n, inside = len(sets), (own == own[0]).all()
    _, at, size = np.unique(component, return_inverse=True, return_counts=True)
    if len(size) < 2:
        return sets[:0], sets[:0]
    rest = np.flatnonzero(at != size.argmax())  # pairs inside the largest component are done
    place = np.full(n, -1)
    place[rest] = np.arange(len(rest))
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, 250_000 // n)
    for i in range(0, len(rest), step):
        some = rest[i : i + step]
        agree = np.full((len(some), n), BANDS * ROWS, np.int32)
        for w in range(sketches.shape[1]):
            x = sketches[some, w][:, None] ^ sketches[None, :, w]
            agree -= np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW))
        near = (agree >= (LEAST_SAME if last else LIKELY)) & (at[some][:, None] != at[None, :]) & (place[None, :] < place[some][:, None])
        if not inside:
            near &= own[some][:, None] != own[None, :]
        r, c = np.nonzero(near)
        a = some[r]
        shared = keys[a] == keys[c]
        first = keys[a, shared.argmax(axis=1)] == h  # a pair is looked at in the first band that it shares
        found.append((a[first], c[first], agree[r, c][first]))
    a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    forest, sure = Forest(n), agree >= (SURE if last else LIKELY)
    fa, fb = forest.join(a[sure], b[sure])
    a, b = a[~sure], b[~sure]
    doubtful = forest.up[a] != forest.up[b]
    return sets[np.concatenate([fa, a[doubtful]])], sets[np.concatenate([fb, b[doubtful]])]


def _doubtful(last: bool):
    """Over rows (h, part, set, component, own, sketch, bands) sorted by h and part: pairs a, b of every part."""

    def matrix(c: pa.Array) -> np.ndarray:
        return c.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(c), -1)

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        if rows:
            h, _, sets, component, own, sketches, keys = (np.concatenate(x) for x in zip(*rows, strict=True))
            a, b = _block(np.uint64(h[:1].view(np.uint64)[0]), sets, component, own, sketches, keys, last)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [matrix(batch.column(i)) for i in (5, 6)]
            turn = (np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1).tolist()
            if held and (held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
                yield from flush(held)
                held = []
            edges = [0, *turn, batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                held.append([r[i:j] for r in rows])
                if j < batch.num_rows:
                    yield from flush(held)
                    held = []
        yield from flush(held)

    return run


def _still_apart(members: DataFrame, nodes: DataFrame, prints: DataFrame, part: int, last: bool) -> DataFrame:
    """Pairs (a, b) of different components that larger bands leave to compare. members: h, set."""
    at = members.join(nodes.toDF("set", "component"), "set", "left").select("h", "set", F.coalesce("component", "set").alias("component"))
    open_ = at.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    k = F.ceil(2 * F.col("m") / part).cast("int")  # parts of which each two make a block
    whole = F.col("m") <= part
    rows = at.join(open_.select("h", F.when(whole, 1).otherwise(k).alias("k")), "h")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("k")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("part", F.least("own", "with") * F.col("k") + F.greatest("own", "with"))
    need = bounded(rows.select("set").distinct())
    kept = prints.join(need, "set", "left_semi").groupBy("set").agg(F.min("sketch").alias("sketch"), F.min("bands").alias("bands"))
    rows = rows.select("h", "part", "set", "component", "own").join(kept, "set").select("h", "part", "set", "component", "own", "sketch", "bands")
    return rows.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_doubtful(last), "a long, b long")


def grouped(prints: DataFrame, texts: DataFrame, few: int = FEW, part: int = PART) -> DataFrame:
    """set and component of the sets that are linked. prints: with_signature's rows with __key; texts: __key, text."""
    some = prints.filter("n > 0")
    sets = stored(some.groupBy("set").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("__key").alias("__key")))
    compared = _Compared(sets, texts)
    heads = sets.groupBy("fp").agg(F.min("set").alias("head"))
    near = links(heads.select("fp")).join(heads.toDF("a", "sa"), "a").join(heads.toDF("b", "sb"), "b")
    found = _ordered(sets.join(heads, "fp"), "set", "head").unionByName(_ordered(near, "sa", "sb"))
    rows = some.select("set", F.explode("bands").alias("h"))
    keys = rows.groupBy("h").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    members = stored(rows.join(keys, "h").select("h", "set", "m").distinct())  # m counts copies of a text as well
    small, large = members.filter(F.col("m") <= few), members.filter(F.col("m") > few)
    every = small.select("h", "set").join(small.select("h", F.col("set").alias("other")), "h").filter("set < other")
    met = large.join(large.groupBy("set").agg(F.sum("m").alias("met")), "set")
    hubs = met.groupBy("h").agg(F.max(F.struct("met", "set")).alias("hub")).select("h", F.col("hub.set").alias("hub"))
    compared.add(found.unionByName(_ordered(every, "set", "other")).unionByName(_ordered(large.join(hubs, "h"), "set", "hub")))
    nodes = stored(components(compared.links))
    for last in (False, True):
        apart = stored(_still_apart(large.select("h", "set"), nodes, prints, part, last))
        if not apart.isEmpty():
            compared.add(_ordered(apart, "a", "b"), sketched=True)
            nodes = stored(components(compared.links))
    return nodes.select(F.col("node").alias("set"), "component")
