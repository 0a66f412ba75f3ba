"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint bit is set if it is set in over half of the text's shingle hashes.
Distinct fingerprints are linked if at most ``most`` bits differ.

The index has its uppermost nodes as Spark keys: cut 64 bits into ``bands``; two
fingerprints that differ in ``most`` bits agree on ``bands - most`` of them, so
each choice of that many bands is a mask, and a masked pattern is a node that
shares those bits. A mask keeps as many of its leading bits as make nodes of about
NODE fingerprints, so that the work below a node is what the hierarchy prunes.

Below a node its fingerprints are sorted by Gray rank and runs of FANOUT of them
share nodes that keep the bits on which all agree, level by level. From the node's
root down, pairs of nodes carry the differences seen so far; each level adds those
on the bits that both have newly fixed, and as soon as a pair has more than
``most`` all pairs below it are pruned. Pairs that reach the leaves are links; of
these a task hands on a spanning forest, never all pairs of a group.

The number of bands follows the number of fingerprints. Members of nodes with over
``hot`` fingerprints go to the nodes of most + 4 bands (32 shared bits, 70 masks for
four bits) instead; what is still hot there is dealt into parts of ``hot`` / 2, and
each two parts are one node, so that no task holds more than ``hot``.

Defined results: a text without words, or null, has fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; a null doc_id
is linked but is no component's id unless all are null; repeated rows share a
component; very long texts are hashed in parts of WORDS_AT_ONCE words; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, row_key, stored, table
from labelloom.llm.graph import Forest, components

SHINGLE = 4
MOST = 4
FANOUT = 4
#: Fingerprints of a node, on average, and at most before it is split.
NODE, HOT = 2048, 32_768
#: Node pairs that are expanded together; bounds a task's memory.
PAIRS = 8192
WORDS_AT_ONCE = 200_000


def shingle_hashes(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42) of a UTF-8 text's shingles, repeats included, lower-cased in A-Z, WORDS_AT_ONCE together."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return
    size = min(size, len(words))
    for i in range(0, len(words) - size + 1, WORDS_AT_ONCE):
        part = words[i : i + WORDS_AT_ONCE + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate(([0], ends[:-1]))
        m = len(part) - size + 1
        digests = [xxh64_digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
        yield np.frombuffer(b"".join(digests), ">u8")


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for p in parts:
        ones += np.unpackbits(p.view(np.uint8).reshape(len(p), 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(p)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text over its shingles."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.binary())
        fp = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])


def with_fingerprint(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint of text as a signed long."""
    kept = df.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_fingerprints, f"{schema}, fp long")


def masks(bands: int, most: int, bits: int = 64) -> list[int]:
    """Signed masks of the first ``bits`` bits, from above, of every choice of bands - most of the bands."""
    cut = [64 * i // bands for i in range(bands + 1)]
    out = []
    for chosen in combinations(range(bands), bands - most):
        places = [p for i in reversed(chosen) for p in range(cut[i + 1] - 1, cut[i] - 1, -1)]
        x = sum(1 << p for p in places[:bits])
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def bands_for(n: int, most: int) -> int:
    """The fewest bands whose nodes have NODE fingerprints on average at most."""
    for bands in range(most + 1, most + 4):
        if n >> (64 * (bands - most) // bands) <= NODE:
            return bands
    return most + 4


def bits_for(n: int) -> int:
    """Bits of a mask with which nodes have half of NODE to NODE fingerprints."""
    return max(0, -(-n // NODE) - 1).bit_length()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From leaves to roots: (pattern, mask of bits all below agree on, first child of each node and the end)."""
    both, either, of = fp, fp, group
    out = [(fp, np.full(len(fp), ~np.uint64(0)), np.arange(len(fp) + 1))]
    while True:
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        size = np.diff(np.append(edge, len(of)))
        if (size == 1).all() and len(out) > 1:
            return out
        runs = -(-size // FANOUT)
        first = np.repeat(edge, runs) + FANOUT * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
        of = of[first]
        out.append((both, ~(both ^ either), np.append(first, len(out[-1][0]))))


def _expanded(left: np.ndarray, right: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of left and a child of right, and the pair each comes from; for a node with itself each unordered pair once."""
    nl, nr = first[left + 1] - first[left], first[right + 1] - first[right]
    n = nl * nr
    pair = np.repeat(np.arange(len(left)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = first[left][pair] + k // nr[pair], first[right][pair] + k % nr[pair]
    keep = (left != right)[pair] | (a <= b)
    return a[keep], b[keep], pair[keep]


def linked(fp: np.ndarray, group: np.ndarray, most: int = MOST, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of all links inside groups. fp: sorted by group and then Gray rank.

    seen: gets (level, pairs, pairs left) of each step.
    """
    levels, forest, out_a, out_b = _levels(fp, group), Forest(len(fp)), [], []
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))

    def parts(level: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> list:
        return [(level, a[i : i + PAIRS], b[i : i + PAIRS], apart[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]

    stack = parts(top, roots, roots, np.zeros(len(roots), np.int8))
    while stack:
        level, ua, ub, apart = stack.pop()
        a, b, up = _expanded(ua, ub, levels[level][2])
        (pattern, mask, _), above = levels[level - 1], levels[level][1]
        new = mask[a] & mask[b] & ~(above[ua] & above[ub])[up]  # bits that both have fixed at this level
        apart = apart[up] + np.bitwise_count((pattern[a] ^ pattern[b]) & new).astype(np.int8)
        near = apart <= most
        if seen is not None:
            seen.append((level - 1, len(a), int(near.sum())))
        a, b, apart = a[near], b[near], apart[near]
        if level > 1:
            stack += parts(level - 1, a, b, apart)
        else:
            a, b = forest.join(a[a != b], b[a != b])
            out_a.append(a)
            out_b.append(b)
    return np.concatenate(out_a or [np.zeros(0, int)]), np.concatenate(out_b or [np.zeros(0, int)])


def _links_of_nodes(most: int):
    """Over rows (mask, node, part, fp) sorted by node: edges a, b of each node's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            *key, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            fp = fp.view(np.uint64)
            group = np.cumsum(np.concatenate(([False], _turns(key))))
            order = np.lexsort((gray_rank(fp), group))
            fp, group = fp[order], group[order]
            a, b = linked(fp, group, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not batch.num_rows:
                continue
            turn = np.flatnonzero(_turns(rows[:3])) + 1
            if held and any(h[-1] != r[0] for h, r in zip(held[-1][:3], rows[:3], strict=True)):
                turn = np.concatenate(([0], turn))
            if len(turn):  # the last node may go on in the next batch
                yield from flush([*held, [r[: turn[-1]] for r in rows]])
                held = [[r[turn[-1] :] for r in rows]]
            else:
                held.append(rows)
        yield from flush(held)

    return run


def _turns(key: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first has another key than the one before."""
    out = np.zeros(max(0, len(key[0]) - 1), bool)
    for k in key:
        out |= k[1:] != k[:-1]
    return out


def _nodes(fps: DataFrame, bands: int, most: int, bits: int = 64) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(bands * 1000 + i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("node")) for i, m in enumerate(masks(bands, most, bits))))
    return fps.select("fp", F.explode(parts).alias("n")).select("n.mask", "n.node", F.lit(0).alias("part"), "fp")


def _larger(nodes: DataFrame, hot: int) -> DataFrame:
    return stored(nodes.groupBy("mask", "node").agg(F.count("*").alias("n")).filter(F.col("n") > hot))


def links(fps: DataFrame, most: int = MOST, hot: int = HOT, bands: int | None = None, bits: int | None = None) -> DataFrame:
    """Edges a, b that connect all distinct fingerprints (column fp) within ``most`` bits."""
    n = fps.count()
    bands = bands or bands_for(n, most)
    nodes = _nodes(fps, bands, most, bits_for(n) if bits is None else bits)
    large = _larger(nodes, hot)
    if not large.isEmpty():
        crowded = nodes.join(large, ["mask", "node"], "left_semi").select("fp").distinct()
        nodes, fine = nodes.join(large, ["mask", "node"], "left_anti"), _nodes(crowded, most + 4, most)
        still = _larger(fine, hot)
        # Each member of a node that is still hot goes to the nodes of its part with every part.
        k = F.ceil(2 * F.col("n") / hot).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        dealt = fine.join(still.select("mask", "node", k.alias("k")), ["mask", "node"]).withColumns({"own": own, "with": F.explode(F.sequence(F.lit(0), F.col("k") - 1))})
        dealt = dealt.select("mask", "node", (F.least("own", "with") * F.col("k") + F.greatest("own", "with") + 1).alias("part"), "fp")
        nodes = nodes.unionByName(fine.join(still, ["mask", "node"], "left_anti")).unionByName(dealt)
    placed = nodes.repartition("mask", "node", "part").sortWithinPartitions("mask", "node", "part")
    return placed.mapInArrow(_links_of_nodes(most), "a long, b long")


def grouped(prints: DataFrame, most: int = MOST, **how) -> tuple[DataFrame, DataFrame]:
    """For rows (doc_id, fp): fp with its component, and component with component_id, its smallest doc_id."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = components(links(distinct.select("fp"), most, **how))
    of = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "rep")
    return of, of.groupBy("component").agg(F.min("rep").alias("component_id"))


def near_duplicates(prints: DataFrame, most: int = MOST, **how) -> DataFrame:
    """(doc_id, fp) with component_id."""
    of, ids = grouped(prints, most, **how)
    known = of.join(ids, "component").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(known, prints["fp"] == known["__fp"], "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of alike texts (see alike), the one with the smallest doc_id, with the columns it came with.

    Rows with one doc_id and text are one document; of these the row whose other columns have the least md5 stays.
    Only keys of rows that go, or that stand for several rows, meet the documents.
    """
    from labelloom.llm import alike

    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    c = {name: own[f"c{i}"] for i, name in enumerate(docs.columns)}
    keyed = own.withColumn("__key", row_key(c["doc_id"], c["text"]))
    texts = keyed.select("__key", c["text"].alias("text"))
    prints = stored(alike.with_signature(keyed.select(c["doc_id"].alias("doc_id"), c["text"].alias("text"), "__key"), "doc_id", "__key"))
    of = alike.grouped(prints, texts)
    first = prints.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("best"))  # copies meet here, before any join
    best = first.join(of, "set", "left").groupBy(F.coalesce("component", "set").alias("component")).agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.__key").alias("__key"), F.lit(True).alias("kept"))
    rows = prints.groupBy("__key").agg(F.count("*").alias("n")).join(keep, "__key", "left")
    apart = bounded(rows.filter("kept IS NULL OR n > 1").select("__key", F.coalesce("kept", F.lit(False)).alias("kept")))
    plain = keyed.join(apart.select("__key"), "__key", "left_anti")
    several = keyed.join(apart.filter("kept"), "__key").groupBy("__key").agg(F.min_by(F.struct(*own.columns), F.md5(F.to_json(F.struct(*own.columns)))).alias("r"))
    both = plain.select(*own.columns).unionByName(several.select(*(F.col(f"r.{x}").alias(x) for x in own.columns)))
    return both.toDF(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(with_fingerprint(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"))
    out = near_duplicates(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
