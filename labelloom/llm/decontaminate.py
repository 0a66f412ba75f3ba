"""Benchmark decontamination with one Aho-Corasick automaton over test windows.

Texts are lower-cased (A-Z), cut into words of ASCII letters, digits and all
characters beyond ASCII, and scanned once by an automaton of all ``window``-word
windows of the items (an item of fewer words is one window). The automaton reads
word numbers of a fixed width in bytes, so it has two nodes for a word of a window
where the items have up to 65,024 words; words that no item has are all zeros. A
word inside an occurrence is hit; runs of hit words are mapped back to character
offsets of the original text.

The items are a stated query set. Up to ``block_bytes`` of them make one automaton,
of about 300 bytes of memory for each byte; a larger set is read in blocks of that
size, each one more pass over the documents, so that memory stays bounded.

Defined results: a null text has no words and no hits; a null or wordless item
has no window; a null item_id counts as the empty string; rows repeated among
the items count once, and among the documents are scanned each; texts are scanned
whole, however long; an empty table of items hits nothing; columns that the
documents came with are passed on, whatever their names (scanned() replaces __scan).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import table

WINDOW = 13
BLOCK_BYTES = 800_000
#: Every byte that ends a word becomes a space; A-Z become a-z.
TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
ORIGINAL_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),  # pairs: first word, word after the last
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())),  # pairs of character offsets: start, end
    ]
)


class Windows:
    """An automaton over the items' windows; a window's value is (words, item ids)."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = text.split()
            for i in range(max(1, len(words) - window + 1)) if words else ():
                owners.setdefault(tuple(words[i : i + window]), set()).add(item_id)
        known = sorted({w for key in owners for w in key})
        self.width = 1
        while 255**self.width <= len(known):
            self.width += 1
        self.codes = {w: bytes(n // 255**k % 255 + 1 for k in range(self.width)) for n, w in enumerate(known)}
        self.unknown = bytes(self.width)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(b"".join([self.codes[w] for w in key]).decode("latin-1"), (len(key), tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """First word, word after the last, and items of every occurrence."""
        if not self.codes:
            return
        get, unknown, width = self.codes.get, self.unknown, self.width
        for end, (n, ids) in self.automaton.iter(b"".join([get(w, unknown) for w in words]).decode("latin-1")):
            if (end + 1) % width == 0:  # a match that starts inside a word's number is none
                yield (end + 1) // width - n, (end + 1) // width, ids


@lru_cache(maxsize=2)
def _windows(items: tuple[tuple[str, bytes], ...], window: int) -> Windows:
    return Windows(items, window)


def scan_text(text: bytes | None, windows: Windows) -> tuple[int, list[int], set[str], np.ndarray | None]:
    """Words, hit word ranges as pairs, items found, and for texts with hits a flag for each word."""
    words = (text or b"").translate(TO_WORDS).split()
    pairs, items = [], set()
    for first, last, ids in windows.found(words):
        pairs.append((first, last))
        items.update(ids)
    if not pairs:
        return len(words), [], set(), None
    return len(words), *_merged(pairs, len(words), items)


def _merged(pairs: list[tuple[int, int]], n: int, items: set[str]) -> tuple[list[int], set[str], np.ndarray]:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, [p[0] for p in pairs], 1)
    np.add.at(step, [p[1] for p in pairs], -1)
    hit = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.tolist(), items, hit


def offsets(text: str, ranges: list[int]) -> list[int]:
    """Character offsets in the original text of ranges of words."""
    import regex

    at = [m.span() for m in regex.finditer(ORIGINAL_WORD, text)]
    return [x for i in range(0, len(ranges), 2) for x in (at[ranges[i]][0], at[ranges[i + 1] - 1][1])]


def _pass(items: tuple[tuple[str, bytes], ...], window: int, text_at: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(items, window)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            before = None if first else batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                n, ranges, ids, hit = scan_text(text, windows)
                if before and before[k]["hits"]:
                    old = before[k]["hits"]
                    ranges, ids, hit = _merged([*zip(old[::2], old[1::2], strict=True), *zip(ranges[::2], ranges[1::2], strict=True)], n, ids | set(before[k]["items"]))
                spans = offsets(text.decode(), ranges) if last and ranges else []
                out.append({"n_words": n, "hits": ranges, "items": sorted(ids), "n_hit": int(hit.sum()) if hit is not None else 0, "spans": spans})
            scan = pa.array(out, pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int32()))]))
            kept = batch.columns if first else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, scan], names=[f"c{i}" for i in range(len(kept) + 1)])

    return run


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs and a struct column __scan (see SCAN)."""
    docs = docs.drop("__scan")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    items = items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {blocks}L)"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField(f"c{len(docs.columns)}", SCAN)])
    text_at = docs.columns.index("text")
    for j in range(blocks):
        rows = items.filter(F.col("block") == j).orderBy("item_id", "text").collect()  # one block, bounded by block_bytes
        block = tuple((r["item_id"], r["text"].encode().translate(TO_WORDS)) for r in rows)
        plain = plain.mapInArrow(_pass(block, window, text_at, j == 0, j == blocks - 1), schema)
    return plain.toDF(*docs.columns, "__scan")


def contaminated() -> F.Column:
    """Hit words make up a twentieth of the document or more."""
    return (F.col("__scan.n_hit") > 0) & (20 * F.col("__scan.n_hit") >= F.col("__scan.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    names = ["text" if c == "text" else f"in_{i}" for i, c in enumerate(docs.columns)]
    return scanned(docs.toDF(*names), benchmark).filter(~contaminated()).select(*names).toDF(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select(
        "doc_id",
        F.col("__scan.n_words").alias("n_words"),
        F.col("__scan.n_hit").alias("n_hit"),
        F.size("__scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__scan.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("__scan.spans").alias("hit_spans"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract's columns by plain search, for tests."""
    import regex

    cut = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple[str, ...], set[str]] = {}
    for item_id, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
