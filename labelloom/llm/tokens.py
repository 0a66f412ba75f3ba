"""Token-ID output: documents as fixed-stride binary shards in a permuted training order.

Each document is tokenised with a public byte-level BPE vocabulary of up to 65,535
tokens, ends with an end token, the number after the vocabulary's last, and is cut
into sequences of ``length`` tokens, the last one filled with end tokens. A byte-level vocabulary makes at most one token of a byte, so a document of
n bytes is given the (n + 1) / length numbers, rounded up, that its sequences
could need; a keyed Feistel permutation with cycle walking over all these
numbers gives every sequence its place. Each range of ``per_shard`` places is a
shard file, which holds its sequences in the order of their places, one record
of fixed size each. With the shards' counts (``manifest``) slot s of the whole
order is found by arithmetic alone, so reading can start or resume anywhere.

A record: doc_id int64 (NO_ID for null), part int32, number of real tokens
int32, then ``length`` token ids as uint16, all little-endian.

Numbers follow the order of the input files and of the rows in them. Bytes are
summed for each split of a file (a range that one task reads whole, in order);
prefix sums over the splits give each its first number, and a running count in
the scan does the rest, whatever the splits are and however often a task is
repeated. Rows are dealt to shards by range partitioning; the ranges are known,
so nothing is sampled. A task writes its shards under temporary names and
renames them, so a lost or repeated task leaves the same files.

Defined results: a null or empty text is one sequence of end tokens alone with no
real tokens; repeated rows, and equal texts, are written each; a long text has as
many sequences as it needs; an empty table writes no file; other columns are
ignored; a vocabulary of more tokens raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, new_path, stored
from labelloom.llm.permute import permuted

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits of the input up to which their numbers are broadcast; more are joined by a shuffle that keeps the rows' order.
MOST_SPLITS = 200_000
LENGTH = 256
PER_SHARD = 16_384
KEY = "training-order-1"
NO_ID = -(2**63)
#: Words that a tokenizer remembers.
MEMO = 700_000
#: Fixed value: the split pattern of the public byte-level BPE vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Encodes and decodes with a ranks file; words seen before are looked up.

    A single space between other characters always starts a new token, so texts
    without double spaces are cut there; words that are new are encoded together,
    and their tokens come apart again where a token starts with a space.
    """

    def __init__(self, path: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        if self.end >= 2**16:
            raise ValueError("the vocabulary has more tokens than two bytes can tell apart")
        self.own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(self.end, bool)
        self.spaced[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.words: dict[str, bytes] = {}  # keys have lost the space in front

    def _plain(self, text: str) -> bytes:
        return np.array(self.own.encode_ordinary(text), "<u2").tobytes()

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.own.encode_ordinary(" " + " ".join(words)), "<u2")
        raw, cut = ids.tobytes(), (2 * np.flatnonzero(self.spaced[ids])).tolist()
        for w, a, b in zip(words, cut, [*cut[1:], len(raw)], strict=True):
            self.words[w] = raw[a:b]

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not first or not all(words):
            return self._plain(text)
        if len(self.words) >= MEMO:
            self.words.clear()
        table = self.words
        if new := {w for w in words if w not in table}:
            self._learn(list(new))
        return self._plain(first) + b"".join([table[w] for w in words])

    def decode(self, tokens: bytes) -> str:
        return self.own.decode(np.frombuffer(tokens, "<u2").tolist())


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def stride(length: int) -> int:
    return 16 + 2 * length


def sequences(n_tokens: int, length: int) -> int:
    """How many sequences n tokens and END fill."""
    return -(-(n_tokens + 1) // length)


def numbers(n_bytes: int, length: int) -> int:
    """How many sequences a document of n bytes can need."""
    return -(-(n_bytes + 1) // length)


def _cut(vocabulary: str, length: int):
    """Rows (doc_id, text, file, start, first) to a row for each sequence: number, doc_id, part, low and high bytes of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, at = tokenizer(vocabulary), dict[tuple[str, int], int]()
        for b in batches:
            ids, texts, files, starts, firsts = (c.to_pylist() for c in b.columns)
            sizes = pc.fill_null(pc.binary_length(b.column(1).cast(pa.binary())), 0).to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, text, file, start, first, size in zip(ids, texts, files, starts, firsts, sizes, strict=True):
                full = np.frombuffer(t.encode(text or ""), np.uint8).reshape(-1, 2)
                number = at.setdefault((file, start), first)
                at[file, start] = number + numbers(size, length)
                n = sequences(len(full), length)
                out[0].extend(range(number, number + n))
                out[1].extend([doc_id] * n)
                out[2].extend(range(n))
                out[3].extend([full[k * length : (k + 1) * length].T.tobytes() for k in range(n)])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["number", "doc_id", "part", "planes"])

    return run


def _records(ids: np.ndarray, parts: np.ndarray, planes: list[bytes], length: int, end: int) -> np.ndarray:
    """Records as rows of bytes."""
    out = np.empty((len(planes), stride(length)), np.uint8)
    n = np.array([len(p) // 2 for p in planes], "<i4")
    out[:, :8] = ids.astype("<i8").view(np.uint8).reshape(-1, 8)
    out[:, 8:12] = parts.astype("<i4").view(np.uint8).reshape(-1, 4)
    out[:, 12:16] = n.view(np.uint8).reshape(-1, 4)
    tokens = out[:, 16:].reshape(len(planes), length, 2)
    tokens[:] = np.array([end], "<u2").view(np.uint8)
    whole = np.flatnonzero(n == length)
    if len(whole):
        tokens[whole] = np.frombuffer(b"".join([planes[i] for i in whole.tolist()]), np.uint8).reshape(len(whole), 2, length).transpose(0, 2, 1)
    for i in np.flatnonzero(n < length).tolist():
        tokens[i, : n[i]] = np.frombuffer(planes[i], np.uint8).reshape(2, -1).T
    return out


def _writer(path: str, length: int, per_shard: int, end: int):
    """Rows (slot, doc_id, part, planes) in the order of slots to shard files; a row for each file: shard, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        now, out, count, tmp, done = None, None, 0, "", []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(tmp, f"{root}/shard-{now:08d}.bin")
                done.append((now, count, count * stride(length)))
                out = None

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(0).to_numpy() // per_shard
            rows = _records(b.column(1).fill_null(NO_ID).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist(), length, end)
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                if shard[a] != now:
                    close()
                    now, count = int(shard[a]), 0
                    tmp = f"{root}/_part-{now:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                out.write(rows[a:z].tobytes())
                count += z - a
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["shard", "records", "bytes"])

    return run


def write_shards(spark: SparkSession, documents: str, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY) -> DataFrame:
    """Writes the shards of Parquet documents (doc_id, text) below path, a folder all executors reach; gives shard, records, bytes.

    The source is a path and not a DataFrame, because a split's rows must reach one task in their order.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    source = ("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index")
    rows = spark.read.parquet(documents).select(F.col("doc_id").cast("long"), "text", *source).toDF("doc_id", "text", "file", "start", "row")
    most = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + length) / length)
    splits = rows.groupBy("file", "start").agg(F.sum(most).alias("n"))  # one row for each split of the input files
    firsts = stored(splits.select("file", "start", "n", (F.sum("n").over(W.orderBy("file", "start")) - F.col("n")).alias("first")))
    n_splits, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = firsts.drop("n")
    if n_splits <= MOST_SPLITS:
        known = rows.join(F.broadcast(firsts), ["file", "start"])  # a task reads its splits' rows in their order
    else:
        known = rows.join(firsts, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "row")
    cut = known.select("doc_id", "text", "file", "start", "first").mapInArrow(_cut(vocabulary, length), "number long, doc_id long, part int, planes binary")
    placed = cut.select(permuted(F.col("number"), max(total, 1), key).alias("slot"), "doc_id", "part", "planes")
    shards = max(1, -(-total // per_shard))
    # Slots are evenly spread, so the ranges are known without sampling; they hold whole shards: a file never has two writers.
    parts = min(shards, 10_000)
    spread = placed.repartitionById(parts, F.expr(f"CAST((slot div {per_shard}L) * {parts} div {shards} AS INT)")).sortWithinPartitions("slot")
    return spread.select("slot", "doc_id", "part", "planes").mapInArrow(_writer(path, length, per_shard, tokenizer(vocabulary).end), "shard long, records long, bytes long")


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """shard, first_slot and records of every shard, from the files' sizes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    sizes = files.select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), F.floor(F.col("length") / stride(length)).alias("records"))
    return sizes.select("shard", (F.sum("records").over(W.orderBy("shard")) - F.col("records")).alias("first_slot"), "records")  # a row for each file


def read_shards(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """slot, shard, byte_offset, doc_id, part, n_tokens and tokens of every record, read from the files."""
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = int(name[-12:-4])
                rows = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, size)
                head = np.ascontiguousarray(rows[:, :16])
                ids, nums = head[:, :8].copy().view("<i8").ravel(), head[:, 8:].copy().view("<i4")
                at = np.arange(len(rows))
                tokens = [bytes(r[16 : 16 + 2 * n]) for r, n in zip(rows, nums[:, 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard), pa.int64()), pa.array(at * size), pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(nums[:, 0].astype(np.int64)), pa.array(nums[:, 1].astype(np.int64)), pa.array(tokens, pa.binary())],
                    names=["shard", "byte_offset", "doc_id", "part", "n_tokens", "tokens"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select("path", "content")
    rows = files.mapInArrow(run, "shard long, byte_offset long, doc_id long, part long, n_tokens long, tokens binary")
    first = manifest(spark, path, length).select("shard", "first_slot")
    return rows.join(bounded(first), "shard").select((F.col("first_slot") + F.floor(F.col("byte_offset") / size)).alias("slot"), "shard", "byte_offset", "doc_id", "part", "n_tokens", "tokens")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents, reads every record back; one row for each sequence."""
    path = new_path(spark, "tokens")
    written = write_shards(spark, f"{sf_dir}/documents.parquet", path).agg(F.count("*")).first()[0]
    columns = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens"]
    if not written:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in columns) + ", tokens_crc32 long")
    return read_shards(spark, path).select(*columns, F.crc32("tokens").alias("tokens_crc32"))
