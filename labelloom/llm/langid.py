"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of labelled documents. It reads a text as consecutive stretches
of STRETCH bytes, runs one gated recurrent unit from each end, and labels every
byte with probabilities of the learned languages; a document's probabilities are
the mean over all its bytes. Prediction reads whole texts and nothing else.

The sample: for each language the SAMPLE_DOCS labelled documents with the least
md5 of doc_id and text, rows that agree in both counting once, and of each WINDOWS
stretches at fixed places spread over the text. Only rows below a bound of the md5,
which follows from an estimate of a language's distinct rows, are ranked. At most
``most_languages`` languages are learned; more raise an error.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is nothing to learn from; a null doc_id is learned from
like any other; repeated rows are predicted one by one; texts are read whole,
however long; columns lang_pred and score that the documents came with are
replaced, others passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import row_key, table

HIDDEN = 8
STRETCH = 64
SAMPLE_DOCS = 400
WINDOWS = 4
STEPS = 200
BATCH = 256
RATE = 0.02
MOST_LANGUAGES = 200
SEED = 7
#: Stretches that run together; bounds a worker's memory.
TOGETHER = 4096
UNKNOWN = "und"


@dataclass
class Network:
    """languages and parameters by name: x (256, 3h), u (h, 3h) for each direction f and b; out (2h, k), bias (k)."""

    languages: list[str]
    p: dict[str, np.ndarray]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Summed probabilities over each row's bytes, shape (rows, languages). rows: bytes (n, STRETCH), zero after the end."""
        n, steps = rows.shape
        h, k = len(self.p["uf"]), len(self.languages)
        states = np.empty((steps, 2 * h, n), np.float32)
        cols = np.ascontiguousarray(rows.T)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            half = np.repeat([0.5, 0.5, 1.0], h).astype(np.float32)  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
            x = np.ascontiguousarray((self.p["x" + d] * half).astype(np.float32))
            u = np.ascontiguousarray((self.p["u" + d] * half).T.astype(np.float32))
            at = np.zeros((h, n), np.float32)
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            for t in order:
                seen = np.take(x, cols[t], axis=0).T
                g = u @ at
                gates = np.tanh(g[: 2 * h] + seen[: 2 * h])
                gates += 1
                gates *= 0.5
                new = gates[h:]
                new *= g[2 * h :]
                new += seen[2 * h :]
                np.tanh(new, out=new)
                at = at - new
                at *= gates[:h]
                at += new
                at *= cols[t] > 0  # a run from the end starts at the last byte
                states[t, part] = at
        out, bias = self.p["out"].T.astype(np.float32), self.p["bias"].astype(np.float32)[:, None]
        total = np.zeros((k, n), np.float32)
        for t in range(steps):
            e = out @ states[t]
            e += bias
            e -= e.max(axis=0)
            np.exp(e, out=e)
            e *= (cols[t] > 0) / e.sum(axis=0)
            total += e
        return total.T


def _forward(x: np.ndarray, u: np.ndarray, cols: np.ndarray, order: list[int]) -> tuple[np.ndarray, list]:
    h, n = len(u), cols.shape[1]
    at, kept, states = np.zeros((n, h)), [], np.zeros((len(order), n, h))
    for t in order:
        seen, g = x[cols[t]], at @ u
        zr = 1 / (1 + np.exp(-(seen[:, : 2 * h] + g[:, : 2 * h])))
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(seen[:, 2 * h :] + r * g[:, 2 * h :])
        live = (cols[t] > 0)[:, None]
        kept.append((t, at, z, r, new, g[:, 2 * h :], live))
        at = (new + z * (at - new)) * live
        states[t] = at
    return states, kept


def _backward(u: np.ndarray, cols: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, du, back = np.zeros((256, u.shape[1])), np.zeros_like(u), np.zeros_like(d_states[0])
    for t, before, z, r, new, gn, live in reversed(kept):
        d = (d_states[t] + back) * live
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * gn * r * (1 - r)
        np.add.at(dx, cols[t], np.hstack([d_z, d_r, d_new]))
        d_g = np.hstack([d_z, d_r, d_new * r])
        du += before.T @ d_g
        back = d * z + d_g @ u.T
    return dx, du


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network from byte stretches (n, length) and their language numbers; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    k, h = len(languages), hidden
    p = {"out": rng.normal(0, 0.3, (2 * h, k)), "bias": np.zeros(k)}
    for d in "fb":
        p |= {"x" + d: rng.normal(0, 0.5, (256, 3 * h)), "u" + d: rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))}
    m, v = {n: np.zeros_like(a) for n, a in p.items()}, {n: np.zeros_like(a) for n, a in p.items()}
    by_language = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, batch // k)) for own in by_language])  # each language alike
        cols, y = np.ascontiguousarray(rows[pick].T), labels[pick]
        n = len(pick)
        runs = {d: _forward(p["x" + d], p["u" + d], cols, list(range(len(cols)))[:: 1 if d == "f" else -1]) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logits = states @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(n), y] -= 1
        d *= (cols > 0)[:, :, None] / max(1, (cols > 0).sum())
        grad = {"out": np.einsum("tnh,tnk->hk", states, d), "bias": d.sum(axis=(0, 1))}
        d_states = d @ p["out"].T
        for name, own in (("f", d_states[:, :, :h]), ("b", d_states[:, :, h:])):
            grad["x" + name], grad["u" + name] = _backward(p["u" + name], cols, runs[name][1], own)
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        for name, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            p[name] -= rate * (1 - step / (steps + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return Network(languages, p)


def stretched(text: bytes) -> bytes:
    """The text filled up with zeros to whole stretches."""
    return text.ljust(-(-max(1, len(text)) // STRETCH) * STRETCH, b"\0")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sampled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> DataFrame | None:
    """lang, key and parts (WINDOWS stretches) of each language's sample; None if no row has both text and lang."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.05).alias("n")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return None
    # Three times the sample's share of a language's keys; all of them where that is not clearly less.
    bounds = {r["lang"]: f"{int(2**32 * 3 * sample_docs / r['n']):08x}" for r in sizes if r["n"] > 4 * sample_docs}
    if bounds:
        bound = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
        rows = rows.filter(F.substring("key", 1, 8) < F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit("g")))
    n = F.length("text")
    parts = F.array(*(F.substr("text", F.floor(n * i / WINDOWS).cast("int") + 1, F.lit(STRETCH)) for i in range(WINDOWS)))
    once = rows.select("lang", "key", parts.alias("parts")).groupBy("lang", "key").agg(F.min("parts").alias("parts"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).drop("rank")


def learned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES, **how) -> Network | None:
    """A network from a bounded sample of docs (doc_id, text, lang); None if no row has both text and lang."""
    sample = sampled(docs, sample_docs, most_languages)
    if sample is None:
        return None
    got = sample.orderBy("lang", "key").collect()  # most_languages * sample_docs rows at most
    languages = sorted({r["lang"] for r in got})
    parts = [(languages.index(r["lang"]), p) for r in got for p in r["parts"]]
    data = np.frombuffer(b"".join(stretched(p.encode()[:STRETCH]) for _, p in parts), np.uint8).reshape(-1, STRETCH)
    return train(data, np.array([k for k, _ in parts]), languages, **how)


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds lang_pred and score to the columns of docs, but for text."""
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    own = docs.select(*keep, "text").toDF(*(f"c{i}" for i in range(len(keep) + 1)))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            have = [i for i, t in enumerate(texts) if network is not None and t.is_valid and letter.search(t.as_py())]
            raw = texts.cast(pa.binary())
            for part in _portions(have, [len(raw[i].as_buffer()) for i in have]):
                data = [stretched(raw[i].as_py()) for i in part]
                rows = np.frombuffer(b"".join(data), np.uint8).reshape(-1, STRETCH)
                sums = np.concatenate([network.probabilities(rows[k : k + TOGETHER]) for k in range(0, len(rows), TOGETHER)])
                n = np.array([len(x) // STRETCH for x in data])
                pooled = np.add.reduceat(sums.astype(np.float64), np.cumsum(n) - n)
                pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)
                for i, best, s in zip(part, pooled.argmax(axis=1).tolist(), pooled.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = network.languages[best], min(1.0, s)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return own.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def _portions(rows: list[int], size: list[int], most: int = STRETCH * TOGETHER) -> Iterator[list[int]]:
    """Runs of rows of about ``most`` bytes together."""
    part, held = [], 0
    for i, n in zip(rows, size, strict=True):
        part.append(i)
        held += n
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    network = learned(docs)
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), network)
