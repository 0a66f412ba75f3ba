"""Where phrases and anchors stand on labels: an inverted index of words, then spans grown from its hits.

Every word has a few keys: itself, its stem class, its first four characters and the
runs of four characters that an anchor could begin with. Anchors have the matching
keys, so the first word of an anchor meets words by equality; only these hits grow into
spans, over the label's words kept as one array. Which of an anchor's spans are
built is decided before they are: by the first anchor of each group that has one.

words: label_id, line, pos, word, x, y, w, h, confidence; (line, pos) is the reading order of a label.
anchors: columns of their own, kind (SEQUENCE, LINE or CLUSTER), targets (array of words), below (lines)
and width (pixels) of a cluster; with label_id they are that label's, else all labels'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.common import by_label

#: Stems by which a printed word stands for a target: class, beginnings of the word, parts of it, targets.
STEMS = (
    ("mrp", ("mrp",), (), ("mrp",)),
    ("mfg", ("mfg", "mfd"), (), ("mfg", "mfd")),
    ("exp", ("exp",), (), ("exp", "expiry")),
    ("ingredient", ("ingred", "inored"), (), ()),
    ("usp", ("usp",), ("saleprice",), ("usp",)),
)
#: Characters of a run, which is also the least length of words that match in part, less one; share of a word that a target must make up, and of a target that a word must.
RUN, PART_OF_WORD, PART_OF_TARGET = 4, 0.5, 0.7


def stripped(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores of any script."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\w]", "")


def _word_stem(s: Column, stem: tuple) -> Column:
    _, begins, parts, _ = stem
    out = F.lit(False)
    for b in begins:
        out = out | s.startswith(b)
    for p in parts:
        out = out | s.contains(p)
    return out


def _target_stem(t: Column, stem: tuple) -> Column:
    return t.startswith("ingredient") if stem[0] == "ingredient" else t.isin(*stem[3])


def same(word: Column, target: Column) -> Column:
    """Whether a stripped word matches a stripped target: equal, by a stem, or one holds the other with enough of its length."""
    n, m = F.length(word), F.length(target)
    stem = F.lit(False)
    for s in STEMS:
        stem = stem | (_target_stem(target, s) & _word_stem(word, s))
    part = (n >= RUN) & (m >= RUN) & F.when(word.contains(target), m >= PART_OF_WORD * n).otherwise(target.contains(word) & (n >= PART_OF_TARGET * m))
    # no empty word passes what follows; a test for it would be pushed below the join and strip every word a second time
    return (target != "") & ((word == target) | stem | part)


def token_matches(word: Column, target: Column) -> Column:
    """same, of words as printed."""
    return same(stripped(word), stripped(target))


def _runs(s: Column, share: float, mark: str) -> Column:
    """The runs of RUN characters that start within the first ``share`` of a word."""
    last = F.least(F.length(s) - RUN + 1, F.floor(share * F.length(s)).cast("int") + 1)
    return F.when(F.length(s) >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: F.concat(F.lit(mark), s.substr(p, F.lit(RUN)))))).otherwise(F.array().cast("array<string>"))


def _first(s: Column, mark: str) -> Column:
    return F.when(F.length(s) >= RUN, F.concat(F.lit(mark), F.left(s, F.lit(RUN))))


def word_keys(s: Column) -> Column:
    """Keys of a stripped word."""
    own = [F.concat(F.lit("="), s), _first(s, ">"), *(F.when(_word_stem(s, k), f"~{k[0]}") for k in STEMS)]
    return F.concat(F.array_compact(F.array(*own)), _runs(s, 1 - PART_OF_WORD, "<"))


def target_keys(t: Column) -> Column:
    """Keys by which a stripped target meets the words that can match it."""
    own = [F.concat(F.lit("="), t), _first(t, "<"), *(F.when(_target_stem(t, k), f"~{k[0]}") for k in STEMS)]
    return F.concat(F.array_compact(F.array(*own)), _runs(t, 1 - PART_OF_TARGET, ">"))


def reading(words: DataFrame, dealt: bool = False) -> DataFrame:
    """label_id and ws: its words in reading order, each with s, the stripped word. dealt: a label's words lie in one partition already."""
    row = F.struct("line", "pos", stripped(F.col("word")).alias("s"), "word", "x", "y", "w", "h", "confidence")
    return (words if dealt else words.repartition("label_id")).groupBy("label_id").agg(F.sort_array(F.collect_list(row)).alias("ws"))


def starts(read: DataFrame, anchors: DataFrame) -> DataFrame:
    """label_id, the anchors' columns and at: the places (from 0) of the words that an anchor's first target matches."""
    columns = [c for c in anchors.columns if c != "label_id"]
    t = anchors.withColumn("targets", F.filter(F.transform("targets", stripped), lambda x: x != "")).filter("size(targets) > 0")
    t = t.withColumn("key", F.explode(target_keys(F.col("targets")[0])))
    spots = read.select("label_id", F.posexplode("ws.s").alias("i", "s")).filter("s <> ''").select("label_id", "i", "s", F.explode(word_keys(F.col("s"))).alias("key"))
    own = "label_id" in anchors.columns
    met = spots.join(by_label(t) if own else F.broadcast(t), ["label_id", "key"] if own else "key").filter(same(F.col("s"), F.col("targets")[0]))
    return met.groupBy("label_id", *columns).agg(F.sort_array(F.collect_set("i")).alias("at"))


def same_text(word: str, target: str) -> bool:
    """same, for two strings."""
    if not word or not target:
        return False
    if word == target:
        return True
    for stem, begins, parts, targets in STEMS:
        if (target.startswith(stem) if stem == "ingredient" else target in targets) and (word.startswith(begins) or any(p in word for p in parts)):
            return True
    n, m = len(word), len(target)
    if n < RUN or m < RUN:
        return False
    return m >= PART_OF_WORD * n if target in word else word in target and n >= PART_OF_TARGET * m


def _parts(s: str, share: float) -> list[str]:
    """_runs, of a string."""
    return [s[p : p + RUN] for p in range(min(len(s) - RUN + 1, int(share * len(s)) + 1))]


@lru_cache(1 << 16)
def _keys_of_word(s: str) -> frozenset[str]:
    """word_keys, of a string, without marks."""
    return frozenset((s, *_parts(s, 1 - PART_OF_WORD), *(f"~{stem}" for stem, begins, parts, _ in STEMS if s.startswith(begins) or any(p in s for p in parts))))


@lru_cache(1 << 16)
def _keys_of_target(t: str) -> frozenset[str]:
    """target_keys, of a string, without marks."""
    return frozenset((t, *_parts(t, 1 - PART_OF_TARGET), *(f"~{stem}" for stem, *_, targets in STEMS if (t.startswith(stem) if stem == "ingredient" else t in targets))))


class Page:
    """The words of one label as lists, for spans that grow step by step."""

    def __init__(self, s: list[str], x: list, y: list, w: list, h: list):
        self.index: dict[str, list[int]] | None = None
        self.s, self.x, self.y, self.h, self.right = s, x, y, h, [a + b for a, b in zip(x, w, strict=True)]
        self.bottom = [a + b for a, b in zip(y, h, strict=True)]
        self.middle = [a + b / 2 for a, b in zip(y, h, strict=True)]
        self.tall = [max(v, 10) for v in h]

    def places(self, target: str) -> list[int]:
        """Places of the words that a target matches, by the index of the words' keys."""
        if self.index is None:
            self.index = {}
            for i, s in enumerate(self.s):
                for k in _keys_of_word(s) if s else ():
                    self.index.setdefault(k, []).append(i)
        lists = [self.index[k] for k in _keys_of_target(target) if k in self.index]
        return [i for i in sorted(set().union(*lists)) if same_text(self.s[i], target)] if lists else []

    def show(self, got: list[int], word: list, confidence: list) -> dict:
        """text_of and box of the words at some places; geometry: TOKEN, LINE if the middles lie within 0.9 of the mean height, else WORD_UNION."""
        middles, sure = [self.middle[j] for j in got], [confidence[j] for j in got if confidence[j] is not None]
        level = max(middles) - min(middles) < 0.9 * (sum(self.h[j] for j in got) / len(got))
        return {
            "text": " ".join(word[j] for j in got if word[j] is not None), "geometry": "TOKEN" if len(got) == 1 else "LINE" if level else "WORD_UNION", "n_words": len(got),
            "x": min(self.x[j] for j in got), "y": min(self.y[j] for j in got), "right": max(self.right[j] for j in got), "bottom": max(self.bottom[j] for j in got), "confidence": min(sure, default=None),
        }

    def walk(self, i: int, targets: list[str], gap: int) -> list[int]:
        """Places matched from i on; next words may stand 1.8 heights below and 3.5 further on at most, and ``gap`` in all may be skipped."""
        got = [i]
        for j in range(i + 1, len(self.s)):
            last = got[-1]
            if len(got) == len(targets) or abs(self.middle[j] - self.middle[last]) > 1.8 * self.tall[last] or self.x[j] - self.right[last] > 3.5 * self.tall[last]:
                break
            if same_text(self.s[j], targets[len(got)]):
                got.append(j)
            elif len(got) + gap <= j - i:
                break
        return got

    def sequence(self, at: list[int], targets: list[str], gap: int) -> list[int] | None:
        """The first start from which two targets are met, or the only one."""
        for i in at:
            got = self.walk(i, targets, gap)
            if len(got) >= min(len(targets), 2):
                return got
        return None

    def beside(self, i: int) -> list[int]:
        """Places whose middle is within 0.6 of the height of i from its middle."""
        middle, most = self.middle[i], 0.6 * self.tall[i]
        return [j for j, m in enumerate(self.middle) if abs(m - middle) <= most]

    def line(self, i: int) -> list[int]:
        """beside, from left to right."""
        return sorted(self.beside(i), key=lambda j: (self.x[j], j))

    def cluster(self, i: int, below: int, width: int) -> list[int]:
        """Places around and below i, in rows of 0.8 of its height."""
        tall, x = self.tall[i], self.x[i]
        top, bottom, left = self.y[i] - 0.5 * tall, self.bottom[i] + tall * (below + 1.2), max(0, x - 50)
        inside = [j for j in range(len(self.s)) if self.y[j] >= top and self.bottom[j] <= bottom and self.x[j] >= left and self.right[j] <= x + width]
        return sorted(inside, key=lambda j: (self.y[j] // (0.8 * tall), self.x[j], j)) or [i]

    def span(self, kind: str, at: list[int], targets: list[str], below: int, width: int, gap: int = 2) -> list[int] | None:
        """Places of what an anchor shows that is met at some places, one at least."""
        if kind == "SEQUENCE":
            return self.sequence(at, targets, gap)
        return self.line(at[0]) if kind == "LINE" else self.cluster(at[0], below, width)


def _grown(gap: int):
    """Rows (label_id, ws, c) and picks: for each span its candidate's place in c, its words' places, and those of its first word's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, cs, out = b.column(1), b.column(2), []
            ends = ws.offsets.to_pylist()
            flat = {k: ws.values.field(k).to_pylist() for k in ("s", "x", "y", "w", "h")}
            for r, candidates in enumerate(cs.to_pylist()):
                page = Page(*(flat[k][ends[r] : ends[r + 1]] for k in ("s", "x", "y", "w", "h")))
                picks = []
                for k, c in enumerate(candidates):
                    got = page.span(c["kind"], c["at"], c["targets"], c["below"], c["width"], gap)
                    if got:
                        picks.append({"k": k, "got": got, "beside": page.beside(got[0])})
                out.append(picks)
            kind = pa.list_(pa.struct([("k", pa.int32()), ("got", pa.list_(pa.int32())), ("beside", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "picks"])

    return run


def spans(read: DataFrame, found: DataFrame, gap: int = 2) -> DataFrame:
    """label_id, the anchors' columns, anchor (the first word met), got (words) and beside (words of the first one's line) of what starts found.

    A span grows word by word from where the last one stands, which no join or window
    expresses, so a label's words and hits go through one Arrow function together.
    """
    columns = [c for c in found.columns if c not in ("label_id", "at")]
    each = found.groupBy("label_id").agg(F.collect_list(F.struct(*columns, "at")).alias("c"))
    j = read.join(by_label(each), "label_id").select("label_id", "ws", "c")
    schema = T.StructType([*j.schema.fields, T.StructField("picks", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("got", T.ArrayType(T.IntegerType())), T.StructField("beside", T.ArrayType(T.IntegerType()))])))])
    e = j.mapInArrow(_grown(gap), schema).select("label_id", "ws", "c", F.explode("picks").alias("p"))
    e = e.withColumn("o", F.get("c", F.col("p.k")))
    words = lambda places: F.transform(places, lambda i: F.get("ws", i))
    first = F.get("ws", F.when(F.col("o.kind") == "SEQUENCE", F.col("p.got")[0]).otherwise(F.col("o.at")[0]))
    return e.select("label_id", *(F.col(f"o.{c}").alias(c) for c in columns), first.alias("anchor"), words("p.got").alias("got"), words("p.beside").alias("beside"))


def box(got: Column) -> list[Column]:
    """Union box of words, their number and the least confidence."""
    least = lambda f: F.array_min(F.transform(got, f))
    most = lambda f: F.array_max(F.transform(got, f))
    return [
        F.size(got).alias("n_words"),
        least(lambda w: w["x"]).alias("x"),
        least(lambda w: w["y"]).alias("y"),
        most(lambda w: w["x"] + w["w"]).alias("right"),
        most(lambda w: w["y"] + w["h"]).alias("bottom"),
        least(lambda w: w["confidence"]).alias("confidence"),
    ]


def text_of(got: Column) -> Column:
    return F.array_join(F.transform(got, lambda w: w["word"]), " ")


def _located(words: DataFrame, anchors: DataFrame, kind: str | None = None, gap: int = 2) -> DataFrame:
    """kind: of all anchors; by default they have a column of it."""
    a = anchors.withColumn("kind", F.lit(kind)) if kind else anchors
    for c in ("below", "width"):
        if c not in a.columns:
            a = a.withColumn(c, F.lit(0))
    read = reading(words)
    return spans(read, starts(read, a), gap=gap)


def sequences(words: DataFrame, phrases: DataFrame, gap: int = 2) -> DataFrame:
    """The first place of each label where words match a phrase's targets in order; two matches are enough.

    phrases: key columns and targets; gives them, label_id, line, pos, n_words, box and the least confidence.
    """
    keys = [c for c in phrases.columns if c not in ("label_id", "targets")]
    first = F.col("got")[0]
    return _located(words, phrases, "SEQUENCE", gap).select("label_id", *keys, first["line"].alias("line"), first["pos"].alias("pos"), *box(F.col("got")))


def gathered(words: DataFrame, anchors: DataFrame, kind: str | None = None) -> DataFrame:
    """Words of lines and clusters in one pass over a label's words. anchors: key columns, target, kind (LINE or CLUSTER), below and width."""
    keys = [c for c in anchors.columns if c not in ("label_id", "target")]
    s = _located(words, anchors.select(*(c for c in anchors.columns if c != "target"), F.array("target").alias("targets")), kind)
    return s.select("label_id", *keys, F.col("anchor.line").alias("line"), F.col("anchor.pos").alias("pos"), *box(F.col("got")), text_of(F.col("got")).alias("text"))


def same_line(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Words of each anchor's line, left to right. anchors: key columns and target, with label_id for that label only."""
    return gathered(words, anchors, "LINE")


def cluster(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Words around and below each anchor. anchors: key columns, target, below (lines) and width (pixels)."""
    return gathered(words, anchors, "CLUSTER")
