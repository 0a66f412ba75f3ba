"""Quality rules whose cutoffs adapt to each language and source. DataFrame functions only.

Per (lang, source) and rule a quantile sketch is built: values are rounded down
to six significant bits and counted. Such a histogram has a relative error below
1/32, is the same whatever the partitioning, and two of them merge by adding
counts. Every group's sketch is merged with its language's, and that with the
sketch of all documents: the wider one counts as ``weight`` documents, by POINTS
bins at even quantiles. So a large group is judged by itself, a small one by its
language, and those between by both.

A document fails a rule if its value lies beyond an outer fence of its group:
above q75 + spread * max(q75 - q25, least), or for word length also below
q25 minus the same.

Defined results: a null text has no words and fails the base rule; null lang or
source form groups of their own; repeated rows are judged one by one; texts are
measured whole, however long; columns of the measures' names are replaced by
them in measured() and kept by quality_filter(); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, let, stored, table, words_of

SYMBOLS = r"[#*$%&|<>]"
SPREAD = 3
#: Documents that the wider sketch counts as, and the bins that stand for it; each is WEIGHT / POINTS documents.
WEIGHT, POINTS = 100, 20
QUARTILES = (25, 75)
#: rule: least interquartile range, in thousandths.
RULES = {"symbol_rate": 60, "dup_line_rate": 150, "repeat_rate": 60, "word_length": 500}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_in_repeats(words: Column, n: int = 5) -> Column:
    """How many words lie in n-word windows that occur twice or more.

    Windows are compared by their 64-bit hashes. Sorting (hash, start) pairs puts
    equal windows side by side; the starts of those, sorted, give the words covered.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    paired = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    covered = lambda r: F.aggregate(
        F.array_sort(F.transform(r, lambda x: x["i"])),
        F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(paired(h), lambda s: let(again(s), covered)))
    return F.when(F.size(words) < n, 0).otherwise(let(words, lambda w: let(hashes(w), counted))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Adds the base measures of every whole text as long columns; columns of these names are replaced."""
    docs = docs.drop(*BASE, "n_lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select("*", words_of(F.col("text")).alias("__words"), lines.alias("__lines"))
    return a.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Each rule's value as a whole number of thousandths."""
    per = lambda x, of: F.floor(1000 * F.col(x) / F.greatest(F.col(of), F.lit(1))).cast("long")
    return {"symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def sketched(value: Column) -> Column:
    """A value's sketch bin: its six leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _ranked(sketch: DataFrame, by: tuple[str, ...], numbers: list[tuple[int, int]]) -> DataFrame:
    """For each group and rule the bins at the given quantiles (numerator, denominator), as array q."""
    w = W.partitionBy(*by, "rule")
    upto, every = F.col("__upto"), F.col("__all")
    q = sketch.select("*", F.sum("n").over(w.orderBy("bin")).alias("__upto"), F.sum("n").over(w).alias("__all"))
    return q.groupBy(*by, "rule").agg(F.array(*(F.min(F.when(d * upto >= p * every, F.col("bin"))) for p, d in numbers)).alias("q"))


def _merged(groups: DataFrame, sketch: DataFrame, by: tuple[str, ...], wider: DataFrame, over: tuple[str, ...], rules: dict[str, int], weight: int) -> DataFrame:
    """Each group's own sketch and the wider one's points. wider: columns over, rule, q."""
    every = groups.select(*by, F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    p = wider.withColumnsRenamed({c: f"__{c}" for c in (*over, "rule")})
    on = every["rule"] == F.col("__rule")
    for c in over:
        on = on & every[c].eqNullSafe(F.col(f"__{c}"))
    points = every.join(p, on).select(*by, "rule", F.explode("q").alias("bin"), F.lit(weight // POINTS).cast("long").alias("n"))
    return sketch.unionByName(points).groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))


def fences(measures: DataFrame, spread: int = SPREAD, weight: int = WEIGHT, rules: dict[str, int] | None = None) -> DataFrame:
    """One row per (lang, source): low_<rule> and high_<rule>.

    measures: lang, source and the columns of measured(). Only documents that pass
    the base rule shape a sketch.
    """
    rules = RULES if rules is None else rules
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in rates().items() if k in rules)))
    own = (
        measures.filter(~base_failed())
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.rule", sketched(F.col("p.value")).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    own = stored(own)  # a row for each bin of each group and rule
    groups = stored(measures.select("lang", "source").distinct())
    even = [(2 * j + 1, 2 * POINTS) for j in range(POINTS)]
    of_all = _ranked(own.groupBy("rule", "bin").agg(F.sum("n").alias("n")), (), even)
    by_lang = own.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    of_lang = _ranked(_merged(groups.select("lang").distinct(), by_lang, ("lang",), of_all, (), rules, weight), ("lang",), even)
    q = _ranked(_merged(groups, own, ("lang", "source"), of_lang, ("lang",), rules, weight), ("lang", "source"), [(p, 100) for p in QUARTILES])
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    least = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()))
    q = q.select("lang", "source", "rule", low.alias("low"), high.alias("high"), (spread * F.greatest(high - low, least)).alias("reach"))
    pick = lambda r, c: F.max(F.when(F.col("rule") == r, c))
    return q.groupBy("lang", "source").agg(*(c for r in rules for c in (pick(r, F.col("low") - F.col("reach")).alias(f"low_{r}"), pick(r, F.col("high") + F.col("reach")).alias(f"high_{r}"))))


def verdict(rules: dict[str, int] | None = None) -> Column:
    """True if a document is inside its group's fences."""
    ok = ~base_failed()
    for r, v in rates().items():
        if r in (RULES if rules is None else rules):
            ok = ok & F.coalesce(v <= F.col(f"high_{r}"), F.lit(True))
            if r == "word_length":
                ok = ok & F.coalesce(v >= F.col(f"low_{r}"), F.lit(True))
    return ok


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept by the fences of each row's language and source."""
    f = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    both = measures.join(bounded(f), measures["lang"].eqNullSafe(F.col("__lang")) & measures["source"].eqNullSafe(F.col("__source")), "left")
    return both.select(*(measures[c] for c in measures.columns), base_failed().alias("base_failed"), verdict().alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The documents are written with their measures and read again, so that each text is measured once.
    """
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*at.values())
    with_own = own.select("*", *(F.col(at[c]).alias(c) for c in ("text", "lang", "source")))
    measures = stored(measured(with_own).drop("text"))
    return judged(measures, fences(measures)).filter("kept").select(*(F.col(at[c]).alias(c) for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    measures = stored(measured(docs).drop("text"))
    return judged(measures, fences(measures)).select("doc_id", *BASE, "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
s AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) t(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM m
), u AS (UNPIVOT b ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rule VALUE v),
k AS (
  SELECT lang, source, rule, (v >> e) << e AS bin, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0)::INT AS e FROM u) WHERE NOT base_failed GROUP BY ALL
), p(j) AS (SELECT unnest(range(20))),
-- Twenty even quantiles of all documents count as 5 documents each in every language, and so a language's in its groups.
a AS (SELECT rule, bin, sum(n) OVER (PARTITION BY rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY rule) AS total FROM (SELECT rule, bin, sum(n) AS n FROM k GROUP BY ALL)),
ap AS (SELECT rule, j, min(bin) AS bin FROM a, p WHERE 40 * upto >= (2 * j + 1) * total GROUP BY ALL),
l AS (
  SELECT lang, rule, bin, sum(n) AS n FROM (
    SELECT lang, rule, bin, n FROM k UNION ALL SELECT lang, rule, bin, 5 FROM (SELECT DISTINCT lang FROM d), ap) GROUP BY ALL
), lc AS (SELECT *, sum(n) OVER (PARTITION BY lang, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, rule) AS total FROM l),
lp AS (SELECT lang, rule, j, min(bin) AS bin FROM lc, p WHERE 40 * upto >= (2 * j + 1) * total GROUP BY ALL),
s2 AS (
  SELECT lang, source, rule, bin, sum(n) AS n FROM (
    SELECT * FROM k UNION ALL
    SELECT x.lang, x.source, lp.rule, lp.bin, 5 FROM (SELECT DISTINCT lang, source FROM d) x JOIN lp ON x.lang IS NOT DISTINCT FROM lp.lang) GROUP BY ALL
), sc AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM s2),
q AS (SELECT lang, source, rule, min(bin) FILTER (WHERE 100 * upto >= 25 * total) AS q25, min(bin) FILTER (WHERE 100 * upto >= 75 * total) AS q75 FROM sc GROUP BY ALL),
f AS (
  SELECT u.doc_id, u.rule, u.v, q25, q75, CASE u.rule WHEN 'symbol_rate' THEN 60 WHEN 'dup_line_rate' THEN 150 WHEN 'repeat_rate' THEN 60 ELSE 500 END AS least
  FROM u LEFT JOIN q ON q.lang IS NOT DISTINCT FROM u.lang AND q.source IS NOT DISTINCT FROM u.source AND q.rule = u.rule
), out_ AS (
  SELECT doc_id, bool_or(v > q75 + 3 * greatest(q75 - q25, least) OR rule = 'word_length' AND v < q25 - 3 * greatest(q75 - q25, least)) AS beyond
  FROM f GROUP BY doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM b JOIN out_ USING (doc_id)
"""
