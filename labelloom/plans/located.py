"""The evidence of every check, against SQL that sets every word against every anchor."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import evidence as V
from labelloom.operators import extraction as E
from labelloom.operators import locate as LO
from labelloom.operators import rules as RU
from labelloom.plans.labels import CHECKS
from labelloom.plans.registry import Registry
from labelloom.sources.views import dealt

QUERIES, SQL, query = Registry.new()

#: Words by one condition, in SQL: a printed word {a} and a target {b}, both stripped.
SAME = """({a} <> '' AND {b} <> '' AND ({a} = {b} OR ({b} = 'mrp' AND starts_with({a}, 'mrp')) OR ({b} IN ('mfg', 'mfd') AND (starts_with({a}, 'mfg') OR starts_with({a}, 'mfd'))) OR ({b} IN ('exp', 'expiry') AND starts_with({a}, 'exp'))
  OR (starts_with({b}, 'ingredient') AND (starts_with({a}, 'ingred') OR starts_with({a}, 'inored'))) OR ({b} = 'usp' AND (starts_with({a}, 'usp') OR contains({a}, 'saleprice')))
  OR (length({a}) > 3 AND length({b}) > 3 AND CASE WHEN contains({a}, {b}) THEN 2 * length({b}) >= length({a}) ELSE contains({b}, {a}) AND 10 * length({a}) >= 7 * length({b}) END)))"""


def same(a: str, b: str) -> str:
    return SAME.format(a=a, b=b)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FIXED = ", ".join(f"({_text(r)}, '{'header' if r == 'LM-005' else 'main'}', {100 + i}, '{kind}', [{', '.join(map(_text, words.split(' ')))}], {below}, {width})" for i, (r, kind, words, below, width) in enumerate(V.ANCHORS))
_HOLDS = lambda words: "(" + " OR ".join(f"contains(lower(text), {_text(w)})" for w in words) + ")"
_WORDS = lambda c, least, most: f"[x FOR x IN [trim(y, '.,:- ') FOR y IN string_split_regex({c}, '\\s+')] IF length(x) >= {least}][1:{most}]"

CHOICE = f"""{CHECKS}, ck AS (SELECT label_id, r.rule_id AS rule_id, r.status AS status, r.value AS value FROM c),
pw AS (SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY line, pos) AS i, regexp_replace(lower(word), '[^a-z0-9_]', '', 'g') AS s, word, x, y, w, h, confidence, y + h / 2::DOUBLE AS mid, greatest(h, 10) AS tall FROM pack_words),
fa(rule_id, item, ord, kind, targets, below, width) AS (VALUES {_FIXED}),
va AS (SELECT label_id, unnest([{{'rule_id': 'LM-001', 'item': 'main', 'ord': 0, 'kind': 'SEQUENCE', 'targets': {_WORDS('maker', 3, 4)}}},
  {{'rule_id': 'LM-001', 'item': 'second', 'ord': 0, 'kind': 'SEQUENCE', 'targets': {_WORDS("'Industrial Estate, Surat'", 4, 3)}}},
  {{'rule_id': 'LM-002', 'item': 'main', 'ord': 0, 'kind': 'SEQUENCE', 'targets': {_WORDS('product_name', 3, 99)}}}, {{'rule_id': 'LM-002', 'item': 'main', 'ord': 1, 'kind': 'SEQUENCE', 'targets': [brand]}},
  {{'rule_id': 'FS-002', 'item': 'main', 'ord': 0, 'kind': 'SEQUENCE', 'targets': {_WORDS('product_name', 3, 99)}}}, {{'rule_id': 'FS-002', 'item': 'main', 'ord': 1, 'kind': 'SEQUENCE', 'targets': [brand]}},
  {{'rule_id': 'LM-003', 'item': 'main', 'ord': 200, 'kind': 'SEQUENCE', 'targets': [CAST(amount AS VARCHAR), unit]}}, {{'rule_id': 'LM-003', 'item': 'main', 'ord': 201, 'kind': 'LINE', 'targets': [CAST(amount AS VARCHAR) || unit]}}, {{'rule_id': 'LM-003', 'item': 'main', 'ord': 202, 'kind': 'LINE', 'targets': [CAST(amount AS VARCHAR)]}},
  {{'rule_id': 'LM-004', 'item': 'declared', 'ord': 0, 'kind': 'LINE', 'targets': [string_split(CAST(price AS VARCHAR), '.')[1]]}},
  {{'rule_id': 'LM-005', 'item': 'declared', 'ord': 0, 'kind': 'LINE', 'targets': [phone]}}, {{'rule_id': 'LM-005', 'item': 'declared', 'ord': 1, 'kind': 'LINE', 'targets': [right(replace(phone, '-', ''), 6)]}},
  {{'rule_id': 'LM-005', 'item': 'email', 'ord': 2, 'kind': 'LINE', 'targets': [email]}}, {{'rule_id': 'LM-005', 'item': 'email', 'ord': 3, 'kind': 'LINE', 'targets': [string_split(email, '@')[1]]}},
  {{'rule_id': 'FS-001', 'item': 'main', 'ord': 0, 'kind': 'LINE', 'targets': [licence]}}, {{'rule_id': 'FS-005', 'item': 'main', 'ord': 0, 'kind': 'LINE', 'targets': [best_before]}}]) AS a FROM label_truth),
an AS (SELECT label_id, a.rule_id AS rule_id, a.item AS item, a.ord AS ord, a.kind AS kind, a.targets AS targets, 0 AS below, 0 AS width FROM va WHERE a.targets[1] IS NOT NULL AND len(a.targets) > 0 UNION ALL SELECT label_id, fa.* FROM label_truth, fa),
ct AS (SELECT label_id, rule_id, item, ord, kind, [regexp_replace(lower(t), '[^a-z0-9_]', '', 'g') FOR t IN targets] AS t, below, width FROM an),
st AS (SELECT ct.*, i FROM ct JOIN pw USING (label_id) WHERE {same('pw.s', 'ct.t[1]')}),
wk(label_id, rule_id, item, ord, t, i, j, got) AS (SELECT label_id, rule_id, item, ord, t, i, i, [i] FROM st WHERE kind = 'SEQUENCE' UNION ALL
  SELECT k.label_id, rule_id, item, ord, t, k.i, v.i, CASE WHEN {same('v.s', 't[len(got) + 1]')} THEN list_append(got, v.i) ELSE got END FROM wk k JOIN pw v ON v.label_id = k.label_id AND v.i = k.j + 1 JOIN pw p ON p.label_id = k.label_id AND p.i = got[-1]
  WHERE len(got) < len(t) AND abs(v.mid - p.mid) <= 1.8::DOUBLE * p.tall AND v.x - p.x - p.w <= 3.5::DOUBLE * p.tall AND ({same('v.s', 't[len(got) + 1]')} OR len(got) + 2 > v.i - k.i)),
sq AS (SELECT label_id, rule_id, item, ord, i, arg_max(got, len(got)) AS got, max(len(got)) AS n, any_value(len(t)) AS k FROM wk GROUP BY ALL),
ca AS (SELECT label_id, rule_id, item, ord, 'SEQUENCE' AS kind, 0 AS below, 0 AS width, min(i) AS i, arg_min(got, i) AS got FROM sq WHERE n >= least(k, 2) GROUP BY ALL UNION ALL SELECT label_id, rule_id, item, ord, kind, below, width, min(i), NULL FROM st WHERE kind <> 'SEQUENCE' GROUP BY ALL),
ch AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY label_id, rule_id, item ORDER BY ord) = 1),
mb AS (SELECT ch.label_id, rule_id, item, list_position(got, v.i) AS o, v.* EXCLUDE (label_id) FROM ch JOIN pw v ON v.label_id = ch.label_id AND list_contains(got, v.i) WHERE kind = 'SEQUENCE' UNION ALL
  SELECT ch.label_id, rule_id, item, 0, v.* EXCLUDE (label_id) FROM ch JOIN pw a ON a.label_id = ch.label_id AND a.i = ch.i JOIN pw v ON v.label_id = ch.label_id AND abs(v.mid - a.mid) <= 0.6::DOUBLE * a.tall WHERE kind = 'LINE' UNION ALL
  SELECT ch.label_id, rule_id, item, floor(v.y / (0.8::DOUBLE * a.tall)), v.* EXCLUDE (label_id) FROM ch JOIN pw a ON a.label_id = ch.label_id AND a.i = ch.i JOIN pw v ON v.label_id = ch.label_id AND v.y >= a.y - 0.5::DOUBLE * a.tall AND v.y + v.h <= a.y + a.h + a.tall * (below + 1.2::DOUBLE)
    AND v.x >= greatest(0, a.x - 50) AND v.x + v.w <= a.x + ch.width WHERE kind = 'CLUSTER'),
ow AS (SELECT label_id, rule_id, item, string_agg(word, ' ' ORDER BY o, x, i) AS text, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, min(confidence) AS conf, CASE WHEN count(*) = 1 THEN 'TOKEN' WHEN max(mid) - min(mid) < 0.9::DOUBLE * avg(h) THEN 'LINE' ELSE 'WORD_UNION' END AS shape, arg_min(i, o) AS first FROM mb GROUP BY ALL),
us AS (SELECT o.label_id, string_agg(v.word, ' ' ORDER BY v.i) AS line, count(*) AS n, min(v.x) AS x, min(v.y) AS y, max(v.x + v.w) AS r, max(v.y + v.h) AS b, min(v.confidence) AS conf FROM ow o JOIN mb f ON f.label_id = o.label_id AND f.rule_id = 'LM-007' AND f.item = o.item
  JOIN pw a ON a.label_id = f.label_id AND a.i = f.i JOIN pw v ON v.label_id = a.label_id AND abs(v.mid - a.mid) <= 0.6::DOUBLE * a.tall WHERE o.rule_id = 'LM-007' AND f.i = o.first GROUP BY 1),
ok AS (SELECT *, CASE item WHEN 'declared' THEN 0 WHEN 'email' THEN 1 WHEN 'main' THEN 1 ELSE 2 END AS rank FROM ow WHERE NOT (rule_id IN ('LM-003', 'LM-005') AND {_HOLDS(V.TABLE_LINE)}) AND NOT (rule_id = 'LM-004' AND item = 'declared' AND NOT {_HOLDS(V.PRICE_LINE)})),
rk AS (SELECT *, row_number() OVER g AS k, first_value(x) OVER g = x AND first_value(y) OVER g = y AND first_value(r) OVER g = r AND first_value(b) OVER g = b AS again FROM ok WINDOW g AS (PARTITION BY label_id, rule_id ORDER BY rank)),
it AS (SELECT *, row_number() OVER (PARTITION BY label_id, rule_id ORDER BY rank) AS nr FROM rk WHERE k = 1 OR (rule_id = 'LM-005' AND item <> 'header') OR (rule_id = 'LM-001' AND NOT (item = 'second' AND again))),
jo AS (SELECT ck.*, coalesce(nr, 1) AS nr, it.item AS part, it.text, it.shape, it.item IS NULL AS none, ck.rule_id = 'LM-007' AND it.item IS NOT NULL AND (regexp_matches(lower(us.line), '{V.RATE}') OR (ck.status = 'PASS' AND ck.value IS NOT NULL)) AS num, it.n AS own, it.x AS ox, it.y AS oy, it.r AS orr, it.b AS ob, it.conf AS oc, us.n AS un, us.x AS ux, us.y AS uy, us.r AS ur, us.b AS ub, us.conf AS uc
  FROM ck LEFT JOIN it ON it.label_id = ck.label_id AND it.rule_id = ck.rule_id LEFT JOIN us ON us.label_id = ck.label_id AND ck.rule_id = 'LM-007'),
me AS (SELECT label_id, rule_id, CAST(nr AS INT) AS item, status, coalesce(text, value) AS text, CASE WHEN num THEN un ELSE own END AS n, CASE WHEN num THEN ux ELSE ox END AS x, CASE WHEN num THEN uy ELSE oy END AS y, CASE WHEN num THEN ur ELSE orr END AS r, CASE WHEN num THEN ub ELSE ob END AS b, coalesce(CASE WHEN num THEN uc ELSE oc END, 0)::DOUBLE AS conf,
  CASE WHEN none THEN 'NONE' WHEN rule_id = 'LM-005' THEN 'LINE' WHEN rule_id IN ('LM-003', 'LM-006') THEN CASE WHEN own > 1 THEN 'LINE' ELSE 'TOKEN' END ELSE shape END AS geometry, none, part, num,
  CASE WHEN rule_id = 'LM-009' THEN 'NONE' WHEN none THEN CASE status WHEN 'NEEDS_REVIEW' THEN 'SEMANTIC_PANEL' WHEN 'PASS' THEN 'TOKEN_SEQUENCE' ELSE 'NONE' END WHEN (rule_id = 'LM-004' AND part = 'main') OR part = 'header' OR (rule_id = 'LM-007' AND NOT num) THEN 'CONTEXTUAL_OCR' WHEN rule_id IN ('FS-003', 'FS-004') THEN 'MULTI_TOKEN_OCR'
    WHEN rule_id IN ('LM-001', 'LM-002', 'FS-002', 'FS-005') AND own > 1 THEN 'MULTI_TOKEN_OCR' WHEN rule_id = 'LM-003' AND own > 2 THEN 'MULTI_TOKEN_OCR' ELSE 'DIRECT_OCR' END AS method FROM jo),
se AS (SELECT *, CASE WHEN rule_id = 'LM-009' THEN 'VERIFIED' WHEN none THEN CASE WHEN status IN ('NOT_APPLICABLE', 'NEEDS_REVIEW') THEN status WHEN status = 'PASS' THEN 'VERIFIED' ELSE 'UNAVAILABLE' END WHEN method = 'CONTEXTUAL_OCR' OR (rule_id = 'LM-007' AND status <> 'PASS') THEN 'CONTEXTUAL'
    WHEN rule_id IN ('LM-001', 'LM-002', 'FS-002') THEN CASE WHEN status = 'PASS' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END WHEN rule_id = 'FS-005' AND status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS state FROM me),
qu AS (SELECT *, CASE WHEN state IN ('NOT_APPLICABLE', 'UNAVAILABLE') THEN 0 WHEN method = 'DIRECT_OCR' THEN least(100, greatest(85, conf)) WHEN method = 'MULTI_TOKEN_OCR' THEN least(95, greatest(75, conf)) WHEN method = 'CONTEXTUAL_OCR' THEN round(least(75, greatest(60, conf * 0.8::DOUBLE)), 1) WHEN method = 'SEMANTIC_PANEL' THEN 40 WHEN method = 'TOKEN_SEQUENCE' THEN 70 ELSE 0 END::DOUBLE AS quality,
  CASE WHEN item = 1 AND b - y > 350 AND rule_id NOT IN ('FS-003', 'FS-004') THEN 'NEEDS_REVIEW' ELSE state END AS evidence_status FROM se),
rl AS (SELECT *, CASE WHEN evidence_status IN ('NOT_APPLICABLE', 'UNAVAILABLE') THEN 0 WHEN evidence_status = 'NEEDS_REVIEW' THEN least(quality, 65) WHEN evidence_status = 'VERIFIED' AND quality >= 85 THEN greatest(quality, 90) ELSE quality END::DOUBLE AS reliability FROM qu)"""


@query("g10_evidence_choice", f"""WITH RECURSIVE {CHOICE} SELECT label_id, rule_id, item, status, method, evidence_status, geometry, text, CAST(n AS INT) AS n_words, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(r AS INT) AS "right", CAST(b AS INT) AS bottom, conf AS confidence, quality, reliability,
  CASE WHEN evidence_status IN ('NOT_APPLICABLE', 'UNAVAILABLE') THEN 'NOT_APPLICABLE' WHEN reliability >= 85 THEN 'HIGH' WHEN reliability >= 70 THEN 'MEDIUM' WHEN reliability >= 50 THEN 'LOW' ELSE 'NEEDS_VERIFICATION' END AS tier FROM rl""", ("pack_words", "label_truth"))  # fmt: skip
def g10(spark, d):
    labels, words = dealt(spark, d, "label_text", "pack_words")
    dec = E.declared(labels, E.candidates(labels)).withColumn("manufacturer_address", F.lit("Industrial Estate, Surat"))
    out = V.evidence_items(LO.reading(words, dealt=True), V.asked(RU.judged(dec)))
    whole = {c: F.col(c).cast("int") for c in ("n_words", "x", "y", "right", "bottom")}
    return out.withColumns(whole)
