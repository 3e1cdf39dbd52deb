"""SQL for DuckDB that states each registered query anew."""

from __future__ import annotations

from ..operators.answers import PROMPTS
from . import samples as P


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(texts: list[str], at: str) -> str:
    return f"list_extract({_list(texts)}, CAST(({at}) % {len(texts)} AS INTEGER) + 1)"


def labels_of(text: str, rules) -> str:
    """Distinct labels of the keywords in a text, in the rules' order."""
    keys, values = _list(k for k, _ in rules), _list(v for _, v in rules)
    hits = f"list_filter(list_transform(range(1, {len(rules)} + 1), lambda i: CASE WHEN contains({text}, list_extract({keys}, i)) THEN list_extract({values}, i) END), lambda v: v IS NOT NULL)"
    return f"list_filter(list_transform({hits}, lambda v, i: CASE WHEN list_position({hits}, v) = i THEN v END), lambda v: v IS NOT NULL)"


def mapped(text: str, folded: str, rules) -> str:
    return f"coalesce(nullif(array_to_string({labels_of(folded, rules)}, '-'), ''), {text})"


# rules, restated with their own values
_ICH = [("front", "frontal"), ("pariet", "parietal"), ("occipit", "occipital"), ("tempor", "temporal"), ("insula", "insular"), ("lenti", "lentiform"), ("putamen", "lentiform"), ("caudate", "caudate"), ("thalam", "thalamus"), ("cerebel", "cerebellum"), ("tronc", "brainstem"), ("pons", "brainstem")]
_IVH = [("third", "third"), ("fourth", "fourth"), ("v3", "third"), ("v4", "fourth"), ("lateral", "lateral"), ("occipital", "lateral"), ("corne", "lateral")]
_PHE = [("mild", "mild"), ("tiny", "mild"), ("leger", "mild"), ("modere", "moderate"), ("severe", "severe"), ("large", "severe"), ("volumineux", "severe")]

_PRESENCE = """
WITH t AS (SELECT doc_id AS id, toxic = 1 AS a, quality = 0 AS none FROM labels),
h AS (SELECT DISTINCT doc_id AS id FROM documents WHERE contains(lower(text), 'trash') OR contains(text, 'scum')),
x AS (SELECT t.id, a, h.id IS NOT NULL AS p FROM t LEFT JOIN h USING (id) {where}),
c AS (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM x),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS se FROM c)
SELECT tp, fp, fn, tn, se AS sensitivity, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn::DOUBLE / (tn + fp)::DOUBLE END AS specificity,
       CASE WHEN pr + se = 0 THEN 0.0 ELSE 2 * pr * se / (pr + se) END AS f1_score, CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / (tp + fp + fn + tn)::DOUBLE END AS accuracy
FROM r"""

_SETS = """
WITH z AS (SELECT user_id, lower(event_type) || (floor(epoch_us(ts) / 86400000000)::BIGINT % 2) AS label, floor(epoch_us(ts) / 3600000000)::BIGINT % 24 < 12 AS morning FROM events),
g AS (SELECT user_id AS id, list_sort(list(DISTINCT label)) AS gt FROM z WHERE morning GROUP BY 1),
q AS (SELECT user_id AS id, list_sort(list(DISTINCT label)) AS pred FROM z WHERE NOT morning GROUP BY 1),
x AS (SELECT id, gt, pred, coalesce(gt = pred, false) AS correct, len(list_intersect(gt, pred)) AS b,
             list_sort(list_filter(gt, lambda v: NOT list_contains(pred, v))) AS missing FROM g LEFT JOIN q USING (id)),
s AS (SELECT *, CASE WHEN pred IS NOT NULL THEN b::DOUBLE / len(gt) END AS coverage, b::DOUBLE / len(pred) AS prec, b::DOUBLE / (len(gt) + len(pred) - b) AS jac FROM x)
"""

_SIZES = """
WITH RECURSIVE l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(trunc(l_quantity) AS INTEGER)::DOUBLE AS q FROM lineitem),
g AS (SELECT id, list(q ORDER BY n, p, s, q::INTEGER::VARCHAR || ' mm') AS gt FROM l WHERE n % 2 = 1 GROUP BY id),
e AS (SELECT id, list(q ORDER BY n, p, s, q::INTEGER::VARCHAR || ' mm') AS pred FROM l WHERE n % 2 = 0 GROUP BY id),
m AS (
  SELECT id, gt, pred, 1 AS i, pred AS rest, []::DOUBLE[] AS missing FROM g JOIN e USING (id)
  UNION ALL
  SELECT id, gt, pred, i + 1, CASE WHEN k IS NULL THEN rest ELSE list_concat(rest[1:k - 1], rest[k + 1:]) END, CASE WHEN k IS NULL THEN list_append(missing, gt[i]) ELSE missing END
  FROM (SELECT *, list_extract(list_filter(range(1, len(rest) + 1), lambda j: abs(rest[j] - gt[i]) <= 5), 1) AS k FROM m WHERE i <= len(gt))),
f AS (SELECT g.id, g.gt, m.pred, m.missing, m.rest, coalesce(len(m.missing) = 0 AND len(m.rest) = 0, false) AS correct, (len(g.gt) - len(m.missing)) AS hits
      FROM g LEFT JOIN (SELECT * FROM m WHERE i = len(gt) + 1) m USING (id))
"""

_FLAGS = """
WITH a AS (SELECT p_partkey AS k, p_size > 40 AS f, p_partkey % 4 IN (0, 2) AS t, p_partkey % 6 <> 0 AS v3, p_partkey % 4 = 0 AS lat, p_partkey % 9 = 0 AS inone, p_partkey % 8 = 0 AS pnone, p_partkey % 3 = 0 AS mild, p_partkey % 16 = 0 AS sev FROM part),
f AS (
SELECT k AS "ID", NOT (f OR t OR v3 OR lat OR inone OR pnone OR mild OR sev) AS all_booleans_false, f OR t AS ich_presence, NOT inone AND (v3 OR lat) AS ivh_presence, NOT pnone AND (mild OR sev) AS phe_presence,
       nullif(concat_ws('/', CASE WHEN f THEN 'frontal' END, CASE WHEN t THEN 'temporal' END), '') AS ich_localisation,
       nullif(concat_ws('/', CASE WHEN v3 THEN 'third' END, CASE WHEN lat THEN 'lateral' END), '') AS ivh_location,
       nullif(concat_ws('/', CASE WHEN mild THEN 'mild' END, CASE WHEN sev THEN 'severe' END), '') AS phe_intensity
FROM a)
"""

_REPORTS = f"""
WITH k AS (SELECT p_partkey AS k, p_size, p_partkey::VARCHAR || {pick(P.FILE_TAILS, 'p_partkey')} AS f FROM part WHERE p_partkey % 13 <> 0),
r AS (SELECT *, k::VARCHAR || CASE WHEN k % 4 = 3 THEN '_report' ELSE '' END AS "ID" FROM k)
"""

_SCORES = f"""
WITH g AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS counts, o_totalprice > 250000 AS ivh, o_custkey % 2 = 0 AS phe, lower(trim({pick(P.SEVERITIES, 'o_custkey')})) AS sev,
  list_distinct(['s' || o_custkey % 3, 's' || o_orderkey % 5]) AS ich_l, ['s' || o_orderkey % 4] AS ivh_l FROM orders),
l AS (SELECT l_orderkey AS id, l_returnflag AS model, l_linestatus AS prompt_id, l_linenumber % 3 AS k, 's' || l_suppkey % 4 AS a, 's' || l_partkey % 5 AS b, {pick(P.SEVERITIES, 'l_partkey')} AS z FROM lineitem),
f AS (SELECT id, model, prompt_id, bool_or(k = 1) AS p_ivh, bool_or(k = 2) AS p_phe, list(z) FILTER (WHERE k = 2) AS p_sev, list_distinct(flatten(list([a, b]) FILTER (WHERE k = 0))) AS p_ich, list_distinct(flatten(list([a, b]) FILTER (WHERE k = 1))) AS p_ivhl FROM l GROUP BY ALL),
w AS (SELECT n.model, n.prompt_id, g.*, coalesce(p_ivh, false) AS p_ivh, coalesce(p_phe, false) AS p_phe, p_sev, p_ich, p_ivhl FROM (SELECT DISTINCT model, prompt_id FROM l) n CROSS JOIN g LEFT JOIN f ON f.model = n.model AND f.prompt_id = n.prompt_id AND f.id = g.id WHERE counts),
pres AS (SELECT model, prompt_id, id, 'ivh_presence' AS metric, ivh AS t, p_ivh AS p FROM w UNION ALL SELECT model, prompt_id, id, 'phe_presence', phe, p_phe FROM w),
sevs AS (SELECT model, prompt_id, id, 'phe_severity' AS metric, sev AS gt, len(p_sev) > 0 AS found, coalesce(list_contains(list_transform(flatten(list_transform(p_sev, lambda v: string_split(v, '/'))), lambda v: lower(trim(v))), sev), false) AS ok FROM w WHERE sev <> ''),
locs AS (SELECT *, len(list_intersect(gt, pred)) AS common FROM (SELECT model, prompt_id, id, 'ich_location' AS metric, ich_l AS gt, CASE WHEN len(p_ich) > 0 THEN p_ich END AS pred FROM w UNION ALL SELECT model, prompt_id, id, 'ivh_location', ivh_l, CASE WHEN len(p_ivhl) > 0 THEN p_ivhl END FROM w)),
lok AS (SELECT *, coalesce(common = len(gt) AND common = len(pred), false) AS ok FROM locs)"""

ORACLE_SQL: dict[str, str] = {
    "presence_confusion": _PRESENCE.format(where=""),
    "presence_ignore_filter": _PRESENCE.format(where="WHERE NOT none"),
    "presence_error_ids": """
SELECT CASE WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS section, doc_id::VARCHAR AS "ID" FROM labels
WHERE (toxic = 1) <> (doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'trash') OR contains(text, 'scum')))""",
    "extra_pred_ids": """
SELECT DISTINCT doc_id::VARCHAR AS "ID" FROM documents
WHERE (contains(lower(text), 'trash') OR contains(text, 'scum')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)""",
    "presence_by_source": """
WITH h AS (SELECT DISTINCT doc_id AS id, source AS model FROM documents WHERE contains(lower(text), 'trash') OR contains(text, 'scum')),
x AS (SELECT m.model, toxic = 1 AS a, h.id IS NOT NULL AS p FROM labels CROSS JOIN (SELECT DISTINCT model FROM h) m LEFT JOIN h ON h.id = doc_id AND h.model = m.model),
c AS (SELECT model, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM x GROUP BY model),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS se FROM c)
SELECT model, tp, fp, fn, tn, se AS sensitivity, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn::DOUBLE / (tn + fp)::DOUBLE END AS specificity,
       CASE WHEN pr + se = 0 THEN 0.0 ELSE 2 * pr * se / (pr + se) END AS f1_score, (tp + tn)::DOUBLE / (tp + fp + fn + tn)::DOUBLE AS accuracy
FROM r""",
    "group_concat_by_type": """
SELECT o_custkey AS "ID", o_orderstatus AS type, coalesce(string_agg(nullif(o_orderpriority, '1-URGENT'), '/' ORDER BY o_orderkey), 'U') AS size, count(*) AS count
FROM orders GROUP BY 1, 2""",
    "type_filter": f"""
WITH t AS (SELECT {pick(P.TYPE_NAMES, 'p_partkey')} AS type FROM part)
SELECT type, count(*) AS n, (SELECT count(*) FROM t WHERE upper(type) = 'ICH') AS n_upper, (SELECT count(*) FROM t WHERE trim(upper(type), ' ' || chr(9) || chr(160)) = 'ICH') AS n_stripped
FROM t WHERE type IN ('ICH', 'IVH', 'PHE') GROUP BY type""",
    "keyword_map": f"SELECT doc_id, {mapped('text', 'lower(text)', P.SYLLABLES)} AS mapped FROM documents",
    "ich_structure_map": f"""
SELECT p_partkey, {mapped('s', 'lower(s)', _ICH)} AS structure FROM (SELECT p_partkey, {pick(P.ICH_PHRASES, 'p_partkey')} AS s FROM part)""",
    "ivh_structure_map": f"""
WITH a AS (SELECT p_partkey, string_split({pick(P.IVH_PHRASES, 'p_partkey')}, '/') AS parts, list_transform(string_split({pick(P.SIDES, 'p_partkey // 3')}, '/'), lambda v: lower(trim(v))) AS sides FROM part),
b AS (SELECT p_partkey, i, trim(parts[i]) AS part, coalesce(sides[i], sides[len(sides)]) AS side FROM a, unnest(range(1, len(parts) + 1)) AS u(i)),
c AS (SELECT *, {labels_of('lower(part)', _IVH)} AS found FROM b),
d AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN contains(lower(part), 'ventricle') THEN ['lateral'] ELSE [part] END AS named FROM c),
e AS (SELECT p_partkey, i, array_to_string(list_transform(named, lambda v: CASE WHEN v <> 'lateral' THEN v WHEN side = 'left' THEN 'lateral_left' WHEN side = 'right' THEN 'lateral_right' WHEN side = 'bilateral' THEN 'lateral_left-lateral_right' ELSE v END), '-') AS v FROM d)
SELECT p_partkey, string_agg(v, '/' ORDER BY i) AS structure FROM e GROUP BY p_partkey""",
    "phe_severity_map": f"""
SELECT p_partkey, {mapped('s', 'lower(strip_accents(s))', _PHE)} AS size FROM (SELECT p_partkey, {pick(P.PHE_PHRASES, 'p_partkey')} AS s FROM part)""",
    "accent_fold_map": f"""
SELECT doc_id, {mapped('text', 'lower(strip_accents(text))', P.FOLDED_SYLLABLES)} AS mapped, md5(lower(strip_accents(text))) AS folded_md5 FROM documents""",
    "format_all": f"""
WITH a AS (SELECT p_partkey // 5 AS id, p_partkey AS k, {pick(P.TYPE_NAMES, 'p_partkey')} AS type, {pick(P.ICH_PHRASES, 'p_partkey')} AS s, {pick(P.SIDES, 'p_partkey')} AS l, {pick(P.PHE_PHRASES, 'p_partkey')} AS z FROM part),
p AS (SELECT id, k, type, s, l, z, i, trim(string_split(s, '/')[i]) AS part, string_split(l, '/') AS sides FROM a, unnest(range(1, len(string_split(s, '/')) + 1)) AS u(i) WHERE type = 'IVH'),
q AS (SELECT *, lower(trim(coalesce(sides[i], sides[len(sides)]))) AS side, {labels_of('lower(part)', [*_IVH, ('frontal', 'lateral')])} AS found FROM p),
v AS (SELECT k, string_agg(array_to_string(list_transform(CASE WHEN len(found) > 0 THEN found WHEN contains(lower(part), 'ventricle') THEN ['lateral'] ELSE [part] END, lambda v: CASE WHEN v <> 'lateral' THEN v WHEN side = 'left' THEN 'lateral_left' WHEN side = 'right' THEN 'lateral_right' WHEN side = 'bilateral' THEN 'lateral_left-lateral_right' ELSE v END), '-'), '/' ORDER BY i) AS ivh FROM q GROUP BY k),
b AS (SELECT id, a.k, type, CASE WHEN type = 'ICH' THEN {mapped('s', 'lower(s)', _ICH)} WHEN type = 'IVH' THEN ivh ELSE s END AS s, l, CASE WHEN type = 'PHE' THEN {mapped('z', 'lower(strip_accents(z))', _PHE)} ELSE z END AS z FROM a LEFT JOIN v ON a.k = v.k WHERE type IN ('ICH', 'IVH', 'PHE'))
SELECT id AS "ID", type, string_agg(s, '/' ORDER BY k) AS structure, string_agg(l, '/' ORDER BY k) AS lateralization, string_agg(z, '/' ORDER BY k) AS size, count(*) AS count
FROM b GROUP BY 1, 2""",
    "set_overlap_per_user": _SETS + """
SELECT id::VARCHAR AS "ID", array_to_string(gt, '/') AS gt, array_to_string(pred, '/') AS pred, correct, round(coverage, 9) AS coverage, round(prec, 9) AS "precision", round(jac, 9) AS jaccard,
       CASE WHEN pred IS NOT NULL THEN array_to_string(missing, '/') END AS missing FROM s""",
    "set_overlap_summary": _SETS + """
SELECT count(*) AS total, count(*) FILTER (WHERE pred IS NULL) AS no_detection, round(avg(coalesce(coverage, 0)), 9) AS avg_gt_coverage, round(avg(coalesce(prec, 0)), 9) AS avg_pred_precision, round(avg(coalesce(jac, 0)), 9) AS avg_jaccard FROM s""",
    "strict_set_accuracy": _SETS + """
SELECT count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE pred IS NULL) AS no_detection, count(*) FILTER (WHERE correct)::DOUBLE / count(*)::DOUBLE AS accuracy FROM s""",
    "location_error_rows": _SETS + """
SELECT CASE WHEN pred IS NULL THEN 'no_detection' ELSE 'mismatch' END AS section, id::VARCHAR AS "ID", array_to_string(gt, '/') AS gt, coalesce(array_to_string(pred, '/'), '') AS pred FROM s WHERE NOT correct""",
    "severity_accuracy": f"""
WITH a AS (SELECT p_partkey, lower(trim({pick(P.SEVERITIES, 'p_partkey')})) AS gt, CASE WHEN p_partkey % 4 <> 0 THEN {pick(P.SEVERITIES, 'p_size')} END AS z FROM part),
b AS (SELECT gt, coalesce(list_contains(list_transform(string_split(z, '/'), lambda v: lower(trim(v))), gt), false) AS ok, coalesce(contains(z, '/'), false) AS several FROM a WHERE gt <> '')
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok)::DOUBLE / count(*)::DOUBLE AS accuracy, count(*) FILTER (WHERE several) AS n_several FROM b""",
    "size_parse": f"""
WITH a AS (SELECT p_partkey, unnest([p_partkey::VARCHAR || {pick(P.SIZE_TAILS, 'p_partkey')}, p_size::VARCHAR || {pick(P.SIZE_TAILS, 'p_size')}]) AS s, generate_subscripts([1, 2], 1) AS i FROM part),
b AS (SELECT *, regexp_extract_all(s, '\\d+(?:\\.\\d+)?')::DOUBLE[] AS n, CASE WHEN contains(s, 'mm') THEN 1.0 ELSE 10.0 END AS f, contains(s, 'x') OR contains(s, '*') AS pair FROM a),
c AS (SELECT p_partkey, i, CASE WHEN pair AND len(n) >= 2 THEN round(least(n[1], n[2]) * f, 3)::DOUBLE::VARCHAR || 'x' || round(greatest(n[1], n[2]) * f, 3)::DOUBLE::VARCHAR WHEN NOT pair AND len(n) = 1 THEN round(n[1] * f, 3)::DOUBLE::VARCHAR END AS v FROM b)
SELECT p_partkey, coalesce(string_agg(v, '/' ORDER BY i), '') AS sizes FROM c GROUP BY p_partkey""",
    "number_extract": "SELECT doc_id, len(n) AS n, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '\\d+(?:\\.\\d+)?') AS n FROM documents)",
    "tolerance_greedy_match": _SIZES + """
SELECT id::VARCHAR AS "ID", array_to_string(missing::INTEGER[], '/') AS missing, array_to_string(rest::INTEGER[], '/') AS extra, correct, round(hits::DOUBLE / len(gt), 9) AS coverage, round(hits::DOUBLE / len(pred), 9) AS "precision"
FROM f""",
    "size_strict": _SIZES + """
SELECT count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE pred IS NULL) AS no_detection, count(*) FILTER (WHERE correct)::DOUBLE / count(*)::DOUBLE AS accuracy FROM f""",
    "size_flexible": _SIZES + """
SELECT count(*) AS total, count(*) FILTER (WHERE pred IS NULL) AS no_detection, round(avg(coalesce(hits::DOUBLE / len(gt), 0)), 9) AS avg_gt_coverage, round(avg(coalesce(hits::DOUBLE / len(pred), 0)), 9) AS avg_pred_precision FROM f""",
    "size_error_rows": _SIZES + """
SELECT CASE WHEN pred IS NULL THEN 'no_detection' ELSE 'mismatch' END AS section, id::VARCHAR AS "ID", array_to_string(list_transform(gt, lambda v: v::VARCHAR || 'mm'), '/') AS gt, CASE WHEN pred IS NULL THEN '' ELSE array_to_string(list_transform(pred, lambda v: v::VARCHAR || 'mm'), '/') END AS pred,
       array_to_string(list_transform(missing, lambda v: v::VARCHAR || 'mm'), '/') AS missing, array_to_string(list_transform(rest, lambda v: v::VARCHAR || 'mm'), '/') AS extra
FROM f WHERE NOT correct""",
    "pair_format": """
WITH a AS (SELECT l_orderkey AS id, list(l_quantity * CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END ORDER BY l_partkey % 11 = 0, l_linenumber, l_partkey, l_suppkey, l_quantity * CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM lineitem GROUP BY 1)
SELECT id AS "ID", array_to_string(list_transform(range(1, len(v) + 1, 2), lambda i: CASE WHEN i < len(v) THEN v[i]::VARCHAR || ' x ' || v[i + 1]::VARCHAR || ' cm' ELSE v[i]::VARCHAR || ' cm' END), '/') AS size FROM a""",
    "unit_to_cm": "SELECT p_partkey, round(p_size * CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 1.0 END::DOUBLE, 9) AS cm FROM part",
    "report_texts": _REPORTS + """SELECT "ID", 'seen' AS "Report" FROM r WHERE k % 10 > 1""",
    "common_keys": _REPORTS + """SELECT key FROM (SELECT unnest(['loc_a', 'loc_b', 'loc_c']) AS key) WHERE key <> 'loc_c' OR NOT EXISTS (SELECT 1 FROM r WHERE k % 7 = 0 AND k % 17 <> 5)""",
    "checklist_booleans": _REPORTS + """SELECT "ID", k % 17 <> 5 AND k % 5 <> 0 AND k % 2 = 0 AS loc_a, k % 17 <> 5 AND p_size > 25 AS loc_b FROM r WHERE k % 10 > 1""",
    "report_measurements": _REPORTS + """
, m AS (SELECT "ID", k, 1 AS o, (k % 3)::DOUBLE AS v, 'mm' AS u, 1.0::DOUBLE AS x1, k::DOUBLE AS z1, 0.5::DOUBLE AS x2, 2.0::DOUBLE AS y2, 3.0::DOUBLE AS z2 FROM r WHERE k % 10 > 1 AND k % 3 > 0
  UNION ALL SELECT "ID", k, 2, p_size::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE k % 10 > 1 AND p_size <> 0)
SELECT "ID", row_number() OVER (PARTITION BY k ORDER BY o)::VARCHAR AS measurement_index, x1, NULL::DOUBLE AS y1, z1, x2, y2, z2, v AS measurement, u AS unit_measure FROM m
UNION ALL SELECT "ID", 'no_measure', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE k % 10 > 1 AND k NOT IN (SELECT k FROM m)""",
    "multi_label_from_flags": _FLAGS + "SELECT * FROM f",
    "ground_truth_join": _FLAGS + """
, l AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS v FROM lineitem GROUP BY 1),
s AS (SELECT id AS "ID", array_to_string(list_transform(range(1, len(v) + 1, 2), lambda i: CASE WHEN i < len(v) THEN v[i]::VARCHAR || ' x ' || v[i + 1]::VARCHAR || ' cm' ELSE v[i]::VARCHAR || ' cm' END), '/') AS size FROM l)
SELECT coalesce(f."ID", s."ID") AS "ID", f.* EXCLUDE ("ID"), size FROM f FULL OUTER JOIN s ON (f."ID" = s."ID")""",
    "outer_join_ids": """
SELECT coalesce(l.doc_id, d.doc_id) AS "ID", quality, n_chars FROM labels l FULL OUTER JOIN (SELECT doc_id + 25 AS doc_id, n_chars FROM documents) d ON l.doc_id = d.doc_id""",
    "resume_anti_join": """SELECT doc_id AS "ID", source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "json_field": "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.k') END AS kind FROM events",
    "parse_answer_lines": f"""
WITH a AS (SELECT p_partkey AS k, p_size, p_name, trim({pick(P.ANSWER_TYPES, 'p_partkey')}) AS t FROM part),
x AS (
  SELECT k, 1 AS o, t AS type, p_size::VARCHAR || ' x 2 cm' AS size, p_name || '=b' AS structure, k::VARCHAR AS severity_phe FROM a WHERE k % 7 <> 0 AND t NOT IN ('', 'U')
  UNION ALL SELECT k, 2, 'PHE', p_size::VARCHAR || ' x 2 cm', p_name || '=b', k::VARCHAR FROM a WHERE k % 7 <> 0)
SELECT k AS "ID", row_number() OVER (PARTITION BY k ORDER BY o)::INTEGER AS "Lesion Index", type, 'U' AS certainty, size, structure, 'U' AS lateralization, 'U' AS ventricle_details, severity_phe, 'U' AS artifacts FROM x
UNION ALL SELECT k, 0, 'No lesions mentioned', 'U', 'U', 'U', 'U', 'U', 'U', 'U' FROM a WHERE k % 7 = 0""",
    "prompt_messages": """
SELECT doc_id, 2::BIGINT AS n, md5('List each lesion of the report on a line: lesion n: type = _; certainty = _; size = _; structure = _; lateralization = _;' || chr(10) || chr(10) || 'Report:' || chr(10) || text) AS user_md5 FROM documents""",
    "prompt_texts": f"""
SELECT doc_id, prompt_id::BIGINT AS prompt_id, md5(said || chr(10) || chr(10) || 'Report:' || chr(10) || text) AS user_md5
FROM documents, (VALUES {", ".join("({}, '{}')".format(k, p.asked.replace("'", "''")) for k, p in sorted(PROMPTS.items()))}) AS p(prompt_id, said)""",
    "path_ids": f"""
WITH a AS (SELECT page_id, {pick(P.PATH_HEADS, 'page_id')} || list_extract(string_split(url, '/'), -1) || {pick(P.PATH_TAILS, 'page_id // 5')} AS p FROM pages),
b AS (SELECT page_id, p, list_extract(string_split(p, '/'), -1) AS b FROM a)
SELECT page_id, coalesce(nullif(regexp_extract(p, '/prompt(\\d+)/', 1), ''), nullif(regexp_extract(p, '/prompt(\\d+)$', 1), ''), nullif(regexp_extract(b, '_prompt(\\d+)', 1), ''), 'U') AS prompt_id,
       coalesce(nullif(regexp_extract(p, '/prompt(\\d+)/', 1), ''), nullif(regexp_extract(b, '_prompt(\\d+)', 1), ''), 'U') AS prompt_id_strict,
       coalesce(nullif(regexp_extract(b, 'results_(.+?)_prompt\\d+', 1), ''), nullif(regexp_replace(regexp_extract(b, 'results_(.+)', 1), '_formated$', ''), ''), 'U') AS model
FROM b""",
    "html_meta_id": f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(url, '/'), -1) || {pick(P.FILE_TAILS, 'page_id')}, '\\.json$', ''), '\\.legacy$', ''), '_report$', '') AS "ID" FROM pages""",
    "bool_parses": f"""
WITH a AS (SELECT p_partkey, lower(trim({pick(P.BOOL_TEXTS, 'p_partkey')})) AS t, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 END AS n FROM part)
SELECT p_partkey, t IN ('true', '1', 'yes', 'y', 't') AS scored, false AS scored_number, t IN ('true', '1', 'yes', 'y', 't') AS listed, coalesce(n <> 0, true) AS listed_number FROM a""",
    "na_tokens": f"SELECT p_partkey, CASE WHEN v NOT IN ('None', 'N/A', '', 'nan', 'NaN', 'null') THEN v END AS v, p_brand FROM (SELECT p_partkey, p_brand, {pick(P.NA_TEXTS, 'p_partkey')} AS v FROM part)",
    "model_grid_summary": """
WITH v AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) % 3 > 0)
SELECT l.lang AS metric, s.source AS model, coalesce(n::VARCHAR, 'N/A') AS value FROM (SELECT DISTINCT lang FROM v) l CROSS JOIN (SELECT DISTINCT source FROM v) s LEFT JOIN v ON v.lang = l.lang AND v.source = s.source""",
    "pivot_metric": """
SELECT event_type AS metric, nullif(count(*) FILTER (WHERE user_id % 4 = 0), 0)::VARCHAR AS b0, nullif(count(*) FILTER (WHERE user_id % 4 = 1), 0)::VARCHAR AS b1, nullif(count(*) FILTER (WHERE user_id % 4 = 2), 0)::VARCHAR AS b2, nullif(count(*) FILTER (WHERE user_id % 4 = 3), 0)::VARCHAR AS b3
FROM events GROUP BY 1""",
    "prompt_metric_pivot": """
WITH v AS (SELECT event_type AS metric, user_id % 3 AS p, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) % 4 > 0)
SELECT metric, coalesce(max(n) FILTER (WHERE p = 0)::VARCHAR, 'N/A') AS prompt1, coalesce(max(n) FILTER (WHERE p = 2)::VARCHAR, 'N/A') AS prompt10, coalesce(max(n) FILTER (WHERE p = 1)::VARCHAR, 'N/A') AS prompt2
FROM (SELECT DISTINCT event_type AS metric FROM events) LEFT JOIN v USING (metric) GROUP BY metric""",
    "models_in_all_prompts": "SELECT source AS model FROM documents GROUP BY source HAVING count(DISTINCT (doc_id // 100) % 5) = (SELECT count(DISTINCT (doc_id // 100) % 5) FROM documents)",
    "first_file_value": "SELECT (page_id % 7)::VARCHAR AS model, min(url) || '#' AS value FROM pages GROUP BY 1",
    "summary_long": """
WITH h AS (SELECT DISTINCT doc_id AS id, lang AS model FROM documents WHERE contains(lower(text), 'trash') OR contains(text, 'scum')),
x AS (SELECT m.model, toxic = 1 AS a, h.id IS NOT NULL AS p FROM labels CROSS JOIN (SELECT DISTINCT model FROM h) m LEFT JOIN h ON h.id = doc_id AND h.model = m.model),
c AS (SELECT model, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE a) AS pos, count(*) FILTER (WHERE NOT a AND NOT p) AS tn, count(*) FILTER (WHERE NOT a) AS neg FROM x GROUP BY model)
SELECT 'ivh_presence_sensitivity' AS metric, model, '3' AS prompt_id, round(CASE WHEN pos = 0 THEN 0 ELSE tp::DOUBLE / pos END, 9) AS value FROM c
UNION ALL SELECT 'ivh_presence_specificity', model, '3', round(CASE WHEN neg = 0 THEN 0 ELSE tn::DOUBLE / neg END, 9) FROM c""",
    "all_scores": _SCORES + """,
c AS (SELECT model, prompt_id, metric, count(*) FILTER (WHERE t AND p)::DOUBLE AS tp, count(*) FILTER (WHERE NOT t AND p)::DOUBLE AS fp, count(*) FILTER (WHERE t AND NOT p)::DOUBLE AS fn, count(*) FILTER (WHERE NOT t AND NOT p)::DOUBLE AS tn FROM pres GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS se FROM c),
said AS (SELECT model, prompt_id, metric, '' AS mode, unnest(['tp', 'fp', 'fn', 'tn', 'sensitivity', 'specificity', 'f1_score', 'accuracy']) AS name,
  unnest([tp, fp, fn, tn, se, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, CASE WHEN pr + se = 0 THEN 0 ELSE 2 * pr * se / (pr + se) END, (tp + tn) / (tp + fp + fn + tn)]) AS value FROM r
UNION ALL SELECT model, prompt_id, metric, '', unnest(['total', 'correct', 'accuracy']), unnest([count(*)::DOUBLE, count(*) FILTER (WHERE ok)::DOUBLE, avg(ok::INTEGER)]) FROM sevs GROUP BY model, prompt_id, metric
UNION ALL SELECT model, prompt_id, metric, 'strict', unnest(['total', 'correct', 'no_detection', 'accuracy']), unnest([count(*)::DOUBLE, count(*) FILTER (WHERE ok)::DOUBLE, count(*) FILTER (WHERE pred IS NULL)::DOUBLE, avg(ok::INTEGER)]) FROM lok GROUP BY model, prompt_id, metric
UNION ALL SELECT model, prompt_id, metric, 'flexible', unnest(['total', 'no_detection', 'avg_gt_coverage', 'avg_pred_precision', 'avg_jaccard']),
  unnest([count(*)::DOUBLE, count(*) FILTER (WHERE pred IS NULL)::DOUBLE, avg(coalesce(common / len(gt), 0)), avg(coalesce(common / len(pred), 0)), avg(coalesce(common / (len(gt) + len(pred) - common), 0))]) FROM lok GROUP BY model, prompt_id, metric)
SELECT model, prompt_id, metric, mode, name, round(value, 9) AS value FROM said""",
    "all_errors": _SCORES + """,
e AS (SELECT model, prompt_id, metric, '' AS mode, CASE WHEN p THEN 'false_positive' ELSE 'false_negative' END AS section, id::VARCHAR AS s FROM pres WHERE t <> p
UNION ALL SELECT model, prompt_id, metric, '', 'extra', id::VARCHAR FROM (SELECT model, prompt_id, id, unnest(['ivh_presence', 'phe_presence']) AS metric, unnest([p_ivh, p_phe]) AS p FROM f) WHERE p AND id NOT IN (SELECT id FROM g WHERE counts)
UNION ALL SELECT model, prompt_id, metric, '', CASE WHEN found THEN 'mismatch' ELSE 'no_detection' END, id::VARCHAR || chr(9) || gt FROM (SELECT * REPLACE (coalesce(found, false) AS found) FROM sevs) WHERE NOT ok
UNION ALL SELECT model, prompt_id, metric, unnest(['strict', 'flexible']), CASE WHEN pred IS NULL THEN 'no_detection' ELSE 'mismatch' END, id::VARCHAR || chr(9) || array_to_string(gt, '/') FROM lok WHERE NOT ok)
SELECT model, prompt_id, metric, mode, section, count(*) AS n, sum(length(s))::BIGINT AS chars FROM e GROUP BY ALL""",
}
