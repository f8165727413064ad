"""SQL of the queries in ``catalogue_more``."""

from __future__ import annotations

from checks.oracle import AP, KNN, MODEL_TEXT, N_WRONG, PREDICTIONS, RETRIEVED, TEST, TOKENS, TRAIN, VEC_SPLIT, VECS, long, neighbours, norm

_CORRECTED = """CASE WHEN idx % 14 = 0 THEN 'NY' WHEN idx % 7 = 0 THEN 'NX' ELSE nominal END AS nominal,
  CASE WHEN idx % 7 = 0 AND idx % 2 <> 0 THEN 'DX' ELSE department END AS department,
  CASE WHEN idx % 7 = 0 AND idx % 2 <> 0 THEN 'TX' ELSE tax_code END AS tax_code"""

_HASHED = f"""{VEC_SPLIT}, size AS (SELECT count(*) AS n, CAST(greatest(1, ceil(log2(count(*) / 64))) AS BIGINT) AS bits FROM {TRAIN}),
  dims AS (SELECT unnest(range(0, 64)) AS i),
  planes AS (SELECT t, j, list(CASE WHEN md5('42|' || t || '|' || j || '|' || i) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS plane
    FROM (SELECT unnest(range(0, 12)) AS t), (SELECT unnest(range(0, bits)) AS j FROM size), dims GROUP BY t, j),
  codes AS (SELECT idx, split, t, sum(CASE WHEN list_inner_product(embedding, plane) >= 0 THEN (1::BIGINT << j) ELSE 0 END)::BIGINT AS code
    FROM sp, planes GROUP BY idx, split, t),
  met AS (SELECT DISTINCT q.idx AS query_id, i.idx FROM codes q JOIN codes i ON q.t = i.t AND q.split = 'test' AND i.split = 'train'
    AND bit_count(xor(q.code, i.code)) <= 1),
  measured AS (SELECT query_id, m.idx, round(1 - list_inner_product(q.embedding, i.embedding)
      / (sqrt(list_inner_product(q.embedding, q.embedding)) * sqrt(list_inner_product(i.embedding, i.embedding))), 9) AS distance
    FROM met m JOIN vecs q ON q.idx = query_id JOIN vecs i ON i.idx = m.idx),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS rank FROM measured) WHERE rank <= 5),
  enough AS (SELECT query_id FROM near GROUP BY query_id HAVING count(*) = 5),
  {neighbours(TEST, TRAIN, 5)},
  approx AS (SELECT query_id, idx, distance, rank, false AS exact FROM near WHERE query_id IN (SELECT query_id FROM enough) UNION ALL
    SELECT query_id, idx, distance, rank, true FROM knn WHERE query_id NOT IN (SELECT query_id FROM enough))"""

_CONFIDENCES = """e AS (SELECT epoch_ms(CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800000) AS w, event_id, user_id, value FROM events),
  c AS (SELECT w, 'nominal' AS field, (event_id % 11) / 10.0::DOUBLE AS x FROM e UNION ALL
        SELECT w, 'department', (user_id % 10) / 10.0::DOUBLE FROM e UNION ALL SELECT w, 'tax_code', least(value, 20.0) / 20.0::DOUBLE FROM e),
  b AS (SELECT w, field, greatest(0, least(9, floor(coalesce(x, 0) * 10)))::INT AS bin, count(*) AS n FROM c GROUP BY ALL),
  grid AS (SELECT w, field, bin, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT w, field FROM b) CROSS JOIN (SELECT unnest(range(0, 10))::INT AS bin) LEFT JOIN b USING (w, field, bin)),
  whole AS (SELECT *, sum(n) OVER (PARTITION BY w, field) AS total, sum(n) OVER (PARTITION BY w, field ORDER BY bin) AS upto FROM grid),
  pair AS (SELECT *, lag(n) OVER o AS old_n, lag(total) OVER o AS old_total, lag(upto) OVER o AS old_upto FROM whole WINDOW o AS (PARTITION BY field, bin ORDER BY w)),
  terms AS (SELECT w, field, total, (n + 0.5) / (total + 5) AS p, (old_n + 0.5) / (old_total + 5) AS q, abs(upto / total - old_upto / old_total) AS gap FROM pair)
  SELECT strftime(w, '%Y-%m-%d') AS window_start, field, any_value(total)::BIGINT AS n, round(coalesce(sum((p - q) * ln(p / q)), 0), 6) AS psi,
    round(coalesce(max(gap), 0), 6) AS ks, coalesce(sum((p - q) * ln(p / q)), 0) > 0.2 AS alert FROM terms GROUP BY w, field"""

_WORDS = f"""{AP}, lines AS (SELECT line_id, "NOMINAL" AS label, {TOKENS.format('(' + MODEL_TEXT + ')')} AS words FROM ap),
  per AS (SELECT term, label, count(*) AS n FROM (SELECT label, unnest(list_distinct(words)) AS term FROM lines) GROUP BY ALL),
  every AS (SELECT sum(n) AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM (SELECT count(*) AS n FROM lines GROUP BY label)),
  found AS (SELECT term, sum(per.n)::BIGINT AS df, sum(per.n) / any_value(every.n) AS share, log2(sum(per.n)) - sum(per.n * log2(per.n)) / sum(per.n) AS entropy,
      (log2(sum(per.n)) - sum(per.n * log2(per.n)) / sum(per.n)) / any_value(every.entropy) AS entropy_ratio FROM per, every GROUP BY term),
  boiler AS (SELECT * FROM found WHERE share >= 0.05 AND entropy_ratio >= 0.9)"""

_NAMES = f"""spelled AS (
    SELECT {norm('name')} AS name, count(*) AS n FROM (
      SELECT CASE left(md5(l_orderkey || '-' || l_linenumber), 1)
        WHEN '0' THEN substr(s_name, 1, 2) || substr(s_name, 4) WHEN '1' THEN substr(s_name, 1, 2) || substr(s_name, 2)
        WHEN '2' THEN upper(s_name) WHEN '3' THEN substr(s_name, 1, 3) || substr(s_name, 5, 1) || substr(s_name, 4, 1) || substr(s_name, 6)
        ELSE s_name END AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1),
  parts AS (SELECT name, regexp_replace(name, '[^0-9]', '', 'g') AS digits, regexp_replace(name, '[0-9]', '', 'g') AS rest FROM spelled),
  links AS (SELECT a.name AS a, b.name AS b FROM parts a JOIN parts b ON a.digits = b.digits AND levenshtein(a.rest, b.rest) <= 2),
  reached(name, other) AS (SELECT a, b FROM links UNION SELECT r.name, l.b FROM reached r JOIN links l ON l.a = r.other),
  rooted AS (SELECT name, min(other) AS root FROM reached GROUP BY name),
  chosen AS (SELECT root, arg_min(name, (-n, name)) AS canonical, count(*) AS n_spellings FROM rooted JOIN spelled USING (name) GROUP BY root)"""


def _kmeans(rounds: int = 5) -> str:
    """The fixed rounds of k-means, one after the other."""
    steps = ["""points AS (SELECT idx, list_transform(embedding, lambda x: floor(x * 1024 + 0.5)) AS x, row_number() OVER (ORDER BY md5('42|' || idx), idx) - 1 AS place,
      greatest(5, floor(sqrt(count(*) OVER ()))) AS k FROM vecs)""", "c0 AS (SELECT place AS c, x AS m FROM points WHERE place < k)"]
    nearest = """(SELECT idx, c FROM (SELECT idx, c, row_number() OVER (PARTITION BY idx ORDER BY list_inner_product(m, m) - 2 * list_inner_product(x, m), c) AS r
      FROM points, {0}) WHERE r = 1)"""
    for i in range(rounds):
        steps.append(f"""s{i + 1} AS (SELECT c, i, floor(sum(x[i]) / count(*)) AS v FROM {nearest.format(f'c{i}')} JOIN points USING (idx), (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
      c{i + 1} AS (SELECT c, coalesce(new, m) AS m FROM c{i} LEFT JOIN (SELECT c, list(v ORDER BY i) AS new FROM s{i + 1} GROUP BY c) USING (c))""")
    return ", ".join([*steps, f"cells AS (SELECT idx, c AS cluster FROM {nearest.format(f'c{rounds}')})"])


_REQUIRED = "['DATE', 'REF', 'DETAIL', 'NET', 'TC', 'VAT', 'SUPPLIER', 'NOMINAL', 'DEPARTMENT']"

MORE = {
    "index_fit": f"WITH {VECS} SELECT idx, text, nominal, department, tax_code, CASE WHEN list_inner_product(embedding, embedding) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, true AS in_range FROM vecs",
    "knn_from_index": f"WITH {KNN} {RETRIEVED}",
    "index_upkeep": f"""WITH {KNN}, fixed AS (SELECT idx, text, {_CORRECTED} FROM vecs)
      SELECT query_id, rank, idx, text, nominal, department, tax_code, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM knn JOIN fixed USING (idx)""",
    "knn_approximate": f"WITH {_HASHED} SELECT query_id, idx, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity, rank, exact FROM approx",
    "knn_approximate_recall": f"""WITH {_HASHED} SELECT count(*) AS wanted, count(a.idx) AS found, round(count(a.idx) / count(*), 6) AS recall
      FROM knn k LEFT JOIN approx a ON a.query_id = k.query_id AND a.idx = k.idx""",
    "supplier_canonical": f"WITH RECURSIVE {_NAMES} SELECT name, canonical, md5(canonical) AS canonical_id, n, n_spellings FROM rooted JOIN spelled USING (name) JOIN chosen USING (root)",
    "confidence_distance": f"WITH {_CONFIDENCES}",
    "confidence_stream": f"WITH {_CONFIDENCES}",
    "boilerplate_terms": f"WITH {_WORDS} SELECT term, df, round(share, 6) AS share, round(entropy, 6) AS entropy, round(entropy_ratio, 6) AS entropy_ratio FROM boiler",
    "stripped_text": f"""WITH {_WORDS}, terms AS (SELECT list(term) AS t FROM boiler)
      SELECT line_id, array_to_string(list_filter(words, lambda w: NOT list_contains(t, w)), ' ') AS stripped_text FROM lines, terms""",
    "trained_vectors": f"""WITH {AP}, lines AS (SELECT {MODEL_TEXT} AS model_text FROM ap)
      SELECT model_text, count(*) AS n, 32::BIGINT AS dim, CASE WHEN model_text = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm, true AS same
      FROM (SELECT model_text FROM lines UNION ALL SELECT '' FROM lines) GROUP BY model_text""",
    "version_as_of": f"""WITH {AP.replace('s_name AS "SUPPLIER"', 's_name AS "SUPPLIER", CAST(o_orderdate AS DATE) AS day, l_orderkey AS ref')},
      changed AS (SELECT "SUPPLIER", day AS valid_from, max('v' || ref) AS model_version FROM ap WHERE ref % 20 = 0 GROUP BY ALL)
      SELECT line_id, strftime(valid_from, '%Y-%m-%d') AS valid_from, model_version
      FROM ap ASOF LEFT JOIN changed ON ap."SUPPLIER" = changed."SUPPLIER" AND ap.day >= changed.valid_from""",
    "metric_cube": f"""WITH {PREDICTIONS}, {long().replace('SELECT', 'SELECT supplier, true_department,')}
      SELECT field, supplier, true_department, grouping_id(field, supplier, true_department)::BIGINT AS level, count(*) AS n,
        sum(coalesce(t = p, false)::INT)::BIGINT AS n_correct, round(avg(coalesce(t = p, false)::INT), 6) AS accuracy, round(1 - avg(coalesce(t = p, false)::INT), 6) AS error_rate
      FROM long GROUP BY CUBE (field, supplier, true_department)""",
    "cluster_holdout": f"""WITH {VECS}, {_kmeans()},
      g AS (SELECT cluster, row_number() OVER (ORDER BY md5('42|' || cluster) || '|' || cluster) AS r FROM (SELECT DISTINCT cluster FROM cells)),
      c AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS t FROM g)
      SELECT idx, cluster::BIGINT AS cluster, CASE WHEN r <= t THEN 'train' ELSE 'test' END AS split FROM cells JOIN g USING (cluster), c""",
    "csv_lines": f"""WITH {AP.replace('s_name AS "SUPPLIER"', 's_name AS "SUPPLIER", strftime(o_orderdate, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') AS date, l_orderkey::VARCHAR AS ref, l_extendedprice * (1 - l_discount) AS net')}
      SELECT date, ref, "DETAIL" AS detail, round(net, 6) AS net, "NOMINAL" AS nominal, "DEPARTMENT" AS department, "TC" AS tc, 'says "' || ref || '", or so' AS note,
        {MODEL_TEXT} AS model_text, (SELECT count(DISTINCT "NOMINAL") FROM ap) AS n_nominal, (SELECT count(DISTINCT "DEPARTMENT") FROM ap) AS n_department,
        (SELECT count(DISTINCT "TC") FROM ap) AS n_tc FROM ap""",
    "csv_missing_columns": f"""SELECT c AS "column", CASE WHEN (SELECT count(*) FROM lineitem) >= 0 THEN 'missing columns: ' || c END AS problem FROM (SELECT unnest({_REQUIRED}) AS c)""",
    "error_report_files": f"""WITH {PREDICTIONS} SELECT detail, supplier, true_nominal, pred_nominal, true_department, pred_department,
      true_tc, pred_tc, 'error_report_supplier_mode_v1-0' AS folder FROM pred WHERE ({N_WRONG}) > 0""",
    "fields_without_labels": """SELECT f AS field, CASE WHEN (SELECT count(*) FROM lineitem) > 0 THEN 'field ' || f || ' holds no labels' END AS problem
      FROM (SELECT unnest(['NOMINAL', 'DEPARTMENT', 'TC']) AS f)""",
}
