"""The registered queries in SQL, over views named like the given tables.

Common table expressions are composed from the fragments below.
"""

from __future__ import annotations

from checks import oracle_text as text

# ---- table adapters ----

AP = """ap AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS line_id,
         p_name || ' & ' || p_brand AS "DETAIL", s_name AS "SUPPLIER", p_type AS "NOMINAL",
         c_mktsegment AS "DEPARTMENT", 'T' || CAST(round(l_tax * 100) AS INT) AS "TC"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS line_id, text AS "DETAIL", source AS "SUPPLIER", lang AS "NOMINAL",
         'Q' || quality AS "DEPARTMENT", 'X' || toxic AS "TC"
  FROM documents LEFT JOIN labels USING (doc_id))"""

VECS = """vecs AS (
  SELECT vec_id AS idx, 'item ' || vec_id AS text, CAST(embedding AS DOUBLE[]) AS embedding,
         'N' || label AS nominal, 'D' || (label % 4) AS department, 'T' || (vec_id % 8) AS tax_code,
         CAST(vec_id AS VARCHAR) AS line_id
  FROM embeddings)"""

GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN "SUPPLIER" NOT LIKE '%7' THEN "NOMINAL" END AS "NOMINAL") FROM ap)"""


def norm(column: str) -> str:
    lowered = f"replace(lower(coalesce({column}, '')), '&', ' and ')"
    plain = rf"regexp_replace({lowered}, '[^a-z0-9\-\s.]', ' ', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"


MODEL_TEXT = f"""'detail: ' || {norm('"DETAIL"')} || ' | supplier: ' || {norm('"SUPPLIER"')}"""
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def fields(source: str, keys: str = "") -> str:
    """One row per field and line."""
    keys = keys + ", " if keys else ""
    return " UNION ALL ".join(
        f"""SELECT {keys}'{f}' AS field, "{f}" AS label FROM {source}"""
        for f in ("NOMINAL", "DEPARTMENT", "TC")
    )


def vocabulary(source: str) -> str:
    return f"""vocab AS (
  SELECT field, label, row_number() OVER (PARTITION BY field ORDER BY label) - 1 AS idx
  FROM (SELECT DISTINCT field, label FROM ({fields(source)}) WHERE label IS NOT NULL))"""


# ---- splits ----


def split(source: str, stratum: str, name: str = "sp") -> str:
    """Largest-remainder quotas per stratum, rows in order of their digest."""
    return f"""keyed AS (
  SELECT *, {stratum} AS stratum, md5('42|' || line_id) || '|' || line_id AS k FROM {source}),
sized AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test FROM keyed),
shares AS (
  SELECT stratum, (count(*)::HUGEINT * any_value(n - n_test)) // any_value(n) AS base,
         (count(*)::HUGEINT * any_value(n - n_test)) % any_value(n) AS rest, any_value(n - n_test) AS n_train
  FROM keyed, sized GROUP BY stratum),
quotas AS (
  SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
                              <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
{name} AS (
  SELECT keyed.*, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY k) <= quota
                       THEN 'train' ELSE 'test' END AS split
  FROM keyed JOIN quotas USING (stratum))"""


ALL_FIELDS = """coalesce("NOMINAL", 'nan') || '_' || coalesce("DEPARTMENT", 'nan') || '_' || coalesce("TC", 'nan')"""
LINE_SPLIT = f"{AP}, {split('ap', ALL_FIELDS)}"

FALLBACK = f"""{DOCS}, total AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM docs),
fits3 AS (
  SELECT min(c) >= 2 AND count(*) <= any_value(t) AND count(*) <= any_value(n - t) AS ok
  FROM (SELECT count(*) AS c FROM docs GROUP BY {ALL_FIELDS}), total),
fits1 AS (
  SELECT min(c) >= 2 AND count(*) <= any_value(t) AND count(*) <= any_value(n - t) AS ok
  FROM (SELECT count(*) AS c FROM docs GROUP BY "NOMINAL"), total),
levelled AS (
  SELECT docs.*, CASE WHEN (SELECT ok FROM fits3) THEN 'all_fields'
                      WHEN (SELECT ok FROM fits1) THEN 'NOMINAL' ELSE 'random' END AS level FROM docs),
{split('levelled', f"CASE level WHEN 'all_fields' THEN {ALL_FIELDS} WHEN 'NOMINAL' THEN coalesce("
       + '"NOMINAL"' + ", 'nan') ELSE 'all' END")}"""

# ---- predictions ----

_COUNTS = f"""counts AS (
  SELECT "SUPPLIER", field, label, count(*) AS n
  FROM ({fields("(SELECT * FROM sp WHERE split = 'train')", '"SUPPLIER"')}) GROUP BY ALL),
overall AS (
  SELECT field, label FROM (SELECT field, label, sum(n) AS n FROM counts GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, label) = 1),
modes AS (
  SELECT "SUPPLIER", field, label FROM counts
  QUALIFY row_number() OVER (PARTITION BY "SUPPLIER", field ORDER BY n DESC, label) = 1)"""


def _predicted(label: str) -> str:
    columns = ", ".join(
        f"""sp."{c}" AS true_{f}, {label.format(c=c)} AS pred_{f}"""
        for f, c in (("nominal", "NOMINAL"), ("department", "DEPARTMENT"), ("tc", "TC"))
    )
    return f"""SELECT line_id, "DETAIL" AS detail, "SUPPLIER" AS supplier, {columns}
  FROM sp WHERE split = 'test'"""


_MODE = """coalesce((SELECT label FROM modes WHERE modes."SUPPLIER" = sp."SUPPLIER" AND field = '{c}'),
                   (SELECT label FROM overall WHERE field = '{c}'))"""
_MAJORITY = "(SELECT label FROM overall WHERE field = '{c}')"
PREDICTIONS = f"{LINE_SPLIT}, {_COUNTS}, pred AS ({_predicted(_MODE)})"
MAJORITY = f"majority AS ({_predicted(_MAJORITY)})"


def long(pred: str = "pred", name: str = "long") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, true_{f} AS t, pred_{f} AS p FROM {pred}" for f in ("nominal", "department", "tc")
    ) + ")"


def report(source: str = "long", name: str = "report", keys: str = "field") -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM (SELECT {keys}, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
        FROM (SELECT {keys}, t AS label, CASE WHEN coalesce(t = p, false) THEN 1 ELSE 0 END AS tp, 0 AS fp,
                     CASE WHEN coalesce(t = p, false) THEN 0 ELSE 1 END AS fn FROM {source}
              UNION ALL
              SELECT {keys}, p, 0, 1, 0 FROM {source} WHERE NOT coalesce(t = p, false))
        WHERE label IS NOT NULL GROUP BY {keys}, label))"""


def scored(source: str = "long", rep: str = "report", name: str = "scored", keys: str = "field") -> str:
    return f"""{name} AS (
  SELECT {keys}, n, n_correct, n_correct / n AS accuracy, f1_macro
  FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE coalesce(t = p, false)) AS n_correct FROM {source} GROUP BY {keys})
  JOIN (SELECT {keys}, avg(f1) AS f1_macro FROM {rep} GROUP BY {keys}) USING ({keys}))"""


WRONG = "((coalesce(true_{0} = pred_{0}, false) = false)::INT)"
N_WRONG = " + ".join(WRONG.format(f) for f in ("nominal", "department", "tc"))
SCORED = f"{PREDICTIONS}, {long()}, {report()}, {scored()}"

# ---- neighbours ----

VEC_SPLIT = f"{VECS}, {split('vecs', chr(39) + 'all' + chr(39))}"


def neighbours(queries: str, index: str, k: int, name: str = "knn") -> str:
    return f"""{name} AS (
  SELECT query_id, idx, distance, 1 - distance AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS rank
    FROM (SELECT q.idx AS query_id, i.idx AS idx,
                 CASE WHEN q.norm = 0 OR i.norm = 0 THEN 1.0::DOUBLE
                      ELSE round(1 - list_inner_product(q.embedding, i.embedding) / (q.norm * i.norm), 9) END AS distance
          FROM (SELECT *, sqrt(list_inner_product(embedding, embedding)) AS norm FROM {queries}) q,
               (SELECT *, sqrt(list_inner_product(embedding, embedding)) AS norm FROM {index}) i))
  WHERE rank <= {k})"""


TEST, TRAIN = "(SELECT * FROM sp WHERE split = 'test')", "(SELECT * FROM sp WHERE split = 'train')"
KNN = f"{VEC_SPLIT}, {neighbours(TEST, TRAIN, 5)}"
RETRIEVED = "SELECT query_id, rank, idx, text, nominal, department, tax_code, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM knn JOIN vecs USING (idx)"

_BALLOT = """ballot AS (
  SELECT query_id, field, label, round(sum(greatest(similarity, 0)), 9) AS w, min(rank) AS first FROM (
    SELECT query_id, rank, similarity, 'nominal' AS field, nominal AS label FROM knn JOIN vecs USING (idx)
    UNION ALL SELECT query_id, rank, similarity, 'department', department FROM knn JOIN vecs USING (idx)
    UNION ALL SELECT query_id, rank, similarity, 'tax_code', tax_code FROM knn JOIN vecs USING (idx))
  GROUP BY ALL),
chosen AS (
  SELECT query_id, field, label, CASE WHEN total = 0 THEN 0.0 ELSE w / total END AS confidence
  FROM (SELECT *, sum(w) OVER (PARTITION BY query_id, field) AS total,
               row_number() OVER (PARTITION BY query_id, field ORDER BY w DESC, label) AS place FROM ballot)
  WHERE place = 1),
voted AS (
  SELECT query_id, max(label) FILTER (field = 'nominal') AS nominal,
         max(label) FILTER (field = 'department') AS department, max(label) FILTER (field = 'tax_code') AS tax_code,
         max(confidence) FILTER (field = 'nominal') AS nominal_confidence,
         max(confidence) FILTER (field = 'department') AS department_confidence,
         max(confidence) FILTER (field = 'tax_code') AS tax_code_confidence
  FROM chosen GROUP BY query_id)"""
VOTED = f"{KNN}, {_BALLOT}"
VOTE_PREDICTIONS = """vote_pred AS (
  SELECT s.line_id, s.nominal AS true_nominal, v.nominal AS pred_nominal, s.department AS true_department,
         v.department AS pred_department, s.tax_code AS true_tc, v.tax_code AS pred_tc
  FROM sp s LEFT JOIN voted v ON v.query_id = s.idx WHERE s.split = 'test')"""

# ---- comparing runs ----

# Both splits use the same names inside, so each lives in its own subquery.
_VOTE_LONG = f"(WITH {VOTED}, {VOTE_PREDICTIONS} SELECT * FROM vote_pred)"


_SIDES = "line_id, true_nominal, pred_nominal, true_department, pred_department, true_tc, pred_tc"
RESULTS = f"""{PREDICTIONS}, {MAJORITY}, vote_pred AS {_VOTE_LONG},
runs AS (
  SELECT 'majority' AS experiment, 'majority' AS method, true AS is_baseline, 0::BIGINT AS run_order, {_SIDES} FROM majority
  UNION ALL SELECT 'supplier', 'supplier_mode', false, 1, {_SIDES} FROM pred
  UNION ALL SELECT 'retrieval', 'retrieval_vote', false, 2, {_SIDES} FROM vote_pred),
run_sample AS (SELECT method, avg((3 - ({N_WRONG})) / 3) AS sample_wise_f1 FROM runs GROUP BY method),
run_long AS (
  SELECT experiment, method, is_baseline, run_order, 'nominal' AS field, true_nominal AS t, pred_nominal AS p FROM runs
  UNION ALL SELECT experiment, method, is_baseline, run_order, 'department', true_department, pred_department FROM runs
  UNION ALL SELECT experiment, method, is_baseline, run_order, 'tc', true_tc, pred_tc FROM runs),
{report('run_long', 'run_report', 'experiment, method, is_baseline, run_order, field')},
{scored('run_long', 'run_report', 'results', 'experiment, method, is_baseline, run_order, field')},
methods AS (
  SELECT experiment, method, is_baseline, run_order, avg(f1_macro) AS f1_macro, avg(accuracy) AS accuracy,
         any_value(sample_wise_f1) AS sample_wise_f1
  FROM results JOIN run_sample USING (method) GROUP BY ALL)"""

# ---- TF-IDF ----


def grams(source: str, text_column: str, high: int) -> str:
    arrays = ["w"] + [
        f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
        for n in range(2, high + 1)
    ]
    joined = arrays[0]
    for a in arrays[1:]:
        joined = f"list_concat({joined}, {a})"
    return f"""words AS (SELECT line_id, {TOKENS.format(text_column)} AS w FROM {source}),
grams AS (SELECT line_id, unnest({joined}) AS term FROM words)"""


def tfidf(source: str, text_column: str, high: int, features: int, min_df: int, max_df: str, tf: str) -> str:
    return f"""{grams(source, text_column, high)},
tf AS (SELECT line_id, term, count(*) AS tf FROM grams GROUP BY ALL),
kept AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term
  HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT count(*) FROM {source})
  ORDER BY cf DESC, term LIMIT {features}),
terms AS (
  SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx,
         ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM kept),
raw AS (SELECT line_id, term, idx, ({tf}) * idf AS raw FROM tf JOIN terms USING (term)),
weights AS (
  SELECT line_id, term, idx, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY line_id)), 6) AS weight FROM raw)"""


# ---- answers ----

_CONF = ''', "nominal_confidence": 0.75, "department_confidence": {}, "tax_code_confidence": 0.5'''
_TAIL = "', \"reasoning\": \"  close to past lines \"}'"
RESPONSES = f"""answers AS (
  SELECT line_id, "NOMINAL", "DEPARTMENT", "TC", substr(md5(line_id), 32, 1) AS damage,
         '{{"nominal": "' || "NOMINAL" || '", "department": "' || "DEPARTMENT" || '"' AS head,
         ', "tax_code": "' || "TC" || '"' AS code,
         '  NOMINAL: ' || "NOMINAL" || ' ' || chr(10) || 'DEPARTMENT:' || "DEPARTMENT" AS lined FROM ap),
responses AS (
  SELECT line_id, CASE damage
    WHEN '0' THEN head || '{_CONF.format("1.0")}' || {_TAIL}
    WHEN '1' THEN head || code || '{_CONF.format("1.2")}' || {_TAIL}
    WHEN '2' THEN 'I think ' || "NOMINAL"
    WHEN '3' THEN head || code || '{_CONF.format("1.0")}' || ', "reasoning": null}}'
    WHEN '4' THEN head || code || '{_CONF.format("-0.1")}' || {_TAIL}
    WHEN '5' THEN head || code || '{_CONF.format("0.25")}' || ', "extra": 1' || {_TAIL}
    ELSE head || code || '{_CONF.format("1.0")}' || {_TAIL} END AS response,
  'Sure.' || chr(10) || lined AS opening, "TC", damage FROM answers),
line_responses AS (
  SELECT line_id, CASE damage WHEN '0' THEN opening WHEN '1' THEN opening || chr(10) || 'TC: none' || chr(10) || 'TC: ' || "TC"
                              WHEN '2' THEN '' ELSE opening || chr(10) || 'TC: ' || "TC" END AS line_response
  FROM responses)"""
_LABELS = ("nominal", "department", "tax_code")
_NUMBERS = tuple(f"{x}_confidence" for x in _LABELS)
PARSED = f"""{AP}, {RESPONSES},
members AS (
  SELECT line_id, json_valid(response) AS readable,
         {", ".join(f"CASE WHEN json_valid(response) THEN json_extract_string(response, '$.{m}') END AS {m}" for m in _LABELS)},
         {", ".join(f"CASE WHEN json_valid(response) THEN TRY_CAST(json_extract_string(response, '$.{m}') AS DOUBLE) END AS {m}" for m in _NUMBERS)},
         CASE WHEN json_valid(response) THEN json_extract_string(response, '$.reasoning') END AS reasoning
  FROM responses),
judged AS (
  SELECT *, CASE WHEN NOT readable THEN 'not_json'
    {" ".join(f"WHEN {m} IS NULL THEN 'missing:{m}'" for m in (*_LABELS, *_NUMBERS, "reasoning"))}
    {" ".join(f"WHEN {m} < 0 OR {m} > 1 THEN 'range:{m}'" for m in _NUMBERS)} ELSE 'ok' END AS reason FROM members),
parsed AS (
  SELECT line_id, {", ".join(f"CASE WHEN reason = 'ok' THEN {m} END AS {m}" for m in (*_LABELS, *_NUMBERS))},
         CASE WHEN reason = 'ok' THEN trim(reasoning) ELSE '' END AS reasoning, reason = 'ok' AS valid, reason FROM judged)"""


def _last(prefix: str) -> str:
    lines = f"list_filter(string_split(line_response, chr(10)), lambda x: starts_with(trim(x), '{prefix}'))"
    return f"coalesce(trim(replace(trim({lines}[-1]), '{prefix}', '')), '')"


# ---- hashed vectors ----


def hashed(source: str, key: str, text_column: str, dim: int) -> str:
    """``key, pos, value``: unit-length counts of hashed uni- and bigrams."""
    return f"""SELECT {key}, pos, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM (
    SELECT {key}, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS BIGINT) AS pos, count(*)::DOUBLE AS n
    FROM (SELECT {key}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string([w[i], w[i + 1]], ' ')))) AS term
          FROM (SELECT {key}, {TOKENS.format(text_column)} AS w FROM {source})) GROUP BY ALL)"""


_NOVEL = f"""{AP},
past AS (SELECT line_id, {MODEL_TEXT} AS model_text, "NOMINAL" AS nominal, "DEPARTMENT" AS department, "TC" AS tax_code FROM ap),
fresh AS (SELECT DISTINCT p_name AS query_id, 'detail: ' || {norm('p_name')} AS model_text FROM part),
past_texts AS (SELECT DISTINCT model_text FROM past),
past_vec AS ({hashed('past_texts', 'model_text', 'model_text', 384)}),
fresh_vec AS ({hashed('fresh', 'query_id', 'model_text', 384)}),
by_text AS (
  SELECT query_id, p.model_text, round(1 - sum(p.value * f.value), 9) AS distance
  FROM past_vec p JOIN fresh_vec f USING (pos) GROUP BY query_id, p.model_text),
ranked AS (
  SELECT query_id, line_id AS idx, nominal, department, tax_code, distance, 1 - distance AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, line_id) AS rank
  FROM by_text JOIN past USING (model_text)),
knn AS (SELECT * FROM ranked WHERE rank <= 5)"""

_PER_FIELD = """ballot AS (
  SELECT query_id, field, label, round(sum(greatest(similarity, 0)), 9) AS w FROM (
    SELECT query_id, similarity, 'nominal' AS field, nominal AS label FROM knn
    UNION ALL SELECT query_id, similarity, 'department', department FROM knn
    UNION ALL SELECT query_id, similarity, 'tax_code', tax_code FROM knn) GROUP BY ALL)"""
_CHOSEN = _BALLOT[_BALLOT.index("chosen AS"):]

_HOLDS = ", ".join(f"true AS {f}_{x}" for f in ("nominal", "department", "tc") for x in ("known", "sure"))
# Only labelled documents are fitted; the split is made of them.
_KNOWN_SPLIT = FALLBACK.replace("LEFT JOIN labels", "JOIN labels")

_FOLDS = f"""r AS (SELECT *, count(*) OVER () AS c, row_number() OVER (ORDER BY md5('42|' || line_id) || '|' || line_id) AS r FROM {TRAIN}),
  f AS (SELECT *, (r > c // 3 + (c % 3) // 3)::BIGINT + (r > c // 3 * 2 + (c % 3) * 2 // 3)::BIGINT AS fold FROM r)"""

ORACLE: dict[str, str] = {
    # text
    "text_normalized": f"SELECT doc_id, {norm('text')} AS text_norm FROM documents",
    "model_text": f"""WITH {AP} SELECT line_id, {norm('"DETAIL"')} AS detail_norm, {norm('"SUPPLIER"')} AS supplier_norm,
      {MODEL_TEXT} AS model_text FROM ap""",
    "novel_model_text": f"""SELECT p_partkey, p_name AS detail, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS supplier,
      round(p_retailprice, 6) AS net, 0.0::DOUBLE AS vat,
      'detail: ' || {norm('p_name')} || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' | supplier: ' || {norm('p_brand')} END AS model_text
      FROM part""",
    "example_excerpts": "SELECT doc_id, substr(text, 1, 100) || '...' AS excerpt FROM documents",
    "token_counts": f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct,
      md5(array_to_string(w, ' ')) AS token_digest FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)""",
    "line_ngrams": f"""WITH {AP}, lines AS (SELECT line_id, {MODEL_TEXT} AS model_text FROM ap),
      {grams('lines', 'model_text', 3)} SELECT term, count(*) AS n FROM grams GROUP BY term""",
    # labels
    "dataset_profile": f"""WITH {AP} SELECT 'rows' AS metric, count(*) AS value FROM ap
      UNION ALL SELECT 'classes_' || lower(field), count(DISTINCT label) FROM ({fields('ap')}) GROUP BY field""",
    "null_label_counts": f"""WITH {AP}, {GAPS} SELECT field, count(*) FILTER (WHERE label IS NULL) AS n_null FROM ({fields('gaps')}) GROUP BY field""",
    "label_vocab": f"WITH {AP}, {vocabulary('ap')} SELECT field, label, idx FROM vocab",
    "encoded_labels": f"""WITH {AP}, {GAPS}, {vocabulary('gaps')}
      SELECT line_id, coalesce(n.idx, -1) AS "NOMINAL_idx", coalesce(d.idx, -1) AS "DEPARTMENT_idx", coalesce(t.idx, -1) AS "TC_idx"
      FROM gaps LEFT JOIN vocab n ON n.field = 'NOMINAL' AND n.label = gaps."NOMINAL"
      LEFT JOIN vocab d ON d.field = 'DEPARTMENT' AND d.label = gaps."DEPARTMENT"
      LEFT JOIN vocab t ON t.field = 'TC' AND t.label = gaps."TC" """,
    "decoded_labels": f"""WITH {AP}, {vocabulary('ap')}
      SELECT ap."NOMINAL", ap."DEPARTMENT", ap."TC", coalesce(n2.label, 'UNKNOWN') AS n_label, coalesce(d2.label, 'UNKNOWN') AS d_label,
        coalesce(t2.label, 'UNKNOWN') AS t_label, count(*) AS n_lines
      FROM ap JOIN vocab n ON n.field = 'NOMINAL' AND n.label = ap."NOMINAL" JOIN vocab d ON d.field = 'DEPARTMENT' AND d.label = ap."DEPARTMENT"
      JOIN vocab t ON t.field = 'TC' AND t.label = ap."TC"
      LEFT JOIN vocab n2 ON n2.field = 'NOMINAL' AND n2.idx = n.idx + 1 LEFT JOIN vocab d2 ON d2.field = 'DEPARTMENT' AND d2.idx = d.idx + 1
      LEFT JOIN vocab t2 ON t2.field = 'TC' AND t2.idx = t.idx + 1
      GROUP BY ALL""",
    "class_weights": f"""WITH {DOCS} SELECT "NOMINAL" AS label, count(*) AS n,
      round((SELECT count(*) FROM docs) / ((SELECT count(DISTINCT "NOMINAL") FROM docs) * count(*)), 6) AS weight
      FROM docs GROUP BY "NOMINAL" """,
    "rare_classes": f"""WITH {DOCS} SELECT field, label, count(*) AS n FROM ({fields('docs')}) WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) < 100""",
    # TF-IDF
    "tfidf_vocab": f"""WITH {AP}, lines AS (SELECT line_id, {MODEL_TEXT} AS model_text FROM ap),
      {tfidf('lines', 'model_text', 2, 500, 2, '0.9', 'tf')} SELECT term, df, cf, idx, round(idf, 6) AS idf FROM terms""",
    "tfidf_weights": f"""WITH {DOCS}, {tfidf('docs', '"DETAIL"', 2, 5000, 1, '1.0', 'tf')}
      SELECT line_id, term, idx, weight FROM weights""",
    "tfidf_weights_sublinear": f"""WITH {DOCS}, {tfidf('docs', '"DETAIL"', 1, 2000, 2, '0.9', '1 + ln(tf)')}
      SELECT line_id, term, idx, weight FROM weights""",
    # splits
    "stratified_split": f"WITH {LINE_SPLIT} SELECT line_id, split, 'all_fields' AS level FROM sp",
    "stratified_split_fallback": f"WITH {FALLBACK} SELECT line_id, split, level FROM sp",
    "random_split": f"WITH {AP}, {split('ap', chr(39) + 'all' + chr(39))} SELECT line_id, split FROM sp",
    "split_sizes": f"WITH {LINE_SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split",
    "prepared_sides": f"""WITH {LINE_SPLIT} SELECT split AS side, "NOMINAL" AS nominal, "DEPARTMENT" AS department,
      "TC" AS tax_code, count(*) AS n FROM sp GROUP BY ALL""",
    "cv_folds": f"""WITH {DOCS}, r AS (SELECT line_id, "NOMINAL", count(*) OVER (PARTITION BY "NOMINAL") AS c,
      row_number() OVER (PARTITION BY "NOMINAL" ORDER BY md5('42|' || line_id) || '|' || line_id) AS r FROM docs)
      SELECT line_id, "NOMINAL", len(list_filter(range(1, 5), lambda i: (c * i) // 5 < r)) AS fold FROM r""",
    "group_split": """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id) || '|' || user_id) AS r
        FROM (SELECT DISTINCT user_id FROM events)), c AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS t FROM g)
      SELECT event_id, user_id, CASE WHEN r <= t THEN 'train' ELSE 'test' END AS split FROM events JOIN g USING (user_id), c""",
    # retrieval
    "knn_topk": f"WITH {KNN} {RETRIEVED}",
    "knn_blocks": f"WITH {KNN} {RETRIEVED}",
    "knn_search": f"""WITH {VEC_SPLIT}, {neighbours(TEST, TRAIN, 3)}
      SELECT query_id, rank, text, nominal, department, tax_code, round(similarity, 6) AS similarity FROM knn JOIN vecs USING (idx)""",
    "knn_small_index": f"""WITH {VECS}, rare AS (SELECT nominal FROM vecs GROUP BY nominal ORDER BY count(*), nominal LIMIT 1),
      small AS (SELECT * FROM vecs WHERE nominal IN (SELECT nominal FROM rare)), {neighbours('vecs', 'small', 1000)}
      SELECT query_id, count(*) AS n, max(rank) AS last_rank, round(max(distance), 6) AS farthest FROM knn GROUP BY query_id""",
    "knn_zero_vector": f"""WITH {VECS}, holed AS (
      SELECT * REPLACE (CASE WHEN idx % 50 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding END AS embedding) FROM vecs),
      {neighbours('holed', 'holed', 5)}
      SELECT query_id, idx, rank, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM knn""",
    "knn_accepted": f"WITH {KNN} SELECT * FROM ({RETRIEVED}) WHERE (query_id, idx) IN (SELECT (query_id, idx) FROM knn WHERE similarity >= 0.45)",
    "similarity_labels": f"WITH {KNN} SELECT query_id, idx, printf('%.2f', similarity) AS shown FROM knn",
    "few_shot_block": f"WITH {KNN} SELECT query_id, {text.FEW_SHOT} AS few_shot_examples FROM knn JOIN vecs USING (idx) GROUP BY query_id",
    "chat_prompt": f"WITH {KNN} {text.chat('vecs')}",
    "plain_prompt": f"WITH {KNN} {text.plain('vecs')}",
    "retrieval_vote": f"""WITH {VOTED} SELECT query_id, nominal, department, tax_code, round(nominal_confidence, 6) AS nominal_confidence,
      round(department_confidence, 6) AS department_confidence, round(tax_code_confidence, 6) AS tax_code_confidence,
      (SELECT count(*) FROM knn k WHERE k.query_id = voted.query_id) || ' similar lines, nearest: ' ||
      (SELECT text FROM knn k JOIN vecs USING (idx) WHERE k.query_id = voted.query_id AND rank = 1) AS reasoning FROM voted""",
    "retrieval_metrics": f"""WITH {VOTED}, {VOTE_PREDICTIONS}, {long('vote_pred')}, {report()}, {scored()}
      SELECT field, n, n_correct, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM scored""",
    "parse_json": f"WITH {PARSED} SELECT * FROM parsed",
    "parse_lines": f"""WITH {AP}, {RESPONSES} SELECT line_id, {_last('NOMINAL:')} AS nominal, {_last('DEPARTMENT:')} AS department,
      {_last('TC:')} AS tax_code FROM line_responses""",
    "fallback_labels": f"""WITH {PARSED} SELECT line_id, {", ".join(
        f'''CASE WHEN valid THEN {s} ELSE (SELECT min("{c}") FROM ap) END AS {s}'''
        for s, c in (("nominal", "NOMINAL"), ("department", "DEPARTMENT"), ("tax_code", "TC")))}, NOT valid AS failed FROM parsed""",
    "batch_infer": f"""WITH {AP} SELECT line_id, CASE WHEN f THEN '' ELSE w END AS nominal, CASE WHEN f THEN '' ELSE right("SUPPLIER", 1) END AS department,
      CASE WHEN f THEN '' ELSE "TC" END AS tax_code, CASE WHEN NOT f THEN 0.5::DOUBLE END AS nominal_confidence,
      CASE WHEN f THEN '' ELSE w END AS reasoning, f AS failed
      FROM (SELECT *, "TC" = 'T0' AS f, string_split("DETAIL", ' ')[1] AS w FROM ap)""",
    "batch_embed": "SELECT conv_id || '-' || turn AS line_id, " + ", ".join(
        f"CAST(len(lower(text)) - len(replace(lower(text), '{c}', '')) AS DOUBLE) AS {c}" for c in "aeiou"
    ) + ", NULL::VARCHAR AS embed_error FROM conversations",
    "hashed_vectors": f"SELECT doc_id, pos, round(value, 6) AS value FROM ({hashed('documents', 'doc_id', 'text', 384)})",
    "novel_items": f"""WITH {_NOVEL}, {_PER_FIELD}, {_CHOSEN}
      SELECT query_id AS line_id, nominal, department, tax_code, round(nominal_confidence, 6) AS nominal_confidence,
        round(department_confidence, 6) AS department_confidence, round(tax_code_confidence, 6) AS tax_code_confidence,
        (SELECT string_agg(idx, ',' ORDER BY rank) FROM knn k WHERE k.query_id = voted.query_id) AS neighbours FROM voted""",
    # metrics
    "field_metrics": f"WITH {SCORED} SELECT field, n, n_correct, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM scored",
    "average_f1": f"WITH {SCORED} SELECT round(avg(f1_macro), 6) AS f1_macro, round(avg(accuracy), 6) AS accuracy FROM scored",
    "class_report": f"""WITH {SCORED} SELECT field, label, tp, fp, fn, tp + fn AS support, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report""",
    "sample_f1": f"WITH {PREDICTIONS} SELECT round(avg((3 - ({N_WRONG})) / 3), 6) AS sample_wise_f1, count(*) AS n FROM pred",
    "error_rate": f"""WITH {PREDICTIONS} SELECT count(*) AS n, count(*) FILTER (WHERE ({N_WRONG}) > 0) AS n_errors,
      round(count(*) FILTER (WHERE ({N_WRONG}) > 0) / count(*), 6) AS error_rate FROM pred""",
    "metrics_with_gaps": f"""WITH {PREDICTIONS}, holes AS (SELECT * REPLACE (
        CASE WHEN substr(md5(line_id), 32, 1) <> '0' THEN true_nominal END AS true_nominal,
        CASE WHEN substr(md5(line_id), 32, 1) <> '1' THEN pred_nominal END AS pred_nominal) FROM pred),
      {long('holes')}, {report()}, {scored()}
      SELECT field, n, n_correct, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM scored""",
    "confusion_topk": f"""WITH {PREDICTIONS}, {long()} SELECT field, t AS "true", p AS pred, n, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, t, p) AS rank
        FROM (SELECT field, t, p, count(*) AS n FROM long WHERE t <> p GROUP BY ALL)) WHERE rank <= 3""",
    "error_report": f"""WITH {PREDICTIONS} SELECT detail, supplier, true_nominal, pred_nominal, true_department, pred_department,
      true_tc, pred_tc FROM pred WHERE ({N_WRONG}) > 0""",
    "error_field_shares": f"""WITH {PREDICTIONS}, {long()}, e AS (SELECT count(*) AS total FROM pred WHERE ({N_WRONG}) > 0)
      SELECT field, count(*) FILTER (WHERE t <> p) AS n_wrong, any_value(total) AS n_error_rows, round(count(*) FILTER (WHERE t <> p) / any_value(total), 6) AS share
      FROM long, e GROUP BY field""",
    "wrong_field_histogram": f"WITH {PREDICTIONS} SELECT CAST({N_WRONG} AS BIGINT) AS n_wrong, count(*) AS n_rows FROM pred WHERE ({N_WRONG}) > 0 GROUP BY 1",
    "supplier_errors": f"""WITH {PREDICTIONS}, {long().replace('SELECT', 'SELECT supplier, line_id,')},
      wrong AS (SELECT * FROM long WHERE NOT coalesce(t = p, false)),
      pairs AS (SELECT supplier, field, t, p, count(*) AS n FROM wrong GROUP BY ALL)
      SELECT supplier, any_value(rows) AS n_error_rows, CAST(sum(n) AS BIGINT) AS n_wrong_labels, count(*) AS n_confusions,
        string_agg(concat_ws(':', field, t, p, n), ';' ORDER BY field, t, p) AS confusions
      FROM pairs JOIN (SELECT supplier, count(DISTINCT line_id) AS rows FROM wrong GROUP BY supplier) USING (supplier) GROUP BY supplier""",
    "majority_collapse": f"""WITH {SCORED}, m AS (SELECT CASE field WHEN 'NOMINAL' THEN 'nominal' WHEN 'DEPARTMENT' THEN 'department' ELSE 'tc' END AS field,
        label AS majority_label FROM overall),
      e AS (SELECT m.field, majority_label, count(t) + count(*) FILTER (WHERE t IS NULL AND w.field IS NOT NULL) AS n_errors,
                   count(*) FILTER (WHERE p = majority_label) AS n_to_majority
        FROM m LEFT JOIN (SELECT * FROM long WHERE NOT coalesce(t = p, false)) w ON w.field = m.field GROUP BY ALL)
      SELECT e.field, majority_label, n_errors, n_to_majority, round(CASE WHEN n_errors = 0 THEN 0.0 ELSE n_to_majority / n_errors END, 6) AS share_to_majority,
        coalesce(n_classes, 0) AS n_classes, coalesce(n_zero_f1, 0) AS n_zero_f1
      FROM e LEFT JOIN (SELECT field, count(*) AS n_classes, count(*) FILTER (WHERE f1 = 0) AS n_zero_f1 FROM report GROUP BY field) r ON r.field = e.field""",
    # comparing runs
    "leaderboard": f"""WITH {RESULTS} SELECT experiment, method, is_baseline, run_order, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy,
      round(sample_wise_f1, 6) AS sample_wise_f1, row_number() OVER (ORDER BY f1_macro DESC, run_order) AS rank, f1_macro >= 0.7 AS passed,
      round(f1_macro - 0.7, 6) AS margin, row_number() OVER (ORDER BY f1_macro DESC, run_order) = 1 AS winner FROM methods""",
    "target_check": f"WITH {RESULTS} SELECT method, round(f1_macro, 6) AS f1_macro, f1_macro >= 0.15 AS passed, round(f1_macro - 0.15, 6) AS margin FROM methods",
    "improvement": f"""WITH {RESULTS}, b AS (SELECT field, f1_macro AS baseline_f1 FROM results WHERE method = 'majority'),
      t AS (SELECT field, f1_macro AS tuned_f1 FROM results WHERE method = 'supplier_mode')
      SELECT field, round(baseline_f1, 6) AS baseline_f1, round(tuned_f1, 6) AS tuned_f1, round(tuned_f1 - baseline_f1, 6) AS change,
        round(CASE WHEN baseline_f1 = 0 THEN 0 ELSE (tuned_f1 - baseline_f1) * 100 / baseline_f1 END, 6) AS percent_change,
        CASE WHEN tuned_f1 > baseline_f1 THEN 'supplier_mode' ELSE 'majority' END AS kept FROM b JOIN t USING (field)""",
    "best_method": f"WITH {RESULTS} SELECT method, round(f1_macro, 6) AS f1_macro FROM methods ORDER BY methods.f1_macro DESC, run_order LIMIT 1",
    "winner_fields": f"""WITH {RESULTS}, w AS (SELECT method FROM methods ORDER BY f1_macro DESC, run_order LIMIT 1)
      SELECT experiment, method, field, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy FROM results WHERE method IN (SELECT method FROM w)""",
    "union_results": f"WITH {RESULTS} SELECT method, round(f1_macro, 6) AS f1_macro FROM methods",
    # later additions
    "stratified_split_random": f"WITH {AP}, {split('ap', chr(39) + 'all' + chr(39))} SELECT line_id, split, 'random' AS level FROM sp",
    "group_split_with_gaps": """WITH ev AS (SELECT event_id, CASE WHEN user_id % 10 <> 3 THEN user_id::VARCHAR END AS user_id FROM events),
      g AS (SELECT u, row_number() OVER (ORDER BY md5('42|' || u) || '|' || u) AS r FROM (SELECT DISTINCT coalesce(user_id, 'nan') AS u FROM ev)),
      c AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS t FROM g)
      SELECT event_id, user_id, CASE WHEN r <= t THEN 'train' ELSE 'test' END AS split FROM ev JOIN g ON u = coalesce(user_id, 'nan'), c""",
    "knn_empty_index": f"WITH {VEC_SPLIT} SELECT idx AS query_id, 0::BIGINT AS broadcast, 0::BIGINT AS blocks FROM {TEST}",
    "knn_empty_queries": f"WITH {VEC_SPLIT} SELECT idx, 0::BIGINT AS broadcast, 0::BIGINT AS blocks FROM {TRAIN}",
    "knn_tenant": f"""WITH {VEC_SPLIT}, q AS (SELECT *, sqrt(list_inner_product(embedding, embedding)) AS norm FROM {TEST}),
      i AS (SELECT *, sqrt(list_inner_product(embedding, embedding)) AS norm FROM {TRAIN}),
      d AS (SELECT q.idx AS query_id, i.idx AS idx, round(1 - list_inner_product(q.embedding, i.embedding) / (q.norm * i.norm), 9) AS distance
            FROM q JOIN i ON q.idx % 4 = i.idx % 4)
      SELECT query_id, idx, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS rank FROM d) WHERE rank <= 3""",
    "retrieval_with_floor": f"""WITH {VEC_SPLIT}, {neighbours(TEST, TRAIN, 5, 'every_knn')}, knn AS (SELECT * FROM every_knn WHERE similarity >= 0.6), {_BALLOT}
      SELECT s.line_id, s.nominal AS true_nominal, coalesce(v.nominal, '') AS pred_nominal, s.department AS true_department,
        coalesce(v.department, '') AS pred_department, s.tax_code AS true_tc, coalesce(v.tax_code, '') AS pred_tc, v.query_id IS NULL AS failed
      FROM {TEST} s LEFT JOIN voted v ON v.query_id = s.idx""",
    "retrieval_with_scorer": f"""WITH {KNN} SELECT s.line_id, n.nominal AS pred_nominal, n.department AS pred_department, n.tax_code AS pred_tc,
        'first' AS reasoning, false AS failed, NULL::VARCHAR AS error, 0.5::DOUBLE AS nominal_confidence
      FROM knn JOIN vecs n USING (idx) JOIN sp s ON s.idx = query_id WHERE rank = 1""",
    "plain_batch": f"""WITH {KNN} SELECT s.line_id, n.nominal AS pred_nominal, (SELECT min(department) FROM vecs) AS pred_department, n.tax_code AS pred_tc,
        false AS failed FROM knn JOIN vecs n USING (idx) JOIN sp s ON s.idx = query_id WHERE rank = 1""",
    "error_report_extended": f"""WITH {VOTED} SELECT s.text AS detail, 'none' AS supplier, s.nominal AS true_nominal, v.nominal AS pred_nominal,
        s.department AS true_department, v.department AS pred_department, s.tax_code AS true_tc, v.tax_code AS pred_tc,
        round(v.nominal_confidence, 6) AS nominal_confidence,
        (SELECT count(*) FROM knn k WHERE k.query_id = v.query_id) || ' similar lines, nearest: ' ||
        (SELECT text FROM knn k JOIN vecs USING (idx) WHERE k.query_id = v.query_id AND rank = 1) AS reasoning
      FROM sp s JOIN voted v ON v.query_id = s.idx WHERE s.nominal <> v.nominal OR s.department <> v.department OR s.tax_code <> v.tax_code""",
    "review_routing": f"""WITH {VOTED} SELECT query_id, round(least(nominal_confidence, department_confidence, tax_code_confidence), 6) AS least_confidence,
        least(nominal_confidence, department_confidence, tax_code_confidence) < 0.7 AS review FROM voted""",
    "review_cascade": f"""WITH {VOTED}, v1 AS (SELECT *, least(nominal_confidence, department_confidence, tax_code_confidence) AS low FROM voted),
      again AS (SELECT * FROM (WITH {VEC_SPLIT}, {neighbours(TEST, TRAIN, 15)}, {_BALLOT} SELECT * FROM voted)),
      v2 AS (SELECT *, least(nominal_confidence, department_confidence, tax_code_confidence) AS low FROM again)
      SELECT CAST(v1.query_id AS VARCHAR) AS line_id, CASE WHEN v1.low >= 0.7 THEN v1.nominal ELSE v2.nominal END AS nominal,
        CASE WHEN v1.low >= 0.7 THEN v1.department ELSE v2.department END AS department,
        CASE WHEN v1.low >= 0.7 THEN v1.tax_code ELSE v2.tax_code END AS tax_code,
        CASE WHEN v1.low >= 0.7 THEN 'first' WHEN v2.low < 0.7 THEN 'review' ELSE 'second' END AS stage
      FROM v1 JOIN v2 USING (query_id)""",
    "corrected_index": f"""WITH {VEC_SPLIT} SELECT idx, CASE WHEN idx % 14 = 0 THEN 'NY' WHEN idx % 7 = 0 THEN 'NX' ELSE nominal END AS nominal,
        CASE WHEN idx % 7 = 0 AND idx % 2 <> 0 THEN 'DX' ELSE department END AS department,
        CASE WHEN idx % 7 = 0 AND idx % 2 <> 0 THEN 'TX' ELSE tax_code END AS tax_code FROM {TRAIN}""",
    "confidence_drift": """WITH e AS (SELECT epoch_ms(CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800000) AS w, (event_id % 11) / 10.0 AS c FROM events),
      d AS (SELECT w, count(*) AS n, avg(c) AS mean_confidence, avg((c < 0.7)::INT) AS unsure_share FROM e GROUP BY w)
      SELECT strftime(w, '%Y-%m-%d') AS window_start, n, round(mean_confidence, 6) AS mean_confidence, round(unsure_share, 6) AS unsure_share,
        coalesce(unsure_share - lag(unsure_share) OVER (ORDER BY w) > 0.1, false) AS alert FROM d""",
    "prediction_versions": f"WITH {VOTED} SELECT query_id, nominal, 'vote-1' AS model_version, 'few-shot-1' AS prompt_version FROM voted",
    "integer_labels": """SELECT ([1, 2, 10, 20, 3, 11, 100, 12, 4, 30])[label % 10 + 1]::BIGINT AS code, count(*) AS n, true AS mostly_right
      FROM embeddings WHERE vec_id % 5 = 0 GROUP BY ALL""",
    "tfidf_lr": f"""WITH {_KNOWN_SPLIT} SELECT line_id, "NOMINAL" AS true_nominal, "DEPARTMENT" AS true_department, "TC" AS true_tc, {_HOLDS}
      FROM sp WHERE split = 'test'""",
    "predict_proba": f"""WITH {_KNOWN_SPLIT}, k AS (SELECT field, count(DISTINCT label) AS n_labels FROM ({fields("(SELECT * FROM sp WHERE split = 'train')")}) GROUP BY field)
      SELECT line_id, field, n_labels, 1.0::DOUBLE AS total FROM sp, k WHERE split = 'test'""",
    "embed_lr_multi": f"WITH {VEC_SPLIT} SELECT line_id, nominal AS true_nominal, department AS true_department, tax_code AS true_tc, {_HOLDS} FROM {TEST}",
    "embed_rf_multi": f"WITH {VEC_SPLIT} SELECT line_id, nominal AS true_nominal, department AS true_department, tax_code AS true_tc, {_HOLDS} FROM {TEST}",
    "grid_search_small": f"""WITH {_KNOWN_SPLIT}, r AS (
        SELECT "NOMINAL" AS label, count(*) OVER w AS c, row_number() OVER (w ORDER BY md5('42|' || line_id) || '|' || line_id) AS r
        FROM sp WHERE split = 'train' WINDOW w AS (PARTITION BY "NOMINAL")),
      f AS (SELECT label, (r > c // 3 + (c % 3) // 3)::BIGINT + (r > c // 3 * 2 + (c % 3) * 2 // 3)::BIGINT AS fold FROM r)
      SELECT max_features, 1.0::DOUBLE AS c, fold, label, count(*) AS n_held_out, true AS score_agrees, true AS best_is_top
      FROM f, (SELECT unnest([300, 600])::BIGINT AS max_features) GROUP BY ALL""",
    "random_search_small": f"""WITH {VEC_SPLIT}, {_FOLDS},
      l AS (SELECT fold, 'NOMINAL' AS field, nominal AS label FROM f UNION ALL SELECT fold, 'DEPARTMENT', department FROM f UNION ALL SELECT fold, 'TC', tax_code FROM f)
      SELECT c AS classifier, d::BIGINT AS draw, fold, field, count(*) AS n_held_out, count(DISTINCT label) AS n_labels, true AS score_agrees, true AS best_is_top
      FROM l, (SELECT unnest(['logistic_regression', 'random_forest']) AS c), (SELECT unnest([0, 1]) AS d) GROUP BY ALL""",
    "search_draws": f"""WITH {VEC_SPLIT}, {_FOLDS}
      SELECT kind AS classifier, d::BIGINT AS draw, true AS in_space, fold, (SELECT count(*) FROM f) - count(*) AS n_fitted
      FROM f, (SELECT unnest(['logistic_regression', 'random_forest']) AS kind), (SELECT unnest(range(20)) AS d) GROUP BY ALL""",
}

from checks.oracle_more import MORE  # noqa: E402  made of the fragments above

ORACLE |= MORE
