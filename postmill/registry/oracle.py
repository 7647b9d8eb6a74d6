"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Each statement is put together from named common table expressions; only those
a query refers to are included.
"""

from __future__ import annotations

import re

from postmill.functions.text import NON_WORD, STRIP_CLASS, STRIP_CLASS_NO_NEWLINE


def _normal(value: str) -> str:
    text = f"coalesce({value}, '')"
    text = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    text = rf"regexp_replace({text}, '[ \t\x{{0c}}\x{{0b}}]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?m)^[{STRIP_CLASS_NO_NEWLINE}]+|[{STRIP_CLASS_NO_NEWLINE}]+$', '', 'g')"
    text = rf"regexp_replace({text}, '\A[{STRIP_CLASS}]+|[{STRIP_CLASS}]+\z', '', 'g')"
    return rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _metrics(keys: str = "") -> str:
    """Select list of the metric record over rows with label, pred_label and score_ai."""
    tn, fp = "count(*) FILTER (label = 0 AND pred_label = 0)", "count(*) FILTER (label = 0 AND pred_label = 1)"
    fn, tp = "count(*) FILTER (label = 1 AND pred_label = 0)", "count(*) FILTER (label = 1 AND pred_label = 1)"
    return f"""{keys} count(*) AS rows, {tn} AS tn, {fp} AS fp, {fn} AS fn, {tp} AS tp,
      avg(-ln(least(greatest(CASE WHEN label = 1 THEN score_ai ELSE 1 - score_ai END,
          2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0)"


_PH, _RH = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp")
_PA, _RA = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
_FH, _FA = _ratio("2 * tn", "2 * tn + fp + fn"), _ratio("2 * tp", "2 * tp + fp + fn")
_ACC = _ratio("tn + tp", "tn + fp + fn + tp")


def _weighted(human: str, ai: str) -> str:
    return _ratio(f"{human} * (tn + fp) + {ai} * (fn + tp)", "tn + fp + fn + tp")


_RECORD = {
    "accuracy": _ACC,
    "balanced_accuracy": f"CASE WHEN tn + fp > 0 AND fn + tp > 0 THEN ({_RH} + {_RA}) / 2 "
    f"WHEN fn + tp > 0 THEN {_RA} ELSE {_RH} END",
    "precision_human": _PH,
    "recall_human": _RH,
    "f1_human": _FH,
    "precision_ai": _PA,
    "recall_ai": _RA,
    "f1_ai": _FA,
    "macro_precision": f"({_PH} + {_PA}) / 2",
    "macro_recall": f"({_RH} + {_RA}) / 2",
    "macro_f1": f"({_FH} + {_FA}) / 2",
    "weighted_f1": _weighted(_FH, _FA),
    "log_loss": "log_loss",
    "auroc": "auroc",
    "average_precision": "average_precision",
}
_RECORD_SQL = ", ".join(f"round({value}, 6) AS {name}" for name, value in _RECORD.items())
_SUPPORT = "tn + fp AS support_human, fn + tp AS support_ai, 0.5::DOUBLE AS threshold"


def _interval(bound: str, k: str = "tp", n: str = "(fn + tp)") -> str:
    z2 = "3.8416"
    middle = f"({k}::DOUBLE / {n} + {z2} / (2 * {n}))"
    spread = f"1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + {z2} / (4 * {n}::DOUBLE * {n}))"
    scale = f"(1 + {z2} / {n})"
    value = (
        f"greatest(0.0::DOUBLE, ({middle} - {spread}) / {scale})"
        if bound == "low"
        else f"least(1.0::DOUBLE, ({middle} + {spread}) / {scale})"
    )
    return f"round(CASE WHEN {n} > 0 THEN {value} ELSE 0 END, 6)"


_INTERVALS = f"{_interval('low')} AS recall_ai_low, {_interval('high')} AS recall_ai_high"

_JSON_BODY = "json_object('note_title', note_title, "
_SPLIT_PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))

CTES = {
    "base": """SELECT doc_id + c * 40040000 AS doc_id, CASE c WHEN 2 THEN '' WHEN 1 THEN text || '!!😊' ELSE text END AS text,
      lang, source, CASE c WHEN 2 THEN 0 ELSE n_chars + c * 3 END AS n_chars, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS label
      FROM (SELECT *, unnest(CASE WHEN doc_id % 17 = 3 THEN [0, 1] WHEN doc_id % 77 = 0 THEN [0, 2] ELSE [0] END) AS c FROM documents)""",
    "posts": """SELECT doc_id,
      CASE WHEN doc_id % 11 = 0 THEN text WHEN label = 0 AND doc_id % 7 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS note_title,
      CASE WHEN doc_id % 11 = 0 THEN NULL
           WHEN doc_id % 5 = 0 THEN chr(9) || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10)) || '  '
           ELSE text END AS note_content,
      label, CASE WHEN label = 1 THEN 'aigc' ELSE 'human' END AS source_file, doc_id AS source_line,
      CASE WHEN label = 0 THEN 'n' || doc_id::VARCHAR END AS note_id,
      CASE WHEN label = 0 THEN n_chars END AS likes, lang AS domain, source,
      CASE WHEN label = 1 THEN 'fam' || ((doc_id // 8) % 6)::VARCHAR END AS model_family,
      CASE WHEN label = 1 THEN 'fam' || ((doc_id // 8) % 6)::VARCHAR || '-' || ((doc_id // 48) % 3)::VARCHAR END AS model,
      ((doc_id * 7919) % 701 + 300 * label) / 1000.0::DOUBLE AS score_ai
      FROM base""",
    "normal": f"""SELECT * REPLACE ({_normal('note_title')} AS note_title, {_normal('note_content')} AS note_content)
      FROM posts""",
    "templated": """SELECT *, CASE WHEN note_title <> '' AND note_content <> ''
           THEN '标题：' || note_title || chr(10) || '正文：' || note_content
           WHEN note_content <> '' THEN '正文：' || note_content
           WHEN note_title <> '' THEN '标题：' || note_title ELSE '' END AS text,
      note_title <> '' AND note_content = '' AS title_only FROM normal""",
    "cleaned": """SELECT *, length(text)::INTEGER AS text_len_chars,
      CASE WHEN label = 1 THEN 'ai_' ELSE 'human_' END || sha1(label::VARCHAR || chr(10) || text)[1:16] AS id
      FROM templated WHERE text <> ''""",
    "conflict_texts": "SELECT text FROM cleaned GROUP BY text HAVING min(label) <> max(label)",
    "deduped": """SELECT * FROM cleaned WHERE text NOT IN (SELECT text FROM conflict_texts)
      QUALIFY row_number() OVER (PARTITION BY label, text ORDER BY source_file, source_line) = 1""",
    "groups": """SELECT text, count(*) AS copies, count(*) FILTER (label = 0) AS human_rows,
      count(*) FILTER (label = 1) AS ai_rows FROM cleaned GROUP BY text HAVING count(*) > 1""",
    "stratum_min": "SELECT min(n) AS n FROM (SELECT count(*) AS n FROM deduped GROUP BY label, domain)",
    "strata": """SELECT id, label, CASE WHEN (SELECT n FROM stratum_min) >= 4
      THEN label::VARCHAR || '__' || coalesce(domain, '<missing>') ELSE label::VARCHAR END AS stratum FROM deduped""",
    "quota1": """SELECT stratum, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= stay - sum(whole) OVER ()
        THEN 1 ELSE 0 END AS take
      FROM (SELECT stratum, stay, floor(exact) AS whole, exact - floor(exact) AS rest FROM (
        SELECT stratum, total - ceil(0.3::DOUBLE * total) AS stay,
          n::DOUBLE / total * (total - ceil(0.3::DOUBLE * total)) AS exact
        FROM (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM strata GROUP BY stratum)))""",
    "held": """SELECT s.id, s.label, s.stratum FROM strata s JOIN quota1 q USING (stratum)
      QUALIFY row_number() OVER (PARTITION BY s.stratum ORDER BY sha1('42:' || s.id)) > any_value(q.take) OVER (PARTITION BY s.stratum)""",
    "held2": """SELECT id, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM held GROUP BY stratum)) < 2
      THEN label::VARCHAR ELSE stratum END AS stratum FROM held""",
    "quota2": """SELECT stratum, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= stay - sum(whole) OVER ()
        THEN 1 ELSE 0 END AS take
      FROM (SELECT stratum, stay, floor(exact) AS whole, exact - floor(exact) AS rest FROM (
        SELECT stratum, total - ceil(0.5::DOUBLE * total) AS stay,
          n::DOUBLE / total * (total - ceil(0.5::DOUBLE * total)) AS exact
        FROM (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM held2 GROUP BY stratum)))""",
    "held_split": """SELECT h.id, CASE WHEN row_number() OVER (PARTITION BY h.stratum ORDER BY sha1('42:' || h.id)) <= q.take
      THEN 'val' ELSE 'test' END AS split FROM held2 h JOIN quota2 q USING (stratum)""",
    "split_rows": """SELECT d.*, coalesce(h.split, 'train') AS split FROM deduped d LEFT JOIN held_split h USING (id)""",
    "predicted": "SELECT *, CASE WHEN score_ai >= 0.5 THEN 1 ELSE 0 END AS pred_label FROM split_rows",
    "scored": "SELECT *, CASE WHEN score_ai >= 0.5 THEN 1 ELSE 0 END AS pred_label FROM deduped",
    "lengths": "SELECT text_len_chars AS v, row_number() OVER (ORDER BY text_len_chars) - 1 AS i, count(*) OVER () AS n FROM deduped",
}


def _edges_cte(rows: str) -> str:
    """Tertile edges: numpy's two-sided interpolation between order statistics."""
    parts = []
    for name, fraction in (("lower", "0.33333333333333326"), ("upper", "0.6666666666666665")):
        place = f"({fraction}::DOUBLE * (n - 1))"
        share = f"max({place} - floor({place}))"
        left = f"max(v) FILTER (i = floor({place}))::DOUBLE"
        right = f"max(v) FILTER (i = least(floor({place}) + 1, n - 1))::DOUBLE"
        parts.append(
            f"CASE WHEN {share} < 0.5 THEN {left} + ({right} - {left}) * {share} "
            f"ELSE {right} - ({right} - {left}) * (1 - {share}) END AS {name}"
        )
    return f"SELECT min(v)::DOUBLE AS smallest, {', '.join(parts)}, max(v)::DOUBLE AS largest FROM {rows}"


CTES["edges"] = _edges_cte("lengths")
CTES["bucketed"] = """SELECT s.*, CASE WHEN text_len_chars <= first THEN 'short' WHEN text_len_chars <= second THEN 'medium' ELSE 'long' END
  AS length_bucket FROM scored s, (SELECT
    CASE WHEN smallest < lower AND lower < upper AND upper < largest THEN lower
         WHEN smallest = largest THEN smallest - 1 ELSE (largest - smallest) / 3 + smallest END AS first,
    CASE WHEN smallest < lower AND lower < upper AND upper < largest THEN upper
         ELSE 2 * ((largest - smallest) / 3) + smallest END AS second FROM edges)"""


def _steps(rows: str, keys: str = "", where: str = "TRUE") -> str:
    """Distinct scores with the cumulated classes, highest score first."""
    part = f"PARTITION BY {keys}" if keys else ""
    comma = f"{keys}, " if keys else ""
    return f"""SELECT {comma}score_ai, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n,
      sum(count(*) FILTER (label = 1)) OVER ({part} ORDER BY score_ai DESC) AS tp,
      sum(count(*) FILTER (label = 0)) OVER ({part} ORDER BY score_ai DESC) AS fp
      FROM {rows} WHERE {where} GROUP BY {comma}score_ai"""


_RANKS = """CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) END AS auroc,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp::DOUBLE / (tp + fp)) / sum(p) END AS average_precision"""


def _subgroup(rows: str, key: str, where: str = "TRUE", having: str = "TRUE") -> str:
    return f"""SELECT {key}, rows, {_RECORD_SQL}, {_SUPPORT}, {_INTERVALS} FROM
      (SELECT {_metrics(key + ',')} FROM {rows} WHERE {where} GROUP BY {key} HAVING {having})
      JOIN (SELECT {key}, {_RANKS} FROM ({_steps(rows, key, where)}) GROUP BY {key}) USING ({key})"""


def _record(rows: str, keys: str = "") -> str:
    """Un-rounded record rows with counts and rank metrics."""
    if keys:
        return f"""SELECT * FROM (SELECT {_metrics(keys + ',')} FROM {rows} GROUP BY {keys})
          JOIN (SELECT {keys}, {_RANKS} FROM ({_steps(rows, keys)}) GROUP BY {keys}) USING ({keys})"""
    return f"""SELECT * FROM (SELECT {_metrics()} FROM {rows}), (SELECT {_RANKS} FROM ({_steps(rows)}))"""


def _fold_rows(step: float) -> str:
    """Test rows per fold, with the score lowered by ``step``."""
    return f"""SELECT f.fold, label, greatest(0.0::DOUBLE, score_ai - {step}::DOUBLE) AS score_ai,
      CASE WHEN greatest(0.0::DOUBLE, score_ai - {step}::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS pred_label
      FROM split_rows, fams f WHERE split = 'test' AND (label = 0 OR model_family = f.fold)"""


def _summary(rows: str, sizes: str, mode: str) -> str:
    return f"""SELECT fold AS held_out_family, ai_rows AS train_ai_rows, tn + fp AS test_human_rows, fn + tp AS test_ai_rows,
      {_RA} AS recall_ai_{mode}, auroc, fp AS false_positives_human, fn AS missed_ai_posts
      FROM ({_record(rows, 'fold')}) JOIN (SELECT fold, ai_rows FROM {sizes} WHERE split = 'train') USING (fold)"""


CTES |= {
    "fams": "SELECT DISTINCT model_family AS fold FROM split_rows WHERE label = 1 AND model_family IS NOT NULL",
    "holdout_rows": """SELECT f.fold, s.split, s.id, s.label, s.model_family FROM split_rows s, fams f
      WHERE s.label = 0 OR CASE WHEN s.split = 'test' THEN s.model_family IS NOT DISTINCT FROM f.fold
                                ELSE s.model_family IS DISTINCT FROM f.fold END""",
    "holdout_sizes": """SELECT fold, split, count(*) FILTER (label = 0) AS human_rows, count(*) FILTER (label = 1) AS ai_rows
      FROM holdout_rows GROUP BY fold, split""",
    "ai_places": """SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha1('42:' || id)) AS place
      FROM split_rows WHERE label = 1""",
    "drops": """SELECT model_family AS fold, split, count(*) AS k FROM split_rows WHERE label = 1 GROUP BY ALL""",
    "control_rows": """SELECT f.fold, a.split, a.model_family, a.id FROM ai_places a CROSS JOIN fams f
      LEFT JOIN drops d ON d.fold = f.fold AND d.split = a.split
      WHERE CASE WHEN a.split = 'test' THEN a.model_family = f.fold ELSE a.place > coalesce(d.k, 0) END""",
    "control_sizes": "SELECT fold, split, count(*) AS ai_rows FROM control_rows GROUP BY fold, split",
    "rows_plain": _fold_rows(0.0),
    "rows_unseen": _fold_rows(0.2),
    "rows_matched": _fold_rows(0.05),
    "sum_plain": _summary("rows_plain", "holdout_sizes", "holdout"),
    "sum_unseen": _summary("rows_unseen", "holdout_sizes", "holdout"),
    "sum_matched": _summary("rows_matched", "control_sizes", "control"),
    "seen": f"""SELECT model_family AS held_out_family, {_RA} AS recall_seen FROM
      (SELECT {_metrics('model_family,')} FROM predicted WHERE split = 'test' AND label = 1 GROUP BY model_family)""",
    # JSON lines: the same variants as on the Spark side, read back with DuckDB's parser.
    "json_good": f"""SELECT *, CASE doc_id % 3
        WHEN 0 THEN {_JSON_BODY} 'note_content', note_content, 'likes', likes, 'domain', domain)
        WHEN 1 THEN {_JSON_BODY} 'desc', note_content, 'liked_count', likes, 'domain', domain, 'model_family', model_family)
        ELSE {_JSON_BODY} 'note_content', note_content, 'desc', 'unused', 'collected_count', likes, 'model', model) END::VARCHAR AS good
      FROM posts""",
    "json_lines": f"""SELECT label, source_file, source_line, CASE
        WHEN doc_id % 97 = 0 THEN left(good, length(good) - 1)
        WHEN doc_id % 89 = 0 THEN json_object('note_content', note_content, 'likes', likes, 'domain', domain)::VARCHAR
        WHEN doc_id % 83 = 0 THEN {_JSON_BODY} 'likes', likes, 'domain', domain)::VARCHAR
        WHEN doc_id % 79 = 0 THEN good || 'x'
        WHEN doc_id % 73 = 0 THEN '[' || good || ']'
        WHEN doc_id % 71 = 0 THEN ' ' || chr(9)
        ELSE good END AS value FROM json_good""",
    "json_checked": """SELECT *, CASE WHEN NOT json_valid(value) THEN 'malformed' WHEN json_type(value) <> 'OBJECT' THEN 'malformed'
        WHEN NOT list_contains(json_keys(value), 'note_title') THEN 'missing'
        WHEN NOT list_has_any(json_keys(value), ['note_content', 'desc']) THEN 'missing' END AS kind,
      CASE WHEN json_valid(value) THEN json_keys(value) ELSE [] END AS keys,
      CASE WHEN json_valid(value) THEN value ELSE '{}' END AS safe
      FROM json_lines WHERE trim(value, ' ' || chr(9)) <> ''""",
    # Characters of the analysed documents, for n-grams.
    "analysed": f"SELECT doc_id, regexp_replace(lower(text), '[{STRIP_CLASS}]{{2,}}', ' ', 'g') AS t FROM documents",
    "chars": "SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS pos FROM analysed WHERE t <> ''",
    "windows": """SELECT doc_id, c AS g1, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3,
      lead(c, 4) OVER w AS c4 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "grams": """SELECT doc_id, gram, n, count(*) AS tf FROM (
      SELECT doc_id, 2 AS n, g1 || c1 AS gram FROM windows UNION ALL SELECT doc_id, 3, g1 || c1 || c2 FROM windows
      UNION ALL SELECT doc_id, 4, g1 || c1 || c2 || c3 FROM windows
      UNION ALL SELECT doc_id, 5, g1 || c1 || c2 || c3 || c4 FROM windows) WHERE gram IS NOT NULL GROUP BY ALL""",
    "docs_n": "SELECT count(*) AS n FROM documents",
    "kept_grams": """SELECT gram, count(*) AS df, sum(tf)::BIGINT AS cf FROM grams GROUP BY gram
      HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT n FROM docs_n) ORDER BY cf DESC, gram LIMIT 300000""",
    "raw_weights": """SELECT g.doc_id, (1 + ln(g.tf)) * (ln((1 + (SELECT n FROM docs_n))::DOUBLE / (1 + k.df)) + 1) AS w
      FROM grams g JOIN kept_grams k USING (gram)""",
}


def _shared(suffix: str) -> str:
    return ", ".join(
        f"count(*) FILTER ({a}_rows > 0 AND {b}_rows > 0) AS {a}_{b}_shared_{suffix}" for a, b in _SPLIT_PAIRS
    )


_FOLD = f"replace(replace(lower(regexp_replace(text, '{NON_WORD}', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"
_SPLIT_COUNTS = ", ".join(f"count(*) FILTER (split = '{name}') AS {name}_rows" for name in ("train", "val", "test"))
_CROSSING = " OR ".join(f"({a}_rows > 0 AND {b}_rows > 0)" for a, b in _SPLIT_PAIRS)
_OVERLAPS = f"SELECT {_shared('texts')} FROM (SELECT text, {_SPLIT_COUNTS} FROM split_rows GROUP BY text)"
_PREDICTION = "id, split, label, pred_label, score_ai, text_len_chars, domain, model_family, model, text"

_AUDIT_COLUMNS = [
    "note_title", "note_content", "label", "source_file", "source_line", "note_id", "likes", "domain",
    "model_family", "model", "text", "title_only", "text_len_chars", "id",
]


def _audit() -> str:
    def row(section: str, select: str) -> str:
        return f"SELECT '{section}' AS section, {select}"

    def rows_of(section: str, key: str, where: str = "TRUE") -> str:
        return row(section, f"coalesce({key}::VARCHAR, '<missing>') AS key1, '' AS key2, 'rows' AS metric, count(*)::DOUBLE AS value "
                            f"FROM cleaned WHERE {where} GROUP BY {key}")

    parts = [
        row("total_rows", "'' AS key1, '' AS key2, 'rows' AS metric, count(*)::DOUBLE AS value FROM cleaned"),
        rows_of("label_counts", "label"),
        row("domain_counts_by_label", "label::VARCHAR, coalesce(domain, 'nan'), 'rows', count(*) FROM cleaned GROUP BY label, domain"),
        rows_of("model_family_counts_aigc", "model_family", "label = 1"),
        rows_of("model_counts_aigc", "model", "label = 1"),
    ]
    for name in _AUDIT_COLUMNS:
        parts.append(row("missing_field_counts", f"'{name}', '', 'rows', count(*) FILTER ({name} IS NULL) FROM cleaned"))
    for name in ("note_title", "note_content", "text"):
        parts.append(row("empty_counts", f"'{name}', '', 'rows', count(*) FILTER (coalesce({name}, '') = '') FROM cleaned"))
    for metric, value in (
        ("rows", "count(*)"),
        ("empty_title_rows", "count(*) FILTER (note_title = '')"),
        ("empty_title_share", "round(count(*) FILTER (note_title = '') / count(*)::DOUBLE, 6)"),
    ):
        parts.append(row("empty_title_counts_by_label", f"label::VARCHAR, '', '{metric}', {value} FROM cleaned GROUP BY label"))
    parts.append(row("duplicate_text_counts", f"'', '', metric, value FROM ({_DUPLICATES})"))
    for metric, value in (("overlap_text_values", "count(*)"), ("rows_in_overlap", "coalesce(sum(copies), 0)")):
        parts.append(row("human_aigc_exact_text_overlap",
                         f"'', '', '{metric}', {value} FROM groups WHERE human_rows > 0 AND ai_rows > 0"))
    for group in ("label", "domain"):
        for metric, value in (("count", "count(*)"), ("mean", "avg(text_len_chars)"), ("median", "median(text_len_chars)"),
                              ("min", "min(text_len_chars)"), ("max", "max(text_len_chars)")):
            parts.append(row(f"length_stats_by_{group}",
                             f"coalesce({group}::VARCHAR, 'nan'), '', '{metric}', {value} FROM cleaned GROUP BY {group}"))
    for name in ("likes", "domain", "model_family", "model"):
        parts.append(row("suspicious_columns_not_for_model_features", f"'{name}', '', 'present', 1"))
    return f"SELECT section, key1, key2, metric, round(value::DOUBLE, 6) AS value FROM ({' UNION ALL '.join(parts)})"


_DUPLICATES = """SELECT metric, value FROM (
    SELECT 'duplicate_rows_overall' AS metric, coalesce(sum(copies), 0)::BIGINT AS value FROM groups
    UNION ALL SELECT 'duplicate_text_values_overall', coalesce(sum(copies - 1), 0)::BIGINT FROM groups
    UNION ALL SELECT 'duplicate_rows_label_0', coalesce(sum(human_rows), 0)::BIGINT FROM groups
    UNION ALL SELECT 'duplicate_rows_label_1', coalesce(sum(ai_rows), 0)::BIGINT FROM groups)
  WHERE metric NOT LIKE 'duplicate_rows_label_%' OR value > 0"""

_CLEAN_REPORT = """SELECT count(*) AS input_rows, count(*) FILTER (text = '') AS dropped_empty_text_rows,
  count(*) FILTER (title_only AND length(note_title) < {least}) AS dropped_short_title_only_rows,
  count(*) FILTER (title_only AND length(note_title) >= {least}) AS kept_title_only_rows,
  count(*) FILTER (text <> '' AND NOT (title_only AND length(note_title) < {least})) AS output_rows FROM templated"""

_LENGTHS = """SELECT {key}, count(text_len_chars) AS count, round(avg(text_len_chars), 6) AS mean,
  round(median(text_len_chars)::DOUBLE, 6) AS median, min(text_len_chars)::BIGINT AS min, max(text_len_chars)::BIGINT AS max
  FROM cleaned GROUP BY {key}"""

_MISSING_NAMES = ["note_title", "note_content", "label", "note_id", "likes", "domain", "model_family", "model", "text"]

_SECTIONS = [("rows", "''", "TRUE"), ("label", "label::VARCHAR", "TRUE"), ("domain", "coalesce(domain, '<missing>')", "TRUE"),
             ("model_family_aigc", "coalesce(model_family, '<missing>')", "label = 1"),
             ("model_aigc", "coalesce(model, '<missing>')", "label = 1")]

_TABLES = [("domain", "TRUE"), ("model_family", "label = 1"), ("model", "label = 1"), ("length_bucket", "TRUE")]

BODIES = {
    "normalize_text": "SELECT doc_id, note_title AS title, note_content AS body FROM normal",
    "canonical_text": "SELECT doc_id, text, title_only, text_len_chars FROM cleaned",
    "clean_report": _CLEAN_REPORT.format(least=1),
    "clean_report_long_titles": _CLEAN_REPORT.format(least=40),
    "stable_id": "SELECT doc_id, id FROM cleaned",
    "conflicts": """SELECT doc_id, label, text, source_file, source_line FROM cleaned
      WHERE text IN (SELECT text FROM conflict_texts)""",
    "dedupe": "SELECT doc_id, id, label, text, domain, model_family FROM deduped",
    "dedupe_summary": """SELECT (SELECT count(*) FROM cleaned) AS input_rows, (SELECT count(*) FROM conflict_texts) AS conflict_text_values,
      (SELECT count(*) FROM cleaned WHERE text IN (SELECT text FROM conflict_texts)) AS conflict_rows_removed,
      (SELECT count(*) FROM cleaned WHERE text NOT IN (SELECT text FROM conflict_texts)) - (SELECT count(*) FROM deduped)
        AS within_label_duplicate_rows_removed, (SELECT count(*) FROM deduped) AS output_rows""",
    "nested_counts": "SELECT label, domain, count(*) AS rows FROM deduped GROUP BY label, domain",
    "value_counts": "SELECT coalesce(model_family, '<missing>') AS value, count(*) AS rows FROM cleaned GROUP BY 1",
    "missing_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER ({name} IS NULL) AS missing_rows FROM cleaned" for name in _MISSING_NAMES
    ),
    "empty_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER (coalesce({name}, '') = '') AS empty_rows FROM cleaned"
        for name in ("note_title", "note_content", "text")
    ),
    "empty_title": """SELECT label, count(*) AS rows, count(*) FILTER (note_title = '') AS empty_title_rows,
      round(count(*) FILTER (note_title = '') / count(*)::DOUBLE, 6) AS empty_title_share FROM cleaned GROUP BY label""",
    "duplicates": _DUPLICATES,
    "label_overlap": """SELECT count(*) AS overlap_text_values, coalesce(sum(copies), 0)::BIGINT AS rows_in_overlap
      FROM groups WHERE human_rows > 0 AND ai_rows > 0""",
    "length_stats_label": _LENGTHS.format(key="label"),
    "length_stats_domain": _LENGTHS.format(key="domain"),
    "audit_report": _audit(),
    "feature_guard": """SELECT label, count(*) AS rows, sum(length(text))::BIGINT AS chars,
      'likes,domain,model_family,model' AS barred_columns FROM cleaned GROUP BY label""",
    "fingerprint": f"SELECT doc_id, sha1({_FOLD}) AS fingerprint FROM cleaned",
    "near_dup": f"""SELECT {_shared('fingerprints')}, coalesce(sum(rows) FILTER ({_CROSSING}), 0)::BIGINT AS rows_involved
      FROM (SELECT sha1({_FOLD}) AS fp, count(*) AS rows, {_SPLIT_COUNTS} FROM split_rows GROUP BY 1)""",
    "split_overlap": f"""SELECT {_shared('texts')} FROM (SELECT text, {_SPLIT_COUNTS} FROM
      (SELECT text, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM cleaned) GROUP BY text)""",
    "group_column": " UNION ALL ".join(
        f"""SELECT '{name}' AS candidate, round(avg(CASE WHEN coalesce({value}, '') <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
        count({value}) FILTER ({value} <> '') - count(DISTINCT {value}) FILTER ({value} <> '') AS duplicate_groups,
        avg(CASE WHEN coalesce({value}, '') <> '' THEN 1.0::DOUBLE ELSE 0 END) >= 0.95
          AND count({value}) FILTER ({value} <> '') > count(DISTINCT {value}) FILTER ({value} <> '') AS usable FROM deduped"""
        for name, value in (("seed_id", "source"), ("note_id", "note_id"))
    ),
    "stratum_choice": """SELECT n AS smallest_stratum, CASE WHEN n >= 4 THEN 'label+domain' ELSE 'label' END AS stratify_by,
      CASE WHEN n >= 4 THEN 'strata are labels and domains' ELSE 'strata are labels' END AS note FROM stratum_min""",
    "stratum_counts": """SELECT label::VARCHAR || '__' || coalesce(domain, '<missing>') AS stratum, count(*) AS rows
      FROM deduped GROUP BY 1""",
    "stratified_split": "SELECT id, split FROM split_rows",
    "group_split": """WITH g AS (SELECT DISTINCT coalesce(source, '') AS g FROM deduped),
      a AS (SELECT g, row_number() OVER (ORDER BY sha1('42:' || g)) AS r, count(*) OVER () AS n FROM g),
      b AS (SELECT g, row_number() OVER (ORDER BY sha1('42:' || g)) AS r, count(*) OVER () AS n FROM a
            WHERE r > n - ceil(0.3::DOUBLE * n))
      SELECT d.id, d.source AS seed_id, CASE WHEN b.g IS NULL THEN 'train' WHEN b.r <= b.n - ceil(0.5::DOUBLE * b.n) THEN 'val'
        ELSE 'test' END AS split FROM deduped d LEFT JOIN b ON b.g = d.source""",
    "split_checks": " UNION ALL ".join(
        [f"SELECT 'empty_{n}' AS check_name, CASE WHEN count(*) FILTER (split = '{n}') = 0 THEN 1 ELSE 0 END::BIGINT AS problem FROM split_rows"
         for n in ("train", "val", "test")]
        + [f"SELECT 'missing_labels_{n}', (2 - count(DISTINCT label) FILTER (split = '{n}'))::BIGINT FROM split_rows"
           for n in ("train", "val", "test")]
        + [f"SELECT '{a}_{b}_shared_texts', {a}_{b}_shared_texts FROM ({_OVERLAPS})" for a, b in _SPLIT_PAIRS]
    ),
    "manifest": " UNION ALL ".join(
        f"SELECT split, '{section}' AS section, {value} AS value, count(*) AS rows FROM split_rows WHERE {where} GROUP BY 1, 3"
        for section, value, where in _SECTIONS
    ),
    "stratified_sample": """SELECT id, label FROM (
      SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha1('42:' || id)) AS r,
        count(*) OVER (PARTITION BY label) AS g, count(*) OVER () AS n FROM deduped)
      WHERE r <= greatest(1, round_even(200 * g / n::DOUBLE, 0))) ORDER BY sha1('42:' || id) LIMIT 200""",
    "split_table": """SELECT id, text, label, note_title, note_content, domain, model_family, model, source_file, split,
      text_len_chars, title_only, note_id, likes FROM split_rows""",
    "prepare_counts": """SELECT 'raw' AS step, count(*) AS rows FROM posts UNION ALL SELECT 'cleaned', count(*) FROM cleaned
      UNION ALL SELECT 'deduped', count(*) FROM deduped UNION ALL SELECT split, count(*) FROM split_rows GROUP BY split""",
    "predictions": f"SELECT {_PREDICTION} FROM predicted",
    "errors_fp": f"SELECT {_PREDICTION} FROM predicted WHERE label = 0 AND pred_label = 1",
    "errors_fn": f"SELECT {_PREDICTION} FROM predicted WHERE label = 1 AND pred_label = 0",
    "softmax": """SELECT doc_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p_ai
      FROM (SELECT doc_id, score_ai * 8 - 4 AS a, (doc_id % 13)::DOUBLE - 6 AS b FROM posts)""",
    "confusion": """SELECT count(*) FILTER (label = 0 AND pred_label = 0) AS tn, count(*) FILTER (label = 0 AND pred_label = 1) AS fp,
      count(*) FILTER (label = 1 AND pred_label = 0) AS fn, count(*) FILTER (label = 1 AND pred_label = 1) AS tp FROM scored""",
    "binary_metrics": f"SELECT rows, {_RECORD_SQL}, tn, fp, fn, tp, {_SUPPORT} FROM ({_record('scored')})",
    "rank_metrics": f"""SELECT domain, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision
      FROM (SELECT domain, {_RANKS} FROM ({_steps('scored', 'domain')}) GROUP BY domain)""",
    "class_report": f"""WITH m AS (SELECT {_metrics()} FROM scored), r AS (
      SELECT 'human' AS class_name, {_PH} AS p, {_RH} AS r, {_FH} AS f, tn + fp AS support FROM m
      UNION ALL SELECT 'ai', {_PA}, {_RA}, {_FA}, fn + tp FROM m
      UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, rows FROM m
      UNION ALL SELECT 'macro avg', ({_PH} + {_PA}) / 2, ({_RH} + {_RA}) / 2, ({_FH} + {_FA}) / 2, rows FROM m
      UNION ALL SELECT 'weighted avg', {_weighted(_PH, _PA)}, {_weighted(_RH, _RA)}, {_weighted(_FH, _FA)}, rows FROM m)
      SELECT class_name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM r""",
    "subgroup_domain": _subgroup("scored", "domain"),
    "subgroup_family": _subgroup("scored", "model_family", "label = 1"),
    "subgroup_model": _subgroup("scored", "model", "label = 1", "count(*) >= 3"),
    "subgroup_length": _subgroup("bucketed", "length_bucket"),
    "subgroup_tables": " UNION ALL ".join(
        f"SELECT '{key}' AS dimension, {key} AS value, * EXCLUDE ({key}) FROM ({_subgroup('bucketed', key, where)})"
        for key, where in _TABLES
    ),
    "wilson": f"""SELECT domain, label, successes, trials, {_interval('low', 'successes', 'trials')} AS low,
      {_interval('high', 'successes', 'trials')} AS high FROM (SELECT domain, label,
      count(*) FILTER (score_ai >= 0.5) AS successes, count(*) AS trials FROM posts GROUP BY domain, label)""",
    "majority": """SELECT CASE WHEN h >= a THEN 0 ELSE 1 END AS majority_label, round(greatest(h, a) / (h + a)::DOUBLE, 6) AS accuracy,
      round(2.0::DOUBLE * greatest(h, a) / (2 * greatest(h, a) + least(h, a)) / 2, 6) AS macro_f1, 0.5::DOUBLE AS auroc,
      round(a / (h + a)::DOUBLE, 6) AS average_precision
      FROM (SELECT count(*) FILTER (label = 0) AS h, count(*) FILTER (label = 1) AS a FROM deduped)""",
    "roc_points": f"""SELECT score_ai AS threshold, round(fp / (sum(n) OVER ())::DOUBLE, 6) AS fpr,
      round(tp / (sum(p) OVER ())::DOUBLE, 6) AS tpr FROM ({_steps('scored')})
      UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    "pr_points": f"""SELECT score_ai AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
      round(tp / (sum(p) OVER ())::DOUBLE, 6) AS recall FROM ({_steps('scored')})
      UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
    "tertile_edges": f"""WITH all_lengths AS (SELECT text_len_chars AS v, row_number() OVER (ORDER BY text_len_chars) - 1 AS i,
      count(*) OVER () AS n FROM cleaned) SELECT smallest, round(lower, 6) AS lower, round(upper, 6) AS upper, largest
      FROM ({_edges_cte('all_lengths')})""",
    "length_buckets": "SELECT id, text_len_chars, length_bucket FROM bucketed",
    "train_val_metrics": f"""SELECT split, round({_ACC}, 6) AS accuracy, round({_RECORD['macro_f1']}, 6) AS macro_f1,
      round({_RA}, 6) AS recall_ai, round(average_precision, 6) AS average_precision, round(log_loss, 6) AS log_loss
      FROM ({_record('predicted', 'split')})""",
    "class_f1_chart": f"""WITH m AS (SELECT {_metrics()} FROM scored)
      SELECT 'human' AS class_name, round({_FH}, 6) AS f1 FROM m UNION ALL SELECT 'ai', round({_FA}, 6) FROM m""",
    "domain_chart": f"""SELECT domain, round({_RECORD['macro_f1']}, 6) AS macro_f1
      FROM (SELECT {_metrics('domain,')} FROM scored GROUP BY domain)""",
    "length_chart": f"""SELECT length_bucket, round({_RA}, 6) AS recall_ai,
      CASE length_bucket WHEN 'short' THEN 0 WHEN 'medium' THEN 1 WHEN 'long' THEN 2 ELSE 99 END AS place
      FROM (SELECT {_metrics('length_bucket,')} FROM bucketed GROUP BY length_bucket)""",
    "families": """SELECT model_family, count(*) AS rows FROM deduped WHERE label = 1 AND model_family IS NOT NULL
      GROUP BY model_family""",
    "holdout_folds": "SELECT * FROM holdout_sizes",
    "control_folds": "SELECT fold, split, model_family, count(*) AS ai_rows FROM control_rows GROUP BY ALL",
    "fold_members": "SELECT fold, split, id, label FROM holdout_rows",
    "fold_summary": "SELECT * REPLACE (round(recall_ai_holdout, 6) AS recall_ai_holdout, round(auroc, 6) AS auroc) FROM sum_plain",
    "recall_drop": """SELECT s.* REPLACE (round(recall_ai_holdout, 6) AS recall_ai_holdout, round(auroc, 6) AS auroc),
      round(recall_seen, 6) AS recall_ai_in_distribution, round(recall_seen - s.recall_ai_holdout, 6) AS recall_drop
      FROM sum_unseen s LEFT JOIN seen USING (held_out_family)""",
    "decomposition": """SELECT h.held_out_family, h.test_ai_rows, round(recall_seen, 6) AS recall_ai_in_distribution,
      round(c.recall_ai_control, 6) AS recall_ai_control, round(h.recall_ai_holdout, 6) AS recall_ai_holdout,
      round(recall_seen - c.recall_ai_control, 6) AS cost_of_less_data,
      round(c.recall_ai_control - h.recall_ai_holdout, 6) AS cost_of_new_generator,
      round(recall_seen - h.recall_ai_holdout, 6) AS recall_drop, round(h.auroc, 6) AS auroc,
      h.false_positives_human, h.missed_ai_posts, h.train_ai_rows
      FROM sum_unseen h JOIN sum_matched c USING (held_out_family) LEFT JOIN seen USING (held_out_family)""",
    "json_scan": "SELECT source_file, source_line, kind FROM json_checked WHERE kind IS NOT NULL",
    "json_alias": """SELECT safe->>'note_title' AS note_title,
      CASE WHEN list_contains(keys, 'note_content') THEN safe->>'note_content' ELSE safe->>'desc' END AS note_content,
      label, source_file, source_line,
      (CASE WHEN list_contains(keys, 'likes') THEN safe->>'likes' ELSE safe->>'liked_count' END)::BIGINT AS likes,
      (CASE WHEN list_contains(keys, 'collections') THEN safe->>'collections' ELSE safe->>'collected_count' END)::BIGINT AS collections,
      safe->>'domain' AS domain, safe->>'model_family' AS model_family, safe->>'model' AS model
      FROM json_checked WHERE kind IS NULL""",
    "load_report": """SELECT source_file, label, count(*) FILTER (kind IS NULL) AS rows_loaded,
      count(*) FILTER (kind = 'malformed') AS malformed_rows, count(*) FILTER (kind = 'missing') AS missing_required_rows,
      count(*) FILTER (kind IS NULL AND list_contains(keys, 'desc') AND NOT list_contains(keys, 'note_content')) AS alias_note_content,
      count(*) FILTER (kind IS NULL AND list_contains(keys, 'liked_count') AND NOT list_contains(keys, 'likes')) AS alias_likes,
      count(*) FILTER (kind IS NULL AND list_contains(keys, 'collected_count') AND NOT list_contains(keys, 'collections')) AS alias_collections,
      count(*) FILTER (kind IS NULL AND list_contains(keys, 'comments_count') AND NOT list_contains(keys, 'comments')) AS alias_comments,
      0::BIGINT AS unread_likes, 0::BIGINT AS unread_collections, 0::BIGINT AS unread_comments
      FROM json_checked GROUP BY source_file, label""",
    "first_n": """SELECT source_file, source_line, kind IS NULL AS good FROM (
      SELECT *, coalesce(sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY source_file, source_line
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good_before FROM json_checked) WHERE good_before < 100""",
    "char_ngrams": """SELECT doc_id, sum(tf)::BIGINT AS grams, count(*) AS distinct_grams, max(tf) AS most,
      (sum(tf) FILTER (n = 5))::BIGINT AS five_grams FROM grams GROUP BY doc_id""",
    "vocabulary": """SELECT gram, df, cf, round(ln((1 + (SELECT n FROM docs_n))::DOUBLE / (1 + df)) + 1, 6) AS idf FROM kept_grams""",
    "tfidf_weights": """SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS total,
      round(max(w) / sqrt(sum(w * w)), 6) AS heaviest FROM raw_weights GROUP BY doc_id""",
    "class_weights": """SELECT label, count(*) AS rows, round((sum(count(*)) OVER ()) / (2 * count(*))::DOUBLE, 6) AS weight
      FROM deduped GROUP BY label""",
    "batch_score": r"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6)
      AS score_ai FROM documents""",
}


# The labelled documents: the same rules as for posts, without a domain.
_OWN = "strata quota1 held held2 quota2 held_split".split()


def _renamed(prefix: str, names: list[str], body: str) -> str:
    return re.sub(rf"\b({'|'.join(names)})\b", rf"{prefix}\1", body)


CTES["tox_rows"] = """SELECT text, toxic AS label, doc_id, CASE WHEN toxic = 1 THEN 'ai_' ELSE 'human_' END ||
  sha1(toxic::VARCHAR || chr(10) || text)[1:16] AS id FROM documents JOIN labels USING (doc_id)"""
CTES["tox_deduped"] = """SELECT * FROM tox_rows WHERE text NOT IN (SELECT text FROM tox_rows GROUP BY text HAVING min(label) <> max(label))
  QUALIFY row_number() OVER (PARTITION BY label, text ORDER BY doc_id) = 1"""
CTES["tox_strata"] = "SELECT id, label, label::VARCHAR AS stratum FROM tox_deduped"
for _name in _OWN[1:]:
    CTES[f"tox_{_name}"] = _renamed("tox_", _OWN, CTES[_name])
CTES["tox_split"] = "SELECT d.*, coalesce(h.split, 'train') AS split FROM tox_deduped d LEFT JOIN tox_held_split h USING (id)"


def _gram_rows(prefix: str, rows: str) -> None:
    """Grams per id of some texts, by the tables behind the documents' grams."""
    names = ["analysed", "chars", "windows", "grams"]
    for name in names:
        body = _renamed(prefix, names, CTES[name]).replace("doc_id", "id").replace("FROM documents", f"FROM ({rows})")
        CTES[prefix + name] = body


_gram_rows("tox_", "SELECT id, text FROM tox_split WHERE split = 'train'")
_gram_rows("post_", "SELECT id, text FROM split_rows WHERE split = 'train'")
CTES["tox_kept"] = """SELECT gram FROM tox_grams GROUP BY gram HAVING count(*) >= 2
  AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM tox_split WHERE split = 'train')"""
CTES["post_dfs"] = """SELECT gram, coalesce(model_family, '') AS family, count(*) AS df
  FROM post_grams JOIN split_rows USING (id) GROUP BY 1, 2"""
CTES["gram_totals"] = "SELECT gram, sum(df) AS df FROM post_dfs GROUP BY gram"
CTES["train_size"] = "SELECT count(*) AS n FROM split_rows WHERE split = 'train'"
CTES["holdout_grams"] = """SELECT f.fold, count(*) AS grams FROM gram_totals t CROSS JOIN fams f
  LEFT JOIN post_dfs o ON o.gram = t.gram AND o.family = f.fold
  LEFT JOIN drops d ON d.fold = f.fold AND d.split = 'train'
  WHERE t.df - coalesce(o.df, 0) >= 2
    AND t.df - coalesce(o.df, 0) <= 0.95::DOUBLE * ((SELECT n FROM train_size) - coalesce(d.k, 0)) GROUP BY f.fold"""
CTES["dropped_places"] = """SELECT f.fold, a.id FROM fams f JOIN drops d ON d.fold = f.fold AND d.split = 'train'
  JOIN ai_places a ON a.split = 'train' AND a.place <= d.k"""
CTES["dropped_dfs"] = "SELECT p.fold, g.gram, count(*) AS df FROM post_grams g JOIN dropped_places p USING (id) GROUP BY 1, 2"
CTES["control_grams"] = """SELECT f.fold, count(*) AS grams FROM gram_totals t CROSS JOIN fams f
  LEFT JOIN dropped_dfs o ON o.gram = t.gram AND o.fold = f.fold
  LEFT JOIN drops d ON d.fold = f.fold AND d.split = 'train'
  WHERE t.df - coalesce(o.df, 0) >= 2
    AND t.df - coalesce(o.df, 0) <= 0.95::DOUBLE * ((SELECT n FROM train_size) - coalesce(d.k, 0)) GROUP BY f.fold"""
CTES["half_scored"] = """SELECT * REPLACE (CASE WHEN domain IN ('de', 'es') AND doc_id % 5 = 1 THEN NULL ELSE score_ai END AS score_ai) FROM deduped"""
CTES["half_predicted"] = "SELECT *, CASE WHEN score_ai >= 0.5 THEN 1 ELSE 0 END AS pred_label FROM half_scored"
CTES["half_whole"] = "SELECT domain FROM half_scored GROUP BY domain HAVING count(*) = count(score_ai)"
CTES["fixed_weights"] = """SELECT g.doc_id, g.gram, (1 + ln(g.tf)) * (ln((1 + (SELECT n FROM docs_n))::DOUBLE / (1 + k.df)) + 1) AS w
  FROM grams g JOIN kept_grams k USING (gram)"""
CTES["fixed_terms"] = """SELECT gram, (sum(unicode(c) * i) % 201 - 100) / 50.0::DOUBLE AS coefficient FROM (
  SELECT gram, unnest(string_split(gram, '')) AS c, unnest(range(1, length(gram) + 1)) AS i FROM kept_grams) GROUP BY gram"""


def _sweep(mode: str) -> str:
    return f"""SELECT fold AS held_out_family, count(*) FILTER (label = 1 AND split = 'train') AS train_ai_rows,
      count(*) FILTER (label = 0 AND split = 'test') AS test_human_rows, count(*) FILTER (label = 1 AND split = 'test') AS test_ai_rows,
      any_value(grams) AS grams, true AS gradient_ok, true AS scores_in_range
      FROM holdout_rows JOIN {mode}_grams USING (fold) GROUP BY fold"""


_FIXED = """SELECT doc_id, round(1 / (1 + exp(-(coalesce(sum(w * coefficient) / sqrt(sum(w * w)), 0) + 0.1))), 6) AS score_ai
  FROM documents LEFT JOIN (SELECT * FROM fixed_weights JOIN fixed_terms USING (gram)) USING (doc_id) GROUP BY doc_id"""

BODIES |= {
    "top_vocabulary": """SELECT gram, df, cf, round(ln((1 + (SELECT n FROM docs_n))::DOUBLE / (1 + df)) + 1, 6) AS idf
      FROM kept_grams ORDER BY cf DESC, gram LIMIT 2000""",
    "train_score": """SELECT split, count(*) AS rows, sum(label)::BIGINT AS ai_rows, (SELECT count(*) FROM tox_kept) AS grams,
      true AS gradient_ok, true AS scores_in_range FROM tox_split WHERE split <> 'test' GROUP BY split""",
    "predict_test": "SELECT doc_id, true AS scored FROM documents",
    "holdout_sweep": _sweep("holdout"),
    "control_sweep": _sweep("control"),
    "fixed_model_scores": _FIXED,
    "model_round_trip": _FIXED,
    "fold_recall_chart": """SELECT h.held_out_family, round(h.recall_ai_holdout, 6) AS recall_ai_holdout,
      round(recall_seen, 6) AS recall_ai_in_distribution, round(c.recall_ai_control, 6) AS recall_ai_control
      FROM sum_unseen h JOIN sum_matched c USING (held_out_family) LEFT JOIN seen USING (held_out_family)""",
    "evaluate_outputs": BODIES["subgroup_tables"],
    "rank_metrics_unscored": f"""SELECT domain, rows, tn, fp, fn, tp,
      CASE WHEN domain IN (SELECT domain FROM half_whole) THEN round(log_loss, 6) END AS log_loss,
      CASE WHEN domain IN (SELECT domain FROM half_whole) THEN round(auroc, 6) END AS auroc,
      CASE WHEN domain IN (SELECT domain FROM half_whole) THEN round(average_precision, 6) END AS average_precision
      FROM ({_record('half_predicted', 'domain')})""",
    "roc_points_unscored": f"""WITH classes AS (SELECT domain, count(*) FILTER (label = 1) AS ais, count(*) FILTER (label = 0) AS humans
        FROM half_scored WHERE domain IN (SELECT domain FROM half_whole) GROUP BY domain)
      SELECT domain, round(score_ai, 6) AS threshold, round(fp::DOUBLE / humans, 6) AS fpr, round(tp::DOUBLE / ais, 6) AS tpr
      FROM ({_steps('half_scored', 'domain')}) JOIN classes USING (domain) WHERE ais > 0 AND humans > 0
      UNION ALL SELECT domain, 'inf'::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM classes WHERE ais > 0 AND humans > 0""",
    "json_counts": """SELECT doc_id AS source_line, CASE doc_id % 7 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 1000 WHEN 6 THEN doc_id END AS likes,
      CASE doc_id % 7 WHEN 2 THEN '1.2万' WHEN 4 THEN doc_id::VARCHAR || '.5' WHEN 5 THEN '123456789012345678901234567890' END AS likes_raw
      FROM documents""",
    "jsonl_file_scan": """SELECT row_number() OVER (PARTITION BY source_line % 8 ORDER BY source_line) AS source_line, value FROM json_lines""",
    "audit_with_load_report": f"""SELECT * FROM ({_audit()})
      UNION ALL SELECT 'cleaning_report', '', '', metric, value::DOUBLE FROM (UNPIVOT ({_CLEAN_REPORT.format(least=1)}) ON COLUMNS(*) INTO NAME metric VALUE value)
      UNION ALL SELECT 'load_report', source_file, '', metric, value::DOUBLE FROM (
        UNPIVOT ({BODIES['load_report']}) ON COLUMNS(* EXCLUDE (source_file, label)) INTO NAME metric VALUE value)""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    """Names of the common table expressions behind ``sql``, in definition order."""
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
            found.append(name)
            _needed(body, found)
    return found


def _statement(body: str) -> str:
    names = _needed(body, [])
    used = [name for name in CTES if name in names]
    if not used:
        return body
    shared = ", ".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in used)
    if body.startswith("WITH "):
        return f"WITH {shared}, {body[5:]}"
    return f"WITH {shared} {body}"


ORACLE = {name: _statement(body) for name, body in BODIES.items()}
