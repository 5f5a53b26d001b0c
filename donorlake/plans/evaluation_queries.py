"""Queries: metrics, confounding, splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlake.functions.columns import rounded
from donorlake.operators import confounding as cf
from donorlake.operators import donors as dn
from donorlake.operators import metrics as mt
from donorlake.operators import models as md
from donorlake.operators import resample as rs
from donorlake.operators import splits as sp
from donorlake.operators.ordering import mid_ranks, quantiles
from donorlake.plans.registry import CELLS, MANIFEST, PATIENTS, PREDICTIONS, TASK_LIST, cells, manifest, patients, predictions, query, r6, table

EVENTS = "ev AS (SELECT event_id, event_type, user_id, value AS score, (event_type = 'purchase')::INTEGER AS label FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label")
    )


def _auroc_sql(source: str, score: str, label: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    group, cols = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT {cols}n_pos, n_neg, CASE WHEN n_pos * n_neg > 0 THEN (s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg::DOUBLE) END AS auroc FROM (
      SELECT {cols}sum({label})::BIGINT AS n_pos, sum(1 - {label})::BIGINT AS n_neg, sum(r) FILTER ({label} = 1) AS s FROM (
        SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{score}) - 1) / 2.0 AS r FROM {source}) {group})"""


def _steps_sql(source: str, score: str, label: str) -> str:
    """Distinct thresholds from the top with cumulative counts."""
    return f"""steps AS (SELECT {score} AS threshold, pos, n, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n, sum(pos) OVER () AS n_pos, sum(n) OVER () AS n_all
      FROM (SELECT {score}, sum({label}) AS pos, count(*) AS n FROM {source} GROUP BY {score}) WINDOW w AS (ORDER BY {score} DESC))"""


@query("auroc", r6(f"WITH {PREDICTIONS} {_auroc_sql('predictions', 'n_chars', 'label')}", "auroc"))
def auroc(spark, sf):
    return rounded(mt.auroc(predictions(spark, sf), "n_chars", "label"))


@query("auroc_by_language", r6(f"WITH {PREDICTIONS} {_auroc_sql('predictions', 'n_chars', 'toxic', 'lang')}", "auroc"))
def auroc_by_language(spark, sf):
    return rounded(mt.auroc(predictions(spark, sf), "n_chars", "toxic", ["lang"]))


@query("auroc_events_by_user", r6(f"WITH {EVENTS} {_auroc_sql('ev', 'score', 'label', 'user_id')}", "auroc"))
def auroc_events_by_user(spark, sf):
    return rounded(mt.auroc(_events(spark, sf), by=["user_id"]))


@query(
    "average_precision",
    r6(f"WITH {EVENTS}, {_steps_sql('ev', 'score', 'label')} SELECT sum(pos / n_pos * cum_pos / cum_n) AS average_precision FROM steps", "average_precision"),
)
def average_precision(spark, sf):
    return rounded(mt.average_precision(_events(spark, sf)))


@query(
    "roc_points",
    r6(
        f"""WITH {EVENTS}, {_steps_sql('ev', 'score', 'label')} SELECT threshold, (cum_n - cum_pos) / (n_all - n_pos) AS fpr, cum_pos / n_pos AS tpr FROM steps
    UNION ALL SELECT NULL, 0.0, 0.0""",
        "fpr",
        "tpr",
    ),
)
def roc_points(spark, sf):
    return rounded(mt.roc_points(_events(spark, sf)))


@query(
    "precision_recall_points",
    r6(f"WITH {EVENTS}, {_steps_sql('ev', 'score', 'label')} SELECT threshold, cum_pos / cum_n AS precision, cum_pos / n_pos AS recall FROM steps", "precision", "recall"),
)
def precision_recall_points(spark, sf):
    return rounded(mt.precision_recall_points(_events(spark, sf)))


@query(
    "mid_ranks",
    """SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS n,
    rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS mid_rank FROM events""",
)
def mid_ranks_query(spark, sf):
    return mid_ranks(table(spark, sf, "events"), "value", ["event_type"])


@query(
    "exact_quantiles",
    r6(
        """SELECT o_orderstatus AS batch, quantile_cont(o_totalprice, 0.025) AS q0, quantile_cont(o_totalprice, 0.5) AS q1, quantile_cont(o_totalprice, 0.975) AS q2
    FROM orders GROUP BY 1""",
        "q0",
        "q1",
        "q2",
    ),
)
def exact_quantiles(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "batch")
    return rounded(quantiles(rows, "o_totalprice", [0.025, 0.5, 0.975], ["batch"]))


_CONFUSION = """c AS (SELECT {by} count(*) FILTER (label = 1 AND score >= {t}) AS tp, count(*) FILTER (label = 0 AND score < {t}) AS tn,
  count(*) FILTER (label = 0 AND score >= {t}) AS fp, count(*) FILTER (label = 1 AND score < {t}) AS fn FROM {src} {group}),
  d AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM c)"""
_CONF_COLS = ("accuracy", "sensitivity", "specificity", "precision", "balanced_accuracy", "f1")


@query(
    "confusion_metrics",
    r6(
        f"WITH {PREDICTIONS}, {_CONFUSION.format(by='lang,', t=0.6, src='predictions', group='GROUP BY lang')} SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy FROM d",
        *_CONF_COLS,
    ),
)
def confusion_metrics(spark, sf):
    return rounded(mt.confusion(mt.predicted(predictions(spark, sf), threshold=0.6), by=["lang"]))


@query("brier_score", r6(f"WITH {PREDICTIONS} SELECT lang, avg((score - label) * (score - label)) AS brier FROM predictions GROUP BY lang", "brier"))
def brier_score(spark, sf):
    return rounded(mt.brier(predictions(spark, sf), by=["lang"]))


@query(
    "prediction_summary",
    r6(
        f"""WITH {PREDICTIONS}, {_CONFUSION.format(by='', t=0.5, src='predictions', group='')}, {_steps_sql('predictions', 'score', 'label')},
    a AS ({_auroc_sql('predictions', 'score', 'label')})
    SELECT d.*, (sensitivity + specificity) / 2 AS balanced_accuracy, (SELECT avg((score - label) * (score - label)) FROM predictions) AS brier,
    a.auroc, (SELECT sum(pos / n_pos * cum_pos / cum_n) FROM steps) AS average_precision FROM d, a""",
        *_CONF_COLS,
        "brier",
        "auroc",
        "average_precision",
    ),
)
def prediction_summary(spark, sf):
    return rounded(mt.prediction_summary(predictions(spark, sf)))


_FIXED = f"""{PREDICTIONS}, bins AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS observed_rate
  FROM predictions GROUP BY 1)"""
_ADAPTIVE = f"""{PREDICTIONS}, s AS (SELECT score, label, floor((rank() OVER (ORDER BY score) - 1) * 10 / count(*) OVER ())::INTEGER AS bin FROM predictions),
  bins AS (SELECT bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS observed_rate FROM s GROUP BY 1)"""


@query("reliability_fixed_bins", r6(f"WITH {_FIXED} SELECT * FROM bins", "mean_score", "observed_rate"))
def reliability_fixed(spark, sf):
    return rounded(mt.reliability(predictions(spark, sf)))


@query("reliability_adaptive_bins", r6(f"WITH {_ADAPTIVE} SELECT * FROM bins", "mean_score", "observed_rate"))
def reliability_adaptive(spark, sf):
    return rounded(mt.reliability(predictions(spark, sf), strategy="adaptive"))


@query("calibration_error_fixed", r6(f"WITH {_FIXED} SELECT sum(n * abs(mean_score - observed_rate)) / sum(n) AS ece FROM bins", "ece"))
def ece_fixed(spark, sf):
    return rounded(mt.ece(predictions(spark, sf)))


@query("calibration_error_adaptive", r6(f"WITH {_ADAPTIVE} SELECT sum(n * abs(mean_score - observed_rate)) / sum(n) AS ece FROM bins", "ece"))
def ece_adaptive(spark, sf):
    return rounded(mt.ece(predictions(spark, sf), strategy="adaptive"))


@query(
    "value_histogram",
    """SELECT event_type, least(floor(value / 25.0), 19)::INTEGER AS bin, count(*) AS n, least(floor(value / 25.0), 19) * 25.0::DOUBLE AS bin_start
    FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL""",
)
def value_histogram(spark, sf):
    return mt.histogram(table(spark, sf, "events"), "value", 0.0, 500.0, 20, ["event_type"])


@query(
    "risk_coverage",
    r6(
        f"""WITH {PREDICTIONS}, p AS (SELECT greatest(score, 1 - score) AS confidence, ((score >= 0.5)::INTEGER <> label)::INTEGER AS wrong FROM predictions),
    s AS (SELECT confidence, count(*) AS n, sum(wrong) AS bad FROM p GROUP BY 1)
    SELECT round(confidence, 6) AS confidence, sum(n) OVER w / (SELECT count(*) FROM p) AS coverage, sum(bad) OVER w / sum(n) OVER w AS risk FROM s
    WINDOW w AS (ORDER BY confidence DESC)""",
        "coverage",
        "risk",
    ),
)
def risk_coverage(spark, sf):
    p = mt.predicted(predictions(spark, sf))
    p = p.withColumns({"confidence": F.greatest("score", 1 - F.col("score")), "wrong": (F.col("predicted") != F.col("label")).cast("int")})
    return rounded(mt.risk_coverage(p, "confidence", "wrong"))


@query("prediction_entropy", r6(f"WITH {PREDICTIONS} SELECT doc_id, -(score * ln(score) + (1 - score) * ln(1 - score)) AS entropy FROM predictions", "entropy"))
def prediction_entropy(spark, sf):
    return rounded(predictions(spark, sf).select("doc_id", mt.entropy("score").alias("entropy")))


# --- confounding --------------------------------------------------------------------

_AUDIT_BASE = f"{CELLS}, {PATIENTS}, {MANIFEST}"
_FLAG = "CASE WHEN {v} IS NULL OR isinf({v}) THEN 'not_estimable' WHEN abs({v}) >= {s} THEN 'strong' WHEN abs({v}) >= {m} THEN 'flag' ELSE 'none' END"


@query("task_expansion", f"WITH {_AUDIT_BASE} SELECT donor_id, grp, nation_id, n_cells, task, label FROM manifest")
def task_expansion(spark, sf):
    return manifest(spark, sf)


_COUNT_AUDIT = f"""cc AS (SELECT task, count(*) AS n_patients, count(*) FILTER (label = 1) AS n_cases, count(*) FILTER (label = 0) AS n_controls,
  avg(n_cells) FILTER (label = 1) AS mean_n_cells_case, avg(n_cells) FILTER (label = 0) AS mean_n_cells_control,
  avg(ln(1 + n_cells)) FILTER (label = 1) AS mean_log1p_n_cells_case, avg(ln(1 + n_cells)) FILTER (label = 0) AS mean_log1p_n_cells_control,
  quantile_cont(n_cells, 0.5) FILTER (label = 1)::DOUBLE AS median_n_cells_case, quantile_cont(n_cells, 0.5) FILTER (label = 0)::DOUBLE AS median_n_cells_control,
  var_samp(ln(1 + n_cells)) FILTER (label = 1) AS v1, var_samp(ln(1 + n_cells)) FILTER (label = 0) AS v0 FROM manifest GROUP BY task),
  count_audit AS (SELECT * EXCLUDE (v1, v0), (mean_log1p_n_cells_case - mean_log1p_n_cells_control)
    / sqrt(((n_cases - 1) * v1 + (n_controls - 1) * v0) / (n_cases + n_controls - 2)) AS log1p_n_cells_smd FROM cc)"""
_COUNT_FLAGGED = f"count_flagged AS (SELECT *, {_FLAG.format(v='log1p_n_cells_smd', m=0.5, s=1.0)} AS warning_flag FROM count_audit)"


@query(
    "cell_count_audit",
    r6(
        f"WITH {_AUDIT_BASE}, {_COUNT_AUDIT}, {_COUNT_FLAGGED} SELECT * FROM count_flagged",
        "mean_n_cells_case", "mean_n_cells_control", "mean_log1p_n_cells_case", "mean_log1p_n_cells_control", "log1p_n_cells_smd",
    ),
)
def cell_count_audit(spark, sf):
    return rounded(cf.cell_count_audit(manifest(spark, sf)))


_TYPE_AUDIT = f"""sh AS (SELECT donor_id, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY donor_id) AS fraction FROM cells GROUP BY donor_id, cell_type),
  sz AS (SELECT task, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM manifest GROUP BY task),
  ta AS (SELECT task, cell_type, coalesce(sum(fraction) FILTER (label = 1), 0) / n1 AS mean_prop_case, coalesce(sum(fraction) FILTER (label = 0), 0) / n0 AS mean_prop_control
    FROM sh JOIN manifest USING (donor_id) JOIN sz USING (task) GROUP BY task, cell_type, n1, n0),
  type_audit AS (SELECT *, abs(mean_prop_case - mean_prop_control) AS abs_mean_prop_diff FROM ta),
  type_flagged AS (SELECT *, {_FLAG.format(v='abs_mean_prop_diff', m=0.1, s=0.2)} AS warning_flag FROM type_audit)"""


def _type_audit(spark, sf):
    return cf.composition_audit(dn.composition(cells(spark, sf)), manifest(spark, sf))


@query("composition_audit", r6(f"WITH {_AUDIT_BASE}, {_TYPE_AUDIT} SELECT * FROM type_flagged", "mean_prop_case", "mean_prop_control", "abs_mean_prop_diff"))
def composition_audit(spark, sf):
    return rounded(_type_audit(spark, sf))


# Sources per patient: nation (constant), batch (mixed over a patient's cells).
_SOURCES = """src AS (SELECT donor_id, CASE WHEN count(DISTINCT batch) > 1 THEN '__mixed_within_patient__' ELSE min(batch) END AS batch,
    CASE WHEN min(nation_id) = 7 THEN '__missing__' ELSE min(nation_id)::VARCHAR END AS site FROM cells GROUP BY donor_id),
  lf AS (SELECT task, label, 'batch' AS source_field, batch AS category FROM manifest JOIN src USING (donor_id)
    UNION ALL SELECT task, label, 'site', site FROM manifest JOIN src USING (donor_id))"""
_CATEGORY_AUDIT = f"""{_SOURCES}, szc AS (SELECT task, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM manifest GROUP BY task),
  ca AS (SELECT task, source_field, category, count(*) AS n_patients, count(*) FILTER (label = 1) AS n_cases, count(*) FILTER (label = 0) AS n_controls
    FROM lf GROUP BY ALL),
  cb AS (SELECT ca.*, n_cases / n1 AS case_class_proportion, n_controls / n0 AS control_class_proportion, abs(n_cases / n1 - n_controls / n0) AS abs_class_proportion_diff,
    ((n_cases = 0) <> (n_controls = 0)) AND n_patients >= 2 AS present_in_only_one_class FROM ca JOIN szc USING (task)),
  category_flagged AS (SELECT *, CASE WHEN present_in_only_one_class OR abs_class_proportion_diff >= 1 THEN 'strong'
    WHEN abs_class_proportion_diff >= 0.25 THEN 'flag' ELSE 'none' END AS warning_flag FROM cb)"""


def _category_audit(spark, sf):
    rows = cells(spark, sf)
    site = rows.groupBy("donor_id").agg(F.min("nation_id").alias("_s")).select(
        "donor_id", F.when(F.col("_s") != 7, F.col("_s").cast("string")).alias("site")
    )
    full = manifest(spark, sf).join(dn.collapse(rows, "donor_id", "batch", "mixed"), "donor_id").join(site, "donor_id")
    return cf.category_audit(full, ["batch", "site"])


@query(
    "category_audit",
    r6(
        f"WITH {_AUDIT_BASE}, {_CATEGORY_AUDIT} SELECT * FROM category_flagged",
        "case_class_proportion", "control_class_proportion", "abs_class_proportion_diff",
    ),
)
def category_audit(spark, sf):
    return rounded(_category_audit(spark, sf))


@query(
    "audit_summary",
    f"""WITH {_AUDIT_BASE}, {_COUNT_AUDIT}, {_COUNT_FLAGGED}, {_TYPE_AUDIT}, {_CATEGORY_AUDIT},
    t3 AS (SELECT task, string_agg(printf('%s=%.3f', cell_type, abs_mean_prop_diff), '; ' ORDER BY r) AS top_cell_type_imbalances FROM (
      SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(abs_mean_prop_diff, 12) DESC, cell_type) AS r FROM type_flagged) WHERE r <= 3 AND abs_mean_prop_diff > 0 GROUP BY task),
    ff AS (SELECT task, array_to_string(list_sort(list_distinct(list(source_field))), '; ') AS source_batch_warning_fields, count(*) AS source_batch_categories_flagged
      FROM category_flagged WHERE warning_flag <> 'none' GROUP BY task),
    lv AS (SELECT task, max(CASE warning_flag WHEN 'strong' THEN 3 WHEN 'flag' THEN 2 WHEN 'not_estimable' THEN 1 ELSE 0 END) AS s FROM (
      SELECT task, warning_flag FROM count_flagged UNION ALL SELECT task, warning_flag FROM type_flagged UNION ALL SELECT task, warning_flag FROM category_flagged) GROUP BY task)
    SELECT task, n_patients, n_cases, n_controls, c.warning_flag AS cell_count_warning_flag, coalesce(top_cell_type_imbalances, '') AS top_cell_type_imbalances,
      coalesce(source_batch_warning_fields, '') AS source_batch_warning_fields, coalesce(source_batch_categories_flagged, 0) AS source_batch_categories_flagged,
      CASE s WHEN 3 THEN 'strong' WHEN 2 THEN 'flag' WHEN 1 THEN 'not_estimable' ELSE 'none' END AS warning_flag
    FROM count_flagged c LEFT JOIN t3 USING (task) LEFT JOIN ff USING (task) JOIN lv USING (task)""",
)
def audit_summary(spark, sf):
    return cf.audit_summary(cf.cell_count_audit(manifest(spark, sf)), _type_audit(spark, sf), _category_audit(spark, sf))


@query(
    "group_cell_types",
    r6(
        f"""WITH {CELLS} SELECT grp, cell_type, count(*) AS cell_count, sum(count(*)) OVER (PARTITION BY grp)::BIGINT AS group_total_cells,
    count(*) / sum(count(*)) OVER (PARTITION BY grp) AS cell_fraction_within_group FROM cells GROUP BY grp, cell_type""",
        "cell_fraction_within_group",
    ),
)
def group_cell_types(spark, sf):
    return rounded(cf.group_cell_types(cells(spark, sf), "grp"))


_CHI = """rows AS (SELECT grp, f AS feature, v AS level FROM (SELECT c_mktsegment AS grp, n_regionkey::VARCHAR AS region, (c_acctbal < 0)::VARCHAR AS debt, 'one' AS flat
    FROM customer JOIN nation ON n_nationkey = c_nationkey) UNPIVOT (v FOR f IN (region, debt, flat))),
  cell AS (SELECT feature, level, grp, count(*) AS patient_count FROM rows GROUP BY ALL),
  lt AS (SELECT feature, level, sum(patient_count) AS lsum FROM cell GROUP BY ALL), gt AS (SELECT feature, grp, sum(patient_count)::BIGINT AS group_total FROM cell GROUP BY ALL),
  tot AS (SELECT feature, sum(lsum) AS total, count(*) AS nl FROM lt GROUP BY feature), ng AS (SELECT feature, count(*) AS ng FROM gt GROUP BY feature),
  tab AS (SELECT lt.feature, lt.level, gt.grp, coalesce(patient_count, 0) AS patient_count, group_total, lsum * group_total / total AS e, nl, ng
    FROM lt JOIN gt USING (feature) JOIN tot USING (feature) JOIN ng USING (feature) LEFT JOIN cell ON cell.feature = lt.feature AND cell.level = lt.level AND cell.grp = gt.grp),
  st AS (SELECT feature, CASE WHEN nl > 1 THEN sum((patient_count - e) * (patient_count - e) / e) END AS chi2,
    CASE WHEN nl > 1 THEN ((nl - 1) * (ng - 1))::DOUBLE END AS dof FROM tab GROUP BY feature, nl, ng),
  pv AS (SELECT *, exp(-chi2 / 2) * (SELECT sum(pow(chi2 / 2, k) / gamma(k + 1)) FROM range(0, 64) r(k) WHERE k < dof / 2) AS p_value FROM st)"""


@query(
    "chi_square_audit",
    r6(
        f"WITH {_CHI} SELECT feature, level, grp, patient_count, group_total, patient_count / group_total AS group_fraction, chi2, dof, p_value FROM tab JOIN pv USING (feature)",
        "group_fraction", "chi2", "p_value",
    ),
)
def chi_square_audit(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").alias("region"), (F.col("c_acctbal") < 0).alias("debt"), F.lit("one").alias("flat")
    )
    return rounded(cf.chi_square(rows, ["region", "debt", "flat"], "grp"))


@query(
    "kruskal_wallis",
    r6(
        f"""WITH {CELLS}, sh AS (SELECT grp, donor_id, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY donor_id) AS fraction FROM cells GROUP BY grp, donor_id, cell_type),
    rk AS (SELECT *, rank() OVER (PARTITION BY cell_type ORDER BY fraction) + (count(*) OVER (PARTITION BY cell_type, fraction) - 1) / 2.0 AS r FROM sh),
    g AS (SELECT cell_type, grp, count(*) AS n, sum(r) AS s FROM rk GROUP BY ALL),
    t AS (SELECT cell_type, sum(k * k * k - k)::DOUBLE AS t FROM (SELECT cell_type, fraction, count(*)::DOUBLE AS k FROM sh GROUP BY ALL) GROUP BY cell_type),
    h AS (SELECT cell_type, sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) AS n_groups FROM g GROUP BY cell_type),
    f AS (SELECT cell_type, n::BIGINT AS n, n_groups, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, (n_groups - 1)::DOUBLE AS dof FROM h JOIN t USING (cell_type))
    SELECT *, exp(-h / 2) * (1 + h / 2) AS p_value FROM f""",
        "h",
        "p_value",
    ),
)
def kruskal_wallis(spark, sf):
    rows = cells(spark, sf)
    shares = dn.composition(rows).join(dn.collapse(rows, "donor_id", "grp"), "donor_id")
    return rounded(cf.kruskal(shares, "fraction", "grp", ["cell_type"]))


_COHORT = "co AS (SELECT CASE WHEN n_regionkey < 3 THEN 'dev' ELSE 'external' END AS cohort, c_acctbal, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _cohort(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    side = F.when(F.col("n_regionkey") < 3, "dev").otherwise("external")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(side.alias("cohort"), "c_acctbal", "c_mktsegment")


@query(
    "numeric_summary",
    r6(
        f"""WITH {_COHORT}, s AS (SELECT cohort, count(*)::DOUBLE AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS min,
      quantile_cont(c_acctbal, 0.5) AS median, max(c_acctbal) AS max FROM co GROUP BY cohort)
    SELECT cohort, 'c_acctbal' AS variable, category, value FROM s UNPIVOT (value FOR category IN (n, mean, sd, min, median, max))""",
        "value",
    ),
)
def numeric_summary(spark, sf):
    return rounded(cf.numeric_summary(_cohort(spark, sf), "c_acctbal", "cohort"))


@query(
    "categorical_summary",
    r6(
        f"""WITH {_COHORT} SELECT cohort, 'c_mktsegment' AS variable, c_mktsegment AS category, count(*)::DOUBLE AS n,
      100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cohort) AS pct FROM co GROUP BY cohort, c_mktsegment
    UNION ALL SELECT DISTINCT cohort, 'ethnicity', 'NOT_AVAILABLE', NULL, NULL FROM co""",
        "pct",
    ),
)
def categorical_summary(spark, sf):
    out = cf.categorical_summary(_cohort(spark, sf), ["c_mktsegment", "ethnicity"], "cohort")
    return rounded(out.withColumn("n", F.col("n").cast("double")))


# --- splits ---------------------------------------------------------------------------


def _people(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("donor_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"),
    )


_PEOPLE = """people AS (SELECT c_custkey AS donor_id, c_mktsegment AS grp, (c_mktsegment = 'BUILDING')::INTEGER AS label, c_acctbal AS balance, c_nationkey AS nation_id FROM customer)"""


@query(
    "leave_one_out_folds",
    f"WITH {_PEOPLE} SELECT donor_id, CASE WHEN n < 1000 THEN 'loocv_' || lpad(n::VARCHAR, 3, '0') ELSE 'loocv_' || n::VARCHAR END AS fold_id "
    "FROM (SELECT donor_id, row_number() OVER (ORDER BY donor_id) AS n FROM people)",
)
def leave_one_out_folds(spark, sf):
    return sp.leave_one_out(_people(spark, sf).select("donor_id"))


@query("round_robin_folds", f"WITH {_PEOPLE} SELECT donor_id, ((row_number() OVER (ORDER BY donor_id) - 1) % 5)::INTEGER AS fold FROM people")
def round_robin_folds(spark, sf):
    return sp.round_robin_kfold(_people(spark, sf).select("donor_id"), 5)


@query(
    "stratified_round_robin_folds",
    f"WITH {_PEOPLE} SELECT donor_id, grp, ((row_number() OVER (PARTITION BY grp ORDER BY donor_id) - 1) % 5)::INTEGER AS fold FROM people",
)
def stratified_round_robin_folds(spark, sf):
    return sp.round_robin_kfold(_people(spark, sf).select("donor_id", "grp"), 5, stratify="grp")


_SHUFFLED = f"""{_PEOPLE}, shuffled AS (SELECT donor_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('11|' || label || '|' || donor_id), donor_id) - 1) % 5)::INTEGER AS fold
  FROM people)"""


def _shuffled(spark, sf, *extra):
    return sp.shuffled_kfold(_people(spark, sf).select("donor_id", "label", *extra), 5, seed=11)


@query("shuffled_stratified_folds", f"WITH {_SHUFFLED} SELECT * FROM shuffled")
def shuffled_stratified_folds(spark, sf):
    return _shuffled(spark, sf)


@query(
    "fold_roles",
    f"""WITH {_SHUFFLED} SELECT donor_id, label, f AS fold_id, CASE WHEN f = fold THEN 'test' ELSE 'train' END AS role
    FROM shuffled, (SELECT unnest([0, 1, 2, 3, 4]) AS f)""",
)
def fold_roles(spark, sf):
    return sp.fold_roles(_shuffled(spark, sf), 5)


@query("split_summary", f"WITH {_SHUFFLED} SELECT fold::VARCHAR AS split, label AS label_group, count(*) AS n_donors FROM shuffled GROUP BY ALL")
def split_summary(spark, sf):
    return sp.split_summary(_shuffled(spark, sf).select(F.col("fold").cast("string").alias("split"), F.col("label").alias("label_group")))


@query("stratification_shortfalls", f"WITH {_PEOPLE} SELECT nation_id AS label, count(*) AS n FROM people GROUP BY 1 HAVING count(*) < 60")
def stratification_shortfalls(spark, sf):
    return sp.stratification_shortfalls(_people(spark, sf).drop("label").withColumnRenamed("nation_id", "label"), 60)


@query(
    "held_out_class_counts",
    f"""WITH {_PEOPLE}, t AS (SELECT grp, count(*) AS n, sum(o) AS p FROM (SELECT grp, (balance < 0)::INTEGER AS o FROM people) GROUP BY grp)
    SELECT donor_id, grp, (balance < 0)::INTEGER AS label, n - 1 AS n_train, (p - (balance < 0)::INTEGER)::BIGINT AS n_train_cases,
    (n - 1 - (p - (balance < 0)::INTEGER))::BIGINT AS n_train_controls FROM people JOIN t USING (grp)""",
)
def held_out_class_counts(spark, sf):
    rows = _people(spark, sf).select("donor_id", "grp", (F.col("balance") < 0).cast("int").alias("label"))
    return sp.loo_class_counts(rows, by=["grp"])


@query(
    "held_out_moments",
    r6(
        f"""WITH {_PEOPLE}, t AS (SELECT nation_id, count(*) - 1 AS m, sum(balance) AS s, sum(balance * balance) AS q FROM people GROUP BY 1)
    SELECT donor_id, nation_id AS feature_id, balance AS value, (s - balance) / m AS train_mean, sqrt((q - balance * balance) / m - ((s - balance) / m) * ((s - balance) / m)) AS train_sd
    FROM people JOIN t USING (nation_id)""",
        "train_mean",
        "train_sd",
    ),
)
def held_out_moments(spark, sf):
    rows = _people(spark, sf).select("donor_id", F.col("nation_id").alias("feature_id"), F.col("balance").alias("value"))
    return rounded(sp.loo_moments(rows))


@query(
    "held_out_medians",
    r6(
        f"""WITH {_PEOPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY nation_id ORDER BY balance, donor_id) AS i, count(*) OVER (PARTITION BY nation_id) AS n FROM people),
    l AS (SELECT nation_id, i, balance FROM r),
    a AS (SELECT r.donor_id, r.nation_id, r.balance, l.balance AS v FROM r JOIN l ON l.nation_id = r.nation_id
      AND l.i - (l.i > r.i)::INTEGER IN ((r.n - 2) // 2 + 1, (r.n - 1) // 2 + 1) AND l.i <> r.i)
    SELECT donor_id, nation_id, balance, avg(v) AS train_median FROM a GROUP BY ALL""",
        "train_median",
    ),
)
def held_out_medians(spark, sf):
    return rounded(sp.loo_median(_people(spark, sf).select("donor_id", "nation_id", "balance"), "balance", ["nation_id"]))


@query(
    "held_out_modes",
    f"""WITH {_PEOPLE}, c AS (SELECT nation_id, grp, count(*) AS k FROM people GROUP BY ALL),
    o AS (SELECT p.donor_id, p.nation_id, p.grp AS own, c.grp, c.k - (c.grp = p.grp)::INTEGER AS k FROM people p JOIN c USING (nation_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY k DESC, grp) AS r FROM o)
    SELECT donor_id, nation_id, own AS grp, grp AS train_mode, (SELECT k > 1 FROM c WHERE c.nation_id = b.nation_id AND c.grp = b.own) AS category_in_train FROM b WHERE r = 1""",
)
def held_out_modes(spark, sf):
    return sp.loo_mode(_people(spark, sf).select("donor_id", "nation_id", "grp"), "grp", ["nation_id"])


_ROLES = f"""{_PEOPLE}, roles AS (SELECT p.donor_id, p.grp, p.balance, f AS fold_id, CASE WHEN f = fold THEN 'test' ELSE 'train' END AS role
  FROM (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5('11|' || label || '|' || donor_id), donor_id) - 1) % 5)::INTEGER AS fold FROM people) p,
  (SELECT unnest([0, 1, 2, 3, 4]) AS f))"""


def _roles(spark, sf):
    return sp.fold_roles(_shuffled(spark, sf, "grp", "balance"), 5)


@query(
    "fold_imputers",
    r6(
        f"""WITH {_ROLES}, tr AS (SELECT * FROM roles WHERE role = 'train'),
    m AS (SELECT fold_id, grp, row_number() OVER (PARTITION BY fold_id ORDER BY count(*) DESC, grp) AS r FROM tr GROUP BY fold_id, grp)
    SELECT fold_id, 'balance' AS "column", quantile_cont(balance, 0.5) AS median, NULL::VARCHAR AS mode FROM tr GROUP BY fold_id
    UNION ALL SELECT fold_id, 'grp', NULL, grp FROM m WHERE r = 1""",
        "median",
    ),
)
def fold_imputers(spark, sf):
    return rounded(md.fold_imputers(_roles(spark, sf), ["balance"], ["grp"]))


@query(
    "fold_one_hot",
    f"""WITH {_ROLES} SELECT fold_id, grp, role, count(*) AS n, sum(1.0)::DOUBLE AS indicator_sum FROM roles r
    WHERE EXISTS (SELECT 1 FROM roles t WHERE t.fold_id = r.fold_id AND t.role = 'train' AND t.grp = r.grp) GROUP BY ALL""",
)
def fold_one_hot(spark, sf):
    return md.one_hot(_roles(spark, sf), "grp").groupBy("fold_id", "grp", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("indicator").alias("indicator_sum")
    )


@query(
    "fold_standardized",
    r6(
        f"""WITH {_ROLES}, s AS (SELECT fold_id, avg(balance) FILTER (role = 'train') AS m, stddev_pop(balance) FILTER (role = 'train') AS d FROM roles GROUP BY fold_id)
    SELECT donor_id, fold_id, role, (balance - m) / d AS z FROM roles JOIN s USING (fold_id)""",
        "z",
    ),
)
def fold_standardized(spark, sf):
    rows = _roles(spark, sf).withColumn("feature_id", F.lit("balance"))
    z = md.standardize(rows, F.col("role") == "train", value="balance", by=["fold_id"])
    return rounded(z.select("donor_id", "fold_id", "role", "z"))


# --- resampling -------------------------------------------------------------------------

BOOT, PERM = 5000, 1000  # replicates of the published analysis


def _mix_sql(x: str) -> str:
    """The 32-bit finaliser of ``multinomial`` on a UBIGINT."""
    a = f"((xor({x}, {x} >> 16) * 2246822507) & 4294967295)"
    b = f"((xor({a}, {a} >> 13) * 3266489909) & 4294967295)"
    return f"xor({b}, {b} >> 16)"


def _lane_sql(seed: int, lane: int) -> str:
    start = _mix_sql(f"{lane ^ seed}::UBIGINT")
    return f"list_reduce([stratum::UBIGINT, replicate::UBIGINT, lo::UBIGINT, hi::UBIGINT], lambda h, k: {_mix_sql('xor(h, k)')}, {start})"


_BINOMIAL = """list_reduce(list_transform(range(0, m + 1), lambda i: {'c': exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(p) + (m - i) * ln(1 - p)), 'k': 0}),
  lambda s, e: {'c': s.c + e.c, 'k': s.k + (s.c + e.c <= u)::INT}, {'c': 0.0::DOUBLE, 'k': 0}).k"""


def _weights_sql(seed: int, by: str = "") -> str:
    """Ranks halved down to single rows of ``ix (i, n)``: how often each replicate draws every row."""
    group = f"{by}, " if by else ""
    stratum = f"('0x' || substr(md5({by}::VARCHAR), 1, 8))::BIGINT" if by else "0"
    return f"""sizes AS (SELECT {group}any_value(n) AS n, {stratum} AS stratum FROM ix {f'GROUP BY {by}' if by else ''}),
    tree AS (SELECT {group}stratum, r AS replicate, 0::BIGINT AS lo, n AS hi, n AS m FROM sizes, range(0, {BOOT}) t(r)
      UNION ALL SELECT {group}stratum, replicate, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN k ELSE m - k END FROM (
        SELECT *, least(m, CASE WHEN m = 1 THEN (u >= 1 - p)::INT ELSE {_BINOMIAL} END) AS k FROM (
          SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) / (hi - lo)::DOUBLE AS p,
            ({_lane_sql(seed, 0)} * 1048576 + ({_lane_sql(seed, 0x9747B28C)} >> 12)) / 4503599627370496::DOUBLE AS u
          FROM tree WHERE hi - lo > 1 AND m > 0)), (VALUES (0), (1)) sides(side)),
    draws AS (SELECT {group}replicate, lo AS i, unnest(range(0, m)) AS again FROM tree WHERE hi - lo = 1 AND m > 0)"""


def _boot_sql(label: str, scores: dict[str, str], by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    group = f"{by}, " if by else ""
    arms = " UNION ALL ".join(f"SELECT {group}replicate, '{arm}' AS arm, label, {s}::DOUBLE AS score FROM drawn" for arm, s in scores.items())
    return f"""{PREDICTIONS}, ix AS (SELECT *, {label} AS y, row_number() OVER ({part}ORDER BY {', '.join(scores.values())}, {label}) - 1 AS i, count(*) OVER ({part}) AS n FROM predictions),
    {_weights_sql(5, by)},
    drawn AS (SELECT {'d.' + by + ', ' if by else ''}d.replicate, ix.y AS label, ix.n_chars, ix.toxic, ix.score FROM draws d JOIN ix ON ix.i = d.i {f'AND ix.{by} = d.{by}' if by else ''}),
    armed AS ({arms}),
    boot AS ({_auroc_sql('armed', 'score', 'label', group + 'arm, replicate')})"""


_TWO = {"n_chars": "n_chars", "rank_noise": "(n_chars * 7919) % 1009"}


def _two_arms(spark, sf):
    return predictions(spark, sf).withColumn("rank_noise", (F.col("n_chars") * 7919) % 1009)


_INTERVAL = """quantile_cont(auroc, 0.025) AS ci_lower, quantile_cont(auroc, 0.975) AS ci_upper, avg(auroc) AS boot_mean, count(auroc) AS n_valid,
  count(*) FILTER (auroc IS NULL) AS n_skipped"""


@query(
    "bootstrap_auroc_interval",
    r6(f"WITH RECURSIVE {_boot_sql('label', {'score': 'score'})} SELECT arm, {_INTERVAL} FROM boot GROUP BY arm", "ci_lower", "ci_upper", "boot_mean"),
)
def bootstrap_auroc_interval(spark, sf):
    reps = rs.bootstrap_auroc(predictions(spark, sf), ["score"], key="doc_id", n=BOOT, seed=5)
    return rounded(rs.bootstrap_interval(reps))


@query(
    "stratified_bootstrap",
    r6(f"WITH RECURSIVE {_boot_sql('toxic', {'n_chars': 'n_chars'}, 'lang')} SELECT lang, {_INTERVAL} FROM boot GROUP BY lang", "ci_lower", "ci_upper", "boot_mean"),
)
def stratified_bootstrap(spark, sf):
    reps = rs.bootstrap_auroc(predictions(spark, sf), ["n_chars"], "toxic", "doc_id", BOOT, 5, ["lang"])
    return rounded(rs.bootstrap_interval(reps, by=["lang"]))


_PAIRED_BOOT = f"""{_boot_sql('label', _TWO)}, d AS (SELECT replicate, max(auroc) FILTER (arm = 'n_chars') - max(auroc) FILTER (arm = 'rank_noise') AS auroc FROM boot GROUP BY replicate)"""


def _paired_boot(spark, sf):
    reps = rs.bootstrap_auroc(_two_arms(spark, sf), ["n_chars", "rank_noise"], key="doc_id", n=BOOT, seed=5)
    diff = rs.paired_difference(reps, "n_chars", "rank_noise")
    return rs.bootstrap_interval(diff, "diff", by=[])


@query("paired_bootstrap_difference", r6(f"WITH RECURSIVE {_PAIRED_BOOT} SELECT {_INTERVAL} FROM d", "ci_lower", "ci_upper", "boot_mean"))
def paired_bootstrap_difference(spark, sf):
    return rounded(_paired_boot(spark, sf))


def _perm_sql(label: str, scores: dict[str, str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r_{arm}" for arm, s in scores.items()
    )
    arms = " UNION ALL ".join(
        f"SELECT replicate, '{arm}' AS arm, (s_{arm} - p * (p + 1) / 2.0) / (p * (n - p))::DOUBLE AS auroc FROM sums" for arm in scores
    )
    seen = " UNION ALL ".join(f"SELECT '{arm}' AS arm, auroc FROM ({_auroc_sql('predictions', s, label)})" for arm, s in scores.items())
    sums = ", ".join(f"sum(r_{arm}) AS s_{arm}" for arm in scores)
    return f"""{PREDICTIONS}, ranked AS (SELECT doc_id, {ranks} FROM predictions), k AS (SELECT sum({label}) AS p, count(*) AS n FROM predictions),
    pick AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY md5('9|' || replicate || '|' || doc_id), doc_id) AS pos FROM (SELECT ranked.*, r AS replicate FROM ranked, range(0, {PERM}) t(r))),
    sums AS (SELECT replicate, p, n, {sums} FROM pick, k WHERE pos <= p GROUP BY replicate, p, n), nul AS ({arms}), seen AS ({seen})"""


_SUMMARY = """count(*) AS n_permutations, count(auroc) AS n_valid, avg(auroc) AS null_mean, stddev_pop(auroc) AS null_std, min(auroc) AS null_min, max(auroc) AS null_max,
  (1.0 + count(*) FILTER ({x})) / (1.0 + count(auroc)) AS p_value, abs(avg(auroc) - {c}) < 0.05 AS null_mean_near_centre"""
_P_COLS = ("observed", "null_mean", "null_std", "null_min", "null_max", "p_value")
_EPS = "1e-12"


def _perm(spark, sf, label="toxic"):
    rows = _two_arms(spark, sf).drop("label").withColumnRenamed(label, "label") if label != "label" else _two_arms(spark, sf)
    null = rs.permutation_auroc(rows, ["n_chars", "rank_noise"], key="doc_id", n=PERM, seed=9)
    arm = lambda s: mt.auroc(rows, s).select(F.lit(s).alias("arm"), "auroc")
    return null, arm("n_chars").unionByName(arm("rank_noise"))


@query(
    "permutation_test_two_sided",
    r6(
        f"WITH {_perm_sql('toxic', _TWO)} SELECT arm, s.auroc AS observed, n.* EXCLUDE (arm) FROM seen s JOIN (SELECT arm, "
        + _SUMMARY.format(x="abs(auroc - 0.5) >= abs(obs - 0.5)", c="0.5")
        + " FROM (SELECT nul.*, seen.auroc AS obs FROM nul JOIN seen USING (arm)) GROUP BY arm) n USING (arm)",
        *_P_COLS,
    ),
)
def permutation_test_two_sided(spark, sf):
    null, observed = _perm(spark, sf)
    return rounded(rs.permutation_summary(null, observed))


@query(
    "permutation_test_upper",
    r6(
        f"WITH {_perm_sql('label', _TWO)} SELECT arm, s.auroc AS observed, n.* EXCLUDE (arm) FROM seen s JOIN (SELECT arm, "
        + _SUMMARY.format(x="auroc >= obs", c="0.5").replace("stddev_pop", "stddev_samp")
        + " FROM (SELECT nul.*, seen.auroc AS obs FROM nul JOIN seen USING (arm)) GROUP BY arm) n USING (arm)",
        *_P_COLS,
    ),
)
def permutation_test_upper(spark, sf):
    null, observed = _perm(spark, sf, "label")
    return rounded(rs.permutation_summary(null, observed, alternative="greater", ddof=1))


_PAIRED_PERM = f"""{_perm_sql('toxic', _TWO)}, dn AS (SELECT replicate, max(auroc) FILTER (arm = 'n_chars') - max(auroc) FILTER (arm = 'rank_noise') AS auroc FROM nul GROUP BY replicate),
  ds AS (SELECT max(auroc) FILTER (arm = 'n_chars') - max(auroc) FILTER (arm = 'rank_noise') AS obs FROM seen)"""


def _paired_perm(spark, sf):
    null, observed = _perm(spark, sf)
    diff = rs.paired_difference(null, "n_chars", "rank_noise")
    seen = rs.paired_difference(observed.withColumn("replicate", F.lit(0)), "n_chars", "rank_noise").drop("replicate")
    return rs.permutation_summary(diff, seen, "diff", by=[], alternative="difference")


@query(
    "paired_permutation_test",
    r6(
        f"WITH {_PAIRED_PERM} SELECT obs AS observed, s.* FROM ds, (SELECT " + _SUMMARY.format(x="abs(auroc) >= abs(obs)", c="0") + " FROM dn, ds) s",
        *_P_COLS,
    ),
)
def paired_permutation_test(spark, sf):
    return rounded(_paired_perm(spark, sf))


@query(
    "null_histogram",
    f"""WITH {_perm_sql('toxic', _TWO)} SELECT arm, least(floor(auroc / 0.025), 39)::INTEGER AS bin, count(*) AS n, least(floor(auroc / 0.025), 39) * 0.025::DOUBLE AS bin_start FROM nul GROUP BY ALL""",
)
def null_histogram(spark, sf):
    null, _ = _perm(spark, sf)
    return mt.histogram(null, "auroc", 0.0, 1.0, 40, ["arm"])


# Tests for the step-down procedure: one sign-test-like p-value per nation from its customers' balances.
_TESTS = """tests AS (SELECT n_name AS test, round(exp(-abs(avg(c_acctbal) - 4500) * sqrt(count(*)) / 3000), 6) AS p_value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)"""
_HOLM = f"""{_TESTS}, st AS (SELECT *, rank() OVER (ORDER BY p_value) AS step, count(*) OVER () AS m FROM tests), th AS (SELECT *, 0.5 / (m - step + 1) AS threshold FROM st),
  sp AS (SELECT min(p_value) FILTER (p_value > threshold) AS stop FROM th),
  holm AS (SELECT test, p_value, step, threshold::DOUBLE AS threshold, stop IS NULL OR p_value < stop AS significant,
    CASE WHEN stop IS NULL OR p_value < stop THEN 'p <= threshold: significant' WHEN p_value = stop THEN 'p > threshold: stop' ELSE 'not reached: an earlier step stopped' END AS reason FROM th, sp)"""


def _tests(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    size = F.abs(F.avg("c_acctbal") - 4500) * F.sqrt(F.count(F.lit(1))) / 3000
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("test")).agg(F.round(F.exp(-size), 6).alias("p_value"))


@query("holm_step_down", r6(f"WITH {_HOLM} SELECT * FROM holm", "threshold"))
def holm_step_down(spark, sf):
    return rounded(rs.holm(_tests(spark, sf), alpha=0.5))


@query(
    "go_decision",
    r6(
        f"""WITH {_HOLM}, ci AS (SELECT n_name AS test, quantile_cont(c_acctbal, 0.025) + 1000 AS ci_lower FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT holm.*, ci_lower, CASE WHEN ci_lower > 0 AND significant THEN 'GO' ELSE 'REJECTED' END AS decision FROM holm JOIN ci USING (test)""",
        "threshold",
        "ci_lower",
    ),
)
def go_decision(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    ci = quantiles(c.join(n, c.c_nationkey == n.n_nationkey).withColumnRenamed("n_name", "test"), "c_acctbal", [0.025], ["test"])
    ci = ci.select("test", (F.col("q0") + 1000).alias("ci_lower"))
    return rounded(rs.decide(ci, rs.holm(_tests(spark, sf), alpha=0.5)))




@query(
    "matched_gene_sets",
    """WITH t AS (SELECT p_brand AS plan_id, p_partkey AS gene_id FROM part), s AS (SELECT plan_id, count(*) AS k FROM t GROUP BY 1),
    pool AS (SELECT plan_id, c AS control_index, p_partkey AS gene_id, k FROM part, s, range(1, 4) r(c) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.plan_id = s.plan_id AND t.gene_id = p_partkey)),
    r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, control_index ORDER BY md5('3|' || plan_id || '|' || control_index || '|' || gene_id), gene_id) AS pos FROM pool)
    SELECT plan_id, control_index::INTEGER AS control_index, gene_id FROM r WHERE pos <= k""",
)
def matched_gene_sets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("plan_id"), F.col("p_partkey").alias("gene_id"))
    return rs.matched_sets(p, p, 3, 3)


@query(
    "random_set_summary",
    r6(
        """WITH s AS (SELECT c_mktsegment AS plan_id, o_orderstatus = 'F' AS t, o_orderpriority AS c, o_totalprice - 250000 AS v FROM orders JOIN customer ON c_custkey = o_custkey),
    tm AS (SELECT plan_id, avg(v) AS target_mean FROM s WHERE t GROUP BY 1), rm AS (SELECT plan_id, c, avg(v) AS m FROM s WHERE NOT t GROUP BY ALL)
    SELECT plan_id, target_mean, avg(m) AS random_mean, stddev_samp(m) AS random_sd, count(*) AS n_random, (1.0 + count(*) FILTER (abs(m) >= abs(target_mean))) / (1.0 + count(*)) AS p_value
    FROM rm JOIN tm USING (plan_id) GROUP BY plan_id, target_mean""",
        "target_mean", "random_mean", "random_sd", "p_value",
    ),
)
def random_set_summary(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("plan_id"), (F.col("o_orderstatus") == "F").alias("is_target"), F.col("o_orderpriority").alias("control_index"),
        (F.col("o_totalprice") - 250000).alias("score_shift"),
    )
    return rounded(rs.control_summary(rows))


@query(
    "best_hyperparameter",
    r6(
        """WITH m AS (SELECT l_returnflag AS arm, l_tax AS c, avg(l_discount) AS s FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY s DESC, c) AS i FROM m) SELECT arm, c, s AS score FROM r WHERE i = 1""",
        "score",
    ),
)
def best_hyperparameter(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_tax").alias("c"), F.col("l_discount").alias("score"))
    return rounded(md.best_c(rows, ["arm"]))


@query("frozen_hyperparameter", r6("SELECT l_returnflag AS arm, quantile_cont(l_tax, 0.5) AS c_frozen FROM lineitem GROUP BY 1", "c_frozen"))
def frozen_hyperparameter(spark, sf):
    return rounded(md.frozen_c(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_tax").alias("c")), ["arm"]))


@query(
    "repeat_summary",
    r6(
        """SELECT arm, count(*) AS n_repeats, avg(a) AS mean, stddev_samp(a) AS sd, min(a) AS min, max(a) AS max FROM (
    SELECT l_returnflag AS arm, l_suppkey, avg(l_discount) AS a FROM lineitem GROUP BY ALL) GROUP BY arm""",
        "mean", "sd", "min", "max",
    ),
)
def repeat_summary(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), "l_suppkey").agg(F.avg("l_discount").alias("auroc"))
    return rounded(md.repeated_summary(rows))


@query(
    "coefficient_ranks",
    """WITH w AS (SELECT p_brand AS feature_id, round(avg(l_quantity) - 25.5, 6) AS coefficient FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT feature_id, coefficient, rank() OVER (ORDER BY abs(coefficient) DESC) AS coefficient_rank,
    CASE WHEN coefficient > 0 THEN 'increases' WHEN coefficient < 0 THEN 'decreases' ELSE 'none' END AS direction FROM w""",
)
def coefficient_ranks(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    w = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("feature_id")).agg(F.round(F.avg("l_quantity") - 25.5, 6).alias("coefficient"))
    return md.rank_coefficients(w)


_VEC = """w AS (SELECT vec_id, y AS label, embedding, (row_number() OVER (PARTITION BY y ORDER BY md5('2|' || y || '|' || vec_id), vec_id) - 1) % 5 AS part
    FROM (SELECT *, (label < 5)::INTEGER AS y FROM embeddings)),
  x AS (SELECT vec_id, label, part, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM w)"""


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("donor_id"), (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").alias("features")
    )
    return sp.shuffled_kfold(rows, 5, seed=2).withColumnRenamed("fold", "part")


@query(
    "centroid_model",
    r6(f"WITH {_VEC} SELECT label, pos, avg(v) AS value, count(*) AS n_train FROM x WHERE part < 4 GROUP BY ALL", "value"),
)
def centroid_model(spark, sf):
    model = md.fit_centroids(_vectors(spark, sf).where(F.col("part") < 4))
    flat = model.select("label", "n_train", F.posexplode("centroid").alias("pos", "value"))
    return rounded(flat.withColumn("pos", F.col("pos").cast("bigint")))


@query(
    "centroid_predictions",
    r6(
        f"""WITH {_VEC}, c AS (SELECT label AS lab, pos, avg(v) AS m FROM x WHERE part < 4 GROUP BY ALL),
    d AS (SELECT vec_id, label, lab, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (pos) WHERE part = 4 GROUP BY ALL),
    s AS (SELECT vec_id, label, arg_min(lab, (d, lab)) AS predicted_label, sum(1 / (d + 1)) FILTER (lab = 1) / sum(1 / (d + 1)) AS score FROM d GROUP BY ALL)
    SELECT vec_id AS donor_id, label, predicted_label, score FROM s""",
        "score",
    ),
)
def centroid_predictions(spark, sf):
    rows = _vectors(spark, sf)
    out = md.predict_centroids(md.fit_centroids(rows.where(F.col("part") < 4)), rows.where(F.col("part") == 4), 1)
    return rounded(out.select("donor_id", "label", "predicted_label", "score"))


_DOC_ARMS = """docs AS (SELECT d.doc_id, quality AS label, n_chars, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, len(regexp_split_to_array(text, '\\s+')) AS words
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  arms AS (SELECT doc_id, label, 'n_chars' AS arm, n_chars::DOUBLE AS score FROM docs UNION ALL SELECT doc_id, label, 'capitals', capitals FROM docs UNION ALL SELECT doc_id, label, 'words', words FROM docs)"""
_PAIRS = "pairs(test, a, b) AS (VALUES ('chars_vs_capitals', 'n_chars', 'capitals'), ('chars_vs_words', 'n_chars', 'words'))"
_CO_PRIMARY = f"""{_DOC_ARMS}, {_PAIRS},
  ix AS (SELECT doc_id, label, row_number() OVER (ORDER BY capitals, n_chars, words, label) - 1 AS i, count(*) OVER () AS n FROM docs),
  {_weights_sql(5)},
  drawn AS (SELECT d.replicate, arm, x.label, score FROM draws d JOIN ix USING (i) JOIN arms x USING (doc_id)),
  boot AS ({_auroc_sql('drawn', 'score', 'label', 'arm, replicate')}),
  seen AS ({_auroc_sql('arms', 'score', 'label', 'arm')}),
  rk AS (SELECT doc_id, arm, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2.0 AS r FROM arms),
  k AS (SELECT sum(label) AS p, count(*) AS n FROM docs),
  pick AS (SELECT doc_id, r AS replicate, row_number() OVER (PARTITION BY r ORDER BY md5('5|' || r || '|' || doc_id), doc_id) AS pos FROM docs, range(0, {PERM}) t(r)),
  nul AS (SELECT arm, replicate, (sum(r) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p)))::DOUBLE AS auroc FROM pick, k, rk WHERE pick.pos <= k.p AND rk.doc_id = pick.doc_id GROUP BY ALL),
  ci AS (SELECT test, quantile_cont(x.auroc - y.auroc, 0.025) AS ci_lower, quantile_cont(x.auroc - y.auroc, 0.975) AS ci_upper, avg(x.auroc - y.auroc) AS boot_mean,
    count(x.auroc - y.auroc) AS n_valid, count(*) FILTER (x.auroc - y.auroc IS NULL) AS n_skipped
    FROM pairs JOIN boot x ON x.arm = a JOIN boot y ON y.arm = b AND y.replicate = x.replicate GROUP BY test),
  ob AS (SELECT test, x.auroc - y.auroc AS observed FROM pairs JOIN seen x ON x.arm = a JOIN seen y ON y.arm = b),
  pm AS (SELECT test, observed, avg(x.auroc - y.auroc) AS null_mean, stddev_pop(x.auroc - y.auroc) AS null_std,
    (1.0 + count(*) FILTER (abs(x.auroc - y.auroc) >= abs(observed))) / (1.0 + count(*)) AS p_value
    FROM pairs JOIN ob USING (test) JOIN nul x ON x.arm = a JOIN nul y ON y.arm = b AND y.replicate = x.replicate GROUP BY ALL),
  st AS (SELECT *, rank() OVER (ORDER BY p_value) AS step, 0.05 / (3 - rank() OVER (ORDER BY p_value)) AS threshold FROM pm),
  sp AS (SELECT min(p_value) FILTER (p_value > threshold) AS stop FROM st),
  fin AS (SELECT st.*, ci.* EXCLUDE (test), stop IS NULL OR p_value < stop AS significant,
    CASE WHEN stop IS NULL OR p_value < stop THEN 'p <= threshold: significant' WHEN p_value = stop THEN 'p > threshold: stop' ELSE 'not reached: an earlier step stopped' END AS reason
    FROM st JOIN ci USING (test), sp)"""


@query(
    "co_primary_comparison",
    r6(
        f"WITH RECURSIVE {_CO_PRIMARY} SELECT *, CASE WHEN ci_lower > 0 AND significant THEN 'GO' ELSE 'REJECTED' END AS decision FROM fin",
        "observed", "p_value", "null_mean", "null_std", "ci_lower", "ci_upper", "boot_mean", "threshold",
    ),
)
def co_primary_comparison(spark, sf):
    """Three scores of the labelled documents against each other: paired intervals, tests, Holm, decisions."""
    from donorlake.plans import arms

    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("capitals"), F.size(F.split("text", r"\s+")).alias("words"))
    rows = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("donor_id"), F.col("quality").alias("label"), "n_chars", "capitals", "words")
    pairs = [("chars_vs_capitals", "n_chars", "capitals"), ("chars_vs_words", "n_chars", "words")]
    return rounded(arms.co_primary(rows, pairs, 5, n_bootstrap=BOOT, n_permutations=PERM))
