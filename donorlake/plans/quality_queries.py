"""Queries: cell and gene quality, neighbours, and every row-level check.

The rows to check are derived from the driver tables by expressions that both
engines read, so each check meets violations as well as clean rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.functions.columns import rounded
from donorlake.operators import catalogs as cat
from donorlake.operators import cellqc as qc
from donorlake.operators import checks as ck
from donorlake.operators import donors as dn
from donorlake.operators import models as md
from donorlake.operators import splits as sp
from donorlake.operators import subspace
from donorlake.plans.registry import CELLS, COUNTS, GENES, PREDICTIONS, cells, counts, genes, predictions, query, r6, table
from donorlake.session import durable

SUMS = f"{COUNTS}, sums AS (SELECT cell_id, gene_id, sum(value) AS value FROM counts GROUP BY cell_id, gene_id)"
MITO = "g AS (SELECT gene_id, gene_symbol LIKE 'PROMO-%' AS is_mito FROM genes)"


def _sums(spark, sf):
    return qc.cell_gene_sums(counts(spark, sf))


def _mito(spark, sf):
    return qc.mito_genes(genes(spark, sf), prefix="promo-")


_METRICS = """SELECT cell_id, count(*) FILTER (value > 0) AS n_genes_by_counts, sum(value) AS total_counts,
  CASE WHEN sum(value) > 0 THEN 100.0 * coalesce(sum(value) FILTER (is_mito), 0) / sum(value) ELSE 0 END AS pct_counts_mt FROM {src} JOIN g USING (gene_id) GROUP BY cell_id"""


@query("cell_quality_metrics", r6(f"WITH {SUMS}, {GENES}, {MITO} {_METRICS.format(src='sums')}", "pct_counts_mt"))
def cell_quality_metrics(spark, sf):
    return rounded(qc.cell_metrics(_sums(spark, sf), _mito(spark, sf)))


@query("cells_per_gene", f"WITH {SUMS} SELECT gene_id, count(*) FILTER (value > 0) AS n_cells FROM sums GROUP BY 1")
def cells_per_gene(spark, sf):
    return qc.cells_per_gene(_sums(spark, sf))


_QC = f"""{SUMS}, {GENES}, {MITO}, k1 AS (SELECT * FROM sums WHERE cell_id IN (SELECT cell_id FROM sums GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)),
  k2 AS (SELECT * FROM k1 WHERE gene_id IN (SELECT gene_id FROM k1 GROUP BY 1 HAVING count(*) >= 20)),
  m AS (SELECT * FROM ({_METRICS.format(src='k2')}) WHERE pct_counts_mt < 20)"""


def _qc(spark, sf):
    return qc.qc_filter(_sums(spark, sf), _mito(spark, sf), 2, 6, 20, 20.0)


@query("quality_filtered_cells", r6(f"WITH {_QC} SELECT * FROM m", "pct_counts_mt"))
def quality_filtered_cells(spark, sf):
    return rounded(_qc(spark, sf)[1])


@query(
    "quality_summary",
    f"""WITH {_QC}, kept AS (SELECT * FROM k2 WHERE cell_id IN (SELECT cell_id FROM m)) SELECT 'before' AS stage, 'cells' AS what, count(*) AS n FROM orders
    UNION ALL SELECT 'before', 'genes', count(*) FROM part UNION ALL SELECT 'after', 'cells', count(DISTINCT cell_id) FROM kept UNION ALL SELECT 'after', 'genes', count(DISTINCT gene_id) FROM kept""",
)
def quality_summary(spark, sf):
    return qc.qc_summary(table(spark, sf, "orders"), genes(spark, sf), _qc(spark, sf)[0])


@query(
    "quality_by_sample",
    r6(
        f"""WITH {CELLS}, {SUMS}, {GENES}, {MITO}, m AS ({_METRICS.format(src='sums')})
    SELECT nation_id, count(*) AS n_cells, avg((batch = 'P')::INTEGER) AS doublet_rate, quantile_cont(n_genes_by_counts, 0.5)::DOUBLE AS median_n_genes_by_counts,
    quantile_cont(total_counts, 0.5) AS median_total_counts, quantile_cont(pct_counts_mt, 0.5) AS median_pct_counts_mt FROM cells JOIN m USING (cell_id) GROUP BY nation_id""",
        "doublet_rate", "median_pct_counts_mt",
    ),
)
def quality_by_sample(spark, sf):
    rows = cells(spark, sf).withColumn("is_doublet", F.col("batch") == "P")
    return rounded(qc.qc_by_sample(rows, qc.cell_metrics(_sums(spark, sf), _mito(spark, sf)), "nation_id", "is_doublet"))


@query("label_distribution", f"WITH {CELLS} SELECT nation_id, batch, count(*) AS n FROM cells GROUP BY ALL")
def label_distribution(spark, sf):
    out = qc.distribution(cells(spark, sf), "nation_id", "batch")
    return out.select("nation_id", F.explode("batch_distribution").alias("batch", "n"))


@query(
    "schema_audit",
    r6(
        f"""WITH {CELLS}, p AS (SELECT donor_id, count(*) AS n, min(grp) AS g FROM cells GROUP BY 1) SELECT sum(n)::BIGINT AS n_obs, count(*) AS n_patients,
    min(n) AS min_cells_per_patient, max(n) AS max_cells_per_patient, avg(n) AS mean_cells_per_patient, count(DISTINCT g) AS n_groups, (SELECT count(*) FROM part) AS n_vars FROM p""",
        "mean_cells_per_patient",
    ),
)
def schema_audit(spark, sf):
    return rounded(qc.schema_audit(cells(spark, sf), genes(spark, sf), "donor_id", "grp"))


_NORM = f"""{SUMS}, norm AS (SELECT cell_id, gene_id, value, value * 1e4 / sum(value) OVER (PARTITION BY cell_id) AS normalized FROM sums)"""


@query("normalized_counts", r6(f"WITH {_NORM} SELECT *, ln(1 + normalized) AS log_normalized FROM norm", "normalized", "log_normalized"))
def normalized_counts(spark, sf):
    return rounded(qc.normalize_log1p(_sums(spark, sf)))


_HVG = f"""{_NORM}, n AS (SELECT count(*) AS n FROM orders), s AS (SELECT gene_id, sum(normalized) / n AS mean, (sum(normalized * normalized) - n * pow(sum(normalized) / n, 2)) / (n - 1) AS variance
    FROM norm, n GROUP BY gene_id, n), d AS (SELECT *, ln(1 + mean) AS log_mean, ln(variance / mean) AS dispersion FROM s),
  e AS (SELECT min(log_mean) AS lo, max(log_mean) AS hi FROM d),
  b AS (SELECT d.*, least(greatest(ceil((log_mean - lo) / ((hi - lo) / 20)) - 1, 0), 19)::INTEGER AS bin FROM d, e),
  z AS (SELECT bin, avg(dispersion) AS m, stddev_samp(dispersion) AS sd FROM b GROUP BY bin),
  f AS (SELECT b.*, CASE WHEN sd IS NULL THEN 1.0 ELSE (dispersion - m) / sd END AS dispersion_norm FROM b JOIN z USING (bin)),
  hv AS (SELECT *, row_number() OVER (ORDER BY dispersion_norm DESC, gene_id) <= 500 AS highly_variable FROM f)"""


@query("highly_variable_genes", r6(f"WITH {_HVG} SELECT * FROM hv", "mean", "variance", "log_mean", "dispersion", "dispersion_norm"))
def highly_variable_genes(spark, sf):
    n = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(qc.highly_variable(qc.gene_dispersion(qc.normalize_log1p(_sums(spark, sf)), n), 500))


_MEDIANS = f"{_NORM}, med AS (SELECT gene_id, quantile_cont(normalized, 0.5) AS median FROM norm GROUP BY gene_id)"


@query("gene_medians", r6(f"WITH {_MEDIANS} SELECT * FROM med", "median"))
def gene_medians(spark, sf):
    return rounded(qc.gene_medians(_sums(spark, sf)))


@query(
    "rank_tokens",
    f"""WITH {_MEDIANS}, r AS (SELECT cell_id, gene_id, row_number() OVER (PARTITION BY cell_id ORDER BY value / median DESC, gene_id)::INTEGER AS position FROM sums JOIN med USING (gene_id))
    SELECT * FROM r WHERE position <= 3""",
)
def rank_tokens(spark, sf):
    return qc.rank_tokens(_sums(spark, sf), qc.gene_medians(_sums(spark, sf)), max_len=3)


@query(
    "token_embeddings",
    r6(
        f"""WITH {CELLS}, {SUMS}, t AS (SELECT cell_id, avg(gene_id) AS a, count(*)::DOUBLE AS b FROM sums WHERE value > 0 GROUP BY 1),
    m AS (SELECT nation_id AS donor_id, count(*) AS n_cells, avg(a) AS a, avg(b) AS b FROM t JOIN cells USING (cell_id) GROUP BY 1)
    SELECT donor_id, n_cells, 0 AS pos, a AS value FROM m UNION ALL SELECT donor_id, n_cells, 1, b FROM m""",
        "value",
    ),
)
def token_embeddings(spark, sf):
    """Tokens of every cell through a stand-in model (mean and length of the token ids), then pooled per donor."""
    tokens = qc.token_sequences(qc.rank_tokens(_sums(spark, sf), qc.gene_medians(_sums(spark, sf))))
    tagged = tokens.join(cells(spark, sf).select("cell_id", F.col("nation_id").alias("donor_id")), "cell_id")
    model = lambda seqs: [(float(sum(t)) / len(t), float(len(t))) for t in seqs]
    pooled = dn.mean_pool(qc.embed(tagged, model, ("cell_id", "donor_id")))
    return rounded(pooled.select("donor_id", "n_cells", F.posexplode("embedding").alias("pos", "value")))


_KNN = """v AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS e, label FROM embeddings),
  p AS (SELECT a.cell_id, b.cell_id AS neighbor, list_distance(a.e, b.e) AS distance, b.label FROM v a JOIN v b ON a.cell_id <> b.cell_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbor)::INTEGER AS rank FROM p)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "cell_id")


@query("nearest_neighbors", r6(f"WITH {_KNN} SELECT cell_id, neighbor, distance, rank FROM r WHERE rank <= 5", "distance"))
def nearest_neighbors(spark, sf):
    v = _vectors(spark, sf)
    return rounded(qc.knn(v, v, 5, exclude_self=True))


@query(
    "label_transfer",
    r6(
        f"""WITH {_KNN}, q AS (SELECT cell_id, label, count(*) AS k FROM r WHERE rank <= 5 GROUP BY ALL),
    w AS (SELECT cell_id, label, k / sum(k) OVER (PARTITION BY cell_id) AS vote_share, row_number() OVER (PARTITION BY cell_id ORDER BY k DESC, label) AS i FROM q)
    SELECT cell_id, label, vote_share FROM w WHERE i = 1""",
        "vote_share",
    ),
)
def label_transfer(spark, sf):
    v = _vectors(spark, sf)
    return rounded(qc.label_transfer(qc.knn(v, v, 5, exclude_self=True), v))


@query(
    "principal_component_checks",
    r6(
        """SELECT unnest(range(1, 9))::INT AS component, count(*) AS n_rows, sum(v) AS total_variance, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS variance_gap, 0.0::DOUBLE AS cross_covariance, true AS sign_rule
        FROM (SELECT unnest(range(0, 64)) AS pos, (SELECT count(*) FROM embeddings) AS n) p
        JOIN (SELECT pos AS q, var_samp(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY pos) ON q = pos""".replace(
            "count(*) AS n_rows", "any_value(n) AS n_rows"
        ),
        "total_variance", "residual", "variance_gap", "cross_covariance",
    ),
)
def principal_component_checks(spark, sf):
    """Eight components: distance from being eigenvectors, variance of the scores beside the eigenvalue, covariance between scores."""
    v = _vectors(spark, sf)
    found = subspace.fit(v, 8)
    rows = durable(subspace.scores(v, found).select("embedding", "components"))
    at = lambda i: F.col("components")[i]
    cov = rows.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(at(i), at(j)).alias(f"c{i}_{j}") for i in range(8) for j in range(i + 1)]).first()
    flat = rows.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    total = flat.agg(F.sum("v")).first()[0]
    out = []
    for i in range(8):
        cross = max(abs(cov[f"c{max(i, j)}_{min(i, j)}"]) for j in range(8) if j != i)
        u = found.directions[:, i]
        out.append((i + 1, cov["n"], float(total), float(found.residuals[i]), abs(cov[f"c{i}_{i}"] - float(found.variances[i])), cross, bool(u[abs(u).argmax()] > 0)))
    names = "component int, n_rows bigint, total_variance double, residual double, variance_gap double, cross_covariance double, sign_rule boolean"
    return rounded(spark.createDataFrame(out, names))


@query("principal_components")
def principal_components(spark, sf):
    return rounded(qc.pca(_vectors(spark, sf), 8).select("cell_id", F.transform("components", lambda x: F.abs(F.round(x, 4))).alias("components")))


@query(
    "balanced_batches",
    """WITH RECURSIVE s AS (SELECT o_custkey AS donor_id, count(*) AS n_cells FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n_cells DESC, donor_id) AS i FROM s),
    dealt AS (SELECT 0::BIGINT AS i, list_transform(range(0, 8), lambda b: 0::BIGINT) AS loads, NULL::INTEGER AS batch
      UNION ALL SELECT i, list_transform(range(0, 8), lambda b: loads[b + 1] + CASE WHEN b = least THEN n_cells ELSE 0 END), least::INTEGER FROM (
        SELECT r.i, loads, n_cells, list_position(loads, list_min(loads)) - 1 AS least FROM dealt JOIN r ON r.i = dealt.i + 1))
    SELECT donor_id, n_cells, batch FROM dealt JOIN r USING (i)""",
)
def balanced_batches(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("donor_id")).agg(F.count(F.lit(1)).alias("n_cells"))
    return qc.balanced_batches(sizes, 8)


@query(
    "run_progress",
    r6(
        """WITH s AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS day, count(*) AS done, sum(value) AS seconds FROM events GROUP BY 1)
    SELECT day, done, seconds, sum(done) OVER w::BIGINT AS cum_done, sum(seconds) OVER w AS cum_seconds, sum(done) OVER w / sum(seconds) OVER w AS rate FROM s WINDOW w AS (ORDER BY day)""".replace("OVER w::BIGINT", "OVER w"),
        "seconds", "cum_seconds", "rate",
    ).replace("round(seconds, 6) AS seconds", "round(seconds, 6) AS seconds, cum_done::BIGINT AS cum_done"),
)
def run_progress(spark, sf):
    e = table(spark, sf, "events").select(F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), F.lit(1).alias("one"), "value")
    return rounded(qc.run_progress(e, "day", "one", "value"))


# --- checks -----------------------------------------------------------------------------


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def _cte(exprs: dict[str, str], source: str, name: str = "m") -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {source})"


def _v(rule: str, where: str, key: str, detail: str, source: str = "m") -> str:
    return f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {where}"


def _dups(key: str, source: str = "m") -> str:
    return _v(f"duplicate_{key}", "n > 1", key, "n", f"(SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})")


def _union(cte: str, *parts: str) -> str:
    return f"WITH {cte} " + " UNION ALL ".join(parts)


_LEAK = {
    "entity_id": "CAST(o_orderkey AS STRING)",
    "entity_type": "CASE o_orderpriority WHEN '5-LOW' THEN 'cell_id' WHEN '2-HIGH' THEN 'plate' ELSE 'donor_id' END",
    "patient_id": "o_custkey",
    "donor_id": "CASE WHEN o_totalprice < 50000 THEN 'TODO' ELSE CAST(o_custkey AS STRING) END",
    "sample_id": "o_orderkey",
    "cell_id": "o_orderkey",
    "cohort_id": "c_nationkey",
    "batch_id": "CASE WHEN o_orderstatus = 'P' THEN 'b1' ELSE o_orderpriority END",
    "split": "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE 'external_validation' END",
    "disease_label": "o_orderstatus",
    "audit_status": "CASE WHEN o_totalprice > 490000 THEN ' ' ELSE 'ok' END",
}
_LEAK_CTE = _cte(_LEAK, "orders JOIN customer ON c_custkey = o_custkey").replace("AS STRING", "AS VARCHAR")


def _leak(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return _select(o.join(c, o.o_custkey == c.c_custkey), _LEAK)


def _one_split(field: str) -> str:
    src = f"(SELECT {field} AS k, min(split) AS a, max(split) AS b FROM m WHERE CAST({field} AS VARCHAR) NOT IN ('', 'TODO', 'unclear', 'None', 'none', 'null') GROUP BY 1)"
    return _v(f"{field}_in_several_splits", "a <> b", "k", "a || ',' || b", src)


_OVERLAP = [_one_split(f) for f in ("patient_id", "donor_id", "sample_id")]
_CELL_LEVEL = _v("cell_level_split", "entity_type IN ('cell_id', 'barcode')", "entity_id", "entity_type")
_AUDIT = _v("missing_audit_status", "trim(audit_status) = ''", "entity_id", "'audit_status'")
_COHORTS = _v("cohort_contamination", "t AND h", "cohort_id", "'train-like and holdout'",
              "(SELECT cohort_id, bool_or(split IN ('train', 'validation', 'test')) AS t, bool_or(split IN ('external_validation', 'holdout')) AS h FROM m GROUP BY 1)")
_BATCHES = _v("batch_confounding", "k = 1", "split", "b", "(SELECT split, count(DISTINCT batch_id) AS k, min(batch_id) AS b FROM m GROUP BY 1)")
_LABELS = """SELECT 'label_leakage' AS rule, 'disease_label' AS key, 'label tied to split' AS detail FROM (
  SELECT count(*) AS n, max(k) AS k, count(DISTINCT s) AS s FROM (SELECT disease_label, count(DISTINCT split) AS k, min(split) AS s FROM m GROUP BY 1)) WHERE n >= 2 AND k = 1 AND s >= 2"""


@query("entity_overlap_check", _union(_LEAK_CTE, *_OVERLAP))
def entity_overlap_check(spark, sf):
    return ck.entity_overlap(_leak(spark, sf))


@query("leakage_checks", _union(_LEAK_CTE, _AUDIT, _CELL_LEVEL, *_OVERLAP, _one_split("cell_id"), _COHORTS, _BATCHES, _LABELS))
def leakage_checks(spark, sf):
    return ck.leakage_checks(_leak(spark, sf))


@query(
    "leakage_report",
    f"""WITH {_LEAK_CTE}, v AS ({' UNION ALL '.join([_AUDIT, _CELL_LEVEL, *_OVERLAP, _one_split('cell_id'), _COHORTS, _BATCHES, _LABELS])})
    SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n_violations, array_to_string(list_sort(list_distinct(list(rule))), '; ') AS errors,
    (SELECT count(*) FROM m) AS checked_rows FROM v""",
)
def leakage_report(spark, sf):
    rows = _leak(spark, sf)
    return ck.leakage_report(rows)


@query(
    "train_test_overlap",
    "SELECT CAST(o_custkey AS VARCHAR) AS donor_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'",
)
def train_test_overlap(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "donor_id")
    return ck.id_overlap(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O"), "donor_id")


_SPLIT_ROWS = _LEAK | {"entity_id": "CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE CAST(o_custkey AS STRING) END", "split": "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE 'extra' END"}


@query(
    "split_manifest_check",
    _union(
        _cte(_SPLIT_ROWS, "orders JOIN customer ON c_custkey = o_custkey").replace("AS STRING", "AS VARCHAR"),
        _AUDIT, _CELL_LEVEL,
        _v("unsupported_entity_type", "entity_type = 'plate'", "entity_id", "entity_type"),
        _v("unsupported_split", "split = 'extra'", "entity_id", "split"),
        _v("missing_entity_id", "entity_id = ''", "entity_id", "'entity_id'"),
        _v("train_test_overlap", "a AND b", "entity_id", "'train,test'",
           "(SELECT entity_id, bool_or(split = 'train') AS a, bool_or(split = 'test') AS b FROM m WHERE entity_id <> '' GROUP BY 1)"),
    ),
)
def split_manifest_check(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return ck.split_manifest(_select(o.join(c, o.o_custkey == c.c_custkey), _SPLIT_ROWS))


_DONOR_ROWS = {"donor_id": "o_custkey", "split": "CASE o_orderstatus WHEN 'F' THEN 'train' ELSE 'test' END", "label_group": "o_orderpriority"}


@query(
    "donor_manifest_check",
    _union(
        _cte(_DONOR_ROWS, "orders") + ", p AS (SELECT donor_id, count(*) AS n, min(split) AS a, max(split) AS b FROM m GROUP BY 1)",
        _v("duplicate_donor", "n > 1", "donor_id", "n", "p"),
        _v("donor_in_several_splits", "a <> b", "donor_id", "a || ',' || b", "p"),
        _v("label_outside_domain", "label_group NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "donor_id", "label_group"),
        "SELECT 'missing_split', 'validation', 'no donor'",
        "SELECT 'unexpected_donor_count', 'donors', CAST(count(*) AS VARCHAR) FROM p HAVING count(*) <> 7",
    ),
)
def donor_manifest_check(spark, sf):
    return ck.donor_manifest(_select(table(spark, sf, "orders"), _DONOR_ROWS), ["1-URGENT", "2-HIGH", "3-MEDIUM"], expected=7)


@query("fold_check", "SELECT 'never_held_out' AS rule, CAST(c_custkey AS VARCHAR) AS key, 'no test fold' AS detail FROM customer WHERE c_acctbal < 0")
def fold_check(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("donor_id"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    folds = sp.shuffled_kfold(people.where(F.col("c_acctbal") >= 0).drop("c_acctbal"), 5, seed=4)
    return ck.fold_checks(sp.fold_roles(folds, 5), people)


@query("duplicate_donor_check", f"SELECT * FROM ({_dups('o_custkey', 'orders')})")
def duplicate_donor_check(spark, sf):
    return ck.duplicate_ids(table(spark, sf, "orders"), "o_custkey")


_META = {"cell_id": "o_orderkey", "donor": "CASE WHEN o_totalprice < 3000 THEN 'unclear' ELSE 'd' END", "priority": "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ' ' ELSE o_orderpriority END",
         "split_group": "CASE o_orderstatus WHEN 'P' THEN 'barcode' ELSE 'donor' END"}


@query(
    "canonical_metadata_check",
    _union(
        _cte(_META, "orders"),
        _v("unresolved_donor", "donor = 'unclear'", "cell_id", "'donor'"),
        _v("unresolved_priority", "trim(priority) = ''", "cell_id", "'priority'"),
        _v("cell_level_split", "split_group = 'barcode'", "cell_id", "split_group"),
    ),
)
def canonical_metadata_check(spark, sf):
    return ck.canonical_metadata(_select(table(spark, sf, "orders"), _META), "cell_id", ["donor", "priority"], split_group="split_group")


_SHARES = "sh AS (SELECT o_custkey AS donor_id, o_orderpriority AS cell_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2)"
_COMP = {
    "feature_id": "concat(donor_id, '/', cell_type)", "dataset_id": "'d'", "aggregation_id": "donor_id", "cell_type": "cell_type",
    "aggregation_unit": "CASE cell_type WHEN '5-LOW' THEN 'barcode' WHEN '1-URGENT' THEN 'cohort' ELSE 'donor_id' END",
    "cell_count": "CASE WHEN n = 6 THEN 1000 ELSE n END", "total_cells": "CASE WHEN total = 4 THEN 0 ELSE total END", "cell_type_fraction": "CASE WHEN n = 1 THEN 1.5 ELSE 0.5 END",
    "transformation_status": "'none'", "split_group": "CASE WHEN total = 5 THEN 'Cell' ELSE 'donor' END", "audit_status": "CASE WHEN total = 7 THEN '' ELSE 'ok' END",
}


def _shares(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("donor_id"), F.col("o_orderpriority").alias("cell_type"))
    return dn.composition(o).withColumnsRenamed({"cell_count": "n", "total_cells": "total"})


@query(
    "composition_rows_check",
    _union(
        f"{_SHARES}, {_cte(_COMP, 'sh')}",
        _v("missing_audit_status", "audit_status = ''", "feature_id", "'audit_status'"),
        _v("cell_level_unit", "aggregation_unit = 'barcode'", "feature_id", "aggregation_unit"),
        _v("unsupported_unit", "aggregation_unit = 'cohort'", "feature_id", "aggregation_unit"),
        _v("total_not_positive", "total_cells <= 0", "feature_id", "total_cells"),
        _v("count_outside_total", "total_cells > 0 AND cell_count > total_cells", "feature_id", "cell_count"),
        _v("fraction_outside_unit", "cell_type_fraction > 1", "feature_id", "cell_type_fraction"),
        _v("cell_level_split", "split_group = 'Cell'", "feature_id", "split_group"),
    ),
)
def composition_rows_check(spark, sf):
    return ck.composition_rows(_select(_shares(spark, sf), _COMP))


_PB = {
    "feature_id": "concat(donor_id, '/', cell_type)", "dataset_id": "'d'", "aggregation_id": "donor_id",
    "aggregation_unit": "CASE WHEN total = 4 THEN 'Cell_ID' ELSE 'patient_id' END",
    "aggregation_method": "CASE cell_type WHEN '5-LOW' THEN 'median' ELSE 'sum_counts' END", "value_type": "CASE WHEN n = 2 THEN '' ELSE 'count' END",
    "normalization_status": "'raw'", "split_group": "CASE WHEN total = 5 THEN 'barcode' ELSE 'donor' END", "audit_status": "'ok'",
}


@query(
    "pseudobulk_rows_check",
    _union(
        f"{_SHARES}, {_cte(_PB, 'sh')}",
        _v("missing_value_type", "value_type = ''", "feature_id", "'value_type'"),
        _v("cell_level_unit", "aggregation_unit = 'Cell_ID'", "feature_id", "aggregation_unit"),
        _v("unknown_method", "aggregation_method = 'median'", "feature_id", "aggregation_method"),
        _v("cell_level_split", "split_group = 'barcode'", "feature_id", "split_group"),
    ),
)
def pseudobulk_rows_check(spark, sf):
    return ck.pseudobulk_rows(_select(_shares(spark, sf), _PB))


_PRED = {
    "run_id": "doc_id", "dataset_id": "lang", "split": "'test'", "true_label": "label", "predicted_score": "score", "predicted_label": "'1'", "audit_status": "'ok'",
    "prediction_unit": "CASE lang WHEN 'de' THEN 'cell' WHEN 'fr' THEN 'well' ELSE 'Patient' END", "patient_id": "CASE WHEN n_chars < 500 THEN '' ELSE 'p' END",
    "donor_id": "''", "sample_id": "CASE WHEN lang = 'es' THEN 's' ELSE '' END", "label_verified": "CASE WHEN label = 1 THEN 'YES' ELSE 'no' END", "leakage_checks_passed": "toxic = 0",
}


@query(
    "prediction_rows_check",
    _union(
        f"{PREDICTIONS}, {_cte(_PRED, 'predictions')}",
        _v("cell_level_unit", "prediction_unit = 'cell'", "run_id", "prediction_unit"),
        _v("unsupported_unit", "prediction_unit = 'well'", "run_id", "prediction_unit"),
        _v("no_identifier", "patient_id = '' AND sample_id = ''", "run_id", "'patient_id, donor_id, sample_id'"),
        _v("label_not_verified", "label_verified = 'no'", "run_id", "label_verified"),
        _v("leakage_checks_not_passed", "NOT leakage_checks_passed", "run_id", "leakage_checks_passed"),
    ),
)
def prediction_rows_check(spark, sf):
    return ck.prediction_rows(_select(predictions(spark, sf), _PRED))


_CAL = {
    "run_id": "doc_id", "dataset_id": "lang", "model_family": "'logistic'", "task": "'t'", "status": "'done'", "audit_status": "'ok'", "prediction_unit": "'donor_id'",
    "n_patients": "CASE WHEN n_chars < 200 THEN '0' WHEN n_chars < 400 THEN '1.5' ELSE CAST(n_chars AS STRING) END", "label_verified": "label = 1", "leakage_checks_passed": "'true'",
}


@query(
    "calibration_rows_check",
    _union(
        f"{PREDICTIONS}, {_cte(_CAL, 'predictions')}".replace("AS STRING", "AS VARCHAR"),
        _v("n_patients_not_integer", "n_patients = '1.5'", "run_id", "n_patients"),
        _v("n_patients_not_positive", "n_patients = '0'", "run_id", "n_patients"),
        _v("label_not_verified", "NOT label_verified", "run_id", "label_verified"),
    ),
)
def calibration_rows_check(spark, sf):
    return ck.calibration_rows(_select(predictions(spark, sf), _CAL))


_THR = {"threshold_id": "p_partkey", "threshold_source": "CASE p_type WHEN 'PROMO' THEN ' Guessed' ELSE 'literature' END", "applied": "p_size > 25",
        "approved_by": "CASE p_brand WHEN 'Brand#1' THEN 'x' ELSE '' END", "audit_status": "CASE p_brand WHEN 'Brand#2' THEN '' ELSE 'ok' END"}


@query(
    "threshold_decisions_check",
    _union(
        _cte(_THR, "part"),
        _v("missing_audit_status", "audit_status = ''", "threshold_id", "'audit_status'"),
        _v("guessed_threshold", "trim(threshold_source) = 'Guessed'", "threshold_id", "threshold_source"),
        _v("applied_without_approver", "applied AND approved_by = ''", "threshold_id", "applied"),
    ),
)
def threshold_decisions_check(spark, sf):
    return ck.threshold_decisions(_select(table(spark, sf, "part"), _THR))


@query(
    "matrix_consistency_check",
    """SELECT 'unknown_cell' AS rule, CAST(l_orderkey AS VARCHAR) AS key, 'in counts only' AS detail FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'unknown_gene', CAST(l_partkey AS VARCHAR), 'in counts only' FROM (SELECT DISTINCT l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1)
    UNION ALL SELECT 'missing_cell_type', CAST(o_orderkey AS VARCHAR), 'cell_type' FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'""",
)
def matrix_consistency_check(spark, sf):
    c = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("cell_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("cell_type")
    )
    g = table(spark, sf, "part").where(F.col("p_size") != 1).select(F.col("p_partkey").alias("gene_id"))
    return ck.cell_gene_matrix(c, g, counts(spark, sf), required=["cell_type"])


@query(
    "ingestion_readiness",
    """SELECT 'too_few_donors' AS rule, 'donors' AS key, CAST(count(DISTINCT o_custkey) AS VARCHAR) AS detail FROM orders HAVING count(DISTINCT o_custkey) < 1000000000
    UNION ALL SELECT 'no_mitochondrial_gene', 'gene_symbol', 'MT-'""",
)
def ingestion_readiness(spark, sf):
    return ck.readiness(cells(spark, sf), genes(spark, sf), counts(spark, sf), minimum_donors=1_000_000_000)


@query(
    "declared_totals_check",
    """SELECT 'differs_n_donors' AS rule, 'manifest' AS key, '7 vs ' || count(DISTINCT o_custkey) AS detail FROM orders
    UNION ALL SELECT 'differs_n_cells', 'manifest', '9 vs ' || count(*) FROM orders""",
)
def declared_totals_check(spark, sf):
    return ck.declared_totals({"n_donors": 7, "n_cells": 9}, dn.cohort_summary(cells(spark, sf)))


def _feature_rows(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("donor_id"), (F.col("label") % 2).alias("label"), F.when(F.col("label") < 8, "train").otherwise("test").alias("split"),
        F.when(F.col("label") != 3, F.col("embedding")).otherwise(F.slice("embedding", 1, 60)).alias("features"),
    )


@query(
    "donor_features_check",
    "SELECT 'sizes_differ' AS rule, 'table' AS key, min(n) || ',' || max(n) AS detail FROM (SELECT CASE WHEN label = 3 THEN 60 ELSE len(embedding) END AS n FROM embeddings)",
)
def donor_features_check(spark, sf):
    return ck.donor_features(_feature_rows(spark, sf))


@query("vector_rows_check", "SELECT 'unusable_vector' AS rule, CAST(vec_id AS VARCHAR) AS key, 'unexpected size' AS detail FROM embeddings WHERE label = 3")
def vector_rows_check(spark, sf):
    rows = _feature_rows(spark, sf).select("donor_id", F.col("donor_id").alias("cell_id"), F.col("features").alias("embedding"))
    return ck.vector_rows(rows, 64)


@query(
    "prediction_sanity_check",
    f"""WITH {PREDICTIONS} SELECT 'score_outside_unit' AS rule, CAST(doc_id AS VARCHAR) AS key, CAST(round(score * 1.2, 6) AS VARCHAR) AS detail FROM predictions WHERE round(score * 1.2, 6) > 1
    UNION ALL SELECT 'not_two_labels', 'table', CAST(count(DISTINCT lang) AS VARCHAR) FROM predictions HAVING count(DISTINCT lang) <> 2
    UNION ALL SELECT 'no_positive_label', 'table', 'xx'""",
)
def prediction_sanity_check(spark, sf):
    rows = predictions(spark, sf).select(
        F.col("doc_id").alias("donor_id"), F.col("lang").alias("true_label"), F.col("lang").alias("predicted_label"), F.round(F.col("score") * 1.2, 6).alias("score")
    )
    return ck.prediction_sanity(rows, "xx", score="score")


@query("centroid_table_check", "SELECT 'sizes_differ' AS rule, 'table' AS key, '60,64' AS detail FROM (SELECT count(*) AS n FROM embeddings) WHERE n > 0")
def centroid_table_check(spark, sf):
    rows = _feature_rows(spark, sf)
    a = md.fit_centroids(rows.where(F.size("features") == 64))
    b = md.fit_centroids(rows.where(F.size("features") == 60)).withColumn("label", F.col("label") + 100)
    return ck.centroid_table(a.unionByName(b))


@query(
    "processed_output_check",
    f"""WITH {_HVG} SELECT 'cells_do_not_add_up' AS rule, 'table' AS key, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') || ' vs ' || (SELECT count(*) FROM orders) AS detail
    UNION ALL SELECT 'unexpected_variable_genes', 'table', CAST(count(*) FILTER (highly_variable) AS VARCHAR) FROM hv""",
)
def processed_output_check(spark, sf):
    n = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    hv = qc.highly_variable(qc.gene_dispersion(qc.normalize_log1p(_sums(spark, sf)), n), 500)
    summary = dn.cell_counts(cells(spark, sf).where(F.col("batch") != "P"), "donor_id", extra=["grp"])
    return ck.processed_output(cells(spark, sf), hv, summary, 2000, group="grp")


# --- catalogs ---------------------------------------------------------------------------

_STATUS = "CASE p_size % 5 WHEN 0 THEN 'candidate_pending_audit' WHEN 1 THEN 'manual_metadata_verified' WHEN 2 THEN 'maybe' WHEN 3 THEN '' ELSE 'rejected_metadata_only' END"
_CAND = {"accession": "CASE p_type WHEN 'PROMO' THEN '' ELSE concat('ACC', p_partkey) END", "audit_status": _STATUS}


@query(
    "candidate_rows_check",
    _union(
        _cte(_CAND, "part"),
        _v("missing_key", "accession = ''", "accession", "'accession'"),
        _v("missing_audit_status", "audit_status = ''", "accession", "'audit_status'"),
        _v("status_not_allowed", "audit_status = 'maybe'", "accession", "audit_status"),
    ),
)
def candidate_rows_check(spark, sf):
    return ck.candidate_rows(_select(table(spark, sf, "part"), _CAND))


_SCORE = {"collection_id": "p_brand", "dataset_id": "CAST(p_partkey AS STRING)", "audit_status": _STATUS, "organism": "CASE p_type WHEN 'PROMO' THEN 'UNKNOWN' ELSE 'human' END", "assay": "CASE p_type WHEN 'SMALL' THEN '' ELSE '10x' END"}
_SCORE_SQL = _cte(_SCORE, "part").replace("AS STRING", "AS VARCHAR")
_SCORED = """SELECT '{src}' AS source_table, {key} AS candidate_key, audit_status, CASE WHEN audit_status = '' THEN 'error_missing_audit_status' WHEN audit_status <> 'manual_metadata_verified' THEN 'not_scored_pending_manual_audit'
    WHEN organism = 'UNKNOWN' OR assay = '' THEN 'error_missing_hard_fields' ELSE 'ready_for_manual_scoring' END AS score_status,
    CASE WHEN audit_status <> 'manual_metadata_verified' THEN 'TODO' WHEN organism = 'UNKNOWN' THEN 'organism' WHEN assay = '' THEN 'assay' ELSE '' END AS missing_information FROM m"""


@query(
    "scoring_status",
    f"WITH {_SCORE_SQL} " + _SCORED.format(src="geo", key="dataset_id") + " UNION ALL " + _SCORED.format(src="cellxgene", key="collection_id || '::' || dataset_id"),
)
def scoring_status(spark, sf):
    rows = _select(table(spark, sf, "part"), _SCORE)
    hard = ["organism", "assay"]
    return cat.scoring_status(rows, "geo", ["dataset_id"], hard).unionByName(cat.scoring_status(rows, "cellxgene", ["collection_id", "dataset_id"], hard))


_AUDITS = {
    "patient_id": "CASE o_orderpriority WHEN '5-LOW' THEN 'UNKNOWN' ELSE CAST(o_custkey AS STRING) END", "audit_status": "CASE WHEN o_totalprice < 5000 THEN ' ' ELSE 'ok' END",
    "row_key": "o_orderkey", "label_type": "CASE o_orderstatus WHEN 'P' THEN 'guess' ELSE 'diagnosis' END", "cell_level_only": "CASE o_orderpriority WHEN '2-HIGH' THEN 'TRUE' ELSE 'false' END",
}
_AUDITS_SQL = _cte(_AUDITS, "orders").replace("AS STRING", "AS VARCHAR")


@query(
    "patient_audit_check",
    _union(_AUDITS_SQL, _v("missing_patient_id", "patient_id = 'UNKNOWN'", "row_key", "'patient_id'"), _v("missing_audit_status", "trim(audit_status) = ''", "row_key", "'audit_status'")),
)
def patient_audit_check(spark, sf):
    return ck.patient_audit_rows(_select(table(spark, sf, "orders"), _AUDITS), "row_key")


@query(
    "label_audit_check",
    _union(
        _AUDITS_SQL,
        _v("missing_patient_id", "patient_id = 'UNKNOWN'", "row_key", "'patient_id'"),
        _v("label_type_not_allowed", "label_type = 'guess'", "row_key", "label_type"),
        _v("cell_level_only_label", "cell_level_only = 'TRUE'", "row_key", "cell_level_only"),
    ),
)
def label_audit_check(spark, sf):
    return ck.label_audit_rows(_select(table(spark, sf, "orders"), _AUDITS), ["diagnosis", "activity"], ["patient_id"], "row_key")


_EXT = {
    "candidate_id": "p_partkey", "source": "'geo'", "accession_or_collection_id": "p_brand", "audit_status": "'ok'", "independent_study": "CASE p_type WHEN 'PROMO' THEN 'UNRESOLVED' ELSE 'yes' END",
    "decision": "CASE p_size % 3 WHEN 0 THEN 'external_validation_ready' WHEN 1 THEN 'reject' ELSE 'later' END",
}


@query(
    "external_candidate_check",
    _union(
        _cte(_EXT, "part"),
        _v("decision_not_allowed", "decision = 'later'", "candidate_id", "decision"),
        _v("ready_but_unresolved_independent_study", "decision = 'external_validation_ready' AND independent_study = 'UNRESOLVED'", "candidate_id", "'independent_study'"),
    ),
)
def external_candidate_check(spark, sf):
    return ck.external_candidate_rows(_select(table(spark, sf, "part"), _EXT), ["independent_study", "source"])


@query("catalog_copy", "SELECT s_suppkey, s_name, 'TODO' AS audit_status, 'copied' AS audit_notes FROM supplier")
def catalog_copy(spark, sf):
    return cat.audit_copy(table(spark, sf, "supplier").select("s_suppkey", "s_name"), notes="copied")


@query(
    "approval_words_check",
    """SELECT 'approval_in_role' AS rule, conv_id || '/' || turn AS key, role AS detail FROM conversations WHERE lower(trim(role)) IN ('system', 'approved')
    UNION ALL SELECT 'approval_in_text', conv_id || '/' || turn, text FROM conversations WHERE lower(trim(text)) IN ('system', 'approved')""",
)
def approval_words_check(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return ck.approval_words(rows, "key", ["role", "text"], ("system", "approved"))


@query(
    "catalog_sizes",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in ("documents", "pages", "labels", "benchmark", "conversations")),
)
def catalog_sizes(spark, sf):
    return cat.table_sizes({t: table(spark, sf, t) for t in ("documents", "pages", "labels", "benchmark", "conversations")})


_COHORTS_ROWS = {
    "cohort_id": "c_custkey", "organism": "CASE WHEN c_nationkey = 1 THEN 'mouse' WHEN c_nationkey = 2 THEN '' ELSE 'human' END", "audit_status": "'ok'",
    "intended_role": "CASE c_mktsegment WHEN 'BUILDING' THEN 'training' ELSE 'TODO' END", "provenance_url": "CASE WHEN c_acctbal < 0 THEN '' ELSE 'x' END",
    "selected_dataset": "CASE c_nationkey WHEN 3 THEN 'yes' ELSE 'no' END",
    "approved_role": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'training' WHEN 'HOUSEHOLD' THEN 'pilot' ELSE 'none' END", "human_gate_approved": "c_nationkey = 4",
}


@query(
    "cohort_manifest_check",
    _union(
        _cte(_COHORTS_ROWS, "customer"),
        _v("missing_organism", "organism = ''", "cohort_id", "'organism'"),
        _v("not_allowed_organism", "organism = 'mouse'", "cohort_id", "organism"),
        _v("intended_role_not_allowed", "intended_role = 'training'", "cohort_id", "intended_role"),
        _v("missing_provenance_url", "provenance_url = ''", "cohort_id", "'provenance_url'"),
        _v("dataset_selected", "selected_dataset = 'yes'", "cohort_id", "selected_dataset"),
        _v("role_without_gate", "approved_role = 'pilot' OR (approved_role = 'training' AND NOT human_gate_approved)", "cohort_id", "approved_role"),
    ),
)
def cohort_manifest_check(spark, sf):
    return ck.cohort_manifest(_select(table(spark, sf, "customer"), _COHORTS_ROWS), "cohort_id", ["organism"], {"organism": ["human"]})


_ELIG = {
    "dataset": "p_partkey", "core_dataset_validity": "p_size / 50.0", "prediction_task_feasibility": "(51 - p_size) / 50.0", "patient_level_modeling_feasibility": "p_size / 50.0",
    "cross_cohort_validation_suitability": "1.0", "bioinformatics_interpretability": "0.5", "reproducibility_and_accessibility": "p_size / 50.0", "bulk_only": "p_type = 'PROMO'", "not_human": "p_brand = 'Brand#3'",
}


@query(
    "eligibility_scores",
    f"""WITH {_cte(_ELIG, 'part')}, s AS (SELECT dataset, round(CAST(25 * core_dataset_validity + 20 * prediction_task_feasibility + 20 * patient_level_modeling_feasibility + 15 * cross_cohort_validation_suitability
      + 10 * bioinformatics_interpretability + 10 * reproducibility_and_accessibility AS DOUBLE), 6) AS total_score,
      concat_ws('; ', CASE WHEN bulk_only THEN 'bulk_only' END, CASE WHEN not_human THEN 'not_human' END) AS hard_rejection_flags FROM m)
    SELECT *, CASE WHEN hard_rejection_flags <> '' OR total_score < 40 THEN 'reject' WHEN total_score >= 80 THEN 'excellent' WHEN total_score >= 60 THEN 'usable_with_caution' ELSE 'limited' END AS eligibility_category FROM s""",
)
def eligibility_scores(spark, sf):
    out = cat.eligibility(_select(table(spark, sf, "part"), _ELIG), ["bulk_only", "not_human"])
    return out.select("dataset", F.round(F.col("total_score").cast("double"), 6).alias("total_score"), "hard_rejection_flags", "eligibility_category")
