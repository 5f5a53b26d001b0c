"""Queries: counts to features, donor tables, joins, sets and scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from donorlake.functions import columns as col
from donorlake.functions import scalars as sc
from donorlake.functions.columns import rounded
from donorlake.operators import catalogs as cat
from donorlake.operators import cellqc as qc
from donorlake.operators import donors as dn
from donorlake.operators import pseudobulk as pb
from donorlake.operators.ordering import global_rank
from donorlake.operators.resample import score_shift
from donorlake.plans.registry import CELLS, COUNTS, DONOR_TEXT, GENES, cells, counts, donor_text, genes, query, r6, table
from donorlake.session import scratch, task_slots
from donorlake.sources import tables
from donorlake.sources.tables import scan

NATION_SUMS = f"""{CELLS}, {COUNTS}, sums AS (
  SELECT nation_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY nation_id, gene_id)"""
CELL_SUMS = f"{COUNTS}, sums AS (SELECT cell_id, gene_id, sum(value) AS value FROM counts GROUP BY cell_id, gene_id)"


@query("pseudobulk_sum", f"WITH {NATION_SUMS} SELECT * FROM sums")
def pseudobulk_sum(spark, sf):
    return pb.pseudobulk(counts(spark, sf), cells(spark, sf), "nation_id")


@query("pseudobulk_bucketed", f"WITH {NATION_SUMS} SELECT * FROM sums")
def pseudobulk_bucketed(spark, sf):
    """The same sums from tables bucketed by cell: their join needs no exchange."""
    paths = {name: scratch(spark, name) for name in ("bucketed-counts", "bucketed-cells")}
    place = lambda df, name: tables.write_bucketed(df, re.sub("[^a-z0-9]", "_", paths[name].rsplit("/", 1)[1]), "cell_id", task_slots(spark), paths[name])
    return pb.pseudobulk(place(counts(spark, sf), "bucketed-counts"), place(cells(spark, sf), "bucketed-cells"), "nation_id")


@query(
    "pseudobulk_log_cpm",
    r6(
        f"""WITH {NATION_SUMS}, totals AS (SELECT nation_id, sum(value) AS total FROM sums GROUP BY nation_id)
        SELECT nation_id, gene_id, value, total, value / total * 1e6 AS cpm, ln(1 + value / total * 1e6) AS log1p_cpm
        FROM sums JOIN totals USING (nation_id)""",
        "cpm",
        "log1p_cpm",
    ),
)
def pseudobulk_log_cpm(spark, sf):
    sums = pb.pseudobulk(counts(spark, sf), cells(spark, sf), "nation_id")
    return rounded(pb.cpm_log1p(sums, "nation_id"))


@query(
    "pseudobulk_restricted_genes",
    r6(
        f"""WITH {CELLS}, {COUNTS}, kept AS (SELECT * FROM counts WHERE gene_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')),
        sums AS (SELECT nation_id, gene_id, sum(value) AS value FROM kept JOIN cells USING (cell_id) GROUP BY nation_id, gene_id),
        totals AS (SELECT nation_id, sum(value) AS total FROM sums GROUP BY nation_id),
        sizes AS (SELECT nation_id, count(*) AS n_cells FROM cells GROUP BY nation_id)
        SELECT nation_id, gene_id, value, total, value / total * 1e6 AS cpm, ln(1 + value / total * 1e6) AS log1p_cpm, n_cells
        FROM sums JOIN totals USING (nation_id) JOIN sizes USING (nation_id)""",
        "cpm",
        "log1p_cpm",
    ),
)
def pseudobulk_restricted_genes(spark, sf):
    kept = pb.restrict_genes(counts(spark, sf), genes(spark, sf).where(F.col("p_type") == "PROMO"))
    sums = pb.pseudobulk(kept, cells(spark, sf), "nation_id")
    sizes = dn.cell_counts(cells(spark, sf), "nation_id")
    return rounded(pb.cpm_log1p(sums, "nation_id").join(sizes, "nation_id"))


@query(
    "pseudobulk_restricted_donors",
    f"""WITH {CELLS}, {COUNTS} SELECT donor_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id)
    WHERE donor_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY donor_id, gene_id""",
)
def pseudobulk_restricted_donors(spark, sf):
    chosen = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("donor_id"))
    return pb.pseudobulk(counts(spark, sf), cells(spark, sf).join(chosen, "donor_id", "left_semi"), "donor_id")


@query(
    "pseudobulk_mean_by_cell_type",
    r6(
        f"""WITH {CELLS}, {COUNTS}, sizes AS (SELECT nation_id, cell_type, count(*) AS n FROM cells GROUP BY ALL),
        top AS (SELECT nation_id, cell_type, gene_id, sum(value) AS s FROM counts JOIN cells USING (cell_id) GROUP BY ALL)
        SELECT nation_id, cell_type, gene_id, s / n AS value FROM top JOIN sizes USING (nation_id, cell_type)""",
        "value",
    ),
)
def pseudobulk_mean_by_cell_type(spark, sf):
    return rounded(pb.pseudobulk(counts(spark, sf), cells(spark, sf), "nation_id", "mean", ["cell_type"]))


@query(
    "pseudobulk_fraction_expressing",
    r6(
        f"""WITH {CELLS}, {CELL_SUMS}, sizes AS (SELECT nation_id, count(*) AS n FROM cells GROUP BY ALL),
        top AS (SELECT nation_id, gene_id, count(*) FILTER (value > 0) AS s FROM sums JOIN cells USING (cell_id) GROUP BY ALL)
        SELECT nation_id, gene_id, s / n AS value FROM top JOIN sizes USING (nation_id)""",
        "value",
    ),
)
def pseudobulk_fraction_expressing(spark, sf):
    return rounded(pb.pseudobulk(counts(spark, sf), cells(spark, sf), "nation_id", "fraction"))


@query(
    "donor_totals",
    f"""WITH {CELLS}, {COUNTS}, per_cell AS (SELECT cell_id, sum(value) AS v FROM counts GROUP BY cell_id)
    SELECT donor_id, count(*) AS n_cells, coalesce(sum(v), 0.0) AS total_counts FROM cells LEFT JOIN per_cell USING (cell_id) GROUP BY donor_id""",
)
def donor_totals(spark, sf):
    return pb.donor_totals(counts(spark, sf), cells(spark, sf))


@query("cell_totals", "SELECT l_orderkey AS cell_id, sum(l_quantity) AS n_counts FROM lineitem GROUP BY l_orderkey")
def cell_totals(spark, sf):
    return qc.cell_totals(counts(spark, sf))


def _keys(spark, sf, flag):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("gene_id"))


_LINES = "SELECT DISTINCT l_partkey AS gene_id FROM lineitem WHERE l_returnflag = '{}'"


@query("gene_intersection", f"{_LINES.format('R')} INTERSECT {_LINES.format('N')}")
def gene_intersection(spark, sf):
    return pb.gene_intersection(_keys(spark, sf, "R"), _keys(spark, sf, "N"))


@query(
    "key_symmetric_difference",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N')
    SELECT k AS cell_id, 'left_only' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT k, 'right_only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def key_symmetric_difference(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "cell_id")
    return pb.symmetric_difference(li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") == "N"), "cell_id")


@query(
    "vocabulary_overlap",
    r6(
        """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N'),
    s AS (SELECT count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b))
    SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, n AS n_shared,
      100.0 * n / (SELECT count(*) FROM a) AS pct_of_left, 100.0 * n / (SELECT count(*) FROM b) AS pct_of_right FROM s""",
        "pct_of_left",
        "pct_of_right",
    ),
)
def vocabulary_overlap(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "cell_id")
    return rounded(pb.set_overlap(li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") == "N"), "cell_id"))


@query("metadata_scan", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id < 100")
def metadata_scan(spark, sf):
    where = (F.col("event_type") == "purchase") & (F.col("user_id") < 100)
    return scan(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"], where)


_EVENT_SUMS = "s AS (SELECT user_id, event_type, round(sum(value), 6) AS value FROM events GROUP BY ALL)"
_TYPES = ("click", "error", "purchase", "signup", "view")


def _event_sums(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return rounded(e).withColumnsRenamed({"user_id": "donor_id", "event_type": "feature_id"})


@query(
    "donor_feature_columns",
    f"WITH {_EVENT_SUMS} SELECT user_id AS donor_id, "
    + ", ".join(f"coalesce(max(value) FILTER (event_type = '{t}'), 0.0) AS {t}" for t in _TYPES)
    + " FROM s GROUP BY user_id",
)
def donor_feature_columns(spark, sf):
    return pb.feature_columns(_event_sums(spark, sf), _TYPES)


@query(
    "donor_feature_arrays",
    f"""WITH {_EVENT_SUMS} SELECT user_id AS donor_id, event_type AS feature, value,
    row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS pos FROM s""",
)
def donor_feature_arrays(spark, sf):
    arrays = pb.feature_arrays(_event_sums(spark, sf))
    flat = arrays.select("donor_id", F.posexplode(F.arrays_zip("features", "values")))
    return flat.select("donor_id", F.col("col.features").alias("feature"), F.col("col.values").alias("value"), F.col("pos").cast("bigint").alias("pos"))


@query(
    "blocked_matrix_round_trip",
    r6(
        f"""WITH {CELLS}, {COUNTS}, s AS (SELECT nation_id AS donor_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY ALL)
    SELECT donor_id, gene_id, ln(1 + value / sum(value) OVER (PARTITION BY donor_id) * 1e6) AS value FROM s""",
        "value",
    ),
)
def blocked_matrix_round_trip(spark, sf):
    """Sums of nations and genes as a blocked matrix, normalised there, and back to long rows."""
    sums = pb.pseudobulk(counts(spark, sf), cells(spark, sf).withColumn("donor_id", F.col("nation_id")))
    positions = pb.feature_positions(sums, "gene_id")
    blocks = pb.blocked_cpm(pb.blocked_arrays(sums, positions, feature="gene_id", block=512))
    return rounded(pb.long_rows(blocks, positions, feature="gene_id"))


@query(
    "mean_pooled_vectors",
    r6(
        """SELECT label AS donor_id, pos, avg(v::DOUBLE) AS value, count(*) AS n_cells
    FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos""",
        "value",
    ),
)
def mean_pooled_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").alias("donor_id"), "embedding", "vec_id")
    flat = dn.mean_pool(v, cell="vec_id").select("donor_id", "n_cells", F.posexplode("embedding").alias("pos", "value"))
    return rounded(flat.withColumn("pos", F.col("pos").cast("bigint")))


@query(
    "cells_per_donor",
    f"""WITH {CELLS} SELECT donor_id, grp, count(*) AS n_cells, min(cell_id) AS first_seen FROM cells GROUP BY donor_id, grp""",
)
def cells_per_donor(spark, sf):
    return dn.cell_counts(cells(spark, sf), "donor_id", "cell_id", ["grp"])


@query(
    "first_seen_donors",
    """WITH f AS (SELECT o_custkey AS donor_id, min(o_orderkey) AS first_seen, count(*) AS n_cells FROM orders GROUP BY o_custkey)
    SELECT donor_id, n_cells, first_seen, row_number() OVER (ORDER BY first_seen) AS position FROM f""",
)
def first_seen_donors(spark, sf):
    sizes = dn.cell_counts(table(spark, sf, "orders"), "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "donor_id")
    return global_rank(sizes, ["first_seen"], name="position")


@query(
    "status_counts",
    f"""WITH {CELLS}, names(status) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('MACHINERY'), ('AEROSPACE')),
    f AS (SELECT grp AS status, count(DISTINCT donor_id) AS n_donors, count(*) AS n_cells FROM cells GROUP BY grp)
    SELECT coalesce(f.status, names.status) AS status, coalesce(n_donors, 0) AS n_donors, coalesce(n_cells, 0) AS n_cells
    FROM f FULL JOIN names ON f.status = names.status""",
)
def status_counts(spark, sf):
    return dn.status_counts(cells(spark, sf), "donor_id", F.col("grp"), ("AUTOMOBILE", "BUILDING", "MACHINERY", "AEROSPACE"))


@query("cohort_summary", f"WITH {CELLS} SELECT count(*) AS n_cells, count(DISTINCT donor_id) AS n_donors FROM cells")
def cohort_summary(spark, sf):
    return dn.cohort_summary(cells(spark, sf))


@query(
    "donor_labels",
    f"""WITH {DONOR_TEXT} SELECT donor_id, CASE WHEN donor_id LIKE 'FLARE%' THEN 'Flare'
    WHEN donor_id LIKE 'HC-%' OR donor_id LIKE 'IGTB%' THEN 'Healthy' ELSE 'Managed' END AS status FROM donor_text""",
)
def donor_labels(spark, sf):
    return dn.donor_labels(donor_text(spark, sf))


@query(
    "donor_status_rules",
    f"""WITH {DONOR_TEXT}, m AS (SELECT CASE WHEN c_nationkey = 0 THEN 'X' || donor_id ELSE lower(donor_id) END AS donor_id FROM donor_text)
    SELECT donor_id, CASE WHEN donor_id ILIKE 'flare%' THEN 'Flare' WHEN donor_id ILIKE 'hc-%' OR donor_id ILIKE 'igtb%' THEN 'Healthy'
      WHEN regexp_full_match(donor_id, '[0-9]+') THEN 'Managed' ELSE 'Unknown' END AS status_by_pattern,
    CASE WHEN donor_id LIKE 'FLARE%' THEN 'Flare' WHEN donor_id LIKE 'HC-%' OR donor_id LIKE 'IGTB%' THEN 'Healthy' ELSE 'Managed' END AS status_by_prefix,
    CASE WHEN donor_id LIKE 'FLARE%' THEN 'flare_like' WHEN donor_id LIKE 'HC-%' THEN 'healthy_hc_like' WHEN donor_id LIKE 'IGTB%' THEN 'healthy_igtb_like'
      WHEN regexp_full_match(donor_id, '[0-9]+') THEN 'managed_sle_numeric_like' ELSE 'other' END AS file_kind FROM m""",
)
def donor_status_rules(spark, sf):
    mixed = F.when(F.col("c_nationkey") == 0, F.concat(F.lit("X"), "donor_id")).otherwise(F.lower("donor_id"))
    rows = donor_text(spark, sf).select(mixed.alias("donor_id"))
    return rows.select(
        "donor_id",
        sc.donor_status("donor_id", "default", "Unknown").alias("status_by_pattern"),
        sc.donor_group_by_prefix("donor_id").alias("status_by_prefix"),
        sc.file_category("donor_id").alias("file_kind"),
    )


_SHARES = """shares AS (SELECT donor_id, cell_type, count(*) AS cell_count, sum(count(*)) OVER (PARTITION BY donor_id)::BIGINT AS total_cells,
  count(*) / sum(count(*)) OVER (PARTITION BY donor_id) AS fraction FROM cells GROUP BY donor_id, cell_type)"""


@query("composition", r6(f"WITH {CELLS}, {_SHARES} SELECT * FROM shares", "fraction"))
def composition(spark, sf):
    return rounded(dn.composition(cells(spark, sf)))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PROPS = {p: "cell_type_prop_" + p.lower().replace("-", "_").replace(" ", "_") for p in _PRIORITIES}


@query(
    "composition_wide_with_patients",
    f"WITH {CELLS} SELECT c_mktsegment AS grp, w.* FROM (SELECT donor_id, count(*) AS n_cells, "
    + ", ".join(f"round(count(*) FILTER (cell_type = '{p}') / count(*), 6) AS {c}" for p, c in _PROPS.items())
    + " FROM cells GROUP BY donor_id) w JOIN customer ON c_custkey = donor_id",
)
def composition_wide_with_patients(spark, sf):
    wide = dn.composition_wide(cells(spark, sf), _PRIORITIES)
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("donor_id"), F.col("c_mktsegment").alias("grp"))
    return rounded(wide.join(people, "donor_id", "left"))


@query(
    "composition_log_ratios",
    r6(
        f"""WITH {CELLS}, {_SHARES} SELECT donor_id, cell_type, fraction,
    ln((fraction + 0.001) / (1 - fraction + 0.001)) AS logit, ln(fraction) - avg(ln(fraction)) OVER (PARTITION BY donor_id) AS clr FROM shares""",
        "fraction",
        "logit",
        "clr",
    ),
)
def composition_log_ratios(spark, sf):
    shares = dn.composition(cells(spark, sf)).select("donor_id", "cell_type", "fraction")
    return rounded(dn.log_ratios(shares, epsilon=0.001))


@query(
    "invariant_report",
    f"""WITH {CELLS}, s AS (SELECT donor_id, count(DISTINCT grp) AS a, count(DISTINCT batch) AS b, count(DISTINCT cell_type) AS c FROM cells GROUP BY donor_id)
    SELECT 'grp' AS field, count(*) FILTER (a > 1) AS n_varying_donors FROM s UNION ALL SELECT 'batch', count(*) FILTER (b > 1) FROM s
    UNION ALL SELECT 'cell_type', count(*) FILTER (c > 1) FROM s""",
)
def invariant_report(spark, sf):
    return dn.invariant_report(cells(spark, sf), "donor_id", ["grp", "batch", "cell_type"])


@query(
    "collapse_fields",
    f"""WITH {CELLS} SELECT donor_id, min(grp) AS grp,
    CASE WHEN count(DISTINCT batch) > 1 THEN '__mixed_within_patient__' ELSE min(batch) END AS batch,
    CASE WHEN count(DISTINCT cell_type) > 1 THEN NULL ELSE min(cell_type) END AS cell_type, count(DISTINCT cell_type) > 1 AS cell_type_ambiguous
    FROM cells GROUP BY donor_id""",
)
def collapse_fields(spark, sf):
    rows = cells(spark, sf)
    out = dn.collapse(rows, "donor_id", "grp", "error")
    out = out.join(dn.collapse(rows, "donor_id", "batch", "mixed"), "donor_id")
    return out.join(dn.collapse(rows, "donor_id", "cell_type", "flag"), "donor_id")


@query(
    "donor_metadata",
    """WITH c AS (SELECT o_custkey AS donor_id, c_mktsegment AS disease, CASE WHEN c_acctbal < 0 THEN 'female' ELSE 'male' END AS sex, n_name AS eth,
      CASE WHEN o_orderpriority = '5-LOW' AND c_mktsegment = 'HOUSEHOLD' THEN '99-year-old stage' WHEN c_nationkey = 3 THEN 'adult stage'
        ELSE (20 + c_nationkey)::VARCHAR || '-year-old stage' END AS stage
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
    g AS (SELECT donor_id, min(disease) AS disease, min(sex) AS sex, min(eth) AS self_reported_ethnicity, count(DISTINCT stage) AS k, min(stage) AS s0,
      count(DISTINCT sex) > 1 AS many_sex, count(DISTINCT disease) > 1 AS many_disease, count(DISTINCT eth) > 1 AS many_eth,
      array_to_string(list_sort(list_distinct(list(stage))), ';') AS development_stage_raw, count(*) AS n_cells FROM c GROUP BY donor_id),
    a AS (SELECT *, CASE WHEN k > 1 THEN NULL ELSE TRY_CAST(nullif(regexp_extract(s0, '^([0-9]+)-year-old stage$', 1), '') AS INTEGER) END AS age FROM g)
    SELECT donor_id, disease, (disease = 'BUILDING')::INTEGER AS sle_label, sex, self_reported_ethnicity, age::DOUBLE AS age,
      CASE WHEN k > 1 THEN 'age_ambiguous' ELSE 'ok' END AS age_flag,
      k = 1 AND (SELECT count(*) = 0 FROM g WHERE many_sex OR many_disease OR many_eth) AS metadata_arm_eligible, development_stage_raw, n_cells FROM a""",
)
def donor_metadata(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    stage = (
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("c_mktsegment") == "HOUSEHOLD"), "99-year-old stage")
        .when(F.col("c_nationkey") == 3, "adult stage")
        .otherwise(F.concat((20 + F.col("c_nationkey")).cast("string"), F.lit("-year-old stage")))
    )
    rows = rows.select(
        F.col("o_custkey").alias("donor_id"), F.col("c_mktsegment").alias("disease"),
        F.when(F.col("c_acctbal") < 0, "female").otherwise("male").alias("sex"), F.col("n_name").alias("self_reported_ethnicity"),
        stage.alias("development_stage"),
    )
    return dn.donor_metadata(rows, case_disease="BUILDING").withColumn("age", F.col("age").cast("double"))


@query(
    "patient_summary",
    r6(
        f"""WITH {CELLS} SELECT donor_id, min(grp) AS grp, quantile_cont(score, 0.5) AS median_score,
    array_to_string(list_sort(list_distinct(list(cell_type))), '|') AS cell_types, count(*) AS n_cells FROM cells GROUP BY donor_id""",
        "median_score",
    ),
)
def patient_summary(spark, sf):
    return rounded(dn.patient_summary(cells(spark, sf), "donor_id", "grp", "score", "cell_type"))


@query(
    "aligned_feature_join",
    """WITH a AS (SELECT o_custkey AS donor_id, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT donor_id, n_orders, c_acctbal AS balance FROM a JOIN customer ON c_custkey = donor_id""",
)
def aligned_feature_join(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "donor_id")
    a = o.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("donor_id"), F.col("c_acctbal").alias("balance"))
    return dn.aligned_join(a, b.join(o, "donor_id", "left_semi"), "donor_id")


@query("attached_metadata", "SELECT o_custkey AS donor_id, o_orderkey AS cell_id, c_mktsegment AS grp FROM orders JOIN customer ON c_custkey = o_custkey")
def attached_metadata(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("donor_id"), F.col("o_orderkey").alias("cell_id"))
    return dn.attach(rows, table(spark, sf, "customer").select(F.col("c_custkey").alias("donor_id"), F.col("c_mktsegment").alias("grp")), "donor_id")


@query(
    "expected_observed_counts",
    """WITH o AS (SELECT l_orderkey AS cell_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS cell_id, 4::DOUBLE AS expected, n::DOUBLE AS observed, CASE WHEN n IS NULL THEN 'missing' ELSE 'different' END AS status
    FROM orders LEFT JOIN o ON cell_id = o_orderkey WHERE n IS NULL OR n <> 4""",
)
def expected_observed_counts(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.lit(4.0).alias("n"))
    observed = counts(spark, sf).groupBy("cell_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return dn.compare_counts(expected, observed, "cell_id", "n")


@query(
    "result_recheck",
    """WITH a AS (SELECT o_custkey AS donor_id, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)
    SELECT donor_id, round(v, 0) AS recorded, v AS recomputed, round(abs(round(v, 0) - v), 6) AS abs_diff, abs(round(v, 0) - v) < 0.253 AS matches FROM a""",
)
def result_recheck(spark, sf):
    live = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("donor_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return rounded(dn.compare_results(live.withColumn("v", F.round("v", 0)), live, "donor_id", "v", 0.253))


@query(
    "cohort_union",
    """SELECT c_custkey AS donor_id, c_acctbal AS value, (n_regionkey >= 3)::INTEGER AS cohort_label FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def cohort_union(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    side = lambda cond: rows.where(cond).select(F.col("c_custkey").alias("donor_id"), F.col("c_acctbal").alias("value"))
    return dn.cohort_union(side(F.col("n_regionkey") < 3), side(F.col("n_regionkey") >= 3))


@query("label_balance", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality")
def label_balance(spark, sf):
    return dn.label_balance(table(spark, sf, "labels").select(F.col("quality").alias("label")), "label")


@query(
    "missing_token_normalization",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED') THEN 'TODO' ELSE trim(o_orderpriority) END AS o_orderpriority FROM orders""",
)
def missing_token_normalization(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return col.normalize_missing(rows, ["o_orderpriority"], tokens=("", "4-NOT SPECIFIED"))


@query(
    "canonical_projection",
    """SELECT o_orderkey::VARCHAR AS cell_id, o_orderstatus AS batch, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority,
    NULL::DOUBLE AS unreadable FROM orders WHERE trim(o_orderpriority) <> ''""",
)
def canonical_projection(spark, sf):
    rows = col.drop_blank(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority").select(
        "o_orderkey", "o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority"), F.col("o_orderpriority").alias("unreadable")
    )
    named = col.rename_fields(rows, {"o_orderkey": "cell_id", "o_orderstatus": "batch", "not_there": "x"})
    return col.canonical(named, ["cell_id", "batch"], ["priority", "unreadable"])


@query(
    "eligible_rows",
    """SELECT c_mktsegment AS grp, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
)
def eligible_rows(spark, sf):
    rows = table(spark, sf, "customer").withColumn("eligible", F.col("c_acctbal") >= 0)
    return rows.where(F.col("eligible") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_mktsegment").alias("grp")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "sanitized_names",
    """WITH n AS (SELECT o_orderpriority AS raw FROM orders UNION ALL SELECT p_name || '--' || p_type FROM part UNION ALL SELECT url FROM pages)
    SELECT coalesce(nullif(trim(regexp_replace(lower(trim(raw)), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'unknown') AS name, count(*) AS n FROM n GROUP BY 1""",
)
def sanitized_names(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw"))
    raw = raw.unionByName(table(spark, sf, "part").select(F.concat_ws("--", "p_name", "p_type").alias("raw")))
    raw = raw.unionByName(table(spark, sf, "pages").select(F.col("url").alias("raw")))
    return raw.groupBy(sc.sanitize("raw").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parsed_ages",
    """SELECT c_custkey AS donor_id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE 20 + c_nationkey END::DOUBLE AS age FROM customer""",
)
def parsed_ages(spark, sf):
    years = (20 + F.col("c_nationkey")).cast("string")
    stage = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(years, F.lit("-year-old"))).otherwise(F.concat(years, F.lit("-year-old stage")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("donor_id"), sc.parse_age(stage).cast("double").alias("age"))


@query("mito_flags", f"WITH {GENES} SELECT gene_id, upper(gene_symbol) LIKE 'PROMO-%' AS is_mito FROM genes")
def mito_flags(spark, sf):
    return qc.mito_genes(genes(spark, sf), prefix="promo-").select("gene_id", "is_mito")


@query(
    "mito_summary",
    f"""WITH {GENES} SELECT count(*) AS total_genes, count(*) FILTER (gene_symbol LIKE 'PROMO-%') AS mito_genes,
    count(*) FILTER (gene_symbol NOT LIKE 'PROMO-%') AS non_mito_genes FROM genes""",
)
def mito_summary(spark, sf):
    return qc.mito_summary(qc.mito_genes(genes(spark, sf), prefix="promo-"))


@query("duplicate_symbols", f"WITH {GENES} SELECT gene_symbol, count(*) AS n FROM genes GROUP BY 1 HAVING count(*) > 1")
def duplicate_symbols(spark, sf):
    return cat.duplicate_symbols(genes(spark, sf))


_MAPPING = f"""{GENES}, d AS (SELECT gene_symbol FROM genes GROUP BY 1 HAVING count(*) > 1),
  m AS (SELECT g.gene_id, g.gene_symbol, 'mapped' AS mapping_status, g.gene_symbol IN (SELECT gene_symbol FROM d) AS duplicate_flag, false AS unmapped_flag,
    g.gene_id IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1) AS foundation_vocab_match, g.gene_symbol LIKE 'SMALL-%' AS pathway_eligible FROM genes g)"""


def _mapping(spark, sf):
    vocab = table(spark, sf, "lineitem").where(F.col("l_discount") == 0.1).select(F.col("l_partkey").alias("gene_id"))
    g = genes(spark, sf)
    return cat.gene_mapping_report(g, vocab, g.where(F.col("gene_symbol").startswith("SMALL-")))


@query("gene_mapping_report", f"WITH {_MAPPING} SELECT * FROM m")
def gene_mapping_report(spark, sf):
    return _mapping(spark, sf)


@query(
    "gene_mapping_summary",
    f"""WITH {_MAPPING} SELECT count(*) AS total_rows, count(*) FILTER (mapping_status = 'mapped') AS mapped_rows, count(*) FILTER (unmapped_flag) AS unmapped_rows,
    count(*) FILTER (duplicate_flag) AS duplicate_rows, count(*) FILTER (foundation_vocab_match) AS foundation_vocab_matches,
    count(*) FILTER (pathway_eligible) AS pathway_eligible_rows FROM m""",
)
def gene_mapping_summary(spark, sf):
    return cat.mapping_summary(_mapping(spark, sf))


@query("boolean_parse", "SELECT doc_id, quality = 1 AS is_quality, toxic = 1 AS is_toxic FROM labels")
def boolean_parse(spark, sf):
    rows = table(spark, sf, "labels")
    yes = F.when(F.col("toxic") == 1, " Yes ").otherwise("no")
    return rows.select("doc_id", sc.as_true("quality").alias("is_quality"), sc.as_true(yes).alias("is_toxic"))


@query(
    "missing_tests",
    """SELECT count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n_missing, count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS n_known FROM orders""",
)
def missing_tests(spark, sf):
    unknown = col.is_missing(F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    return table(spark, sf, "orders").agg(F.count_if(unknown).alias("n_missing"), F.count_if(~unknown).alias("n_known"))


@query(
    "centre_distances",
    r6(
        """WITH m AS (SELECT label, pos, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
    x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    d AS (SELECT vec_id, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN m USING (label, pos) GROUP BY vec_id)
    SELECT vec_id, distance, 1 / (distance + 1) AS inverse FROM d""",
        "distance",
        "inverse",
    ),
)
def centre_distances(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    centre = dn.mean_pool(v, "label", cell="vec_id").select("label", F.col("embedding").alias("centre"))
    d = v.join(centre, "label").select("vec_id", sc.euclidean("embedding", "centre").alias("distance"))
    return rounded(d.withColumn("inverse", sc.inverse_distance("distance")))


@query(
    "json_list_medians",
    r6(
        """SELECT l_returnflag AS grp, avg(l_quantity + l_discount + l_tax - greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax)) AS mean_median
    FROM lineitem GROUP BY 1""",
        "mean_median",
    ),
)
def json_list_medians(spark, sf):
    text = F.to_json(F.array("l_quantity", "l_discount", "l_tax"))
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), sc.array_median(sc.json_doubles(text)).alias("m"))
    return rounded(rows.groupBy("grp").agg(F.avg("m").alias("mean_median")))


@query("composite_keys", "SELECT l_partkey::VARCHAR || '::' || l_suppkey::VARCHAR AS candidate_key, count(*) AS n FROM lineitem GROUP BY 1")
def composite_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy(sc.composite_key("l_partkey", "l_suppkey").alias("candidate_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_shift",
    """WITH b AS (SELECT o_custkey AS donor_id, round(avg(o_totalprice), 6) AS baseline FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    p AS (SELECT o_custkey AS donor_id, round(avg(o_totalprice), 6) AS perturbed FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    s AS (SELECT donor_id, baseline, perturbed, round(perturbed - baseline, 6) AS score_shift FROM b JOIN p USING (donor_id))
    SELECT *, abs(score_shift) AS abs_score_shift, CASE WHEN score_shift > 0 THEN 'increase' WHEN score_shift < 0 THEN 'decrease' ELSE 'no_change' END AS direction FROM s""",
)
def score_shift_query(spark, sf):
    side = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("donor_id")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("score")
    )
    return score_shift(side("F"), side("O"))
