"""Queries: fitted models, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlake.functions.columns import rounded
from donorlake.operators import donors as dn
from donorlake.operators import metrics as mt
from donorlake.operators import models as md
from donorlake.operators import pseudobulk as pb
from donorlake.operators import quasi_newton as qn
from donorlake.operators import splits as sp
from donorlake.operators import trees as tr
from donorlake.plans import arms
from donorlake.plans.registry import CELLS, COUNTS, cells, counts, query, r6, table
from donorlake.session import durable, scratch, written
from donorlake.sources import matrix_market, ranges, tables
from donorlake.streaming import incremental


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("donor_id"), (F.col("label") < 5).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features")
    )


def _nations(spark, sf):
    """Nations as donors: composition, size, one missing numeric and one categorical field; two regions are the cases."""
    rows = cells(spark, sf)
    types = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = dn.composition_wide(rows, types, "nation_id").withColumnRenamed("nation_id", "donor_id")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("donor_id"), (F.col("n_regionkey") < 2).cast("int").alias("label"))
    people = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("donor_id")).agg(
        F.avg("c_acctbal").alias("age"), F.max_by("c_mktsegment", F.struct("c_acctbal", "c_custkey")).alias("sex")
    )
    out = wide.join(n, "donor_id").join(people, "donor_id")
    return out.withColumns({"age": F.when(F.col("age") > 4300, F.col("age")), "sex": F.when(F.col("n_cells") % 7 != 0, F.col("sex"))})


_NUMERIC = ("age", "n_cells", "cell_type_prop_1_urgent", "cell_type_prop_2_high", "cell_type_prop_3_medium", "cell_type_prop_4_not_specified", "cell_type_prop_5_low")


@query("nested_cross_validation")
def nested_cross_validation(spark, sf):
    """Out-of-fold scores of every vector: 5 × 5 folds, six values of C."""
    oof, _ = md.nested_cv(_vectors(spark, sf), seed=20260719)
    return rounded(oof.select("donor_id", "label", "fold", "score"))


@query("selected_hyperparameters")
def selected_hyperparameters(spark, sf):
    _, picks = md.nested_cv(_vectors(spark, sf), seed=20260719)
    return picks.select("fold", "c").withColumn("c_frozen", md.frozen_c(picks).select("c_frozen").scalar())


@query("repeated_cross_validation")
def repeated_cross_validation(spark, sf):
    runs = md.repeated_cv(_vectors(spark, sf), 10, 20260719)
    return rounded(md.repeated_summary(runs.withColumn("arm", F.lit("vectors"))))


@query("arm_run")
def arm_run(spark, sf):
    """AUROC, interval, refit permutation p and sanity flag of the vector arm."""
    return rounded(arms.run_arm("vectors", _vectors(spark, sf), 7, permutation_c=0.01))


@query("external_scoring")
def external_scoring(spark, sf):
    """Fit on four fifths of the vectors at a frozen C, score the rest, overall and per stratum."""
    rows = sp.shuffled_kfold(_vectors(spark, sf), 5, seed=3).withColumn("stratum_id", F.when(F.col("features")[0] > 0, "high").otherwise("low"))
    dev, ext = rows.where(F.col("fold") != 4), rows.where(F.col("fold") == 4)
    _, summary = arms.external_arm(dev.drop("fold"), ext.drop("fold"), 0.01, 5, "stratum_id")
    return rounded(summary)


@query("cohort_probe")
def cohort_probe(spark, sf):
    """Vectors of two label groups as two cohorts: how well membership is predicted."""
    v = table(spark, sf, "embeddings")
    side = lambda cond: v.where(cond).select(F.col("vec_id").alias("donor_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rounded(arms.cohort_probe(side(F.col("label") < 7), side(F.col("label") >= 7), 7, permutation_c=0.01))


@query("metadata_leave_one_out")
def metadata_leave_one_out(spark, sf):
    """Metadata-only predictions of each nation, preparation and fit inside the fold."""
    out = arms.metadata_loocv(_nations(spark, sf), _NUMERIC, ["sex"])
    return rounded(out)


@query("permutation_leave_one_out")
def permutation_leave_one_out(spark, sf):
    """100 refits of the whole leave-one-out on shuffled labels; gaps are imputed inside each fold."""
    design, scaled = arms.metadata_design(_nations(spark, sf), _NUMERIC, ["sex"])
    rows = durable(design.select("donor_id", "label", "features", "fill"))
    return rounded(md.permutation_loocv(rows.drop("fill"), 100, 42, scaled=scaled, fills=rows.select("donor_id", "fill")))


@query("permutation_refit")
def permutation_refit(spark, sf):
    """Cross-validation refitted on 1,000 permuted labellings at the published fixed C."""
    return rounded(md.permutation_refit(_vectors(spark, sf), 1000, 7, fixed_c=0.01))


@query("wide_feature_cross_validation")
def wide_feature_cross_validation(spark, sf):
    """Pseudobulk arm: nations against all genes, far more features than donors, C fixed."""
    features = arms.pseudobulk_features(counts(spark, sf), cells(spark, sf).withColumn("donor_id", F.col("nation_id")))
    donors = table(spark, sf, "nation").select(F.col("n_nationkey").alias("donor_id"), (F.col("n_regionkey") < 2).cast("int").alias("label"))
    return rounded(md.cv_wide(features, donors, 7, 0.01, feature="gene_id", value="log1p_cpm"))


_WIDE_C = (0.01, 1.0)


@query(
    "wide_fit_residuals",
    f"""WITH {CELLS}, {COUNTS}, donors AS (
      SELECT DISTINCT nation_id AS donor_id, (n_regionkey < 2)::INT AS label, nation_id % 5 AS fold
      FROM counts JOIN cells USING (cell_id) JOIN nation ON nation_id = n_nationkey)
    SELECT f.fold::INT AS fold, c::DOUBLE AS c, count(*) AS n_train, sum(label)::BIGINT AS n_cases, true AS converged, 0.0::DOUBLE AS kkt
    FROM range(0, 5) f(fold) JOIN donors d ON d.fold <> f.fold CROSS JOIN (VALUES ({_WIDE_C[0]}), ({_WIDE_C[1]})) v(c) GROUP BY f.fold, c""",
)
def wide_fit_residuals(spark, sf):
    """Nations against all genes by the matrix-free solver, five folds and two values of C: every fit's gradient is zero."""
    features = arms.pseudobulk_features(counts(spark, sf), cells(spark, sf).withColumn("donor_id", F.col("nation_id")))
    donors = table(spark, sf, "nation").select(F.col("n_nationkey").alias("donor_id"), (F.col("n_regionkey") < 2).cast("int").alias("label"))
    features = written(features.select("donor_id", "gene_id", "log1p_cpm"), "wide-features")  # read by all of the next steps
    positions = written(pb.feature_positions(features, "gene_id"), "wide-positions")
    blocks = pb.blocked_arrays(features, positions, feature="gene_id", value="log1p_cpm")
    size = positions.count()
    rows = pb.model_rows(blocks, size).join(donors, "donor_id")
    rows = durable(rows.withColumns({"rep": F.lit(0), "folds": F.array((F.col("donor_id") % 5).cast("int"))}))
    fits = [md.Fit(0, ((0, i),), c) for i in range(5) for c in _WIDE_C]
    fitted = md.fit_logistic(rows, fits, size, solver="matrix-free")
    fold = spark.createDataFrame([(i, f.out[0][1]) for i, f in enumerate(fits)], "fit int, fold int")
    out = qn.residuals(fits, fitted.kkt, fitted.n_train, fitted.n_cases, fitted.converged, spark).join(fold, "fit")
    return out.select("fold", "c", "n_train", "n_cases", "converged", F.round("kkt", 5).alias("kkt"))


# Newton's method for two standardised features and an intercept: sums over all rows, then the 3 x 3 solve by cofactors.
_NEWTON = """
raw AS (SELECT (label < 5)::INT AS y, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings),
z AS (SELECT y, (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS z1, (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS z2 FROM raw),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b
  UNION ALL
  SELECT k + 1,
    w1 - ((h22 * h33 - h23 * h23) * g1 + (h13 * h23 - h12 * h33) * g2 + (h12 * h23 - h13 * h22) * g3) / det,
    w2 - ((h13 * h23 - h12 * h33) * g1 + (h11 * h33 - h13 * h13) * g2 + (h12 * h13 - h11 * h23) * g3) / det,
    b - ((h12 * h23 - h13 * h22) * g1 + (h12 * h13 - h11 * h23) * g2 + (h11 * h22 - h12 * h12) * g3) / det
  FROM (
    SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h13 * h23) + h13 * (h12 * h23 - h13 * h22) AS det FROM (
      SELECT k, w1, w2, b, w1 + C * sum((p - y) * z1) AS g1, w2 + C * sum((p - y) * z2) AS g2, C * sum(p - y) AS g3,
        1 + C * sum(p * (1 - p) * z1 * z1) AS h11, C * sum(p * (1 - p) * z1 * z2) AS h12, C * sum(p * (1 - p) * z1) AS h13,
        1 + C * sum(p * (1 - p) * z2 * z2) AS h22, C * sum(p * (1 - p) * z2) AS h23, C * sum(p * (1 - p)) AS h33
      FROM (SELECT steps.*, z.*, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS p FROM steps, z WHERE k < 12) GROUP BY k, w1, w2, b)))"""


@query(
    "two_feature_fit",
    f"""WITH RECURSIVE {_NEWTON.replace("C *", "0.1 *")}
    SELECT unnest(['intercept', 'x1', 'x2']) AS term, round(unnest([b, w1, w2]), 6) AS weight FROM steps WHERE k = 12""",
)
def two_feature_fit(spark, sf):
    """Weights of two standardised dimensions by the matrix-free solver."""
    rows = _vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    rows = durable(rows.withColumns({"rep": F.lit(0), "folds": F.array(F.lit(0))}))
    fitted = md.fit_logistic(rows, [md.Fit(0, ((0, -1),), 0.1)], 2, solver="matrix-free")
    w = fitted.weights[0]
    return rounded(spark.createDataFrame(list(zip(("intercept", "x1", "x2"), (float(w[2]), float(w[0]), float(w[1])))), "term string, weight double"))


@query("model_coefficients")
def model_coefficients(spark, sf):
    rows = _vectors(spark, sf)
    names = [f"dim_{i:03d}" for i in range(rows.select(F.max(F.size("features"))).head()[0])]
    return rounded(md.coefficients(md.fit_final(rows, 0.1), names, spark))


@query("tree_importances")
def tree_importances(spark, sf):
    rows = _vectors(spark, sf)
    names = [f"dim_{i:03d}" for i in range(rows.select(F.max(F.size("features"))).head()[0])]
    return rounded(md.tree_importances(rows, names))


_FOREST = {"trees": 4, "depth": 3, "bins": 32, "subset": 12, "seed": 5}


def _forest_sql() -> str:
    """The forest in SQL: bins, weights and feature subsets by the same rules, one block of statements per level."""
    f = _FOREST
    u = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    weight = " + ".join(f"({u(chr(39) + str(f['seed']) + '|w|' + chr(39) + ' || tree || ' + chr(39) + '|' + chr(39) + ' || id')} >= {x})::BIGINT" for x in tr.poisson_steps())
    blocks = [
        "x AS (SELECT vec_id AS id, (label < 5)::INTEGER AS y, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INTEGER AS feature FROM embeddings)",
        "bounds AS (SELECT feature, min(v) AS low, max(v) AS high FROM x GROUP BY 1)",
        f"b AS (SELECT id, y, feature, CASE WHEN high > low THEN least(floor((v - low) / (high - low) * {f['bins']}.0::DOUBLE)::INTEGER, {f['bins'] - 1}) ELSE 0 END AS bin FROM x JOIN bounds USING (feature))",
        f"r0 AS (SELECT *, 1::BIGINT AS node FROM (SELECT id, tree, {weight} AS w FROM (SELECT DISTINCT id FROM x), (SELECT unnest(range({f['trees']}))::INTEGER AS tree)) WHERE w > 0)",
    ]
    for d in range(f["depth"]):
        order = u(f"'{f['seed']}|f|' || tree || '|' || node || '|' || feature")
        blocks += [
            f"""a{d} AS (SELECT tree, node, feature FROM (SELECT DISTINCT tree, node FROM r{d}), (SELECT DISTINCT feature FROM b)
                QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {order}, feature) <= {f['subset']})""",
            f"h{d} AS (SELECT tree, node, feature, bin, sum(w)::BIGINT AS n, sum(w * y)::BIGINT AS p FROM r{d} JOIN b USING (id) JOIN a{d} USING (tree, node, feature) GROUP BY ALL)",
            f"""c{d} AS (SELECT tree, node, feature, bin, sum(n) OVER u AS nl, sum(p) OVER u AS pl, sum(n) OVER t AS n, sum(p) OVER t AS p FROM h{d}
                WINDOW t AS (PARTITION BY tree, node, feature), u AS (PARTITION BY tree, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING))""",
            f"""g{d} AS (SELECT tree, node, feature, bin, pl::DOUBLE * pl::DOUBLE / nl::DOUBLE + (p - pl)::DOUBLE * (p - pl)::DOUBLE / (n - nl)::DOUBLE - p::DOUBLE * p::DOUBLE / n::DOUBLE AS gain, n, p
                FROM c{d} WHERE nl < n)""",
            f"s{d} AS (SELECT * FROM g{d} WHERE gain > {tr.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, bin) = 1)",
            f"r{d + 1} AS (SELECT r.id, r.tree, r.w, 2 * r.node + (b.bin > s.bin)::BIGINT AS node FROM r{d} r JOIN s{d} s USING (tree, node) JOIN b ON b.id = r.id AND b.feature = s.feature)",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(f["depth"]))
    threshold = f"low + (bin + 1)::DOUBLE * (high - low) / {f['bins']}.0::DOUBLE"
    blocks.append(f"splits AS (SELECT tree, node, feature, bin, {threshold} AS threshold, gain, n::BIGINT AS n, p::BIGINT AS positives FROM ({every}) JOIN bounds USING (feature))")
    return "WITH " + ",\n".join(blocks)


@query("tree_splits", r6(f"{_forest_sql()} SELECT * FROM splits", "threshold", "gain"))
def tree_splits(spark, sf):
    """Every split of a small forest on the vectors, with its gain."""
    return rounded(tr.grow(_vectors(spark, sf), bootstrap=True, **_FOREST))


@query(
    "forest_importances",
    r6(
        f"""{_forest_sql()}, g AS (SELECT tree, feature, sum(gain) AS g FROM splits GROUP BY ALL), t AS (SELECT tree, sum(gain) AS a FROM splits GROUP BY 1)
    SELECT feature, sum(g / a) / (SELECT count(*) FROM t) AS importance FROM g JOIN t USING (tree) GROUP BY 1""",
        "importance",
    ),
)
def forest_importances(spark, sf):
    return rounded(tr.importances(tr.grow(_vectors(spark, sf), bootstrap=True, **_FOREST)))


@query("vector_arm_metrics")
def vector_arm_metrics(spark, sf):
    oof, _ = md.nested_cv(_vectors(spark, sf), seed=1)
    return rounded(mt.prediction_summary(oof))


# --- files --------------------------------------------------------------------------------


@query(
    "csv_round_trip",
    "SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, o_totalprice, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS cell_type FROM orders",
)
def csv_round_trip(spark, sf):
    """Write a table as CSV with NULLs empty, read it back with text ids."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cell_id"), "o_totalprice", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("cell_type")
    )
    path = scratch(spark, "cells") + ".csv"
    tables.write_csv(rows, path, rows.columns)
    return tables.read_table(spark, path, ids=["cell_id"])


@query("parquet_round_trip", "SELECT l_orderkey AS cell_id, l_partkey AS gene_id, l_quantity AS value FROM lineitem WHERE l_partkey < 100 AND l_quantity > 10")
def parquet_round_trip(spark, sf):
    """Write counts sorted by gene as zstd parquet; a gene range read back skips row groups."""
    path = scratch(spark, "counts") + ".parquet"
    tables.write_parquet(counts(spark, sf), path, ["gene_id"])
    return tables.scan(spark, path, ["cell_id", "gene_id", "value"], (F.col("gene_id") < 100) & (F.col("value") > 10))


def _write_matrices(spark, sf, path):
    """One coordinate file per nation: genes × cells, 1-based, size line first."""
    rows = counts(spark, sf).join(cells(spark, sf).select("cell_id", "nation_id"), "cell_id")
    entry = rows.select("nation_id", F.lit(2).alias("o"), F.concat_ws(" ", (F.col("gene_id") + 1).cast("string"), (F.col("cell_id") + 1).cast("string"), F.col("value").cast("string")).alias("line"))
    head = rows.groupBy("nation_id").agg(
        F.concat_ws(" ", (F.max("gene_id") + 1).cast("string"), (F.max("cell_id") + 1).cast("string"), F.count(F.lit(1)).cast("string")).alias("line")
    ).withColumn("o", F.lit(1))
    banner = head.select("nation_id", F.lit(0).alias("o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("line"))
    every = entry.unionByName(head).unionByName(banner)
    every.repartition("nation_id").sortWithinPartitions("nation_id", "o").select("nation_id", "line").write.partitionBy("nation_id").text(path)
    return F.regexp_extract("file", "nation_id=([0-9]+)", 1).cast("int")


@query(
    "matrix_market_pseudobulk",
    f"""WITH {CELLS}, {COUNTS} SELECT nation_id AS sample_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY ALL""",
)
def matrix_market_pseudobulk(spark, sf):
    """Coordinate files of all samples read back, named by the gene list, and summed per sample."""
    path = scratch(spark, "matrices")
    sample = _write_matrices(spark, sf, path)
    names = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("gene_ix"), F.col("p_partkey").alias("gene_id"))
    rows = matrix_market.read_mtx(spark, f"{path}/*", names, sample)
    return rows.groupBy("sample_id", "gene_id").agg(F.sum("value").alias("value"))


@query(
    "matrix_market_sizes",
    f"""WITH {CELLS}, {COUNTS} SELECT nation_id AS sample_id, max(gene_id) + 1 AS n_genes, max(cell_id) + 1 AS n_cells, count(*) AS nnz FROM counts JOIN cells USING (cell_id) GROUP BY ALL""",
)
def matrix_market_sizes(spark, sf):
    path = scratch(spark, "matrices")
    sample = _write_matrices(spark, sf, path)
    return matrix_market.declared_sizes(spark, f"{path}/*", sample).drop("file")


@query(
    "matrix_directory",
    """WITH v AS (SELECT 'group_' || label AS donor_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cell_ix, embedding FROM embeddings)
    SELECT donor_id, cell_ix, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM v""",
)
def matrix_directory(spark, sf):
    """Vectors of every label group written as one matrix file each, and read back by ranges of rows."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("group_"), F.col("label").cast("string")).alias("donor_id"), F.col("vec_id").alias("cell_ix"), "embedding")
    path = scratch(spark, "matrix-files")
    ranges.write_matrices(rows, path)
    back = ranges.read_matrices(spark, path, range_bytes=10_000)
    return back.select("donor_id", "cell_ix", F.posexplode("embedding").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))


@query("gene_list_round_trip", "SELECT p_type || '-' || p_name AS gene_id FROM part WHERE p_brand <> 'Brand#2'")
def gene_list_round_trip(spark, sf):
    """A headerless tab-separated gene list; genes of one brand are blank and skipped."""
    path = scratch(spark, "genes")
    name = F.when(F.col("p_brand") != "Brand#2", F.concat_ws("-", "p_type", "p_name")).otherwise(F.lit(" "))
    table(spark, sf, "part").select(F.col("p_partkey"), name.alias("n")).write.option("sep", "\t").csv(path)
    return tables.read_gene_list(spark, path, 1)


@query(
    "json_results_lookup",
    r6("SELECT o_orderstatus AS arm, avg(o_totalprice) AS value FROM orders GROUP BY 1", "value"),
)
def json_results_lookup(spark, sf):
    path = scratch(spark, "results") + ".json"
    tables.write_json(table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("arm")).agg(F.avg("o_totalprice").alias("value")), path)
    return rounded(spark.read.schema("arm string, value double").json(path))


# --- stream ---------------------------------------------------------------------------------


@query("incremental_pseudobulk", f"WITH {CELLS}, {COUNTS} SELECT nation_id AS donor_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY ALL")
def incremental_pseudobulk(spark, sf):
    """Counts arriving as chunk files, summed batch by batch, equal to the one-pass sum."""
    chunks, out, state = scratch(spark, "chunks"), scratch(spark, "partials"), scratch(spark, "stream")
    counts(spark, sf).repartition(4).write.parquet(chunks)
    stream = incremental.stream_counts(spark, chunks, "cell_id bigint, gene_id bigint, value double")
    people = cells(spark, sf).select("cell_id", F.col("nation_id").alias("donor_id"))
    incremental.append_partial_sums(stream, out, state, people).awaitTermination()
    return incremental.read_sums(spark, out)


@query("compacted_pseudobulk", f"WITH {CELLS}, {COUNTS} SELECT nation_id AS donor_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY ALL")
def compacted_pseudobulk(spark, sf):
    """Nine micro-batches, merged by twos while the stream goes on, equal to the one-pass sum."""
    chunks, out, state = scratch(spark, "chunks"), scratch(spark, "partials"), scratch(spark, "stream")
    rows = counts(spark, sf)
    people = cells(spark, sf).select("cell_id", F.col("nation_id").alias("donor_id"))
    for part, files in ((0, 5), (1, 4)):
        rows.where(F.col("cell_id") % 2 == part).repartition(files).write.mode("append").parquet(chunks)
        stream = incremental.stream_counts(spark, chunks, "cell_id bigint, gene_id bigint, value double", files_per_batch=1)
        incremental.append_partial_sums(stream, out, state, people).awaitTermination()
        incremental.compact_sums(spark, out, state, fanout=2)
    return incremental.read_sums(spark, out)


@query(
    "incremental_log_cpm",
    r6(
        f"""WITH {CELLS}, {COUNTS}, s AS (SELECT nation_id AS donor_id, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY ALL)
    SELECT donor_id, gene_id, ln(1 + value / sum(value) OVER (PARTITION BY donor_id) * 1e6) AS log1p_cpm FROM s""",
        "log1p_cpm",
    ),
)
def incremental_log_cpm(spark, sf):
    return rounded(pb.cpm_log1p(incremental_pseudobulk(spark, sf)).select("donor_id", "gene_id", "log1p_cpm"))
