"""Many refits at once: the shared solver beside Newton's method, and orders of replicates in one window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.operators import models as md
from donorlake.operators.ordering import hash_rank
from donorlake.plans import arms


def people(spark, n=90, p=6):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, p)) * np.linspace(0.1, 30, p) + np.linspace(-5, 500, p)
    x[:, 1] += 0.02 * x[:, -2]
    x[:, -1] = 7.0  # constant
    y = (x[:, 0] + rng.normal(0, 0.1, n) > -5).astype(int)
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "donor_id long, label int, features array<double>").repartition(3)


@pytest.mark.parametrize("c", [0.01, 0.1, 1.0])
def test_shared_solver_reaches_newtons_optimum(spark, c, monkeypatch):
    df = people(spark)
    labels = md.shuffled_labels(df.select("donor_id", "label"), 7, 3)
    one = labels.withColumn("label", F.when(F.col("rep") == 6, 0).otherwise(F.col("label")))  # a replicate with one class
    packed = md.pack_replicates(md.fold_rows(one, 5, 5, 0, largest=90), df, "donor_id")
    fits = [md.Fit(r, ((0, o),), c) for r in range(7) for o in range(5)]
    a = md.fit_logistic(packed, fits, 6, solver="newton")
    with monkeypatch.context() as m:
        m.setattr(md, "_curvature", None)  # Newton's sums aren't asked for
        b = md.fit_logistic(packed, fits, 6, solver="shared")
    assert np.isnan(a.weights[30:]).all() and np.isnan(b.weights[30:]).all()
    assert np.abs(a.weights[:30] - b.weights[:30]).max() < 1e-8 and b.converged.all() and b.iterations < 25
    assert (a.n_train == b.n_train).all() and (a.n_cases == b.n_cases).all()
    assert np.allclose(a.mean, b.mean, rtol=1e-12) and np.allclose(a.scale, b.scale, rtol=1e-9)
    wide = {(r["rep"], r["donor_id"]): r["score"] for r in md.score_fits(packed, b).where("rep < 6").collect()}
    plain = md._place(md.fold_rows(one, 5, 5, 0).join(df.select("donor_id", "features"), "donor_id"), "donor_id")
    narrow = {(r["rep"], r["donor_id"]): r["score"] for r in md.score_fits(plain, a).where("rep < 6").collect()}
    assert wide.keys() == narrow.keys() and len(wide) == 6 * 90
    assert max(abs(wide[k] - narrow[k]) for k in wide) < 1e-8


def test_fits_that_need_another_solver_fall_back(spark, monkeypatch):
    df = people(spark)
    packed = md.pack_replicates(md.fold_rows(df.select("donor_id", "label"), 5, 5, 0), df, "donor_id")
    fits = [md.Fit(0, ((0, o),), 10.0) for o in range(5)]
    want = md.fit_logistic(packed, fits, 6, solver="newton").weights
    monkeypatch.setattr(md.qn, "TOGETHER_PASSES", 2)
    got = md.fit_logistic(packed, fits, 6, solver="shared")
    assert got.converged.all() and np.allclose(want, got.weights, atol=1e-9)
    # A feature that varies in one fold only has no spread in that fold's training side.
    lone = packed.withColumn("features", F.concat(F.slice("features", 1, 5), F.array(F.when((F.col("all_folds")[0] == 0) & (F.col("donor_id") % 2 == 0), 1.0).otherwise(0.0))))
    got = md.fit_logistic(lone, fits, 6, solver="shared")
    assert np.isinf(got.scale[0, 5]) and np.isfinite(got.scale[1:, 5]).all()


def test_one_window_gives_the_order_of_slices(spark):
    df = spark.range(0, 300).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    want, got = (sorted(hash_rank(df, "id", 9, ["rep"], "r", largest=n).select("rep", "id", "r").collect()) for n in (None, 300))
    assert want == got
    plan = hash_rank(df, "id", 9, ["rep"], "r", largest=300)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_an_arm_is_not_computed_once_per_column(spark):
    out = arms.run_arm("a", people(spark, 40), 1, fixed_c=0.1, n_bootstrap=20, n_permutations=3)
    plan = out._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Window" not in plan
    assert out.count() == 1


@pytest.mark.parametrize("name", ["arm_run", "cohort_probe"])
def test_arms_take_all_published_replicates(spark, monkeypatch, name):
    import inspect

    from donorlake.plans import all_queries

    seen, signature = [], inspect.signature(arms.run_arm)

    def recorded(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        seen.append((call.arguments["n_permutations"], call.arguments["n_bootstrap"], call.arguments["fixed_c"]))
        return spark.range(1)

    monkeypatch.setattr(arms, "run_arm", recorded)
    all_queries().QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [(1000, 5000, None)]


def test_a_fit_frees_what_it_sends_on_the_driver_too(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (gone.append(1), destroy(self, blocking))[1])
    rows = md._place(people(spark).withColumns({"rep": F.lit(0), "folds": F.array((F.col("donor_id") % 3).cast("int"))}), "donor_id")
    fitted = md.fit_logistic(rows, [md.Fit(0, ((0, 0),), 0.1)], 6, solver="matrix-free")
    assert fitted.converged.all() and len(gone) >= fitted.iterations + 2


@pytest.mark.parametrize("method", ["sum", "mean", "fraction"])
def test_cells_are_not_broadcast(spark, method):
    from donorlake.operators import pseudobulk as pb
    from donorlake.plans import registry as rg

    sf = "/root/testdata/sf0.001"
    out = pb.pseudobulk(rg.counts(spark, sf), rg.cells(spark, sf), "nation_id", method)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in x]
    assert not any("cell_id" in x or "custkey" in x or "orderkey" in x for x in joins)


def _broadcast_rows(spark, run):
    """The most rows that a broadcast of any job of ``run`` had."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    ids = lambda: {e.executionId() for e in (lambda x: [x.apply(i) for i in range(x.size())])(store.executionsList())}
    before = ids()  # old ones are dropped, so their number says nothing
    run()
    bus.waitUntilEmpty()
    most = 0
    for e in ids() - before:
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in [nodes.apply(i) for i in range(nodes.size())]:
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            most = max([most, *[int(v.get().replace(",", "")) for v in found if v.isDefined()]])
    return most


def test_an_external_arm_broadcasts_no_rows_times_replicates(spark):
    df = people(spark, 200).withColumn("side", (F.col("donor_id") % 2).cast("string"))
    run = lambda: arms.external_arm(df, df, 0.1, 2, "side", 100, 300)[1].collect()
    most = _broadcast_rows(spark, run)
    assert 0 < most <= 2 * 200  # in all and in strata; 300 replicates of 200 rows look as small to Spark as the rows
