"""Bootstrap, permutation and multiple-testing operators.

Replicates are a key. What a replicate draws depends on (seed, replicate, range of
ranks) or (seed, replicate, id) only, so results do not change with partitioning,
and a lost executor recomputes the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlake.operators import multinomial as mn
from donorlake.operators.ordering import mid_ranks, quota_slices, replicate_draw_sums, replicated, required, running_totals, union_all, with_group_totals
from donorlake.session import durable, task_slots


REPLICATES = 64  # replicates that a task weighs together


def _cells(df: DataFrame, scores: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """Rows folded to what counts, ``by…, _s0…, _y, _start, _end, _n``: the ranks of every cell in its stratum of ``_n`` rows."""
    value = lambda s: F.when(F.col(s).isNull(), F.raise_error(F.lit(f"{s} is NULL"))).otherwise(F.col(s).cast("double"))
    named = df.select(*by, *[value(s).alias(f"_s{i}") for i, s in enumerate(scores)], F.col(label).cast("int").alias("_y"))
    order = [*by, *[f"_s{i}" for i in range(len(scores))], "_y"]
    cells = named.groupBy(*order).agg(F.count(F.lit(1)).alias("_c"))
    placed = durable(cells.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.sum("_c").alias("_k"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_local", F.sum("_c").over(inside)).join(offsets, "_part").withColumn("_end", F.col("_before") + F.col("_local"))
    strata = ranked.groupBy(*by).agg(F.min(F.col("_end") - F.col("_c")).alias("_zero"), F.sum("_c").alias("_n"))
    whole = with_group_totals(ranked, strata, by)
    return whole.select(*order, (F.col("_end") - F.col("_c") - F.col("_zero")).alias("_start"), (F.col("_end") - F.col("_zero")).alias("_end"), "_n")


def _auroc_sums(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted positives, negatives and pairs won of sorted distinct scores, with ``below`` negatives under them (per replicate)."""
    under = np.cumsum(neg, axis=0) - neg + below
    return pos.sum(axis=0), neg.sum(axis=0), (pos * (under + 0.5 * neg)).sum(axis=0)


def bootstrap_auroc(
    df: DataFrame,
    scores: Sequence[str] = ("score",),
    label: str = "label",
    key: str = "donor_id",
    n: int = 5000,
    seed: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """AUROC of each arm on rows drawn with replacement, per replicate (and stratum).

    A replicate is a weight per distinct (scores, label), by ``multinomial``; no row is drawn or joined. All arms see the
    same draws. A replicate that drew one class only has a NULL AUROC; NULL scores fail. Rows with a NULL label are drawn
    but count for neither class. ``key`` isn't needed any more: rows that are equal in all that counts share their draws.
    """
    by, arms, spark = list(by), len(scores), df.sparkSession
    # Leaves are bounded; a cell that lies over several is cut.
    leaf, kinds = mn.LEAF, {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{c}` {kinds[c]}, " for c in by)
    cells = _cells(df, scores, label, by)
    values = [f"_s{i}" for i in range(arms)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges: dict[int, np.ndarray] = {}
        for pdf in batches:
            for size, part in pdf.groupby("_n"):
                if size not in edges:
                    edges = {size: np.array([lo for lo, _ in mn.leaves(int(size), leaf)] + [int(size)])}
                edge = edges[size]
                one = np.searchsorted(edge, part["_start"], side="right") - 1
                many = np.searchsorted(edge, part["_end"] - 1, side="right") - one
                part = part.loc[part.index.repeat(many)]
                at = np.repeat(one, many) + np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
                part = part.assign(_first=edge[at], _last=edge[at + 1])
                yield part.assign(_start=np.maximum(part["_start"], part["_first"]), _end=np.minimum(part["_end"], part["_last"]))

    shape = head + "".join(f"{v} double, " for v in values) + "_y int, _start bigint, _end bigint, _n bigint"
    pieces = cells.mapInPandas(cut, shape + ", _first bigint, _last bigint")
    stratum = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by])), 1, 8), 16, 10).cast("bigint") if by else F.lit(0).cast("bigint")
    pieces = durable(pieces.withColumn("_h", stratum))
    chunks = pieces.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // REPLICATES))))
    # A number of partitions of one's own: the rows are few but each stands for many binomial draws.
    chunks = chunks.repartition(task_slots(spark), *by, "_first", "_chunk")
    single = pieces.where("_first > 0 OR _last < _n").isEmpty()

    def weigh(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
        """The draws of a leaf's cells (in order) for one chunk of replicates."""
        pdf, row = pdf.sort_values("_start", kind="stable"), pdf.iloc[0]
        start = int(row["_chunk"]) * REPLICATES
        replicates = np.arange(start, min(n, start + REPLICATES))
        w = mn.cell_weights(int(row["_n"]), int(row["_first"]), int(row["_last"]), pdf["_end"].to_numpy(), seed, int(row["_h"]), replicates)
        return replicates, pdf, w

    def by_score(pdf: pd.DataFrame, w: np.ndarray, arm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score, at = np.unique(pdf[f"_s{arm}"].to_numpy(), return_inverse=True)
        y = pdf["_y"].to_numpy()
        out = []
        for side in (1, 0):
            sums = np.zeros((len(score), w.shape[1]), np.int64)
            np.add.at(sums, at[y == side], w[y == side])
            out.append(sums)
        return score, *out

    if single:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            replicates, pdf, w = weigh(pdf)
            parts = []
            for arm, name in enumerate(scores):
                pos, neg, won = _auroc_sums(*by_score(pdf, w, arm), np.zeros(len(replicates)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    auroc = np.where(pos * neg > 0, won / (pos * neg.astype(np.float64)), np.nan)
                parts.append(pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "arm": name, "replicate": replicates, "n_pos": pos, "n_neg": neg, "auroc": auroc}))
            return pd.concat(parts)

        schema = head + "arm string, replicate int, n_pos bigint, n_neg bigint, auroc double"
        done = chunks.groupBy(*by, "_first", "_chunk").applyInPandas(whole, schema)
        return done.withColumn("auroc", F.when(~F.isnan("auroc"), F.col("auroc")))

    # Several leaves: weights go on per score and chunk, are sorted by score, and partitions' sums meet in order.
    def per_score(pdf: pd.DataFrame) -> pd.DataFrame:
        _, pdf, w = weigh(pdf)
        parts = []
        for arm, name in enumerate(scores):
            score, pos, neg = by_score(pdf, w, arm)
            parts.append(pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "arm": name, "_chunk": pdf["_chunk"].iloc[0], "score": score, "pos": list(pos), "neg": list(neg)}))
        return pd.concat(parts)

    schema = head + "arm string, _chunk int, score double, pos array<bigint>, neg array<bigint>"
    weights = durable(chunks.groupBy(*by, "_first", "_chunk").applyInPandas(per_score, schema))
    order = [*by, "arm", "_chunk", "score"]
    ranged = weights.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    group = [*by, "arm", "_chunk", "_part"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of each group of a sorted partition; only the open group's sums are held, and its last score, which may go on."""
        held, tail = None, None  # [group, pos, neg, won], [score, pos, neg]

        def close(score, pos, neg):
            p, q, won = _auroc_sums(score, pos, neg, held[2])
            held[1], held[2], held[3] = held[1] + p, held[2] + q, held[3] + won

        def row():
            return pd.DataFrame([(*held[0], held[1], held[2], held[3])], columns=[*group, "pos", "neg", "won"])

        for pdf in batches:
            for name, part in pdf.groupby(group, sort=False, dropna=False):
                if held is None or held[0] != name:
                    if held is not None:
                        close(*tail)
                        yield row()
                    zero = np.zeros(len(part["pos"].iloc[0]))
                    held, tail = [name, zero, zero, zero], None
                score, pos, neg = part["score"].to_numpy(), np.stack(part["pos"].to_numpy()), np.stack(part["neg"].to_numpy())
                if tail is not None:
                    score, pos, neg = np.concatenate([tail[0], score]), np.concatenate([tail[1], pos]), np.concatenate([tail[2], neg])
                score, first = np.unique(score, return_index=True)
                pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
                if len(score) > 1:
                    close(score[:-1], pos[:-1], neg[:-1])
                tail = [score[-1:], pos[-1:], neg[-1:]]
        if held is not None:
            close(*tail)
            yield row()

    sums = ranged.mapInPandas(stream, head + "arm string, _chunk int, _part int, pos array<double>, neg array<double>, won array<double>")
    at = F.posexplode(F.arrays_zip("pos", "neg", "won")).alias("_at", "_v")
    flat = sums.select(*group, at).select(*group, "_at", "_v.*")
    earlier = Window.partitionBy(*by, "arm", "_chunk", "_at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    met = flat.groupBy(*by, "arm", (F.col("_chunk") * REPLICATES + F.col("_at")).cast("int").alias("replicate")).agg(
        F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"), F.sum("won").alias("won")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return met.select(*by, "arm", "replicate", "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).alias("auroc"))


def bootstrap_interval(replicates: DataFrame, value: str = "auroc", by: Sequence[str] = ("arm",), level: float = 0.95) -> DataFrame:
    """Percentile interval over the valid replicates, with how many were skipped. Groups hold one value per replicate."""
    tail = (1.0 - level) / 2.0
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1.0 - tail)))
    return replicates.groupBy(*by).agg(
        q[0].alias("ci_lower"), q[1].alias("ci_upper"), F.avg(value).alias("boot_mean"),
        F.count(value).alias("n_valid"), F.count_if(F.col(value).isNull()).alias("n_skipped"),
    )


def paired_difference(replicates: DataFrame, a: str, b: str, by: Sequence[str] = (), value: str = "auroc") -> DataFrame:
    """``a − b`` per replicate of two arms that shared their draws."""
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col(value)))
    return replicates.where(F.col("arm").isin(a, b)).groupBy(*by, "replicate").agg((side(a) - side(b)).alias("diff"))


def permutation_auroc(
    df: DataFrame,
    scores: Sequence[str] = ("score",),
    label: str = "label",
    key: str = "donor_id",
    n: int = 1000,
    seed: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """AUROC of fixed scores under shuffled labels.

    The scores never move, so their mid-ranks are computed once and written; a
    replicate only chooses which rows are positive and adds up their ranks.
    """
    by = list(by)
    rows = df.select(*by, key, label, *[F.col(s).cast("double").alias(s) for s in scores])
    for s in scores:
        ranks = mid_ranks(rows, s, by).select(*by, s, F.col("mid_rank").alias(f"_rank_{s}"))
        rows = rows.join(ranks, by + [s])
    totals = df.groupBy(*by).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    slim = durable(with_group_totals(rows.select(*by, key, *[f"_rank_{s}" for s in scores]), totals.select(*by, "_p"), by))
    # Dealt to all tasks first, since a small input sits in one partition and is multiplied in place.
    dealt = slim.repartition(task_slots(slim.sparkSession), *by, key)
    drawn = replicate_draw_sums(dealt, n, key, seed, "_p", [f"_rank_{s}" for s in scores], by)
    # Every stratum has all its replicates, also one without positives, which draws no rows.
    sums = totals.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(drawn.hint("merge"), [*by, "replicate"], "left")
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    value = lambda s: F.when((p > 0) & (q > 0), (F.col(f"_rank_{s}") - p * (p + 1) / 2) / (p * q))
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("arm"), value(s).alias("auroc")) for s in scores]))
    return sums.select(*by, "replicate", arms.alias("_a")).select(*by, "replicate", "_a.*")


def is_extreme(null: Column, observed: Column, alternative: str = "two-sided") -> Column:
    """How a null value counts: two-sided around 0.5, one-sided upper, or absolute difference."""
    tests = {
        "two-sided": F.abs(null - 0.5) >= F.abs(observed - 0.5),
        "greater": null >= observed,
        "difference": F.abs(null) >= F.abs(observed),
    }
    return tests[alternative]


def permutation_summary(
    null: DataFrame,
    observed: DataFrame,
    value: str = "auroc",
    by: Sequence[str] = ("arm",),
    alternative: str = "two-sided",
    ddof: int = 0,
) -> DataFrame:
    """Observed value, null moments and range, p = (1 + extreme) / (1 + valid), and the mean-near-0.5 sanity flag."""
    seen = observed.select(*by, F.col(value).alias("observed"))
    rows = with_group_totals(null, seen, by)
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    keys = [*by, "observed"] if by else ["observed"]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_permutations"), F.count(value).alias("n_valid"), F.avg(value).alias("null_mean"),
        sd.alias("null_std"), F.min(value).alias("null_min"), F.max(value).alias("null_max"),
        F.count_if(is_extreme(F.col(value), F.col("observed"), alternative)).alias("_x"),
    )
    centre = 0.0 if alternative == "difference" else 0.5
    return out.withColumns(
        {
            "p_value": (1.0 + F.col("_x")) / (1.0 + F.col("n_valid")),
            "null_mean_near_centre": F.abs(F.col("null_mean") - centre) < 0.05,
        }
    ).drop("_x")


def holm(tests: DataFrame, p: str = "p_value", name: str = "test", alpha: float = 0.05) -> DataFrame:
    """Step-down Holm for any number of tests.

    A test's step is one more than the number of smaller p-values; testing
    stops at the smallest p that misses ``alpha / (m − step + 1)``. Equal
    p-values share the strictest of their thresholds, which decides alike.
    """
    steps = running_totals(tests, p, {"n": F.count(F.lit(1))})
    steps = steps.withColumnRenamed("total_n", "_m").withColumn("step", F.col("cum_n") - F.col("n") + 1)
    steps = steps.withColumn("threshold", F.lit(alpha) / (F.col("_m") - F.col("step") + 1))
    stop = steps.agg(F.min(F.when(F.col(p) > F.col("threshold"), F.col(p))).alias("_stop"))
    judged = with_group_totals(steps, stop, [])
    significant = F.col("_stop").isNull() | (F.col(p) < F.col("_stop"))
    reason = (
        F.when(significant, "p <= threshold: significant")
        .when(F.col(p) == F.col("_stop"), "p > threshold: stop")
        .otherwise("not reached: an earlier step stopped")
    )
    judged = judged.select(p, "step", "threshold", significant.alias("significant"), reason.alias("reason"))
    return tests.select(name, p).join(judged, p)


def decide(intervals: DataFrame, tests: DataFrame, name: str = "test") -> DataFrame:
    """GO when the interval lies above 0 and the corrected test is significant, otherwise REJECTED."""
    go = (F.col("ci_lower") > 0) & F.col("significant")
    return intervals.join(tests, name).withColumn("decision", F.when(go, "GO").otherwise("REJECTED"))


def matched_sets(
    targets: DataFrame, universe: DataFrame, k: int, seed: int, plan: str = "plan_id", gene: str = "gene_id"
) -> DataFrame:
    """k random gene sets per plan, as large as the plan's target set and disjoint from it.

    The plans are those of ``targets``; a plan whose remaining universe is too small fails.
    """
    sizes = required(targets.select(plan, gene), [plan]).distinct().groupBy(plan).agg(F.count(F.lit(1)).alias("_size"))
    own = targets.groupBy(gene).agg(F.collect_set(plan).alias("_own"))
    pool = required(universe.select(gene).distinct().join(own, gene, "left"), [gene])
    pool = pool.repartition(task_slots(universe.sparkSession), gene)  # each gene is multiplied by the sets in place
    group = [plan, "control_index"]
    sets = sizes.withColumn("control_index", F.explode(F.sequence(F.lit(1), F.lit(k))))
    free = lambda each: replicated(pool, each, [], gene, seed).where(~F.coalesce(F.array_contains("_own", F.col(plan)), F.lit(False)))
    slices = quota_slices(free(sets.agg(F.collect_list(F.struct(*group, "_size")).alias("_each"))), "_size", group)
    # A second walk keeps the slices up to the one in which a set is full; only their rows are shuffled and ordered.
    last = slices.groupBy(*group).agg(F.max(F.struct("_place", (F.col("_quota") - F.col("_before")).alias("take"))).alias("_e"))
    last = last.agg(F.collect_list(F.struct(*group, F.col("_e._place").alias("_last"), F.col("_e.take").alias("_take"))).alias("_each"))
    inside = Window.partitionBy(*group, "_place").orderBy("_digest", gene)
    near = free(last).where("_place <= _last").withColumn("_pos", F.row_number().over(inside))
    chosen = durable(near.where("_place < _last OR _pos <= _take").select(*group, gene))
    got = chosen.groupBy(*group).agg(F.count(F.lit(1)).alias("_got"))
    message = F.concat(F.lit("gene universe too small for "), F.col(plan).cast("string"))
    full = F.when(F.col("_got") == F.col("_size"), True).otherwise(F.raise_error(message).cast("boolean"))
    enough = sets.join(got, [plan, "control_index"], "left").select(plan, "control_index", full.alias("_full"))
    # A left join: a set that has no genes at all must fail too, not vanish.
    return enough.join(chosen.hint("merge"), [plan, "control_index"], "left").where("_full").select(plan, "control_index", gene)


def control_summary(shifts: DataFrame, plan: str = "plan_id", value: str = "score_shift", is_target: str = "is_target") -> DataFrame:
    """Target mean shift against the means of its random sets: mean, sd, empirical p.

    Input holds one row per (plan, set, patient): ``control_index`` names the random set.
    """
    target = shifts.where(F.col(is_target)).groupBy(plan).agg(F.avg(value).alias("target_mean"))
    means = shifts.where(~F.col(is_target)).groupBy(plan, "control_index").agg(F.avg(value).alias("_m"))
    rows = means.join(target, plan)
    out = rows.groupBy(plan, "target_mean").agg(
        F.avg("_m").alias("random_mean"), F.stddev_samp("_m").alias("random_sd"), F.count(F.lit(1)).alias("n_random"),
        F.count_if(F.abs(F.col("_m")) >= F.abs(F.col("target_mean"))).alias("_x"),
    )
    return out.withColumn("p_value", (1.0 + F.col("_x")) / (1.0 + F.col("n_random"))).drop("_x")


def score_shift(baseline: DataFrame, perturbed: DataFrame, key: str = "donor_id", score: str = "score") -> DataFrame:
    """Perturbed minus baseline score per patient, its size and direction."""
    from donorlake.functions.scalars import direction

    sides = baseline.select(key, F.col(score).alias("baseline")).join(perturbed.select(key, F.col(score).alias("perturbed")), key)
    shift = F.round(F.col("perturbed") - F.col("baseline"), 6)
    return sides.withColumn("score_shift", shift).withColumns(
        {"abs_score_shift": F.abs(F.col("score_shift")), "direction": direction("score_shift")}
    )

