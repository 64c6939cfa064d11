"""Regression gate, promotion and comparison of runs.

``by`` names columns that identify a comparison, so that one plan can judge many runs. Tables of
metrics are long: (*by, metric, value).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.schemas import GATE_METRICS, GATE_THRESHOLD, HYPERPARAMETERS


def regression_gate(
    new: DataFrame,
    baseline: DataFrame | None,
    threshold: float = GATE_THRESHOLD,
    metrics: tuple[str, ...] = GATE_METRICS,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per checked metric with its status: ok, skipped or regression.

    A metric that is missing counts as 0; a new value of 0 is skipped. Without a baseline nothing
    can regress.
    """
    sides = [new.select(*by, "metric", "value", F.lit(True).alias("_new"))]
    if baseline is not None:
        sides.append(baseline.select(*by, "metric", "value", F.lit(False).alias("_new")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])

    def value(metric: str, side: Column) -> Column:
        found = F.max(F.when((F.col("metric") == metric) & side, F.col("value")))
        return F.coalesce(found, F.lit(0.0))

    # One exchange: both values of every metric meet in one aggregate.
    of_new, of_old = F.col("_new"), ~F.col("_new")
    checked = F.array(
        *[F.struct(F.lit(m).alias("metric"), value(m, of_old).alias("old"), value(m, of_new).alias("new")) for m in metrics]
    )
    judged = both.groupBy(*by).agg(checked.alias("_checked"), F.count_if(of_new).alias("_rows"))
    if by:
        judged = judged.where(F.col("_rows") > 0)
    joined = judged.select(*by, F.explode("_checked").alias("_c")).select(*by, "_c.*")
    on = [*by, "metric"]
    status = (
        F.when(F.col("new") == 0, "skipped")
        .when(F.col("new") < F.col("old") - F.lit(threshold), "regression")
        .otherwise("ok")
    )
    return joined.select(*on, "old", "new", status.alias("status"))


def gate_verdict(gate: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether each comparison passed: no metric regressed."""
    return gate.groupBy(*by).agg(F.bool_and(F.col("status") != "regression").alias("passed"))


def promote_baseline(
    new: DataFrame, baseline: DataFrame | None, verdict: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """The baseline after the gate: the new metrics where it passed, else the old ones."""

    def judged(df: DataFrame, passed: bool, origin: str) -> DataFrame:
        keep = verdict.where(F.col("passed") == passed).select(*by)
        # Without `by` the verdict is one row.
        rows = df.join(keep, list(by), "left_semi") if by else df.where(keep.limit(1).exists())
        return rows.select(*by, "metric", "value", F.lit(origin).alias("origin"))

    promoted = judged(new, True, "new")
    return promoted if baseline is None else promoted.unionByName(judged(baseline, False, "old"))


def params_diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Keys whose value changed, was added or was removed between two (*by, key, value) tables."""
    on = [*by, "key"]
    # The marks tell a missing key from a null value.
    old = a.select(*on, F.col("value").alias("old"), F.lit(True).alias("_a"))
    new = b.select(*on, F.col("value").alias("new"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    )
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("old").eqNullSafe(F.col("new"))
    return old.join(new, on, "full").where(~same).select(*on, "old", "new", change.alias("change"))


def metrics_diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Old, new and delta of every metric of two (*by, metric, value) tables."""
    on = [*by, "metric"]
    old = a.select(*on, F.col("value").alias("old"))
    new = b.select(*on, F.col("value").alias("new"))
    return old.join(new, on, "full").withColumn("delta", F.round(F.col("new") - F.col("old"), 4))


def run_record(
    params: DataFrame,
    counts: DataFrame,
    run_id: str,
    info: dict[str, str] | None = None,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Flattened record of a run: (run_id, key, value).

    ``params`` holds (key, value) with keys like ``training.lora_r``, ``counts`` the rows per task
    and part, ``info`` facts about the run such as ``timestamp`` and ``git_hash``, ``measured``
    further (key, value) rows such as losses and run times.
    """
    name = F.regexp_replace("key", r"^training\.", "")
    training = params.where(F.col("key").startswith("training.")).select(name.alias("key"), "value")
    base = training.where(F.col("key") == "base_model")
    hyper = training.where(F.col("key").isin(*HYPERPARAMETERS)).select(
        F.concat(F.lit("hyperparameters."), "key").alias("key"), "value"
    )
    modules = (
        training.where(F.col("key").endswith("_target_modules"))
        .select(
            F.regexp_replace("key", "_target_modules$", "").alias("task"),
            F.posexplode(F.split("value", ",", -1)).alias("i", "value"),
        )
        .select(F.format_string("%s.target_modules[%d]", "task", "i").alias("key"), "value")
    )
    part = F.when(F.col("part") == "train", "train_samples").otherwise("eval_samples")
    samples = counts.select(
        F.concat_ws(".", "task", part).alias("key"), F.col("n_rows").cast("string").alias("value")
    )
    rows = base.unionByName(hyper).unionByName(modules).unionByName(samples)
    if info:
        pairs = [F.lit(x) for item in info.items() for x in item]
        facts = params.sparkSession.range(1).select(F.explode(F.create_map(*pairs)).alias("key", "value"))
        rows = rows.unionByName(facts)
    if measured is not None:
        rows = rows.unionByName(measured.select("key", F.col("value").cast("string").alias("value")))
    return rows.select(F.lit(run_id).alias("run_id"), "key", "value")
