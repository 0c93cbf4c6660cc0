"""Knowledge tracing: frozen counts, initial mastery, Bayesian tracing, frozen probes, logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import scans
from lucerna.functions.ids import clipped, smoothed
from lucerna.operators.guards import lookup, union_streams
from lucerna.operators.history import long_form, opportunity_index, with_earlier, with_overall_rate
from lucerna.operators.labels import with_label_vector
from lucerna.sources.cuts import cut, dealt

#: Labels whose initial odds are broadcast at most; more of them are joined.
_LABELS = 100_000


@dataclass(frozen=True)
class Bkt:
    learn: float = 0.04
    guess: float = 0.20
    slip: float = 0.10
    alpha: float = 1.0
    beta: float = 1.0

    def after(self, mastery: float, correct: int) -> float:
        """Mastery after one answer: Bayes' rule, then the chance to learn."""
        hit, miss = (1 - self.slip, self.guess) if correct else (self.slip, 1 - self.guess)
        known = mastery * hit / (mastery * hit + (1 - mastery) * miss)
        return known + (1 - known) * self.learn

    def predicted(self, mastery: Column) -> Column:
        return self.guess + (1 - self.slip - self.guess) * mastery


def learner_state(projected: DataFrame) -> DataFrame:
    """Attempts and successes of each learner and label."""
    # dealt first, so that a task's table of learners and labels is a part of them, not its file's share of them all
    return long_form(dealt(projected.select("learner", "seq", "correct", "kc_ids"), "learner")).groupBy("learner", "kc").agg(F.count("*").alias("attempts"), F.sum("correct").alias("successes"))


def initial_mastery(projected: DataFrame, kc_ids: list[str], model: Bkt = Bkt(), cold: float | None = None) -> DataFrame:
    """Smoothed success of each label on the training split, held between 0.05 and 0.95; a label without
    training attempts has the cold prior if one is given."""
    every = projected.sparkSession.createDataFrame([(k,) for k in kc_ids], "kc string")
    seen = long_form(projected.where("dataset_split = 'train'")).groupBy("kc").agg(F.sum("correct").alias("s"), F.count("*").alias("n"))
    rate = clipped(smoothed(F.coalesce("s", F.lit(0)), F.coalesce("n", F.lit(0)), model.alpha, model.beta), 0.05, 0.95)
    start = rate if cold is None else F.when(F.col("n").isNull(), F.lit(cold)).otherwise(rate)
    return every.join(seen, "kc", "left").select("kc", start.alias("initial"), F.coalesce("n", F.lit(0)).alias("train_attempts"))


#: Odds of mastery are held under the first, which as a chance is 1 to a double; chances are kept the second from 0.
_MOST_ODDS, _TINY = 1e200, 1e-100


def _factor(model: Bkt, correct: Column) -> Column:
    """What an answer multiplies the odds of mastery with: Bayes' rule, and the share of the others that doesn't learn."""
    ratio = lambda known, unknown: max(known, _TINY) / max(unknown, _TINY) / max(1 - model.learn, _TINY)
    return F.when(correct == 1, ratio(1 - model.slip, model.guess)).otherwise(ratio(model.slip, 1 - model.guess))


def _step(model: Bkt, odds: Column, correct: Column) -> Column:
    """The odds after an answer and the chance to learn."""
    return F.least(odds * _factor(model, correct) + model.learn / max(1 - model.learn, _TINY), F.lit(_MOST_ODDS))


def _chance(odds: Column) -> Column:
    return odds / (1 + odds)


def _chains(rows: DataFrame, several: bool, initial: DataFrame, model: Bkt) -> DataFrame:
    """learner, _block, kc, the block's chain of (seq, correct) in order, and `odds` at its start. rows, several: blocked.

    A step is linear in the odds, so a whole block is too: (a * odds + b) / c, with numbers that the block alone decides,
    kept in range by their largest. The start of a later block follows from the blocks before it; an array
    holds a block's events, or a chain's blocks. Learners without later blocks start at the initial odds.
    """
    m = F.col("initial")
    start = cut(initial.select("kc", F.when(m >= 1, _MOST_ODDS).otherwise(m / (1 - m)).alias("first")))
    start = F.broadcast(start) if start.count() <= _LABELS else start
    long = rows.select("learner", "_block", "seq", "correct", F.explode("kc_ids").alias("kc"))
    chains = long.groupBy("learner", "_block", "kc").agg(F.array_sort(F.collect_list(F.struct("seq", "correct"))).alias("chain")).join(start, "kc")
    if not several:
        return chains.withColumnRenamed("first", "odds")

    def through(t: Column, event: Column) -> Column:
        f = _factor(model, event["correct"])
        a, b, c = t["a"] * f, t["b"] * f + t["c"] * (model.learn / max(1 - model.learn, _TINY)), t["c"]
        most = F.greatest(a, b, c)
        return F.struct((a / most).alias("a"), (b / most).alias("b"), F.greatest(c / most, F.lit(1e-300)).alias("c"))

    far = chains.join(scans.spread_keys(rows, "learner"), "learner", "left_semi")
    maps = far.select("learner", "kc", "first", "_block", F.aggregate("chain", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c")), through).alias("map"))
    whole = maps.groupBy("learner", "kc").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("_block", "map"))).alias("blocks"))
    carried = lambda odds, x: F.least((x["map"]["a"] * odds + x["map"]["b"]) / x["map"]["c"], F.lit(_MOST_ODDS))
    starts = whole.select("learner", "kc", F.explode(F.arrays_zip("blocks", scans.running(F.col("blocks"), F.col("first"), carried, "double").alias("odds"))).alias("x"))
    by_block = starts.groupBy("learner", F.col("x.blocks._block").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct("kc", "x.odds"))).alias("_starts"))
    return chains.join(by_block, ["learner", "_block"], "left").select("learner", "_block", "kc", "chain", F.coalesce(F.try_element_at("_starts", F.col("kc")), "first").alias("odds"))


def _mastery(rows: DataFrame, several: bool, initial: DataFrame, model: Bkt) -> DataFrame:
    """learner, _block, seq, kc, mastery before the event."""
    before = scans.running(F.col("chain"), F.col("odds"), lambda odds, e: _step(model, odds, e["correct"]), "double").alias("odds")
    each = _chains(rows, several, initial, model).select("learner", "_block", "kc", F.explode(F.arrays_zip(F.col("chain.seq").alias("seq"), before)).alias("x"))
    return each.select("learner", "_block", "x.seq", "kc", _chance(F.col("x.odds")).alias("mastery"))


def mastery_before(projected: DataFrame, initial: DataFrame, model: Bkt = Bkt()) -> DataFrame:
    """learner, seq, kc, mastery before the event. Each learner's chain of a label is independent of the others.

    Odds keep differences from 1 that a fold of chances in doubles rounds away: such a fold stays at 1 for good once
    1 - mastery is under 2^-53, this one falls again after enough wrong answers.
    """
    rows, several = scans.blocked(projected.select("learner", "seq", "correct", "kc_ids"), ["learner"])
    return _mastery(rows, several, initial, model).select("learner", "seq", "kc", "mastery")


def bkt_predictions(projected: DataFrame, initial: DataFrame, model: Bkt = Bkt()) -> DataFrame:
    """projected with bkt: the chance of success before the event; events without labels have the overall rate."""
    rows, several = scans.blocked(projected, ["learner"])
    mean = _mastery(rows, several, initial, model).groupBy("learner", "_block", "seq").agg(F.avg("mastery").alias("m"))
    scored = with_overall_rate(with_earlier(rows) if several else rows, several, model.alpha, model.beta).join(mean, ["learner", "_block", "seq"], "left")
    return scored.select(*[F.col(c) for c in projected.columns], F.coalesce(model.predicted(F.col("m")), "overall_rate").alias("bkt"))


def final_mastery(projected: DataFrame, initial: DataFrame, model: Bkt = Bkt()) -> DataFrame:
    """learner, kc, mastery after all the learner's events: the frozen state that probes read."""
    rows, several = scans.blocked(projected.select("learner", "seq", "correct", "kc_ids"), ["learner"])
    last = F.aggregate("chain", F.col("odds"), lambda odds, e: _step(model, odds, e["correct"]))
    ends = _chains(rows, several, initial, model).select("learner", "kc", "_block", last.alias("odds"))
    return ends.groupBy("learner", "kc").agg(F.max_by("odds", "_block").alias("odds")).select("learner", "kc", _chance(F.col("odds")).alias("mastery"))


def frozen_probes(history: DataFrame, probes: DataFrame, initial: DataFrame, model: Bkt = Bkt(), cold: float = 0.5) -> DataFrame:
    """probes scored from each learner's frozen state, which they never change.

    Labels without development support count as cold: their rate is the smoothed prior and their mastery
    the cold value. A probe of a learner without history fails the job. Columns: overall, n_supported, n_cold, empirical, bkt, mean_log_opportunity, fallback.
    """
    state = learner_state(history)
    mastery = final_mastery(history, initial, model)
    supported = long_form(history).select("kc").distinct().withColumn("supported", F.lit(1))
    overall = history.groupBy("learner").agg(F.count("*").alias("n"), F.sum("correct").alias("s"))
    probes = lookup(probes, overall, "learner")
    keys = probes.select("learner", "seq", F.explode("kc_ids").alias("kc"))
    facts = (
        keys.join(supported, "kc", "left").join(state, ["learner", "kc"], "left").join(mastery, ["learner", "kc"], "left").join(initial.select("kc", "initial"), "kc", "left")
        .groupBy("learner", "seq").agg(
            F.count("supported").alias("n_supported"), F.sum(F.col("supported").isNull().cast("int")).alias("n_cold"),
            F.avg(F.when(F.col("supported").isNull(), F.lit(model.alpha / (model.alpha + model.beta))).otherwise(smoothed(F.coalesce("successes", F.lit(0)), F.coalesce("attempts", F.lit(0)), model.alpha, model.beta))).alias("rate"),
            F.avg(F.when(F.col("supported").isNull(), F.lit(cold)).otherwise(F.coalesce("mastery", "initial"))).alias("mean_mastery"),
            F.avg(F.log1p(F.coalesce("attempts", F.lit(0)).cast("double"))).alias("mean_log"),
        )
    )
    out = probes.join(facts, ["learner", "seq"], "left")
    prior = smoothed(F.col("s"), F.col("n"), model.alpha, model.beta)
    return out.select(
        "learner", "seq", "item_id", "correct", "kc_ids", prior.alias("overall"), F.coalesce("n_supported", F.lit(0)).alias("n_supported"), F.coalesce("n_cold", F.lit(0)).alias("n_cold"),
        F.coalesce("rate", prior).alias("empirical"), F.coalesce(model.predicted(F.col("mean_mastery")), prior).alias("bkt"), F.coalesce("mean_log", F.lit(0.0)).alias("mean_log_opportunity"),
        F.when(F.coalesce("n_supported", F.lit(0)) + F.coalesce("n_cold", F.lit(0)) == 0, "no_label").when(F.col("n_cold") > 0, "cold_label").otherwise("none").alias("fallback"),
    )


def probe_opportunities(history: DataFrame, probes: DataFrame) -> DataFrame:
    """learner, seq, kc, opportunity of the probes: one more than the learner's attempts before all probes,
    the same for every probe of the label."""
    keys = probes.select("learner", "seq", F.explode("kc_ids").alias("kc"))
    return keys.join(learner_state(history), ["learner", "kc"], "left").select("learner", "seq", "kc", (F.coalesce("attempts", F.lit(0)) + 1).alias("opportunity"))


def compositional_projection(history: DataFrame, probes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Both streams with their role, index map, supported and cold labels and flags. Labels of development items are
    supported; probes read the state after all history and never change it; their learners need one."""
    supported = labelled.where("canonical_split = 'development'").select(F.explode("kc_ids").alias("kc")).distinct().withColumn("_ok", F.lit(1))
    probes = lookup(probes, history.select("learner").distinct(), "learner")
    both = union_streams({"acquisition": history, "probe": probes}).withColumnRenamed("stream", "role")
    numbers = opportunity_index(history).unionByName(probe_opportunities(history, probes))
    pick = lambda c: F.array_sort(F.array_compact(F.collect_list(c)))
    facts = numbers.join(supported, "kc", "left").groupBy("learner", "seq").agg(
        pick(F.when(F.col("_ok").isNotNull(), F.col("kc"))).alias("supported"), pick(F.when(F.col("_ok").isNull(), F.col("kc"))).alias("cold"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kc", "opportunity")))).alias("indices"),
    )
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    out = both.join(facts, ["learner", "seq"], "left").withColumn("supported", F.coalesce("supported", none)).withColumn("cold", F.coalesce("cold", none)).withColumn("indices", F.coalesce("indices", no_map))
    return out.withColumn("covered", F.size("kc_ids") > 0).withColumn("fully_supported", F.col("covered") & (F.size("cold") == 0))


def probe_scopes(scored: DataFrame) -> DataFrame:
    """Scored probes once for each scope they belong to: all (with fallback), covered, fully supported."""
    covered = F.col("n_supported") + F.col("n_cold") > 0
    scopes = F.array_compact(F.array(F.lit("all"), F.when(covered, F.lit("covered")), F.when(covered & (F.col("n_cold") == 0), F.lit("fully_supported"))))
    return scored.withColumn("scope", F.explode(scopes))


NOT_APPLICABLE = "not_applicable_without_holdout_items"


def compositional_result(history: DataFrame, probes: DataFrame, evaluate) -> DataFrame:
    """status, and the columns of evaluate(history, probes); one row that says so where there are no probes."""
    if probes.isEmpty():
        return history.agg(F.count("*").alias("n_acquisition")).select(F.lit(NOT_APPLICABLE).alias("status"), "n_acquisition")
    return evaluate(history, probes).withColumn("status", F.lit("evaluated"))


def frozen_state(history: DataFrame, initial: DataFrame, model: Bkt = Bkt()) -> DataFrame:
    """One row a learner with maps of attempts, successes and mastery by label (as many as there are labels)."""
    rows = learner_state(history).join(final_mastery(history, initial, model), ["learner", "kc"])
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("kc", c)))).alias(c)
    return rows.groupBy("learner").agg(as_map("attempts"), as_map("successes"), as_map("mastery"))


def _assembled(features: DataFrame, columns: list[str], kc_ids: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = with_label_vector(features, kc_ids, name="_hot").withColumn("_kc_count", F.size("kc_ids").cast("double"))
    return VectorAssembler(inputCols=[*columns, "_kc_count", "_hot"], outputCol="features").transform(rows)


def fit_logistic(features: DataFrame, columns: list[str], kc_ids: list[str], strength: float = 1.0, rounds: int = 300):
    """L2 regression fitted on the training split (regularisation 1 / (C n)) over the columns, the number of labels
    and the labels themselves. Returns a function that adds `logistic` to a table with these columns; a row
    without labels gets its `fallback` column there instead."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    train = _assembled(features.where("dataset_split = 'train'"), columns, kc_ids).withColumn("label", F.col("correct").cast("double"))
    model = LogisticRegression(regParam=1.0 / (strength * max(train.count(), 1)), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-9).fit(train)
    # the summary holds the session, which can't go to tasks once it has observed a table
    model._java_obj.setSummary(features.sparkSession._jvm.scala.Option.empty())

    def predict(rows: DataFrame, fallback: str) -> DataFrame:
        found = model.transform(_assembled(rows, columns, kc_ids)).withColumn("_p", vector_to_array("probability")[1])
        return found.withColumn("logistic", F.when(F.size("kc_ids") == 0, F.col(fallback)).otherwise(F.col("_p"))).drop("features", "_hot", "_kc_count", "_p", "rawPrediction", "probability", "prediction")

    return predict


def logistic_predictions(features: DataFrame, columns: list[str], kc_ids: list[str], fallback: str = "overall_rate", strength: float = 1.0, rounds: int = 300) -> DataFrame:
    """features with logistic."""
    return fit_logistic(features, columns, kc_ids, strength, rounds)(features, fallback)
