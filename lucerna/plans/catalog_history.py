"""Queries of ordered histories, tracing, evaluation, selection and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.ids import hash_uniform
from lucerna.functions.rules import operation_scope
from lucerna.operators import canonical, evaluation, history, labels, policies, selection, tracing
from lucerna.plans.catalog_labels import KCS, _HAMMING, labelled
from lucerna.plans.policy import CANDIDATES, LEAST_DESCRIPTORS, PATTERNS
from lucerna.plans.sql import BIG, CELLS, EVENTS, ITEMS, LABELS, condition, quoted, with_
from lucerna.sources.adapters import COMPILER, DIMENSIONS, cells, interactions, interactions_big, items, table
from lucerna.sources.cuts import cut

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def big(spark, sf):
    """Line items as events with labels."""
    return labels.project(interactions_big(spark, sf), labelled(spark, sf))


def small(spark, sf):
    return labels.project(interactions(spark, sf), labelled(spark, sf), table(spark, sf, "events").count())


def small_split(spark, sf):
    """small with dataset_split, found while the events are still dealt by learner."""
    return labels.project(history.chronological_split(interactions(spark, sf)), labelled(spark, sf), table(spark, sf, "events").count())


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_LONG = "long_ AS (SELECT learner, seq, correct, kc FROM big JOIN labels_ USING (item_id))"
_W = "OVER (PARTITION BY learner, kc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_WL = "OVER (PARTITION BY learner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SPLIT = """spl AS (SELECT *, CASE WHEN seq <= te THEN 'train' WHEN seq <= ve THEN 'validation' ELSE 'test' END AS dataset_split FROM (SELECT *, CASE WHEN n >= 3 THEN least(greatest(b, te + 1), n - 1) ELSE n END AS ve FROM (
  SELECT *, CASE WHEN n >= 3 THEN least(greatest(a, 1), n - 2) ELSE greatest(a, 1) END AS te FROM (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS a, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS b FROM (SELECT *, count(*) OVER (PARTITION BY learner) AS n FROM {t})))))"""


def _rates(t: str, long: str) -> str:
    return f"""kcr AS (SELECT learner, seq, avg(rate) AS active, avg(seen) AS mean_log FROM (SELECT learner, seq, (coalesce(sum(correct) {_W}, 0) + 1.0::DOUBLE) / (count(correct) {_W} + 2.0::DOUBLE) AS rate, ln(1 + count(correct) {_W}) AS seen FROM {long}) GROUP BY 1, 2),
ovr AS (SELECT learner, seq, item_id, correct, (coalesce(sum(correct) {_WL}, 0) + 1.0::DOUBLE) / (count(correct) {_WL} + 2.0::DOUBLE) AS overall_rate FROM {t}),
rates AS (SELECT ovr.*, coalesce(active, overall_rate) AS active_rate, coalesce(mean_log, 0) AS mean_log_opportunity FROM ovr LEFT JOIN kcr USING (learner, seq))"""


@query(with_(ITEMS, LABELS, BIG, _LONG) + "SELECT learner, seq, kc, row_number() OVER (PARTITION BY learner, kc ORDER BY seq) AS opportunity FROM long_")
def opportunity_index(spark, sf):
    return history.opportunity_index(big(spark, sf))


@query(with_(ITEMS, LABELS, BIG, _LONG, _rates("big", "long_")) + "SELECT learner, seq, round(overall_rate, 6) AS overall_rate, round(active_rate, 6) AS active_rate, round(mean_log_opportunity, 6) AS mean_log_opportunity FROM rates")
def prior_rates(spark, sf):
    out = history.prior_rates(big(spark, sf)).select("learner", "seq", "overall_rate", "active_rate", "mean_log_opportunity")
    return rounded(out, "overall_rate", "active_rate", "mean_log_opportunity")


@query(with_(BIG, _SPLIT.format(t="big")) + "SELECT learner, seq, dataset_split FROM spl")
def chronological_split(spark, sf):
    return history.chronological_split(interactions_big(spark, sf)).select("learner", "seq", "dataset_split")


@query("""SELECT learner, count(*) AS n_events, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(stuck) AS BIGINT) AS not_rising FROM (SELECT user_id AS learner, CASE WHEN event_id - coalesce(lag(event_id) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS gap, CASE WHEN coalesce(ts <= lag(ts) OVER w, false) THEN 1 ELSE 0 END AS stuck FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1""")
def sequence_gaps(spark, sf):
    # the event id taken as sequence number, so that there are gaps to find
    return history.sequence_gaps(table(spark, sf, "events").select(F.col("user_id").alias("learner"), "event_id", "ts"), seq="event_id")


@query(with_(ITEMS, BIG) + "SELECT cell_id, learner, seq, item_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY learner, seq) AS r FROM big JOIN items USING (item_id)) WHERE r = 1")
def first_realisation(spark, sf):
    rows = interactions_big(spark, sf).join(items(spark, sf).select("item_id", "cell_id"), "item_id")
    return history.first_by(rows, ["cell_id"], ["learner", "seq"], ["learner", "seq", "item_id"])


@query(with_(ITEMS, LABELS, BIG, _LONG) + "SELECT learner, kc, count(*) AS attempts, CAST(sum(correct) AS BIGINT) AS successes FROM long_ GROUP BY ALL")
def learner_state(spark, sf):
    return tracing.learner_state(big(spark, sf))


_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in KCS) + ") v(kc))"


def _init(t: str) -> str:
    return f"init AS (SELECT names.kc, least(greatest((coalesce(sum(correct), 0) + 1.0::DOUBLE) / (count(correct) + 2.0::DOUBLE), 0.05), 0.95) AS initial, count(correct) AS train_attempts FROM names LEFT JOIN (SELECT kc, correct FROM {t} JOIN labels_ USING (item_id) WHERE dataset_split = 'train') x USING (kc) GROUP BY 1)"


@query(with_(ITEMS, LABELS, BIG, _NAMES, _SPLIT.format(t="big"), _init("spl")) + "SELECT kc, round(initial, 6) AS initial, train_attempts FROM init")
def initial_mastery(spark, sf):
    rows = history.chronological_split(big(spark, sf))
    return rounded(tracing.initial_mastery(rows, KCS), "initial")


_STEP = "(CASE WHEN c = 1 THEN m * 0.9 / (m * 0.9 + (1 - m) * 0.2) ELSE m * 0.1 / (m * 0.1 + (1 - m) * 0.8) END)"
_FOLD = f"lambda m, c: {_STEP} + (1 - {_STEP}) * 0.04"


@query(with_(ITEMS, LABELS, BIG, _NAMES, _SPLIT.format(t="big"), _init("spl"), "lg AS (SELECT learner, seq, correct, kc FROM spl JOIN labels_ USING (item_id))",
             f"before AS (SELECT learner, seq, kc, coalesce(list(CAST(correct AS DOUBLE)) {_W}, []) AS past FROM lg)",
             f"mast AS (SELECT learner, seq, avg(list_reduce([initial] || past, {_FOLD})) AS m FROM before JOIN init USING (kc) GROUP BY 1, 2)",
             f"ov AS (SELECT learner, seq, (coalesce(sum(correct) {_WL}, 0) + 1.0::DOUBLE) / (count(correct) {_WL} + 2.0::DOUBLE) AS o FROM big)") + "SELECT learner, seq, round(coalesce(0.2 + (1 - 0.1 - 0.2) * m, o), 6) AS bkt FROM ov LEFT JOIN mast USING (learner, seq)")
def bkt(spark, sf):
    rows = cut(history.chronological_split(big(spark, sf)))  # read twice
    return rounded(tracing.bkt_predictions(rows, tracing.initial_mastery(rows, KCS)).select("learner", "seq", "bkt"), "bkt")


_SMALL = "small AS (SELECT learner, item_id, seq, correct FROM ev)"
_SLONG = "slong AS (SELECT learner, seq, correct, kc FROM small JOIN labels_ USING (item_id))"
_SRATES = with_(ITEMS, LABELS, EVENTS, _SMALL, _SLONG, _rates("small", "slong"), _SPLIT.format(t="small"), """pr AS (SELECT learner, seq, dataset_split, technique, least(greatest(prediction, 1e-6), 1 - 1e-6) AS p, rates.correct FROM (
  SELECT *, 'overall_rate' AS technique, overall_rate AS prediction FROM rates UNION ALL SELECT *, 'active_rate', active_rate FROM rates) rates JOIN spl USING (learner, seq))""")
_MET = "count(*) AS n, round(avg(-ln(CASE WHEN correct = 1 THEN p ELSE 1 - p END)), 6) AS log_loss, round(avg((p - correct) * (p - correct)), 6) AS brier, round(avg(((round(p, 12) >= 0.5)::INT = correct)::INT::DOUBLE), 6) AS accuracy, round(avg(p), 6) AS mean_prediction, round(avg(correct), 6) AS observed_rate"
_TECHNIQUES = ["overall_rate", "active_rate"]


def predictions(spark, sf):
    rows = history.prior_rates(small_split(spark, sf))
    return evaluation.long_predictions(rows, _TECHNIQUES, ["learner", "seq", "dataset_split"])


@query(_SRATES + f"SELECT technique, dataset_split, {_MET} FROM pr GROUP BY 1, 2")
def metrics(spark, sf):
    out = evaluation.metrics(predictions(spark, sf), ["technique", "dataset_split"])
    return rounded(out, "log_loss", "brier", "accuracy", "mean_prediction", "observed_rate")


@query(_SRATES + """SELECT technique, dataset_split, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (2 * below + neg)) / 2 / sum(pos) / sum(neg), 6) END AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY technique, dataset_split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT technique, dataset_split, round(p, 9) AS score, sum(correct) AS pos, sum(1 - correct) AS neg FROM pr GROUP BY 1, 2, 3)) GROUP BY 1, 2""")
def auc(spark, sf):
    # means are added up in any order, so scores count as equal to 9 digits here
    return rounded(evaluation.auc(rounded(predictions(spark, sf), "prediction", digits=9), ["technique", "dataset_split"]), "auc")


_BIN = " + ".join(f"(round(p, 12) >= {i / 10}::DOUBLE)::INT" for i in range(1, 10))


@query(_SRATES + f"SELECT technique, dataset_split, round(sum(n * abs(mp - mo)) / sum(n), 6) AS ece, count(*) AS bins_used FROM (SELECT technique, dataset_split, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(correct) AS mo FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 2")
def ece(spark, sf):
    return rounded(evaluation.ece(predictions(spark, sf), ["technique", "dataset_split"]), "ece")


@query(_SRATES + f"""SELECT g.technique, g.dataset_split, g.scope, coalesce(m.n, 0) AS n, m.log_loss, m.brier, m.accuracy, m.mean_prediction, m.observed_rate FROM
 (SELECT * FROM (VALUES ('overall_rate'), ('active_rate')) a(technique), (VALUES ('train'), ('validation'), ('test')) b(dataset_split), (VALUES ('all'), ('covered'), ('uncovered')) c(scope)) g LEFT JOIN
 (SELECT technique, dataset_split, scope, {_MET} FROM (SELECT pr.*, unnest(['all', CASE WHEN cov.seq IS NULL THEN 'uncovered' ELSE 'covered' END]) AS scope FROM pr LEFT JOIN (SELECT DISTINCT learner, seq FROM slong) cov USING (learner, seq)) GROUP BY 1, 2, 3) m USING (technique, dataset_split, scope)""")
def evaluation_grid(spark, sf):
    rows = history.prior_rates(small_split(spark, sf))
    scope = F.explode(F.array(F.lit("all"), F.when(F.size("kc_ids") > 0, "covered").otherwise("uncovered"))).alias("scope")
    long = evaluation.long_predictions(rows.select("*", scope), _TECHNIQUES, ["dataset_split", "scope"])
    grid = spark.createDataFrame([(t, s, c) for t in _TECHNIQUES for s in ("train", "validation", "test") for c in ("all", "covered", "uncovered")], "technique string, dataset_split string, scope string")
    out = evaluation.over_grid(evaluation.metrics(long, ["technique", "dataset_split", "scope"]), grid, ["technique", "dataset_split", "scope"])
    return rounded(out, "log_loss", "brier", "accuracy", "mean_prediction", "observed_rate")


@query(_SRATES + f"SELECT technique, {_MET} FROM pr GROUP BY 1")
def flagship(spark, sf):
    """Chance of success predicted from earlier practice, and how good it was."""
    out = evaluation.metrics(predictions(spark, sf), ["technique"])
    return rounded(out, "log_loss", "brier", "accuracy", "mean_prediction", "observed_rate")


@query(_SRATES.rstrip() + """, per AS (SELECT learner, sum(-ln(CASE WHEN r.correct = 1 THEN least(greatest(active_rate, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(active_rate, 1e-6), 1 - 1e-6) END) + ln(CASE WHEN r.correct = 1 THEN least(greatest(overall_rate, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(overall_rate, 1e-6), 1 - 1e-6) END)) AS d, count(*) AS n FROM rates r GROUP BY 1),
num AS (SELECT *, row_number() OVER (ORDER BY learner) - 1 AS position, count(*) OVER () AS size FROM per),
draws AS (SELECT rep, least(CAST(floor(((CAST(('0x' || substr(h, 1, 8))::BIGINT AS DOUBLE) * 4294967296.0 + ('0x' || substr(h, 9, 8))::BIGINT) / 18446744073709551615.0) * size) AS BIGINT), size - 1) AS position FROM (SELECT rep, size, sha256('17|' || rep || '|' || draw) AS h FROM (SELECT unnest(range(1000)) AS rep), (SELECT unnest(range(size)) AS draw, size FROM (SELECT max(size) AS size FROM num)))),
means AS (SELECT rep, sum(d) / sum(n) AS mean FROM draws JOIN num USING (position) GROUP BY 1)
SELECT (SELECT count(*) FROM per) AS n_learners, (SELECT CAST(sum(n) AS BIGINT) FROM per) AS n_events, round((SELECT sum(d) / sum(n) FROM per), 6) AS difference, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
 CASE WHEN quantile_cont(mean, 0.975) < 0 THEN 'a better' WHEN quantile_cont(mean, 0.025) > 0 THEN 'b better' ELSE 'unclear' END AS direction FROM means""")
def bootstrap(spark, sf):
    rows = history.prior_rates(small(spark, sf)).select("learner", "correct", F.col("active_rate").alias("a"), F.col("overall_rate").alias("b"))
    return rounded(evaluation.paired_bootstrap(rows, 1000), "difference", "low", "high")


def frozen(spark, sf):
    """History: events of items outside the holdouts; probes: the others, scored from frozen state."""
    rows = cut(small(spark, sf).join(items(spark, sf).select("item_id", "canonical_split").hint("merge"), "item_id"))  # read several times
    known = history.chronological_split(rows.where("canonical_split = 'development'"))
    start = tracing.initial_mastery(known, KCS)
    # learners without development events have no state that a probe could read
    probes = rows.where("canonical_split <> 'development'").join(known.select("learner").distinct(), "learner", "left_semi")
    return known, probes, start


_FROZEN = with_(ITEMS, LABELS, EVENTS, _NAMES, "small AS (SELECT learner, seq, item_id, correct, canonical_split FROM ev JOIN items USING (item_id))", "hist AS (SELECT * FROM small WHERE canonical_split = 'development')", "probe AS (SELECT * FROM small WHERE canonical_split <> 'development')",
    "hseq AS (SELECT learner, item_id, correct, seq FROM hist)", _SPLIT.format(t="hseq"), _init("spl"), "hl AS (SELECT learner, seq, correct, kc FROM hist JOIN labels_ USING (item_id))",
    f"st AS (SELECT learner, kc, count(*) AS attempts, sum(correct) AS successes, list_reduce([first(initial)] || list(CAST(correct AS DOUBLE) ORDER BY seq), {_FOLD}) AS mastery FROM hl JOIN init USING (kc) GROUP BY 1, 2)",
    "ovl AS (SELECT learner, count(*) AS n, sum(correct) AS s FROM hist GROUP BY 1)", "sup AS (SELECT DISTINCT kc FROM hl)",
    """fx AS (SELECT p.learner, p.seq, count(sup.kc) AS n_supported, count(*) - count(sup.kc) AS n_cold, avg(CASE WHEN sup.kc IS NULL THEN 0.5 ELSE (coalesce(successes, 0) + 1.0::DOUBLE) / (coalesce(attempts, 0) + 2.0::DOUBLE) END) AS rate,
      avg(CASE WHEN sup.kc IS NULL THEN 0.5 ELSE coalesce(mastery, initial) END) AS mm, avg(ln(1 + coalesce(attempts, 0))) AS ml FROM probe p JOIN labels_ l USING (item_id) LEFT JOIN sup ON sup.kc = l.kc LEFT JOIN st ON st.learner = p.learner AND st.kc = l.kc LEFT JOIN init ON init.kc = l.kc GROUP BY 1, 2)""",
    """fp AS (SELECT p.learner, p.seq, p.item_id, p.correct, p.canonical_split, coalesce(n_supported, 0) AS n_supported, coalesce(n_cold, 0) AS n_cold, coalesce(rate, (s + 1.0::DOUBLE) / (n + 2.0::DOUBLE)) AS empirical, coalesce(0.2 + (1 - 0.1 - 0.2) * mm, (s + 1.0::DOUBLE) / (n + 2.0::DOUBLE)) AS bkt, coalesce(ml, 0) AS mean_log_opportunity,
      CASE WHEN coalesce(n_supported, 0) + coalesce(n_cold, 0) = 0 THEN 'no_label' WHEN n_cold > 0 THEN 'cold_label' ELSE 'none' END AS fallback FROM probe p JOIN ovl USING (learner) LEFT JOIN fx USING (learner, seq))""")


@query(_FROZEN + "SELECT learner, seq, item_id, correct, n_supported, n_cold, round(empirical, 6) AS empirical, round(bkt, 6) AS bkt, round(mean_log_opportunity, 6) AS mean_log_opportunity, fallback FROM fp")
def frozen_probe(spark, sf):
    return rounded(tracing.frozen_probes(*frozen(spark, sf)).drop("kc_ids", "overall"), "empirical", "bkt", "mean_log_opportunity")


@query(_FROZEN + "SELECT learner, count(*) AS n_labels, CAST(sum(attempts) AS BIGINT) AS attempts, round(max(mastery), 6) AS top_mastery FROM st GROUP BY 1")
def frozen_state(spark, sf):
    known, _, start = frozen(spark, sf)
    out = tracing.frozen_state(known, start)
    total = F.aggregate(F.map_values("attempts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("learner", F.size("mastery").cast("long").alias("n_labels"), total.alias("attempts"), F.round(F.array_max(F.map_values("mastery")), 6).alias("top_mastery"))


@query(_FROZEN + """SELECT canonical_split, count(DISTINCT item_id) AS n_items, count(*) AS n_events, round_even(avg((n_cold = 0 AND n_supported > 0)::INT::DOUBLE), 6) AS fully_supported_rate, round_even(avg((n_cold > 0)::INT::DOUBLE), 6) AS cold_event_rate, round_even(sum(n_supported) / sum(n_supported + n_cold), 6) AS component_reuse FROM fp GROUP BY 1""")
def representation_support(spark, sf):
    known, probes, start = frozen(spark, sf)
    out = tracing.frozen_probes(known, probes, start).join(items(spark, sf).select("item_id", "canonical_split"), "item_id")
    return evaluation.representation_support(out)


FEATURES = ["overall_rate", "active_rate", "mean_log_opportunity", "item_difficulty"]


def difficulty():
    return hash_uniform(F.lit(17), F.col("item_id"), low=0.25, high=0.75)


@query()
def logistic(spark, sf):
    rows = history.prior_rates(small_split(spark, sf)).withColumn("item_difficulty", difficulty())
    out = tracing.logistic_predictions(rows, FEATURES, KCS)
    return rounded(out.select("learner", "seq", "dataset_split", "logistic"), "logistic")


# Selection

_PART_CELLS = CELLS


def _grid(spark, sf):
    """Realisations that discovery may read."""
    return items(spark, sf).where("canonical_split = 'development'")


def _dev_cells(spark, sf):
    return cells(spark, sf).where("canonical_split = 'development'")


def act(where: str) -> str:
    return "act AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS candidate, cell_id, CAST(sum(({condition(c[6])})::INT) AS BIGINT) AS active, count(*) AS realisations FROM items WHERE {where} GROUP BY cell_id" for c in CANDIDATES) + ")"


_ACT, _ACT_ALL = act("canonical_split = 'development'"), act("TRUE")
_STATE = "sta AS (SELECT *, CASE WHEN active = realisations THEN 'always' WHEN active = 0 THEN 'never' ELSE 'mixed' END AS state FROM act)"


@query(with_(ITEMS, _ACT, _STATE) + "SELECT candidate, cell_id, active, realisations, state FROM sta")
def activation_long(spark, sf):
    return selection.activations(_grid(spark, sf), COMPILER, CANDIDATES)


@query(with_(ITEMS, "di AS (SELECT * FROM items WHERE canonical_split = 'development')", "w AS (SELECT DISTINCT item_id, cell_id, unnest(operations) AS fact FROM di)", "sz AS (SELECT cell_id, count(*) AS n FROM di GROUP BY 1)") + "SELECT cell_id, fact FROM (SELECT cell_id, fact, count(*) AS k FROM w GROUP BY 1, 2) JOIN sz USING (cell_id) WHERE k = n UNION ALL SELECT cell_id, fact FROM (SELECT cell_id, unnest(['kind:' || kind, 'size:' || size]) AS fact FROM (SELECT DISTINCT cell_id, kind, size FROM di))")
def stable_facts(spark, sf):
    rows = _grid(spark, sf).withColumn("facts", F.concat("operations", F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("size:"), "size"))))
    return selection.stable_facts(rows, "facts")


_TABLE = "tab AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(c[0])}, {c[1]}, {c[2]}, {c[3]}, {quoted(c[5])}, {str(bool(c[4])).lower()}, {str(operation_scope(c[6])).lower()}, {quoted(c[7]) if len(c) > 7 else 'NULL'})" for c in CANDIDATES) + ") v(candidate, origin, granularity, complexity, represents, interaction, operation, alternatives))"
_PARENT = "par AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(c[0])}, {quoted(p)})" for c in CANDIDATES for p in c[4]) + ") v(candidate, parent))"
_PATTERNS = "pat AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(c)}, {quoted(f)})" for c, fs in PATTERNS.items() for f in fs) + ") v(candidate, fact))"
_STABLE = "stf AS (SELECT cell_id, 'kind:' || kind AS fact FROM cells UNION ALL SELECT cell_id, 'size:' || size FROM cells UNION ALL SELECT cell_id, 'brand:' || brand FROM cells UNION ALL SELECT cell_id, 'pair:' || kind || '+' || brand FROM cells)"
_ONLY = "po AS (SELECT DISTINCT par.candidate, a.cell_id FROM par JOIN sta a ON a.candidate = par.parent AND a.state = 'always' JOIN sta b ON b.candidate = par.candidate AND b.cell_id = a.cell_id AND b.state = 'never')"
_EVIDENCE = """ins AS (SELECT candidate, fact, count(*) AS n, count(f.fact2) AS w FROM pat JOIN (SELECT candidate, cell_id FROM sta WHERE state = 'always') al USING (candidate) LEFT JOIN (SELECT cell_id, fact AS fact2 FROM stf) f ON f.cell_id = al.cell_id AND f.fact2 = pat.fact GROUP BY 1, 2),
out_ AS (SELECT candidate, fact, count(*) AS n, count(f.fact2) AS w FROM pat JOIN po USING (candidate) LEFT JOIN (SELECT cell_id, fact AS fact2 FROM stf) f ON f.cell_id = po.cell_id AND f.fact2 = pat.fact GROUP BY 1, 2),
evi AS (SELECT pat.candidate, pat.fact, coalesce(ins.n, 0) AS inside_cells, coalesce(out_.n, 0) AS parent_cells, coalesce(ins.n = ins.w, false) AS stable, coalesce(out_.w = 0, false) AS absent FROM pat LEFT JOIN ins USING (candidate, fact) LEFT JOIN out_ USING (candidate, fact))"""
_DIAGS = with_(ITEMS, CELLS, _ACT, _STATE, _TABLE, _PARENT, _PATTERNS, _STABLE, _ONLY, _EVIDENCE, """dg AS (SELECT candidate, CAST(sum((state = 'always')::INT) AS BIGINT) AS cells, CAST(sum((state <> 'never')::INT) AS BIGINT) AS any_cells, CAST(sum((state = 'mixed')::INT) AS BIGINT) AS mixed_cells, CAST(sum(CASE WHEN state = 'always' THEN n_items ELSE 0 END) AS BIGINT) AS items,
   CAST(sum(CASE WHEN state = 'always' THEN realisations ELSE 0 END) AS BIGINT) AS realisations FROM sta JOIN cells USING (cell_id) GROUP BY 1)""",
    "lp AS (SELECT par.candidate, min(dg.cells) AS least_parent FROM par JOIN dg ON par.parent = dg.candidate GROUP BY 1)",
    "dsc AS (SELECT candidate, count(DISTINCT l_suppkey) AS n FROM sta JOIN items USING (cell_id) JOIN lineitem ON l_partkey = item_id WHERE state = 'always' GROUP BY 1)",
    "rf AS (SELECT candidate, count(DISTINCT fact) AS n FROM evi WHERE stable AND absent GROUP BY 1)",
    f"""dx0 AS (SELECT dg.*, coalesce(dsc.n, 0) AS descriptors, coalesce(rf.n, 0) AS residual_facts, cells < 2 AS fragile, CASE WHEN mixed_cells > 0 THEN 'realisation' WHEN operation AND any_cells = 0 THEN 'unverified' ELSE 'cell' END AS scope,
   list_filter([CASE WHEN cells < 1 THEN 'too few cells' END, CASE WHEN coalesce(dsc.n, 0) < {LEAST_DESCRIPTORS} THEN 'too few source descriptors' END, CASE WHEN mixed_cells > 0 THEN 'scope is realisation' WHEN operation AND any_cells = 0 THEN 'scope is unverified' END,
   CASE WHEN interaction AND cells < 2 THEN 'too few interaction cells' END, CASE WHEN interaction AND NOT coalesce(cells > 0 AND cells < least_parent, false) THEN 'not a strict part of its parents' END, CASE WHEN interaction AND rf.n IS NULL THEN 'no fact beyond its parents' END,
   CASE WHEN NOT interaction AND represents = '' THEN 'stands for nothing' END], lambda x: x IS NOT NULL) AS reasons FROM dg JOIN tab USING (candidate) LEFT JOIN lp USING (candidate) LEFT JOIN dsc USING (candidate) LEFT JOIN rf USING (candidate))""",
    "vec AS (SELECT candidate, string_agg(CASE state WHEN 'always' THEN '1' WHEN 'never' THEN '0' ELSE 'M' END, '' ORDER BY cell_id) AS v, CAST(sum((state <> 'never')::INT) AS BIGINT) AS active_cells FROM sta GROUP BY 1)",
    "rk AS (SELECT vec.*, alternatives, row_number() OVER (PARTITION BY v ORDER BY (len(reasons) > 0), origin, granularity, -length(represents), complexity, candidate) AS r FROM vec JOIN dx0 USING (candidate) JOIN tab USING (candidate))",
    "dx AS (SELECT dx0.* EXCLUDE (reasons), array_to_string(CASE WHEN len(reasons) = 0 AND r > 1 THEN ['collapsed into an identical activation class'] ELSE reasons END, ';') AS reasons FROM dx0 JOIN rk USING (candidate))")


def _found(spark, sf):
    parts = _parts(spark, sf)
    return parts["active"], parts["table"], parts["found"]


def _stable(spark, sf):
    made = F.array(*[F.concat(F.lit(f"{d}:"), F.col(d)) for d in DIMENSIONS], F.concat(F.lit("pair:"), "kind", F.lit("+"), "brand"))
    return _dev_cells(spark, sf).select("cell_id", F.explode(made).alias("fact"))


def _parts(spark, sf):
    suppliers = items(spark, sf).join(table(spark, sf, "lineitem"), F.col("item_id") == F.col("l_partkey")).select("cell_id", F.col("l_suppkey").alias("source_id")).distinct()
    return policies.discover(_dev_cells(spark, sf), _grid(spark, sf), COMPILER, CANDIDATES, DIMENSIONS, PATTERNS, _stable(spark, sf), suppliers, LEAST_DESCRIPTORS)


@query(_DIAGS + "SELECT candidate, cells, any_cells, mixed_cells, items, realisations, descriptors, residual_facts, fragile, scope, reasons, reasons = '' AS eligible FROM dx")
def candidate_diagnostics(spark, sf):
    return _found(spark, sf)[2].withColumn("reasons", F.array_join("reasons", ";")).drop("representative")


@query(_DIAGS + """SELECT string_agg(candidate, ',' ORDER BY candidate) AS members, count(*) AS n_members, max(CASE WHEN r = 1 THEN candidate END) AS representative, max(active_cells) AS active_cells, count(*) > 1 AS unidentifiable,
coalesce((SELECT string_agg(g, ';' ORDER BY g) FROM (SELECT alternatives || '=' || string_agg(candidate, ',' ORDER BY candidate) AS g FROM rk k WHERE k.v = rk.v AND alternatives IS NOT NULL GROUP BY alternatives HAVING count(*) > 1)), '') AS granularity_groups FROM rk GROUP BY v""")
def equivalence_classes(spark, sf):
    return _parts(spark, sf)["classes"]


_CFACTS = "cfacts AS (SELECT cell_id, unnest(['kind:' || kind, 'size:' || size, 'brand:' || brand]) AS fact FROM cells)"


def _cell_facts(spark, sf):
    return cells(spark, sf).select("cell_id", "canonical_split", F.explode(F.array(*[F.concat(F.lit(f"{d}:"), d) for d in DIMENSIONS])).alias("fact"))


def _covered(spark, sf):
    parts = _parts(spark, sf)
    return parts["coverage"], parts["table"], parts["found"]


_DEV = "dev AS (SELECT cell_id FROM cells WHERE canonical_split = 'development')"
_CON = f"con AS (SELECT left_id, right_id FROM ({_HAMMING}) WHERE left_id IN (FROM dev) AND right_id IN (FROM dev))"


@query(with_(ITEMS, CELLS, _DEV, _CON, _CFACTS) + "SELECT 'cell' AS kind, 'cell:' || cell_id AS obligation FROM dev UNION ALL SELECT DISTINCT 'fact', 'fact:' || fact FROM cfacts WHERE cell_id IN (FROM dev) UNION ALL SELECT 'contrast', 'contrast:' || left_id || ':' || right_id FROM con")
def obligations(spark, sf):
    return _parts(spark, sf)["obligations"]


@query(_DIAGS.rstrip() + f""", {_DEV}, {_CON}, {_CFACTS}, onn AS (SELECT candidate, cell_id FROM sta WHERE state = 'always' AND cell_id IN (FROM dev))
SELECT candidate, 'cell:' || cell_id AS obligation FROM onn UNION ALL SELECT candidate, 'fact:' || represents FROM tab WHERE represents IN (SELECT fact FROM cfacts WHERE cell_id IN (FROM dev))
UNION ALL SELECT candidate, 'contrast:' || left_id || ':' || right_id FROM con JOIN onn ON cell_id = left_id OR cell_id = right_id GROUP BY candidate, left_id, right_id HAVING count(*) = 1""")
def obligation_coverage(spark, sf):
    return _parts(spark, sf)["coverage"]


@query()
def greedy_cover(spark, sf):
    return selection.greedy_cover(*_covered(spark, sf))


@query(with_(ITEMS, CELLS, LABELS, _CFACTS, "lc AS (SELECT c.cell_id, c.canonical_split, l.kc FROM cells c JOIN (SELECT DISTINCT cell_id, kc FROM labels_ JOIN items USING (item_id) WHERE kc NOT IN ('K_RED', 'K_WARMTH', 'K_FASTENER', 'K_COLD_HIGH')) l USING (cell_id))",
             "sg AS (SELECT c.cell_id, c.canonical_split, coalesce(string_agg(kc, ',' ORDER BY kc), '') AS s FROM cells c LEFT JOIN lc USING (cell_id) GROUP BY 1, 2)", "sn AS (SELECT canonical_split, s, count(*) AS same FROM sg GROUP BY 1, 2)",
             "ok AS (SELECT DISTINCT kc FROM lc WHERE canonical_split = 'development')") + """SELECT canonical_split, count(*) AS n_cells, round_even(avg((s <> '')::INT::DOUBLE), 6) AS coverage, round_even(avg((same = 1)::INT::DOUBLE), 6) AS unique_rate,
  max(reuse) AS component_reuse, max(n_facts) AS n_facts FROM sg JOIN sn USING (canonical_split, s) LEFT JOIN (SELECT canonical_split, round_even(count(ok.kc) / count(*), 6) AS reuse FROM lc LEFT JOIN ok USING (kc) GROUP BY 1) u USING (canonical_split)
  LEFT JOIN (SELECT canonical_split, count(DISTINCT fact) AS n_facts FROM cfacts JOIN cells USING (cell_id) GROUP BY 1) f USING (canonical_split) GROUP BY 1""")
def policy_evaluation(spark, sf):
    from lucerna.plans.policy import RULES

    cell_rules = [r for r in RULES if "operation" not in str(r["rule"])]
    marked = labels.label_items(cells(spark, sf), COMPILER, cell_rules)
    support = marked.where("canonical_split = 'development'").select(F.explode("kc_ids").alias("kc")).distinct()
    return selection.policy_evaluation(marked, _cell_facts(spark, sf), support)


@query(with_(ITEMS, CELLS, "lv AS (SELECT cell_id, canonical_split, unnest(['kind=' || kind, 'size=' || size, 'brand=' || brand]) AS value FROM cells)", "kn AS (SELECT DISTINCT value FROM lv WHERE canonical_split = 'development')") + """SELECT cell_id, canonical_split, count(*) - count(kn.value) AS unseen, CASE WHEN (canonical_split = 'compositional_holdout') = (count(*) = count(kn.value)) THEN 'PASS' ELSE 'FAIL' END AS status FROM lv LEFT JOIN kn USING (value) WHERE canonical_split <> 'development' GROUP BY 1, 2""")
def split_audit(spark, sf):
    return selection.split_audit(cells(spark, sf), DIMENSIONS)


# Comparison

@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT l_orderkey AS k, min(l_linestatus) AS s FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s""")
def keyed_delta(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("s"))
    return canonical.keyed_delta(a, b, ["k"], ["s"])


@query("""SELECT property, bool_and(same) AS invariant, CAST(sum((NOT same)::INT) AS BIGINT) AS differing FROM (SELECT unnest(['ids', 'learner', 'correct']) AS property, unnest([b.event_id IS NOT NULL, true, b.event_id IS NULL OR (a.value >= 35) = (b.value >= 36)]) AS same FROM events a LEFT JOIN (SELECT * FROM events WHERE event_id % 1000 <> 0) b USING (event_id)) GROUP BY 1""")
def run_invariance(spark, sf):
    rows = table(spark, sf, "events")
    a = rows.select("event_id", F.col("user_id").alias("learner"), (F.col("value") >= 35).alias("correct"))
    # the second run lost some events and used another threshold
    b = rows.where("event_id % 1000 <> 0").select("event_id", F.col("user_id").alias("learner"), (F.col("value") >= 36).alias("correct"))
    return canonical.invariance(a, b, "event_id", ["learner", "correct"])


@query(with_(EVENTS) + "SELECT learner, CAST(sum(times) AS BIGINT) AS n_events, count(*) AS n_items, min(times) AS least_times, max(times) AS most_times, min(lo) = 1 AND max(hi) = sum(times) AND 2 * sum(total) = sum(times) * (sum(times) + 1) AS contiguous FROM (SELECT learner, item_id, count(*) AS times, min(seq) AS lo, max(seq) AS hi, sum(seq) AS total FROM ev GROUP BY 1, 2) GROUP BY 1")
def schedule_audit(spark, sf):
    return canonical.schedule_audit(interactions(spark, sf))


@query("""SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(h, 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) AS sum_a, CAST(sum(CAST(('0x' || substr(h, 13, 12))::BIGINT AS HUGEINT)) AS VARCHAR) AS sum_b FROM (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders)""")
def fingerprint(spark, sf):
    return canonical.fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query(with_(ITEMS) + "SELECT item_id, count(*) OVER (PARTITION BY array_to_string(operations, ' '), cell_id) AS n_same FROM items")
def repeated_prompts(spark, sf):
    rows = items(spark, sf).withColumn("prompt", F.array_join("operations", " "))
    return canonical.repeats_over(rows, ["prompt", "cell_id"]).select("item_id", "n_same")
