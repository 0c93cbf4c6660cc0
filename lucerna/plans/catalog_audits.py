"""Queries of audits, tags, policy variants and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.ids import content_id
from lucerna.operators import audits, canonical, curation, guards, history, labels, selection
from lucerna.plans.catalog_history import _ACT_ALL, _STATE
from lucerna.plans.catalog_labels import _PER_ITEM, labelled
from lucerna.plans.policy import CANDIDATES, RULES
from lucerna.plans.sql import BIG, CELLS, EVENTS, ITEMS, LABELS, condition, with_
from lucerna.sources.adapters import COMPILER, DIMENSIONS, cells, interactions, interactions_big, items, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(with_(ITEMS) + """SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags, max(kind) AS kind_tag, max('chain_edge:' || operations[1] || '>' || operations[2]) AS chain FROM (
  SELECT DISTINCT item_id, kind, operations, unnest(['kind:' || kind, 'size:' || size, 'brand:' || brand, 'operation_count:' || len(operations), 'operation:' || operations[1], 'operation:' || operations[2]]) AS tag FROM items) GROUP BY item_id""")
def coverage_tags(spark, sf):
    rows = items(spark, sf).withColumn("tags", audits.coverage_tags(DIMENSIONS))
    return rows.select("item_id", F.array_join("tags", ",").alias("tags"), audits.tag_value("tags", "kind:").alias("kind_tag"), F.array_join(audits.adjacent_pairs(), ",").alias("chain"))


@query(with_(ITEMS, CELLS, "n AS (SELECT array_to_string(operations, ' ') AS prompt, count(*) AS c FROM items GROUP BY 1)") + """SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 10 = 0 THEN 'id differs from its parts' END, CASE WHEN i.canonical_split = 'novel_feature_holdout' THEN 'unknown cell' END, CASE WHEN c > 2 THEN 'prompt is repeated' END], lambda x: x IS NOT NULL), ';') AS errors
FROM items i JOIN n ON prompt = array_to_string(operations, ' ')""")
def item_checks(spark, sf):
    # every tenth part states another id; cells of the novel holdout count as unknown
    rows = items(spark, sf).withColumn("prompt", F.array_join("operations", " "))
    rows = rows.withColumn("stated", F.when(F.col("item_id") % 10 == 0, "ITEM_0").otherwise(content_id("ITEM", F.col("item_id"), F.col("kind"))))
    known = cells(spark, sf).where("canonical_split <> 'novel_feature_holdout'")
    return audits.item_errors(rows, known, ["item_id", "kind"], "stated", ["prompt"], 2).select("item_id", F.array_join("errors", ";").alias("errors"))


@query("""WITH s AS (SELECT * FROM (SELECT source, row_number() OVER (ORDER BY lang, CAST(doc_id AS VARCHAR), doc_id) AS r FROM documents WHERE lang IN ('de', 'fr')) WHERE r <= 100)
SELECT d.source, d.eligible, coalesce(s.selected, 0) AS selected FROM (SELECT source, count(DISTINCT doc_id) AS eligible FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1) d LEFT JOIN (SELECT source, count(*) AS selected FROM s GROUP BY 1) s USING (source)""")
def sampling_audit(spark, sf):
    docs = curation.scope_filter(table(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": ["de", "fr"]})
    sample = curation.stratified_sample(docs, [{"where": {}, "quota": 100}], "doc_id", ["lang", "doc_id"])
    return audits.sampling_audit(docs, sample, "doc_id", "source")


@query(with_(ITEMS) + "SELECT 'C_KIND_' || kind AS candidate, count(*) AS n_items, count(DISTINCT cell_id) AS n_cells FROM items GROUP BY kind")
def template_candidates(spark, sf):
    rows = items(spark, sf)
    made = audits.template_candidates(rows.select(F.col("kind").alias("value")).distinct(), "C_KIND_{value}")
    return rows.join(made, F.col("kind") == F.col("value")).groupBy("candidate").agg(F.count("*").alias("n_items"), F.countDistinct("cell_id").alias("n_cells"))


@query(with_(ITEMS, CELLS) + "SELECT canonical_split, count(*) AS n_items, CAST(sum((canonical_split = 'development')::INT) AS BIGINT) AS labelled, count(DISTINCT CASE WHEN canonical_split = 'development' THEN cell_id END) AS n_labels FROM items GROUP BY 1")
def frozen_full_cell(spark, sf):
    rows = audits.frozen_full_cell(items(spark, sf), cells(spark, sf))
    return rows.groupBy("canonical_split").agg(F.count("*").alias("n_items"), F.count("kc").alias("labelled"), F.countDistinct("kc").alias("n_labels"))


@query(with_(ITEMS, LABELS, "ok AS (SELECT DISTINCT kc FROM labels_ JOIN items USING (item_id) WHERE canonical_split = 'development')") + "SELECT i.canonical_split, l.kc, count(*) AS n FROM labels_ l JOIN ok USING (kc) JOIN items i USING (item_id) GROUP BY ALL")
def frozen_rules(spark, sf):
    kept = audits.frozen_rules(labelled(spark, sf).where("canonical_split = 'development'"), RULES)
    rows = labels.label_items(items(spark, sf), COMPILER, kept)
    return rows.select("canonical_split", F.explode("kc_ids").alias("kc")).groupBy("canonical_split", "kc").agg(F.count("*").alias("n"))


_B = [*RULES[2:], {"kc_id": "K_PROMO", "rule": {"cell": {"kind": ["PROMO", "LARGE"]}}}]
_OTHER = "other AS (" + " UNION ALL ".join(f"SELECT item_id, '{r['kc_id']}' AS kc FROM items WHERE {condition(r['rule'])}" for r in _B) + ")"


@query(with_(ITEMS, LABELS, _OTHER) + """SELECT item_id, coalesce(string_agg(CASE WHEN b IS NULL THEN kc END, ',' ORDER BY kc), '') AS lost, coalesce(string_agg(CASE WHEN a IS NULL THEN kc END, ',' ORDER BY kc), '') AS new
FROM (SELECT coalesce(x.item_id, y.item_id) AS item_id, coalesce(x.kc, y.kc) AS kc, x.kc AS a, y.kc AS b FROM labels_ x FULL JOIN other y ON x.item_id = y.item_id AND x.kc = y.kc) WHERE a IS NULL OR b IS NULL GROUP BY item_id""")
def label_changes(spark, sf):
    out = audits.label_changes(labelled(spark, sf), labels.label_items(items(spark, sf), COMPILER, _B), "item_id")
    return out.select("item_id", F.array_join("lost", ",").alias("lost"), F.array_join("new", ",").alias("new"))


@query(with_(ITEMS, LABELS, _OTHER, "a AS (SELECT n, count(*) AS c FROM (SELECT items.item_id, count(kc) AS n FROM items LEFT JOIN labels_ USING (item_id) GROUP BY 1) GROUP BY 1)", "b AS (SELECT n, count(*) AS c FROM (SELECT items.item_id, count(kc) AS n FROM items LEFT JOIN other USING (item_id) GROUP BY 1) GROUP BY 1)") + "SELECT coalesce(a.n, b.n) AS n_labels, coalesce(a.c, 0) AS rows_left, coalesce(b.c, 0) AS rows_right FROM a FULL JOIN b ON a.n = b.n")
def count_histograms(spark, sf):
    return audits.count_histograms(labelled(spark, sf), labels.label_items(items(spark, sf), COMPILER, _B))


@query(with_(ITEMS, _ACT_ALL, _STATE) + "SELECT class, cell_id, count(DISTINCT state) AS states, count(*) AS n FROM sta JOIN (VALUES ('low', 'C_LOW'), ('low', 'C_LOW_AGAIN'), ('mixed', 'C_LOW'), ('mixed', 'C_SIZE_S0')) m(class, candidate) USING (candidate) GROUP BY ALL HAVING count(DISTINCT state) > 1")
def separated_classes(spark, sf):
    active = selection.activations(items(spark, sf), COMPILER, CANDIDATES)
    members = spark.createDataFrame([("low", "C_LOW"), ("low", "C_LOW_AGAIN"), ("mixed", "C_LOW"), ("mixed", "C_SIZE_S0")], "class string, candidate string")
    return audits.separated_classes(active, members)


_SUITE = {
    "repeated line keys": "SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", "repeated event ids": "SELECT 1 FROM events GROUP BY event_id HAVING count(*) > 1",
    "events without item": "SELECT 1 FROM ev WHERE item_id NOT IN (SELECT item_id FROM items)", "items without event": "SELECT 1 FROM items WHERE item_id NOT IN (SELECT item_id FROM ev)",
    "events not well formed": "SELECT 1 WHERE false", "cells in several splits": "SELECT 1 FROM items GROUP BY cell_id HAVING count(DISTINCT canonical_split) > 1",
    "development items without label": "SELECT 1 FROM per WHERE n = 0 AND canonical_split = 'development'", "learners with gaps": "SELECT 1 FROM ev GROUP BY learner HAVING max(seq) <> count(*)",
    "orders without line": "SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "items met more than once": "SELECT 1 FROM ev GROUP BY learner, item_id HAVING count(*) > 1",
}


@query(with_(ITEMS, LABELS, _PER_ITEM, EVENTS) + "SELECT check_name, n AS n_errors, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS check_name, (SELECT count(*) FROM ({sql})) AS n" for name, sql in _SUITE.items()) + ")")
def suite_report(spark, sf):
    events, rows, marked = interactions(spark, sf), items(spark, sf), labelled(spark, sf)
    keys, pairs = labels.missing_keys(events, rows, "item_id"), events.select("learner", "item_id")
    return audits.suite_report({
        "repeated line keys": labels.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), "repeated event ids": labels.repeated_keys(events, ["event_id"]),
        "events without item": events.join(rows, "item_id", "left_anti"), "items without event": keys.where("side = 'right_only'"), "events not well formed": events.where(F.size(curation.event_errors()) > 0),
        "cells in several splits": guards.in_several(rows, "cell_id", "canonical_split"), "development items without label": marked.where("canonical_split = 'development' and size(kc_ids) = 0"),
        "learners with gaps": canonical.schedule_audit(events).where("not contiguous"),
        "orders without line": labels.missing_keys(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k").where("side = 'left_only'"),
        "items met more than once": guards.multiset_difference(pairs, pairs.distinct(), ["learner", "item_id"]),
    })


@query("""SELECT dimension, count(*) AS n_pairs, CAST(sum(same) AS BIGINT) AS agreed, round_even(avg(same), 6) AS rate FROM (SELECT unnest(['cheap', 'early', 'all']) AS dimension, unnest([(a.cheap = b.cheap)::INT::DOUBLE, (a.early = b.early)::INT::DOUBLE, (a.cheap = b.cheap AND a.early = b.early)::INT::DOUBLE]) AS same
 FROM (SELECT o_custkey, o_orderkey, o_totalprice < 200000 AS cheap, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders WHERE o_orderkey % 2 = 0) a JOIN (SELECT o_orderkey - 1 AS o_orderkey, o_totalprice < 200000 AS cheap, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders WHERE o_orderkey % 2 = 1) b USING (o_orderkey)) GROUP BY 1""")
def diagnostic_agreement(spark, sf):
    # even orders are units with two flags; the order after each is the repeat
    flags = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") < 200000).alias("cheap"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"))
    repeat = flags.where("o_orderkey % 2 = 1").withColumn("o_orderkey", F.col("o_orderkey") - 1)
    return canonical.repeat_agreement(flags.where("o_orderkey % 2 = 0"), repeat, "o_orderkey", ["cheap", "early"])


@query(with_(ITEMS, BIG) + "SELECT cell_id, correct, min(learner) AS learner FROM big JOIN items USING (item_id) GROUP BY 1, 2")
def representative_sources(spark, sf):
    rows = interactions_big(spark, sf).join(items(spark, sf).select("item_id", "cell_id"), "item_id")
    return history.first_by(rows, ["cell_id", "correct"], ["learner"], ["learner"])


@query(with_(ITEMS, LABELS, _PER_ITEM, BIG) + "SELECT canonical_split, count(DISTINCT per.item_id) AS n_items, count(learner) AS n_events, count(DISTINCT learner) AS n_learners, count(DISTINCT CASE WHEN n > 0 THEN per.item_id END) AS covered FROM per LEFT JOIN big USING (item_id) GROUP BY 1")
def stage_summary(spark, sf):
    rows = labelled(spark, sf).join(interactions_big(spark, sf).select("item_id", "learner"), "item_id", "left")
    return rows.groupBy("canonical_split").agg(F.countDistinct("item_id").alias("n_items"), F.count("learner").alias("n_events"), F.countDistinct("learner").alias("n_learners"), F.countDistinct(F.when(F.size("kc_ids") > 0, F.col("item_id"))).alias("covered"))
