"""Queries of guards, record checks, sets behind labels, streams and comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions import times
from lucerna.functions.rules import operation_scope
from lucerna.operators import canonical, curation, evaluation, guards, history, labels, records, tracing
from lucerna.plans.catalog_history import _FROZEN, _MET, FEATURES, KCS, _rates, difficulty, frozen, rounded, small
from lucerna.plans.catalog_labels import _PER_ITEM, labelled, mappings
from lucerna.plans.policy import RULES
from lucerna.plans.sql import BIG, CELLS, EVENTS, ITEMS, LABELS, quoted, with_
from lucerna.sources.adapters import COMPILER, DIMENSIONS, cells, interactions, items, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(*cases: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL), ';')"


_SHARED = "both_ AS (SELECT item_id FROM items INTERSECT SELECT item_id FROM ev)"


@query(with_(ITEMS, LABELS, _PER_ITEM, EVENTS, _SHARED) + "SELECT event_id, item_id, kcs FROM ev JOIN per USING (item_id) WHERE item_id IN (FROM both_)")
def exact_projection(spark, sf):
    # the items that both tables hold, which then must cover each other exactly
    events, marked = interactions(spark, sf), labelled(spark, sf)
    events, marked = events.join(marked.select("item_id"), "item_id", "left_semi"), marked.join(events.select("item_id").distinct(), "item_id", "left_semi")
    return guards.exact_projection(events, marked).select("event_id", "item_id", F.array_join("kc_ids", ",").alias("kcs"))


@query(with_(ITEMS, CELLS) + "SELECT item_id, cell_id, c.n_items FROM items JOIN cells c USING (cell_id)")
def item_lookup(spark, sf):
    return guards.lookup(items(spark, sf).select("item_id", "cell_id"), cells(spark, sf).select("cell_id", "n_items"), "cell_id")


@query(with_(ITEMS, LABELS, _PER_ITEM) + "SELECT item_id, 'K_ANY' || CASE WHEN kcs = '' THEN '' ELSE ',' || kcs END AS kcs FROM per")
def covered_items(spark, sf):
    # with a rule that always holds, so that no item stays uncovered
    return labels.covered_items(items(spark, sf), COMPILER, [*RULES, {"kc_id": "K_ANY", "rule": {"all": []}}], every=True).select("item_id", F.array_join("kc_ids", ",").alias("kcs"))


@query("SELECT a.o_orderkey AS duplicate_of, a.o_orderkey + 1 AS unit_id, a.o_orderstatus AS primary_status, b.o_orderstatus AS repeat_status FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0")
def repeat_pairs(spark, sf):
    # an odd order repeats the even one before it
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_orderstatus")
    before = orders.select((F.col("unit_id") + 1).alias("unit_id"), F.col("unit_id").alias("duplicate_of"))
    units = orders.where("unit_id % 2 = 1").join(before, "unit_id").select("unit_id", "duplicate_of")
    return guards.paired_units(units, orders).select("duplicate_of", "unit_id", F.col("primary.o_orderstatus").alias("primary_status"), F.col("repeat.o_orderstatus").alias("repeat_status"))


_SMALL_RATES = with_(ITEMS, LABELS, EVENTS, "small AS (SELECT learner, item_id, seq, correct FROM ev)", "slong AS (SELECT learner, seq, correct, kc FROM small JOIN labels_ USING (item_id))", _rates("small", "slong"))


@query(_SMALL_RATES + "SELECT event_id, learner, item_id, correct, round(active_rate, 6) AS a, round(overall_rate, 6) AS b FROM rates JOIN ev USING (learner, seq, item_id, correct)")
def paired_predictions(spark, sf):
    rows = history.prior_rates(small(spark, sf)).select("event_id", "learner", "item_id", "correct", "active_rate", "overall_rate")
    a, b = rows.withColumnRenamed("active_rate", "p").drop("overall_rate"), rows.withColumnRenamed("overall_rate", "p").drop("active_rate")
    return rounded(guards.paired_predictions(a, b, "p"), "a", "b")


@query(with_(ITEMS, CELLS) + "SELECT canonical_split, count(*) AS n_cells, CAST(sum(n_items) AS BIGINT) AS n_items FROM cells GROUP BY 1")
def split_partition(spark, sf):
    every = cells(spark, sf)
    parts = guards.partition_by_split(every.drop("canonical_split"), every.select("cell_id", "canonical_split"))
    return parts.groupBy("canonical_split").agg(F.count("*").alias("n_cells"), F.sum("n_items").alias("n_items"))


@query("SELECT l_orderkey AS k, " + _list("CASE WHEN min_s IS DISTINCT FROM o_orderstatus THEN 'status' END", "CASE WHEN late IS DISTINCT FROM (o_totalprice > 200000) THEN 'late' END").replace("l_orderkey", "k") + " AS differing FROM (SELECT l_orderkey, min(l_linestatus) AS min_s, sum(l_extendedprice) > 200000 AS late FROM lineitem GROUP BY 1) l JOIN orders ON o_orderkey = l_orderkey WHERE min_s IS DISTINCT FROM o_orderstatus OR late IS DISTINCT FROM (o_totalprice > 200000)")
def table_disagreements(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 200000).alias("late"))
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("status"), (F.sum("l_extendedprice") > 200000).alias("late"))
    return guards.disagreements(left, right, "k", ["status", "late"]).withColumn("differing", F.array_join("differing", ";"))


@query("SELECT l_partkey AS item_id, count(DISTINCT l_returnflag) AS n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def in_several(spark, sf):
    return guards.in_several(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_returnflag"), "item_id", "l_returnflag")


@query(with_(EVENTS) + "SELECT learner, item_id, count(*) AS n_left, CAST(1 AS BIGINT) AS n_right FROM ev GROUP BY ALL HAVING count(*) <> 1")
def schedule_difference(spark, sf):
    # against a schedule in which each learner meets each of its items once
    rows = interactions(spark, sf).select("learner", "item_id")
    return guards.multiset_difference(rows, rows.distinct(), ["learner", "item_id"])


@query(with_(ITEMS, EVENTS) + "SELECT CASE WHEN canonical_split = 'development' THEN 'acquisition' ELSE 'probe' END AS stream, canonical_split, count(*) AS n, count(DISTINCT learner) AS n_learners FROM ev JOIN items USING (item_id) GROUP BY ALL")
def event_streams(spark, sf):
    rows = interactions(spark, sf).join(items(spark, sf).select("item_id", "canonical_split"), "item_id")
    dev = F.col("canonical_split") == "development"
    return guards.union_streams({"acquisition": rows.where(dev), "probe": rows.where(~dev)}).groupBy("stream", "canonical_split").agg(F.count("*").alias("n"), F.countDistinct("learner").alias("n_learners"))


@query("SELECT a AS l_partkey, b AS l_suppkey, side, count(*) AS n FROM (SELECT l_partkey AS a, l_suppkey AS b, 'left_only' AS side FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 1) UNION ALL SELECT l_partkey, l_suppkey, 'right_only' FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 1 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')) GROUP BY ALL")
def edge_changes(spark, sf):
    lines = table(spark, sf, "lineitem")
    edge = lambda where: lines.where(where).select("l_partkey", "l_suppkey")
    return guards.edge_changes(edge("l_returnflag <> 'R'"), edge("l_linenumber > 1")).groupBy("l_partkey", "l_suppkey", "side").agg(F.count("*").alias("n"))


@query(with_(EVENTS) + "SELECT coalesce(a.grp, b.grp) AS grp, b.n - a.n AS n_delta, round(b.rate - a.rate, 6) AS rate_delta FROM (SELECT item_id % 5 AS grp, count(*) AS n, avg(correct) AS rate FROM ev WHERE seq % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT item_id % 7 AS grp, count(*) AS n, avg(correct) AS rate FROM ev GROUP BY 1) b ON a.grp = b.grp")
def metric_deltas(spark, sf):
    rows = interactions(spark, sf)
    run = lambda df, m: df.groupBy((F.col("item_id") % m).alias("grp")).agg(F.count("*").alias("n"), F.avg("correct").alias("rate"))
    return rounded(guards.metric_deltas(run(rows.where("seq % 2 = 0"), 5), run(rows, 7), ["grp"], ["n", "rate"]), "rate_delta")


@query(with_(ITEMS) + "SELECT (SELECT count(*) FROM items WHERE size IN ('S3', 'S4')) + (SELECT count(*) FROM items WHERE kind = 'PROMO') AS n_errors, (SELECT string_agg(k || ': ' || e, ';' ORDER BY k, e) FROM (SELECT * FROM (SELECT item_id AS k, 'size is not allowed' AS e FROM items WHERE size IN ('S3', 'S4') UNION ALL SELECT item_id, 'kind is not allowed' FROM items WHERE kind = 'PROMO') ORDER BY k, e LIMIT 20)) AS errors")
def capped_errors(spark, sf):
    rows = items(spark, sf).withColumn("errors", curation.domain_errors({"kind": ["ECONOMY", "SMALL", "LARGE", "MEDIUM", "STANDARD"], "size": ["S0", "S1", "S2"]}))
    return guards.capped_errors(rows, "item_id", "errors", 20).withColumn("errors", F.array_join("errors", ";"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS text, true AS same FROM events")
def iso_times(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("text", times.iso_text(F.col("ts")))
    return rows.select("event_id", "text", times.iso_time(F.col("text")).eqNullSafe(F.col("ts")).alias("same"))


# Records

@query(with_(ITEMS) + "SELECT item_id, kind, size, NULL AS guideword FROM items")
def kept_fields(spark, sf):
    return records.kept_fields(items(spark, sf), ["item_id", "kind", "size", "guideword"], "item_id")


@query(with_(ITEMS, "s AS (SELECT p.item_id, coalesce(list(DISTINCT l_suppkey), []) AS sources, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 10), []) AS noted FROM items p LEFT JOIN lineitem ON l_partkey = p.item_id GROUP BY 1)") + """SELECT item_id, """ + _list("CASE WHEN price > 1500 THEN 'missing brand' END", "CASE WHEN len(sources) <> len(noted) THEN 'notes differ from sources' END") + " AS errors FROM items JOIN s USING (item_id)")
def opportunity_checks(spark, sf):
    # suppliers as sources, and notes of those that sold over ten at once; dear parts lack their brand
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_suppkey", "l_quantity")
    pairs = lines.groupBy("item_id", "l_suppkey").agg(F.max("l_quantity").alias("most"))
    both = pairs.groupBy("item_id").agg(F.collect_list("l_suppkey").alias("sources"), F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("most") > 10, F.struct("l_suppkey", "most"))))).alias("notes"))
    rows = items(spark, sf).withColumn("opportunity_id", F.col("item_id")).withColumn("brand", F.when(F.col("price") <= 1500, F.col("brand"))).join(both, "item_id", "left")
    rows = rows.withColumn("sources", F.coalesce("sources", F.array().cast("array<long>"))).withColumn("notes", F.coalesce("notes", F.create_map().cast(dict(both.dtypes)["notes"])))
    return rows.select("item_id", F.array_join(records.opportunity_errors(DIMENSIONS), ";").alias("errors"))


@query(with_(ITEMS, EVENTS) + "SELECT event_id, " + _list(
    "CASE WHEN correct IS NULL THEN 'outcome is not 0 or 1' END", "CASE WHEN probe_type <> CASE canonical_split WHEN 'development' THEN 'development_acquisition' ELSE canonical_split END THEN 'probe type differs from split' END",
    "CASE WHEN role = 'acquisition' AND canonical_split <> 'development' THEN 'acquisition of a holdout item' END", "CASE WHEN role = 'probe' AND canonical_split = 'development' THEN 'probe of a development item' END",
) + " AS errors FROM (SELECT *, CASE WHEN size IN ('S0', 'S1') THEN 'acquisition' ELSE 'probe' END AS role, CASE WHEN kind = 'PROMO' THEN 'novel_feature_holdout' ELSE 'development_acquisition' END AS probe_type FROM ev JOIN items USING (item_id))")
def compositional_checks(spark, sf):
    # roles by size and probe types by kind, so that some go with the split and others don't
    rows = interactions(spark, sf).join(items(spark, sf).select("item_id", "kind", "size", "canonical_split"), "item_id")
    rows = rows.withColumn("role", F.when(F.col("size").isin("S0", "S1"), "acquisition").otherwise("probe")).withColumn("probe_type", F.when(F.col("kind") == "PROMO", "novel_feature_holdout").otherwise("development_acquisition"))
    return rows.select("event_id", F.array_join(records.compositional_errors(), ";").alias("errors"))


_NUMBERED = "nb AS (SELECT learner, seq, kc, row_number() OVER (PARTITION BY learner, kc ORDER BY seq) AS k FROM ev JOIN labels_ USING (item_id))"


@query(with_(ITEMS, LABELS, EVENTS, _NUMBERED, "pe AS (SELECT e.event_id, count(kc) AS n, count(CASE WHEN k > 1 THEN 1 END) AS later FROM ev e LEFT JOIN nb USING (learner, seq) GROUP BY 1)") + "SELECT event_id, " + _list("CASE WHEN later < n THEN 'index below 1' END") + " AS errors FROM pe")
def projection_checks(spark, sf):
    # indices counted from 0 instead of 1, so that first opportunities stand out
    rows = small(spark, sf)
    indices = history.opportunity_index(rows).groupBy("learner", "seq").agg(F.map_from_entries(F.collect_list(F.struct("kc", F.col("opportunity") - 1))).alias("indices"))
    rows = rows.join(indices, ["learner", "seq"], "left").withColumn("indices", F.coalesce("indices", F.create_map().cast("map<string,bigint>"))).withColumn("kc_ids", F.coalesce("kc_ids", F.array().cast("array<string>")))
    return rows.select("event_id", F.array_join(curation.projection_errors("kc_ids", "indices"), ";").alias("errors"))


_COMP = with_(ITEMS, LABELS, EVENTS, "small AS (SELECT event_id, learner, seq, item_id, correct, canonical_split FROM ev JOIN items USING (item_id))", "hist AS (SELECT * FROM small WHERE canonical_split = 'development')",
    "probe AS (SELECT * FROM small WHERE canonical_split <> 'development' AND learner IN (SELECT learner FROM hist))", "sup AS (SELECT DISTINCT kc FROM labels_ JOIN items USING (item_id) WHERE canonical_split = 'development')",
    "st AS (SELECT learner, kc, count(*) AS n FROM hist JOIN labels_ USING (item_id) GROUP BY 1, 2)",
    "ix AS (SELECT learner, seq, kc, row_number() OVER (PARTITION BY learner, kc ORDER BY seq) AS k FROM hist JOIN labels_ USING (item_id) UNION ALL SELECT p.learner, p.seq, l.kc, coalesce(st.n, 0) + 1 FROM probe p JOIN labels_ l USING (item_id) LEFT JOIN st ON st.learner = p.learner AND st.kc = l.kc)",
    "cp AS (SELECT e.event_id, e.role, coalesce(string_agg(ix.kc || ':' || k, ',' ORDER BY ix.kc), '') AS indices, count(ix.kc) AS n, count(sup.kc) AS n_supported FROM (SELECT *, 'acquisition' AS role FROM hist UNION ALL SELECT *, 'probe' FROM probe) e LEFT JOIN ix USING (learner, seq) LEFT JOIN sup ON sup.kc = ix.kc GROUP BY 1, 2)")


def _compositional(spark, sf):
    known, probes, _ = frozen(spark, sf)
    return tracing.compositional_projection(known.drop("dataset_split"), probes, labelled(spark, sf))


@query(_COMP + "SELECT event_id, role, indices, n_supported, n - n_supported AS n_cold, n > 0 AS covered, n > 0 AND n = n_supported AS fully_supported, '' AS errors FROM cp")
def compositional_projection(spark, sf):
    rows = _compositional(spark, sf)
    entries = F.array_sort(F.transform(F.map_entries("indices"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return rows.select("event_id", "role", F.array_join(entries, ",").alias("indices"), F.size("supported").cast("long").alias("n_supported"), F.size("cold").cast("long").alias("n_cold"), "covered", "fully_supported", F.array_join(records.support_errors(), ";").alias("errors"))


@query(_COMP + "SELECT event_id, " + _list("CASE WHEN n = 0 THEN 'no features' END", "CASE WHEN n > n_supported THEN 'before differs from features' END") + " AS errors FROM cp")
def private_checks(spark, sf):
    # labels as features; the state before holds supported ones only
    rows = _compositional(spark, sf).withColumn("before", F.map_filter("indices", lambda k, _: F.array_contains("supported", k)))
    rows = rows.select("event_id", F.col("kc_ids").alias("features"), F.col("indices").alias("opportunities"), "before", F.col("indices").alias("after"))
    return rows.select("event_id", F.array_join(records.private_errors(), ";").alias("errors"))


@query(_COMP.rstrip() + ", px AS (SELECT p.learner, p.seq, ix.kc, k FROM probe p JOIN ix USING (learner, seq)) SELECT learner, seq, kc, k AS opportunity FROM px")
def probe_opportunities(spark, sf):
    known, probes, _ = frozen(spark, sf)
    return tracing.probe_opportunities(known, probes)


@query(with_(ITEMS) + "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'fields differ' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'a field has another type' ELSE 'ok' END AS error, CASE WHEN item_id % 4 = 3 THEN price > 1000 END AS dear, CASE WHEN item_id % 4 = 3 THEN kind END AS note FROM items")
def diagnostic_parse(spark, sf):
    # answers about parts: whole, with a field too many, cut short, or with a text for a flag
    rows = items(spark, sf).select("item_id", "kind", (F.col("price") > 1000).alias("dear"))
    whole, k = F.to_json(F.struct("dear", F.col("kind").alias("note"))), F.col("item_id") % 4
    raw = F.when(k == 0, F.to_json(F.struct("dear", F.col("kind").alias("note"), "item_id"))).when(k == 1, F.expr("substring(" + "to_json(struct(dear, kind AS note)), 1, 9)")).when(k == 2, F.to_json(F.struct(F.lit("yes").alias("dear"), F.col("kind").alias("note")))).otherwise(whole)
    parsed = rows.withColumn("raw", raw).withColumn("p", records.parsed_diagnostic("raw", ["dear"], "note"))
    return parsed.select("item_id", F.coalesce("p.error", F.lit("ok")).alias("error"), F.col("p.values.dear").alias("dear"), F.col("p.values.note").alias("note"))


_RESULT = "CASE WHEN item_id % 7 = 0 THEN 'out_of_scope' WHEN item_id % 3 = 0 THEN 'partial' ELSE 'complete' END"


@query(with_(ITEMS) + f"SELECT item_id, r = 'partial' AS second_phase, CASE r WHEN 'partial' THEN 'open dimensions' WHEN 'complete' THEN 'nothing is open' ELSE 'result is ' || r END AS why FROM (SELECT item_id, {_RESULT} AS r FROM items)")
def routing(spark, sf):
    return records.routed(mappings(spark, sf)).select("item_id", "second_phase", "why")


@query(with_(ITEMS) + "SELECT item_id, CASE brand WHEN 'B0' THEN 'not in canonical order' WHEN 'B1' THEN 'unknown name;repeated name' ELSE '' END AS errors FROM items")
def eligibility_checks(spark, sf):
    note = F.when(F.col("brand") == "B0", "phase2 eligible: size, brand; rest").when(F.col("brand") == "B1", "phase2 eligible: brand, brand, colour").otherwise("phase2 eligible: kind, size")
    return items(spark, sf).select("item_id", F.array_join(records.eligibility_errors(note, ["brand", "kind", "size"]), ";").alias("errors"))


# Sets behind labels and cells

@query("SELECT l_partkey AS cell_id, l_suppkey AS source_id, count(*) AS n_edges, arg_min(l_returnflag, struct_pack(a := l_orderkey, b := l_linenumber, c := l_shipdate, d := l_extendedprice)) AS first_note FROM lineitem GROUP BY 1, 2")
def canonical_sources(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("note"), F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").alias("position"))
    return canonical.canonical_sources(edges)


@query(with_(ITEMS) + f"""SELECT CASE WHEN r = 'complete' THEN 'contributes' ELSE 'result is ' || r END AS reason, count(*) AS n, CAST(NULL AS DOUBLE) AS ratio FROM (SELECT item_id, {_RESULT} AS r FROM items) GROUP BY 1
UNION ALL SELECT 'edges a cell', count(*), round_even(count(*) / count(DISTINCT cell_id), 6) FROM (SELECT cell_id, {_RESULT} AS r FROM items) WHERE r = 'complete'""")
def contribution(spark, sf):
    rows = mappings(spark, sf)
    return canonical.contribution(rows, rows.where("result = 'complete'").select("cell_id"))


@query(with_(ITEMS, "e AS (SELECT cell_id, kind, l_suppkey AS source_id, CASE WHEN l_quantity > 25 THEN 'bulk' END AS note FROM lineitem JOIN items ON l_partkey = item_id)", "f AS (SELECT cell_id, min(source_id) AS first FROM e GROUP BY 1)") + "SELECT DISTINCT cell_id, source_id, note, source_id = first AS primary FROM e JOIN f USING (cell_id) WHERE source_id = first OR (kind = 'PROMO' AND note IS NOT NULL)")
def source_cases(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_quantity") > 25, "bulk").alias("note"))
    edges = lines.join(items(spark, sf).select("item_id", "cell_id", "kind"), "item_id")
    return canonical.source_cases(edges, F.col("kind") == "PROMO")


_RULE_ROWS = "rules_ AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(r['kc_id'])}, {quoted('realisation' if operation_scope(r['rule']) else 'cell')}, {quoted(__import__('json').dumps(r['rule'], sort_keys=True))})" for r in RULES) + ") v(kc, scope, rule))"


@query(with_(ITEMS, LABELS, _RULE_ROWS) + "SELECT item_id, kc, scope, rule FROM labels_ JOIN rules_ USING (kc)")
def scoped_edges(spark, sf):
    return labels.scoped_edges(labelled(spark, sf), RULES)


@query(with_(ITEMS, LABELS, _RULE_ROWS) + "SELECT DISTINCT kc, 'cell' AS kind, cell_id AS member, rule FROM labels_ JOIN items USING (item_id) JOIN rules_ USING (kc) UNION ALL SELECT DISTINCT kc, 'source', CAST(l_suppkey AS VARCHAR), rule FROM labels_ JOIN lineitem ON l_partkey = item_id JOIN rules_ USING (kc)")
def inventory_members(spark, sf):
    return labels.inventory_members(labelled(spark, sf), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("source_id")), RULES)


@query(with_(ITEMS, LABELS, _PER_ITEM, _RULE_ROWS, "su AS (SELECT kc, scope, count(item_id) AS n FROM rules_ LEFT JOIN labels_ USING (kc) GROUP BY 1, 2)") + "SELECT 'row_sum' AS measure, CAST(n AS VARCHAR) AS key, count(*) AS n FROM per GROUP BY n UNION ALL SELECT 'scope_edges', scope, CAST(sum(n) AS BIGINT) FROM su GROUP BY 2 UNION ALL SELECT 'low_support', kc, n FROM su WHERE n < 25")
def matrix_histograms(spark, sf):
    return labels.matrix_histograms(labelled(spark, sf), RULES, least=25)


@query(with_(ITEMS, LABELS) + """SELECT check_name, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'no items' AS check_name, (CASE WHEN (SELECT count(*) FROM items) = 0 THEN 1 ELSE 0 END)::BIGINT AS n UNION ALL SELECT 'no labels', (CASE WHEN (SELECT count(*) FROM items WHERE kind <> 'PROMO') = 0 THEN 1 ELSE 0 END)::BIGINT
 UNION ALL SELECT 'repeated items', (SELECT count(*) FROM (SELECT item_id FROM items GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'repeated label rows', (SELECT count(*) FROM (SELECT item_id FROM items WHERE kind <> 'PROMO' GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'items not covered both ways', (SELECT count(*) FROM items WHERE kind = 'PROMO')
 UNION ALL SELECT 'unknown labels', (SELECT count(*) FROM labels_ JOIN items USING (item_id) WHERE kind <> 'PROMO' AND kc = 'K_RED') UNION ALL SELECT 'cell differs', (SELECT count(*) FROM items WHERE kind <> 'PROMO' AND size = 'S4'))""")
def matrix_integrity(spark, sf):
    # labels without promotional parts, with another cell for the largest, and a rule list that lacks one
    marked = labelled(spark, sf).where("kind <> 'PROMO'").withColumn("cell_id", F.when(F.col("size") == "S4", "CELL_0").otherwise(F.col("cell_id")))
    return labels.matrix_integrity(items(spark, sf), marked, [r for r in RULES if r["kc_id"] != "K_RED"])


_SPLIT_SMALL = __import__("lucerna.plans.catalog_history", fromlist=["_SPLIT"])._SPLIT.format(t="small")


@query(with_(ITEMS, LABELS, EVENTS, "small AS (SELECT learner, item_id, seq, correct FROM ev)", _SPLIT_SMALL, "c AS (SELECT spl.*, item_id IN (SELECT item_id FROM labels_) AS covered FROM spl)") + "SELECT dataset_split, count(*) AS n_events, CAST(sum(covered::INT) AS BIGINT) AS covered_events, CAST(sum((NOT covered)::INT) AS BIGINT) AS uncovered_events, round_even(avg(covered::INT::DOUBLE), 6) AS share FROM c GROUP BY 1")
def coverage_by_time(spark, sf):
    rows = history.chronological_split(small(spark, sf)).withColumn("kc_ids", F.coalesce("kc_ids", F.array().cast("array<string>")))
    return labels.coverage_by_time(rows)


_PAIRS = "pr AS (SELECT a.item_id, a.r AS pr, b.r AS rr, a.kind AS pk, b.kind AS rk, a.size AS ps, b.size AS rs FROM (SELECT item_id, kind, CASE WHEN item_id % 5 <> 0 THEN size END AS size, " + _RESULT + " AS r FROM items) a JOIN (SELECT item_id, kind, CASE WHEN item_id % 5 <> 0 THEN size END AS size, " + _RESULT + " AS r FROM items) b ON b.item_id = a.item_id + 1 WHERE a.item_id % 2 = 0)"
_SAME = "(pk IS NOT DISTINCT FROM rk AND ps IS NOT DISTINCT FROM rs)"


@query(with_(ITEMS, _PAIRS) + f"""SELECT measure, count(same) AS n, CAST(sum(same::INT) AS BIGINT) AS agreed, round_even(avg(same::INT::DOUBLE), 6) AS rate FROM (SELECT unnest(['same class', 'same mapping', 'same routing', 'complete against partial', 'inventory unaffected', 'same kind', 'same size']) AS measure,
 unnest([pr = rr, pr = rr AND {_SAME}, (pr = 'partial') = (rr = 'partial'), (pr = 'complete' AND rr = 'partial') OR (pr = 'partial' AND rr = 'complete'), (pr = 'complete') = (rr = 'complete') AND (pr <> 'complete' OR {_SAME}), pk = rk, ps = rs]) AS same FROM pr) GROUP BY 1""")
def mapping_agreement(spark, sf):
    # the part after each even one repeats it; every fifth says nothing of its size
    rows = mappings(spark, sf).select("item_id", "result", "kind", F.when(F.col("item_id") % 5 != 0, F.col("size")).alias("size"))
    as_struct = lambda name: F.struct("result", "kind", "size").alias(name)
    pairs = rows.where("item_id % 2 = 0").select("item_id", as_struct("primary")).join(rows.where("item_id % 2 = 1").select((F.col("item_id") - 1).alias("item_id"), as_struct("repeat")), "item_id")
    return canonical.mapping_agreement(pairs, ["kind", "size"])


# Frozen probes

_PROBE_METRICS = _FROZEN.rstrip() + f""", lp AS (SELECT canonical_split, n_supported, n_cold, correct, unnest(['empirical', 'bkt']) AS technique, unnest([empirical, bkt]) AS p0 FROM fp),
sc AS (SELECT canonical_split, technique, correct, least(greatest(p0, 1e-6), 1 - 1e-6) AS p, unnest(list_filter(['all', CASE WHEN n_supported + n_cold > 0 THEN 'covered' END, CASE WHEN n_supported > 0 AND n_cold = 0 THEN 'fully_supported' END], lambda x: x IS NOT NULL)) AS scope FROM lp)
SELECT canonical_split, technique, scope, {_MET} FROM sc GROUP BY canonical_split, technique, scope"""


def _scored(spark, sf):
    known, probes, start = frozen(spark, sf)
    return tracing.frozen_probes(known, probes, start).join(items(spark, sf).select("item_id", "canonical_split"), "item_id")


def _probe_metrics(scored, techniques):
    long = evaluation.long_predictions(tracing.probe_scopes(scored), techniques, ["canonical_split", "scope"])
    return rounded(evaluation.metrics(long, ["canonical_split", "technique", "scope"]), "log_loss", "brier", "accuracy", "mean_prediction", "observed_rate")


@query(_PROBE_METRICS)
def probe_evaluation(spark, sf):
    return _probe_metrics(_scored(spark, sf), ["empirical", "bkt"])


@query(_PROBE_METRICS.replace("SELECT canonical_split, technique, scope,", "SELECT 'evaluated' AS status, canonical_split, technique, scope,"))
def compositional_result(spark, sf):
    known, probes, start = frozen(spark, sf)
    split = items(spark, sf).select("item_id", "canonical_split")
    return tracing.compositional_result(known, probes, lambda h, p: _probe_metrics(tracing.frozen_probes(h, p, start).join(split, "item_id"), ["empirical", "bkt"]))


@query()
def frozen_logistic(spark, sf):
    # fitted on the training part of development events; probes are scored by their frozen features
    known, _, _ = frozen(spark, sf)
    predict = tracing.fit_logistic(history.prior_rates(known).withColumn("item_difficulty", difficulty()), FEATURES, KCS)
    scored = _scored(spark, sf).withColumn("item_difficulty", difficulty()).withColumnRenamed("overall", "overall_rate").withColumnRenamed("empirical", "active_rate")
    out = predict(scored.withColumn("kc_ids", F.coalesce("kc_ids", F.array().cast("array<string>"))), "overall_rate")
    return rounded(out.select("learner", "seq", "item_id", "correct", "logistic", "fallback"), "logistic")


@query(with_(ITEMS, LABELS, _PER_ITEM, BIG, "src AS (SELECT l_partkey AS item_id, count(DISTINCT l_suppkey) AS n_sources, count(*) AS n_edges FROM lineitem GROUP BY 1)", "us AS (SELECT item_id, count(*) AS n_events, count(DISTINCT learner) AS n_learners FROM big GROUP BY 1)", EVENTS.replace("ev AS", "ev2 AS"), "pe AS (SELECT item_id, count(*) AS n_predictions FROM ev2 GROUP BY 1)")
       + f"SELECT per.item_id, per.cell_id, kcs, {_RESULT.replace('item_id', 'per.item_id')} AS result, coalesce(n_sources, 0) AS n_sources, coalesce(n_edges, 0) AS n_edges, coalesce(n_events, 0) AS n_events, coalesce(n_learners, 0) AS n_learners, coalesce(n_predictions, 0) AS n_predictions FROM per LEFT JOIN src ON src.item_id = per.item_id LEFT JOIN us ON us.item_id = per.item_id LEFT JOIN pe ON pe.item_id = per.item_id")
def full_lineage(spark, sf):
    """Item to cell, mapping, sources, labels, events and predictions."""
    from lucerna.sources.adapters import interactions_big

    sources = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.countDistinct("l_suppkey").alias("n_sources"), F.count("*").alias("n_edges"))
    use = interactions_big(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_events"), F.countDistinct("learner").alias("n_learners"))
    made = interactions(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_predictions"))
    rows = labelled(spark, sf).join(mappings(spark, sf).select("item_id", "result"), "item_id")
    for part in (sources, use, made):
        rows = rows.join(part, "item_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_edges", "n_events", "n_learners", "n_predictions")]
    return rows.select("item_id", "cell_id", F.array_join("kc_ids", ",").alias("kcs"), "result", *zero)
