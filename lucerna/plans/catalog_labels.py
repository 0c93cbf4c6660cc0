"""Queries of labelling, the item-by-label matrix, curation and annotation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions import ids
from lucerna.functions.rules import facts, merged, operation_scope
from lucerna.operators import canonical, curation, labels
from lucerna.plans.policy import FACT_RULES, IMPLICATIONS, INTERACTION_RULES, RULES
from lucerna.plans.sql import BIG, CELLS, EVENTS, ITEMS, LABELS, condition, quoted, with_
from lucerna.sources.adapters import COMPILER, DIMENSIONS, cells, interactions, items, table

KCS = sorted(r["kc_id"] for r in RULES)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def labelled(spark, sf):
    return labels.label_items(items(spark, sf), COMPILER, RULES)


_PER_ITEM = "per AS (SELECT i.item_id, i.cell_id, i.canonical_split, count(l.kc) AS n, coalesce(string_agg(l.kc, ',' ORDER BY l.kc), '') AS kcs FROM items i LEFT JOIN labels_ l USING (item_id) GROUP BY ALL)"


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND NOT (lang = 'en' AND source IN ('src0', 'src1'))")
def scope_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return curation.scope_filter(docs, {"lang": ["en", "de"]}, {"lang": "en", "source": ["src0", "src1"]})


@query(with_(ITEMS, LABELS, _PER_ITEM) + "SELECT item_id, kcs, n AS n_labels FROM per")
def rule_labels(spark, sf):
    return labelled(spark, sf).select("item_id", F.array_join("kc_ids", ",").alias("kcs"), F.size("kc_ids").cast("long").alias("n_labels"))


_EVIDENCE = [({"all": [{"operation": "cold"}, {"cell": {"size": ["S3", "S4"]}}]}, "K_COLD_HIGH"), ({"cell": {"kind": "PROMO"}}, "K_PROMO")]


@query(with_(ITEMS) + """SELECT item_id, 'K_COLD_HIGH' AS kc, (list_contains(operations, 'cold') AND size IN ('S3', 'S4')) AS active, 0 AS leaf, 'operations' AS field, 'cold' AS expected, array_to_string(operations, ',') AS actual, list_contains(operations, 'cold') AS matched FROM items
UNION ALL SELECT item_id, 'K_COLD_HIGH', (list_contains(operations, 'cold') AND size IN ('S3', 'S4')), 1, 'cell.size', 'S3,S4', size, size IN ('S3', 'S4') FROM items
UNION ALL SELECT item_id, 'K_PROMO', kind = 'PROMO', 0, 'cell.kind', 'PROMO', kind, kind = 'PROMO' FROM items""")
def rule_evidence(spark, sf):
    return labels.rule_evidence(items(spark, sf), COMPILER, [{"kc_id": k, "rule": r} for r, k in _EVIDENCE])


@query(with_(ITEMS) + "SELECT item_id, 'K_FULL_' || substr(cell_id, 6) AS kcs FROM items")
def full_cell_labels(spark, sf):
    return labels.full_cell_labels(items(spark, sf)).select("item_id", F.array_join("kc_ids", ",").alias("kcs"))


@query(with_(ITEMS, LABELS) + "SELECT kc, count(*) AS n_items FROM (SELECT kc, item_id FROM labels_ UNION ALL SELECT 'K_BASIC_BRAND0', item_id FROM items WHERE kind IN ('ECONOMY', 'STANDARD') AND brand = 'B0') GROUP BY kc")
def merged_policy(spark, sf):
    both = merged(RULES, INTERACTION_RULES)
    return labels.edges(labels.label_items(items(spark, sf), COMPILER, both)).groupBy("kc").agg(F.count("*").alias("n_items"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted(r['kc_id'])}, {str(operation_scope(r['rule'])).lower()})" for r in RULES) + ") t(kc, uses_operation) WHERE kc IN (SELECT kc FROM (" + with_(ITEMS, LABELS) + "SELECT DISTINCT kc FROM labels_))")
def rule_scope(spark, sf):
    fired = labels.edges(labelled(spark, sf)).select("kc").distinct()
    scopes = spark.createDataFrame([(r["kc_id"], operation_scope(r["rule"])) for r in RULES], "kc string, uses_operation boolean")
    return fired.join(scopes, "kc")


def _fact_sql(r: dict) -> str:
    text = quoted(r["fact"]) if "fact" in r else quoted(r["template"].split("{")[0]) + " || " + r["template"].split("{")[1].rstrip("}")
    return f"SELECT item_id, {text} AS fact FROM items WHERE {condition(r['rule'])}"


FACTS = "facts_ AS (" + " UNION ALL ".join(map(_fact_sql, FACT_RULES)) + ")"


@query(with_(ITEMS, FACTS) + "SELECT i.item_id, coalesce(string_agg(f.fact, ',' ORDER BY f.fact), '') AS facts FROM items i LEFT JOIN facts_ f USING (item_id) GROUP BY i.item_id")
def salient_facts(spark, sf):
    return items(spark, sf).select("item_id", F.array_join(facts(COMPILER, FACT_RULES), ",").alias("facts"))


@query(with_(ITEMS) + " UNION ALL ".join(f"SELECT item_id, {quoted(n)} AS error FROM items WHERE {condition(a)} AND NOT {condition(b)}" for n, a, b in IMPLICATIONS))
def implication_violations(spark, sf):
    return items(spark, sf).select("item_id", F.explode(curation.implication_errors(COMPILER, IMPLICATIONS)).alias("error"))


@query(with_(EVENTS, """bad AS (SELECT event_id, CASE WHEN item_id % 11 = 0 THEN NULL ELSE item_id END AS item_id, seq - 1 AS seq, CASE WHEN item_id % 7 = 0 THEN 2 ELSE correct END AS correct, CASE WHEN item_id % 13 = 0 THEN NULL ELSE ts END AS ts FROM ev)""") + """SELECT verdict, count(*) AS n FROM (SELECT coalesce(nullif(array_to_string(list_filter([
  CASE WHEN item_id IS NULL THEN 'missing id' END, CASE WHEN correct IS NULL OR correct NOT IN (0, 1) THEN 'outcome is not 0 or 1' END, CASE WHEN seq < 1 THEN 'sequence is not positive' END, CASE WHEN ts IS NULL THEN 'no time' END], lambda x: x IS NOT NULL), ';'), ''), 'ok') AS verdict FROM bad) GROUP BY 1""")
def record_checks(spark, sf):
    # events numbered from 0, some of them without item or time or with an outcome that is none
    item = F.col("item_id")
    events = curation.reject_leaks(interactions(spark, sf)).select(
        "event_id", "learner", F.when(item % 11 != 0, item).alias("item_id"), (F.col("seq") - 1).alias("seq"), F.when(item % 13 != 0, F.col("ts")).alias("ts"), F.when(item % 7 == 0, 2).otherwise(F.col("correct")).alias("correct"))
    errors = F.array_join(curation.event_errors(), ";")
    return events.groupBy(F.when(errors == "", "ok").otherwise(errors).alias("verdict")).agg(F.count("*").alias("n"))


@query(with_(ITEMS) + "SELECT item_id, array_to_string(list_filter([CASE WHEN kind NOT IN ('ECONOMY', 'SMALL', 'PROMO') THEN 'kind is not allowed' END, CASE WHEN size NOT IN ('S0', 'S1', 'S2', 'S3') THEN 'size is not allowed' END], lambda x: x IS NOT NULL), ';') AS errors FROM items")
def domain_checks(spark, sf):
    return items(spark, sf).select("item_id", F.array_join(curation.domain_errors({"kind": ["ECONOMY", "SMALL", "PROMO"], "size": ["S0", "S1", "S2", "S3"]}), ";").alias("errors"))


def mappings(spark, sf):
    """Parts as mappings: one cell of kind and size; every third has an open size, every seventh is out of scope."""
    one = lambda c: F.struct(F.lit("scalar").alias("kind"), F.array(c).alias("values"))
    open_ = F.struct(F.lit("list").alias("kind"), F.array("size", F.lit("S0")).alias("values"))
    rows = items(spark, sf).withColumn("result", F.when(F.col("item_id") % 7 == 0, "out_of_scope").when(F.col("item_id") % 3 == 0, "partial").otherwise("complete"))
    cell = F.struct(one(F.col("kind")).alias("kind"), F.when(F.col("item_id") % 3 == 0, open_).otherwise(one(F.col("size"))).alias("size"))
    return rows.withColumn("cells", F.when(F.col("item_id") % 14 == 0, F.array().cast("array<struct<kind:struct<kind:string,values:array<string>>,size:struct<kind:string,values:array<string>>>>")).otherwise(F.array(cell)))


_KINDS, _SIZES = ["ECONOMY", "SMALL", "PROMO", "LARGE", "MEDIUM"], ["S0", "S1", "S2", "S3", "S4"]


@query(with_(ITEMS) + """SELECT item_id, array_to_string(list_filter([
  CASE WHEN item_id % 14 <> 0 AND kind = 'STANDARD' THEN 'bad kind' END,
  CASE WHEN item_id % 14 <> 0 AND item_id % 3 = 0 AND size = 'S0' THEN 'repeated size' END,
  CASE WHEN item_id % 7 = 0 AND item_id % 14 <> 0 THEN 'out of scope has cells' END], lambda x: x IS NOT NULL), ';') AS errors FROM items""")
def mapping_checks(spark, sf):
    return mappings(spark, sf).select("item_id", F.array_join(curation.mapping_errors({"kind": _KINDS, "size": _SIZES}), ";").alias("errors"))


@query(with_(ITEMS) + """SELECT item_id, CASE WHEN brand = 'B0' OR (brand = 'B1' AND size IN ('S0', 'S1')) THEN '' ELSE 'a child refines no parent;a parent has no child' END AS errors FROM items""")
def refinement_checks(spark, sf):
    v = lambda kind, *cols: F.struct(F.lit(kind).alias("kind"), (F.array(*cols) if cols else F.array().cast("array<string>")).alias("values"))
    parent = F.struct(v("scalar", F.col("kind")).alias("kind"), F.when(F.col("brand") == "B0", v("unknown")).otherwise(v("list", F.lit("S0"), F.lit("S1"))).alias("size"))
    child = F.struct(F.when(F.col("brand") == "B2", v("scalar", F.lit("OTHER"))).otherwise(v("scalar", F.col("kind"))).alias("kind"), v("scalar", F.col("size")).alias("size"))
    rows = items(spark, sf).withColumn("parents", F.array(parent)).withColumn("children", F.array(child))
    return rows.select("item_id", F.array_join(curation.refinement_errors("parents", "children", ["kind", "size"]), ";").alias("errors"))


@query(with_(ITEMS) + """SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'not one JSON object' ELSE 'ok' END AS verdict, CASE WHEN item_id % 5 <> 0 THEN kind END AS kind,
  CASE WHEN brand = 'B0' THEN 'brand,size' WHEN brand = 'B1' THEN 'size' ELSE '' END AS eligible FROM items""")
def raw_annotation_parse(spark, sf):
    raw = F.to_json(F.struct("item_id", "kind"))
    note = F.when(F.col("brand") == "B0", "phase2 eligible: size, brand; rest").when(F.col("brand") == "B1", "Phase2 Eligible: size").otherwise("none")
    rows = items(spark, sf).withColumn("raw", F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("Answer: "), raw)).otherwise(raw)).withColumn("note", note)
    parsed = rows.select("item_id", "note", *curation.parse_mapping("raw", "item_id long, kind string"))
    return parsed.select("item_id", F.coalesce("error", F.lit("ok")).alias("verdict"), F.col("mapping.kind").alias("kind"), F.array_join(curation.eligibility(F.col("note"), ["brand", "kind", "size"]), ",").alias("eligible"))


@query(with_(ITEMS) + """SELECT i.item_id, (s.item_id IS NOT NULL AND s.cheap AND s.plain) AS accepted,
  CASE WHEN s.item_id IS NULL THEN 'missing diagnostic' ELSE array_to_string(list_filter([CASE WHEN NOT s.cheap THEN 'cheap' END, CASE WHEN NOT s.plain THEN 'plain' END], lambda x: x IS NOT NULL), ';') END AS reasons
FROM items i LEFT JOIN (SELECT l_partkey AS item_id, avg(l_extendedprice) < 45000 AS cheap, max(l_discount) < 0.1 AS plain FROM lineitem GROUP BY 1) s USING (item_id)""")
def acceptance_gate(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg((F.avg("l_extendedprice") < 45000).alias("cheap"), (F.max("l_discount") < 0.1).alias("plain"))
    return curation.acceptance(items(spark, sf), flags, "item_id", ["cheap", "plain"]).select("item_id", "accepted", F.array_join("reasons", ";").alias("reasons"))


@query(with_(ITEMS, "fold AS (SELECT DISTINCT cell_id, canonical_split FROM items WHERE canonical_split <> 'development')") + "SELECT i.item_id, i.cell_id, coalesce(f.canonical_split, 'development') AS fold FROM items i LEFT JOIN fold f USING (cell_id)")
def fold_join(spark, sf):
    fold = cells(spark, sf).where("canonical_split <> 'development'").select("cell_id", F.col("canonical_split").alias("fold"))
    return items(spark, sf).join(fold, "cell_id", "left").select("item_id", "cell_id", F.coalesce("fold", F.lit("development")).alias("fold"))


@query("SELECT o_orderkey AS doc_id, lang, o.position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) o JOIN documents ON doc_id = o_orderkey WHERE position <= 500")
def ordered_semi_join(spark, sf):
    # the 500 largest orders declare ids and their order (a top-k feature)
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)
    from pyspark.sql import Window

    declared = top.select(F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("position"))
    return curation.ordered_semi_join(table(spark, sf, "documents").select("doc_id", "lang"), declared, "doc_id").select("doc_id", "lang", "position")


@query(with_(EVENTS, ITEMS) + "SELECT item_id, 'right_only' AS side FROM items WHERE item_id NOT IN (SELECT item_id FROM ev) UNION ALL SELECT DISTINCT item_id, 'left_only' FROM ev WHERE item_id NOT IN (SELECT item_id FROM items)")
def missing_keys(spark, sf):
    return labels.missing_keys(interactions(spark, sf), items(spark, sf), "item_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return labels.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT doc_id, lang, 0 AS stratum, row_number() OVER (ORDER BY source, lang, CAST(doc_id AS VARCHAR), doc_id) AS rank FROM documents WHERE lang = 'en'),
b AS (SELECT doc_id, lang, 1 AS stratum, row_number() OVER (ORDER BY source, lang, CAST(doc_id AS VARCHAR), doc_id) AS rank FROM documents WHERE lang IN ('en', 'fr') AND doc_id NOT IN (SELECT doc_id FROM a WHERE rank <= 40))
SELECT * FROM a WHERE rank <= 40 UNION ALL SELECT * FROM b WHERE rank <= 60""")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    out = curation.stratified_sample(docs, [{"where": {"lang": "en"}, "quota": 40}, {"where": {"lang": ["en", "fr"]}, "quota": 60}], "doc_id", ["source", "lang", "doc_id"])
    return out.select("doc_id", "lang", "stratum", "rank")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || CASE lang WHEN 'de' THEN 0 ELSE 1 END || '|' || doc_id), doc_id) AS rank FROM documents WHERE lang IN ('de', 'es'))
SELECT doc_id, lang, rank FROM r WHERE rank <= 25""")
def seeded_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    out = curation.stratified_sample(docs, [{"where": {"lang": "de"}, "quota": 25}, {"where": {"lang": "es"}, "quota": 25}], "doc_id", seed=7)
    return out.select("doc_id", "lang", "rank")


_EDGES = "e AS (SELECT l_partkey AS item_id, l_suppkey AS source_id, l_shipdate, l_returnflag FROM lineitem)"


@query(with_(ITEMS, _EDGES) + """SELECT cell_id, count(DISTINCT source_id) AS n_sources, count(*) AS n_edges, min(source_id) AS first_source FROM e JOIN items USING (item_id) GROUP BY cell_id""")
def canonical_dedup(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("note"))
    return canonical.canonical_dedup(edges.join(items(spark, sf).select("item_id", "cell_id"), "item_id")).select("cell_id", "n_sources", "n_edges", "first_source")


@query(with_(ITEMS) + "SELECT r.result, count(item_id) AS n, r.result = 'complete' AS contributes FROM (VALUES ('complete'), ('partial'), ('out_of_scope'), ('unresolved')) r(result) LEFT JOIN (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'out_of_scope' WHEN item_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS result FROM items) m ON m.result = r.result GROUP BY r.result")
def attrition(spark, sf):
    return canonical.attrition(mappings(spark, sf), curation.RESULTS)


@query(with_(ITEMS) + """SELECT dimension, count(*) AS n_pairs, CAST(sum(same) AS BIGINT) AS agreed, round_even(avg(same), 6) AS rate FROM (
  SELECT unnest(['kind', 'size', 'brand', 'all']) AS dimension, unnest([(a.kind = b.kind)::INT::DOUBLE, (a.size = b.size)::INT::DOUBLE, (a.brand = b.brand)::INT::DOUBLE, (a.kind = b.kind AND a.size = b.size AND a.brand = b.brand)::INT::DOUBLE]) AS same
  FROM items a JOIN items b ON b.item_id = a.item_id + 1 WHERE a.item_id % 2 = 0) GROUP BY dimension""")
def repeat_agreement(spark, sf):
    # even parts are units; the part after each is its repeat
    rows = items(spark, sf)
    repeat = rows.where("item_id % 2 = 1").withColumn("item_id", F.col("item_id") - 1)
    return canonical.repeat_agreement(rows.where("item_id % 2 = 0"), repeat, "item_id", DIMENSIONS)


_HAMMING = " UNION ALL ".join(
    f"SELECT l.cell_id AS left_id, r.cell_id AS right_id, '{d}' AS dimension, l.{d} AS left_value, r.{d} AS right_value FROM cells l JOIN cells r ON l.cell_id < r.cell_id AND l.{d} <> r.{d} AND " + " AND ".join(f"l.{x} = r.{x}" for x in DIMENSIONS if x != d)
    for d in DIMENSIONS
)


@query(with_(ITEMS, CELLS) + _HAMMING)
def hamming_contrasts(spark, sf):
    return canonical.hamming_one(cells(spark, sf), DIMENSIONS)


@query(with_(ITEMS, CELLS, f"c AS ({_HAMMING})") + """SELECT h.split, dimension, count(*) AS n FROM (VALUES ('compositional_holdout'), ('novel_feature_holdout')) h(split), c JOIN cells a ON left_id = a.cell_id JOIN cells b ON right_id = b.cell_id
 WHERE (a.canonical_split = h.split AND b.canonical_split IN (h.split, 'development')) OR (b.canonical_split = h.split AND a.canonical_split = 'development') GROUP BY ALL""")
def cross_split_contrasts(spark, sf):
    # each holdout's cells against those of its own split and of development, every pair once
    all_cells = cells(spark, sf)
    split = lambda side: all_cells.select(F.col("cell_id").alias(f"{side}_id"), F.col("canonical_split").alias(f"{side}_split"))
    pairs = canonical.hamming_one(all_cells, DIMENSIONS).join(split("left"), "left_id").join(split("right"), "right_id")
    a, b = F.col("left_split"), F.col("right_split")
    owner = F.when(a == b, a).when(a == "development", b).when(b == "development", a)
    return pairs.withColumn("split", owner).where("split <> 'development'").groupBy("split", "dimension").agg(F.count("*").alias("n"))


@query()
def contrast_matching(spark, sf):
    # items with equal words whose cells differ in one dimension, matched one to one
    rows = items(spark, sf).withColumn("nuisance", F.array_join("operations", " "))
    return canonical.contrast_matching_by_group(rows, "item_id", "nuisance", DIMENSIONS)


@query(with_(ITEMS, CELLS) + "SELECT cell_id, frame, weight FROM cells CROSS JOIN (VALUES ('plain', 1), ('boxed', 2), ('bulk', 5)) f(frame, weight) WHERE NOT (frame = 'bulk' AND kind = 'SMALL') AND NOT (frame = 'boxed' AND size IN ('S3', 'S4'))")
def admissible_grid(spark, sf):
    frames = spark.createDataFrame([("plain", 1), ("boxed", 2), ("bulk", 5)], "frame string, weight long")
    ok = ~((F.col("frame") == "bulk") & (F.col("kind") == "SMALL")) & ~((F.col("frame") == "boxed") & F.col("size").isin("S3", "S4"))
    return canonical.admissible_grid(cells(spark, sf), frames, ok).select("cell_id", "frame", "weight")


@query(with_(ITEMS, LABELS) + "SELECT kc, count(DISTINCT cell_id) AS n_cells, count(DISTINCT item_id) AS n_items, min(cell_id) AS first_cell, CASE kc " + " ".join(f"WHEN '{r['kc_id']}' THEN {i}" for i, r in enumerate(RULES)) + " END AS rule_no FROM labels_ JOIN items USING (item_id) GROUP BY kc")
def inventory_cards(spark, sf):
    return labels.inventory(labelled(spark, sf), RULES)


@query(with_(ITEMS, LABELS, _PER_ITEM, EVENTS, "n AS (SELECT item_id, count(*) AS c FROM ev GROUP BY 1)") + """SELECT canonical_split, count(*) AS n_items, CAST(sum(CASE WHEN per.n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered_items, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_events,
  CAST(sum(CASE WHEN per.n > 0 THEN coalesce(c, 0) ELSE 0 END) AS BIGINT) AS covered_events, round_even(sum(CASE WHEN per.n > 0 THEN 1 ELSE 0 END) / count(*), 6) AS item_share FROM per LEFT JOIN n USING (item_id) GROUP BY 1""")
def coverage(spark, sf):
    return labels.coverage(interactions(spark, sf), labelled(spark, sf))


@query(with_(ITEMS, LABELS) + "SELECT item_id, kc FROM labels_")
def qmatrix_edges(spark, sf):
    return labels.edges(labelled(spark, sf))


@query(with_(ITEMS) + "SELECT item_id, " + ", ".join(f"CASE WHEN {condition(next(r['rule'] for r in RULES if r['kc_id'] == k))} THEN 1 ELSE 0 END AS {k}" for k in KCS) + " FROM items")
def qmatrix_wide(spark, sf):
    return labels.wide(labelled(spark, sf), KCS)


_DIAG = f"count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_edges, CAST(sum((n = 0)::INT) AS BIGINT) AS uncovered, CAST(sum((n > 4)::INT) AS BIGINT) AS dense_rows, max(n) AS most_labels, round_even(sum(n) / (count(*) * {len(KCS)}), 6) AS density FROM per"


@query(with_(ITEMS, LABELS, _PER_ITEM) + f"SELECT canonical_split, {_DIAG} GROUP BY 1 UNION ALL SELECT 'all', {_DIAG}")
def qmatrix_diagnostics(spark, sf):
    return labels.matrix_diagnostics(labelled(spark, sf), len(KCS))


_TWINS = [*RULES, {"kc_id": "K_LOW_TWIN", "rule": {"any": [{"cell": {"size": "S0"}}, {"cell": {"size": "S1"}}]}}, {"kc_id": "K_NONE_A", "rule": {"operation": "absent"}}, {"kc_id": "K_NONE_B", "rule": {"any": []}}]
_TWIN_LABELS = "t AS (" + " UNION ALL ".join(f"SELECT item_id, '{r['kc_id']}' AS kc FROM items WHERE {condition(r['rule'])}" for r in _TWINS) + ")"
_TWIN_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{r['kc_id']}')" for r in _TWINS) + ") v(kc))"


@query(with_(ITEMS, _TWIN_LABELS, _TWIN_NAMES, "s AS (SELECT names.kc, count(item_id) AS n, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS list FROM names LEFT JOIN t USING (kc) GROUP BY 1)") + "SELECT a.kc AS kc_left, b.kc AS kc_right, a.n AS n_items FROM s a JOIN s b ON a.list = b.list AND a.kc < b.kc")
def identical_columns(spark, sf):
    return labels.identical_columns(labels.label_items(items(spark, sf), COMPILER, _TWINS), [r["kc_id"] for r in _TWINS])


@query(with_(ITEMS, LABELS) + "SELECT kc, count(*) AS n_items, count(DISTINCT cell_id) AS n_cells FROM labels_ JOIN items USING (item_id) WHERE canonical_split = 'development' GROUP BY kc")
def rule_support(spark, sf):
    return labels.rule_support(labelled(spark, sf))


@query(with_(ITEMS) + "SELECT w AS tag, count(*) AS n FROM (SELECT unnest(operations) AS w FROM items) GROUP BY 1")
def tag_support(spark, sf):
    return items(spark, sf).select(F.explode("operations").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(with_(ITEMS) + "SELECT item_id, 'ITEM_' || upper(substr(sha256(kind || '|' || size || '|' || 'null' || '|' || item_id), 1, 16)) AS content_id FROM items")
def stable_id(spark, sf):
    return items(spark, sf).select("item_id", ids.content_id("ITEM", F.col("kind"), F.col("size"), None, F.col("item_id")).alias("content_id"))


@query("SELECT p_partkey AS item_id, round(0.25 + 0.5 * (CAST(('0x' || substr(h, 1, 8))::BIGINT AS DOUBLE) * 4294967296.0 + ('0x' || substr(h, 9, 8))::BIGINT) / 18446744073709551615.0, 6) AS difficulty FROM (SELECT p_partkey, sha256('17|' || p_partkey) AS h FROM part)")
def hash_difficulty(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.round(ids.hash_uniform(F.lit(17), F.col("p_partkey"), low=0.25, high=0.75), 6).alias("difficulty"))


@query("""SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem)) AS both, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS unsold,
 (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem EXCEPT ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS repeated,
 (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem UNION SELECT s_suppkey FROM supplier)) AS suppliers""")
def set_operations(spark, sf):
    part, line, supplier = table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem"), table(spark, sf, "supplier").select("s_suppkey")
    pairs = line.select("l_partkey", "l_suppkey")
    sizes = [part.intersect(line.select("l_partkey")), part.subtract(line.select("l_partkey")), pairs.exceptAll(pairs.distinct()), line.select("l_suppkey").union(supplier).distinct()]
    out = None
    for name, df in zip(("both", "unsold", "repeated", "suppliers"), sizes, strict=True):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query(with_(ITEMS, BIG, LABELS, _PER_ITEM) + "SELECT item_id, cell_id, kcs, count(learner) AS n_events, count(DISTINCT learner) AS n_learners, CAST(coalesce(sum(correct), 0) AS BIGINT) AS n_correct FROM per LEFT JOIN big USING (item_id) GROUP BY ALL")
def lineage(spark, sf):
    from lucerna.sources.adapters import interactions_big

    use = interactions_big(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_events"), F.countDistinct("learner").alias("n_learners"), F.sum("correct").alias("n_correct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return labelled(spark, sf).join(use, "item_id", "left").select("item_id", "cell_id", F.array_join("kc_ids", ",").alias("kcs"), zero("n_events"), zero("n_learners"), zero("n_correct"))
