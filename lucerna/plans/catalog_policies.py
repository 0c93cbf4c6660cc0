"""Queries of candidates, the selected policy and its evaluation, and of derived clause features."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lucerna.functions import forms
from lucerna.functions.ids import content_id
from lucerna.operators import audits, canonical, labels, policies, records, selection
from lucerna.plans.catalog_history import _ACT, _CFACTS, _DEV, _DIAGS, _EVIDENCE, _ONLY, _PARENT, _STABLE, _STATE, _cell_facts, _parts, _stable
from lucerna.plans.catalog_labels import _HAMMING
from lucerna.plans.policy import CANDIDATES, RULES
from lucerna.plans.sql import CELLS, ITEMS, condition, quoted, with_
from lucerna.sources.adapters import CLAUSE_VALUES, COMPILER, DIMENSIONS, cells, clauses, items

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Sizes one by one and together, kinds one by one, and two interactions of them.
COMPILED = policies.interactions(
    [policies.generic("C_SIZE_ANY", 1, 0, 1, "size", ["S0", "S1", "S2", "S3", "S4"]), *policies.from_template(("C_SIZE_{VALUE}", 0, 1, 1, "size:{value}"), "size", ["S0", "S1", "S2", "S3", "S4"]),
     *policies.from_template(("C_KIND_{VALUE}", 0, 1, 1, "kind:{value}"), "kind", ["ECONOMY", "SMALL"])],
    [("C_SMALL_S0", "C_KIND_SMALL", "C_SIZE_S0"), ("C_ECONOMY_SIZED", "C_KIND_ECONOMY", "C_SIZE_ANY")],
)


@query(with_(ITEMS) + " UNION ALL ".join(f"SELECT {quoted(c[0])} AS candidate, {quoted(d)} AS dimensions, CAST({c[3]} AS BIGINT) AS complexity, (SELECT count(*) FROM items WHERE {condition(c[6])}) AS n_items" for c, d in zip(COMPILED, ["size"] * 6 + ["kind"] * 2 + ["kind,size"] * 2, strict=True)))
def compiled_candidates(spark, sf):
    """Candidates from templates and parents, with the items that each holds for."""
    rules = [{"kc_id": c[0], "rule": c[6]} for c in COMPILED]
    held = labels.edges(labels.label_items(items(spark, sf), COMPILER, rules)).groupBy(F.col("kc").alias("candidate")).agg(F.count("*").alias("n_items"))
    made = selection.candidate_table(spark, COMPILED).select("candidate", "complexity").join(policies.candidate_dimensions(spark, COMPILED).select("candidate", F.array_join("dimensions", ",").alias("dimensions")), "candidate")
    return made.join(held, "candidate", "left").select("candidate", "dimensions", "complexity", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query(with_(ITEMS, _ACT, _STATE, _PARENT, _ONLY) + "SELECT candidate, cell_id FROM po")
def parent_only_cells(spark, sf):
    parts = _parts(spark, sf)
    return policies.parent_only_cells(parts["active"], parts["table"])


@query(with_(ITEMS, CELLS, _ACT, _STATE, _PARENT, _ONLY, _STABLE, "pat AS (SELECT DISTINCT 'C_ECONOMY_B0' AS candidate, fact FROM stf JOIN cells USING (cell_id) WHERE canonical_split = 'development')", _EVIDENCE)
       + "SELECT candidate, fact, inside_cells, parent_cells, stable, absent, stable AND absent AS beyond_parents FROM evi")
def residual_evidence(spark, sf):
    # every fact of the development cells as a pattern, the pair of kind and brand among them
    parts = _parts(spark, sf)
    patterns = _stable(spark, sf).select(F.lit("C_ECONOMY_B0").alias("candidate"), "fact").distinct()
    return policies.residual_evidence(parts["active"], parts["table"], _stable(spark, sf), patterns)


_CON = f"con AS (SELECT left_id, right_id FROM ({_HAMMING}) WHERE left_id IN (FROM dev) AND right_id IN (FROM dev))"


@query(_DIAGS.rstrip() + f""", {_DEV}, {_CON}, {_CFACTS}, onn AS (SELECT candidate, cell_id FROM sta WHERE state = 'always' AND cell_id IN (FROM dev)),
cov AS (SELECT candidate, 'cell:' || cell_id AS obligation FROM onn UNION ALL SELECT candidate, 'fact:' || represents FROM tab WHERE represents IN (SELECT fact FROM cfacts WHERE cell_id IN (FROM dev)) UNION ALL SELECT candidate, 'contrast:' || left_id || ':' || right_id FROM con JOIN onn ON cell_id = left_id OR cell_id = right_id GROUP BY candidate, left_id, right_id HAVING count(*) = 1),
obl AS (SELECT 'cell' AS kind, 'cell:' || cell_id AS obligation FROM dev UNION ALL SELECT DISTINCT 'fact', 'fact:' || fact FROM cfacts WHERE cell_id IN (FROM dev) UNION ALL SELECT 'contrast', 'contrast:' || left_id || ':' || right_id FROM con)
SELECT kind, obligation FROM obl WHERE obligation NOT IN (SELECT obligation FROM cov JOIN dx USING (candidate) WHERE reasons = '' AND candidate NOT LIKE 'C_BRAND%')""")
def uncoverable(spark, sf):
    # without the brand candidates, so that some obligations stay open
    parts = _parts(spark, sf)
    found = parts["found"].withColumn("eligible", F.col("eligible") & ~F.col("candidate").startswith("C_BRAND"))
    return policies.uncoverable(parts["obligations"], parts["coverage"], found)


@query()
def selection_statuses(spark, sf):
    parts = _parts(spark, sf)
    return policies.statuses(policies.select_policy(parts), parts["found"], parts["coverage"])


@query()
def selection_objective(spark, sf):
    parts = _parts(spark, sf)
    return policies.objective(policies.select_policy(parts), parts["found"], parts["table"], parts["obligations"], parts["coverage"])


#: Rules on cells alone, with what each stands for.
CELL_RULES = [{"kc_id": c[0], "rule": c[6], "represents": c[5]} for c in CANDIDATES if "operation" not in json.dumps(c[6])]
_OWN = [(r["kc_id"], next(iter(r["rule"]["cell"]))) for r in CELL_RULES if list(r["rule"]) == ["cell"] and len(r["rule"]["cell"]) == 1] + [("C_LOW_AGAIN", "size")]


@query(with_(ITEMS, CELLS, _CFACTS, f"con AS ({_HAMMING})", "lab AS (SELECT cell_id, canonical_split, list_filter([" + ", ".join(f"CASE WHEN {condition(r['rule'])} THEN {quoted(r['kc_id'])} END" for r in CELL_RULES) + "], lambda x: x IS NOT NULL) AS kcs FROM cells)",
             "us AS (SELECT cell_id, canonical_split, unnest(kcs) AS kc FROM lab)", "sh AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(r['kc_id'])}, {quoted(r['represents'])})" for r in CELL_RULES if r["represents"]) + ") v(kc, fact))",
             "own AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(d)})" for k, d in _OWN) + ") v(kc, dimension))", "cv AS (SELECT DISTINCT cell_id, fact FROM us JOIN sh USING (kc))",
             "rc AS (SELECT canonical_split, round_even(count(cv.fact) / count(*), 6) AS fact_recall FROM cfacts JOIN cells USING (cell_id) LEFT JOIN cv USING (cell_id, fact) GROUP BY 1)",
             "ru AS (SELECT canonical_split, count(*) AS reused_cells FROM lab WHERE len(kcs) > 0 AND list_has_all((SELECT list(DISTINCT kc) FROM us WHERE canonical_split = 'development'), kcs) GROUP BY 1)",
             """pc AS (SELECT CASE WHEN a.canonical_split = b.canonical_split THEN a.canonical_split WHEN a.canonical_split = 'development' THEN b.canonical_split WHEN b.canonical_split = 'development' THEN a.canonical_split END AS canonical_split, dimension,
               list_concat(list_filter(a.kcs, lambda x: NOT list_contains(b.kcs, x)), list_filter(b.kcs, lambda x: NOT list_contains(a.kcs, x))) AS apart FROM con JOIN lab a ON left_id = a.cell_id JOIN lab b ON right_id = b.cell_id)""",
             "pr AS (SELECT canonical_split, count(*) AS n_contrasts, round_even(avg((len(apart) > 0)::INT::DOUBLE), 6) AS contrast_preservation, round_even(avg((list_has_any(apart, (SELECT list(kc) FROM own WHERE own.dimension = pc.dimension)))::INT::DOUBLE), 6) AS witness_preservation FROM pc WHERE canonical_split IS NOT NULL GROUP BY 1)")
       + "SELECT c.canonical_split, c.n AS n_cells, fact_recall, coalesce(reused_cells, 0) AS reused_cells, coalesce(n_contrasts, 0) AS n_contrasts, contrast_preservation, witness_preservation FROM (SELECT canonical_split, count(*) AS n FROM cells GROUP BY 1) c LEFT JOIN rc USING (canonical_split) LEFT JOIN ru USING (canonical_split) LEFT JOIN pr USING (canonical_split)")
def policy_transfer(spark, sf):
    every = cells(spark, sf)
    return policies.transfer(every, CELL_RULES, COMPILER, _cell_facts(spark, sf), canonical.hamming_one(every, DIMENSIONS))


@query()
def frozen_policy(spark, sf):
    """Select on development, write the policy, read it back, and only then look at the holdouts."""
    parts = _parts(spark, sf)
    chosen = [r["candidate"] for r in policies.select_policy(parts).where("status = 'selected'").collect()]  # declared candidates
    written = policies.freeze(spark, *policies.compile_policy(chosen, CANDIDATES))
    every = cells(spark, sf)
    return policies.transfer(every, policies.thawed(written), COMPILER, _cell_facts(spark, sf), canonical.hamming_one(every, DIMENSIONS))


def _mode_sql(mode: str, rules: list[dict], frozen: bool) -> str:
    per = " UNION ALL ".join(f"SELECT item_id, {quoted(r['kc_id'])} AS kc FROM items WHERE {condition(r['rule'])}" + (f" AND EXISTS (SELECT 1 FROM items d WHERE d.canonical_split = 'development' AND {condition(r['rule']).replace('list_contains(operations', 'list_contains(d.operations').replace('(kind', '(d.kind').replace('(size', '(d.size').replace('(brand', '(d.brand')})" if frozen else "") for r in rules)
    return f"SELECT '{mode}' AS mode, canonical_split, count(DISTINCT items.item_id) AS n_items, count(kc) AS n_edges, count(DISTINCT kc) AS n_labels FROM items LEFT JOIN ({per}) l ON l.item_id = items.item_id GROUP BY 2"


@query(with_(ITEMS) + _mode_sql("predefined", RULES, False) + " UNION ALL " + _mode_sql("frozen_rules", RULES, True) + " UNION ALL SELECT 'frozen_full_cell', canonical_split, count(*), count(CASE WHEN canonical_split = 'development' THEN 1 END), count(DISTINCT CASE WHEN canonical_split = 'development' THEN cell_id END) FROM items GROUP BY 2")
def policy_modes(spark, sf):
    rows, every, out = items(spark, sf), cells(spark, sf), None
    for mode in ("predefined", "frozen_rules", "frozen_full_cell"):
        marked = policies.labelled_by(mode, rows, every, COMPILER, RULES).select("item_id", "canonical_split", F.explode_outer("kc_ids").alias("kc"))
        one = marked.groupBy("canonical_split").agg(F.countDistinct("item_id").alias("n_items"), F.count("kc").alias("n_edges"), F.countDistinct("kc").alias("n_labels")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


# Derived clause features

def _at(name: str, expr: str) -> str:
    values = CLAUSE_VALUES[name]
    return f"([{', '.join(map(quoted, values))}])[1 + ({expr}) % {len(values)}] AS {name}"


CLAUSES = f"""cl0 AS (SELECT p_partkey AS item_id, {_at('tense', 'p_size // 2')}, {_at('aspect', 'p_size')}, {_at('voice', 'p_partkey // 3')}, {_at('polarity', 'p_size // 4')}, {_at('clause', 'p_partkey')}, {_at('modal', 'p_size // 7')}, {_at('frame_type', 'p_partkey // 7')}, {_at('note', 'p_partkey // 2')}, string_split(p_name, ' ')[1] AS word FROM part),
cl AS (SELECT *, CASE WHEN frame_type = 'transitive' THEN 'the ' || word END AS object FROM cl0)"""
_SUBTYPE = "CASE WHEN contains(note, 'LET''S NOT') THEN 'lets_not' WHEN contains(note, 'LET''S') THEN 'lets' WHEN contains(note, 'emphatic-DO') THEN 'emphatic_do' WHEN contains(note, 'LET + third-person pronoun') THEN 'let_pronoun' ELSE 'ordinary' END"
_DO = "(clause <> 'imperative' AND (polarity = 'negative' OR clause IN ('polar_question', 'non_subject_wh_question')) AND aspect = 'none' AND voice = 'active' AND modal = 'none' AND frame_type <> 'copular')"
_OPS = f"""list_sort(list_distinct(list_filter([CASE WHEN voice = 'passive' THEN 'be_passive' END, CASE WHEN aspect <> 'none' THEN aspect END, CASE WHEN modal <> 'none' THEN 'central_modal' END, CASE WHEN clause = 'imperative' AND subtype <> 'ordinary' THEN subtype END, CASE WHEN clause = 'imperative' AND subtype = 'ordinary' AND polarity = 'negative' THEN 'do_support_negation' END,
 CASE WHEN {_DO} THEN 'do_support' END, CASE WHEN clause <> 'imperative' AND polarity = 'negative' THEN 'negation' END, CASE WHEN clause IN ('polar_question', 'non_subject_wh_question') THEN 'operator_inversion' END, CASE WHEN clause = 'subject_wh_question' THEN 'subject_wh' END, CASE WHEN clause = 'non_subject_wh_question' THEN 'non_subject_wh' END], lambda x: x IS NOT NULL)))"""
_SITE = f"CASE WHEN clause = 'imperative' THEN 'none' WHEN modal <> 'none' THEN 'modal' WHEN {_DO} THEN 'do' WHEN aspect IN ('perfect', 'perfect_progressive') THEN 'have' WHEN aspect = 'progressive' OR voice = 'passive' THEN 'be' ELSE 'main_verb' END"
_ROLES = "list_filter([CASE WHEN modal <> 'none' THEN 'modal' END, CASE WHEN aspect IN ('perfect', 'perfect_progressive') THEN 'perfect' END, CASE WHEN aspect IN ('progressive', 'perfect_progressive') THEN 'progressive' END, CASE WHEN voice = 'passive' THEN 'passive' END, 'main'], lambda x: x IS NOT NULL)"
_DERIVED = with_(CLAUSES, f"sb AS (SELECT *, {_SUBTYPE} AS subtype FROM cl)", f"dv AS (SELECT *, {_OPS} AS ops, {_SITE} AS site, {_ROLES} AS roles FROM sb)")
_CELL = ["aspect", "voice", "modal", "polarity", "clause", "frame_type"]


def _derived(spark, sf):
    rows = clauses(spark, sf).withColumn("subtype", forms.imperative_subtype(F.col("note")))
    own = [F.col(c) for c in _CELL]
    return rows.withColumn("ops", forms.operations(*own, F.col("subtype"))).withColumn("site", forms.agreement_site(*own)).withColumn("roles", forms.chain_roles(*own[:3]))


@query(_DERIVED + "SELECT item_id, subtype, array_to_string(ops, ',') AS operations, site AS agreement_site, array_to_string(roles, '>') AS chain FROM dv")
def derived_operations(spark, sf):
    return _derived(spark, sf).select("item_id", "subtype", F.array_join("ops", ",").alias("operations"), F.col("site").alias("agreement_site"), F.array_join("roles", ">").alias("chain"))


_H = lambda o: f"list_contains(ops, '{o}')"


@query(_DERIVED + f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(ops, list_filter(['agreement_site:' || site, CASE WHEN {_H('negation')} THEN 'negation_host:' || site END, CASE WHEN {_H('operator_inversion')} THEN 'inverted_operator:' || site END, CASE WHEN {_H('do_support')} AND {_H('operator_inversion')} THEN 'dependency:inverted_operator:do' END,
 CASE WHEN {_H('do_support')} AND {_H('negation')} THEN 'dependency:negation_host:do' END, CASE WHEN {_H('operator_inversion')} AND {_H('negation')} THEN 'dependency:inverted_negative_operator' END], lambda x: x IS NOT NULL),
 list_transform(range(1, len(roles)), lambda i: 'chain_edge:' || roles[i] || '>' || roles[i + 1])))), ',') AS facts FROM dv""")
def derived_facts(spark, sf):
    return _derived(spark, sf).select("item_id", F.array_join(forms.realisation_facts(F.col("ops"), F.col("site"), F.col("roles")), ",").alias("facts"))


_WHS = "wh AS (SELECT *, unnest(CASE WHEN clause = 'subject_wh_question' THEN ['who/subject'] WHEN clause = 'non_subject_wh_question' THEN list_filter([CASE WHEN voice = 'active' AND object IS NOT NULL THEN 'what/object' END, 'when/adjunct'], lambda x: x IS NOT NULL) ELSE ['-'] END) AS w FROM cl)"
_EVERY = "[" + ", ".join(quoted(f"{t}/{p}/{n}") for t, p, n in forms.SUBJECTS) + "]"


@query(with_(CLAUSES, _WHS) + f"SELECT item_id, w AS wh, unnest(CASE WHEN w = 'who/subject' THEN ['who/3/singular'] WHEN clause = 'imperative' THEN ['you/2/singular'] WHEN voice = 'passive' THEN CASE WHEN object IS NULL THEN [] ELSE [object || '/3/singular'] END ELSE {_EVERY} END) AS subject FROM wh")
def realisation_conditions(spark, sf):
    rows = clauses(spark, sf).withColumn("w", F.explode(forms.wh_conditions(F.col("clause"), F.col("voice"), F.col("object"))))
    rows = rows.withColumn("s", F.explode(forms.subjects(F.col("clause"), F.col("voice"), F.col("object"), F.col("w"))))
    return rows.select("item_id", F.when(F.col("w").isNull(), "-").otherwise(F.concat_ws("/", F.col("w.phrase"), F.col("w.role"))).alias("wh"), F.concat_ws("/", F.col("s.text"), F.col("s.person").cast("string"), F.col("s.number")).alias("subject"))


@query(with_(CLAUSES, f"sb AS (SELECT *, {_SUBTYPE} AS wanted, CASE WHEN item_id % 4 = 0 THEN 'ordinary' WHEN clause = 'imperative' THEN {_SUBTYPE} END AS subtype FROM cl)") + """SELECT item_id, array_to_string(list_filter([
 CASE WHEN clause = 'subject_wh_question' AND item_id % 3 = 0 THEN 'subject WH is missing' END, CASE WHEN clause = 'subject_wh_question' AND item_id % 3 <> 0 AND voice = 'active' THEN 'WH phrase is not the subject' END,
 CASE WHEN clause = 'non_subject_wh_question' THEN 'other WH is missing' END, CASE WHEN clause = 'imperative' AND subtype IS NULL THEN 'imperative subtype is missing' END, CASE WHEN clause <> 'imperative' AND subtype IS NOT NULL THEN 'imperative subtype elsewhere' END,
 CASE WHEN coalesce(subtype = 'let_pronoun', false) THEN 'pronoun and subtype differ' END, CASE WHEN voice = 'passive' AND frame_type <> 'transitive' THEN 'frame has no passive' END,
 CASE WHEN wanted <> 'ordinary' AND subtype IS DISTINCT FROM wanted THEN 'source note asks for another subtype' END], lambda x: x IS NOT NULL), ';') AS errors FROM sb""")
def spec_checks(spark, sf):
    # every fourth row forgets the source's subtype, and every third its WH; passive subjects are the patient
    wh = F.when((F.col("clause") == "subject_wh_question") & (F.col("item_id") % 3 != 0), F.struct(F.lit("who").alias("phrase"), F.lit("subject").alias("role")))
    subtype = F.when(F.col("item_id") % 4 == 0, "ordinary").when(F.col("clause") == "imperative", forms.imperative_subtype(F.col("note")))
    subject = F.when(F.col("voice") == "passive", F.struct(F.when(F.col("clause") == "subject_wh_question", "who").otherwise(F.upper("object")).alias("text"))).otherwise(F.struct(F.lit("she").alias("text")))
    rows = clauses(spark, sf).withColumn("wh", wh).withColumn("subtype", subtype).withColumn("subject", subject)
    errors = forms.spec_errors(F.col("clause"), F.col("voice"), F.col("frame_type") == "transitive", F.col("object"), F.col("wh"), F.col("subtype"), F.lit(None).cast("string"), F.col("subject"), F.col("note"))
    return rows.select("item_id", F.array_join(errors, ";").alias("errors"))


@query(with_(CLAUSES) + """SELECT item_id, array_to_string(list_filter([CASE WHEN clause = 'imperative' AND (tense <> 'NA' OR modal <> 'none') THEN 'imperative with tense or modal' END, CASE WHEN tense <> 'NA' AND modal <> 'none' THEN 'tense beside a modal' END,
 CASE WHEN item_id % 3 <> 0 AND clause <> 'imperative' AND modal = 'none' AND tense = 'NA' THEN 'complete cell without tense' END, CASE WHEN item_id % 3 <> 0 AND clause <> 'imperative' AND modal <> 'none' AND tense <> 'NA' THEN 'complete modal cell with tense' END], lambda x: x IS NOT NULL), ';') AS errors FROM cl""")
def tense_checks(spark, sf):
    # every third mapping isn't complete
    return clauses(spark, sf).select("item_id", F.array_join(records.tense_errors(complete=F.col("item_id") % 3 != 0), ";").alias("errors"))


_FIRST = "CASE WHEN item_id % 7 = 0 THEN 'unresolved' WHEN item_id % 3 = 0 THEN 'partial' ELSE 'complete' END"
_SECOND = "CASE WHEN item_id % 5 = 0 THEN 'unresolved' WHEN item_id % 4 = 0 THEN 'complete' WHEN item_id % 7 = 0 THEN 'unresolved' WHEN item_id % 3 = 0 THEN CASE WHEN brand = 'B0' THEN 'out_of_scope' ELSE 'partial' END ELSE 'complete' END"


@query(with_(ITEMS, f"tr AS (SELECT item_id, brand, kind, size, {_FIRST} AS a, {_SECOND} AS b FROM items)") + """SELECT item_id, CASE WHEN a = 'unresolved' AND b <> 'unresolved' THEN 'an unresolved mapping can''t be refined'
 WHEN b = 'unresolved' AND a <> 'unresolved' THEN CASE brand WHEN 'B0' THEN 'contradiction note has another form' WHEN 'B1' THEN CASE WHEN kind = 'SMALL' THEN '' ELSE 'contradiction isn''t of a stated value' END ELSE 'contradiction names no known value' END
 WHEN a <> 'partial' AND a <> b THEN 'only partial mappings change' WHEN a = 'partial' AND b NOT IN ('partial', 'complete') THEN 'a refinement stays partial or becomes complete' WHEN a = 'partial' AND size = 'S4' THEN 'a child refines no parent' ELSE '' END AS errors FROM tr""")
def transition_checks(spark, sf):
    # second annotations of parts: some unresolved with notes of three forms, some changed, the largest refining nothing
    rows = items(spark, sf).withColumn("first", F.expr(_FIRST)).withColumn("second", F.expr(_SECOND))
    note = F.when(F.col("brand") == "B0", "it says otherwise").when(F.col("brand") == "B1", "phase2 contradiction: kind=SMALL; evidence: the name").otherwise("phase2 contradiction: colour=RED; evidence: the name")
    refined = F.when(F.col("size") == "S4", F.array(F.lit("a child refines no parent"))).otherwise(F.array().cast("array<string>"))
    domains = {"kind": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], "size": ["S0", "S1", "S2", "S3", "S4"]}
    errors = records.transition_errors("first", "second", "note", {"kind": F.col("kind"), "size": F.col("size")}, domains, refined)
    return rows.withColumn("note", note).select("item_id", F.array_join(errors, ";").alias("errors"))


_FINISHED = """fi AS (SELECT dv.*, dv.item_id // 2 AS contrast_id, 'CELL_' || aspect || voice AS cell_id, CASE WHEN item_id % 9 = 0 THEN 'ITEM_1' ELSE 'ITEM_' || upper(substr(sha256(item_id || '|' || clause), 1, 16)) END AS stated_id FROM dv),
sd AS (SELECT contrast_id, count(*) AS n, count(DISTINCT frame_type) AS fr, (count(DISTINCT aspect) > 1)::INT + (count(DISTINCT voice) > 1)::INT + (count(DISTINCT polarity) > 1)::INT AS diff FROM fi GROUP BY 1),
pm AS (SELECT clause, note, word, count(*) AS same FROM fi GROUP BY 1, 2, 3)"""


@query(_DERIVED.rstrip() + ", " + _FINISHED + """ SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 9 = 0 THEN 'id has another form' END, CASE WHEN item_id % 9 = 0 THEN 'id differs from its parts' END, CASE WHEN item_id % 8 = 0 THEN 'source isn''t of the cell' END,
 CASE WHEN ops <> list_filter(ops, lambda x: x <> 'negation') THEN 'evidence differs from its derivation' END, CASE WHEN NOT ends_with(clause, 'question') THEN 'answer ends with another sign' END, CASE WHEN voice = 'passive' AND object IS NOT NULL THEN 'passive subject isn''t the patient' END,
 CASE WHEN same > 1 THEN 'prompt is repeated' END, CASE WHEN n <> 2 THEN 'contrast set isn''t of two' END, CASE WHEN n = 2 AND fr > 1 THEN 'contrast differs in more than its cell' END, CASE WHEN n = 2 AND fr = 1 AND diff <> 1 THEN 'contrast isn''t of one dimension' END], lambda x: x IS NOT NULL), ';') AS errors
 FROM fi JOIN sd USING (contrast_id) JOIN pm USING (clause, note, word)""")
def hard_item_checks(spark, sf):
    # clauses as finished items that all end with a question mark, lack negation in their evidence, and pair up by number
    rows = _derived(spark, sf).withColumn("contrast_id", F.floor(F.col("item_id") / 2)).withColumn("cell_id", F.concat(F.lit("CELL_"), "aspect", "voice"))
    stated = F.when(F.col("item_id") % 9 == 0, "ITEM_1").otherwise(content_id("ITEM", F.col("item_id"), F.col("clause")))
    rows = rows.withColumn("stated_id", stated).withColumn("source_id", F.col("item_id") % 8).withColumn("subject", F.lit(None).cast("string")).withColumn("prompt", F.concat_ws("|", "clause", "note", "word")).withColumn("answer", F.lit("so?"))
    rows = rows.withColumn("derived", F.filter("ops", lambda x: x != "negation")).withColumn("operations", F.col("ops")).withColumn("tags", F.col("ops")).withColumn("reasons", F.array("clause"))
    edges = rows.select("cell_id").distinct().crossJoin(spark.range(1, 8).withColumnRenamed("id", "source_id"))
    contrasts = audits.contrast_set_errors(rows, ["aspect", "voice", "polarity"], "frame_type")
    return audits.hard_item_errors(rows, edges, contrasts, ["item_id", "clause"]).select("item_id", F.array_join("errors", ";").alias("errors"))
