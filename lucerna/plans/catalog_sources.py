"""Queries of sources and sinks (what is written comes back as it was), of the scans that spread long keys, and of the stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions.ids import content_id
from lucerna.operators import canonical, curation, evaluation, history, rule_index
from lucerna.operators.labels import label_items
from lucerna.plans.catalog_history import rounded, small
from lucerna.plans.policy import RULES
from lucerna.plans.sql import EVENTS, ITEMS, LABELS, condition, with_
from lucerna.sources import files
from lucerna.sources.adapters import COMPILER, LINE_ORDER, items, table
from lucerna.sources.cuts import scratch
from lucerna.streaming.histories import trace_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, o_totalprice FROM orders")
def jsonl_round_trip(spark, sf):
    """Orders through JSON lines, nulls kept."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), "o_totalprice")
    path = scratch(spark, "orders-jsonl")
    files.write_jsonl(rows, path, sort_keys=True)
    return files.read_jsonl(spark, path, rows.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_table_round_trip(spark, sf):
    """The nations as the array of one JSON report."""
    row = F.struct("n_nationkey", "n_name", "n_regionkey")
    path = scratch(spark, "nations-json")
    files.write_report(table(spark, sf, "nation").agg(F.collect_list(row).alias("rows")), path)  # one row by its aggregation, 25 nations
    return files.read_json_table(spark, path, "rows").select("n_nationkey", "n_name", "n_regionkey")


_WIDE = ", ".join(f"CAST(({condition(r['rule'])})::INT AS VARCHAR) AS {r['kc_id']}" for r in RULES)


@query(with_(ITEMS) + f"SELECT CAST(item_id AS VARCHAR) AS item_id, {_WIDE} FROM items")
def wide_csv_round_trip(spark, sf):
    """The item by label matrix through CSV, whose values come back as text."""
    marked = label_items(items(spark, sf), COMPILER, RULES)
    wide = marked.select("item_id", *[F.array_contains("kc_ids", r["kc_id"]).cast("int").alias(r["kc_id"]) for r in RULES])
    path = scratch(spark, "matrix-csv")
    files.write_wide_csv(wide, path, "item_id")
    return files.read_csv(spark, path)


@query("SELECT row_number() OVER (ORDER BY c_custkey DESC) AS position, 'C' || c_custkey AS id FROM customer")
def id_list_round_trip(spark, sf):
    """The customers' ids, written in falling order and read back with their positions."""
    ids = table(spark, sf, "customer").select((-F.col("c_custkey")).alias("position"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    path = scratch(spark, "ids")
    files.write_id_list(ids, path)
    return files.read_id_list(spark, path).withColumn("position", F.col("position").cast("long"))


@query("SELECT s_suppkey, s_name FROM supplier")
def digest_guard(spark, sf):
    """Suppliers from a file whose SHA-256 is the one noted when it was written."""
    path = scratch(spark, "suppliers")
    files.write_jsonl(table(spark, sf, "supplier").select("s_suppkey", "s_name").coalesce(1), path)
    parts = f"{path}/part-*"
    noted = spark.read.format("binaryFile").load(parts).select(F.sha2("content", 256)).first()[0]
    files.require_digest(spark, parts, noted)
    return files.read_jsonl(spark, path, "s_suppkey long, s_name string")


@query("SELECT p_partkey, p_name FROM part")
def counted_write(spark, sf):
    """Parts published only once the rows written are as many as the parts; the count is taken while they are read."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    expected = table(spark, sf, "part").count()  # what a manifest would say
    path = scratch(spark, "parts")
    files.write_counted(rows, path, expected, "parts")
    return files.require_count(spark.read.parquet(path), expected, "parts")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def by_class_round_trip(spark, sf):
    """Line items in a folder a class, read back by class."""
    path = scratch(spark, "lines")
    files.write_by_class(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, "l_returnflag")
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query(with_(ITEMS, LABELS) + "SELECT items.item_id, coalesce(string_agg(kc, ',' ORDER BY kc), '') AS kc_ids FROM items LEFT JOIN labels_ USING (item_id) GROUP BY 1")
def indexed_labels(spark, sf):
    """Labels by the rule index: rules are rows of a table, joined with the items' atoms."""
    rows = items(spark, sf)
    marked = rule_index.label_by_index(rows, "item_id", rule_index.rule_table(spark, RULES, COMPILER), COMPILER)
    return marked.select("item_id", F.array_join("kc_ids", ",").alias("kc_ids"))


@query()
def bootstrap_by_range(spark, sf):
    """The paired bootstrap with counts drawn by range of learners."""
    rows = history.prior_rates(small(spark, sf)).select("learner", "correct", F.col("active_rate").alias("a"), F.col("overall_rate").alias("b"))
    return rounded(evaluation.bootstrap_by_range(rows, 1000), "difference", "low", "high")


def _digest_sql(prime: int, base: int, start: int) -> str:
    squares, square = [], base
    for _ in range(canonical._POSITION_BITS):
        squares.append(square)
        square = square * square % prime
    power = f"list_reduce(list_prepend(1::BIGINT, list_transform(range(0, {len(squares)}), lambda k: CASE WHEN (p >> k) & 1 = 1 THEN {squares}[k + 1] ELSE 1 END)), lambda x, y: (x * y) % {prime})"
    return f"CAST(sum(CAST(('0x' || substr(h, {start}, 7))::BIGINT * {power} % {prime} AS HUGEINT)) % {prime} AS BIGINT)"


@query(with_("ord AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS p, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS h FROM orders)")
       + "SELECT count(*) AS n_rows, " + ", ".join(f"{_digest_sql(*m, 1 + 7 * i)} AS hash_{c}" for i, (c, m) in enumerate(zip("ab", canonical.MODULI, strict=True))) + " FROM ord")
def ordered_digest(spark, sf):
    """The digest of the orders in each customer's order of events."""
    return canonical.ordered_digest(table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(with_(ITEMS, LABELS, EVENTS, "due AS (SELECT ev.*, kc FROM ev JOIN labels_ USING (item_id) WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)")
       + "SELECT event_id, learner, kc, row_number() OVER (PARTITION BY learner, kc ORDER BY ts, event_id) AS opportunity FROM due")
def streamed_opportunities(spark, sf):
    """Opportunity numbers of the events as a bounded stream: all that the watermark, an hour behind the last event, has passed."""
    rows = table(spark, sf, "events")
    marked = label_items(items(spark, sf), COMPILER, RULES).select("item_id", "kc_ids")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf}/events.parque[t]")  # a pattern, since a stream of one file path needs a folder
    events = source.select("event_id", F.col("user_id").alias("learner"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") >= 35).cast("int").alias("correct"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("item_id"))
    traced = trace_stream(events.join(marked, "item_id").drop("item_id"))
    path = scratch(spark, "traced")
    running = traced.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "learner", "kc", "opportunity")


# Checks of mappings as text, repeated annotations and private tables

_KEYS = ["item_id", "result", "cells", "note"]


@query(with_(ITEMS) + """SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 11 = 0 THEN 'not an object' END, CASE WHEN item_id % 11 <> 0 AND (size = 'S3' OR brand = 'B2') THEN 'other keys' END,
 CASE WHEN item_id % 11 <> 0 AND brand = 'B2' THEN 'cells are no list' END, CASE WHEN item_id % 11 <> 0 AND brand <> 'B2' AND kind = 'PROMO' THEN 'other dimensions' END, CASE WHEN item_id % 11 <> 0 AND size = 'S4' THEN 'another id' END], lambda x: x IS NOT NULL), ';') AS errors FROM items""")
def mapping_key_checks(spark, sf):
    """Mappings of the parts as text: to_json leaves nulls out, so parts lack keys where a value is null."""
    cell = F.struct(F.col("kind"), F.when(F.col("kind") != "PROMO", F.col("size")).alias("size"))
    whole = F.struct(
        F.when(F.col("size") == "S4", F.lit("0")).otherwise(F.col("item_id").cast("string")).alias("item_id"), F.lit("complete").alias("result"),
        F.when(F.col("brand") != "B2", F.array(cell)).alias("cells"), F.when(F.col("size") != "S3", F.lit("as given")).alias("note"),
    )
    rows = items(spark, sf).withColumn("raw", F.when(F.col("item_id") % 11 == 0, F.to_json(F.array(whole))).otherwise(F.to_json(whole)))
    errors = curation.key_errors("raw", _KEYS, ["kind", "size"], id_key="item_id", expected_id=F.col("item_id"))
    return rows.select("item_id", F.array_join(errors, ";").alias("errors"))


@query(with_("l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'complete' ELSE 'partial' END AS result, 'CELL_' || upper(substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 16)) AS cell FROM lineitem)",
             "p AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS pair, l_linenumber % 2 AS first, CASE WHEN result = 'complete' THEN [cell] ELSE [] END AS cells FROM l)")
       + "SELECT a.l_orderkey, CAST(a.pair AS BIGINT) AS pair, CASE WHEN len(b.cells) > 0 AND a.cells <> b.cells THEN b.cells[1] ELSE '' END AS added, CASE WHEN len(a.cells) > 0 AND a.cells <> b.cells THEN a.cells[1] ELSE '' END AS removed, a.cells <> b.cells AS affects_inventory FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.pair = b.pair AND a.first = 1 AND b.first = 0")
def contribution_changes(spark, sf):
    """Each second line item as a repeated annotation of the one before: returned or accepted lines are only partial."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.array(content_id("CELL", F.col("l_suppkey")))).otherwise(F.array().cast("array<string>")).alias("cells"))
    side = lambda odd, name: lines.where(F.col("l_linenumber") % 2 == odd).select("l_orderkey", F.floor((F.col("l_linenumber") + 1) / 2).alias("pair"), F.col("cells").alias(name))
    out = canonical.contribution_changes(side(1, "primary_cells").join(side(0, "repeat_cells"), ["l_orderkey", "pair"]))
    return out.select("l_orderkey", "pair", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "affects_inventory")


@query(with_("o AS (SELECT o_custkey AS learner, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS event_id, event_id AS seq, l_suppkey AS f, l_linestatus, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
             "a AS (SELECT * FROM o WHERE l_linestatus = 'F' OR l_returnflag = 'N')", "b AS (SELECT learner, event_id, CASE WHEN l_returnflag = 'A' THEN seq + 1 ELSE seq END AS seq, f FROM o WHERE l_returnflag <> 'R')")
       + """SELECT coalesce(a.learner, b.learner) AS learner, count(*) FILTER (a.event_id IS NOT NULL AND b.event_id IS NOT NULL) AS n_matched, count(*) FILTER (b.event_id IS NULL) AS observed_only, count(*) FILTER (a.event_id IS NULL) AS private_only,
 count(*) FILTER (a.seq <> b.seq) AS moved, count(*) FILTER (a.f <> b.f) AS other_features, count(*) FILTER (a.event_id IS NULL OR b.event_id IS NULL OR a.seq <> b.seq OR a.f <> b.f) = 0 AS aligned FROM a FULL JOIN b ON a.learner = b.learner AND a.event_id = b.event_id GROUP BY 1""")
def private_alignment(spark, sf):
    """Line items as observed events against a private table that lacks the returned ones and has the accepted ones a place later."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy(*LINE_ORDER)
    every = joined.select(F.col("o_custkey").alias("learner"), F.row_number().over(order).alias("event_id"), F.row_number().over(order).alias("seq"), F.col("l_suppkey").alias("features"), "l_linestatus", "l_returnflag")
    private = every.where("l_returnflag <> 'R'").withColumn("seq", F.when(F.col("l_returnflag") == "A", F.col("seq") + 1).otherwise(F.col("seq")))
    return canonical.private_alignment(every.where("l_linestatus = 'F' or l_returnflag = 'N'"), private, features="features")
