"""Catalog, fact and trace queries on the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import dedup, joins, sequences
from tabulon.plans.registry import plan


@plan("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND year(o_orderdate) IN (1997, 1998) AND o_orderpriority = '1-URGENT'")
def flt1_catalog_filter(t):
    """Null parameters filter nothing: here there is no lower bound of the price."""
    given = {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT"], "o_totalprice": None}
    rows = t.orders.where(F.col("o_orderdate").between("1997-01-01", "1998-12-31"))
    for column, values in given.items():
        rows = rows if values is None else rows.where(F.col(column).isin(values))
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@plan("SELECT count(*) AS n, coalesce(sum(o_totalprice > 400000)::BIGINT, 0) AS dear FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false) AND coalesce(o_custkey % 10 <> 0, true)")
def flt2_active(t):
    rows = t.orders.where(~F.coalesce(F.col("o_orderstatus") == "P", F.lit(False)) & F.coalesce(F.col("o_custkey") % 10 != 0, F.lit(True)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("dear"))


TYPES = {"ECONOMY": "annual", "PROMO": "quarterly", "SMALL": "event"}


@plan("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'annual' WHEN 'PROMO' THEN 'quarterly' WHEN 'SMALL' THEN 'event' ELSE 'other' END AS document_type FROM part")
def flt3_document_type(t):
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(known, F.col("p_type")), F.lit("other")).alias("document_type"))


@plan("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1900 END, year(o_orderdate) - 1)::INT AS fiscal_year, CASE WHEN o_orderpriority = '1-URGENT' THEN 'FY' WHEN o_orderstatus = 'P' THEN NULL ELSE 'Q' || quarter(o_orderdate) END AS fiscal_period FROM orders")
def flt4_fiscal_fields(t):
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    found = F.coalesce(F.when(key % 3 != 0, year), F.when(key % 2 != 0, F.lit(1900)), year - 1)
    period = F.when(F.col("o_orderpriority") == "1-URGENT", "FY").when(F.col("o_orderstatus") != "P", F.concat(F.lit("Q"), F.quarter("o_orderdate")))
    return t.orders.select("o_orderkey", found.alias("fiscal_year"), period.alias("fiscal_period"))


@plan("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 50000 AND 51000 AND l_discount >= 0.05")
def flt6_numeric_range(t):
    return t.lineitem.where(F.col("l_extendedprice").between(50000, 51000) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@plan("SELECT p_partkey, lower(list_extract(string_split('us-gaap:' || replace(p_name, ' ', '_'), '_'), -1)) AS local FROM part WHERE lower(list_extract(string_split('us-gaap:' || replace(p_name, ' ', '_'), '_'), -1)) = 'ring'")
def flt7_concept_local_name(t):
    concept = F.concat(F.lit("us-gaap:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select("p_partkey", C.local_name(concept).alias("local")).where("local = 'ring'")


@plan("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) LIKE '%.example.com' AS included FROM pages")
def flt11_url_safety(t):
    host = F.parse_url("url", F.lit("HOST"))
    return t.pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), host.endswith(".example.com").alias("included"))


@plan("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '%SPECIFIED' THEN 'layout' WHEN o_totalprice > 300000 THEN 'financial' ELSE 'data' END AS table_type FROM orders")
def flt14_table_type(t):
    kind = F.when(F.col("o_orderpriority").endswith("SPECIFIED"), "layout").when(F.col("o_totalprice") > 300000, "financial").otherwise("data")
    return t.orders.select("o_orderkey", "o_orderpriority", kind.alias("table_type"))


@plan("SELECT o_orderkey, n_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join1_company(t):
    """Spark broadcasts a side by its own size estimate; no hint is given, since customers grow with the data."""
    found = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return found.select("o_orderkey", "n_name", "c_mktsegment")


@plan("SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, coalesce(returned, false) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def join2_capabilities(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    found = t.orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return found.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("returned", F.lit(False)).alias("returned"))


@plan("SELECT alias, min(n_nationkey) AS nation FROM (SELECT lower(n_name) AS alias, n_nationkey FROM nation UNION ALL SELECT lower(replace(n_name, '_', '')), n_nationkey FROM nation UNION ALL SELECT lower(r_name), n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY alias")
def join3_alias_index(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = F.array(F.lower("n_name"), F.lower(F.replace("n_name", F.lit("_"), F.lit(""))), F.lower("r_name"))
    return named.select("n_nationkey", F.explode(aliases).alias("alias")).groupBy("alias").agg(F.min("n_nationkey").alias("nation"))


@plan("SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join5_ancestors(t):
    found = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return found.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


@plan("""WITH b AS (SELECT 0 AS ref, 0.0 AS low, 600000.0 AS high, 1 AS level UNION ALL SELECT i + 1, i * 50000.0, i * 50000.0 + 30000.0, 2 FROM range(0, 12) t(i) UNION ALL SELECT i + 101, i * 50000.0 + 10000.0, i * 50000.0 + 15000.0, 3 FROM range(0, 12) t(i))
SELECT o_orderkey, arg_max(ref, level)::BIGINT AS deepest FROM orders JOIN b ON o_totalprice BETWEEN low AND high GROUP BY o_orderkey""")
def join7_interval_deepest(t):
    bands = t.spark.range(12).select(F.explode(F.array(F.struct(F.col("id") + 1, F.col("id") * 50000.0, F.col("id") * 50000.0 + 30000.0, F.lit(2)), F.struct(F.col("id") + 101, F.col("id") * 50000.0 + 10000.0, F.col("id") * 50000.0 + 15000.0, F.lit(3)))).alias("b"))
    bands = bands.select(*[F.col(f"b.col{i + 1}").alias(c) for i, c in enumerate(("ref", "low", "high", "level"))])
    bands = bands.unionByName(t.spark.range(1).select(F.lit(0).cast("long").alias("ref"), F.lit(0.0).alias("low"), F.lit(600000.0).alias("high"), F.lit(1).alias("level")))
    found = joins.interval_join(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "low", "high", 50000.0)
    return dedup.best_value(found, ["o_orderkey"], F.col("ref"), F.col("level"), "deepest")


@plan("""SELECT e.event_id, p.value AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join8_asof(t):
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return joins.asof(errors, bought, "user_id", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@plan("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def join11_text_containment(t):
    phrases = t.benchmark.select("item_id", F.col("text").alias("phrase"))
    return joins.containing(t.documents.select("doc_id", "text"), "text", phrases, "phrase", "doc_id").select("doc_id", "item_id").distinct()


@plan("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' ELSE 'same' END AS state
FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def join13_snapshot_diff(t):
    old = t.orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_totalprice").alias("old"), F.lit(1).alias("in_old"))
    new = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("new"), F.lit(1).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(joins.differs(F.col("old"), F.col("new")), "changed").otherwise("same")
    return old.join(new, "o_orderkey", "full").select("o_orderkey", state.alias("state"))


@plan("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def join14_gaps(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@plan("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join16_semi_anti(t):
    open_, urgent = t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderpriority = '1-URGENT'")
    key = lambda o: o.select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(key(open_), "c_custkey", "left_semi").join(key(urgent), "c_custkey", "left_anti")


@plan("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views, coalesce(clicks, 0) <> coalesce(views, 0) AS mismatch FROM (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id")
def join17_count_mismatch(t):
    """Both sides come from one reading: conditional counts instead of a full join."""
    counted = t.events.where("event_type IN ('click', 'view')").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    return counted.withColumn("mismatch", F.col("clicks") != F.col("views"))


@plan("SELECT doc_id, coalesce(quality, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END)::INT AS verdict, quality IS NOT NULL AS confirmed FROM documents LEFT JOIN labels USING (doc_id)")
def join19_override(t):
    claims = t.documents.select("doc_id", F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("claim"))
    found = claims.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("quality", "claim").alias("verdict"), F.col("quality").isNotNull().alias("confirmed"))


@plan("""WITH r AS (SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, '0') AS subject, CASE WHEN o_orderkey % 4 = 0 THEN '00' || o_custkey ELSE (o_custkey + 1)::VARCHAR END AS filed_by FROM orders)
SELECT o_orderkey, c_custkey FROM r JOIN customer ON subject::BIGINT = c_custkey AND filed_by::BIGINT <> c_custkey WHERE c_acctbal > 5000 AND c_custkey > 0""")
def join20_direction(t):
    """Filings about a watched company that the company hasn't filed itself; numbers are padded in different ways."""
    number = F.col("o_custkey").cast("string")
    filer = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("00"), number)).otherwise((F.col("o_custkey") + 1).cast("string"))
    roles = t.orders.select("o_orderkey", F.lpad(number, 10, "0").alias("subject"), filer.alias("filed_by"))
    watched = t.customer.where("c_acctbal > 5000 AND c_custkey > 0").select("c_custkey", F.concat(F.lit("CIK-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("cik"))
    return joins.directed(roles, watched, "cik").select("o_orderkey", "c_custkey")


@plan("SELECT coalesce(nullif(trim(event_type), ''), '<empty>') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k")
def agg1_count_by_key(t):
    return t.events.groupBy(F.coalesce(C.blank_to_null(F.col("event_type")), F.lit("<empty>")).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k")


@plan("SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount = 0) AS undiscounted, count(*) FILTER (l_quantity >= 40 AND l_tax = 0) AS large_untaxed FROM lineitem")
def agg2_batch_summary(t):
    flags = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "undiscounted": "l_discount = 0", "large_untaxed": "l_quantity >= 40 AND l_tax = 0"}
    return t.lineitem.agg(F.count("*").alias("n"), *[F.count_if(F.expr(x)).alias(k) for k, x in flags.items()])


@plan("""SELECT event_type, count(*) AS calls, round(avg((value > 5)::INT), 6) AS success_rate, round(median(value), 6) AS median_value, list_sort(list(value))[ceil((count(*) - 1) * 0.9)::INT + 1] AS p90_value,
(SELECT string_agg(k || ':' || n, ', ' ORDER BY n DESC, k) FROM (SELECT props AS k, count(*) AS n FROM events e WHERE e.event_type = o.event_type GROUP BY 1 ORDER BY n DESC, k LIMIT 3)) AS top_props FROM events o GROUP BY event_type""")
def agg3_tool_stats(t):
    counted = t.events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    stats = counted.groupBy("event_type").agg(F.sum("n").alias("calls"), F.round(F.sum(F.when(F.col("value") > 5, F.col("n")).otherwise(0)) / F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), 6).alias("success_rate"))
    for p, name in ((0.9, "p90_value"),):
        stats = stats.join(sequences.value_at(counted.where("value IS NOT NULL"), ["event_type"], "value", "n", lambda n, p=p: F.ceil((n - 1) * p) + 1, name), "event_type", "left")
    middle = [sequences.value_at(counted.where("value IS NOT NULL"), ["event_type"], "value", "n", lambda n, k=k: F.floor((n + k) / 2), name) for k, name in ((1, "low"), (2, "high"))]
    stats = stats.join(middle[0].join(middle[1], "event_type").select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_value")), "event_type", "left")
    counts = t.events.groupBy("event_type", F.col("props").alias("k")).agg(F.count("*").alias("n"))
    top = dedup.keep_best(counts, ["event_type"], [F.desc("n"), F.asc("k")], 3).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k"))).alias("top"))
    text = F.array_join(F.transform("top", lambda x: F.concat(x["k"], F.lit(":"), -x["m"])), ", ")
    return stats.join(top, "event_type").select(*stats.columns, text.alias("top_props"))


@plan("SELECT source, round(quantile_cont(n_chars, 0.1), 6) AS p10 FROM documents GROUP BY source")
def agg5_p10_linear(t):
    return t.documents.groupBy("source").agg(F.round(F.percentile("n_chars", 0.1), 6).alias("p10"))


@plan("SELECT doc_id FROM documents, (SELECT greatest(quantile_disc(n_chars, 0.9), 2 * quantile_disc(n_chars, 0.5)) AS x FROM documents WHERE n_chars > 0) WHERE n_chars > x")
def agg6_adaptive_threshold(t):
    counted = t.documents.where("n_chars > 0").groupBy("n_chars").agg(F.count("*").alias("n"))
    limits = sequences.value_at(counted, [], "n_chars", "n", lambda n: F.ceil(n * 0.9), "p90").crossJoin(sequences.value_at(counted, [], "n_chars", "n", lambda n: F.ceil(n * 0.5), "p50"))
    limits = limits.select(F.greatest("p90", 2 * F.col("p50")).alias("x"))  # one row
    return t.documents.join(F.broadcast(limits), F.col("n_chars") > F.col("x")).select("doc_id")


@plan("SELECT user_id, event_type, props, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def agg8_duplicate_calls(t):
    grouped = t.events.groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids")).where("n > 1")
    return grouped.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@plan("""WITH g AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL HAVING count(*) > 1)
SELECT event_id, first_id, n FROM events e JOIN g ON e.user_id = g.user_id AND e.event_type = g.event_type AND json_extract_string(e.props, '$.k') = g.k""")
def agg8_duplicate_links(t):
    """Every call that another one repeats, with the first of them; arguments are compared in canonical form. A row for
    each call, so that a signature may have any number of them."""
    keyed = t.events.select("event_id", "user_id", "event_type", C.canonical_json(F.col("props")).alias("args"))
    groups = keyed.groupBy("user_id", "event_type", "args").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n > 1")
    return keyed.join(groups, ["user_id", "event_type", "args"]).select("event_id", "first_id", "n")


@plan("SELECT user_id, (json_extract_string(props, '$.k')::INT) % 10 AS signature, count(*) AS n, arg_min(event_id, ts) AS sample FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def agg9_failure_patterns(t):
    signature = F.get_json_object("props", "$.k").cast("int") % 10
    return t.events.where("event_type = 'error'").groupBy("user_id", signature.alias("signature")).agg(F.count("*").alias("n"), F.min_by("event_id", "ts").alias("sample"))


@plan("SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, arg_min(value, ts) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id")
def agg10_runs(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase"))


@plan("SELECT p AS o_orderpriority, least_n AS expected, coalesce(n, 0) AS n, coalesce(n, 0) < least_n AS warned FROM (VALUES ('1-URGENT', 3000), ('2-HIGH', 1), ('9-NONE', 2)) e(p, least_n) LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) ON o_orderpriority = p")
def agg13_expected_counts(t):
    expected = t.spark.sql("SELECT * FROM VALUES ('1-URGENT', 3000), ('2-HIGH', 1), ('9-NONE', 2) AS e(o_orderpriority, expected)")
    counted = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return expected.join(counted, "o_orderpriority", "left").select("o_orderpriority", "expected", n.alias("n"), (n < F.col("expected")).alias("warned"))


@plan("SELECT o_custkey, year(o_orderdate)::INT AS y, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def agg14_period_best(t):
    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    return dedup.keep_best(rows, ["o_custkey", "y"], [F.asc("o_orderpriority"), F.asc("o_orderkey")]).select("o_custkey", "y", "o_orderkey")


@plan("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'signup') WHERE r = 1 UNION ALL SELECT event_id FROM events WHERE event_type <> 'signup'")
def agg15_latest_per_filer(t):
    latest = dedup.keep_best(t.events.where("event_type = 'signup'"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return latest.select("event_id").unionByName(t.events.where("event_type <> 'signup'").select("event_id"))


@plan("""SELECT l_partkey, arg_max(l_extendedprice, {'a': l_returnflag = 'R', 'b': l_discount, 'c': -l_orderkey, 'd': -l_linenumber}) AS price, min(l_orderkey * 10 + l_linenumber) AS first_seen
FROM lineitem GROUP BY l_partkey""")
def agg17_fact_dedup(t):
    score = F.struct((F.col("l_returnflag") == "R").alias("a"), F.col("l_discount"), -F.col("l_orderkey"), -F.col("l_linenumber"))
    return t.lineitem.groupBy("l_partkey").agg(F.max_by("l_extendedprice", score).alias("price"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))


@plan("SELECT c_nationkey, c_mktsegment AS segment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def agg19_mode(t):
    return dedup.mode(t.customer, ["c_nationkey"], "c_mktsegment", "segment")


@plan("""SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) FILTER (o_orderstatus = 'F') AS finished, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) FILTER (o_orderstatus = 'O') AS opened,
coalesce(arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) FILTER (o_orderpriority = '1-URGENT'), arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey})) AS overview FROM orders GROUP BY o_custkey""")
def agg23_recommended_slots(t):
    latest = lambda when: F.max(F.when(when, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"]
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(latest(status == "F").alias("finished"), latest(status == "O").alias("opened"), F.coalesce(latest(F.col("o_orderpriority") == "1-URGENT"), latest(F.lit(True))).alias("overview"))


@plan("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg24_available_types(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@plan("SELECT o_orderstatus, count(*) FILTER (year(o_orderdate) < 1998) AS before, count(*) FILTER (year(o_orderdate) = 1998) AS in_1998, count(*) FILTER (year(o_orderdate) > 1998) AS after FROM orders GROUP BY 1")
def agg26_status_pivot(t):
    when = F.when(F.year("o_orderdate") < 1998, "before").when(F.year("o_orderdate") == 1998, "in_1998").otherwise("after")
    return t.orders.withColumn("w", when).groupBy("o_orderstatus").pivot("w", ["before", "in_1998", "after"]).count().na.fill(0)


@plan("SELECT CASE WHEN grouping(lang) = 1 THEN '<all>' ELSE lang END AS lang, count(*) AS n, round(avg(quality), 6) AS quality, round(quantile_cont(n_chars, 0.1), 6) AS p10 FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def agg27_rollup(t):
    both = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    rolled = both.rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.percentile("n_chars", 0.1), 6).alias("p10"))
    return rolled.select(F.when(F.col("g") == 1, "<all>").otherwise(F.col("lang")).alias("lang"), "n", "quality", "p10")


@plan("SELECT l_orderkey, (l_linenumber - 1) // 3 AS batch, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def agg30_batches(t):
    grouped = t.lineitem.groupBy("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return grouped.select("l_orderkey", "batch", F.array_join(F.transform("x", lambda s: s["l_partkey"].cast("string")), ",").alias("parts"))


@plan("SELECT source, sum(n_chars)::BIGINT AS total, arg_max(doc_id, {'n': n_chars, 'd': -doc_id}) AS longest FROM documents GROUP BY source")
def agg31_lengths(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("total"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))


@plan("SELECT conv_id, string_agg(role || ':' || n, ', ' ORDER BY n DESC, role) AS mix FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def agg32_message_mix(t):
    counts = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "role"))).alias("x"))
    return counts.select("conv_id", F.array_join(F.transform("x", lambda s: F.concat(s["role"], F.lit(":"), -s["m"])), ", ").alias("mix"))


@plan("SELECT l_orderkey, sha256(string_agg(l_partkey || '|' || l_suppkey || '|' || l_linenumber, ';' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def agg34_fingerprint(t):
    files = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("f"))
    return files.select("l_orderkey", F.sha2(F.array_join(F.transform("f", lambda s: F.concat_ws("|", s["l_partkey"], s["l_suppkey"], s["l_linenumber"])), ";"), 256).alias("fingerprint"))


@plan("""WITH x AS (SELECT user_id, event_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT event_id, coalesce(following = 'purchase', false) AS converted FROM x WHERE event_type = 'signup'""")
def win1_gap_detection(t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.where("event_type IN ('signup', 'purchase')").withColumn("following", F.lead("event_type").over(order))
    return rows.where("event_type = 'signup'").select("event_id", F.coalesce(F.col("following") == "purchase", F.lit(False)).alias("converted"))


@plan("SELECT event_id, coalesce(f = 'click', false) AS followed FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE event_type = 'view'")
def win2_immediate_follow(t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("f", F.lead("event_type").over(order)).where("event_type = 'view'").select("event_id", F.coalesce(F.col("f") == "click", F.lit(False)).alias("followed"))


@plan("""WITH n AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
i AS (SELECT user_id, r, r - row_number() OVER (PARTITION BY user_id ORDER BY r) AS g FROM n WHERE event_type = 'error')
SELECT user_id, min(r) AS streak_start, count(*) AS streak_len FROM i GROUP BY user_id, g HAVING count(*) >= 2""")
def win3_streaks(t):
    return sequences.streaks(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@plan("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
FROM (SELECT conv_id, turn, greatest(1, ceil(length(text) / 2))::BIGINT AS cost FROM conversations)) WHERE r = 1 OR (spent <= 300 AND r <= 4)""")
def win4_memory_budget(t):
    costed = t.conversations.withColumn("cost", C.token_units(F.col("text")))
    return sequences.newest_within(costed, "conv_id", "turn", "cost", 300, 4).select("conv_id", "turn")


@plan("""WITH RECURSIVE s AS (SELECT source, list_sort(list(n_chars)) AS a FROM documents GROUP BY source),
f AS (SELECT source, a, 0 AS i, 100000::BIGINT AS rest, 0::BIGINT AS given, 0::BIGINT AS capped FROM s
UNION ALL SELECT source, a, i + 1, greatest(0, rest - least(a[i + 1], greatest(400, rest // (len(a) - i)))), given + least(a[i + 1], greatest(400, rest // (len(a) - i))), capped + (a[i + 1] > greatest(400, rest // (len(a) - i)))::BIGINT FROM f WHERE i < len(a))
SELECT source, given, capped FROM f WHERE i = len(a)""")
def win6_fair_share(t):
    return sequences.water_fill(t.documents, ["source"], "n_chars", 100_000, 400)


@plan("""WITH RECURSIVE s AS (SELECT source, list_sort(list(n_chars)) AS a FROM documents GROUP BY source),
f AS (SELECT source, a, 0 AS i, 600000::BIGINT AS rest, 0::BIGINT AS given, 0::BIGINT AS capped FROM s
UNION ALL SELECT source, a, i + 1, greatest(0, rest - least(a[i + 1], greatest(4000, rest // (len(a) - i)))), given + least(a[i + 1], greatest(4000, rest // (len(a) - i))), capped + (a[i + 1] > greatest(4000, rest // (len(a) - i)))::BIGINT FROM f WHERE i < len(a))
SELECT source, given, capped FROM f WHERE i = len(a)""")
def win6_tool_budgets(t):
    """With the least share of the tool results' budget."""
    return sequences.water_fill(t.documents, ["source"], "n_chars", 600_000, 4_000)


@plan("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS y FROM orders) WHERE r <= 6 AND year(o_orderdate) = y")
def win12_newest_year(t):
    newest = dedup.keep_best(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 6)
    year = F.max(F.year("o_orderdate")).over(Window.partitionBy("o_custkey"))
    return newest.withColumn("y", year).where(F.year("o_orderdate") == F.col("y")).select("o_custkey", "o_orderkey")


@plan("SELECT l_orderkey, bool_and(coalesce(l_partkey >= b, true)) AS in_order FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) GROUP BY l_orderkey")
def win13_monotonic(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.withColumn("b", F.lag("l_partkey").over(order))
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.col("l_partkey") >= F.col("b"), F.lit(True))).alias("in_order"))


@plan("""WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS seen, ts FROM events),
g AS (SELECT *, sum((NOT seen)::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT event_id, sum(seen::INT) OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS no_gain FROM g""")
def win14_duplicate_guard(t):
    order = [F.col("ts"), F.col("event_id")]
    seen = (F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy(*order)) > 1).cast("long")
    past = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = t.events.withColumn("seen", seen).withColumn("run", F.sum(1 - F.col("seen")).over(past("user_id", "event_type")))
    return rows.select("event_id", F.sum("seen").over(past("user_id", "event_type", "run")).alias("no_gain"))


@plan("SELECT o_orderkey, 1 + sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM (SELECT *, (coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <> o_orderstatus, false))::INT AS c FROM orders)")
def win15_versions(t):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    changed = F.coalesce(F.lag("o_orderstatus").over(order) != F.col("o_orderstatus"), F.lit(False)).cast("long")
    return t.orders.withColumn("c", changed).select("o_orderkey", (1 + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("version"))


@plan("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn, text)) AS assembled FROM conversations GROUP BY conv_id")
def win16_assembly(t):
    parts = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("assembled"))


@plan("SELECT o_orderkey FROM orders ORDER BY (o_orderstatus <> 'P')::INT DESC, o_orderdate DESC NULLS LAST, year(o_orderdate) DESC, o_orderpriority DESC, o_orderkey DESC LIMIT 300")
def sort1_recency(t):
    """The limit is the feature: a page of the catalog."""
    return t.orders.orderBy(F.desc(F.col("o_orderstatus") != "P"), F.desc_nulls_last("o_orderdate"), F.desc(F.year("o_orderdate")), F.desc("o_orderpriority"), F.desc("o_orderkey")).limit(300).select("o_orderkey")


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 5000) ORDER BY o_custkey, o_orderkey LIMIT 50")
def lim2_keyset_page(t):
    after = (F.col("o_custkey") > 100) | ((F.col("o_custkey") == 100) & (F.col("o_orderkey") > 5000))
    return sequences.page(t.orders.select("o_orderkey", "o_custkey"), [F.asc("o_custkey"), F.asc("o_orderkey")], after, 50)


@plan("SELECT doc_id, substr(text, 1, 100) AS head, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS two_lines, n_chars > 100 AS cut FROM documents")
def lim1_truncation(t):
    return t.documents.select("doc_id", F.substring("text", 1, 100).alias("head"), F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n").alias("two_lines"), (F.col("n_chars") > 100).alias("cut"))


@plan("SELECT c_custkey AS id, 'filing' AS kind FROM customer UNION ALL SELECT s_suppkey, 'material' FROM supplier")
def set1_union(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lit("filing").alias("kind")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("material").alias("kind")))


@plan("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def set3_except(t):
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")))


@plan("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def set4_intersect(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_totalprice > 450000").select("o_custkey"))


@plan("""SELECT o_orderkey, coalesce(u.price, o.o_totalprice) AS price, u.price IS NOT NULL AS updated FROM orders o LEFT JOIN (SELECT o_orderkey AS k, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 9 = 0) u ON k = o_orderkey
UNION ALL SELECT -o_orderkey, o_totalprice, true FROM orders WHERE o_orderkey % 500 = 1""")
def snk1_upsert(t):
    changes = t.orders.where("o_orderkey % 9 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("new"))
    changes = changes.unionByName(t.orders.where("o_orderkey % 500 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.col("o_totalprice").alias("new")))
    merged = t.orders.select("o_orderkey", "o_totalprice").join(changes, "o_orderkey", "full")
    return merged.select("o_orderkey", F.coalesce("new", "o_totalprice").alias("price"), F.col("new").isNotNull().alias("updated"))


@plan("SELECT o_orderkey, CASE WHEN b.v IS NULL THEN 'new' WHEN b.v = a.v AND b.f = a.f THEN 'skip' ELSE 'again' END AS action FROM (SELECT o_orderkey, o_orderkey % 4 AS v, o_custkey AS f FROM orders) a LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 2 AS v, o_custkey AS f FROM orders WHERE o_orderkey % 3 <> 0) b ON k = o_orderkey")
def ing5_process_skip(t):
    now = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("v"), F.col("o_custkey").alias("f"))
    done = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 2).alias("dv"), F.col("o_custkey").alias("df"))
    action = F.when(F.col("dv").isNull(), "new").when((F.col("dv") == F.col("v")) & (F.col("df") == F.col("f")), "skip").otherwise("again")
    return now.join(done, "o_orderkey", "left").select("o_orderkey", action.alias("action"))


@plan("SELECT k, form, day FROM (SELECT k, unnest(forms) AS form, unnest(days) AS day FROM (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS forms, list(o_orderdate ORDER BY o_orderkey) AS days FROM orders GROUP BY 1)) WHERE day >= '1998-01-01'")
def ing1_arrays_to_rows(t):
    """Submissions come as parallel arrays: zipped to rows, then filtered by their window."""
    arrays = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderdate"))).alias("x"))
    arrays = arrays.select("k", F.transform("x", lambda s: s["o_orderpriority"]).alias("form"), F.transform("x", lambda s: s["o_orderdate"]).alias("day"))
    return arrays.select("k", F.inline(F.arrays_zip("form", "day"))).where("day >= '1998-01-01'")


@plan("SELECT l_partkey, round(sum(l_extendedprice) FILTER (year(l_shipdate) = 1997), 2) AS fy1997, round(sum(l_extendedprice) FILTER (year(l_shipdate) = 1998), 2) AS fy1998 FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY l_partkey")
def api8_statement(t):
    facts = t.lineitem.where(F.col("l_shipdate").between("1997-01-01", "1998-12-31")).withColumn("y", F.concat(F.lit("fy"), F.year("l_shipdate")))
    wide = facts.groupBy("l_partkey").pivot("y", ["fy1997", "fy1998"]).agg(F.sum("l_extendedprice"))
    return wide.select("l_partkey", F.round("fy1997", 2).alias("fy1997"), F.round("fy1998", 2).alias("fy1998"))


@plan("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm1_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


@plan("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INT AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s""")
def stm5_sessions(t):
    found = t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("began"), "n")


@plan("SELECT event_type, count(*) AS used, 2000 AS capacity, count(*) >= 2000 AS full FROM events GROUP BY 1")
def sql6_permits(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("used")).withColumn("capacity", F.lit(2000)).withColumn("full", F.col("used") >= 2000)
