"""Ingest governance, guarded state tables, uploads, reading calls and small rules of text, numbers and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import dedup, governance
from tabulon.plans.registry import plan

#: Names that a statement is asked for by.
STATEMENT_NAMES = {"income": "IncomeStatement", "incomestatement": "IncomeStatement", "balancesheet": "BalanceSheet", "cashflow": "CashFlowStatement", "cashflowstatement": "CashFlowStatement"}
#: Materials by the first pattern that a file's name holds, and ranks of main reports.
MATERIALS = (("FINANCIAL_STATEMENTS", r"(?i)财务报表"), ("EARNINGS_CALL", r"(?i)电话会议|(?:财报|业绩|业绩会|业绩说明会|业绩发布会).{0,8}会议纪要|Earnings.{0,5}Call|Transcript|Conference.{0,5}Call"), ("EARNINGS_PRESENTATION", r"(?i)演示|Slide|Presentation|Investor.{0,10}Day|Deck"))
REPORT_RANKS = ((5, r"(?i)演示|Slide|Presentation|Deck|新闻|News|简报|摘要|Summary"), (0, r"(?i)年度报告|中期报告|Annual.{0,5}Report|Interim.{0,5}Report|半年.{0,3}报告|年报|中报"), (1, r"(?i)季报|季度.{0,5}报告|Quarterly.{0,5}Report"), (2, r"(?i)报告"), (3, r"(?i)公告|通告|Announcement"))
FILE_NAMES = ["2024 Annual Report.pdf", "Q3 Transcript.html", "Investor Day 2023.pdf", "2023年报.pdf", "业绩公告.pdf", "Quarterly Report Q1.pdf", "press Summary.txt", "财务报表.xlsx", "notes"]


def orders_files(t, changed: bool):
    """Lines of orders as files of a document: with an etag, a date, a size, some of them missing; some changed."""
    n = F.col("l_linenumber")
    bump = F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0) if changed else F.lit(0)
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    if changed:
        rows = rows.where(~((F.col("l_orderkey") % 11 == 3) & (n == 1)))
    return rows.select("l_orderkey", F.concat(F.lit("f"), n.cast("string")).alias("name"), F.when(n % 3 == 0, (F.col("p") + bump).cast("string")).alias("etag"), F.when(n % 3 == 1, (F.col("p") % 28 + bump).cast("string")).alias("modified"), F.when(n % 4 != 2, F.col("p") * 10 + bump).alias("size"))


@plan("""WITH a AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS b FROM a WHERE NOT (l_orderkey % 11 = 3 AND n = 1))
SELECT coalesce(a.l_orderkey, r.l_orderkey) AS l_orderkey, bool_and(r.p IS NOT NULL AND CASE WHEN a.n % 3 = 2 AND a.n % 4 = 2 THEN true ELSE b = 0 END) AS equivalent FROM a FULL JOIN r ON a.l_orderkey = r.l_orderkey AND a.n = r.n GROUP BY 1""")
def join13_file_equivalence(t):
    """Names first, then etag, date and size in this order."""
    return governance.equivalent(orders_files(t, True), orders_files(t, False), ["l_orderkey"])


@plan("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'source_fingerprint_matched' WHEN o_orderkey % 5 = 0 THEN 'remote_files_equivalent' END END AS reason FROM orders""")
def ing4_skip_reason(t):
    n = F.col("o_orderkey")
    return t.orders.select("o_orderkey", governance.skip_reason(n % 7 != 0, F.when(n % 3 != 0, "v2").otherwise("v1"), "v2", F.when(n % 2 == 0, n.cast("string")).otherwise(""), n.cast("string"), n % 5 == 0).alias("reason"))


@plan("""WITH p AS (SELECT o_orderkey, o_orderkey % 2 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS c, NULL AS d, o_orderstatus AS e, o_orderpriority AS f FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o.o_orderkey FROM orders o LEFT JOIN p USING (o_orderkey) WHERE p.o_orderkey IS NULL OR NOT (a = 1 AND b = 1 AND c = o.o_orderkey % 5 AND e = o.o_orderstatus AND f = o.o_orderpriority)""")
def ing5_work_list(t):
    """What must be processed again: six values of the last time, against what they would be now."""
    six = ["schema_version", "rules_version", "source_version", "parser", "fingerprint", "form"]
    n = F.col("o_orderkey")
    now = t.orders.select("o_orderkey", F.lit(1).cast("long").alias("schema_version"), F.lit(1).cast("long").alias("rules_version"), (n % 5).alias("source_version"), F.lit(None).cast("string").alias("parser"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("form"))
    then = t.orders.where("o_orderkey % 13 <> 0").select("o_orderkey", (n % 2).alias("schema_version"), (n % 3).alias("rules_version"), (n % 5).alias("source_version"), F.lit(None).cast("string").alias("parser"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("form"))
    done = now.alias("a").join(then.alias("b"), "o_orderkey").where(governance.unchanged("a", "b", six)).select("o_orderkey")
    return now.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@plan("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 8 = 0)")
def join15_unrejected(t):
    """The registry has rejections of an older version of the rules too; these count no longer."""
    registry = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "v2").otherwise("v1").alias("download_version"))
    return governance.unrejected(t.orders.select("o_orderkey"), registry, "o_orderkey", "v2")


@plan("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'too_old' WHEN 1 THEN 'no_match' ELSE 'too_old' END AS reason, o_orderpriority AS form_type FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'no_match', o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0""")
def ing6_rejections(t):
    """The registry after new rejections: the last one of a document holds."""
    old = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 2, "blank").otherwise("too_old").alias("reason"), F.col("o_orderpriority").alias("form_type"))
    new = t.orders.where("(o_orderstatus = 'P' AND o_orderkey % 3 > 0) OR (o_orderstatus = 'F' AND o_orderkey % 10 = 0)").select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 2), "too_old").otherwise("no_match").alias("reason"), F.col("o_orderpriority").alias("form_type"))
    return governance.upsert(old, new, ["o_orderkey"], ["reason", "form_type"])


@plan("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS fingerprint, o_orderkey % 4 = 0 AS reprocess FROM orders")
def ing7_source_upsert(t):
    """New fingerprints take the old ones' place, and a document whose fingerprint has changed must be processed again."""
    old = t.orders.select("o_orderkey", F.col("o_totalprice").alias("fingerprint"))
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("fingerprint"))
    changed = new.join(old.withColumnRenamed("fingerprint", "before"), "o_orderkey").select("o_orderkey", (F.col("fingerprint") != F.col("before")).alias("reprocess"))
    return governance.upsert(old, new, ["o_orderkey"], ["fingerprint"]).join(changed, "o_orderkey", "left").withColumn("reprocess", F.coalesce("reprocess", F.lit(False)))


@plan("""SELECT o_orderkey, o_orderstatus = 'P' AS was_rejected, o_totalprice > 200000 AS wanted, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'rescue' WHEN o_orderstatus <> 'P' AND o_totalprice <= 200000 THEN 'retire' END AS move
FROM orders WHERE (o_orderstatus = 'P') = (o_totalprice > 200000)""")
def ing10_triage(t):
    """Documents that the rules of today would decide the other way about: to be rescued, or retired. Nothing is moved."""
    rejected, wanted = F.col("o_orderstatus") == "P", F.col("o_totalprice") > 200_000
    rows = t.orders.select("o_orderkey", rejected.alias("was_rejected"), wanted.alias("wanted"))
    return rows.where("was_rejected = wanted").withColumn("move", F.when(F.col("was_rejected"), "rescue").otherwise("retire"))


@plan("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_custkey, n, CASE WHEN o_custkey IN (SELECT * FROM a) THEN 'false_negative' ELSE 'lost' END AS verdict FROM r""")
def ing12_rule_diagnostics(t):
    """Companies with rejected documents: with active ones beside them, or with none left."""
    live = t.orders.where("o_orderstatus = 'O'").select("o_custkey").distinct()
    rejected = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    beside = rejected.join(live, "o_custkey", "left_semi").withColumn("verdict", F.lit("false_negative"))
    return beside.unionByName(rejected.join(live, "o_custkey", "left_anti").withColumn("verdict", F.lit("lost")))


@plan("SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'partial' WHEN p_size > 25 THEN 'full' WHEN p_size > 10 THEN 'partial' ELSE 'fallback' END AS quality FROM part")
def ing13_quality_label(t):
    """A proxy statement is never more than partial; structured facts make a document full, found statements partial."""
    proxy, facts, capable = F.col("p_brand") == "Brand#5", F.col("p_size") > 25, F.col("p_size") > 10
    return t.part.select("p_partkey", F.when(proxy, "partial").when(facts, "full").when(capable, "partial").otherwise("fallback").alias("quality"))


RUNS_SQL = "r AS (SELECT event_id, user_id AS owner, ['created', 'queued', 'running', 'succeeded', 'failed'][1 + event_id % 5] AS state, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS started_at FROM events)"


def runs(t):
    """Events as runs of their users."""
    state = F.element_at(F.array(*map(F.lit, ("created", "queued", "running", "succeeded", "failed"))), (1 + F.col("event_id") % 5).cast("int"))
    return t.events.select("event_id", F.col("user_id").alias("owner"), state.alias("state"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))


@plan(f"""WITH {RUNS_SQL}, w AS (SELECT *, state IN ('created', 'queued', 'running') AND owner % 3 <> 0 AND TIMESTAMP '2024-01-20 00:00:00' - coalesce(started_at, created_at) >= INTERVAL 2 DAY AS lost FROM r)
SELECT event_id, CASE WHEN lost THEN 'unsettled' ELSE state END AS state, CASE WHEN lost THEN 'orphan' END AS error FROM w""")
def stm6_orphans(t):
    alive = t.events.where("user_id % 3 = 0").select(F.col("user_id").alias("owner"))
    return governance.settle(runs(t), F.lit("2024-01-20 00:00:00").cast("timestamp"), alive, "2 DAYS").select("event_id", "state", "error")


@plan(f"""WITH {RUNS_SQL}, w AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'running' ELSE 'succeeded' END AS wanted FROM r), m AS (SELECT *, (state = 'created' AND wanted = 'running') OR (state = 'queued' AND wanted = 'running') OR (state = 'running' AND wanted = 'succeeded') AS moved FROM w)
SELECT event_id, CASE WHEN moved THEN wanted ELSE state END AS state, moved FROM m""")
def stm7_transitions(t):
    wanted = F.when(F.col("event_id") % 2 == 0, "running").otherwise("succeeded")
    return governance.transition(runs(t), wanted).select("event_id", "state", "moved")


@plan("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey, o_custkey + 1000 AS o_custkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def stm7_idempotent_submit(t):
    """A key that is there already is left as it is; of new rows of one key the first is put in."""
    old = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + 1000).alias("o_custkey"))
    return governance.insert_or_ignore(old, new.unionByName(new.withColumn("o_custkey", F.col("o_custkey") + 1)), ["o_orderkey"], [F.asc("o_custkey")])


@plan("""WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 6 DAY)
SELECT user_id, event_id FROM l WHERE r <= 3""")
def stm8_leases(t):
    """The leases that hold: of those not run out yet the first three of each session."""
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    live = t.events.where((F.col("event_type") == "purchase") & (F.col("ts") >= now - F.expr("INTERVAL 6 DAYS")))
    return dedup.keep_best(live, ["user_id"], [F.asc("ts"), F.asc("event_id")], 3).select("user_id", "event_id")


@plan(f"WITH {RUNS_SQL} SELECT event_id, state, row_number() OVER (ORDER BY created_at DESC, event_id DESC) AS place FROM r WHERE owner IN (3, 4, 5) AND state IN ('queued', 'running') ORDER BY place LIMIT 50")
def sql2_run_list(t):
    """The newest fifty of some owners' active runs; a filter that isn't given doesn't filter."""
    given = {"owner": [3, 4, 5], "state": ["queued", "running"], "error": None}
    rows = runs(t)
    for column, values in given.items():
        rows = rows if values is None else rows.where(F.col(column).isin(values))
    top = rows.orderBy(F.desc("created_at"), F.desc("event_id")).limit(50)
    return top.select("event_id", "state", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("event_id"))).alias("place"))  # fifty rows


@plan(f"WITH {RUNS_SQL} SELECT owner, state, count(*) AS n FROM r WHERE state IN ('created', 'queued', 'running') AND owner < 10 GROUP BY ALL")
def sql3_active_runs(t):
    return runs(t).where(F.col("state").isin(*governance.ACTIVE) & (F.col("owner") < 10)).groupBy("owner", "state").agg(F.count("*").alias("n"))


@plan(f"WITH {RUNS_SQL} SELECT event_id, CASE WHEN state = 'queued' AND event_id % 2 = 0 THEN 'running' ELSE state END AS state FROM r WHERE owner <> 7")
def sql4_compare_and_set(t):
    """Rows in the expected state get the new one; those of a closed session are deleted."""
    hit = (F.col("state") == "queued") & (F.col("event_id") % 2 == 0)
    return runs(t).where("owner <> 7").select("event_id", F.when(hit, "running").otherwise(F.col("state")).alias("state"))


@plan("SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def sort3_latest_of_each(t):
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")).join(t.customer.select("c_custkey"), "c_custkey", "left_semi")


@plan("""WITH k AS (SELECT l_orderkey, l_suppkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY hits DESC, n DESC, l_suppkey) AS place FROM k WHERE hits >= 1""")
def sort4_statement_candidates(t):
    """Tables with enough hits, those with most hits and rows first."""
    found = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("n")).where("hits >= 1")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("hits"), F.desc("n"), "l_suppkey")
    return found.select("l_orderkey", "l_suppkey", F.row_number().over(order).alias("place"))


@plan("SELECT l_orderkey, arg_max(l_suppkey, (l_returnflag = 'R', l_quantity, -l_suppkey, -l_partkey)) AS primary_document FROM lineitem GROUP BY l_orderkey")
def sort5_primary_document(t):
    score = F.struct((F.col("l_returnflag") == "R").alias("a"), F.col("l_quantity"), -F.col("l_suppkey"), -F.col("l_partkey"))
    return dedup.best_value(t.lineitem, ["l_orderkey"], F.col("l_suppkey"), score, "primary_document")


@plan("""WITH x AS (SELECT c_nationkey, unnest([c_mktsegment, lower(c_mktsegment), ' ' || c_mktsegment]) AS a FROM customer WHERE c_custkey < 100000000), k AS (SELECT c_nationkey, lower(trim(a)) AS k, min(trim(a)) AS a FROM x WHERE trim(a) <> '' GROUP BY ALL)
SELECT c_nationkey, string_agg(a, '|' ORDER BY k) AS aliases FROM k GROUP BY c_nationkey""")
def set2_alias_union(t):
    """Names of each group, each once whatever its case and blanks."""
    each = t.customer.select("c_nationkey", F.explode(F.array("c_mktsegment", F.lower("c_mktsegment"), F.concat(F.lit(" "), "c_mktsegment"))).alias("a"))
    one = each.where(F.trim("a") != "").groupBy("c_nationkey", F.lower(F.trim("a")).alias("k")).agg(F.min(F.trim("a")).alias("a"))
    return one.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"]), "|").alias("aliases"))


@plan("""WITH h AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '5-LOW'),
n AS (SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h)), e AS (SELECT o_custkey, min(CASE WHEN year(o_orderdate) >= 1998 THEN 0 WHEN year(o_orderdate) >= 1997 THEN 1 WHEN year(o_orderdate) >= 1996 THEN 2 END) AS w FROM n GROUP BY 1)
SELECT o_orderkey FROM h UNION ALL SELECT o_orderkey FROM n JOIN e USING (o_custkey) WHERE year(o_orderdate) >= 1998 - w""")
def set5_extension(t):
    """Records that aren't there yet are added from a window that is widened by a year, twice at most, until it has some."""
    have = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    new = t.orders.where("o_orderpriority = '5-LOW'").join(have, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    needed = F.when(F.col("y") >= 1998, 0).when(F.col("y") >= 1997, 1).when(F.col("y") >= 1996, 2)
    width = new.groupBy("o_custkey").agg(F.min(needed).alias("w"))
    return have.unionByName(new.join(width, "o_custkey").where(F.col("y") >= 1998 - F.col("w")).select("o_orderkey"))


@plan("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber = 2) GROUP BY 1)
SELECT l_orderkey, coalesce(a.s = b.s, false) AS same FROM a LEFT JOIN b USING (l_orderkey)""")
def set6_same_files(t):
    files = lambda rows, name: rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias(name))
    kept = t.lineitem.where("NOT (l_orderkey % 4 = 0 AND l_linenumber = 2)")
    return files(t.lineitem, "a").join(files(kept, "b"), "l_orderkey", "left").select("l_orderkey", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


@plan("""WITH f AS (SELECT o_orderkey, ['2024 Annual Report.pdf', 'Q3 Transcript.html', 'Investor Day 2023.pdf', '2023年报.pdf', '业绩公告.pdf', 'Quarterly Report Q1.pdf', 'press Summary.txt', '财务报表.xlsx', 'notes'][1 + o_orderkey % 9] AS name FROM orders)
SELECT o_orderkey, CASE WHEN contains(name, '财务报表') THEN 'FINANCIAL_STATEMENTS' WHEN contains(name, 'Transcript') THEN 'EARNINGS_CALL' WHEN contains(name, 'Investor Day') THEN 'EARNINGS_PRESENTATION' END AS material,
 CASE WHEN contains(name, 'Summary') THEN 5 WHEN contains(name, 'Annual Report') OR contains(name, '年报') THEN 0 WHEN contains(name, 'Quarterly Report') THEN 1 WHEN contains(name, '公告') THEN 3 ELSE 4 END AS rank,
 nullif(regexp_extract(name, '\\.([a-z]+)$', 1), '') AS suffix FROM f""")
def up1_upload_routing(t):
    """File names: as which material they are taken, how likely they are the main report, and their suffix."""
    name = F.element_at(F.array(*map(F.lit, FILE_NAMES)), (1 + F.col("o_orderkey") % len(FILE_NAMES)).cast("int"))
    first = lambda table, otherwise: F.coalesce(*[F.when(name.rlike(p), F.lit(v)) for v, p in table], F.lit(otherwise))
    return t.orders.select("o_orderkey", first(MATERIALS, None).alias("material"), first(REPORT_RANKS, 4).alias("rank"), C.suffix(name).alias("suffix"))


@plan("""WITH o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 4 <> 0)
SELECT o_orderkey, CASE WHEN o.o_totalprice IS NULL THEN 'create' WHEN n.p IS NULL THEN 'delete' WHEN p = o_totalprice THEN 'skip' ELSE 'update' END AS action FROM o FULL JOIN n USING (o_orderkey)""")
def up2_upload_action(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("old"))
    new = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("new"))
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "skip").otherwise("update")
    return old.join(new, "o_orderkey", "full").select("o_orderkey", action.alias("action"))


@plan("SELECT o_orderkey, o_orderkey % 6 = 1 AS is_deleted, CASE WHEN o_orderkey % 6 IN (2, 3) THEN 'P' ELSE o_orderstatus END AS state FROM orders")
def snk2_document_lifecycle(t):
    """Logical deletes, restores and new values of documents, of which the last of each document holds."""
    table = t.orders.select("o_orderkey", (F.col("o_orderkey") % 6).isin(0, 1).alias("is_deleted"), F.col("o_orderstatus").alias("state"))
    n = F.col("o_orderkey") % 6
    steps = t.orders.select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.when(n == 0, True).alias("is_deleted"), F.when(n.isin(2, 3), "X").alias("state")), F.struct(F.lit(2).alias("at"), F.when(n == 0, False).alias("is_deleted"), F.when(n.isin(2, 3), "P").alias("state")))).alias("s")).select("o_orderkey", "s.*")
    last = dedup.keep_best(steps, ["o_orderkey"], [F.desc("at")]).select("o_orderkey", "is_deleted", "state")
    return governance.upsert(table, last, ["o_orderkey"], ["is_deleted", "state"])


@plan("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def snk5_stale_rows(t):
    """Active documents that no source names any more."""
    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")


@plan("SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 24 HOUR GROUP BY user_id")
def snk10_fresh_cache(t):
    return governance.fresh(t.events, F.lit("2024-01-10 00:00:00").cast("timestamp"), "ts").groupBy("user_id").agg(F.count("*").alias("n"))


@plan("SELECT '| ' || source || ' | ' || count(*) || ' | ' || round(avg(n_chars), 2)::DECIMAL(20, 2) || ' |' AS line FROM documents GROUP BY source")
def snk9_report_rows(t):
    per = t.documents.groupBy("source").agg(F.count("*").cast("string").alias("n"), F.round(F.avg("n_chars"), 2).cast("decimal(20,2)").cast("string").alias("a"))
    return per.select(C.markdown_row("source", "n", "a").alias("line"))


@plan("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'IncomeStatement' WHEN 1 THEN 'BalanceSheet' WHEN 2 THEN 'CashFlowStatement' ELSE 'other thing' END AS statement FROM nation")
def flt8_statement_names(t):
    asked = F.element_at(F.array(*map(F.lit, (" Income_Statement", "balance sheet", "CASH_FLOW", "other thing"))), (1 + F.col("n_nationkey") % 4).cast("int"))
    return t.nation.select("n_nationkey", C.named(asked, STATEMENT_NAMES).alias("statement"))


@plan("SELECT page_id, nullif(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '://[^/]+/.*(\\.[a-z0-9]+)$', 1), '') AS suffix, regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') AND NOT regexp_matches(url, '://(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|0\\.)') AS is_public FROM pages")
def str3_url_parts(t):
    """Suffix of the path, and whether the address is a public one."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    path = F.regexp_extract(F.lower(bare), r"://[^/]+/.*(\.[a-z0-9]+)$", 1)
    return t.pages.select("page_id", F.nullif(path, F.lit("")).alias("suffix"), C.public_url(F.col("url")).alias("is_public"))


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL), c AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(line), '[.;。；\\n]+'), lambda z: trim(z)), lambda z: z <> '') AS parts FROM l)
SELECT doc_id, section, CASE WHEN length(parts[-1]) BETWEEN 5 AND 200 THEN sha256(parts[-1]) END AS caption FROM c""")
def str4_captions(t):
    """The last sentence before a table as its caption, if it is neither a word nor a paragraph."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    tail = C.tail_sentence(F.col("line"))
    return lines.select("doc_id", "section", F.when(F.length(tail).between(5, 200), F.sha2(tail.cast("binary"), 256)).alias("caption"))


@plan("""WITH c AS (SELECT o_orderkey, 'a [[t_0001]] b [[t_0002]] a [[t_0001]]' || CASE WHEN o_orderkey % 2 = 0 THEN ' [[t_' || lpad(o_orderkey::VARCHAR, greatest(4, length(o_orderkey::VARCHAR))::INT, '0') || ']]' ELSE '' END AS content FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey NOT IN (1, 2) THEN 't_0001,t_0002,t_' || lpad(o_orderkey::VARCHAR, greatest(4, length(o_orderkey::VARCHAR))::INT, '0') ELSE 't_0001,t_0002' END AS refs, content || CASE WHEN o_orderkey = 9 THEN '' ELSE chr(10) || '[[t_0009]]' END AS filled FROM c""")
def str5_placeholders(t):
    """References in a text in order, each once, and the text with a missing one put at its end."""
    own = F.concat(F.lit(" [["), C.reference("t", F.col("o_orderkey")), F.lit("]]"))
    content = F.concat(F.lit("a [[t_0001]] b [[t_0002]] a [[t_0001]]"), F.when(F.col("o_orderkey") % 2 == 0, own).otherwise(""))
    filled = F.when(F.col("o_orderkey") == 9, content).otherwise(C.with_placeholders(content, F.array(F.lit("t_0009"), F.lit("t_0001"))))
    return t.orders.select("o_orderkey", F.array_join(C.table_references(content), ",").alias("refs"), filled.alias("filled"))


@plan("SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS dashed, lpad(o_custkey::VARCHAR, 10, '0') || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS bare, o_custkey AS cik FROM orders WHERE o_custkey > 0")
def str17_accessions(t):
    """Accession numbers with and without hyphens, and the company's number in them."""
    rows = t.orders.where("o_custkey > 0")
    bare = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0"))
    dashed = C.accession(bare)
    return rows.select("o_orderkey", dashed.alias("dashed"), F.replace(dashed, F.lit("-"), F.lit("")).alias("bare"), F.substring(bare, 1, 10).cast("long").alias("cik"))


@plan("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN '$ 1,234' WHEN 1 THEN '(' || l_partkey || ')' WHEN 2 THEN l_partkey || '[2]' WHEN 3 THEN l_partkey || '%' WHEN 4 THEN '—' ELSE ' some  text ' END AS cell FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN '1234' WHEN 1 THEN '-' || l_partkey WHEN 2 THEN l_partkey::VARCHAR WHEN 3 THEN l_partkey || '%' WHEN 4 THEN NULL ELSE 'some text' END AS value FROM x""")
def num2_cells(t):
    """Table cells: numbers in plain form, without brackets, signs and footnotes; shares stay text; blanks are null."""
    p = F.col("l_partkey")
    cell = F.when(p % 6 == 0, "$ 1,234").when(p % 6 == 1, F.concat(F.lit("("), p.cast("string"), F.lit(")"))).when(p % 6 == 2, F.concat(p.cast("string"), F.lit("[2]"))).when(p % 6 == 3, F.concat(p.cast("string"), F.lit("%"))).when(p % 6 == 4, "—").otherwise(" some  text ")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct().select("l_orderkey", "l_linenumber", "l_partkey", C.cell_value(cell).alias("value"))


@plan("SELECT l_orderkey, l_linenumber AS col, count(*) FILTER (l_discount > 0.02) AS numbers FROM lineitem WHERE l_linenumber >= 1 GROUP BY ALL HAVING count(*) FILTER (l_discount > 0.02) >= 2")
def num6_value_columns(t):
    """Columns of a table with at least two numbers below the header."""
    text = F.when(F.col("l_discount") > 0.02, F.col("l_quantity").cast("string")).otherwise("n/a")
    cells = t.lineitem.where("l_linenumber >= 1").select("l_orderkey", F.col("l_linenumber").alias("col"), C.tolerant_number(text).alias("number"))
    return cells.groupBy("l_orderkey", "col").agg(F.count("number").alias("numbers")).where("numbers >= 2")


@plan("""WITH c AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS a, max(CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_suppkey END) AS b FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, count(b) > 0 AS has_b FROM c GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN has_b THEN '{"a":' || a || CASE WHEN b IS NULL THEN '' ELSE ',"b":' || b END || '}' ELSE '{"a":' || a || '}' END AS record FROM c JOIN k USING (l_orderkey)""")
def arr2_records(t):
    """Rows of a table as records, without columns that are empty all the way down."""
    cells = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("a"), F.max(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_suppkey"))).alias("b"))
    used = cells.groupBy("l_orderkey").agg((F.count("b") > 0).alias("has_b"))
    record = F.to_json(F.struct("a", F.when(F.col("has_b"), F.col("b")).alias("b")))
    return cells.join(used, "l_orderkey").select("l_orderkey", "l_linenumber", record.alias("record"))


@plan("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def arr6_first_key(t):
    """The first of a map's keys that is asked for, whatever its case."""
    given = F.from_json(F.replace("props", F.lit('"k"'), F.lit('"K"')), "map<string,string>")
    return t.events.select("event_id", C.first_key(given, ["missing", "k"]).alias("k"))


@plan("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE l_returnflag END AS label, l_linestatus AS concept FROM lineitem), n AS (SELECT l_orderkey, trim(coalesce(nullif(trim(label), ''), concept)) AS label, min((l_linenumber, l_partkey)) AS first FROM r GROUP BY ALL)
SELECT l_orderkey, string_agg(label, ',' ORDER BY first) AS labels FROM n GROUP BY 1""")
def arr8_row_labels(t):
    """Labels of a statement's rows, or their concepts where they have none, each once in order."""
    label = F.coalesce(C.blank_to_null(F.when(F.col("l_partkey") % 4 == 0, " ").otherwise(F.col("l_returnflag"))), F.col("l_linestatus"))
    # Rows of one number come as the table has them, file after file; numbers that are missing come last.
    number = F.struct(*[x for c in ("l_linenumber", "l_partkey") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    files = t.lineitem.select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("file_number", F.row_number().over(Window.orderBy("file")).cast("long"))
    place = F.shiftleft("file_number", 40) + F.col("row_index")
    rows = t.lineitem.select("l_orderkey", label.alias("label"), number.alias("number"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    rows = rows.join(F.broadcast(files), "file").select("l_orderkey", "label", "number", place.alias("place"))
    first = rows.groupBy("l_orderkey", "label").agg(F.min("number").alias("number"), F.min("place").alias("place"))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "place", "label"))), lambda s: s["label"]), ",").alias("labels"))


@plan("SELECT doc_id, sha256(substr(text, 1, 100)) AS chars, sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))) AS lines, array_to_string(string_split(text, ' ')[1:3], ' ') AS items, octet_length(encode(substr(coalesce(text, ''), 1, 0))) + least(50, octet_length(encode(text)))::INT AS n_bytes FROM documents WHERE text IS NOT NULL")
def lim1_strategies(t):
    """The four ways to cut a result."""
    rows = t.documents.where("text IS NOT NULL")
    cut = lambda strategy, most, c="text": governance.truncated(F.col(c), strategy, most)
    return rows.withColumn("words", F.split("text", " ")).select("doc_id", F.sha2(cut("text_chars", 100).cast("binary"), 256).alias("chars"), F.sha2(cut("text_lines", 2).cast("binary"), 256).alias("lines"), F.array_join(cut("list_items", 3, "words"), " ").alias("items"), F.length(cut("binary_bytes", 50)).alias("n_bytes"))


@plan("""WITH t AS (SELECT l_orderkey, 't_' || lpad(l_linenumber::VARCHAR, 4, '0') AS table_ref, bool_or(l_returnflag = 'R') AS is_financial, min(l_partkey % 3) AS section FROM lineitem GROUP BY ALL), f AS (SELECT l_orderkey, count(*) FILTER (is_financial) AS financial_count FROM t GROUP BY 1)
SELECT l_orderkey, table_ref, is_financial, 'Section ' || section AS section_title, row_number() OVER (PARTITION BY l_orderkey ORDER BY is_financial DESC, table_ref) AS place, financial_count FROM t JOIN f USING (l_orderkey)""")
def api5_list_tables(t):
    """Tables of a document, the financial ones first, with the title of their section."""
    tables = t.lineitem.groupBy("l_orderkey", C.reference("t", F.col("l_linenumber")).alias("table_ref")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("is_financial"), F.min(F.col("l_partkey") % 3).alias("section"))
    titles = t.spark.range(3).select(F.col("id").alias("section"), F.concat(F.lit("Section "), F.col("id").cast("string")).alias("section_title"))
    counts = tables.groupBy("l_orderkey").agg(F.count_if("is_financial").alias("financial_count"))
    placed = tables.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("is_financial"), "table_ref")))
    return placed.join(F.broadcast(titles), "section", "left").join(counts, "l_orderkey").select("l_orderkey", "table_ref", "is_financial", "section_title", "place", "financial_count")


@plan("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE 7 BETWEEN l_suppkey AND l_suppkey + l_linenumber")
def api7_page_content(t):
    """What stands on page 7: all that begins there or before and ends there or after."""
    begin, end = F.col("l_suppkey"), F.col("l_suppkey") + F.col("l_linenumber")
    return t.lineitem.where((begin <= 7) & (end >= 7)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@plan("""WITH f AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS i, 'us-gaap:' || l_returnflag || 'Text' AS concept, l_orderkey, l_partkey, l_linenumber, l_linestatus, year(l_shipdate)::INT AS fy, l_extendedprice AS v, l_discount FROM lineitem)
SELECT l_orderkey, lower(split_part(concept, ':', 2)) AS concept, fy, round(max(v), 2) AS value, count(*) AS n FROM f WHERE lower(split_part(concept, ':', 2)) IN ('rtext', 'ntext') AND fy IN (1996, 1997) AND v BETWEEN 1000 AND 60000 GROUP BY ALL""")
def api9_query_facts(t):
    """Facts of two concepts and years within bounds; of those that agree in all but their number the largest."""
    facts = t.lineitem.select("l_orderkey", F.concat(F.lit("us-gaap:"), "l_returnflag", F.lit("Text")).alias("concept"), F.year("l_shipdate").alias("fy"), F.col("l_extendedprice").alias("v"))
    found = facts.withColumn("concept", C.local_name(F.col("concept"))).where(F.col("concept").isin("rtext", "ntext") & F.col("fy").isin(1996, 1997) & F.col("v").between(1000, 60_000))
    return found.groupBy("l_orderkey", "concept", "fy").agg(F.round(F.max("v"), 2).alias("value"), F.count("*").alias("n"))


@plan("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) BETWEEN 4 AND 6")
def api11_fetch_more(t):
    """The second page of three of every company's list."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t.orders.withColumn("place", place).where(F.col("place").between(4, 6)).select("o_custkey", "o_orderkey")


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL)
SELECT doc_id, section, last_value(CASE WHEN length(line) < 40 THEN section END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l""")
def join9_heading_of(t):
    """The last heading at or before each line; a short line is one."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    heading = F.last(F.when(F.length("line") < 40, F.col("section")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("section"))
    return lines.select("doc_id", "section", heading.alias("heading"))


@plan("""WITH c AS (SELECT user_id AS run, event_id // 10 AS iteration, count(*) AS n_context FROM events WHERE event_type = 'view' GROUP BY ALL), u AS (SELECT user_id AS run, event_id // 10 AS iteration, sum(value) AS used FROM events WHERE event_type = 'purchase' GROUP BY ALL), k AS (SELECT user_id AS run, event_id // 10 AS iteration, count(*) AS n_calls FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL)
SELECT run, iteration, coalesce(n_context, 0) AS n_context, round(coalesce(used, 0), 4) AS used, coalesce(n_calls, 0) AS n_calls, coalesce(n_context, 0) <> coalesce(n_calls, 0) AS differs FROM c FULL JOIN u USING (run, iteration) FULL JOIN k USING (run, iteration)""")
def join17_iterations(t):
    """Context, use and calls of each iteration of a run, and where the numbers of context and calls differ."""
    keyed = t.events.select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 10).alias("iteration"), "event_type", "value")
    side = lambda kinds, agg: keyed.where(F.col("event_type").isin(*kinds)).groupBy("run", "iteration").agg(agg)
    both = side(["view"], F.count("*").alias("n_context")).join(side(["purchase"], F.sum("value").alias("used")), ["run", "iteration"], "full").join(side(["click", "error"], F.count("*").alias("n_calls")), ["run", "iteration"], "full")
    n, calls = F.coalesce("n_context", F.lit(0)), F.coalesce("n_calls", F.lit(0))
    return both.select("run", "iteration", n.alias("n_context"), F.round(F.coalesce("used", F.lit(0.0)), 4).alias("used"), calls.alias("n_calls"), (n != calls).alias("differs"))


@plan("""SELECT user_id, event_type, (value > 100) AS is_large, json_extract_string(props, '$.k')::INT % 3 AS code, event_id % 2 AS attempt, count(*) AS n, min(event_id) AS sample FROM events GROUP BY ALL""")
def agg9_five_part_signature(t):
    """Failures by tool, kind, size, code and attempt, with the first of each."""
    code = F.get_json_object("props", "$.k").cast("int") % 3
    return t.events.groupBy("user_id", "event_type", (F.col("value") > 100).alias("is_large"), code.alias("code"), (F.col("event_id") % 2).alias("attempt")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


@plan("""WITH x AS (SELECT p_partkey, p_brand, p_name || ['_htm.xml', '_ins.xml', '.xml', '_lab.xml', '.htm'][1 + p_size % 5] AS name FROM part), r AS (SELECT *, CASE WHEN name LIKE '%\\_htm.xml' ESCAPE '\\' THEN 1 WHEN name LIKE '%\\_ins.xml' ESCAPE '\\' THEN 2 WHEN regexp_matches(name, '_(lab|pre|cal|def)\\.xml$') THEN NULL WHEN name LIKE '%.xml' THEN 3 END AS p FROM x)
SELECT p_brand, arg_min(name, (p, name)) AS instance FROM r WHERE p IS NOT NULL GROUP BY p_brand""")
def src16_instance_file(t):
    """The instance document of each filing, by the ends of its files' names; linkbases are none."""
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, ("_htm.xml", "_ins.xml", ".xml", "_lab.xml", ".htm"))), (1 + F.col("p_size") % 5).cast("int")))
    rank = F.when(name.endswith("_htm.xml"), 1).when(name.endswith("_ins.xml"), 2).when(name.rlike(r"_(lab|pre|cal|def)\.xml$"), None).when(name.endswith(".xml"), 3)
    return t.part.select("p_brand", name.alias("name"), rank.alias("rank")).where("rank IS NOT NULL").groupBy("p_brand").agg(F.min_by("name", F.struct("rank", "name")).alias("instance"))


@plan("SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS report FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS text FROM conversations) GROUP BY conv_id")
def wr3_assembly(t):
    """Chapters put together in their order."""
    chapter = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), chapter.alias("chapter"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["chapter"]), "\n").alias("report"))


@plan("""WITH v AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS high, count(*) FILTER (l_returnflag = 'A') AS medium, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, high = 0 AND medium < 2 AS passed, CASE WHEN high >= 2 THEN 'regenerate' WHEN high = 1 OR medium >= 2 THEN 'patch' ELSE 'none' END AS strategy FROM v""")
def wr2_violations(t):
    """Whether a chapter passes, and how it is mended, from the weights of its violations."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("high"), F.count_if(F.col("l_returnflag") == "A").alias("medium"))
    high, medium = F.col("high"), F.col("medium")
    return per.select("l_orderkey", ((high == 0) & (medium < 2)).alias("passed"), F.when(high >= 2, "regenerate").when((high == 1) | (medium >= 2), "patch").otherwise("none").alias("strategy"))


@plan("SELECT l_orderkey, l_linenumber, string_agg(l_returnflag || '=' || l_quantity::INT, ';' ORDER BY l_partkey, l_suppkey, l_quantity) AS cells FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL")
def api6_get_table(t):
    """One table of every document, its cells in order."""
    cell = F.concat(F.col("l_returnflag"), F.lit("="), F.col("l_quantity").cast("int").cast("string"))
    rows = t.lineitem.where("l_linenumber = 3").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", cell.alias("cell")))).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("c", lambda x: x["cell"]), ";").alias("cells"))


@plan("""WITH f AS (SELECT p_partkey, p_brand, p_type, p_size, (p_type = 'PROMO')::INT * 2 + (p_size % 3 = 0)::INT AS score FROM part WHERE p_type = 'PROMO' OR p_size % 3 = 0)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS place FROM f QUALIFY place <= 5""")
def flt13_facet_routing(t):
    """Candidates by the kind of business first and by what they are bound to second; five of each at most."""
    kind, bound = F.col("p_type") == "PROMO", F.col("p_size") % 3 == 0
    score = F.when(kind, 2).otherwise(0) + F.when(bound, 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(score.desc(), "p_partkey"))
    return t.part.where(kind | bound).withColumn("place", place).where("place <= 5").select("p_brand", "p_partkey", "place")


@plan("SELECT user_id, max(ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE AS idle, max(ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY AS stale FROM events GROUP BY user_id")
def dt7_cutoffs(t):
    """Sessions that have been silent for half an hour, and for five days."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", (F.col("last") < now - F.expr("INTERVAL 30 MINUTES")).alias("idle"), (F.col("last") < now - F.expr("INTERVAL 5 DAYS")).alias("stale"))


@plan("SELECT 'quarter_' || quarter(o_orderdate) AS period, o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def arr4_periods_to_rows(t):
    """A column for each period, turned into rows again; periods without a value have none."""
    quarter = F.concat(F.lit("quarter_"), F.quarter("o_orderdate").cast("string"))
    wide = t.orders.withColumn("p", quarter).groupBy("o_custkey").pivot("p", [f"quarter_{i}" for i in range(1, 5)]).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.unpivot("o_custkey", [f"quarter_{i}" for i in range(1, 5)], "period", "value").where("value IS NOT NULL").select("period", "o_custkey", "value")


@plan("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k, value > 100 AS is_large, 'all' AS scope FROM events")
def arr7_coerced_arguments(t):
    """Arguments brought to the types of a schema: numbers out of texts, defaults for what is missing."""
    text = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), (F.col("value") > 100).cast("string").alias("is_large")))
    given = F.from_json(text, "k string, is_large string, scope string")
    return t.events.select("event_id", given["k"].try_cast("int").alias("k"), given["is_large"].try_cast("boolean").alias("is_large"), F.coalesce(given["scope"], F.lit("all")).alias("scope"))


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL), h AS (SELECT *, last_value(CASE WHEN length(line) < 60 THEN contains(lower(line), 'in') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM l)
SELECT doc_id, section FROM h WHERE inside AND length(line) >= 60""")
def str14_lines_under_heading(t):
    """Lines below a heading that has a word, up to the next heading."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    heading = F.when(F.length("line") < 60, F.contains(F.lower("line"), F.lit("in")))
    inside = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("section"))
    return lines.withColumn("inside", inside).where(F.col("inside") & (F.length("line") >= 60)).select("doc_id", "section")


@plan("""WITH p AS (SELECT DISTINCT l_orderkey, l_shipdate::DATE AS period_end FROM lineitem WHERE l_linenumber <= 2), v AS (SELECT l_orderkey, l_shipdate::DATE AS period_end, l_linenumber, round(l_extendedprice, 2) AS value FROM lineitem WHERE l_linenumber > 2)
SELECT l_orderkey, period_end::VARCHAR AS period_end, l_linenumber, value FROM v SEMI JOIN p USING (l_orderkey, period_end)""")
def join21_target_periods(t):
    """Values of the periods that a statement is to have; of other periods none."""
    date = F.to_date("l_shipdate").alias("period_end")
    wanted = t.lineitem.where("l_linenumber <= 2").select("l_orderkey", date).distinct()
    values = t.lineitem.where("l_linenumber > 2").select("l_orderkey", date, "l_linenumber", F.round("l_extendedprice", 2).alias("value"))
    return values.join(wanted, ["l_orderkey", "period_end"], "left_semi").select("l_orderkey", F.col("period_end").cast("string").alias("period_end"), "l_linenumber", "value")


@plan("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 4 <> 1 AS reprocess, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS result FROM orders WHERE o_orderkey % 10 <> 9")
def snk3_processed_lifecycle(t):
    """Processed results: some marked for another run, some of these marks cleared, some results cleared, some deleted."""
    rows = t.orders.where("o_orderkey % 10 <> 9").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("result"))
    marked = rows.withColumn("reprocess", F.col("o_orderstatus") == "F")
    return marked.select("o_orderkey", (F.col("reprocess") & (F.col("o_orderkey") % 4 != 1)).alias("reprocess"), F.when(F.col("o_orderkey") % 7 != 0, F.col("result")).alias("result"))


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL), c AS (SELECT *, count(*) FILTER (length(line) < 50) OVER (PARTITION BY doc_id ORDER BY section) AS chapter FROM l)
SELECT doc_id, chapter, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY section)) AS body FROM c WHERE chapter > 0 GROUP BY ALL""")
def wr1_chapters(t):
    """A template's chapters: each heading with all that stands below it; what stands before the first is none's."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    numbered = lines.withColumn("chapter", F.count(F.when(F.length("line") < 50, 1)).over(Window.partitionBy("doc_id").orderBy("section"))).where("chapter > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "line"))), lambda s: s["line"]), "\n")
    return numbered.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_lines"), F.sha2(body.cast("binary"), 256).alias("body"))


@plan("""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS after FROM conversations), s AS (SELECT conv_id, min(turn) FILTER (role = 'user' AND after <= 2000) AS split FROM m GROUP BY conv_id)
SELECT conv_id, split FROM s""")
def wr4_compaction_split(t):
    """Where a conversation is cut for compaction: the earliest turn of a user from which on all fits, so that no group
    of calls and answers is torn."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.col("role"), F.col("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = t.conversations.withColumn("after", F.sum(F.length(F.coalesce("text", F.lit("")))).over(back))
    return rows.groupBy("conv_id").agg(F.min(F.when((F.col("role") == "user") & (F.col("after") <= 2000), F.col("turn"))).alias("split"))


@plan("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'promoted' WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS expected FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def up4_promotion(t):
    """The ground truth with what was promoted to it."""
    truth = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("expected"))
    promoted = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("promoted").alias("expected"))
    return governance.upsert(truth, promoted, ["o_orderkey"], ["expected"])


@plan("""SELECT c_custkey, c_name FROM customer WHERE regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') IN (SELECT 'customer' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier)""")
def up3_alias_matches(t):
    """Companies whose name is exactly one that a search has found, letters and digits alone being compared."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    found = t.supplier.select(bare(F.concat(F.lit("CUSTOMER # "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("key")).distinct()
    return t.customer.withColumn("key", bare(F.col("c_name"))).join(found, "key", "left_semi").select("c_custkey", "c_name")
