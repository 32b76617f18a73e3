"""Queries that run the engine's stages over claims, plans, mentions and edges made from whole test tables, with SQL beside them.

Order lines are claims: fifteen orders make a document, a line's part gives the claim's kind, its supplier the attributes and
the evidence. Return flag and line number make plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimforge.functions import text
from claimforge.operators import candidates as C, claims as K, contracts as CC, dml, evaluation as Q, formation as M, planning as P, projection as R, relational, segments as S
from claimforge.queries import query
from claimforge.rules import RuleSet
from claimforge.scratch import settle
from claimforge.sources import gateways
from claimforge.sources.packages import read_table

KINDS = ["rule", "strategy", "script", "objection", "term", "process", "fact", "list"]
ATTRIBUTES = ['{"scope":"all"}', '{"action":"b","condition":"a"}', '{"code":"1","meaning":"m"}', '{"response":"r"}']
HOMES = {"A": (1, "D3.2", "SALES_STRATEGY"), "N": (2, "D4.1", "CUSTOMER_OBJECTION"), "R": (3, "D1.2", "BUSINESS_PROCESS")}

MADE = """WITH c AS (SELECT l_orderkey // 15 AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey // 15 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS pos,
      (['rule', 'strategy', 'script', 'objection', 'term', 'process', 'fact', 'list'])[1 + l_partkey % 8] AS kind, 'part ' || l_partkey % 3 AS subject, l_suppkey % 4 AS att, 'a' || l_suppkey % 3 AS anchor, 'heading ' || l_suppkey % 2 AS topic, l_returnflag AS flag, l_linenumber AS line FROM lineitem),
    d AS (SELECT *, 'c' || pos AS claim_id, att = 1 AND pos % 2 = 0 AS branches, CASE flag WHEN 'A' THEN 'D3.2' WHEN 'N' THEN 'D4.1' ELSE 'D1.2' END AS module, CASE flag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END + line AS plan FROM c),
    e AS (SELECT *, (module = 'D3.2' AND (kind IN ('rule', 'strategy') OR branches)) OR (module = 'D4.1' AND (kind IN ('objection', 'term') OR (kind = 'fact' AND att = 0))) OR (module = 'D1.2' AND kind IN ('rule', 'process', 'fact')) AS covers FROM d) """


def lines_as_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with the plan that each belongs to."""
    order = Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    numbered = read_table(spark, sf, "lineitem").withColumn("doc_id", F.floor(F.col("l_orderkey") / 15)).withColumn("pos", F.row_number().over(order))
    # numbered once: plans, claims and additions are all made of these few numbers
    t = settle(numbered.select("doc_id", "pos", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))
    of = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))
    named = lambda word, key, n: F.concat(F.lit(word), (F.col(key) % n).cast("string"))
    home = lambda i: F.element_at(F.create_map(*[F.lit(x) for flag, row in HOMES.items() for x in (flag, row[i])]), F.col("l_returnflag"))
    evidence = F.array(F.struct(named("a", "l_suppkey", 3).alias("anchor_id"), F.lit("quote").alias("exact_quote"), F.lit(None).cast("string").alias("selector"), F.concat(F.lit("# "), named("heading ", "l_suppkey", 2), F.lit("\nbody")).alias("source_text")))
    statement = F.when(F.col("pos") % 2 == 0, F.lit("客户 asks")).otherwise(F.lit("asks"))
    return t.select(
        "doc_id", "pos", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("claim_id"), of(KINDS, "l_partkey").alias("claim_kind"), statement.alias("statement"), named("part ", "l_partkey", 3).alias("subject"), of(ATTRIBUTES, "l_suppkey").alias("attributes"),
        F.array().cast("array<string>").alias("module_hints"), evidence.alias("evidence"), (home(0) * 10 + F.col("l_linenumber")).alias("plan"), home(1).alias("module"), home(2).alias("object_type"),
    )


def lines_as_plans(claims: DataFrame) -> DataFrame:
    g = claims.groupBy("doc_id", F.col("plan").alias("pos"), "module", "object_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))
    title = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("title"))
    hints = F.when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(F.lit('{"subject":"s"}'))
    return g.select("doc_id", "pos", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("plan_id"), title.alias("title"), F.split_part("module", F.lit("."), F.lit(1)).alias("domain"), "module", "object_type", hints.alias("identity_hints"), "claim_ids")


def made(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = lines_as_claims(spark, sf)
    return settle(lines_as_plans(rows)), rows.drop("plan", "module", "object_type")


def listed(plans: DataFrame) -> DataFrame:
    return plans.select("doc_id", "plan_id", "title", F.array_join("claim_ids", ",").alias("claims"))


@query(MADE + """SELECT doc_id, pos, CASE WHEN row_number() OVER (PARTITION BY doc_id, anchor ORDER BY pos) = 1 THEN '# ' || topic || chr(10) || 'body' END AS source_text FROM e""")
def q_compact_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """PF6, PF7: the source text goes with the first claim of an anchor only."""
    return K.compact_prompt(made(spark, sf)[1]).select("doc_id", "pos", "source_text")


@query(MADE + """SELECT doc_id, plan AS pos, CAST(row_number() OVER (PARTITION BY doc_id, plan ORDER BY pos) - 1 AS INT) AS nth, claim_id, kind AS claim_kind FROM e""")
def q_plan_links(spark: SparkSession, sf: str) -> DataFrame:
    """Plans meet their claims."""
    return P.links(*made(spark, sf)).select("doc_id", "pos", "nth", "claim_id", "claim_kind")


@query(MADE + """SELECT doc_id, plan AS pos, claim_id, covers AS "primary" FROM e""")
def q_plan_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a plan's module is a primary home of each of its claims."""
    return P.covers(P.links(*made(spark, sf)), RuleSet.built_in()).select("doc_id", "pos", "claim_id", "primary")


@query(MADE + """SELECT doc_id, claim_id FROM e WHERE NOT covers""")
def q_uncovered_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that no plan covers."""
    return P.uncovered(*made(spark, sf), RuleSet.built_in()).select("doc_id", "claim_id")


@query(
    MADE
    + """, g AS (SELECT doc_id, plan, count(*) AS n FROM e GROUP BY doc_id, plan), s AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, anchor FROM e GROUP BY doc_id, anchor HAVING count(DISTINCT plan) > 1) GROUP BY doc_id)
    SELECT doc_id, count(*) AS objects, count(*) FILTER (n = 1) AS single_claim, round(avg(n), 2) AS mean_claims, coalesce(max(k), 0) AS split_anchors, round(count(*) FILTER (n = 1) / count(*), 4) AS single_claim_rate FROM g LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
)
def q_granularity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How finely each document's claims are dealt to plans."""
    return P.granularity_metrics(*made(spark, sf))


@query(
    MADE
    + """, f AS (SELECT doc_id, plan, any_value(module) AS module, bool_or(kind = 'strategy') AS strategic, bool_or(att = 1) AS acts, bool_and(kind = 'list') AS lists, bool_or(covers) AS covered, bool_or(kind IN ('strategy', 'script') OR att = 3) AS supported,
      bool_or(branches) AS branches, count(*) >= 2 AND bool_or(kind = 'process') AS steps FROM e GROUP BY doc_id, plan)
    SELECT doc_id, 'p' || plan AS plan_id, 'the objection lacks a sourced root concern or response' AS reason FROM f WHERE module = 'D4.1' AND NOT supported
    UNION ALL SELECT doc_id, 'p' || plan, 'a strategy needs sourced actions or branches' FROM f WHERE module = 'D3.2' AND strategic AND NOT acts
    UNION ALL SELECT doc_id, 'p' || plan, 'an enumeration is no action rule' FROM f WHERE module = 'D3.2' AND lists
    UNION ALL SELECT doc_id, 'p' || plan, 'D3.2 needs a sourced strategy or decision rule' FROM f WHERE module = 'D3.2' AND NOT lists AND NOT covered
    UNION ALL SELECT doc_id, 'p' || plan, 'conversation branches belong to D3.2' FROM f WHERE module = 'D1.2' AND branches
    UNION ALL SELECT doc_id, 'p' || plan, 'a process needs a sourced sequence of steps' FROM f WHERE module = 'D1.2' AND NOT steps
    UNION ALL SELECT doc_id, 'p' || plan, 'a title is required' FROM f WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'p' || plan, 'identity hints are required' FROM f WHERE doc_id % 5 = 0"""
)
def q_plan_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P2f, P2i, P2k, P2m: the rule table over plans, a row for each rule that a plan breaks."""
    known = P.facts(*made(spark, sf), RuleSet.built_in())
    broken = F.array_compact(F.array(*[F.when(on, F.lit(reason)) for reason, on in P.rule_table()]))
    # outer: before an inner explode the optimiser would test every rule once more
    return known.select("doc_id", "plan_id", F.explode_outer(broken).alias("reason")).where("reason is not null")


@query(
    MADE
    + """SELECT doc_id, 'guard-D33-CONVERSATION-' || arg_min(claim_id, pos) AS plan_id, topic || '销售应对规则' AS title, string_agg(claim_id, ',' ORDER BY pos) AS claims FROM e WHERE branches AND module <> 'D3.2' GROUP BY doc_id, topic"""
)
def q_guard_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Branches that no strategy holds, by source heading."""
    return listed(P.guard_branches(*made(spark, sf)))


@query(MADE + """SELECT doc_id, 'guard-D41-' || claim_id AS plan_id, '客户异议：' || subject AS title, claim_id AS claims FROM e WHERE kind = 'objection' AND att = 3 AND module <> 'D4.1'""")
def q_guard_objections(spark: SparkSession, sf: str) -> DataFrame:
    """Answered objections that no objection plan holds."""
    return listed(P.guard_objections(*made(spark, sf)))


@query(MADE + """SELECT doc_id, 'guard-D42-' || arg_min(claim_id, pos) AS plan_id, subject AS title, string_agg(claim_id, ',' ORDER BY pos) AS claims FROM e WHERE kind = 'script' OR att = 3 GROUP BY doc_id, subject""")
def q_guard_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Reusable scripts by goal and audience."""
    return listed(P.guard_scripts(*made(spark, sf)))


@query(
    MADE + """SELECT doc_id, 'guard-D21-' || arg_min(claim_id, pos) AS plan_id, arg_min(topic, pos) || '维度' AS title, string_agg(claim_id, ',' ORDER BY pos) AS claims FROM e WHERE kind = 'term' AND att = 2 GROUP BY doc_id, anchor HAVING count(*) > 1"""
)
def q_guard_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """P5: value domains of two or more coded terms."""
    return listed(P.guard_dimensions(*made(spark, sf)))


@query(
    MADE
    + """, s AS (SELECT DISTINCT doc_id, plan FROM e WHERE module = 'D3.2' AND kind = 'strategy')
    SELECT doc_id, 'guard-D13-' || arg_min(claim_id, pos) AS plan_id, arg_min(topic, pos) || '规则集' AS title, string_agg(claim_id, ',' ORDER BY pos) AS claims FROM e JOIN s USING (doc_id, plan) WHERE kind = 'rule' AND att = 1 GROUP BY doc_id, plan HAVING count(*) > 1"""
)
def q_guard_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Constraint rules that only a strategy holds."""
    return listed(P.guard_policies(*made(spark, sf)))


@query(MADE + """, p AS (SELECT DISTINCT doc_id, plan FROM e) SELECT doc_id, 'p' || plan AS plan_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY plan) - 1) // 10 AS INT) AS batch FROM p""")
def q_realization_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans in batches of ten."""
    return P.realization_batches(made(spark, sf)[0]).select("doc_id", "plan_id", "batch")


@query(MADE + """SELECT DISTINCT doc_id, 'a' || k AS anchor_id FROM e, range(4) r(k) WHERE 'a' || k NOT IN (SELECT x.anchor FROM e x WHERE x.doc_id = e.doc_id AND x.kind = 'term')""")
def q_unclaimed_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of each document that no term cites."""
    claims = made(spark, sf)[1]
    anchors = claims.select("doc_id", F.explode(F.array(*[F.lit(f"a{k}") for k in range(4)])).alias("anchor_id")).distinct()
    return K.unclaimed_anchors(anchors, claims.where("claim_kind = 'term'"), claims.limit(0).select("doc_id", F.lit("{}").alias("raw")))


MENTIONS = """WITH m AS (SELECT s_nationkey AS doc_id, s_suppkey AS pos, 'Org  ' || s_suppkey % 40 AS said, s_suppkey % 2 = 0 AS lead, 'KO' || s_suppkey % 7 AS object_id FROM supplier
    UNION ALL SELECT c_nationkey, 100000000 + c_custkey, ' org ' || c_custkey % 60, c_custkey % 2 = 0, 'KO' || c_custkey % 7 FROM customer),
    n AS (SELECT *, trim(said) AS mention, 'BE-' || upper(left(sha256('w|org|' || lower(trim(regexp_replace(said, ' +', ' ', 'g')))), 16)) AS entity_id FROM m) """


def mentioned(spark: SparkSession, sf: str) -> DataFrame:
    from claimforge.functions.ids import entity_id

    def side(table: str, key: str, nation: str, shift: int, word: str, n: int) -> DataFrame:
        k = F.col(key)
        return read_table(spark, sf, table).select(F.col(nation).alias("doc_id"), F.lit("w").alias("workspace_id"), (k + shift).alias("pos"), (k + shift).alias("candidate_id"), F.lit(0).alias("n"), F.lit("org").alias("type"), F.concat(F.lit(word), (k % n).cast("string")).alias("text"), F.when(k % 2 == 0, "lead").otherwise("aid").alias("role"), F.concat(F.lit("A"), F.col(nation).cast("string")).alias("anchor"), F.concat(F.lit("KO"), (k % 7).cast("string")).alias("knowledge_object_id"))

    both = side("supplier", "s_suppkey", "s_nationkey", 0, "Org  ", 40).unionByName(side("customer", "c_custkey", "c_nationkey", 100000000, " org ", 60))
    return both.withColumn("entity_id", entity_id(F.col("workspace_id"), F.col("type"), F.col("text")))


@query(
    MENTIONS
    + """SELECT entity_id, arg_min(mention, (doc_id, pos)) AS canonical_name, list_aggregate(list_sort(list_distinct(list(mention))), 'string_agg', '|') AS mentions, CASE WHEN bool_or(doc_id = 3) THEN 'reused' ELSE 'created' END AS action FROM n GROUP BY entity_id"""
)
def q_entities(spark: SparkSession, sf: str) -> DataFrame:
    """A2, SF9, F4: mentions of one name, however spaced or cased, are one entity, named by the first."""
    m = mentioned(spark, sf)
    return M.entities(m, m.where("doc_id = 3")).select("entity_id", "canonical_name", F.array_join("source_mentions", "|").alias("mentions"), "action")


@query(MENTIONS + """SELECT object_id AS knowledge_object_id, entity_id, CASE WHEN lead THEN 'lead' ELSE 'aid' END AS role, list_aggregate(list_sort(list_distinct(list('A' || doc_id))), 'string_agg', ',') AS evidence FROM n GROUP BY ALL""")
def q_entity_references(spark: SparkSession, sf: str) -> DataFrame:
    """The anchors at which an object refers to an entity in a role."""
    m = mentioned(spark, sf)
    refs = M.entity_references(m.drop("knowledge_object_id"), m.select("doc_id", "candidate_id", "knowledge_object_id"))
    return refs.select("knowledge_object_id", F.explode("entity_references").alias("r")).select("knowledge_object_id", "r.entity_id", "r.role", F.array_join("r.evidence", ",").alias("evidence"))


@query(
    """WITH a AS (SELECT p_brand || '|' || p_size AS k, min(p_partkey) AS new_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p_brand || '|' || p_size AS k, min(p_partkey) AS old_id FROM part WHERE p_partkey % 2 = 1 GROUP BY 1 HAVING count(*) = 1)
    SELECT new_id, old_id FROM a JOIN b USING (k)"""
)
def q_slot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Brands and sizes of one new (even) and one stored (odd) part."""
    p = read_table(spark, sf, "part").select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("slot"), "p_partkey")
    side = lambda rest, name: p.where(F.col("p_partkey") % 2 == rest).withColumnRenamed("p_partkey", name)
    return relational.unique_slots(side(0, "new_id"), side(1, "old_id"), ["slot"], "new_id", "old_id")


EDGES = """WITH g AS (SELECT r_name AS src, 'N' || n_nationkey AS dst, 'CONTAINS' AS type, NULL AS role FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'REFERS_TO', c_mktsegment FROM customer WHERE c_acctbal > 9000), first AS (SELECT min(r_name) AS p FROM region), own AS (SELECT dst FROM g, first WHERE src = p AND type = 'CONTAINS') """


def edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    r, n, c = (read_table(spark, sf, t) for t in ("region", "nation", "customer"))
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    inside = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("src"), key("N", "n_nationkey").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("string").alias("role"))
    refers = c.where("c_acctbal > 9000").select(key("N", "c_nationkey").alias("src"), key("C", "c_custkey").alias("dst"), F.lit("REFERS_TO").alias("type"), F.col("c_mktsegment").alias("role"))
    nodes = n.select(key("N", "n_nationkey").alias("id"), F.col("n_name").alias("props"))
    return inside.unionByName(refers), nodes, r.agg(F.min("r_name")).first()[0]


@query(EDGES + """SELECT own.dst AS object_id, g.dst AS entity_id, g.role, n_name AS props FROM own LEFT JOIN g ON g.src = own.dst AND g.type = 'REFERS_TO' LEFT JOIN nation ON 'N' || n_nationkey = own.dst""")
def q_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of a package and the entities that they refer to, if any."""
    made_edges, nodes, package = edges(spark, sf)
    return R.one_hop(made_edges, nodes, package).select("object_id", "entity_id", "role", "props")


@query(EDGES + """SELECT src, dst, type FROM g, first WHERE (src = p AND type = 'CONTAINS') OR src IN (SELECT dst FROM own)""")
def q_edges_around(spark: SparkSession, sf: str) -> DataFrame:
    """J22, SL3: edges of a package and of its objects."""
    made_edges, _, package = edges(spark, sf)
    return R.edges_around(made_edges, package).select("src", "dst", "type")


@query(
    """WITH t AS (SELECT user_id AS document_id, event_id, event_type AS group_pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt FROM events), n AS (SELECT *, 'call-' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY group_pos, attempt) AS VARCHAR), 3, '0') AS call_id FROM t)
    SELECT event_id, call_id, lag(call_id) OVER (PARTITION BY document_id, group_pos ORDER BY attempt) AS retry_of FROM n"""
)
def q_trace_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as calls, those of one type as attempts."""
    e = read_table(spark, sf, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("group_pos"))
    tried = e.withColumn("attempt", F.row_number().over(Window.partitionBy("document_id", "group_pos").orderBy("event_id")))
    return gateways.trace(tried).select("event_id", "call_id", "retry_of")


@query(
    """SELECT event_type AS purpose, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(user_id % 7) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 1000) AS BIGINT) AS duration_ms, count(*) FILTER (value <= 50) AS failures FROM events GROUP BY event_type"""
)
def q_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens, time and failures by purpose."""
    e = read_table(spark, sf, "events")
    return gateways.usage(e.select(F.col("event_type").alias("purpose"), F.col("user_id").alias("prompt_tokens"), (F.col("user_id") % 7).alias("completion_tokens"), (F.col("event_id") % 1000).alias("duration_ms"), (F.col("value") > 50).alias("ok")))


@query(
    """SELECT p_partkey AS doc_id, n AS number, CASE n WHEN '1' THEN p_name || '吗' ELSE p_type END AS question, CASE n WHEN '1' THEN p_brand || p_size ELSE 'no' END AS answer FROM part, (VALUES ('1'), ('2')) v(n)"""
)
def q_numbered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered questions and answers of a section, line breaks taken out."""
    p = read_table(spark, sf, "part")
    section = F.concat(F.lit("intro\nQ1："), "p_name", F.lit("吗\nA1："), "p_brand", F.lit("\n"), F.col("p_size").cast("string"), F.lit("\nQ2："), "p_type", F.lit("\nA2：no"))
    return K.numbered_pairs(p.select(F.col("p_partkey").alias("doc_id"), F.lit("a").alias("anchor_id"), F.lit(0).alias("pos"), section.alias("section"))).select("doc_id", "number", "question", "answer")


@query("""SELECT p_partkey AS doc_id, 'X' || p_size || '热线' AS term, replace(p_brand, '#', '') AS definition FROM part WHERE p_partkey % 3 <> 0""")
def q_internal_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that a text defines, where its anchor has no term claim."""
    p = read_table(spark, sf, "part").withColumn("doc_id", F.col("p_partkey"))
    section = F.concat(F.lit("其中X"), F.col("p_size").cast("string"), F.lit("的热线是"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("，其余不变"))
    claims = p.where("p_partkey % 3 = 0").select("doc_id", F.lit("term").alias("claim_kind"), F.array(F.struct(F.lit("a").alias("anchor_id"))).alias("evidence"))
    return K.internal_terms(p.select("doc_id", F.lit("a").alias("anchor_id"), F.lit(0).alias("pos"), section.alias("section")), claims).select("doc_id", "term", "definition")


@query(
    """WITH t AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), '') AS head, url FROM pages) SELECT page_id, CASE WHEN head = '' OR page_id % 4 = 0 THEN url ELSE head END AS heading FROM t"""
)
def q_first_heading(spark: SparkSession, sf: str) -> DataFrame:
    """The first heading in a list of Markdown texts, else the subject."""
    h = F.trim(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1))
    marked = F.array(F.lit("no heading\n#"), F.when(F.col("page_id") % 4 == 0, h).otherwise(F.concat(F.lit("words\n  ## "), h, F.lit("  \n# later"))))
    return read_table(spark, sf, "pages").select("page_id", text.first_heading(F.when(h == "", F.array(F.lit(""))).otherwise(marked), F.col("url")).alias("heading"))


@query(
    """SELECT conv_id, turn, regexp_matches(s, '(\\?|？|吗|呢)$') OR regexp_matches(s, '^(如何|怎么|为什么|是否|能否|可以|可不可以)') OR regexp_matches(s, '几年|多少|多久|多长') AS asks
    FROM (SELECT conv_id, turn, trim(CASE turn % 4 WHEN 0 THEN '如何 ' ELSE '' END || text || CASE turn % 3 WHEN 0 THEN '？ ' WHEN 1 THEN ' 多久 .' ELSE '' END, chr(32) || chr(10)) AS s FROM conversations)"""
)
def q_asks(spark: SparkSession, sf: str) -> DataFrame:
    """SF33: questions by their ends, starts and parts."""
    t = F.col("turn")
    said = F.concat(F.when(t % 4 == 0, "如何 ").otherwise(""), "text", F.when(t % 3 == 0, "？ ").when(t % 3 == 1, " 多久 .").otherwise(""))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", text.question_like(said).alias("asks"))


@query(
    """SELECT event_id, coalesce(description, '') = '' AS lacks_description, coalesce(reason, '') = '' AS lacks_reason, NOT known AS lacks_anchor FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS description, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS reason, event_id % 11 <> 0 AS known FROM events)
    WHERE coalesce(description, '') = '' OR coalesce(reason, '') = '' OR NOT known"""
)
def q_auxiliary(spark: SparkSession, sf: str) -> DataFrame:
    """Open items without description or reason, or with an anchor that the document lacks."""
    e = read_table(spark, sf, "events")
    items = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise("").alias("description"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("reason"), F.array(F.when(F.col("event_id") % 11 == 0, "x").otherwise("a")).alias("evidence"))
    bad = C.auxiliary(items, e.select(F.col("user_id").alias("doc_id"), F.lit("a").alias("anchor_id")).distinct())[1]
    blank: Column = F.coalesce(F.trim("description"), F.lit("")) == ""
    return bad.select(F.col("pos").alias("event_id"), blank.alias("lacks_description"), F.col("reason").isNull().alias("lacks_reason"), F.array_contains("evidence", "x").alias("lacks_anchor"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'o' || o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'P' THEN 'forbidden' ELSE 'unexpected' END AS kind FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 1)"""
)
def q_strays(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: orders that groups forbid (partial ones), and those that no group expects (odd open ones)."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("candidate_id"), "o_orderstatus", "o_orderkey")
    negative = F.col("o_orderstatus") == "P"
    expected = negative | (F.col("o_orderstatus") == "F") | (F.col("o_orderkey") % 2 == 0)
    scored = o.where(expected).groupBy("doc_id", negative.alias("negative")).agg(F.collect_list("candidate_id").alias("candidate_ids")).withColumn("structural_ids", F.col("candidate_ids"))
    return Q.strays(scored, o)


@query("""SELECT doc_id, seg AS "index", 'a' || k AS anchor_id FROM (SELECT doc_id, unnest(generate_series(1, 1 + doc_id % 3)) AS seg, doc_id % 3 = 0 AS lone FROM documents), range(4) r(k) WHERE lone OR k = seg""")
def q_segment_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors that a segment cites; all of them where a document is one segment."""
    d = read_table(spark, sf, "documents").select("doc_id")
    cut = d.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int"))).alias("index")).withColumn("cited_anchors", F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("a"), F.col("index").cast("string")))))
    anchors = d.select("doc_id", F.explode(F.array(*[F.lit(f"a{k}") for k in range(4)])).alias("anchor_id"))
    return S.segment_anchors(cut, anchors, "doc_id").select("doc_id", "index", "anchor_id")


@query(
    """WITH t AS (SELECT p_partkey, (['D1.1', 'D9.9', 'D4.2', 'D4.1'])[1 + p_partkey % 4] AS module, (['PRODUCT_FACT', 'QA_PAIR', 'TERM'])[1 + p_size % 3] AS kind, CASE WHEN p_size % 5 = 0 THEN 'D1' ELSE 'D4' END AS domain FROM part),
    u AS (SELECT *, CASE WHEN module <> 'D9.9' AND left(module, 2) <> domain THEN 'the domain isn''t the module''s' END AS b, CASE WHEN module <> CASE kind WHEN 'PRODUCT_FACT' THEN 'D1.1' WHEN 'QA_PAIR' THEN 'D4.2' ELSE 'D4.1' END THEN 'object type not allowed in the module: ' || kind END AS c FROM t)
    SELECT p_partkey, concat_ws('; ', CASE WHEN module = 'D9.9' THEN 'unknown module: D9.9' END, b, c) AS issues FROM u"""
)
def q_classification(spark: SparkSession, sf: str) -> DataFrame:
    """PF12, J20: modules, domains and object types against the catalog."""
    of = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))
    p = read_table(spark, sf, "part").select("p_partkey", of(["D1.1", "D9.9", "D4.2", "D4.1"], "p_partkey").alias("module"), of(["PRODUCT_FACT", "QA_PAIR", "TERM"], "p_size").alias("object_type"), F.when(F.col("p_size") % 5 == 0, "D1").otherwise("D4").alias("domain"))
    return P.classification(RuleSet.built_in(), p).select("p_partkey", F.array_join("class_issues", "; ").alias("issues"))


@query(
    """WITH t AS (SELECT p_partkey, p_name AS subject, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS version, CASE WHEN p_size % 3 > 0 THEN p_type END AS theme FROM part),
    u AS (SELECT *, sha256('["' || subject || '",' || coalesce('"' || version || '"', 'null') || ',' || coalesce('"' || theme || '"', 'null') || ']') AS identity FROM t)
    SELECT p_partkey, concat_ws(',', CASE WHEN coalesce(version, '') = '' THEN 'versionScope' END, CASE WHEN theme IS NULL THEN 'factTheme' END) AS missing, identity AS identity_key, sha256('D1.1|PRODUCT_FACT|A9|' || identity) AS lineage_key, 'KO-' || upper(left(sha256('w|PRODUCT_FACT|' || identity), 16)) AS own_object_id FROM u"""
)
def q_identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    """PF13, SF2, SF5, SF6: identity fields that are absent or empty, and the keys that identity and first anchor lead to."""
    version = F.when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 > 1, F.col("p_brand"))
    hints = F.to_json(F.struct(F.col("p_name").alias("subject"), version.alias("versionScope"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("factTheme")))
    p = read_table(spark, sf, "part").select("p_partkey", F.lit("w").alias("workspace_id"), F.lit("D1.1").alias("module"), F.lit("PRODUCT_FACT").alias("object_type"), hints.alias("identity_hints"), F.array(F.lit("A10"), F.lit("A9")).alias("evidence"))
    lacks = P.identity_missing(RuleSet.built_in(), p).select("p_partkey", F.array_join("missing_identity", ",").alias("missing"))
    return M.keyed(p, RuleSet.built_in()).select("p_partkey", "identity_key", "lineage_key", "own_object_id").join(lacks, "p_partkey")


DUTIES = """WITH t AS (SELECT p_partkey // 100 AS doc_id, p_partkey AS pos, CASE p_partkey % 7 WHEN 0 THEN 'FAQ' WHEN 3 THEN '客户异议' WHEN 5 THEN '其他' END AS mark, CASE WHEN p_size % 2 = 0 THEN p_name || '？' ELSE p_name END AS b, p_brand AS c, CASE WHEN p_size % 3 > 0 THEN p_type END AS d FROM part),
    u AS (SELECT *, last_value(CASE WHEN mark <> '其他' THEN mark END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS label FROM t) """


@query(
    DUTIES
    + """SELECT doc_id, pos, 0 AS duty, 'strategy' AS claim_kind, b AS question, c AS response FROM u WHERE d IS NOT NULL AND coalesce(label, '') <> '客户异议'
    UNION ALL SELECT doc_id, pos, 1, 'qa', b, c FROM u WHERE label = 'FAQ'
    UNION ALL SELECT doc_id, pos, 2, 'objection', b, d FROM u WHERE d IS NOT NULL AND label = '客户异议'
    UNION ALL SELECT doc_id, pos, 3, 'qa', b, d FROM u WHERE d IS NOT NULL AND label = '客户异议' AND b LIKE '%？'"""
)
def q_table_duties(spark: SparkSession, sf: str) -> DataFrame:
    """What the rows of a table owe, under the label that holds for them."""
    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    mark = F.when(k % 7 == 0, "FAQ").when(k % 7 == 3, "客户异议").when(k % 7 == 5, "其他")
    line = lambda c, v: F.when(v.isNotNull(), F.concat(F.lit(f"- **{c}列**："), v))
    section = F.concat_ws("\n", line("A", mark), line("B", F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("？"))).otherwise(F.col("p_name"))), line("C", F.col("p_brand")), line("D", F.when(F.col("p_size") % 3 > 0, F.col("p_type"))))
    rows = p.select(F.floor(k / 100).alias("doc_id"), F.concat(F.lit("a"), k.cast("string")).alias("anchor_id"), k.alias("pos"), section.alias("section"))
    return K.table_duties(rows).select("doc_id", "pos", "duty", "claim_kind", "question", "response")


@query(
    """WITH t AS (SELECT conv_id, turn, text, turn % 2 + 1 AS part, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM conversations WHERE length(trim(text)) > 0)
    SELECT conv_id AS doc_id, 'S' || part || '-k' || n AS claim_id, turn % 5 <> 4 AS accepted FROM t"""
)
def q_validate_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as claims of two segments that number alike, quoted from their own section, or from none."""
    c = read_table(spark, sf, "conversations").where("length(trim(text)) > 0").withColumn("part", (F.col("turn") % 2 + 1).cast("int"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn"))).withColumn("anchor_id", F.concat(F.lit("a"), F.col("turn").cast("string")))
    quote = F.when(F.col("turn") % 5 == 4, F.lit("§§ nowhere §§")).otherwise(F.trim("text"))
    item = F.struct(F.concat(F.lit("k"), F.col("n").cast("string")).alias("claimId"), F.lit("fact").alias("claimKind"), F.lit("s").alias("statement"), F.lit("t").alias("subject"), F.array(F.struct(F.col("anchor_id").alias("anchorId"), quote.alias("exactQuote"), F.lit(" ").alias("selector"))).alias("evidence"))
    raw = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "part", F.lit(2).alias("segments"), F.to_json(item).alias("raw"))
    good, bad = K.validate(raw, c.select(F.col("conv_id").alias("doc_id"), "part", "anchor_id", F.col("text").alias("section")), ["D1.1"])
    return good.select("doc_id", "claim_id", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", "claim_id", F.lit(False).alias("accepted")))


@query(
    """WITH t AS (SELECT p_partkey AS doc_id, p_size % 4 AS k, p_name FROM part) SELECT doc_id, CASE WHEN k = 3 THEN 'INVALID-' || doc_id ELSE 'p' || doc_id END AS plan_id, CASE WHEN k <> 3 THEN p_name END AS title, CASE WHEN k IN (0, 1) THEN 2 ELSE 0 END AS n_claims, CASE WHEN k < 2 THEN 0 ELSE 1 END AS n_issues FROM t"""
)
def q_parse_plans(spark: SparkSession, sf: str) -> DataFrame:
    """T12, SF18: plans as objects, as compact arrays, without a list of claims, and as no JSON."""
    k, name = F.col("p_size") % 4, K.text_json(F.col("p_name"))
    own = F.concat(F.lit('"p'), F.col("p_partkey").cast("string"), F.lit('"'))
    whole = lambda claims: F.concat(F.lit('{"planId":'), own, F.lit(',"title":'), name, F.lit(',"module":"D1.1","objectType":"TERM","sourceClaimIds":' + claims + "}"))
    raw = F.when(k == 0, whole('["a","b"]')).when(k == 1, F.concat(F.lit("["), own, F.lit(","), name, F.lit(',"D1.1","TERM",{},["a","b"]]'))).when(k == 2, whole('"a"')).otherwise("{")
    parsed = read_table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), P.parse_plan(raw, F.col("p_partkey")).alias("p"))
    return parsed.select("doc_id", "p.plan_id", "p.title", F.size("p.claim_ids").alias("n_claims"), F.size("p.issues").alias("n_issues"))


@query(
    MADE
    + """, a AS (SELECT doc_id, pos, module, branches, claim_id, 'p' || (CASE WHEN pos % 4 = 0 THEN 99 ELSE plan END) AS plan_id, CASE WHEN pos % 11 = 5 THEN []::VARCHAR[] WHEN pos % 6 = 1 THEN ['zz', claim_id] ELSE [claim_id] END AS ids, pos % 5 <> 0 AS known FROM e),
    u AS (SELECT *, list_sort(list_filter(ids, lambda x: x = 'zz' OR NOT known)) AS unknown FROM a),
    b AS (SELECT *, list_filter([CASE WHEN plan_id = 'p99' THEN 'unknown plan' END, CASE WHEN len(ids) = 0 THEN 'no claims' END, CASE WHEN len(unknown) > 0 THEN 'unknown claims: ' || array_to_string(unknown, ', ') END], lambda x: x IS NOT NULL) AS basic FROM u)
    SELECT doc_id, pos AS nth, plan_id, CASE WHEN len(basic) > 0 THEN array_to_string(basic, '; ') ELSE 'conversation claims in a process plan: ' || claim_id END AS reasons FROM b WHERE len(basic) > 0 OR (module = 'D1.2' AND branches)"""
)
def q_augment_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """P10: additions to plans that are refused whole: unknown plans, no claims, unknown claims, conversation branches in processes."""
    rows = lines_as_claims(spark, sf)
    plan_id = F.concat(F.lit("p"), F.when(F.col("pos") % 4 == 0, 99).otherwise(F.col("plan")).cast("string"))
    ids = F.when(F.col("pos") % 11 == 5, F.array().cast("array<string>")).when(F.col("pos") % 6 == 1, F.array(F.lit("zz"), "claim_id")).otherwise(F.array("claim_id"))
    more = rows.select("doc_id", F.col("pos").alias("nth"), plan_id.alias("plan_id"), ids.alias("claim_ids"))
    bad = P.augment_plans(lines_as_plans(rows), more, rows.where("pos % 5 <> 0").drop("plan", "module", "object_type"))[1]
    return bad.select("doc_id", "nth", "plan_id", F.array_join("reasons", "; ").alias("reasons"))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as accepted candidates of their customers; a third have a relation: to themselves, to a mention or to nothing."""
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    to = F.when(k % 5 == 0, F.lit("gone")).when(k % 2 == 0, F.lit("m")).otherwise(F.concat(F.lit("o"), k.cast("string")))
    link = F.struct(F.lit("formal").alias("kind"), F.lit("ABOUT").alias("type"), F.concat(F.lit("o"), k.cast("string")).alias("source"), to.alias("target"), F.array(F.lit("a")).alias("evidence"))
    mention = F.struct(*[F.lit(v).alias(n) for n, v in {"mention_id": "m", "text": "t", "type": "org", "role": "r", "anchor": "a"}.items()])
    return o.select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.concat(F.lit("o"), k.cast("string")).alias("candidate_id"), F.when(k % 3 == 0, F.array(link)).otherwise(F.array().cast("array<" + "struct<kind string, type string, source string, target string, evidence array<string>>" + ">")).alias("relations"), F.array(mention).alias("mentions"))


@query("""SELECT o_custkey AS doc_id, 'o' || o_orderkey AS candidate_id, CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END AS dangling, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS kept FROM orders""")
def q_dangling_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose ends are no accepted candidates or mentions are taken out and counted."""
    return C.drop_dangling(priced(spark, sf)).select("doc_id", "candidate_id", "dangling", F.size("relations").alias("kept"))


@query(
    """SELECT o_custkey AS doc_id, 'c' || o_orderkey % 9 AS claim_id, arg_min('candidate rejected: ' || o_orderpriority || '；x', o_orderkey) AS reason FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = orders.o_custkey AND u.o_orderstatus = 'F' AND u.o_orderkey % 9 = orders.o_orderkey % 9) GROUP BY 1, 2
    UNION ALL SELECT o_custkey, 'c' || o_orderkey % 9, 'no plan covers the claim' FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = orders.o_custkey AND u.o_orderstatus IN ('F', 'P') AND u.o_orderkey % 9 = orders.o_orderkey % 9) GROUP BY 1, 2"""
)
def q_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """Open claims by their first reason: of rejected candidates (P), then uncovered (O), without used ones (F)."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("c"), (F.col("o_orderkey") % 9).cast("string")).alias("claim_id"), "o_orderstatus", "o_orderpriority")
    of = lambda status: o.where(F.col("o_orderstatus") == status)
    accepted = of("F").select("doc_id", "pos", F.array("claim_id").alias("used_claims"), F.array().cast("array<struct<claim_id string, reason string>>").alias("unresolved"))
    return C.unresolved(accepted, of("P").select("doc_id", "pos", F.array("claim_id").alias("claim_ids"), F.array("o_orderpriority", F.lit("x")).alias("reasons")), of("O").select("doc_id", "pos", "claim_id"))


@query(
    """SELECT source, doc_id, CASE WHEN length(text) > 240 THEN left(text, 160) ELSE text END AS head, CAST(len(list_filter(string_split_regex(text, '\r\n|\n|\r'), lambda x: length(trim(x)) > 0)) AS INT) AS n_lines, source LIKE 'src1%' OR source LIKE 'src2%' AS starts, contains(text, 'the') OR contains(text, 'der') AS has FROM documents WHERE text IS NOT NULL"""
)
def q_text_tests(spark: SparkSession, sf: str) -> DataFrame:
    """SF12, SF13, SF16, PF10: containment, prefixes, lines and previews."""
    t = F.col("text")
    d = read_table(spark, sf, "documents").where("text is not null")
    return d.select("source", "doc_id", F.when(F.length(t) > 240, text.preview(t)).otherwise(t).alias("head"), F.size(text.lines(t)).alias("n_lines"), text.starts_with_any(F.col("source"), ("src1", "src2")).alias("starts"), text.contains_any(t, ("the", "der")).alias("has"))


@query(
    """SELECT 'KR-' || upper(left(sha256('ABOUT|KO' || o_orderkey || '|' || t), 20)) AS relationship_id, 'KO' || o_orderkey AS source_ref, t AS target_ref, 'HAS_KNOWLEDGE' AS inverse_label, CASE WHEN o_orderkey % 2 = 1 THEN 4 END AS target_revision
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BE' || o_custkey ELSE 'KO' || o_orderkey END AS t FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)"""
)
def q_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose ends are objects or entities, with ids, inverse labels and revisions."""
    found = priced(spark, sf)
    sources = found.select("doc_id", "candidate_id", F.concat(F.lit("KO"), F.col("pos").cast("string")).alias("knowledge_object_id"))
    told = found.select("doc_id", F.lit("m").alias("mention_id"), F.concat(F.lit("BE"), F.col("doc_id").cast("string")).alias("entity_id"))
    made_links = M.relationships(found, sources, told, sources.select("knowledge_object_id", F.lit(4).alias("revision")))
    return made_links.select("relationship_id", "source_ref", "target_ref", "inverse_label", "target_revision")


def parts_as_candidates(spark: SparkSession, sf: str, again: bool = False) -> DataFrame:
    """Parts as candidates whose identity is their brand; a second time half of the brands have other contents."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    # a file of few row groups is few tasks; making and keying the candidates is most of the work
    p, k = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type").repartition("p_partkey"), F.col("p_partkey").cast("string")
    hints = F.to_json(F.struct(F.col("p_brand").alias("subject"), F.lit("v").alias("versionScope"), F.lit("f").alias("factTheme")))
    other = F.lit(again) & F.col("p_brand").rlike("[02468]$")
    content = F.to_json(F.struct(F.array(F.when(other, F.concat("p_type", F.lit("*"))).otherwise(F.col("p_type"))).alias("facts")))
    fixed = {"workspace_id": "w", "title": "t", "domain": "D1", "module": "D1.1", "object_type": "PRODUCT_FACT"}
    return p.select(
        F.concat(F.lit("D"), F.col("p_size").cast("string")).alias("doc_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("k"), k).alias("candidate_id"), *[F.lit(v).alias(n) for n, v in fixed.items()], hints.alias("identity_hints"), content.alias("content"),
        F.array(F.concat(F.lit("A"), (F.col("p_size") % 3).cast("string"))).alias("evidence"), none("struct<mention_id string, text string, type string, role string, anchor string>").alias("mentions"), none("string").alias("used_claims"),
        none("struct<claim_id string, role string, paths array<string>>").alias("usage"), F.lit(1).alias("leaf_count"), F.lit(1).alias("attributed_count"), F.when(F.col("p_partkey") % 50 == 0, F.array(F.lit("gap"))).otherwise(none("string")).alias("quality_issues"),
    )


NO_LINES = "workspace_id string, source_lineage_key string, knowledge_object_id string"
NO_ACTIVE = "doc_id string, knowledge_object_id string"


@query(
    """SELECT 'KO-' || upper(left(sha256('w|PRODUCT_FACT|' || sha256('["' || p_brand || '","v","f"]')), 16)) AS knowledge_object_id, 'created' AS action, list_aggregate(list_sort(list_distinct(list('A' || p_size % 3))), 'string_agg', ',') AS evidence, CAST(count(*) AS INT) AS members, count(*) > 1 AS merged, count(*) > 1 AND count(DISTINCT p_type) > 1 AS ambiguous
    FROM part WHERE p_partkey % 50 <> 0 GROUP BY p_brand"""
)
def q_form_objects(spark: SparkSession, sf: str) -> DataFrame:
    """F1, F2, A4, A5, A6, PF8: candidates of one identity become one object; those with quality issues form none."""
    from claimforge.plans.engine import STORED

    none = lambda schema: spark.createDataFrame([], schema)
    objects = M.form(parts_as_candidates(spark, sf), none(STORED), none(NO_LINES), none(NO_ACTIVE), RuleSet.built_in())["objects"]
    return objects.select("knowledge_object_id", "action", F.array_join("evidence", ",").alias("evidence"), F.size("candidate_ids").alias("members"), "merged", "ambiguous")


@query(
    """SELECT 'KO-' || upper(left(sha256('w|PRODUCT_FACT|' || sha256('["' || p_brand || '","v","f"]')), 16)) AS knowledge_object_id, CASE WHEN regexp_matches(p_brand, '[02468]$') THEN 'review_required' ELSE 'reused' END AS action, 1 AS revision FROM part WHERE p_partkey % 50 <> 0 GROUP BY p_brand"""
)
def q_form_again(spark: SparkSession, sf: str) -> DataFrame:
    """A second build reuses what is the same and sends changed contents to review."""
    from claimforge.plans.engine import STORED

    none = lambda schema: spark.createDataFrame([], schema)
    first = M.form(parts_as_candidates(spark, sf), none(STORED), none(NO_LINES), none(NO_ACTIVE), RuleSet.built_in())
    stored = first["objects"].select(*[c.split()[0] for c in STORED.split(", ")])
    again = M.form(parts_as_candidates(spark, sf, again=True), stored, first["lineages"], none(NO_ACTIVE), RuleSet.built_in())
    return again["objects"].select("knowledge_object_id", "action", "revision")


@query(
    """WITH n AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O') AS opened, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS partial FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'open' AS key, CAST(opened AS INT) AS predicted_count, CASE WHEN opened BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS matched_count, CASE WHEN opened = 0 THEN 'missed' WHEN opened > 5 THEN 'over_split' ELSE 'met' END AS status FROM n
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'partial', CAST(partial AS INT), 0, CASE WHEN partial > 0 THEN 'negative_hit' ELSE 'met' END FROM n"""
)
def q_evaluate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders against a group of one to five open orders and one that forbids partial ones."""
    wanted = [(0, False, '{"key":"open","module":"D1.1","objectTypes":["O"],"expectedCount":3,"minimumExpectedCount":1,"maximumExpectedCount":5}'), (1, True, '{"key":"partial","module":"D1.1","objectTypes":["P"],"evidence":["a0"],"expectedCount":0}')]
    groups = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")).crossJoin(F.broadcast(spark.createDataFrame(wanted, "group_pos int, negative boolean, g string")))
    k = F.col("o_orderkey").cast("string")
    found = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("o"), k).alias("candidate_id"), F.lit("D1.1").alias("module"), F.col("o_orderstatus").alias("object_type"), F.lit("{}").alias("identity_hints"), F.lit("{}").alias("content"), F.array(F.concat(F.lit("a"), (F.col("o_orderkey") % 2).cast("string"))).alias("evidence"), F.array().cast("array<struct<claim_id string, role string, paths array<string>>>").alias("usage"))
    claims = spark.createDataFrame([], "doc_id string, claim_id string, evidence array<struct<exact_quote string, source_text string>>")
    return Q.evaluate(groups, found, claims, spark.createDataFrame([], "doc_id string, anchor_id string")).select("doc_id", "key", "predicted_count", "matched_count", "status")


@query(
    """SELECT o_custkey AS doc_id, (['D1.1', 'D4.2', 'D3.2'])[1 + o_orderkey % 3] AS module, CASE min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'hit' WHEN 2 THEN 'weak_signal' ELSE 'unresolved' END AS status FROM orders GROUP BY 1, 2"""
)
def q_module_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest status of each module in each document, without modules that nothing touches."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.get(F.array(*[F.lit(m) for m in ("D1.1", "D4.2", "D3.2")]), (F.col("o_orderkey") % 3).cast("int")).alias("module"), "o_orderstatus")
    of = lambda status: o.where(F.col("o_orderstatus") == status)
    return C.coverage(of("F"), of("O"), of("P"), RuleSet.built_in()).where("status <> 'not_found'").select("doc_id", "module", "status")


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey) > 1 AS same_id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) > 1 AS same_content FROM orders)
    SELECT doc_id, pos, concat_ws('; ', CASE WHEN same_id THEN 'duplicate candidate id' END, CASE WHEN same_content THEN 'duplicate candidate content in the document' END) AS reasons FROM t WHERE same_id OR same_content"""
)
def q_judge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """C20: candidates whose id or content an earlier one of the document has."""
    k = F.col("o_orderkey")
    found = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.concat(F.lit("k"), (k % 7).cast("string")).alias("candidate_id"), F.lit("D1").alias("domain"), F.lit("D1.1").alias("module"), F.lit("PRODUCT_FACT").alias("object_type"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("content"), F.array().cast("array<string>").alias("issues"))
    return C.judge(found, RuleSet.built_in())[1].select("doc_id", "pos", F.array_join("reasons", "; ").alias("reasons"))


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, 'p' || o_orderkey % 11 AS plan_id, o_orderpriority AS subject, o_orderkey % 2 = 0 AS old FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, plan_id ORDER BY pos) > 1 OR EXISTS (SELECT 1 FROM t o WHERE o.old AND o.doc_id = n.doc_id AND o.plan_id = n.plan_id) AS same_id, row_number() OVER (PARTITION BY doc_id, subject ORDER BY pos) > 1 OR EXISTS (SELECT 1 FROM t o WHERE o.old AND o.doc_id = n.doc_id AND o.subject = n.subject) AS same FROM t n WHERE NOT n.old)
    SELECT doc_id, plan_id, concat_ws('; ', CASE WHEN same_id THEN 'duplicate repair plan id' END, CASE WHEN same THEN 'repair plan duplicates an existing object identity' END) AS reasons FROM f WHERE same_id OR same"""
)
def q_merge_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Repair plans whose id or identity the document already has."""
    k, hints = F.col("o_orderkey"), F.to_json(F.struct(F.col("o_orderpriority").alias("subject"), F.lit("x").alias("applicability")))
    plans = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.concat(F.lit("p"), (k % 11).cast("string")).alias("plan_id"), F.lit("t").alias("title"), F.lit("D4").alias("domain"), F.lit("D4.1").alias("module"), F.lit("TERM").alias("object_type"), hints.alias("identity_hints"), F.array(F.lit("c")).alias("claim_ids"))
    return P.merge_plans(plans.where("pos % 2 = 0"), plans.where("pos % 2 = 1"), RuleSet.built_in())[1].select("doc_id", "plan_id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    """WITH u AS (SELECT 'KO' || conv_id || '-' || turn AS k, text FROM conversations WHERE role = 'user' AND text <> '') SELECT 'RU-' || upper(left(sha256(k || '|' || left(sha256(text), 12) || '|$.items[0]'), 20)) AS retrieval_unit_id, k AS knowledge_object_id, '$.items[0]' AS content_path, left(text, 160) AS preview FROM u"""
)
def q_unit_listing(spark: SparkSession, sf: str) -> DataFrame:
    """R1, SF3, SL7, PF10: questions as retrieval units, listed by id."""
    c = read_table(spark, sf, "conversations").where("role = 'user' and text <> ''")
    content = F.concat(F.lit('{"items":[{"question":'), K.text_json(F.col("text")), F.lit(',"answer":"a"}]}'))
    objects = c.select(F.concat(F.lit("KO"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("knowledge_object_id"), F.col("conv_id").alias("doc_id"), F.lit("w").alias("workspace_id"), F.lit(1).alias("revision"), F.lit("QA_PAIR").alias("object_type"), F.lit("t").alias("title"), content.alias("content"))
    return R.unit_listing(R.retrieval_units(objects))


@query(
    """WITH t AS (SELECT l_partkey AS k, l_shipdate < TIMESTAMP '1998-01-01' AS early, l_quantity > 49 AS active FROM lineitem)
    SELECT DISTINCT k AS knowledge_object_id FROM t WHERE early AND k % 3 = 0 AND k NOT IN (SELECT k FROM t WHERE NOT early AND k % 2 = 0) AND k NOT IN (SELECT k FROM t WHERE active)"""
)
def q_superseded_parts(spark: SparkSession, sf: str) -> DataFrame:
    """J10, J11, SNK3h, SO3: parts of the early build that the later one lacks and that no active source (a large line) holds."""
    t = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("knowledge_object_id"), (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"), (F.col("l_quantity") > 49).alias("active"))
    before, now = t.where("early and knowledge_object_id % 3 = 0"), t.where("not early and knowledge_object_id % 2 = 0")
    return dml.superseded(before, now, t)


# By event_id modulo 15: module, object type and content, in which T stands for the event's type and U for its user.
CONTENTS = [
    ("D9.9", "NO_SUCH_TYPE", '{"subject":"T"}'),
    ("D1.1", "QA_PAIR", '{"items":[{"question":"T","answer":"a","claimRef":"c"}],"factReferences":["c"],"applicability":"T"}'),
    ("D4.2", "QA_PAIR", '{"items":[],"factReferences":{}}'),
    ("D4.2", "STANDARD_SCRIPT", '{"communicationGoal":" ","applicability":{"a":U},"script":[],"factReferences":[],"complianceConstraints":[]}'),
    ("D1.2", "BUSINESS_PROCESS", '{"purpose":U,"preconditions":"T","rulesOrSteps":["T"],"exceptions":[]}'),
    ("D4.2", "QA_PAIR", '{"items":["T",{"question":"T","answer":"a","claimRef":"c"},[U]],"factReferences":["c"],"applicability":"T"}'),
    ("D4.2", "QA_PAIR", '{"items":[{"question":"T","answer":""},{"question":"T","answer":"a","claimRef":"c"}],"factReferences":["c"],"applicability":"T"}'),
    ("D4.2", "QA_PAIR", '{"items":[{"question":U,"answer":"a","claimRef":false}],"factReferences":["c"],"applicability":"T"}'),
    ("D4.1", "CUSTOMER_OBJECTION", '{"objectionTheme":"T","expressions":["T"],"context":"c","rootConcernHypotheses":[],"resolutionElements":["T",{"element":"e","detail":"d"}]}'),
    ("D4.1", "CUSTOMER_OBJECTION", '{"objectionTheme":"T","expressions":["T"],"context":"c","rootConcernHypotheses":[{"hypothesis":U,"sourceStance":" "}],"resolutionElements":[{"element":"e","detail":"d"}]}'),
    ("D4.1", "CUSTOMER_OBJECTION", '{"objectionTheme":"T","expressions":["T"],"context":"c","rootConcernHypotheses":[],"resolutionElements":[{"element":"e","detail":"d","z":1,"b":"T"}]}'),
    ("D4.1", "CUSTOMER_OBJECTION", '{"objectionTheme":"T","expressions":[" T ",""],"context":"c","rootConcernHypotheses":[],"resolutionElements":[{"element":"e","detail":"T"},{"element":"e","detail":" T "}]}'),
    ("D1.2", "BUSINESS_PROCESS", '{"summary":"T"}'),
    ("D4.1", "CUSTOMER_OBJECTION", '{"objectionTheme":"T","expressions":["T"],"context":"c","rootConcernHypotheses":[],"resolutionElements":[{"element":"e","detail":"d"}]}'),
    ("D1.2", "BUSINESS_PROCESS", '{"purpose":"T","preconditions":[],"rulesOrSteps":null,"exceptions":[],"summary":"T"}'),
]
_case = lambda i: "CASE event_id % 15 " + " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(CONTENTS)) + " END"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
QA, BP = ["items", "factReferences", "applicability"], ["purpose", "preconditions", "rulesOrSteps", "exceptions"]
CO, SS = ["objectionTheme", "expressions", "context", "rootConcernHypotheses", "resolutionElements"], ["communicationGoal", "applicability", "script", "factReferences", "complianceConstraints"]
_rules = ", ".join(
    f"('{kind}', '{home}', {_list(required)}, {_list(may)}, {_list(texts)}, {_list(lists)}, {_list(objects)}, {_list(bare)}, {_list(items)})"
    for kind, home, required, may, texts, lists, objects, bare, items in [
        ("QA_PAIR", "D4.2", QA, [], ["applicability"], ["items", "factReferences"], [], [], ["question", "answer", "claimRef"]),
        ("BUSINESS_PROCESS", "D1.2", BP, ["preconditions", "exceptions"], ["purpose"], ["preconditions", "rulesOrSteps", "exceptions"], [], [], []),
        ("CUSTOMER_OBJECTION", "D4.1", CO, ["rootConcernHypotheses"], ["objectionTheme", "context"], ["expressions", "rootConcernHypotheses", "resolutionElements"], [], [], []),
        ("STANDARD_SCRIPT", "D4.2", SS, ["factReferences", "complianceConstraints"], ["communicationGoal", "script"], ["factReferences", "complianceConstraints"], ["applicability"], ["communicationGoal", "script"], []),
    ]
)
VIOLATIONS_SQL = f"""WITH e AS (SELECT event_id, {_case(0)} AS module, {_case(1)} AS object_type, replace(replace({_case(2)}, 'T', event_type), 'U', CAST(user_id AS VARCHAR))::JSON AS c FROM events),
    r AS (SELECT * FROM (VALUES {_rules}) t(object_type, home, required, may, texts, lists, objects, bare, item_fields)), m AS (SELECT * FROM e LEFT JOIN r USING (object_type)),
    typed AS (SELECT *, list_filter(required, lambda f: (list_contains(texts, f) AND json_type(c, '$.' || f) <> 'VARCHAR') OR (list_contains(lists, f) AND json_type(c, '$.' || f) <> 'ARRAY') OR (list_contains(objects, f) AND json_type(c, '$.' || f) <> 'OBJECT')) AS wrong FROM m),
    items AS (SELECT event_id, item_fields, unnest(generate_series(1, CAST(json_array_length(c, '$.items') AS BIGINT))) AS i, c -> '$.items' AS list FROM m WHERE object_type = 'QA_PAIR'), item AS (SELECT event_id, item_fields, i, json_extract(list, '$[' || (i - 1) || ']') AS x FROM items),
    lists AS (SELECT event_id, c, p.name, p.names FROM m, (VALUES ('rootConcernHypotheses', ['hypothesis', 'sourceStance', 'usageBoundary']), ('resolutionElements', ['element', 'detail'])) p(name, names) WHERE object_type = 'CUSTOMER_OBJECTION'),
    numbered AS (SELECT *, unnest(generate_series(1, CAST(json_array_length(c, '$.' || name) AS BIGINT))) AS i FROM lists), part AS (SELECT event_id, c, name, names, i, json_extract(c, '$.' || name || '[' || (i - 1) || ']') AS x FROM numbered),
    found AS (SELECT event_id, '$' AS place, 'no_contract' AS kind, []::VARCHAR[] AS fields FROM m WHERE home IS NULL
    UNION ALL SELECT event_id, '$', 'wrong_module', [] FROM m WHERE home <> module
    UNION ALL SELECT event_id, '$', 'missing', list_filter(required, lambda f: json_type(c, '$.' || f) IS NULL OR (NOT list_contains(may, f) AND CAST(json_extract(c, '$.' || f) AS VARCHAR) IN ('null', '""', '[]', '{{}}'))) FROM m WHERE home IS NOT NULL
    UNION ALL SELECT event_id, '$', 'blank', list_filter(bare, lambda f: json_type(c, '$.' || f) <> 'VARCHAR' OR trim(json_extract_string(c, '$.' || f)) = '') FROM m WHERE home IS NOT NULL
    UNION ALL SELECT event_id, '$', 'type', list_transform(wrong, lambda f: f || ' must be ' || CASE WHEN list_contains(texts, f) THEN 'text' WHEN list_contains(lists, f) THEN 'list' ELSE 'object' END) FROM typed WHERE home IS NOT NULL
    UNION ALL SELECT event_id, 'item ' || i, 'item_object', [] FROM item WHERE json_type(x) <> 'OBJECT'
    UNION ALL SELECT event_id, 'item ' || i, 'item_missing', list_filter(item_fields, lambda f: json_type(x, '$.' || f) IS NULL OR CAST(json_extract(x, '$.' || f) AS VARCHAR) IN ('null', '""', '[]', '{{}}')) FROM item WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT event_id, 'item ' || i, 'item_type', list_transform(list_filter(item_fields, lambda f: json_type(x, '$.' || f) <> 'VARCHAR'), lambda f: f || ' must be text') FROM item WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT event_id, name || ' ' || i, 'part_object', [] FROM part WHERE json_type(x) <> 'OBJECT'
    UNION ALL SELECT event_id, name || ' ' || i, 'part_missing', list_filter(names, lambda f: json_type(x, '$.' || f) IS NULL OR json_type(x, '$.' || f) <> 'VARCHAR' OR trim(json_extract_string(x, '$.' || f)) = '') FROM part WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT event_id, name || ' ' || i, 'part_other', list_sort(list_filter(json_keys(x), lambda k: NOT list_contains(names, k))) FROM part WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT event_id, name || ' ' || i, 'repeats', ['detail'] FROM part WHERE name = 'resolutionElements' AND json_type(x) = 'OBJECT' AND json_extract_string(x, '$.detail') IN (SELECT unnest(list_filter(list_transform(json_extract_string(c, '$.expressions[*]'), lambda s: trim(s)), lambda s: s <> '')))
    UNION ALL SELECT event_id, '$', 'summary_only', [] FROM m WHERE home IS NOT NULL AND json_keys(c) = ['summary'])
    SELECT event_id, place, kind, array_to_string(fields, ', ') AS fields FROM found WHERE len(fields) > 0 OR kind IN ('no_contract', 'wrong_module', 'item_object', 'part_object', 'summary_only')"""


@query(VIOLATIONS_SQL)
def q_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """PF14, SRC4: every kind of violation of a content contract, over contents made of events."""
    e = read_table(spark, sf, "events")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("module", "object_type", "content"), row)]) for row in CONTENTS])
    made = e.withColumn("row", F.get(rows, (F.col("event_id") % len(CONTENTS)).cast("int"))).select("event_id", "row.module", "row.object_type", F.replace(F.replace("row.content", F.lit("T"), "event_type"), F.lit("U"), F.col("user_id").cast("string")).alias("content"))
    # an inner explode would have the optimiser test the size of the list first, which evaluates every rule once more
    found = CC.with_violations(made, RuleSet.built_in()).select("event_id", F.explode_outer("violations").alias("v")).where("v is not null")
    return found.select("event_id", "v.place", "v.kind", F.array_join("v.fields", ", ").alias("fields"))


@query(
    """WITH g AS (SELECT DISTINCT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT DISTINCT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION SELECT DISTINCT 'C' || o_custkey, 'O' || o_orderstatus FROM orders),
    one AS (SELECT 'R' || r_regionkey AS start, dst AS node FROM region JOIN g ON src = 'R' || r_regionkey), two AS (SELECT DISTINCT start, dst AS node FROM one JOIN g ON src = node), three AS (SELECT DISTINCT start, dst AS node FROM two JOIN g ON src = node)
    SELECT 'R' || r_regionkey AS start, 'R' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT start, node, 1 FROM one UNION ALL SELECT start, node, 2 FROM two UNION ALL SELECT start, node, 3 FROM three"""
)
def q_reach(spark: SparkSession, sf: str) -> DataFrame:
    """What regions reach within three edges over nations, customers and the states of their orders."""
    t = lambda name: read_table(spark, sf, name)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    edges = edge(t("nation"), "R", "n_regionkey", "N", "n_nationkey").unionByName(edge(t("customer"), "N", "c_nationkey", "C", "c_custkey")).unionByName(edge(t("orders"), "C", "o_custkey", "O", "o_orderstatus"))
    return R.reach(edges, t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node")), 3)
