"""Queries over the test tables: each applies one or more of the engine's operators to whole tables, with SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimforge.functions import ids, json_ops, numbers, text
from claimforge.operators import claims as K, dml, relational as R, segments as S
from claimforge.sources.packages import camel, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MARKS = r"[\s，。；：、,.!?！？''\"“”‘’（）()]+"


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, length(text) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents),
    t AS (SELECT doc_id, s, len(s) AS k, CAST(ceil(n / 2000.0) AS INT) AS c, ceil(n / ceil(n / 2000.0)) AS target FROM d WHERE len(s) > 0),
    p AS (SELECT doc_id, s, k, c, target, 1 AS i, 1 AS seg, s[1] AS open FROM t
      UNION ALL
      SELECT doc_id, s, k, c, target, i + 1, CASE WHEN length(open) + 2 + length(s[i + 1]) > target AND seg < c THEN seg + 1 ELSE seg END,
        CASE WHEN length(open) + 2 + length(s[i + 1]) > target AND seg < c THEN s[i + 1] ELSE open || chr(10) || chr(10) || s[i + 1] END FROM p WHERE i < k)
    SELECT doc_id, CAST(seg AS INT) AS segment, CAST(length(arg_max(open, i)) AS INT) AS chars, sha256(arg_max(open, i)) AS digest FROM p GROUP BY doc_id, seg"""
)
def q_segment_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document as sections, packed into segments of about equal length."""
    docs = read_table(spark, sf, "documents")
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    cut = docs.select("doc_id", F.posexplode(S.packed(parts, F.length("text"), 2000)).alias("n", "segment_text"))
    return cut.select("doc_id", (F.col("n") + 1).alias("segment"), F.length("segment_text").alias("chars"), F.sha2("segment_text", 256).alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    s AS (SELECT doc_id, CAST(n // 3 AS INT) AS pos, 'A' || ((n // 3) % 4) AS anchor_id, string_agg(line, chr(10) ORDER BY n) AS body FROM l GROUP BY doc_id, n // 3)
    SELECT doc_id, anchor_id, CAST(max(pos) AS INT) AS pos, CAST(length(arg_max(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), pos)) AS INT) AS body_chars FROM s GROUP BY doc_id, anchor_id"""
)
def q_anchor_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line opens an anchored section; of a repeated anchor the last section stands."""
    docs = read_table(spark, sf, "documents")
    mark = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 3 == 0, F.concat(F.lit("<!-- source-anchor: A"), (F.floor(i / 3) % 4).cast("string"), F.lit(" -->\n"), line)).otherwise(line))
    found = S.anchor_sections(docs.select("doc_id", F.array_join(mark, "\n").alias("markdown")), "doc_id", "markdown")
    body = text.strip_space(F.regexp_replace("section", r"^<!--[^>]*-->\n?", ""))
    return found.select("doc_id", "anchor_id", "pos", F.length(body).alias("body_chars"))


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events"""
)
def q_fill_down(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase at or before each event of a user."""
    events = read_table(spark, sf, "events").withColumn("label", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return R.fill_down(events, "user_id", "event_id", "label", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""SELECT doc_id, 'KO-' || upper(left(sha256('ws|' || lang || '|' || sha256(text)), 16)) AS object_id, 'KR-' || upper(left(sha256('ABOUT|' || source || '|' || lang), 20)) AS relationship_id FROM documents""")
def q_surrogate_id(spark: SparkSession, sf: str) -> DataFrame:
    """SF1, SF2: ids from hashes of joined parts."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", ids.object_id(F.lit("ws"), F.col("lang"), ids.sha(F.col("text"))).alias("object_id"), ids.relationship_id(F.lit("ABOUT"), F.col("source"), F.col("lang")).alias("relationship_id"))


@query("""SELECT doc_id, sha256(text) AS fingerprint, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS repeated FROM documents""")
def q_text_fingerprint_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """SF7, W2: rows after the first of their fingerprint."""
    d = read_table(spark, sf, "documents").select("doc_id", ids.sha(F.col("text")).alias("fingerprint"))
    return R.first_per_key(d, ["fingerprint"], ["doc_id"])


@query(f"""SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '{MARKS}', '', 'g')) AS digest FROM documents""")
def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """SF11: texts in evidence form."""
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(text.evidence_text(F.col("text")), 256).alias("digest"))


@query("""SELECT user_id, event_id, CAST(rank AS INT) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5""")
def q_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    """W4, SL2: the five latest events of each user."""
    return R.latest(read_table(spark, sf, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "rank")


@query("""SELECT event_id, user_id FROM events WHERE ts + INTERVAL 168 HOUR > (SELECT max(ts) FROM events)""")
def q_ttl_live(spark: SparkSession, sf: str) -> DataFrame:
    """PF4, SNK2: events alive 168 hours after they came, seen from the latest one."""
    e = read_table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL '168' HOUR"))
    now = e.agg(F.max("ts").alias("now"))
    return R.live(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id", "user_id")


@query(
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey + 1 + (SELECT max(c_custkey) FROM customer) AS c_custkey, c_name || '*', c_acctbal + 1 FROM customer WHERE c_custkey % 5 = 0"""
)
def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK1: changed and new customers replace or join the old ones."""
    old = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = old.select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    top = F.broadcast(old.agg(F.max("c_custkey").alias("top")))
    fresh = changed.where("c_custkey % 5 = 0").crossJoin(top).select((F.col("c_custkey") + 1 + F.col("top")).alias("c_custkey"), "c_name", "c_acctbal")
    return dml.upsert(old, changed.where("c_custkey % 3 = 0").unionByName(fresh), ["c_custkey"])


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer""")
def q_upsert_keep(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3b: an upsert that keeps the old value of one column."""
    old = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("other").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return dml.upsert(old, new, ["c_custkey"], keep=("c_name",))


@query(
    """SELECT DISTINCT o_custkey AS knowledge_object_id FROM orders o WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate >= TIMESTAMP '1996-01-01')
    AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000)"""
)
def q_superseded(spark: SparkSession, sf: str) -> DataFrame:
    """J10, J11, SNK3h: customers of old orders without new orders and without an active source (a high balance)."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("knowledge_object_id"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    active = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("knowledge_object_id"), (F.col("c_acctbal") > 5000).alias("active"))
    return dml.superseded(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), active)


@query("""SELECT n_nationkey AS relationship_id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) THEN 'active' ELSE 'inactive' END AS status FROM nation""")
def q_orphan_edges(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3g: nations without an active source become inactive."""
    rel = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("relationship_id"), F.lit("active").alias("status"))
    return dml.orphans(rel, read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("relationship_id"), (F.col("s_acctbal") > 9000).alias("active")))


@query("""SELECT event_id, event_type, CASE WHEN user_id % 7 = 3 THEN FALSE ELSE value > 50 END AS active FROM events""")
def q_deactivate(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3a: the occurrences of one package stop being active."""
    return dml.deactivate(read_table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.col("value") > 50).alias("active")), F.col("user_id") % 7 == 3).drop("user_id")


@query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no label covers."""
    return dml.dangling(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_semi_membership(spark: SparkSession, sf: str) -> DataFrame:
    """PF5: orders of the wanted customers."""
    wanted = read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.members(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", wanted)


@query(
    """WITH m AS (SELECT lower(trim(regexp_replace(s_name, '[0-9]+$', ''))) || (s_nationkey % 5) AS name, s_nationkey AS pos, s_name AS mention FROM supplier
    UNION ALL SELECT lower(trim(regexp_replace(c_name, '[0-9]+$', ''))) || (c_nationkey % 5), 100 + c_nationkey, c_name FROM customer)
    SELECT name, count(*) AS mentions, min(pos) AS first_pos, sha256(string_agg(DISTINCT mention, ',' ORDER BY mention)) AS digest FROM m GROUP BY name"""
)
def q_entity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A2, SF9: suppliers and customers as mentions of named groups."""

    def told(table: str, p: str, shift: int) -> DataFrame:
        t = read_table(spark, sf, table)
        base = text.entity_name(F.regexp_replace(f"{p}_name", "[0-9]+$", ""))
        return t.select(F.concat(base, (F.col(f"{p}_nationkey") % 5).cast("string")).alias("name"), (F.col(f"{p}_nationkey") + shift).alias("pos"), F.col(f"{p}_name").alias("mention"))

    m = told("supplier", "s", 0).unionByName(told("customer", "c", 100))
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.min("pos").alias("first_pos"), F.sha2(F.array_join(F.sort_array(F.collect_set("mention")), ","), 256).alias("digest"))


@query("""SELECT p_brand, count(*) AS members, count(DISTINCT p_type) AS contents, count(*) > 1 AND count(DISTINCT p_type) > 1 AS ambiguous FROM part GROUP BY p_brand""")
def q_ambiguous_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A4, A5: groups of several members with several contents."""
    g = read_table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("p_type").alias("contents"))
    return g.withColumn("ambiguous", (F.col("members") > 1) & (F.col("contents") > 1))


@query(
    """WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY o_custkey HAVING count(*) = 1), b AS (SELECT l_suppkey AS k, min(l_orderkey) AS l FROM lineitem WHERE l_quantity = 1 GROUP BY l_suppkey HAVING count(*) = 1)
    SELECT o AS order_id, l AS line_id FROM a JOIN b USING (k)"""
)
def q_unique_slot_join(spark: SparkSession, sf: str) -> DataFrame:
    """Slots that hold one row on each side."""
    a = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("order_id"))
    b = read_table(spark, sf, "lineitem").where("l_quantity = 1").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("line_id"))
    return R.unique_slots(a, b, ["k"], "order_id", "line_id")


@query(
    """SELECT DISTINCT a.l_orderkey AS a_id, b.l_orderkey AS b_id FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'"""
)
def q_array_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Returned and accepted orders whose (part, supplier) sets overlap."""
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_partkey", "l_suppkey").alias("e"))
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias(name)).agg(F.collect_set("e").alias("sets"))
    return R.overlaps(side("R", "a_id"), side("A", "b_id"), "a_id", "b_id", "sets")


@query(
    """WITH t AS (SELECT DISTINCT p_brand AS k, '$.' || replace(p_type, ' ', '.') AS path FROM part), u AS (SELECT DISTINCT k, regexp_replace(path, '\\.[^.]*$', '') AS up FROM t)
    SELECT DISTINCT t.k, t.path AS a, u.up AS b FROM t JOIN u ON t.k = u.k AND (t.path = u.up OR starts_with(t.path, u.up || '.') OR starts_with(u.up, t.path || '.'))"""
)
def q_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a key that are equal or contain each other."""
    t = read_table(spark, sf, "part").select(F.col("p_brand").alias("k"), F.concat(F.lit("$."), F.replace("p_type", F.lit(" "), F.lit("."))).alias("a")).distinct()
    return R.path_prefixes(t, t.select("k", F.regexp_replace("a", r"\.[^.]*$", "").alias("b")), "k", "a", "b")


@query()
def q_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """J15, SF25: parts of a type and size whose names are alike and like no third part's, each pair once."""
    p = read_table(spark, sf, "part").select("p_type", "p_size", "p_partkey", "p_name")
    a, b = (p.withColumnRenamed("p_partkey", n) for n in ("a_id", "b_id"))
    return R.fuzzy_unique(a, b, ["p_type", "p_size"], "a_id", "b_id", "p_name", 0.85, same=True)


@query(
    """SELECT n_nationkey AS nation, CASE max(CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) WHEN 3 THEN 'O' WHEN 2 THEN 'P' WHEN 1 THEN 'F' ELSE 'none' END AS status
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey"""
)
def q_coverage_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest order status of each nation's richest customers."""
    dims = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    rich = read_table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    facts = read_table(spark, sf, "orders").join(rich, "o_custkey").select("nation", F.col("o_orderstatus").alias("status"))
    return R.priority_rollup(dims, facts, "nation", "status", ["O", "P", "F"], "none")


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT count(*) AS split FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1))
    SELECT count(*) AS objects, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS single_claim, round(avg(n), 2) AS mean_claims, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 4) AS single_claim_rate, (SELECT split FROM s) AS split_anchors FROM g"""
)
def q_granularity(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as objects, lines as claims, parts as anchors."""
    lines = read_table(spark, sf, "lineitem")
    g = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("n") == 1).alias("single_claim"), F.round(F.avg("n"), 2).alias("mean_claims"))
    split = lines.select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").count().where("count > 1").agg(F.count(F.lit(1)).alias("split_anchors"))
    return g.withColumn("single_claim_rate", numbers.rate(F.col("single_claim"), F.col("objects"))).crossJoin(split)


@query(
    """SELECT source, count(*) AS objects, count(l.doc_id) AS labelled, round(coalesce(count(l.doc_id) / count(*), 0), 4) AS labelled_rate, round(coalesce(sum(quality) / nullif(count(quality), 0), 0), 4) AS quality_rate
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"""
)
def q_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by source, 0 without a whole."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("objects"), F.count("l").alias("labelled"), F.sum("quality").alias("good"), F.count("quality").alias("judged"))
    return g.select("source", "objects", "labelled", numbers.rate(F.col("labelled"), F.col("objects")).alias("labelled_rate"), numbers.rate(F.col("good"), F.col("judged")).alias("quality_rate"))


@query("""SELECT lang, CAST(trunc(median(length(text))) AS INT) AS median_chars, count(*) AS n FROM documents GROUP BY lang""")
def q_median_len(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians, cut to integers."""
    return read_table(spark, sf, "documents").groupBy("lang").agg(numbers.whole_median(F.length("text")).alias("median_chars"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1 AS shared FROM lineitem""")
def q_multi_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose (part, supplier) stands in several lines."""
    w = Window.partitionBy("l_partkey", "l_suppkey")
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.count(F.lit(1)).over(w) > 1).alias("shared"))


GROUPS = [("urgent-open", "1-URGENT", "O", 1, None), ("urgent-partial", "1-URGENT", "P", 0, 5), ("low-final", "5-LOW", "F", 100000, None), ("none", "9-NONE", "O", 0, 0), ("absent", "9-NONE", "F", 2, 3)]


@query(
    """WITH g(key, priority, status, least, most) AS (VALUES ('urgent-open', '1-URGENT', 'O', 1, NULL), ('urgent-partial', '1-URGENT', 'P', 0, 5), ('low-final', '5-LOW', 'F', 100000, NULL), ('none', '9-NONE', 'O', 0, 0), ('absent', '9-NONE', 'F', 2, 3)),
    c AS (SELECT g.key, g.least, g.most, count(o_orderkey) AS found FROM g LEFT JOIN orders ON o_orderpriority = g.priority AND o_orderstatus = g.status GROUP BY g.key, g.least, g.most)
    SELECT key, found, CASE WHEN least <= found AND (most IS NULL OR found <= most) THEN 'met' WHEN found = 0 THEN 'missed' WHEN most IS NOT NULL AND found > most THEN 'over_split' ELSE 'under_split_or_recall' END AS status FROM c"""
)
def q_gold_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Expected counts against orders, and the ladder of statuses."""
    g = spark.createDataFrame(GROUPS, "key string, o_orderpriority string, o_orderstatus string, least int, most int")
    counts = read_table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    c = F.broadcast(g).join(counts, ["o_orderpriority", "o_orderstatus"], "left").withColumn("found", F.coalesce("n", F.lit(0)))
    status = F.when((F.col("least") <= F.col("found")) & (F.col("most").isNull() | (F.col("found") <= F.col("most"))), "met").when(F.col("found") == 0, "missed").when(F.col("found") > F.col("most"), "over_split").otherwise("under_split_or_recall")
    return c.select("key", "found", status.alias("status"))


@query("""SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n_keys, NOT json_exists(props, '$.k') OR json_extract_string(props, '$.k') = '' AS lacks_k, NOT json_exists(props, '$.page') AS lacks_page FROM events""")
def q_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """PF13, PF15: required fields of JSON that are absent or empty."""
    e = read_table(spark, sf, "events")
    lacks = lambda k: json_ops.is_empty_json(json_ops.field_json(F.col("props"), k))
    return e.select("event_id", F.size(json_ops.keys(F.col("props"))).alias("n_keys"), lacks("k").alias("lacks_k"), lacks("page").alias("lacks_page"))


@query(
    """WITH j AS (SELECT event_id, json_object('a', props::JSON, 'items', json_array(event_type, '', user_id), 'category', 'hidden') AS doc FROM events)
    SELECT event_id, fullkey AS path, CASE WHEN type = 'VARCHAR' THEN atom ->> '$' ELSE CAST(atom AS VARCHAR) END AS value FROM (SELECT j.event_id, t.fullkey, t.type, t.atom FROM j, json_tree(j.doc) t) WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND NOT (type = 'VARCHAR' AND (atom ->> '$') = '') AND NOT starts_with(fullkey, '$.category')"""
)
def q_json_leaf_paths(spark: SparkSession, sf: str) -> DataFrame:
    """SF20, C8: leaves of nested JSON without reference keys, nulls and empty texts."""
    doc = F.concat(F.lit('{"a":'), "props", F.lit(',"items":['), K.text_json(F.col("event_type")), F.lit(',"",'), F.col("user_id").cast("string"), F.lit('],"category":"hidden"}'))
    return read_table(spark, sf, "events").select("event_id", F.explode(json_ops.leaves(doc)).alias("l")).select("event_id", "l.path", "l.value")


@query(
    """WITH p AS (SELECT event_id, props::JSON AS a, lead(props) OVER (PARTITION BY user_id ORDER BY event_id)::JSON AS b FROM events), k AS (SELECT event_id, unnest(list_distinct(json_keys(a) || json_keys(b))) AS key, a, b FROM p WHERE b IS NOT NULL)
    SELECT event_id, '$.' || key AS path FROM k WHERE json_extract(a, '$.' || key) IS DISTINCT FROM json_extract(b, '$.' || key)"""
)
def q_changed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """SF21, F7: paths at which a user's next event has other properties."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read_table(spark, sf, "events").select("event_id", "props", F.lead("props").over(w).alias("next")).where("next is not null")
    return e.select("event_id", F.explode(json_ops.changed_paths("props", "next")).alias("path"))


@query(
    """SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
)
def q_qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn and the assistant's that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "question", "answer")


@query(
    """SELECT 'conv-' || conv_id AS object_id, left(sha256(text), 12) AS item_id, left(text, 160) AS preview FROM conversations WHERE role = 'user'
    UNION ALL SELECT 'doc-' || doc_id, coalesce(nullif(source, ''), left(sha256(text), 12)), left(text, 160) FROM documents"""
)
def q_retrieval_units(spark: SparkSession, sf: str) -> DataFrame:
    """R1, SF3, PF10: units with item ids and previews."""
    unit = lambda df, prefix, key, *given: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("object_id"), ids.item_id(F.col("text"), *given).alias("item_id"), text.preview(F.col("text")).alias("preview"))
    asked = read_table(spark, sf, "conversations").where("role = 'user'")
    return unit(asked, "conv-", "conv_id").unionByName(unit(read_table(spark, sf, "documents"), "doc-", "doc_id", F.col("source")))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings e, q WHERE e.vec_id <> query_id)
    SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """SL8: the ten nearest vectors of each stated query."""
    v = read_table(spark, sf, "embeddings")
    return R.top_by_cosine(v, v.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank")


@query("""SELECT r_name AS document, n_nationkey AS object_id, c_custkey AS entity_id FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000""")
def q_graph_onehop(spark: SparkSession, sf: str) -> DataFrame:
    """Regions contain nations, nations refer to customers, if any."""
    r, n = read_table(spark, sf, "region"), read_table(spark, sf, "nation")
    c = read_table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("object_id"), F.col("c_custkey").alias("entity_id"))
    objects = r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(F.col("r_name").alias("document"), F.col("n_nationkey").alias("object_id"))
    return objects.join(c, "object_id", "left").select("document", "object_id", "entity_id")


@query("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier""")
def q_union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """SO1, SO6, A1."""
    return read_table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).union(read_table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("""SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders""")
def q_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """SO2."""
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def q_except(spark: SparkSession, sf: str) -> DataFrame:
    """SO3, SO4."""
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query(
    """SELECT l_orderkey, list_aggregate(list_sort(list_distinct(list(l_partkey))), 'string_agg', ',') AS parts, count(DISTINCT l_suppkey) <= count(DISTINCT l_partkey) AS fits FROM lineitem GROUP BY l_orderkey"""
)
def q_evidence_union(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A6, SL5, SO5: sorted distinct unions."""
    g = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"), F.collect_set("l_suppkey").alias("s"))
    return g.select("l_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("parts"), (F.size("s") <= F.size("p")).alias("fits"))


@query("""SELECT source, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS INT)) AS INT) AS place FROM (SELECT DISTINCT source FROM documents)""")
def q_natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    """SL4: src10 comes after src2. Sources are a few names, so one window over all of them is fine."""
    names = read_table(spark, sf, "documents").select("source").distinct()
    return names.select("source", F.row_number().over(Window.orderBy(text.natural_key(F.col("source")))).alias("place"))


@query(
    """WITH RECURSIVE g AS (SELECT l_suppkey, l_orderkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS i FROM lineitem GROUP BY l_suppkey, l_orderkey),
    b AS (SELECT l_suppkey, l_orderkey, i, n, 0 AS batch FROM g WHERE i = 1 UNION ALL SELECT g.l_suppkey, g.l_orderkey, g.i, CASE WHEN b.n + g.n > 45 THEN g.n ELSE b.n + g.n END, CASE WHEN b.n + g.n > 45 THEN b.batch + 1 ELSE b.batch END FROM b JOIN g ON g.l_suppkey = b.l_suppkey AND g.i = b.i + 1)
    SELECT l_suppkey, l_orderkey, CAST(batch AS INT) AS batch FROM b"""
)
def q_plan_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of a supplier in batches of 45 lines, an order's lines together."""
    g = read_table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return R.greedy_batches(g, ["l_suppkey"], ["l_orderkey"], "n", 45).select("l_suppkey", "l_orderkey", "batch")


@query("""SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS INT) AS batch FROM lineitem""")
def q_realization_batches(spark: SparkSession, sf: str) -> DataFrame:
    """P14, SF23: runs of three lines of an order."""
    return R.batches(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3)


@query()
def q_quote_span(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of documents that stand for their own second sentence, quoted without marks and with other spacing."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", F.get(F.split("text", r"\. "), F.lit(1)).alias("s")).where("s is not null and s <> ''")
    quote = F.regexp_replace("s", r"\s+", "  ")
    return d.select("doc_id", F.explode(K.resolve_quote("text", quote, F.lit(False))).alias("span"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), url) AS heading FROM pages""")
def q_html_heading(spark: SparkSession, sf: str) -> DataFrame:
    """T16, SF28: a page's first heading, else its address."""
    return read_table(spark, sf, "pages").select("page_id", text.falsy_chain(F.trim(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1)), F.col("url")).alias("heading"))


@query("""SELECT conv_id, turn, regexp_matches(trim(text), '[?？吗呢]$') AS asks, length(text) > 240 AS cut, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS quote FROM conversations""")
def q_question_like(spark: SparkSession, sf: str) -> DataFrame:
    """SF33, PF6: turns that end as questions, and quotes cut for prompts."""
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.ends_with_any(text.strip_space(F.col("text")), text.QUESTION_ENDS).alias("asks"), (F.length("text") > 240).alias("cut"), text.truncated(F.col("text")).alias("quote"))


@query("""SELECT conv_id, 'call-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS call_id, turn, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS retry_of FROM conversations""")
def q_call_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Calls numbered within a document, with the call before of their group."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read_table(spark, sf, "conversations").select("conv_id", F.format_string("call-%03d", F.row_number().over(w)).alias("call_id"), "turn", F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("retry_of"))


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN o_orderpriority END AS source_text FROM orders""")
def q_first_context(spark: SparkSession, sf: str) -> DataFrame:
    """PF7: context only with the first row of its key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read_table(spark, sf, "orders").select("o_orderkey", F.when(F.row_number().over(w) == 1, F.col("o_orderpriority")).alias("source_text"))


@query("""SELECT event_type, count(*) AS calls, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS failures, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def q_call_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums by purpose."""
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") > 50).alias("failures"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT p_brand, max(p_name) AS longest_by_size, min(left(p_name, 3)) AS prefix_low FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1 GROUP BY p_brand""")
def q_longest_pick(spark: SparkSession, sf: str) -> DataFrame:
    """A25, SL6: the row of the greatest size in each group."""
    best = read_table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_size", F.negative("p_partkey"))).alias("longest_by_size"))
    return best.withColumn("prefix_low", F.left("longest_by_size", F.lit(3)))


@query("""SELECT c_mktsegment, left(min(c_name), len(list_filter(range(1, length(min(c_name)) + 1), lambda i: left(min(c_name), i) = left(max(c_name), i)))) AS prefix FROM customer GROUP BY c_mktsegment""")
def q_common_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix that all names of a segment share: that of the least and the greatest."""
    g = read_table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.array(F.min("c_name"), F.max("c_name")).alias("n"))
    return g.select("c_mktsegment", text.common_prefix(F.col("n")).alias("prefix"))


@query("""SELECT s_suppkey AS "supplierKey", s_name AS "supplierName", s_acctbal AS "accountBalance" FROM supplier""")
def q_camel_projection(spark: SparkSession, sf: str) -> DataFrame:
    """PF1, PF2: a message's field names."""
    return camel(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_key"), F.col("s_name").alias("supplier_name"), F.col("s_acctbal").alias("account_balance")))


@query("""SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name""")
def q_catalog_join(spark: SparkSession, sf: str) -> DataFrame:
    """J20, PF12: facts against small dimensions."""
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    dims = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    counts = read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return dims.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def q_events_window(spark: SparkSession, sf: str) -> DataFrame:
    """2.16: events by hour and type; the same function serves a stream under a watermark."""
    from claimforge.streaming.ingest import windowed_counts

    return windowed_counts(read_table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
