"""More named queries: lookups, gates, review, exports, text and readers' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, filters, linking, pairs, quality, review, similarity, snapshots, summaries
from ..sources import readers, writers
from .catalog import _EXPORTED, _LINKS7, _P, _TOP, _exported, _links, query
from .views import FLOOR, Views


def _owned(v: Views) -> DataFrame:
    return v.assignments().join(v.controls().select(F.col("id").alias("control_id"), "framework_id", "section_id", "title"), "control_id")


_OWNED = ", owned AS (SELECT a.*, c.framework_id, c.section_id, c.title FROM assignments a JOIN controls c ON c.id = a.control_id)"

# --- lookups, sources and their rows ------------------------------------------------------------


@query("""SELECT 'control' AS kind, id FROM assignments WHERE control_id = 'P7' UNION ALL SELECT 'provenance', id FROM assignments WHERE provenance = 'active_round_2'
UNION ALL SELECT 'status', id FROM assignments WHERE review_status = 'rejected' UNION ALL SELECT 'framework', CAST(substr(id, 2) AS BIGINT) FROM controls WHERE framework_id = 'Brand#3'""")
def a2_lookups(v):
    a = v.assignments()
    by = lambda kind, c: a.where(c).select(F.lit(kind).alias("kind"), "id")
    own = v.controls().where("framework_id = 'Brand#3'").select(F.lit("framework").alias("kind"), F.substring("id", 2, 20).cast("long").alias("id"))
    return by("control", "control_id = 'P7'").union(by("provenance", "provenance = 'active_round_2'")).union(by("status", "review_status = 'rejected'")).union(own)


@query("SELECT concat(id, ': ', CASE WHEN title <> '' THEN concat(title, '. ') ELSE '' END, description) AS text, framework_id, id FROM controls")
def a16_control_texts(v):
    return readers.control_texts(v.controls().withColumn("full_text", F.lit(" "))).select("text", "framework_id", "id")


@query("SELECT framework_id, section_id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN title ELSE description END AS text FROM controls")
def a16b_parsed_texts(v):
    full = F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, F.col("title")).otherwise("  ")
    return readers.parsed_texts(v.controls().withColumn("full_text", full))


@query("""SELECT framework_id, arg_min(title, (length(title), title)) AS label, string_agg(DISTINCT title, ', ' ORDER BY title) AS names FROM controls GROUP BY 1""")
def a16d_framework_names(v):
    return readers.framework_names(v.controls().withColumnRenamed("title", "standard_name"))


@query("""SELECT concat('D', doc_id) AS item_id, CASE WHEN lang IN ('en', 'de') THEN lang END AS hub_id FROM documents""", plain=True)
def a16e_truth_of(v):
    items = v.table("documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("item_id"), F.to_json(F.array(F.coalesce("lang", F.lit("none")), F.lit("zz"))).alias("truth"))
    return readers.truth_of(items, v.spark.createDataFrame([("en",), ("de",)], "id string"))


@query("""SELECT c.c_custkey AS id, coalesce(o.text, CAST(c.c_custkey AS VARCHAR)) AS text FROM customer c LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS text FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""", plain=True)
def a16f_aligned_texts(v):
    ids = v.table("customer").select(F.col("c_custkey").cast("string").alias("id"))
    texts = v.table("orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos"))
    return readers.aligned_texts(ids, texts).select(F.col("id").cast("long").alias("id"), "text")


@query("SELECT count(*) AS frameworks, CAST(sum(n) AS BIGINT) AS controls FROM (SELECT framework_id, count(*) AS n FROM controls GROUP BY 1)")
def a15_framework_totals(v):
    per = v.controls().groupBy("framework_id").agg(F.collect_list("id").alias("controls"))
    return readers.framework_totals(per)


@query("SELECT id, framework_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY concat(framework_id, ':', title) ORDER BY CAST(substr(id, 2) AS BIGINT)) AS r FROM controls) WHERE r = 1")
def m1_first_rows(v):
    c = v.controls()
    return linking.first_per(c, ["framework_id", "title"], [F.substring("id", 2, 20).cast("long")]).select("id", "framework_id", "section_id")


@query("""SELECT user_id AS control_id, event_id AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, event_id) AS r FROM events) WHERE r = 1""", plain=True)
def m4_longest_description(v):
    rows = v.table("events").select(F.col("user_id").alias("control_id"), F.col("event_type").alias("description"), F.col("event_id").alias("pos"))
    return linking.longest_description(rows).select("control_id", "pos")


@query(_LINKS7 + """ SELECT hub_id, count(*) AS n, count(DISTINCT framework_id) AS frameworks FROM links GROUP BY 1""")
def m6_link_counts(v):
    return _links(v).groupBy("hub_id").agg(F.count("*").alias("n"), F.countDistinct("framework_id").alias("frameworks"))


# --- classes and gates ----------------------------------------------------------------------------


@query("SELECT item_id, max(sim) < 0.2 AS is_ood FROM sims GROUP BY 1")
def c11_ood_flags(v):
    return similarity.top_hubs(v.items(), v.vector_hubs(), 1).select("item_id", (F.col("sim") < 0.2).alias("is_ood"))


@query(_P + _TOP + """ SELECT item_id, NOT (sim < 0.2) AND round(p, 4) >= 0.1 AND p >= 0.08 AS auto_accept FROM ranked JOIN probs p USING (item_id, hub_id, sim) WHERE rank = 1""")
def c12_auto_accept(v):
    top = similarity.scored_top(v.items(), v.vector_hubs(), 10, 0.1).withColumn("is_ood", F.col("max_sim") < 0.2)
    return writers.review_lines(top, 0.1, 0.92).select("item_id", "auto_accept")


@query(_OWNED + """ SELECT framework_id, rate, CASE WHEN rate >= 85 THEN 'High' WHEN rate >= 50 THEN 'Medium' ELSE 'Lower' END AS tier FROM
(SELECT framework_id, round(100.0 * count(*) FILTER (review_status = 'accepted') / count(*), 1) AS rate FROM owned WHERE review_status <> 'pending' GROUP BY 1)""")
def c14_trust_tiers(v):
    seen = _owned(v).where("review_status <> 'pending'").groupBy("framework_id").agg(F.round(100.0 * F.count_if(F.col("review_status") == "accepted") / F.count("*"), 1).alias("rate"))
    return seen.select("framework_id", "rate", filters.trust_tier(F.col("rate")).alias("tier"))


@query("""SELECT 'pending' AS rule, CAST(id AS VARCHAR) AS id FROM assignments WHERE review_status = 'pending' UNION ALL SELECT 'missing_bridge', concat('S', a, '|S', b) FROM
(SELECT DISTINCT s_nationkey AS a, s_suppkey % 9 AS b FROM supplier) x WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a AND n_regionkey = b)""")
def c16_publication_gate(v):
    at = lambda c: F.concat(F.lit("S"), c.cast("string"))
    bridges = v.table("supplier").select(at(F.col("s_nationkey")).alias("hub_a"), at(F.col("s_suppkey") % 9).alias("hub_b")).distinct()
    related = v.table("nation").select(at(F.col("n_nationkey")).alias("hub_a"), at(F.col("n_regionkey")).alias("hub_b"))
    return quality.publication_issues(v.assignments().select("id", F.col("review_status").alias("status")), bridges, related)


@query(_OWNED + """, ok AS (SELECT DISTINCT section_id AS item_id, hub_id FROM owned WHERE provenance = 'ground_truth'),
c AS (SELECT avg(CASE WHEN ok.item_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS canary FROM owned o LEFT JOIN ok ON ok.item_id = o.section_id AND ok.hub_id = o.hub_id WHERE review_status NOT IN ('pending', 'rejected')),
r AS (SELECT round(count(*) FILTER (review_status = 'accepted') / count(*), 6) AS rate, count(DISTINCT hub_id) FILTER (review_status = 'accepted') AS hubs FROM assignments WHERE review_status <> 'pending')
SELECT rate, hubs, round(canary, 6) AS canary, rate > 0.80 AND canary >= 0.50 AND hubs >= 50 AS stop FROM r, c""")
def c17_stopping(v):
    r = summaries.round_status(v.assignments().select(F.col("review_status").alias("status"), "hub_id")).select("rate", "hubs").first()
    canary = e15_canary_accuracy(v).first().accuracy
    return v.spark.createDataFrame([(r.rate, r.hubs, canary, evaluation.stopping(r.rate, canary, r.hubs))], "rate double, hubs bigint, canary double, stop boolean")


@query(_OWNED + """, f AS (SELECT framework_id AS fold, round(quantile_cont(confidence, 0.25), 6) AS lo FROM owned WHERE confidence IS NOT NULL GROUP BY 1)
SELECT fold, lo, 0.3 AS floor FROM f WHERE fold IN ('Brand#1', 'Brand#2', 'Brand#3') AND lo < 0.3""")
def c18_soft_floors(v):
    f = _owned(v).where("confidence IS NOT NULL").groupBy(F.col("framework_id").alias("fold")).agg(F.round(F.percentile("confidence", F.lit(0.25)), 6).alias("lo"))
    return evaluation.soft_floors(f, {"Brand#1": 0.3, "Brand#2": 0.3, "Brand#3": 0.3})


@query("""SELECT vec_id FROM embeddings WHERE replace(concat('f', CASE WHEN vec_id % 2 = 0 THEN '::' ELSE ':' END, vec_id), '::', ':') IN (SELECT concat('f:', s_suppkey) FROM supplier)""", plain=True)
def d14_embedding_slice(v):
    k = F.col("vec_id")
    vectors = v.table("embeddings").select(F.concat(F.lit("f"), F.when(k % 2 == 0, "::").otherwise(":"), k.cast("string")).alias("id"), "vec_id", "embedding")
    return readers.embedding_slice(vectors, v.table("supplier").select(F.concat(F.lit("f:"), F.col("s_suppkey").cast("string")).alias("id"))).select("vec_id")


@query("""SELECT a.id AS item_id, CASE WHEN a.id % 3 = 2 THEN concat('text of ', a.id) ELSE c.title END AS text, CASE a.id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' ELSE 'section' END AS source FROM assignments a JOIN controls c ON c.id = a.control_id""")
def d18_enriched_corpus(v):
    a, k = _owned(v), F.col("id") % 3
    asked = F.when(k == 0, F.col("section_id")).when(k == 1, F.lower(F.translate("section_id", "-", " "))).otherwise(F.concat(F.lit("none"), F.col("id").cast("string")))
    items = a.select(F.col("id").alias("item_id"), "framework_id", asked.alias("section_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("section_text"))
    parsed = v.controls().select("framework_id", "section_id", F.col("title").alias("text"))
    return readers.enriched_corpus(items, parsed)


# --- aggregates ---------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (o_orderkey % 4 <> 1) AS agreed, count(*) AS reviewed, round(count(*) FILTER (o_orderkey % 4 <> 1) / count(*), 3) AS score FROM orders WHERE o_orderstatus <> 'P'", plain=True)
def e11_reviewer_quality(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select((-k - 1).alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("accepted").alias("review_status"), F.lit("h").alias("hub_id"), F.when(k % 4 == 1, "x").otherwise("h").alias("reviewer_hub_id"))
    return summaries.calibration_quality(rows)


@query("""SELECT count(*) AS total, count(*) FILTER (review_status <> 'pending') AS reviewed, count(*) FILTER (review_status = 'accepted') AS good, round(count(*) FILTER (review_status = 'accepted') / count(*) FILTER (review_status <> 'pending'), 6) AS rate,
  count(DISTINCT hub_id) FILTER (review_status = 'accepted') AS hubs FROM assignments""")
def e14_round_status(v):
    return summaries.round_status(v.assignments().select(F.col("review_status").alias("status"), "hub_id"))


@query(_OWNED + """, ok AS (SELECT DISTINCT section_id AS item_id, hub_id FROM owned WHERE provenance = 'ground_truth')
SELECT round(avg(CASE WHEN ok.item_id IS NOT NULL THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM owned o LEFT JOIN ok ON ok.item_id = o.section_id AND ok.hub_id = o.hub_id WHERE review_status NOT IN ('pending', 'rejected')""")
def e15_canary_accuracy(v):
    a = _owned(v)
    return review.canary_accuracy(a.select(F.col("section_id").alias("item_id"), "hub_id", F.col("review_status").alias("status")), a.where("provenance = 'ground_truth'").select(F.col("section_id").alias("item_id"), "hub_id"))


@query(_P + _TOP + """, t AS (SELECT item_id, p, sim FROM ranked JOIN probs USING (item_id, hub_id, sim) WHERE rank = 1),
d AS (SELECT item_id, bool_or(sim >= 0.3) AS dup, bool_or(sim < 0.3) AS near FROM sims WHERE sim >= 0.2 GROUP BY 1)
SELECT count(*) AS controls, count(*) FILTER (sim < 0.2) AS ood, count(*) FILTER (dup) AS duplicates, count(*) FILTER (near) AS similar, count(*) FILTER (p >= 0.1) AS high, count(*) FILTER (p < 0.1) AS low,
  round(avg(p), 3) AS mean_confidence, round(avg(sim), 3) AS mean_max_sim FROM t LEFT JOIN d USING (item_id)""")
def e16_ingest_summary(v):
    top = similarity.scored_top(v.items(), v.vector_hubs(), 1, 0.1).select("item_id", F.col("p").alias("confidence"), "max_sim", (F.col("max_sim") < 0.2).alias("is_ood"))
    return summaries.ingest_summary(top, pairs.tiers(v.items(), v.vector_hubs(), 0.2, 0.3), high=0.1)


@query(_LINKS7 + ", k AS (SELECT hub_id, count(*) AS n FROM links GROUP BY 1) SELECT count(*) AS hubs, min(n) AS least, max(n) AS most, round(avg(n), 3) AS mean, round(quantile_cont(n, 0.5), 3) AS median FROM k")
def e18_links_per_hub(v):
    return summaries.links_per_hub(_links(v))


@query(_LINKS7 + """, h AS (SELECT concat(hub_id, '-', id % 50) AS hub_id, length(section_name) >= 10 AS usable FROM links), k AS (SELECT hub_id, bool_and(usable) AS a, bool_or(usable) AS s FROM h GROUP BY 1)
SELECT CASE WHEN a THEN 'all_good' WHEN s THEN 'mixed' ELSE 'all_bad' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def e18_hub_usability(v):
    rows = _links(v).select(F.concat_ws("-", "hub_id", (F.col("id") % 50).cast("string")).alias("hub_id"), (F.length("section_name") >= 10).alias("usable"))
    return summaries.hub_usability(rows)


@query(_LINKS7 + """, k AS (SELECT lower(trim(section_name)) AS key, count(DISTINCT hub_id) AS n FROM links GROUP BY 1) SELECT count(*) AS texts, count(*) FILTER (n > 1) AS several, max(n) AS most, round(avg(n), 3) AS mean FROM k""")
def e20_multi_hub_texts(v):
    return summaries.multi_hub_texts(_links(v).select(F.col("section_name").alias("text"), "hub_id"))


@query(_OWNED + """, f AS (SELECT o.framework_id, n.parent_id AS root FROM owned o JOIN hubs h ON h.id = o.hub_id JOIN hubs n ON n.id = h.parent_id)
SELECT framework_id, count(*) FILTER (root = 'R0') AS R0, count(*) FILTER (root = 'R1') AS R1, count(*) FILTER (root = 'R2') AS R2, count(*) FILTER (root = 'R3') AS R3, count(*) FILTER (root = 'R4') AS R4 FROM f GROUP BY 1""")
def e21_root_pivot(v):
    from .catalog import e21_flows

    return summaries.root_pivot(e21_flows(v), [f"R{k}" for k in range(5)])


@query(""", p AS (SELECT concat('S', l_suppkey) AS t, concat('S', l_partkey % (SELECT count(*) FROM supplier)) AS p FROM lineitem) SELECT t AS true_id, p AS predicted_id, count(*) AS n FROM p WHERE t <> p GROUP BY 1, 2 ORDER BY n DESC, t, p LIMIT 10""")
def e23_confusions(v):
    k = v.table("supplier").count()
    pairs = v.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("true_id"), F.concat(F.lit("S"), (F.col("l_partkey") % k).cast("string")).alias("predicted_id"))
    return summaries.confusions(pairs, 10)


@query(_OWNED + """, k AS (SELECT framework_id, count(*) AS n FROM owned GROUP BY 1) SELECT arg_max(framework_id, (n, framework_id)) AS framework_id, round(max(n) / sum(n), 6) AS share, max(n) > 0.5 * sum(n) AS warn FROM k""")
def e26_dominance(v):
    return summaries.dominance(_owned(v), "framework_id")


@query(""", p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM items, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY 1)
SELECT p.label AS cluster_id, CAST(i - 1 AS INTEGER) AS i, round(m / n, 5) AS x FROM p JOIN n ON n.label = p.label""")
def e28_centroids(v):
    from ..operators.proposals import centroids

    c = centroids(v.items().select(F.col("label").alias("cluster_id"), "item_id", F.lit("f").alias("framework_id"), "embedding"))
    return c.select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", "i", F.round("x", 5).alias("x"))


@query("""SELECT section, name, value FROM (SELECT 'coverage' AS section, unnest(['total', 'pending', 'accepted', 'rejected', 'reassigned', 'reviewed', 'pct_reviewed', 'accepted_rate', 'rejected_rate', 'reassigned_rate']) AS name,
  unnest([t, p, a, r, g, t - p, round(100.0 * (t - p) / t, 1), round(100.0 * a / (t - p), 1), round(100.0 * r / (t - p), 1), round(100.0 * g / (t - p), 1)]::DOUBLE[]) AS value FROM (SELECT count(*) AS t, count(*) FILTER (review_status = 'pending') AS p,
  count(*) FILTER (review_status = 'accepted') AS a, count(*) FILTER (review_status = 'rejected') AS r, count(*) FILTER (review_status = 'reassigned') AS g FROM assignments))
UNION ALL SELECT 'confidence', s, round(100.0 * count(*) FILTER (review_status = 'accepted') / count(*), 1)::DOUBLE FROM (SELECT review_status, unnest([CASE WHEN coalesce(confidence, 0) > 0.5 THEN 'high' ELSE 'low' END, CASE WHEN is_ood THEN 'ood' END]) AS s
  FROM assignments WHERE review_status <> 'pending') WHERE s IS NOT NULL GROUP BY 2 UNION ALL SELECT 'calibration', 'items', 0.0""")
def e7b_review_document(v):
    return summaries.review_document(v.assignments())


# --- ranking, sampling, sets ------------------------------------------------------------------------------


@query("""SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, control_id, hub_id) AS place FROM (
  SELECT control_id, hub_id, confidence, CASE WHEN t <= 5 THEN 1 WHEN b <= 5 THEN 2 WHEN m <= 10 THEN 3 END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY t <= 5 OR b <= 5 ORDER BY md5(concat('1:', control_id, ':', hub_id)), control_id, hub_id) AS m FROM
    (SELECT control_id, hub_id, confidence, row_number() OVER (ORDER BY confidence DESC, control_id, hub_id) AS t, row_number() OVER (ORDER BY confidence, control_id, hub_id) AS b
     FROM (SELECT control_id, hub_id, max(confidence) AS confidence FROM assignments WHERE confidence IS NOT NULL GROUP BY 1, 2)))) WHERE kind IS NOT NULL""")
def f8_calibration_items(v):
    rows = v.assignments().where("confidence IS NOT NULL").groupBy("control_id", "hub_id").agg(F.max("confidence").alias("confidence"))
    out = review.calibration_items(rows, 5, 5, 10, 1)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("confidence"), "control_id", "hub_id"))
    return out.select("control_id", "hub_id", "confidence", "kind", place.cast("long").alias("place"))


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r IN (SELECT i * n // 7 FROM unnest(range(0, 7)) AS u(i), (SELECT count(*) AS n FROM customer))""", plain=True)
def f13_few_shot(v):
    return evaluation.evenly_spaced(v.table("customer").select("c_custkey"), "c_custkey", 7)


@query("SELECT control_id, id FROM (SELECT control_id, id, row_number() OVER (PARTITION BY control_id ORDER BY id) AS r FROM assignments) WHERE r > 1")
def f14_repeats(v):
    w = Window.partitionBy("control_id").orderBy("id")
    return v.assignments().withColumn("r", F.row_number().over(w)).where("r > 1").select("control_id", "id")


@query("SELECT coalesce(max(l_linenumber), 0) + 1 AS next_round FROM lineitem", plain=True)
def f15_import_round(v):
    return summaries.import_round(v.table("lineitem").select(F.col("l_linenumber").alias("round")))


@query("""SELECT 'missing' AS side, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey NOT IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT 'extra', CAST(s_suppkey * 3 AS VARCHAR) FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT p_partkey FROM part)""", plain=True)
def h3_description_coverage(v):
    at = lambda t, c: v.table(t).select(c.cast("string").alias("id"))
    return quality.description_gaps(at("part", F.col("p_partkey")), at("supplier", F.col("s_suppkey") * 3))


@query("""SELECT count(*) FILTER (p.id IS NOT NULL) AS leaves, count(*) FILTER (s.id IS NOT NULL) AS described, count(*) FILTER (s.id IS NULL) AS missing, count(*) FILTER (p.id IS NULL) AS extra, count(*) FILTER (s.id IS NOT NULL AND length(trim(s.text)) = 0) AS empty,
  count(*) FILTER (s.id IS NOT NULL AND length(trim(s.text)) BETWEEN 1 AND 49) AS short FROM (SELECT p_partkey AS id FROM part) p FULL JOIN (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE repeat(s_name, CAST(s_suppkey % 4 + 1 AS INTEGER)) END AS text FROM supplier) s ON p.id = s.id""", plain=True)
def q5_description_report(v):
    s = v.table("supplier")
    text = F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.expr("repeat(s_name, CAST(s_suppkey % 4 + 1 AS INT))"))
    return quality.description_report(v.table("part").select(F.col("p_partkey").alias("id")), s.select((F.col("s_suppkey") * 3).alias("id"), text.alias("text")))


@query("""SELECT framework_id, 'count' AS rule, n FROM (SELECT framework_id, count(*) AS n FROM controls GROUP BY 1) WHERE n < floor(9 * 0.9) OR n > ceil(9 * 1.1)
UNION ALL SELECT framework_id, 'empty_description', count(*) FROM controls WHERE CAST(substr(id, 2) AS BIGINT) % 13 = 0 GROUP BY 1
UNION ALL SELECT framework_id, 'repeated_id', count(*) - count(DISTINCT title) FROM controls GROUP BY 1 HAVING count(*) > count(DISTINCT title)""")
def q2_batch_issues(v):
    c = v.controls()
    rows = c.select("framework_id", F.col("title").alias("control_id"), F.when(F.substring("id", 2, 20).cast("long") % 13 == 0, " ").otherwise(F.col("description")).alias("description"))
    return quality.batch_issues(rows, c.select("framework_id", F.lit(9).alias("n")).distinct())


@query("""SELECT id, rule FROM (SELECT a.id, CASE a.id % 20 WHEN 1 THEN 'unknown_status' WHEN 2 THEN 'missing_hub' WHEN 3 THEN 'unknown_hub' WHEN 4 THEN 'needless_hub' WHEN 5 THEN 'pending' END AS rule FROM assignments a) WHERE rule IS NOT NULL
UNION ALL SELECT n_nationkey + 900000000, 'unknown_id' FROM nation""")
def q4_review_issues(v):
    a, k = v.assignments(), F.col("id") % 20
    status = F.when(k == 1, "what").when((k == 2) | (k == 3), "reassigned").when(k == 5, "pending").otherwise("accepted")
    hub = F.when(k == 3, "S-none").when(k == 4, F.col("hub_id"))
    rows = a.select("id", status.alias("status"), hub.alias("reviewer_hub_id"))
    more = v.table("nation").select((F.col("n_nationkey") + 900000000).cast("long").alias("id"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reviewer_hub_id"))
    return quality.review_issues(rows.unionByName(more), a, v.hubs().select("id"))


# --- text --------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, nfc_normalize(replace(left(text, 3000), chr(0), '')) AS text FROM documents""", plain=True)
def i5_light_cleaning(v):
    return v.table("documents").select("doc_id", T.sanitize_light(F.col("text"), 3000).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN t <> '' THEN t END AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(translate(nfc_normalize(replace(text, chr(0), ' ')), concat(chr(8203), chr(8204), chr(8205), chr(65279)), ''),
  'ﬄ', 'ffl'), 'ﬃ', 'ffi'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents WHERE NOT regexp_matches(text, '[<&]'))""", plain=True)
def i1_cleaning(v):
    plain = v.table("documents").where(~F.col("text").rlike("[<&]"))
    return plain.select("doc_id", T.sanitize(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 100 THEN t WHEN instr(left(t, 100), ' ') > 0 AND 100 - instr(reverse(left(t, 100)), ' ') >= 50 THEN rtrim(left(t, 100 - instr(reverse(left(t, 100)), ' '))) ELSE left(t, 100) END AS text,
  CASE WHEN length(t) > 100 THEN t END AS full_text FROM (SELECT doc_id, text AS t FROM documents)""", plain=True)
def i3_cut_texts(v):
    t = F.col("text")
    return v.table("documents").select("doc_id", T.cut_at_space(t, 100).alias("text"), F.when(F.length(t) > 100, t).alias("full_text"))


@query(r"SELECT event_id, CAST(len(list_distinct(regexp_extract_all(concat(user_id, '-', event_id % 50, ' and ', user_id, '-7'), '(\d+-\d+)', 1))) AS INTEGER) AS n FROM events", plain=True)
def i8_mentioned_ids(v):
    u = F.col("user_id").cast("string")
    return v.table("events").select("event_id", F.size(T.mentioned_ids(F.concat(u, F.lit("-"), (F.col("event_id") % 50).cast("string"), F.lit(" and "), u, F.lit("-7")))).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LinkedTo' WHEN 1 THEN 'AutomaticallyLinkedTo' WHEN 2 THEN 'LinkedTo' END AS kind FROM orders""", plain=True)
def i9_link_types(v):
    k = F.col("o_orderkey") % 4
    return v.table("orders").select("o_orderkey", T.link_type(F.when(k == 0, "Linked To").when(k == 1, "automatically linked to").when(k == 2, "LINKEDTO").otherwise("related")).alias("kind"))


@query("SELECT id, concat_ws(' ', nullif(title, ''), CASE WHEN id LIKE '%3' THEN NULL ELSE description END) AS text FROM controls")
def i10_joined_text(v):
    d = F.when(F.col("id").endswith("3"), F.lit("")).otherwise(F.col("description"))
    return v.controls().select("id", T.join_present(F.col("title"), d).alias("text"))


@query("SELECT id, CASE framework_id WHEN 'Brand#1' THEN concat('https://example.org/one/', section_id) WHEN 'Brand#2' THEN concat('https://example.org/two#', section_id) END AS link FROM controls")
def i12_hyperlinks(v):
    t = {"Brand#1": "https://example.org/one/{section_id}", "Brand#2": "https://example.org/two#{section_id}"}
    return v.controls().select("id", T.hyperlink(F.col("framework_id"), F.col("section_id"), t).alias("link"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders", plain=True)
def i15_days(v):
    text = F.when(F.col("o_orderkey") % 10 == 3, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return v.table("orders").select("o_orderkey", T.day(text).alias("day"))


@query("SELECT id, concat('[', id, '] ', coalesce(parent_id, 'top'), ' | ', name, CASE WHEN length(repeat(name, depth)) = 0 THEN '' WHEN length(repeat(name, depth)) > 20 THEN concat(': ', left(repeat(name, depth), 20), '...') ELSE concat(': ', repeat(name, depth)) END) AS line FROM hubs")
def i21_catalog_lines(v):
    return v.hubs().select("id", T.catalog_line(F.col("id"), F.coalesce("parent_id", F.lit("top")), F.col("name"), F.expr("repeat(name, depth)"), 20).alias("line"))


@query("SELECT id, concat('Represent this: ', title) AS query, CASE WHEN id LIKE '%5' THEN '(none)' ELSE trim(description) END AS linked FROM controls")
def i22_instructed(v):
    t = F.when(F.col("id").endswith("5"), F.col("description")).otherwise(F.concat(F.col("id"), F.lit(": "), F.col("description")))
    return v.controls().select("id", T.instructed(F.col("title"), "Represent this: ").alias("query"), T.linked_text(t).alias("linked"))


# --- exports and mutation -------------------------------------------------------------------------------------


@query(_OWNED + " SELECT framework_id, control_id, count(*) AS n, string_agg(hub_id, ',' ORDER BY hub_id, confidence NULLS FIRST) AS hubs FROM owned WHERE review_status = 'accepted' GROUP BY 1, 2")
def b2_grouped(v):
    g = writers.grouped(_owned(v).where("review_status = 'accepted'"))
    return g.select("framework_id", "control_id", F.size("hubs").cast("long").alias("n"), F.array_join(F.transform("hubs", lambda h: h["hub_id"]), ",").alias("hubs"))


@query(_OWNED + " SELECT framework_id, control_id, title, hub_id, h.name AS hub_name, confidence, provenance, review_status FROM owned JOIN hubs h ON h.id = hub_id")
def b3_csv_rows(v):
    return writers.csv_rows(_owned(v), v.hubs())


@query(_EXPORTED + """ SELECT concat(hub_id, '|', h.name) AS "CRE 0", 'Std' AS "Std|name", section_id AS "Std|id", title AS "Std|description", concat('https://example.org/', section_id) AS "Std|hyperlink" FROM exported JOIN hubs h ON h.id = hub_id WHERE framework_id = 'Brand#3'""")
def b4_interchange(v):
    return writers.standard_csv(_exported(v).where("framework_id = 'Brand#3'"), v.hubs(), "Std", "https://example.org/{section_id}")


@query(_TOP + ", t AS (SELECT item_id, max(sim) AS s, string_agg(hub_id, ',' ORDER BY rank) AS hubs FROM ranked WHERE rank <= 3 GROUP BY 1) SELECT item_id, left(repeat(item_id, 40), 100) AS text, hubs, round(s, 6) AS top1_sim FROM t")
def b10_assign_lines(v):
    top = similarity.scored_top(v.items(), v.vector_hubs(), 3, 0.1)
    out = writers.assign_lines(top, v.items().select("item_id", F.expr("repeat(item_id, 40)").alias("text")))
    return out.select("item_id", "text", F.array_join("hubs", ",").alias("hubs"), F.round("top1_sim", 6).alias("top1_sim"))


@query(_P + _TOP + """ SELECT item_id, string_agg(concat(hub_id, CASE WHEN p >= 0.08 THEN '+' ELSE '-' END), ',' ORDER BY rank) AS predictions, max(sim) < 0.2 AS is_ood FROM ranked JOIN probs USING (item_id, hub_id, sim) WHERE rank <= 10 GROUP BY 1""")
def b15_review_lines(v):
    top = similarity.scored_top(v.items(), v.vector_hubs(), 10, 0.1).withColumn("is_ood", F.col("max_sim") < 0.2)
    lines = writers.review_lines(top, 0.1, 0.92)
    return lines.select("item_id", F.array_join(F.transform("predictions", lambda p: F.concat(p["hub_id"], F.when(p["in_conformal_set"], "+").otherwise("-"))), ",").alias("predictions"), "is_ood")


@query(_EXPORTED + """ SELECT c.framework_id, c.id AS control_id, count(e.hub_id) AS n, coalesce(string_agg(e.hub_id, ',' ORDER BY e.confidence DESC, e.hub_id), '') AS hubs FROM controls c LEFT JOIN exported e ON e.control_id = c.id GROUP BY 1, 2""")
def n1_snapshot(v):
    s = snapshots.build_snapshot(v.controls(), _exported(v))
    return s.select("framework_id", "control_id", F.size("mappings").cast("long").alias("n"), F.array_join(F.transform("mappings", lambda m: m["hub_id"]), ",").alias("hubs"))


@query(""", b AS (SELECT framework_id, id, title FROM controls WHERE CAST(substr(id, 2) AS BIGINT) % 7 <> 0), n AS (SELECT framework_id, id, CASE WHEN id LIKE '%5' THEN upper(title) ELSE title END AS title FROM controls WHERE CAST(substr(id, 2) AS BIGINT) % 11 <> 0)
SELECT coalesce(b.framework_id, n.framework_id) AS framework_id, CASE WHEN b.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS operation, 'control' AS entity_kind, coalesce(b.id, n.id) AS key FROM b FULL JOIN n ON b.id = n.id WHERE b.title IS DISTINCT FROM n.title""")
def b6_changeset(v):
    c, k = v.controls().select("framework_id", F.col("id").alias("control_id"), "title"), F.substring("control_id", 2, 20).cast("long")
    after = c.where(k % 11 != 0).withColumn("title", F.when(F.col("control_id").endswith("5"), F.upper("title")).otherwise(F.col("title")))
    m = _exported(v).select("framework_id", "control_id", "hub_id", "confidence").dropDuplicates(["framework_id", "control_id", "hub_id"])
    return snapshots.changeset(c.where(k % 7 != 0), after, m, m).select("framework_id", "operation", "entity_kind", "key")


@query(_EXPORTED + """, s AS (SELECT framework_id, count(*) AS n FROM exported GROUP BY 1), f AS (SELECT framework_id, count(*) AS n FROM exported WHERE id % 3 > 0 OR framework_id < 'Brand#2' GROUP BY 1)
SELECT framework_id, s.n AS expected, coalesce(f.n, 0) AS found FROM s LEFT JOIN f USING (framework_id) WHERE coalesce(f.n, 0) < s.n""")
def n8_shortfalls(v):
    stats = summaries.filter_stats(v.assignments(), v.controls(), overrides=FLOOR).where("n_exported > 0")
    return writers.count_shortfalls(_exported(v).where("id % 3 > 0 OR framework_id < 'Brand#2'"), stats)


@query(_OWNED + """, o AS (SELECT control_id, hub_id, confidence, is_ood, row_number() OVER (PARTITION BY control_id ORDER BY confidence DESC, hub_id, id) AS r FROM owned WHERE id % 2 = 1 AND confidence IS NOT NULL AND framework_id IN ('Brand#1', 'Brand#2'))
SELECT control_id, hub_id, confidence, is_ood, 'model_prediction' AS provenance, 'pending' AS review_status FROM o WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.id % 2 = 0 AND a.control_id = o.control_id AND a.hub_id = o.hub_id)""")
def o5_uncovered(v):
    a = v.assignments()
    w = Window.partitionBy("control_id").orderBy(F.desc("confidence"), "hub_id", "id")
    predictions = a.where("id % 2 = 1 AND confidence IS NOT NULL").withColumn("rank", F.row_number().over(w))
    return review.uncovered_inserts(a.where("id % 2 = 0"), predictions, v.controls(), ["Brand#1", "Brand#2"])


@query(_OWNED + """ SELECT control_id, hub_id, confidence, review_status FROM owned WHERE framework_id <> 'Brand#2' UNION ALL
SELECT control_id, CASE WHEN id % 3 = 0 THEN 'S0' ELSE hub_id END, CASE WHEN id % 3 <> 0 THEN confidence END, CASE WHEN id % 3 = 0 THEN 'corrected' ELSE 'accepted' END FROM owned WHERE framework_id = 'Brand#2' AND review_status = 'accepted'""")
def o6_accept_ingest(v):
    a, k = _owned(v), F.col("id") % 3
    status = F.when(F.col("review_status") != "accepted", F.col("review_status")).when(k == 0, "corrected").otherwise("accepted")
    reviews = a.where("framework_id = 'Brand#2'").select("control_id", status.alias("status"), F.when(k == 0, "S0").alias("corrected_hub_id"), F.col("hub_id").alias("top_hub_id"), F.col("confidence").alias("top_confidence"))
    own = v.controls().where("framework_id = 'Brand#2'").select(F.col("id").alias("control_id"))
    return review.accept_ingest(v.assignments(), own, reviews)


@query(_OWNED + """ SELECT concat(framework_id, ':', control_id) AS control_id, CASE WHEN id % 4 = 0 THEN 'S0' ELSE hub_id END AS hub_id, CASE WHEN id % 4 <> 0 OR hub_id = 'S0' THEN confidence END AS confidence, control_id AS section_id FROM owned WHERE review_status = 'accepted'""")
def o7_round_assignments(v):
    a = _owned(v)
    items = a.select(F.concat_ws(":", "framework_id", "control_id").alias("control_id"), F.when(F.col("review_status") == "accepted", F.when(F.col("id") % 4 == 0, "corrected").otherwise("accepted")).otherwise("rejected").alias("status"),
                     F.when(F.col("id") % 4 == 0, "S0").otherwise(F.col("hub_id")).alias("hub_id"), F.array(F.struct("hub_id", "confidence")).alias("predictions"))
    return review.round_assignments(items).select("control_id", "hub_id", "confidence", "section_id")


@query(""", old AS (SELECT id, control_id, hub_id FROM assignments WHERE id % 2 = 0), n AS (SELECT control_id, hub_id, min(id) AS id FROM assignments WHERE id % 2 = 1 GROUP BY 1, 2)
SELECT control_id, hub_id FROM old UNION ALL SELECT control_id, hub_id FROM n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.control_id = n.control_id AND o.hub_id = n.hub_id)""")
def o1_append(v):
    a = v.assignments()
    return review.appended(a.where("id % 2 = 0"), a.where("id % 2 = 1")).select("control_id", "hub_id")


_HASH_ALL = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {k}, 8)) AS BIGINT)) AS VARCHAR)" for k in (1, 9, 17, 25))


@query(f""", h AS (SELECT sha256(concat_ws(chr(31), CAST(id AS VARCHAR), control_id, hub_id, provenance, review_status)) AS h FROM assignments)
SELECT sha256(concat_ws(',', {_HASH_ALL}, CAST(count(*) AS VARCHAR))) AS content_hash, count(*) AS n_rows FROM h""")
def n6_table_hash(v):
    return snapshots.table_hash(v.assignments(), ["id", "control_id", "hub_id", "provenance", "review_status"])


@query("""SELECT id, CASE WHEN position(section_id IN t) > 0 THEN t ELSE concat(section_id, ': ', t) END AS text FROM (SELECT id, section_id, CASE WHEN id LIKE '%2' THEN section_id WHEN id LIKE '%4' THEN concat(section_id, ' ', title) ELSE title END AS t FROM controls)""")
def p5_evaluation_text(v):
    name = F.when(F.col("id").endswith("2"), F.lit(" ")).when(F.col("id").endswith("4"), F.concat_ws(" ", "section_id", "title")).otherwise(F.col("title"))
    return v.controls().select("id", evaluation.evaluation_text(name, F.col("section_id")).alias("text"))


@query("SELECT id, framework_id FROM controls WHERE framework_id <> 'Brand#4'")
def p6_retrieval_pool(v):
    return evaluation.folds(v.controls(), ["Brand#4"]).where("role = 'train'").select("id", "framework_id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) AS r FROM documents) WHERE r <= 15""", plain=True)
def p2_canaries(v):
    return evaluation.hashed_split(v.table("documents").select("doc_id"), "doc_id", {"canary": 15}, "rest", 7).where("part = 'canary'").select("doc_id")
