"""Named queries of the composed lifecycles: collection, facets, diagnostics, themes, contracts, entries, parsed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import collect, contract, diagnostics, documents, gates, graph, percolate, rank, taxonomy, themes
from orrery.plans.catalog import BASE_SQL, DOC_SQL, KEY_SQL, Frame, _docs, query, table
from orrery import sinks
from orrery.sources import parse

LOOP_SQL = BASE_SQL.replace("WITH works", "WITH RECURSIVE works")


def _scope_works(f: Frame, spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    n = f.refs.groupBy("id").agg(F.count("*").alias("n_refs"))
    kind = F.when(F.col("s") == "F", "article").when(F.col("s") == "O", "conference-paper").otherwise("review")
    return f.works.join(o, "id").join(n, "id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).withColumn("type", kind).withColumn("topic", F.col("id") % 40).withColumn("retracted", F.col("id") % 11 == 0)


def _pool(f: Frame):
    return f.pool.select((F.row_number().over(graph.W.orderBy(F.col("seed_citers").desc(), "ref")) - 1).alias("slot"), "ref")


def _fair_sql(where: str, kind: str, page: int) -> str:
    return LOOP_SQL + f""", n AS (SELECT id, count(*) AS n FROM refs GROUP BY id),
scope AS (SELECT w.* FROM works w JOIN orders ON o_orderkey = w.id LEFT JOIN n ON n.id = w.id WHERE w.id % 11 <> 0 AND coalesce(n.n, 0) < 100 AND o_orderstatus IN ('F', 'O') AND w.id NOT IN (SELECT id FROM seeds) AND {where}),
slots AS (SELECT ref, row_number() OVER (ORDER BY seed_citers DESC, ref) - 1 AS slot FROM pool),
pages AS (SELECT slot, s.id, {kind} AS kind, row_number() OVER (PARTITION BY slot ORDER BY s.cites DESC, s.id) AS pos FROM slots JOIN refs USING (ref) JOIN scope s ON s.id = refs.id QUALIFY pos <= {page}),
lists AS (SELECT slot, list(id ORDER BY kind, pos) AS ids FROM pages GROUP BY slot),
walk(slot, got) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.slot + 1, list_concat(w.got, list_slice(list_filter(coalesce(l.ids, []::BIGINT[]), lambda x: NOT list_contains(w.got, x)), 1, greatest(least(6, 60 - len(w.got)), 0))) FROM walk w LEFT JOIN lists l ON l.slot = w.slot + 1 WHERE w.slot < 49),
fin AS (SELECT got FROM walk ORDER BY slot DESC LIMIT 1),
spare AS (SELECT id, cites FROM scope WHERE id IN (SELECT id FROM refs WHERE ref IN (SELECT ref FROM pool)) ORDER BY cites DESC, id LIMIT 150),
tail AS (SELECT coalesce(list(id ORDER BY cites DESC, id), []::BIGINT[]) AS t FROM spare, fin WHERE NOT list_contains(got, id))
SELECT CAST(i - 1 AS INTEGER) AS slot, list_concat(got, t)[i] AS id FROM fin, tail, range(1, least(len(got) + len(t), 60) + 1) AS u(i)"""


@query(_fair_sql("field NOT IN (SELECT field FROM home)", "0", 12))
def two_hop_fair_share(spark, sf):
    f = Frame(spark, sf)
    return collect.collect_candidates(_scope_works(f, spark, sf), f.refs, f.seeds, _pool(f), home_fields=f.home).select("slot", "id")


@query(_fair_sql("w.id % 13 <> 0 AND field NOT IN (SELECT field FROM home) AND w.id % 40 NOT IN (3, 7)", "CASE WHEN s.domain IN (SELECT domain FROM works WHERE field IN (SELECT field FROM home)) THEN 1 ELSE 0 END", 24))
def two_hop_full_filters(spark, sf):
    f = Frame(spark, sf)
    used = table(spark, sf, "orders").where("o_orderkey % 13 = 0").select("o_orderkey")
    topics = spark.createDataFrame([(3,), (7,)], "topic long")
    domains = f.works.join(F.broadcast(f.home), "field", "left_semi").select("domain").distinct()
    return collect.collect_candidates(_scope_works(f, spark, sf), f.refs, f.seeds, _pool(f), home_fields=f.home, home_topics=topics, home_domains=domains, used=used).select("slot", "id")


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos, CASE WHEN s_suppkey % 9 = 0 THEN '10.1/' || s_suppkey % 18 ELSE '' END AS dk, CASE WHEN s_suppkey % 7 = 0 THEN 'title ' || s_suppkey % 21 ELSE '' END AS tk FROM supplier QUALIFY pos <= 60),
refs AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS ref FROM lineitem WHERE l_suppkey IN (SELECT id FROM s)), n AS (SELECT id, count(*) AS n FROM refs GROUP BY id HAVING count(*) >= 10),
j AS (SELECT x.id AS a, y.id AS b FROM refs x JOIN refs y ON x.ref = y.ref AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY 1, 2 HAVING count(*) * 100 >= (any_value(nx.n) + any_value(ny.n) - count(*)) * 18),
e AS (SELECT x.pos AS a, y.pos AS b FROM s x JOIN s y ON x.pos <> y.pos AND (x.dk = y.dk AND x.dk <> '' OR x.tk = y.tk AND x.tk <> '') UNION SELECT x.pos, y.pos FROM j JOIN s x ON x.id = j.a JOIN s y ON y.id = j.b UNION SELECT y.pos, x.pos FROM j JOIN s x ON x.id = j.a JOIN s y ON y.id = j.b),
r(pos, g) AS (SELECT pos, pos FROM s UNION SELECT r.pos, e.b FROM r JOIN e ON e.a = r.g), m AS (SELECT pos, min(g) AS root FROM r GROUP BY pos)
SELECT id, CAST(s.pos AS INTEGER) AS pos, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS grp FROM s JOIN m ON m.pos = s.pos""")
def seed_group_union(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").orderBy(F.col("s_acctbal").desc(), k).limit(60)
    seeds = s.select(k.alias("id"), F.row_number().over(graph.W.orderBy(F.col("s_acctbal").desc(), k)).alias("pos"), F.when(k % 9 == 0, F.concat(F.lit("10.1/"), (k % 18).cast("string"))).otherwise("").alias("dk"), F.when(k % 7 == 0, F.concat(F.lit("title "), (k % 21).cast("string"))).otherwise("").alias("tk"))
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("ref")).distinct()
    return collect.seed_groups(seeds, refs, percent=18)


FACET_SQL = """WITH RECURSIVE o AS (SELECT o_orderpriority AS facet, o_orderkey AS id, c_nationkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY pos <= 50),
raw AS (SELECT *, c_nationkey < CASE facet WHEN '1-URGENT' THEN 20 ELSE 9 END AS home, id % 8 = 0 AS supplement, id % 6 <> 0 AS has_abstract, id % 10 = 0 AS used, CAST(id % 37 AS VARCHAR) AS tk, c_nationkey % 4 = 0 AS off FROM o WHERE id % 9 <> 0 AND id % 12 <> 0),
v AS (SELECT facet, CASE WHEN count(*) < 3 THEN 'too_few' WHEN count(*) FILTER (home) * 100 > count(*) * 60 THEN 'home_converged' WHEN count(*) - count(*) FILTER (home) < 1 THEN 'no_distant' END AS verdict FROM raw GROUP BY facet),
st AS (SELECT raw.*, coalesce(verdict, CASE WHEN home THEN 'home' WHEN supplement THEN 'supplement' WHEN used THEN 'used' WHEN NOT has_abstract THEN 'no_abstract' ELSE 'kept' END) AS stage FROM raw JOIN v USING (facet)),
k AS (SELECT *, row_number() OVER (ORDER BY facet, pos) AS spot FROM st WHERE stage = 'kept'),
h AS (SELECT tk, min(spot) AS spot, arg_min(facet, spot) AS facet, (list(id ORDER BY o_totalprice DESC, spot))[1] AS id, (list(off ORDER BY o_totalprice DESC, spot))[1] AS off FROM k GROUP BY tk),
b AS (SELECT facet, id, off, row_number() OVER (PARTITION BY facet ORDER BY off, spot) - 1 AS slot FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY slot, facet) AS place FROM b QUALIFY place <= 30)
"""


def _facets(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    pos = F.row_number().over(graph.W.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    k = F.col("o_orderkey")
    top = table(spark, sf, "orders").withColumn("pos", pos).where("pos <= 50").join(c, "o_custkey")
    home = F.col("c_nationkey") < F.when(F.col("o_orderpriority") == "1-URGENT", 20).otherwise(9)
    rows = top.select(F.col("o_orderpriority").alias("facet"), "pos", k.alias("id"), home.alias("home"), (k % 9 != 0).alias("type_ok"), (k % 12 == 0).alias("retracted"), (k % 8 == 0).alias("supplement"), (k % 6 != 0).alias("has_abstract"), (k % 37).cast("string").alias("tk"), F.col("o_totalprice").alias("standing"), (F.col("c_nationkey") % 4 == 0).alias("off"))
    used = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select("o_orderkey")
    stages = collect.facet_stages(rows, used)
    buckets = collect.facet_buckets(stages.where("stage = 'kept'"), ["tk"], off_language=F.col("off"))
    return stages, buckets, collect.facet_select(buckets, limit=30)


@query(FACET_SQL + "SELECT facet, CAST(slot AS INTEGER) AS slot, id, CAST(place AS INTEGER) AS place FROM p")
def facet_selection(spark, sf):
    return _facets(spark, sf)[2].select("facet", "slot", "id", "place")


@query(FACET_SQL + """SELECT facet, count(*) AS returned, count(*) FILTER (stage = 'home') AS home_excluded, count(*) FILTER (stage = 'supplement') AS supplement_excluded, (SELECT count(*) FROM b WHERE b.facet = st.facet) AS kept,
(SELECT count(*) FROM b WHERE b.facet = st.facet AND off) AS off_language, (SELECT count(*) FROM p WHERE p.facet = st.facet) AS selected, coalesce(max(CASE WHEN stage IN ('too_few', 'home_converged', 'no_distant') THEN stage END), 'ok') AS status FROM st GROUP BY facet""")
def facet_counts(spark, sf):
    return collect.facet_counts(*_facets(spark, sf))


@query(BASE_SQL + ", n AS (SELECT id, count(DISTINCT ref) AS n FROM seed_hits GROUP BY id) SELECT s.id, field, cites, coalesce(n, 0) AS bridge_contribution FROM seeds s LEFT JOIN n ON n.id = s.id")
def seed_rows(spark, sf):
    f = Frame(spark, sf)
    return diagnostics.seed_rows(f.seeds, f.seed_hits).select("id", "field", "cites", "bridge_contribution")


@query(BASE_SQL + "SELECT CAST(field AS BIGINT) AS field, count(*) AS n FROM top60 GROUP BY 1")
def top_topics(spark, sf):
    return diagnostics.top_topics(Frame(spark, sf).candidates.select(F.col("field").cast("long")), "field")


@query(BASE_SQL + """, o AS (SELECT id, row_number() OVER (ORDER BY bridge_betweenness DESC, shared_bridge_count DESC, cites DESC, id) - 1 AS pos FROM top60), h AS (SELECT hits.ref, o.id, pos FROM hits JOIN o ON o.id = hits.id),
p AS (SELECT ref, count(*) AS n, count(*) FILTER (pos < 10) AS head FROM h GROUP BY ref), t AS (SELECT * FROM p ORDER BY n DESC, ref LIMIT 1)
SELECT (SELECT count(*) FROM o) AS candidates, (SELECT count(*) FROM o WHERE pos < 10) AS window, (SELECT ref FROM t) AS top_bridge, (SELECT n FROM t) AS top_candidates, (SELECT head FROM t) AS top_in_head, (SELECT count(*) FROM h) AS shared_total""")
def head_share(spark, sf):
    f = Frame(spark, sf)
    ranked = f.candidates.withColumn("pos", F.row_number().over(graph.W.orderBy(*graph.rank_keys())) - 1)
    return diagnostics.head_share(ranked, f.cand_hits)


ROUTE_SQL = BASE_SQL + """, t AS (SELECT ref, CASE WHEN domain <= 1 THEN 'lexical' ELSE 'semantic' END AS leg FROM seed_hits JOIN seeds USING (id)),
routes AS (SELECT ref, CASE WHEN count(DISTINCT leg) = 2 THEN 'both' ELSE min(leg) END AS route FROM t GROUP BY ref), slots AS (SELECT ref, row_number() OVER (ORDER BY seed_citers DESC, ref) - 1 AS slot FROM pool)
"""


def _routes(f: Frame):
    leg = F.when(F.col("domain") <= 1, "lexical").otherwise("semantic")
    return graph.route_split(f.seed_hits.join(f.seeds.select("id", leg.alias("leg")), "id"), "ref", "leg", ("lexical", "semantic"))


@query(ROUTE_SQL + """, m AS (SELECT s.ref, slot, coalesce(route = 'lexical' AND EXISTS (SELECT 1 FROM routes WHERE route IN ('semantic', 'both')), false) AS moved FROM slots s LEFT JOIN routes r ON r.ref = s.ref)
SELECT CAST(row_number() OVER (ORDER BY moved, slot) - 1 AS INTEGER) AS slot, ref, moved FROM m""")
def lexical_bridges_last(spark, sf):
    f = Frame(spark, sf)
    return diagnostics.lexical_bridges_last(_pool(f), _routes(f))


@query(ROUTE_SQL + ", g AS (SELECT h.id, count(DISTINCT route) AS n, min(route) AS one FROM hits h JOIN routes r ON r.ref = h.ref GROUP BY h.id) SELECT c.id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN one ELSE 'both' END AS route FROM top60 c LEFT JOIN g ON g.id = c.id")
def candidate_routes(spark, sf):
    f = Frame(spark, sf)
    return diagnostics.candidate_routes(f.candidates, f.cand_hits, _routes(f))


@query(BASE_SQL + """, k AS (SELECT id, count(DISTINCT ref) AS k FROM seed_hits GROUP BY id), q AS (SELECT ref FROM seed_hits GROUP BY ref HAVING count(DISTINCT id) >= 2)
SELECT (SELECT count(*) FROM pool) AS pool, (SELECT count(*) FROM q) AS shared, CAST((SELECT sum(k) FROM (SELECT k FROM k ORDER BY k DESC LIMIT 2)) AS BIGINT) AS top2, CAST((SELECT sum(k) FROM k) AS BIGINT) AS contributed,
(SELECT count(DISTINCT id) FROM refs WHERE id IN (SELECT id FROM seeds) AND id NOT IN (SELECT id FROM k)) AS absent""")
def pool_coverage(spark, sf):
    f = Frame(spark, sf)
    return diagnostics.coverage_summary(f.seeds, f.refs, f.seed_hits, f.pool)


@query("SELECT l_suppkey AS supp, count(*) AS n, CAST(floor(avg(l_quantity) * 1000 + 0.5) AS BIGINT) AS mean_e3, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def score_stability(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), "l_quantity")
    return diagnostics.stability(v, "supp", "l_quantity").select("supp", "n", F.round(F.col("mean") * 1000, 0).cast("long").alias("mean_e3"), "low", "high")


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 100) / 100.0::DOUBLE AS a, (p_partkey * 53 % 100) / 100.0::DOUBLE AS b, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS f FROM part)
SELECT id, CAST(floor(least(a, b) * 100 + 0.5) AS BIGINT) AS weaker_e2, CAST(floor(a * b * 10000 + 0.5) AS BIGINT) AS product_e4, least(a, b) >= 0.45::DOUBLE AND NOT coalesce(f, false) AS stands FROM p""")
def two_pier_gate(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), (k * 37 % 100 / 100.0).alias("match_a"), (k * 53 % 100 / 100.0).alias("match_b"), F.when(k % 6 != 0, k % 5 == 0).alias("false_bridge"))
    return diagnostics.two_piers(rows).select("id", F.floor(F.col("weaker") * 100 + 0.5).alias("weaker_e2"), F.floor(F.col("product") * 10000 + 0.5).alias("product_e4"), "stands")


@query("""WITH l AS (SELECT length(coalesce(text, '')) AS n FROM documents), h AS (SELECT n, count(*) AS c FROM l GROUP BY n)
SELECT CASE WHEN (SELECT sum(n) FROM l) > 300000 THEN (SELECT max(i) FROM range(0, 30000) AS u(i) WHERE (SELECT sum(least(n, i) * c) FROM h) <= 300000) END AS cut""")
def budget_cut(spark, sf):
    return sinks.cut_for_budget(table(spark, sf, "documents"), budget=300_000, text="text")


THEME_SQL = """WITH t AS (SELECT p_partkey AS theme, list_filter([CASE WHEN p_partkey % 5 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(split_part(p_name, ' ', 1)) END], lambda x: coalesce(x, '') <> '') AS k,
CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS f, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS g, CASE WHEN p_partkey % 2 = 0 THEN 'worry' END AS c FROM part),
a AS (SELECT *, CASE WHEN len(k) > 0 THEN k ELSE list_filter([f, g], lambda x: coalesce(x, '') <> '') END AS terms, array_to_string(list_filter([f, g], lambda x: coalesce(x, '') <> ''), ' ') AS rest FROM t),
e AS (SELECT *, list_filter(list_concat(list_transform(range(len(k), 0, -1), lambda n: array_to_string(k[1:n], ' ')), [rest]), lambda x: x <> '') AS every FROM a)
"""


@query(THEME_SQL + """SELECT theme, array_to_string(terms, ' ') AS query, coalesce(k[1], nullif(coalesce(g, ''), ''), f) AS anchor, trim(coalesce(k[1], nullif(f, ''), coalesce(g, ''))) AS hub,
array_to_string(list_filter(every, lambda s, i: list_position(list_transform(every, lambda x: lower(x)), lower(s)) = i), '|') AS rungs, array_to_string(list_filter([g, f, CASE WHEN c IS NOT NULL THEN '懸念: ' || c END], lambda x: coalesce(x, '') <> ''), ' / ') AS summary FROM e""")
def theme_texts(spark, sf):
    k = F.col("p_partkey")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    words = F.when(k % 5 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(word(1), word(2), F.lower(word(1))))
    t = table(spark, sf, "part").select(k.alias("theme"), words.alias("keywords_include"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("scope_field"), F.when(k % 4 != 0, F.col("p_type")).alias("goal"), F.when(k % 2 == 0, "worry").alias("concern"))
    t = t.withColumn("theme_overview", F.col("goal")).withColumn("why_problem", F.lit(None).cast("string"))
    shown = t.select("theme", themes.query_text().alias("query"), themes.theme_anchor().alias("anchor"), themes.hub_query().alias("hub"), F.array_join(themes.rungs(), "|").alias("rungs"), F.col("scope_field"), "goal", "concern")
    own = t.withColumn("theme_overview", F.col("goal")).withColumn("why_problem", F.col("scope_field")).withColumn("goal", F.lit(""))
    return shown.select("theme", "query", "anchor", "hub", "rungs").join(own.select("theme", themes.summary_text().alias("summary")), "theme")


@query(r"""WITH v AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part), q AS (SELECT p_partkey AS theme, ' ' || trim(regexp_replace(lower(p_name || '; ' || p_brand), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ' AS t FROM part)
SELECT theme, name AS subfield_id FROM q JOIN v ON contains(t, ' ' || lower(name) || ' ')""")
def subfield_resolution(spark, sf):
    p = table(spark, sf, "part")
    vocab = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct().withColumn("subfield_id", F.col("name"))
    t = p.select(F.col("p_partkey").alias("theme"), F.concat_ws("; ", "p_name", "p_brand").alias("scope_field"))
    return taxonomy.resolve_strict(t, vocab).select("theme", "subfield_id")


@query(r"""WITH w AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text, regexp_extract_all(lower(coalesce(split_part(text, chr(10), 1), '')), '[\p{L}\p{N}_]+') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS a, regexp_replace(coalesce(text, ''), '\P{L}', '', 'g') AS l FROM documents),
c AS (SELECT id, CASE WHEN len(a) = 0 THEN NULL WHEN len(t) >= 3 AND len(a) <= len(t) + 25 AND contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(t, ' ') || ' ') THEN 'title_echo' WHEN len(t) > 0 AND len(a) <= len(t) AND len(list_filter(a, lambda x: NOT list_contains(t, x))) = 0 THEN 'title_fragment'
  WHEN len(a) <= 40 AND length(l) >= 20 AND length(regexp_replace(l, '\P{Lu}', '', 'g')) >= 0.9::DOUBLE * length(l) THEN 'caps_heading' END AS class FROM w) SELECT id, class FROM c""")
def title_only_classes(spark, sf):
    return _docs(spark, sf).select("id", contract.title_only_class(F.col("title"), F.col("text")).alias("class"))


@query(DOC_SQL + r""", m AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE text END AS abstract, CASE WHEN id % 7 = 0 THEN NULL ELSE 2000 END AS year, CASE WHEN id % 11 = 0 THEN '  ' ELSE 'v' END AS venue, CASE WHEN id % 13 = 0 THEN NULL ELSE 5 END AS cites, CASE WHEN id % 15 = 0 THEN ['abstract'] END AS marks, id % 4 = 0 AS shown, id % 8 = 0 AS failed, CASE WHEN id % 6 = 0 THEN '' ELSE 'said' END AS relationship FROM d),
x AS (SELECT *, list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN trim(coalesce(abstract, '')) = '' THEN 'abstract' END, CASE WHEN year IS NULL THEN 'year' END, CASE WHEN trim(coalesce(venue, '')) = '' THEN 'venue' END, CASE WHEN cites IS NULL THEN 'cited_by_count' END], lambda c: c IS NOT NULL) AS gone,
  list_filter([CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN abstract IS NOT NULL THEN 'abstract' END, CASE WHEN year IS NOT NULL THEN 'year' END, CASE WHEN venue IS NOT NULL THEN 'venue' END, CASE WHEN cites IS NOT NULL THEN 'cited_by_count' END], lambda c: c IS NOT NULL) AS there,
  title IS NULL AND abstract IS NULL AND NOT list_contains(coalesce(marks, []::VARCHAR[]), 'abstract') AND NOT shown AS alone FROM m),
y AS (SELECT *, list_filter(gone, lambda c: list_contains(coalesce(marks, []::VARCHAR[]), c) OR list_contains(there, c)) AS up FROM x), z AS (SELECT *, list_filter(gone, lambda c: NOT list_contains(up, c)) AS miss FROM y)
SELECT id, 'score_only' AS what, '' AS fields FROM z WHERE alone UNION ALL SELECT id, 'unwritten', '' FROM z WHERE shown AND NOT failed AND relationship = '' UNION ALL SELECT id, 'upstream_empty', array_to_string(up, ',') FROM z WHERE NOT alone AND len(up) > 0 UNION ALL SELECT id, 'missing', array_to_string(miss, ',') FROM z WHERE NOT alone AND len(miss) > 0""")
def submission_report(spark, sf):
    i = F.col("id")
    null = F.lit(None)
    rows = _docs(spark, sf).select("id", F.when(i % 3 != 0, F.col("title")).alias("title"), F.when(i % 5 == 0, null).when(i % 5 == 1, "").otherwise(F.col("text")).alias("abstract"), F.when(i % 7 != 0, 2000).alias("year"), F.when(i % 11 == 0, "  ").otherwise("v").alias("venue"), F.when(i % 13 != 0, 5).alias("cited_by_count"), F.when(i % 15 == 0, F.array(F.lit("abstract"))).alias("upstream_empty"), F.when(i % 6 == 0, "").otherwise("said").alias("relationship"))
    shown = rows.where(i % 4 == 0).select("id", (i % 8 == 0).alias("failed"))
    return contract.submission_report(rows, shown).select("id", "what", F.array_join("fields", ",").alias("fields"))


@query(DOC_SQL + r""", s AS (SELECT id, coalesce(text, '') AS t, trim(regexp_replace(split_part(lower(coalesce(title, '')), ':', 1), '\s+', ' ', 'g')) AS head FROM d),
r AS (SELECT *, right(t, 200) AS tail FROM s), e AS (SELECT *, length(regexp_extract(tail, '(?s)^(.*?[.!?]\s+)[A-Z0-9("'']', 1)) AS n, strpos(substr(tail, 1, 30), ' ') AS sp FROM r)
SELECT id, head, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 120) || '...' END AS brief, CASE WHEN length(t) <= 200 THEN t WHEN n > 0 AND n <= 40 THEN substr(tail, n + 1) WHEN sp > 0 AND NOT regexp_matches(substr(t, length(t) - 200, 1), '^\s$') THEN substr(tail, sp + 1) ELSE tail END AS tail,
CAST(len(list_filter(string_split_regex(t || ' ', '\.\s'), lambda x: trim(x, chr(32)) <> '')) AS INTEGER) AS sentences FROM e""")
def text_cuts(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("id", T.title_head(F.col("title")).alias("head"), T.simple_summary(t).alias("brief"), sinks.abstract_tail(t, 200).alias("tail"), F.size(T.sentences(t)).alias("sentences"))


def _word_points(words, points: int) -> str:
    return " + ".join(f"{points} * CAST(contains(t, '{w}') AS INTEGER)" for w in words)


def _any_word(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(DOC_SQL + f""", r AS (SELECT id, lower(coalesce(text, '')) AS t, coalesce(text, '') AS raw, CASE WHEN id % 3 = 0 THEN 'NOASSERTION' WHEN id % 3 = 1 THEN NULL ELSE 'mit' END AS lic FROM d)
SELECT id, CASE WHEN t = '' THEN 0 ELSE least(3 + {_word_points(S.README_SIGNALS, 2)}, 15) END AS readme, CASE WHEN t = '' THEN 0 ELSE least(least(4 + {_word_points(S.README_BASICS, 2)}, 10) + CASE WHEN {_any_word(S.README_WHY)} THEN 5 ELSE 0 END + CASE WHEN {_any_word(S.README_WHEN)} THEN 5 ELSE 0 END, 20) END AS completeness,
CASE WHEN (length(raw) - length(replace(raw, '```', ''))) // 6 >= 3 THEN 10 WHEN (length(raw) - length(replace(raw, '```', ''))) // 6 >= 1 THEN 5 ELSE 0 END AS code,
CASE WHEN coalesce(lic, '') IN ('', 'NOASSERTION') THEN 0 ELSE 10 END + least({_word_points(S.PRACTICE_SIGNALS, 2)}, 10) + CASE WHEN {_any_word(S.RESEARCH_SIGNALS)} THEN 5 ELSE 0 END AS practice FROM r""")
def readme_signals(spark, sf):
    i, t = F.col("id"), F.col("text")
    lic = F.when(i % 3 == 0, "NOASSERTION").when(i % 3 == 2, "mit")
    return _docs(spark, sf).select("id", S.readme_points(t).alias("readme"), S.readme_completeness(t).alias("completeness"), S.code_blocks(t).alias("code"), S.practices(F.lit(""), t, lic).alias("practice"))


@query("""WITH c AS (SELECT l_orderkey AS id, list(p_brand ORDER BY l_linenumber, p_brand, l_partkey) AS names, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, p_brand, l_partkey) AS refs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'RETRACTED: x' ELSE 'Order ' || o_orderkey END AS title, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE year(o_orderdate) END AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS cited_by_count, CASE WHEN o_orderkey % 3 = 0 THEN 'review' ELSE 'article' END AS publication_type,
o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 AS is_retracted, coalesce(array_to_string(names, ','), '') AS concepts, coalesce(array_to_string(list_transform(refs, lambda r: 'https://x.org/W' || r), ','), '') AS refs, 'F' || o_custkey % 26 AS field_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a b' || ' a' END AS abstract FROM orders LEFT JOIN c ON c.id = o_orderkey""")
def normalize_works(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    line = table(spark, sf, "lineitem").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand", "l_partkey"))).alias("l"))
    o = table(spark, sf, "orders").join(line, "o_orderkey", "left")
    empty = F.coalesce("l", F.array().cast(dict(line.dtypes)["l"]))
    none = F.lit(None).cast("string")
    payload = F.struct(
        F.concat(F.lit("https://openalex.org/W"), k.cast("string")).alias("id"), F.when(k % 5 == 0, none).otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("display_name"), F.lit("RETRACTED: x").alias("title"), F.when(k % 7 != 0, F.year("o_orderdate")).alias("publication_year"), F.floor("o_totalprice").alias("cited_by_count"),
        F.when(k % 3 == 0, none).otherwise("article").alias("type"), F.lit("review").alias("type_crossref"), F.when(k % 11 == 0, F.lit(True)).alias("is_retracted"), F.when(k % 4 != 0, F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.array(F.lit(1)), F.lit("late"), F.array(F.lit(1)))).alias("abstract_inverted_index"),
        F.transform(empty, lambda x: F.struct(x["p_brand"].alias("display_name"), F.lit(1).alias("level"), F.lit(0.5).alias("score"))).alias("concepts"), F.transform(empty, lambda x: F.concat(F.lit("https://x.org/W"), x["l_partkey"].cast("string"))).alias("referenced_works"),
        F.struct(F.struct(F.concat(F.lit("https://x.org/F"), (F.col("o_custkey") % 26).cast("string")).alias("id")).alias("field")).alias("primary_topic"),
    )
    w = parse.normalize_works(o.select(F.to_json(payload).alias("payload")))
    return w.select("id", "title", "year", "cited_by_count", "publication_type", "is_retracted", F.array_join("concepts", ",").alias("concepts"), F.array_join("refs", ",").alias("refs"), "field_id", "abstract")


@query(DOC_SQL + r""", p AS (SELECT id, ' ' || trim(regexp_replace(lower(concat_ws(' ', title, text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h, title, text, n_chars FROM d WHERE length(trim(coalesce(text, ''))) > 0),
l AS (SELECT *, CASE WHEN contains(h, ' the ') AND contains(h, ' with ') AND contains(h, ' que ') THEN 0 WHEN contains(h, ' the ') AND contains(h, ' with ') THEN 1 WHEN contains(h, ' the ') THEN 2 WHEN contains(h, ' und ') AND contains(h, ' der ') THEN 3 END AS rung FROM p)
SELECT id, rung FROM l WHERE rung IS NOT NULL ORDER BY rung, id LIMIT 500""")
def near_field_ladder(spark, sf):
    works = _docs(spark, sf).select("id", "title", F.col("text").alias("abstract"), F.lit(False).alias("is_retracted"), F.col("id").alias("pos"), F.lit(None).cast("string").alias("field_id"))
    theme = {"keywords_include": ["the", "with", "que"], "scope_field": "und", "goal": "der"}
    return themes.near_field(works, theme, limit=500, expand=False).select("id", "rung")


PERCOLATE_SQL = DOC_SQL + r""", h AS (SELECT id, ' ' || trim(regexp_replace(lower(concat_ws(' ', title, text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h FROM d WHERE length(trim(coalesce(text, ''))) > 0 AND NOT starts_with(upper(title), 'RETRACTED:') AND NOT starts_with(upper(title), 'WITHDRAWN:')),
t AS (SELECT conv_id AS theme, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')[1:4], lambda w: true) AS w FROM conversations WHERE turn = 0),
q AS (SELECT theme, 0 AS rung, w[1:3] AS w, len(w) AS k FROM t WHERE len(w) >= 3 UNION ALL SELECT theme, greatest(least(len(w), 3) - 2, 0), w[1:2], len(w) FROM t WHERE len(w) >= 2 UNION ALL SELECT theme, least(len(w), 3) - 1, w[1:1], len(w) FROM t WHERE len(w) >= 1 UNION ALL SELECT theme, 3, w[4:4], len(w) FROM t WHERE len(w) >= 4),
u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY theme, array_to_string(w, ' ') ORDER BY rung) = 1),
f AS (SELECT theme, id, min(rung) AS rung FROM u, h WHERE contains(h, ' ' || w[1] || ' ') AND (len(w) < 2 OR contains(h, ' ' || w[2] || ' ')) AND (len(w) < 3 OR contains(h, ' ' || w[3] || ' ')) GROUP BY theme, id)
"""


def _conversation_themes(spark, sf):
    """A theme from each conversation's first turn: three keywords, the fourth word as goal."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), 1, 4)
    rows = table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("theme"), words.alias("w"))
    return rows.select("theme", F.slice("w", 1, 3).alias("keywords_include"), F.lit(None).cast("string").alias("scope_field"), F.try_element_at("w", F.lit(4)).alias("goal"))


def _doc_works(spark, sf):
    return _docs(spark, sf).select("id", "title", F.col("text").alias("abstract"), F.lit(False).alias("is_retracted"), F.col("id").alias("pos"))


@query(PERCOLATE_SQL + "SELECT theme, id, CAST(rung AS INTEGER) AS rung FROM f")
def percolated_ladders(spark, sf):
    works = gates.drop_retracted(_doc_works(spark, sf)).where(gates.has_abstract())
    found = percolate.first_matches(percolate.ladders(_conversation_themes(spark, sf)), works)
    return found.select(F.col("query").alias("theme"), "id", "rung")


@query(PERCOLATE_SQL + "SELECT theme, CAST(row_number() OVER (PARTITION BY theme ORDER BY rung, id) AS INTEGER) AS place, id, CAST(rung AS INTEGER) AS rung FROM f QUALIFY place <= 500")
def near_fields(spark, sf):
    return percolate.near_fields(_doc_works(spark, sf), _conversation_themes(spark, sf), expand=False).select("theme", "place", "id", "rung")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem), n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
w AS (SELECT o_orderkey AS id, o_custkey % 26 AS field, year(o_orderdate) AS y, o_orderstatus AS kind, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON n.id = o_orderkey)
SELECT p_partkey AS part, w.id FROM part JOIN r ON r.ref IN (p_partkey, p_partkey + 1) JOIN w ON w.id = r.id WHERE field <> p_size % 26 AND (p_partkey % 3 <> 0 OR y >= 1995) AND (p_partkey % 4 <> 0 OR y <= 1996) AND (p_partkey % 5 <> 0 OR kind = 'F') AND (p_partkey % 2 <> 0 OR n < 5)
UNION SELECT -1 - c_custkey, w.id FROM customer JOIN w ON field IN (c_nationkey, c_nationkey + 1) WHERE c_custkey % 50 = 0 AND kind = 'O'""")
def percolated_filters(spark, sf):
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("refs"))
    works = table(spark, sf, "orders").join(refs, F.col("o_orderkey") == F.col("o"), "left").select(F.col("o_orderkey").alias("id"), F.lit("").alias("title"), F.lit("").alias("abstract"), (F.col("o_custkey") % 26).cast("string").alias("field_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type"), "refs")
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    parts = table(spark, sf, "part").select(
        k.alias("query"), F.array(s(k), s(k + 1)).alias("cites"), F.array(s(F.col("p_size") % 26)).alias("exclude_field_ids"), F.when(k % 3 == 0, 1995).alias("year_from"), F.when(k % 4 == 0, 1996).alias("year_to"),
        F.when(k % 5 == 0, "F").alias("work_type"), F.when(k % 2 == 0, 5).alias("max_refs"),
    )
    n = F.col("c_nationkey")
    fields = table(spark, sf, "customer").where("c_custkey % 50 = 0").select((-1 - F.col("c_custkey")).alias("query"), F.array(s(n), s(n + 1)).alias("field_ids"), F.lit("O").alias("work_type"))
    queries = parts.unionByName(fields, allowMissingColumns=True).withColumn("rung", F.lit(0))
    return percolate.percolate(queries, works).select(F.col("query").alias("part"), "id")


@query(DOC_SQL + r""", s AS (SELECT id, CASE WHEN id % 9 = 0 OR starts_with(upper(coalesce(title, '')), 'RETRACTED:') OR starts_with(upper(coalesce(title, '')), 'WITHDRAWN:') THEN 'retracted' WHEN id % 4 = 1 THEN 'other_type' WHEN length(trim(coalesce(text, ''))) = 0 THEN 'no_abstract' ELSE 'kept' END AS stage FROM d)
SELECT count(*) AS returned, count(*) FILTER (stage = 'retracted') AS retracted, count(*) FILTER (stage = 'other_type') AS other_type, count(*) FILTER (stage = 'no_abstract') AS no_abstract, count(*) FILTER (stage = 'kept') AS kept FROM s""")
def semantic_leg_counts(spark, sf):
    i = F.col("id")
    rows = _docs(spark, sf).select("id", "title", F.col("text").alias("abstract"), (i % 9 == 0).alias("is_retracted"), F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "review").when(i % 4 == 2, "conference-paper").otherwise("article").alias("type"))
    return themes.semantic_leg(rows)[1]


@query("""WITH a AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS INTEGER) AS reliability, CAST(s_suppkey * 13 % 31 AS INTEGER) AS fit FROM supplier), r AS (SELECT *, least(greatest(fit / 30.0::DOUBLE, 0), 1) AS rel FROM a), s AS (SELECT *, reliability * (0.35::DOUBLE + 0.65::DOUBLE * rel) AS score FROM r)
SELECT CAST(row_number() OVER (ORDER BY rel > 0 DESC, score DESC, id) - 1 AS INTEGER) AS pos, id, '実装アンカー' AS label, CASE WHEN rel >= 0.67::DOUBLE THEN '高' WHEN rel >= 0.35::DOUBLE THEN '中' ELSE '低' END AS level, CASE WHEN rel > 0 THEN '' ELSE '・一致キーワード 0 件のため、一致のあるアンカーすべての後ろに並ぶ' END AS tier_note FROM s QUALIFY pos < 10""")
def anchor_entries(spark, sf):
    k = F.col("s_suppkey")
    a = table(spark, sf, "supplier").select(k.alias("id"), (k * 37 % 101).cast("int").alias("reliability"), (k * 13 % 31).cast("int").alias("fit")).withColumn("relevance", S.relevance(F.col("fit"), 30))
    a = a.withColumn("anchor_rank_score", S.anchor_score(F.col("reliability"), F.col("relevance")))
    return documents.anchor_entries(a, count=10).select("pos", "id", "label", "level", "tier_note")


@query(DOC_SQL + r""", c AS (SELECT id, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS t FROM d), s AS (SELECT id, CAST(contains(t, 'the') AS INTEGER) + CAST(contains(t, 'ing') AS INTEGER) - 2 * CAST(contains(t, 'und') AS INTEGER) AS keyword_score FROM c) SELECT id, keyword_score FROM s ORDER BY keyword_score DESC, id LIMIT 60""")
def track_a_pre_rank(spark, sf):
    rows = _docs(spark, sf).select("id", "title", F.col("text").alias("abstract"), F.col("id").alias("pos"))
    return documents.pre_rank(rows, ["the", "ing"], ["und"], count=20).select("id", "keyword_score")


@query(KEY_SQL.replace("WITH d", "WITH RECURSIVE d") + """, f AS (SELECT k.id, lang AS query, row_number() OVER (PARTITION BY lang ORDER BY k.id) - 1 AS pos, tk, CASE WHEN length(ak) >= 200 THEN substr(ak, 1, 200) ELSE '' END AS ak, text FROM k JOIN d ON d.id = k.id WHERE lang IS NOT NULL),
q AS MATERIALIZED (SELECT id, query, pos // 50 AS page, list_filter([CASE WHEN tk <> '' THEN hash('t' || tk) END, CASE WHEN ak <> '' THEN hash('a' || ak) END], lambda v: v IS NOT NULL) AS own, row_number() OVER (ORDER BY query, pos) AS rn FROM f WHERE length(trim(coalesce(text, ''))) > 0),
z(rn, query, page, n, stopped, keys, ids) AS (SELECT 0::BIGINT, '', 0::BIGINT, 0::BIGINT, false, []::UBIGINT[], []::BIGINT[] UNION ALL
  SELECT y.rn, y.query, y.page, CASE WHEN take THEN y.n + 1 ELSE y.n END, y.stopped, CASE WHEN take THEN list_concat(y.keys, y.own) ELSE y.keys END, CASE WHEN take THEN list_append(y.ids, y.id) ELSE y.ids END
  FROM (SELECT x.*, NOT x.stopped AND NOT list_has_any(x.keys, x.own) AS take
        FROM (SELECT q.rn, q.query, q.page, q.id, CASE WHEN q.query <> z.query THEN 0 ELSE z.n END AS n, q.query = z.query AND (z.stopped OR q.page <> z.page AND z.n >= 60) AS stopped, q.own, z.keys, z.ids FROM z JOIN q ON q.rn = z.rn + 1 WHERE len(z.ids) < 200) x) y),
fin AS (SELECT ids FROM z ORDER BY rn DESC LIMIT 1) SELECT CAST(i AS INTEGER) AS place, ids[i] AS id FROM fin, range(1, least(len(ids), 200) + 1) AS u(i)""")
def lexical_baseline(spark, sf):
    # of an abstract only its first letter is asked for; places are counted over all languages, no task holds one
    some = F.substring(F.trim("text"), 1, 1)
    rows = _docs(spark, sf).where("lang IS NOT NULL").select("id", F.col("lang").alias("query"), some.alias("abstract"), T.title_key(F.col("title")).alias("tk"), T.abstract_key(F.col("text")).alias("ak"))
    rows = rank.places(rows, F.col("query").asc(), F.col("id").asc())
    heads = rows.groupBy("query").agg(F.min("place").alias("head"))
    rows = rows.join(F.broadcast(heads), "query").withColumn("pos", F.col("place") - F.col("head")).drop("place", "head")
    return themes.lexical_baseline(rows, ["tk", "ak"], per_query=60, limit=200).select("place", "id")


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey % 3 AS attempt, o_orderstatus <> 'P' AS complete, o_totalprice FROM orders) SELECT o_custkey AS id, CAST(list(o_orderkey ORDER BY o_orderstatus = 'P', o_orderkey)[1] AS BIGINT) AS attempt, bool_or(o_orderstatus <> 'P') AS complete FROM orders GROUP BY 1""")
def best_attempts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("attempt"), "o_orderstatus")
    return documents.best_attempts(o, complete=F.col("o_orderstatus") != "P").select("id", "attempt", "complete")


@query(DOC_SQL + r""", t AS (SELECT id, replace(coalesce(text, ''), chr(10), ' ') AS x FROM d), p AS (SELECT id, list_filter(list_transform(string_split_regex(x || ' ', '\.\s'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM t), m AS (SELECT id, array_to_string(list_transform(s[1:3], lambda q: q || '.'), ' ') AS m FROM p)
SELECT id, CASE WHEN m = '' THEN 'abstract欠損' ELSE '（記入なし）原文の冒頭の抜粋: ' || CASE WHEN length(m) <= 160 THEN m ELSE regexp_replace(substr(m, 1, 160), '(?s) [^ ]*$', '') || '...' END END AS summary FROM m""")
def excerpt_summaries(spark, sf):
    return _docs(spark, sf).select("id", documents.excerpt_summary(F.col("text")).alias("summary"))


@query("""WITH i AS (SELECT conv_id, list({'domain': trim(role), 'pseudo_abstract': trim(coalesce(text, ''))} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS f FROM conversations GROUP BY 1), r AS (SELECT conv_id, list_filter(f, lambda x: x.pseudo_abstract <> '') AS f FROM i)
SELECT conv_id, array_to_string(list_transform(list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y.domain)), lower(x.domain)) = i)[1:3], lambda x: x.domain || ':' || length(x.pseudo_abstract)), ' ') AS facets FROM r""")
def facet_payload(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    items = F.transform("x", lambda r: F.struct(r["role"].alias("domain"), r["text"].alias("pseudo_abstract")))
    shown = F.transform(themes.facets(items), lambda f: F.concat(f["domain"], F.lit(":"), F.length(f["pseudo_abstract"]).cast("string")))
    return c.select("conv_id", F.array_join(shown, " ").alias("facets"))


@query("""WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 7), r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders QUALIFY pos <= 40), u AS (SELECT 0 AS o, pos, id FROM p UNION ALL SELECT 1, pos, id FROM r WHERE id NOT IN (SELECT id FROM p))
SELECT CAST(row_number() OVER (ORDER BY o, pos, id) - 1 AS INTEGER) AS slot, id, o = 1 AS filled FROM u QUALIFY slot < 20""")
def naive_fill(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")

    def head(n, *keys):
        return o.orderBy(*keys, "id").limit(n).select("id", F.row_number().over(graph.W.orderBy(*keys, "id")).alias("pos"))

    return documents.naive_fill(head(7, F.col("o_totalprice").desc()), head(40, "o_orderdate"), count=20)


@query("""WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 2 END DESC, o_orderkey) AS place FROM orders) SELECT id, CAST(place AS INTEGER) AS place FROM r""")
def level_ordering(spark, sf):
    level = F.when(F.col("o_orderstatus") == "F", "高").when(F.col("o_orderstatus") == "O", "低").otherwise("?")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level"), F.col("o_orderkey").alias("pos"))
    order = documents.level_order()
    return rank.places(o, *order).select("id", F.col("place").cast("int").alias("place"))
