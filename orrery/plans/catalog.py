"""Named queries over the driver tables. Works are orders, references the distinct parts of an order's
lines, the field of a work its customer's nation, the domain that nation's region."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import contract, dedup, diversify, gates, graph, rank, stats
from orrery.sources import parse
from orrery.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Frame:
    """The graph view of the tables. Roster, pool and candidates have at most 60 rows by their own limits and become
    local relations, so that the joins on them don't run the scans below again and nothing stays cached."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        t = lambda n: table(spark, sf_dir, n)
        place = t("customer").select("c_custkey", F.col("c_nationkey").alias("field"))
        region = t("nation").select(F.col("n_nationkey").alias("field"), F.col("n_regionkey").alias("domain"))
        self.works = t("orders").join(place, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(region), "field").select(F.col("o_orderkey").alias("id"), "field", "domain", F.col("o_totalprice").alias("cites"))
        self.refs = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref")).distinct()
        local = lambda df: spark.createDataFrame(df.limit(60).collect(), df.schema)
        self.seeds = local(graph.top_seeds(self.works))
        self.home = graph.dominant(self.seeds, "field").select("field")
        self.pool = local(graph.bridge_pool_by_citers(self.seeds, self.refs))
        self.candidates = local(graph.two_hop(self.works, self.refs, self.seeds, self.pool, self.home))
        self.cand_hits = graph.hits(self.candidates, self.refs, self.pool)
        self.seed_hits = graph.hits(self.seeds, self.refs, self.pool)


BASE_SQL = """
WITH works AS (SELECT o_orderkey AS id, c_nationkey AS field, n_regionkey AS domain, o_totalprice AS cites
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
refs AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem),
seeds AS (SELECT * FROM works ORDER BY cites DESC, id LIMIT 20),
home AS (SELECT field FROM seeds GROUP BY field HAVING count(*) >= 2 ORDER BY count(*) DESC, field LIMIT 2),
pool AS (SELECT ref, count(DISTINCT id) AS seed_citers FROM refs WHERE id IN (SELECT id FROM seeds) GROUP BY ref ORDER BY 2 DESC, 1 LIMIT 50),
cand AS (SELECT * FROM works w WHERE id NOT IN (SELECT id FROM seeds) AND field NOT IN (SELECT field FROM home) AND id IN (SELECT id FROM refs WHERE ref IN (SELECT ref FROM pool))),
found AS (SELECT r.id, r.ref, field FROM refs r JOIN cand c ON c.id = r.id WHERE ref IN (SELECT ref FROM pool)),
reach AS (SELECT ref, count(DISTINCT field) AS diversity FROM found GROUP BY ref),
ranked AS (SELECT c.*, count(DISTINCT f.ref) AS shared_bridge_count, max(diversity) AS bridge_betweenness, max(seed_citers) AS bridge_strength
           FROM cand c JOIN found f ON f.id = c.id JOIN reach USING (ref) JOIN pool USING (ref) GROUP BY ALL),
top60 AS (SELECT * FROM ranked ORDER BY bridge_betweenness DESC, shared_bridge_count DESC, cites DESC, id LIMIT 60),
hits AS (SELECT id, ref FROM refs WHERE id IN (SELECT id FROM top60) AND ref IN (SELECT ref FROM pool)),
seed_hits AS (SELECT id, ref FROM refs WHERE id IN (SELECT id FROM seeds) AND ref IN (SELECT ref FROM pool))
"""


@query(BASE_SQL + "SELECT id, field, domain, cites, shared_bridge_count, bridge_betweenness, bridge_strength FROM top60")
def bridge_two_hop(spark, sf):
    return Frame(spark, sf).candidates


@query(BASE_SQL + "SELECT p.ref, count(DISTINCT s.id) AS seed_citers, count(DISTINCT h.id) AS cand_citers FROM pool p LEFT JOIN seed_hits s ON s.ref = p.ref LEFT JOIN hits h ON h.ref = p.ref GROUP BY p.ref")
def bridge_usage(spark, sf):
    f = Frame(spark, sf)
    return graph.bridge_usage(f.pool, f.seed_hits, f.cand_hits)


@query(BASE_SQL + """, a AS (SELECT ref, count(*) AS n FROM hits GROUP BY ref), b AS (SELECT id, count(*) AS k FROM hits GROUP BY id)
SELECT (SELECT ref FROM a ORDER BY n DESC, ref DESC LIMIT 1) AS top_bridge, (SELECT max(n) FROM a) AS top_candidates, (SELECT count(*) FROM a) AS bridges_used,
       (SELECT count(*) FROM b) AS candidates, CAST((SELECT sum(k) FROM b) AS BIGINT) AS shared_total, (SELECT count(*) FROM b WHERE k = 1) AS single_bridge""")
def bridge_concentration(spark, sf):
    return graph.bridge_concentration(Frame(spark, sf).cand_hits)


@query(BASE_SQL + """, sizes AS (SELECT ref, count(*) AS size FROM refs WHERE ref IN (SELECT ref FROM pool) GROUP BY ref)
SELECT h.id, min(size) AS smallest, max(size) AS largest, CASE WHEN min(size) >= 20000 THEN '20k+' WHEN min(size) >= 5000 THEN '5k-20k' WHEN min(size) >= 1000 THEN '1k-5k' ELSE '<1k' END AS tier
FROM hits h JOIN sizes USING (ref) GROUP BY h.id""")
def bridge_size_tiers(spark, sf):
    f = Frame(spark, sf)
    sizes = f.refs.join(F.broadcast(f.pool.select("ref")), "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("size"))
    return graph.bridge_sizes(f.cand_hits, sizes).withColumn("tier", S.size_tier(F.col("smallest")))


@query(BASE_SQL + "SELECT s.id, count(DISTINCT h.ref) AS pool_refs FROM seeds s LEFT JOIN seed_hits h ON h.id = s.id GROUP BY s.id")
def seed_pool_coverage(spark, sf):
    f = Frame(spark, sf)
    return graph.seed_coverage(f.seeds, f.seed_hits)


@query(BASE_SQL + """, t AS (SELECT ref, CASE WHEN domain <= 1 THEN 'lexical' ELSE 'semantic' END AS leg FROM seed_hits JOIN seeds USING (id))
SELECT ref, CASE WHEN count(DISTINCT leg) = 2 THEN 'both' ELSE min(leg) END AS route FROM t GROUP BY ref""")
def seed_routes(spark, sf):
    f = Frame(spark, sf)
    leg = F.when(F.col("domain") <= 1, "lexical").otherwise("semantic")
    tagged = f.seed_hits.join(f.seeds.select("id", leg.alias("leg")), "id")
    return graph.route_split(tagged, "ref", "leg", ("lexical", "semantic"))


@query(BASE_SQL + """SELECT id, field, CASE WHEN field IN (SELECT field FROM seeds) THEN 'roster' WHEN field IN (SELECT field FROM works WHERE domain = 0) THEN 'pool' ELSE 'new' END AS filed FROM top60""")
def candidate_filing(spark, sf):
    f = Frame(spark, sf)
    return graph.filing(f.candidates.select("id", "field"), f.seeds.select("field"), f.works.where("domain = 0").select("field"), "field")


@query("""WITH refs AS (SELECT DISTINCT l_orderkey AS id FROM lineitem) SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM refs)""")
def dead_seed_gate(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("""SELECT DISTINCT l_partkey AS ref FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def live_bridge_filter(spark, sf):
    pool = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ref")).distinct()
    return graph.live_bridges(pool, table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")))


@query(BASE_SQL + "SELECT field, count(*) AS n FROM seeds GROUP BY field HAVING count(*) >= 2 ORDER BY n DESC, field LIMIT 2")
def dominant_fields(spark, sf):
    return graph.dominant(Frame(spark, sf).seeds, "field")


@query(BASE_SQL + "SELECT count(domain) AS known, count(*) FILTER (domain IN (0, 1)) AS home_n, count(*) FILTER (domain IS NULL) AS unknown FROM seeds")
def roster_alignment(spark, sf):
    return stats.alignment(Frame(spark, sf).seeds, F.col("domain"), [0, 1])


POOL_SQL = BASE_SQL.replace("WITH works", "WITH RECURSIVE works") + """, own AS (SELECT s.grp, r.ref, s.grp * 1000000 + r.ref AS pos FROM (SELECT id, CAST(row_number() OVER (ORDER BY cites DESC, id) - 1 AS INTEGER) AS grp FROM seeds) s JOIN refs r ON r.id = s.id),
q AS (SELECT ref, count(*) AS n, min(pos) AS first, arg_min(grp, pos) AS owner FROM own GROUP BY ref), g AS (SELECT max(grp) + 1 AS n FROM own),
one AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, first) AS rn FROM q WHERE n >= 2 QUALIFY rn <= 12), top AS (SELECT * FROM one ORDER BY n DESC, first LIMIT 50),
two(step, idle, got, used) AS (
  SELECT 0, 0, coalesce((SELECT list(ref ORDER BY n DESC, first) FROM top), []::BIGINT[]), (SELECT list((SELECT count(*) FROM top WHERE owner = i) ORDER BY i) FROM g, range(g.n) AS u(i)) UNION ALL
  SELECT step + 1, CASE WHEN x.ref IS NULL THEN idle + 1 ELSE 0 END, CASE WHEN x.ref IS NULL THEN got ELSE list_append(got, x.ref) END, CASE WHEN x.ref IS NULL THEN used ELSE list_transform(used, lambda u, i: CASE WHEN i - 1 = step % g.n THEN u + 1 ELSE u END) END
  FROM two, g, LATERAL (SELECT min(own.ref) AS ref FROM own WHERE own.grp = two.step % g.n AND NOT list_contains(two.got, own.ref) AND two.used[CAST(two.step % g.n AS BIGINT) + 1] < 12) x WHERE idle < g.n AND len(got) < 50),
fin AS (SELECT got FROM two ORDER BY step DESC LIMIT 1), tail AS (SELECT coalesce(list(ref ORDER BY first), []::BIGINT[]) AS t FROM q, fin WHERE NOT list_contains(got, ref))
SELECT 0 AS theme, CAST(i - 1 AS INTEGER) AS slot, list_concat(got, t)[i] AS ref FROM fin, tail, range(1, least(len(got) + len(t), 50) + 1) AS u(i)
"""


def _mentions(f: Frame) -> DataFrame:
    """What the seeds cite, in their order, each seed a group."""
    order = F.row_number().over(graph.W.orderBy(F.col("cites").desc(), "id")) - 1
    return f.seeds.select("id", order.alias("grp")).join(f.refs, "id").select(F.lit(0).alias("theme"), "grp", "ref", (F.col("grp") * 1_000_000 + F.col("ref")).alias("pos"))


@query(POOL_SQL[: POOL_SQL.index(",\ntwo(")] + " SELECT ref, n FROM top")
def bridge_pool_tier1(spark, sf):
    return graph.bridge_pool_tier1(_mentions(Frame(spark, sf)))


@query(POOL_SQL)
def bridge_pool_full(spark, sf):
    return diversify.pool_three_tiers(_mentions(Frame(spark, sf)))


@query(BASE_SQL + """, z AS (SELECT id, (bridge_strength - avg(bridge_strength) OVER ()) / nullif(stddev_pop(bridge_strength) OVER (), 0) AS zs, (ln(1 + cites) - avg(ln(1 + cites)) OVER ()) / nullif(stddev_pop(ln(1 + cites)) OVER (), 0) AS zc FROM top60)
SELECT id, CAST(floor((0.85 * coalesce(zs, 0) + 0.15 * coalesce(zc, 0)) * 10000 + 0.5) AS BIGINT) AS hybrid_e4 FROM z""")
def hybrid_rank(spark, sf):
    rows = rank.hybrid_score(Frame(spark, sf).candidates, ["bridge_strength"], "cites")
    return rows.select("id", F.floor(F.col("hybrid") * 10000 + 0.5).alias("hybrid_e4"))


@query(BASE_SQL + ", o AS (SELECT id, domain, CASE WHEN domain IN (SELECT domain FROM seeds ORDER BY cites DESC, id LIMIT 1) THEN 1 ELSE 0 END AS k, cites FROM top60) SELECT id, domain, CAST(row_number() OVER (ORDER BY k, cites DESC, id) AS INTEGER) AS slot FROM o")
def domain_first_fill(spark, sf):
    f = Frame(spark, sf)
    home = f.seeds.orderBy(F.col("cites").desc(), "id").limit(1).select(F.col("domain").alias("h"))
    rows = f.candidates.join(F.broadcast(home), F.col("domain") == F.col("h"), "left").withColumn("neg", -F.col("cites"))
    keys = rank.domain_first(rows, "domain", F.col("h").isNotNull(), "neg", "id")
    return rows.select("id", "domain", F.row_number().over(graph.W.orderBy(*keys)).alias("slot"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS bucket, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders)
SELECT id, bucket, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, bucket LIMIT 60""")
def facet_interleave(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("bucket"), "o_totalprice")
    return rank.interleave(rows, "bucket", F.col("o_totalprice").desc(), "id", limit=60).select("id", "bucket", "turn")


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders LIMIT 40), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders LIMIT 40),
a1 AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 40), b1 AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders QUALIFY pos <= 40),
u AS (SELECT id, pos, 0 AS leg FROM a1 UNION ALL SELECT id, pos, 1 FROM b1 WHERE id NOT IN (SELECT id FROM a1)), t AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY pos, id) AS turn FROM u)
SELECT id, leg, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, leg LIMIT 50""")
def merge_seed_pools(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")

    def head(*keys):
        top = o.orderBy(*keys, "id").limit(40)
        return top.select("id", F.row_number().over(graph.W.orderBy(*keys, "id")).alias("pos"))

    return rank.merge_pools(head(F.col("o_totalprice").desc()), head("o_orderdate"), limit=50).select("id", "leg", "turn")


def _scores(spark, sf):
    k = F.col("o_orderkey")
    two = lambda m: F.pmod(k * m, F.lit(100)) / 100.0
    depth = F.when(F.pmod(k, F.lit(7)) != 0, two(13))
    causal = F.when(F.pmod(k, F.lit(5)) != 0, F.pmod(k, F.lit(3)) != 0)
    rows = table(spark, sf, "orders").select(k.alias("id"), two(37).alias("purpose_sim"), two(53).alias("mechanism_dist"), depth.alias("structural_depth"), causal.alias("has_causal_pm"), (F.pmod(k, F.lit(4)) == 0).alias("near"))
    return gates.post_gates(rows)


GATE_SQL = """
WITH s AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 100) / 100.0::DOUBLE AS ps, (o_orderkey * 53 % 100) / 100.0::DOUBLE AS md, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 13 % 100) / 100.0::DOUBLE END AS depth,
                  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 <> 0 END AS causal, o_orderkey % 4 = 0 AS near FROM orders),
m AS (SELECT *, CASE WHEN near THEN least(md, 0.5::DOUBLE) ELSE md END AS mech FROM s),
c AS (SELECT *, coalesce(NOT causal AND ps > 0.45::DOUBLE, false) AS capped FROM m),
d AS (SELECT *, CASE WHEN capped THEN ps * mech * (0.45::DOUBLE / ps) ELSE ps * mech END AS ser, CASE WHEN capped THEN 0.45::DOUBLE ELSE ps END AS used, ps < 0.2::DOUBLE AS anomaly, coalesce(depth < 0.5::DOUBLE, false) AS hollow FROM c),
a AS (SELECT ser, row_number() OVER (ORDER BY ser DESC, id) AS rn, count(*) OVER () AS n FROM d WHERE NOT anomaly AND NOT hollow),
g AS (SELECT greatest(max(ser), 0.2::DOUBLE) AS gate FROM a WHERE rn = greatest(1, n * 3 // 10)),
r AS (SELECT d.*, gate, CASE WHEN anomaly THEN 'anomaly' WHEN hollow THEN 'hollow' WHEN ser < gate THEN 'percentile_gate' WHEN ser < 0.35::DOUBLE THEN 'output_floor' END AS rejected_by FROM d, g)
"""


@query(GATE_SQL + "SELECT id, rejected_by, capped, CASE WHEN mech <= used THEN 'mechanism_dist' ELSE 'purpose_sim' END AS binding, mech <= used AND used >= 0.7::DOUBLE AS near_but_useful, CAST(floor(ser * 1000000 + 0.5) AS BIGINT) AS ser_e6 FROM r")
def post_gates(spark, sf):
    return _scores(spark, sf).select("id", "rejected_by", "capped", "binding", "near_but_useful", F.floor(F.col("serendipity") * 1_000_000 + 0.5).alias("ser_e6"))


@query(GATE_SQL + "SELECT CAST(floor(gate * 1000000 + 0.5) AS BIGINT) AS gate_e6 FROM g")
def percentile_gate(spark, sf):
    return _scores(spark, sf).where("gate IS NOT NULL").select(F.floor(F.col("gate") * 1_000_000 + 0.5).alias("gate_e6")).distinct()


@query(GATE_SQL + "SELECT id, rejected_by AS floor, CASE rejected_by WHEN 'anomaly' THEN ps WHEN 'hollow' THEN depth ELSE ser END AS value, CASE rejected_by WHEN 'anomaly' THEN 0.2::DOUBLE WHEN 'hollow' THEN 0.5::DOUBLE WHEN 'percentile_gate' THEN gate ELSE 0.35::DOUBLE END AS threshold FROM r WHERE rejected_by IS NOT NULL")
def rejection_log(spark, sf):
    return gates.rejection_log(_scores(spark, sf))


@query(GATE_SQL + "SELECT count(*) AS scored, count(*) FILTER (rejected_by = 'anomaly') AS anomaly, count(*) FILTER (rejected_by = 'hollow') AS hollow, count(*) FILTER (rejected_by = 'percentile_gate') AS gated, count(*) FILTER (rejected_by = 'output_floor') AS floored, count(*) FILTER (rejected_by IS NULL) AS qualified, CASE WHEN count(*) FILTER (rejected_by IS NULL) = 0 THEN 'no_qualified' ELSE 'ok' END AS status FROM r")
def fallback_saturation(spark, sf):
    return gates.saturation(_scores(spark, sf))


@query("""SELECT l_orderkey AS id, median(l_quantity) AS purpose_sim, median(l_discount) AS depth, count(*) FILTER (l_returnflag = 'N') * 2 >= count(l_returnflag) AS causal, min(l_linestatus) AS reason, count(*) AS n_votes FROM lineitem GROUP BY 1""")
def vote_median_majority(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("purpose_sim"), F.col("l_discount").alias("depth"), (F.col("l_returnflag") == "N").alias("causal"), F.col("l_linestatus").alias("reason"), F.struct("l_linestatus", "l_linenumber").alias("vote"))
    return gates.vote_reduce(v)


def _tags(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("score"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return line.join(part, "p_partkey").select("id", "name", F.lit(1).alias("level"), "score")


TAG_SQL = "WITH t AS (SELECT l_orderkey AS id, p_brand AS name, l_quantity AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(TAG_SQL + " SELECT name, sum(score) AS weight, true AS broad FROM t GROUP BY name ORDER BY weight DESC, name LIMIT 20".replace("LIMIT 20", "LIMIT 25"))
def theme_profile(spark, sf):
    return stats.theme_profile(_tags(spark, sf), top=25)


@query(TAG_SQL + """, p AS (SELECT DISTINCT name FROM t WHERE id IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)), o AS (SELECT DISTINCT id, name FROM t),
n AS (SELECT id, count(*) AS n, count(*) FILTER (name IN (SELECT name FROM p)) AS inter FROM o GROUP BY id)
SELECT id, inter, n + (SELECT count(*) FROM p) - inter AS union_n, inter * 100 > (n + (SELECT count(*) FROM p) - inter) * 30 AS near FROM n""")
def near_domain(spark, sf):
    tags = _tags(spark, sf)
    top = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(2).select(F.col("o_orderkey").alias("id"))
    profile = tags.join(F.broadcast(top), "id").select("name").distinct().withColumn("broad", F.lit(True))
    return stats.near_domain(tags, profile)


@query(TAG_SQL + """, o AS (SELECT DISTINCT id, name FROM t WHERE id IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60)), n AS (SELECT id, count(*) AS n FROM o GROUP BY id)
SELECT x.id AS a, y.id AS b, count(*) AS inter, any_value(nx.n) + any_value(ny.n) - count(*) AS union_n FROM o x JOIN o y ON x.name = y.name AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY 1, 2""")
def concept_jaccard_pairs(spark, sf):
    top = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(60).select(F.col("o_orderkey").alias("id"))
    return stats.jaccard_pairs(_tags(spark, sf).join(F.broadcast(top), "id"))


def _bounded(spark, sf, n=60):
    top = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(n).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("score"), F.col("o_orderpriority").alias("facet"))
    names = _tags(spark, sf).groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return top.join(names, "id", "left").withColumn("theme", F.lit(0)).withColumn("pos", F.row_number().over(graph.W.orderBy(F.col("score").desc(), "id")))


LIST_SQL = TAG_SQL.replace("WITH t", "WITH RECURSIVE t") + """, top AS (SELECT o_orderkey AS id, o_totalprice / 1e6::DOUBLE AS score, o_orderpriority AS facet FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60),
c AS (SELECT top.*, row_number() OVER (ORDER BY score DESC, id) AS pos FROM top),
nm AS (SELECT DISTINCT id, name FROM t WHERE id IN (SELECT id FROM top)), k AS (SELECT id, count(*) AS n FROM nm GROUP BY id),
i AS (SELECT x.id AS a, y.id AS b, count(*) AS inter FROM nm x JOIN nm y USING (name) GROUP BY 1, 2),
s AS (SELECT p.id AS a, q.id AS b, coalesce(inter / (kp.n + kq.n - inter)::DOUBLE, 0) AS sim, kp.n IS NOT NULL AND kq.n IS NOT NULL AS named, p.facet = q.facet AS same
      FROM c p CROSS JOIN c q LEFT JOIN i ON i.a = p.id AND i.b = q.id LEFT JOIN k kp ON kp.id = p.id LEFT JOIN k kq ON kq.id = q.id)
"""


@query(LIST_SQL + """, r(slot, id, chosen) AS (SELECT 0, id, [id] FROM c WHERE pos = 1 UNION ALL
  SELECT r.slot + 1, x.id, list_append(chosen, x.id) FROM r, LATERAL (SELECT c.id FROM c JOIN s ON s.a = c.id WHERE list_contains(r.chosen, s.b) AND NOT list_contains(r.chosen, c.id) GROUP BY c.id, c.pos ORDER BY max(s.sim), c.pos LIMIT 1) x WHERE r.slot < 19)
SELECT slot, id FROM r""")
def maxmin_select(spark, sf):
    return diversify.farthest_first(_bounded(spark, sf), 20).select("slot", "id")


@query(TAG_SQL.replace("WITH t", "WITH RECURSIVE t") + """, nm AS (SELECT id, list(DISTINCT name) AS names FROM t GROUP BY id), w AS MATERIALIZED (SELECT o_orderpriority AS theme, o_orderkey AS id, coalesce(names, []::VARCHAR[]) AS names FROM orders LEFT JOIN nm ON nm.id = o_orderkey),
r(slot, theme, id, names, near, pick) AS (SELECT 0, theme, id, names, 0::DOUBLE, id = min(id) OVER (PARTITION BY theme) FROM w UNION ALL
  SELECT slot + 1, theme, id, names, near, row_number() OVER (PARTITION BY theme ORDER BY near, id) = 1 FROM (
    SELECT a.slot, a.theme, a.id, a.names, greatest(a.near, CASE WHEN len(list_intersect(a.names, b.names)) > 0 THEN len(list_intersect(a.names, b.names)) / (len(a.names) + len(b.names) - len(list_intersect(a.names, b.names)))::DOUBLE ELSE 0 END) AS near
    FROM r a JOIN r b ON a.theme = b.theme AND b.pick AND NOT a.pick WHERE a.slot < 7))
SELECT theme, CAST(slot AS INTEGER) AS slot, id FROM r WHERE pick""")
def maxmin_whole(spark, sf):
    names = _tags(spark, sf).groupBy("id").agg(F.collect_set("name").alias("names"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("theme"), F.col("o_orderkey").alias("pos")).join(names, "id", "left")
    return diversify.farthest_first_rounds(rows, 8).select("theme", "slot", "id")


SHARES_SQL = """WITH RECURSIVE r AS (SELECT DISTINCT l_partkey AS ref, l_orderkey AS id FROM lineitem), w AS (SELECT p_brand AS theme, ref, id, o_totalprice AS cites, CAST(o_custkey % 3 AS INTEGER) AS kind FROM r JOIN part ON ref = p_partkey JOIN orders ON id = o_orderkey),
b AS (SELECT p_brand AS theme, p_partkey AS ref, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn FROM part QUALIFY turn < 50),
g AS (SELECT theme, turn, id, kind, row_number() OVER (PARTITION BY theme, turn ORDER BY cites DESC, id) AS pos FROM w JOIN b USING (theme, ref) QUALIFY pos <= 12),
l AS MATERIALIZED (SELECT theme, turn, list(id ORDER BY kind, pos) AS ids FROM g GROUP BY theme, turn), s AS (SELECT DISTINCT theme, id, cites FROM w SEMI JOIN b USING (theme, ref)), e AS (SELECT theme, list(id ORDER BY cites DESC, id)[1:150] AS ids FROM s GROUP BY theme),
z(theme, turn, got) AS (SELECT DISTINCT theme, -1::BIGINT, []::BIGINT[] FROM b UNION ALL
  SELECT z.theme, z.turn + 1, list_concat(z.got, list_slice(list_filter(coalesce(l.ids, []::BIGINT[]), lambda x: NOT list_contains(z.got, x)), 1, greatest(least(3, 130 - len(z.got)), 0))) FROM z LEFT JOIN l ON l.theme = z.theme AND l.turn = z.turn + 1 WHERE z.turn < 49),
f AS (SELECT z.theme, list_concat(got, list_filter(e.ids, lambda x: NOT list_contains(got, x)))[1:130] AS ids FROM z JOIN e ON e.theme = z.theme WHERE turn = 49)
SELECT theme, CAST(i - 1 AS INTEGER) AS slot, ids[i] AS id FROM f, range(1, len(ids) + 1) AS u(i)"""


@query(SHARES_SQL)
def fair_shares_by_brand(spark, sf):
    """A fair share of every brand's candidates: its first 50 parts are the bridges, orders the candidates."""
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ref"), F.col("l_orderkey").alias("id")).distinct()
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("theme"), F.col("p_partkey").alias("ref"))
    bridges = parts.withColumn("turn", F.row_number().over(graph.W.partitionBy("theme").orderBy("ref")) - 1).where("turn < 50")
    works = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("cites"), (F.col("o_custkey") % 3).cast("int").alias("kind"))
    into = refs.join(bridges, "ref").join(works, "id")
    best = graph.W.partitionBy("theme", "turn").orderBy(F.col("cites").desc(), "id")
    pages = into.withColumn("pos", F.row_number().over(best)).where("pos <= 12")
    spare = into.select("theme", "id", "cites").distinct().withColumn("pos", F.row_number().over(graph.W.partitionBy("theme").orderBy(F.col("cites").desc(), "id"))).where("pos <= 150")
    return diversify.fair_shares(pages, spare, quota=3, limit=130).select("theme", "slot", "id")


@query(LIST_SQL + """, r(slot, id, chosen) AS (SELECT 0, id, [id] FROM c WHERE pos = 1 UNION ALL
  SELECT r.slot + 1, x.id, list_append(chosen, x.id) FROM r, LATERAL (SELECT c.id FROM c JOIN s ON s.a = c.id WHERE list_contains(r.chosen, s.b) AND NOT list_contains(r.chosen, c.id) GROUP BY c.id, c.pos, c.score
    ORDER BY 0.7::DOUBLE * c.score - (1 - 0.7::DOUBLE) * max(CASE WHEN s.named THEN s.sim WHEN s.same THEN 0.18::DOUBLE ELSE 0 END) DESC, c.pos LIMIT 1) x WHERE r.slot < 9)
SELECT slot, id FROM r""")
def mmr_rerank(spark, sf):
    return diversify.mmr(_bounded(spark, sf), 10).select("slot", "id")


@query(LIST_SQL + """, r(pos, head) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT c.pos, CASE WHEN len(r.head) < 10 AND (x.n = 0 OR x.least < 2) THEN list_append(r.head, c.id) ELSE r.head END FROM r JOIN c ON c.pos = r.pos + 1,
  LATERAL (SELECT count(*) AS n, min(y.m) AS least FROM (SELECT nm.name, (SELECT count(*) FROM nm z WHERE z.name = nm.name AND list_contains(r.head, z.id)) AS m FROM nm WHERE nm.id = c.id) y) x),
h AS (SELECT head FROM r ORDER BY pos DESC LIMIT 1)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN list_contains(head, id) THEN 0 ELSE 1 END, pos) - 1 AS INTEGER) AS slot, id FROM c, h""")
def head_window(spark, sf):
    return diversify.head_window(_bounded(spark, sf).withColumnRenamed("names", "bridges")).select("slot", "id")


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "n_chars")


DOC_SQL = "WITH d AS (SELECT doc_id AS id, text, lang, split_part(text, chr(10), 1) AS title, n_chars FROM documents)"
KEY_SQL = DOC_SQL + r""", k AS (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS tk, regexp_replace(regexp_replace(ltrim(lower(text)), '^(?:(?:abstract|summary|preliminary and incomplete|preliminary draft)\b[\s:.\-–—]*)+', ''), '[^a-z0-9]+', '', 'g') AS ak FROM d)"""


@query(KEY_SQL + " SELECT ak AS k, min(id) AS id, count(*) AS n FROM (SELECT id, substr(ak, 1, 200) AS ak FROM k WHERE length(ak) >= 200) GROUP BY ak HAVING count(*) > 1")
def abstract_key_dedup(spark, sf):
    k = _docs(spark, sf).select("id", T.abstract_key(F.col("text")).alias("k")).where("k <> ''")
    return k.groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")


@query(KEY_SQL + " SELECT tk AS k, min(id) AS id, count(*) AS n FROM k WHERE tk <> '' GROUP BY tk")
def title_key_dedup(spark, sf):
    return _docs(spark, sf).select("id", T.title_key(F.col("title")).alias("k")).where("k <> ''").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(KEY_SQL + ", n AS (SELECT k.id, tk, n_chars FROM k JOIN d ON d.id = k.id WHERE tk <> '') SELECT tk AS k, arg_max(id, (n_chars, -id)) AS id FROM n GROUP BY tk".replace("arg_max(id, (n_chars, -id))", "(list(id ORDER BY n_chars DESC, id))[1]"))
def record_standing(spark, sf):
    k = _docs(spark, sf).select("id", "n_chars", T.title_key(F.col("title")).alias("k")).where("k <> ''")
    return rank.first_wins(k.withColumn("less", -F.col("n_chars")), "k", "less", "id").select("k", "id")


@query(KEY_SQL.replace("WITH d", "WITH RECURSIVE d") + """, a AS (SELECT id, tk, CASE WHEN length(ak) >= 200 THEN substr(ak, 1, 200) ELSE '' END AS ak FROM k),
s AS (SELECT id, min(id) OVER (PARTITION BY tk) AS hub FROM a WHERE tk <> '' UNION SELECT id, min(id) OVER (PARTITION BY ak) FROM a WHERE ak <> ''),
e AS (SELECT id AS a, hub AS b FROM s WHERE id <> hub UNION SELECT hub, id FROM s WHERE id <> hub),
r(id, g) AS (SELECT id, id FROM a UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.g)
SELECT id, min(g) AS grp FROM r GROUP BY id""")
def duplicate_components(spark, sf):
    rows = _docs(spark, sf).select("id", T.title_key(F.col("title")).alias("tk"), T.abstract_key(F.col("text")).alias("ak"))
    return dedup.duplicate_groups(rows.select("id"), dedup.key_edges(rows, ["tk", "ak"]))


FIRST_WINS_SQL = KEY_SQL.replace("WITH d", "WITH RECURSIVE d") + r""", w AS (SELECT id, n_chars, coalesce(title, '') AS t, regexp_extract(coalesce(title, ''), '\.\s+([^.]{1,60})$', 1) AS tail, regexp_replace(coalesce(title, ''), '\.\s+([^.]{1,60})$', '') AS head FROM d),
c AS (SELECT id, n_chars, trim(regexp_replace(split_part(lower(CASE WHEN tail <> '' AND len(list_filter(string_split_regex(tail, '\s+'), lambda x: x <> '')) <= 6 AND len(list_filter(string_split_regex(head, '\s+'), lambda x: x <> '')) >= 4 AND NOT regexp_matches(tail, '(?i)^(?:part|vol|volume|chapter|section|[ivx]+|\d)\b') THEN head ELSE t END), ':', 1), '\s+', ' ', 'g')) AS h FROM w),
m AS (SELECT c.id, n_chars AS st, trim(regexp_replace(regexp_replace(h, '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS tk, CASE WHEN length(ak) >= 200 THEN substr(ak, 1, 200) ELSE '' END AS ak FROM c JOIN k ON k.id = c.id),
f AS (SELECT *, ak = '' OR id = min(id) OVER (PARTITION BY ak) AS sure FROM m), g AS (SELECT *, first_value(sure) OVER o AS hs, first_value(st) OVER o AS hst, min(id) OVER (PARTITION BY tk) AS hid FROM f WINDOW o AS (PARTITION BY tk ORDER BY id)),
live AS (SELECT id, st, tk, ak FROM g WHERE tk = '' OR NOT (hs AND id > hid AND st <= hst)),
s AS (SELECT id, min(id) OVER (PARTITION BY tk) AS hub FROM live WHERE tk <> '' UNION SELECT id, min(id) OVER (PARTITION BY ak) FROM live WHERE ak <> ''), e AS (SELECT id AS a, hub AS b FROM s WHERE id <> hub UNION SELECT hub, id FROM s WHERE id <> hub),
r(id, g) AS (SELECT id, id FROM live UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.g), th AS (SELECT id, min(g) AS theme FROM r GROUP BY id),
q AS (SELECT live.*, theme, row_number() OVER (PARTITION BY theme ORDER BY live.id) AS rn FROM live JOIN th ON th.id = live.id),
z(theme, rn, ids, sts, keys, spots) AS (SELECT theme, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::VARCHAR[], []::BIGINT[] FROM q WHERE rn = 1 UNION ALL
  SELECT y.theme, y.next, CASE WHEN y.at IS NULL THEN list_append(y.ids, y.id) WHEN y.st > y.sts[y.at] THEN list_transform(y.ids, lambda x, i: CASE WHEN i = y.at THEN y.id ELSE x END) ELSE y.ids END,
    CASE WHEN y.at IS NULL THEN list_append(y.sts, y.st) WHEN y.st > y.sts[y.at] THEN list_transform(y.sts, lambda x, i: CASE WHEN i = y.at THEN y.st ELSE x END) ELSE y.sts END,
    CASE WHEN y.at IS NULL OR y.st > y.sts[y.at] THEN list_concat(y.keys, y.fresh) ELSE y.keys END, CASE WHEN y.at IS NULL OR y.st > y.sts[y.at] THEN list_concat(y.spots, list_transform(y.fresh, lambda x: coalesce(y.at, len(y.ids) + 1))) ELSE y.spots END
  FROM (SELECT z.*, q.id, q.st, q.rn AS next, coalesce(z.spots[nullif(list_position(z.keys, 't:' || q.tk), 0)], z.spots[nullif(list_position(z.keys, 'a:' || q.ak), 0)]) AS at, list_filter([CASE WHEN q.tk <> '' THEN 't:' || q.tk END, CASE WHEN q.ak <> '' THEN 'a:' || q.ak END], lambda x: x IS NOT NULL AND NOT list_contains(z.keys, x)) AS fresh
    FROM z JOIN q ON q.theme = z.theme AND q.rn = z.rn + 1) y),
fin AS (SELECT theme, ids, row_number() OVER (PARTITION BY theme ORDER BY rn DESC) AS back FROM z)
SELECT theme, CAST(i - 1 AS INTEGER) AS slot, ids[i] AS id FROM fin, range(1, len(ids) + 1) AS u(i) WHERE back = 1"""


@query(FIRST_WINS_SQL)
def multi_key_first_wins(spark, sf):
    rows = _docs(spark, sf).select("id", T.title_match_key(F.col("title")).alias("tk"), T.abstract_key(F.col("text")).alias("ak"), F.col("id").alias("pos"), F.col("n_chars").alias("standing"))
    return diversify.keep_first_in_components(rows, ["tk", "ak"]).select("theme", "slot", "id")


@query(KEY_SQL + r""", b AS (SELECT trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS tk, item_id FROM benchmark) SELECT id FROM k WHERE tk NOT IN (SELECT tk FROM b WHERE tk <> '') AND id NOT IN (SELECT item_id FROM b)""")
def history_anti_join(spark, sf):
    d = _docs(spark, sf).select("id", T.title_key(F.col("title")).alias("tk"), F.lit("").alias("dk"))
    b = table(spark, sf, "benchmark")
    titles = b.select(T.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("tk"))
    return dedup.exclude_used(d, b.select(F.col("item_id").cast("string")), titles, titles.where("false"), id_key="id", title_key="tk", doi_key="dk").select("id")


STOP = ("the", "and", "for", "that", "with", "this", "are", "was", "from")


@query(DOC_SQL + r""", w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}')) AS term FROM (SELECT * FROM d WHERE lang = 'en' ORDER BY id LIMIT 20))
SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM w WHERE term NOT IN ('the', 'and', 'for', 'that', 'with', 'this', 'are', 'was', 'from') GROUP BY term HAVING count(DISTINCT id) >= 2 ORDER BY df DESC, tf DESC, term LIMIT 6""")
def prf_salient_terms(spark, sf):
    return stats.salient_terms(_docs(spark, sf).where("lang = 'en'").orderBy("id").limit(20), stop=STOP)


WORDS = ("the", "is the", "of that", "with")


@query(DOC_SQL + r""", p AS (SELECT id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS b, greatest(length(text), 1000) / 10000.0::DOUBLE AS u FROM d),
k(i, w) AS (VALUES (1, ' the '), (2, ' is the '), (3, ' of that '), (4, ' with ')),
c AS (SELECT id, i, CASE WHEN contains(s, w) THEN 1.0::DOUBLE WHEN trim(b) <> '' THEN least(((length(b) - length(replace(b, w, ''))) // length(w)) / u, 1.0::DOUBLE) ELSE 0.0 END AS credit FROM p, k)
SELECT id, CAST(floor(sum(credit ORDER BY i) * 1000000 + 0.5) AS BIGINT) AS credit_e6 FROM c GROUP BY id""")
def keyword_fit(spark, sf):
    fit = T.keyword_fit(F.col("title"), F.col("text"), WORDS, scale=30)
    return _docs(spark, sf).select("id", fit.alias("f")).select("id", "f.credit_e6")


@query(DOC_SQL + r""", p AS (SELECT ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS b FROM d), k(keyword) AS (VALUES ('the'), ('is the'), ('of that'), ('with'))
SELECT keyword, count(*) FILTER (contains(s, ' ' || keyword || ' ')) AS strong, count(*) FILTER (NOT contains(s, ' ' || keyword || ' ') AND contains(b, ' ' || keyword || ' ')) AS readme, count(*) FILTER (contains(s, ' ' || keyword || ' ') OR contains(b, ' ' || keyword || ' ')) AS total FROM p, k GROUP BY keyword""")
def pool_keyword_breakdown(spark, sf):
    return stats.keyword_breakdown(_docs(spark, sf), WORDS, F.col("title"), F.col("text"))


@query(DOC_SQL + r""", n AS (SELECT id, list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')) AS a, list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')) AS b FROM d)
SELECT id, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS n_unsupported FROM n""")
def numeric_guard(spark, sf):
    return _docs(spark, sf).select("id", F.size(T.unsupported_numbers(F.col("text"), F.col("title"))).cast("long").alias("n_unsupported"))


FOLD_SQL = "replace(replace(lower(regexp_replace(coalesce({0}, ''), '\\s+', '', 'g')), 'ß', 'ss'), 'µ', 'μ')"


@query("""WITH u AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
q AS (SELECT conv_id, turn, role, text, """ + FOLD_SQL.format("text") + """ AS own, """ + FOLD_SQL.format("substr(text, 1, 24)") + """ AS theme, """ + FOLD_SQL.format("before") + """ AS hay, """ + FOLD_SQL.format("role || ' ' || coalesce(before, '')") + """ AS source FROM u)
SELECT conv_id, turn, CASE WHEN text = '' OR text IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN length(theme) < 10 THEN 'theme_missing' WHEN hay = '' THEN 'theme_unverifiable' WHEN NOT contains(hay, theme) THEN 'theme_mismatch' END,
  CASE WHEN length(own) < 10 THEN 'source_missing' WHEN source = '' THEN 'source_unverifiable' WHEN NOT contains(source, own) THEN 'source_mismatch' END], lambda x: x IS NOT NULL), ',') END AS failures FROM q""")
def grounding_check(spark, sf):
    w = graph.W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf, "conversations").withColumn("abstract", F.lag("text").over(w))
    rows = c.select("conv_id", "turn", F.col("role").alias("title"), "abstract", F.col("text").alias("relationship"), F.lit("").alias("serendipity_rationale"), F.substring("text", 1, 24).alias("theme_quote"), F.col("text").alias("source_quote"))
    return rows.select("conv_id", "turn", F.array_join(contract.grounding(F.col("abstract")), ",").alias("failures"))


@query(DOC_SQL + " SELECT lang, count(*) AS n FROM d WHERE lang IS NULL OR trim(lower(lang)) IN ('', 'en') GROUP BY lang")
def language_gate(spark, sf):
    return _docs(spark, sf).where(gates.language_matches(F.col("lang"), "en")).groupBy("lang").agg(F.count("*").alias("n"))


@query(DOC_SQL + r" SELECT id, length(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?()\[\]\-''\"%/&@+=°ãμ ]', '', 'g')) AS good, length(text) AS total FROM d")
def prose_ratio(spark, sf):
    d = _docs(spark, sf)
    return d.select("id", F.floor(T.prose_ratio(F.col("text")) * F.length("text") + 0.5).alias("good"), F.length("text").cast("long").alias("total"))


@query(DOC_SQL + r", l AS (SELECT id, regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g') AS s FROM d) SELECT id, length(s) AS letters, length(regexp_replace(s, '[\x{0}-\x{24F}]', '', 'g')) AS non_latin FROM l")
def non_latin_share(spark, sf):
    letters, far = T.letter_counts(F.col("text"))
    return _docs(spark, sf).select("id", letters.cast("long").alias("letters"), far.cast("long").alias("non_latin"))


@query("""SELECT doc_id AS id, text AS restored FROM documents""")
def inverted_index_restore(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), parse.inverted_index(F.col("text")).alias("index"))
    return d.select("id", F.when(F.col("index").isNotNull(), parse.restore_abstract(F.col("index"))).alias("restored"))


@query(r"""WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<ref-list\b.*?</ref-list>', ' ', 'g'), '(?is)<fig\b.*?</fig>', ' ', 'g'), '(?is)<table-wrap\b.*?</table-wrap>', ' ', 'g'), '(?is)<math\b.*?</math>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM d""")
def html_body_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", parse.html_text(F.col("html")).alias("body"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM embeddings, q)
SELECT vec_id FROM s ORDER BY c DESC, vec_id LIMIT 50""")
def semantic_topk(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    q = e.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))
    return e.join(F.broadcast(q), how="cross").orderBy(cos.desc(), "vec_id").limit(50).select("vec_id")  # one query row


@query("""SELECT CAST(vec_id % 20 AS BIGINT) AS facet, count(*) AS n, count(*) FILTER (label < 5) AS home_n, count(*) >= 3 AND count(*) FILTER (label < 5) * 100 <= count(*) * 60 AND count(*) - count(*) FILTER (label < 5) >= 1 AS valid FROM embeddings GROUP BY 1""")
def facet_validity(spark, sf):
    return stats.facet_validity(table(spark, sf, "embeddings").select(F.pmod("vec_id", F.lit(20)).alias("facet"), (F.col("label") < 5).alias("home")))


RELIABILITY_SQL = """
WITH r AS (SELECT o_orderkey AS id, CAST(o_totalprice AS BIGINT) % 700 AS stars, o_custkey % 60 AS forks, o_orderkey % 9 AS opened, o_custkey % 11 AS closed, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) AS days FROM orders),
t AS (SELECT *, CASE WHEN days <= 14 THEN 25 WHEN days <= 45 THEN 20 WHEN days <= 90 THEN 15 WHEN days <= 180 THEN 10 WHEN days <= 365 THEN 5 ELSE 1 END AS fresh FROM r),
l AS (SELECT *, CASE WHEN (stars >= 50 OR forks >= 10) AND closed > 0 AND closed >= opened THEN greatest(fresh, CASE WHEN stars >= 200 THEN 15 ELSE 12 END) ELSE fresh END AS lma FROM t)
"""


def _reliability(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), (F.round("o_totalprice").cast("long") % 700).alias("stars"), (F.col("o_custkey") % 60).alias("forks"), (F.col("o_orderkey") % 9).alias("opened"), (F.col("o_custkey") % 11).alias("closed"), F.greatest(F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")), F.lit(0)).alias("days"))
    return r.withColumn("lma", S.maintenance(F.col("days"), F.col("stars"), F.col("forks"), F.col("opened"), F.col("closed")))


@query(RELIABILITY_SQL.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)") + """SELECT id, lma, CASE WHEN days <= 30 THEN 15 WHEN days <= 90 THEN 12 WHEN days <= 180 THEN 8 WHEN days <= 365 THEN 4 ELSE 1 END AS activity,
CASE WHEN stars >= 500 THEN 15 WHEN stars >= 100 THEN 12 WHEN stars >= 30 THEN 8 WHEN stars >= 5 THEN 4 WHEN stars > 0 THEN 1 ELSE 0 END AS adoption,
CASE WHEN stars < 10 THEN CASE WHEN forks > 0 THEN 5 ELSE 0 END WHEN forks * 10 >= stars THEN 10 WHEN forks * 20 >= stars THEN 7 WHEN forks * 50 >= stars THEN 4 ELSE 1 END AS fork_star FROM l""")
def reliability_tiers(spark, sf):
    r = _reliability(spark, sf)
    return r.select("id", "lma", S.activity(F.col("days")).alias("activity"), S.adoption(F.col("stars")).alias("adoption"), S.fork_to_star(F.col("stars"), F.col("forks")).alias("fork_star"))


@query(RELIABILITY_SQL.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)").replace("FROM orders)", "FROM orders)", 1) + """, p AS (SELECT l.*, o_orderpriority AS pool FROM l JOIN orders ON o_orderkey = id),
s AS (SELECT id, lma, 2 + (count(*) OVER (PARTITION BY pool) - count(*) OVER (PARTITION BY pool ORDER BY days)) * 10 / CAST(greatest(count(*) OVER (PARTITION BY pool) - 1, 1) AS DOUBLE) AS rel FROM p)
SELECT id, greatest(lma, CAST(round_even(rel, 0) AS INTEGER)) AS lifted FROM s""")
def pool_relative_lift(spark, sf):
    r = _reliability(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pool")), "id")
    return S.pool_relative(r, "days", "lma", "pool").select("id", F.col("lma").alias("lifted"))


@query("""WITH a AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS INTEGER) AS reliability, CAST(s_suppkey * 13 % 31 AS INTEGER) AS fit FROM supplier), r AS (SELECT *, least(greatest(fit / 30.0::DOUBLE, 0), 1) AS rel FROM a)
SELECT id, CAST(floor(reliability * (0.35::DOUBLE + 0.65::DOUBLE * rel) * 10000 + 0.5) AS BIGINT) AS score_e4, CASE WHEN rel >= 0.67::DOUBLE THEN '高' WHEN rel >= 0.35::DOUBLE THEN '中' ELSE '低' END AS level,
CAST(row_number() OVER (ORDER BY CASE WHEN rel > 0 THEN 0 ELSE 1 END, reliability * (0.35::DOUBLE + 0.65::DOUBLE * rel) DESC, id) AS INTEGER) AS place FROM r""")
def anchor_rank(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 101).cast("int").alias("reliability"), (F.col("s_suppkey") * 13 % 31).cast("int").alias("fit"))
    a = a.withColumn("relevance", S.relevance(F.col("fit"), 30)).withColumn("anchor_rank_score", S.anchor_score(F.col("reliability"), F.col("relevance")))
    a = rank.anchor_places(a)
    return a.select("id", F.floor(F.col("anchor_rank_score") * 10000 + 0.5).alias("score_e4"), S.relevance_level(F.col("relevance")).alias("level"), F.col("place").cast("int").alias("place"))


@query("""WITH r AS (SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS run, o_custkey AS key FROM orders), f AS (SELECT *, min(run) OVER (PARTITION BY key) AS first FROM r)
SELECT run, count(*) AS fetched, count(*) FILTER (first < run) AS recycled, count(*) FILTER (first = run) AS fresh FROM f GROUP BY run""")
def depletion_yield(spark, sf):
    o = table(spark, sf, "orders").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("run"), F.col("o_custkey").alias("key"))
    return stats.depletion(o, "run", "key")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def request_telemetry(spark, sf):
    return telemetry.windowed_rates(table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH refs AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS ref FROM lineitem), l AS (SELECT id, count(*) AS n, md5(CAST(list(ref ORDER BY ref) AS VARCHAR)) AS h FROM refs GROUP BY id HAVING count(*) >= 10), m AS (SELECT *, min(id) OVER (PARTITION BY n, h) AS rep FROM l), n AS (SELECT id, n FROM m WHERE id = rep)
SELECT rep AS a, id AS b FROM m WHERE id <> rep UNION ALL
SELECT x.id AS a, y.id AS b FROM refs x JOIN refs y ON x.ref = y.ref AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY 1, 2 HAVING count(*) * 100 >= (any_value(nx.n) + any_value(ny.n) - count(*)) * 18""")
def shared_reference_pairs(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("ref")).distinct()
    return graph.shared_reference_pairs(refs, percent=18)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1994 AND 1996 AND o_custkey % 25 IN (3, 7)")
def structured_query(spark, sf):
    o = table(spark, sf, "orders")
    works = o.select(F.col("o_orderkey").alias("id"), F.lit("").alias("title"), F.lit("").alias("abstract"), (F.col("o_custkey") % 25).cast("string").alias("field_id"), F.lit(None).cast("string").alias("topic_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type"), F.array().cast("array<string>").alias("refs"), F.array().cast("array<string>").alias("concept_ids"))
    return gates.StructuredQuery(field_ids=("3", "7"), year_from=1994, year_to=1996, work_type="F").apply(works).select("id")


@query("""SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 0) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)""")
def fallback_scan(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return gates.fallback_if_empty(o.where("o_totalprice < 0"), o).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey * 37 % 120000 AS d, p_partkey * 13 % 1200 AS l, p_partkey * 7 % 600 AS v, p_size / 50.0::DOUBLE AS u FROM part)
SELECT id, CASE WHEN d >= 100000 THEN 25 WHEN d >= 10000 THEN 20 WHEN d >= 1000 THEN 14 WHEN d >= 100 THEN 8 WHEN d >= 10 THEN 4 WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN l >= 1000 THEN 15 WHEN l >= 200 THEN 12 WHEN l >= 50 THEN 8 WHEN l >= 10 THEN 4 WHEN l > 0 THEN 1 ELSE 0 END AS hub,
least(CASE WHEN d >= 100000 THEN 22 WHEN d >= 10000 THEN 18 WHEN d >= 1000 THEN 12 WHEN d >= 100 THEN 7 WHEN d >= 10 THEN 3 WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN v >= 1000 THEN 12 WHEN v >= 200 THEN 9 WHEN v >= 50 THEN 6 WHEN v >= 10 THEN 3 WHEN v > 0 THEN 1 ELSE 0 END + CAST(round_even(greatest(least(u, 1), 0) * 6, 0) AS INTEGER), 40) AS dataset,
CASE WHEN v >= 500 THEN 28 WHEN v >= 100 THEN 22 WHEN v >= 30 THEN 15 WHEN v >= 10 THEN 9 WHEN v >= 3 THEN 4 WHEN v > 0 THEN 1 ELSE 0 END AS notebook FROM p""")
def hub_tiers(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 120000).alias("d"), (F.col("p_partkey") * 13 % 1200).alias("l"), (F.col("p_partkey") * 7 % 600).alias("v"), (F.col("p_size") / 50.0).alias("u"))
    return p.select("id", S.hub_adoption(F.col("d"), F.col("l")).alias("hub"), S.dataset_adoption(F.col("d"), F.col("v"), F.col("u")).alias("dataset"), S.notebook_adoption(F.col("v"), F.lit("")).alias("notebook"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 8 AS r, s_suppkey * 3 % 11 AS ok, s_suppkey * 5 % 13 AS runs, s_suppkey % 10 AS ext, s_suppkey * 7 % 9 AS rep FROM supplier)
SELECT id, CASE WHEN r >= 6 THEN 6 WHEN r >= 3 THEN 4 WHEN r >= 1 THEN 2 ELSE 0 END AS cadence, CASE WHEN runs <= 0 THEN 0 ELSE 3 + CASE WHEN ok * 5 >= runs * 4 THEN 3 WHEN ok * 2 >= runs THEN 1 ELSE 0 END END AS ci,
CASE WHEN ext >= 8 THEN 3 WHEN ext >= 3 THEN 2 WHEN ext >= 1 THEN 1 ELSE 0 END + CASE WHEN rep >= 5 THEN 3 WHEN rep >= 3 THEN 2 WHEN rep >= 1 THEN 1 ELSE 0 END AS people FROM s""")
def signal_tiers(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), S.release_cadence(k % 8).alias("cadence"), S.ci_health(k * 3 % 11, k * 5 % 13).alias("ci"), S.third_party(k % 10, k * 7 % 9).alias("people"))


@query("""WITH e AS (SELECT user_id, event_id, value, event_type = 'click' AS is_pr, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS pos FROM events QUALIFY pos < 100),
f AS (SELECT *, count(*) FILTER (pos < 5 AND NOT is_pr) OVER (PARTITION BY user_id) AS near, sum(CASE WHEN is_pr THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM e),
u AS (SELECT *, NOT is_pr AND CASE WHEN near > 0 THEN pos < 5 ELSE nth <= 5 END AS used FROM f)
SELECT CAST(user_id AS VARCHAR) AS repo, count(*) FILTER (used) AS issues, count(*) FILTER (used AND event_id % 2 = 0) AS opened, count(*) FILTER (used AND event_id % 2 = 1) AS closed, count(DISTINCT CASE WHEN used AND event_id % 7 <> 0 THEN event_id % 7 END) AS reporters FROM u GROUP BY 1""")
def issue_signals(spark, sf):
    from orrery.sources import anchors

    pos = F.row_number().over(graph.W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1
    login = F.when(F.col("event_id") % 7 == 0, "").otherwise((F.col("event_id") % 7).cast("string"))
    items = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("repo"), F.lit("owner").alias("owner"), pos.alias("pos"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed").alias("state"), F.lit("").alias("body"), login.alias("login"), F.array().cast("array<string>").alias("labels"), (F.col("event_type") == "click").alias("is_pr"))
    return anchors.issue_signal(items).select("repo", "issues", "opened", "closed", "reporters")


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS leg, row_number() OVER (PARTITION BY o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey) - 1 AS own FROM orders)
SELECT CAST(id AS VARCHAR) AS full_name, leg FROM o ORDER BY CASE leg WHEN 0 THEN own // 2 ELSE own END, leg, own LIMIT 30""")
def search_pool_turns(spark, sf):
    from orrery.sources import anchors

    leg = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    legs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("full_name"), leg.alias("leg"), F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias("pos"))
    return anchors.seat_by_turns(legs, [2, 1], limit=30).select("full_name", "leg")


@query(r"""WITH p AS (SELECT page_id, url FROM pages) SELECT page_id, regexp_extract(url, '[^/]*$') AS tail, substr(sha256(url), 1, 16) AS hash, trim(regexp_replace(translate(url, ',|!:', '    '), '\s+', ' ', 'g')) AS clean FROM p""")
def scalar_keys(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.strip_id(u).alias("tail"), T.theme_hash(u).alias("hash"), T.sanitize_filter_value(u).alias("clean"))


@query("""SELECT day, CAST(floor(spent * 10000 + 0.5) AS BIGINT) AS spent_e4, n >= 100 AS exhausted FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS n, n * 0.001::DOUBLE AS spent FROM events GROUP BY 1)""")
def budget_meter(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return telemetry.budget(e, {"click": 0.001}, 0.1, group=["day"]).select("day", F.floor(F.col("spent") * 10000 + 0.5).alias("spent_e4"), "exhausted")
