"""Named queries of records: null-open filters, hubs, repositories and notebooks, taxonomies, history, materials, full texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery import sinks
from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import collect, gates, graph, history, rank, taxonomy
from orrery.plans.catalog import BASE_SQL, DOC_SQL, Frame, _docs, query, table
from orrery.sources import anchors, fulltext, parse, readers


@query(DOC_SQL + r""", r AS (SELECT id, title, text, lang, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'article' WHEN id % 4 = 2 THEN 'conference-paper' ELSE 'review' END AS kind, id % 3 = 0 AS oa, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END AS home FROM d)
SELECT id, NOT (starts_with(upper(coalesce(title, '')), 'RETRACTED:') OR starts_with(upper(coalesce(title, '')), 'WITHDRAWN:')) AS live, length(trim(coalesce(text, ''))) > 0 AS abstracted, coalesce(kind IN ('article', 'conference-paper'), true) AS allowed, coalesce(lower(trim(lang)), '') IN ('', 'en') AS spoken,
coalesce(home NOT IN (1, 2), true) AS outside, coalesce(home IN (1, 2), true) AS inside, oa AND length(coalesce(text, '')) < 280 AS wanting, trim(coalesce(title, '')) <> '' OR length(trim(coalesce(text, ''))) > 0 AS material FROM r""")
def null_open_filters(spark, sf):
    i = F.col("id")
    kind = F.when(i % 4 == 1, "article").when(i % 4 == 2, "conference-paper").when(i % 4 == 3, "review")
    rows = _docs(spark, sf).select("id", "title", F.col("text").alias("abstract"), "lang", kind.alias("kind"), (i % 3 == 0).alias("oa"), F.when(i % 5 != 0, i % 5).alias("home"), F.lit(False).alias("is_retracted"))
    homes = spark.createDataFrame([(1,), (2,)], "home long")
    tag = lambda df, c: df.select("id", F.lit(True).alias(c))
    live, out, inside = tag(gates.drop_retracted(rows), "live"), tag(gates.exclude_home(rows, homes, "home"), "outside"), tag(gates.keep_home(rows, homes, "home"), "inside")
    got = rows.select("id", gates.has_abstract().alias("abstracted"), gates.type_allowed(F.col("kind"), "article").alias("allowed"), gates.language_matches(F.col("lang"), "en").alias("spoken"), gates.needs_fulltext(F.col("oa"), F.col("abstract")).alias("wanting"), gates.has_material().alias("material"))
    for side in (live, out, inside):
        got = got.join(side, "id", "left")
    return got.fillna(False, ["live", "outside", "inside"])


@query(DOC_SQL + " SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN length(trim(coalesce(text, ''))) > 0 AND id % 3 <> 0 THEN 0 ELSE 1 END, id) AS INTEGER) AS place FROM d")
def abstract_first(spark, sf):
    rows = _docs(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("text")).alias("abstract"), F.col("id").alias("pos"))
    order = gates.abstract_first()
    return rank.places(rows, *order).select("id", F.col("place").cast("int").alias("place"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://openalex.org/W' || page_id WHEN 1 THEN 'w' || page_id WHEN 2 THEN 'https://doi.org/10.1/' || page_id WHEN 3 THEN 'W' || page_id || 'x' ELSE url END AS raw FROM pages)
SELECT page_id, CASE WHEN regexp_matches(raw, '^(?:https?://openalex\.org/)?[Ww]\d+$') THEN 'W' || regexp_extract(raw, '\d+$') END AS work_id, NOT regexp_matches(coalesce(raw, ''), '^(?:https?://openalex\.org/)?[Ww]\d+$') AS malformed,
CASE WHEN regexp_matches(coalesce(raw, ''), 'W\d+') THEN regexp_extract(raw, 'W\d+') ELSE coalesce(raw, '') END AS short, regexp_replace(lower(trim(coalesce(raw, ''))), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|doi:)', '') AS doi,
coalesce(nullif(regexp_replace(CASE WHEN regexp_extract(coalesce(raw, ''), '[^/]*$') = '' THEN coalesce(raw, '') ELSE regexp_extract(raw, '[^/]*$') END, '[^A-Za-z0-9_.-]', '_', 'g'), ''), 'work') AS cached FROM p""")
def id_forms(spark, sf):
    k = F.col("page_id")
    s = k.cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("https://openalex.org/W"), s)).when(k % 5 == 1, F.concat(F.lit("w"), s)).when(k % 5 == 2, F.concat(F.lit("https://doi.org/10.1/"), s)).when(k % 5 == 3, F.concat(F.lit("W"), s, F.lit("x"))).otherwise(F.col("url"))
    got = gates.malformed_ids(table(spark, sf, "pages").select("page_id", raw.alias("id")))
    return got.select("page_id", "work_id", F.coalesce("malformed", F.lit(True)).alias("malformed"), T.short_id(F.col("id")).alias("short"), T.doi_key(F.col("id")).alias("doi"), readers.cache_key(F.col("id")).alias("cached"))


HUB_SQL = """WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_partkey * 37 % 120000 AS d, p_partkey * 13 % 1200 AS l, p_size, greatest(date_diff('day', DATE '1998-01-01' + CAST(p_partkey % 900 AS INTEGER), DATE '2000-01-01'), 0) AS days, CAST(strftime(DATE '1998-01-01' + CAST(p_partkey % 900 AS INTEGER), '%Y') AS INTEGER) AS y FROM part),
t AS (SELECT *, CASE WHEN days <= 30 THEN 25 WHEN days <= 90 THEN 20 WHEN days <= 180 THEN 14 WHEN days <= 365 THEN 8 ELSE 2 END AS fresh FROM p)
"""


def _hub_day():
    return F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).cast("string")


AS_OF = "2000-01-01"


@query(HUB_SQL + """SELECT 'https://huggingface.co/datasets/' || p_name AS id, y AS year, l AS cited_by_count, least(CASE WHEN d >= 100000 THEN 25 WHEN d >= 10000 THEN 20 WHEN d >= 1000 THEN 14 WHEN d >= 100 THEN 8 WHEN d >= 10 THEN 4 WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN l >= 1000 THEN 15 WHEN l >= 200 THEN 12 WHEN l >= 50 THEN 8 WHEN l >= 10 THEN 4 WHEN l > 0 THEN 1 ELSE 0 END + fresh
  + CASE WHEN k % 3 = 0 THEN 15 WHEN k % 3 = 1 THEN 7 ELSE 0 END + CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 20 ELSE 0 END, 100) AS reliability_score, CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 20 ELSE 0 END AS theme_fit_score, p_brand || ',license:' || CASE WHEN k % 3 = 0 THEN 'mit' WHEN k % 3 = 1 THEN 'other' ELSE '' END AS concepts FROM t""")
def hub_records(spark, sf):
    k = F.col("p_partkey")
    lic = F.when(k % 3 == 0, "mit").when(k % 3 == 1, "other").otherwise("")
    item = F.struct(F.col("p_name").alias("modelId"), F.array(F.col("p_brand"), F.concat(F.lit("license:"), lic)).alias("tags"), (k * 37 % 120000).alias("downloads"), (k * 13 % 1200).alias("likes"), _hub_day().alias("lastModified"))
    raw = table(spark, sf, "part").select(F.to_json(item).alias("payload"), F.lit("").alias("card"))
    got = anchors.hub_to_works(raw, F.lit(AS_OF).cast("date"), ["red"], kind="dataset")
    return got.select("id", "year", "cited_by_count", "reliability_score", "theme_fit_score", F.array_join("concepts", ",").alias("concepts"))


@query(HUB_SQL + """, m AS (SELECT *, l % 600 AS v, CASE k % 4 WHEN 0 THEN 'gold' WHEN 1 THEN ' Silver ' WHEN 2 THEN '3' ELSE '' END AS medal FROM t)
SELECT 'https://www.kaggle.com/code/' || p_name AS id, y AS year, v AS cited_by_count, least(least(CASE WHEN v >= 500 THEN 28 WHEN v >= 100 THEN 22 WHEN v >= 30 THEN 15 WHEN v >= 10 THEN 9 WHEN v >= 3 THEN 4 WHEN v > 0 THEN 1 ELSE 0 END + CASE lower(trim(medal)) WHEN 'gold' THEN 12 WHEN 'silver' THEN 8 WHEN '3' THEN 4 ELSE 0 END, 40) + fresh + CASE WHEN k % 2 = 0 THEN 15 ELSE 0 END
  + CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 20 ELSE 0 END, 100) AS reliability_score, 'Kaggle notebook by ' || p_brand AS abstract FROM m""")
def notebook_records(spark, sf):
    k = F.col("p_partkey")
    medal = F.when(k % 4 == 0, "gold").when(k % 4 == 1, " Silver ").when(k % 4 == 2, "3").otherwise("")
    item = F.struct(F.col("p_name").alias("ref"), F.lit("").alias("title"), F.col("p_brand").alias("author"), (k * 13 % 1200 % 600).alias("totalVotes"), medal.alias("medal"), F.when(k % 2 == 0, "Python").otherwise("").alias("languageName"), _hub_day().alias("lastRunTime"))
    got = anchors.notebooks_to_works(table(spark, sf, "part").select(F.to_json(item).alias("payload")), F.lit(AS_OF).cast("date"), ["red"])
    return got.select("id", "year", "cited_by_count", "reliability_score", "abstract")


@query(HUB_SQL + """SELECT 'https://www.kaggle.com/datasets/' || p_name AS id, y AS year, l AS cited_by_count, least(least(CASE WHEN d >= 100000 THEN 22 WHEN d >= 10000 THEN 18 WHEN d >= 1000 THEN 12 WHEN d >= 100 THEN 7 WHEN d >= 10 THEN 3 WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN l >= 1000 THEN 12 WHEN l >= 200 THEN 9 WHEN l >= 50 THEN 6 WHEN l >= 10 THEN 3 WHEN l > 0 THEN 1 ELSE 0 END + CAST(round_even(p_size / 50.0::DOUBLE * 6, 0) AS INTEGER), 40)
  + fresh + CASE WHEN k % 3 = 0 THEN 15 WHEN k % 3 = 1 THEN 7 ELSE 0 END, 100) AS reliability_score, p_brand || ' · t' AS abstract FROM t""")
def dataset_records(spark, sf):
    k = F.col("p_partkey")
    tags = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("ref")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("t").alias("ref")))
    item = F.struct(F.col("p_name").alias("ref"), F.lit("").alias("subtitle"), tags.alias("tags"), (k * 37 % 120000).alias("downloadCount"), (k * 13 % 1200).alias("voteCount"), (F.col("p_size") / 50.0).alias("usabilityRating"), F.when(k % 3 == 0, "CC0").when(k % 3 == 1, "unknown").otherwise("").alias("licenseName"), _hub_day().alias("lastUpdated"))
    got = anchors.datasets_to_works(table(spark, sf, "part").select(F.to_json(item).alias("payload")), F.lit(AS_OF).cast("date"), ["none at all"])
    return got.select("id", "year", "cited_by_count", "reliability_score", "abstract")


REPO_SQL = """WITH s AS (SELECT s_suppkey AS k, s_name, s_suppkey * 7 % 700 AS stars, s_suppkey % 60 AS forks, greatest(date_diff('day', DATE '1999-01-01' + CAST(s_suppkey % 500 AS INTEGER), DATE '2000-01-01'), 0) AS days FROM supplier),
e AS (SELECT user_id, event_id, event_type = 'click' AS is_pr, event_id % 2 = 0 AS open, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS pos FROM events QUALIFY pos < 100),
f AS (SELECT *, count(*) FILTER (pos < 5 AND NOT is_pr) OVER (PARTITION BY user_id) AS near, sum(CASE WHEN is_pr THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM e),
i AS (SELECT user_id, count(*) AS listed, count(*) FILTER (NOT is_pr AND CASE WHEN near > 0 THEN pos < 5 ELSE nth <= 5 END) AS issues, count(*) FILTER (open AND NOT is_pr AND CASE WHEN near > 0 THEN pos < 5 ELSE nth <= 5 END) AS opened, count(*) FILTER (NOT open AND NOT is_pr AND CASE WHEN near > 0 THEN pos < 5 ELSE nth <= 5 END) AS closed FROM f GROUP BY 1),
r AS (SELECT s.*, coalesce(listed, 0) AS listed, coalesce(issues, 0) AS issues, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed, k % 8 AS rel, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 5 END AS runs, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 5 - k % 2 * (k % 5 > 0)::INTEGER END AS good, k % 10 AS ext FROM s LEFT JOIN i ON user_id = k),
m AS (SELECT *, CASE WHEN days <= 14 THEN 25 WHEN days <= 45 THEN 20 WHEN days <= 90 THEN 15 WHEN days <= 180 THEN 10 WHEN days <= 365 THEN 5 ELSE 1 END AS fresh FROM r)
SELECT s_name AS full_name, CASE WHEN (stars >= 50 OR forks >= 10) AND closed > 0 AND closed >= opened THEN greatest(fresh, CASE WHEN stars >= 200 THEN 15 ELSE 12 END) ELSE fresh END AS lma_score,
CASE WHEN stars < 10 THEN CASE WHEN forks > 0 THEN 5 ELSE 0 END WHEN forks * 10 >= stars THEN 10 WHEN forks * 20 >= stars THEN 7 WHEN forks * 50 >= stars THEN 4 ELSE 1 END
  + CASE WHEN issues = 0 THEN CASE WHEN listed > 0 OR stars < 50 THEN 3 ELSE 0 END ELSE least(3 + CASE WHEN closed > 0 THEN 3 ELSE 0 END, 10) END AS community_score,
CAST(round_even(10 * 0.4::DOUBLE, 0) AS INTEGER) + CASE WHEN rel >= 6 THEN 6 WHEN rel >= 3 THEN 4 WHEN rel >= 1 THEN 2 ELSE 0 END + CASE WHEN runs <= 0 THEN 0 ELSE 3 + CASE WHEN good * 5 >= runs * 4 THEN 3 WHEN good * 2 >= runs THEN 1 ELSE 0 END END + CASE WHEN ext >= 8 THEN 3 WHEN ext >= 3 THEN 2 WHEN ext >= 1 THEN 1 ELSE 0 END AS impl_doc_score,
CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END AS security_score FROM m"""


@query(REPO_SQL)
def repository_pillars(spark, sf):
    k = F.col("s_suppkey")
    key = k.cast("string")
    pushed = F.date_add(F.lit("1999-01-01").cast("date"), (k % 500).cast("int")).cast("string")
    item = F.struct(F.col("s_name").alias("full_name"), F.struct(F.lit("owner").alias("login")).alias("owner"), (k * 7 % 700).alias("stargazers_count"), (k % 60).alias("forks_count"), F.struct(F.when(k % 2 == 0, "MIT").otherwise("NOASSERTION").alias("spdx_id")).alias("license"), pushed.alias("pushed_at"), pushed.alias("updated_at"))
    s = table(spark, sf, "supplier")
    repos = parse.normalize_repos(s.select(F.to_json(item).alias("payload"))).withColumn("readme", F.lit("install setup quickstart usage"))
    names = s.select(F.col("s_name").alias("repo"), key.alias("__k"), k.alias("__n"))
    pos = F.row_number().over(graph.W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1
    issues = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("__k"), F.lit("owner").alias("owner"), pos.alias("pos"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed").alias("state"), F.lit("").alias("body"), F.lit("").alias("login"), F.array().cast("array<string>").alias("labels"), (F.col("event_type") == "click").alias("is_pr")).join(names, "__k").drop("__k", "__n")
    times = lambda n, *cols: names.withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).where(n > 0).select("repo", *cols)
    n = F.col("__n")
    releases = times(n % 8, F.lit("1999-01-01").alias("published_at"))
    runs = times(F.when(n % 3 == 0, 0).otherwise(n % 5), F.when(F.col("__i") > n % 5 - n % 2, "failure").otherwise("success").alias("conclusion"))
    people = times(n % 10, F.col("__i").cast("string").alias("login"))
    got = anchors.reliability(anchors.attach_signals(repos, issues=issues, releases=releases, runs=runs, contributors=people), F.lit(AS_OF).cast("date"), rich=True)
    return got.select("full_name", "lma_score", "community_score", "impl_doc_score", "security_score")


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS id, l_partkey % 7 AS topic FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 2 = 0), r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 11 END AS topic_id FROM supplier), p AS (SELECT s_suppkey AS id, s_suppkey % 4 AS topic_id FROM supplier WHERE s_suppkey % 5 = 0)
SELECT count(*) AS lexical, count(topic_id) AS known, count(*) FILTER (topic_id IN (SELECT topic_id FROM p)) AS agree FROM r WHERE id NOT IN (SELECT id FROM p)""")
def leg_agreement(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    return taxonomy.leg_agreement(s.select(k.alias("id"), F.when(k % 6 != 0, k % 11).alias("topic_id")), s.where(k % 5 == 0).select(k.alias("id"), (k % 4).alias("topic_id")))


@query("""WITH n AS (SELECT p_size % 5 AS s, count(*) AS n FROM part WHERE p_size % 7 <> 0 GROUP BY 1) SELECT (SELECT s FROM n ORDER BY n DESC, s DESC LIMIT 1) AS top, max(n) AS n, CAST(sum(n) AS BIGINT) AS classified, max(n) * 2 >= sum(n) AND (SELECT s FROM n ORDER BY n DESC, s DESC LIMIT 1) NOT IN (0, 1) AS elsewhere FROM n""")
def landed_elsewhere(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 5).alias("subfield_id"))
    return taxonomy.landed_elsewhere(p, spark.createDataFrame([(0,), (1,)], "s int"))


@query("""WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS subfield_id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0), s AS (SELECT CAST(c_nationkey AS VARCHAR) AS subfield_id, min(c_mktsegment) AS name FROM customer GROUP BY 1)
SELECT coalesce(t.subfield_id, s.subfield_id) AS subfield_id, coalesce(t.name, s.name) AS name FROM t FULL JOIN s ON s.subfield_id = t.subfield_id""")
def subfield_vocabulary(spark, sf):
    taxo = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("subfield_id"), F.col("n_name").alias("name"))
    return taxonomy.vocabulary(table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("subfield_id"), F.col("c_mktsegment").alias("name")), taxo)


@query("SELECT n_name AS name, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS ids FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def label_lines(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return taxonomy.labels_line(table(spark, sf, "customer").join(n, "c_nationkey").select("name", F.col("c_custkey").cast("string").alias("field_id")))


@query("""WITH o AS (SELECT 't' || o_custkey % 40 AS h, CAST(o_custkey AS VARCHAR) AS v, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS leg FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY h, v ORDER BY leg, pos) AS rn FROM o)
SELECT h AS theme_hash, v AS value, row_number() OVER (PARTITION BY h ORDER BY leg, pos, v) - 1 AS pos FROM f WHERE rn = 1""")
def history_merge(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("theme_hash"), F.lit("id").alias("kind"), F.col("o_custkey").cast("string").alias("value"), F.col("o_orderkey").alias("pos"), F.lit(None).cast("timestamp").alias("generated_at"), "o_orderstatus")
    old, new = (rows.where(c).drop("o_orderstatus") for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    return history.merge_history(old, new).select("theme_hash", "value", "pos")


@query(DOC_SQL + """, m AS (SELECT id, coalesce(title, '') AS title, coalesce(text, '') AS t FROM d) SELECT CAST(id AS VARCHAR) AS id, title, substr(t, 1, 150) AS abstract, 0 AS year, 'v' AS venue, id % 9 AS cited_by_count FROM m""")
def material_round_trip(spark, sf):
    i = F.col("id")
    none = F.lit(None).cast("string")
    rows = _docs(spark, sf).select(i.cast("string").alias("id"), "title", F.col("text").alias("abstract"), F.lit(None).cast("int").alias("year"), F.lit("v").alias("venue"), none.alias("doi"), (i % 9).alias("cited_by_count"))
    return sinks.works_of_materials(rows.select(sinks.material(abstract_chars=150, lean=True).alias("payload"))).select("id", "title", "abstract", "year", "venue", "cited_by_count")


@query(DOC_SQL + """, a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'one ' || id END AS x, CASE WHEN id % 2 = 0 THEN 'two ' || id END AS y FROM d) SELECT id, CASE WHEN x IS NOT NULL THEN 'first' WHEN y IS NOT NULL THEN 'second' END AS source, coalesce(x, y) AS text, coalesce(x, y) IS NOT NULL AS resolved FROM a""")
def provider_chain(spark, sf):
    d = _docs(spark, sf).select("id")
    s = F.col("id").cast("string")
    first = d.select("id", F.lit("first").alias("source"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("one "), s)).otherwise("").alias("text"))
    second = d.select("id", F.lit("second").alias("source"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("two "), s)).alias("text"))
    return parse.fulltext_chain(first, second, ids=d)


@query(DOC_SQL + """, t AS (SELECT id, coalesce(text, '') AS t FROM d) SELECT id, CASE WHEN id % 3 = 0 THEN substr(t, 1, 500) || chr(10) || substr('x' || t, 1, 1200) ELSE substr(t, 1, 500) END AS abstract FROM t""")
def effective_abstracts(spark, sf):
    t = T.text_or_empty(F.col("text"))
    return _docs(spark, sf).select("id", fulltext.effective_abstract(F.col("text"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), t))).alias("abstract"))


@query(DOC_SQL + r"""SELECT id, lower(hex(encode(coalesce(text, '')))) AS hex FROM d""")
def readme_decode(spark, sf):
    t = T.text_or_empty(F.col("text"))
    coded = F.regexp_replace(F.base64(F.encode(t, "UTF-8")), "(.{60})", "$1\n")
    return _docs(spark, sf).select("id", F.lower(F.hex(F.encode(parse.decode_readme(coded), "UTF-8"))).alias("hex"))


@query(BASE_SQL + "SELECT s.id, CASE WHEN field IN (11, 13, 24) THEN '1' WHEN field IN (12, 14, 18, 20) THEN '2' WHEN field IN (15, 16, 17, 19, 21, 22, 23) THEN '3' END AS domain FROM works s")
def work_domains(spark, sf):
    return Frame(spark, sf).works.select("id", collect.domain_of(F.col("field")).alias("domain"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 1) SELECT p_partkey AS id, p_name AS title, p.id IS NULL AS missing FROM part LEFT JOIN p ON p.id = p_partkey""")
def read_by_id(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    works = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("id")).distinct()
    found, gone = taxonomy.read_works(asked, works)
    return found.select("id", "title", F.lit(False).alias("missing")).unionByName(gone.select("id", "title", F.lit(True).alias("missing")))


SUPPLEMENT_SQL = r"(?i)^\s*(?:additional\s+files?|supplement(?:ary|al)\s+(?:materials?|files?|tables?|figures?|data|information)|supporting\s+information|(?:figure|fig\.?|table|movie|video|data|appendix)(?:\s+s?\d+[a-z]?)|\S*moesm\d+(?:_esm)?)(?:\s+s?\d+[a-z]?)?\s*[:.]?\s+(?:of|from|for)\s"


@query(DOC_SQL + rf""", r AS (SELECT id, coalesce(text, '') AS t, CASE id % 6 WHEN 0 THEN 'Additional file ' || id || ': of ' || title WHEN 1 THEN 'Table S' || id || ' from x' WHEN 2 THEN 'https://arxiv.org/abs/2101.' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0') || 'v2' WHEN 3 THEN 'arXiv:hep-th/' || lpad(CAST(id % 10000000 AS VARCHAR), 7, '0') WHEN 4 THEN '"one x two × three' || id || '"' ELSE title END AS h FROM d),
c AS (SELECT *, substr(t, 1, 300) AS cut FROM r), p AS (SELECT *, greatest(CASE WHEN strpos(reverse(cut), ' .') > 0 THEN 300 - strpos(reverse(cut), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(cut), '。') > 0 THEN 300 - strpos(reverse(cut), '。') ELSE -1 END) AS back FROM c)
SELECT id, CASE WHEN length(t) <= 300 THEN t WHEN back > 150 THEN substr(cut, 1, CAST(back + 1 AS BIGINT)) ELSE cut END AS capped, coalesce(regexp_matches(h, '{SUPPLEMENT_SQL}'), false) AS supplement,
coalesce(nullif(regexp_extract(coalesce(h, ''), '(?i)(?:arxiv[.:/]|/abs/|/pdf/)([a-z\-]+(?:\.[a-z]{{2}})?/\d{{7}})', 1), ''), nullif(regexp_extract(coalesce(h, ''), '(?i)(?:arxiv[.:/]|/abs/|/pdf/)(\d{{4}}\.\d{{4,5}})', 1), '')) AS arxiv FROM p""")
def caps_and_marks(spark, sf):
    i, s = F.col("id"), F.col("id").cast("string")
    h = F.when(i % 6 == 0, F.concat(F.lit("Additional file "), s, F.lit(": of "), F.col("title"))).when(i % 6 == 1, F.concat(F.lit("Table S"), s, F.lit(" from x"))).when(i % 6 == 2, F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v2")))
    h = h.when(i % 6 == 3, F.concat(F.lit("arXiv:hep-th/"), F.lpad((i % 10000000).cast("string"), 7, "0"))).when(i % 6 == 4, F.concat(F.lit('"one x two × three'), s, F.lit('"'))).otherwise(F.col("title"))
    rows = _docs(spark, sf).select("id", "text", h.alias("h"))
    return rows.select("id", T.cap_at_sentence(F.col("text"), 300).alias("capped"), T.is_supplement_title(F.col("h")).alias("supplement"), T.arxiv_id(F.col("h")).alias("arxiv"))


@query("""WITH r AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 130) / 100.0::DOUBLE AS ps, (o_orderkey * 53 % 110) / 100.0::DOUBLE AS md, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 140 - 20 AS INTEGER) END AS pct, CASE o_orderkey % 5 WHEN 0 THEN ' Strong ' WHEN 1 THEN 'none' WHEN 2 THEN 'partial' ELSE '?' END AS lv FROM orders)
SELECT id, CAST(floor(least(ps, 1) * 100 + 0.5) AS BIGINT) AS purpose_e2, CASE WHEN pct IS NOT NULL THEN least(greatest(pct, 0), 100) END AS purpose_pct, CASE WHEN pct IS NOT NULL THEN CAST(floor(round(least(greatest(pct, 0), 100) / 100.0::DOUBLE * least(md, 1), 4) * 10000 + 0.5) AS BIGINT) END AS fine_e4, CAST(floor(least(CASE lower(trim(lv)) WHEN 'none' THEN 0.1::DOUBLE WHEN 'partial' THEN 0.45::DOUBLE WHEN 'strong' THEN 0.7::DOUBLE ELSE ps END, 1) * 100 + 0.5) AS BIGINT) AS level_e2 FROM r""")
def score_rows(spark, sf):
    from orrery.operators import contract

    k = F.col("o_orderkey")
    lv = F.when(k % 5 == 0, " Strong ").when(k % 5 == 1, "none").when(k % 5 == 2, "partial").otherwise("?")
    rows = table(spark, sf, "orders").select(k.alias("id"), (k * 37 % 130 / 100.0).alias("purpose_sim"), (k * 53 % 110 / 100.0).alias("mechanism_dist"), F.when(k % 4 != 0, (k % 140 - 20).cast("int")).alias("purpose_pct"), lv.alias("lv"), (k * 37 % 130 / 100.0).alias("raw"))
    e2 = lambda c: F.floor(c * 100 + 0.5)
    return contract.score_row(rows).select("id", e2(F.col("purpose_sim")).alias("purpose_e2"), "purpose_pct", F.floor(F.col("fine_rank") * 10000 + 0.5).alias("fine_e4"), e2(gates.level_value(F.col("lv"), F.col("raw"))).alias("level_e2"))


@query(DOC_SQL + """, t AS (SELECT id, trim(coalesce(text, '')) AS o, CASE WHEN id % 3 = 0 THEN ' ' ELSE 'g' END AS g, id % 7 AS na, id % 8 AS nk, CASE id % 4 WHEN 0 THEN 'theory' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'experiment' END AS kind FROM d)
SELECT id, array_to_string(list_filter([CASE WHEN length(o) < 200 OR length(o) > 1200 THEN 'theme_overview' END, CASE WHEN trim(g) = '' THEN 'goal' END, CASE WHEN na < 2 OR na > 5 THEN 'assumptions' END, CASE WHEN nk > 5 THEN 'keywords_include' END, CASE WHEN coalesce(kind, '') NOT IN ('theory', 'experiment', 'application') THEN 'approach_type' END, CASE WHEN id % 5 = 0 THEN 'scale' END], lambda x: x IS NOT NULL), ',') AS errors FROM t""")
def theme_validation(spark, sf):
    from orrery.operators import contract

    i = F.col("id")
    some = lambda n: F.when(n > 0, F.array_repeat(F.lit("a"), n.cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = _docs(spark, sf).select("id", F.col("text").alias("theme_overview"), F.when(i % 3 == 0, " ").otherwise("g").alias("goal"), F.lit("w").alias("why_problem"), some(i % 7).alias("assumptions"), some(i % 8).alias("keywords_include"), F.lit(None).cast("array<string>").alias("keywords_exclude"), F.when(i % 4 == 0, "theory").when(i % 4 == 1, "other").when(i % 4 == 3, "experiment").alias("approach_type"), F.when(i % 5 == 0, "odd").otherwise("small").alias("scale"), F.lit("no_limit").alias("time_range"))
    return rows.select("id", F.array_join(contract.theme_errors(), ",").alias("errors"))


@query(BASE_SQL + "SELECT CAST(field AS BIGINT) AS topic, count(*) AS n FROM top60 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, topic LIMIT 5")
def dominant_topics(spark, sf):
    return graph.dominant(Frame(spark, sf).candidates.select(F.col("field").cast("long").alias("topic")), "topic", top=5)


@query("""WITH c AS (SELECT user_id % 7 AS model, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 500 END AS i, event_id % 90 AS o FROM events) SELECT CAST(model AS VARCHAR) AS model, count(*) AS calls, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(coalesce(sum(i), 0) + sum(o) AS BIGINT) AS total_tokens FROM c GROUP BY 1""")
def token_usage(spark, sf):
    from orrery.streaming import telemetry

    e = F.col("event_id")
    return telemetry.token_usage(table(spark, sf, "events").select((F.col("user_id") % 7).cast("string").alias("model"), F.when(e % 9 != 0, e % 500).alias("input_tokens"), (e % 90).alias("output_tokens")))


@query("""SELECT 'lang' AS field, CAST(sum(CASE WHEN lang IS NULL THEN 2 ELSE length(lang) + 11 END) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'source', CAST(sum(CASE WHEN source IS NULL THEN 2 ELSE length(source) + 13 END) AS BIGINT) FROM documents""")
def material_sizes(spark, sf):
    return sinks.size_by_field(table(spark, sf, "documents"), ["lang", "source"])


@query("""WITH n AS (SELECT c_nationkey AS id, count(*) AS own FROM customer GROUP BY 1), t AS (SELECT count(*) AS total FROM customer), r AS (SELECT id, greatest(ln(total / CAST(greatest(own, 1) AS DOUBLE)), 0.1::DOUBLE) AS raw FROM n, t) SELECT CAST(id AS BIGINT) AS id, CAST(floor(raw / sum(raw) OVER () * 1000000 + 0.5) AS BIGINT) AS weight_e6 FROM r""")
def rarity_weights(spark, sf):
    from orrery.operators import rank

    c = table(spark, sf, "customer")
    n = c.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").alias("own")).crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))  # one row
    return rank.rarity_weights(n, "own", F.col("total")).select("id", F.floor(F.col("weight") * 1_000_000 + 0.5).alias("weight_e6"))
