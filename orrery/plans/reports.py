"""Named queries of search texts, requests, readers, full texts, themes, rendered entries and lines."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import contract, diagnostics, documents, gates, graph, percolate, rank, render, stats, taxonomy, themes
from orrery.plans.catalog import BASE_SQL, DOC_SQL, GATE_SQL, Frame, _docs, _scores, query, table
from orrery.sources import anchors, fulltext, parse, readers

AS_OF = "2000-01-02"
#: Four words of each conversation's first turn: one alone, two as a phrase, one with a hyphen, one left out.
TURN_SQL = """WITH w AS (SELECT conv_id AS theme, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')[1:4] AS w FROM conversations WHERE turn = 0),
k AS (SELECT theme, w[1] AS a, w[2] || ' ' || w[3] AS b, w[4] || '-' || w[1] AS c, w[4] AS no FROM w WHERE len(w) = 4)"""


def _turns(spark, sf):
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), 1, 4)
    w = table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("theme"), words.alias("w")).where("size(w) = 4")
    at = lambda i: F.element_at("w", i)
    return w.select("theme", F.array(at(1), F.concat_ws(" ", at(2), at(3)), F.concat_ws("-", at(4), at(1)), at(1)).alias("keywords_include"), F.array(at(4)).alias("keywords_exclude"))


@query(TURN_SQL + """, t AS (SELECT theme, ' in:name,description,readme NOT ' || no || ' pushed:>1998-07-01' AS tail, a, '"' || b || '"' AS b, c FROM k)
SELECT theme, 0 AS leg, '全語 OR' AS label, a || ' OR ' || b || ' OR ' || c || tail AS text FROM t UNION ALL SELECT theme, 1, a, a || tail FROM t UNION ALL SELECT theme, 2, trim(b, '"'), b || tail FROM t UNION ALL SELECT theme, 3, c, '"' || c || '"' || tail FROM t""")
def search_legs(spark, sf):
    return anchors.legs_of(_turns(spark, sf), F.lit(AS_OF).cast("date"))


@query("""WITH n AS (SELECT o_custkey % 50 AS theme, o_custkey % 4 AS leg, count(*) FILTER (o_orderstatus = 'F' OR o_custkey % 4 = 0) AS total FROM orders GROUP BY 1, 2),
x AS (SELECT *, max(CASE WHEN leg = 0 THEN total END) OVER (PARTITION BY theme) AS o, count(*) OVER (PARTITION BY theme) - 1 AS n FROM n), y AS (SELECT *, CASE WHEN leg > 0 AND total * n < o THEN 1 ELSE 0 END AS k FROM x)
SELECT theme, leg, total, CAST(CASE WHEN n = 0 OR coalesce(o, 0) = 0 THEN 1 WHEN leg = 0 THEN greatest(1, n - sum(k) OVER (PARTITION BY theme)) ELSE k END AS INTEGER) AS turns FROM y""")
def search_turns(spark, sf):
    n = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("theme"), (F.col("o_custkey") % 4).alias("leg")).agg(F.count_if((F.col("o_orderstatus") == "F") | (F.col("o_custkey") % 4 == 0)).alias("total"))
    return anchors.turns_of(n)


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'github' WHEN 1 THEN 'huggingface' WHEN 2 THEN 'kaggle' WHEN 3 THEN 'kaggle' WHEN 4 THEN 'github' END AS source, CASE WHEN p_size * 2 >= 70 THEN '高' WHEN p_size * 2 >= 40 THEN '中' ELSE '低' END AS band,
CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1990 + p_partkey % 30 END AS INTEGER) AS year FROM part""")
def names_and_bands(spark, sf):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, (" GH", "Huggingface_Hub", "kg ", "Kaggle", "github", "other"))), (k % 6 + 1).cast("int"))
    stamp = F.when(k % 7 == 0, "not a date").otherwise(F.concat((1990 + k % 30).cast("string"), F.lit("-05-01T10:00:00Z")))
    return table(spark, sf, "part").select(k.alias("id"), anchors.known_source(name).alias("source"), S.quality_band(F.col("p_size") * 2).alias("band"), S.updated_year(stamp).alias("year"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_size FROM part)
SELECT k AS part, 'filter' AS route, 'title_and_abstract.search:' || p_name || ',cites:W' || k || '|W' || (k + 1) || ',primary_topic.field.id:!' || p_size || CASE WHEN k % 6 = 0 THEN ',publication_year:1995-1996' WHEN k % 3 = 0 THEN ',from_publication_date:1995-01-01' WHEN k % 2 = 0 THEN ',to_publication_date:1996-12-31' ELSE '' END || CASE WHEN k % 5 = 0 THEN ',type:article' ELSE '' END || ',referenced_works_count:<100' AS filter, CAST(NULL AS VARCHAR) AS search, '80' AS per_page FROM p
UNION ALL SELECT k, 'search', 'primary_topic.field.id:' || p_size, p_name || ' | x', '80' FROM p
UNION ALL SELECT k, 'semantic', CASE WHEN k % 2 = 0 THEN 'from_publication_date:1995-01-01' END, p_name, '50' FROM p""")
def route_parameters(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    s = lambda c: c.cast("string")
    own = p.select(k.alias("query"), F.lit(0).alias("rung"), F.lit("filter").alias("route"), F.concat("p_name", F.lit(" |!")).alias("anchor"), F.array(F.concat(F.lit("W"), s(k)), F.concat(F.lit("W"), s(k + 1))).alias("cites"), F.array(s(F.col("p_size"))).alias("exclude_field_ids"), F.when(k % 3 == 0, 1995).alias("year_from"), F.when(k % 2 == 0, 1996).alias("year_to"), F.when(k % 5 == 0, "article").alias("work_type"), F.lit(100).alias("max_refs"))
    loose = p.select(k.alias("query"), F.lit(1).alias("rung"), F.lit("search").alias("route"), F.concat("p_name", F.lit(" | x")).alias("anchor"), F.array(s(F.col("p_size"))).alias("field_ids"))
    near = p.select(k.alias("query"), F.lit(2).alias("rung"), F.lit("semantic").alias("route"), F.col("p_name").alias("anchor"), F.when(k % 2 == 0, 1995).alias("year_from"), F.array(s(F.col("p_size"))).alias("field_ids"))
    got = percolate.requests(own.unionByName(loose, allowMissingColumns=True).unionByName(near, allowMissingColumns=True), per_page=80)
    m = F.col("params")
    return got.select(F.col("query").alias("part"), F.element_at(F.array(*map(F.lit, ("filter", "search", "semantic"))), F.col("rung") + 1).alias("route"), m["filter"].alias("filter"), F.coalesce(m["search"], m["search.semantic"]).alias("search"), m["per-page"].alias("per_page"))


def _pages_of(params):
    """Answers a query by its own number: so many pages, every fourth query is refused, every fifth answers with a broken body."""
    n, page = int(params["search"].split("_")[1]), params["page"]
    if n % 4 == 3:
        return 400, {}, "refused"
    if n % 5 == 4:
        return 200, {}, "{broken"
    works = [{"id": f"https://openalex.org/W{n}00{page}{i}", "display_name": f"Work {n} {page} {i}", "publication_year": 1990 + i, "cited_by_count": n} for i in range(params["per-page"])]
    return 200, {"X-RateLimit-Remaining-USD": "0.05"}, json.dumps({"results": works if page <= n % 3 else []})


@query("""WITH n AS (SELECT n_nationkey AS n, row_number() OVER (ORDER BY n_nationkey) - 1 AS q FROM nation), r AS (SELECT n, p, i FROM n, range(1, 4) AS u(p), range(0, 3) AS v(i) WHERE n % 4 <> 3 AND n % 5 <> 4 AND p <= n % 3)
SELECT 'W' || n || '00' || p || i AS id, 'Work ' || n || ' ' || p || ' ' || i AS title, CAST(1990 + i AS INTEGER) AS year, false AS failed FROM r UNION ALL SELECT 'query ' || q, NULL, NULL, true FROM n WHERE n % 4 = 3 OR n % 5 = 4""")
def paged_scan(spark, sf):
    """Every nation's name is a query to a server of works; eight lanes read them under one budget."""
    names = [r.n_name for r in table(spark, sf, "nation").orderBy("n_nationkey").limit(1000).collect()]
    got = readers.read_pages(spark, _pages_of, [{"search": n} for n in names], per_page=3, max_pages=3, requests=500, isolate=True, config=readers.ReadConfig(interval=0.0, backoff=0.0), columns=readers.RECORD_COLUMNS, name="works_of_nations")
    works = parse.normalize_works(got.where("error IS NULL")).select(T.short_id(F.col("id")).alias("id"), "title", "year", F.lit(False).alias("failed"))
    return works.unionByName(got.where("error IS NOT NULL").select(F.concat(F.lit("query "), "query").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(True).alias("failed")))


def _readme_of(params):
    name, n = params["key"].rsplit("#", 1)
    if int(n) % 7 == 0:
        return 404, {}, ""
    if int(n) % 11 == 0:
        return 403, {}, "no"
    text = f"---\nlicense: mit\n---\n# {name} {n}\n"
    return 200, {}, json.dumps({"content": base64.b64encode(text.encode()).decode()})


@query("""SELECT p_name || '#' || p_partkey AS key, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN '# ' || p_name || ' ' || p_partkey || chr(10) END AS card, p_partkey % 7 <> 0 AND p_partkey % 11 = 0 AS failed FROM part""")
def fetched_cards(spark, sf):
    """One request a part for its card: absent ones are null, refused ones cost only themselves."""
    keys = table(spark, sf, "part").select(F.concat("p_name", F.lit("#"), "p_partkey").alias("key"))
    got = readers.fetch_each(keys, _readme_of, config=readers.ReadConfig(interval=0.0, backoff=0.0))
    card = parse.strip_front_matter(parse.decode_readme(F.get_json_object("payload", "$.content")))
    return got.select("key", F.when(F.col("payload").isNotNull(), card).alias("card"), F.col("error").isNotNull().alias("failed"))


def _works_of(params):
    ids = [int(x[1:]) for x in params["key"].split("|")]
    return 200, {}, json.dumps({"results": [{"id": f"https://openalex.org/W{i}", "title": f"Part {i}", "cited_by_count": i % 50} for i in ids if i % 9]})


@query("""SELECT 'https://openalex.org/W' || p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN 'Part ' || p_partkey END AS title, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 50 END AS cited_by_count FROM part""")
def resolved_ids(spark, sf):
    """Ids in look-ups of 50 at most, one request each; then every id with what it resolved to."""
    ids = table(spark, sf, "part").select(F.concat(F.lit("https://openalex.org/W"), "p_partkey").alias("id"))
    got = readers.fetch_each(readers.id_lookups(ids), _works_of, key="ids", config=readers.ReadConfig(interval=0.0))
    works = got.select(F.explode(F.from_json("payload", "struct<results:array<struct<id:string,title:string,cited_by_count:long>>>")["results"]).alias("w")).select(T.short_id(F.col("w.id")).alias("id"), "w.title", "w.cited_by_count")
    return readers.labelled(ids, works)


#: Letters, spaces and sentence ends of a text: what every container holds alike.
PLAIN_SQL = DOC_SQL + r""", p AS (SELECT id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z.]+', ' ', 'g')) AS t FROM d),
c AS (SELECT *, substr(t, 1, 4000) AS cut FROM p), e AS (SELECT *, CASE WHEN length(t) <= 4000 THEN t WHEN strpos(reverse(cut), ' .') > 0 AND 4000 - strpos(reverse(cut), ' .') - 1 > 2000 THEN substr(cut, 1, 4000 - strpos(reverse(cut), ' .')) ELSE cut END AS x FROM c)
"""


@query(PLAIN_SQL + """SELECT id, 'jats' AS kind, CASE WHEN t <> '' THEN x END AS text, length(t) > 4000 AS truncated FROM e UNION ALL SELECT id, 'pdf', CASE WHEN length(t) >= 400 THEN x END, length(t) > 4000 FROM e UNION ALL SELECT id, 'eprint', CASE WHEN t <> '' THEN x END, length(t) > 4000 FROM e""")
def full_texts(spark, sf):
    """Every document as JATS, as PDF and as TeX, read back by its provider."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z.]+", " "))
    made = {
        "jats": F.concat(F.lit("<article><front><article-title>no</article-title></front><body><p>"), plain, F.lit("</p><fig>no</fig></body></article>")),
        "pdf": F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< >>\nstream\nBT ("), plain, F.lit(") Tj ET\nendstream\nendobj\n")),
        "eprint": F.concat(F.lit("\\documentclass{a}\n\\begin{document}\n"), plain, F.lit("\n\\end{document}")),
    }
    out = None
    for kind, text in made.items():
        one = fulltext.full_texts(_docs(spark, sf).select("id", F.encode(text, "UTF-8").alias("content")), kind, source=kind).select("id", F.lit(kind).alias("kind"), "text", "truncated")
        out = one if out is None else out.unionByName(one)
    return out


@query(r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM pages)
SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN coalesce('https://web.archive.org/' || url, '') || CASE WHEN url IS NOT NULL THEN '|' || url ELSE '' END WHEN page_id % 3 = 1 THEN coalesce(url, '') ELSE '' END AS copies, CAST(CASE WHEN length(t) >= 400 THEN length(t) END AS INTEGER) AS chars FROM p""")
def archive_copies(spark, sf):
    k, u = F.col("page_id"), F.col("url")
    file = lambda kind, *urls: F.struct(F.lit(kind).alias("mimetype"), F.array(*[F.struct(x.alias("url")) for x in urls]).alias("urls"))
    files = F.when(k % 3 == 0, F.array(file("application/pdf", u, F.concat(F.lit("https://web.archive.org/"), u)), file("text/html", u))).when(k % 3 == 1, F.array(file("Application/PDF", u))).otherwise(F.array(file("text/html", u)))
    return table(spark, sf, "pages").select(k.alias("id"), F.array_join(readers.archived_pdfs(files), "|").alias("copies"), F.length(readers.repository_text(F.col("html"))).alias("chars"))


@query("""SELECT conv_id AS theme, coalesce(text, '') AS theme_overview, role AS goal, CASE WHEN conv_id % 2 = 0 THEN 'a ' || conv_id || ',b' ELSE '' END AS assumptions, CASE WHEN conv_id % 3 = 0 THEN 'field ' || conv_id END AS scope_field, CASE WHEN conv_id % 5 = 0 THEN 'w' ELSE '' END AS include FROM conversations WHERE turn = 0""")
def loaded_themes(spark, sf):
    """Themes as JSON texts, read back."""
    k = F.col("conv_id")
    some = lambda on, *xs: F.when(on, F.array(*xs))
    spec = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("theme_overview"), F.col("role").alias("goal"), some(k % 2 == 0, F.concat(F.lit("a "), k), F.lit("b")).alias("assumptions"), F.struct(F.when(k % 3 == 0, F.concat(F.lit("field "), k)).alias("field")).alias("scope"), F.struct(some(k % 5 == 0, F.lit("w")).alias("include")).alias("keywords"), F.lit("?").alias("unknown")))
    t = themes.parse_themes(table(spark, sf, "conversations").where("turn = 0").select(k.alias("theme"), spec.alias("value")))
    return t.select("theme", "theme_overview", "goal", F.concat_ws(",", "assumptions").alias("assumptions"), "scope_field", F.concat_ws(",", "keywords_include").alias("include"))


HOME_SQL = """WITH t AS (SELECT c_custkey AS theme, CASE c_custkey % 4 WHEN 0 THEN 'nation ' || c_nationkey WHEN 1 THEN 'studies of Nation ' || c_nationkey || ' and trade' WHEN 2 THEN 'n' || c_nationkey ELSE 'elsewhere' END AS scope, c_custkey % 4 AS kind, c_nationkey AS n FROM customer),
f AS (SELECT theme, n_nationkey AS field FROM t JOIN nation ON n_nationkey = n AND kind < 3 OR kind = 0 AND contains('nation ' || n_nationkey, scope))"""


def _homes(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    scope = F.when(k % 4 == 0, F.concat(F.lit("nation "), n)).when(k % 4 == 1, F.concat(F.lit("studies of Nation "), n, F.lit(" and trade"))).when(k % 4 == 2, F.concat(F.lit("n"), n)).otherwise("elsewhere")
    rows = table(spark, sf, "customer").select(k.alias("theme"), scope.alias("scope_field"))
    # the taxonomy is read from JSON triples, one a nation
    triple = F.to_json(F.array(F.array(F.concat(F.lit("s"), "n_nationkey"), F.regexp_replace("n_name", "_", " "), F.col("n_nationkey").cast("string"))))
    fields = taxonomy.parse_taxonomy(table(spark, sf, "nation").select(triple.alias("value"))).select("field_id", "name")
    aliases = fields.select(F.concat(F.lit("n"), "field_id").alias("alias"), "field_id")
    return rows, fields, taxonomy.resolve_fields(rows, fields, aliases)


@query(HOME_SQL + " SELECT theme, CAST(field AS VARCHAR) AS field_id FROM f")
def resolved_fields(spark, sf):
    return _homes(spark, sf)[2].select("theme", "field_id")


@query(HOME_SQL + ", g AS (SELECT theme, string_agg('NATION ' || field, ' / ' ORDER BY 'NATION ' || field) AS names FROM f GROUP BY theme) SELECT theme, 'home ' || scope || ': ' || coalesce(names, 'no field') AS line FROM t LEFT JOIN g USING (theme)")
def home_notes(spark, sf):
    rows, fields, found = _homes(spark, sf)
    none = rows.select("theme", F.lit("").alias("name")).where("false")
    return diagnostics.home_line(rows, found.select("theme", "field_id"), fields, none)


SENTENCE_SQL = r"list_filter(list_transform(string_split_regex({x} || ' ', '\.\s'), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(DOC_SQL + r""", x AS (SELECT id, coalesce(text, '') AS t, coalesce(title, '') AS h FROM d)
SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 120) || '...' END AS simple, '<<<external' || chr(10) || replace(replace(t, '<<<', '< < <'), '>>>', '> > >') || chr(10) || 'external>>>' AS enclosed,
CASE id % 3 WHEN 0 THEN '（個別の注意点は記入なし。テーマの不安点は入力サマリの「不安点」の行）' WHEN 1 THEN '（個別の注意点は記入なし）前提「p' || id || '」が成り立つか要確認。' ELSE '（個別の注意点は記入なし）' END AS caution,
'【接続点' || CASE WHEN id % 5 = 0 THEN '（構造対応ゆるめ・思考のタネ）' ELSE '' END || ': ' || CASE WHEN id % 4 = 0 THEN '構造的接続' ELSE 'l' || id END || '】' AS label, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 100 AS BIGINT) END AS depth_e2,
'one two' || id || ' three' AS cleaned, 'repo: a ' || id || CASE WHEN id % 2 = 0 THEN ' / b 7' ELSE '' END AS pillars FROM x""")
def text_forms(spark, sf):
    i, s = F.col("id"), F.col("id").cast("string")
    rows = _docs(spark, sf)
    none = F.lit(None).cast("array<string>")
    return rows.select(
        "id", T.simple_summary(F.col("text")).alias("simple"), contract.envelope(F.col("text")).alias("enclosed"),
        documents.caution_for(F.when(i % 3 == 0, "worry"), F.when(i % 3 == 1, F.array(F.concat(F.lit("p"), s))).otherwise(none)).alias("caution"),
        documents.connection_label(F.when(i % 4 != 0, F.concat(F.lit("l"), s)).otherwise(""), F.when(i % 5 == 0, False).when(i % 5 == 1, True)).alias("label"),
        F.floor(documents.depth_shown(F.when(i % 6 != 0, (i % 100) / 100.0)) * 100 + 0.5).alias("depth_e2"), T.clean_query(F.concat(F.lit(' "one x  two'), s, F.lit('×three" '))).alias("cleaned"),
        documents.pillar_line(F.lit("repo"), {"a": i, "b": F.when(i % 2 == 0, 7)}).alias("pillars"),
    )


@query(DOC_SQL + r""", o AS (SELECT id, lang, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS h FROM d), b AS (SELECT id, trim(concat_ws(' ', nullif(h, ''), nullif(t, ''))) AS s FROM o), c AS (SELECT *, substr(s, 1, 1200) AS cut FROM b)
SELECT id, trim(CASE WHEN length(s) <= 1200 THEN s WHEN greatest(CASE WHEN strpos(reverse(cut), ' .') > 0 THEN 1200 - strpos(reverse(cut), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(cut), '。') > 0 THEN 1200 - strpos(reverse(cut), '。') ELSE -1 END) > 600
  THEN substr(cut, 1, CAST(greatest(CASE WHEN strpos(reverse(cut), ' .') > 0 THEN 1200 - strpos(reverse(cut), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(cut), '。') > 0 THEN 1200 - strpos(reverse(cut), '。') ELSE -1 END) + 1 AS BIGINT)) ELSE cut END) AS asked, s AS seed FROM c""")
def semantic_texts(spark, sf):
    """What the semantic route is asked for each document as a facet, and the prose that its search would start from."""
    rows = _docs(spark, sf)
    return rows.select("id", themes.semantic_text(F.col("title"), F.col("text")).alias("asked"), T.seed_text(F.col("title"), F.col("text"), F.lit("")).alias("seed"))


@query(GATE_SQL + """, n AS (SELECT count(*) AS s, count(*) FILTER (rejected_by = 'anomaly') AS a, count(*) FILTER (rejected_by = 'hollow') AS h, count(*) FILTER (rejected_by = 'percentile_gate') AS g, count(*) FILTER (rejected_by = 'output_floor') AS f, count(*) FILTER (rejected_by IS NULL) AS q FROM r)
SELECT 'kept ' || q || ' of ' || s || ' (anomaly ' || a || ', hollow ' || h || ', gate ' || g || ', floor ' || f || ')' AS line FROM n""")
def saturation_line(spark, sf):
    return diagnostics.saturation_text(gates.saturation(_scores(spark, sf)))


@query(GATE_SQL + """, best AS (SELECT id FROM r WHERE rejected_by IN ('percentile_gate', 'output_floor') AND ser >= 0.1::DOUBLE ORDER BY ser DESC, id LIMIT 1) SELECT id FROM r WHERE rejected_by IS NULL UNION ALL SELECT id FROM best WHERE NOT EXISTS (SELECT 1 FROM r WHERE rejected_by IS NULL)""")
def kept_or_fallback(spark, sf):
    return gates.with_fallback(_scores(spark, sf)).select("id")


@query("""SELECT o_orderkey AS id, CAST(floor((o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w * 10000 + 0.5) AS BIGINT) AS z_e4 FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def z_scores(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderpriority")
    return rank.z_scores(o, "o_totalprice", group=["o_orderpriority"]).select("id", F.floor(F.col("z") * 10_000 + 0.5).alias("z_e4"))


@query(BASE_SQL + """, f AS (SELECT id, field, CASE WHEN field IN (SELECT field FROM seeds) THEN 'roster' WHEN field IN (SELECT field FROM works WHERE domain = 0) THEN 'pool' ELSE 'new' END AS filed FROM top60),
p AS (SELECT id, row_number() OVER (ORDER BY bridge_betweenness DESC, shared_bridge_count DESC, cites DESC, id) AS pos FROM top60)
SELECT 0 AS pos, 'roster at domain: ' || count(*) FILTER (domain IN (0, 1)) || ' of ' || count(domain) || ' at home (' || CAST(round_even(count(*) FILTER (domain IN (0, 1)) * 100 / count(domain)::DOUBLE, 0) AS INTEGER) || '%), 0 not filed' AS line FROM seeds
UNION ALL SELECT 1, 'topics seen in the roster ' || count(*) FILTER (filed = 'roster') || ', in the pool ' || count(*) FILTER (filed = 'pool') || ', nowhere ' || count(*) FILTER (filed = 'new') || ', not filed 0' FROM f
UNION ALL SELECT 2, 'candidates (' || count(*) || '): ' || string_agg('W' || id, ', ' ORDER BY pos) FROM p
UNION ALL SELECT 3, 'home domain: ' || count(*) FILTER (domain IN (0, 1)) || ' of ' || count(*) || ' candidates inside, 0 deferred' FROM top60""")
def run_lines(spark, sf):
    """What a run says about its roster, topics, candidates and home domain."""
    f = Frame(spark, sf)
    filed = graph.filing(f.candidates.select("id", "field"), f.seeds.select("field"), f.works.where("domain = 0").select("field"), "field")
    placed = f.candidates.select(F.concat(F.lit("https://openalex.org/W"), "id").alias("id"), F.row_number().over(graph.W.orderBy(*graph.rank_keys())).alias("pos"))
    home = spark.createDataFrame([(0,), (1,)], "domain int")
    return diagnostics.block(diagnostics.alignment_line(stats.alignment(f.seeds, F.col("domain"), [0, 1]), level="domain"), diagnostics.filing_line(filed), diagnostics.ids_line(placed), diagnostics.home_domain_line(f.candidates, home, deferred=0))


BODY_SQL = """'<!-- AUTO_SECTION:' || e || ':SUMMARY:START -->' || chr(10) || '1) 概要: s' || chr(10) || '<!-- AUTO_SECTION:' || e || ':SUMMARY:END -->' || chr(10) || '<!-- AUTO_SECTION:' || e || ':RELATIONSHIP:START -->' || chr(10) || '2) テーマとの関連性: r' || chr(10) || '<!-- AUTO_SECTION:' || e || ':RELATIONSHIP:END -->' || chr(10) || '<!-- AUTO_SECTION:' || e || ':HYPOTHESIS:START -->' || chr(10) || '3) 役に立つ可能性の仮説: h' || chr(10) || '<!-- AUTO_SECTION:' || e || ':HYPOTHESIS:END -->' || chr(10) || '<!-- AUTO_SECTION:' || e || ':CAUTION:START -->' || chr(10) || '4) 注意点: ' || chr(10) || '<!-- AUTO_SECTION:' || e || ':CAUTION:END -->' || chr(10)"""


@query(f"""WITH p AS (SELECT p_partkey AS k, p_name, p_size, printf('S%02d-E%03d', 0, p_partkey % 1000) AS e FROM part), o AS (SELECT o_orderkey AS k, o_orderpriority AS t, year(o_orderdate) AS y, printf('S%02d-E%03d', 1, o_orderkey % 1000) AS e FROM orders)
SELECT 'A' AS track, k AS id, '### ' || (k % 1000 + 1) || '. ' || p_name || chr(10) || chr(10) || '- **関係度**: ' || CASE WHEN k % 3 = 0 THEN '高' ELSE '—' END || '（theme関連度 ' || p_size || '）' || chr(10) || '- **関係軸**: 実装アンカー' || chr(10) || CASE WHEN k % 2 = 0 THEN '- 更新年: —  |  種別: GitHub  |  stars: ' || k || chr(10) || '- Reliability Score: 5/100 [README-only]  |  License: MIT' || chr(10) || '- Issue Signal: —' ELSE '- 年: 0  |  掲載: GitHub  |  被引用: ' || k END || chr(10) || '- リンク: W' || k || chr(10) || chr(10) || {BODY_SQL} AS block FROM p
UNION ALL SELECT 'B', k, '### ' || (k % 1000 + 1) || '. ' || t || chr(10) || chr(10) || '- **接続点**: l' || chr(10) || '- **セレンディピティ・スコア**: 0.5（距離 — × 目的の一致 —＝purpose_sim）' || CASE WHEN k % 2 = 0 THEN '／構造の深さ 0.6（structural_depth・hollow ゲートにだけ使い、点数には入らない）' ELSE '' END || chr(10) || '- 年: ' || y || '  |  掲載:   |  被引用: 1' || chr(10) || '- リンク: ' || CASE WHEN k % 5 = 0 THEN '10.1/' || k ELSE 'W' || k END || chr(10) || chr(10) || {BODY_SQL} FROM o""")
def rendered_entries(spark, sf):
    """An anchor of every part and a connection of every order, as blocks of a report."""
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    text = lambda v: F.lit(v).alias
    texts = [text("s")("summary"), text("r")("relationship"), text("h")("hypothesis"), F.lit(None).cast("string").alias("caution"), F.lit(None).cast("array<struct<keyword:string,where:string,credit:double>>").alias("matched"), F.lit(None).cast("int").alias("n_keywords")]
    some = lambda **m: F.map_filter(F.create_map(*[x for n, v in m.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    a = table(spark, sf, "part").select(
        F.lit(0).alias("section"), F.lit("A").alias("track"), (k % 1000).cast("int").alias("pos"), F.concat(F.lit("W"), k).alias("id"), F.lit("").alias("doi"), F.col("p_name").alias("title"), F.lit(0).alias("year"), F.lit("GitHub").alias("venue"), k.alias("cited_by_count"),
        F.when(k % 2 == 0, "github_repository").otherwise("article").alias("publication_type"), F.lit("実装アンカー").alias("label"), F.when(k % 3 == 0, "高").alias("level"), some(relevance=F.col("p_size").cast("string"), reliability_score=F.lit("5"), license_name=F.lit("MIT")).alias("meta"), *texts, k.alias("n"),
    )
    b = table(spark, sf, "orders").select(
        F.lit(1).alias("section"), F.lit("B").alias("track"), (o % 1000).cast("int").alias("pos"), F.concat(F.lit("W"), o).alias("id"), F.when(o % 5 == 0, F.concat(F.lit("10.1/"), o)).alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.lit("").alias("venue"), F.lit(1).cast("long").alias("cited_by_count"),
        F.lit("article").alias("publication_type"), F.lit("l").alias("label"), F.lit(None).cast("string").alias("level"), some(serendipity_score=F.lit("0.5"), structural_depth=F.when(o % 2 == 0, "0.6")).alias("meta"), *texts, o.alias("n"),
    )
    return a.unionByName(b).select("track", F.col("n").alias("id"), render.entry_block().alias("block"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderkey % 4 AS lv, (o_orderkey * 53 % 130) / 100.0::DOUBLE AS d, CAST(o_orderkey % 130 - 10 AS INTEGER) AS pct FROM orders WHERE o_orderkey % 9 <> 0)
SELECT CAST(id AS VARCHAR) AS id, CAST(CASE lv WHEN 0 THEN 70 WHEN 1 THEN 45 WHEN 2 THEN 10 ELSE 33 END AS BIGINT) AS purpose_e2, CAST(floor(least(d, 1) * 100 + 0.5) AS BIGINT) AS distance_e2, greatest(least(pct, 100), 0) AS purpose_pct, id % 5 = 0 AS complete FROM m""")
def model_rows(spark, sf):
    """Models' answers, an array for each customer, back as score rows; answers without a distance go."""
    k = F.col("o_orderkey")
    level = F.element_at(F.array(F.lit(" strong"), F.lit("Partial"), F.lit("none"), F.lit("?")), (k % 4 + 1).cast("int"))
    item = F.struct(k.cast("string").alias("id"), level.alias("purpose_level"), F.lit(0.33).alias("purpose_sim"), F.when(k % 9 == 0, "far").otherwise((k * 53 % 130 / 100.0).cast("string")).alias("mechanism_dist"), (k % 130 - 10).cast("int").alias("purpose_pct"), F.when(k % 5 == 0, "tie").alias("connection_label"), F.lit("why").alias("serendipity_rationale"))
    answers = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("payload"))
    e2 = lambda c: F.floor(F.col(c) * 100 + 0.5)
    return contract.model_rows(answers).select("id", e2("purpose_sim").alias("purpose_e2"), e2("mechanism_dist").alias("distance_e2"), "purpose_pct", "complete")
