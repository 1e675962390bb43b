"""Practical anchors: repositories, hub items and notebooks as works with a reliability score."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.lineage import cut
from orrery.sources.parse import hub_license

#: Search limits, source names.
OPERATORS, QUERY_CHARS, PUSHED_WITHIN_DAYS, ISSUE_PAGE = 5, 256, 550, 100
SOURCES = ("github", "huggingface", "kaggle")
ALL_LEG = "全語 OR"
ALIASES = {"github": "github", "gh": "github", "huggingface": "huggingface", "hf": "huggingface", "huggingface_hub": "huggingface", "kaggle": "kaggle", "kg": "kaggle", "kaggle_hub": "kaggle"}
HUB = "struct<id:string,modelId:string,_id:string,tags:array<string>,pipeline_tag:string,library_name:string,downloads:long,downloadsAllTime:long,likes:long,lastModified:string,createdAt:string>"
SET = "struct<ref:string,title:string,subtitle:string,tags:array<struct<name:string,fullPath:string,ref:string>>,downloadCount:long,voteCount:long,usabilityRating:double,licenseName:string,lastUpdated:string>"
BOOK = "struct<ref:string,title:string,author:string,tags:array<struct<name:string,fullPath:string,ref:string>>,totalVotes:long,voteCount:long,medal:string,languageName:string,language:string,lastRunTime:string>"


def sources_of(names: Sequence[str] | None) -> list[str]:
    """Known sources in the given order, each once; all of them if none is known."""
    known = [ALIASES[k] for n in names or () if (k := str(n).strip().lower()) in ALIASES]
    return list(dict.fromkeys(known)) or list(SOURCES)


def search_terms(keywords: Sequence[str], *, quote_hyphen: bool = False) -> list[str]:
    """Distinct keywords, phrases quoted, trimmed from the tail to the operator and length limits."""
    seen: dict[str, str] = {}
    for k in keywords:
        k = " ".join((k or "").replace('"', " ").split())
        if k:
            seen.setdefault(k.lower(), f'"{k}"' if " " in k or quote_hyphen and "-" in k else k)
    terms = list(seen.values())[: OPERATORS + 1]
    while len(terms) > 1 and sum(map(len, terms)) > QUERY_CHARS:
        terms.pop()
    return terms


def search_text(terms: Sequence[str], exclude: Sequence[str], as_of: dt.date) -> str:
    """Keywords by OR, exclusions with the operators left over, and the recency cut-off."""
    left = max(0, OPERATORS - (len(terms) - 1))
    nots = [f"NOT {t}" for t in search_terms(exclude)[:left]]
    return " ".join([" OR ".join(terms), "in:name,description,readme", *nots, f"pushed:>{as_of - dt.timedelta(days=PUSHED_WITHIN_DAYS)}"])


def search_legs(keywords: Sequence[str], exclude: Sequence[str], as_of: dt.date, *, extra: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(label, query): all keywords by OR, then, where there are several, each one by itself, hyphenated ones as phrases."""
    legs = [(ALL_LEG, search_text(search_terms([*keywords, *extra]), exclude, as_of))]
    own = search_terms(keywords, quote_hyphen=True)
    return legs + ([(t.strip('"'), search_text([t], exclude, as_of)) for t in own] if len(own) > 1 else [])


def search_terms_of(keywords: Column, *, quote_hyphen: bool = False) -> Column:
    """search_terms of a column of keywords (array<string>)."""
    clean = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: T.collapse_ws(F.translate(T.text_or_empty(k), '"', " "))), lambda k: k != "")
    once = F.filter(clean, lambda k, i: F.array_position(F.transform(clean, F.lower), F.lower(k)) == i + 1)
    quoted = F.transform(once, lambda k: F.when(k.contains(" ") | (k.contains("-") if quote_hyphen else F.lit(False)), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k))
    few = F.slice(quoted, 1, OPERATORS + 1)
    chars = lambda n: F.aggregate(F.slice(few, F.lit(1), n), F.lit(0), lambda a, t: a + F.length(t))
    fitting = F.filter(F.sequence(F.lit(1), F.greatest(F.size(few), F.lit(1))), lambda n: chars(n) <= QUERY_CHARS)
    return T.once(F.slice(few, F.lit(1), F.greatest(F.size(fitting), F.lit(1))), lambda t: t)


def search_text_of(terms: Column, exclude: Column, as_of: Column) -> Column:
    """search_text of columns; terms as search_terms_of gives them, exclude as keywords."""
    left = F.greatest(F.lit(OPERATORS + 1) - F.size(terms), F.lit(0))
    nots = F.transform(F.slice(search_terms_of(exclude), F.lit(1), left), lambda t: F.concat(F.lit("NOT "), t))
    since = F.concat(F.lit("pushed:>"), F.date_sub(as_of, PUSHED_WITHIN_DAYS).cast("string"))
    return F.array_join(F.concat(F.array(F.array_join(terms, " OR "), F.lit("in:name,description,readme")), nots, F.array(since)), " ")


def legs_of(themes: DataFrame, as_of: Column, *, include: str = "keywords_include", exclude: str = "keywords_exclude", key: str = "theme") -> DataFrame:
    """key, leg, label, text: search_legs of a whole table of themes."""
    own = search_terms_of(F.col(include), quote_hyphen=True)
    leg = lambda label, terms: F.struct(label.alias("label"), search_text_of(terms, F.col(exclude), as_of).alias("text"))
    first = F.array(leg(F.lit(ALL_LEG), search_terms_of(F.col(include))))
    each = F.when(F.size(own) > 1, F.transform(own, lambda t: leg(F.trim(t, F.lit('"')), F.array(t)))).otherwise(F.slice(first, 1, 0))
    return themes.select(key, F.posexplode(F.concat(first, each)).alias("leg", "e")).select(key, "leg", "e.label", "e.text")


def turns_of(totals: DataFrame, *, key: str = "theme") -> DataFrame:
    """totals (key, leg, total) plus turns: leg_turns of every theme at once."""
    w = W.partitionBy(key)
    either, n = F.max(F.when(F.col("leg") == 0, F.col("total"))).over(w), F.count("*").over(w) - 1
    rows = totals.withColumn("__or", either).withColumn("__n", n)
    keep = F.coalesce((F.col("total") * F.col("__n") < F.col("__or")).cast("int"), F.lit(0))
    rows = rows.withColumn("__keep", F.when(F.col("leg") > 0, keep).otherwise(0)).withColumn("__kept", F.sum("__keep").over(w))
    turns = F.when(F.coalesce("__or", F.lit(0)) == 0, 1).when(F.col("leg") == 0, F.greatest(F.lit(1), F.col("__n") - F.col("__kept"))).otherwise(F.col("__keep"))
    return rows.withColumn("turns", F.when(F.col("__n") == 0, 1).otherwise(turns).cast("int")).select(*totals.columns, "turns")


def known_source(name: Column) -> Column:
    """The source that a name stands for, whatever its case; null where none is."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return names[F.lower(F.trim(T.text_or_empty(name)))]


def search_predicate(terms: Sequence[str], exclude: Sequence[str], as_of: Column, *, text: Column, pushed: Column) -> Column:
    """The same search over a table of repositories."""
    hay = T.padded(text)
    bare = lambda t: T.padded(F.lit(t.strip('"')))
    hit = F.lit(False)
    for t in terms:
        hit = hit | T.phrase_in(hay, bare(t))
    for t in exclude:
        hit = hit & ~T.phrase_in(hay, bare(t))
    return hit & (pushed > F.date_sub(as_of, PUSHED_WITHIN_DAYS))


def leg_turns(totals: Sequence[int | None]) -> list[int]:
    """Turns a round of the OR leg (first) and the keyword legs: a keyword rarer than an equal share of the OR total keeps its own."""
    either, *own = totals
    if not own:
        return [1]
    if not either:
        return [1] * len(totals)
    keep = [int(t is not None and t * len(own) < either) for t in own]
    return [max(1, len(own) - sum(keep)), *keep]


def seat_by_turns(legs: DataFrame, turns: Sequence[int], *, limit: int, key: str = "full_name", leg: str = "leg", pos: str = "pos") -> DataFrame:
    """Weighted round-robin over legs; each repository once, at its first seat. legs: leg, pos, key.

    Leg l seats turns[l] rows a round, so row i of leg l sits in round i div turns[l]. Only heads of the legs are ever
    ranked: they are lengthened until the rounds that they fill have enough repositories, so no task holds a leg.
    """
    seated = [(n, turn) for n, turn in enumerate(turns) if turn > 0]
    names = [c for c in legs.columns if c in (key, leg)]
    own, first = F.row_number().over(W.partitionBy(leg).orderBy(pos, *names)) - 1, F.row_number().over(W.partitionBy(key).orderBy("__round", leg, "__own"))
    weight = F.element_at(F.array(*[F.lit(t) for t in turns]), F.col(leg) + 1)
    most = 4 * max(limit, 1)
    while True:
        heads = [legs.where(F.col(leg) == n).orderBy(pos, *names).limit(most) for n, _ in seated] or [legs.limit(0)]
        dealt = cut(reduce(DataFrame.unionByName, heads).withColumn("__own", own).withColumn("__round", F.floor(F.col("__own") / weight)))
        held = {r[0]: r[1] for r in dealt.groupBy(leg).agg(F.count("*")).collect()}
        ends = [most // turn for n, turn in seated if held.get(n, 0) == most]
        if not ends or dealt.where(F.col("__round") < min(ends)).select(key).distinct().limit(limit).count() == limit:
            break
        most *= 8
    return dealt.withColumn("__n", first).where("__n = 1").orderBy("__round", leg, "__own").limit(limit).drop("__own", "__round", "__n")


def issue_signal(items: DataFrame, *, sample: int = 5) -> DataFrame:
    """repo, issues, opened, closed, with_body, labelled, reporters over the newest sample without pull requests;
    if those are all pull requests, over the newest issues behind them. items: repo, owner, pos, state, body, login, labels, is_pr."""
    rows = items.where(F.col("pos") < ISSUE_PAGE)
    near = F.count_if((F.col("pos") < sample) & ~F.col("is_pr")).over(W.partitionBy("repo"))
    nth = F.sum((~F.col("is_pr")).cast("int")).over(W.partitionBy("repo").orderBy("pos"))
    used = ~F.col("is_pr") & F.when(F.col("__near") > 0, F.col("pos") < sample).otherwise(F.col("__nth") <= sample)
    rows = rows.withColumn("__near", near).withColumn("__nth", nth).withColumn("used", used)
    u = F.col("used")
    got = rows.groupBy("repo").agg(
        F.count_if(u).alias("issues"), F.count_if(u & (F.col("state") == "open")).alias("opened"), F.count_if(u & (F.col("state") == "closed")).alias("closed"), F.count_if(u & (F.trim(F.coalesce("body", F.lit(""))) != "")).alias("with_body"),
        F.count_if(u & (F.size(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) > 0)).alias("labelled"), F.count_distinct(F.when(u & (F.col("login") != "") & (F.col("login") != F.col("owner")), F.col("login"))).alias("reporters"),
        F.count("*").alias("listed"),
    )
    return got


def attach_signals(repos: DataFrame, *, issues: DataFrame, releases: DataFrame, runs: DataFrame, contributors: DataFrame) -> DataFrame:
    """repos plus what the issue, release, CI and contributor tables say; missing counts are 0."""
    rel = releases.groupBy("repo").agg(F.count("*").alias("release_count"), F.max("published_at").alias("latest_release_at"))
    ci = runs.groupBy("repo").agg(F.count("*").alias("ci_runs"), F.count_if(F.col("conclusion") == "success").alias("ci_success"))
    own = repos.select(F.col("full_name").alias("repo"), "owner")
    ext = contributors.join(own, "repo").groupBy("repo").agg(F.count_if(F.col("login") != F.col("owner")).alias("contributors"))
    out = repos
    for side in (issue_signal(issues), rel, ci, ext):
        out = out.join(side.withColumnRenamed("repo", "full_name"), "full_name", "left")
    counts = ("issues", "opened", "closed", "with_body", "labelled", "reporters", "listed", "release_count", "ci_runs", "ci_success", "contributors")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in out.columns])


def reliability(repos: DataFrame, as_of: Column, *, rich: bool) -> DataFrame:
    """repos plus the four pillars and their sum, at most 100. rich moves weight from the README to releases, CI and people."""
    days = F.coalesce(S.days_since(F.nullif("pushed_at", F.lit("")), as_of), S.days_since(F.col("updated_at"), as_of))
    readme, code = S.readme_completeness(F.col("readme")), S.code_blocks(F.col("readme"))
    if rich:
        impl = F.bround(readme * 0.4, 0).cast("int") + F.bround(code * 0.4, 0).cast("int") + S.release_cadence(F.col("release_count")) + S.ci_health(F.col("ci_success"), F.col("ci_runs")) + S.third_party(F.col("contributors"), F.col("reporters"))
    else:
        impl = readme + code
    all_prs = (F.col("issues") == 0) & (F.col("listed") > 0)
    issue = F.when(all_prs, 3).otherwise(S.issue_points(F.col("issues"), F.col("with_body"), F.col("closed"), F.col("labelled"), F.col("stars")))
    out = repos.withColumn("days", days).withColumn("impl_doc_score", impl).withColumn("lma_score", S.maintenance(F.col("days"), F.col("stars"), F.col("forks"), F.col("opened"), F.col("closed")))
    out = out.withColumn("community_score", S.fork_to_star(F.col("stars"), F.col("forks")) + issue).withColumn("security_score", S.practices(F.col("description"), F.col("readme"), F.col("license_name")))
    return out.withColumn("reliability_score", F.least(F.col("impl_doc_score") + F.col("lma_score") + F.col("community_score") + F.col("security_score"), F.lit(100)))


def lift_pool(repos: DataFrame, pool: str) -> DataFrame:
    """Maintenance lifted by the recency rank within the pool, and the total with it."""
    out = S.pool_relative(repos, "days", "lma_score", pool)
    return out.withColumn("reliability_score", F.least(F.col("impl_doc_score") + F.col("lma_score") + F.col("community_score") + F.col("security_score"), F.lit(100)))


ANCHOR = ("id", "title", "year", "venue", "cited_by_count", "abstract", "concepts", "publication_type", "reliability_score", "theme_fit_score")


def repos_to_works(repos: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    strong = F.concat_ws(" ", "full_name", "description", F.array_join("topics", " "))
    fit = T.keyword_fit(strong, F.col("readme"), include, exclude, scale=30)
    body = F.concat_ws("\n\n", F.nullif(F.trim("description"), F.lit("")), F.nullif(F.substring(F.trim(T.text_or_empty(F.col("readme"))), 1, 2000), F.lit("")))
    return repos.withColumn("fit", fit).select(
        F.col("html_url").alias("id"), F.col("full_name").alias("title"), S.updated_year(F.col("updated_at")).alias("year"), F.lit("GitHub").alias("venue"), F.col("stars").cast("long").alias("cited_by_count"), F.nullif(body, F.lit("")).alias("abstract"),
        F.col("topics").alias("concepts"), F.lit("github_repository").alias("publication_type"), "reliability_score", F.col("fit.score").alias("theme_fit_score"),
    )


def _first_year(*stamps: str) -> Column:
    return F.coalesce(*[F.year(F.try_to_timestamp(F.col(s))) for s in stamps], F.lit(0))


def _hub_like(rows: DataFrame, *, id: Column, title: Column, year: Column, venue: str, cites: Column, abstract: Column, tags: Column, kind: str, points: Column, strong: Column, body: Column, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("fit", T.keyword_fit(strong, body, include, exclude, scale=20, penalty=7, most=14))
    return rows.select(
        id.alias("id"), title.alias("title"), year.alias("year"), F.lit(venue).alias("venue"), cites.cast("long").alias("cited_by_count"), F.nullif(abstract, F.lit("")).alias("abstract"), F.slice(tags, 1, 25).alias("concepts"),
        F.lit(kind).alias("publication_type"), F.least(points + F.col("fit.score"), F.lit(100)).alias("reliability_score"), F.col("fit.score").alias("theme_fit_score"),
    )


def hub_to_works(raw: DataFrame, as_of: Column, include: Sequence[str], exclude: Sequence[str] = (), *, kind: str = "model", base: str = "https://huggingface.co", payload: str = "payload", card: str = "card") -> DataFrame:
    h = raw.select(F.from_json(payload, HUB).alias("h"), T.text_or_empty(F.col(card)).alias("card")).select("h.*", "card")
    name = F.coalesce("id", "modelId", "_id")
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    downloads, likes = F.coalesce(F.nullif("downloads", F.lit(0)), "downloadsAllTime", F.lit(0)), F.coalesce("likes", F.lit(0))
    points = S.hub_adoption(downloads, likes) + S.hub_activity(S.days_since(F.col("lastModified"), as_of)) + S.hub_license(hub_license(tags))
    made = F.concat_ws(" · ", F.nullif("pipeline_tag", F.lit("")), F.nullif("library_name", F.lit("")), F.nullif(F.array_join(F.slice(tags, 1, 8), ", "), F.lit("")))
    strong = F.concat_ws(" ", name, F.array_join(tags, " "), "pipeline_tag", "library_name")
    abstract = F.coalesce(F.nullif(F.substring("card", 1, 2000), F.lit("")), made)
    prefix = f"{base}/datasets/" if kind == "dataset" else f"{base}/"
    return _hub_like(h, id=F.concat(F.lit(prefix), name), title=name, year=_first_year("createdAt", "lastModified"), venue="HuggingFace", cites=likes, abstract=abstract, tags=tags, kind=f"huggingface_{kind}", points=points, strong=strong, body=F.col("card"), include=include, exclude=exclude)


def _tag_names() -> Column:
    return F.filter(F.transform(F.coalesce("tags", F.array().cast("array<struct<name:string,fullPath:string,ref:string>>")), lambda t: F.coalesce(t.getField("name"), t.fullPath, t.ref)), lambda t: t.isNotNull())


def datasets_to_works(raw: DataFrame, as_of: Column, include: Sequence[str], exclude: Sequence[str] = (), *, base: str = "https://www.kaggle.com/datasets/", payload: str = "payload") -> DataFrame:
    d = raw.select(F.from_json(payload, SET).alias("d")).select("d.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    points = S.dataset_adoption(zero("downloadCount"), zero("voteCount"), F.coalesce("usabilityRating", F.lit(0.0))) + S.hub_activity(S.days_since(F.col("lastUpdated"), as_of)) + S.hub_license(F.col("licenseName"))
    abstract = F.coalesce(F.nullif("subtitle", F.lit("")), F.array_join(F.slice(_tag_names(), 1, 8), " · "))
    return _hub_like(d, id=F.concat(F.lit(base), "ref"), title=F.col("ref"), year=_first_year("lastUpdated"), venue="Kaggle", cites=zero("voteCount"), abstract=abstract, tags=_tag_names(), kind="kaggle_dataset", points=points, strong=F.concat_ws(" ", "ref", "title", "subtitle", F.array_join(_tag_names(), " ")), body=F.lit(""), include=include, exclude=exclude)


def notebooks_to_works(raw: DataFrame, as_of: Column, include: Sequence[str], exclude: Sequence[str] = (), *, base: str = "https://www.kaggle.com/code/", payload: str = "payload") -> DataFrame:
    n = raw.select(F.from_json(payload, BOOK).alias("n")).select("n.*")
    votes = F.coalesce(F.nullif("totalVotes", F.lit(0)), "voteCount", F.lit(0))
    language = F.when(F.trim(F.coalesce(F.nullif("languageName", F.lit("")), "language", F.lit(""))) != "", 15).otherwise(0)
    points = S.notebook_adoption(votes, F.coalesce("medal", F.lit(""))) + S.hub_activity(S.days_since(F.col("lastRunTime"), as_of)) + language
    abstract = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Kaggle notebook by "), F.nullif("author", F.lit(""))))
    return _hub_like(n, id=F.concat(F.lit(base), "ref"), title=F.col("ref"), year=_first_year("lastRunTime"), venue="Kaggle", cites=votes, abstract=abstract, tags=_tag_names(), kind="kaggle_kernel", points=points, strong=F.concat_ws(" ", "ref", "title", F.array_join(_tag_names(), " ")), body=F.lit(""), include=include, exclude=exclude)


def union_sources(*works: DataFrame) -> DataFrame:
    out = works[0]
    for w in works[1:]:
        out = out.unionByName(w, allowMissingColumns=True)
    return out


def collect_sources(works: dict[str, DataFrame], failures: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(works of all sources with their source's name, what failed): a source that failed costs only itself; with none left that is an error."""
    if not works:
        raise ValueError("no source gave anything: " + "; ".join(f"{k}: {v}" for k, v in (failures or {}).items()))
    return union_sources(*(w.withColumn("anchor_source", F.lit(name)) for name, w in works.items())), dict(failures or {})
