"""The three lifecycles as compositions of operators; score tables come from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import collect, contract, diversify, documents, gates, graph, rank, render
from orrery.sources import anchors, parse


def collect_bridges(works: DataFrame, refs: DataFrame, seeds: DataFrame, *, home: DataFrame | None = None, cap: int = 50, limit: int = 60, window: int = 10, used: DataFrame | None = None, home_topics: DataFrame | None = None, home_domains: DataFrame | None = None) -> DataFrame:
    """Candidates across shared references: seed groups, three-tier pool, fair share with backfill, hybrid rank, head window.

    works: id, field, cites, and where they are known domain, topic, type, n_refs and retracted; seeds: works' rows, with dk
    and tk (keys of DOI and title) where they are known; refs: id, ref, and at (the place in the work's list) where it is known.
    """
    home = graph.dominant(seeds, "field").select("field") if home is None else home
    known = {"domain": "string", "topic": "string", "type": "string", "n_refs": "int", "retracted": "boolean"}
    full = works.select("*", *[(F.lit(0) if c == "n_refs" else F.lit(None)).cast(k).alias(c) for c, k in known.items() if c not in works.columns])
    keyed = seeds.select("id", "cites", *[F.col(c) if c in seeds.columns else F.lit("").alias(c) for c in ("dk", "tk")])
    listed = keyed.withColumn("pos", F.row_number().over(W.orderBy(F.col("cites").desc(), "id")))  # a roster
    groups = collect.seed_groups(listed, refs)
    placed = graph.edges_of(seeds, refs).withColumn("at", F.col("at") if "at" in refs.columns else F.lit(0))
    own, refs = placed.select("id", "ref"), refs.select("id", "ref")
    pool = collect.pool_of_groups(groups, placed, cap=cap)
    kind = "article" if "type" in works.columns else None
    found = collect.collect_candidates(full, refs, seeds, pool, home_fields=home, home_topics=home_topics, home_domains=home_domains, used=used, limit=limit, work_type=kind)
    cited = works.join(F.broadcast(found.select("id")), "id")
    strength = own.groupBy("ref").agg(F.countDistinct("id").alias("seed_citers"))
    pool = pool.join(strength, "ref")
    through = graph.hits(cited, refs, pool)
    signals = graph.bridge_signals(cited, through, pool)
    ranked = rank.hybrid_score(signals, ["bridge_strength"], "cites")
    order = [F.col("hybrid").desc(), *graph.rank_keys()]
    bridges = through.groupBy("id").agg(F.collect_set("ref").alias("bridges"))
    listed = ranked.join(bridges, "id", "left").withColumn("theme", F.lit(0)).withColumn("pos", F.row_number().over(W.orderBy(*order)))
    return diversify.head_window(listed, window=window)


def finalize(materials: DataFrame, theme_text: str, *, count: int = 1, gate: float = gates.GATE, depth_gate: float = gates.DEPTH, output_floor: float = gates.FLOOR, fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(picked rows in order, rejection log) of score rows echoed with their material.

    Prose that is not grounded is dropped; its scores stay.
    """
    rows = materials.withColumn("failures", contract.grounding(F.lit(theme_text)))
    ok = F.size("failures") == 0
    rows = contract.score_row(rows)
    for c in ("relationship", "serendipity_rationale"):
        rows = rows.withColumn(c, F.when(ok, F.col(c)))
    gated = gates.post_gates(rows, gate=gate, depth_gate=depth_gate, output_floor=output_floor)
    kept = gates.with_fallback(gated) if fallback else gated.where("rejected_by IS NULL")
    listed = kept.withColumn("theme", F.lit(0)).withColumn("pos", F.row_number().over(W.orderBy(F.col("serendipity").desc(), "id")))
    picked = diversify.mmr(listed, count, score="serendipity", names="concepts")
    return picked, gates.rejection_log(gated, output_floor=output_floor)


def rank_anchors(works: DataFrame, *, count: int = 3) -> DataFrame:
    """Anchors of all sources: reliability weighed by relevance, matches first. works as the anchor sources give them."""
    scale = F.when(F.col("publication_type") == "github_repository", 30.0).otherwise(20.0)
    rel = F.greatest(F.least(F.col("theme_fit_score") / scale, F.lit(1.0)), F.lit(0.0))
    scored = works.withColumn("relevance", rel).withColumn("anchor_rank_score", S.anchor_score(F.col("reliability_score"), F.col("relevance"))).withColumn("level", S.relevance_level(F.col("relevance")))
    return scored.orderBy(*rank.anchor_order()).limit(count)


def anchor_document(works: DataFrame, theme: DataFrame, *, count: int = 3, section: str = "Track A", title: str = render.TITLE) -> DataFrame:
    """theme, document: the report of the best anchors, filled without any external model. theme: one row of themes.load_themes with theme."""
    ranked = rank_anchors(works, count=count)
    entries = documents.anchor_entries(ranked, count=count).join(ranked.drop("level", "anchor_rank_score"), "id")
    blank = [F.lit(None).cast("string").alias(c) for c in ("relationship", "summary", "hypothesis", "caution", "doi") if c not in entries.columns]
    spec = theme.select("theme", "concern", F.coalesce("assumptions", F.array().cast("array<string>")).alias("assumptions"))
    rows = documents.fill(entries.select("*", *blank).join(F.broadcast(spec), how="cross"), concern=F.col("concern"), assumptions=F.col("assumptions"))  # one theme
    shown = {"relevance": F.round("relevance", 2), "anchor_rank_score": F.round("anchor_rank_score", 1), "relevance_tier": (F.col("relevance") > 0).cast("int"), "reliability_score": F.col("reliability_score"), "theme_fit_score": F.col("theme_fit_score")}
    meta = F.create_map(*[x for k, v in shown.items() for x in (F.lit(k), v.cast("string"))])
    none = F.lit(None).cast("array<struct<keyword:string,where:string,credit:double>>")
    placed = rows.select("*", F.lit(0).alias("section"), F.map_filter(meta, lambda _, v: v.isNotNull()).alias("meta"), none.alias("matched"), F.lit(None).cast("int").alias("n_keywords"))
    return render.documents(render.document_blocks(theme, theme.select("theme", F.lit(0).alias("section"), F.lit(section).alias("title")), placed, title=title))


def bridge_document(works: DataFrame, refs: DataFrame, seeds: DataFrame, overlap: DataFrame, *, count: int = 3, concern: str = "", assumptions: tuple[str, ...] = (), **scope) -> DataFrame:
    """Filled entries of the first count bridge candidates, without any external model. overlap: id, inter, union_n, near."""
    found = collect_bridges(works, refs, seeds, **scope).drop("slot", "theme", "pos")
    chosen = documents.select_bridges(found.drop("bridges"), found.select("id", "bridges"), count=count, near=overlap.select("id", "near"))
    entries = documents.bridge_entries(chosen, overlap).join(works, "id")
    blank = [F.lit(None).cast("string").alias(c) for c in ("level", "relationship", "summary", "hypothesis", "caution", "abstract", "title") if c not in entries.columns]
    listed = F.array(*map(F.lit, assumptions)).cast("array<string>")
    return documents.fill(entries.select("*", *blank), concern=F.lit(concern), assumptions=listed)


def delegated_document(materials: DataFrame, theme_text: str, *, count: int = 1, concern: str = "", assumptions: tuple[str, ...] = (), **gates_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled entries in order, rejection log, what the caller should know of its rows) of rows that a caller scored."""
    picked, log = finalize(materials, theme_text, count=count, **gates_of)
    label = documents.connection_label(F.col("connection_label") if "connection_label" in picked.columns else F.lit(None).cast("string"), F.col("has_causal_pm"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("level", "summary", "hypothesis", "caution") if c not in picked.columns]
    ok = F.size("failures") == 0  # prose whose quotes do not hold is dropped as a whole
    rows = picked.select("*", *blank).withColumn("track", F.lit("B")).withColumn("label", label).withColumn("hypothesis", F.when(ok, F.col("serendipity_rationale")))
    rows = rows.withColumn("summary", F.when(ok, F.col("summary"))).withColumn("caution", F.when(ok, F.col("caution")))
    entries = documents.fill(rows, concern=F.lit(concern), assumptions=F.array(*map(F.lit, assumptions)).cast("array<string>"))
    echoed = materials if "upstream_empty" in materials.columns else materials.withColumn("upstream_empty", F.array().cast("array<string>"))
    report = contract.submission_report(echoed, picked.select("id", (F.size("failures") > 0).alias("failed")))
    return entries, log, report


def collect_repositories(found: DataFrame, signals: dict[str, DataFrame], readmes: DataFrame, *, include: list[str], as_of: Column, exclude: tuple[str, ...] = (), turns: tuple[int, ...] = (1,), limit: int = 30, count: int = 3, rich: bool = True) -> DataFrame:
    """Anchors from repository searches: seats by turns over the search legs, signals, four pillars lifted in the pool, theme fit, rank.

    found: leg, pos, payload (a repository's JSON); signals: issues, releases, runs, contributors as anchors.attach_signals takes
    them; readmes: full_name, readme.
    """
    first = F.row_number().over(W.partitionBy("full_name").orderBy("leg", "pos")) == 1  # a repository of several legs as the first one gives it
    once = found.withColumn("full_name", F.get_json_object("payload", "$.full_name")).withColumn("__first", first).where("__first")
    repos = parse.normalize_repos(once).join(readmes, "full_name", "left").withColumn("readme", F.coalesce("readme", F.lit("")))
    names = found.select("leg", "pos", F.get_json_object("payload", "$.full_name").alias("full_name"))
    seated = anchors.seat_by_turns(names, list(turns), limit=limit).select("full_name")
    pool = repos.join(F.broadcast(seated), "full_name")  # at most limit rows
    scored = anchors.reliability(anchors.attach_signals(pool, **signals), as_of, rich=rich)
    lifted = anchors.lift_pool(scored.withColumn("pool", F.lit("all")), "pool")
    return rank_anchors(anchors.repos_to_works(lifted, include, exclude), count=count)


def collect_facets(returned: DataFrame, used: DataFrame, keys: list[str], *, limit: int = 60, fair: bool = True, off_language: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected records in order, counts by facet and stage) of what semantic searches returned for each facet: rejected facets, home works,
    supplements, used ids, duplicates, other languages last, and a share for every facet."""
    stages = collect.facet_stages(returned, used)
    buckets = collect.facet_buckets(stages.where("stage = 'kept'"), keys, off_language=off_language)
    chosen = collect.facet_select(buckets, limit=limit, fair=fair)
    return chosen, collect.facet_counts(stages, buckets, chosen)
