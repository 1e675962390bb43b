"""Reports as tables of blocks: the theme, its contents, an entry of either track, the appendix; one text a theme at the end.

entries: theme, section (int), track (A, B), pos (from 0), id, doi, title, year, venue, cited_by_count, publication_type, label, level,
the four texts (summary, relationship, hypothesis, caution) and meta (map<string,string>: what a source knows besides, as it
is shown). A Track A entry that its keywords were matched for has matched (array<struct<keyword,where,credit>>) and n_keywords.
All of it is Column expressions; a block is one row, and only a theme's own blocks meet in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

#: What stands for a missing value, and the words of the report.
ABSENT, UNKNOWN, NOT_COLLECTED, TITLE = "—", "TBD", "- （未収集）", "視座拡張レポート"
BODY = (("SUMMARY", "1) 概要: ", "summary"), ("RELATIONSHIP", "2) テーマとの関連性: ", "relationship"), ("HYPOTHESIS", "3) 役に立つ可能性の仮説: ", "hypothesis"), ("CAUTION", "4) 注意点: ", "caution"))
NO_YEARS = "（記録のみ。出版年では絞らないので、これより古い文献も返る）"
TIER_NOTE = "・一致キーワード 0 件のため、一致のあるアンカーすべての後ろに並ぶ"
IDENTITY = "name/description/topics"


def _said(c: Column, instead: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(instead))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _said(p) for p in parts])


def _meta(key: str, instead: str = ABSENT) -> Column:
    return _said(F.col("meta")[key], instead)


def _has(*keys: str) -> Column:
    out = F.col("meta")[keys[0]].isNotNull()
    for k in keys[1:]:
        out = out & F.col("meta")[k].isNotNull()
    return out


def auto_tag(name: str, edge: str) -> Column:
    return F.format_string(f"<!-- AUTO_SECTION:S%02d-E%03d:{name}:{edge} -->", F.col("section"), F.col("pos"))


def body_lines() -> list[Column]:
    """The four texts between their marks."""
    out = []
    for name, head, c in BODY:
        out += [auto_tag(name, "START"), _line(head, F.col(c)), auto_tag(name, "END")]
    return [*out, F.lit("")]


def pillars() -> Column:
    """The pillars that an entry's source scores, each of its most; null where one is missing."""
    own = lambda names: F.when(_has(*(k for _, k, _ in names)), F.concat_ws(", ", *[_line(f"{label}: ", F.col("meta")[k], f"/{most}") for label, k, most in names]))
    repo = own((("Impl/Doc", "impl_doc_score", 30), ("LMA", "lma_score", 25), ("Comm", "community_score", 20), ("Sec", "security_score", 25)))
    hub = own((("Adoption", "adoption_score", 40), ("Activity", "activity_score", 25), ("License", "license_score", 15), ("Theme-fit", "theme_fit_score", 20)))
    kind = F.col("publication_type")
    return F.when(kind == "github_repository", repo).when(kind.startswith("huggingface_") | kind.startswith("kaggle_"), hub)


def matched_line(matched: Column, n: Column) -> Column:
    """Which keywords matched, and where."""
    where = lambda m: F.when(m["where"] == IDENTITY, "名前/説明/topics").otherwise("README")
    part = lambda m: F.when(m["credit"] >= 1, "").otherwise(_line("・部分 ", m["credit"]))
    one = F.transform(matched, lambda m: F.concat(m["keyword"], F.lit("（"), where(m), part(m), F.lit("）")))
    return F.when(F.size(matched) > 0, _line("一致キーワード ", F.size(matched), "/", n, ": ", F.array_join(one, " / "))).otherwise(_line("一致キーワード なし（0/", n, "）"))


def _link() -> Column:
    return _line("- リンク: ", F.coalesce(F.nullif("doi", F.lit("")), F.nullif("id", F.lit("")), F.lit(UNKNOWN)))


def _score_line(extra: Column | None = None) -> Column:
    """A reliability score with its pillars in brackets, where all are there."""
    mode = F.lit("") if extra is None else F.concat(F.lit(" ["), extra, F.lit("]"))
    return F.concat(F.lit("- Reliability Score: "), _meta("reliability_score"), F.lit("/100"), mode, F.coalesce(F.concat(F.lit(" ("), pillars(), F.lit(")")), F.lit("")))


def _of_source() -> list[Column]:
    """The lines by which repositories, hub items, data sets and papers differ; null where a line is not theirs."""
    kind = F.col("publication_type")
    repo, hub, sets = (F.coalesce(c, F.lit(False)) for c in (kind == "github_repository", kind.startswith("huggingface_"), kind.startswith("kaggle_")))
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit(ABSENT))
    rich = repo & F.coalesce(F.col("meta")["has_rich_signals"] == "true", F.lit(False))
    made = lambda k, *tail: F.concat(F.lit("- 更新年: "), year, F.lit("  |  種別: "), _said(F.col("venue")), F.lit("/"), _meta(k), *tail)
    license_of = F.concat(F.lit("  |  License: "), F.coalesce(F.nullif(F.col("meta")["license_name"], F.lit("")), F.lit(ABSENT)))
    loads = F.coalesce(F.concat(F.lit("  |  DL: "), F.col("meta")["downloads"]), F.lit(""))
    return [
        F.when(repo, _line("- 更新年: ", year, "  |  種別: ", F.col("venue"), "  |  stars: ", F.col("cited_by_count")))
        .when(hub, made("hf_kind", F.lit("  |  DL: "), _meta("downloads"), F.lit("  |  likes: "), _meta("likes")))
        .when(sets, made("kaggle_kind", F.lit("  |  votes: "), _meta("votes"), loads))
        .otherwise(paper_line()),
        F.when(repo, F.concat(_score_line(F.when(rich, "rich: time+people").otherwise("README-only")), license_of)).when(hub, F.concat(_score_line(), license_of)).when(sets, _score_line()),
        F.when(rich, F.concat(F.lit("- Verified Maturity: "), _meta("verified_maturity_score"), F.lit("/12 (releases: "), _meta("release_count"), F.lit(", CI: "), _meta("ci_recent_success"), F.lit("/"), _meta("ci_runs_sampled"), F.lit(" passing)"))),
        F.when(rich, F.concat(F.lit("- Third-Party Signal: "), _meta("third_party_score"), F.lit("/6 (ext. contributors: "), _meta("external_contributor_count"), F.lit(", non-owner reporters: "), _meta("non_owner_issue_reporters"), F.lit(")"))),
        F.when(repo, F.concat(F.lit("- Issue Signal: "), _meta("issue_signal_summary"))).when(hub, F.concat(F.lit("- Task/Pipeline: "), F.coalesce(F.nullif(F.col("meta")["pipeline_tag"], F.lit("")), F.lit(ABSENT)))),
    ]


def paper_line() -> Column:
    return _line("- 年: ", F.col("year"), "  |  掲載: ", F.col("venue"), "  |  被引用: ", F.col("cited_by_count"))


def anchor_lines() -> list[Column]:
    """A Track A entry: how near it is, why it stands where it does, what matched, what its source says."""
    relevance = F.col("meta")["relevance"]
    return [
        _line("- **関係度**: ", F.coalesce(F.nullif("level", F.lit("")), F.lit(ABSENT)), F.coalesce(F.concat(F.lit("（theme関連度 "), relevance, F.lit("）")), F.lit(""))),
        _line("- **関係軸**: ", F.coalesce(F.nullif("label", F.lit("")), F.lit(ABSENT))),
        F.when(_has("anchor_rank_score"), F.concat(F.lit("- **順位スコア**: "), _meta("anchor_rank_score"), F.lit(" = Reliability × 関連度係数 (theme関連度 "), _said(relevance, "0.0"), F.when(F.col("meta")["relevance_tier"] == "0", TIER_NOTE).otherwise(""), F.lit(")"))),
        F.when(F.col("matched").isNotNull(), F.concat(F.lit("- **"), matched_line(F.col("matched"), F.coalesce("n_keywords", F.lit(0))), F.lit("**"))),
        *_of_source(),
    ]


def bridge_lines() -> list[Column]:
    """A Track B entry: the connection, the score and its factors."""
    score = F.concat(F.lit("- **セレンディピティ・スコア**: "), _meta("serendipity_score"), F.lit("（距離 "), _meta("distance_score"), F.lit(" × 目的の一致 "), _meta("structure_score"), F.lit("＝purpose_sim）"))
    depth = F.coalesce(F.concat(F.lit("／構造の深さ "), F.col("meta")["structural_depth"], F.lit("（structural_depth・hollow ゲートにだけ使い、点数には入らない）")), F.lit(""))
    return [_line("- **接続点**: ", F.coalesce(F.nullif("label", F.lit("")), F.lit(ABSENT))), F.concat(score, depth), paper_line()]


def entry_block() -> Column:
    """One entry of either track."""
    head = [_line("### ", F.col("pos") + 1, ". ", F.col("title")), F.lit("")]
    own = [F.when(F.col("track") == "B", F.array(*bridge_lines())).otherwise(F.array(*anchor_lines()))]
    lines = F.concat(F.array(*head), *own, F.array(_link(), F.lit(""), *body_lines()))
    return F.array_join(F.array_compact(lines), "\n")


def theme_block(*, title: str = TITLE) -> Column:
    """What the report starts from. theme columns as themes.load_themes gives them."""
    own = lambda c: _said(F.col(c))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    words = lambda c, name: F.when(F.size(listed(F.col(c))) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(c, ", ")))
    lines = F.concat(
        F.array(_line(f"# {title}（ホーム分野: ", own("scope_field"), "）"), F.lit(""), F.lit("## 入力サマリ"), F.lit(""), _line("- テーマ概要: ", own("theme_overview")), _line("- 目的: ", own("goal")), _line("- 問題意識: ", own("why_problem")), _line("- アプローチ: ", own("approach_type")), F.lit("- 前提・仮説:")),
        F.transform(listed(F.col("assumptions")), lambda a: F.concat(F.lit("  - "), a)),
        F.array(F.lit("- スコープ:"), _line("  - 分野: ", own("scope_field")), _line("  - スケール: ", own("scale")), _line("  - 時代: ", own("time_range"), F.when(F.coalesce("time_range", F.lit("")) != "no_limit", NO_YEARS).otherwise("")), words("keywords_include", "include"), words("keywords_exclude", "exclude"), F.when(own("concern") != "", _line("- 不安点: ", own("concern"))), F.lit("")),
    )
    return F.array_join(F.array_compact(lines), "\n")


def document_blocks(themes: DataFrame, sections: DataFrame, entries: DataFrame, *, title: str = TITLE) -> DataFrame:
    """theme, place (struct, in order), block: the report of every theme.

    themes: theme, load_themes' columns, and collected_at, query, filter_policy where they are known; sections: theme, section, title.
    """
    at = lambda part, section=0, pos=0: F.struct(F.lit(part).alias("part"), (F.lit(section) if isinstance(section, int) else section).cast("int").alias("section"), (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos")).alias("place")
    known = themes.select("*", *[F.lit(None).cast("string").alias(c) for c in ("collected_at", "query", "filter_policy") if c not in themes.columns])
    named = sections.groupBy("theme").agg(F.transform(F.sort_array(F.collect_list(F.struct("section", "title"))), lambda s: F.concat(F.lit("- "), s["title"])).alias("titles"))
    contents = themes.select("theme").join(named, "theme", "left").select("theme", at(1), F.array_join(F.concat(F.array(F.lit("## 目次"), F.lit("")), F.coalesce("titles", F.array().cast("array<string>")), F.array(F.lit(""))), "\n").alias("block"))
    filled = entries.groupBy("theme", "section").agg(F.lit(True).alias("filled"))
    empty = F.when(F.col("filled").isNull(), F.lit(f"\n{NOT_COLLECTED}\n")).otherwise("")
    heads = sections.join(filled, ["theme", "section"], "left").select("theme", at(2, F.col("section"), -1), F.concat(F.lit("## "), F.col("title"), F.lit("\n"), empty).alias("block"))
    rows = entries.select("theme", at(2, F.col("section"), F.col("pos")), entry_block().alias("block"))
    told = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))
    end = known.select("theme", at(3), F.concat_ws("\n", F.lit("## 付録"), F.lit(""), _line("- 取得日: ", told("collected_at")), _line("- 検索条件: ", told("query")), _line("- フィルタ条件: ", told("filter_policy")), F.lit("")).alias("block"))
    first = known.select("theme", at(0), theme_block(title=title).alias("block"))
    return first.unionByName(contents).unionByName(heads).unionByName(rows).unionByName(end)


def documents(blocks: DataFrame) -> DataFrame:
    """theme, document: a theme's blocks under each other; a theme's entries are bounded by its selection."""
    return blocks.groupBy("theme").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda b: b["block"]), "\n").alias("document"))


def pool_lines(include: list[str], counts: DataFrame, totals: DataFrame, *, legs: DataFrame | None = None) -> DataFrame:
    """pos, line: how a pool was fetched, how often each keyword matches in it, and which keywords none of it carries by name.

    counts: keyword, strong, readme, total (stats.keyword_breakdown); totals: one row of measured, readme_failed, issue_failed and
    first_error; legs: one row with line. Nothing measured gives no lines.
    """
    order = F.array_position(F.array(*map(F.lit, include)).cast("array<string>"), F.col("keyword"))
    listed = lambda c, s: F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.when(c, s).alias("s")))), lambda x: x["s"].isNotNull()), lambda x: x["s"]), " / ")
    shown = F.concat("keyword", F.lit(" "), "total", F.lit("（"), "strong", F.lit("・"), "readme", F.lit("）"))
    lacks = F.concat("keyword", F.when(F.col("total") == 0, "（README を含め 0 件）").otherwise(F.concat(F.lit("（README の言及のみ "), "readme", F.lit(" 件）"))))
    one = counts.agg(listed(F.lit(True), shown).alias("shown"), listed(F.col("strong") == 0, lacks).alias("lacks"), F.count("*").alias("n")).join(totals, how="cross")  # one row each
    head = F.concat(F.lit("プール内訳（取得 "), F.col("measured").cast("string"), F.lit(" 件のうち各キーワードに一致した件数。括弧内は 名前/説明/topics・README）: "), "shown")
    gap = F.when(F.col("lacks") != "", F.concat(F.lit("名前/説明/topics に一致したものがプールに 1 件も無いキーワード: "), "lacks"))
    first = F.coalesce(F.concat(F.lit("（"), F.nullif("first_error", F.lit("")), F.lit("）")), F.lit(""))
    failed = F.when((F.col("readme_failed") > 0) | (F.col("issue_failed") > 0), F.concat(F.lit("取得失敗: README "), F.col("readme_failed").cast("string"), F.lit(" 件・issue "), F.col("issue_failed").cast("string"), F.lit(" 件"), first))
    rows = one.where("measured > 0 AND n > 0").select(F.posexplode(F.array(head, gap, failed)).alias("pos", "line")).where("line IS NOT NULL").select((F.col("pos") + 1).alias("pos"), "line")
    return rows if legs is None else legs.where("line <> ''").select(F.lit(0).alias("pos"), "line").join(one.where("measured > 0 AND n > 0").select(F.lit(1).alias("x")), how="cross").select("pos", "line").unionByName(rows)
