"""From ranked candidates to entries of a document: labels, levels, filled texts, Markdown blocks.

An entry is a row: track, pos, id, title, label, level, relationship, summary, hypothesis, caution and the work's own
columns. Texts that nobody wrote say so and name where what stands in their place comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import diversify, graph, rank

#: Labels of the tracks, marks of unwritten and unchecked texts, weight of an excluded keyword, levels in order.
TRACK_A_LABEL, UNWRITTEN, UNCHECKED, NO_ABSTRACT, TAIL_MARK = "実装アンカー", "（記入なし）", "（呼び手の記述・原文と未照合）", "abstract欠損", "…"
EXCLUDE_WEIGHT = 2
LEVEL_RANK = {"高": 3, "中": 2, "低": 1}


def keyword_score(title: Column, abstract: Column, include: list[str], exclude: list[str]) -> Column:
    """Included keywords in the text less twice the excluded ones."""
    t = F.lower(F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(abstract)))
    hits = lambda words: sum((t.contains(w.lower()).cast("int") for w in words if w), F.lit(0))
    return hits(include) - EXCLUDE_WEIGHT * hits(exclude)


def pre_rank(works: DataFrame, include: list[str], exclude: list[str], *, count: int, pos: str = "pos") -> DataFrame:
    """The best max(3 count, 30) works by keyword_score; ties as they came."""
    score = keyword_score(F.col("title"), F.col("abstract"), include, exclude)
    return works.withColumn("keyword_score", score).orderBy(F.col("keyword_score").desc(), pos).limit(max(3 * count, 30))


def level_order(level: str = "level", pos: str = "pos") -> list[Column]:
    """Levels from high to low, unknown ones as middle; else as they came."""
    rank_of = F.lit(2)
    for name, r in LEVEL_RANK.items():
        rank_of = F.when(F.col(level) == name, r).otherwise(rank_of)
    return [rank_of.desc(), F.col(pos).asc()]


def best_attempts(rows: DataFrame, *, key: str = "id", attempt: str = "attempt", complete: Column) -> DataFrame:
    """One row a key over repeated attempts: the first complete one, else the first."""
    w = W.partitionBy(key).orderBy(complete.cast("int").desc(), attempt)
    return rows.withColumn("complete", complete).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def select_bridges(candidates: DataFrame, through: DataFrame, *, count: int, near: DataFrame | None = None) -> DataFrame:
    """The first count candidates without near-domain ones, by hybrid score and then structure, no bridge with more than two places.

    candidates: the signals of graph.two_hop, hybrid (optional); through: id, bridges; near: id, near.
    """
    rows = candidates if near is None else candidates.join(near.where("near").select("id"), "id", "left_anti")
    order = ([F.col("hybrid").desc()] if "hybrid" in rows.columns else []) + graph.rank_keys()
    listed = rows.join(through, "id", "left").withColumn("theme", F.lit(0)).withColumn("pos", F.row_number().over(W.orderBy(*order)))
    return diversify.head_window(listed, window=count).where(F.col("slot") < count)


def bridge_entries(chosen: DataFrame, overlap: DataFrame) -> DataFrame:
    """Entries of selected bridge candidates. overlap: id, inter, union_n (root and first-level concepts shared with the theme)."""
    share = F.when(F.col("union_n") > 0, F.col("inter") / F.col("union_n")).otherwise(0.0)
    label = F.concat_ws("", F.lit("引用ブリッジ（共有 "), F.col("shared_bridge_count"), F.lit(" 本 / 異分野 "), F.col("bridge_betweenness"), F.lit("）"))
    j = chosen.join(overlap, "id", "left")
    return j.select(F.lit("B").alias("track"), F.col("slot").alias("pos"), "id", label.alias("label"), F.round(1 - F.coalesce(share, F.lit(0.0)), 2).alias("distance"), F.lit(0.0).alias("structure"), F.lit(0.0).alias("serendipity"))


def anchor_entries(works: DataFrame, *, count: int) -> DataFrame:
    """Entries of the best anchors; the level is that of the relevance, not of the reliability."""
    top = works.orderBy(*rank.anchor_order()).limit(count)
    pos = F.row_number().over(W.orderBy(*rank.anchor_order())) - 1
    note = F.when(F.col("relevance") > 0, "").otherwise("・一致キーワード 0 件のため、一致のあるアンカーすべての後ろに並ぶ")
    return top.withColumn("pos", pos).select(F.lit("A").alias("track"), "pos", "id", F.lit(TRACK_A_LABEL).alias("label"), S.relevance_level(F.col("relevance")).alias("level"), "anchor_rank_score", note.alias("tier_note"))


def connection_label(label: Column, causal: Column) -> Column:
    """The connection's label; a link judged not causal says that it is loose."""
    base = F.coalesce(F.nullif(label, F.lit("")), F.lit("構造的接続"))
    return F.when(causal == False, F.concat(F.lit("【接続点（構造対応ゆるめ・思考のタネ）: "), base, F.lit("】"))).otherwise(F.concat(F.lit("【接続点: "), base, F.lit("】")))  # noqa: E712


def depth_shown(depth: Column) -> Column:
    """Two places; null where it was not judged."""
    return F.round(depth.cast("double"), 2)


def naive_fill(picked: DataFrame, pool: DataFrame, *, count: int, pos: str = "pos") -> DataFrame:
    """picked (pos, id) filled up from the pool in order, without those picked."""
    rest = pool.join(picked.select("id"), "id", "left_anti")
    both = picked.select(F.lit(0).alias("__o"), pos, "id").unionByName(rest.select(F.lit(1).alias("__o"), pos, "id"))
    top = both.orderBy("__o", pos, "id").limit(count)
    return top.select((F.row_number().over(W.orderBy("__o", pos, "id")) - 1).alias("slot"), "id", (F.col("__o") == 1).alias("filled"))


def excerpt_summary(abstract: Column) -> Column:
    """The first three sentences, marked as borrowed from the opening (or, for a tail cut, from the end)."""
    a = T.text_or_empty(abstract)
    body = _sentences_cut(a)
    where = F.when(a.startswith(TAIL_MARK), "末尾").otherwise("冒頭")
    return F.when(body == "", NO_ABSTRACT).otherwise(F.concat(F.lit(f"{UNWRITTEN}原文の"), where, F.lit("の抜粋: "), body))


def _sentences_cut(a: Column, *, n: int = 3, chars: int = 160) -> Column:
    parts = F.transform(T.sentences(F.replace(a, F.lit("\n"), F.lit(" "))), lambda s: F.concat(s, F.lit(".")))
    merged = F.array_join(F.slice(parts, 1, n), " ")
    return T.once(merged, lambda m: F.when(F.length(m) <= chars, m).otherwise(F.concat(_cut_at_word(F.substring(m, 1, chars)), F.lit("..."))))


def _cut_at_word(t: Column) -> Column:
    """Before the last space, if there is one."""
    return F.regexp_replace(t, r"(?s) [^ ]*$", "")


def short_summary(abstract: Column, *, chars: int = 120) -> Column:
    """The first characters, cut at a word."""
    t = F.replace(F.trim(T.text_or_empty(abstract)), F.lit("\n"), F.lit(" "))
    return F.when(t == "", NO_ABSTRACT).when(F.length(t) <= chars, t).otherwise(F.concat(_cut_at_word(F.substring(t, 1, chars)), F.lit("...")))


def caution_for(concern: Column, assumptions: Column) -> Column:
    """What stands for a caution that nobody wrote."""
    first = F.try_element_at(assumptions, F.lit(1))
    return F.when(T.text_or_empty(concern) != "", "（個別の注意点は記入なし。テーマの不安点は入力サマリの「不安点」の行）").when(first.isNotNull(), F.concat(F.lit("（個別の注意点は記入なし）前提「"), first, F.lit("」が成り立つか要確認。"))).otherwise("（個別の注意点は記入なし）")


def fill(entries: DataFrame, *, concern: Column, assumptions: Column) -> DataFrame:
    """entries with relationship, summary, hypothesis and caution filled; what a caller wrote stays, unchecked prose is marked."""
    own = lambda c: F.nullif(F.trim(T.text_or_empty(F.col(c))), F.lit(""))
    marked = lambda c: F.when(own(c).isNotNull(), F.concat(F.lit(UNCHECKED), F.col(c)))
    relation = F.when(F.col("track") == "A", F.concat(F.lit("関係軸「"), F.col("label"), F.lit("」で関係度「"), F.coalesce(F.col("level"), F.lit("中")), F.lit("」の関連性がある。"))).otherwise(F.concat(F.lit(f"{UNWRITTEN}接続点ラベルのみ: "), F.col("label")))
    return (
        entries.withColumn("relationship", F.coalesce(own("relationship"), relation))
        .withColumn("summary", F.coalesce(marked("summary"), excerpt_summary(F.col("abstract"))))
        .withColumn("hypothesis", F.coalesce(own("hypothesis"), F.lit(UNWRITTEN)))
        .withColumn("caution", F.coalesce(marked("caution"), caution_for(concern, assumptions)))
    )


def pillar_line(source: Column, pillars: dict[str, Column]) -> Column:
    """The pillars behind a reliability score, per source; null pillars are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), v.cast("string"))) for k, v in pillars.items()]
    return F.concat(source, F.lit(": "), F.concat_ws(" / ", *parts))


def entry_block(*, n: str = "pos") -> Column:
    """One entry as Markdown: heading, label, the four texts, in their order."""
    head = F.concat_ws("", F.lit("### "), F.col(n) + 1, F.lit(". "), T.text_or_empty(F.col("title")))
    lines = [head, F.col("label"), F.concat(F.lit("1) "), F.col("summary")), F.concat(F.lit("2) "), F.col("relationship")), F.concat(F.lit("3) "), F.col("hypothesis")), F.concat(F.lit("4) "), F.col("caution"))]
    return F.concat_ws("\n", *lines)


def write_markdown(document: str, spark, path: str) -> None:
    """One text file through the cluster's file system, so that any store that Spark writes will do."""
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)
