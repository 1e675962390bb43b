"""Domain > field > subfield > topic: vocabulary, free text to ids, agreement between legs. Taxonomies have a few hundred rows by definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """subfield_id, name, field_id from a JSON array of string triples."""
    return parse_taxonomy(spark.read.text(path, wholetext=True))


def parse_taxonomy(raw: DataFrame, value: str = "value") -> DataFrame:
    """subfield_id, name, field_id of the triples in JSON texts."""
    return raw.select(F.explode(F.from_json(value, "array<array<string>>")).alias("r")).select(F.col("r")[0].alias("subfield_id"), F.col("r")[1].alias("name"), F.col("r")[2].alias("field_id"))


def vocabulary(seen: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """subfield_id, name: the taxonomy's name wins over what works carry."""
    both = taxonomy.select("subfield_id", "name", F.lit(0).alias("o")).unionByName(seen.where("subfield_id IS NOT NULL AND name IS NOT NULL").select("subfield_id", "name", F.lit(1).alias("o")))
    return both.groupBy("subfield_id").agg(F.min_by("name", F.struct("o", "name")).alias("name"))


def _normal(c: Column) -> Column:
    """Lower case, every other run than letters, digits and underscores one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def _phrases(themes: DataFrame, text: str, longest: int) -> DataFrame:
    """themes plus __phrase: every run of up to so many words of a text, each once."""
    words = F.split(_normal(F.col(text)), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return themes.withColumn("__phrase", F.explode(F.array_distinct(runs))).where("__phrase <> ''")


def _dealt(themes: DataFrame) -> DataFrame:
    """themes over as many tasks as shuffles have: a small file of short rows would give all its phrases to one."""
    return themes.repartition(int(themes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *themes.columns)


def _longest(names: DataFrame, name: str) -> int:
    """Words of the longest name; a taxonomy's names are short."""
    return names.agg(F.coalesce(F.max(F.size(F.split(_normal(F.col(name)), " "))), F.lit(1))).first()[0]


def resolve_strict(themes: DataFrame, vocab: DataFrame, *, text: str = "scope_field", key: str = "subfield_id") -> DataFrame:
    """themes x ids whose name is the text or a whole phrase of it: the text's phrases meet the names in an equi-join."""
    named = vocab.select(_normal(F.col("name")).alias("__phrase"), key).where("__phrase <> ''").distinct()
    return _phrases(_dealt(themes), text, _longest(vocab, "name")).join(named, "__phrase").select(*themes.columns, key).distinct()


def resolve_fields(themes: DataFrame, fields: DataFrame, aliases: DataFrame, *, text: str = "scope_field") -> DataFrame:
    """themes x field_id: by alias (short ones only as the whole text), by name, whole name in the text, or the text within a name."""
    t = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    named = aliases.select(_normal(F.col("alias")).alias("__phrase"), (F.length("alias") < 4).alias("__short"), "field_id").unionByName(fields.select(_normal(F.col("name")).alias("__phrase"), F.lit(False).alias("__short"), "field_id")).where("__phrase <> ''").distinct()
    longest = max(_longest(aliases, "alias"), _longest(fields, "name"))
    by_phrase = _phrases(_dealt(themes), text, longest).join(named, "__phrase").where(~F.col("__short") | (_normal(F.col(text)) == F.col("__phrase"))).select(*themes.columns, "field_id")
    # the text within a name: the fields of a taxonomy are a few dozen rows
    within = themes.join(F.broadcast(fields), (F.length(t) >= 4) & F.lower("name").contains(t)).select(*themes.columns, "field_id")
    return by_phrase.unionByName(within).distinct()


def labels_line(rows: DataFrame, *, id_col: str = "field_id", name: str = "name") -> DataFrame:
    """name, ids: ids grouped by label, in order."""
    return rows.groupBy(name).agg(F.array_join(F.sort_array(F.collect_set(id_col)), ",").alias("ids"))


def leg_agreement(roster: DataFrame, pool: DataFrame, *, key: str = "id", topic: str = "topic_id") -> DataFrame:
    """One row: lexical seeds of the roster, those with a topic, and those whose topic the semantic pool has too."""
    lexical = roster.join(pool.select(key), key, "left_anti")
    topics = pool.where(F.col(topic).isNotNull()).select(F.col(topic).alias("__t")).distinct()
    j = lexical.join(topics, F.col(topic) == F.col("__t"), "left")
    return j.agg(F.count("*").alias("lexical"), F.count(topic).alias("known"), F.count("__t").alias("agree"))


def landed_elsewhere(pool: DataFrame, home: DataFrame, *, subfield: str = "subfield_id") -> DataFrame:
    """One row: does half or more of the classified pool sit in one subfield that is not at home."""
    n = pool.where(F.col(subfield).isNotNull()).groupBy(subfield).agg(F.count("*").alias("n"))
    top = n.agg(F.max_by(subfield, F.struct("n", subfield)).alias("top"), F.max("n").alias("n"), F.sum("n").alias("classified"))
    h = home.select(F.col(home.columns[0]).alias("__h")).distinct()
    return top.join(F.broadcast(h), F.col("top") == F.col("__h"), "left").select("top", "n", "classified", ((F.col("n") * 2 >= F.col("classified")) & F.col("__h").isNull()).alias("elsewhere"))


def read_works(asked: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, in the order asked; ids that are missing). asked: id, pos."""
    return asked.join(works, "id").orderBy("pos"), asked.join(works.select("id"), "id", "left_anti").orderBy("pos")
