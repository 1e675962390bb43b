"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, collocations, decontam, divergence, exact_dedup, hilbert, lang_id, minhash, quality, secrets, suffix_dedup, topk, url_filter
from orrery.llm.common import small_batches
from orrery.llm.common import table as read_table

#: The filter rules of the url query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
BLOCKED_HOSTS = ("spam-farm.example.org",)
SHARDS = 40
TOP_K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Where a public tokenizer's file lies: in the given folder, else where the package of public tokenizers says."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, blocked_hosts=BLOCKED_HOSTS).drop("url")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"), shards=SHARDS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(rows, rows.where("vec_id % 100 = 0"), k=TOP_K)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"], output="digests")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_suffix_dedup, op3_hilbert_shards, op4_decontamination, op5_exact_top_k, op6_secret_scan, op7_near_duplicates, op8_quality, op9_bpe, op10_language_id, op11_source_divergence, op12_collocations, op13_exact_dedup)}

ORACLE_SQL = {
    "op1_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut),
        rules(rhost, rpath, said) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(said, length(rhost || rpath)) AS said
                 FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT p.page_id, host, path, rule,
               CASE WHEN said IS NOT NULL THEN said WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'block' ELSE 'allow' END AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
    """,
    "op2_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS v FROM h, unnest(range(0, greatest(n - 99, 0))) AS u(i)),
        f AS (SELECT v, min((doc_id, i)) AS first FROM w GROUP BY v HAVING count(*) > 1),
        gone AS (SELECT doc_id, i FROM w JOIN f USING (v) WHERE (doc_id, i) <> first),
        marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM gone),
        runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
        spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS t FROM runs GROUP BY doc_id, run),
        cuts AS (SELECT doc_id, s AS until, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans UNION ALL SELECT h.doc_id, n, coalesce(max(t), 0) FROM h LEFT JOIN spans ON spans.doc_id = h.doc_id GROUP BY h.doc_id, n),
        kept AS (SELECT c.doc_id, string_agg(substr(x, 2 * since + 1, 2 * (until - since)), '' ORDER BY since) AS k FROM cuts c JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id),
        sums AS (SELECT doc_id, sum(t - s) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
        SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM h JOIN kept ON kept.doc_id = h.doc_id LEFT JOIN sums ON sums.doc_id = h.doc_id
    """,
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM d), bw AS (SELECT item_id, least(12, len(w)) AS win, CAST(ceil(0.8 * least(12, len(w)) - 1e-9) AS INTEGER) AS need, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS j FROM b WHERE len(w) >= 5),
        m AS (SELECT doc_id, item_id, i - j AS g, j, win, need FROM dw JOIN bw USING (t)),
        c AS (SELECT *, lead(j, need - 1) OVER (PARTITION BY doc_id, item_id, g ORDER BY j) - j < win AS ok FROM m),
        h AS (SELECT DISTINCT doc_id, item_id, g, win, need FROM c WHERE ok),
        s AS (SELECT h.*, u.s FROM h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id, range(greatest(0, -g), least(len(b.w), len(d.w) - g) - win + 1) AS u(s)),
        n AS (SELECT s.doc_id, s.item_id, s.g, s.s, s.win, s.need, count(*) AS n FROM s JOIN m ON m.doc_id = s.doc_id AND m.item_id = s.item_id AND m.g = s.g AND m.j BETWEEN s.s AND s.s + s.win - 1 GROUP BY ALL)
        SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_equal, CAST(win AS INTEGER) AS n_window, CAST(g + s AS INTEGER) AS doc_word, CAST(s AS INTEGER) AS item_word FROM n WHERE n >= need QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, g + s, s) = 1
    """,
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
        SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
    """,
    "op7_near_duplicates": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM t),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.v = y.v AND x.doc_id <> y.doc_id AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r(id, g) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.g)
        SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(r.g) AS component_id, s.doc_id = min(r.g) AS kept FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p, 1 + 1000000000::HUGEINT * (k.ln + 1) // (v.lt + v.v) AS q
              FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
        pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
    """,
    "op12_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        o AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM s, range(1, 6) AS u(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM o GROUP BY lang, phrase HAVING count(*) >= 100),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS x FROM f WHERE m > 1),
        k AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n.n, CAST(1000::HUGEINT * a * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
              FROM c, range(1, 5) AS u(k), f l, f r, n WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang AND l.phrase = array_to_string(x[1 : k], ' ') AND r.phrase = array_to_string(x[k + 1 : ], ' ')),
        inside AS (SELECT DISTINCT c.lang, array_to_string(x[i : i + q - 1], ' ') AS phrase, a FROM c, range(2, 5) AS u(q), range(1, 5) AS v(i) WHERE q < c.m AND i + q - 1 <= c.m),
        gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase WHERE 100 * i.a >= 100 * f.f),
        best AS (SELECT * FROM k ANTI JOIN gone USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
    """,
    "op13_exact_dedup": """
        WITH e AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM e
    """,
}
