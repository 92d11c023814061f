"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import caps, exact, html, licenses, minhash, mix, pack, pii, quality, substrings, tokens, trie, variants
from graphloom.llm.common import materialize, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents")).drop("input_ids")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.cap_groups(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op9_mixing`` SQL can say as well: sizes and targets."""
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(*trie.spliced(turns, trie.lengths_of(turns)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_exact_dedup, op4_minhash, op5_licenses, op6_spherical_caps, op7_quality, op8_main_text, op9_mixing, mixing_targets, op10_personal_data, op11_token_counts, op12_prefix_trie, op13_spelling_variants, pipeline)}


#: Words of each document, and the recursion that gives each linked id the smallest id it reaches.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACHED = "b AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l), r AS (SELECT u AS id, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON r.id = b.u), c AS (SELECT id, min(c) AS c FROM r GROUP BY 1)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a list of bytes: each is taken in with eight steps of the polynomial's bits.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform({bytes}, lambda b: [b::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))), 4294967295::UBIGINT)"
#: The UTF-8 bytes of digits, a colon and letters up to U+00FF.
_BYTES = "flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"

ORACLE_SQL = {
    "op12_prefix_trie": f"""
        WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
        o AS MATERIALIZED (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY p) AS own FROM t GROUP BY 1),
        h AS (SELECT conv_id, own, CAST({_CRC.format(bytes=_BYTES.format(text="CAST(conv_id AS VARCHAR)"))} % 6 AS INTEGER) AS h FROM o),
        s AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
        k AS (SELECT conv_id, len(ts) AS total, unnest(range(len(ts) + 1)) AS depth, ts FROM s),
        g AS MATERIALIZED (SELECT depth, ts[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN total = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM k GROUP BY 1, 2),
        n AS MATERIALIZED (SELECT g.*, p.conv_id AS parent FROM g LEFT JOIN g p ON g.depth > 0 AND p.depth = g.depth - 1 AND p.path = g.path[1:g.depth - 1]),
        c AS (SELECT parent, depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
        w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[n.depth].x) END AS saved FROM n LEFT JOIN c ON c.parent = n.conv_id AND c.depth = n.depth + 1),
        u AS (SELECT conv_id, depth, parent, leaf, saved, conv_id AS top, depth AS top_depth FROM w UNION ALL SELECT w.conv_id, w.depth, w.parent, u.leaf, u.saved, w.conv_id, w.depth FROM u JOIN w ON u.depth > 0 AND w.depth = u.depth - 1 AND w.conv_id = u.parent),
        f AS (SELECT top, top_depth, sum(leaf) AS n_leaves, sum(saved) AS saved FROM u GROUP BY 1, 2)
        SELECT w.conv_id, w.depth, w.parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(f.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM w JOIN f ON f.top = w.conv_id AND f.top_depth = w.depth
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        e AS (SELECT id, run, count(*) AS n FROM d GROUP BY 1, 2),
        h AS (SELECT run, n, {_CRC.format(bytes=_BYTES.format(text="concat(id, ':', run)"))} AS h FROM e),
        s AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
        p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
        q AS MATERIALIZED (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM p),
        l AS (SELECT a.word, b.word AS other, b.n FROM q a JOIN q b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT q.word, w.word, w.n FROM q JOIN w ON q.rest = w.word UNION SELECT w.word, q.word, q.n FROM q JOIN w ON q.rest = w.word),
        b AS (SELECT word, count(*) AS n_near, arg_min(other, {{'m': -n, 'o': encode(other)}}) AS form, max(n) AS form_n FROM l GROUP BY 1),
        f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
        r AS (SELECT word, word AS root, 0 AS i FROM f UNION ALL SELECT r.word, f.form, i + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, arg_max(r.root, r.i) AS root, n, n_near, form_n FROM f JOIN r ON f.word = r.word GROUP BY ALL
    """,
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
        s AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER o AS span, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        f AS (SELECT span, min(doc_id) AS first_doc FROM s WHERE n = 50 GROUP BY 1),
        m AS (SELECT s.doc_id, s.pos, s.word, f.first_doc < s.doc_id AS again FROM s LEFT JOIN f ON s.n = 50 AND s.span = f.span),
        k AS (SELECT doc_id, pos, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
        g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY 1)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
    """,
    "op4_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM d),
        e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS both_ FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
        l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * both_ >= 75 * (nx + ny - both_)), {_REACHED}
        SELECT doc_id, len(sh) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON doc_id = id
    """,
    "op6_spherical_caps": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.n / b.n >= 0.93), {_REACHED},
        n AS (SELECT u, count(*) AS n FROM b GROUP BY 1)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON vec_id = id LEFT JOIN n ON vec_id = u
    """,
    "mixing_targets": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format(text="coalesce(text, '')")}) AS size FROM documents),
        s AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY 1),
        f AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS level UNION ALL
              SELECT i + 1, (SELECT (1.5 * sum(source_size) - sum(CASE WHEN 2 * source_size <= f.level * w THEN 2 * source_size ELSE 0 END)) / sum(CASE WHEN 2 * source_size <= f.level * w THEN 0 ELSE w END) FROM s) FROM f WHERE i < 60)
        SELECT doc_id, size, source_size, round(least(2.0 * source_size, (SELECT level FROM f WHERE level IS NOT NULL ORDER BY i DESC LIMIT 1) * w), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
