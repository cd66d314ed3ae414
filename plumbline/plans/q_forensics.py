"""Queries of duplicates, overlap, leakage and text functions."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.stats import r9
from plumbline.operators import forensics as O
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query

_STOP = "', '".join(X.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains(['{_STOP}'], x))"
_TOK1 = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_SQZ = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


def _grams(name: str, table: str, key: str, n: int, tokens: str = _TOK1) -> str:
    """CTEs ``name``: distinct (key, gram) of word n-grams; a shorter text is one gram."""
    run = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    words = f"SELECT {key}, unnest({tokens}) AS w, generate_subscripts({tokens}, 1) AS i FROM {table}"
    short = f"SELECT {key}, array_to_string({tokens}, ' ') FROM {table} WHERE len({tokens}) BETWEEN 1 AND {n - 1}"
    return f"{name} AS (SELECT DISTINCT {key}, gram FROM (SELECT {key}, {run} AS gram FROM ({words}) WINDOW o AS (PARTITION BY {key} ORDER BY i)) WHERE gram IS NOT NULL UNION {short})"


_OVER = f""", {_grams("ig", "benchmark", "item_id", 5, _TOK)}, {_grams("de", "documents", "doc_id", 5, _TOK)}, ie AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM ig),
o AS (SELECT item_id, doc_id, count(*) / total AS o FROM de JOIN ie USING (gram) GROUP BY item_id, doc_id, total)"""


def _bench(t: Tables):
    return t.raw("benchmark").select("item_id", "text")


def _docs(t: Tables):
    return t.raw("documents").select("doc_id", "text")


@query("tokenize", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens FROM documents", prelude=False)
def _(t: Tables):
    return _docs(t).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("normalize_text", f"SELECT doc_id, md5({_SQZ}) AS digest FROM documents", prelude=False)
def _(t: Tables):
    return _docs(t).select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("digest"))


@query("exact_duplicates", f", k AS (SELECT doc_id, md5({_SQZ}) AS d FROM documents), g AS (SELECT d, min(doc_id) AS first_id, count(*) AS n FROM k GROUP BY 1) SELECT doc_id AS item_id, first_id FROM k JOIN g USING (d) WHERE n > 1 AND doc_id <> first_id")
def _(t: Tables):
    return O.duplicate_ids(t.items.withColumn("key", F.md5(X.squeeze(F.col("text")))).select("item_id", "key"), "key")


def _runs(e: str, whole: str, mark: str) -> str:
    """``e`` with every complete run of word characters that matches ``whole`` replaced."""
    return f"array_to_string(list_transform(regexp_extract_all({e}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: CASE WHEN regexp_full_match(x, '{whole}') THEN '{mark}' ELSE x END), '')"


_TEMPLATE = "trim(regexp_replace(" + _runs("regexp_replace(" + _runs("lower(text)", "[0-9]+", "<num>") + ", '''[^'']+''', '<quoted>', 'g')", "[a-z]{4,}", "<word>") + ", '\\s+', ' ', 'g'))"


@query("template_duplicates", f", k AS (SELECT item_id, {_TEMPLATE} AS cluster_key FROM benchmark) SELECT cluster_key, min(item_id) AS first_id, count(*) AS size FROM k GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return O.key_clusters(_bench(t).withColumn("key", X.template(F.col("text"))), "key")


@query("template_keys", f"SELECT doc_id, md5({_TEMPLATE}) AS digest FROM documents", prelude=False)
def _(t: Tables):
    return _docs(t).select("doc_id", F.md5(X.template(F.col("text"))).alias("digest"))


@query("ngram_overlap", _OVER + " SELECT item_id, doc_id, round(o, 9) AS overlap FROM o")
def _(t: Tables):
    return O.ngram_overlap(_bench(t), _docs(t)).withColumn("overlap", r9("overlap"))


@query("corpus_overlap", _OVER + f""", b AS (SELECT item_id, doc_id, o FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, doc_id) AS k FROM o) WHERE k = 1),
sq AS (SELECT doc_id, {_SQZ} AS t FROM documents), w AS (SELECT DISTINCT item_id FROM (SELECT item_id, {_SQZ} AS t FROM benchmark) x JOIN sq ON x.t <> '' AND contains(sq.t, x.t))
SELECT item_id, w.item_id IS NOT NULL AS contained, round(coalesce(o, 0), 9) AS overlap, doc_id, CASE WHEN w.item_id IS NOT NULL THEN 1.0 ELSE round(coalesce(o, 0), 9) END AS suspicion, w.item_id IS NOT NULL OR coalesce(o, 0) >= 0.5 AS suspicious FROM benchmark LEFT JOIN b USING (item_id) LEFT JOIN w USING (item_id)""")
def _(t: Tables):
    return O.corpus_overlap(_bench(t), _docs(t)).withColumns({c: r9(c) for c in ("overlap", "suspicion")})


@query("corpus_contains", "SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1", prelude=False)
def _(t: Tables):
    return O.containing(_bench(t), _docs(t)).groupBy("item_id").agg(F.count("*").alias("documents"))


_SETS = f", s AS (SELECT doc_id AS id, list_distinct({_TOK}) AS t FROM documents), e AS (SELECT id, len(t) AS n, unnest(t) AS tok FROM s)"
_JAC = _SETS + ", p AS (SELECT x.id AS a, y.id AS b, count(*) / (x.n + y.n - count(*)) AS j FROM e x JOIN e y ON x.tok = y.tok AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n)"


@query("near_duplicate_pairs", _JAC + " SELECT a, b, round(j, 9) AS jaccard FROM p WHERE j >= 0.82 - 1e-12")
def _(t: Tables):
    return O.similar_pairs(t.items.select("item_id", X.tokens(F.col("text")).alias("tokens")), "tokens", 0.82).withColumn("jaccard", r9("jaccard"))


@query("near_duplicate_clusters", "WITH RECURSIVE " + (_JAC[2:]) + """, ed AS (SELECT a, b FROM p WHERE j >= 0.82 - 1e-12 UNION ALL SELECT b, a FROM p WHERE j >= 0.82 - 1e-12),
r(id, root) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.root FROM r JOIN ed ON ed.a = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY 1""", prelude=False)
def _(t: Tables):
    return O.similar_clusters(t.items.select("item_id", X.tokens(F.col("text")).alias("tokens")), "tokens", 0.82)


@query("semantic_duplicate_pairs", f""", e AS (SELECT doc_id AS id, unnest({_TOK}) AS tok FROM documents), tf AS (SELECT id, tok, count(*) AS c FROM e GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT id, tok, c / sum(c) OVER (PARTITION BY id) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok)), u AS (SELECT id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 7) AS cosine FROM u x JOIN u y ON x.tok = y.tok AND x.id < y.id GROUP BY ALL HAVING sum(x.w * y.w) >= 0.85 - 1e-9""")
def _(t: Tables):
    return O.tfidf_pairs(t.items.select("item_id", X.tokens(F.col("text")).alias("tokens")), "tokens", 0.85).withColumn("cosine", F.round("cosine", 7))


@query("shingle_overlap", f""", {_grams("lg", "benchmark", "item_id", 3)}, le AS (SELECT item_id, count(*) OVER (PARTITION BY item_id) AS n, gram AS s FROM lg), q AS (SELECT x.item_id AS left_id, y.item_id AS right_id, count(*) / (x.n + y.n - count(*)) AS j FROM le x JOIN le y USING (s) GROUP BY x.item_id, y.item_id, x.n, y.n)
SELECT left_id, right_id, round(j, 9) AS jaccard FROM q WHERE j >= 0.8""")
def _(t: Tables):
    return O.shingle_candidates(_bench(t), _bench(t)).withColumn("jaccard", r9("jaccard"))


@query("minhash_similarity", f""", s AS (SELECT item_id, {_TOK} AS t FROM benchmark), m AS (SELECT item_id, unnest(range(0, 16)) AS k, t FROM s), mv AS (SELECT item_id, k, coalesce(list_min(list_transform(t, lambda x: substr(sha256(CAST(k AS VARCHAR) || '|' || x), 1, 16))), '0000000000000000') AS v FROM m)
SELECT a.item_id AS a, b.item_id AS b, count(*) / 16.0 AS similarity FROM mv a JOIN mv b ON a.k = b.k AND a.v = b.v AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id""")
def _(t: Tables):
    return O.minhash_pairs(_bench(t).select("item_id", X.minhash(X.tokens(F.col("text")), 16).alias("h")), "h")


@query("split_leakage", f""", k AS (SELECT doc_id, source AS split, md5({_SQZ}) AS x, lang || CAST(n_chars % 50 AS VARCHAR) AS y FROM documents), c AS (SELECT 'exact' AS kind, x AS key, split, count(*) AS c FROM k GROUP BY ALL UNION ALL SELECT 'source', y, split, count(*) FROM k GROUP BY ALL)
SELECT a.kind, a.split AS split_a, b.split AS split_b, CAST(sum(a.c * b.c) AS BIGINT) AS pairs FROM c a JOIN c b ON a.kind = b.kind AND a.key = b.key AND a.split < b.split GROUP BY ALL""")
def _(t: Tables):
    rows = t.raw("documents").select("doc_id", F.col("source").alias("split"), F.md5(X.squeeze(F.col("text"))).alias("x"), F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("y"))
    return O.split_leakage(rows, {"exact": "x", "source": "y"})


@query("temporal_validity", """, e AS (SELECT event_id AS item_id, regexp_matches(event_type || CASE WHEN user_id % 3 = 0 THEN ' latest' ELSE '' END, '\\b(today|current|currently|latest|recent|now|this year|last year|as of)\\b', 'i') AS relative_time,
coalesce(CASE WHEN user_id % 5 > 0 THEN CAST(ts AS DATE) > DATE '2024-01-15' END, false) AS after_cutoff, user_id % 2 = 0 AND user_id % 7 = 0 AS stale_label, CASE WHEN user_id % 2 = 0 THEN 1 + CAST(user_id % 7 = 0 AS INT) + CAST(user_id % 5 = 0 AS INT) ELSE 0 END AS missing_fields FROM events)
SELECT *, relative_time OR after_cutoff OR stale_label OR missing_fields > 0 AS risk FROM e""")
def _(t: Tables):
    u = F.col("user_id")
    e = t.raw("events").select(
        F.col("event_id").alias("item_id"), F.concat("event_type", F.when(u % 3 == 0, " latest").otherwise("")).alias("text"), F.when(u % 5 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("source_date"), F.lit("2024-01-15").alias("cutoff"),
        (u % 2 == 0).alias("time_sensitive"), F.lit(None).cast("string").alias("answer_validity_date"), F.when(u % 7 > 0, "2024-01-01").alias("last_verified_date"), F.when(u % 5 > 0, "year").alias("temporal_scope"),
    )
    return O.temporal(e)


@query("provenance", "SELECT count(*) AS items, count(*) FILTER (a AND b) AS complete, round(count(*) FILTER (a AND b) / count(*), 9) AS complete_fraction, count(*) FILTER (NOT a) AS missing_url, count(*) FILTER (NOT b) AS missing_license FROM (SELECT page_id % 3 > 0 AS a, page_id % 7 > 0 AS b FROM pages)", prelude=False)
def _(t: Tables):
    p = t.raw("pages").select(F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 7 > 0, "cc").otherwise(" ").alias("license"))
    return O.provenance(p, ["url", "license"]).withColumn("complete_fraction", r9("complete_fraction"))


@query("dataset_digest", "SELECT count(*) AS items, md5(concat_ws('|', " + ", ".join(f"CAST(CAST(sum(CAST(('0x' || substr(h, {1 + 8 * k}, 8)) AS BIGINT)) AS HUGEINT) AS VARCHAR)" for k in range(4)) + ")) AS digest FROM (SELECT sha256(CAST(item_id AS VARCHAR) || chr(31) || text) AS h FROM benchmark)", prelude=False)
def _(t: Tables):
    return O.dataset_digest(_bench(t), "item_id", "text")


@query("longest_common_substring")
def _(t: Tables):
    cand = O.ngram_overlap(_bench(t), _docs(t)).select("item_id", "doc_id")  # all pairs that share an n-gram
    both = cand.join(_docs(t), "doc_id").join(F.broadcast(_bench(t).withColumnRenamed("text", "needle")), "item_id")
    return O.lcs_ratio(both, "needle", "text").select("item_id", "doc_id", r9("lcs").alias("lcs"))


@query("leak_text_digest")
def _(t: Tables):
    return t.raw("pages").select("page_id", F.md5(O.normalize_leak_text(F.col("html"))).alias("digest"))


@query("entities", "SELECT item_id, array_to_string(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: regexp_matches(x, '^\\p{Lu}')), ' ') AS entities FROM benchmark", prelude=False)
def _(t: Tables):
    return _bench(t).select("item_id", F.array_join(X.entities(F.col("text")), " ").alias("entities"))


@query("redundancy", f""", k AS (SELECT doc_id, md5({_SQZ}) AS x FROM documents) SELECT count(*) AS items, count(DISTINCT x) AS effective, round(1 - count(DISTINCT x) / count(*), 9) AS redundancy FROM k""")
def _(t: Tables):
    return t.items.select(F.md5(X.squeeze(F.col("text"))).alias("x")).agg(F.count("*").alias("items"), F.count_distinct("x").alias("effective"), F.round(1 - F.count_distinct("x") / F.count("*"), 9).alias("redundancy"))
