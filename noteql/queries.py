"""The engine's operators applied to the synthetic tables, with the same in SQL.

``documents`` stand for notes, ``pages`` for a link graph, ``events`` for metric logs, ``embeddings`` for vectors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime

from noteql import scratch
from noteql.functions import extract, text
from noteql.operators import clusters, context, fts, links, metrics, notes, vectors
from noteql.plans import query as note_query
from noteql.sources import files
from noteql.streaming import changes, incremental
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 20, 12, tzinfo=UTC)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600)
    return d.select(
        F.col("doc_id").cast("string").alias("note_id"),
        F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("text").alias("raw"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("relative_path"),
        at.alias("file_modified_at"),
        F.when(F.col("doc_id") % 10 != 0, at).alias("created_at"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


def kept(spark: SparkSession, path: str, name: str, tables: Callable[[Callable], dict[str, DataFrame]]) -> incremental.Catalog:
    """An index in the shared folder, named by the state of the files it is of and what makes it: it is built for the
    first question and read by all others. Indexes of the same name of files that are no more go."""
    folder, top = scratch.shared_folder(spark), f"noteql-index-{name}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"
    state = f"{incremental.file_states(spark, path)}-{incremental.SCHEMA_VERSION}"
    catalog = incremental.Catalog(spark, f"{folder}/{top}/{state}", parts=max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    if catalog.version == 0:
        try:
            catalog.commit(tables(catalog.part), based_on=0)
        except incremental.Conflict:  # built by somebody else meanwhile
            pass
        catalog.remove_others(f"{folder}/{top}")
    return catalog


def indexed(spark: SparkSession, sf_dir: str) -> fts.Kept:
    """The search index of the documents."""

    def made(part):
        postings, lengths = map(scratch.stored, fts.build(note_table(spark, sf_dir), F.col("content"), _metadata_words()))
        terms, corpus = fts.summaries(postings, lengths, part("note_id"))
        return {"postings": postings, "lengths": lengths, "terms": terms, "corpus": corpus}

    return incremental.kept_index(kept(spark, f"{sf_dir}/documents.parquet", "notes", made), stem=False)


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes without an index."""
    return fts.index_text(note_table(spark, sf_dir), F.col("content"), _metadata_words())


def _metadata_words():
    return F.concat(F.lit("lang:"), F.col("metadata.lang"), F.lit(" "), F.col("metadata.lang"), F.lit("\nsource:"), F.col("metadata.source"), F.lit(" "), F.col("metadata.source"))


#: The index in SQL: note_id, c and m (term strings), dl, modified.
IDX = r"""idx AS (SELECT note_id, coalesce(array_to_string(list_transform(ct, lambda x: ' ' || x || ' '), ''), '') AS c,
 coalesce(array_to_string(list_transform(mt, lambda x: ' ' || x || ' '), ''), '') AS m, len(ct) + len(mt) AS dl, modified, doc_id FROM (
 SELECT CAST(doc_id AS VARCHAR) AS note_id, doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ct,
 regexp_extract_all(lower('lang:' || lang || ' ' || lang || ' source:' || source || ' ' || source), '[\p{L}\p{N}]+') AS mt,
 to_timestamp(1704067200 + doc_id * 600) AS modified FROM documents))"""


def _tf(words: str, cols: str = "cm") -> str:
    p = "".join(f" {w} " for w in words.split())
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, '{p}', ''))) / {len(p)}" for c in cols) + ")"


def _bm25(terms: list[tuple[str, str]], where: str, limit: int, extra: str = "") -> str:
    tfs = ", ".join(f"CAST({_tf(w, c)} AS DOUBLE) AS t{k}" for k, (w, c) in enumerate(terms))
    stats = ", ".join(f"CAST(sum(CASE WHEN t{k} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END"
    total = " + ".join(f"({idf(k)}) * t{k} * 2.2 / (t{k} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    return f"""WITH {IDX}, tf AS (SELECT *, {tfs} FROM idx), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {stats} FROM tf),
 r AS (SELECT note_id, -({total}) AS rank FROM tf, st WHERE ({where}) {extra})
 SELECT note_id, round(rank, 6) AS rank, round(1 - exp(-greatest(-rank, 0)), 6) AS score FROM r ORDER BY r.rank, note_id LIMIT {limit}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("note_id", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


@register("fts_bm25_topk", _bm25([("reatti", "cm"), ("hand", "cm")], "t0 > 0 OR t1 > 0", 20))
def fts_bm25_topk(spark, d):
    return _ranked(fts.search(indexed(spark, d), "reatti OR hand", 20, NOW))


@register("fts_boolean", _bm25([("the", "cm"), ("hand", "cm"), ("reatti", "cm")], "t0 > 0 AND (t1 > 0 OR t2 > 0)", 20))
def fts_boolean(spark, d):
    return _ranked(fts.search(indexed(spark, d), "the AND (hand OR reatti)", 20, NOW))


@register("fts_scan", _bm25([("reatti", "cm"), ("hand", "cm")], "t0 > 0 OR t1 > 0", 20))
def fts_scan(spark, d):
    return _ranked(fts.search(scanned(spark, d), "reatti OR hand", 20, NOW))


@register("fts_phrase", _bm25([("of the", "cm")], "t0 > 0", 25))
def fts_phrase(spark, d):
    return _ranked(fts.search(indexed(spark, d), '"of the"', 25, NOW))


@register("fts_field_scope", _bm25([("the", "c"), ("source src3", "m")], "t0 > 0 AND t1 > 0", 15))
def fts_field_scope(spark, d):
    return _ranked(fts.search(indexed(spark, d), "content:the source:src3", 15, NOW))


@register("fts_not_before_limit", _bm25([("the", "cm")], "t0 > 0", 10, f"AND NOT ({_tf('of')} > 0)"))
def fts_not_before_limit(spark, d):
    return _ranked(fts.search(indexed(spark, d), "the NOT of", 10, NOW))


@register("fts_dated", _bm25([("the", "cm")], "t0 > 0", 10, "AND modified >= TIMESTAMPTZ '2024-01-02 00:00:00+00' AND modified < TIMESTAMPTZ '2024-01-03 00:00:00+00'"))
def fts_dated(spark, d):
    return _ranked(fts.search(indexed(spark, d), "the modified:2024-01-02", 10, NOW))


@register("fts_two_ranges", _bm25([("the", "cm")], "t0 > 0", 10, "AND modified >= TIMESTAMPTZ '2024-01-02 00:00:00+00' AND modified <= TIMESTAMPTZ '2024-01-03 00:00:00+00'"))
def fts_two_ranges(spark, d):
    """Ranges of one field are cut with each other; a day as an end is its midnight."""
    return _ranked(fts.search(indexed(spark, d), "the modified:>=2024-01-02 modified:<=2024-01-03", 10, NOW))


@register("fts_all_ids", f"WITH {IDX} SELECT note_id FROM idx WHERE {_tf('und')} > 0 AND {_tf('der')} > 0")
def fts_all_ids(spark, d):
    return fts.matching_ids(indexed(spark, d), "und der", NOW)


@register("filter_only_recent", f"WITH {IDX} SELECT note_id, 0.0::DOUBLE AS score, 'Filter match' AS reason FROM idx WHERE modified >= TIMESTAMPTZ '2024-01-03 00:00:00+00' AND NOT ({_tf('und')} > 0) ORDER BY modified DESC, note_id LIMIT 12")
def filter_only_recent(spark, d):
    return fts.search(indexed(spark, d), "modified:>=2024-01-03 NOT und", 12, NOW).select("note_id", "score", "reason")


@register("filter_metadata_date_exists", "SELECT CAST(o_orderkey AS VARCHAR) AS note_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-04-01')")
def filter_metadata_date_exists(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"))
    dates = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("note_id"), F.lit("date").alias("key"), F.col("l_shipdate").cast("timestamp").alias("value"))
    return fts.date_filtered(o, note_query.parse("date:1995-03", NOW).filters, dates)


@register("token_frequencies", r"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS notes FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term")
def token_frequencies(spark, d):
    p = fts.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    # Once for each note first: a frequent word then sends one row a note.
    once = p.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return once.groupBy("term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("notes"))


@register("fts_porter")
def fts_porter(spark, d):
    n = note_table(spark, d)
    return fts.search(fts.index_text(n, F.col("content"), F.lit(""), stem=True), "nations OR handing", 10, NOW, stem=True)


@register("fts_snippet")
def fts_snippet(spark, d):
    return fts.enrich(fts.search(indexed(spark, d), "hand", 5, NOW), note_table(spark, d), "hand")


def vector_table(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("note_id"), F.col("embedding").alias("vector"), F.lit("m").alias("model"), F.lit(datetime(2024, 1, 1, tzinfo=UTC)).alias("indexed_at"))


_SIM = "greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0)"


@register("knn_cosine_topk", f"SELECT CAST(e.vec_id AS VARCHAR) AS note_id, round({_SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY {_SIM} DESC, note_id LIMIT 10")
def knn_cosine_topk(spark, d):
    v = vector_table(spark, d)
    return vectors.knn(v, vectors.vector_of(v, "1"), 10).withColumn("similarity", F.round("similarity", 6))


@register("related_to_anchor", f"SELECT note_id, round(s, 6) AS similarity FROM (SELECT CAST(e.vec_id AS VARCHAR) AS note_id, {_SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q ORDER BY s DESC, note_id LIMIT 20) WHERE s >= 0.1 AND note_id <> '2' ORDER BY s DESC, note_id LIMIT 10")
def related_to_anchor(spark, d):
    return vectors.related(vector_table(spark, d), "2", 10, threshold=0.1).withColumn("similarity", F.round("similarity", 6))


def clustered(spark, d) -> clusters.Clustered:
    """The vectors kept by cluster."""

    def made(_):
        v = vector_table(spark, d).select("note_id", "vector", "model")
        centres = clusters.fit(v)
        near = scratch.stored(clusters.placed(v, centres))
        return {"near": near, "clusters": clusters.described(clusters.summary(near), centres).withColumn("model", F.lit("m")).withColumn("part", F.lit(0))}

    return incremental.kept_vectors(kept(spark, f"{d}/embeddings.parquet", "vectors", made), "m")


@register("knn_clustered", f"SELECT CAST(e.vec_id AS VARCHAR) AS note_id, round({_SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_SIM} DESC, note_id LIMIT 25")
def knn_clustered(spark, d):
    return vectors.knn(clustered(spark, d), vectors.vector_of(vector_table(spark, d), "7"), 25).withColumn("similarity", F.round("similarity", 6))


@register("related_clustered", f"SELECT note_id, round(s, 6) AS similarity FROM (SELECT CAST(e.vec_id AS VARCHAR) AS note_id, {_SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q ORDER BY s DESC, note_id LIMIT 30) WHERE s >= 0.3 AND note_id <> '11' ORDER BY s DESC, note_id LIMIT 15")
def related_clustered(spark, d):
    return vectors.related(clustered(spark, d), "11", 15, of=vector_table(spark, d)).withColumn("similarity", F.round("similarity", 6))


@register("semantic_post_filter", f"WITH {IDX}, near AS (SELECT CAST(e.vec_id AS VARCHAR) AS note_id, {_SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY s DESC, note_id LIMIT 40) SELECT near.note_id, round(s, 6) AS similarity FROM near JOIN idx USING (note_id) WHERE NOT ({_tf('und')} > 0) ORDER BY s DESC, note_id LIMIT 20")
def semantic_post_filter(spark, d):
    v = vector_table(spark, d)
    q = note_query.parse("the NOT und", NOW)
    return vectors.semantic_search(indexed(spark, d), v, vectors.vector_of(v, "3"), 20, q.filters, q.excludes).withColumn("similarity", F.round("similarity", 6))


@register("vector_normalise", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)")
def vector_normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("square"), F.round(F.col("v")[0], 6).alias("first"))


@register("hybrid_fusion", f"""WITH tx AS ({_bm25([("hand", "cm")], "t0 > 0", 30).replace("round(rank, 6) AS rank, round(1 - exp(-greatest(-rank, 0)), 6) AS score", "1 - exp(-greatest(-rank, 0)) AS f")}),
 ve AS (SELECT CAST(e.vec_id AS VARCHAR) AS note_id, {_SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY s DESC, note_id LIMIT 30),
 b AS (SELECT coalesce(tx.note_id, ve.note_id) AS note_id, f, s, 0.7 * coalesce(f, 0) + 0.5 * coalesce(s, 0) AS score FROM tx FULL JOIN ve ON tx.note_id = ve.note_id)
 SELECT note_id, round(score, 6) AS score FROM b WHERE NOT (b.score < 0.3 AND (coalesce(s, 0) > 0 OR f IS NULL)) ORDER BY b.score DESC, note_id LIMIT 10""")
def hybrid_fusion(spark, d):
    v = vector_table(spark, d)
    hits = fts.search(indexed(spark, d), "hand", 30, NOW)
    return vectors.fuse(hits, vectors.knn(v, vectors.vector_of(v, "1"), 30), 10).select("note_id", F.round("score", 6).alias("score"))


@register("vector_staleness", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR doc_id % 7 = 0")
def vector_staleness(spark, d):
    t = F.lit(datetime(2024, 1, 1, tzinfo=UTC))
    n = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.when(F.col("doc_id") % 7 == 0, t + F.expr("INTERVAL 1 HOUR")).otherwise(t).alias("indexed_at"))
    return vectors.stale(n, vector_table(spark, d), "m")


@register("vector_gc", "SELECT CAST(vec_id AS VARCHAR) AS note_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def vector_gc(spark, d):
    return vectors.collect_garbage(vector_table(spark, d), note_table(spark, d)).select("note_id")


def page_notes(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("note_id"), F.concat(F.lit("T"), (F.col("page_id") % 40).cast("string")).alias("title"), F.array(F.concat(F.lit("A"), (F.col("page_id") % 90).cast("string"))).alias("aliases"), "page_id")


def page_links(spark, d) -> DataFrame:
    """Three links from every page: to a page by other letters, to a title, and to an alias."""
    p = table(spark, d, "pages").select("page_id")
    i = F.col("page_id")
    kinds = F.array(F.concat(F.lit("page "), (i * 7 % 400).cast("string"), F.lit(".md")), F.concat(F.lit("t"), (i % 50).cast("string")), F.concat(F.lit("A"), (i % 110).cast("string")))
    return p.select(F.concat(F.lit("Page "), i.cast("string")).alias("source_id"), F.explode(kinds).alias("raw")).withColumn("target", F.col("raw"))


EDGES = """pn AS (SELECT 'Page ' || page_id AS note_id, 't' || page_id % 40 AS tk, 'a' || page_id % 90 AS ak FROM pages),
 pl AS (SELECT 'Page ' || page_id AS source_id, unnest(['page ' || (page_id * 7 % 400) || '.md', 't' || page_id % 50, 'A' || page_id % 110]) AS raw FROM pages),
 ids AS (SELECT lower(note_id) AS k, min(note_id) AS id FROM pn GROUP BY 1), ti AS (SELECT tk AS k, min(note_id) AS id FROM pn GROUP BY 1),
 al AS (SELECT ak AS k, min(note_id) AS id FROM pn GROUP BY 1 HAVING count(DISTINCT note_id) = 1),
 edges AS (SELECT source_id, raw, coalesce(e.note_id, ids.id, ti.id, al.id) AS target_id, CASE WHEN coalesce(e.note_id, ids.id) IS NOT NULL THEN 'direct' WHEN ti.id IS NOT NULL THEN 'title' WHEN al.id IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS reason
 FROM pl LEFT JOIN pn e ON e.note_id = regexp_replace(raw, '\\.md$', '') LEFT JOIN ids ON ids.k = lower(regexp_replace(raw, '\\.md$', '')) LEFT JOIN ti ON ti.k = lower(raw) LEFT JOIN al ON al.k = lower(raw))""".replace("\\\\", "\\")


def page_edges(spark, d) -> DataFrame:
    return links.resolve(page_links(spark, d), page_notes(spark, d)).select("source_id", "raw", "target_id", "reason")


@register("link_resolve_cascade", f"WITH {EDGES} SELECT source_id, raw, target_id, reason FROM edges")
def link_resolve_cascade(spark, d):
    return page_edges(spark, d)


@register("link_reason_counts", f"WITH {EDGES} SELECT reason, count(*) AS n FROM edges GROUP BY reason")
def link_reason_counts(spark, d):
    return page_edges(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("backlinks", f"WITH {EDGES} SELECT source_id, raw, reason FROM edges WHERE target_id = 'Page 1'")
def backlinks(spark, d):
    return links.backlinks(page_edges(spark, d), "Page 1").select("source_id", "raw", "reason")


@register("forward_links", f"WITH {EDGES} SELECT raw, target_id, reason FROM edges WHERE source_id = 'Page 1'")
def forward_links(spark, d):
    return links.forward_links(page_edges(spark, d), "Page 1").select("raw", "target_id", "reason")


@register("orphans", f"WITH {EDGES} SELECT note_id FROM pn WHERE note_id NOT IN (SELECT source_id FROM edges WHERE target_id IS NOT NULL) AND note_id NOT IN (SELECT target_id FROM edges WHERE target_id IS NOT NULL)")
def orphans(spark, d):
    return links.orphans(page_notes(spark, d), page_edges(spark, d))


@register("unresolved", f"WITH {EDGES} SELECT source_id, raw FROM edges WHERE target_id IS NULL")
def unresolved(spark, d):
    return links.unresolved(page_edges(spark, d)).select("source_id", "raw")


@register("neighbour_rank", f"WITH {EDGES}, b AS (SELECT target_id AS note_id, 'Outbound link via [[' || raw || ']]' AS why FROM edges WHERE source_id = 'Page 1' AND target_id IS NOT NULL UNION ALL SELECT source_id, 'Backlink from ' || source_id FROM edges WHERE target_id = 'Page 1') SELECT note_id, count(DISTINCT why) AS reasons_n, array_to_string(list_sort(list_distinct(list(why))), '; ') AS reasons FROM b WHERE note_id <> 'Page 1' GROUP BY note_id")
def neighbour_rank(spark, d):
    return links.neighbours(page_edges(spark, d), "Page 1")


@register("link_extract", r"""SELECT doc_id, raw, trim(regexp_extract(raw, '^([^|#]*)', 1)) AS target, CASE WHEN raw LIKE '%|%' THEN trim(regexp_extract(raw, '\|(.*)$', 1)) END AS display, CASE WHEN regexp_extract(raw, '^([^|]*)', 1) LIKE '%#%' THEN trim(regexp_extract(raw, '#([^|]*)', 1)) END AS heading
 FROM (SELECT doc_id, unnest(['Note ' || doc_id % 50 || '|shown', source || '#part', lang]) AS raw FROM documents)""")
def link_extract(spark, d):
    i = F.col("doc_id")
    made = F.concat(F.lit("a [[Note "), (i % 50).cast("string"), F.lit("|shown]] b ![[no.png]] [["), F.col("source"), F.lit("#part]] [["), F.col("lang"), F.lit("]] [["), F.col("lang"), F.lit("]] [[ ]]"))
    n = table(spark, d, "documents").select("doc_id", F.explode(extract.wikilinks(made)).alias("raw"))
    return n.withColumn("l", extract.parse_link(F.col("raw"))).select("doc_id", "raw", "l.target", "l.display", "l.heading")


@register("tag_union", "SELECT doc_id, array_to_string(list_sort(list_distinct([lang, 'topic', source, 'x-y_' || doc_id % 5])), ',') AS tags FROM documents")
def tag_union(spark, d):
    made = F.concat(F.lit("#"), F.col("lang"), F.lit(" a#no !#no #topic/sub [#no] #x-y_"), (F.col("doc_id") % 5).cast("string"), F.lit("."))
    return table(spark, d, "documents").select("doc_id", F.array_join(extract.tag_union(made, F.array(F.concat(F.col("source"), F.lit(", topic")))), ",").alias("tags"))


@register("content_fingerprint", "SELECT doc_id, sha256(encode(source || '/' || doc_id) || '\\x00'::BLOB || encode('lang') || '\\x00'::BLOB || encode(lang) || '\\xFF'::BLOB || encode(text)) AS fingerprint FROM documents")
def content_fingerprint(spark, d):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", extract.content_fingerprint(path, F.create_map(F.lit("lang"), "lang"), F.col("text")).alias("fingerprint"))


@register("excerpts", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 240 THEN left(text, 240) || '...' ELSE text END AS excerpt FROM documents")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.excerpt(F.col("text")).alias("excerpt"))


@register("word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+')) AS INT) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.word_count(F.col("text")).alias("words"))


@register("literal_phrase", r"SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ', ' of the ')")
def literal_phrase(spark, d):
    return table(spark, d, "documents").where(text.has_phrase(F.col("text"), F.lit("of, the"))).select("doc_id")


@register("vault_stats", "SELECT count(*) AS total_notes, CAST(sum(w) AS BIGINT) AS total_words, round(sum(w) / count(*), 6) AS average_words FROM (SELECT len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+')) AS w FROM documents)")
def vault_stats(spark, d):
    return notes.stats(note_table(spark, d)).withColumn("average_words", F.round("average_words", 6))


@register("recent_notes", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents ORDER BY doc_id DESC LIMIT 7")
def recent_notes(spark, d):
    return notes.recent(note_table(spark, d), 7).select("note_id")


_LEAF = "CASE doc_id % 6 WHEN 0 THEN '2024-01-' || (10 + doc_id % 20) WHEN 1 THEN 'a-' || doc_id WHEN 2 THEN 'a_' || doc_id WHEN 3 THEN 'AbcDef' WHEN 4 THEN CAST(doc_id AS VARCHAR) ELSE 'Ab ' || doc_id END"
_CLASS = "CASE doc_id % 6 WHEN 0 THEN 'ISO date (YYYY-MM-DD)' WHEN 1 THEN 'kebab-case' WHEN 2 THEN 'snake_case' WHEN 3 THEN 'PascalCase' WHEN 4 THEN 'Numeric identifiers' ELSE 'Mixed' END"


@register("naming_histogram", f"SELECT p AS pattern, count(*) AS count, array_to_string(list_sort(list(leaf))[1:3], ',') AS examples FROM (SELECT {_LEAF} AS leaf, {_CLASS} AS p FROM documents) GROUP BY p")
def naming_histogram(spark, d):
    out = notes.naming_histogram(table(spark, d, "documents"), F.expr(_LEAF.replace("VARCHAR", "STRING")))
    return out.withColumn("examples", F.array_join("examples", ","))


@register("metadata_profile", """WITH e AS (SELECT doc_id, 'lang' AS key, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
 c AS (SELECT key, v, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, v) AS rank FROM c)
 SELECT key AS field, (SELECT count(DISTINCT doc_id) FROM e WHERE e.key = r.key) AS note_count, '"' || v || '"' AS value, n AS value_count, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def metadata_profile(spark, d):
    eav = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "v"))
    return notes.metadata_profile(eav.select("note_id", "key", F.concat(F.lit('"'), "v", F.lit('"')).alias("value_json")))


@register("note_list", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents WHERE lang = 'de' ORDER BY note_id LIMIT 20")
def note_list(spark, d):
    n = note_table(spark, d).withColumn("metadata", F.create_map(F.lit("category"), F.col("metadata.lang")))
    return notes.list_notes(n, category=" DE ", limit=20).select("note_id")


def event_records(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    null = F.lit(None).cast("string")
    return e.select(
        F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("source_file"), F.col("event_id").cast("int").alias("source_line"), F.col("props").alias("raw_line"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), ts.alias("ts"), F.col("ts").cast("timestamp").alias("ts_utc"), F.concat(F.lit("web."), F.col("event_type")).alias("key"), "value",
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("source"), F.when(F.col("event_id") % 4 != 0, F.to_date("ts")).alias("date"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.lit("kg")).alias("unit"), null.alias("note"), F.col("props").alias("context_json"), null.alias("tags_json"), null.alias("extra_fields_json"),
    )


RECS = """recs AS (SELECT 'f' || event_id % 3 AS source_file, event_id, 'e' || event_id AS id, ts, 'web.' || event_type AS key, value, 'u' || user_id % 7 AS source,
 CAST(ts AS DATE) AS bucket, CASE WHEN event_id % 4 <> 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE ts END AS t_at, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'kg' ELSE '~' END AS unit, props, event_id % 4 <> 0 AS dated FROM events)"""


@register("metrics_search", f"WITH {RECS} SELECT id, key, source FROM recs WHERE key = 'web.click' AND source = 'u3' AND t_at >= TIMESTAMP '2024-01-05' AND t_at <= TIMESTAMP '2024-01-12' ORDER BY t_at DESC, source_file, event_id LIMIT 50")
def metrics_search(spark, d):
    return metrics.search(event_records(spark, d), "key:WEB.click source:u3 date:2024-01-05..2024-01-12", 50, NOW).select("id", "key", "source")


def kept_records(spark, d) -> DataFrame:
    """The records of the events, kept by key and day."""
    catalog = kept(spark, f"{d}/events.parquet", "records", lambda _: {"metric_rows": metrics.clustered(event_records(spark, d))})
    return catalog.table("metric_rows")


@register("metrics_search_kept", f"WITH {RECS} SELECT id, key, source FROM recs WHERE key = 'web.click' AND source = 'u3' AND t_at >= TIMESTAMP '2024-01-05' AND t_at <= TIMESTAMP '2024-01-12' ORDER BY t_at DESC, source_file, event_id LIMIT 50")
def metrics_search_kept(spark, d):
    return metrics.search(kept_records(spark, d), "key:WEB.click source:u3 date:2024-01-05..2024-01-12", 50, NOW).select("id", "key", "source")


#: Events in a log of their own for so many of them, by id.
EVENTS_A_LOG = 40_000


@register("log_lines", f"SELECT event_id // {EVENTS_A_LOG} AS log, event_id, row_number() OVER (PARTITION BY event_id // {EVENTS_A_LOG} ORDER BY event_id) * 2 - 1 AS source_line FROM events")
def log_lines(spark, d):
    """Logs of the events, every line followed by a blank one, written as files and read again in ranges."""
    log = F.floor(F.col("event_id") / EVENTS_A_LOG)
    text = F.concat(F.to_json(F.struct("event_id", "event_type", "props")), F.lit("\r\n  "))
    rows = table(spark, d, "events").select(log.alias("log"), "event_id", text.alias("value"))
    folder = f"{scratch.shared_folder(spark)}/{scratch.RUN}-{uuid.uuid4().hex}"
    rows.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(folder)
    ranges = files.log_ranges(files.listing(spark, folder, files.Rules(".txt")), folder, 256 << 10)
    read = files.read_ranges(ranges, folder)
    return read.select(F.regexp_extract("source_file", r"log=(\d+)/", 1).cast("long").alias("log"), F.get_json_object("raw_line", "$.event_id").cast("long").alias("event_id"), F.col("source_line").cast("long").alias("source_line"))


@register("metrics_named_day", f"WITH {RECS} SELECT id, key FROM recs WHERE t_at >= TIMESTAMP '2024-01-19' AND t_at < TIMESTAMP '2024-01-20'")
def metrics_named_day(spark, d):
    return metrics.search(event_records(spark, d), "date:yesterday", None, NOW).select("id", "key")


@register("metrics_optional_fields", """SELECT 'm' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 2 = 0 THEN '["' || event_type || '","zz"]' END AS tags_json,
 CASE WHEN event_id % 5 <> 0 THEN props END AS context, 'o' || event_id AS origin_id, CASE WHEN event_id % 4 = 0 THEN 'seen by ' || user_id END AS note FROM events""")
def metrics_optional_fields(spark, d):
    """Records of lines with a day, tags in any order and more than once, a context, an origin and a note."""
    i = F.col("event_id")
    lines = table(spark, d, "events").select(
        F.lit("f").alias("source_file"), i.cast("int").alias("source_line"), F.col("props"),
        F.concat(
            F.lit('{"id":"m'), i.cast("string"), F.date_format("ts", "'\",\"ts\":\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'"), F.lit(',"key":"own.thing","value":1,"source":"s","origin_id":" o'), i.cast("string"), F.lit('"'),
            F.when(i % 3 == 0, F.date_format("ts", "',\"date\":\"'yyyy-MM-dd'\"'")).otherwise(""), F.when(i % 2 == 0, F.concat(F.lit(',"tags":["zz"," ","'), "event_type", F.lit('","zz"]'))).otherwise(""),
            F.when(i % 5 != 0, F.concat(F.lit(',"context":'), "props")).otherwise(""), F.when(i % 4 == 0, F.concat(F.lit(',"note":"seen by '), F.col("user_id").cast("string"), F.lit(' "'))).otherwise(""), F.lit("}"),
        ).alias("raw_line"),
    )
    r = metrics.records(metrics.parse_lines(lines.drop("props"))).join(lines.select("source_line", "props"), "source_line")
    same = F.col("context_json").eqNullSafe(F.to_json(F.parse_json(F.when(F.col("source_line") % 5 != 0, F.col("props")))))
    return r.select("id", F.col("date").cast("string").alias("date"), "tags_json", F.when(F.col("context_json").isNotNull() & same, F.col("props")).alias("context"), "origin_id", "note")


@register("metrics_fingerprints", """WITH l AS (SELECT event_id // 500 AS log, event_id - (event_id // 500) * 500 AS k, 'e' || event_id || ' ' || event_type AS line FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY k) AS number FROM l)
 SELECT log, sha256(unhex(string_agg(printf('%02x%02x', number & 255, number >> 8) || '000000000000' || hex(encode(line)) || '0A', '' ORDER BY number))) AS fingerprint FROM n GROUP BY log""")
def metrics_fingerprints(spark, d):
    """Of logs of 500 events each."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).alias("log"), "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    return e.groupBy("log").agg(text.alias("raw")).select("log", metrics.fingerprint(F.col("raw")).alias("fingerprint"))


@register("metrics_text_search", f"WITH {RECS} SELECT id FROM recs WHERE lower(props) LIKE '%\"k\": 42%'")
def metrics_text_search(spark, d):
    return metrics.search(event_records(spark, d), "'\"k\": 42'", None, NOW).select("id")


@register("metrics_month", f"WITH {RECS} SELECT key, count(*) AS n FROM recs WHERE t_at >= TIMESTAMP '2024-01-01' AND t_at < TIMESTAMP '2024-02-01' GROUP BY key")
def metrics_month(spark, d):
    return metrics.search(event_records(spark, d), "date:2024-01", None, NOW).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("daily_sum", f"WITH {RECS} SELECT CAST(bucket AS VARCHAR) AS bucket, round(sum(value), 4) AS total, count(*) AS record_count FROM recs WHERE key = 'web.click' GROUP BY recs.bucket ORDER BY recs.bucket DESC LIMIT 20")
def daily_sum(spark, d):
    r = metrics.search(event_records(spark, d), "key:web.click", None, NOW)
    return metrics.daily_sum(r, 20).select(F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "record_count")


_ROLL = "SELECT key, source, bucket, sum(value) AS total, count(*) AS n FROM recs WHERE (key, source) IN (SELECT (key, source) FROM recs GROUP BY key, source HAVING count(DISTINCT unit) = 1) GROUP BY key, source, bucket"


@register("rollup_by_key_source", f"WITH {RECS}, d AS ({_ROLL}) SELECT key, source, CAST(bucket AS VARCHAR) AS bucket, round(total, 4) AS total, n, count(*) OVER w AS active_days, CAST(sum(n) OVER w AS BIGINT) AS record_total FROM d WINDOW w AS (PARTITION BY key, source)")
def rollup_by_key_source(spark, d):
    return metrics.rollups(event_records(spark, d), ["key", "source"]).select("key", "source", F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "n", "active_days", "record_total")


@register("rollup_of_daily_parts", f"WITH {RECS}, d AS ({_ROLL}) SELECT key, source, CAST(bucket AS VARCHAR) AS bucket, round(total, 4) AS total, n, count(*) OVER w AS active_days, CAST(sum(n) OVER w AS BIGINT) AS record_total FROM d WINDOW w AS (PARTITION BY key, source)")
def rollup_of_daily_parts(spark, d):
    parts = metrics.daily_parts(event_records(spark, d))
    return metrics.rollups_of_parts(parts, ["key", "source"]).select("key", "source", F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "n", "active_days", "record_total")


@register("rollup_top_buckets", f"WITH {RECS}, d AS ({_ROLL}), r AS (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY bucket DESC) AS k FROM d) SELECT key, source, CAST(bucket AS VARCHAR) AS bucket, round(total, 4) AS total FROM r WHERE k <= 3")
def rollup_top_buckets(spark, d):
    return metrics.rollups(event_records(spark, d), ["key", "source"], 3).select("key", "source", F.col("bucket").cast("string"), F.round("total", 4).alias("total"))


@register("co_recorded_keys", f"WITH {RECS}, t AS (SELECT bucket, list(DISTINCT source) AS s FROM recs WHERE key = 'web.click' AND source = 'u1' GROUP BY bucket) SELECT key, count(*) AS overlap_days, CAST(count_if(list_contains(s, source)) AS BIGINT) AS same_source_overlap_days, 1 AS shared_prefix, epoch_us(max(ts)) AS latest_ts FROM recs JOIN t USING (bucket) WHERE key <> 'web.click' GROUP BY key")
def co_recorded_keys(spark, d):
    r = event_records(spark, d)
    out = metrics.co_recorded(r, r.where("key = 'web.click' AND source = 'u1'"))
    return out.drop("latest_id", "latest_source").withColumn("latest_ts", F.unix_micros("latest_ts"))


@register("activity_window", f"WITH {RECS} SELECT CAST(min(bucket) AS VARCHAR) AS first_day, CAST(max(bucket) AS VARCHAR) AS last_day FROM recs WHERE key = 'web.view'")
def activity_window(spark, d):
    return metrics.activity_window(metrics.search(event_records(spark, d), "key:web.view", None, NOW)).select(F.col("first_day").cast("string"), F.col("last_day").cast("string"))


@register("active_days", f"WITH {RECS} SELECT DISTINCT CAST(bucket AS VARCHAR) AS day FROM recs WHERE dated")
def active_days(spark, d):
    return context.active_days(note_table(spark, d), event_records(spark, d)).select(F.col("day").cast("string"))


#: A raw log made of the events, with faults on some rows.
def event_lines(spark, d) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(
        F.lit('{"id": '), F.when(i % 11 == 0, F.lit("5")).otherwise(F.concat(F.lit('"m'), F.when(i % 13 == 0, i - 3).otherwise(i).cast("string"), F.lit('"'))),
        F.lit(', "ts": "'), F.when(i % 17 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+04:00'")),
        F.lit('", "key": "'), F.when(i % 2 == 0, F.lit("body.weight")).otherwise(F.lit("own.thing")), F.lit('", "value": '),
        F.when(i % 19 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string")), F.lit(', "source": "s"'),
        F.when(i % 3 == 0, F.lit(', "unit": "lb"')).otherwise(F.lit("")), F.when(i % 7 == 0, F.lit(', "odd": 1')).otherwise(F.lit("")), F.when(i % 23 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, d, "events").select(F.concat(F.lit("f"), (i % 3).cast("string")).alias("source_file"), i.cast("int").alias("source_line"), line.alias("raw_line"))


PARSED = """ev AS (SELECT 'f' || event_id % 3 AS source_file, event_id, CASE WHEN event_id % 13 = 0 THEN event_id - 3 ELSE event_id END AS mid, event_id % 23 = 0 AS broken, event_id % 11 = 0 AS badid, event_id % 17 = 0 AS badts, event_id % 19 = 0 AS badvalue,
 event_id % 2 = 0 AS known, event_id % 3 = 0 AS lb, event_id % 7 = 0 AS odd FROM events),
 du AS (SELECT source_file, mid FROM ev WHERE NOT broken AND NOT badid GROUP BY ALL HAVING count(*) > 1),
 iss AS (SELECT source_file, event_id, unnest(list_filter([CASE WHEN broken THEN 'invalid_json' END, CASE WHEN NOT broken AND badid THEN 'invalid_id' END, CASE WHEN NOT broken AND badts THEN 'invalid_ts' END, CASE WHEN NOT broken AND badvalue THEN 'invalid_value' END,
 CASE WHEN NOT broken AND NOT known THEN 'unknown_metric_key' END, CASE WHEN NOT broken AND known AND lb THEN 'unit_mismatch' END, CASE WHEN NOT broken AND NOT known AND lb THEN 'unknown_unit' END, CASE WHEN NOT broken AND odd THEN 'unknown_field' END,
 CASE WHEN NOT broken AND NOT badid AND (source_file, mid) IN (SELECT (source_file, mid) FROM du) THEN 'duplicate_id' END], lambda x: x IS NOT NULL)) AS code FROM ev),
 st AS (SELECT ev.source_file, ev.event_id, CASE WHEN count_if(code LIKE 'invalid%' OR code = 'duplicate_id') > 0 THEN 'invalid' WHEN count(code) > 0 THEN 'warning' ELSE 'valid' END AS status FROM ev LEFT JOIN iss ON ev.event_id = iss.event_id GROUP BY ALL)"""


@register("metrics_validate", f"WITH {PARSED} SELECT source_file, CAST(event_id AS INT) AS source_line, status FROM st")
def metrics_validate(spark, d):
    return metrics.parse_lines(event_lines(spark, d)).select("source_file", "source_line", "status")


@register("metrics_issue_counts", f"WITH {PARSED} SELECT code, count(*) AS n FROM iss GROUP BY code")
def metrics_issue_counts(spark, d):
    return metrics.issues(metrics.parse_lines(event_lines(spark, d))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@register("metrics_file_summary", f"WITH {PARSED} SELECT source_file, count(*) AS row_count, CAST(count_if(status <> 'invalid') AS BIGINT) AS record_count FROM st GROUP BY source_file")
def metrics_file_summary(spark, d):
    return metrics.file_summary(metrics.parse_lines(event_lines(spark, d))).select("source_file", "row_count", "record_count")


@register("snapshot_diff_plan", "SELECT CAST(doc_id AS VARCHAR) AS note_id, CASE WHEN doc_id % 5 = 0 THEN 'add' WHEN doc_id % 5 = 1 THEN 'remove' ELSE 'update' END AS action FROM documents WHERE doc_id % 5 < 3")
def snapshot_diff_plan(spark, d):
    n = note_table(spark, d).withColumn("metadata_json", F.to_json("metadata"))
    f = incremental.fingerprinted(n)
    i = F.col("note_id").cast("long") % 5
    old = incremental.fingerprinted(n.withColumn("content", F.when(i == 2, F.lit("old")).otherwise(F.col("content"))))
    return incremental.plan(f.where(i != 1), old.where(i != 0))


#: Files of documents; by a hash of their numbers some are added, changed or removed since the listing before.
_FILES = "d AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS p, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) AS h, coalesce(n_chars, 0) AS n FROM documents WHERE doc_id IS NOT NULL)"
_CHANGES = f"{_FILES}, ch AS (SELECT DISTINCT p, CASE h WHEN '0' THEN 'added' WHEN '1' THEN 'changed' WHEN '2' THEN 'removed' END AS change FROM d WHERE h < '3')"


def _listings(spark, d) -> tuple[DataFrame, DataFrame]:
    i, none = F.col("doc_id").cast("string"), F.lit("none")
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.concat(i, F.lit(".md")))
    rows = table(spark, d, "documents").where("doc_id is not null").select(path.alias("relative_path"), F.substring(F.md5(i), 1, 1).alias("h"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    rows = rows.groupBy("relative_path", "h").agg(F.max("size").alias("size")).withColumn("file_modified_at", F.lit(NOW))
    return rows.where("h <> '0'").withColumn("size", F.col("size") + (F.col("h") == "1").cast("int")).drop("h"), rows.where("h <> '2'").drop("h")


@register("change_rows", f"WITH {_CHANGES} SELECT p AS relative_path, change FROM ch")
def change_rows(spark, d):
    return changes.differences(*_listings(spark, d))


@register("change_scopes", f"""WITH {_CHANGES}, k AS (SELECT count(*) AS n3, count(DISTINCT (split_part(p, '/', 1), split_part(p, '/', 2))) AS n2, count(DISTINCT split_part(p, '/', 1)) AS n1 FROM ch),
 s AS (SELECT change, CASE WHEN n3 <= 50 THEN p WHEN n2 <= 50 THEN split_part(p, '/', 1) || '/' || split_part(p, '/', 2) WHEN n1 <= 50 THEN split_part(p, '/', 1) ELSE '' END AS scope, n3 <= 50 AS single FROM ch, k)
 SELECT scope AS relative_path, CASE WHEN single THEN change ELSE 'reconcile' END AS change, count(*) AS files FROM s GROUP BY ALL""")
def change_scopes(spark, d):
    return changes.told(scratch.stored(changes.differences(*_listings(spark, d))), 50)


@register("context_day_created", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents WHERE doc_id * 600 >= 86400 AND doc_id * 600 < 2 * 86400 AND doc_id % 10 <> 0 ORDER BY doc_id DESC, note_id LIMIT 5")
def context_day_created(spark, d):
    k = context.Knowledge(note_table(spark, d), event_records(spark, d), page_edges(spark, d))
    return context.day_view(k, date(2024, 1, 2))["created"].select("note_id")


@register("context_week_metrics", f"WITH {RECS} SELECT id, key FROM recs WHERE t_at >= TIMESTAMP '2024-01-08' AND t_at <= TIMESTAMP '2024-01-14' ORDER BY ts DESC, source_file, event_id LIMIT 10")
def context_week_metrics(spark, d):
    k = context.Knowledge(note_table(spark, d), event_records(spark, d), page_edges(spark, d))
    return context.week_view(k, date(2024, 1, 10))["metrics"].select("id", "key")


@register("anchor_window_45d", "SELECT CAST(o_orderkey AS VARCHAR) AS note_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' - 45 AND DATE '1995-03-10' + 45")
def anchor_window_45d(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderdate").cast("timestamp").alias("file_modified_at"), F.lit(None).cast("timestamp").alias("created_at"))
    return o.where(context.near_anchor(o, (date(1995, 3, 1), date(1995, 3, 10)))).select("note_id")


@register("latest_per_key", f"WITH {RECS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, source_file, event_id) AS k FROM recs) SELECT key, id FROM r WHERE k = 1")
def latest_per_key(spark, d):
    return context.latest_per_key(event_records(spark, d)).select("key", "id")


_EV = "SELECT CAST(doc_id % 40 AS VARCHAR) AS note_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE doc_id % 40 % 3 END AS INT) AS kind, CASE WHEN doc_id % 9 <> 0 THEN to_timestamp(1704067200 + doc_id * 600) END AS t_at, CAST(doc_id AS VARCHAR) AS reason FROM documents"


@register("evidence_best", f"SELECT note_id, kind, reason FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY kind, t_at DESC NULLS LAST, reason) AS k FROM ({_EV})) WHERE k = 1")
def evidence_best(spark, d):
    return context.best_evidence(_evidence(spark, d), "note_id", "at").select("note_id", "kind", "reason")


@register("evidence_prune", f"WITH b AS (SELECT note_id, kind, t_at FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY kind, t_at DESC NULLS LAST, reason) = 1), n AS (SELECT least(count(*), 5) AS n FROM b WHERE kind < 2), r AS (SELECT note_id, kind, row_number() OVER (PARTITION BY kind < 2 ORDER BY kind, t_at DESC NULLS LAST, note_id) AS r FROM b) SELECT note_id, kind FROM r, n WHERE r <= CASE WHEN kind < 2 THEN 5 ELSE least(CASE WHEN n >= 2 THEN 1 ELSE 2 END, 5 - n) END")
def evidence_prune(spark, d):
    return context.prune(context.best_evidence(_evidence(spark, d), "note_id", "at"), "note_id", "at", 5).select("note_id", "kind")


def _evidence(spark, d) -> DataFrame:
    i = F.col("doc_id")
    at = F.when(i % 9 != 0, F.timestamp_seconds(F.lit(1704067200) + i * 600))
    kind = F.when(i % 7 == 0, 2).otherwise(i % 40 % 3).cast("int")
    return table(spark, d, "documents").select((i % 40).cast("string").alias("note_id"), kind.alias("kind"), at.alias("at"), i.cast("string").alias("reason"))


@register("ordered_merge_cap", "SELECT note_id FROM (SELECT note_id, min(g * 1000 + p) AS o FROM (SELECT CAST(doc_id AS VARCHAR) AS note_id, 0 AS g, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS p FROM documents WHERE lang = 'es' QUALIFY p <= 8 UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS p FROM documents WHERE source = 'src1' QUALIFY p <= 8) GROUP BY note_id ORDER BY o LIMIT 8)")
def ordered_merge_cap(spark, d):
    n = note_table(spark, d)
    return context.merge_capped([n.where("metadata.lang = 'es'").select("note_id"), n.where("metadata.source = 'src1'").select("note_id")], "note_id", 8)


@register("timeline_bounds", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def timeline_bounds(spark, d):
    span = note_query.parse("m:past7d", NOW).filters["modified"]
    return table(spark, d, "events").where(span.contains(F.col("ts").cast("timestamp"))).select("event_id")


