"""Vector and lexical search."""

from pyspark.sql import functions as F

from shotgrove.operators import bm25, knn, neighbors
from shotgrove.plans.catalog_encoding import sql_knn
from shotgrove.plans.inputs import SQL_WORDS, passages, turn_examples, vectors, with_parts
from shotgrove.plans.registry import joined, query, rounded, table
from shotgrove.session import materialize, new_table_path


def _queries(spark, folder):
    return vectors(spark, folder, "query_id")


def _texts(spark, folder):
    """Lexical queries and corpus."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked, table(spark, folder, "documents").select("doc_id", "text")


@query("knn_exact", with_parts("v") + ",\n" + sql_knn(64) + "\nSELECT query_id, rank, doc_id, score FROM knn")
def knn_exact(spark, folder):
    return knn.knn_exact(_queries(spark, folder), vectors(spark, folder), 64)


@query("knn_exact_blocks", with_parts("v") + ",\n" + sql_knn(64) + "\nSELECT query_id, rank, doc_id, score FROM knn")
def knn_exact_blocks(spark, folder):
    """The way taken when there are too many queries to broadcast at once."""
    return knn.knn_exact(_queries(spark, folder), vectors(spark, folder), 64, max_broadcast_values=0)


@query("knn_metrics", with_parts("v") + "".join(
    ",\n" + sql_knn(8, m, m) for m in ("ip", "cosine", "l2")) + "\n    " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, query_id, rank, doc_id, score FROM {m}" for m in ("ip", "cosine", "l2")))
def knn_metrics(spark, folder):
    found = [knn.knn_exact(_queries(spark, folder), vectors(spark, folder), 8, m).withColumn("metric", F.lit(m))
             for m in ("ip", "cosine", "l2")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("metric", "query_id", "rank", "doc_id", "score")


SQL_MEANS = """parts AS (SELECT vec_id, label, unnest(range(len(e))) AS dim, unnest(e) AS x FROM v),
means AS (SELECT label, dim, AVG(x) AS x FROM parts GROUP BY label, dim),
centers AS (SELECT label AS cell, list(x ORDER BY dim) AS e FROM means GROUP BY label)"""

_SQL_IVF = with_parts("v") + ",\n" + SQL_MEANS + """,
    near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS n FROM (
        SELECT v.vec_id, c.cell, round(list_inner_product(v.e, c.e), 6) AS score FROM v CROSS JOIN centers c)),
    found AS (
        SELECT p.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.e, t.e), 6) + 0.0 AS score
        FROM near p JOIN near d ON d.cell = p.cell AND d.n = 1
        JOIN v q ON q.vec_id = p.vec_id JOIN v t ON t.vec_id = d.vec_id WHERE p.n <= 3)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM found)
    WHERE rank <= 16"""


def label_means(spark, folder):
    return knn.mean_centroids(
        table(spark, folder, "embeddings").select("label", F.col("embedding").alias("emb")), "label")


@query("knn_ivf", _SQL_IVF)
def knn_ivf(spark, folder):
    return knn.knn_ivf(_queries(spark, folder), vectors(spark, folder), label_means(spark, folder), 16, 3)


@query("knn_ivf_blocks", _SQL_IVF)
def knn_ivf_blocks(spark, folder):
    """The way taken when there are too many queries to broadcast at once."""
    return knn.knn_ivf(_queries(spark, folder), vectors(spark, folder), label_means(spark, folder), 16, 3,
                       max_broadcast_values=0)


@query("index_partitions", _SQL_IVF)
def index_partitions(spark, folder):
    path = new_table_path(spark, "index")
    knn.write_index(vectors(spark, folder), label_means(spark, folder), path)
    return knn.search_index(_queries(spark, folder), path, 16, 3)


@query("knn_ivf_kmeans")
def knn_ivf_kmeans(spark, folder):
    """Share of the exact neighbours found with centroids from k-means."""
    queries, corpus = _queries(spark, folder), vectors(spark, folder)
    found = knn.knn_ivf(queries, corpus, knn.kmeans_centroids(corpus, 16, seed=7), 16, 4)
    return knn.recall(found, knn.knn_exact(queries, corpus, 16))


DIM = 256

# Vectors of all texts as (kind, id, dim, x), from the words alone.
SQL_ENCODED = f"""texts AS (
    SELECT 'document' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'query' AS kind, item_id AS id, text FROM benchmark),
hashed AS (SELECT kind, id, CAST('0x' || left(md5(w), 8) AS BIGINT) % {DIM} AS dim FROM (
    SELECT kind, id, unnest({SQL_WORDS.format('text')}) AS w FROM texts)),
counted AS (SELECT kind, id, dim, COUNT(*) AS n FROM hashed GROUP BY kind, id, dim),
weights AS (SELECT dim, ln(((SELECT COUNT(*) FROM documents) + 1) / (COUNT(*) + 1)) AS weight
            FROM counted WHERE kind = 'document' GROUP BY dim),
weighted AS (SELECT c.kind, c.id, c.dim, c.n * COALESCE(w.weight, ln((SELECT COUNT(*) FROM documents) + 1)) AS x
             FROM counted c LEFT JOIN weights w ON w.dim = c.dim),
encoded AS (SELECT kind, id, dim, x / sqrt(SUM(x * x) OVER (PARTITION BY kind, id)) AS x FROM weighted WHERE x > 0)"""


@query("encode_queries", f"""
    WITH {SQL_ENCODED}
    SELECT kind, id, dim::INTEGER AS dim, round(x, 6) AS x FROM encoded""")
def encode_queries(spark, folder):
    """The vectors of all documents and queries, from an encoder fitted on the documents; without the zeros."""
    asked, corpus = _texts(spark, folder)
    encoder = neighbors.fit_encoder(corpus, DIM)
    both = (corpus.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
            .unionByName(asked.select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), "text")))
    rows = neighbors.encode_texts(both, encoder).select("kind", "id", F.posexplode("emb").alias("dim", "x"))
    return rows.where(F.col("x") > 0).select("kind", "id", "dim", rounded(F.col("x")).alias("x"))


@query("dense_text", f"""
    WITH {SQL_ENCODED},
    scored AS (SELECT q.id AS query_id, d.id AS doc_id, round(SUM(q.x * d.x), 6) AS score
               FROM encoded q JOIN encoded d ON d.dim = q.dim AND d.kind = 'document' WHERE q.kind = 'query'
               GROUP BY q.id, d.id),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""")
def dense_text(spark, folder):
    """Texts are encoded and searched in one plan."""
    asked, corpus = _texts(spark, folder)
    return neighbors.retrieve(asked, corpus, "dense", k=10)


_SQL_INDEX = f"""words AS (SELECT doc_id, unnest({SQL_WORDS.format('text')}) AS term FROM documents),
posted AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, len({SQL_WORDS.format('text')}) AS dl FROM documents),
freq AS (SELECT term, COUNT(*) AS df FROM posted GROUP BY term),
sums AS (SELECT COUNT(*) AS n_docs, AVG(dl) AS avgdl FROM lengths)"""


@query("bm25_index", f"""
    WITH {_SQL_INDEX}
    SELECT p.doc_id, p.term, p.tf::INTEGER AS tf, f.df, l.dl::INTEGER AS dl
    FROM posted p JOIN freq f ON f.term = p.term JOIN lengths l ON l.doc_id = p.doc_id""")
def bm25_index(spark, folder):
    posted = materialize(bm25.postings(bm25.document_rows(_texts(spark, folder)[1])), "postings")
    return posted.join(bm25.document_frequency(posted), "term").select("doc_id", "term", "tf", "df", "dl")


@query("bm25_statistics", f"""
    WITH {_SQL_INDEX}
    SELECT f.term, f.df, s.n_docs, round(s.avgdl, 6) AS avgdl FROM freq f CROSS JOIN sums s""")
def bm25_statistics(spark, folder):
    counted = bm25.term_statistics(bm25.document_rows(_texts(spark, folder)[1]))
    n_docs, length = counted.where(F.col("term").isNull()).select("df", "length").first()
    return counted.where(F.col("term").isNotNull()).select(
        "term", "df", F.lit(n_docs).cast("bigint").alias("n_docs"), rounded(F.lit(length / n_docs)).alias("avgdl"))


_SQL_BM25 = f"""{_SQL_INDEX},
asked AS (SELECT query_id, term, COUNT(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest({SQL_WORDS.format('text')}) AS term FROM benchmark) GROUP BY query_id, term),
scored AS (
    SELECT a.query_id, p.doc_id, round(SUM(
        a.qtf * ln(1 + (s.n_docs - f.df + 0.5) / (f.df + 0.5))
        * p.tf / (p.tf + 0.9 * (1 - 0.4 + 0.4 * l.dl / s.avgdl))), 6) AS score
    FROM asked a JOIN posted p ON p.term = a.term JOIN freq f ON f.term = a.term
    JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN sums s GROUP BY a.query_id, p.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


@query("bm25_topk", f"""
    WITH {_SQL_BM25} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""")
def bm25_topk(spark, folder):
    asked, corpus = _texts(spark, folder)
    return bm25.bm25_topk(asked, corpus, 10)


@query("bm25_stored_index", f"""
    WITH {_SQL_BM25} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""")
def bm25_stored_index(spark, folder):
    asked, corpus = _texts(spark, folder)
    path = new_table_path(spark, "lexical")
    bm25.write_index(corpus, path)
    return bm25.bm25_topk(asked, bm25.open_index(spark, path), 10)


@query("bm25_topk_blocks", f"""
    WITH {_SQL_BM25} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""")
def bm25_topk_blocks(spark, folder):
    """The way taken when there are many postings: bounds, and blocks of frequent terms."""
    asked, corpus = _texts(spark, folder)
    path = new_table_path(spark, "lexical")
    bm25.write_index(corpus, path, block_postings=64)
    return bm25.bm25_topk(asked, bm25.open_index(spark, path), 10, plain_postings=0, bound_postings=200)


@query("retriever_switch", with_parts("v") + ",\n" + sql_knn(5) + f", {_SQL_BM25}" + """
    SELECT 'dense' AS method, query_id, rank, doc_id, score FROM knn
    UNION ALL SELECT 'sparse' AS method, query_id, rank::INTEGER, doc_id, score FROM best WHERE rank <= 5""")
def retriever_switch(spark, folder):
    asked, corpus = _texts(spark, folder)
    dense = neighbors.retrieve(_queries(spark, folder), vectors(spark, folder), "dense", k=5)
    sparse = neighbors.retrieve(asked, corpus, "sparse", k=5)
    both = dense.withColumn("method", F.lit("dense")).unionByName(sparse.withColumn("method", F.lit("sparse")))
    return both.select("method", "query_id", "rank", "doc_id", "score")


@query("hit_json_parse", "SELECT event_id, json_extract_string(props, '$.k') AS text FROM events")
def hit_json_parse(spark, folder):
    raw = table(spark, folder, "events").select("event_id", F.col("props").alias("raw"))
    return neighbors.parse_hits(raw, field="k").select("event_id", "text")


def pair_queries(spark, folder):
    """A vector and the next one as the two sentences of an example."""
    v = vectors(spark, folder, "guid")
    second = v.select((F.col("guid") - 1).alias("guid"), F.col("emb").alias("next"))
    return v.join(second, "guid").select("guid", F.posexplode(F.array("emb", "next")).alias("sent_id", "emb")).withColumn(
        "query_id", F.col("guid") * 2 + F.col("sent_id"))


@query("attach_neighbors", with_parts("v") + ",\n" + sql_knn(4) + """,
    pairs AS (SELECT a.vec_id AS guid, unnest([0, 1]) AS sent_id, unnest([a.vec_id, b.vec_id]) AS q
              FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
    SELECT p.guid, COUNT(*) AS n, string_agg(COALESCE(d.text, ''), '|' ORDER BY p.sent_id, k.rank) AS texts
    FROM pairs p JOIN knn k ON k.query_id = p.q LEFT JOIN documents d ON d.doc_id = k.doc_id GROUP BY p.guid""")
def attach_neighbors(spark, folder):
    """A neighbour without a passage keeps its place, with an empty text."""
    queries = pair_queries(spark, folder)
    hits = knn.knn_exact(queries, vectors(spark, folder), 4)
    rows = neighbors.neighbor_rows(queries, hits, passages(spark, folder).select("doc_id", "text"))
    return neighbors.attach_neighbors(rows).select(
        "guid", F.size("neighbor_texts").cast("bigint").alias("n"),
        F.array_join("neighbor_texts", "|", "").alias("texts"))


@query("neighbor_cache", with_parts("v") + ",\n" + sql_knn(8) + "\nSELECT query_id, rank, doc_id, score FROM knn")
def neighbor_cache(spark, folder):
    """Half the classes are searched first; the second call searches only the others."""
    cache = neighbors.NeighborCache(spark, new_table_path(spark, "neighbors"))
    early = table(spark, folder, "embeddings").where(F.col("label") < 5).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb"))
    cache.fetch(early, vectors(spark, folder), "dense", k=8)
    return cache.fetch(_queries(spark, folder), vectors(spark, folder), "dense", k=8)


@query("batch_queries", with_parts("turns") + """
    SELECT guid, CAST(floor((row_number() OVER (ORDER BY guid) - 1) / 32) AS BIGINT) AS batch_id,
           ((row_number() OVER (ORDER BY guid) - 1) % 32)::INTEGER AS pos FROM turns""")
def batch_queries(spark, folder):
    return neighbors.batch_queries(turn_examples(spark, folder).select("guid"), "guid")
