"""Search queries: benchmark items ask, documents answer; a document's vector is the one of its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.explode import exploded
from lexarium.functions.text import tokens
from lexarium.operators import evaluate, retrieve
from lexarium.operators import vectors as vector_index
from lexarium.plans.tables import table
from lexarium.storage import settled, stored

TOK = r"regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_./+\\-]+')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return own.join(vectors(spark, d).withColumnRenamed("doc_id", "query_id"), "query_id")


def lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.bm25_top(retrieve.LexicalIndex.build(docs(spark, d)), queries(spark, d), k)


def semantic(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.knn(vectors(spark, d), query_vectors(spark, d), k)


def first_words(q: DataFrame, n: int) -> DataFrame:
    return q.select("query_id", F.array_join(F.slice(tokens(F.col("text")), 1, n), " ").alias("text"))


#: BM25 as common table expressions; {q} selects (query_id, text).
BM25 = rf"""
tok AS (SELECT doc_id, unnest({TOK}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
corpus AS (SELECT count(*) AS n, (SELECT count(*) FROM tok) / count(*) AS avgdl FROM documents),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, corpus),
idf AS (SELECT token, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM raw) ELSE i END AS idf FROM raw),
"""


def bm25_sql(name: str, query: str, k: int) -> str:
    """CTEs that end in ``name(query_id, doc_id, score, rank)``; documents without a match fill short lists by id."""
    return rf"""
{name}_q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({TOK}) AS token FROM ({query})) GROUP BY ALL),
{name}_s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN tf USING (token) JOIN idf USING (token) JOIN dl USING (doc_id), corpus GROUP BY ALL),
{name}_a AS (SELECT query_id, doc_id, score, 1 AS hit FROM {name}_s UNION ALL SELECT query_id, doc_id, 0.0, 0
  FROM (SELECT q.query_id, d.doc_id FROM (SELECT DISTINCT query_id FROM ({query})) q CROSS JOIN documents d) ANTI JOIN {name}_s USING (query_id, doc_id)),
{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, score DESC, doc_id) AS rank FROM {name}_a) WHERE rank <= {k})"""


ASK = "SELECT item_id AS query_id, text FROM benchmark"
SHORT_ASK = f"SELECT item_id AS query_id, array_to_string({TOK}[1:5], ' ') AS text FROM benchmark"
KNN = """
pairs AS (SELECT b.item_id AS query_id, e.vec_id AS doc_id,
  round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= {k})"""


def fuse_sql(name: str, runs: list[tuple[str, float]]) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, doc_id, {w} / (60 + rank) AS part, {i * 1_000_000} + rank AS seq FROM {run}" for i, (run, w) in enumerate(runs))
    return f"""
{name}_s AS (SELECT query_id, doc_id, round(sum(part), 8) AS fused_score, min(seq) AS seq FROM ({every}) GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, seq, doc_id) AS fused_rank FROM {name}_s)"""


RESCUE = """
kept AS (SELECT query_id, doc_id, fused_score, fused_rank AS seq FROM fused WHERE fused_rank <= 60),
unseen AS (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS place FROM sem s ANTI JOIN kept k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
cand AS (SELECT * FROM kept UNION ALL SELECT u.query_id, u.doc_id, coalesce(f.fused_score, 0.0), 60 + u.place FROM unseen u LEFT JOIN fused f USING (query_id, doc_id) WHERE u.place <= 24)"""


def overlap_sql(texts: str, candidates: str) -> str:
    """(query_id, doc_id, rerank_score) of candidates over the texts of their query."""
    return rf"""
qt AS (SELECT query_id, list_distinct({TOK}) AS qt FROM ({texts})),
dt AS (SELECT doc_id, list_distinct({TOK}) AS dt FROM documents),
best AS (SELECT c.query_id, c.doc_id, max(round(len(list_intersect(qt, dt)) / greatest(len(qt), 1), 6)) AS rerank_score
  FROM {candidates} c JOIN qt USING (query_id) JOIN dt USING (doc_id) GROUP BY ALL)"""


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid_search(docs(spark, d), vectors(spark, d), queries(spark, d), query_vectors(spark, d))


HYBRID = f"""WITH {BM25} {bm25_sql('lex', ASK, 40)}, {KNN.format(k=64)}, {fuse_sql('fused', [('sem', 0.8), ('lex', 0.2)])}, {RESCUE},
{overlap_sql(ASK, 'cand')}
SELECT query_id, rank, doc_id, fused_score, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_score DESC, seq, doc_id) AS rank
FROM cand JOIN best USING (query_id, doc_id)) WHERE rank <= 8"""


def bm25_topk(spark, d):
    return lexical(spark, d, 10)


def knn_indexed(spark, d):
    """As ``knn_topk``, over partitions of the vectors."""
    return vector_index.knn(vector_index.VectorIndex.build(vectors(spark, d)), query_vectors(spark, d), 5)[0]


def knn_reads(spark, d):
    """Pairs of query and vector, and how many of them were scored."""
    return vector_index.knn(vector_index.VectorIndex.build(vectors(spark, d)), query_vectors(spark, d), 5)[1]


def rrf_fuse(spark, d):
    return retrieve.fuse([(semantic(spark, d, 64), 0.8), (lexical(spark, d, 40), 0.2)])


def rrf_weighted_variants(spark, d):
    index = retrieve.LexicalIndex.build(docs(spark, d))
    short = retrieve.bm25_top(index, first_words(queries(spark, d), 5), 20)
    return retrieve.fuse([(semantic(spark, d, 20), 0.8), (retrieve.bm25_top(index, queries(spark, d), 20), 0.2), (short, 0.15)])


def post_filter_search(spark, d):
    found = lexical(spark, d, 50)
    return found.join(table(spark, d, "documents").where("lang = 'de'").select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score", "rank")


def semantic_rescue(spark, d):
    s = stored(semantic(spark, d, 64), "semantic-top")
    return retrieve.with_rescue(retrieve.fuse([(s, 0.8), (lexical(spark, d, 40), 0.2)]), s)


def exact_match_rescue(spark, d):
    q = queries(spark, d).select("query_id", F.element_at(F.array_sort(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 4)), 1).alias("token"))
    index = retrieve.LexicalIndex.build(docs(spark, d))
    found = retrieve.bm25_top(index, queries(spark, d), 40)
    # Asked of the documents found only: a common word is held by nearly all of the others.
    asked = stored(found.join(q, "query_id").select("query_id", "doc_id", "token"), "asked-tokens")
    holds = retrieve.with_few(index.postings.select("doc_id", "token"), asked, "doc_id", "token").join(asked, ["doc_id", "token"]).select("query_id", "doc_id")
    top = found.where("rank <= 2").select("query_id", "doc_id", F.col("score").alias("fused_score"), F.col("rank").alias("seq"))
    return retrieve.exact_rescue(top, found, holds)


EXACT = rf"""WITH {BM25} {bm25_sql('lex', ASK, 40)},
q AS (SELECT item_id AS query_id, list_sort(list_filter({TOK}, lambda x: length(x) >= 4))[1] AS token FROM benchmark),
holds AS (SELECT DISTINCT query_id, doc_id FROM q JOIN tf USING (token)),
top AS (SELECT query_id, doc_id, score AS fused_score, rank AS seq FROM lex WHERE rank <= 2),
have AS (SELECT query_id, count(*) AS have FROM top SEMI JOIN holds USING (query_id, doc_id) GROUP BY ALL),
more AS (SELECT l.query_id, l.doc_id, coalesce(have, 0) + row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS place
  FROM (SELECT * FROM lex SEMI JOIN holds USING (query_id, doc_id)) l ANTI JOIN top t ON l.query_id = t.query_id AND l.doc_id = t.doc_id LEFT JOIN have h ON h.query_id = l.query_id)
SELECT * FROM top UNION ALL SELECT query_id, doc_id, 0.0, 1000000000 + place FROM more WHERE place <= 3"""


def rerank_max_over_variants(spark, d):
    q = queries(spark, d)
    top = lexical(spark, d, 20).select("query_id", "doc_id", F.col("score").alias("fused_score"), F.col("rank").alias("seq"))
    return retrieve.rerank(top, docs(spark, d), q.unionByName(first_words(q, 5))).select("query_id", "doc_id", "rerank_score")


def vocabulary(spark, d):
    held = exploded(docs(spark, d), tokens(F.col("text")), "token", "doc_id")
    return held.groupBy("token").agg(F.count("*").alias("frequency"), F.countDistinct("doc_id").alias("df"))


def typo_candidates(spark, d):
    words = queries(spark, d).select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return retrieve.typo_candidates(words, vocabulary(spark, d))


TYPO = rf"""WITH v AS (SELECT token, count(*) AS frequency FROM (SELECT unnest({TOK}) AS token FROM documents) GROUP BY ALL),
w AS (SELECT DISTINCT token AS word FROM (SELECT unnest({TOK}) AS token FROM benchmark) WHERE length(token) >= 4 AND NOT regexp_full_match(token, '[0-9]+'))
SELECT word, correction, frequency FROM (SELECT word, token AS correction, frequency, row_number() OVER (PARTITION BY word ORDER BY frequency DESC, token) AS n
FROM w JOIN v ON substr(word, 1, 1) = substr(token, 1, 1) AND abs(length(word) - length(token)) <= 1 WHERE word <> token AND length(token) >= 4 AND levenshtein(word, token) <= 1) WHERE n = 1"""


def relevance(spark, d):
    """Grades of documents for items, told by another ranking than the one that is graded.

    A labelled document among an item's three best by its first five words has its quality and one.
    """
    index = retrieve.LexicalIndex.build(docs(spark, d))
    graded = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("grade"))
    told = retrieve.bm25_top(index, first_words(queries(spark, d), 5), 3).join(graded, "doc_id").select("query_id", "doc_id", "grade")
    return told, retrieve.bm25_top(index, queries(spark, d), 10)


def eval_metrics(spark, d):
    told, found = relevance(spark, d)
    return evaluate.query_metrics(found, told, 5)


def eval_overall(spark, d):
    return evaluate.overall(eval_metrics(spark, d))


METRICS = f"""WITH {BM25} {bm25_sql('lex', ASK, 10)}, {bm25_sql('short', SHORT_ASK, 3)},
rel AS (SELECT query_id, doc_id, quality + 1 AS grade FROM short JOIN labels USING (doc_id)),
g AS (SELECT l.query_id, l.doc_id, l.rank, coalesce(r.grade, 0) AS grade FROM lex l LEFT JOIN (SELECT query_id, doc_id, greatest(max(grade), 0) AS grade FROM rel GROUP BY ALL) r USING (query_id, doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM g),
a AS (SELECT query_id, sum(CASE WHEN rank <= 5 AND grade > 0 THEN 1 ELSE 0 END) AS hits, min(CASE WHEN grade > 0 THEN rank END) AS first,
  sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY ALL),
t AS (SELECT query_id, count(DISTINCT doc_id) AS relevant FROM rel WHERE grade > 0 GROUP BY ALL),
m AS (SELECT query_id, round(hits / 5, 6) AS "precision", round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg, coalesce(first <= 1, false)::BIGINT AS top1, coalesce(first <= 3, false)::BIGINT AS top3 FROM a LEFT JOIN t USING (query_id))
"""


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def case_invariance(spark, d):
    q = queries(spark, d)
    forms = [F.col("text"), F.lower("text"), F.translate("text", LOWER, UPPER), F.col("text")]
    cased = q.select("query_id", F.posexplode(F.array(*forms)).alias("form", "text"))
    # The last form drops a word, so that not all agree.
    last = F.when(F.col("form") == 3, F.regexp_replace("text", r"^\S+", "")).otherwise(F.col("text"))
    cased = cased.select((F.col("query_id") * 4 + F.col("form")).alias("query_id"), last.alias("text"))
    found = retrieve.bm25_top(retrieve.LexicalIndex.build(docs(spark, d)), cased, 8)
    return evaluate.group_agreement(found, cased.select("query_id", F.floor(F.col("query_id") / 4).alias("grp")), 8)


CASE_ASK = rf"""SELECT item_id * 4 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 4 + 1, lower(text) FROM benchmark
UNION ALL SELECT item_id * 4 + 2, translate(text, '{LOWER}', '{UPPER}') FROM benchmark UNION ALL SELECT item_id * 4 + 3, regexp_replace(text, '^\S+', '') FROM benchmark"""
CASES = f"""WITH {BM25} {bm25_sql('lex', CASE_ASK, 8)},
s AS (SELECT query_id, list(doc_id) AS docs FROM lex GROUP BY ALL)
SELECT a.query_id // 4 AS grp, count(*) AS pairs, round(avg(len(list_intersect(a.docs, b.docs)) / len(list_distinct(list_concat(a.docs, b.docs)))), 6) AS agreement
FROM s a JOIN s b ON a.query_id // 4 = b.query_id // 4 AND a.query_id < b.query_id GROUP BY ALL"""

LEX_WITH = f"WITH {BM25} {bm25_sql('lex', ASK, 40)}"
QUERIES = {
    "hybrid_search": hybrid_search,
    "bm25_topk": settled(bm25_topk),
    "knn_indexed": settled(knn_indexed),
    "knn_reads": settled(knn_reads),
    "knn_topk": lambda s, d: semantic(s, d, 5),
    "rrf_fuse": settled(rrf_fuse),
    "rrf_weighted_variants": settled(rrf_weighted_variants),
    "post_filter_search": settled(post_filter_search),
    "semantic_rescue": settled(semantic_rescue),
    "exact_match_rescue": settled(exact_match_rescue),
    "rerank_max_over_variants": settled(rerank_max_over_variants),
    "typo_candidates": typo_candidates,
    "tokenize_df": vocabulary,
    "eval_metrics": settled(eval_metrics),
    "eval_overall": settled(eval_overall),
    "case_invariance": settled(case_invariance),
}
ORACLE_SQL = {
    "hybrid_search": HYBRID,
    "bm25_topk": f"WITH {BM25} {bm25_sql('lex', ASK, 10)} SELECT query_id, doc_id, score, rank FROM lex",
    "knn_indexed": f"WITH {KNN.format(k=5)} SELECT query_id, doc_id, score, rank FROM sem",
    "knn_topk": f"WITH {KNN.format(k=5)} SELECT query_id, doc_id, score, rank FROM sem",
    "rrf_fuse": f"{LEX_WITH}, {KNN.format(k=64)}, {fuse_sql('fused', [('sem', 0.8), ('lex', 0.2)])} SELECT * FROM fused",
    "rrf_weighted_variants": f"WITH {BM25} {bm25_sql('lex', ASK, 20)}, {bm25_sql('short', SHORT_ASK, 20)}, {KNN.format(k=20)}, {fuse_sql('fused', [('sem', 0.8), ('lex', 0.2), ('short', 0.15)])} SELECT * FROM fused",
    "post_filter_search": f"WITH {BM25} {bm25_sql('lex', ASK, 50)} SELECT query_id, doc_id, score, rank FROM lex JOIN documents USING (doc_id) WHERE lang = 'de'",
    "semantic_rescue": f"{LEX_WITH}, {KNN.format(k=64)}, {fuse_sql('fused', [('sem', 0.8), ('lex', 0.2)])}, {RESCUE} SELECT query_id, doc_id, fused_score, seq FROM cand",
    "exact_match_rescue": EXACT,
    "rerank_max_over_variants": f"WITH {BM25} {bm25_sql('lex', ASK, 20)}, {overlap_sql(ASK + ' UNION ALL ' + SHORT_ASK, 'lex')} SELECT query_id, doc_id, rerank_score FROM best",
    "typo_candidates": TYPO,
    "tokenize_df": f"SELECT token, count(*) AS frequency, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY ALL",
    "eval_metrics": METRICS + "SELECT * FROM m",
    "eval_overall": METRICS + 'SELECT count(*) AS queries, round(avg("precision"), 5) AS "precision", round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg, round(avg(top1), 5) AS top1, round(avg(top3), 5) AS top3 FROM m',
    "case_invariance": CASES,
}
