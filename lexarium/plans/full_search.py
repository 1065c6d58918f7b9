"""The whole search plan over a handful of requests, with its DuckDB form built from the same variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import retrieve, search
from lexarium.operators.variants import exact_token, rerank_queries, variants, words
from lexarium.plans.search import BM25, bm25_sql
from lexarium.plans.surface import CHUNKS, chunk_fields, q_department, q_filter, q_normalize
from lexarium.plans.tables import table
from lexarium.storage import settled

#: (text, earliest day, latest day, department, how many).
REQUESTS = (
    ("how to install the container", None, None, "all", 5),
    ("What is the data?", None, None, "", 8),
    ("about", None, None, "all", 6),
    ("errors of the system", "2024-01-20", "2024-03-15", "all", 4),
    ("people and time", None, None, "SRC_3", 5),
    ("que es el agua", None, "2024-02-15", "src_7", 3),
    ("src_5 the", None, None, "all", 7),
    ("world", None, None, "a$b", 5),
    ("les enfants", None, None, "all", 20),
)


def requests(s: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(REQUESTS)]
    made = s.createDataFrame(rows, "query_id bigint, text string, low string, high string, department string, k int")
    return made.withColumn("low", F.col("low").cast("date")).withColumn("high", F.col("high").cast("date"))


def semantic(s: SparkSession, d: str):
    """Ranks by the vector of a number that the request and variant tell: a stand-in for embedding their text."""
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    known = table(s, d, "documents").select("doc_id")

    def ranked(asked: DataFrame, k: int) -> DataFrame:
        one = asked.select((F.col("query_id") * search.LEXICAL_RUNS + F.col("variant")).alias("query_id"), (F.col("query_id") * 7 + F.col("variant")).alias("vec"))
        mine = one.join(vectors.select(F.col("doc_id").alias("vec"), "embedding"), "vec").select("query_id", "embedding")
        found = retrieve.knn(vectors.join(known, "doc_id", "left_semi"), mine, k)
        key = F.col("query_id")
        return found.select(F.floor(key / search.LEXICAL_RUNS).cast("bigint").alias("query_id"), F.pmod(key, F.lit(search.LEXICAL_RUNS)).cast("int").alias("variant"), "doc_id", "rank")

    return ranked


def corpus(s: SparkSession, d: str) -> search.Corpus:
    return search.Corpus(chunk_fields(s, d), semantic(s, d))


def variant_rows(s: SparkSession) -> DataFrame:
    """Variants without corrections of typing errors, which depend on the corpus."""
    return search.query_variants(requests(s).select("query_id", "text"))


def search_full(s: SparkSession, d: str) -> DataFrame:
    return search.retrieve_batch(corpus(s, d), requests(s), variant_rows(s))


def search_grouped(s: SparkSession, d: str) -> DataFrame:
    return search.search_batch(corpus(s, d), requests(s), variant_rows(s))


def corrected_variants(s: SparkSession, d: str) -> DataFrame:
    """Variants of queries with a typing error, corrected by the corpus's words."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.substring_index("text", " ", 3), F.lit("x")).alias("text"))
    made = corpus(s, d)
    return search.query_variants(asked, made.vocabulary())


def date_only(s: SparkSession, d: str) -> DataFrame:
    asked = search.request("", "2024-01-10", "20/02/2024", "all", 0)
    return search.date_batch(chunk_fields(s, d), asked).select("doc_id", "group_key")


# ---- the DuckDB form ----------------------------------------------------------------------------------------------


def text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(str(v) for v in r) + ')' for r in rows)}) v({names})"


def strings(items) -> str:
    return f"[{', '.join(text(x) for x in items)}]::VARCHAR[]"


def request_rows(ks: list[int]) -> list[tuple]:
    out = []
    for i, ((query, low, high, department, _), k) in enumerate(zip(REQUESTS, ks, strict=True)):
        told = variants(query)
        w = words(query)
        short = 1 <= len(w) <= search.SHORT_TOKENS
        asked = [words(q) for q in rerank_queries(query, [t for t, *_ in told])]
        base = max(retrieve.RERANK_N, 4 * k)
        pool = max(base, 20 * k, 100) if low or high else base
        out.append((i, low, high, department, k, w, short, asked, exact_token(query), base, pool))
    return out


def plan_sql(ks: list[int]) -> str:
    rows = [
        (i, f"{text(low)}::DATE", f"{text(high)}::DATE", text(department), k, strings(w), str(short).lower(), "[" + ", ".join(strings(a) for a in asked) + "]", text(exact), base, pool)
        for i, low, high, department, k, w, short, asked, exact, base, pool in request_rows(ks)
    ]
    return f"""r0 AS (SELECT * FROM {values(rows, 'query_id, low, high, department, k, tokens, short, asked, exact, base, pool')}),
plan AS (SELECT *, {q_filter('department')} AS wanted, low IS NOT NULL OR high IS NOT NULL AS dated FROM r0),
pools AS (SELECT *, greatest(64, pool, CASE WHEN short THEN 80 ELSE 0 END, CASE WHEN wanted <> 'all' THEN 150 ELSE 0 END) AS semantic_k, greatest(40, pool, CASE WHEN short THEN 120 ELSE 0 END, CASE WHEN wanted <> 'all' THEN 150 ELSE 0 END) AS lexical_k,
  CASE WHEN short THEN 0.55 ELSE 0.8 END AS semantic_weight, CASE WHEN short THEN 0.45 ELSE 0.2 END AS lexical_weight FROM plan WHERE wanted IS NOT NULL)"""


def variants_sql() -> str:
    rows = [(i, n, text(t), a, b) for i, (query, *_) in enumerate(REQUESTS) for n, (t, a, b) in enumerate(variants(query))]
    return f"variants AS (SELECT * FROM {values(rows, 'query_id, variant, text, semantic, lexical')})"


ASKED = "SELECT query_id * 100 + variant AS query_id, text FROM variants WHERE lexical > 0"


def full_sql(ks: list[int]) -> str:
    """The plan with so many results for each request."""
    return f"""WITH {BM25} {CHUNKS}, {variants_sql()}, {plan_sql(ks)}, {bm25_sql('lex', ASKED, 300)},
vec AS (SELECT v.query_id, v.variant, e.embedding FROM variants v JOIN embeddings e ON e.vec_id = v.query_id * 7 + v.variant WHERE semantic > 0),
sims AS (SELECT v.query_id, v.variant, e.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM vec v, embeddings e SEMI JOIN documents d ON d.doc_id = e.vec_id),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM sims),
lists AS (SELECT s.query_id, doc_id, rank, s.variant AS run, semantic_weight * v.semantic AS weight, 'semantic' AS kind FROM sem s JOIN pools p USING (query_id) JOIN variants v ON v.query_id = s.query_id AND v.variant = s.variant WHERE rank <= semantic_k
UNION ALL SELECT l.query_id // 100, doc_id, rank, 100 + l.query_id % 100, lexical_weight * v.lexical, 'lexical' FROM lex l JOIN pools p ON p.query_id = l.query_id // 100 JOIN variants v ON v.query_id = l.query_id // 100 AND v.variant = l.query_id % 100 WHERE rank <= lexical_k),
everything AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 8) AS fused_score, min(run * 1000000 + rank) AS seq FROM lists GROUP BY ALL),
c AS (SELECT *, coalesce(lower(trim(source_type)) IN ('html', 'pdf'), false) AS page, {q_department('department')} AS dep, last_updated::TIMESTAMP::DATE AS day, {q_normalize('text')} AS own, {q_normalize("coalesce(page_title, '')")} AS title FROM chunk),
passing AS (SELECT e.query_id, e.doc_id FROM (SELECT DISTINCT query_id, doc_id FROM lists) e JOIN pools p USING (query_id) JOIN c USING (doc_id)
  WHERE (NOT dated OR (NOT page AND (low IS NULL OR day >= low) AND (high IS NULL OR day <= high))) AND (wanted = 'all' OR dep = wanted)),
fused AS (SELECT e.query_id, e.doc_id, fused_score, row_number() OVER (PARTITION BY e.query_id ORDER BY fused_score DESC, e.seq, e.doc_id) AS fused_rank FROM everything e SEMI JOIN passing x ON x.query_id = e.query_id AND x.doc_id = e.doc_id),
kept AS (SELECT f.query_id, doc_id, fused_score, fused_rank AS seq FROM fused f JOIN pools p USING (query_id) WHERE fused_rank <= base),
semantic AS (SELECT query_id, doc_id, min(run * 1000000 + rank) AS o FROM lists l SEMI JOIN passing x ON x.query_id = l.query_id AND x.doc_id = l.doc_id WHERE kind = 'semantic' GROUP BY ALL),
unseen AS (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY o) AS place FROM semantic s ANTI JOIN kept k ON k.query_id = s.query_id AND k.doc_id = s.doc_id),
cand AS (SELECT * FROM kept UNION ALL SELECT u.query_id, u.doc_id, coalesce(fused_score, 0.0), 100000 + place FROM unseen u LEFT JOIN everything e ON e.query_id = u.query_id AND e.doc_id = u.doc_id WHERE place <= 24),
toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(concat_ws(chr(10), text, page_title, source, subject))), '[a-z0-9_./+\\-]+') AS t FROM chunk),
holding AS (SELECT DISTINCT l.query_id, l.doc_id FROM lists l JOIN pools p USING (query_id) JOIN toks USING (doc_id) WHERE exact IS NOT NULL AND list_contains(t, exact)),
have AS (SELECT query_id, count(*) AS have FROM cand c SEMI JOIN holding h ON h.query_id = c.query_id AND h.doc_id = c.doc_id GROUP BY ALL),
lexical AS (SELECT query_id, doc_id, min(run * 1000000 + rank) AS o FROM lists WHERE kind = 'lexical' GROUP BY ALL),
more AS (SELECT l.query_id, l.doc_id, row_number() OVER (PARTITION BY l.query_id ORDER BY o) AS place FROM (SELECT * FROM lexical l SEMI JOIN holding h ON h.query_id = l.query_id AND h.doc_id = l.doc_id) l ANTI JOIN cand c ON c.query_id = l.query_id AND c.doc_id = l.doc_id),
every AS (SELECT * FROM cand UNION ALL SELECT m.query_id, m.doc_id, coalesce(f.fused_score, 0.0), 200000 + place FROM more m LEFT JOIN have USING (query_id) LEFT JOIN fused f ON f.query_id = m.query_id AND f.doc_id = m.doc_id WHERE place <= 8 AND place + coalesce(have, 0) <= 3),
read AS (SELECT *, list_distinct(regexp_extract_all(strip_accents(lower(CASE WHEN page AND title <> '' AND NOT contains(lower(own), lower(title)) THEN title || ' ' || own ELSE own END)), '[a-z0-9_./+\\-]+')) AS dt, len(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_./+\\-]+')) AS size, strip_accents(lower(title)) AS low_title FROM c),
hints AS (SELECT query_id, list(h) AS hints FROM (SELECT query_id, {q_department('w')} AS h FROM (SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_-]+')) AS w FROM variants WHERE variant = 0) WHERE length(w) BETWEEN 3 AND 32) GROUP BY ALL),
scored AS (SELECT e.*, k, list_max(list_transform(asked, lambda q: round(len(list_intersect(list_distinct(q), dt)) / greatest(len(list_distinct(q)), 1), 6))) AS best,
  CASE WHEN wanted = 'all' AND list_contains(hints, dep) THEN 5.0 ELSE 0 END + CASE WHEN h.doc_id IS NOT NULL THEN 2.5 ELSE 0 END + CASE WHEN short AND page THEN CASE WHEN size < 6 OR length(own) < 80 THEN -6.0 ELSE
  CASE WHEN low_title <> '' AND len(list_filter(tokens, lambda t: NOT contains(low_title, t))) = 0 THEN 1.5 ELSE 0 END + CASE WHEN page_number IN (1, 2) AND chunk_in_page = 0 THEN 1.0 ELSE 0 END + CASE WHEN length(own) >= 160 THEN 0.5 ELSE 0 END END ELSE 0 END AS boost
  FROM every e JOIN pools p USING (query_id) JOIN read USING (doc_id) LEFT JOIN hints USING (query_id) LEFT JOIN holding h ON h.query_id = e.query_id AND h.doc_id = e.doc_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(best + boost, 6) DESC, fused_score DESC, seq, doc_id) AS rank, doc_id, fused_score, round(best + boost, 6)::DOUBLE AS rerank_score, k FROM scored)
SELECT query_id, rank, doc_id, fused_score, rerank_score FROM ranked WHERE rank <= k"""


def grouped_sql() -> str:
    """One chunk a group: of each request the first number of fetched chunks that fills its groups, or the last that is tried."""
    wanted, levels = [k for *_, k in REQUESTS], [[search.overfetch(k) for *_, k in REQUESTS]]
    for _ in range(search.FETCH_STEPS):
        levels.append([search.next_overfetch(now, k) for now, k in zip(levels[-1], wanted, strict=True)])
    asked = values([(i, k, n, now[i], n == search.FETCH_STEPS or levels[n + 1][i] <= now[i]) for n, now in enumerate(levels) for i, k in enumerate(wanted)], "query_id, wanted, level, fetched, final")
    every = " UNION ALL ".join(f"SELECT {n} AS level, * FROM ({full_sql(now)})" for n, now in enumerate(levels))
    key = f"""coalesce('ticket:' || nullif(trim(ticket_id::VARCHAR), ''), 'conversation:' || nullif(trim(conversation_id), ''), 'source:' || nullif(trim(source), ''),
      'fallback:' || sha1(coalesce(nullif(trim(chunk_id), ''), '') || '|' || substr({q_normalize("coalesce(text, '')")}, 1, 80)))"""
    return f"""WITH {CHUNKS}, keys AS (SELECT doc_id, {key} AS group_key FROM chunk), asked AS (SELECT * FROM {asked}),
found AS (SELECT f.*, group_key, wanted, final FROM ({every}) f JOIN keys USING (doc_id) JOIN asked a ON a.level = f.level AND a.query_id = f.query_id),
first AS (SELECT *, row_number() OVER (PARTITION BY level, query_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY level, query_id, group_key ORDER BY rank) AS n FROM found) WHERE n = 1),
told AS (SELECT a.level, a.query_id, a.final OR count(f.doc_id) < a.wanted OR count(DISTINCT f.group_key) >= a.wanted AS ends FROM asked a LEFT JOIN found f ON f.level = a.level AND f.query_id = a.query_id GROUP BY a.level, a.query_id, a.final, a.wanted),
chosen AS (SELECT query_id, min(level) AS level FROM told WHERE ends GROUP BY query_id)
SELECT query_id, place AS rank, doc_id, group_key, fused_score, rerank_score FROM first SEMI JOIN chosen c ON c.query_id = first.query_id AND c.level = first.level WHERE place <= wanted"""


FULL = full_sql([k for *_, k in REQUESTS])
DATE_ONLY = f"""WITH {CHUNKS}, g AS (SELECT doc_id, last_updated, ticket_id, 'ticket:' || ticket_id AS group_key FROM chunk WHERE source_type IS NULL AND last_updated::TIMESTAMP::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-02-20')
SELECT doc_id, group_key FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY last_updated DESC, doc_id) AS n FROM g) WHERE n = 1"""

QUERIES = {"search_full": settled(search_full), "search_grouped": settled(search_grouped), "search_by_date": date_only, "corrected_variants": settled(corrected_variants)}
ORACLE_SQL = {"search_full": FULL, "search_grouped": grouped_sql(), "search_by_date": DATE_ONLY}
