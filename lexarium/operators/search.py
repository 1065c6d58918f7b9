"""The whole search plan: request checks, query variants, filters, rescues, boosts, grouping and its adaptive pools."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.functions import dates, ids, text
from lexarium.functions.ids import blank_to_null
from lexarium.operators import retrieve
from lexarium.operators.variants import exact_token, rerank_queries, variants
from lexarium.storage import stored

# Most rows that an over-fetched request asks for, the factor, how often it is doubled, most rescued rows.
FETCH_MOST, FETCH_FACTOR, FETCH_STEPS, EXACT_RESCUE = 300, 4, 3, 8
DEPARTMENT_POOL, SHORT_TOKENS = 150, 2
#: Lists of a query: semantic ones by variant, then lexical ones.
LEXICAL_RUNS = 100

#: What the plan reads of a chunk besides ``doc_id`` and ``text``; a missing column counts as null.
CHUNK = (
    "department string, source_type string, last_updated string, page_title string, source string, subject string, page_number int, "
    "chunk_in_page int, char_len bigint, ticket_id bigint, conversation_id string, chunk_id string"
)
VARIANTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("semantic", T.DoubleType()), T.StructField("lexical", T.DoubleType())]))


@dataclass(frozen=True)
class Request:
    query: str
    low: date | None
    high: date | None
    department: str
    k: int | None


def request(query: str | None, date_from: str | None = None, date_to: str | None = None, department: str | None = "all", k: int | None = None) -> Request:
    """Checked arguments of a search; a ``ValueError`` says what is wrong with them."""
    asked = (query or "").strip()
    low, high = dates.filter_date(date_from, "date_from"), dates.filter_date(date_to, "date_to")
    if not asked and not (low or high):
        raise ValueError("a query or a date is needed")
    if low and high and low > high:
        raise ValueError("date_from must not be after date_to")
    if asked and k == 0:
        raise ValueError("k = 0 is for searches by date only")
    named = (department or "").strip().lower() or "all"
    wanted = named if named == "all" else ids.valid_name(named)
    if wanted is None:
        raise ValueError(f"invalid department: one of {', '.join(ids.DEPARTMENTS)}, or 3 to 32 lower-case letters, digits, _ or -")
    # A search by date alone takes 0 for all; a query takes what is no number of results for the default.
    return Request(asked, low, high, wanted, retrieve.FINAL_K if asked and k is not None and k < 0 else k)


def department_filter(c: Column) -> Column:
    """A filter's department: ``all`` (also where blank), a normalised valid name, or null for an invalid one."""
    raw = F.lower(blank_to_null(c))
    return F.when(raw.isNull() | (raw == "all"), "all").otherwise(ids.valid_department(c))


def department_matches(own: Column, wanted: Column) -> Column:
    """Whether a row's department passes a filter; an invalid filter passes nothing."""
    told = department_filter(wanted)
    return F.coalesce((told == "all") | (ids.department(own, True) == told), F.lit(False))


def not_ticket(source_type: Column) -> Column:
    return F.coalesce(F.lower(blank_to_null(source_type)).isin("html", "pdf"), F.lit(False))


def holds_token(token: Column, *parts: Column) -> Column:
    """Whether one of the texts has the token."""
    every = F.concat_ws("\n", *[text.normalize(F.coalesce(p, F.lit(""))) for p in parts])
    return F.coalesce(F.array_contains(text.tokens(every), token), F.lit(False))


def group_key(ticket: Column, conversation: Column, source: Column, chunk: Column, body: Column) -> Column:
    """What results are grouped by: ticket, conversation, source, else chunk and beginning of the text."""
    named = lambda name, c: F.concat(F.lit(f"{name}:"), blank_to_null(c))
    last = F.concat(F.coalesce(blank_to_null(chunk), F.lit("")), F.lit("|"), F.substring(text.normalize(F.coalesce(body, F.lit(""))), 1, 80))
    return F.coalesce(named("ticket", ticket), named("conversation", conversation), named("source", source), F.concat(F.lit("fallback:"), F.sha1(last.cast("binary"))))


def rerank_text(body: Column, title: Column, source_type: Column) -> Column:
    """What a reranker reads of a chunk: a page's title comes first where its text lacks it."""
    own, name = text.normalize(F.coalesce(body, F.lit(""))), text.normalize(F.coalesce(title, F.lit("")))
    lacking = not_ticket(source_type) & (name != "") & ~F.contains(F.lower(own), F.lower(name))
    return F.when(lacking, F.when(own == "", name).otherwise(F.concat_ws("\n\n", name, own))).otherwise(own)


def overfetch(k: int, has_query: bool = True) -> int:
    return max(k, min(FETCH_MOST, k * FETCH_FACTOR)) if has_query and k > 0 else k


def next_overfetch(now: int, k: int) -> int:
    return min(FETCH_MOST, max(k, k * FETCH_FACTOR, now * 2))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row in ``order``: a distinct union that keeps it."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def ordered_departments(rows: DataFrame, column: str = "department") -> DataFrame:
    """``(place, department)``: ``all``, the known departments that occur in their fixed order, the others by name."""
    found = rows.select(department_filter(F.col(column)).alias("department")).where("department <> 'all'").distinct()
    every = found.union(rows.sparkSession.createDataFrame([("all",)], "department string"))
    fixed = F.array_position(F.array(*[F.lit(d) for d in ("all", *ids.DEPARTMENTS)]), F.col("department"))
    order = F.when(fixed > 0, fixed).otherwise(len(ids.DEPARTMENTS) + 2)
    return every.select((F.row_number().over(Window.orderBy(order, "department")) - 1).alias("place"), "department")


def result_kind(source_type: Column, source: Column) -> Column:
    """How a result is shown: web, pdf or ticket."""
    kind = F.lower(blank_to_null(source_type))
    pdf = F.regexp_like(F.lower(blank_to_null(source)), F.lit(r"\.pdf(?:$|[?#])"))
    return F.when(kind == "html", "web").when((kind == "pdf") | pdf, "pdf").otherwise("ticket")


def result_order(by_date: bool = False) -> list[Column]:
    """Order of shown results: by rank, score and place; ``by_date`` the newest first, those without a date last."""
    order = [F.asc_nulls_last("rank"), F.desc_nulls_last("rerank_score"), F.asc("place")]
    return [F.desc_nulls_last(F.to_timestamp("last_updated"))] + order if by_date else order


# ---- variants of queries -------------------------------------------------------------------------------------------


@F.udf(VARIANTS, useArrow=True)
def variants_of(query: str | None, corrections: dict | None):
    fixes = corrections or {}
    return [{"text": t, "semantic": s, "lexical": x} for t, s, x in variants(query or "", fixes.get)]


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def rerank_queries_of(query: str | None, more: list | None):
    return rerank_queries(query or "", list(more or []))


@F.udf(T.StringType(), useArrow=True)
def exact_token_of(query: str | None):
    return exact_token(query or "")


def corrections(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(query_id, fixes map<string,string>)``: the correction of each word of a query that has one."""
    told = queries.select("query_id", F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    fixed = told.join(retrieve.typo_candidates(told.select("word").distinct(), vocabulary), "word")
    return fixed.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "correction"))).alias("fixes"))


def query_variants(queries: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(query_id, variant, text, semantic, lexical)`` of ``queries(query_id, text)``, the query itself as variant 0."""
    if vocabulary is None:
        held = queries.withColumn("fixes", F.lit(None).cast("map<string,string>"))
    else:
        held = queries.join(corrections(queries, vocabulary), "query_id", "left")
    return held.select("query_id", F.posexplode(variants_of("text", "fixes")).alias("variant", "v")).select("query_id", "variant", "v.*")


# ---- the plan ------------------------------------------------------------------------------------------------------

Semantic = Callable[[DataFrame, int], DataFrame]


class Corpus:
    """Chunks with their lexical index, stored once, and a function that ranks chunks by vectors.

    ``semantic(asked, k)`` takes ``(query_id, variant, text)`` and returns ``(query_id, variant, doc_id, rank)``: embedding a text
    is the caller's part.
    """

    def __init__(self, chunks: DataFrame, semantic: Semantic):
        missing = [f for f in T._parse_datatype_string(CHUNK) if f.name not in chunks.columns]
        self.chunks = chunks.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        self.index = retrieve.LexicalIndex.build(chunks.select("doc_id", "text"))
        self.semantic = semantic

    def vocabulary(self) -> DataFrame:
        return self.index.postings.groupBy("token").agg(F.sum("tf").alias("frequency"))

    def lexical(self, asked: DataFrame, k: int) -> DataFrame:
        """As ``semantic``, by BM25."""
        one = asked.select((F.col("query_id") * LEXICAL_RUNS + F.col("variant")).alias("query_id"), "text")
        found = retrieve.bm25_top(self.index, one, k)
        return found.select(
            F.floor(F.col("query_id") / LEXICAL_RUNS).cast("bigint").alias("query_id"), F.pmod("query_id", F.lit(LEXICAL_RUNS)).cast("int").alias("variant"), "doc_id", "rank"
        )


def plan_of(requests: DataFrame, variants_table: DataFrame) -> DataFrame:
    """Requests with what the plan needs of them: tokens, rerank texts, exact token, pools and weights."""
    requests = requests.withColumn("k", F.when(F.col("k") > 0, F.col("k")).otherwise(retrieve.FINAL_K))
    told = variants_table.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "text"))), lambda x: x["text"]).alias("_texts"))
    r = requests.join(told, "query_id").withColumn("tokens", text.tokens(F.col("text")))
    r = r.withColumn("wanted", department_filter(F.col("department"))).where("wanted is not null").drop("department")
    r = r.withColumn("short", F.size("tokens").between(1, SHORT_TOKENS)).withColumn("dated", F.col("low").isNotNull() | F.col("high").isNotNull())
    r = r.withColumn("asked", rerank_queries_of("text", "_texts")).withColumn("exact", exact_token_of("text")).drop("_texts")
    base = F.greatest(F.lit(retrieve.RERANK_N), F.col("k") * 4)
    pool = F.when(F.col("dated"), F.greatest(base, F.col("k") * 20, F.lit(100))).otherwise(base)
    wide = F.when(F.col("wanted") != "all", DEPARTMENT_POOL).otherwise(0)
    return r.withColumns(
        {
            "semantic_k": F.greatest(F.lit(retrieve.SEMANTIC_K), pool, F.when(F.col("short"), 80).otherwise(0), wide),
            "lexical_k": F.greatest(F.lit(retrieve.LEXICAL_K), pool, F.when(F.col("short"), 120).otherwise(0), wide),
            "semantic_weight": F.when(F.col("short"), 0.55).otherwise(retrieve.SEMANTIC_WEIGHT),
            "lexical_weight": F.when(F.col("short"), 0.45).otherwise(retrieve.LEXICAL_WEIGHT),
            "candidates": base,
        }
    )


def _lists(corpus: Corpus, plan: DataFrame, variants_table: DataFrame) -> DataFrame:
    """All ranked lists of all variants as ``(query_id, doc_id, rank, run, weight, kind)``, cut to each request's pools."""
    most = plan.agg(F.max("semantic_k"), F.max("lexical_k")).first()
    asked = variants_table.join(plan.select("query_id"), "query_id", "left_semi")
    out = None
    for kind, find, k in (("semantic", corpus.semantic, most[0] or 1), ("lexical", corpus.lexical, most[1] or 1)):
        found = find(asked.where(F.col(kind) > 0), k).join(asked.select("query_id", "variant", F.col(kind).alias("_w")), ["query_id", "variant"])
        found = found.join(plan.select("query_id", F.col(f"{kind}_k").alias("_k"), F.col(f"{kind}_weight").alias("_base")), "query_id").where("rank <= _k")
        run = F.col("variant") + (LEXICAL_RUNS if kind == "lexical" else 0)
        part = found.select("query_id", "doc_id", F.col("rank").cast("int"), run.cast("int").alias("run"), (F.col("_base") * F.col("_w")).alias("weight"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return stored(out, "ranked-lists")


def _passing(rows: DataFrame, plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows ``(query_id, doc_id, ...)`` whose chunk passes its request's filters."""
    own = chunks.select("doc_id", F.to_date(dates.parse(F.col("last_updated"))).alias("_day"), not_ticket(F.col("source_type")).alias("_page"), ids.department(F.col("department"), True).alias("_dep"))
    held = rows.join(plan.select("query_id", "low", "high", "dated", "wanted"), "query_id").join(own, "doc_id")
    low, high = F.coalesce(F.col("_day") >= F.col("low"), F.col("low").isNull()), F.coalesce(F.col("_day") <= F.col("high"), F.col("high").isNull())
    in_time = ~F.col("dated") | (F.col("_day").isNotNull() & low & high & ~F.col("_page"))
    right = (F.col("wanted") == "all") | F.coalesce(F.col("_dep") == F.col("wanted"), F.lit(False))
    return held.where(in_time & right).select(rows.columns)


def retrieve_batch(corpus: Corpus, requests: DataFrame, variants_table: DataFrame | None = None, score=retrieve.overlap_score) -> DataFrame:
    """The best chunks of each request: ``(query_id, rank, doc_id, fused_score, rerank_score)``.

    ``requests(query_id, text, low date, high date, department, k)``; ``department`` is ``all`` or blank for no filter, an invalid one
    finds nothing; a ``k`` of 0 or less, or none, is ``FINAL_K``. Lists of all variants are fused by weighted reciprocal ranks, filtered by date (pages
    are no part of a dated search) and department, filled by semantic and by exact matches (these are not
    filtered), reranked by the best of a query's forms plus boosts, and cut. Ties go to the earlier candidate.
    """
    if variants_table is None:
        variants_table = stored(query_variants(requests.select("query_id", "text"), corpus.vocabulary()), "query-variants")
    plan = stored(plan_of(requests, variants_table), "search-plan")
    lists = _lists(corpus, plan, variants_table)
    chunks = corpus.chunks.join(lists.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = stored(chunks.withColumn("page", not_ticket(F.col("source_type"))), "listed-chunks")
    everything = stored(retrieve.fuse_runs(lists), "fused-lists")
    fused = _passing(everything, plan, chunks)
    fused = fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank")))
    semantic = first_seen(lists.where("kind = 'semantic'"), ["query_id", "doc_id"], ["run", "rank"])
    semantic = _passing(semantic.select("query_id", "doc_id", "run", "rank"), plan, chunks)
    # Candidates: the first fused ones, then semantic ones that are not among them.
    kept = fused.join(plan.select("query_id", "candidates"), "query_id").where("fused_rank <= candidates")
    kept = stored(kept.select("query_id", "doc_id", "fused_score", F.col("fused_rank").cast("long").alias("seq")), "kept")
    unseen = semantic.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    unseen = unseen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("run", "rank"))).where(F.col("place") <= retrieve.RESCUE_K)
    # Scores of rescued chunks are those after the filters, which they pass themselves.
    scores = everything.select("query_id", "doc_id", "fused_score")
    filled = unseen.join(scores, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce("fused_score", F.lit(0.0)).alias("fused_score"), (F.col("place") + 100_000).cast("long").alias("seq")
    )
    candidates = stored(kept.unionByName(filled), "candidates")
    # Chunks that hold a query's one token.
    tokened = plan.where("exact is not null").select("query_id", "exact")
    holding = lists.select("query_id", "doc_id").distinct().join(tokened, "query_id").join(chunks, "doc_id")
    holding = stored(holding.where(holds_token(F.col("exact"), *[F.col(c) for c in ("text", "page_title", "source", "subject")])).select("query_id", "doc_id"), "exact-matches")
    have = candidates.join(holding, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("have"))
    lexical = first_seen(lists.where("kind = 'lexical'"), ["query_id", "doc_id"], ["run", "rank"])
    more = lexical.join(holding, ["query_id", "doc_id"], "left_semi").join(candidates, ["query_id", "doc_id"], "left_anti").join(have, "query_id", "left")
    more = more.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("run", "rank")))
    more = more.where((F.col("place") <= EXACT_RESCUE) & (F.col("place") + F.coalesce("have", F.lit(0)) <= retrieve.EXACT_MATCHES))
    passed = fused.select("query_id", "doc_id", "fused_score")
    more = more.join(passed, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce("fused_score", F.lit(0.0)).alias("fused_score"), (F.col("place") + 200_000).cast("long").alias("seq")
    )
    return _ranked(candidates.unionByName(more), plan, chunks, holding, score)


def _ranked(candidates: DataFrame, plan: DataFrame, chunks: DataFrame, holding: DataFrame, score) -> DataFrame:
    c = F.col
    read = stored(
        chunks.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select(
            "*", F.array_distinct(text.tokens(rerank_text(c("text"), c("page_title"), c("source_type")))).alias("dt"), text.fold(F.coalesce("page_title", F.lit(""))).alias("_title"),
            F.size(text.tokens(c("text"))).alias("_size"), F.when(c("char_len") > 0, c("char_len")).otherwise(F.length(text.normalize(c("text")))).alias("_chars"),
            ids.department(c("department"), True).alias("_dep"),
        ),
        "candidate-chunks",
    )
    hints = F.filter(F.transform(F.regexp_extract_all(text.fold(c("text")), F.lit("[a-z0-9_-]+"), F.lit(0)), lambda x: F.when(F.length(x).between(3, 32), x)), lambda x: x.isNotNull())
    asked = plan.select(
        "query_id", "k", F.when(c("short"), c("tokens")).alias("tokens"), F.transform("asked", lambda x: text.tokens(x)).alias("asked"),
        F.when(c("wanted") == "all", F.transform(hints, lambda x: ids.department(x, True))).alias("hints"),
    )
    rows = candidates.join(asked, "query_id").join(read.drop("k", "text"), "doc_id").join(holding.withColumn("holds", F.lit(True)), ["query_id", "doc_id"], "left")
    best = F.array_max(F.transform("asked", lambda q: score(q, c("dt"))))
    little = (c("_size") < retrieve.LOW_INFO_TOKENS) | (c("_chars") < retrieve.LOW_INFO_CHARS)
    named = (c("_title") != "") & F.forall("tokens", lambda t: F.contains(c("_title"), t))
    good = (
        F.when(named, retrieve.TITLE_BOOST).otherwise(0.0)
        + F.when(c("page_number").isin(1, 2) & (F.coalesce("chunk_in_page", F.lit(0)) == 0), retrieve.INTRO_BOOST).otherwise(0.0)
        + F.when(c("_chars") >= retrieve.LENGTH_FROM, retrieve.LENGTH_BOOST).otherwise(0.0)
    )
    brief = F.when(c("tokens").isNotNull() & c("page"), F.when(little, -retrieve.LOW_INFO_PENALTY).otherwise(good)).otherwise(0.0)
    hinted = F.when(F.coalesce(F.array_contains("hints", c("_dep")), F.lit(False)), retrieve.DEPARTMENT_BOOST).otherwise(0.0)
    exact = F.when(c("holds"), retrieve.EXACT_BONUS).otherwise(0.0)
    rows = rows.withColumn("rerank_score", F.round(best + hinted + brief + exact, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), "seq", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("query_id", "rank", "doc_id", "fused_score", "rerank_score")


def search_batch(corpus: Corpus, requests: DataFrame, variants_table: DataFrame | None = None) -> DataFrame:
    """As ``retrieve_batch`` with one chunk a ticket, conversation or source: ``group_key``, ranks from 1 on.

    More chunks than ``k`` are fetched; requests whose groups are still too few while chunks were not are run again with
    twice as many, up to ``FETCH_STEPS`` times and ``FETCH_MOST`` chunks.
    """
    if variants_table is None:
        variants_table = stored(query_variants(requests.select("query_id", "text"), corpus.vocabulary()), "query-variants")
    c = F.col
    keys = corpus.chunks.select("doc_id", group_key(c("ticket_id"), c("conversation_id"), c("source"), c("chunk_id"), c("text")).alias("group_key"))

    def grouped(asked: DataFrame, fetch: Column) -> tuple[DataFrame, DataFrame]:
        found = stored(retrieve_batch(corpus, asked.withColumn("k", fetch), variants_table).join(asked.select("query_id", "k"), "query_id"), "search-chunks")
        first = first_seen(found.join(keys, "doc_id"), ["query_id", "group_key"], ["rank"])
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        out = stored(first.withColumn("rank", place).where("rank <= k"), "search-groups")
        told = asked.join(found.groupBy("query_id").agg(F.count("*").alias("_all")), "query_id", "left").join(out.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left")
        return out, told.where("coalesce(_all, 0) >= k and coalesce(_n, 0) < k").drop("_all", "_n")

    fetch = F.greatest("k", F.least(F.lit(FETCH_MOST), F.col("k") * FETCH_FACTOR))
    asked = requests.withColumn("_fetch", fetch)
    out, lacking = grouped(asked, F.col("_fetch"))
    for _ in range(FETCH_STEPS):
        wider = F.least(F.lit(FETCH_MOST), F.greatest("k", F.col("k") * FETCH_FACTOR, F.col("_fetch") * 2))
        lacking = stored(lacking.where(wider > F.col("_fetch")).withColumn("_fetch", wider), "lacking-requests")
        if lacking.isEmpty():
            break
        more, next_lacking = grouped(lacking, F.col("_fetch"))
        out = stored(out.join(lacking.select("query_id"), "query_id", "left_anti").unionByName(more), "search-groups")
        lacking = next_lacking
    return out.select("query_id", "rank", "doc_id", "group_key", "fused_score", "rerank_score")


def date_batch(chunks: DataFrame, request: Request, k: int = retrieve.FINAL_K) -> DataFrame:
    """A search by date alone: the newest chunk of each group in time and department, pages left out, newest first; scores are 0.

    The request's ``k`` of 0 means all, none or less than 0 means ``k``.
    """
    c = F.col
    stamp = dates.parse(c("last_updated"))
    rows = chunks.where(~not_ticket(c("source_type"))).withColumn("_stamp", stamp)
    rows = rows.where(F.to_date("_stamp") >= F.lit(request.low)) if request.low else rows
    rows = rows.where(F.to_date("_stamp") <= F.lit(request.high)) if request.high else rows
    rows = rows.where(department_matches(c("department"), F.lit(request.department)))
    key = group_key(c("ticket_id"), c("conversation_id"), c("source"), c("chunk_id"), c("text"))
    newest = first_seen(rows.withColumn("group_key", key).withColumn("_age", -F.unix_timestamp("_stamp")), ["group_key"], ["_age", "doc_id"])
    most = k if request.k is None or request.k < 0 else request.k
    out = newest.orderBy(F.desc_nulls_last("_stamp"), F.desc(F.coalesce(c("ticket_id").cast("string"), F.lit(""))), "doc_id")
    out = out.limit(most) if most else out
    return out.select("doc_id", "group_key", "last_updated", F.lit(0.0).alias("fused_score"), F.lit(0.0).alias("rerank_score"))


def pages_of(rows: DataFrame, order: Iterable[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows: 25 of a search's results, 8 of a catalog's."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
