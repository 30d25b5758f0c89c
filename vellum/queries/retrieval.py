"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN
from ..operators.fusion import first_payload, fuse, page, rerank_all_or_nothing, rerank_first, rerank_mixed
from ..operators.index import SearchIndex
from ..operators.lexical import and_first, bm25, grep, keyword_overlap, postings, query_tokens, snippet, substring_lane, top
from ..operators.vector import fill_missing, nearest, nearest_to_each, valid_dimension
from ..plans.hybrid import catalogue_search, hybrid, law_search, lexical_lanes, ruling_search, two_way_search
from ..session import new_folder, table
from .register import registry

QUERIES, ORACLES, query = registry()

FORM = f"' ' || trim(regexp_replace(lower(translate(text, '{ACCENTED}', '{PLAIN}')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def bm25_sql(tokens: list[str], name: str = "m", every: bool = False, prefix: bool = False, where: str = "true") -> str:
    """CTEs up to ``name``: (doc_id, score) of the documents that match."""
    tf = [f"len(string_split(replace(form, ' ', '  '), ' {t.replace(' ', '  ')}{'' if prefix else ' '}')) - 1" for t in tokens]
    idf = [f"case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end" for i in range(len(tokens))]
    score = " + ".join(f"({idf[i]}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(tokens)))
    match = (" and " if every else " or ").join(f"tf{i} > 0" for i in range(len(tokens)))
    return f"""{name}_f as (select doc_id, lang, source, text, {FORM} as form from documents),
{name}_c as (select *, case when trim(form) = '' then 0 else len(string_split(trim(form), ' ')) end as dl, {', '.join(f'{x} as tf{i}' for i, x in enumerate(tf))} from {name}_f),
{name}_w as (select count(*) as n, avg(dl) as mean, {', '.join(f'count(*) filter (tf{i} > 0) as df{i}' for i in range(len(tokens)))} from {name}_c),
{name} as (select doc_id, {score} as score from {name}_c, {name}_w where ({match}) and {where})"""


WORDS = "thereon tion heer"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


@query(f"with {bm25_sql(['the', 'er', 'ment'])} select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, doc_id) as rank from m order by rank limit 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(documents(spark, sf_dir), "text", query_tokens("the er ment")).withColumn("score", F.round("score", 6))
    return top(found, "doc_id", 20).select("doc_id", "score", "rank")


@query(f"with {bm25_sql(['the', 'er', 'ment'])} select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, doc_id) as rank from m order by rank limit 20")
def bm25_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, from the index: only blocks that may hold one of the best are read."""
    return documents_index(spark, sf_dir, "terms", "blocks").best(query_tokens("the er ment"), 20)


#: Indexes that were built in this process: one build serves all queries of a session.
_built: dict[tuple[str, str], str] = {}


def documents_index(spark: SparkSession, sf_dir: str, *parts: str) -> SearchIndex:
    """The index of the documents of a folder, built when it is first asked for; each part when it first is."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _built:
        path = new_folder(spark, "index-of-documents")
        SearchIndex(spark, path, parts).add(documents(spark, sf_dir), "doc_id", "text")
        _built[at] = path
    index = SearchIndex(spark, _built[at])
    index.ensure(*parts)
    return index


@query(f"with {bm25_sql(['the', 'er'], where=chr(39).join(['lang = ', 'en', ' and source = ', 'src3', '']))} select doc_id, round(score, 6) as score from m")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matching rows of one source; corpus figures come from all documents."""
    keep = (F.col("lang") == "en") & (F.col("source") == "src3")
    return bm25(documents(spark, sf_dir), "text", query_tokens("the er"), keep=keep).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {bm25_sql(['thti', 'onan'], prefix=True)} select doc_id, round(score, 6) as score from m")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(documents(spark, sf_dir), "text", query_tokens("Thti, onan", "rulings"), prefix=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {bm25_sql(['of the', 'with'], every=True)} select doc_id, round(score, 6) as score from m")
def phrase_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a term, both asked for: a token with inner punctuation is a phrase of its parts."""
    return bm25(documents(spark, sf_dir), "text", query_tokens("of-the with", "grep"), every=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {bm25_sql(['thti', 'onan'], prefix=True)} select doc_id, round(score, 6) as score from m")
def indexed_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As prefix_search, from the index: terms that begin so lie in one range."""
    return documents_index(spark, sf_dir, "terms").search(query_tokens("Thti, onan", "rulings"), prefix=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {bm25_sql(['of the', 'with'], every=True)} select doc_id, round(score, 6) as score from m")
def indexed_phrase_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As phrase_and_search, from the positions in the index."""
    return documents_index(spark, sf_dir, "terms").search(query_tokens("of-the with", "grep"), every=True).select("doc_id", F.round("score", 6).alias("score"))


CHANGED = "documents as (select doc_id, lang, source, case when doc_id % 5 = 0 then 'the er ' || coalesce(text, '') else text end as text from documents where doc_id % 7 <> 0)"


@query(f"with {CHANGED}, {bm25_sql(['the', 'er', 'ment'])} select doc_id, round(score, 6) as score from m")
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the terms of half of the documents, to which the others are added, in which some are replaced and some deleted; searched like one built anew."""
    docs, index = documents(spark, sf_dir).select("doc_id", "text"), SearchIndex(spark, new_folder(spark, "changing-index"), ("terms",))
    index.add(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 1"), "doc_id", "text")
    index.add(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("the er "), F.coalesce("text", F.lit("")))), "doc_id", "text")
    index.delete(docs.where("doc_id % 7 = 0").select("doc_id"))
    index.merge()
    return index.search(query_tokens("the er ment")).select("doc_id", F.round("score", 6).alias("score"))


@query("""
with f as (select p_partkey, p_name, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' as form from part),
a as (select p_partkey from f where form like '% small %' and form like '% notebook %'),
b as (select p_partkey from f where form like '% small %' or form like '% notebook %' or form like '% laptop %')
select p_partkey, 'all' as mode from a union all select p_partkey, 'any' from b where not exists (select 1 from a)
""")
def catalog_and_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both terms, else either of them or a synonym."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("described"))
    return and_first(part, "described", "small notebook").select("p_partkey", "mode")


@query("""
with c as (select doc_id, greatest(length(text) - 2, 0) as dl, (length(lower(text)) - length(replace(lower(text), 'thereon', ''))) // 7 as a,
    (length(lower(text)) - length(replace(lower(text), 'tionst', ''))) // 6 as b from documents),
w as (select count(*) as n, avg(dl) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c)
select doc_id, round(
    greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean))
  + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)), 6) as score
from c, w where a > 0 or b > 0
""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_lane(documents(spark, sf_dir), "text", "Thereon tionst on").select("doc_id", F.round("score", 6).alias("score"))


@query(ORACLES["substring_search"])
def indexed_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As substring_search, from the index: rows that hold the rarest trigrams of a token are read."""
    return documents_index(spark, sf_dir, "grams").substring("Thereon tionst on").select("doc_id", F.round("score", 6).alias("score"))


@query("select doc_id, source from documents where regexp_matches(text, '(?i)token\\s*=\\s*\"[0-9a-f]{8}') order by doc_id limit 50")
def regex_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(documents(spark, sf_dir), "text", 'token\\s*=\\s*"[0-9a-f]{8}', "doc_id", 50).select("doc_id", "source")


@query("""
with t as (select doc_id, lower(text) as x from documents),
s as (select doc_id, least(1.0, ((x like '%thereon%')::int + (x like '%tionst%')::int + (x like '%heinst%')::int) / 5.0) as score from t)
select doc_id, score from s where score > 0 order by score desc, doc_id limit 25
""")
def keyword_recommender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_overlap(documents(spark, sf_dir), "text", "thereon the tionst, HEINST", "doc_id", 25).select("doc_id", "score")


@query(f"""
with f as (select doc_id, {FORM} as form from documents), t as (select doc_id, unnest(string_split(trim(form), ' ')) as term from f where trim(form) <> '')
select doc_id, term, count(*) as tf, sum(count(*)) over (partition by doc_id) as length from t group by doc_id, term
""")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"))


@query(r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where contains(lower(text), 'than')),
p as (select *, coalesce(list_position(list_transform(w, lambda x: contains(lower(strip_accents(x)), 'than')), true), 0) as place from w),
f as (select *, greatest(place - 6, 1) as head from p)
select doc_id, case when place > 0 then case when head > 1 then '…' else '' end || array_to_string(list_transform(w[head : head + 11], lambda x: case when contains(lower(strip_accents(x)), 'than') then '[' || x || ']' else x end), ' ')
    || case when len(w) > head + 11 then '…' else '' end end as snippet from f
""")
def highlight_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.lower("text").contains("than")).select("doc_id", snippet(F.col("text"), "than").alias("snippet"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the least id: one row."""
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first().embedding)


COSINE = "round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)), 6)"


@query(f"select vec_id, {COSINE} as score, row_number() over (order by {COSINE} desc, vec_id) as rank from embeddings order by rank limit 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), 20)


@query(f"select vec_id, {COSINE} as score, row_number() over (order by {COSINE} desc, vec_id) as rank from embeddings where label = 1 order by rank limit 20")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes before the cut."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), 20, F.col("label") == 1)


@query("""
with q as (select vec_id as query, embedding::double[] as qv from embeddings where vec_id % 50 = 0),
s as (select query, vec_id, round(list_cosine_similarity(qv, embedding::double[]), 6) as score from q, embeddings where query <> vec_id)
select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from s qualify rank <= 5
""")
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_to_each(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("select label, count(*) as n, count(*) filter (len(embedding) = 64) as n_valid from embeddings group by label")
def vector_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = valid_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return checked.groupBy("label").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


LANES = f"""with {bm25_sql(['the', 'er', 'ment'], 'm')},
lane_a as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from m qualify rank <= 20),
lane_b as (select vec_id as doc_id, row_number() over (order by {COSINE} desc, vec_id) as rank from embeddings qualify rank <= 20),
s_c as (select doc_id, greatest(length(text) - 2, 0) as dl, (length(lower(text)) - length(replace(lower(text), 'ment', ''))) // 4 as a, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as b from documents),
s_w as (select count(*) as n, avg(dl) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from s_c),
s as (select doc_id, round(greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)), 6) as score from s_c, s_w where a > 0 or b > 0),
lane_c as (select doc_id, row_number() over (order by score desc, doc_id) as rank from s qualify rank <= 20),
"""


def lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows with has_text, and the lanes by terms, by vectors and by substrings: texts are read once."""
    counts, a, c = lexical_lanes(documents(spark, sf_dir), "doc_id", "text", "the er ment")
    b = nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), 20).withColumnRenamed("vec_id", "doc_id")
    return counts, a, b, c


@query(LANES + "u as (select * from lane_a union all select * from lane_b) select doc_id, round(sum(1 / (60 + rank)), 6) as rrf, count(*) as n_lanes from u group by doc_id")
def rrf_two_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b, _ = lanes(spark, sf_dir)
    return fuse([a, b], "doc_id")


THREE = LANES + """u as (select * from lane_a union all select * from lane_b union all select * from lane_c),
f as (select doc_id, round(sum(1 / (60 + rank)), 6) as rrf, count(*) as n_lanes from u group by doc_id),
pool as (select f.*, d.lang, d.source from f join documents d using (doc_id) where coalesce(d.text, '') <> '' order by rrf desc, doc_id limit 20)
"""


@query(THREE + "select doc_id, lang, source, rrf, n_lanes, row_number() over (order by rrf desc, doc_id) as place from pool")
def hybrid_three_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, vectors and substrings fused; rows that no longer exist or have no text are dropped before the cut."""
    rows, a, b, c = lanes(spark, sf_dir)
    return hybrid([a, b, c], rows, "doc_id", ["lang", "source"], 20)


RERANK = THREE + ", r as (select pool.*, quality::double as rerank from pool left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id))"


def reranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("rerank"))
    return hybrid_three_lane(spark, sf_dir).join(quality, "doc_id", "left")


@query(RERANK + ", g as (select bool_and(rerank is not null) as usable from r) select doc_id, rrf, case when usable then rerank else rrf end as score, usable as reranked, row_number() over (order by case when usable then rerank else rrf end desc, doc_id) as place from r, g where not usable or rerank >= 0.02")
def rerank_all_or_nothing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_all_or_nothing(reranked_pool(spark, sf_dir), "doc_id")


@query(RERANK + " select doc_id, rrf, rerank, row_number() over (order by rerank is null, rerank desc nulls last, rrf desc, doc_id) as place from r")
def rerank_first_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_first(reranked_pool(spark, sf_dir), "doc_id")


@query(RERANK + " select doc_id, coalesce(rerank, rrf) as score, row_number() over (order by coalesce(rerank, rrf) desc, doc_id) as place from r")
def rerank_mixed_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_mixed(reranked_pool(spark, sf_dir), "doc_id")


@query(LANES + """u as (select * from lane_a union all select * from lane_c), f as (select doc_id, round(sum(1 / (60 + rank)), 6) as rrf, count(*) as n_lanes from u group by doc_id)
select doc_id, rrf, n_lanes, row_number() over (order by rrf desc, doc_id) as place from f join documents d using (doc_id) where coalesce(d.text, '') <> '' order by place limit 20""")
def two_way_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_way_search(documents(spark, sf_dir), "doc_id", "text", "the er ment")


def substring_sql(tokens: list[str]) -> str:
    """CTEs up to ``s``: (doc_id, score) of the documents that hold a token anywhere."""
    held = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)} as sf{i}" for i, t in enumerate(tokens))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * sf{i} * 2.2 / (sf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(tokens)))
    return f"""s_c as (select doc_id, greatest(length(text) - 2, 0) as dl, {held} from documents),
s_w as (select count(*) as n, avg(dl) as mean, {', '.join(f'count(*) filter (sf{i} > 0) as d{i}' for i in range(len(tokens)))} from s_c),
s as (select doc_id, {score} as score from s_c, s_w where {' or '.join(f'sf{i} > 0' for i in range(len(tokens)))})"""


def catalogue_sql(strict: list[str], wide: list[str], parts: list[str]) -> str:
    return f"""with {bm25_sql(strict, 'a', every=True)}, {bm25_sql(wide, 'o')}, {substring_sql(parts)},
t as (select *, 'all' as mode from a union all select *, 'any' from o where not exists (select 1 from a)),
lane_t as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from t qualify rank <= 20),
lane_s as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from s qualify rank <= 20),
u as (select * from lane_t union all select * from lane_s), f as (select doc_id, round(sum(1 / (60 + rank)), 6) as rrf, count(*) as n_lanes from u group by doc_id)
select doc_id, rrf, n_lanes, row_number() over (order by rrf desc, doc_id) as place, (select min(mode) from t) as mode from f join documents d using (doc_id) where coalesce(d.text, '') <> '' order by place limit 20"""


@query(catalogue_sql(["the", "ment"], ["the", "ment"], ["the", "ment"]))
def catalogue_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all terms are found, so only these make the lane of terms."""
    return catalogue_search(documents(spark, sf_dir), "doc_id", "text", "the er ment")


@query(catalogue_sql(["the", "notebook"], ["the", "notebook", "laptop", "computador", "portatil"], ["the", "notebook"]))
def catalogue_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row has all terms: any of them counts, synonyms too."""
    return catalogue_search(documents(spark, sf_dir), "doc_id", "text", "the notebook")


@query(LANES + """u as (select * from lane_a union all select * from lane_b), f as (select doc_id, round(sum(1 / (60 + rank)), 6) as rrf from u group by doc_id),
pool as (select doc_id, rrf from f join documents d using (doc_id) where coalesce(d.text, '') <> '' order by rrf desc, doc_id limit 20),
r as (select doc_id, rrf, (doc_id % 97) / 97.0 as rerank from pool)
select doc_id, rrf, rerank as score, true as reranked, row_number() over (order by rerank desc, doc_id) as place from r where rerank >= 0.02 order by place limit 5""")
def law_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of law search; ids stand in for a model's rerank scores."""
    docs, vectors = documents(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    scores = docs.select("doc_id", (F.col("doc_id") % 97 / 97).alias("rerank"))
    return law_search(docs, vectors, scores, "doc_id", "text", "the er ment", query_vector(spark, sf_dir))


@query(f"""
with b as (select vec_id as doc_id, {COSINE} as rrf from embeddings order by rrf desc, vec_id limit 20),
r as (select doc_id, rrf, quality::double as rerank from b join documents d using (doc_id) left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id) where coalesce(d.text, '') <> '')
select doc_id, rrf, rerank, row_number() over (order by rerank is null, rerank desc nulls last, rrf desc, doc_id) as place from r order by place limit 10
""")
def ruling_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = documents(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("rerank"))
    return ruling_search(docs, vectors, quality, "doc_id", "text", "the er ment", query_vector(spark, sf_dir), 10)


@query(LANES + "u as (select doc_id, rank, 0 as lane from lane_a union all select doc_id, rank, 1 from lane_c) select doc_id, arg_min(rank, lane) as rank, min(lane) as from_lane from u group by doc_id")
def lane_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, _, c = lanes(spark, sf_dir)
    tagged = [x.withColumn("from_lane", F.lit(i).cast("long")) for i, x in enumerate((a, c))]
    return first_payload(tagged, "doc_id", ["rank", "from_lane"])


@query("""
with h as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, c_name, o_orderstatus, o_totalprice from orders join customer on o_custkey = c_custkey
    where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' and lower(c_name || ' ' || o_orderpriority) like '%urgent%')
select o_orderkey, day, c_name, o_orderstatus, (select count(*) from h) as total from h order by day desc, o_orderkey limit 20 offset 20
""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of one year's urgent orders, newest first, with the number of all of them."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    found = orders.where(year).join(customer, orders.o_custkey == customer.c_custkey).where(F.lower(F.concat_ws(" ", "c_name", "o_orderpriority")).contains("urgent"))
    rows = found.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "c_name", "o_orderstatus")
    return page(rows, [F.desc("day"), "o_orderkey"], 20, 20)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An encoder that needs no model: the length of a text, and how often it has two letters."""
    return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


@query("""
select doc_id, case when doc_id % 3 = 0 then doc_id::double when coalesce(text, '') = '' then null else length(text)::double end as v0,
    case when doc_id % 3 = 0 then 1.0 when coalesce(text, '') = '' then null else (length(text) - length(replace(text, 'a', '')))::double end as v1,
    case when doc_id % 3 = 0 then 2.0 when coalesce(text, '') = '' then null else (length(text) - length(replace(text, 'e', '')))::double end as v2 from documents
""")
def filled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has a vector; the others get one from their text."""
    given = F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id").cast("double"), F.lit(1.0), F.lit(2.0)))
    filled = fill_missing(documents(spark, sf_dir).select("doc_id", "text", given.alias("v")), "text", "v", letter_counts, 3)
    return filled.select("doc_id", *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)))
