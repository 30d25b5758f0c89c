"""The queries of this subpackage, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .chat_format import format_chats
from .decontaminate import decontaminate
from .jaccard_join import near_duplicates
from .language_id import identify_held_out
from .line_dedup import dedup_lines
from .minhash_forest import minhash_duplicates
from .periodic_runs import periodic_runs
from .prefix_trie import grafted, placed_words, trie_of
from .quality_classifier import classify_held_out
from .quality_rules import quality_rules
from .sentencepiece_codec import encode_decode
from .shared import scratch, settled, written
from .url_filters import filter_urls
from .warc import archive, read_archives

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query(r"""
with p as (
    select page_id, coalesce(url, '') as u, strpos(coalesce(url, ''), '://') as sep from pages
), q as (
    select page_id, case when sep = 0 then '' else substr(u, sep + 3) end as rest from p
), h as (
    select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from q
), x as (
    select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), y as (
    select *, '.' || host as dotted from x
), z as (
    select page_id, host, path, case
        when dotted like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
        when dotted like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
        when dotted like '%.net' and starts_with(path, '/es/') then 'net/es/'
        when dotted like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
        when dotted like '%.com' and starts_with(path, '/') then 'com/' end as rule from y
)
select page_id, host, path, rule,
    case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from z
""")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES) + " as rules(rule, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@query(r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
    select distinct item_id, n, list_slice(w, i, i + n - 1) as x
    from (select item_id, w, least(10, len(w)) as n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)
), dw as (
    select doc_id, i, n, list_slice(w, i, i + n - 1) as x
    from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)
), hits as (
    select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.x = bw.x
), covered as (
    select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from (select distinct doc_id, i, n from hits)) group by doc_id
), items as (
    select doc_id, count(distinct item_id) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct doc_id, item_id from hits) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(r"""
with l as (
    select doc_id, source, i, x from (select doc_id, source, unnest(string_split(text, chr(10))) as x, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as i from documents where text is not null)
), w as (
    select * from l where regexp_matches(x, '[^\x20\x09-\x0D]')
), b as (
    select x, min((doc_id, i)) as f from w group by x having count(distinct source) >= 10
), gone as (
    select w.doc_id, w.i from w join b on w.x = b.x where (w.doc_id, w.i) <> b.f
), t as (
    select l.doc_id, string_agg(l.x, chr(10) order by l.i) as kept from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i where gone.doc_id is null group by l.doc_id
), n as (
    select doc_id, count(*) as n_lines from w group by doc_id
), g as (
    select doc_id, count(*) as n_removed from gone group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
    case when text is null then null else sha256(coalesce(kept, '')) end as text_sha256
from documents d left join t using (doc_id) left join n using (doc_id) left join g using (doc_id)
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query(r"""
with r as (
    select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null
), t as (
    select conv_id, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as said,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, count(*) over (partition by conv_id) as n_turns
    from r
), p as (
    select conv_id, pos, n_turns, sha256(string_agg(said, '' order by pos) over (partition by conv_id order by pos)) as prefix from t
), e as (
    select prefix, min(conv_id) as conv_id from p where pos = n_turns group by prefix
), m as (
    select conv_id from e where prefix not in (select prefix from p where pos < n_turns)
)
select conv_id, cast((pos - 1) // 1024 as bigint) as part, any_value(n_turns) as n_turns, length(string_agg(said, '')) as n_chars, sha256(string_agg(said, '' order by pos)) as chat_sha256
from t where conv_id in (select conv_id from m) group by conv_id, (pos - 1) // 1024
""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "part", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.sha2("chat", 256).alias("chat_sha256"))


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted documents: those that labels.quality marks 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


@query("""
with p as (
    select page_id, encode(coalesce(html, '')) as b from pages
), h as (
    select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest from p
), m as (
    select *, max(page_id) over (partition by payload_digest) as last from h
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes < 1000 or page_id = last then 'response' else 'revisit' end as record_type,
    case when payload_bytes < 1000 or page_id = last then null else last end as refers_to from m
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive(table(spark, sf_dir, "pages"))
    back = read_archives(manifest, payloads=False)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def piece_model() -> str:
    """The model of op6, a file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    ids = F.array_join(F.transform("piece_ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify_held_out(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_held_out(docs).select("doc_id", "held_out", "lang_pred", "score", F.size("languages").cast("long").alias("n_languages"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query()
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def looped_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of op13: of ids whose crc32 h is divisible by 10 all words from a on repeat the first p from there.

    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10), n words. Other texts stay as they are. Words
    and numbers are columns of their own: within the function of transform() they would be made anew for each word.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    worded = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    n = F.size("words")
    begun = worded.select("doc_id", "text", "g", "words", F.when(n > 0, F.pmod("g", n)).cast("int").alias("a"))
    timed = begun.select("doc_id", "text", "words", "a", (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int").alias("p"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    looped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return timed.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = looped_texts(table(spark, sf_dir, "documents"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = periodic_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(F.col("longest.length") * 1000 / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Conversations of a family, and the number that bounds the turns taken from its first.
FAMILY, HEADS = 20, 4


@query(r"""
with t as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
    from conversations where conv_id is not null
), l as (
    -- crc32 of the decimal id by its half-bytes, the lower first; the table is that of the polynomial EDB88320
    select c, max(p) as n, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint & 15, ascii(x)::bigint >> 4]))),
        lambda crc, x: xor(crc >> 4, [TABLE][(xor(crc, x) & 15) + 1])) as crc from t group by c
), m as (
    select c, n, xor(crc, 4294967295) % 4 as h, c - ((c % 20 + 20) % 20) as b from l
), k as (
    select m.c, m.b, m.h, least(m.h, coalesce(x.n, 0)) as k from m left join m x on m.b = x.c
), r as (
    select k.c, t.p as d, role, text from k join t on t.c = k.b and t.p <= k.k
    union all
    select k.c, t.p - k.h + k.k, role, text from k join t on t.c = k.c and t.p > k.h
), s as (
    select c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, sha256(string_agg(sha256(role) || sha256(text), '' order by d) over (partition by c order by d)) as prefix from r
    union all
    select c, 0, 0, '' from m
), v as (
    select *, min(c) over (partition by d, prefix) as o, count(*) over (partition by d, prefix) as n_convs, max(d) over (partition by c) as last from s
), w as (
    select *, lag(o) over (partition by c order by d) as po from v
), e as (
    select o, d, max(po) as po, max(n_convs) as n_convs, max(words) as words, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = last), '')) as ends from w group by o, d
), kids as (
    select po, d - 1 as d, count(*) as n from e where po is not null group by po, d
), f as (
    select e.*, coalesce(kids.n, 0) as n_children from e left join kids on e.o = kids.po and e.d = kids.d
), totals as (
    -- each node counts for all nodes on the path of its name-giver
    select w.o, w.d, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.words) as saved from f join w on w.c = f.o and w.d <= f.d group by w.o, w.d
)
select f.o as conv_id, f.d as depth, f.po as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends as ends_sha256
from f join totals on f.o = totals.o and f.d = totals.d
""".replace("TABLE", "0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108"))
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        placed = written(placed_words(table(spark, sf_dir, "conversations")), "trie-turns")
        return settled(trie_of(*grafted(placed, FAMILY, HEADS)), "prefix-trie")
