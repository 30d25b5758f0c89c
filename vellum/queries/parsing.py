"""Parsing queries over the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, norm_slug, provision_label, provision_path, provision_ref, ruling_label, slice_if_unchanged, strip_accents, term_set
from ..operators.laws import block_class, counts_below_levels, law_provisions, law_statistics, mark_number
from ..operators.parsing import ROMAN, citation_labels, citations, diff_counts, internal_references, keep_in_force, normalised_id, provisions_of, truncate_at, word_diff
from ..operators.temporal import compared_versions, resolve_references
from ..plans.versions import version_differences
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks of a law: the number and flag of each line decide its level."""
    lines = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("Art. "), F.col("l_orderkey").cast("string"), F.lit("º Texto.")))
        .when(n == 2, F.lit("§ 1º Texto."))
        .when(n == 3, F.lit("II - texto;"))
        .when(n == 4, F.lit("a) texto;"))
        .when(n == 5, F.lit("Parágrafo único. Texto."))
        .when(n == 6, F.lit("b) texto;"))
        .otherwise(F.lit("Continuação do texto, sem marca alguma, que não é dispositivo nem título porque é longa demais."))
    )
    return lines.select(F.col("l_orderkey").alias("document"), n.alias("seq"), text.alias("text"))


@query("""
with l as (select distinct l_orderkey as document, l_linenumber as seq from lineitem), h as (select *, max(case when seq = 1 then 1 end) over (partition by document) as art,
    max(case when seq = 2 then 1 end) over (partition by document) as p1, max(case when seq = 3 then 1 end) over (partition by document) as i3, max(case when seq = 5 then 1 end) over (partition by document) as p5 from l)
select document, seq, case seq when 1 then 'article' when 2 then 'paragraph' when 3 then 'item' when 4 then 'letter' when 5 then 'paragraph' else 'letter' end as kind,
    'art' || document || case when seq >= 5 and p5 = 1 then '-parunico' when seq >= 2 and p1 = 1 then '-par1' else '' end
      || case when seq in (3, 4) and i3 = 1 then '-incII' when seq = 6 and p5 is null and i3 = 1 then '-incII' else '' end || case when seq = 4 then '-ala' when seq = 6 then '-alb' else '' end as path
from h where art = 1 and seq <= 6
""")
def provision_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = order_blocks(spark, sf_dir).withColumn("kind", block_class(F.col("text"))).withColumn("number", mark_number(F.col("kind"), F.col("text")))
    return provisions_of(blocks).select("document", "seq", "kind", "path")


@query(ORACLES["provision_hierarchy"].replace("select document, seq, case seq", ", p as (select document, seq, case seq").strip() + """)
select t.document, t.path, count(*) as n_nodes from p t join p d on d.document = t.document and (d.path = t.path or starts_with(d.path, t.path || '-')) group by t.document, t.path
""")
def provision_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provision with the number of provisions at and below it."""
    blocks = order_blocks(spark, sf_dir).withColumn("kind", block_class(F.col("text"))).withColumn("number", mark_number(F.col("kind"), F.col("text")))
    return counts_below_levels(provisions_of(blocks))


#: A browser's page header, and a heading, that may stand before a line.
PRINTED = "'01/02/2024, 10:30 Lei' || chr(10) || 'https://x.gov.br/lei.htm' || chr(10) || '1/10' || chr(10)"
HEADED = "'CAPÍTULO I' || chr(10) || 'Das Regras' || chr(10)"
#: What stands before the lines of documents to make them blocks of laws, and how often.
LAW_MARKS = {
    0: "'Art. ' || (i // 9 + 1) || 'º '", 1: "'§ ' || (i % 4 + 1) || 'º '", 2: "'II - '", 3: "'b) '", 4: f"case when i % 2 = 1 then {HEADED} || 'Art. ' || (i % 50 + 60) || '. ' else '' end",
    5: "case when i % 3 = 0 then 'DIÁRIO OFICIAL DA UNIÃO ' else 'Parágrafo único. ' end", 6: "'Decreto nº '", 7: "'IV – '", 8: f"case when i % 2 = 0 then {PRINTED} else '' end",
}


def law_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as blocks of laws, most of them with a mark, a heading or a page header in front of their own text."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    kind = (F.col("document") + F.col("i")) % 9
    mark = F.lit("")
    for k, made in LAW_MARKS.items():
        mark = F.when(kind == k, F.expr(made.replace("//", "div"))).otherwise(mark)
    text = F.concat(mark, "line")
    start = F.col("i") * 800
    return lines.select("document", F.col("i").alias("seq"), start.alias("start"), (start + F.length(text)).alias("stop"), text.alias("text"))


# The SQL of the law queries has rules of its own, written from the order of classes and not from the operator's patterns.
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NUMERALS = ", ".join(f"'{x}'" for x in ROMAN)
SQL_MARKS = {
    "article": r"regexp_matches(t, '(?i)^art\.\s*[0-9]+([.][0-9]+)*[º°o]?(-[a-z]+)?[0-9a-z_-]*[.\s]')",
    "paragraph": r"(regexp_matches(t, '^§\s*[0-9]+[ºo°]?[.]?\s') or regexp_matches(t, '(?i)^par[áa]grafo\s+[úu]nico'))",
    "item": rf"(regexp_matches(t, '^[A-Z]+\s*[–—-]') and regexp_extract(t, '^[A-Z]+') in ({NUMERALS}))",
    "letter": r"(t[1] between 'a' and 'z' and regexp_matches(t[2:3], '^[)]\s'))",
}
SQL_CONTENTS = r"(contains(t, '.....') or regexp_matches(t, '\s(_\s|-\s\s)'))"
AS_MARK = "\n".join(f"when {rule} then case when {SQL_CONTENTS} then 'metadata' else '{kind}' end" for kind, rule in SQL_MARKS.items())
AS_EDITED = r"""
when contains(t, 'DIÁRIO OFICIAL DA UNIÃO') or contains(t, 'Publicado em:') or contains(t, 'Imprensa Nacional') or contains(t, 'http://') or contains(t, 'https://') then 'metadata'
when regexp_matches(t, '^[0-9][0-9]/[0-9][0-9]/[0-9]{4},?\s+[0-9][0-9]:[0-9][0-9]') then 'metadata'
when regexp_matches(lower(t), '^(p[áa]gina|p[áa]ginas|p[áa]g|p[áa]g\.|fl|fls|fl\.|fls\.)?\s*[0-9]+(\s*(/|de)\s*[0-9]+)?$') then 'metadata'
when regexp_matches(lower(t), '^[óo]rg[ãa]o\s*:') then 'metadata'
when starts_with(lower(t), 'instrução normativa') or starts_with(lower(t), 'decreto') or starts_with(lower(t), 'portaria') or starts_with(lower(t), 'resolução') or regexp_matches(lower(t), '^lei\s+(complementar\s+)?n[º°]') then 'heading'
when regexp_matches(lower(t), '^o\s+(secretári[ao]|ministro|presidente|diretor)') or starts_with(lower(t), 'resolve') or starts_with(lower(t), 'considerando')
    or regexp_matches(t, 'no uso d[ae]s?\s+atribuiç') or regexp_matches(t, 'resolve\s*:') then 'preamble'
when regexp_matches(lower(t), '^(altera|dispõe|estabelece|institui|regulamenta)\s') then 'preamble'
when regexp_matches(lower(t), '^cap[ií]tulo\s') then 'heading'"""
AS_SHAPED = rf"""
when length(t) < 120 and regexp_matches(t, '^[\sA-ZÁÂÃÉÊÍÓÔÕÚÇ(),./:;–—-]+$') then 'heading'
when starts_with(lower(t), 'art.') or starts_with(t, '§') or regexp_matches(t, '^([a-zA-Z]\)|[0-9]+\.)') or upper(regexp_extract(t, '^([ivxlIVXL]+)\s*[–—-]', 1)) in ({NUMERALS}) then 'unclassified'
when length(t) < 60 and length(t) - length(replace(t, '.', '')) <= 1 and length(t) - length(replace(t, ',', '')) <= 1 and regexp_matches(t, '^\p{{Lu}}') and len(regexp_split_to_array(t, '\s+')) <= 10 then 'heading'"""
LINES = rf"""l as (select doc_id as document, unnest(string_split(text, chr(10))) as line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as i from documents where text is not null),
m as (select document, i, (document + i) % 9 as mark, line, i * 800 as start, case (document + i) % 9 {' '.join(f'when {k} then {x}' for k, x in LAW_MARKS.items())} else '' end || line as text from l)"""
CLASSES = rf"k as (select *, case when t = '' then 'metadata' {AS_MARK} {AS_EDITED} {AS_SHAPED} else 'unclassified' end as kind from b)"
LAWS = rf"with {LINES}, b as (select document, i as seq, start, start + length(text) as stop, text, {TRIM.format('text')} as t from m), {CLASSES}"
# a page header with more than 20 characters behind it, and a heading with an article of 50 or more, are blocks of their own
SPLIT_LAWS = rf"""with {LINES},
c as (select *, case when mark = 8 and i % 2 = 0 and length({TRIM.format('line')}) > 20 then length({PRINTED})
    when mark = 4 and i % 2 = 1 and length({TRIM.format(f"substr(text, length({HEADED}) + 1)")}) >= 50 then length({HEADED}) else 0 end as cut from m),
b as (select *, {TRIM.format('text')} as t from (
    select document, 2 * i as seq, start, start + length(text) as stop, text from c where cut = 0
    union all select document, 2 * i, start, start + cut, {TRIM.format('substr(text, 1, cut)')} from c where cut > 0
    union all select document, 2 * i + 1, start + cut, start + length(text), {TRIM.format('substr(text, cut + 1)')} from c where cut > 0)), {CLASSES}"""


@query(LAWS + " select document, seq, kind from k")
def law_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return law_blocks(spark, sf_dir).select("document", F.col("seq").cast("long").alias("seq"), block_class(F.col("text")).alias("kind"))


def as_number(part) -> str:
    return f"regexp_replace({part}, '^0+([0-9])', '\\1')"


#: Words after which a sentence goes on: articles, prepositions, conjunctions and pronouns.
LEADING_ON = ["a", "as", "o", "os", "um", "uma", "uns", "umas", "e", "ou", "de", "do", "dos", "da", "das", "no", "nos", "na", "nas", "ao", "aos", "à", "às", "em", "com", "sem", "por", "para", "pelo", "pelos", "pela", "pelas", "sob", "sobre", "entre",
    "até", "perante", "mediante", "conforme", "como", "que", "se", "qual", "quais", "quando", "onde", "cujo", "cujos", "cuja", "cujas", "seu", "seus", "sua", "suas"]
BEFORE = "lag(t) over (partition by document, no order by seq)"
UNFINISHED = rf"(regexp_matches({BEFORE}, ',$') or regexp_extract(lower({BEFORE}), '[\p{{L}}\p{{N}}_]+$') in ({', '.join(f"'{x}'" for x in LEADING_ON)}))"
ARTICLE_NO, ARTICLE_SUFFIX, PARAGRAPH_NO = (f"regexp_extract(t, '{p}', 1)" for p in (r"(?i)^art\.\s*([0-9]+([.][0-9]+)*)", r"(?i)^art\.\s*[0-9]+(?:[.][0-9]+)*[º°o]?(-[a-z]+)?", r"^§\s*([0-9]+)"))
PROVISIONS = SPLIT_LAWS + rf""", n as (select *, case kind when 'article' then {as_number(f"replace({ARTICLE_NO}, '.', '')")} || coalesce({ARTICLE_SUFFIX}, '')
    when 'paragraph' then case when {PARAGRAPH_NO} = '' then 'unico' else {as_number(PARAGRAPH_NO)} end when 'item' then regexp_extract(t, '^[IVXL]+') when 'letter' then t[1] end as number from k),
g as (select *, count(*) filter (kind <> 'unclassified') over (partition by document order by seq) as no from n where kind in ('article', 'paragraph', 'item', 'letter', 'unclassified') and t <> ''),
j as (select *, coalesce(kind <> 'unclassified' or start - first_value(stop) over (partition by document, no order by seq) <= 1500 or {UNFINISHED}, false) as joins from g where no > 0),
h as (select *, bool_and(joins) over (partition by document, no order by seq) as kept from j),
o as (select document, no, min(seq) as seq, arg_min(kind, seq) as kind, arg_min(number, seq) as number, string_agg(case when kind = 'unclassified' then t else text end, chr(10) order by seq) as text from h where kept group by document, no),
a as (select *, count(*) filter (kind = 'article') over (partition by document order by seq) as s0 from o),
p as (select *, count(*) filter (kind = 'paragraph') over (partition by document, s0 order by seq) as s1 from a where s0 > 0),
q as (select *, count(*) filter (kind = 'item') over (partition by document, s0, s1 order by seq) as s2 from p),
r as (select *, first_value(case when kind = 'article' then number end) over (partition by document, s0 order by seq) as article,
    first_value(case when kind = 'paragraph' then number end) over (partition by document, s0, s1 order by kind <> 'paragraph', seq) as paragraph,
    first_value(case when kind = 'item' then number end) over (partition by document, s0, s1, s2 order by kind <> 'item', seq) as item, case when kind = 'letter' then number end as letter from q),
u as (select document, seq, kind, text, case when letter is not null then 'ALI' when item is not null then 'INC' when paragraph is not null then 'PAR' else 'ART' end
    || '-' || case when length(regexp_extract(article, '^\d+')) < 3 then lpad(regexp_extract(article, '^\d+'), 3, '0') else regexp_extract(article, '^\d+') end || regexp_extract(article, '^\d+(.*)$', 1)
    || case when paragraph is null then '' when paragraph = 'unico' then '-0' else '-' || paragraph end || coalesce('-' || item, '') || coalesce('-' || letter, '') as span_id,
    (paragraph is not null)::int + (item is not null)::int + (letter is not null)::int as depth from r),
f as (select *, row_number() over (partition by document, span_id order by contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'vigência encerrada'), seq desc) as best from u),
w as (select document, row_number() over (partition by document order by seq) as place, kind, span_id, depth, text from f where best = 1)"""


@query(PROVISIONS + " select document, place, kind, span_id, depth, md5(text) as digest from w")
def law_provision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From blocks to provisions: classes, orphans, levels, repeated provisions, ids."""
    return law_provisions(law_blocks(spark, sf_dir)).select("document", "place", "kind", "span_id", F.col("depth").cast("int").alias("depth"), F.md5("text").alias("digest"))


@query(PROVISIONS + " select document, count(*) as n, " + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in SQL_MARKS) + ", max(depth)::bigint as max_depth from w group by document")
def law_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return law_statistics(law_provisions(law_blocks(spark, sf_dir)))


@query("select o_custkey, arg_max(o_orderkey, (o_orderstatus <> 'F', o_orderkey)) as o_orderkey from orders group by o_custkey")
def in_force_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("revoked"))
    return keep_in_force(orders, ["o_custkey"], "revoked", "o_orderkey").select("o_custkey", "o_orderkey")


@query()
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms cited in whole texts, to which a sentence is added that names the number and year of each document's own row."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(". Conforme o art. "), (F.col("doc_id") % 30 + 1).cast("string"), F.lit(" da Lei nº 14."), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("/2021 e do Decreto 99."), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(", de 1990."))
    return citations(docs.select("doc_id", text.alias("text")), "doc_id", "text")


@query()
def internal_law_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References within whole texts, to which one of the document's own and one to another law are added."""
    docs = table(spark, sf_dir, "documents")
    own = F.format_string(". Aplica-se o art. %d, § 2º, inciso IV, desta lei e o art. %d da Lei nº 14.%03d/2021.", F.col("doc_id") % 40 + 1, F.col("doc_id") % 7 + 50, F.col("doc_id") % 1000)
    return internal_references(docs.select("doc_id", F.concat("text", own).alias("text")), "doc_id", "text")


@query("""
select doc_id, 'LEI-14.' || lpad((doc_id % 1000)::varchar, 3, '0') || '-2021 art. ' || (doc_id % 30 + 1) || '; ' || 'DECRETO-99.' || lpad((doc_id % 1000)::varchar, 3, '0') || '-1990 art. ' || (doc_id % 30 + 1) as labels
from documents where text is not null
""")
def citation_label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels, in order, of whole texts whose own digits are masked by a letter, so that they cite what is added to them only."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.translate("text", "0123456789", "x" * 10), F.format_string(". O art. %d da Lei nº 14.%03d/2021; o art. %d do Decreto 99.%03d, de 1990; ainda o art. %d da Lei nº 14.%03d/2021.", *(x for _ in range(3) for x in (F.col("doc_id") % 30 + 1, F.col("doc_id") % 1000))))
    found = citation_labels(citations(docs.select("doc_id", text.alias("text")), "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.array_join("labels", "; ").alias("labels"))


@query("""
select o_orderkey, case o_orderkey % 4 when 0 then 'LEI-' || n || '-2021' when 1 then 'IN-58-2022' when 2 then 'DECRETO-' || n || '-1998' else 'LC-' || n end as id
from (select o_orderkey, case when o_orderkey >= 1000 then ltrim(format('{:,}', o_orderkey)) else o_orderkey::varchar end as d from orders) x, lateral (select replace(d, ',', '.') as n)
""")
def normalised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.format_string(" lei nº %d/2021", key)).when(key % 4 == 1, "IN_58 / 2022").when(key % 4 == 2, F.format_string("Decreto %d-1998", key)).otherwise(F.concat(F.lit("lc N. "), F.replace(F.format_number(key, 0), F.lit(","), F.lit("."))))
    return table(spark, sf_dir, "orders").select("o_orderkey", normalised_id(raw).alias("id"))


@query("""
select l_orderkey, l_linenumber, l_orderkey::int as article, case l_linenumber when 1 then '3' when 2 then 'unico' end as paragraph, case when l_linenumber in (1, 3) then 'IV' end as item, case when l_linenumber in (3, 4) then 'b' end as letter,
    concat_ws('-', 'art' || l_orderkey, 'par' || case l_linenumber when 1 then '3' when 2 then 'unico' end, 'inc' || case when l_linenumber in (1, 3) then 'IV' end, 'al' || case when l_linenumber in (3, 4) then 'b' end) as path,
    concat_ws(', ', 'Art. ' || l_orderkey || 'º', '§' || case l_linenumber when 1 then '3' when 2 then 'unico' end || 'º', case when l_linenumber in (1, 3) then 'IV' end, case when l_linenumber in (3, 4) then 'b' end) || ' da Lei 1' as label
from (select distinct l_orderkey, l_linenumber from lineitem)
""")
def provision_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable references of five forms read into levels, and these written as a path and a label."""
    n, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    said = F.concat(F.lit("Art. "), key, F.when(n == 1, "º, § 3º, IV").when(n == 2, ", parágrafo único").when(n == 3, ", inciso IV, alínea b").when(n == 4, "º, b").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select("*", provision_ref(said).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    levels = [F.col(x) for x in ("article", "paragraph", "item", "letter")]
    return rows.withColumn("path", provision_path(*levels)).withColumn("label", provision_label(*levels, F.lit("Lei 1")))


@query("select doc_id, case when doc_id % 3 = 0 then '' else substr(text, 6, 20) end as slice, doc_id % 3 <> 0 as unchanged from documents where text is not null")
def verified_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by offset, empty where the text isn't the one that was hashed."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    digest = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    part, same = slice_if_unchanged("text", F.lit(5), F.lit(25), digest)
    return docs.select("doc_id", part.alias("slice"), same.alias("unchanged"))


@query("""
select o_custkey, arg_min(o_orderpriority || ' ' || o_orderkey, (o_orderdate, o_orderpriority || ' ' || o_orderkey)) as old, arg_max(o_orderpriority || ' ' || o_orderkey, (o_orderdate, o_orderpriority || ' ' || o_orderkey)) as new from orders group by o_custkey
""")
def compared_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last wording of each customer's orders, side by side."""
    orders = table(spark, sf_dir, "orders").withColumn("wording", F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")))
    return compared_versions(orders, "o_custkey", "o_orderdate", "o_orderdate", "wording")


@query()
def word_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that differ between each conversation's turns and the turn before."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("before", before).where("before is not null").select(F.struct("conv_id", "turn").alias("at"), word_diff("before", "text").alias("d"))
    return diff_counts(pairs, "at", "d").select("at.*", "n_same", "n_removed", "n_added")


def last_begin(mark: str) -> str:
    """SQL for the place, from 0, of the last ``mark`` that begins at 400 or before; -1 without one."""
    head = f"left(text, {400 + len(mark)})"
    sql = " || ".join("chr(10)" if c == chr(10) else f"'{c}'" for c in mark[::-1])
    return f"case when strpos(reverse({head}), {sql}) = 0 then -1 else length({head}) - strpos(reverse({head}), {sql}) + 1 - {len(mark)} end"


CUTS = " ".join(f"when {last_begin(m)} > 240 then {last_begin(m)} + {len(m)}" for m in ("\n\n", "\n", ". ", "; ", ", "))


@query(f"select doc_id, case when length(text) <= 400 then length(text) else case {CUTS} else 400 end end as n_chars, case when length(text) > 400 then case {CUTS} else 400 end end as next from documents")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate_at(F.col("text"), 0, 100).alias("t")).select("doc_id", F.length("t.text").alias("n_chars"), "t.next")


@query(r"select doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '') || chr(10)) as digest from documents")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(canonical("text")).alias("digest"))


@query("select doc_id, md5(strip_accents(text)) as digest from documents")
def accents_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_accents("text")).alias("digest"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'lei-' || o_orderkey || '-2021' when 1 then 'lc-' || o_orderkey || '-2025' when 2 then 'decreto-' || o_orderkey || '-1998' end as slug from orders")
def norm_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    dotted = F.format_number(key, 0)
    number = F.replace(dotted, F.lit(","), F.lit("."))
    name = F.when(key % 4 == 0, F.concat(F.lit("Lei nº "), number, F.lit("/2021"))).when(key % 4 == 1, F.concat(F.lit("Lei Complementar "), number, F.lit(", de 2025"))).when(key % 4 == 2, F.concat(F.lit("Decreto nº "), number, F.lit(" de 1998"))).otherwise("Constituição Federal")
    return table(spark, sf_dir, "orders").select("o_orderkey", norm_slug(name).alias("slug"))


@query("select doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: length(x) > 2 and x not in ('das', 'dos', 'para', 'com', 'sem', 'por', 'tipo', 'cor', 'material', 'modelo', 'caracteristicas', 'adicionais', 'apresentacao', 'finalidade', 'uso')))) as n_terms from documents")
def telling_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(term_set("text")).cast("long").alias("n_terms"))


@query("""
with r as (select o_orderkey, case o_orderkey % 3 when 0 then 'lei-' || o_orderkey || '-2021' when 1 then 'norma-' || o_orderkey || '-2021' else 'lei-x' end as slug from orders),
c as (select 'lei-' || o_orderkey || '-2021' as norm from orders where o_orderkey % 2 = 0)
select o_orderkey, coalesce((select min(norm) from c where norm = slug), (select min(norm) from c where regexp_extract(norm, '[0-9]+-[0-9]{4}$') = nullif(regexp_extract(slug, '[0-9]+-[0-9]{4}$'), ''))) as norm from r
""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by exact slug, else by number and year."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    named = lambda kind: F.concat(F.lit(kind), key.cast("string"), F.lit("-2021"))
    refs = orders.select("o_orderkey", F.when(key % 3 == 0, named("lei-")).when(key % 3 == 1, named("norma-")).otherwise("lei-x").alias("slug"))
    catalogue = orders.where(key % 2 == 0).select(named("lei-").alias("norm"))
    return resolve_references(refs, catalogue, "slug", "norm").select("o_orderkey", "norm")


@query("""
select l_orderkey, l_linenumber, 'Acórdão ' || l_orderkey || '/' || year(l_shipdate) || '-TCU-Plenário' || case l_linenumber when 1 then ', sumário' when 2 then ', item 9.' || l_orderkey when 3 then ', voto §' || (l_orderkey % 90) when 4 then ', relatório' when 5 then ', enunciado 0' || l_linenumber else '' end as label
from lineitem
""")
def ruling_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    section = F.when(n == 1, "sumario").when(n == 2, "acordao").when(n == 3, "voto").when(n == 4, "relatorio").when(n == 5, "enunciado").otherwise("outra")
    mark = F.when(n == 1, "x").when(n == 2, F.concat(F.lit("item9."), key)).when(n == 3, F.concat(F.lit("p0"), (F.col("l_orderkey") % 90).cast("string"))).when(n == 4, "w06").when(n == 5, F.concat(F.lit("e0"), n.cast("string"))).otherwise("y")
    label = ruling_label(F.col("l_orderkey"), F.year("l_shipdate"), F.lit("Plenário"), section, mark)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("""
with v as (select o_custkey, 'status ' || o_orderstatus || ' priority ' || replace(o_orderpriority, ' ', '_') as text, o_orderdate, o_orderkey, o_orderstatus as s, replace(o_orderpriority, ' ', '_') as p from orders),
w as (select o_custkey, arg_min((s, p), (o_orderdate, text)) as a, arg_max((s, p), (o_orderdate, text)) as b from v group by o_custkey)
select o_custkey, 2 + (a[1] = b[1])::bigint + (a[2] = b[2])::bigint as n_same, (a[1] <> b[1])::bigint + (a[2] <> b[2])::bigint as n_removed, (a[1] <> b[1])::bigint + (a[2] <> b[2])::bigint as n_added from w
""")
def version_difference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay, go and come between the first and the last version of each customer's orders."""
    text = F.concat(F.lit("status "), "o_orderstatus", F.lit(" priority "), F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    versions = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.lit(None).cast("timestamp").alias("end"), text.alias("text"))
    return version_differences(versions, "o_custkey", "o_orderdate", "end", "text").select("o_custkey", "n_same", "n_removed", "n_added")
