"""Lexical retrieval: query profiles, BM25 over terms, prefixes and phrases, substring lane, synonyms, pattern search."""

from __future__ import annotations

import re
import unicodedata

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, fold, terms

K1, B = 1.2, 0.75

#: Groups of interchangeable terms.
SYNONYMS = [
    ["notebook", "laptop", "computador portátil"],
    ["desktop", "computador de mesa", "microcomputador"],
    ["celular", "smartphone", "telefone móvel"],
    ["caminhonete", "pick-up", "picape"],
    ["viatura", "veículo policial"],
    ["tv", "televisor", "televisão"],
    ["geladeira", "refrigerador"],
    ["ar-condicionado", "condicionador de ar"],
    ["impressora multifuncional", "multifuncional"],
    ["pendrive", "pen drive", "memória portátil"],
    ["limpeza predial", "limpeza e conservação"],
]


def plain(text: str) -> str:
    """Python's form of ``fold`` for query texts."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def query_tokens(text: str, profile: str = "laws") -> list[str]:
    """Tokens of a query text after one of four profiles: laws, catalogue, grep, rulings.

    All but rulings split at white space after compatibility normalisation and drop operator characters; tokens shorter
    than two (catalogue: three) characters go. rulings takes the first twelve runs of letters and digits, for prefixes.
    """
    if profile == "rulings":
        return [t for t in re.split(r"[\W_]+", text.lower()) if len(t) >= 2][:12]
    if profile not in ("laws", "catalogue", "grep"):
        raise ValueError(f"no query profile {profile}")
    clean = re.sub(r'["\\()*:^]', " ", unicodedata.normalize("NFKC", text))
    return [t for t in clean.split() if len(t) >= (3 if profile == "catalogue" else 2)]


def expand_synonyms(text: str, groups: list[list[str]] = SYNONYMS) -> str:
    """The query text followed by all terms interchangeable with one that it holds as a whole word, none twice."""
    folded, out = plain(text), [text]
    for group in groups:
        holds = [g for g in group if re.search(rf"(?<![^\W_]){re.escape(plain(g))}(?![^\W_])", folded)]
        if holds:
            out += [g for g in group if g not in holds and g not in out]
    return " ".join(out)


def needle(token: str) -> str:
    """A query token as it stands in an index form: one term, or the terms of a phrase."""
    return re.sub(r"[\W_]+", " ", plain(token)).strip()


def times(text: Column, part: str) -> Column:
    """How often ``part`` stands in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long") if part else F.lit(0).cast("long")


WORD, BREAK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
#: WORD, with a letter beyond U+FFFF by name: only then such letters are seen by looking back.
WORD_BEFORE = "[\\p{L}\\p{N}\U0001d49c]"
#: Letters that become accented Latin letters in lower case, but aren't in ACCENTED themselves; what they become is put
#: as letters that no needle has.
LATE, LATE_LOWER, APART = "\u0178\u212b", "ÿå", "ŷǻ"


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern stands in a text, without overlaps; never in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_form(text: str, low: Column) -> Column:
    """The text, with its lower case ``low``, as ``word_pattern`` reads it: accents stay, and are read as what they fold to."""
    apart = F.translate(fold(text), LATE_LOWER, APART)
    return F.when(F.col(text).rlike(f"[{LATE}]"), apart).otherwise(low)


def word_pattern(needle: str, prefix: bool = False) -> str:
    """A needle (a term, the terms of a phrase, or, last, a prefix) in a ``word_form``, as whole terms."""
    variants: dict[str, str] = {}
    for accented, plain in zip(ACCENTED.lower(), PLAIN.lower(), strict=True):
        variants[plain] = variants.get(plain, plain) + accented
    first, *more = ("".join(f"[{variants[c]}]" if c in variants else re.escape(c) for c in term) for term in needle.split(" "))
    # the letters come first: what stands before them is looked at only where they are found
    return f"{first}(?<!{WORD_BEFORE}{first})" + "".join(f"{BREAK}++{term}" for term in more) + ("" if prefix else f"(?!{WORD})")


def token_table(docs: DataFrame, text: str, tokens: list[str] = (), substrings: list[str] = (), prefix: bool = False, keep: Column | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, with the counts that scoring needs: texts are read once, whatever follows.

    length and tf0, tf1 ... are of terms (or phrases, or prefixes), grams and sf0, sf1 ... of character trigrams and
    substrings; has_text says whether there is a text, kept whether ``keep`` holds. A few numbers a document: the table
    is kept in memory, or on disk, until the session's cache is cleared.
    """
    base = docs.withColumn("kept", F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)).withColumn("has_text", F.coalesce(F.col(text), F.lit("")) != "")
    base = base.withColumn("_low", F.lower(F.col(text)))
    if tokens:
        base = base.withColumn("_form", word_form(text, F.col("_low"))).withColumn("length", matches(F.col("_form"), f"{WORD}++"))
        for i, t in enumerate(map(needle, tokens)):
            base = base.withColumn(f"tf{i}", matches(F.col("_form"), word_pattern(t, prefix)) if t else F.lit(0).cast("long"))
        base = base.drop("_form")
    if substrings:
        base = base.withColumn("grams", F.greatest(F.length(text) - 2, F.lit(0)).cast("long"))
        for i, t in enumerate(substrings):
            base = base.withColumn(f"sf{i}", matches(F.col("_low"), re.escape(t)) if t else F.lit(0).cast("long"))
    base = base.drop("_low")
    return base.drop(text).persist(StorageLevel.MEMORY_AND_DISK)


def scored(table: DataFrame, count: str, length: str, n: int, every: bool = False) -> DataFrame:
    """Rows of a token table that match, with score: BM25 over its counts ``count``0 to ``count``n-1.

    Corpus figures (documents, mean length, documents of each token) come from all rows, kept or not: one row, joined by
    broadcast.
    """
    if not n:
        return table.where("false").withColumn("score", F.lit(0.0))
    tf = [F.col(f"{count}{i}") for i in range(n)]
    whole = table.agg(F.count("*").alias("_n"), F.avg(length).alias("_mean"), *(F.count_if(x > 0).alias(f"_df{i}") for i, x in enumerate(tf)))
    score, match = F.lit(0.0), F.lit(every)
    for i, x in enumerate(tf):
        score = score + idf(F.col("_n"), F.col(f"_df{i}")) * saturated(x, F.col(length), F.col("_mean"))
        match = match & (x > 0) if every else match | (x > 0)
    found = table.where(F.col("kept") & match).join(F.broadcast(whole)).withColumn("score", score)
    return found.drop("_n", "_mean", *(f"_df{i}" for i in range(n)))


def idf(n: Column, df: Column) -> Column:
    """Weight of a token on ``df`` of ``n`` documents, a millionth at least."""
    weight = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(weight <= 0, 1e-6).otherwise(weight)


def saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


COUNTS = re.compile(r"^(tf|sf)\d+$|^(length|grams|kept|has_text)$")


def without_counts(found: DataFrame) -> DataFrame:
    return found.drop(*(c for c in found.columns if COUNTS.match(c)))


def bm25(docs: DataFrame, text: str, tokens: list[str], every: bool = False, prefix: bool = False, keep: Column | None = None) -> DataFrame:
    """Matching rows of ``docs`` (its columns but the text) with score (positive, larger is better).

    Corpus figures come from all of ``docs``; ``keep`` only restricts the rows. ``every`` asks for all tokens. Repeated
    tokens count again. No tokens match nothing. Only the counts of the query's tokens are computed; where many queries
    follow, an index reads the terms asked for only.
    """
    return without_counts(scored(token_table(docs, text, tokens, prefix=prefix, keep=keep), "tf", "length", len(tokens), every))


def substring_tokens(query: str) -> list[str]:
    return [t.lower() for t in query.split() if len(t) >= 3]


def substring_lane(docs: DataFrame, text: str, query: str, keep: Column | None = None) -> DataFrame:
    """Rows that hold a query token of three or more characters anywhere, case ignored, ranked by BM25 over character trigrams."""
    tokens = substring_tokens(query)
    return without_counts(scored(token_table(docs, text, substrings=tokens, keep=keep), "sf", "grams", len(tokens)))


def and_first(docs: DataFrame, text: str, query: str, keep: Column | None = None) -> DataFrame:
    """Rows with all tokens; only if there are none, rows with any token of the query and its synonyms. Adds mode."""
    strict = bm25(docs, text, query_tokens(query, "catalogue"), every=True, keep=keep)
    if not strict.isEmpty():
        return strict.withColumn("mode", F.lit("all"))
    return bm25(docs, text, query_tokens(expand_synonyms(query), "catalogue"), keep=keep).withColumn("mode", F.lit("any"))


def top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows, equal scores by key, with rank from 1."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


UNSAFE = re.compile(r"\([^)]*[+*][^)]*\)[+*{]|(\.\*){3,}")


def grep(docs: DataFrame, text: str, pattern: str, key: str, k: int, keep: Column | None = None) -> DataFrame:
    """The first ``k`` rows, by key, in which a regular expression matches, case ignored; patterns that may backtrack without end are refused."""
    if UNSAFE.search(pattern):
        raise ValueError("this pattern may take exponential time")
    found = docs.where(keep) if keep is not None else docs
    return found.where(F.col(text).rlike(f"(?iu){pattern}")).orderBy(key).limit(k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): one row for each document and term, to be kept when many queries follow."""
    # the text is split once, before the rows multiply
    split = docs.select(key, terms(text).alias("terms")).select(key, "terms", F.size("terms").alias("length"))
    exploded = split.select(key, "length", F.explode("terms").alias("term"))
    return exploded.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def snippet(text: Column, token: str, around: int = 6) -> Column:
    """About twelve words around the first occurrence of a token, the token in brackets, dots where text is left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: fold(w).contains(plain(token))), F.lit(True)).cast("int")
    first = F.greatest(at - around, F.lit(1))
    part = F.transform(F.slice(words, first, F.lit(2 * around)), lambda w: F.when(fold(w).contains(plain(token)), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(at > 0, F.concat(F.when(first > 1, "…").otherwise(""), F.array_join(part, " "), F.when(F.size(words) > first + 2 * around - 1, "…").otherwise("")))


def keyword_overlap(docs: DataFrame, text: str, query: str, key: str, k: int) -> DataFrame:
    """Recommends rows by how many query tokens of five or more characters their text holds: score = min(1, hits / 5).

    Case is ignored, accents count. A repeated token counts each time.
    """
    tokens = [t for t in re.split(r"[\W_]+", query.lower()) if len(t) > 4]
    hits = sum((F.lower(F.col(text)).contains(t).cast("int") for t in tokens), F.lit(0))
    return docs.withColumn("score", F.least(F.lit(1.0), hits / 5)).where("score > 0").orderBy(F.desc("score"), key).limit(k)
