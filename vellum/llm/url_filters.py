"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest confirmation, precedence.

Each URL expands into the expressions that could name it (``example.com/``, ``www.example.com/en/`` ...). A rule is
filed under its host and its path up to the last slash. Both sides carry a short prefix of the expression's SHA-256;
the equi-join runs on that prefix, and the full digest and the rule's whole path confirm each hit. The longest rule
wins; of rules equally long, block before allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, small_side

#: Hex digits of the SHA-256 on which the join runs.
PREFIX_HEX = 8
#: Up to so many rules are broadcast (about 200 bytes each); more are joined by shuffling.
BROADCAST_RULES = 100_000


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def filed_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule, verdict) with host, path, depth of both, and the digest under which each is filed."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    key = F.when(F.col("r_path") == "", "").otherwise(F.regexp_extract("r_path", r"(?s)^(.*/)", 1))
    return (
        rules.where("rule is not null and verdict is not null")
        .select("rule", F.col("verdict").alias("r_verdict"), host.alias("r_host"), path.alias("r_path"))
        .withColumn("r_digest", F.sha2(F.concat("r_host", key), 256))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
        .withColumn("r_labels", F.size(F.split("r_host", r"\.")))
        .withColumn("r_slashes", F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit(""))))
    )


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``urls`` by ``rules`` (columns rule, verdict; a rule is ``host`` + path prefix).

    Returns id, host, path, rule (null if none fits) and verdict, one row for each row of ``urls``.

    Null urls, and urls without ``://``, have empty host and path and get the default. Null ids and repeated rows
    are kept as they are. Very long urls expand no deeper than the deepest rule. An empty ``rules`` gives the default
    throughout; an empty ``urls`` gives no rows. Other columns are left out, whatever their names.
    """
    filed = filed_rules(rules)
    deep = filed.agg(F.max("r_labels"), F.min("r_slashes"), F.max("r_slashes")).first()  # one row: how far urls need expanding
    labels, least, most = (x if x is not None else 0 for x in deep)

    host, path = url_parts(F.col("u_url"))
    parts = urls.select(F.col(id_col).alias("u_id"), F.col(url_col).alias("u_url")).select("u_id", host.alias("u_host"), path.alias("u_path"))
    expressions = F.expr(f"""
        concat(array(cast(null as string)), if(u_host = '' or {labels} = 0, array(), flatten(transform(
            sequence(1, least({labels}, size(split(u_host, '[.]')))),
            i -> transform(
                filter(sequence({least}, {most}), j -> j <= length(u_path) - length(replace(u_path, '/', ''))),
                j -> concat(substring_index(u_host, '.', -i), if(j = 0, '', concat(substring_index(u_path, '/', j), '/'))))))))""")
    # the null expression at 0 matches nothing: it keeps urls without a match and counts equal rows
    expanded = (
        parts.select("*", F.posexplode(expressions).alias("u_at", "u_expression"))
        .withColumn("u_digest", F.sha2("u_expression", 256))
        .withColumn("u_prefix", F.substring("u_digest", 1, PREFIX_HEX))
    )
    r = small_side(filed.select("rule", "r_verdict", "r_path", "r_digest", "r_prefix"), BROADCAST_RULES)
    fits = (F.col("u_prefix") == F.col("r_prefix")) & (F.col("u_digest") == F.col("r_digest")) & F.startswith("u_path", "r_path")
    rank = F.struct(F.length("rule").alias("long"), (F.col("r_verdict") == "block").alias("strict"), F.col("rule"), F.col("r_verdict").alias("verdict"))
    judged = (
        expanded.join(r, fits, "left")
        .groupBy("u_id", "u_host", "u_path")
        .agg(F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best"), F.count_if(F.col("u_at") == 0).alias("copies"))
    )
    return judged.select(
        F.col("u_id").alias(id_col),
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("u_copy"),
    ).drop("u_copy")
