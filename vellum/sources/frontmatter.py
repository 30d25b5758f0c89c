"""Markdown files with a front-matter block: a small grammar of its own, not YAML."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import slug

#: Fixed value: beyond it an integer stays a text.
GREATEST = 2**53 - 1
#: What the inside of an inline list is made of: a quoted text (to the end, if the quote doesn't end), a bracket, a comma, other text.
PIECE = re.compile(r"""(?P<quoted>"[^"]*"?|'[^']*'?)|(?P<open>\[)|(?P<close>\])|(?P<comma>,)|[^"'\[\],]+""")


def scalar(text: str):
    """true and false, an integer, a text without the quotes around it; all else, numbers with a point too, as it is."""
    text = text.strip()
    if text in ("true", "false"):
        return text == "true"
    if re.match(r"-?[0-9]+\Z", text) and abs(int(text)) <= GREATEST:
        return int(text)
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def items_of(inside: str) -> list[str]:
    """The items between commas; one within quotes or brackets parts nothing, and what is empty at the end is no item."""
    items, depth = [""], 0
    for piece in PIECE.finditer(inside.strip()):
        depth += bool(piece["open"]) - bool(piece["close"])
        if piece["comma"] and not depth:
            items.append("")
        else:
            items[-1] += piece[0]
    return items if items[-1].strip() else items[:-1]


def value_of(text: str):
    """An inline list, a scalar, or None where nothing stands: the lines that follow tell."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in items_of(text[1:-1])]
    return scalar(text) if text else None


def parse(text: str) -> dict:
    """Keys of the block between two ``---`` lines: scalars, inline lists, block lists, one nested level.

    Raises ValueError with the line number where the grammar isn't kept.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---":
        raise ValueError("line 1: no front matter")
    out: dict = {}
    open_key = None
    for n, line in enumerate(lines[1:], 2):
        if line.strip() == "---":
            return out
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"line {n}: indented by a tab")
        if line[0] == " ":
            if open_key is None:
                raise ValueError(f"line {n}: indented without a key")
            if body.startswith("- "):
                if out[open_key] is None:
                    out[open_key] = []
                if not isinstance(out[open_key], list):
                    raise ValueError(f"line {n}: list item among keys")
                out[open_key].append(scalar(body[2:]))
                continue
            key, colon, rest = body.partition(":")
            if out[open_key] is None:
                out[open_key] = {}
            if not colon or not isinstance(out[open_key], dict):
                raise ValueError(f"line {n}: no key")
            out[open_key][key.strip()] = value_of(rest)
        else:
            key, colon, rest = body.partition(":")
            if not colon:
                raise ValueError(f"line {n}: no key")
            out[key.strip()] = value_of(rest)
            open_key = key.strip() if not rest.strip() else None
    raise ValueError(f"line {len(lines)}: front matter doesn't end")


PARSED = T.StructType([T.StructField("fields", T.StringType()), T.StructField("error", T.StringType())])


@pandas_udf(PARSED)
def front_matter(texts: pd.Series) -> pd.DataFrame:
    """struct(fields as JSON, error)."""

    def one(t):
        try:
            return json.dumps(parse(t or ""), ensure_ascii=False, sort_keys=True), None
        except ValueError as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in texts], columns=["fields", "error"])


def body(text: Column) -> Column:
    """What follows the front matter, or the whole text if there is none."""
    return F.when(text.startswith("---\n"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")).otherwise(text)


def quoted(value: Column) -> Column:
    """A text as a front-matter value of one line: in double quotes, with these and backslashes escaped, line breaks as spaces."""
    escaped = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), F.replace(escaped, F.lit("\n"), F.lit(" ")), F.lit('"'))


def render(fields: dict[str, Column], text: Column, numbers: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> Column:
    """A Markdown document: front matter of the given fields and the text, each on lines of its own.

    Values are ``quoted`` but for those of ``numbers``; those of ``lists`` are arrays, written as a block list. Null values
    and empty lists are left out.
    """
    lines = []
    for name, value in fields.items():
        if name in lists:
            items = F.array_join(F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("\n  - "), quoted(x))), "")
            lines.append(F.when(items != "", F.concat(F.lit(f"{name}:"), items)))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), value.cast("string") if name in numbers else quoted(value)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def provision_path(law: Column, levels: Column, provision: Column, article: Column, paragraph: Column, item: Column, letter: Column) -> Column:
    """Where a provision's file lies: ``<law>/dispositivos/<level>/.../art-005-p-1-i-ii-a-a.md``.

    ``levels`` is an array of headings above it (``sem-hierarquia`` stands for none); a provision outside an article has
    its id as name. Article numbers have three digits at least.
    """
    number = article.cast("string")
    number = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    part = lambda tag, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{tag}-"), slug(c.cast("string"))))
    name = F.when(article.isNull(), slug(provision.cast("string"))).otherwise(F.concat_ws("-", F.concat(F.lit("art-"), number), part("p", paragraph), part("i", item), part("a", letter)))
    folders = F.filter(F.transform(F.coalesce(levels, F.array().cast("array<string>")), slug), lambda x: x != "")
    middle = F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise(F.lit("sem-hierarquia"))
    return F.concat_ws("/", law, F.lit("dispositivos"), middle, F.concat(name, F.lit(".md")))


def write_markdown(rows: DataFrame, path: str, folder: str, text: str) -> None:
    """One folder for each value of ``folder``; only folders that ``rows`` has are replaced."""
    rows.select(folder, F.col(text).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).text(path)
