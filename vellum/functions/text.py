"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .norms import NORM_KINDS

#: Accented Latin letters and what they become without accents.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

#: Words that don't tell one item from another.
STOPWORDS = ["de", "da", "do", "das", "dos", "para", "com", "sem", "e", "ou", "a", "o", "as", "os", "em", "no", "na", "por", "tipo", "cor", "material", "modelo", "caracteristicas", "adicionais", "apresentacao", "finalidade", "uso"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    """Latin letters without their accents; everything else as it is."""
    return F.translate(col(c), ACCENTED, PLAIN)


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(c))


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def index_form(c: Column | str) -> Column:
    """Folded text whose terms stand between single spaces, with a space at both ends: the form that lexical search reads."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def terms(c: Column | str) -> Column:
    """Terms of a text in order."""
    return F.filter(F.split(F.trim(index_form(c)), " "), lambda t: t != "")


def term_set(c: Column | str) -> Column:
    """Distinct telling terms: ASCII letters and digits after folding, longer than two, no stop words."""
    words = F.split(fold(c), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def slug(c: Column | str) -> Column:
    """Folded words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def preview(c: Column | str, most: int) -> Column:
    """The text, cut with three dots where it is longer than ``most`` characters."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 3), F.lit("..."))).otherwise(col(c))


def clean_or_null(c: Column | str) -> Column:
    return F.nullif(collapsed(c), F.lit(""))


def positive_code(c: Column | str) -> Column:
    """A code of digits only, above zero, as long; else null."""
    digits = F.when(F.trim(col(c)).rlike(r"^\d{1,18}$"), F.trim(col(c)).cast("long"))
    return F.when(digits > 0, digits)


def estimated_tokens(c: Column | str, up: bool = True) -> Column:
    """A quarter of the characters, rounded up (or down)."""
    quarter = F.length(col(c)) / 4
    return (F.ceil(quarter) if up else F.floor(quarter)).cast("long")


def audit_form(c: Column | str) -> Column:
    """Text for literal comparison: no byte-order mark or zero-width characters, white space collapsed."""
    return collapsed(F.regexp_replace(col(c), "[﻿​‌‍]", ""))


def canonical(c: Column | str) -> Column:
    """Line feeds only, no white space at line ends, one line feed at the end."""
    unix = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), r"[ \t\x0b\f]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(unix, r"\n+$", ""), F.lit("\n"))


def slice_if_unchanged(c: Column | str, start: Column, stop: Column, digest: Column) -> tuple[Column, Column]:
    """(text between offsets, whether the hash agrees); empty where the text isn't the one the offsets were made for."""
    same = F.sha2(col(c), 256) == digest
    return F.when(same, F.substr(col(c), start + 1, stop - start)).otherwise(""), F.coalesce(same, F.lit(False))


def first_where(tokens: Column, condition) -> Column:
    return F.get(F.filter(tokens, condition), F.lit(0))


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm_slug(c: Column | str) -> Column:
    """``type-number-year`` of a norm's readable name; null if a part is missing.

    The name is read as words and numbers: the first number is the norm's, the first of four digits that can be a year
    its year, and the type is the first of NORM_KINDS whose words stand in it.
    """
    tokens = F.regexp_extract_all(fold(c), F.lit(r"[a-z]+|\d[\d.]*"), 0)
    words = F.concat(F.lit(" "), F.array_join(F.filter(tokens, lambda t: t.rlike("^[a-z]")), " "), F.lit(" "))
    kind = F.coalesce(*(F.when(F.contains(words, F.lit(w)), k.slug) for k in NORM_KINDS for w in k.named))
    number = F.replace(first_where(tokens, lambda t: t.rlike(r"^\d")), F.lit("."), F.lit(""))
    year = first_where(F.transform(tokens, lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t.rlike(r"^(19|20)\d{2}$"))
    return F.concat(kind, F.lit("-"), number, F.lit("-"), year)


def provision_ref(c: Column | str) -> Column:
    """struct(article, paragraph, item, letter) of a readable reference; article null if there is none.

    The reference is read as words, numbers, § and commas; each part is told by a pair of neighbours ("art", "5") or,
    for Roman numerals, by its form. A single letter behind the last comma is a letter too.
    """
    tokens = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"§|,|\p{L}+|\d+"), 0)

    def named(tokens: Column, pairs: Column) -> Column:
        behind = lambda names, form: first_where(pairs, lambda p: p["a"].isin(names) & p["b"].rlike(form))["b"]
        letter = lambda ending: F.coalesce(behind(["alinea"], "^[a-z]$"), F.when((ending["a"] == ",") & ending["b"].rlike("^[a-z]$"), ending["b"]))
        rest = lambda: {
            "paragraph": behind(["§", "paragrafo"], r"^(\d+|unico)$"),
            "item": first_where(tokens, lambda t: t.rlike("^[IVXLCDM]{1,7}$")),
            "letter": once(F.get(pairs, F.size(pairs) - 2), letter),
        }
        article = behind(["art", "artigo"], r"^\d+$").cast("int")
        return once(article, lambda a: F.struct(a.alias("article"), *(F.when(a.isNotNull(), x).alias(n) for n, x in rest().items())))

    neighbours = lambda folded: F.zip_with(folded, F.slice(folded, F.lit(2), F.greatest(F.size(folded), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return once(tokens, lambda t: once(once(F.transform(t, fold), neighbours), lambda p: named(t, p)))


def provision_path(article: Column, paragraph: Column, item: Column, letter: Column) -> Column:
    """``art5-par3-incIV-alb``; absent levels are left out."""
    level = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    return F.concat_ws("-", level("art", article), level("par", paragraph), level("inc", item), level("al", letter))


def provision_label(article: Column, paragraph: Column, item: Column, letter: Column, norm: Column) -> Column:
    """``Art. 5º, §3º, IV, b da Lei ...``."""
    parts = F.concat_ws(", ", F.concat(F.lit("Art. "), article.cast("string"), F.lit("º")), F.concat(F.lit("§"), paragraph.cast("string"), F.lit("º")), F.upper(item), F.lower(letter))
    return F.concat(parts, F.lit(" da "), norm)


def transient_error(status: Column, message: Column) -> Column:
    """Whether a failed call may succeed when tried again."""
    return status.isin(429, 500, 502, 503, 504) | F.lower(message).rlike("timeout|timed out|econnreset|network|overloaded|rate limit")


def backoff_ms(attempt: Column, base: int = 500) -> Column:
    """Wait before a further attempt, without the random part."""
    return (F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


def control_url(control: Column, base: str) -> Column:
    """The public address of a purchase from its control number ``owner-n-sequence/year``; the bare address if it is none."""
    part = lambda i: F.regexp_extract(control, r"^(\d+)-\d+-(\d+)/(\d+)$", i)
    sequence = F.regexp_replace(part(2), r"^0+(?=\d)", "")
    return F.when(F.coalesce(part(1), F.lit("")) != "", F.concat_ws("/", F.lit(base), F.lit("app/editais"), part(1), part(3), sequence)).otherwise(base)


#: Sections of a ruling: what a label calls them, the form of a mark with a number, what stands before the
#: number, and whether there is no label without one.
RULING_SECTIONS = [
    ("sumario", "sumário", None, "", False),
    ("acordao", "item", r"(?i)^item\s*(\d.*)$", " ", True),
    ("voto", "voto", r"(?i)^p0*(\d+)", " §", False),
    ("relatorio", "relatório", r"(?i)^p0*(\d+)", " §", False),
    ("enunciado", "enunciado", r"^(?:[eE](?=\d))?(.+)$", " ", True),
]


def ruling_place(section: Column, mark: Column) -> Column:
    """struct(name, number) of the place in a ruling that a mark names; null where it names none."""
    found = F.lit(None).cast("struct<name:string,number:string>")
    for key, name, form, before, required in RULING_SECTIONS:
        number = F.nullif(F.regexp_extract(mark, form, 1), F.lit("")) if form else F.lit(None).cast("string")
        place = F.struct(F.lit(name).alias("name"), F.concat(F.lit(before), number).alias("number"))
        found = F.when((section == key) & (number.isNotNull() if required else F.lit(True)), place).otherwise(found)
    return F.when(F.coalesce(mark, F.lit("")) != "", found)


def ruling_label(number: Column, year: Column, body: Column, section: Column, mark: Column) -> Column:
    """``Acórdão 12/2020-TCU-Plenário, voto §5``: paragraph and item numbers only where the mark has one, without leading zeros."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    place = ruling_place(section, mark)
    ruling = F.format_string("Acórdão %s/%s-TCU-%s", shown(number), shown(year), F.coalesce(body, F.lit("")))
    return F.concat_ws("", F.concat_ws(", ", ruling, place["name"]), place["number"])
