"""What is known of kinds of norms: how they are named, and when they can be from."""

from __future__ import annotations

from typing import NamedTuple


class NormKind(NamedTuple):
    kind: str
    #: Pattern of a citation of this kind.
    cited: str
    #: The kind in a slug, and the words by which a readable name has it (joined by spaces, without accents); None: no slug.
    slug: str | None = None
    named: tuple[str, ...] = ()


#: More telling kinds first: a name may hold the words of several.
NORM_KINDS = [
    NormKind("LC", r"lei\s+complementar|lc", "lc", (" lei complementar", " lc ")),
    NormKind("EC", r"emenda\s+constitucional|ec", "ec", (" emenda constitucional", " ec ")),
    NormKind("IN", r"instru[çc][ãa]o\s+normativa|in", "instrucao-normativa", (" instrucao normativa", " in ")),
    NormKind("DL", r"decreto[-\s]+lei|dl"),
    NormKind("MP", r"medida\s+provis[óo]ria|mp"),
    NormKind("DECRETO", r"decreto", "decreto", ("decreto",)),
    NormKind("PORTARIA", r"portaria"),
    NormKind("RESOLUCAO", r"resolu[çc][ãa]o"),
    NormKind("CF", r"(?!)", "constituicao", ("constituicao",)),
    NormKind("LEI", r"lei", "lei", (" lei ",)),
]

#: Years of well-known norms by kind and number.
KNOWN_YEARS = {
    ("LC", "214"): 2025, ("LC", "87"): 1996, ("LC", "116"): 2003, ("LC", "123"): 2006, ("LC", "101"): 2000, ("EC", "132"): 2023,
    ("EC", "87"): 2015, ("EC", "42"): 2003, ("LEI", "5172"): 1966, ("LEI", "8137"): 1990, ("LEI", "9430"): 1996, ("LEI", "9532"): 1997,
    ("LEI", "10637"): 2002, ("LEI", "10833"): 2003, ("DECRETO", "12955"): 2026, ("DECRETO", "9580"): 2018,
}

#: First and last year that a norm of a kind can have.
YEAR_BOUNDS = {
    "LEI": (1824, 2030), "LC": (1967, 2030), "DECRETO": (1889, 2030), "DL": (1937, 1988), "IN": (1990, 2030),
    "PORTARIA": (1950, 2030), "RESOLUCAO": (1950, 2030), "MP": (1988, 2030), "EC": (1992, 2030),
}

#: Norms that are cited by a name, without a number.
NAMED_NORMS = [
    (r"constitui[çc][ãa]o(?:\s+federal|\s+da\s+rep[úu]blica)?", "CF-1988"),
    (r"CF(?:/(?:19)?88)?", "CF-1988"),
    (r"carta\s+magna", "CF-1988"),
    (r"c[óo]digo\s+tribut[áa]rio\s+nacional", "LEI-5.172-1966"),
    (r"CTN", "LEI-5.172-1966"),
    (r"lei\s+kandir", "LC-87-1996"),
]
