"""A search index on disk: one build, many queries, and rows that come and go.

An index is a folder of segments that are never changed, and a list of manifests, of which the newest counts. A segment has

* ``rows``: (key, text, grams, part), as they came; a part is some thousand rows of one file,
* ``terms``: (term, block, key, tf, length, positions); the empty term has a row of each text, with its length,
* ``blocks``: of each term and block in a run the greatest tf, the least length and the number of rows,
* ``grams``: (gram, part, keys), the character trigrams of lower-cased texts, and ``gram_counts``.

Each task inverts the texts of its own file, run by run, and nothing is shuffled: a table of terms or trigrams is a row of
runs, each in order, so a query on a few terms, a prefix or a few trigrams opens the pages of each run that can hold them.
An index may be made without terms, blocks or grams, and be given them later. Blocks put together rows of like length, on
which the weight of a term depends most: a search for the best k scores, after the most promising blocks, only those whose
greatest possible score reaches the k-th best.

Rows that are replaced or deleted become tombstones; reading leaves them out and takes them off the figures. Small segments
are merged when there are many. A manifest is written under the next number, which only one writer can take.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ACCENTED, PLAIN, fold
from ..functions.text import terms as terms_of
from .lexical import LATE, LATE_LOWER, idf, needle, saturated, substring_tokens, times

#: What an index can have besides its rows.
PARTS = ("terms", "blocks", "grams")
#: Blocks of rows of like length: so many for each doubling of the length, each dealt over so many.
BANDS, SPREAD = 4, 4
#: Segments from which on the smaller half is merged.
MOST_SEGMENTS = 8
#: Rare trigrams that are intersected for a substring.
RARE = 3
#: Tombstones that are broadcast; more are joined by shuffling.
BROADCAST_DELETED = 200_000
#: Keys that are broadcast in lists by part (of rows that may hold a substring or are deleted); more are joined by shuffling. Parts that are asked for by number.
BROADCAST_KEYS, ASKED_PARTS = 2_000_000, 1_000
#: Bytes of text that are inverted together, for terms and for trigrams; rows at most; rows that leave together.
TERM_RUN, GRAM_RUN, RUN_ROWS, LEAVING = 8_000_000, 4_000_000, 2**16, 2**16
FIGURES = ("n", "length", "grams")


class SearchIndex:
    """The newest state of an index below ``path``."""

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...] = PARTS):
        """``parts``: what a new index has besides its rows; one that is there has what it was given."""
        self.spark, self.path, self.parts = spark, path.rstrip("/"), [p for p in PARTS if p in parts]
        self.reload()

    # -- manifests ---------------------------------------------------------------------------------------------------
    def reload(self) -> None:
        try:
            newest = self.spark.read.text(f"{self.path}/manifests/*").select(F.from_json("value", "version long, body string").alias("m")).select("m.*").orderBy(F.desc("version")).first()
        except AnalysisException:  # nothing has been written yet
            newest = None
        self.version = newest.version if newest else 0
        body = json.loads(newest.body) if newest else {"segments": {}, "deleted": [], "n_deleted": 0, "key": None, "parts": self.parts}
        self.segments, self.deleted, self.n_deleted, self.key, self.parts = body["segments"], body["deleted"], body["n_deleted"], body["key"], body["parts"]

    def _publish(self) -> None:
        """Writes the state as the next version; fails if another writer has taken the number."""
        body = json.dumps({"segments": self.segments, "deleted": self.deleted, "n_deleted": self.n_deleted, "key": self.key, "parts": self.parts})
        self.version += 1
        row = self.spark.range(1).select(F.to_json(F.struct(F.lit(self.version).cast("long").alias("version"), F.lit(body).alias("body"))).alias("value"))
        row.coalesce(1).write.mode("error").text(f"{self.path}/manifests/{self.version:010d}")

    # -- writing -----------------------------------------------------------------------------------------------------
    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Rows of ``docs`` (keys not null, each once): those whose key is there already take its place."""
        if self.key not in (None, key):
            raise ValueError(f"the key of this index is {self.key}")
        self.key = key
        name = uuid.uuid4().hex
        figures = self._write(docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text")), name)
        self._bury(self.spark.read.parquet(self._at(name, "rows")).select(key))
        self.segments[name] = figures
        self._publish()
        if len(self.segments) > MOST_SEGMENTS:
            self.merge()

    def ensure(self, *parts: str) -> None:
        """Makes those of ``parts`` that the index hasn't got, from its texts."""
        new = [p for p in PARTS if p not in self.parts and (p in parts or (p == "terms" and "blocks" in parts))]
        if not new:
            return
        for name in self.segments:
            self._write_parts(name, new)
        self.parts = [p for p in PARTS if p in [*self.parts, *new]]
        if "terms" in new and self.segments:
            sums = {r.segment: r.length for r in self._live("terms", where=F.col("term") == "").groupBy("segment").agg(F.sum("length").alias("length")).collect()}  # a row a segment
            self.segments = {s: v | {"length": sums.get(s) or 0} for s, v in self.segments.items()}
        self._publish()

    def delete(self, keys: DataFrame) -> None:
        """Takes out the rows of the keys in the first column of ``keys``."""
        self._bury(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct())
        self._publish()

    def merge(self, least: int | None = None) -> None:
        """Makes one segment of the smaller half of all (or of the ``least`` smallest), without what has been deleted."""
        names = sorted(self.segments, key=lambda s: (self.segments[s]["n"], s))
        names = names[: least or (len(names) + 1) // 2]
        if not names:
            return
        name = uuid.uuid4().hex
        merged = self._write(self._live("rows", names).select(self.key, "text"), name)
        kept = self._deleted().where(~F.col("segment").isin(names))
        self.segments = {s: v for s, v in self.segments.items() if s not in names} | {name: merged}
        self.n_deleted = kept.count()
        at = f"deleted/{uuid.uuid4().hex}"
        kept.write.parquet(f"{self.path}/{at}")
        self.deleted = [at]
        self._publish()

    def _at(self, segment: str, table: str) -> str:
        return f"{self.path}/segments/{segment}/{table}"

    def _save(self, rows: DataFrame, name: str, table: str) -> None:
        rows.write.option("compression", "zstd").parquet(self._at(name, table))

    def _write(self, given: DataFrame, name: str) -> dict[str, int]:
        """Makes a segment of rows (key, text); its figures."""
        cores = self.spark.sparkContext.defaultParallelism
        given = given.repartition(cores) if given.rdd.getNumPartitions() < cores else given
        part = F.shiftright(F.monotonically_increasing_id(), 12)
        self._save(given.select(self.key, "text", F.greatest(F.length("text") - 2, F.lit(0)).cast("long").alias("grams"), part.alias("part")), name, "rows")
        figures = self.spark.read.parquet(self._at(name, "rows")).agg(F.count("*").alias("n"), F.sum("grams").alias("grams"), F.count_distinct(self.key).alias("keys")).first()
        if figures.n != figures["keys"]:
            raise ValueError("a key stands on several rows of one batch")
        self._write_parts(name, self.parts)
        length = self.spark.read.parquet(self._at(name, "terms")).where("term = ''").agg(F.sum("length")).first()[0] if "terms" in self.parts else 0
        return {"n": figures.n, "length": length or 0, "grams": figures.grams or 0}

    def _write_parts(self, name: str, parts: list[str]) -> None:
        rows = self.spark.read.parquet(self._at(name, "rows"))
        if "terms" in parts:
            self._save(_terms(rows, self.key), name, "terms")
        if "blocks" in parts:
            self._save(_blocks(self.spark.read.parquet(self._at(name, "terms"))), name, "blocks")
        if "grams" in parts:
            self._save(_grams(rows, self.key), name, "grams")
            counts = self.spark.read.parquet(self._at(name, "grams")).groupBy("gram").agg(F.sum(F.size("keys")).cast("long").alias("rows"))
            self._save(counts.sortWithinPartitions("gram"), name, "gram_counts")

    def _bury(self, keys: DataFrame) -> None:
        """Adds tombstones for the live rows of ``keys`` and takes these off the figures of their segments."""
        if not self.segments:
            return
        dead = self._live("rows").select("segment", "part", self.key, "grams").join(keys, self.key, "left_semi")
        if "terms" in self.parts:
            dead = dead.join(self._table("terms", list(self.segments)).where("term = ''").select("segment", self.key, "length"), ["segment", self.key])
        else:
            dead = dead.withColumn("length", F.lit(0).cast("long"))
        at = f"deleted/{uuid.uuid4().hex}"
        dead.select("segment", "part", self.key, "length", "grams").write.parquet(f"{self.path}/{at}")
        found = self.spark.read.parquet(f"{self.path}/{at}").groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum("grams").alias("grams")).collect()  # a row a segment
        if found:
            self.deleted = [*self.deleted, at]
            self.segments = {s: dict(v) for s, v in self.segments.items()}
        for r in found:
            self.n_deleted += r.n
            for x in FIGURES:
                self.segments[r.segment][x] -= r[x]

    # -- reading -----------------------------------------------------------------------------------------------------
    def _deleted(self) -> DataFrame:
        if not self.deleted:
            return self._table("rows", list(self.segments)).select("segment", "part", self.key).where("false")
        return self.spark.read.parquet(*(f"{self.path}/{x}" for x in self.deleted)).select("segment", "part", self.key, "length", "grams")

    def _table(self, table: str, names: list[str]) -> DataFrame:
        found = None
        for s in names:
            one = self.spark.read.parquet(self._at(s, table)).withColumn("segment", F.lit(s))
            found = one if found is None else found.unionByName(one)
        return found

    def _live(self, table: str, names: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a table in the given segments (all), those that ``where`` holds of, without the deleted ones."""
        rows = self._table(table, list(self.segments) if names is None else names)
        return self._alive(rows.where(where) if where is not None else rows)

    def _alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with segment and key) without the deleted ones; texts stay where they are while the tombstones can be broadcast."""
        if not self.deleted:
            return rows
        if {"part", "text"} <= {*rows.columns} and self.n_deleted <= BROADCAST_KEYS:
            dead = self._deleted().groupBy("segment", "part").agg(F.collect_list(self.key).alias("dead"))
            kept = rows.join(F.broadcast(dead), ["segment", "part"], "left").where(~F.coalesce(F.array_contains("dead", F.col(self.key)), F.lit(False)))
            return kept.select(rows.columns)
        dead = self._deleted().select("segment", self.key)
        return rows.join(F.broadcast(dead) if self.n_deleted <= BROADCAST_DELETED else dead, ["segment", self.key], "left_anti")

    def _needs(self, part: str) -> None:
        if part not in self.parts:
            raise ValueError(f"this index has no {part}; ensure() makes them")

    def figures(self, length: str) -> tuple[int, float]:
        """Number of rows and mean of ``length`` or ``grams``."""
        n = sum(v["n"] for v in self.segments.values())
        return n, (sum(v[length] for v in self.segments.values()) / n if n else 0.0)

    def rows(self) -> DataFrame:
        """(key, text) of all rows."""
        return self._live("rows").select(self.key, "text")

    def _counts(self, token: str, prefix: bool, blocks: Column | None = None) -> DataFrame:
        """(key, tf, length, block) of the rows that hold a token: a term, a phrase, or (``prefix``) one whose last term only begins so."""
        parts = needle(token).split(" ")
        found = None
        for i, part in enumerate(parts):
            begins = prefix and i == len(parts) - 1
            holds = F.col("term").startswith(part) if begins else F.col("term") == part
            rows = self._live("terms", where=holds & blocks if blocks is not None else holds)
            if begins:  # several terms of a row may begin so
                rows = rows.groupBy("segment", self.key, "length", "block").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
            if len(parts) == 1:
                return rows.select(self.key, "tf", "length", "block")
            starts = _moved("positions", i)
            if found is None:
                found = rows.select("segment", self.key, "length", "block", starts.alias("starts"))
            else:
                more = rows.select("segment", self.key, starts.alias("more"))
                found = found.join(more, ["segment", self.key]).withColumn("starts", F.array_intersect("starts", "more")).drop("more").where(F.size("starts") > 0)
        # occurrences that overlap count once, as in a text that is searched from its beginning
        apart = F.aggregate(
            F.array_sort("starts"),
            F.struct(F.lit(-(2**31)).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.when(p >= s["last"] + len(parts), F.struct(p.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s),
        )
        return found.select(self.key, apart["n"].alias("tf"), "length", "block")

    def search(self, tokens: list[str], every: bool = False, prefix: bool = False) -> DataFrame:
        """(key, score): BM25 of the rows that hold any (or ``every``) one of the tokens, as the operator of that name scores.

        Repeated tokens count again; tokens without a letter or digit match nothing.
        """
        asked = [t for t in tokens if needle(t)]
        if not asked or not self.segments or (every and len(asked) < len(tokens)):
            return self._nothing()
        self._needs("terms")
        n, mean = self.figures("length")
        return self._scored([self._counts(t, prefix) for t in asked], n, mean, len(asked) if every else 1)

    def _scored(self, counts: list[DataFrame], n: int, mean: float, least: int, weights: list[float] | None = None) -> DataFrame:
        every = None
        for i, c in enumerate(counts):
            c = c.select(F.lit(i).alias("token"), self.key, "tf", "length")
            every = c if every is None else every.unionByName(c)
        if weights is None:
            every = every.persist(StorageLevel.MEMORY_AND_DISK)  # a few numbers a posting: read and joined once
            df = every.groupBy(F.col("token").alias("d_token")).agg(idf(F.lit(n), F.count("*")).alias("weight"))  # a row a token
            every = every.join(F.broadcast(df), F.col("token") == F.col("d_token"))
        else:
            every = every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("token") + 1))
        scored = every.groupBy(self.key).agg(F.sum(F.col("weight") * saturated(F.col("tf"), F.col("length"), F.lit(mean))).alias("score"), F.count("*").alias("held"))
        return scored.where(F.col("held") >= least).select(self.key, "score")

    def _nothing(self) -> DataFrame:
        kind = self._table("rows", list(self.segments)).select(self.key) if self.segments else self.spark.range(0).select(F.col("id").alias(self.key or "key"))
        return kind.where("false").withColumn("score", F.lit(0.0))

    def best(self, tokens: list[str], k: int, first: int = 8) -> DataFrame:
        """(key, score, rank): the ``k`` best rows that hold any of the tokens (single terms), scores to 6 digits, ties by key.

        The blocks of the terms tell how much a row of theirs can score. The ``first`` most promising are searched, then
        those which may hold a row as good as the k-th best of these.
        """
        asked = [needle(t) for t in tokens if needle(t)]
        if any(" " in t for t in asked):
            raise ValueError("phrases have no blocks")
        place = F.row_number().over(Window.orderBy(F.desc("score"), self.key or "key")).cast("long")
        if not asked or not self.segments:
            return self._nothing().withColumn("rank", place)
        self._needs("blocks")
        n, mean = self.figures("length")
        if self.deleted:  # tombstones change how many rows hold a term
            held = self._live("terms", where=F.col("term").isin(asked)).groupBy("term").agg(F.count("*").alias("rows"))
        else:
            held = self._table("blocks", list(self.segments)).where(F.col("term").isin(asked)).groupBy("term").agg(F.sum("rows").alias("rows"))
        weight = {r.term: r.weight for r in held.select("term", idf(F.lit(n), F.col("rows")).alias("weight")).collect()}  # the query's terms
        weights = [weight.get(t, 0.0) for t in asked]
        bounds = self._table("blocks", list(self.segments)).where(F.col("term").isin(asked))
        times_asked = F.element_at(F.create_map(*(x for t in dict.fromkeys(asked) for x in (F.lit(t), F.lit(asked.count(t) * weight.get(t, 0.0))))), F.col("term"))
        by_term = bounds.groupBy("block", "term").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        bounds = by_term.groupBy("block").agg(F.sum(times_asked * saturated(F.col("most"), F.col("shortest"), F.lit(mean))).alias("bound")).orderBy(F.desc("bound"), "block").collect()  # a row a block: some hundreds
        scored = lambda blocks: self._scored([self._counts(t, False, F.col("block").isin(blocks)) for t in asked], n, mean, 1, weights).withColumn("score", F.round("score", 6))
        cut = lambda found: found.orderBy(F.desc("score"), self.key).limit(k)
        tried = [b.block for b in bounds[:first]]
        best = [r.score for r in cut(scored(tried)).select("score").collect()] if len(bounds) > first else []  # k numbers at most
        self.read_blocks = [b.block for b in bounds if not best or len(best) < k or b.bound + 1e-6 >= min(best)]
        return cut(scored(self.read_blocks)).withColumn("rank", place)

    def substring(self, query: str) -> DataFrame:
        """(key, score) of the rows that hold a query token of three or more characters anywhere, as ``substring_lane`` scores.

        Of each token the rarest trigrams are intersected; only rows that have them are held against the token, and where few
        parts have such rows only those parts are read.
        """
        tokens = substring_tokens(query)
        if not tokens or not self.segments:
            return self._nothing()
        self._needs("grams")
        parts = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in tokens}
        every = sorted({g for grams in parts.values() for g in grams})
        counts = self._table("gram_counts", list(self.segments)).where(F.col("gram").isin(every)).groupBy("gram").agg(F.sum("rows").alias("rows"))
        rows = {r.gram: r["rows"] for r in counts.collect()}  # the query's trigrams
        rare = {t: sorted(grams, key=lambda g: (rows.get(g, 0), g))[:RARE] for t, grams in parts.items()}
        wanted = sorted({g for grams in rare.values() for g in grams})
        held = self._table("grams", list(self.segments)).where(F.col("gram").isin(wanted)).groupBy("segment", "part")
        near = held.agg(*(F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("keys")))).alias(f"g{i}") for i, g in enumerate(wanted)))
        for i, t in enumerate(tokens):
            keys = [F.col(f"g{wanted.index(g)}") for g in rare[t]]
            for more in keys[1:]:
                keys[0] = F.array_intersect(keys[0], more)
            near = near.withColumn(f"may{i}", keys[0])
        may = [F.col(f"may{i}") for i in range(len(tokens))]
        near = near.where(sum(map(F.size, may), F.lit(0)) > 0).select("segment", "part", *may).persist(StorageLevel.MEMORY_AND_DISK)
        found = near.agg(F.count("*").alias("parts"), F.sum(sum(map(F.size, may), F.lit(0))).alias("keys")).first()
        texts = self._table("rows", list(self.segments))
        if found.parts <= ASKED_PARTS:
            texts = texts.where(F.col("part").isin([r.part for r in near.select("part").distinct().collect()]))
        texts = texts.join(F.broadcast(near) if (found["keys"] or 0) <= BROADCAST_KEYS else near, ["segment", "part"])
        has = [F.array_contains(m, F.col(self.key)) for m in may]
        texts = texts.select("segment", self.key, "text", "grams", *(h.alias(f"may{i}") for i, h in enumerate(has))).where(" or ".join(f"may{i}" for i in range(len(may))))
        low = texts.withColumn("low", F.lower("text"))
        counted = low.select("segment", self.key, F.col("grams").alias("length"), *(F.when(F.col(f"may{i}"), times(F.col("low"), t)).otherwise(0).alias(f"sf{i}") for i, t in enumerate(tokens)))
        # a few numbers of each row that holds a token: texts are read once
        counted = self._alive(counted.where(" or ".join(f"sf{i} > 0" for i in range(len(tokens))))).persist(StorageLevel.MEMORY_AND_DISK)
        n, mean = self.figures("grams")
        whole = counted.agg(*(idf(F.lit(n), F.count_if(F.col(f"sf{i}") > 0)).alias(f"w{i}") for i in range(len(tokens))))
        score = sum((F.col(f"w{i}") * saturated(F.col(f"sf{i}"), F.col("length"), F.lit(mean)) for i in range(len(tokens))), F.lit(0.0))
        return counted.join(F.broadcast(whole)).select(self.key, score.alias("score"))


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _block(length: Column, key: str) -> Column:
    band = F.floor(F.log2(length + 1) * BANDS)
    return (band * SPREAD + F.pmod(F.xxhash64(key), F.lit(SPREAD))).cast("int")


def _postings(rows: DataFrame, key: str) -> DataFrame:
    """(term, block, key, tf, length, positions) of rows (key, text, length), by grouping: what ``_terms`` is held against."""
    # texts are dealt by key, so that the places of a term meet where its text was split: places don't travel
    each = rows.repartition(key).select(key, "length", _block(F.col("length"), key).alias("block"), F.posexplode(terms_of("text")).alias("pos", "term"))
    return each.groupBy(key, "length", "block", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions")).select("term", "block", key, F.size("positions").cast("long").alias("tf"), "length", "positions")


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a column and RUN_ROWS rows at most."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + most, "right"))), start + RUN_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a value stands for the first time."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


#: Letters of a lower-cased term, and what they are folded to; LATE stands for letters that stay.
_FOLDED = str.maketrans(ACCENTED.lower() + LATE, PLAIN.lower() + LATE_LOWER)


def _inverted(keys: pa.Array, spread: pa.Array, forms: pa.StringArray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The terms of a run: texts whose terms stand between single spaces."""
    split = pc.split_pattern(forms.cast(pa.string()), " ")
    lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
    whole, places = split.flatten(), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = pc.binary_length(forms).to_numpy(zero_copy_only=False) > 0
    some_terms = np.repeat(some, lengths)  # an empty text is split into one empty term
    lengths = lengths * some
    block = np.floor(np.log2(lengths + 1) * BANDS).astype(np.int32) * SPREAD + spread.to_numpy(zero_copy_only=False).astype(np.int32)
    order = pc.sort_indices(pa.table({"block": block, "key": keys}), sort_keys=[("block", "ascending"), ("key", "ascending")]).to_numpy().astype(np.int64)
    n, keys, block, lengths_in_order = len(order), keys.take(pa.array(order)), block[order], lengths[order]
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)

    def out(term: pa.Array, row: np.ndarray, tf: np.ndarray, positions: pa.Array) -> Iterator[pa.RecordBatch]:
        columns = [term, pa.array(block[row]), keys.take(pa.array(row)), pa.array(tf), pa.array(lengths_in_order[row]), positions]
        made = pa.RecordBatch.from_arrays(columns, names=names)
        yield from (made.slice(i, LEAVING) for i in range(0, made.num_rows, LEAVING))

    yield from out(pa.array([""] * n, pa.string()), np.arange(n), np.zeros(n, np.int64), _lists(np.zeros(n, np.int64), pa.array([], pa.int32())))
    if not some.any():
        return
    met = whole.dictionary_encode()
    folded = pa.array([t if t.isascii() else t.translate(_FOLDED) for t in met.dictionary.to_pylist()], pa.string()).dictionary_encode()
    in_order = pc.sort_indices(folded.dictionary)
    rank = np.empty(len(in_order), np.int64)
    rank[in_order.to_numpy()] = np.arange(len(in_order))
    term = rank[folded.indices.to_numpy()][met.indices.to_numpy()][some_terms]
    row, widest = np.repeat(place_of[some], lengths[some]), int(lengths.max())
    # term, row and place of each word in one number: runs are short enough for 63 bits
    packed = np.sort((term * n + row) * widest + places[some_terms])
    pairs = packed // widest
    starts = _firsts(pairs)
    pairs_of, tf = pairs[starts], np.diff(np.append(starts, len(packed)))
    yield from out(folded.dictionary.take(in_order).take(pa.array(pairs_of // n)), pairs_of % n, tf, _lists(starts, pa.array((packed - pairs * widest).astype(np.int32))))


def _terms(rows: DataFrame, key: str) -> DataFrame:
    """(term, block, key, tf, length, positions) of rows (key, text): runs in order of term, block and key, without a shuffle.

    Texts are lower-cased and split once; accents are taken off the distinct terms of a run.
    """
    late = F.col("text").contains(LATE[0]) | F.col("text").contains(LATE[1])
    low = F.when(late, F.translate(fold("text"), LATE_LOWER, LATE)).otherwise(F.lower("text"))
    form = F.trim(F.regexp_replace(F.coalesce(low, F.lit("")), r"[^\p{L}\p{N}]++", " "))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.IntegerType()), rows.schema[key], T.StructField("tf", T.LongType()), T.StructField("length", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 2, TERM_RUN):
            yield from _inverted(*part.columns, schema.names)

    return rows.select(key, F.pmod(F.xxhash64(key), F.lit(SPREAD)).alias("spread"), form.alias("form")).mapInArrow(run, schema)


def _blocks(terms: DataFrame) -> DataFrame:
    """(term, block, most, shortest, rows) of a table of terms: neighbours in its runs are put together, without a shuffle."""
    schema = T.StructType([terms.schema["term"], terms.schema["block"], *(T.StructField(c, T.LongType()) for c in ("most", "shortest", "rows"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, block, tf, length = batch.columns
            other = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], other]))
            figures = [np.maximum.reduceat(tf.to_numpy(), starts), np.minimum.reduceat(length.to_numpy(), starts), np.diff(np.append(starts, batch.num_rows))]
            yield pa.RecordBatch.from_arrays([term.take(pa.array(starts)), block.take(pa.array(starts)), *map(pa.array, figures)], names=schema.names)

    return terms.where("term <> ''").select("term", "block", "tf", "length").mapInArrow(run, schema)


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """(gram, part, keys): which rows of a part hold a character trigram in their lower-cased text; runs in order of gram, without a shuffle."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("part", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches, 2, GRAM_RUN):
            numbers = piece.column(1).to_numpy()
            edges = [*_firsts(numbers).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:]):
                for grams, holders in _trigrams(piece.column(0)[a:b], piece.column(2)[a:b].cast(pa.string())):
                    made = pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(grams), numbers[a])), holders], names=schema.names)
                    yield from (made.slice(i, LEAVING) for i in range(0, made.num_rows, LEAVING))

    return rows.select(key, "part", F.coalesce(F.lower("text"), F.lit("")).alias("low")).mapInArrow(run, schema)


def _letters(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins and the last one ends."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]])
    if raw.isascii():
        return np.frombuffer(raw, np.uint8), at - at[0]
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), begins[at - at[0]]


def _trigrams(keys: pa.Array, texts: pa.StringArray) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """The distinct trigrams in order, and the keys of the texts that hold each; in pieces where numbers of 63 bits don't suffice."""
    letters, ends = _letters(texts)
    n, known = len(texts), np.flatnonzero(np.bincount(letters))
    if n > 1 and len(known) ** 3 * n >= 2**63:
        for half in (slice(None, n // 2), slice(n // 2, None)):
            yield from _trigrams(keys[half], texts[half])
    elif len(letters) >= 3:
        row = np.repeat(np.arange(n), np.diff(ends))
        number = np.zeros(known[-1] + 1, np.int64)
        number[known] = np.arange(len(known))
        x = number[letters]
        packed = np.sort((((x[:-2] * len(known) + x[1:-1]) * len(known) + x[2:]) * n + row[:-2])[row[2:] == row[:-2]])
        packed = packed[_firsts(packed)]
        grams = packed // n
        starts = _firsts(grams)
        codes, holders = grams[starts], packed - grams * n
        spelt = np.stack([known[codes // len(known) ** 2], known[codes // len(known) % len(known)], known[codes % len(known)]], 1).astype("<u4").tobytes().decode("utf-32-le")
        yield pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)], pa.string()), _lists(starts, keys.take(pa.array(holders)))
