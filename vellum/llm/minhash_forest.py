"""Near-duplicates by MinHash and an LSH forest, confirmed on full sets.

Each distinct set of four-word shingles has ``VALUES`` min-hashes. A tree of the forest is one order of them: tree k sorts
the signatures by the values from place k * ``STRIDE`` on, all others after them. Sets with a long common prefix are
neighbours in that order and become candidates. How long is told region by region: sets that share the first value are a
region; one of more than ``CROWD`` sets is parted by more values, until no region is crowded.

A crowded region is looked at on each level too, in parts dealt by hash, each of which also holds the region's first set,
so a set that leaves a large group of copies as the prefix grows meets the group before.

In a region, and in a part, sets are compared by one byte of each min-hash: those that agree in fewer than ``AGREE``
places, or whose sizes differ too much, are no candidates (a pair at the threshold falls below once in ten million). In a
first pass every set looks for the first set of its regions that agrees with it, and one such pair a set is confirmed by
the texts; what is linked has one root. A second pass takes all candidates of different roots, without any cap: only the
sets that have one leave their task, their texts are delivered to the regions, and there all candidates are held against
each other in full. Each pair of sets is looked at in the first tree only in which both share a whole region by one value:
the first values of both, and which of their regions are whole, tell. What leaves a region are links between roots, fewer than it has sets. A pair of similarity s meets in a tree at depth d with probability s^d: at the threshold 16 trees miss
one in 10^11 at depth 1, one in 10^7 at depth 2, one in 50,000 at depth 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components, forest_roots
from .jaccard_join import keyed_sets, linked
from .sentencepiece_codec import slices
from .shared import scratch, settled, small_side, written
from .shingles import shingle_sets

#: Words of a shingle; least similarity in hundredths.
WORDS, LEAST = 4, 80
#: Trees, and values by which each begins before the others'.
TREES, STRIDE = 16, 8
VALUES = TREES * STRIDE
#: Places in which the signatures of candidates agree at least.
AGREE = 80
#: Sets of a region that are compared with each other; more part it.
CROWD = 1024
#: Most addresses of texts that are broadcast (some 200 bytes each); more are joined by shuffling.
BROADCAST_ADDRESSED = 100_000

_rng = np.random.default_rng(20240401)
_TURN = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, VALUES, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), VALUES) min-hashes (uint32) of sets of 64-bit hashes; those of empty sets are 0."""
    sizes = np.array([len(x) for x in sets], np.int64)
    found = np.zeros((len(sets), VALUES), np.uint32)
    some = sizes > 0
    if some.any():
        flat = np.concatenate(sets)
        begins = np.cumsum(np.concatenate([[0], sizes[some]]))[:-1]
        for i in range(VALUES):
            x = (flat ^ _TURN[i]) * _FACTOR[i]
            x ^= x >> np.uint64(29)
            found[some, i] = np.minimum.reduceat(x * _FACTOR[i - 1], begins) >> np.uint64(32)
    return found


def alike(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Which of ``members`` reach the similarity with ``query``; all are sorted arrays of distinct shingles."""
    sizes = np.array([len(x) for x in members])
    flat = np.concatenate(members)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    both = np.bincount(np.repeat(np.arange(len(members)), sizes)[query[at] == flat], minlength=len(members))
    return 100 * both >= LEAST * (len(query) + sizes - both)


def _set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, set, other, values, bytes): size and hashes of each document's set, its min-hashes, one byte of each."""
    longs = [T.StructField(x, T.LongType()) for x in ("key", "n", "set", "other")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("values", T.BinaryType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, 2, 1_000_000):
                sets = shingle_sets(part.column(2).to_pylist(), WORDS)
                values = signatures(sets)
                digests = [pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)) for seed in (0, 1)]
                large, small = values.astype(">u4"), values.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), *digests, pa.array([x.tobytes() for x in large], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary())],
                    names=["doc_id", "key", "n", "set", "other", "values", "bytes"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def _signed(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(set, n, values, bytes), one row for each distinct set."""
    first = reps.select(F.col("set").alias("r_set"), "rep")
    mine = (F.col("set") == F.col("r_set")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.key"))
    return sets.where("n > 0").join(first, mine).select("set", "n", "values", "bytes").dropDuplicates(["set"])


def _value(tree: str, depth: int) -> F.Column:
    """The bytes of one value: that at ``depth`` (from 0) in the order of a tree."""
    place = F.pmod(F.col(tree) * STRIDE + depth, F.lit(VALUES))
    return F.substring("values", place * 4 + 1, F.lit(4))


def _deeper(depth: int) -> int:
    return min(VALUES, depth + 1 if depth < 4 else depth + depth // 2)


def _regions(signed: DataFrame, crowd: int) -> DataFrame:
    """(region, set, tree) of all regions and parts of crowded regions that hold two sets or more.

    tree is that of a whole region of sets with the same first value, -1 for all others.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = signed.select("set", "values", trees).select("set", "tree", F.xxhash64("tree", _value("tree", 0)).alias("prefix"))
    depth, found = 1, []
    while True:
        rows = written(rows, "forest-rows")
        sizes = rows.groupBy(F.col("tree").alias("p_tree"), F.col("prefix").alias("p_prefix")).agg(F.count("*").alias("size"), F.min("set").alias("first")).where("size > 1")
        shared = written(rows.join(sizes, (F.col("tree") == F.col("p_tree")) & (F.col("prefix") == F.col("p_prefix"))).select("set", "tree", "prefix", "size", "first"), "forest-shared")
        parts = F.ceil(F.col("size") / crowd)
        whole = F.when((F.lit(depth) == 1) & (F.col("size") <= crowd), F.col("tree")).otherwise(-1).alias("whole_of")
        dealt = shared.select("set", F.xxhash64("tree", F.lit(depth), "prefix", F.pmod(F.xxhash64("set", "tree"), parts)).alias("region"), whole.alias("tree"))
        crowded = shared.where(F.col("size") > crowd)
        firsts = crowded.where("set = first").select("set", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "tree", "prefix")
        found.append(written(dealt.unionByName(firsts.select("set", F.xxhash64("tree", F.lit(depth), "prefix", "part").alias("region"), F.lit(-1).alias("tree"))).distinct(), "forest-regions"))
        if depth == VALUES or crowded.limit(1).count() == 0:
            break
        further = _deeper(depth)
        known = signed.select(F.col("set").alias("v_set"), "values")
        rows = crowded.join(known, F.col("set") == F.col("v_set")).select("set", "tree", F.xxhash64("prefix", *(_value("tree", d) for d in range(depth, further))).alias("prefix"))
        depth = further
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every


class Region:
    """The sets of a region that a task has gathered: numbers, sizes, one byte of each min-hash, and for the second pass
    roots, the first values of all trees, and in which trees these make a whole region."""

    def __init__(self, rows: list[tuple], tree: int = -1):
        self.own, self.n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.values = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), VALUES)
        if len(rows[0]) > 3:
            self.root = np.array([r[3] for r in rows], np.int64)
            self.begins = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), TREES)
            trees = np.arange(TREES if tree < 0 else tree)
            self.before = (np.array([r[5] for r in rows])[:, None] >> trees & 1).astype(bool)

    def near(self, i: int, others: np.ndarray, roots: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places ``others`` that may be similar to place ``i``, and places in which they agree.

        With ``roots`` only those of other roots that don't meet ``i`` in an earlier tree.
        """
        may = 100 * np.minimum(self.n[others], self.n[i]) >= LEAST * np.maximum(self.n[others], self.n[i])
        if roots:
            may &= self.root[others] != self.root[i]
            others, may = others[may], may[may]
            trees = np.flatnonzero(self.before[i])
            may &= ~(self.begins[others][:, trees] == self.begins[i, trees]).any(axis=1)
        others = others[may]
        same = (self.values[others] == self.values[i]).sum(axis=1)
        return others[same >= AGREE], same[same >= AGREE]

    def first_pairs(self) -> tuple[list, list, list]:
        """Each place with the first that agrees with it and with no place before: numbers of both, places in which they agree."""
        a, b, agree = [], [], []
        left = np.arange(len(self.own))
        while len(left) > 1:
            near, same = self.near(left[0], left[1:], False)
            a += self.own[near].tolist()
            b += [int(self.own[left[0]])] * len(near)
            agree += same.tolist()
            left = np.setdiff1d(left[1:], near, assume_unique=True)
        return a, b, agree

    def open_places(self) -> np.ndarray:
        """The places that may be similar to one of another root."""
        found = np.zeros(len(self.own), bool)
        for i in range(len(self.own) - 1):
            near, _ = self.near(i, np.arange(i + 1, len(self.own)), True)
            found[near] = True
            found[i] |= len(near) > 0
        return np.flatnonzero(found)

    def links(self, sets: list[np.ndarray]) -> tuple[list, list]:
        """Pairs of similar sets of different roots; roots that have been linked count as one from then on."""
        a, b = [], []
        for i in range(len(self.own) - 1):
            near, _ = self.near(i, np.arange(i + 1, len(self.own)), True)
            for j in near[alike(sets[i], [sets[k] for k in near])] if len(near) else ():
                if self.root[j] != self.root[i]:
                    a.append(int(self.own[j]))
                    b.append(int(self.own[i]))
                    self.root[self.root == self.root[j]] = self.root[i]
        return a, b


def _by_region(rows: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` on the rows (first ``region``, then ``columns``) of each region, which it gets as a list of tuples.

    A region is held in memory whole: it has ``crowd`` sets and one more at most.
    """
    sent = rows.select("region", *columns).repartition("region").sortWithinPartitions("region", "set")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)
        for batch in batches:
            for part in slices(batch, len(columns), 4_000_000) if columns[-1] == "text" else [batch]:
                for region, *row in zip(*(part.column(i).to_pylist() for i in range(len(columns) + 1)), strict=True):
                    if region != at:
                        if len(held) > 1:
                            yield made(work(at, held))
                        at, held = region, []
                    if columns[-1] == "text":  # sets take the place of texts as these come
                        row[-1] = shingle_sets([row[-1]], WORDS)[0]
                    if not held or held[-1][0] != row[0]:  # a repeated document brings its set more than once
                        held.append(row)
        if len(held) > 1:
            yield made(work(at, held))

    return sent.mapInArrow(run, schema)


def _first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, agree) of ``rows`` (region, set, n, bytes): a set, and the first set of its region that agrees with it."""
    return _by_region(rows, ["set", "n", "bytes"], "a long, b long, agree long", lambda at, held: Region(held).first_pairs())


#: What the second pass knows of a set in a region.
KNOWN = ["set", "n", "bytes", "root", "begins", "whole_in", "tree"]


def _open_sets(rows: DataFrame) -> DataFrame:
    """(region, set, root, tree) of the rows (region and KNOWN) that have a candidate of another root in their region."""

    def work(at: int, held: list) -> tuple:
        region = Region(held, held[0][6])
        places = region.open_places()
        return np.full(len(places), at), region.own[places], region.root[places], np.full(len(places), held[0][6])

    return _by_region(rows, KNOWN, "region long, set long, root long, tree long", work)


def _links_in_regions(rows: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between the rows (region and KNOWN) of a region that have different roots, by their full texts."""
    addressed = written(rows.join(reps, "set").select("region", *KNOWN, "rep.*"), "forest-addressed")
    given = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_key"), "text")
    sent = given.join(small_side(addressed, BROADCAST_ADDRESSED), F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_key") == F.col("key")))
    return _by_region(sent, [*KNOWN, "text"], "a long, b long", lambda at, held: Region(held, held[0][6]).links([r[7] for r in held]))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    partners = pairs.groupBy(F.col("b").alias("p_b")).agg(F.count("*").alias("len"))
    return linked(pairs.join(partners, F.col("b") == F.col("p_b")).select("a", "b", "len"), reps, docs, partial(shingle_sets, words=WORDS), alike)


def similar_components(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Sets of ``docs`` (doc_id, text) and the components of linked sets: (doc_id, key, n, set) and (node, root)."""
    sets, reps = keyed_sets(_set_table(docs))
    signed = written(_signed(sets, reps), "forest-signatures")
    regions = _regions(signed, crowd)
    whole_in = regions.where("tree >= 0").groupBy(F.col("set").alias("w_set")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("tree"))).alias("whole_in"))
    begins = F.concat(*(F.substring("values", t * STRIDE * 4 + 1, 4) for t in range(TREES))).alias("begins")
    shown = signed.select("set", "n", "bytes", begins).join(whole_in, F.col("set") == F.col("w_set"), "left")
    shown = written(shown.select(F.col("set").alias("s_set"), "n", "bytes", "begins", F.coalesce("whole_in", F.lit(0)).alias("whole_in")), "forest-shown")
    rows = regions.join(shown, F.col("set") == F.col("s_set")).select("region", "set", "n", "bytes")
    first = _first_pairs(rows).groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", "best.b")
    first = written(first, "forest-first-pairs")
    links = written(_confirmed(first, reps, docs), "forest-first-links")

    up = links.select(F.col("a").alias("node"), F.col("b").alias("up"))
    tops = links.select(F.col("b").alias("node")).distinct().join(up.select("node"), "node", "left_anti").select("node", F.col("node").alias("up"))
    roots = forest_roots(up.unionByName(tops)).select(F.col("node").alias("k_set"), "root")
    rooted = written(regions.join(roots, F.col("set") == F.col("k_set"), "left").select("region", "set", "tree", F.coalesce("root", "set").alias("root")), "forest-rooted")
    open_regions = rooted.groupBy(F.col("region").alias("o_region")).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("o_region")
    with_known = lambda some: some.join(shown, F.col("set") == F.col("s_set")).select("region", *KNOWN)
    open_sets = written(_open_sets(with_known(rooted.join(open_regions, F.col("region") == F.col("o_region")))), "forest-open-sets")
    last = written(_links_in_regions(with_known(open_sets), reps, docs), "forest-last-links")
    return sets.select("doc_id", "key", "n", "set"), connected_components(links.unionByName(last))


def minhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked if 100 times the size of the intersection of their shingle sets is at least 80 times that of the
    union. component_id is the least id that links lead to; kept is true for the row of that id.

    A-Z are lower-cased; words are runs of anything but space and the ASCII controls 9 to 13. Documents of fewer than
    four words have their whole sequence as one shingle. Null, empty and wordless texts have no shingles and are linked
    with nothing: their component is their own id. Repeated rows and equal texts are in one component, and repeated rows
    of the least id are all kept. Null ids take part; they are never the least unless alone. Texts count whole. An empty
    table gives no rows; other columns are left out, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        sets, roots = similar_components(given, crowd)
        placed = written(sets.join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("root")), "placed-documents")
        least = written(placed.where("root is not null").groupBy(F.col("root").alias("l_root")).agg(F.min("doc_id").alias("component_id")), "least-ids")
        component = F.coalesce("component_id", "doc_id")
        found = placed.join(least, F.col("root") == F.col("l_root"), "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
        return settled(found, "minhash-duplicates")
