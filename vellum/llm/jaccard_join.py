"""N-gram Jaccard join by T-occurrence search.

Two documents link if their sets of five-word shingles reach a Jaccard similarity of 3/4: then they share at least
T = ceil(3/7 of the sum of both sizes) shingles. Shingles are put in one order: those on few documents by hash, then
those on many (the long lists) by their number. The inverted lists are searched after the manner of DivideSkip:

* Of each set the first shingles in that order are its short lists, about a quarter. They are merged: all that the lists
  of a query hold meet in one task, sorted by set, and a set that stands on fewer than T - L of them (L: the query's other
  lists) is thrown out. Passages that many documents share come last in the order, so they bring few together.
* For the sets that are left, a task inverts those of one query into lists, merges the short ones of these, and probes
  the L longest by binary search, for the candidates of the merge only. Only pairs that reach T leave the task.

Equal sets count once. To avoid all pairs of a group of near copies, lists are first searched with one query each, the
set of the list with the fewest shingles of its own; sets found linked are one component. After that only sets of
different components are compared, and this is done for all of them: their lists are delivered to them whole, in
segments, a query with very long lists in several parts. So all links between components are found, without any cap
on lists or partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .sentencepiece_codec import slices
from .shared import scratch, settled, small_side, written
from .shingles import shingle_sets, text_groups

#: Rows of a task's block that a shingle must be on to be counted there; documents from which a list is long; most long lists.
LOCAL_MIN, LONG_LIST, MOST_LONG = 2, 16, 500_000
#: Shingles that a block of the counting pass holds.
BLOCK_SHINGLES = 4_000_000
#: Sets compared with one copy of a query; sets that a segment of a list holds, about; most deliveries of texts that are broadcast.
QUERY_SETS, SEGMENT, BROADCAST_DELIVERIES = 256, 1024, 400_000
#: Rounds in which lists are searched with one query each. More or fewer change the work, never the links.
HUB_ROUNDS = 1
#: Weight of a binary probe against a step of the merge, from which follows how many lists are long.
PROBE = 0.01
#: Ratio of the sizes of neighbouring classes: a little over 4/3, the most that linked sets may differ.
SIZE_CLASS = 1.34
#: Bits of the hash by which long lists are cut into segments.
CUT_BITS = 24


def prefix_length(n):
    """Shingles of a set of ``n`` that go into merged lists: a linked set shares at least one of them."""
    return n - (3 * n + 3) // 4 + 1


def long_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles on LONG_LIST documents or more, sorted, and their ranks by number; at most MOST_LONG of them.

    Every block of every task counts its shingles, those found at least LOCAL_MIN times are added up over all blocks.
    Any choice and order give the same links: they only decide which lists come last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_MIN
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        size = 0
        for batch in batches:
            for texts in text_groups(batch.column(0).to_pylist()):
                held += shingle_sets(texts)
                size = sum(map(len, held))
                if size > BLOCK_SHINGLES:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    heavy, least = written(counts.where(F.col("n") >= LONG_LIST), "long-lists"), LONG_LIST
    while heavy.where(F.col("n") >= least).count() > MOST_LONG:
        least *= 2
    found = heavy.where(F.col("n") >= least).collect()
    token, n = (np.array([r[c] for r in found], np.int64) for c in ("token", "n"))
    token = token.view(np.uint64)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def set_table(docs: DataFrame, long: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, n, set, other, short, long): size and hashes of each document's set, and its first shingles in order."""
    known = docs.sparkSession.sparkContext.broadcast(long)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("set", T.LongType()), T.StructField("other", T.LongType()), T.StructField("short", T.ArrayType(T.LongType())), T.StructField("long", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last, rank = known.value
        for batch in batches:
            for part in slices(batch, 2, 1_000_000):
                sets = shingle_sets(part.column(2).to_pylist())
                size = np.array([len(x) for x in sets])
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                at = np.minimum(np.searchsorted(last, flat), max(0, len(last) - 1))
                is_long = (last[at] == flat) if len(last) else np.zeros(len(flat), bool)
                ends = np.cumsum(size)
                short, late = [], []
                for u, e, n in zip(sets, ends.tolist(), size.tolist(), strict=True):
                    hot, take = is_long[e - n : e], prefix_length(n) if n else 0
                    first = u[~hot][:take]
                    short.append(first)
                    late.append(u[hot][np.argsort(rank[at[e - n : e][hot]])[: take - len(first)]] if take > len(first) else u[:0])
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64))) for x in (short, late)]
                digests = [pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size.astype(np.int32)), *digests, *lists], names=["doc_id", "key", "n", "set", "other", "short", "long"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def keyed_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sets`` written, with one ``set`` number for each distinct set, and (set, rep), a document of each.

    Numbers are 64-bit hashes; sets of one number are held against a second hash, and if any differ all are numbered
    anew by both: 128 bits tell sets apart.
    """
    while True:
        sets = written(sets, "shingle-sets")
        reps = written(sets.where("n > 0").groupBy("set").agg(F.min(F.struct("doc_id", "key")).alias("rep"), (F.min("other") != F.max("other")).alias("mixed")), "distinct-sets")
        if reps.where("mixed").limit(1).count() == 0:
            return sets, reps.drop("mixed")
        sets = sets.withColumn("set", F.xxhash64("set", "other"))


def shared_lists(sets: DataFrame) -> DataFrame:
    """(token, set, n, len, own) of the short lists that hold two sets or more; own: first shingles of the set that stand on no such list.

    Lists of few documents are gathered by token, in order, and those of one set dropped on the way; long ones are only
    made distinct, by token and set, so that no long list has to fit a task.
    """
    rows = sets.where("n > 0").select("set", "n", F.explode("short").alias("token")).select("token", "set", "n")

    def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # rows of the last token so far: its list may go on in the next batch

        def shared(token: np.ndarray, own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            token, own, n = token[fresh], own[fresh], n[fresh]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(start, len(token)))
            count = np.repeat(length, length)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(own[keep]), pa.array(n[keep].astype(np.int32)), pa.array(count[keep])], names=["token", "set", "n", "len"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield shared(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield shared(*held)

    short = rows.repartition("token").sortWithinPartitions("token", "set").mapInArrow(keep_shared, "token long, set long, n int, len long")
    late = written(sets.where("size(long) > 0").select("set", "n", F.explode("long").alias("token")).select("token", "set", "n").distinct(), "long-list-rows")
    lengths = late.groupBy(F.col("token").alias("l_token")).agg(F.count("*").alias("len")).where("len > 1")
    late = late.join(small_side(lengths, MOST_LONG), F.col("token") == F.col("l_token")).select("token", "set", "n", "len")
    lists = written(short.unionByName(late), "lists")
    met = lists.groupBy(F.col("set").alias("m_set")).agg(F.count("*").alias("met"))
    return lists.join(met, F.col("set") == F.col("m_set")).select("token", "set", "n", "len", (F.expr(FIRST.format("n")) - F.col("met")).alias("own"))


#: SQL for prefix_length.
FIRST = "({0} - cast((3 * {0} + 3) / 4 as int) + 1)"


def needed(n: str, m: str) -> F.Column:
    """T - L: times that sets of sizes ``n`` and ``m`` must meet in short lists if they link."""
    overlap = f"cast(ceil(3 * ({n} + {m}) / 7D) as int)"
    return F.expr(f"greatest(1, least({FIRST.format(n)} - ({n} - {overlap}), {FIRST.format(m)} - ({m} - {overlap})))")


def similar_sizes(n: str, m: str) -> F.Column:
    return F.expr(f"4 * least({n}, {m}) >= 3 * greatest({n}, {m})")


def reached(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Which of ``members`` share enough shingles with ``query``, by DivideSkip over the members' inverted lists.

    All are sorted arrays of distinct shingles.
    """
    sizes = np.array([len(x) for x in members])
    least = -(-3 * (len(query) + sizes) // 7)
    token, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    begin, end = np.searchsorted(token, query), np.searchsorted(token, query, "right")
    found = end > begin
    begin, end = begin[found], end[found]
    length = end - begin
    if not len(length):
        return np.zeros(len(members), bool)
    n_long = min(int(least.min()) - 1, int(least.min() / (PROBE * math.log2(length.max() + 1) + 1)), len(length))
    by_length = np.argsort(length, kind="stable")
    short, long = by_length[: len(length) - n_long], by_length[len(length) - n_long :]
    # merge: all entries of the short lists, counted by owner
    size = length[short]
    at = np.arange(size.sum()) + np.repeat(begin[short] - np.cumsum(size) + size, size)
    count = np.bincount(owner[at], minlength=len(members))
    candidates = np.flatnonzero(count >= least - n_long)
    # probe: (list, owner) of the long lists is in order, so a binary search tells whether a candidate is on a list
    if len(long) and len(candidates):
        size = length[long]
        at = np.arange(size.sum()) + np.repeat(begin[long] - np.cumsum(size) + size, size)
        entries = np.repeat(np.arange(len(long)), size) * len(members) + owner[at]
        probes = np.arange(len(long))[:, None] * len(members) + candidates[None, :]
        place = np.minimum(np.searchsorted(entries, probes), len(entries) - 1)
        count[candidates] += (entries[place] == probes).sum(axis=0)
    return count >= least


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, sets_of=shingle_sets, reach=reached) -> DataFrame:
    """The pairs (a, b, len) of sets that reach the similarity: each query ``b`` is searched for among its ``a``.

    ``sets_of`` makes sets of texts, ``reach`` tells which of several sets are similar to one.

    The text of each ``a`` goes to its ``b``; ``len`` bounds the number of a ``b``'s partners: it tells into how many
    copies the ``b`` is dealt, so that QUERY_SETS or so meet one copy.
    """
    dealt = pairs.withColumn("copies", F.ceil(F.col("len") / QUERY_SETS).cast("int")).select("a", "b", "copies", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    parcels = dealt.select("b", "copies", "copy", F.lit(1).alias("role"), F.col("a").alias("set")).unionByName(dealt.select("b", "copies", "copy", F.lit(0).alias("role"), F.col("b").alias("set")).distinct())
    addressed = written(parcels.join(reps, "set").select("b", "copies", "copy", "role", "set", "rep.*"), "parcels")
    given = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_key"), "text")
    sent = (
        given.join(small_side(addressed, BROADCAST_DELIVERIES), F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_key") == F.col("key")))
        .select("b", F.concat_ws("/", "copies", "copy").alias("copy"), "role", "set", "text")
        .repartition("b", "copy")
        .sortWithinPartitions("b", "copy", "role", "set")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query, names, members = None, None, [], []

        def links() -> pa.RecordBatch:
            yes = reach(query, members) if members else np.zeros(0, bool)
            found = [a for a, y in zip(names, yes.tolist(), strict=True) if y]
            names.clear()
            members.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([at and at[0]] * len(found), pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in slices(batch, 4, 1_000_000):
                sets = sets_of(part.column(4).to_pylist())
                for b, copy, role, own, x in zip(*(part.column(i).to_pylist() for i in range(4)), sets, strict=True):
                    if role == 0:
                        if at != (b, copy):  # repeated rows of the query's document bring it more than once
                            yield links()
                            at, query = (b, copy), x
                    elif not names or names[-1] != own:
                        names.append(own)
                        members.append(x)
                        if len(members) >= 2 * QUERY_SETS:  # a search at a time: memory stays bounded
                            yield links()
        yield links()

    return sent.mapInArrow(run, "a long, b long")


def rooted_lists(lists: DataFrame, roots: DataFrame | None, by_share: bool = True) -> DataFrame:
    """(token, set, n, len, own, root, weight) of each row, and of its token the top root: c_root, with its query hub, hub_n.

    Only lists of two roots or more are left. ``weight`` is the number of sets of a root; the top root is that of most
    sets, among single sets (``by_share``) that with the smallest share of shingles of its own, then that of the largest
    number. Its query is the set with the smallest such share.
    """
    alone = F.col("own") / F.col("n")
    if roots is None:
        marked = lists.withColumn("root", F.col("set")).withColumn("weight", F.lit(1).cast("long"))
    else:
        weight = roots.groupBy(F.col("k_root").alias("w_root")).agg(F.count("*").alias("weight"))
        known = roots.join(weight, F.col("k_root") == F.col("w_root")).select("k_set", "k_root", "weight")
        marked = written(lists.join(known, F.col("set") == F.col("k_set"), "left").select("token", "set", "n", "len", "own", F.coalesce("k_root", "set").alias("root"), F.coalesce("weight", F.lit(1)).alias("weight")), "marked-lists")
    share = F.when(F.lit(by_share) & (F.col("weight") == 1), -alone)
    top = F.max(F.struct(F.col("weight"), share.alias("share"), F.col("root"), (-alone).alias("common"), F.col("set"), F.col("n"))).alias("top")
    tops = marked.groupBy("token").agg(top, F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    tops = tops.select(F.col("token").alias("c_token"), F.col("top.root").alias("c_root"), F.col("top.set").alias("hub"), F.col("top.n").alias("hub_n"))
    return marked.join(tops, F.col("token") == F.col("c_token")).drop("c_token")


def met_in_lists(rows: DataFrame) -> DataFrame:
    """(a, b): sets of different roots that meet in short lists as often as links must; b is of the weightier root.

    Lists are cut by the size of their sets, so that a set meets those of its own class and the two beside it, and
    within a class into segments of SEGMENT sets or so. Each set outside the top root of a list is a query, to which the
    segments that hold a weightier root are delivered. A query whose lists are long is cut into parts by the same hash
    as they are, each with its own task.
    """
    bits = F.least(F.lit(CUT_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("len") / SEGMENT)))).cast("int")
    place = F.shiftrightunsigned("set", 64 - CUT_BITS).cast("int")  # numbers of sets are hashes
    size_class = F.floor(F.log("n") / math.log(SIZE_CLASS)).cast("int")
    rows = rows.withColumn("bits", bits).withColumn("class", size_class).withColumn("weight", F.least("weight", F.lit(2**31 - 1)).cast("int"))
    segments = rows.groupBy(F.col("token").alias("s_token"), F.col("class").alias("s_class"), F.call_function("shiftright", place, F.lit(CUT_BITS) - F.col("bits")).alias("segment")).agg(
        F.collect_list(F.struct("set", "n", "root", "weight")).alias("members"), F.max(F.struct("weight", "root")).alias("most")
    )
    asking = rows.where("root <> c_root").select("token", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("weight").alias("weight_a"), "class", "bits")
    widest = asking.groupBy(F.col("a").alias("w_a")).agg(F.max("bits").alias("a_bits")).where("a_bits > 0")
    asking = asking.join(widest, F.col("a") == F.col("w_a"), "left").drop("w_a").withColumn("a_bits", F.coalesce("a_bits", F.lit(0)))
    asking = asking.withColumn("near", F.explode(F.expr("array(class - 1, class, class + 1)"))).withColumn("part", F.explode(F.expr("sequence(0, cast(shiftleft(1, a_bits) as int) - 1)")))
    weightier = F.col("most") > F.struct(F.col("weight_a").alias("weight"), F.col("root_a").alias("root"))
    delivered = asking.join(segments, (F.col("token") == F.col("s_token")) & (F.col("near") == F.col("s_class")) & (F.expr("shiftright(part, a_bits - bits)") == F.col("segment")) & weightier)
    names = ("set", "n", "root", "weight")
    sent = delivered.select("a", "part", "n_a", "root_a", "weight_a", "a_bits", *(F.col(f"members.{x}").alias(x) for x in names)).repartition("a", "part").sortWithinPartitions("a", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asks, held = None, (), []

        def merged() -> pa.RecordBatch:
            a, part = at
            n_a, root_a, weight_a, a_bits = asks
            own, n, root, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            place = (own.view(np.uint64) >> np.uint64(64 - CUT_BITS)).astype(np.int64)
            mine = (place >> (CUT_BITS - a_bits) == part) & (root != root_a) & ((weight > weight_a) | (weight == weight_a) & (root > root_a))
            mine &= 4 * np.minimum(n, n_a) >= 3 * np.maximum(n, n_a)
            b, first, met = np.unique(own[mine], return_index=True, return_counts=True)
            m = n[mine][first]
            overlap = -(-3 * (n_a + m) // 7)
            need = np.maximum(1, np.minimum(prefix_length(n_a) - n_a, prefix_length(m) - m) + overlap)
            b = b[met >= need]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(6)]
            lists = [batch.column(6 + i) for i in range(4)]
            flat, ends = [x.flatten().to_numpy() for x in lists], np.cumsum(lists[0].value_lengths().to_numpy())
            for i, (a, part, *more) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
                if at != (a, part):
                    if held:
                        yield merged()
                    at, asks, held = (a, part), tuple(more), []
                held.append([x[ends[i - 1] if i else 0 : ends[i]] for x in flat])
        if held:
            yield merged()

    return sent.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of ``docs`` (doc_id, text) and the components of linked sets: (doc_id, key, n, set) and (node, root)."""
    sets, reps = keyed_sets(set_table(docs, long_shingles(docs)))
    lists = written(shared_lists(sets), "shared-lists")
    links, roots = [], None
    for _ in range(HUB_ROUNDS):
        # each set goes to the query that it meets most often, if often enough
        rows = rooted_lists(lists, roots).where((F.col("root") != F.col("c_root")) & similar_sizes("n", "hub_n"))
        pairs = rows.groupBy(F.col("set").alias("a"), F.col("hub").alias("b"), "n", "hub_n", "root", "c_root").agg(F.count("*").alias("met"), F.max("len").alias("len"))
        pairs = pairs.where(F.col("met") >= needed("n", "hub_n")).groupBy("a").agg(F.max(F.struct("met", "b", "len", "root", "c_root")).alias("best")).select("a", "best.*")
        pairs = written(pairs, "hub-pairs")
        links.append(written(linked(pairs, reps, docs), "hub-links"))
        roots = written(_joined_roots(roots, links[-1].select("a").distinct().join(pairs, "a")), "known-roots")
    # what is left: the sets of lists on which several roots still stand
    met = written(met_in_lists(written(rooted_lists(lists, roots, by_share=False), "open-lists")), "met-in-lists")
    partners = met.groupBy(F.col("b").alias("p_b")).agg(F.count("*").alias("len"))
    links.append(written(linked(met.join(partners, F.col("b") == F.col("p_b")).drop("p_b"), reps, docs), "last-links"))
    return sets.select("doc_id", "key", "n", "set"), connected_components(_all(links))


def _joined_roots(roots: DataFrame | None, joined: DataFrame) -> DataFrame:
    """(k_set, k_root) after each ``root`` of ``joined`` has been found to be of one component with its ``c_root``.

    The c_root comes after the root in the order by which lists choose their top root, so there are no circles. Sets of
    one root are of one component; one component may still have several roots, which only leaves more to compare.
    """
    parents = written(joined.groupBy(F.col("root").alias("child")).agg(F.max(F.struct("met", "c_root")).alias("best")).select("child", F.col("best.c_root").alias("parent")), "parents")
    fresh = parents.select(F.explode(F.array("child", "parent")).alias("k_set")).distinct()
    known = fresh.select("k_set", F.col("k_set").alias("k_root"))
    known = known if roots is None else roots.unionByName(known.join(roots, "k_set", "left_anti"))
    for _ in range(3):
        known = known.join(parents, F.col("k_root") == F.col("child"), "left").select("k_set", F.coalesce("parent", "k_root").alias("k_root"))
    return known


def _all(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, text_key, component_key) of every row of ``docs``.

    component_id is the least id that links lead to. text_key is xxhash64 of the text: it tells rows of one id apart.
    component_key is a number of the component, null for documents without shingles: unlike component_id it differs
    between components that share their least id.

    Documents of fewer than five words have their whole sequence as one shingle. Null, empty and wordless texts have
    no shingles and are linked with nothing: their component is their own id. Repeated rows and equal texts are in one
    component. Null ids take part; they are never the least unless alone. Texts count whole. An empty table gives no
    rows; other columns are left out, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        sets, roots = similar_components(given)
        placed = sets.join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "n", "key", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("root"))
        placed = written(placed, "placed-documents")
        least = written(placed.where("root is not null").groupBy(F.col("root").alias("l_root")).agg(F.min("doc_id").alias("component_id")), "least-ids")
        found = placed.join(least, F.col("root") == F.col("l_root"), "left").select(
            F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("text_key"), F.col("root").alias("component_key")
        )
        return settled(found, "near-duplicates")
