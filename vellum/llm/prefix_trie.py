"""Trie of the prefixes of conversations, with subtree totals by time-forward processing.

A node of depth d is a distinct sequence of first d turns (role, text). It is known by a 128-bit rolling hash and named
by its least conversation and its depth: the nodes of one name-giver are a chain, from where it leaves the chain of a
lesser conversation to its own last turn. Stretches of a chain with the same number of conversations have no forks and
move as one: what is left is a tree of about two stretches for each conversation, whatever the conversations' lengths.

Totals of subtrees go from children to parents by time-forward processing. Stretches of fewer than ``BRANCH``
conversations fall into subtrees, each below a stretch of more; these are dealt to shards whole, by their root. A shard
is sorted in reverse level order, and a task goes through it once: each stretch takes the messages that its children have
put into a priority queue, adds its own part and puts a message to its parent, which is still to come. The queue keeps
``QUEUE`` messages and spills more of them, sorted, to the shared folder. What reaches a shard's roots is added up by
parent and goes into the next pass, over the stretches of fewer than ``BRANCH`` squared, and so on up to the root of all:
as each of these has over ``BRANCH`` members, all later passes together see less than a thousandth of the turns.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat_format import LANES, PART, placed_turns, turn_prefixes
from .files import NewFile, open_to_read
from .graph import forest_roots
from .shared import new_path, scratch, settled, written

#: Conversations from which on a stretch is left to the next pass; each pass takes so many times more.
BRANCH = 1024
#: Messages that a queue keeps in memory, and that are read back together.
QUEUE, READ_BACK = 500_000, 10_000
#: Ids that are written as one text on the way to a node's digest.
SEGMENT_IDS = 1024

KEY = ["pos", *LANES]


class SpillingQueue:
    """Messages (depth, conv, leaves, saved), deepest first, then by conv; all but ``limit`` of them lie in files."""

    def __init__(self, folder: str, limit: int = QUEUE):
        self.folder, self.limit = folder, limit
        self.held: list[tuple[int, int, int, int]] = []
        self.spilled: list[tuple[tuple[int, int, int, int], int, Iterator]] = []
        self.files = 0

    def put(self, depth: int, conv: int, leaves: int, saved: int) -> None:
        if len(self.held) >= self.limit:
            self._spill()
        heapq.heappush(self.held, (-depth, conv, leaves, saved))

    def take(self, depth: int, conv: int) -> tuple[int, int]:
        """Sums of leaves and saved of all messages to a stretch; those to stretches before it have been taken."""
        leaves = saved = 0
        address = (-depth, conv)
        while self.held and self.held[0][:2] == address:
            message = heapq.heappop(self.held)
            leaves, saved = leaves + message[2], saved + message[3]
        while self.spilled and self.spilled[0][0][:2] == address:
            message, k, rest = self.spilled[0]
            leaves, saved = leaves + message[2], saved + message[3]
            if (following := next(rest, None)) is not None:
                heapq.heapreplace(self.spilled, (following, k, rest))
            else:
                heapq.heappop(self.spilled)
        return leaves, saved

    def _spill(self) -> None:
        uri = f"{self.folder}/{self.files}"
        file = NewFile(uri)
        file.stream.write(np.array(sorted(self.held), np.int64).tobytes())
        file.finish()
        rest = self._read(uri)
        heapq.heappush(self.spilled, (next(rest), self.files, rest))
        self.files += 1
        self.held = []

    @staticmethod
    def _read(uri: str) -> Iterator[tuple[int, int, int, int]]:
        with open_to_read(uri) as stream:
            while data := stream.read(32 * READ_BACK):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(pos, a, b, c, d, p_a, p_b, p_c, p_d, owner, n_convs, words) of every node; the root is the one of pos 0."""
    made = prefixes.groupBy(*KEY).agg(*(F.min(f"p_{x}").alias(f"p_{x}") for x in LANES), F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return made.unionByName(root.select(*(zero.alias(x) for x in KEY), *(zero.alias(f"p_{x}") for x in LANES), "owner", "n_convs", zero.alias("words")))


def _chains(nodes: DataFrame) -> DataFrame:
    """(owner, first, last, p_owner): depths of each owner's chain, and the owner of the node that it hangs on."""
    top = F.min(F.struct("pos", *(f"p_{x}" for x in LANES))).alias("top")
    chains = written(nodes.groupBy("owner").agg(top, F.max("pos").alias("last")), "trie-chains")
    below_root = chains.where("top.pos <= 1")
    others = chains.where("top.pos > 1")
    parents = nodes.select(F.col("owner").alias("p_owner"), *(F.col(x).alias(f"n_{x}") for x in KEY))
    met = (F.col("top.pos") - 1 == F.col("n_pos")) & F.expr(" and ".join(f"top.p_{x} = n_{x}" for x in LANES))
    root = nodes.where("pos = 0").select("owner").first()
    on_root = F.when(F.col("top.pos") == 1, F.lit(root and root[0])).cast("long").alias("p_owner")
    names = ("owner", F.col("top.pos").alias("first"), "last")
    return others.join(parents, met).select(*names, "p_owner").unionByName(below_root.select(*names, on_root))


def _stretches(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(owner, n_convs, lo, hi, gain, p_owner, p_hi, p_convs, leaf): forkless stretches, and what they hang on.

    gain is what the stretch's own nodes save; leaf is 1 if nothing hangs on it.
    """
    made = nodes.groupBy("owner", "n_convs").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("words").alias("words"))
    made = made.join(chains.select(F.col("owner").alias("c_owner"), "first", F.col("p_owner").alias("c_parent")), F.col("owner") == F.col("c_owner"))
    made = written(
        made.select("owner", "n_convs", "lo", "hi", ((F.col("n_convs") - 1) * F.col("words")).alias("gain"), F.when(F.col("lo") > F.col("first"), F.col("owner")).otherwise(F.col("c_parent")).alias("p_owner"), F.when(F.col("lo") > 0, F.col("lo") - 1).alias("p_hi")),
        "trie-stretches",
    )
    parents = made.select(F.col("owner").alias("o"), F.col("hi").alias("h"), F.col("n_convs").alias("p_convs"))
    hung = made.select(F.col("p_owner").alias("h_owner"), F.col("p_hi").alias("h_hi")).distinct()
    return (
        made.join(parents, (F.col("p_owner") == F.col("o")) & (F.col("p_hi") == F.col("h")), "left")
        .join(hung, (F.col("owner") == F.col("h_owner")) & (F.col("hi") == F.col("h_hi")), "left")
        .select("owner", "n_convs", "lo", "hi", "gain", "p_owner", "p_hi", "p_convs", F.col("h_owner").isNull().cast("long").alias("leaf"))
    )


def _shard_roots(stretches: DataFrame) -> DataFrame:
    """(s_owner, shard) of the owners of ``stretches``, of which those in one subtree have the same shard: its root's owner."""
    top = F.max(F.struct("n_convs", "inside", "p_owner")).alias("top")
    found = stretches.groupBy("owner").agg(top).select("owner", F.when(F.col("top.inside"), F.col("top.p_owner")).otherwise(F.col("owner")).alias("shard"))
    return forest_roots(found.select(F.col("owner").alias("node"), F.col("shard").alias("up"))).select(F.col("node").alias("s_owner"), F.col("root").alias("shard"))


def _totals(stretches: DataFrame, messages: DataFrame | None, queue: int) -> DataFrame:
    """One pass over whole subtrees: (owner, hi, leaves, below, total, p_owner, p_hi, inside) of each stretch.

    ``messages`` (m_owner, m_hi, m_leaves, m_saved) come from passes before. ``inside`` is false for roots of shards.
    """
    spark = stretches.sparkSession
    folder = new_path(spark, "trie-queues", scoped=True)
    if messages is None:
        stretches = stretches.withColumn("m_leaves", F.lit(0).cast("long")).withColumn("m_saved", F.lit(0).cast("long"))
    else:
        stretches = stretches.join(messages, (F.col("owner") == F.col("m_owner")) & (F.col("hi") == F.col("m_hi")), "left").withColumn("m_leaves", F.coalesce("m_leaves", F.lit(0))).withColumn("m_saved", F.coalesce("m_saved", F.lit(0)))
    dealt = stretches.join(_shard_roots(stretches), F.col("owner") == F.col("s_owner"))
    columns = ["owner", "hi", "leaf", "gain", "m_leaves", "m_saved", "p_owner", "p_hi", "inside"]
    levels = dealt.select("shard", *columns).repartition("shard").sortWithinPartitions(F.col("hi").desc(), F.col("owner").asc()).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        waiting = SpillingQueue(f"{folder}/{uuid.uuid4().hex}", queue)
        for batch in batches:
            leaves, below, total = [], [], []
            for owner, hi, leaf, gain, m_leaves, m_saved, p_owner, p_hi, inside in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                got_leaves, got_saved = waiting.take(hi, owner)
                leaves.append(leaf + m_leaves + got_leaves)
                below.append(m_saved + got_saved)
                total.append(gain + below[-1])
                if inside:
                    waiting.put(p_hi, p_owner, leaves[-1], total[-1])
            made = [pa.array(x, pa.int64()) for x in (leaves, below, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *(batch.column(i) for i in (6, 7, 8))], names=["owner", "hi", "leaves", "below", "total", "p_owner", "p_hi", "inside"])

    return levels.mapInArrow(run, "owner long, hi long, leaves long, below long, total long, p_owner long, p_hi long, inside boolean")


def _subtree_totals(stretches: DataFrame, branch: int, queue: int) -> DataFrame:
    """(owner, hi, leaves, below): childless nodes at and below each stretch, and what is saved below it."""
    found, messages, least, most = None, None, 0, branch
    while True:
        level = stretches.where((F.col("n_convs") >= least) & (F.col("n_convs") < most)).withColumn("inside", F.coalesce(F.col("p_convs") < most, F.lit(False)))
        done = written(_totals(written(level, "trie-level"), messages, queue), "trie-totals")
        kept = done.select("owner", "hi", "leaves", "below")
        found = kept if found is None else found.unionByName(kept)
        if stretches.where(F.col("n_convs") >= most).limit(1).count() == 0:
            return found
        out = done.where("not inside").select("p_owner", "p_hi", "leaves", "total")
        if messages is not None:  # what was sent to stretches of later passes
            out = out.unionByName(messages.join(level.select("owner", "hi"), (F.col("m_owner") == F.col("owner")) & (F.col("m_hi") == F.col("hi")), "left_anti").select(F.col("m_owner").alias("p_owner"), F.col("m_hi").alias("p_hi"), F.col("m_leaves").alias("leaves"), F.col("m_saved").alias("total")))
        messages = written(out.groupBy(F.col("p_owner").alias("m_owner"), F.col("p_hi").alias("m_hi")).agg(F.sum("leaves").alias("m_leaves"), F.sum("total").alias("m_saved")), "trie-messages")
        least, most = most, most * branch


def _end_digests(ends: DataFrame) -> DataFrame:
    """(e_pos, e_a, .., digest) of the nodes at which conversations of ``ends`` (pos, a, b, c, d, conv) end.

    Ids are dealt by ranges, so that those of one node may lie in many tasks, and written in texts of SEGMENT_IDS; then
    one task goes through the texts of a node, one at a time.
    """
    names = ["pos", *LANES]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*at, ids[0])), pa.array([",".join(map(str, ids))])], names=[*names, "least", "ids"])

        for batch in batches:
            out = []
            for *node, conv in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if node != at or len(ids) == SEGMENT_IDS:
                    if ids:
                        out.append(segment())
                    at, ids = node, []
                ids.append(conv)
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        if ids:
            yield segment()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows])], names=[*names, "digest"])

        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if node != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield made(out)
        if at is not None:
            yield made([(*at, digest.hexdigest())])

    longs = ", ".join(f"{x} long" for x in names)
    texts = ends.select(*names, "conv").repartitionByRange(*names, "conv").sortWithinPartitions(*names, "conv").mapInArrow(segments, f"{longs}, least long, ids string")
    found = texts.repartition(*names).sortWithinPartitions(*names, "least").select(*names, "ids").mapInArrow(digests, f"{longs}, digest string")
    return found.select(*(F.col(x).alias(f"e_{x}") for x in names), "digest")


def trie_of(placed: DataFrame, convs: DataFrame, part_turns: int = PART, branch: int = BRANCH, queue: int = QUEUE) -> DataFrame:
    """The nodes of ``prefix_trie``, of turns placed as by ``placed_turns``, with their words; ``convs`` (conv) has all members.

    To be called, and its result stored, within a ``scratch`` scope.
    """
    convs = written(convs, "trie-members")
    prefixes = written(turn_prefixes(placed, part_turns, ("words",)), "trie-prefixes")
    nodes = written(_nodes(prefixes, convs), "trie-nodes")
    chains = written(_chains(nodes), "trie-tops")
    stretches = written(_stretches(nodes, chains), "trie-tree")
    totals = _subtree_totals(stretches, branch, queue)

    hung = chains.where("first > 0").groupBy(F.col("p_owner").alias("h_owner"), (F.col("first") - 1).alias("h_pos")).agg(F.count("*").alias("hung"))
    shared = nodes.where("n_convs > 1").withColumn("part", F.floor(F.col("pos") / part_turns))
    parts = shared.groupBy("owner", "n_convs", "part").agg(F.sum("words").alias("w"))
    later = Window.partitionBy("owner", "n_convs").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select(F.col("owner").alias("l_owner"), F.col("n_convs").alias("l_convs"), F.col("part").alias("l_part"), F.coalesce(F.sum("w").over(later), F.lit(0)).alias("later"))
    inside = Window.partitionBy("owner", "n_convs", "part").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends_below = stretches.where("n_convs > 1").select(F.col("owner").alias("t_owner"), F.col("n_convs").alias("t_convs"), F.col("hi").alias("t_hi"))
    ends_below = ends_below.join(totals.withColumnsRenamed({"owner": "o", "hi": "h"}), (F.col("t_owner") == F.col("o")) & (F.col("t_hi") == F.col("h"))).select("t_owner", "t_convs", "leaves", "below")
    shared = (
        shared.withColumn("after", F.sum("words").over(inside))
        .join(later, (F.col("owner") == F.col("l_owner")) & (F.col("n_convs") == F.col("l_convs")) & (F.col("part") == F.col("l_part")))
        .join(ends_below, (F.col("owner") == F.col("t_owner")) & (F.col("n_convs") == F.col("t_convs")))
        .join(hung, (F.col("owner") == F.col("h_owner")) & (F.col("pos") == F.col("h_pos")), "left")
        .select(*KEY, "owner", "n_convs", F.coalesce("hung", F.lit(0)).alias("hung"), "leaves", (F.col("below") + (F.col("n_convs") - 1) * (F.col("after") + F.col("later"))).alias("saved"))
    )
    single = nodes.where("n_convs = 1").select(*KEY, "owner", "n_convs", F.lit(0).cast("long").alias("hung"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    turnless = convs.join(placed.select("conv").distinct(), "conv", "left_anti")
    ends = prefixes.where("pos = turns").select(*KEY, "conv").unionByName(turnless.select(*(F.lit(0).cast("long").alias(x) for x in KEY), "conv"))
    return (
        shared.unionByName(single)
        .join(chains.select(F.col("owner").alias("c_owner"), "first", "last", "p_owner"), F.col("owner") == F.col("c_owner"))
        .join(_end_digests(ends), F.expr(" and ".join(f"{x} = e_{x}" for x in KEY)), "left")
        .select(
            F.col("owner").alias("conv_id"),
            F.col("pos").alias("depth"),
            F.when(F.col("pos") > F.col("first"), F.col("owner")).otherwise(F.col("p_owner")).alias("parent_conv_id"),
            "n_convs",
            (F.col("hung") + (F.col("pos") < F.col("last")).cast("long")).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


WORD = r"[^\x20\x09-\x0D]+"


def placed_words(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, x, y, words, start, copies, turns) of every distinct turn of a conversation, in order of turn, role and text."""
    empty = F.lit("")
    given = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text")).where("conv is not null")
    return placed_turns(given).select("conv", "x", "y", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), "start", "copies", "turns")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART) -> DataFrame:
    """The trie of all conversations: one row for each distinct sequence of first turns (role, text), the empty one included.

    Columns: conv_id (the least conversation that begins so) and depth, which name the node; parent_conv_id (null for the
    root); n_convs, conversations that begin so; n_children; n_leaves, childless nodes in the subtree, the node itself
    included; saved_tokens, the sum over the subtree of (n_convs - 1) times the words of the last text; ends_sha256, the
    digest of the comma-joined ids of the conversations that end there.

    Conversation ids are integers; rows without one are left out, they belong to no conversation. Turns are ordered by
    number, null first, equal ones by role and text; repeated rows count as turns each. Null roles and texts are empty
    ones. Texts and conversations may be of any length. An empty table gives no rows; other columns are left out,
    whatever their names.
    """
    with scratch(turns.sparkSession):
        placed = written(placed_words(turns, conv_col, turn_col, role_col, text_col), "trie-turns")
        return settled(trie_of(placed, placed.select("conv").distinct(), part_turns), "prefix-trie")


def grafted(placed: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """``placed`` turns of conversations that take their first turns from the first of their family, and all members.

    Conversation c gets the first h turns of conversation c - c % ``family`` (all, if it has fewer; none, if there is
    none), then its own turns after its first h; h is the crc32 of its decimal id modulo ``heads``.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads))
    members = placed.groupBy("conv").agg(F.max("turns").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base"))
    bases = members.select(F.col("conv").alias("b_conv"), F.col("n").alias("b_n"))
    members = written(
        members.join(bases, F.col("base") == F.col("b_conv"), "left").withColumn("k", F.least("h", F.coalesce("b_n", F.lit(0)))).select(F.col("conv").alias("m_conv"), "h", "k", "base", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("m_turns")),
        "trie-families",
    )
    own = placed.join(members, F.col("conv") == F.col("m_conv")).withColumn("from", F.greatest(F.col("start"), F.col("h") + 1)).withColumn("left", F.col("start") + F.col("copies") - F.col("from")).where("left > 0")
    own = own.select("conv", "x", "y", "words", (F.col("from") - F.col("h") + F.col("k")).alias("start"), F.col("left").alias("copies"), F.col("m_turns").alias("turns"))
    first = placed.where(F.col("start") < heads).select(F.col("conv").alias("f_conv"), "x", "y", "words", "start", "copies")
    taken = first.join(members, F.col("f_conv") == F.col("base")).withColumn("left", F.least(F.col("copies"), F.col("k") - F.col("start") + 1)).where("left > 0")
    taken = taken.select(F.col("m_conv").alias("conv"), "x", "y", "words", "start", F.col("left").alias("copies"), F.col("m_turns").alias("turns"))
    return written(own.unionByName(taken), "grafted-turns"), members.select(F.col("m_conv").alias("conv"))
