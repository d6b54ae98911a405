"""A prefix trie of conversations: burst tries over turn ids.

A turn's id is the 128-bit hash of its role and text, so a conversation is a string of fixed-width letters, kept
packed in one binary value: its bytes sort as its turns do. Equal conversations are one row with their number.

Trie heads are the prefixes that too many turns lie below. A container holds what lies below a prefix that is small
enough, as suffixes. All start in the root's container; an oversized container bursts by its next turn ids, as often as
needed. Rounds look ahead twice as far each time, so a long prefix that very many conversations share takes as many rounds as its
length has binary digits. Containers are dealt over the shards (shuffle partitions), sorted and swept into
nodes with a stack. What a sweep has summed goes up to the heads as one number per container and head.

A conversation is one row, as a document is; its turns meet in one task. Nothing else is collected: a container has at
most ``CONTAINER`` turns or one conversation, and copies are counted before they are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import saved, small_side

#: Turns (of different conversations) below a prefix from which it becomes a trie head.
CONTAINER = 20_000
#: Bytes of a turn id.
WIDTH = 16
#: Ids of one conversation's copies that are joined to one text before they meet.
_ID_BITS = 12
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Hex digits of a turn's id; null role or text count as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (id, code points of the text) in order: by turn, null first, equal numbers by
    turn id. Rows without a conv_id belong to no conversation."""
    c = {n: F.col(f"`{n}`") for n in (conv, turn, role, text)}
    size = F.coalesce(F.length(c[text].cast("string")), F.lit(0)).cast("int")
    each = F.struct(c[turn].isNotNull().alias("numbered"), c[turn].alias("turn"), turn_id(c[role], c[text]).alias("id"), size.alias("size"))
    grouped = conversations.where(c[conv].isNotNull()).groupBy(c[conv].cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def with_shared_heads(turns: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Conversations that start like the first of their block: the first h turns of conversation ``c - c % block``, then c's own after
    its first h, h being the crc32 of c's digits modulo ``most + 1``."""
    first = F.col("conv_id") - F.col("conv_id") % block
    starts = turns.where(first == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = turns.withColumn("base", first).join(starts, "base", "left").withColumn("h", h)
    own = F.filter("turns", lambda _, i: i >= F.col("h"))
    taken = F.filter(F.coalesce("start", F.slice("turns", 1, 0)), lambda _, i: i < F.col("h"))
    return both.select("conv_id", F.concat(taken, own).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(dig, ends): the SHA-256 of the copies' ids, ascending, joined by commas. Ids meet in runs of at most 2 ** ``_ID_BITS``
    values; a group of several runs is hashed as its runs stream by in order."""
    run = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = members.groupBy("dig", F.shiftright("conv_id", _ID_BITS).alias("run")).agg(run.alias("ids"))
    runs = saved(runs, "trie-ends")
    several = runs.groupBy("dig").agg(F.count("*").alias("n")).where("n > 1").select("dig")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for dig, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if dig != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = dig, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["dig", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["dig", "ends"])

    one = runs.join(several, "dig", "left_anti").select("dig", F.sha2("ids", 256).alias("ends"))
    more = runs.join(several, "dig", "left_semi").repartition("dig").sortWithinPartitions("dig", "run").select("dig", "run", "ids")
    return one.unionByName(more.mapInArrow(hashed, "dig string, ends string"))


def _distinct(sequences: DataFrame) -> DataFrame:
    """One row per different conversation: ``m`` (its smallest id), ``w`` (how many there are), ``seq`` (packed turn ids), ``sizes`` and
    ``ends``."""
    packed = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = sequences.select("conv_id", packed.alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = saved(rows.withColumn("dig", F.sha2("seq", 256)), "trie-sequences")
    groups = rows.groupBy("dig").agg(F.min("conv_id").alias("m"), F.count("*").alias("w"), F.first("seq").alias("seq"), F.first("sizes").alias("sizes"))
    return saved(groups.join(_ends(rows.select("dig", "conv_id")), "dig").drop("dig"), "trie-distinct")


def _step(key: bytes, turn: bytes) -> bytes:
    """A prefix's key: of the prefix one turn shorter and that turn."""
    return hashlib.blake2b(key + turn, digest_size=WIDTH).digest()


ROOT = b"\0" * WIDTH


def _prefixes(live: DataFrame, start: int, reach: int) -> DataFrame:
    """For each sequence its next prefixes, up to ``reach`` turns further than ``start``: their keys, the turns that follow the prefix and
    its last turn's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m, w, key, seq, sizes in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for d in range(start, min(start + reach, len(sizes))):
                    up, key = key, _step(key, seq[d * WIDTH : (d + 1) * WIDTH])
                    rows.append((m, w, d + 1, up, key, len(sizes) - d, sizes[d]))
                    if len(rows) >= 20_000:
                        yield _batch(rows, _PREFIX)
                        rows = []
            yield _batch(rows, _PREFIX)

    return live.select("m", "w", "key", "seq", "sizes").mapInArrow(run, _PREFIX)


_PREFIX = "m long, w long, depth long, up binary, key binary, turns long, size long"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def _burst(distinct: DataFrame, container: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bursts containers until none is oversized.

    Returns the heads but the root (``key``, ``up``, ``depth``, ``conv_id``, ``n_convs``, ``size``), the head prefixes of each sequence
    (``m``, ``depth``, ``key``) and where sequences go: (``m``, ``top``, ``up``, ``key``), the container below head ``up``; ``top`` is
    null if the sequence ends at a head."""
    live = distinct.where(F.length("seq") > 0).withColumn("key", F.lit(ROOT))
    heads, paths, placed = [], [], []
    start, reach = 0, 1
    while True:
        ahead = saved(_prefixes(live, start, reach), "trie-ahead")
        below = ahead.groupBy("key").agg(
            F.min("m").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("n"), F.sum("turns").alias("turns"),
            F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        )
        found = saved(below.where((F.col("n") > 1) & (F.col("turns") > container)).drop("n", "turns"), "trie-heads")
        marked = ahead.join(small_side(found.select("key", F.lit(True).alias("head"))), "key", "left")
        path = saved(marked.where("head").select("m", "depth", "key"), "trie-paths")
        first = marked.where("head IS NULL").groupBy("m").agg(F.min(F.struct("depth", "up", "key")).alias("at"))
        first = first.select("m", F.col("at.depth").alias("top"), F.col("at.up").alias("up"), F.col("at.key").alias("key"))
        placed.append(saved(first, "trie-placed"))
        heads.append(found)
        paths.append(path)
        # what is a head's at the end of the stretch and goes on
        start += reach
        on = path.where(F.col("depth") == start).select("m", "key")
        live = saved(live.drop("key").where(F.length("seq") > start * WIDTH).join(on, "m"), "trie-live")
        if live.isEmpty():
            return _union(heads), _union(paths), _union(placed)
        reach *= 2


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_SWEPT = "m long, up binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("depth", "least", "n", "children", "leaves", "saved", "size", "ends", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = NO_ENDS, []


def sweep(rows: Iterator[tuple], top: int) -> Iterator[tuple]:
    """The nodes of one container from its sequences (m, w, seq, sizes, ends), sorted by ``seq``, that share the first ``top`` turns.

    A stack holds the open path. A node is given out when its parent closes, which then knows its smallest member; the one
    at depth ``top``, last, has no parent here. Each is (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends)."""
    path: list[_Open] = []
    last = b""

    def close() -> Iterator[tuple]:
        node = path.pop()
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.size
        for child in node.waiting:
            yield (child.least, child.depth, node.least, child.n, child.children, child.leaves, child.saved, child.ends)
        node.waiting = ()
        if path:
            up = path[-1]
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.n += node.n
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.waiting.append(node)
        else:
            yield (node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends)

    for m, w, seq, sizes, ends in rows:
        shared = _common(last, seq) // WIDTH if path else 0
        while path and path[-1].depth > shared:
            yield from close()
        for d in range(max(shared + 1, top), len(sizes) + 1):
            path.append(_Open(d, sizes[d - 1]))
        end = path[-1]
        end.least = m if end.least is None else min(end.least, m)
        end.n, end.ends, last = end.n + w, ends, seq
    while path:
        yield from close()


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both start with."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _sweep_all(contained: DataFrame) -> DataFrame:
    """The nodes of all containers. ``up`` is the head above the container."""
    names = ("key", "up", "top", "m", "w", "seq", "sizes", "ends")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            first = next(rows)
            up, top = first[1], first[2]

            def whole(first=first, rows=rows):
                yield first[3:]
                for r in rows:
                    yield r[3:]

            for node in sweep(whole(), top):
                is_top = node[1] == top
                out.append((node[0], up if is_top else None, is_top, *node))
                if len(out) >= 10_000:
                    yield _batch(out, _SWEPT)
                    out = []
        yield _batch(out, _SWEPT)

    dealt = contained.select(*names).repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInArrow(run, _SWEPT)


def nodes(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie's nodes, one row each, from (conv_id, turns) with one row per conversation.

    ``conv_id`` is a node's smallest member and, with ``depth``, names it; ``parent_conv_id`` is its parent's (null for the root);
    ``n_convs`` its members, ``n_children`` and ``n_leaves`` (childless nodes below it, itself included), ``saved_tokens`` what its
    subtree saves: for each node the code points of its last text times its members but one; ``ends_sha256`` the hash of the ids of
    the conversations that end there.

    Conversations without turns end at the root. Repeated conversations are members of the same nodes. An empty table has no
    node, not even a root."""
    distinct = _distinct(sequences)
    heads, paths, placed = _burst(distinct, container)
    heads, placed = saved(heads, "trie-heads"), saved(placed, "trie-placed")
    contained = distinct.join(placed, "m")
    swept = saved(_sweep_all(contained), "trie-swept")
    tops = swept.where("top")
    # a container's sums go up with its smallest sequence, a head's own saving with the head's: running sums
    # from the deep end give each head on that path what lies below
    root = distinct.agg(F.min("m").alias("conv_id"), F.sum("w").alias("n_convs")).where("n_convs > 0")
    up = paths.select("m", "depth", "key").unionByName(distinct.select("m", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key")))
    own = heads.select(F.col("conv_id").alias("m"), "depth", F.lit(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = tops.select("m", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(own)
    sums = saved(sums.groupBy("m", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
    steps = up.join(sums.select("m").distinct(), "m").withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    steps = steps.unionByName(sums.withColumn("key", F.lit(None).cast("binary")))
    deep = Window.partitionBy("m").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = steps.select("key", F.sum("leaves").over(deep).alias("leaves"), F.sum("saved").over(deep).alias("saved")).where("key IS NOT NULL")
    below = below.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_tokens"))
    # children are containers and heads one turn further
    children = tops.select("up").unionByName(heads.select("up")).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    ended = paths.join(distinct.select("m", "ends", (F.length("seq") / WIDTH).cast("long").alias("depth")), ["m", "depth"]).select("key", "ends")
    ended = ended.unionByName(distinct.where(F.length("seq") == 0).select(F.lit(ROOT).alias("key"), "ends"))
    whole = heads.drop("size").unionByName(
        root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs")
    )
    whole = whole.join(below, "key", "left").join(children, "key", "left").join(ended, "key", "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    whole = whole.select(
        "key", "up", "depth", "conv_id", "n_convs", n_children.alias("n_children"),
        (F.coalesce("leaves", F.lit(0).cast("long")) + F.when(n_children == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    whole = saved(whole, "trie-whole")
    parents = small_side(whole.select(F.col("key").alias("up"), F.col("conv_id").alias("parent")))
    names = [f.split()[0] for f in _NODE.split(", ")]
    upper = whole.join(parents, "up", "left").withColumnRenamed("parent", "parent_conv_id").select(*names)
    edge = tops.drop("parent_conv_id").join(parents, "up").withColumnRenamed("parent", "parent_conv_id").select(*names)
    return upper.unionByName(edge).unionByName(swept.where("NOT top").select(*names))
