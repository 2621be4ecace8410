"""The trie of all conversations' prefixes, in node tables addressed by minimal perfect hashes.

A prefix is named by 128 bits: two polynomials over the MD5 of its turns, modulo 2**64. They are sums along a conversation, so
turns that lie in several partitions add up, and a prefix moved to another depth is multiplied by a power. Names are verified:
rows of one name must agree in depth, parent and last turn, else another base is taken.

Subtrees are shards: a node belongs to the topmost of its ancestors (itself included) that has at most as many rows as its
band allows. A shard's distinct names get slots by a minimal perfect hash, counts are scattered into flat arrays by slot, and
sums go through the array of parent slots, deepest nodes first. What a shard's top adds up to goes to its parent, in a later
band. Nodes with one member are a tail of one conversation and need no sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import skew_join, small_batches, written
from meridian.llm.words import U, mix

HEAD = 8  #: turns that a conversation may take over from another
BASES = ((0x5851F42D4C957F2D, 0xDA942042E4DD58B5), (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ROOT = bytes(16)
MASK = (1 << 64) - 1


def lanes(col: pa.Array) -> np.ndarray:
    """Binary values of 16 bytes as rows of two numbers."""
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(-1, 2)


def joined(a: np.ndarray) -> pa.Array:
    """Rows of two numbers as binary values of 16 bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, 16 * len(a) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a, "<u8"))])


def raised(bases: tuple[int, int], n: np.ndarray) -> np.ndarray:
    """Rows of both bases to the powers n (negative ones too) modulo 2**64."""
    values, at = np.unique(n, return_inverse=True)
    return np.array([[pow(b, int(x), 1 << 64) for b in bases] for x in values], U).reshape(-1, 2)[at]


def _sums_along(bases: tuple[int, int]):
    """Streams sorted (conv, turn hash, bytes); yields (part, conv, i, p, q, t, n_bytes): sums with and without the turn, from where the conversation starts in this task."""

    def run(batches):
        from pyspark import TaskContext

        part, conv, count, total = TaskContext.get().partitionId(), None, 0, np.zeros(2, U)
        power: np.ndarray = np.ones((1, 2), U)
        for batch in batches:
            c, t = batch.column(0).to_numpy(zero_copy_only=False), lanes(batch.column(1))
            if not len(c):
                continue
            new = np.concatenate(([conv is None or c[0] != conv], c[1:] != c[:-1]))
            if new[0]:
                count, total = 0, np.zeros(2, U)
            start = np.flatnonzero(new) if new[0] else np.concatenate(([0], np.flatnonzero(new)))
            run_of = np.cumsum(np.isin(np.arange(len(c)), start)) - 1
            first = np.where(start == 0, count, 0)
            i = np.arange(len(c)) - start[run_of] + first[run_of] + 1
            if int(i.max()) >= len(power):
                power = np.cumprod(np.vstack((np.ones((1, 2), U), np.tile(np.array(bases, U), (2 * int(i.max()), 1)))), axis=0, dtype=U)
            w = t * power[i]
            s = np.cumsum(w, axis=0, dtype=U)
            before = np.where((start == 0)[:, None], U(0) - total, s[start - 1])
            p = s - before[run_of]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), batch.column(0), pa.array(i.astype(np.int64)), joined(p), joined(p - w), batch.column(1), batch.column(2)], names=["part", "c", "i", "p", "q", "t", "n_bytes"])
            conv, count, total = c[-1], int(i[-1]), p[-1]

    return run


def _carried(bases: tuple[int, int], carry: dict[int, tuple[int, int, int, int]]):
    """Moves what _sums_along found for the conversation that a task began with on by what earlier tasks had of it."""

    def run(batches):
        for batch in batches:
            part, c, i = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in range(3))
            p, q = lanes(batch.column(3)).copy(), lanes(batch.column(4)).copy()
            for x in np.unique(part):
                if int(x) in carry:
                    conv, n, *before = carry[int(x)]
                    at = np.flatnonzero((part == x) & (c == conv))
                    i[at] += n
                    move = np.array([pow(b, n, 1 << 64) for b in bases], U)
                    p[at], q[at] = p[at] * move + np.array(before, U), q[at] * move + np.array(before, U)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(i), joined(p), joined(q), batch.column(5), batch.column(6)], names=["c", "i", "p", "q", "t", "n_bytes"])

    return run


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str, bases: tuple[int, int]) -> DataFrame:
    """(c, i, p, q, t, n_bytes): each turn with its place i in its conversation, from 1, the names of the prefixes with and without it, and its own digest.

    Rows are range-partitioned, so a long conversation may lie in many tasks; one row a task reaches the driver, to tell how it goes on.
    """
    r, x = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    t = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("o"), r.alias("r"), x.alias("x"))
    ordered = (F.col("c"), F.col("o").asc_nulls_first(), F.col("r"), F.col("x"))
    t = t.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    digest = F.unhex(F.md5(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x")))
    cut = t.select("c", digest.alias("t"), F.octet_length("x").cast("long").alias("n_bytes")).mapInArrow(_sums_along(bases), "part int, c long, i long, p binary, q binary, t binary, n_bytes long")
    cut = written(cut)
    ends = cut.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "i", "p")).alias("last")).orderBy("part").collect()
    carry: dict[int, tuple[int, int, int, int]] = {}
    at: tuple[int, int, int, int] | None = None
    for e in ends:
        n, p = e["last"]["i"], np.frombuffer(bytes(e["last"]["p"]), "<u8").tolist()
        if at and at[0] == e["first"]:
            carry[e["part"]] = at
            if e["last"]["c"] == e["first"]:
                p = [(before + x * pow(b, at[1], 1 << 64)) & MASK for before, x, b in zip(at[2:], p, bases)]
                n += at[1]
        at = (e["last"]["c"], n, *p)
    return cut.mapInArrow(_carried(bases, carry), "c long, i long, p binary, q binary, t binary, n_bytes long")


def whole(turns: DataFrame) -> DataFrame:
    """(c, depth, k, pk, t, n_bytes, len) of the conversations as they are, and a row of depth 0 for each."""
    n = turns.groupBy("c").agg(F.max("i").alias("len"))
    rows = skew_join(turns, n, "c", n.select("c", F.col("len").alias("n"))).select("c", F.col("i").alias("depth"), F.col("p").alias("k"), F.col("q").alias("pk"), "t", "n_bytes", "len")
    return rows.unionByName(n.selectExpr("c", "0L AS depth", "CAST(NULL AS BINARY) AS k", "CAST(NULL AS BINARY) AS pk", "CAST(NULL AS BINARY) AS t", "0L AS n_bytes", "len"))


def _shifted(bases: tuple[int, int]):
    """Streams (c, i, p, q, t, n_bytes, h, taken, len, own, other): turns after the first h, which give way to `taken` turns with the sum `other`."""

    def run(batches):
        for batch in batches:
            i, h, taken = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 6, 7))
            p, q, own, other = (lanes(batch.column(k)) for k in (2, 3, 9, 10))
            move = raised(bases, taken - h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i - h + taken), joined(other + (p - own) * move), joined(other + (q - own) * move), batch.column(4), batch.column(5), batch.column(8)], names=["c", "depth", "k", "pk", "t", "n_bytes", "len"])

    return run


def spliced(turns: DataFrame, bases: tuple[int, int], base: Column, h: Column) -> DataFrame:
    """As whole(), of conversations whose first h (at most HEAD) turns give way to the first h of another one, named by `base` (as many as that has)."""
    turns = written(turns)
    head = F.when(F.col("i") <= HEAD, F.struct("i", "p", "q", "t", "n_bytes"))
    heads = written(turns.groupBy("c").agg(F.max("i").alias("own_len"), F.sort_array(F.collect_list(head)).alias("head")))
    other = heads.select(F.col("c").alias("b"), F.col("own_len").alias("b_len"), F.col("head").alias("b_head"))
    info = heads.withColumns({"base": base, "h": h}).join(other, F.col("base") == F.col("b"), "left")
    info = info.withColumn("taken", F.least("h", F.coalesce("b_len", F.lit(0))))
    at = lambda col, n: F.when(n > 0, F.get(F.col(col), (n - 1).cast("int"))["p"]).otherwise(F.lit(bytearray(ROOT)))
    own = F.when(F.col("own_len") > F.col("h"), at("head", F.col("h"))).otherwise(F.lit(bytearray(ROOT)))
    info = info.select("c", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own_len") - F.col("h"))).alias("len"), own.alias("own"), at("b_head", F.col("taken")).alias("other"), F.slice("b_head", F.lit(1), F.col("taken").cast("int")).alias("head"), "own_len")
    info = written(info)
    first = info.select("c", "len", F.explode("head").alias("x")).select("c", F.col("x.i").alias("depth"), F.col("x.p").alias("k"), F.col("x.q").alias("pk"), F.col("x.t").alias("t"), F.col("x.n_bytes").alias("n_bytes"), "len")
    rest = skew_join(turns, info.select("c", "h", "taken", "len", "own", "other"), "c", info.select("c", F.col("own_len").alias("n"))).where("i > h")
    rest = rest.select("c", "i", "p", "q", "t", "n_bytes", "h", "taken", "len", "own", "other").mapInArrow(_shifted(bases), "c long, depth long, k binary, pk binary, t binary, n_bytes long, len long")
    return first.unionByName(rest).unionByName(info.selectExpr("c", "0L AS depth", "CAST(NULL AS BINARY) AS k", "CAST(NULL AS BINARY) AS pk", "CAST(NULL AS BINARY) AS t", "0L AS n_bytes", "len"))


class PerfectHash:
    """Slots 0 ... n-1 for n distinct rows of two numbers: on each level, keys that meet no other get a bit, the others go on.

    A slot is the rank of its key's bit. Names that are not among the keys are told by comparing them with the key in the slot.
    """

    def __init__(self, keys: np.ndarray, room: float = 1.6) -> None:
        self.bits: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            size = max(1, int(room * len(left)))
            at = self._place(keys[left], len(self.bits), size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
            if len(self.bits) > 200:
                raise ValueError("keys are not distinct")
        self.ranks = [np.cumsum(b) - 1 for b in self.bits]
        self.before = np.concatenate(([0], np.cumsum([int(b.sum()) for b in self.bits]))).astype(np.int64)
        self.keys = np.zeros_like(keys)
        slot = self._slots(keys)
        self.keys[slot] = keys
        if len(keys) != self.before[-1] or not (self.keys[slot] == keys).all() or (slot < 0).any():
            raise ValueError("slots are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + U(level))) % U(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            slot[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the table."""
        slot = self._slots(keys)
        ok = slot >= 0
        ok[ok] = (self.keys[slot[ok]] == keys[ok]).all(axis=1)
        return np.where(ok, slot, -1)


def _shard(key, group):
    """The nodes of a shard's subtrees: children, leaves and saved tokens in each node's subtree, and the parent's conversation where the parent is here."""
    k, pk = (lanes(group[n].combine_chunks() if isinstance(group[n], pa.ChunkedArray) else group[n]) for n in ("k", "pk"))
    table = PerfectHash(k)
    slot = table.slots(k)
    conv, depth, members, n_bytes, kids, leaves, saved = (np.zeros(len(k), np.int64) for _ in range(7))
    for a, name in ((conv, "conv_id"), (depth, "depth"), (members, "n_convs"), (n_bytes, "n_bytes"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
        a[slot] = group[name].to_numpy()
    up = np.full(len(k), -1)
    up[slot] = table.slots(pk)
    inner = np.flatnonzero(up >= 0)
    np.add.at(kids, up[inner], 1)
    leaves[kids == 0] = 1
    saved += (members - 1) * n_bytes
    order = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    parent = pa.array(np.where(up >= 0, conv[up], 0)[slot], mask=(up < 0)[slot])
    return pa.table({"k": group["k"], "kids": pa.array(kids[slot]), "leaves": pa.array(leaves[slot]), "saved": pa.array(saved[slot]), "parent": parent})


def _chunks(batches):
    """Streams sorted (k, c); yields (k, first, ids): runs of one k as comma-joined decimals, of some 8,000 ids at most."""
    for batch in batches:
        k, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cut = [i for i in range(len(k)) if i == 0 or k[i] != k[i - 1] or i % 8000 == 0] + [len(k)]
        rows = [(k[i], c[i], ",".join(map(str, c[i:j]))) for i, j in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["k", "first", "ids"])


def _digests(batches):
    """Streams sorted (k, first, ids); yields (k, sha): SHA-256 of the ids of each k, joined by commas."""
    at, sha, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != at:
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["k", "sha"])
        out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], names=["k", "sha"])


def _ends(rows: DataFrame) -> DataFrame:
    """(k, sha) of the nodes at which conversations end. Ids are joined in ranges, so a common end is a row for some thousands of ids."""
    ends = rows.where("depth = len").select(F.coalesce("k", F.lit(bytearray(ROOT))).alias("k"), "c")
    runs = ends.repartitionByRange("k", "c").sortWithinPartitions("k", "c").mapInArrow(_chunks, "k binary, first long, ids string")
    return runs.repartition("k").sortWithinPartitions("k", "first").mapInArrow(_digests, "k binary, sha string")


def trie(rows: DataFrame, share: int = 1000) -> DataFrame | None:
    """The nodes of rows (c, depth, k, pk, t, n_bytes, len), with columns as in prefix_trie(); None if two prefixes have one name.

    share: a shard of the first band has at most 1 / share of the rows, within 64 and 2**18.
    """
    rows = written(rows)
    low = lambda c: F.min(c).alias(c)
    n = rows.where("depth > 0").groupBy("k").agg(F.min("c").alias("conv_id"), low("depth"), low("pk"), low("n_bytes"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("ends"), F.sum(F.col("len") - F.col("depth") + 1).alias("rest"), F.max("depth").alias("d2"), F.max("pk").alias("pk2"), F.min("t").alias("t1"), F.max("t").alias("t2"))
    nodes = written(n)
    same = (F.col("depth") == F.col("d2")) & (F.col("pk") == F.col("pk2")) & (F.col("t1") == F.col("t2")) & (F.col("k") != F.lit(bytearray(ROOT)))
    facts = nodes.agg(F.count_if(~same).alias("bad"), F.max("depth").alias("deep"), F.coalesce(F.max("rest"), F.lit(0)).alias("most"), F.count("*").alias("nodes")).first()
    if facts["bad"]:
        return None
    # bands: 0 for nodes with one member, then by the rows below a node
    size = min(1 << 18, max(64, rows.count() // share))
    steps, factor = [size], max(16, size // max(1, facts["deep"] or 1))
    while steps[-1] < facts["most"]:
        steps.append(steps[-1] * factor)
    band = F.when(F.col("n_convs") == 1, 0)
    for b, most in enumerate(steps, 1):
        band = band.when(F.col("rest") <= most, b)
    nodes = nodes.withColumn("band", band).drop("d2", "pk2", "t1", "t2", "rest")
    # of each conversation, where each band begins on its path
    on_path = skew_join(rows.where("depth > 0").select("c", "depth", "k", "len"), nodes.select("k", "band"), "k", nodes.select("k", F.col("n_convs").alias("n")))
    cuts = on_path.groupBy("c").agg(F.max("len").alias("len"), *(F.min(F.when(F.col("band") == b, F.struct("depth", "k"))).alias(f"cut{b}") for b in range(len(steps) + 1)))
    mine = F.coalesce(*(F.when(F.col("band") == b, F.col(f"cut{b}")) for b in range(len(steps) + 1)))
    placed = skew_join(nodes.withColumnRenamed("conv_id", "c"), written(cuts), "c")
    placed = written(placed.select("k", "pk", F.col("c").alias("conv_id"), "depth", "n_convs", "n_bytes", "ends", "band", "len", mine["k"].alias("top")))
    tops = placed.where("k = top")
    gifts = tops.where("band = 0").groupBy("pk").agg(F.count("*").alias("kids"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    found = placed.where("band = 0").select("k", F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.when(F.col("k") != F.col("top"), F.col("conv_id")).alias("parent"))
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), facts["nodes"] // 100_000)
    for b in range(1, len(steps) + 1):
        given = gifts.groupBy(F.col("pk").alias("g")).agg(*(F.sum(x).alias(x) for x in ("kids", "leaves", "saved")))
        own = placed.where(F.col("band") == b)
        own = own.join(given, own["k"] == given["g"], "left").fillna(0, ["kids", "leaves", "saved"])
        own = own.select("k", "pk", "conv_id", "depth", "n_convs", "n_bytes", "kids", "leaves", "saved", F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("shard"))
        done = written(own.groupBy("shard").applyInArrow(_shard, "k binary, kids long, leaves long, saved long, parent long"))
        found = found.unionByName(done)
        up = done.join(tops.where(F.col("band") == b).select("k", "pk"), "k").groupBy("pk").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        gifts = gifts.unionByName(up)
    # parents of the tops, which lie in other shards
    above = tops.where("depth > 1").select(F.col("k").alias("top_k"), F.col("pk").alias("k"))
    above = skew_join(above, nodes.select("k", F.col("conv_id").alias("above")), "k").select(F.col("top_k").alias("k"), "above")
    nothing, sha = F.lit(hashlib.sha256().hexdigest()), written(_ends(rows))
    root_sha = sha.where(F.col("k") == F.lit(bytearray(ROOT))).select("sha")
    root = rows.where("depth = 0").agg(F.min("c").alias("least"), F.count("*").alias("n")).where("n > 0")
    sums = gifts.where(F.col("pk") == F.lit(bytearray(ROOT))).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("kids", "leaves", "saved")))
    root = written(root.join(sums).join(root_sha, how="left"))  # one row each
    out = placed.join(found, "k").join(above, "k", "left").join(sha, "k", "left").join(F.broadcast(root.select("least")))
    parent = F.coalesce("parent", "above", "least")
    out = out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"))
    top = root.select(F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"))
    return out.unionByName(top)


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", splice: tuple[Column, Column] | None = None, share: int = 1000) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one (depth 0) included.

    conv_id: its least member; depth: its turns; parent_conv_id: the least member of the prefix without the last turn (null for the
    root); n_convs: conversations that begin so; n_children: prefixes with one turn more; n_leaves: childless prefixes that begin so
    (itself included); saved_tokens: over those that begin so, bytes of the last text times members beyond the first;
    ends_sha256: SHA-256 of the ids of conversations that end here, ascending, joined by commas.

    Turns are ordered by `turn`, null first, then by role and text; repeated rows are turns of their own. Null roles and texts are empty.
    Rows without a conversation id belong to none and are left out. An empty table gives no rows. splice: two columns over `c`, the
    id, for spliced(): which conversation gives its first turns, and how many.
    """
    small_batches(turns.sparkSession, 10_000)
    for bases in BASES:
        ordered = numbered(turns, conv, turn, role, text, bases)
        out = trie(spliced(ordered, bases, *splice) if splice else whole(ordered), share)
        if out is not None:
            return out
    raise ValueError("prefixes have the same name under all bases")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of the conversations that are rebuilt with the first crc32(id) % 9 turns of conversation id - id % 5."""
    c = F.col("c")
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), splice=(c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9))


OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
len AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id AS c, n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h FROM len),
g AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN len b ON base = b.conv_id),
turns AS (SELECT c, i AS d, role, text FROM g JOIN t ON conv_id = base AND i <= h UNION ALL SELECT c, i - h + taken, role, text FROM g JOIN t ON conv_id = c AND i > h),
path AS (SELECT c, d, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS k, strlen(text) AS b FROM turns UNION ALL SELECT c, 0, '', 0 FROM g),
p AS MATERIALIZED (SELECT c, d, md5(k) AS k, b, CASE WHEN d > 0 THEN md5(k[:len(k) - 32]) END AS pk, max(d) OVER (PARTITION BY c) AS len FROM path),
n AS MATERIALIZED (SELECT k, min(c) AS conv_id, min(d) AS depth, min(pk) AS pk, count(*) AS n_convs, min(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM p GROUP BY k),
kids AS (SELECT pk AS k, count(*) AS kids FROM n WHERE pk IS NOT NULL GROUP BY pk),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
sums AS (SELECT p.k, sum((w.n_convs - 1) * w.b) AS saved, count(*) FILTER (w.kids = 0) AS leaves FROM w JOIN p ON p.c = w.conv_id AND p.d <= w.depth GROUP BY p.k)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, w.ends_sha256 FROM w JOIN sums USING (k) LEFT JOIN n u ON w.pk = u.k
"""
