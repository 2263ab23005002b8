"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document's set is its distinct shingles of ``shingle`` words. Each shingle's 64-bit
hash picks a bucket; of a bucket's smallest value only the number of leading zeros and
``MANTISSA`` bits after them are kept, two bytes a bucket. ``ROWS`` registers make a
band; documents that agree in a band are candidates. Before any set is fetched, the
share of equal registers, corrected for chance collisions, gives an estimate, and
pairs more than ``SLACK`` standard deviations under the threshold are dropped. What is left
is confirmed on full sets.

No step emits all pairs of a group. Documents with one set are one node. Empty buckets
borrow from filled ones for the bands (not for the estimate), so that sets of few
shingles share a band no more easily than others. In a band's group every member is
first compared with the group's hub alone, the node that shares its bands with most
others (in a family of copies, the one that was changed least); connected components of
the confirmed links follow. Where a band's group is still in several components, the
bands' overlaps make families of nodes; members outside a family's largest component
meet all others of the family, block against block, and a block hands on the links of a
spanning forest. So no link between different texts that share a band is lost, rows grow
with members and not with pairs, and a node's set is made in the scan of the documents
and sent once per block. A pair at the very threshold shares no band with probability
(1 - 0.8**6)**42, about 3e-6.

Defined results: null or white text has an empty set and is linked with nothing. Of
fewer words than ``shingle`` the whole sequence is the one shingle. ``component_id``
is the smallest id reachable; null ids count only where there is no other. Rows that
repeat an id are rows of their own. Ids are integers; other ids raise an error. Equal
texts share a node whatever their ids, and ties of hubs go to the smaller node. The
result has the operator's own columns alone, so names in the input cannot clash. Sets
are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BESIDE_TEXTS, BROADCAST_BYTES, Scratch, left_join_sized, quoted, table, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, BANDS, MANTISSA = 6, 42, 10
REGISTERS = ROWS * BANDS
EMPTY = 0xFFFF
#: Fixed value of the published collision estimate for equal-sized sets.
COLLISION = 0.169919487159739093975315012348
#: An estimate this many standard deviations too low is never met in practice (under 1 in a million).
SLACK = 5
#: Nodes, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Families of more nodes are compared band by band; rows then grow with bands instead of blocks.
FAMILY = 8192


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    h = np.full(max(0, len(words) - size + 1), size, dtype=np.uint64)
    for i in range(size):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i])
    return h


def sequences(text: pa.Array, size: int) -> list[np.ndarray]:
    """Hashes of each text's shingles in order, repeats included; of fewer words than ``size`` all are one shingle."""
    if not len(text):
        return []
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    words, at = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct)), coded.indices.to_numpy()
    if "" in distinct:  # white space at a text's ends
        filled = at != distinct.index("")
        ends, at = np.append(0, np.cumsum(filled))[ends], at[filled]
    words = words[at]
    n = np.diff(ends)
    inside = np.arange(max(0, len(words) - size + 1)) + size <= np.repeat(ends[1:], n)[: max(0, len(words) - size + 1)]
    out = np.split(_shingled(words, size)[inside], np.cumsum(np.maximum(n - size + 1, 0))[:-1])
    for k in np.flatnonzero((n > 0) & (n < size)):
        out[k] = _shingled(words[ends[k] : ends[k + 1]], int(n[k]))
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    h = np.sort(hashes)
    return h[np.append(h[1:] != h[:-1], True)] if len(h) else h


def portions(text: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 2048):
    """(start, length) of stretches of a column with a bounded number of rows and, but for single long texts, of bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(text):
        before = int(total[start - 1]) if start else 0
        stop = min(start + most_rows, max(start + 1, int(np.searchsorted(total, before + most_bytes, side="right"))))
        yield start, stop - start
        start = stop


def sequence_hashes(text: bytes | None, size: int) -> np.ndarray:
    return sequences(pa.array([text.decode() if text is not None else None], pa.string()), size)[0]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return distinct(sequence_hashes(text, size))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros of a bucket's smallest value, and the bits after them."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        value = _mixed(hashes) >> np.uint64(16)
        order = np.sort((bucket << np.uint64(48)) | value)
        first = np.flatnonzero(np.diff(order >> np.uint64(48), prepend=np.uint64(1 << 15)))
        low = (order[first] & np.uint64((1 << 48) - 1)).astype(np.int64)
        zeros = 48 - np.frexp(low.astype(np.float64))[1]
        zeros = np.where(low > 0, np.minimum(zeros, 48 - MANTISSA - 1), 48 - MANTISSA - 1)
        mantissa = (low >> (48 - 1 - zeros - MANTISSA)) & ((1 << MANTISSA) - 1)
        out[(order[first] >> np.uint64(48)).astype(np.int64)] = (zeros << MANTISSA) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, na, nb) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, less chance collisions, and how many buckets they rest on."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1)
    filled = used.sum(axis=-1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * filled
    return np.maximum(same - chance, 0) / np.maximum(filled, 1), filled


def promising(a: np.ndarray, b: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Whether a pair may reach the threshold: sizes allow it and the estimate is within SLACK deviations."""
    at = percent / 100
    guess, filled = estimate(a, b, na, nb)
    slack = SLACK * np.sqrt(at * (1 - at) / np.maximum(filled, 1)) + 1e-9
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (guess >= at - slack)


def signatures(docs: DataFrame, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """Per row: id, two hashes of the text, two hashes of the set, its size and its registers."""
    schema = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())])

    def sign(batches):
        for b in batches:
            text = b.column("text")
            for start, n in portions(text):
                part, sets = b.slice(start, n), []
                for h in map(distinct, sequences(text.slice(start, n), shingle)):
                    key = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
                    sets.append((int(key[0]), int(key[1]), len(h), registers(h).tobytes()))
                s1, s2, n, regs = zip(*sets)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t1"), part.column("t2"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())], schema=schema)

    text = quoted(text_col)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))
    return rows.mapInArrow(trimmed(sign), "id long, t1 long, t2 long, s1 long, s2 long, n long, registers binary")


def _ranks() -> np.ndarray:
    """For each bucket, the order in which it looks at the buckets for a filled one; itself comes first."""
    at = np.arange(REGISTERS, dtype=np.uint64)
    drawn = _mixed(at[:, None] * np.uint64(0x9E3779B97F4A7C15) + at[None, :] + np.uint64(1))
    drawn[at.astype(int), at.astype(int)] = 0
    return drawn.argsort(axis=1).argsort(axis=1).astype(np.int16)


def densified(rows: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Register rows in which empty buckets borrow the first filled one of their own order.

    Two sets agree in a borrowed register with their similarity, as in any other, so a
    band of a small set is no likelier to be shared than that of a large one.
    """
    out = rows.copy()
    for i in np.flatnonzero((rows == EMPTY).any(axis=1)):
        empty, filled = np.flatnonzero(rows[i] == EMPTY), np.flatnonzero(rows[i] != EMPTY)
        if len(filled):
            out[i, empty] = rows[i, filled[ranks[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(nodes: DataFrame) -> DataFrame:
    """Rows (band, node, n) of every node's bands."""
    schema = pa.schema([("band", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
    weights = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def keys(batches):
        ranks = _ranks()
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                rows = np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                regs = densified(rows, ranks).reshape(-1, BANDS, ROWS)
                h = np.repeat(weights, len(regs), axis=0)
                for r in range(ROWS):
                    h = _mixed(h + regs[:, :, r].astype(np.uint64))
                node, n = (np.repeat(part.column(k).to_numpy(), BANDS) for k in ("node", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(node), pa.array(n)], schema=schema)

    return nodes.select("node", "n", "registers").mapInArrow(trimmed(keys), "band long, node long, n long")


def _estimated(stars: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The promising ones of (a, b, na, nb, salts) pairs of hubs and members; a hot hub's registers go to many tasks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches):
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                ra, rb = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in ("ra", "rb"))
                ok = pa.array(promising(ra, rb, part.column("na").to_numpy(), part.column("nb").to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], schema=schema)

    hubs = stars.select("a", "salts").distinct().join(nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
    hubs = hubs.select("a", "ra", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = stars.join(nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    return met.join(hubs, ["a", "salt"]).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(trimmed(test), "a long, b long")


def _sets(docs: DataFrame, placed: DataFrame, shingle: int, text_col: str, id_col: str, broadcast_bytes: int) -> DataFrame:
    """Rows (unit, i, j, left, node, root, hashes) of placed nodes, their sets made in the scan of the documents.

    ``placed``: node, rep (hashes and id of the row that stands for it), root, places.
    """

    def make(batches):
        for b in batches:
            text = b.column("text")
            for start, n in portions(text, most_rows=512):
                part = b.slice(start, n)
                sets = [distinct(x).view(np.int64) for x in sequences(text.slice(start, n), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), part.column("places"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "root", "places", "hashes"])

    text = quoted(text_col)
    rows = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), quoted(id_col).cast("long").alias("id"), text.alias("text"))
    size = placed.agg(F.sum(F.size("places") * 64 + 200)).first()[0] or 0  # as Spark holds them in memory
    wanted = placed.select("node", "root", "places", *(F.col(f"rep.{c}").alias(f"_{c}") for c in ("t1", "t2", "id")))
    same = (rows["t1"] == wanted["_t1"]) & (rows["t2"] == wanted["_t2"]) & rows["id"].eqNullSafe(wanted["_id"])
    found = rows.join(F.broadcast(wanted) if size <= broadcast_bytes else wanted, same)
    made = found.select("node", "root", "places", "text").mapInArrow(trimmed(make), f"node long, root long, places {placed.schema['places'].dataType.simpleString()}, hashes array<bigint>")
    return made.select(F.explode("places").alias("p"), "node", "root", "hashes").select("p.unit", "p.i", "p.j", "p.left", "node", "root", "hashes")


def _links(sets: DataFrame, percent: int, gated: bool) -> DataFrame:
    """(a, b) links of each block: a spanning forest of what its left members share with the others.

    ``gated``: whether pairs have to pass the registers' estimate here (those of stars have already).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for _, group in sorted_groups(batches, ["unit", "i", "j"]):
            left = np.concatenate([b.column("left").to_numpy() for b in group]) == 1
            node, root = (np.concatenate([b.column(c).to_numpy() for b in group]) for c in ("node", "root"))
            sets = [x.values.to_numpy().view(np.uint64) for b in group for x in b.column("hashes")]
            if left.any() and not left.all():
                found = forest(node, root, left, sets, percent, gated)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    dealt = sets.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return dealt.mapInArrow(trimmed(compare), "a long, b long")


def forest(node: np.ndarray, root: np.ndarray, left: np.ndarray, sets: list[np.ndarray], percent: int, gated: bool = True) -> list[tuple[int, int]]:
    """Confirmed links between left members and others of different roots, none that closes a cycle."""
    n = np.array([len(s) for s in sets])
    begin = np.cumsum(n) - n
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has = np.zeros(len(ids) + 1, dtype=bool)
    regs = np.stack([registers(s) for s in sets]) if gated else None
    on_left = np.isin(node, node[left])
    top, found = root.copy(), []
    for p in np.flatnonzero(left).tolist():
        # a pair of left members is met twice: the smaller one's turn counts
        fits = ~left & (top != top[p]) & (node != node[p]) & (~on_left | (node > node[p]))
        q = np.flatnonzero(fits & (100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p])))
        if gated and len(q):
            q = q[promising(regs[p], regs[q], n[p], n[q], percent)]
        if not len(q):
            continue
        has[ids[begin[p] : begin[p] + n[p]]] = True
        ends = np.cumsum(n[q])
        every = np.arange(int(ends[-1])) + np.repeat(begin[q] - (ends - n[q]), n[q])
        shared = np.add.reduceat(has[ids[every]].astype(np.int64), ends - n[q])
        has[ids[begin[p] : begin[p] + n[p]]] = False
        for x in q[100 * shared >= percent * (n[p] + n[q] - shared)].tolist():
            if top[x] != top[p]:
                found.append((int(node[p]), int(node[x])))
                top[top == top[x]] = top[p]
    return found


def sorted_groups(batches, keys: list[str]):
    """(key, record batches) of each stretch of rows with equal integer keys; one group and one batch are held at once."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(cols[:, lo].tolist())
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, held


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of (a, b) links: the smallest node connected with it.

    Alternating large-star and small-star steps: each makes every node point to the
    smallest it knows, by aggregates and joins on the links alone, until none changes.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state, step = now, step + 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has plain exchanges on both sides and a root's many rows can be split
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least{step}")
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large{step}")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-most{step}")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = scratch.write(small.where("u <> v").distinct(), f"{name}-{step}")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch.write(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), f"{name}-roots")


def _blocks(members: DataFrame) -> DataFrame:
    """(node, root, places) of members of units, left ones (outside the unit's largest component) against all.

    ``members``: unit, node, root, n, each node once in a unit.
    """
    parts = members.groupBy("unit", "root").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    units = parts.groupBy("unit").agg(F.max(F.struct("k", (-F.col("root")).alias("minus"), "w")).alias("most"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count("*").alias("roots"))
    cuts = lambda k, w: F.ceil(F.greatest(k / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")
    units = units.where("roots > 1").select("unit", (-F.col("most.minus")).alias("main"), cuts(F.col("k") - F.col("most.k"), F.col("w") - F.col("most.w")).alias("lefts"), cuts(F.col("k"), F.col("w")).alias("alls"))
    met = members.join(units, "unit").withColumn("left", F.col("root") != F.col("main"))
    own = lambda c: F.pmod(F.xxhash64("node", "unit"), F.col(c)).cast("int")
    place = lambda i, j, left: F.struct(F.col("unit"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda j: place(own("lefts"), j, 1))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: place(i, own("alls"), 0))
    places = F.concat(F.when(F.col("left"), as_left).otherwise(F.array().cast("array<struct<unit:bigint,i:int,j:int,left:int>>")), as_right)
    # a node is in one unit, or in at most as many as it has bands
    return met.groupBy("node", "root").agg(F.flatten(F.collect_list(places)).alias("places"))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, beside_texts: int = BROADCAST_BESIDE_TEXTS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row, with the text's hashes t1 and t2."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed = signatures(docs, shingle, text_col, id_col).withColumn("row", F.monotonically_increasing_id())
    signed = scratch.write(signed, "signed")
    filled = signed.where("n > 0")
    rep = F.min(F.struct("row", "t1", "t2", "id")).alias("rep")
    nodes = filled.groupBy("s1", "s2").agg(rep, F.min("id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    nodes = scratch.write(nodes.select("s1", "s2", F.col("rep.row").alias("node"), "rep", "least", "copies", "n", "registers"), "nodes")

    bands = band_keys(nodes)
    groups = scratch.write(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "groups")
    small = groups.count() * 24 <= broadcast_bytes
    members = scratch.write(bands.join(F.broadcast(groups) if small else groups, "band"), "members")
    shared = members.groupBy("node").agg(F.sum("size").alias("shared"))
    hubs = members.join(shared, "node").groupBy("band").agg(F.max(F.struct("shared", (-F.col("node")).alias("minus"), "n")).alias("hub"))
    hubs = scratch.write(hubs.select("band", (-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("na")), "hubs")
    stars = members.join(hubs, "band").where("node <> a").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    stars = scratch.write(stars.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).distinct(), "stars")
    degree = stars.groupBy("a").agg(F.ceil(F.count("*") / F.lit(8 * BLOCK)).cast("int").alias("salts"))
    likely = scratch.write(_estimated(stars.join(degree, "a"), nodes, percent), "likely")

    # a hub is the left side of its own unit, in as many blocks as its members need
    of = nodes.select("node", "rep", F.col("node").alias("root"))
    per_hub = likely.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("alls"))
    per_hub = scratch.write(per_hub, "per-hub")
    place = lambda unit, j, left: F.struct(unit.alias("unit"), F.lit(0).alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_hub = per_hub.select(F.col("a").alias("node"), F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda j: place(F.col("a"), j, 1)).alias("places"))
    as_member = likely.join(per_hub, "a").select(F.col("b").alias("node"), F.array(place(F.col("a"), F.pmod(F.xxhash64("b"), F.col("alls")).cast("int"), 0)).alias("places"))
    places = as_hub.unionByName(as_member).groupBy("node").agg(F.flatten(F.collect_list("places")).alias("places"))
    placed = scratch.write(of.join(places, "node"), "star-places")
    args = (shingle, text_col, id_col, beside_texts)
    links = scratch.write(_links(_sets(docs, placed, *args), percent, gated=False).distinct(), "links")
    roots = components(links, scratch, "first")

    # what the stars could not show: groups in several components, by the families that their bands make
    rooted = members.where("size > 2").select("band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.write(rooted, "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first")).where("lo <> hi").select("band", "first")
    open_groups = scratch.write(rooted.join(mixed, "band"), "open")
    families = components(open_groups.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), scratch, "families")
    families = families.withColumnRenamed("root", "family")
    large = families.groupBy("family").count().where(F.col("count") > FAMILY).select("family", F.lit(True).alias("large"))
    unit = F.when(F.col("large"), F.col("band")).otherwise(F.col("family"))
    within = open_groups.join(families, "node").join(large, "family", "left").select(unit.alias("unit"), "node", "root", "n").distinct()
    blocks = _blocks(scratch.write(within, "within"))
    placed = scratch.write(blocks.join(nodes.select("node", "rep"), "node"), "block-places")
    found = scratch.write(_links(_sets(docs, placed, *args), percent, gated=True).distinct(), "found")
    if not found.isEmpty():
        roots = components(links.unionByName(found), scratch, "second")

    # only sets of several rows, or with links, need to be looked up
    placed = nodes.select("s1", "s2", "node", "least", "copies").join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.write(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    decided = scratch.write(placed.join(smallest, "root").select("s1", "s2", "component", F.lit(True).alias("known")), "decided")
    out = left_join_sized(signed.select("id", "t1", "t2", "s1", "s2", "n", "row"), decided, ["s1", "s2"], 48, F.col("row"), broadcast_bytes)
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("known"), F.col("component")).otherwise(F.col("id"))
    return out.select("id", "t1", "t2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_each(docs: DataFrame, judged: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` kept, with their own columns."""
    text = quoted(text_col)
    kept = judged.where("kept").select(F.col("id").alias("__id"), "t1", "t2").distinct()
    marked = docs.select("*", quoted(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("second"), text).alias("__t2"))
    same = marked["__id"].eqNullSafe(kept["__id"]) & (marked["__t1"] == kept["t1"]) & (marked["__t2"] == kept["t2"])
    return marked.join(kept, same, "left_semi").select(*[quoted(c) for c in docs.columns])


def op9_near_dedup(spark, sf_dir):
    judged = near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return judged.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {"op9_near_dedup": op9_near_dedup}
#: Rare shingles make the pairs, whole sets decide, a recursion follows the links.
ORACLES = {
    "op9_near_dedup": r"""
    WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END) AS g FROM d WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    f AS (SELECT g, count(*) AS f FROM s GROUP BY g),
    r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS rn FROM s JOIN f USING (g)),
    p AS MATERIALIZED (SELECT doc_id, g, n FROM r JOIN n USING (doc_id) WHERE rn <= n - ceil(0.8 * n) + 1),
    c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
    l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    t AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.a, t.root FROM t JOIN e ON e.b = t.node)
    SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, min(root) = node AS kept FROM t LEFT JOIN n ON n.doc_id = node GROUP BY node"""
}
