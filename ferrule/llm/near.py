"""Near-duplicate classes by a chosen-path set similarity join over minwise tokens.

A text's set is its distinct k-word shingles.  Texts with equal sets are one class, found by a 128-bit key, and
only classes, numbered by longs, go on.  In each of TREES independent trees, which draw from minwise tokens of their
own, a class walks down chosen paths: at a node, a hash of the path chooses one of the tree's POOL minwise positions,
and in a share of the nodes a second one; a class goes on to the child named by its token there.  Two classes of
similarity s share a child with probability s for each position, so at the threshold as many shared nodes are
expected at any depth.  A tree of depth 4 keeps a pair of similarity 0.8 together with probability 0.57; 16
independent ones miss about one pair in a million there, and fewer above.

Only what is connected is asked for, so a pair that is connected already need not be compared.  First each class is
compared with the leader that most of its nodes share; then the classes outside the label that holds most of a large
node with another leader, of that label.  Of the nodes that still hold several labels,

- one of up to SMALL classes is compared exhaustively by itself;
- in a larger one with a label that holds most of it, each stray, a class of another label, is compared with all
  classes of that label, and then the node is that of its strays;
- one of up to LARGE classes is compared exhaustively too, but nodes that share classes are joined before, so that what
  several trees put together is compared once;
- the classes of a still larger one go down to the next depth in DEPTHS; at the last one it is compared exhaustively.

All comparisons are exact, on full sets, with no limit to partners.  They are done in tiles: two lists of up to ROWS
classes and about MASS shingles each, so that no group is in one task.  A tile gives links enough to connect what its
links connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shelf import Shelf, bounded_batches, frugal

TREES = 16
#: Minwise tokens that a tree chooses from.
POOL = 16
DEPTHS = (4, 8, 12)
#: Most classes in a node that is compared exhaustively by itself.
SMALL = 32
#: Most classes in a node that is compared exhaustively with those that share classes with it: some hundred tiles.
LARGE = 20_000
#: Classes and shingles on a side of a tile, about.
ROWS = 512
MASS = 1_000_000
#: Floats in a matrix at once.
CELLS = 4_000_000
_U = np.uint64
_TREE = _U(TREES - 1)
_MULTIPLY = (W.mix(np.arange(1, TREES * POOL + 1, dtype=_U)) | _U(1)).astype(np.uint32)


def _keys(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of scrambled members, the second with the size."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, _U), np.cumsum(W.mix(x + _U(i))))) for i in (11, 77)]
        a, b = (s[at[1:]] - s[at[:-1]] for s in sums)
        b = b + W.mix(np.diff(at).astype(_U))
    return a.view(np.int64), b.view(np.int64)


def _fixed(x: np.ndarray) -> pa.Array:
    """Each row of the matrix as bytes."""
    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def signatures(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the smallest of TREES * POOL different hashes of each set; sets without members have the largest."""
    out = np.full((len(at) - 1, TREES * POOL), 0xFFFF, dtype=np.uint16)
    has = np.diff(at) > 0
    if has.any():
        start = at[:-1][has]
        low, high = x.astype(np.uint32), (x >> _U(32)).astype(np.uint32)
        z = np.empty_like(low)
        found = np.empty((len(start), TREES * POOL), dtype=np.uint16)
        with np.errstate(over="ignore"):
            for i, m in enumerate(_MULTIPLY):
                np.multiply(high, m, out=z)
                z += low
                found[:, i] = np.minimum.reduceat(z, start).astype(np.uint16)
        out[has] = found
    return out


def _profiles(k: int):
    """Rows (id, rk, n, k1, k2, sig) of rows (id, text, rk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.blocks(batch.column(1)):
                x, at = W.shingles(*W.words(batch.column(1).slice(a, b - a)), k)
                k1, k2 = _keys(x, at)
                columns = [*(batch.column(i).slice(a, b - a) for i in (0, 2)), pa.array(np.diff(at).astype(np.int64)), pa.array(k1), pa.array(k2), _fixed(signatures(x, at))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "rk", "n", "k1", "k2", "sig"])

    return run


def _paths(steps: int, share: float):
    """Rows (path, c, n) of rows (c, n, sig), from the trees' roots on, or of rows (c, n, sig, path), from there on."""
    second = _U(int(share * 2**64))

    def step(path: np.ndarray, row: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = W.mix(path + _U(0x51ED))
        i = (h >> _U(32)) % _U(POOL)
        more = np.flatnonzero(W.mix(path + _U(0xBEEF)) < second)
        j = (i[more] + _U(1) + (h[more] & _U(0xFFFF)) % _U(POOL - 1)) % _U(POOL)  # never the same position
        path, row, at = np.concatenate((path, path[more])), np.concatenate((row, row[more])), np.concatenate((i, j))
        tree = path & _TREE
        token = sig[row, (tree * _U(POOL) + at).astype(np.int64)].astype(_U)
        return W.mix(path ^ W.mix(token << _U(8) | at)) & ~_TREE | tree, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                c, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint16).reshape(len(c), -1)
                with np.errstate(over="ignore"):
                    if part.num_columns > 3:
                        path, row = part.column(3).to_numpy().astype(np.int64).view(_U), np.arange(len(c))
                    else:
                        path, row = np.repeat(np.arange(TREES, dtype=_U), len(c)), np.tile(np.arange(len(c)), TREES)
                    for _ in range(steps):
                        path, row = step(path, row, sig)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(c[row]), pa.array(n[row])], names=["path", "c", "n"])

    return run


def _sets(k: int):
    """Rows (c, set) of rows (c, text, k1, k2), for the texts that have the key: their full sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in W.blocks(batch.column(1)):
                part = batch.slice(s, e - s)
                x, at = W.shingles(*W.words(part.column(1)), k)
                k1, k2 = _keys(x, at)
                same = (part.column(2).to_numpy() == k1) & (part.column(3).to_numpy() == k2)
                sets = pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["c", "set"]).filter(pa.array(same))

    return run


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of members that each set of x shares with each of y; a set's members are different numbers."""
    m, n = len(x), len(y)
    a, ao = np.concatenate(x), np.repeat(np.arange(m), [len(s) for s in x])
    b, bo = np.concatenate(y), np.repeat(np.arange(n), [len(s) for s in y])
    vocabulary, ac = np.unique(a, return_inverse=True)
    bc = np.searchsorted(vocabulary, b)
    bc[bc == len(vocabulary)] = 0
    there = vocabulary[bc] == b
    bc, bo = bc[there], bo[there]
    fb = np.bincount(bc, minlength=len(vocabulary))
    there = fb[ac] > 0
    ac, ao = ac[there], ao[there]
    fa = np.bincount(ac, minlength=len(vocabulary))
    out = np.zeros((m, n), dtype=np.float32)
    # members that many hold, by products of 0-1 matrices; a matrix product does this many in the time of one of the rest
    dense = fa * fb * 256 >= m * n
    number = np.cumsum(dense) - 1
    da, db = dense[ac], dense[bc]
    (ca, oa), (cb, ob) = (number[ac[da]], ao[da]), (number[bc[db]], bo[db])
    sa, sb = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, oa, cb, ob = ca[sa], oa[sa], cb[sb], ob[sb]
    many = int(dense.sum())
    width = max(1, min(many, CELLS // (m + n)))
    for lo in range(0, many, width):
        (i, j), (p, q) = np.searchsorted(ca, (lo, lo + width)), np.searchsorted(cb, (lo, lo + width))
        left, right = np.zeros((m, width), np.float32), np.zeros((n, width), np.float32)
        left[oa[i:j], ca[i:j] - lo] = 1
        right[ob[p:q], cb[p:q] - lo] = 1
        out += left @ right.T
    # the rest, by listing who shares them
    ca, oa, cb, ob = ac[~da], ao[~da], bc[~db], bo[~db]
    if len(ca):
        sb = np.argsort(cb, kind="stable")
        cb, ob = cb[sb], ob[sb]
        start, many = np.searchsorted(cb, ca), fb[ca]
        cut = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + CELLS, CELLS))
        for lo, hi in zip(cut, [*cut[1:], len(ca)], strict=True):
            s, k = start[lo:hi], many[lo:hi]
            other = ob[np.repeat(s - np.cumsum(k) + k, k) + np.arange(k.sum())]
            out += np.bincount(np.repeat(oa[lo:hi], k) * n + other, minlength=m * n).reshape(m, n).astype(np.float32)
    return out


def linked_across(a: list, a_label: list, a_set: list, b: list, b_label: list, b_set: list, num: int, den: int) -> tuple[list, list]:
    """Links between two lists of classes, enough to connect all labels that their links connect."""
    out: tuple[list, list] = ([], [])
    if not len(a) or not len(b):
        return out
    labels, number = np.unique(np.array([*a_label, *b_label]), return_inverse=True)
    la, lb = number[: len(a)], number[len(a) :]
    x, y = ([np.frombuffer(s, dtype=_U) for s in sets] for sets in (a_set, b_set))
    p, q = (np.array([len(s) for s in sets], dtype=np.int64) for sets in (x, y))
    fits = (la[:, None] != lb) & (p[:, None] * den >= q * num) & (q * den >= p[:, None] * num) & (p[:, None] > 0)
    rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if not len(rows):
        return out
    both = intersections([x[i] for i in rows], [y[j] for j in columns]).astype(np.int64)
    i, j = np.nonzero((den * both >= num * (p[rows][:, None] + q[columns] - both)) & fits[np.ix_(rows, columns)])
    if not len(i):
        return out
    i, j = rows[i], columns[j]
    # a forest over the labels that are linked
    some, near = np.unique(np.concatenate((la[i], lb[j])), return_inverse=True)
    u, v = near[: len(i)], near[len(i) :]
    link = np.full((len(some), len(some)), -1, dtype=np.int64)
    link[u, v] = link[v, u] = np.arange(len(i))
    new = np.ones(len(some), dtype=bool)
    for s in range(len(some)):
        todo = [s] if new[s] else []
        new[s] = False
        while todo:
            r = todo.pop()
            for t in np.flatnonzero(new & (link[r] >= 0)).tolist():
                new[t] = False
                todo.append(t)
                e = link[r, t]
                out[0].append(min(a[i[e]], b[j[e]]))
                out[1].append(max(a[i[e]], b[j[e]]))
    return out


def _compare(num: int, den: int):
    """Pairs (a, b) of linked labels, of rows (tile, side, label, set) in order of tiles: between sides 1 and 2 of a
    tile, or, where all are on side 0, between all and all."""

    def tile(parts: list[tuple]) -> tuple[list, list]:
        side, label = (np.concatenate([p[i] for p in parts]) for i in range(2))
        sets = [s for p in parts for s in p[2]]
        first, second = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
        return linked_across(*(v for at in (first, second) for v in (label[at], label[at], [sets[i] for i in at])), num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, side, label = (batch.column(i).to_numpy() for i in range(3))
            sets = batch.column(3)
            at = np.frombuffer(sets.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(sets.type) else np.int32)[sets.offset : sets.offset + len(sets) + 1]
            data = sets.buffers()[2]
            sets = [np.frombuffer(data, dtype=_U, count=(e - s) // 8, offset=s) if e > s else np.empty(0, _U) for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
            out: tuple[list, list] = ([], [])
            cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and now != t[s]:
                    for o, f in zip(out, tile(held), strict=True):
                        o += f
                    held = []
                held.append((side[s:e], label[s:e], sets[s:e]))
                now = t[s]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
        if held:
            a, b = tile(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Texts are linked when ``den * intersection >= num * union`` of their shingle sets; component_id is the smallest
    id that a text reaches over links.  A null, empty or wordless text has no shingles and reaches itself only.  Rows
    with the same id and set are one document given twice and both are kept; a null id is never smallest, and a
    component of null ids only has a null component_id and is kept.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shelf = Shelf(spark, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("rk", F.xxhash64("id", "text"))
    profiles = source.mapInArrow(frugal(_profiles(k)), f"id {kind}, rk long, n long, k1 long, k2 long, sig binary")
    profiles = shelf.put(profiles.withColumn("c", F.monotonically_increasing_id()))
    first = profiles.where("n > 0").groupBy("k1", "k2").agg(F.min("c").alias("c"), F.min("id").alias("least"))
    classes = shelf.put(profiles.drop("id").join(first.select("c", F.col("least").alias("id")), "c"))
    root = _connected(classes, source, shelf, k, num, den)
    named = classes.select("c", "id", "k1", "k2")
    named = named if root is None else _named(named, root, "c").drop("c").withColumnRenamed("label", "c")
    found = named.join(named.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("k1", "k2", "component_id")
    found = shelf.put(found)
    shelf.drop(classes)
    out = profiles.select("id", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, as they are: of each component the document with the smallest id.

    Texts without words are nobody's duplicates and stay.  Rows of one id stay or go together: they stay if one of
    them is kept.  Rows with a null id cannot be told apart and stay.  An empty table gives an empty one.
    """
    kept = near_duplicates(docs, id_col, text_col, k, num, den).groupBy(id_col).agg(F.max("kept").alias("__kept"))
    return docs.join(kept.where(~F.col("__kept")).select(id_col), id_col, "left_anti").select(*docs.columns)


def _named(rows: DataFrame, root: DataFrame, name: str, label: str = "label") -> DataFrame:
    """rows with the label of ``name``: its root, or itself."""
    return rows.join(root.toDF(name, "__root"), name, "left").withColumn(label, F.coalesce("__root", name)).drop("__root")


def _connected(classes: DataFrame, source: DataFrame, shelf: Shelf, k: int, num: int, den: int) -> DataFrame | None:
    """``c, root`` of the classes whose root is another class; None if no class shares a node with another."""
    share, root = den / num - 1, None

    def walked(rows: DataFrame, steps: int) -> DataFrame:
        return rows.mapInArrow(frugal(_paths(steps, share)), "path long, c long, n long")

    nodes = walked(classes.select("c", "n", "sig"), DEPTHS[0])
    shared = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("c").alias("lead")).where("size > 1")
    nodes = shelf.put(nodes.join(shared, "path"))
    if nodes.isEmpty():
        return None
    need = nodes.select("c").distinct().join(classes.select("c", "rk", "k1", "k2"), "c")
    texts = source.select("rk", "text").join(need, "rk").select("c", "text", "k1", "k2").dropDuplicates(["c"])
    sets = shelf.put(texts.mapInArrow(frugal(_sets(k)), "c long, set binary"))

    def compare(tiles: DataFrame) -> DataFrame:
        """Compares rows (tile, side, c, label).  Gives the labels that are no longer roots with their roots, and
        keeps root up to date."""
        nonlocal root
        rows = tiles.join(sets, "c").select("tile", "side", "label", "set").repartition("tile").sortWithinPartitions("tile")
        new = components(rows.mapInArrow(frugal(_compare(num, den)), "a long, b long"), shelf).where("c <> root")
        if root is None:
            root = new
        else:
            root = shelf.put(_named(root.toDF("at", "c"), new, "c", "root").select(F.col("at").alias("c"), "root").union(new))
        return new

    # each class with the leader that most of its nodes share
    compare(_stars(nodes.where("lead <> c").select(F.col("lead").alias("a"), "c", "n", F.col("lead").alias("a_label"), F.col("c").alias("label"))))
    mixed = shelf.put(_mixed(_named(nodes.select("path", "c", "n"), root, "c")))
    strays = mixed.where("kind = 'stray'")
    if not strays.isEmpty():
        new = compare(_stars(strays.select(F.col("lead").alias("a"), "c", "n", F.col("main").alias("a_label"), "label")))
        again = _named(_named(mixed.withColumnRenamed("label", "was"), new, "was"), new, "main", "held_by").drop("was", "main").withColumnRenamed("held_by", "main")
        mixed = shelf.put(again.where("kind <> 'stray' or label <> main"))
        strays = mixed.where("kind = 'stray'")
    tiles = [_exhaustive(mixed.where("kind = 'small'"), num, den), _against(strays, root, classes)]
    large, between = mixed.where("kind <> 'small'").select("path", "c", "n", "label"), []
    for depth, below in enumerate(DEPTHS):
        if depth:
            large = walked(large.join(classes.select("c", "sig"), "c").select("c", "n", "sig", "path"), below - DEPTHS[depth - 1])
            large = _named(large, root, "c")
        several = large.groupBy("path").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("path", "size")
        large = shelf.put(large.join(several, "path"))
        if large.isEmpty():
            break
        tiles.append(_exhaustive(large.where(F.col("size") <= SMALL), num, den))
        between.append(large.where((F.col("size") > SMALL) & ((F.col("size") <= LARGE) | F.lit(below == DEPTHS[-1]))).drop("size"))
        large = large.where(F.col("size") > LARGE).drop("size")
        if large.isEmpty():
            break
    if between:
        rows = reduce(DataFrame.union, between)
        ties = rows.join(rows.groupBy("path").agg(F.min("c").alias("b")), "path").select(F.col("c").alias("a"), "b")
        groups = components(ties, shelf).withColumnRenamed("root", "g")
        tiles.append(_all_with_all(rows.select("c", "n", "label").distinct().join(groups, "c")))
    compare(reduce(DataFrame.union, tiles))
    shelf.drop(nodes, sets, mixed)
    return root


def _first(value: str, k: str, by: str) -> Column:
    """The value with the most of k; ties go by a hash."""
    return F.max_by(value, F.col(k) * F.lit(1 << 40) + F.pmod(F.xxhash64(by), F.lit(1 << 40)))


def _blocks(count: Column, mass: Column) -> Column:
    return F.greatest(F.ceil(count / ROWS), F.ceil(mass / MASS), F.lit(1)).cast("int")


def _in_block(c: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), c), F.col(blocks)).cast("int")


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _mixed(rows: DataFrame) -> DataFrame:
    """Of the nodes of rows (path, c, n, label) with several labels: of a large node that one label holds most of, its
    strays, with that label as ``main`` and a leader of it as ``lead``; all rows of other large nodes and of small ones.
    ``kind`` tells which."""
    turn = F.lit(0x1E3779B97F4A7C15)  # another order of the classes than that in which the first leaders were taken
    by = rows.groupBy("path", "label").agg(F.count("*").alias("k"), F.min(F.col("c").bitwiseXOR(turn)).alias("lead"))
    most = by.groupBy("path").agg(
        F.sum("k").alias("size"), F.count("*").alias("labels"), F.max("k").alias("top"), _first("label", "k", "label").alias("main"), _first("lead", "k", "label").alias("lead")
    )
    kind = F.when(F.col("size") <= SMALL, "small").when(F.col("top") * 2 > F.col("size"), "stray").otherwise("other")
    most = most.where("labels > 1").select(F.col("path").alias("p"), "main", F.col("lead").bitwiseXOR(turn).alias("lead"), kind.alias("kind"))
    return rows.join(most, (F.col("path") == F.col("p")) & ((F.col("kind") != "stray") | (F.col("label") != F.col("main")))).drop("p")


def _stars(rows: DataFrame) -> DataFrame:
    """Tiles of rows (a, c, n, a_label, label), one a node: each class c with the leader a that most of its rows have."""
    times = rows.groupBy("a", "c", "n", "a_label", "label").agg(F.count("*").alias("times"))
    best = times.groupBy("c", "n", "label").agg(_first("a", "times", "a").alias("a"), _first("a_label", "times", "a").alias("a_label"))
    blocks = best.groupBy("a").agg(_blocks(F.count("*"), F.sum("n")).alias("k"))
    tiled = best.join(blocks, "a").withColumn("tile", F.xxhash64(F.lit(1), "a", _in_block("c", "k")))
    leaders = tiled.select("tile", F.lit(1).alias("side"), F.col("a").alias("c"), F.col("a_label").alias("label")).distinct()
    return leaders.union(tiled.select("tile", F.lit(2), "c", "label"))


def _exhaustive(rows: DataFrame, num: int, den: int) -> DataFrame:
    """A tile for each node with several labels of rows (path, c, n, label), and one for nodes with the same classes; two
    classes whose sizes rule out a link need none."""
    tiles = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("c", "n", "label"))).alias("m"))
    tiles = tiles.select(F.xxhash64(F.lit(2), "m.c").alias("tile"), "m").dropDuplicates(["tile"])
    a, b = F.element_at("m", 1)["n"], F.element_at("m", -1)["n"]
    tiles = tiles.where(F.size(F.array_distinct("m.label")) > 1).where((F.size("m") > 2) | ((a * den >= b * num) & (b * den >= a * num)))
    return tiles.select("tile", F.explode("m").alias("m")).select("tile", F.lit(0).alias("side"), "m.c", "m.label")


def _against(strays: DataFrame, root: DataFrame, classes: DataFrame) -> DataFrame:
    """Tiles of each stray with all classes of the label that holds most of its node."""
    strays = strays.select("main", "c", "n", "label").distinct()
    cut = strays.groupBy("main").agg(_blocks(F.count("*"), F.sum("n")).alias("ks"))
    members = root.join(cut, F.col("root") == F.col("main")).select("main", "ks", "c").union(cut.select("main", "ks", "main")).join(classes.select("c", "n"), "c")
    cut = members.groupBy("main", "ks").agg(_blocks(F.count("*"), F.sum("n")).alias("km"))
    members = members.select("main", "c").join(cut, "main").select("main", _in_block("c", "km").alias("j"), _each("ks").alias("i"), F.lit(2).alias("side"), "c", F.col("main").alias("label"))
    strays = strays.join(cut, "main").select("main", _each("km").alias("j"), _in_block("c", "ks").alias("i"), F.lit(1).alias("side"), "c", "label")
    return strays.union(members).select(F.xxhash64(F.lit(4), "main", "i", "j").alias("tile"), "side", "c", "label")


def _all_with_all(rows: DataFrame) -> DataFrame:
    """Tiles of all pairs of blocks of each group of rows (g, c, n, label)."""
    cut = rows.groupBy("g").agg(_blocks(F.count("*"), F.sum("n")).alias("k"))
    rows = rows.join(cut, "g").select("g", "c", "label", _in_block("c", "k").alias("i"), _each("k").alias("j"))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return rows.select(F.xxhash64(F.lit(5), "g", F.least("i", "j"), F.greatest("i", "j")).alias("tile"), side.alias("side"), "c", "label")
