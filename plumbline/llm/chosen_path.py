"""Similarity join of word-shingle sets by chosen paths.

Every set is embedded as ``width`` MinHash tokens. A run splits the sets by
tokens that a hash of (run, path, token) chooses, 1/threshold of a set's tokens
on average, so that two sets of that similarity go on together down a path
with even odds at each step. Buckets of a few sets are compared by brute force;
larger ones are split again by the next token of the path, unless the split
leaves most of their sets together (then they are alike) or the path is long.
Those are compared whole too, in pairs of blocks of bounded size.

A pair belongs to the first bucket that it shares, so no pair is counted twice
and none is written: buckets give counts and a few edges per set. Buckets are
first compared by their tokens, with a margin; only sets that have a partner
there are fetched and compared exactly. Runs are added until the estimated
share of links found reaches the target (links seen in one or two runs tell how
many were seen in none). Pairs that share frequent tokens only meet deep down
and more seldom, and families give many easy links; so the target holds for
each depth, and for links of families and others, on their own. A depth that
has reached it is closed: its buckets are not compared again, and further runs
bring none for it.

Sets that are equal are one class from the start, whatever the number of
copies; only one of them takes part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.characters import mix, shingle_sets
from plumbline.llm.common import Copies, id_and_text, join_groups, maybe_in, text_batches, text_mark, without_ids, without_rows
from plumbline.session import materialize

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A path is its run's number above so many bits of a hash.
_RUN_BITS = 48
_MOST_RUNS = 1 << (63 - _RUN_BITS)


@dataclass(frozen=True)
class Paths:
    """``threshold`` of the join; shingle ``words``; MinHash tokens; first number of runs; recall to reach.

    ``leaf`` sets are compared by brute force; larger buckets that stay together
    in pairs of blocks of about ``block`` sets and ``block_shingles`` shingles
    (a bound of memory, 2 MB of tokens and 32 MB of shingles); a path has
    ``depth`` steps at most, and a bucket is not split where one step keeps
    ``alike`` of it together. ``margin`` is how far below the threshold the
    tokens' estimate may lie: 5 standard deviations. Links between sets that
    both have more than ``family`` in a bucket are estimated apart.
    """

    threshold: float = 0.8
    words: int = 5
    width: int = 128
    runs: int = 10
    recall: float = 0.995
    leaf: int = 256
    block: int = 2048
    block_shingles: int = 1 << 22
    depth: int = 6
    alike: float = 0.4
    margin: float = 0.18
    family: int = 16


# --- in tasks -----------------------------------------------------------------------------------


def min_tokens(sets: list[np.ndarray], width: int) -> np.ndarray:
    """MinHash tokens of sets that are not empty."""
    values = np.concatenate(sets)
    offsets = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = (values >> np.uint64(32)).astype(np.uint32)
    keys = mix(np.arange(1, 2 * width + 1, dtype=np.uint64) * _STEP).astype(np.uint32)
    tokens = np.empty((len(sets), width), np.uint32)
    for i in range(width):
        hashed = low * (keys[2 * i] | np.uint32(1))
        hashed ^= hashed >> np.uint32(15)
        hashed *= keys[2 * i + 1] | np.uint32(1)
        tokens[:, i] = np.minimum.reduceat(hashed, offsets)
    return tokens


def chosen(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: every token of a row that its path chooses gives one."""
    width = tokens.shape[1]
    named = tokens.astype(np.uint64) * np.uint64(width) + np.arange(width, dtype=np.uint64)
    draws = mix(named * _STEP ^ paths.astype(np.uint64)[:, None])
    limit = np.uint64(min(1.0, 1 / (threshold * width)) * float(1 << 63) * 2 - 2048)
    rows, columns = np.nonzero(draws < limit)
    run = paths[rows] >> np.int64(_RUN_BITS)
    new = (run << np.int64(_RUN_BITS)) | (mix(draws[rows, columns] + _STEP) >> np.uint64(64 - _RUN_BITS)).astype(np.int64)
    return rows, new


def _sets(options: Paths):
    def run(batches):
        for batch in text_batches(batches, chars=1_000_000):
            sets = shingle_sets(batch.column("text").to_pylist(), options.words)
            full = [k for k, s in enumerate(sets) if len(s)]
            tokens: list = [None] * len(sets)
            if full:
                for k, row in zip(full, min_tokens([sets[k] for k in full], options.width)):
                    tokens[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(tokens, pa.binary()),
                    batch.column("mark"),
                ],
                ["doc_id", "digest", "size", "tokens", "mark"],
            )

    return run


def _full_sets(options: Paths):
    def run(batches):
        for batch in text_batches(batches, chars=1_000_000):
            sets = shingle_sets(batch.column("text").to_pylist(), options.words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["digest", "shingles"],
            )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _first_step(options: Paths, first: int, last: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, nodes = _matrix(batch.column("tokens"), options.width), np.asarray(batch.column("node"))
            sizes = np.asarray(batch.column("size"))
            for number in range(first, last):
                rows, paths = chosen(tokens, np.full(len(nodes), number << _RUN_BITS, np.int64), options.threshold)
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(nodes[rows]), pa.array(sizes[rows])], ["path", "node", "size"])

    return run


def _next_step(options: Paths):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, nodes = _matrix(batch.column("tokens"), options.width), np.asarray(batch.column("node"))
            rows, paths = chosen(tokens, np.asarray(batch.column("path")), options.threshold)
            above, sizes = (np.asarray(batch.column(c))[rows] for c in ("n", "size"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(nodes[rows]), pa.array(sizes), pa.array(above)], ["path", "node", "size", "above"]
            )

    return run


def groups_in(batches, keys: list[str]):
    """Runs of rows with equal keys in sorted batches, joined over the batches' borders."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *cuts.tolist(), n]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that several rows are in, where each stands first in the rows' lists, and which rows are in which."""
    lists = table["leaves"].combine_chunks()
    values, owners = np.asarray(lists.flatten()), np.repeat(np.arange(len(table)), np.asarray(pc.list_value_length(lists)))
    names, first, columns, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    inside = place[columns] >= 0
    held = np.zeros((len(table), len(common)), np.float32)
    held[owners[inside], place[columns[inside]]] = 1
    return names[common], first[common], held


def _earlier(names: np.ndarray, held: np.ndarray, leaf: int, a: int = 0, b: int | None = None) -> np.ndarray:
    """For rows a..b-1 with all others: whether they share an earlier bucket."""
    earlier = held[:, names < leaf]
    return earlier[a:b] @ earlier.T > 0


def _runs_met(table: pa.Table, first: np.ndarray, held: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """For rows a..b-1 with all others: in how many runs they share a bucket, in however many of a run."""
    lists = pc.take(table["runs"].combine_chunks().flatten(), pa.array(first))
    runs, columns = np.asarray(lists.flatten()), np.repeat(np.arange(len(first)), np.asarray(pc.list_value_length(lists)))
    met = np.zeros((len(held[a:b]), len(held)), np.int32)
    for run in np.unique(runs):
        own = held[:, columns[runs == run]]
        met += own[a:b] @ own.T > 0
    return met


#: Rows of a bucket that are compared with all others at once.
_TILE = 256


def _tiles(n: int):
    return ((a, min(a + _TILE, n)) for a in range(0, n, _TILE))


def _own_pairs(table: pa.Table, a: int, b: int) -> np.ndarray:
    """Of the pairs of rows a..b-1 with later ones those that this group compares: all, or those between its two blocks."""
    pairs = np.arange(len(table))[None, :] > np.arange(a, b)[:, None]
    if table["low"][0].as_py() != table["high"][0].as_py():
        block = np.asarray(table["block"])
        pairs &= block[a:b, None] != block
    return pairs


def _candidates(options: Paths):
    least = options.width * (options.threshold - options.margin)

    def run(batches):
        for table in groups_in(batches, ["leaf", "low", "high"]):
            n = len(table)
            if n < 2:
                continue
            tokens = np.ascontiguousarray(_matrix(table["tokens"].combine_chunks(), options.width).T)
            size = np.asarray(table["size"]).astype(np.float64)
            found, near = None, np.zeros(n, bool)
            for a, b in _tiles(n):
                if n <= 64:
                    agree = (tokens[:, :, None] == tokens[:, None, :]).sum(axis=0)
                else:
                    agree = np.zeros((b - a, n), np.uint16)
                    for own in tokens:
                        agree += own[a:b, None] == own
                fit = (size[a:b, None] >= options.threshold * size) & (size >= options.threshold * size[a:b, None])
                like = (agree >= least) & _own_pairs(table, a, b) & fit
                if not like.any():
                    continue
                found = found or _held(table)
                like &= ~_earlier(found[0], found[2], table["leaf"][0].as_py(), a, b)
                near[a:b] |= like.any(axis=1)
                near |= like.any(axis=0)
            rows = np.flatnonzero(near)
            if len(rows):
                yield from table.take(pa.array(rows)).select(["leaf", "low", "high", "block", "depth", "leaves", "runs", "node", "doc_id", "digest"]).to_batches()

    return run


class Overlaps:
    """Sizes of the intersections of sets, by products of blocks of their incidence matrix."""

    def __init__(self, sets: list[np.ndarray], columns: int | None = None):
        self.n = len(sets)
        values, owners = np.concatenate(sets), np.repeat(np.arange(self.n), [len(s) for s in sets])
        _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        inside = counts[inverse] > 1
        rows, places = owners[inside], place[inverse[inside]]
        order = np.argsort(places, kind="stable")
        self.rows, self.places = rows[order], places[order]
        self.columns = columns or (4096 if self.n <= 1024 else 1024)

    def of(self, a: int, b: int) -> np.ndarray:
        """Those of sets a..b-1 with all."""
        total = np.zeros((b - a, self.n), np.float32)
        for first in range(0, int(self.places[-1]) + 1 if len(self.places) else 0, self.columns):
            x, y = np.searchsorted(self.places, [first, first + self.columns])
            held = np.zeros((self.n, self.columns), np.float32)
            held[self.rows[x:y], self.places[x:y] - first] = 1
            total += held[a:b] @ held.T
        return total.astype(np.int64)


def overlaps(sets: list[np.ndarray], columns: int | None = None) -> np.ndarray:
    """Those of all with all."""
    return Overlaps(sets, columns).of(0, len(sets))


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    linked, labels = links | links.T, np.arange(len(links))
    while True:
        new = labels.copy()
        for a, b in _tiles(len(links)):
            near = np.where(linked[a:b], labels[None, :], len(labels)).min(axis=1)
            new[a:b] = np.minimum(labels[a:b], near)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


#: Pairs, and those met in one and in two runs, of few links and of families.
_SEEN = [f"{of}_{how}" for of in ("few", "family") for how in ("pairs", "once", "twice")]


def reached(pairs: int, once: int, twice: int, recall: float) -> bool:
    """Whether the share of pairs found reaches the target, by Chao's estimate of those met in no run."""
    return pairs >= recall * (pairs + once * (once - 1) / (2 * (twice + 1)))


def _links(options: Paths):
    def run(batches):
        for table in groups_in(batches, ["leaf", "low", "high"]):
            n = len(table)
            if n < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets])
            overlaps, linked = Overlaps(sets), np.zeros((n, n), bool)
            for a, b in _tiles(n):
                # both / (a + b - both) >= t, without a division
                enough = overlaps.of(a, b) * (1 + options.threshold) >= options.threshold * (size[a:b, None] + size) - 1e-9
                linked[a:b] = enough & _own_pairs(table, a, b)
            if not linked.any():
                continue
            names, first, held = _held(table)
            for a, b in _tiles(n):
                linked[a:b] &= ~_earlier(names, held, table["leaf"][0].as_py(), a, b)
            nodes, roots = np.asarray(table["node"]), _roots(linked)
            counts = linked.sum(axis=0) + linked.sum(axis=1)
            seen = np.zeros((6, n), np.int64)
            for a, b in _tiles(n):
                met = _runs_met(table, first, held, a, b)
                family = linked[a:b] & (np.minimum(counts[a:b, None], counts) > options.family)
                # Pairs stand in the row of their first set.
                seen[:, a:b] = [(of & how).sum(axis=1) for of in (linked[a:b] & ~family, family) for how in (True, met == 1, met == 2)]
            rows = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[rows]), pa.array(nodes[roots[rows]]), pa.array(np.full(len(rows), table["depth"][0].as_py(), np.int32)),
                    *(pa.array(x[rows].astype(np.int64)) for x in (counts, *seen)),
                ],
                ["node", "root", "depth", "links", *_SEEN],
            )

    return run


# --- plan ---------------------------------------------------------------------------------------


def _buckets(frontier: DataFrame) -> DataFrame:
    """Rows of buckets with company, with the bucket's size, and that of its sets together."""
    sizes = frontier.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass")).where("n > 1")
    return frontier.join(sizes, "path")


def _near_in_size(rows: DataFrame, options: Paths) -> DataFrame:
    """Rows of which another set of the bucket has a size that allows the threshold.

    Only the next smaller and the next larger set need a look. Buckets of more
    than ``leaf`` sets, which are not bounded, pass as they are.
    """
    small = rows.where(F.col("n") <= options.leaf)
    by_size = Window.partitionBy("path").orderBy("size", "node")
    smaller, larger = F.lag("size").over(by_size), F.lead("size").over(by_size)
    near = small.withColumn(
        "near", (smaller >= options.threshold * F.col("size")) | (F.col("size") >= options.threshold * larger)
    )
    return near.where("near").drop("near").unionByName(rows.where(F.col("n") > options.leaf))


def _leaves(nodes: DataFrame, options: Paths, first: int, last: int, copy: Copies) -> DataFrame:
    """leaf, node, n, depth of the runs first..last-1, without rows that no set of their bucket is near in size."""
    total = nodes.count()
    frontier = nodes.select("node", "size", "tokens").mapInArrow(_first_step(options, first, last), "path long, node long, size int")
    frontier, done = frontier.withColumn("above", F.lit(total).cast("long")), []
    for step in range(options.depth):
        rows = copy(_buckets(frontier))
        whole = (F.col("n") <= options.leaf) | (F.col("n") >= options.alike * F.col("above")) & F.lit(step > 0) | F.lit(step == options.depth - 1)
        done.append(_near_in_size(rows.where(whole), options).select(F.col("path").alias("leaf"), "node", "n", "mass", F.lit(step).alias("depth")))
        large = rows.where(~whole).select("path", "node", "size", "n")
        if large.isEmpty():
            break
        frontier = large.join(_of_nodes(nodes.select("node", "tokens"), large), "node").select("path", "node", "size", "n", "tokens").mapInArrow(
            _next_step(options), "path long, node long, size int, above long"
        )
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result


def _of_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes that may be in ``rows``; the others' tokens need not move for a join."""
    return maybe_in(nodes, F.xxhash64("node"), rows.select(F.xxhash64("node").alias("key")))


def _different(leaves: DataFrame) -> DataFrame:
    """One bucket of those with the same sets: leaf, node, n, depth, and the ``runs`` that have it.

    Sets that belong together meet in most runs, so this is most buckets.
    """
    marks = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(20,0)")).alias(f"mark{k}") for k in (1, 2)]
    buckets = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("members"), *marks)
    runs = F.collect_set(F.shiftright("leaf", _RUN_BITS).cast("int")).alias("runs")
    kept = buckets.groupBy("members", "mark1", "mark2").agg(F.min("leaf").alias("leaf"), runs)
    return leaves.join(kept.select("leaf", "runs"), "leaf")


def _in_blocks(leaves: DataFrame, options: Paths) -> DataFrame:
    """One row for every pair of blocks of a bucket that a node's block is in; one for small buckets."""
    blocks = F.ceil(F.greatest(F.col("n") / options.block, F.col("mass") / options.block_shingles)).cast("int")
    cut = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cut.withColumn("other", other).select(
        "leaf", "node", "block", "depth", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high", "node")


def components(edges: DataFrame, copy: Copies | None = None) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (node, root) is connected with.

    Every round takes the smallest label among neighbours and then the label's
    own label; rounds end when nothing changes. Each is written to the shared folder.
    """
    copy = copy or Copies()
    ways = copy(
        edges.where("node <> root").select("node", F.col("root").alias("other")).union(edges.where("node <> root").select("root", "node"))
    )
    labels = copy(ways.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            ways.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        moved = copy(
            stepped.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("further", "new")).alias("label"))
        )
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("root"))
        labels = moved.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Paths = Paths()) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links of every row of ``docs``.

    Texts are compared as sets of ``options.words`` words (lower case, cut at
    white space; a shorter text is one shingle). Rows with equal sets are
    copies: ``copy_id`` is their smallest id, ``n_copies`` their number.
    ``n_links`` counts the other sets with a Jaccard similarity of
    ``options.threshold`` or more, each once, whatever its copies.
    ``class_id`` is the smallest id among all rows that links connect. Null,
    empty and blank texts are copies of each other and have no links. Ids may
    repeat or be null; a null id names a class only if all its rows have none.
    """
    found = _classes(docs, id_col, text_col, options, F.lit(None).cast("binary"))
    return found.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def _classes(docs: DataFrame, id_col: str, text_col: str, options: Paths, mark: Column) -> DataFrame:
    """The columns of :func:`near_duplicates`, the row's ``mark`` (of its text), and the ``head`` of its class: its first row."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        source.withColumn("mark", mark)
        .mapInArrow(_sets(options), f"doc_id {kind}, digest binary, size int, tokens binary, mark binary")
        .withColumn("node", F.monotonically_increasing_id())
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("head")
    copies = materialize(
        rows.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("copy_id"), first, F.count(F.lit(1)).alias("n_copies"))
    )
    copy = Copies()  # deleted once the classes are written
    # All sets but the further copies, whose tokens need not move to be left out.
    total = docs.count()
    chief = copies.where("n_copies > 1").select("digest", "n_copies", F.col("node").alias("chief"))
    further = join_groups(rows.select("digest", "node"), chief, "digest", "n_copies", total).where("node <> chief")
    further = further.select(F.col("node").alias("doc_id"))
    nodes = without_ids(rows.where("size > 0"), copy(further), "node").select("node", "doc_id", "digest", "size", "tokens")

    leaves, first, last = None, 0, options.runs
    closed, results = [], []
    while True:
        more = _leaves(nodes, options, first, last, copy).where(~F.col("depth").isin(closed))
        leaves = copy(more) if leaves is None else leaves.unionByName(copy(more))
        different = copy(_different(leaves))
        listed = different.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leaf", "runs"))).alias("l"))
        listed = listed.select("node", F.col("l.leaf").alias("leaves"), F.col("l.runs").alias("runs"))
        # A pair belongs to the first bucket it shares, and new buckets come after the old, so closed depths keep their pairs.
        compared = different.where(~F.col("depth").isin(closed))
        company = listed.join(_of_nodes(nodes, compared), "node")
        place = "leaf long, low int, high int, block int, depth int, leaves array<long>, runs array<array<int>>, node long"
        near = copy(
            _by_bucket(_in_blocks(compared, options).join(company, "node"))
            .select("leaf", "low", "high", "block", "depth", "leaves", "runs", "node", "doc_id", "digest", "size", "tokens")
            .mapInArrow(_candidates(options), f"{place}, doc_id {kind}, digest binary")
        )
        # Equal digests are equal sets, so the first of them serves.
        texts = maybe_in(source, F.xxhash64("doc_id"), near.select(F.xxhash64("doc_id").alias("key")))
        full = texts.mapInArrow(_full_sets(options), "digest binary, shingles binary")
        full = full.groupBy("digest").agg(F.first("shingles").alias("shingles"))
        found = copy(
            _by_bucket(near.drop("doc_id").join(full, "digest"))
            .select("leaf", "low", "high", "block", "depth", "leaves", "runs", "node", "shingles")
            .mapInArrow(_links(options), f"node long, root long, depth int, links long, {', '.join(f'{c} long' for c in _SEEN)}")
        )
        strata = found.groupBy("depth").agg(*(F.sum(c).alias(c) for c in _SEEN)).collect()
        open_ = {row.depth for row in strata if not all(reached(*row[k : k + 3], options.recall) for k in (1, 4))}
        results.append(found.where(~F.col("depth").isin(list(open_))))
        if not open_:
            break
        if last == _MOST_RUNS:
            raise RuntimeError(f"{last} runs do not reach a recall of {options.recall}")
        closed = [d for d in range(options.depth) if d not in open_]
        first, last = last, min(last * 2, _MOST_RUNS)
    found = reduce(DataFrame.unionByName, results)

    roots = components(found.select("node", "root"), copy)
    counted = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = (
        copies.join(roots, "node", "left")
        .join(counted, "node", "left")
        .select("digest", "copy_id", "head", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    classes = materialize(classes)
    copy.release()
    names = classes.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("head").alias("head"))
    groups = classes.drop("head").join(names, "root").drop("root")
    return join_groups(rows.select("doc_id", "mark", "digest"), groups, "digest", "n_copies", total)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Paths = Paths()) -> DataFrame:
    """``docs`` with one row of every class of :func:`near_duplicates`, the one with the smallest id; all columns stay.

    Of rows with that id the one whose text's digest is smallest stays, and a
    row without an id only if its class has no other. Rows that repeat id and
    text are one document and stay or go together. Null, empty and blank texts
    are one class. An empty table gives an empty result.
    """
    found = _classes(docs, id_col, text_col, options, text_mark(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))
    return without_rows(docs, materialize(found.where(~same).select("doc_id", "mark").distinct()), id_col, text_col)
