"""MinHash near-duplicates with sequential Bayesian verification.

1. One narrow pass turns every text into its set size, a 128-bit digest of its
   shingle set, band hashes and a short verification signature.  Documents with the
   same set become one *node*, however many copies there are.
2. Nodes that share a band are candidates.  Pairs of a bucket are never emitted
   wholesale: each bucket has a few pivots, the nodes with the largest buckets, and
   every node is paired with them.
3. A candidate's signatures are compared in batches.  After each batch the posterior
   of the similarity, Beta prior and binomial likelihood, prunes the pair if the
   chance that it reaches the threshold is below ``MISS``.  Survivors are verified
   on the full shingle sets.
4. What the pivots leave, nodes outside their bucket's largest component, is compared
   with all of that component in blocks of bounded size: the same pruning, the same
   verification, and only links between components leave the task.

Only links between components are missing from the link table, none that would
join two components.  Components come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

from . import common

# 40 bands of 5: a pair at similarity 0.8 shares no band with probability 1.2e-7.
BANDS, BAND_ROWS = 40, 5
# Verification hashes, apart from those of the bands, compared in batches.
CHECKS, CHECK_BATCH = 64, 16
# A pair is pruned if its posterior chance to reach the threshold is below this.
MISS = 1e-4
# Pivots of a bucket; shingles of a block when the rest is compared.
PIVOTS, BLOCK = 3, 500_000

_rng = np.random.default_rng(7)
_HASHES = _rng.integers(1, 1 << 63, BANDS * BAND_ROWS + CHECKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST, _ONE, _DIGEST = (np.uint64(x) for x in _rng.integers(1, 1 << 62, 3) * 2 + 1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within the row, and their row bounds.

    Lower-cases A-Z.  A row with fewer than ``size`` words has one shingle, one
    without words none.
    """
    data = data.copy()
    capital = (data >= 65) & (data <= 90)
    data[capital] += 32
    starts, ends, row = common.words(data, bounds)
    rows = len(bounds) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    sums = common.running(common.word_hashes(data, starts, ends))
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    each = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    until = np.minimum(at + size, np.repeat(first[1:], each))
    hashes = common.span_hashes(sums, at, until)
    edges = np.concatenate([[0], np.cumsum(each)])
    for i in np.flatnonzero(each > 1):
        hashes[edges[i] : edges[i + 1]].sort()
    owner = np.repeat(np.arange(rows), each)
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=rows))])


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest (two numbers), band hashes and verification hashes of non-empty sets."""
    starts = bounds[:-1]
    low = np.empty((len(_HASHES), len(starts)), np.uint64)
    for i, h in enumerate(_HASHES):
        low[i] = np.minimum.reduceat(hashes * h, starts)
    digest = np.stack([np.add.reduceat(common.mix(hashes * m), starts) for m in (_FIRST, _DIGEST)], 1)
    bands = np.zeros((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(BAND_ROWS):
            bands[:, b] = common.mix(bands[:, b] * _ONE + low[b * BAND_ROWS + r] + np.uint64(b))
    checks = (low[BANDS * BAND_ROWS :].T >> np.uint64(48)).astype(np.uint16)
    return digest, bands, checks


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for i, j in common.slices(offsets):
                bounds = offsets[i : j + 1] - offsets[i]
                hashes, edges = shingle_sets(data[offsets[i] : offsets[j]], bounds, size)
                count = np.diff(edges)
                full = np.flatnonzero(count)
                nodes, bands, checks = [None] * (j - i), [None] * (j - i), [None] * (j - i)
                if len(full):
                    digest, band, check = signatures(hashes, np.append(edges[full], edges[-1]))
                    band = band.view(np.int64)
                    for k, row in enumerate(full):
                        nodes[row], bands[row], checks[row] = digest[k].tobytes(), band[k], check[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(count, pa.int64()),
                     pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(checks, pa.binary())],
                    names=["doc_id", "key", "n", "node", "bands", "checks"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for i, j in common.slices(offsets):
                hashes, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                sets = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


@lru_cache(64)
def least_agreements(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each number of compared hashes the fewest agreements that keep a pair.

    Prior Beta(1, 1) on the similarity; the posterior tail comes from the beta
    density on a fine grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    log_p, log_q = np.log(grid), np.log1p(-grid)
    above = grid >= threshold
    least = np.zeros(CHECKS + 1, np.int64)
    for n in range(1, CHECKS + 1):
        for m in range(n + 1):
            density = m * log_p + (n - m) * log_q
            density = np.exp(density - density.max())
            if density[above].sum() >= miss * density.sum():
                least[n] = m
                break
    return least


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Row numbers of the signature pairs that no batch prunes."""
    least, alive, agree = least_agreements(threshold), np.arange(len(left)), np.zeros(len(left), np.int64)
    for end in range(CHECK_BATCH, CHECKS + 1, CHECK_BATCH):
        batch = slice(end - CHECK_BATCH, end)
        agree = agree + (left[alive, batch] == right[alive, batch]).sum(1)
        keep = agree >= least[end]
        alive, agree = alive[keep], agree[keep]
    return alive


def _checks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, CHECKS)


def _prune(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = survivors(_checks(batch.column("ca")), _checks(batch.column("cb")), threshold)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, known, held = [], None, None
            for i in range(batch.num_rows):
                raw = batch.column("sa")[i].as_buffer()
                if known is None or not raw.equals(known):
                    known, held = raw, np.frombuffer(raw, np.uint64)
                other = np.frombuffer(batch.column("sb")[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(held, other), len(held) - 1)
                both = int((held[at] == other).sum())
                if 100 * both >= percent * (len(held) + len(other) - both):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    return run


def _in_blocks(percent: int):
    """Links between different components in one pair of blocks of a group; one per node and component."""

    def run(few: pa.Table, rest: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        if not few.num_rows or not rest.num_rows:
            return schema.empty_table()
        nodes, comps = rest.column("node").to_pylist(), rest.column("comp").to_pylist()
        checks, sizes = _checks(rest.column("checks")), rest.column("n").to_numpy()
        numbers = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        group = np.array([numbers[c] for c in comps])
        known, place = np.unique(np.frombuffer(b"".join(rest.column("shingles").to_pylist()), np.uint64), return_inverse=True)
        starts, wanted = np.cumsum(sizes) - sizes, np.zeros(len(known), bool)
        found = []
        for node, comp, check, raw in zip(*(few.column(c).to_pylist() for c in ("node", "comp", "checks", "shingles"))):
            own = np.frombuffer(raw, np.uint64)
            small, large = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
            at = np.flatnonzero((group != numbers.get(comp, -1)) & (100 * small >= percent * large))
            mine = np.broadcast_to(np.frombuffer(check, np.uint16), (len(at), CHECKS))
            at = at[survivors(mine, checks[at], percent / 100)]
            if not len(at):
                continue
            here = np.minimum(np.searchsorted(known, own), len(known) - 1)
            here = here[known[here] == own]
            wanted[here] = True
            both = np.add.reduceat(wanted[place], starts, dtype=np.int64)[at]
            wanted[here] = False
            linked = at[100 * both >= percent * (sizes[at] + len(own) - both)]
            linked = linked[np.unique(group[linked], return_index=True)[1]]
            found += [(min(node, nodes[i]), max(node, nodes[i])) for i in linked]
        return pa.table([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], schema=schema)

    return run


class _Links:
    """Verified links between nodes, and the components that they make so far."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes = nodes.select("node", "n", "checks")
        self.sets, self.percent = sets, percent
        self.edges: DataFrame | None = None
        self.comps: DataFrame | None = None

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a``, ``b`` that size and signatures leave possible."""
        left = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("checks").alias("ca"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("checks").alias("cb"))
        sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return sized.select("a", "b", "ca", "cb").mapInArrow(_prune(self.percent / 100), "a binary, b binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = stash(pairs).join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(_verify(self.percent), "a binary, b binary")

    def add(self, links: DataFrame, last: bool = False) -> None:
        """Join components by verified links.

        Only the ``last`` call needs every component as a whole: until then one that
        falls into several costs comparisons, no links.
        """
        if self.edges is not None:
            links = links.union(self.edges)
        self.edges = stash(common.contracted(stash(links), None if last else 2))
        self.comps = stash(common.roots(self.edges))

    def with_comp(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("comp")
        if self.comps is None:
            return rows.withColumn("comp", F.col("node"))
        known = self.comps.select("node", F.col("root").alias("comp"))
        return rows.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return members.join(mixed.select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept, class`` of every document row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles (A-Z lower-cased, words between ASCII white space).
    ``component_id`` is the smallest ``doc_id`` reachable, ``kept`` says that a row
    has it, ``class`` is the component's own name (null without words).  A text
    that is null, empty or without words has no shingles and is a component of its
    own.  A null ``doc_id`` never becomes a component's id unless it is alone, and
    such a row is kept only if its component has no other id.  Repeated rows are
    linked with each other and share their ``doc_id``.  Other columns are ignored.
    """
    rows = docs.select("doc_id", common.row_key().alias("key"), "text")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, node binary, bands array<long>, checks binary"
    rows = stash(rows.mapInArrow(_sketch(size), kinds))
    nodes = rows.where("node is not null").groupBy("node")
    nodes = nodes.agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("checks").alias("checks"))
    nodes = stash(nodes)
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stash(members.join(shared, "bucket"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stash(members.select("bucket", "node").join(weight, "node"))
    wanted = weight.select("node").join(nodes.select("node", "key"), "node")
    texts = docs.select(common.row_key().alias("key"), "text").join(wanted, "key").dropDuplicates(["key"]).select("node", "text")
    links = _Links(nodes, stash(texts.mapInArrow(_sets(size), "node binary, shingles binary")), percent)

    third = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = members.groupBy("bucket", third.alias("third")).agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    pivots = pivots.groupBy("bucket").agg(F.collect_list("pivot").alias("pivots"))  # PIVOTS at most
    members = stash(members.select("bucket", "node").join(pivots, "bucket"))
    pairs = members.select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links.add(links.verified(links.pruned(pairs)))
    members = members.where(~F.array_contains("pivots", F.col("node"))).select("bucket", "node")
    members = stash(_open_buckets(links.with_comp(members)))
    links.add(_rest(members, links), last=True)

    found = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "node")
    roots = links.comps.select("node", F.col("root").alias("class"))
    found = stash(found.join(roots, "node", "left").withColumn("class", F.coalesce("class", "node")))
    least = found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    found = found.join(least, "class", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "key", "n_shingles", "component_id", kept, "class")


def _rest(members: DataFrame, links: _Links) -> DataFrame:
    """Links that the pivots did not see, of nodes outside their bucket's largest component.

    Such a node is compared with the whole of that component and with the other
    nodes that came to it, in blocks of about ``BLOCK`` shingles.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp"))["comp"].alias("group"))
    few = stash(members.join(largest, "bucket").where("comp <> group").select("group", "node", "comp").distinct())
    groups = few.select("group").distinct()
    whole = links.comps.select(F.col("root").alias("group"), "node", F.col("root").alias("comp")).join(groups, "group")
    alone = groups.select("group", F.col("group").alias("node"), F.col("group").alias("comp"))
    rest = whole.union(alone).union(few).distinct()

    size = links.nodes.select("node", "n")
    few, rest = (stash(df.join(size, "node")) for df in (few, rest))
    blocks = lambda df, name: df.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias(name))
    counts = blocks(few, "xs").join(blocks(rest, "ys"), "group")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    few = few.join(counts, "group").withColumn("x", own("xs")).withColumn("y", every("ys"))
    rest = rest.join(counts, "group").withColumn("y", own("ys")).withColumn("x", every("xs"))
    full = links.nodes.select("node", "checks").join(links.sets, "node")
    columns, keys = ["group", "x", "y", "node", "comp", "n", "checks", "shingles"], ["group", "x", "y"]
    named = lambda df: df.join(full, "node").select(*[F.col(c).alias(c) for c in columns]).groupBy(keys)
    return named(few).cogroup(named(rest)).applyInArrow(_in_blocks(links.percent), "a binary, b binary")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of every component stays.

    Texts without words are components of their own and stay; of rows that repeat the
    same id and text one stays.
    """
    found = near_duplicates(docs, size, percent).where("kept")
    name = common.fresh(docs, "row_key")
    alone = found.where("class is null").select("key")
    first = found.where("class is not null").groupBy("class").agg(F.min("key").alias("key")).select("key")
    keys = alone.union(first).distinct().withColumnRenamed("key", name)
    # Rows that are equal in id and text share a key; one of them stays.
    return docs.withColumn(name, common.row_key()).join(keys, name, "left_semi").dropDuplicates([name]).drop(name)
