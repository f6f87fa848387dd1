"""Near-duplicate documents by one-permutation MinHash.

Method. One hash orders a document's shingles; its values are dealt into ``BINS`` bins and each bin
keeps its smallest (one-permutation hashing). Empty bins copy a bin that is drawn at random per
(empty bin, attempt) until one that is not empty is hit (optimal densification). ``BANDS`` bands of
``ROWS`` bins each are bucket keys: texts of similarity 0.85 miss all 32 buckets with probability
3e-7. Documents with equal shingle sets are one representative from the start.

The node of the link graph is a shingle set, not a doc_id, so rows that repeat an id with different
texts lose nothing; ids tie their sets together at the end.

Candidate pairs in a bucket are star-shaped: every member is paired with the bucket's centre, so a
bucket of m members gives m - 1 pairs. A signature estimate drops hopeless pairs, the rest are
confirmed on the full shingle sets, and the links are contracted to components. Buckets that still
hold several components get one more star (around the smallest member of another component than
the first centre's). What remains mixed is settled exactly inside tasks: the members outside the
bucket's largest component (the minor ones) meet each other and the rest, block against block, with
their full sets at hand, and a task gives out a spanning forest of the links it finds, at most one
link per minor member and block. No bucket is capped and no candidate pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import textnp as T
from kiln.llm.common import ready, save, small
from kiln.llm.components import components

BINS = 512
BANDS = 32
ROWS = 6
BLOCK = 1024
#: Shingle sets of a block.
BLOCK_BYTES = 4 << 20
PERCENT = 85
SHINGLE = 5

_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary, bands array<bigint>"


def _donors() -> Iterator[np.ndarray]:
    """For each attempt, the bin that each bin looks at when it is empty."""
    attempt = 0
    while True:
        yield (T.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(attempt + 1))
               % np.uint64(BINS)).astype(np.int64)
        attempt += 1


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One byte per bin and row; ``h``: the distinct shingle hashes, ascending within each row.
    Rows without shingles get zeros."""
    rows = T.row_of(counts)
    bins = (h >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    slot = rows * BINS + bins
    first = np.ones(len(h), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    sig = np.zeros(len(counts) * BINS, dtype=np.uint8)
    has = np.zeros(len(counts) * BINS, dtype=bool)
    sig[slot[first]] = (T.mix(h[first]) & np.uint64(255)).astype(np.uint8)
    has[slot[first]] = True
    at, = np.nonzero(~has & np.repeat(counts > 0, BINS))
    for donor in _donors():
        if not len(at):
            break
        row = at // BINS
        source = row * BINS + donor[at - row * BINS]
        found = has[source]
        sig[at[found]] = sig[source[found]]
        at = at[~found]
    return sig.reshape(len(counts), BINS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key per row and band."""
    part = sig[:, :BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = (key << np.uint64(8)) | part[:, :, k]
    return T.mix(key).astype(np.int64)


def _sets(data, offsets):
    data = T.lower(data)
    starts, ends, n_words = T.word_spans(data, offsets)
    h, rows = T.shingles(T.span_hashes(data, starts, ends), n_words, SHINGLE)
    return T.distinct_by_row(h, rows, len(n_words))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.slices(batch.column(1)):
            h, counts = _sets(data, offsets)
            sig = signatures(h, counts)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first), pa.array(counts), *map(pa.array, _prints(h, counts)),
                pa.array([x.tobytes() for x in sig], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
            ], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"])


def _prints(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that, with the size, name each row's set."""
    total = np.zeros((2, len(h) + 1), dtype=np.uint64)
    np.cumsum(T.mix(h + np.uint64(1)), out=total[0, 1:])
    np.cumsum(T.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    prints = (total[:, bounds[1:]] - total[:, bounds[:-1]]).astype(np.int64)
    return prints[0], prints[1]


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, n_shingles, set_a, set_b) to (node, shingles), of rows whose text has that set."""
    for batch in batches:
        for first, end, data, offsets in T.slices(batch.column(0)):
            h, counts = _sets(data, offsets)
            part = batch.slice(first, end - first)
            own = (counts, *_prints(h, counts))
            same = np.logical_and.reduce([part.column(k).to_numpy() == x for k, x in zip((2, 3, 4), own, strict=True)])
            parts = np.split(h, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x.tobytes() for x in parts], pa.binary())],
                                             names=["node", "shingles"]).filter(pa.array(same))


def _least_agreement(n: np.ndarray) -> np.ndarray:
    """Agreeing bins below which a pair is taken to be under the threshold: five standard errors.

    Densified bins repeat one another, but a short text's bins also see most of its shingles: in
    simulation the deviation of the agreement never exceeds that of min(n, BINS) independent draws."""
    error = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.clip(n, 1, BINS))
    return BINS * np.clip(PERCENT / 100 - 5 * error, 0.05, 1)


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for k in ("sa", "sb"))
        na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
        fits = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        fits &= (a == b).sum(axis=1) >= _least_agreement(np.minimum(na, nb))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fits))


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_alike(*(np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in pair))
                for pair in zip(batch.column("xa"), batch.column("xb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _forest(t: pa.Table) -> list[tuple[int, int]]:
    """A spanning forest, over the components given, of the links in one unit: between its two sides,
    or, where it has one side, among its members."""
    t = t.take(pa.array(np.argsort(t.column("n").to_numpy(), kind="stable"))).combine_chunks()
    node, n, side, comp = (t.column(k).to_numpy() for k in ("node", "n", "side", "comp"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    keys = sig[:, :BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    sets = [np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in t.column("shingles").combine_chunks()]
    band, across = t.column("band")[0].as_py(), bool(side.any())
    root = np.unique(comp, return_inverse=True)[1]
    links = []
    for i in range(len(node)):
        end = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
        j = np.arange(i + 1, end)
        j = j[(root[j] != root[i]) & ((side[j] != side[i]) if across else True)]
        if not len(j):
            continue
        j = j[(sig[j] == sig[i]).sum(axis=1) >= _least_agreement(n[i])]
        j = j[(keys[j] == keys[i]).all(axis=2).argmax(axis=1) == band]  # a pair meets in its first common bucket
        for k in j:
            if root[k] != root[i] and _alike(sets[i], sets[k]):
                links.append((int(node[i]), int(node[k])))
                root[root == root[k]] = root[i]
    return links


_UNIT = ["bucket", "kind", "i", "j"]


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by unit; a unit holds two blocks at most."""
    rest: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rest)
        rest.clear()
        if t.num_rows > 1 and (links := _forest(t)):
            a, b = np.array(links, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in _UNIT], axis=1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), len(unit)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if rest and tuple(unit[lo]) != last:
                yield from done()
            last = tuple(unit[lo])
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield from done()


class _Search:
    """The nodes (distinct shingle sets), their buckets, and the links that were confirmed so far."""

    def __init__(self, docs: DataFrame, signed: DataFrame, groups: DataFrame, repeated: bool):
        self.docs, self.repeated, self.groups = docs, repeated, groups
        own = signed.select(F.col("doc_id").alias("rep"), *_KEY, "sig", "bands")
        nodes = own.join(groups, ["rep", *_KEY]).select("node", F.col("n_shingles").alias("n"), "sig", "bands")
        # copies of the smallest id's text, where it is repeated with the same set
        self.nodes = save(nodes.dropDuplicates(["node"]) if repeated else nodes, "nodes")
        rows = self.nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
        held = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("centre")).where("m > 1")
        self.members = save(rows.join(held, "bucket").select("bucket", "band", "node", "n", "centre"), "members")
        self.links = self.tried = None

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of ``nodes``, from the texts."""
        wanted = save(nodes.join(self.groups, "node").select(F.col("rep").alias("doc_id"), "node", *_KEY), "wanted")
        found = (self.docs.select("doc_id", "text").join(small(wanted), "doc_id").select("text", "node", *_KEY)
                 .mapInArrow(_full_sets, "node bigint, shingles binary"))
        return save(found.dropDuplicates(["node"]) if self.repeated else found, "sets")

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)

    def confirm(self, pairs: DataFrame) -> None:
        """Check the pairs (a, b) that were not tried before."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        side = lambda k: self.nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
        pairs = save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_hopeful, "a bigint, b bigint"), "pairs")
        if not pairs.limit(1).count():
            return
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"x{k}"))
        self.add(save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed, "a bigint, b bigint"), "found"))
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)

    def classes(self) -> DataFrame:
        """(node, comp) of nodes with links."""
        return components(self.links).select("node", F.col("component").alias("comp"))

    def mixed(self, members: DataFrame) -> DataFrame:
        """The rows of ``members`` in buckets that hold several components, with their component."""
        if self.links is not None:
            rows = members.join(save(self.classes(), "classes"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        else:
            rows = members.withColumn("comp", F.col("node"))
        held = rows.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        return rows.join(held, "bucket")


_KEY = ["n_shingles", "set_a", "set_b"]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_shingles,
    component_id (smallest doc_id reachable over links of 85 % similarity), kept.

    A null, empty or word-less text has no shingles, stands alone and is kept. Rows that repeat a
    doc_id share a component, which holds the links of all their texts; each row has its own
    n_shingles. Rows with a null doc_id get component null and are kept. Equal sets are one class
    whatever their number. An empty table gives an empty table.
    """
    ready(docs)
    signed = save(docs.select("doc_id", "text").mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # saved: the nodes' numbers stay the same, whoever reads them
    groups = save(some.groupBy(*_KEY).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "groups")
    counts = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).agg(F.max("m")).first()
    repeated = (counts[0] or 0) > 1
    s = _Search(docs, signed, groups, repeated)
    star = s.members.where("node <> centre")
    s.confirm(star.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    again = save(s.mixed(s.members), "mixed")
    # the second centre: the smallest member of another component than the first centre's
    first = again.where("node = centre").select("bucket", F.col("comp").alias("taken"))
    again = again.join(first, "bucket").drop("c0", "c1")
    hubs = again.where("comp <> taken").groupBy("bucket").agg(F.min_by(F.struct("node", "comp"), "node").alias("at"))
    again = again.join(hubs, "bucket")
    star = again.where("comp <> at.comp and node <> centre")
    s.confirm(star.select(F.least("node", F.col("at.node")).alias("a"), F.greatest("node", F.col("at.node")).alias("b")).distinct())
    # both centres have met every member of another component
    left = again.where("node <> centre and node <> at.node").select("bucket", "band", "node", "n")
    _settle(s, left)
    own = signed.join(groups, _KEY, "left").select("doc_id", "n_shingles", "rep", "node")
    if repeated:  # rows of one id tie their sets together
        first = own.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"))
        s.add(own.where("node is not null").join(first, "doc_id").select("a", F.col("node").alias("b")).distinct())
    own = own.withColumn("doc_component", F.col("rep"))
    if s.links is not None:
        known = save(s.classes(), "classes")
        least = save(known.join(groups, "node").groupBy("comp").agg(F.min("rep").alias("least")).join(known, "comp").select("node", "least"), "least")
        own = own.join(least, "node", "left").withColumn("doc_component", F.coalesce("least", "rep"))
    component = F.coalesce("doc_component", "doc_id")
    if repeated:  # a row without shingles goes with the other rows of its id
        with_sets = own.where("doc_component is not null and doc_id is not null").groupBy("doc_id").agg(F.min("doc_component").alias("id_component"))
        own = own.join(with_sets, "doc_id", "left")
        component = F.coalesce("doc_component", "id_component", "doc_id")
    return own.select("doc_id", F.col("n_shingles").cast("bigint"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _settle(s: _Search, members: DataFrame) -> None:
    """Add what links the members of each bucket that two stars left in several components.

    Minor members (outside the bucket's largest component) are dealt into blocks by a hash, major ones
    too. Units are pairs of minor blocks and of a minor and a major block; majors of one component need
    not meet. A bucket of m members with r minor ones ships m * ceil(r / BLOCK) + r * ceil(m / BLOCK) rows at most.
    """
    rows = save(s.mixed(members), "left").select("bucket", "band", "node", "n", "comp")
    if not rows.limit(1).count():
        return
    size = F.col("n") * 8 + BINS
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum(size).alias("size"))
    held = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp", "size")).alias("top"), F.sum("m").alias("m"), F.sum("size").alias("size"))
    blocks = lambda m, size: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    held = held.select("bucket", F.col("top.comp").alias("top"), blocks(F.col("m") - F.col("top.m"), F.col("size") - F.col("top.size")).alias("minors"),
                       blocks(F.col("top.m"), F.col("top.size")).alias("majors"))
    rows = rows.join(held, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("top"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["bucket", "band", "node", "comp"]
    minor, major = rows.where("comp <> top"), rows.where("comp = top")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = [
        minor.withColumn("other", F.explode(up_to("minors"))).select(
            *cols, F.lit(0).alias("kind"), low.alias("i"), high.alias("j"), F.when(F.col("block") == low, 0).otherwise(1).alias("side")),
        minor.withColumn("other", F.explode(up_to("majors"))).select(
            *cols, F.lit(1).alias("kind"), F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side")),
        major.withColumn("other", F.explode(up_to("minors"))).select(
            *cols, F.lit(1).alias("kind"), F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))]
    units = units[0].unionByName(units[1]).unionByName(units[2])
    full = s.nodes.select("node", "n", "sig").join(s.sets(rows.select("node").distinct()), "node")
    units = units.join(full, "node").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    s.add(save(units.select(*_UNIT, "side", "band", "node", "comp", "n", "sig", "shingles").mapInArrow(_unit_links, "a bigint, b bigint"), "forest"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: all columns, the smallest doc_id's row.

    Rows with a null doc_id stay. Of rows that repeat a kept doc_id one stays.
    """
    found = save(near_duplicates(docs), "dedup")
    dropped = save(found.where("not kept").select("doc_id").distinct(), "dropped")
    rest = docs.join(small(dropped), "doc_id", "left_anti")
    if found.where("doc_id is not null").count() > found.select("doc_id").where("doc_id is not null").distinct().count():
        rest = rest.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id is null"))
    return rest
