"""Near-duplicate join by a MinHash LSH forest with exact verification (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import byte_batches, discard, few, shuffle_partitions, staged, text_or_empty
from tidewell.llm.graph import components
from tidewell.llm.shingles import SHINGLE, shingle_sets
from tidewell.operators.sizes import spread

THRESHOLD = 0.8
#: Tries, hashes on a path, and the part of pairs at the threshold that must meet in one.
TREES, DEPTH, RECALL = 16, 8, 0.995
#: Texts whose partners are looked up by whole signatures, to measure what part meets at each depth (a bounded sample).
SAMPLE = 128
#: Standard deviations that a signature's estimate may be off.
SLACK = 4.0
#: Estimated similarity to a leader from which a text doesn't lead, and what its estimate may be off by.
NEAR, SPARE = 0.9, 0.07
#: Texts and shingles of a block when a candidate class is verified, and text bytes at once.
BLOCK, BLOCK_SHINGLES, TEXT_BYTES = 192, 1 << 19, 1 << 20
#: Pairs of texts that a verifying task compares, about.
TASK_PAIRS = 1 << 15
SEED = 97


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest matched prefix that finds ``recall`` of the pairs at ``similarity``, hashes being independent."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def meeting_depths(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """By other signature: the longest common prefix over all trees."""
    return np.cumprod((others == sig).reshape(len(others), TREES, DEPTH), axis=2).sum(2).max(1)


def shortened(length: int, met: dict[int, int], recall: float = RECALL) -> int:
    """``length``, shortened while a smaller part of the sampled pairs than ``recall`` meets at it, beyond two standard deviations of chance.

    ``met`` counts pairs by the greatest depth at which they meet.
    """
    n = sum(met.values())
    allowed = n * (1 - recall) + 2 * math.sqrt(n * (1 - recall) * recall)
    while length > 1 and sum(x for depth, x in met.items() if depth < length) > allowed:
        length -= 1
    return length


def signatures(sets: list[np.ndarray], n_hashes: int = TREES * DEPTH, seed: int = SEED) -> np.ndarray:
    """MinHash values (unsigned 32 bits) of non-empty sets."""
    rng = np.random.default_rng(seed)
    scale, shift = rng.integers(0, 1 << 31, n_hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n_hashes, np.uint32)
    out = np.empty((len(sets), n_hashes), np.uint32)
    sizes = np.array([len(s) for s in sets])
    begin = 0
    with np.errstate(over="ignore"):
        while begin < len(sets):  # parts that stay in cache
            end = begin + 1
            total = sizes[begin]
            while end < len(sets) and total + sizes[end] <= 1 << 15:
                total += sizes[end]
                end += 1
            h = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(sizes[begin:end])[:-1]])
            v = np.empty_like(h)
            for i in range(n_hashes):
                np.multiply(h, scale[i], out=v)
                np.add(v, shift[i], out=v)
                np.bitwise_xor(v, v >> np.uint32(15), out=v)
                out[begin:end, i] = np.minimum.reduceat(v, at)
            begin = end
    return out


def estimate(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one 8-bit signature with others; chance matches of 8 bits are taken off."""
    return ((others == sig).mean(1) - 1 / 256) * (256 / 255)


def floor_at(similarity: np.ndarray | float, n_hashes: int = TREES * DEPTH) -> np.ndarray | float:
    """The least estimate that texts of this similarity may have."""
    similarity = np.maximum(similarity, 0.0)
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / n_hashes)


def found_root(root: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The root of each item's component; ``root`` then leads there at once."""
    at = root[items]
    while (up := root[at]).tolist() != at.tolist():
        at = up
    root[items] = at
    return at


def joined(root: np.ndarray, first: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Joins the components of ``others`` to that of ``first``; one link to each that was apart."""
    if not len(others):
        return []
    own = int(found_root(root, np.array([first]))[0])
    apart, at = np.unique(found_root(root, others), return_index=True)
    new = apart != own
    root[apart[new]] = own
    return [(first, x) for x in others[at[new]].tolist()]


def lead(rows: np.ndarray, bits: np.ndarray, radius: np.ndarray, threshold: float, links: list[tuple[int, int]], root: np.ndarray) -> np.ndarray:
    """The leaders among a node's ``rows``; ``links`` gets what joins each of them to its candidates.

    ``root`` holds the components so far; only what joins two of them is a link, so there are fewer links than texts.

    A text within NEAR of a leader, all that it leads included, follows it and is compared no further.
    ``radius`` is the estimated distance of a leader's farthest follower: leaders are joined if texts
    that they lead could be within the threshold.  So a node of near copies costs one pass, and one
    of unlike texts all pairs of 128 bytes.
    """
    leaders = []
    while len(rows):
        first, rows = rows[0], rows[1:]
        est = estimate(bits[first], bits[rows])
        reach = 1 - est + radius[rows]
        near = reach <= 1 - NEAR
        if near.any():
            radius[first] = max(radius[first], float(reach[near].max()))
        around = radius[first] + radius[rows]
        low = floor_at(threshold - around - np.where(around > 0, SPARE, 0.0))
        links += joined(root, int(first), rows[near | (est >= low)])
        leaders.append(first)
        rows = rows[~near]
    return np.array(leaders, np.int64)


def spanning(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Fewer links that connect the same of ``n`` items: each to the least one of its component."""
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            return [(i, int(root[i])) for i in np.flatnonzero(root != np.arange(n)).tolist()]
        root = now


def climb(paths: np.ndarray, bits: np.ndarray, length: int, threshold: float = THRESHOLD, radius: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Candidate links of a trie's sorted paths: nodes of full depth first, then of ever shorter prefixes down to ``length``, which only leaders reach.

    Returns links (row pairs), the rows that lead at the end, and the radius of every row.
    """
    alive, radius = np.arange(len(paths)), np.zeros(len(paths)) if radius is None else radius
    root = np.arange(len(paths))
    links: list[tuple[int, int]] = []
    for depth in range(paths.shape[1], length - 1, -1):
        cuts = np.flatnonzero((paths[alive[1:], :depth] != paths[alive[:-1], :depth]).any(1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(alive)]])
        several = np.flatnonzero(ends - starts > 1)
        stay = np.ones(len(alive), bool)
        for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            stay[a:b] = np.isin(alive[a:b], lead(alive[a:b], bits, radius, threshold, links, root))
        alive = alive[stay]
    return links, alive, radius


def class_links(sets: list[np.ndarray], weights: np.ndarray, threshold: float, left: int | None = None):
    """Exact links among sets (with ``left``: between the first ``left`` and the others only).

    Returns the weight of each set's partners and the linked index pairs that span the same components.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    where, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count[inverse] > 1
    column, owner = (np.cumsum(count > 1) - 1)[inverse[shared]], owner[shared]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(n_columns, (1 << 22) // max(1, n)))
    for start in range(0, n_columns, width):
        a, b = np.searchsorted(column, [start, start + width])
        cells = np.zeros((n, width), np.float32)
        cells[owner[a:b], column[a:b] - start] = 1
        common += cells @ cells.T
    union = sizes[:, None] + sizes[None] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if left is not None:
        linked[:left, :left] = linked[left:, left:] = False
    root = np.arange(n)
    while True:  # every text takes the least root around it until nothing changes
        around = np.minimum(np.where(linked, root, n).min(1, initial=n), root)
        around = np.minimum(around, around[around])
        if (around == root).all():
            break
        root = around
    return linked @ weights, [(i, int(r)) for i, r in enumerate(root)]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held or (a == 0 and change[0] and held):
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, h1, h2, n, sig)``: 128 bits that stand for the whole shingle set, and the signature; texts without words have nulls."""
    source = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", TEXT_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            full = [s for s in sets if len(s)]
            sig = iter([row.tobytes() for row in signatures(full).astype(">u4")]) if full else iter(())
            digest = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([next(sig) if len(s) else None for s in sets], pa.binary())], names=["id", "h1", "h2", "n", "sig"])

    return source.mapInArrow(run, "id long, h1 long, h2 long, n long, sig binary")


def representatives(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(h1, h2, rep, copies)`` of each set, by its smallest id, and the signatures ``(id, sig)`` of these."""
    reps = staged(prints.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")), "reps")
    own = prints.join(reps.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    return reps, staged(own.select("id", "sig"), "signatures")


def measured_depths(own: DataFrame, threshold: float, sample: int = SAMPLE) -> dict[int, int]:
    """How many pairs of a bounded sample of texts with any text within the threshold (by whole signatures) meet at which greatest depth."""
    asked = [(r.id, bytes(r.sig)) for r in own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    shared = own.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(DEPTH + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, full = batch.column("id").to_numpy(), _signature_rows(batch.column("sig"))
                low = np.ascontiguousarray(full.astype(np.uint8))
                for key, sig in shared.value:
                    mine = np.frombuffer(sig, ">u4")
                    like = np.flatnonzero((estimate(mine.astype(np.uint8), low) >= threshold) & (ids != key))
                    met += np.bincount(meeting_depths(mine, full[like]), minlength=DEPTH + 1) if len(like) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH + 1), pa.int32()), pa.array(met, pa.int64())], names=["depth", "n"])

    return {r.depth: r.n for r in own.mapInArrow(count, "depth int, n long").groupBy("depth").agg(F.sum("n").alias("n")).collect()}


def sorted_tries(own: DataFrame, length: int) -> DataFrame:
    """``(tree, path, id)`` of the texts that share ``length`` hashes of a tree's path with a neighbour, and those at the ends of sorted ranges.

    All paths are sorted by range: a node of any size is a run of rows, over as many ranges as it needs.
    """
    paths = own.select("id", F.posexplode(F.array(*(F.substring(F.col("sig"), t * 4 * DEPTH + 1, 4 * DEPTH) for t in range(TREES)))).alias("tree", "path"))
    ranged = paths.repartitionByRange(max(2, shuffle_partitions(own.sparkSession)), "tree", "path", "id").sortWithinPartitions("tree", "path", "id")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, and whether it stays
        stays = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
            path, tree = _path_rows(rows.column("path")), rows.column("tree").to_numpy()
            same = (path[1:, :length] == path[:-1, :length]).all(1) & (tree[1:] == tree[:-1])
            keep = np.zeros(len(tree), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= stays
            held, stays = rows.slice(len(tree) - 1), bool(keep[-1])
            yield rows.slice(0, len(tree) - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    return ranged.select("tree", "path", "id").mapInArrow(beside, "tree int, path binary, id long")


def proposed_links(tries: DataFrame, own: DataFrame, length: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate links ``(a, b)`` of all tries, and the staged tables behind them.

    Each range of sorted paths climbs on its own; the leaders of its first and last node, which other
    ranges may share, meet once more by node: few rows, however large the node of near copies.
    """
    spark = own.sparkSession
    # eight bits of each hash are enough for estimates
    short = own.select(F.col("id").alias("s_id"), "sig").mapInArrow(_short, "s_id long, bits binary")
    placed = staged(tries.join(short, F.col("id") == F.col("s_id")).select("tree", "path", "id", "bits"), "tries")
    ranged = placed.repartitionByRange(max(2, shuffle_partitions(spark)), "tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    schema = "a long, b long, node binary, radius double, bits binary"

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node of ``length``; the first and the last run of the range also give their leaders."""
        first = True
        for group, last in _with_last(_groups(_keyed(batches, length), ["key"])):
            ids, bits = group["id"].to_numpy(), _bit_rows(group["bits"])
            links, leaders, radius = climb(_path_rows(group["path"]), bits, length, threshold)
            if links:
                yield _links_batch([(ids[i], ids[j]) for i, j in spanning(len(ids), links)])
            if first or last:
                yield _leaders_batch(group["key"][0].as_py(), ids[leaders], radius[leaders], bits[leaders])
            first = False

    met = staged(ranged.mapInArrow(nodes, schema), "met")
    again = met.where("node IS NOT NULL").select(F.col("node").alias("key"), F.col("a").alias("id"), "radius", "bits").repartition("key").sortWithinPartitions("key", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key"]):
            ids, links = group["id"].to_numpy(), []
            lead(np.arange(len(ids)), _bit_rows(group["bits"]), group["radius"].to_numpy().copy(), threshold, links, np.arange(len(ids)))
            if links:
                yield _links_batch([(ids[i], ids[j]) for i, j in spanning(len(ids), links)])

    links = met.where("node IS NULL").select("a", "b").unionByName(again.mapInArrow(meet, schema).select("a", "b"))
    return links, [placed, met]


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, fingerprint: bool = False) -> DataFrame:
    """The similarity join of the texts with themselves: ``(<id_col>, class_id, copy_of, n_links)``, a row per document.

    Texts are linked if the Jaccard similarity of their sets of ``size``-word shingles (runs of letters
    and digits, case folded) is ``threshold`` or more.  ``class_id`` is the smallest id of the texts
    connected by links, ``copy_of`` the smallest id with the very same set, ``n_links`` the number of
    other ids linked directly, copies included.  With ``fingerprint``, ``h1`` and ``h2`` stand for the set.

    1. One pass over the texts writes a set fingerprint and a signature a document.
    2. Copies (equal sets) collapse, pre-aggregated, to their smallest id and a count.
    3. Each representative has a path of ``DEPTH`` hashes in each of ``TREES`` tries, which are sorted.
       Matched prefixes are shortened from full depth, node by node, until the length at which
       ``RECALL`` of the pairs at the threshold meet (``prefix_length``), and on until the pairs of a
       bounded sample, found by whole signatures, meet as often (``measured_depths``).  Near copies
       leave a node through their leader, so only leaders reach shorter prefixes and a node gives
       about as many links as it has texts.
    4. Components of the candidate links are the units of verification: only their texts are read
       again.  Exact similarities are counted block by block inside the function, never emitted.
    5. Components of the verified links are the classes.

    Every link is verified exactly (up to collisions of 64-bit hashes); links are lost only where
    no trie brings a pair together (under 1 - RECALL at the threshold, and fast less above).

    A text of fewer than ``size`` words is one shingle; texts without words, null ones too, are
    linked to nothing.  Rows that repeat an id are documents of their own, each with a row in the
    result.  Null ids are left out.  An empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs, id_col, text_col, size), "prints")
    reps, own = representatives(prints)
    length = shortened(prefix_length(threshold), measured_depths(own, threshold))
    tries = staged(sorted_tries(own, length), "neighbours")
    candidates, behind = proposed_links(tries, own, length, threshold)
    units = staged(components(candidates), "units")
    discard(own, tries, *behind)

    found = staged(verified(docs, units, reps, id_col, text_col, threshold, size), "links")
    discard(units)
    per_rep = found.groupBy(F.col("a").alias("l_id")).agg(F.sum("links").alias("links"))
    linked = components(found.select("a", "b"))
    of_rep = reps.join(per_rep, F.col("rep") == F.col("l_id"), "left").join(linked, F.col("rep") == F.col("node"), "left") \
        .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return prints.join(of_rep, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_of"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        *(["h1", "h2"] if fingerprint else []))


def verified(docs: DataFrame, units: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, size: int) -> DataFrame:
    """``(a, b, links)``: exact links inside each candidate unit, per block of texts: how many ids ``a`` is linked to, and a text ``b`` connected to it."""
    weights = reps.select(F.col("rep").alias("w_id"), "copies", F.col("h1").alias("w1"), F.col("h2").alias("w2"), "n")
    sized = units.join(weights, F.col("node") == F.col("w_id"))
    blocks = sized.groupBy(F.col("root").alias("u")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("texts"))
    inside = staged(sized.join(blocks, F.col("root") == F.col("u")).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
                    .select("node", "root", "blocks", "block", "copies", "w1", "w2", "texts"), "blocks")
    pairs = inside.agg(F.sum(F.least("texts", F.lit(2 * BLOCK)) * F.col("blocks"))).first()[0] or 0
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(few(inside.drop("texts")), F.col("id") == F.col("node"))
    # every pair of blocks of a class meets once; as many tasks as the pairs ask for, bytes say nothing about them
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = max(shuffle_partitions(docs.sparkSession), pairs // TASK_PAIRS)
    met_blocks = texts.select("id", "text", "root", "block", "copies", "w1", "w2", other).select(
        "id", "text", "root", "copies", "w1", "w2", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block") \
        .repartition(tasks, "root", "first", "second").sortWithinPartitions("root", "first", "second", "block", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in _groups(byte_batches(batches, "text", TEXT_BYTES), ["root", "first", "second"]):
            first, second = group["first"][0].as_py(), group["second"][0].as_py()
            # by id and fingerprint: rows that repeat an id with another text are passed over
            chosen = {}
            for i, block, copies, w1, w2, s in zip(*(group[c].to_pylist() for c in ("id", "block", "copies", "w1", "w2")), _sets(group["text"], size), strict=True):
                if _digest(s) == [w1, w2]:
                    chosen[block, i, w1, w2] = copies, s
            keys = sorted(chosen)
            left = None if first == second else sum(k[0] == first for k in keys)
            if len(keys) < 2:
                continue
            links, star = class_links([chosen[k][1] for k in keys], np.array([chosen[k][0] for k in keys], np.int64), threshold, left)
            out += [(keys[i][1], keys[j][1], int(links[i])) for i, j in star]
            if len(out) > 10_000:
                yield _found_batch(out)
                out = []
        yield _found_batch(out)

    return met_blocks.mapInArrow(verify, "a long, b long, links long")


def _digest(s: np.ndarray) -> list[int | None]:
    """128 bits that stand for a sorted set."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8").tolist() if len(s) else [None, None]


def _sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in texts.chunks:  # of bounded bytes each
        out += shingle_sets(chunk.to_pylist(), size)
    return out


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, 3::4]
            yield pa.RecordBatch.from_arrays([batch.column("s_id"), pa.array([r.tobytes() for r in sig], pa.binary())], names=["s_id", "bits"])


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), -1)


def _path_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _signature_rows(column)


def _bit_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """With ``key``: the tree and the first ``length`` hashes of the path, big-endian, so that keys sort as paths do."""
    for batch in batches:
        keys = [bytes([t]) + p[:4 * length] for t, p in zip(batch.column("tree").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield batch.append_column("key", pa.array(keys, pa.binary()))


def _with_last(groups: Iterator[pa.Table]) -> Iterator[tuple[pa.Table, bool]]:
    held = None
    for group in groups:
        if held is not None:
            yield held, False
        held = group
    if held is not None:
        yield held, True


def _links_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, pa.nulls(len(a), pa.float64()), none], names=["a", "b", "node", "radius", "bits"])


def _leaders_batch(node: bytes, ids: np.ndarray, radius: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    own = pa.array(ids, pa.int64())
    return pa.RecordBatch.from_arrays([own, own, pa.array([node] * len(ids), pa.binary()), pa.array(radius, pa.float64()), pa.array([r.tobytes() for r in bits], pa.binary())], names=["a", "b", "node", "radius", "bits"])


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, links = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])
