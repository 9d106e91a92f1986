"""SimHash near-duplicates with the generalised pigeonhole principle.

A fingerprint has 64 bits (or several words of 64) from the hashes of a text's word shingles. Documents link where their
fingerprints differ in at most `distance` bits. Links are found between distinct fingerprints only:

1. The 64 bits of a probed word are cut into partitions of 16; bits that correlate, on a bounded sample, go to the same partition.
2. Each partition gets a threshold of its own. If the thresholds plus one add up to the probe distance plus one, two
   fingerprints within that distance are within the threshold in one partition at least. Dynamic programming picks the
   thresholds of least cost, from the candidate counts that the partitions' exact value histograms (65,536 counts each,
   whatever the input) give for every threshold; a partition with a hot value gets none.
3. A fingerprint goes to the buckets of all values within half the threshold of its own, where any two meet that are within
   the threshold. Buckets that the histogram shows to be large are cut into blocks, every pair of which meets in a bucket.
4. Sorted buckets stream through the tasks, which verify the pairs and keep one link only where two groups join, so a
   bucket's rows never become its pairs. A task contracts the links of all its buckets before it passes them on: a node that
   it has met in many buckets has one link. Connected components close the links. Buckets of own values go first where there
   are others, and what they join is known to the rest, so that a group that meets in every task isn't linked in each.

With 64 bits the probed word is the whole fingerprint and no link is lost. With more words, the first `probes` words are
probed, each on its own: a link is found if one of them differs in `probe_distance` bits or fewer. With `any_part` all that
meet in a bucket are compared over the whole fingerprint, so pairs whose words all differ in more bits are found as well
where one partition is within its threshold.

one_of_each() uses the links as candidates only. Their components, in which every pair of similar texts lies, are gone
through with the texts' exact sets of shingles, and only texts whose sets are similar enough are linked. Texts with equal
sets count once; components of many texts are cut into blocks, every pair of which meets unless links found before join all.

Defined cases: a null or empty text has fingerprint zero and links like any other; a null id keeps its row, and a component
all of whose ids are null has a null component_id; repeated rows each get their result; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.llm.common import MAX_BROADCAST_KEYS, durable, free_name, release, row_key, without_keys
from verdictlake.llm.graph import components, contract, gathered, with_groups

#: Partitions of a word, and their bits.
PARTS, WIDTH = 4, 16
SAMPLE = 20_000
#: Members of a bucket from which it is cut into blocks.
BLOCK = 4096
#: Texts of a component, and shingles of them all, from which it is cut into blocks.
TEXTS, SHINGLES = 1024, 4_000_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of hashes from the first (a 64-bit finaliser over shifted inputs)."""
    if k == 0:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles in order; a text of fewer words has one, a text without words none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(itertools.islice(tokens, i, None) for i in range(shingle)), strict=False)) if len(tokens) >= shingle else iter([b" ".join(tokens)])
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def _print(hashes: np.ndarray, words: int) -> bytes:
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.stack([_mixed(hashes[at : at + CHUNK], k) for k in range(words)], 1).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * words), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprint(text: str | None, shingle: int, words: int) -> bytes:
    """Big-endian fingerprint: a bit is set if over half of the shingles' hashes have it."""
    return _print(shingle_hashes(text, shingle), words)


def fingerprints(df: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint in bytes."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py(), shingle, words) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("fp", T.BinaryType())]))


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(x.as_py() for x in column), ">u8").reshape(-1, words).astype(np.uint64)


def correlated_bits(sample: np.ndarray) -> list[list[int]]:
    """The 64 bits in PARTS groups of WIDTH; each group starts with the lowest free bit and takes what correlates most with it."""
    if not len(sample):
        return [list(range(p * WIDTH, (p + 1) * WIDTH)) for p in range(PARTS)]
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits.std(0)
    safe = np.where(spread > 0, spread, 1.0)
    z = (bits - bits.mean(0)) / safe
    related = np.abs(z.T @ z) / max(1, len(bits))
    free, groups = set(range(64)), []
    while free:
        group = [min(free)]
        free.remove(group[0])
        while len(group) < WIDTH:
            best = max(sorted(free), key=lambda b: related[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def _values(prints: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Each partition's value of each fingerprint: (n, partitions), PARTS for each probed word."""
    out = np.zeros((len(prints), len(groups)), np.int64)
    for p, group in enumerate(groups):
        for k, bit in enumerate(group):
            out[:, p] |= ((prints[:, p // PARTS] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def within(histogram: np.ndarray, radius: int) -> np.ndarray:
    """For radius 0, 1, ...: how many members are within it of each value; (partitions, radius + 1, 65536)."""
    at = np.zeros((len(histogram), radius + 1, histogram.shape[1]), np.int64)
    at[:, 0] = histogram
    values = np.arange(histogram.shape[1])
    for bit in range(WIDTH):
        at[:, 1:] = at[:, 1:] + at[:, :-1][:, :, values ^ (1 << bit)]
    return at.cumsum(1)


#: Thresholds that differ in cost: half of them is the radius of buckets.
THRESHOLDS = (-1, 0, 2, 4, 6)


def allocate(histogram: np.ndarray, distance: int) -> list[int]:
    """Thresholds of the partitions, of least cost by dynamic programming; a row for a bucket costs as much as 200 pairs."""
    total = int(histogram[0].sum())
    balls = np.cumsum([1.0, 16, 120, 560])
    cost = []
    for own in histogram:  # one partition at a time, as the counts of all take much memory
        near = within(own[None], max(THRESHOLDS))[0]
        cost.append([0.0 if t < 0 else float((own.astype(float) * near[t]).sum()) / 2 + 200.0 * total * balls[t // 2] for t in THRESHOLDS])
    need = distance + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for p in range(len(histogram)):
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (c, chosen) in best.items():
            for t, more in zip(THRESHOLDS, cost[p], strict=True):
                key = min(need, had + t + 1)
                if key not in step or c + more < step[key][0]:
                    step[key] = (c + more, [*chosen, t])
        best = step
    return best[need][1]


def joined_before(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each member's first fellow of its bucket (positions) that is known to be linked with it; known names what it is linked with, negative if nothing."""
    parent, at = np.arange(len(keys)), np.flatnonzero(known >= 0)
    if len(at):
        at = at[np.lexsort((at, known[at], keys[at]))]
        new = np.r_[True, (keys[at][1:] != keys[at][:-1]) | (known[at][1:] != known[at][:-1])]
        parent[at] = at[new][np.cumsum(new) - 1]
    return parent


def forest(keys: np.ndarray, prints: np.ndarray, distance: int, probe: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) from the first of each group of a bucket's members that pairs within the distance join to its others; keys are sorted.

    Members of a bucket are first compared in the word that it was probed by, unless `probe` allows all of its bits to differ.
    Those known to be linked are one member: no link joins them again.
    """
    n, first = len(keys), prints[np.arange(len(keys)), keys >> (40 + WIDTH) >> 2]
    before = np.arange(n) if known is None else joined_before(keys, known)
    parent = before.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    alive = np.arange(n)
    for d in range(1, n):
        alive = alive[alive + d < n]
        alive = alive[keys[alive] == keys[alive + d]]
        if not len(alive):
            break
        i = alive if probe >= 64 else alive[np.bitwise_count(first[alive] ^ first[alive + d]) <= probe]
        i = i[parent[i] != parent[i + d]]
        if probe >= 64 and prints.shape[1] > 2:  # two words first, which lose nothing
            i = i[np.bitwise_count(prints[i, 0] ^ prints[i + d, 0]) + np.bitwise_count(prints[i, 1] ^ prints[i + d, 1]) <= distance]
        linked = i[np.bitwise_count(prints[i] ^ prints[i + d]).sum(1, dtype=np.int64) <= distance] if prints.shape[1] > 1 else i
        for a in linked.tolist():
            x, y = find(a), find(a + d)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(linked):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    right = np.flatnonzero((parent != np.arange(n)) & (before == np.arange(n)))
    return parent[right], right


def links(nodes: DataFrame, distance: int, words: int = 1, probe_distance: int | None = None, probes: int = 1, any_part: bool = False) -> DataFrame:
    """From distinct fingerprints (fp): links u, v that leave the components of all links within the distance as they are.

    Where buckets have a radius, those of the fingerprints' own values come first, a few for each; what they join is known in all
    the others. A large group of near copies meets in most buckets of most tasks, and would be linked in each of them again.
    """
    probe, parts = distance if probe_distance is None else probe_distance, PARTS * probes
    sample = _words(nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow().column(0), words)
    groups = [g for w in range(probes) for g in correlated_bits(sample[:, w])]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_values(_words(batch.column(0), words), groups) + np.arange(parts) * (1 << WIDTH), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    counts = nodes.select("fp").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(parts << WIDTH, np.int64)
    histogram[counts.column("k").to_numpy()] = counts.column("n").to_numpy()
    histogram = histogram.reshape(parts, 1 << WIDTH)
    thresholds = [t for w in range(probes) for t in allocate(histogram[w * PARTS : (w + 1) * PARTS], probe)]
    #: how many blocks each bucket has
    blocks = [(-(-within(histogram[p : p + 1], max(0, t) // 2)[0, -1] // BLOCK)).clip(1) for p, t in enumerate(thresholds)]
    flips = [np.array([sum(1 << b for b in c) for r in range(t // 2 + 1) for c in itertools.combinations(range(WIDTH), r)], np.int64) if t >= 0 else np.array([], np.int64) for t in thresholds]
    cut = nodes.sparkSession.sparkContext.broadcast((groups, flips, {p: {int(v): int(blocks[p][v]) for v in np.flatnonzero(blocks[p] > 1)} for p in range(parts)}))

    def dealt(batches: Iterator[pa.RecordBatch], radius: bool) -> Iterator[pa.RecordBatch]:
        groups, flips, large = cut.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                prints = _words(batch.column(0), words)
                values = _values(prints, groups)
                own = (prints[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
                rows, keys = [], []
                for p, masks in enumerate(flips if radius else [m[:1] for m in flips]):
                    if not len(masks):
                        continue
                    bucket = (values[:, p, None] ^ masks).ravel()
                    row = np.repeat(np.arange(len(prints)), len(masks))
                    hot = np.isin(bucket, list(large[p])) if large[p] else np.zeros(len(bucket), bool)
                    rows.append(row[~hot])
                    keys.append((bucket[~hot] + (p << WIDTH)) << 40)
                    for b, r in zip(bucket[hot].tolist(), row[hot].tolist(), strict=True):
                        n = large[p][b]
                        mine = int(own[r]) % n
                        rows.append(np.full(n, r))
                        keys.append((((b + (p << WIDTH)) << 40) | np.minimum(mine, np.arange(n)) << 20 | np.maximum(mine, np.arange(n))).astype(np.int64))
                if rows:
                    taken = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(taken), batch.column(1).take(taken)], ["bucket", "fp", "root"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last bucket so far, which the next batch may go on with
        for batch in itertools.chain(batches, [None]):
            if batch is None and rest is None:
                return
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks()
            keys = table.column(0).to_numpy()
            whole = len(keys) if batch is None or not len(keys) else int(np.searchsorted(keys, keys[-1]))
            rest = table.slice(whole).to_batches()[0] if whole < len(keys) else None
            if whole:
                fp, root = (table.column(k).slice(0, whole).combine_chunks() for k in (1, 2))
                fp, root = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (fp, root))
                known = root.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if root.null_count < whole else None
                a, b = forest(keys[:whole], _words(fp, words), distance, 64 if any_part else probe, known)
                if len(a):
                    names = pc.coalesce(root, fp)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["u", "v"])

    def met(rows: DataFrame, radius: bool) -> DataFrame:
        buckets = rows.mapInArrow(lambda batches: dealt(batches, radius), "bucket long, fp binary, root binary").repartition("bucket").sortWithinPartitions("bucket")
        return buckets.mapInArrow(lambda batches: contract(joined(batches)), "u binary, v binary")

    rows = nodes.select("fp", F.lit(None).cast("binary").alias("root"))
    if max(map(len, flips)) <= 1:
        return met(rows, True)
    # kept first: where links come out of Python, a task that contracts them at once would hold two workers
    kept = durable(gathered(durable(met(rows, False))))
    # a node's smallest neighbour, in place of its component: what is kept tells the rest
    known = kept.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v")))).groupBy(F.col("u").alias("fp")).agg(F.min("v").alias("root"))
    placed = nodes.select("fp").join(known, "fp", "left").select("fp", "root")
    return kept.unionByName(met(placed, True))


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 3, words: int = 1, probe_distance: int | None = None, probes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest id that links reach, a document's own included."""
    prints = durable(fingerprints(df, shingle, words, id_col, text_col))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = durable(components(links(nodes, distance, words, probe_distance, probes)))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    linked = with_groups(linked, "root", roots.count(), F.col("fp"), lowest=F.min("first_id")).select("fp", "lowest")
    # kept, so that both sides of the last join are plain shuffles, which Spark splits where many copies share a fingerprint
    by_print = durable(nodes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first_id").alias("component_id")))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, **settings) -> DataFrame:
    """The documents whose id is their component's; rows that share a kept document's id all stay, and so do rows without an id whose component has none."""
    found = near_duplicates(df, **settings)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct()
    return df.join(gone, df["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def similar(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets of which every two neighbours share `percent` of their union or more; exact. Two empty sets are equal.

    Walks from set to set; each is held against those not reached yet, all at once.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1].astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(flat) + 1, np.int8)
    left, out, held = np.arange(len(sets)), [], len(sets)
    tokens, owner = flat, np.repeat(np.arange(len(sets)), sizes)
    reached: list[int] = []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        i = reached.pop()
        if len(left) * 2 < held:
            stay = np.isin(owner, left)
            tokens, owner, held = tokens[stay], owner[stay], len(left)
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        shared = np.bincount(owner[mark[tokens] > 0], minlength=len(sets))[left]
        mark[own] = 0
        near = 100 * shared >= percent * (sizes[i] + sizes[left] - shared)
        found = left[near].tolist()
        out += [(i, j) for j in found]
        reached += found
        left = left[~near]
    return out


def _compared(texts: DataFrame, shingle: int, percent: int, crosswise: bool) -> DataFrame:
    """From root, blocks, sid, text of distinct sets: links u, v (of sids) between texts of a root that are similar enough.

    A root's texts are dealt to blocks by their sid; crosswise every two blocks of a root meet, else each is gone through alone.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20):
                rows = []
                for root, n, sid, text in zip(*(c.to_pylist() for c in whole.slice(at, 20).columns), strict=True):
                    own, shingles = int.from_bytes(sid[:8], "big") % n, np.unique(shingle_hashes(text, shingle)).tobytes()
                    rows += [(root, min(own, k) << 32 | max(own, k), sid, shingles) for k in (range(n) if crosswise else (own,))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["root", "pair", "sid", "shingles"])
        release()

    def joined(group: pa.Table) -> pa.Table:
        sids = group.column("sid").to_pylist()
        found = similar([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], percent)
        return pa.table({"u": pa.array([sids[a] for a, _ in found], pa.binary()), "v": pa.array([sids[b] for _, b in found], pa.binary())})

    return texts.select("root", "blocks", "sid", "text").mapInArrow(dealt, "root binary, pair long, sid binary, shingles binary").groupBy("root", "pair").applyInArrow(joined, "u binary, v binary")


def _several(sets: DataFrame) -> DataFrame:
    """Of sets (root, sid, row_key, size) those whose root has several, with the number of blocks that TEXTS and SHINGLES call for."""
    several = with_groups(sets, "root", sets.count(), F.col("sid"), n=F.count(F.lit(1)), shingles=F.sum("size")).filter(F.col("n") > 1)
    return several.withColumn("blocks", F.ceil(F.greatest(F.col("n") / TEXTS, F.col("shingles") / SHINGLES)).cast("int")).drop("n", "shingles")


def _classes(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """The sets with their class: the smallest sid that links reach."""
    return sets.join(components(linked).withColumnRenamed("node", "sid").withColumnRenamed("root", "to"), "sid", "left").withColumn("class", F.coalesce("to", "sid")).drop("to")


def verified(sets: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links u, v whose components are those of all similar pairs of a root. Sets are rows of root, sid, row_key, size.

    Roots of one block are gone through at once. In larger ones each block is gone through alone, then the first of each class
    found, and crosswise only those roots that still have several classes: copies of one text, however many, are read twice.
    """

    def texts(of: DataFrame) -> DataFrame:
        # texts stay where they are unless they are wanted; copies of one row have one key, and their set goes on once
        wanted = durable(of.select("row_key", "root", "blocks", "sid"))
        small = F.broadcast if wanted.count() <= MAX_BROADCAST_KEYS else (lambda x: x)
        return source.select("row_key", "text").join(small(wanted), "row_key").dropDuplicates(["root", "sid"])

    several = durable(_several(sets))
    linked = durable(_compared(texts(several), shingle, percent, False))
    large = several.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return linked
    large = durable(_classes(large.drop("blocks"), linked))
    first = durable(_several(large.filter(F.col("sid") == F.col("class")).drop("class")))
    linked = durable(linked.unionByName(_compared(texts(first), shingle, percent, True)))
    large = durable(_classes(large.drop("class"), linked))
    left = large.groupBy("root").agg(F.count_distinct("class").alias("n")).filter(F.col("n") > 1).select("root")
    left = durable(_several(large.drop("class").join(left, "root", "left_semi")))
    return linked.unionByName(_compared(texts(left), shingle, percent, True))


def one_of_each(df: DataFrame, shingle: int, percent: int, words: int, distance: int, probe_distance: int, probes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, that of the smallest id, of each group that similar texts link; `percent` is the least similarity of shingle sets.

    Works on rows: whether a row stays doesn't depend on other rows of the same id, or without one. Ids sort before null, rows of
    one id by their key.
    """
    release()  # what the stages before have learned is gone by now
    name = free_name(df, "row_key")
    keyed = df.withColumn(name, row_key(df))
    source = keyed.select(F.col(name).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sids, fps, sizes = [], [], []
            for t in b.column(2):  # one text's hashes at a time
                hashes = shingle_hashes(t.as_py(), shingle)
                own = np.unique(hashes)
                sids.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                fps.append(_print(hashes, words))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sids, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["row_key", "doc_id", "sid", "fp", "size"])
        release()

    kinds = [T.StructField("row_key", T.StringType()), source.schema["doc_id"], T.StructField("sid", T.BinaryType()), T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType())]
    prints = durable(source.mapInArrow(printed, T.StructType(kinds)))
    # a fingerprint follows from counts of shingles, so that equal sets can have several
    sets = durable(prints.groupBy("sid", "fp").agg(F.min("row_key").alias("row_key"), F.min("size").alias("size")))
    roots = durable(components(links(sets.select("fp").distinct(), distance, words, probe_distance, probes, any_part=True)))
    placed = durable(sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"), "sid").agg(F.min("row_key").alias("row_key"), F.min("size").alias("size")))
    linked = durable(components(verified(placed, source, shingle, percent)))
    grouped = durable(prints.select("row_key", "doc_id", "sid").join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("row_key", "doc_id", F.coalesce("root", "sid").alias("of")))
    first = with_groups(grouped, "of", grouped.count(), F.col("row_key"), first=F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")))
    gone = durable(first.filter(F.col("row_key") != F.col("first.row_key")).select("row_key").distinct())
    copies = durable(grouped.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("row_key").join(gone, "row_key", "left_anti"))
    stay = without_keys(keyed, gone.unionByName(copies), name)
    if not copies.isEmpty():
        few = F.broadcast(copies.toDF(name)) if copies.count() <= MAX_BROADCAST_KEYS else copies.toDF(name)
        stay = stay.unionByName(keyed.join(few, name, "left_semi").dropDuplicates([name]))
    return stay.select(*df.columns)
