"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes the set of its runs of five words; texts with equal sets are copies of one *node*, so that the
   copies of a text never meet one another.
2. A node's MinHash signature is cut into bands; band and row counts are the cheapest ones whose recall at the
   threshold reaches the target. A shuffle on band hashes finds buckets; each member is tied to its bucket's smallest
   node, not to all others, and the components of these ties are the candidate groups.
3. A group's pairs are verified in the way that repeats its rows less often: as one unit, or bucket by bucket, where a
   pair belongs to the first bucket that both are in. So weak ties that chain many texts together cost no more than their
   buckets. A unit is cut into blocks of bounded rows and bytes, and pairs of blocks are dealt out as tasks. A task counts
   common runs of all its pairs by matrix products over the full sets and hands on a number of links for each node and
   one tie for each linked node - never the pairs. A pair of nodes is counted in exactly one task.
4. Components of the verified ties are the classes.

Defined cases: words are runs of digits, letters A-Z in either case, and characters beyond ASCII. A text of fewer than
five words is one run of all of them. Equal texts without words are copies of each other and have no other link. A null
text has a class of its own and no link. A repeated row is a copy. A row with a null doc_id is joined like any other; a
class of such rows alone has a null class_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise, passes, small_batches, text_buffers
from heliograph.llm.words import Words, mix, shingles
from heliograph.operators.graph import components

RUN_WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Nodes and bytes of their sets in a block, on average at most: a task holds two blocks.
BLOCK, BLOCK_BYTES = 128, 4_000_000


@functools.cache
def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, for the target recall at the threshold, need ``most`` hashes at most."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _signature(codes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each text's set of codes; texts without codes get zeros."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if not len(filled):
        return out
    starts = offsets[:-1][filled]
    # fixed values: odd multipliers and shifts from a seeded generator
    rng = np.random.default_rng(20240501)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = (codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32)
    for b in range(bands):
        total = np.full(len(filled), b + 1, np.uint64)
        for r in range(rows):
            k = odd[b * rows + r]
            value = low * np.uint32(k >> np.uint64(32) | np.uint64(1)) + np.uint32(k & np.uint64(0xFFFFFFFF))
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, starts).astype(np.uint64))
        out[filled, b] = total
    return out


def _sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different run codes of each text, end to end, and offsets."""
    codes, cuts = shingles(Words(raw, offsets), size)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[keep], np.searchsorted(owner[keep], np.arange(len(cuts)))


def _node(codes: np.ndarray, text: bytes) -> bytes:
    return hashlib.blake2b(codes.tobytes() if len(codes) else b"text" + text, digest_size=16, person=b"runs" if len(codes) else b"text").digest()


def _sketch(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            raw, offsets = text_buffers(texts)
            missing = texts.is_null().to_pylist()
            for lo, hi in passes(offsets):
                part, places = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                codes, cuts = _sets(part, places, size)
                marks = _signature(codes, cuts, bands, rows)
                whole = part.tobytes()
                nodes = [None if missing[lo + i] else _node(codes[cuts[i] : cuts[i + 1]], whole[places[i] : places[i + 1]]) for i in range(hi - lo)]
                signed = [m.astype("<u8").tobytes() if cuts[i + 1] > cuts[i] else None for i, m in enumerate(marks)]
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.binary()), pa.array(signed, pa.binary()), pa.array(np.diff(cuts), pa.int64())], ["doc_id", "text_key", "node", "marks", "runs"])

    return run


def _candidate_sets(size: int):
    def run(batches):
        done: set[bytes] = set()  # repeated rows of one text come to one task
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            wanted = batch.column("node").to_pylist()
            for lo, hi in passes(offsets):
                part, places = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                codes, cuts = _sets(part, places, size)
                whole = part.tobytes()
                same = []
                for i in range(hi - lo):
                    node = wanted[lo + i]
                    if node not in done and node == _node(codes[cuts[i] : cuts[i + 1]], whole[places[i] : places[i + 1]]):
                        done.add(node)
                        same.append(i)
                at = pa.array([lo + i for i in same], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "root", "copies", "marks")), pa.array([codes[cuts[i] : cuts[i + 1]].astype("<u8").tobytes() for i in same], pa.binary())], ["node", "root", "copies", "marks", "codes"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common codes of every left and right set, by products of 0/1 matrices over codes that both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return total

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ok = common[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], owner[ok][order]

    (col_a, row_a), (col_b, row_b) = cells(left, a), cells(right, b)
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        part = []
        for sets, col, row in ((left, col_a, row_a), (right, col_b, row_b)):
            x, y = np.searchsorted(col, [lo, lo + width])
            m = np.zeros((len(sets), width), np.float32)
            m[row[x:y], col[x:y] - lo] = 1
            part.append(m)
        total += part[0] @ part[1].T
    return total


def _earlier(left: list[tuple], right: list[tuple], bucket: bytes) -> np.ndarray:
    """Pairs that are both in a bucket of an earlier band, to which they belong."""
    a, b = (np.stack([np.frombuffer(r[4], "<u8") for r in side]) for side in (left, right))
    band = int(np.flatnonzero(a[0] == np.frombuffer(bucket, "<u8")[0])[0])
    out = np.zeros((len(a), len(b)), bool)
    for k in range(band):
        out |= a[:, k][:, None] == b[:, k][None, :]
    return out


def _links(rows: list[tuple], unit: bytes, by_bucket: bool, i: int, j: int, threshold: float) -> list[tuple]:
    """(node, tied to, links, text links) for the linked nodes of a block pair; ties join each linked pair's ends."""
    left = [r for r in rows if r[1] == i]
    right = left if i == j else [r for r in rows if r[1] == j]
    if not left or not right or (i == j and len(left) < 2):
        return []
    a, b = ([np.frombuffer(r[3], "<u8") for r in side] for side in (left, right))
    common = _overlaps(a, b)
    size_a, size_b = (np.array([len(s) for s in side], np.float64) for side in (a, b))
    hit = common >= threshold * (size_a[:, None] + size_b[None, :] - common) - 1e-6
    if by_bucket:
        hit &= ~_earlier(left, right, unit)
    if i == j:
        np.fill_diagonal(hit, False)
    copies_a, copies_b = (np.array([r[2] for r in side], np.int64) for side in (left, right))
    label_a, label_b = np.arange(len(left)), (np.arange(len(left)) if i == j else np.arange(len(left), len(left) + len(right)))
    while True:
        low_b = np.minimum(label_b, np.where(hit, label_a[:, None], len(left) + len(right)).min(0))
        low_a = np.minimum(label_a, np.where(hit, low_b[None, :], len(left) + len(right)).min(1))
        if i == j:
            low_a = low_b = np.minimum(low_a, low_b)
        if np.array_equal(low_a, label_a) and np.array_equal(low_b, label_b):
            break
        label_a, label_b = low_a, low_b
    names = [r[0] for r in left] + ([] if i == j else [r[0] for r in right])
    sides = [(left, label_a, hit, copies_b)] + ([] if i == j else [(right, label_b, hit.T, copies_a)])
    out = []
    for side, label, linked, copies in sides:
        for k, n in enumerate(linked.sum(1).tolist()):
            if n:
                out.append((side[k][0], names[label[k]], int(copies[linked[k]].sum()), n))
    return out


def _verify(threshold: float):
    def run(batches):
        key, rows = None, []

        def out(links: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], t) for k, t in enumerate(kinds)], ["node", "tied", "links", "text_links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "by_bucket", "i", "j", "node", "block", "copies", "codes", "marks")]
            found = []
            for unit, by_bucket, i, j, *row in zip(*columns):
                if (unit, by_bucket, i, j) != key:
                    if rows:
                        found += _links(rows, *key, threshold)
                    key, rows = (unit, by_bucket, i, j), []
                rows.append(tuple(row))
            yield out(found)
        if rows:
            yield out(_links(rows, *key, threshold))

    return run


def _blocks(rows: str, size: str):
    """Blocks that a unit is cut into, and the row repeats that follow from them."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")


def _units(marks: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, unit, by_bucket, blocks): the units in which each candidate node's pairs are verified.

    ``marks`` has the buckets of nodes (node, mark, size), ``buckets`` those of two nodes or more (mark, least, rows,
    size), ``groups`` the component of each node (node, root).
    """
    sized = groups.join(marks.groupBy("node").agg(F.max("size").alias("size")), "node")
    whole = sized.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).select("root", "rows", _blocks("rows", "size").alias("blocks"))
    parts = buckets.withColumn("blocks", _blocks("rows", "size")).join(groups.select(F.col("node").alias("least"), "root"), "least")
    repeats = parts.groupBy("root").agg(F.sum(F.col("rows") * F.col("blocks")).alias("repeats"))
    ways = materialise(whole.join(repeats, "root").select("root", "blocks", (F.col("repeats") < F.col("rows") * F.col("blocks")).alias("by_bucket")), "ways")
    together = groups.join(ways.where(~F.col("by_bucket")), "root").select("node", F.col("root").alias("unit"), "by_bucket", "blocks")
    split = parts.drop("root").join(parts.select("mark", "root").join(ways.where("by_bucket").select("root"), "root", "left_semi"), "mark").select("mark", "blocks")
    apart = marks.join(split, "mark").select("node", F.col("mark").alias("unit"), F.lit(True).alias("by_bucket"), "blocks")
    return together.unionByName(apart)


def _text_keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))


def _classified(docs: DataFrame, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, node) of ``docs``, and nodes (node, root, first, class_id, copies, links, text_links)."""
    with small_batches(docs.sparkSession):  # all that goes through Python is written in here
        return _written(docs, size, threshold, recall)


def _written(docs: DataFrame, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    bands, rows = banding(threshold, recall)
    docs = _text_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sketches = materialise(docs.mapInArrow(_sketch(size, bands, rows), "doc_id long, text_key long, node binary, marks binary, runs long"), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    nodes = materialise(
        sketches.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("marks").alias("marks"), F.max("runs").alias("runs")), "nodes"
    )
    marks = nodes.where(F.col("marks").isNotNull()).select("node", (8 * F.col("runs")).alias("size"), F.explode(F.expr(f"transform(sequence(0, {bands - 1}), k -> substring(marks, 8 * k + 1, 8))")).alias("mark"))
    buckets = materialise(marks.groupBy("mark").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).where(F.col("least") != F.col("most")).drop("most"), "buckets")
    # a node of many buckets ties their few least nodes together, and itself to one of them: ties don't repeat with a group's size
    tied = materialise(marks.join(buckets.select("mark", "least"), "mark").groupBy("node").agg(F.collect_set("least").alias("all")).select("node", F.array_min("all").alias("low"), "all"), "tied")
    hubs = components(tied.select(F.explode("all").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    groups = tied.select("node", "low").join(hubs.select(F.col("node").alias("low"), F.col("root").alias("_root")), "low", "left").select("node", F.coalesce("_root", "low").alias("root"))
    groups = materialise(groups, "groups")
    discard(tied, hubs)
    units = materialise(_units(marks, buckets, groups), "units")
    candidates = groups.join(nodes.select("node", "first", "copies", "marks"), "node").select("node", "root", "copies", "marks", "first.doc_id", "first.text_key")
    found = docs.join(candidates.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "root", "copies", "marks", "text")
    sets = materialise(found.mapInArrow(_candidate_sets(size), "node binary, root binary, copies long, marks binary, codes binary"), "sets")
    dealt = (
        sets.join(units, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("unit", "by_bucket", "i", "j", "node", "block", "copies", "codes", F.when(F.col("by_bucket"), F.col("marks")).alias("marks"))
    )
    pairs = dealt.repartition("unit", "i", "j").sortWithinPartitions("unit", "by_bucket", "i", "j")
    links = materialise(pairs.mapInArrow(_verify(threshold), "node binary, tied binary, links long, text_links long"), "links")
    discard(buckets, units, sets)
    classes = components(links.where(F.col("node") != F.col("tied")).select(F.col("node").alias("a"), F.col("tied").alias("b")))
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    linked = classes.join(nodes.select("node", "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    known = linked.join(least, "root").select("node", "root", "least").join(degrees, "node")
    table = nodes.select("node", "first", "copies").join(known, "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    table = table.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "first").alias("least"), "copies", zero("links"), zero("text_links"))
    # written first, so that both sides of a later join are plain shuffles and a node with many copies can be split
    table = materialise(table, "classes")
    discard(nodes, links)
    return sketches.select("doc_id", "text_key", "node"), table


def near_duplicates(docs: DataFrame, size: int = RUN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_text_links, n_copies.

    ``class_id`` is the smallest doc_id of the class; ``n_links`` counts the other rows whose sets are at least
    ``threshold`` alike, ``n_text_links`` the different nodes among them, ``n_copies`` the rows of the same node.
    """
    rows, table = _classified(docs, size, threshold, recall)
    joined = rows.join(table, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return joined.select(
        "doc_id", class_id.alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"), F.coalesce("copies", F.lit(1)).alias("n_copies")
    )


def keep_one(docs: DataFrame, size: int = RUN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class of ``docs``: that of the smallest doc_id, null ones last.

    Rows are chosen, not doc_ids: rows with one doc_id and different texts are told apart, and of rows that repeat the
    chosen doc_id and text one stays. Rows with a null text are in no class and all stay. All columns are returned.
    """
    rows, table = _classified(docs, size, threshold, recall)
    chosen = table.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    repeated = rows.where(F.col("node").isNotNull()).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(True).alias("_again"))
    chosen = chosen.alias("c").join(repeated.alias("r"), F.col("c._id").eqNullSafe(F.col("r._id")) & (F.col("c._key") == F.col("r._key")), "left").select("c._id", "c._key", F.coalesce("_again", F.lit(False)).alias("_again"))
    chosen = materialise(chosen, "chosen")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"), F.col("text").isNull().alias("_none"))
    kept = keyed.where(~F.col("_none")).join(chosen, (F.col("_text") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
    single = kept.where(~F.col("_again")).select("_row.*")
    plain = [F.col("_row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = kept.where("_again").groupBy("_id", "_key").agg(F.min_by("_row", F.struct(F.xxhash64(*plain), F.hash(*plain))).alias("_row")).select("_row.*")
    return single.unionByName(one).unionByName(keyed.where("_none").select("_row.*"))
