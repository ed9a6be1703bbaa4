"""N-gram Jaccard self-join by parity sketches.

A text's set holds the hashes of its distinct word n-grams.  Every element
flips one bit of a very wide, sparse bit sketch, so two sketches differ in at
most as many bits as their sets differ in elements.  Sets of similar size meet
in a size band.  Inside a band the largest possible difference d is known, the
sketch is cut into more than d segments, and by the pigeonhole principle a
similar pair agrees in at least one segment that has odd bits.  A segment's bits
are fingerprinted by XOR of 64-bit codes, and equal fingerprints are joined.

Segments shared by many sets (passages, boilerplate, groups of near copies)
are left aside for every set that has more than d segments of its own that few
others share: one of those must agree already.  Only sets made up of common
segments go on to the second step.  Sets that common segments connect form
families; a family is cut into blocks, and each pair of blocks is compared in
one place by its sketches, closest first, skipping what links already join.
All candidates are verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .components import components
from .storage import written

#: A segment shared by more sets than this is common.
COMMON = 12
#: Entries that a bucket of the segment join gets on average.
BUCKET_ENTRIES = 1_000_000
#: Sets, and bytes of their elements, that a block of a family holds on average.
BLOCK_SETS = 1024
BLOCK_BYTES = 16_000_000


def partners_up_to(n: int, percent: int) -> int:
    """Largest set size that can reach the similarity with a set of n elements."""
    return n * 100 // percent


def size_bands(percent: int, top: int = 1 << 40) -> list[tuple[int, int]]:
    """Overlapping ranges of set sizes; sizes that can be similar always share one."""
    bands, low = [], 1
    while low < top:
        high = max(low * 22 // 10, partners_up_to(low, percent))
        bands.append((low, high))
        low = max(high * percent // 100, low)
        while partners_up_to(low, percent) <= high:
            low += 1
    return bands


def _largest_difference(total: int, percent: int) -> int:
    """Most elements in which two similar sets of that total size can differ."""
    return total * (100 - percent) // (100 + percent)


def sparse_segments(s: np.ndarray, band: int, high: int, percent: int) -> tuple[np.ndarray, int]:
    """Fingerprints of the segments of the set's sketch in a band, and how many of them may be left aside.

    The second value is the number of segments with odd bits less the most by
    which a partner in the band can differ; 0 or less: no guarantee here.
    """
    n = len(s)
    k = 1 if _largest_difference(2 * high, percent) == 0 else int(1.26 * _largest_difference(2 * high, percent)) + 3
    seg = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    order = np.argsort(seg, kind="stable")
    seg, codes = seg[order], bw.mix64(s[order] ^ np.uint64(0xA5A5A5A5DEADBEEF))
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    print_ = np.bitwise_xor.reduceat(codes, first)
    keys = bw.mix64(print_ ^ bw.mix64(seg[first] + np.uint64((band + 1) << 40)))
    return keys, len(first) - _largest_difference(n + min(high, partners_up_to(n, percent)), percent)


def _sets(batch: pa.RecordBatch, column: int, n: int):
    data, offsets = bw.buffers(batch.column(column))
    words, first = bw.word_hashes(data, offsets, bw.space_table(), bw.lower_table())
    for i in range(batch.num_rows):
        yield np.unique(bw.shingles(words[first[i] : first[i + 1]], n))


def _digest(s: np.ndarray) -> int:
    """63-bit identity of a set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.uint64(len(s)) + (bw.mix64(s) * np.uint64(0x9E3779B97F4A7C15)).sum()
    x = bw.mix64(np.array([x ^ np.bitwise_xor.reduce(bw.mix64(s ^ np.uint64(0x5851F42D4C957F2D)))]))[0]
    return int(x >> np.uint64(1)) | 1


def dense_sketch(s: np.ndarray) -> bytes:
    """Parity bits of the set in a sketch of two to four bits an element; half the bits follow by folding."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((bw.mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Differing bits of two dense sketches, folded to the same width: never more than the sets' symmetric difference."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def set_table(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, the set's identity (null for the empty set) and its dense sketch, for every row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sizes, ids, sketches = [], [], []
                for s in _sets(part, 1, n):
                    sizes.append(len(s))
                    ids.append(_digest(s) if len(s) else None)
                    sketches.append(dense_sketch(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary")


def _entries(docs: DataFrame, text_col: str, n: int, percent: int, buckets: int) -> DataFrame:
    """Segments of all sets, packed by bucket: fingerprints (32 bits beside the bucket), and how many follow for each set."""
    bands = size_bands(percent)
    row = np.dtype([("set", "<i8"), ("spare", "<i4"), ("space", "<i2"), ("entries", "<i4")])

    def run(batches):
        lows = np.array([b[0] for b in bands])
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part, seen = batch.slice(start, 4000), set()
                keys, owner = [], []
                for s in _sets(part, 0, n):
                    who = _digest(s)
                    if not len(s) or who in seen:
                        continue
                    seen.add(who)
                    top = int(np.searchsorted(lows, len(s), "right"))
                    for i in range(max(0, top - 3), top):
                        if not bands[i][0] <= len(s) <= bands[i][1]:
                            continue
                        k, left = sparse_segments(s, i, bands[i][1], percent)
                        keys.append(k), owner.append((who, left, i, 0))
                        if left <= 0:  # rare: too many elements fell together; every element is then a segment too
                            keys.append(bw.mix64(s ^ bw.mix64(np.array([(i + 1) << 50], np.uint64))))
                            owner.append((who, len(s) - _largest_difference(len(s) + min(bands[i][1], partners_up_to(len(s), percent)), percent), i + 1000, 0))
                if not keys:
                    continue
                key, own = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, low, own = bucket[order], key[order].astype(np.uint32), own[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                table, packed = np.array(owner, row), []
                for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
                    first = np.flatnonzero(np.r_[True, own[a + 1 : b] != own[a : b - 1]])
                    mine = table[own[a:b][first]]
                    mine["entries"] = np.diff(np.r_[first, b - a])
                    packed.append((low[a:b].tobytes(), mine.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())], names=["bucket", "keys", "owners"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, keys binary, owners binary")


def _match_bucket(common: int):
    """Pairs of sets that share an uncommon segment, and the members of common segments."""
    row = np.dtype([("set", "<i8"), ("spare", "<i4"), ("space", "<i2"), ("entries", "<i4")])

    def run(key, table):
        bucket = key[0].as_py()
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()])
        owners = np.concatenate([np.frombuffer(x, row) for x in table.column("owners").to_pylist()])
        who = np.repeat(np.arange(len(owners)), owners["entries"])
        own = owners["set"][who]
        order = np.lexsort((own, key))
        key, own, who = key[order], own[order], who[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]  # copies of a set count once
        key, own, who = key[keep], own[keep], who[keep]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        pairs = []
        for g in range(2, common + 1):
            at = first[n == g]
            if len(at):
                i, j = np.triu_indices(g, 1)
                pairs.append(np.stack([own[(at[:, None] + i).ravel()], own[(at[:, None] + j).ravel()]], 1))
        pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        big = np.repeat(n > common, n)
        m = len(pair)
        return pa.table(
            {
                "a": pa.array(np.r_[pair[:, 0], own[big]], pa.int64()),
                "b": pa.array(np.r_[pair[:, 1], (bucket << 32) + key[big].astype(np.int64)], pa.int64()),
                "space": pa.array(np.r_[np.full(m, -1, np.int32), owners["space"][who[big]].astype(np.int32)], pa.int32()),
                "spare": pa.array(np.r_[np.zeros(m, np.int32), owners["spare"][who[big]]], pa.int32()),
            }
        )

    return run


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (u, v, and the documents du, dv that hold the sets) those whose whole sets reach the similarity.

    Every pair's two sets meet in one place; a set is built once for all its pairs in a task.
    """

    def to_sets(batches):
        last, element = None, b""
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keep, raw = [], []
                texts, wanted = part.column(0), part.column(1).to_pylist()
                change = [i for i in range(part.num_rows) if not (texts[i].equals(texts[i - 1]) if i else texts[0].as_py() == last)]
                fresh = dict(zip(change, _sets(pa.RecordBatch.from_arrays([texts.take(pa.array(change, pa.int64()))], names=["text"]), 0, n), strict=True))
                for i in range(part.num_rows):
                    if i in fresh:
                        element, digest = fresh[i].tobytes(), _digest(fresh[i])
                        known = digest
                    elif i == 0:
                        known = seen
                    keep.append(known == wanted[i])
                    if keep[-1]:
                        raw.append(element)
                if part.num_rows:
                    last, seen = texts[part.num_rows - 1].as_py(), known
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(2).filter(mask), part.column(3).filter(mask), part.column(1).filter(mask), pa.array(raw, pa.binary())], names=["u", "v", "set_id", "elements"])

    def check(batches):
        before = None
        for b in batches:
            us, vs, ids, elements = (b.column(i) for i in range(4))
            us, vs, ids = us.to_pylist(), vs.to_pylist(), ids.to_pylist()
            good = []
            for i in range(b.num_rows):
                pair, s = (us[i], vs[i]), np.frombuffer(elements[i].as_buffer(), np.uint64)
                if before is not None and before[0] == pair and before[1] != ids[i]:
                    both = np.sort(np.concatenate([before[2], s]))
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (len(both) - same):
                        good.append(pair)
                before = pair, ids[i], s
            before = before and (before[0], before[1], before[2].copy())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([x for _, x in good], pa.int64())], names=["u", "v"])

    legs = pairs.select(F.col("du").alias("doc_id"), F.col("u").alias("set_id"), "u", "v").unionByName(pairs.select(F.col("dv").alias("doc_id"), F.col("v").alias("set_id"), "u", "v"))
    sets = docs.join(legs, "doc_id").select("text", "set_id", "u", "v").mapInArrow(to_sets, "u long, v long, set_id long, elements binary")
    return sets.repartition("u", "v").sortWithinPartitions("u", "v", "set_id").mapInArrow(check, "u long, v long")


def _set_elements(texts: DataFrame, n: int) -> DataFrame:
    """set_id and elements of every text."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = [s for s in _sets(b.slice(at, 500), 0, n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["set_id", "elements"])

    return texts.select("text").mapInArrow(run, "set_id long, elements binary").dropDuplicates(["set_id"])


def _link_family(ids: list[int], roots: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links that join all of a family's similar sets that can be joined, without links inside a known component.

    side: 0 and 1 for the two blocks, -1 where one block is compared with itself.
    """
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = np.array([len(s) for s in sets])
    label = np.array(roots)
    sketches = [np.frombuffer(dense_sketch(s), np.uint64) for s in sets]
    width = np.array([len(x) for x in sketches])
    near = []
    for w in np.unique(width):
        for w2 in (w, 2 * w):
            one, two = np.flatnonzero(width == w), np.flatnonzero(width == w2)
            if not len(one) or not len(two):
                continue
            p, q = np.stack([sketches[i] for i in one]), np.stack([sketches[i] for i in two])
            q = q if w2 == w else q[:, :w] ^ q[:, w:]
            for i, x in zip(one, p, strict=True):
                ok = (two > i if w2 == w else two >= 0) & (label[two] != label[i]) & (100 * np.minimum(size[two], size[i]) >= percent * np.maximum(size[two], size[i]))
                if side[i] >= 0:
                    ok &= side[two] != side[i]
                js = np.flatnonzero(ok)
                if len(js):
                    apart = np.bitwise_count(q[js] ^ x).sum(1, dtype=np.int64)
                    good = apart <= (size[two[js]] + size[i]) * (100 - percent) // (100 + percent)
                    near.append(np.stack([apart[good], np.full(good.sum(), i), two[js][good]], 1))
    links = []
    if near:
        near = np.concatenate(near)
        for _, i, j in near[np.argsort(near[:, 0], kind="stable")]:
            a, b = root(roots[i]), root(roots[j])
            if a == b:
                continue
            both = np.sort(np.concatenate([sets[i], sets[j]]))
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= percent * (len(both) - same):
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _family_links(members: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside families; members: set_id, n, root (component so far), family."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    # small families share a bucket, large ones are cut into blocks of which every pair meets once
    rows = members.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(parts)))
    rows = rows.select("set_id", "root", "family", "own", (F.col("blocks") > 1).alias("cut"), group.alias("place"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(key, table):
        out = []
        family = table.column("family").to_numpy()
        ids, roots, own = (table.column(c).to_pylist() for c in ("set_id", "root", "own"))
        raw, lo, hi = table.column("elements"), key[2].as_py(), key[3].as_py()
        for f in np.unique(family):
            at = np.flatnonzero(family == f)
            side = np.array([-1 if lo == hi else int(own[i] == hi) for i in at])
            out += _link_family([ids[i] for i in at], [roots[i] for i in at], side, [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in at], percent)
        return pa.table({"u": pa.array([min(x) for x in out], pa.int64()), "v": pa.array([max(x) for x in out], pa.int64())})

    return rows.join(elements, "set_id").groupBy("place", "cut", "lo", "hi").applyInArrow(run, "u long, v long")


def _with_links(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Edges of the components so far, a star each, and of new links."""
    return links if comp is None else comp.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, common: int = COMMON) -> DataFrame:
    """Near-duplicate classes: texts are linked when 100 * |A and B| >= percent * |A or B| over their sets of word n-grams.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, the row's own included).  Texts that are
    null, empty or without words have the empty set, link with nothing and are
    their own component.  Equal sets are always linked and are collapsed before
    the join.  Repeated rows are kept; a row whose doc_id is null gets the
    component of its text, or null if no row with that set has an id.  Other
    columns are ignored, whatever their names.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(set_table(docs, "doc_id", "text", n), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * BUCKET_ENTRIES) + 1)
    docs = docs.where("doc_id is not null")
    found = written(_entries(docs, "text", n, percent, buckets).groupBy("bucket").applyInArrow(_match_bucket(common), "a long, b long, space int, spare int"), "found")
    size = written(sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")), "classes")

    def possible(batches):
        for b in batches:
            nu, nv, x, y = (b.column(i).to_pylist() for i in range(4, 8))
            mask = pa.array([hamming(p, q) <= _largest_difference(i + j, percent) for i, j, p, q in zip(nu, nv, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in range(4)], names=["u", "v", "du", "dv"])

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs u, v with their documents; sizes and dense sketches rule out most that can't be similar."""
        one, two = (size.select(F.col("set_id").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
        sized = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(one, "u").join(two, "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        return written(sized.select("u", "v", "du", "dv", "nu", "nv", "su", "sv").mapInArrow(possible, "u long, v long, du long, dv long"), "pairs")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends no chain of links joins yet."""
        one, two = (comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        both = pairs.join(one, "u", "left").join(two, "v", "left")
        return both.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select(pairs.columns)

    cold = found.where("space < 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # sets without enough uncommon segments of their own, with all their common ones
    hot = found.where("space >= 0").select(F.col("a").alias("set_id"), F.col("b").alias("key"), "space", "spare")
    short = hot.groupBy("set_id", "space").agg(F.count("*").alias("c"), F.max("spare").alias("s")).where("c >= s").select("set_id", "space")
    hot = written(hot.join(short, ["set_id", "space"]).select("set_id", "key"), "common")
    open_ = candidates(cold)
    first = hot.join(hot.groupBy("key").agg(F.min("set_id").alias("v")), "key").select(F.col("set_id").alias("u"), "v")
    family = components(first).unionByName(hot.select(F.col("set_id").alias("node"), F.col("set_id").alias("root"))).groupBy("node").agg(F.min("root").alias("family"))
    family = written(family.join(size.select(F.col("set_id").alias("node"), "doc_id", "n"), "node"), "families")
    # the texts of all sets that have a candidate or a family, once
    wanted = open_.select(F.col("du").alias("doc_id")).unionByName(open_.select(F.col("dv").alias("doc_id"))).unionByName(family.select("doc_id")).distinct()
    texts = written(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    # one pair for each set first; what that leaves apart, after a second round of the same, in full
    comp = None
    for i in range(3):
        one = open_.groupBy("v").agg(F.min_by(F.struct("u", "v", "du", "dv"), "u").alias("p")).select("p.*") if i < 2 else open_
        new = written(_verified(one, texts, n, percent), "links")
        comp = components(_with_links(comp, new))
        if i < 2:
            open_ = written(apart(open_, comp).join(one, ["u", "v"], "left_anti"), "pairs")
            if open_.isEmpty():
                break
    members = family.join(comp, "node", "left").select(F.col("node").alias("set_id"), "n", F.coalesce("root", "node").alias("root"), "family")
    chosen = texts.join(family.select("doc_id"), "doc_id", "left_semi")
    more = written(_family_links(members, _set_elements(chosen, n), percent), "links")
    comp = components(_with_links(comp, more))
    whose = size.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = whose.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = whose.join(least, "root").select("set_id", "component_id")
    return sets.select("doc_id", "n_shingles", "set_id").join(label, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
