"""Documents whose sets of four-word shingles overlap: a size-aware heavy-light similarity join.

Documents with equal sets are one node. Two different sets that link share at least t(n) = ceil(0.85 n) shingles, n the size of
either. With all shingles in one order (frequent ones last), the l-th shared one stands among the first n - t(n) + l of
both sets. So

* light sets (n up to a boundary) name every subset of ``SUBSET`` shingles out of their first n - t(n) + SUBSET,
  and two light sets that link share a subset;
* heavy sets scan the inverted lists of their first n - t(n) + 1 shingles, in which light sets stand too if a heavy set can
  reach them.

Subsets grow with the square of a light set's size but are seldom shared by chance; lists are short to name and long to
scan. The boundary is where the sum of both, from the sizes of all sets and the lists of a sample of shingles, is least.

A list is not expanded into its pairs. One member is the centre of its list, then another one, as long as the list
is in several components, and each set meets the centre that it shares most lists with; only what is still apart is
compared piece against piece. 256 bits of every set (``parity``) bound from below in how many shingles two sets differ. They stand
beside the members of a list, so that nearly all pairs that cannot link are never rows. Small counts of large sets (``sketch``)
bound how much two of them can share; candidates that this leaves are compared by both whole sets, streamed past the set that
they all meet. The result needs no more links than join what links join.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, discard, spread
from .components import components
from .grouped import whole_groups
from .keyfilter import inside, key_filter, passing
from .skew import join_counted
from .text import LOWER, mixed, row_blocks, text_bytes

SHINGLE = 4
PERCENT = 85
SUBSET = 2
FREQUENT = 50_000  # shingles, the most frequent ones, that stand last in the order of all
BLOCK = 4 << 20  # bytes of text whose shingles are counted together
SAMPLE = 64  # one in so many shingles has its list measured
ROUNDS = 1  # in which each set meets one other before all candidates that are left are compared
SHARE = 16  # lists are dealt into so many shares, some of which are compared before all others
TURNS = 8  # so many shares at most
FEW = 8  # sets that a member of a list meets in such a turn
SMALL = 64  # members of a list that is compared together with others
SLAB = 1 << 15  # pairs compared at a time
PIECE = 4096  # members of a list that meet as many others in a task
MEET = 20_000  # sets that meet one in a task
BUCKETS = 256  # of a sketch, by a hash's first byte
LARGE = 512  # sets of more shingles have a sketch too
BITS = ["p0", "p1", "p2", "p3"]  # a set's parity

_FACTOR = np.random.default_rng(SHINGLE).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``size`` words; a shorter text is one run."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    runs = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        runs += h[k: len(h) - size + 1 + k] * _FACTOR[k]
    return np.unique(mixed(runs))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    raw, at = text_bytes(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield shingle_set(raw[a:b].tobytes())


def frequent(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Hashes of frequent shingles, the most frequent last. Counts are exact only for what is frequent in most
    blocks of texts; they decide an order and no result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in row_blocks(text_bytes(column)[1], BLOCK):
                found, n = np.unique(np.concatenate(list(_sets(column.slice(low, high - low)))), return_counts=True)
                often = n >= max(3, (high - low) // 256)
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])],
                                                 names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def ordered(hashes: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the order of all shingles: by hash, but those of ``last`` (sorted) at the end, by rank."""
    if not len(last) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
    late = last[at] == hashes
    end = hashes[late]
    return np.concatenate([hashes[~late], end[np.argsort(rank[at[late]])]])


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes has each last byte: 256 bits. At least as many shingles are in one of two sets alone
    as bits of their parities differ."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of ``BUCKETS``. The sum of the lesser counts of two sketches is at least the number of
    hashes that both sets hold. Sets that could exceed a count allow everything."""
    if len(hashes) >= 1 << 16:
        return np.full(BUCKETS, 0xFFFF, "<u2").tobytes()
    return np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS).astype("<u2").tobytes()


def _bounds(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.minimum(left, right).sum(axis=1, dtype=np.int64)


def _counts(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].view("<u2").reshape(-1, BUCKETS)


def _rows(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key (a hash of id and text), node (a 128-bit hash of the set), n, prefix, sketch, parity; row numbers."""
    order = frequent(docs)
    at = np.argsort(order)
    sent = docs.sparkSession.sparkContext.broadcast((order[at], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = sent.value
        for batch in batches:
            nodes, sizes, parts, sketches, bits = [], [], [], [], [np.zeros((0, len(BITS)), np.int64)]
            for found in _sets(batch.column("text")):
                n = len(found)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                sizes.append(n)
                sketches.append(sketch(found) if n > LARGE else None)
                bits.append(parity(found)[None])
                parts.append(ordered(found, last, rank)[: n - -(-percent * n // 100) + SUBSET].view(np.int64))
            borders = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            bits = [pa.array(c) for c in np.ascontiguousarray(np.concatenate(bits).T)]
            prefix = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 prefix, pa.array(sketches, pa.binary()), *bits],
                names=["doc_id", "key", "node", "n", "prefix", "sketch", *BITS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, key long, node binary, n long, prefix array<long>, sketch binary, "
                          + ", ".join(f"{c} long" for c in BITS))
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def _first(n: Column, more: int, percent: int) -> Column:
    """How many shingles of a set's order matter: n - t(n) + more."""
    return (n - F.ceil(n * percent / F.lit(100)) + more).cast("int")


def boundary(nodes: DataFrame, percent: int) -> int:
    """The size up to which sets are light: where naming subsets and scanning lists together cost least."""
    sized = nodes.withColumn("k", F.floor(8 * F.log2("n")).cast("int"))
    sizes = sized.groupBy("k").agg(
        F.max("n").alias("most"), F.count(F.lit(1)).alias("sets"), F.sum(_first(F.col("n"), 1, percent)).alias("names"),
        F.sum((_first(F.col("n"), 2, percent) * _first(F.col("n"), 1, percent) / 2)).alias("subsets"))
    names = sized.select("k", F.explode(F.slice("prefix", 1, _first(F.col("n"), 1, percent))).alias("h"))
    lists = names.where(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("h", "k").agg(F.count(F.lit(1)).alias("c")).groupBy(
        "h").agg(F.sum("c").alias("m"), F.collect_list(F.struct("k", "c")).alias("parts"))  # a row per size class
    reach = F.least("m", F.lit(SMALL))  # a longer list is met by its centre first
    scans = lists.select(reach.alias("m"), F.inline("parts")).groupBy("k").agg(
        (F.sum(F.col("c") * F.col("m")) * SAMPLE).alias("scan"))
    classes = sizes.join(scans, "k", "left").fillna(0, ["scan"]).orderBy("k").collect()  # 8 for each doubling of the size
    best, least, light = 0, float("inf"), 0.0
    heavy = float(sum(c["names"] + c["scan"] for c in classes))
    for most, c in [(0, None), *[(c["most"], c) for c in classes]]:
        if c:
            light, heavy = light + c["subsets"], heavy - c["names"] - c["scan"]
        if light + heavy < least:
            best, least = most, light + heavy
    return best


def _scanned(nodes: DataFrame, light: int, percent: int) -> DataFrame:
    """id, n, guest, heads (the shingles whose lists a set stands in). Two guests of a list need not meet."""
    n = F.col("n")
    return nodes.where((n > light) | (F.floor(n * 100 / F.lit(percent)) > light)).select(
        "id", "n", (n <= light).alias("guest"), F.slice("prefix", 1, _first(n, 1, percent)).alias("heads"))


def _named(nodes: DataFrame, light: int) -> DataFrame:
    """list, id, n, pos, guest: a row for every subset that a light set names."""
    tails = F.transform(F.sequence(F.lit(1), F.size("prefix") - 1), lambda i: F.transform(
        F.slice("prefix", i + 1, F.size("prefix")), lambda h: F.xxhash64(F.element_at("prefix", i), h)))
    return nodes.where(F.col("n") <= light).select("id", "n", F.explode(F.flatten(tails)).alias("list")).select(
        "list", "id", "n", F.lit(0).alias("pos"), F.lit(False).alias("guest"))


def _listed(scanned: DataFrame, sent: Broadcast) -> DataFrame:
    """list, id, n, pos, guest: a row for every list of a set that may be in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column("heads")
            many = heads.value_lengths().to_numpy().astype(np.int64)
            h = heads.flatten()
            row = np.repeat(np.arange(len(many)), many)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            there = np.flatnonzero(inside(sent.value, h.to_numpy()))
            own = batch.select(["id", "n", "guest"]).take(pa.array(row[there]))
            yield pa.RecordBatch.from_arrays([h.take(pa.array(there)), own.column("id"), own.column("n"), pa.array(
                pos[there].astype(np.int32)), own.column("guest")], names=["list", "id", "n", "pos", "guest"])

    return scanned.mapInArrow(run, "list long, id long, n long, pos int, guest boolean")


def _may_link(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of these sizes with a shared shingle at these positions can link. (Subsets carry no positions.)"""
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent))


def _filtered_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, hashes of the sets of ``wanted(id, node, key)``. Only texts that pass a filter of the wanted keys are
    shingled again and shuffled; the filter lets some others through, which the join drops."""
    sent = key_filter(wanted.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(inside(sent.value, batch.column("key").to_numpy())))
            for low, high in row_blocks(text_bytes(texts)[1], BLOCK):
                found = [s.tobytes() for s in _sets(texts.slice(low, high - low))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()),
                                                  pa.array(found, pa.binary())], names=["node", "hashes"])

    found = docs.select("key", "text").mapInArrow(run, "node binary, hashes binary")
    out = cut(found.join(wanted.select("node", "id"), "node").dropDuplicates(["id"]).select("id", "hashes"))
    sent.unpersist()
    return out


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            a, b, hashes = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("hashes")
            for k in range(batch.num_rows):
                theirs = np.frombuffer(hashes[k].as_buffer(), np.uint64)
                if a[k] == b[k]:  # stands before those that meet it
                    centre, mine = a[k], theirs.copy()
                    continue
                assert a[k] == centre
                small, large = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good[k] = 100 * both >= percent * (len(mine) + len(theirs) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = _bounds(_counts(batch.column("sa")), _counts(batch.column("sb")))
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(bound * (100 + percent) >= n * percent))

    return run


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose parities allow a link, as a table; of two large sets the sketches have to, too."""
    def side(k: str, some: DataFrame, *columns: str) -> DataFrame:
        return some.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in columns])

    both = pairs.join(side("a", nodes, "n", *BITS), "a").join(side("b", nodes, "n", *BITS), "b")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in BITS])
    near = cut(both.where((F.col("na") + F.col("nb")) * (100 - percent) >= differ * (100 + percent)).select(
        "a", "b", "na", "nb"))
    many = (F.col("na") > LARGE) & (F.col("nb") > LARGE)
    large = near.where(many)
    if large.isEmpty():
        return near.select("a", "b")
    wide = nodes.where(F.col("n") > LARGE)
    sketched = large.join(side("a", wide, "sketch"), "a").join(side("b", wide, "sketch"), "b").select(
        "a", "b", "na", "nb", F.col("sketcha").alias("sa"), F.col("sketchb").alias("sb"))
    out = cut(sketched.mapInArrow(_possible(percent), "a long, b long").unionByName(near.where(~many).select("a", "b")))
    discard(near)
    return out


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets link. A set that more than ``MEET`` others meet is in several tasks."""
    met = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEET)).cast("int").alias("pieces")))
    cuts = met.where("pieces > 1")
    dealt = pairs if cuts.isEmpty() else pairs.join(cuts, "a", "left")
    pieces = F.lit(1) if cuts.isEmpty() else F.coalesce("pieces", F.lit(1))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), pieces).cast("int").alias("piece"))
    guests = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "piece", "b", "hashes")
    centres = met.join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("a").alias("b"), "hashes")
    rows = spread(guests.unionByName(centres).withColumn("guest", F.col("a") != F.col("b")), "a", "piece")
    return rows.sortWithinPartitions("a", "piece", "guest").select("a", "b", "hashes").mapInArrow(
        _compared(percent), "a long, b long")


def _apart(percent: int, few: int | None = None):
    """Pairs of sets in one list that may link; with ``few``, so many others of each at most."""
    keys = ["list", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            node, root, n, pos, guest = (table.column(c).to_numpy() for c in ("id", "root", "n", "pos", "guest"))
            bits = [table.column(c).to_numpy() for c in BITS]

            def linked(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                """Of these pairs of rows, the nodes of those that may link."""
                least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                shared = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
                keep = ((root[x] != root[y]) & ~(guest[x] & guest[y]) & (least * 100 >= most * percent)
                        & (shared * (100 + percent) >= (least + most) * percent))
                x, y = x[keep], y[keep]
                differ = sum(np.bitwise_count((b[x] ^ b[y]).view(np.uint64)).astype(np.int64) for b in bits)
                near = (n[x] + n[y]) * (100 - percent) >= differ * (100 + percent)
                x, y = x[near], y[near]
                if few is not None and len(x) > few:  # those with the least hash of both
                    order = np.lexsort((mixed((node[x] ^ node[y]).view(np.uint64)), x))
                    x, y = x[order], y[order]
                    new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    which = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
                    x, y = x[which < few], y[which < few]
                x, y = node[x], node[y]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

            sizes = np.diff(np.append(starts, table.num_rows))
            small = np.repeat(sizes <= SMALL, sizes)
            after = np.repeat(starts + sizes, sizes) - np.arange(len(node)) - 1  # rows behind a row in its list
            rows = np.flatnonzero(small & (after > 0))
            ends, k = np.cumsum(after[rows]), 0
            while k < len(rows):
                stop = max(k + 1, int(np.searchsorted(ends, ends[k] - after[rows[k]] + SLAB, "right")))
                x, many = rows[k:stop], after[rows[k:stop]]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                x = np.repeat(x, many)
                yield linked(x, x + 1 + step)
                k = stop
            for low, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                _, number, many = np.unique(root[low: low + size], return_inverse=True, return_counts=True)
                rest = low + np.flatnonzero(number != many.argmax())  # one of each pair is outside the largest component
                step = max(1, SLAB // size)
                for k in range(0, len(rest), step):
                    x = rest[k: k + step]
                    yield linked(np.repeat(x, size), np.tile(np.arange(low, low + size), len(x)))

    return run


def _nodes(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of ``wide`` that stands for its set, as id, of every set, as a table. Only rows whose set may be in several
    rows are shuffled."""
    columns = [F.col("row").alias("id"), "n", "prefix", "sketch", "node", "key", *BITS]
    wide = wide.withColumn("code", F.xxhash64("node"))
    sent = key_filter(groups.where("rows > 1").select(F.xxhash64("node").alias("code")))
    chosen = groups.select(F.col("id").alias("row"))
    again = passing(wide, "code", sent).join(chosen, "row", "left_semi")
    out = cut(passing(wide, "code", sent, False).select(*columns).unionByName(again.select(*columns)))
    sent.unpersist()
    return out


def _rooted(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (with an id) and the root of each; a node without links is its own."""
    roots = cut(components(links)).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return members.join(roots, members["id"] == roots["_node"], "left").withColumn(
        "root", F.coalesce("_root", "id")).drop("_node", "_root")


def links(docs: DataFrame, nodes: DataFrame, *, percent: int = PERCENT, light: int | None = None,
          piece: int = PIECE, rounds: int = ROUNDS) -> DataFrame:
    """Links a, b between ``nodes(id, n, prefix, sketch, node, key)``, all right and enough to join what links join."""
    made = []  # tables that nothing reads after this

    def kept(df: DataFrame) -> DataFrame:
        made.append(cut(df))
        return made[-1]

    light = boundary(nodes, percent) if light is None else light
    scanned, named = _scanned(nodes, light, percent), _named(nodes, light)
    every = scanned.select(F.explode("heads").alias("list"), "guest").unionByName(named.select("list", "guest"))
    found = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    shared = cut(every.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("guests")).where(
        "m > 1 and not guests").drop("guests"))
    sent = key_filter(shared.select("list"))
    likely = cut(_listed(scanned, sent).unionByName(passing(named, "list", sent)) if light else _listed(scanned, sent))
    sent.unpersist()
    open_rows = kept(join_counted(likely, shared, ["list"], "m", "inner"))
    discard(likely, shared)
    sets = None

    def verified(pairs: DataFrame) -> DataFrame:
        """``found`` and those of ``pairs`` that link; sets that were not needed before are made from their texts."""
        nonlocal sets
        if pairs.isEmpty():
            return found
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if sets is not None:
            ids = kept(ids.join(sets, "id", "left_anti"))
        if sets is None or not ids.isEmpty():
            made.append(more := _filtered_sets(docs, kept(nodes.join(ids, "id").select("id", "node", "key"))))
            sets = more if sets is None else sets.unionByName(more)
        return kept(found.unionByName(similar(pairs, sets, percent)))

    if rounds:
        centre = F.min(F.struct("guest", F.xxhash64("id").alias("first"), "id", "n", "pos")).alias("one")  # no guest
        lists = cut(open_rows.groupBy("list").agg(centre, F.count(F.lit(1)).alias("m")))
        met = join_counted(open_rows.drop("m"), lists, ["list"], "m", "inner")
        meet = met.where((F.col("id") != F.col("one.id")) & _may_link(
            F.col("n"), F.col("one.n"), F.col("pos"), F.col("one.pos"), percent)).groupBy(
            F.col("one.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
        most = F.max(F.struct("lists", (-F.col("a")).alias("last"))).alias("most")  # of a set, the centre it meets
        first = possible(meet.groupBy("b").agg(most).select((-F.col("most.last")).alias("a"), "b"), nodes, percent)
        discard(lists)
        found = verified(first)
        discard(first)

    def apart(share: int | None = None) -> DataFrame:
        """Candidates of different components from the lists that are not in one component, as a table. Of one share of the
        lists, a few for each member."""
        some = open_rows if share is None else open_rows.where(F.pmod("list", F.lit(SHARE)) == share)
        known = cut(_rooted(found, some.drop("m")))
        still = cut(known.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"),
                                              F.max("root").alias("high")).where("low != high").select("list", "m"))
        keys = ["list", "i", "j"]
        pieces = F.ceil(F.col("m") / F.lit(piece)).cast("int")
        own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
        dealt = join_counted(known, still, ["list"], "m", "inner").join(nodes.select("id", *BITS), "id").withColumn(
            "pieces", pieces).withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns(
            {"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        rows = spread(dealt.select(*keys, "id", "root", "n", "pos", "guest", *BITS), *keys).sortWithinPartitions(*keys)
        out = cut(rows.mapInArrow(_apart(percent, None if share is None else FEW), "a long, b long").distinct())
        discard(known, still)
        return out

    # Sets that link share many lists, so a share of the lists shows most of them. In a large group of near copies a few
    # candidates of each set join nearly all, so that pairs grow with the sets and not with the square of the group; as long as
    # that joins many, the next share follows. Then the lists that are still apart, all of them and whole.
    tested, links_before, most = found.limit(0), found.count(), 0
    for turn in range(TURNS if rounds else 0):
        every = apart(turn)
        some = possible(every.join(tested, ["a", "b"], "left_anti"), nodes, percent)
        discard(every)
        made.append(some)
        found, tested = verified(some), tested.unionByName(some)
        links_now = found.count()
        more, links_before = links_now - links_before, links_now
        most = max(most, more)
        if 4 * more <= most:
            break
    every = apart()
    some = possible(every.join(tested, ["a", "b"], "left_anti"), nodes, percent)
    found = verified(some)
    discard(every, some)
    out = cut(found)
    discard(*made)
    return out


def _ends(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` and the roots of both ends; nodes that are not in ``roots`` are their own."""
    for side in "ab":
        one = roots.select(F.col("id").alias(side), F.col("root").alias("_root"))
        pairs = pairs.join(one, side, "left").withColumn(f"r{side}", F.coalesce("_root", side)).drop("_root")
    return pairs


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets. Documents with equal sets
    link; one without words (null text too) links with nothing and names itself. Rows that share an id or a text each
    get an answer. Null ids are answered, and name a component only if all of its ids are null. Other columns do not
    matter. An empty table gives an empty table. A text and its set have to fit into a task.

    ``light`` (a size in place of the computed boundary), ``piece`` and ``rounds`` do not change the result.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent: from 67 to 100, so that linked sets share a subset")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    least = percent / (100 - percent) if percent < 100 else float("inf")  # smaller sets link with none but themselves
    wide = _rows(docs, percent)
    rows = cut(wide.select("doc_id", "n", "node", "row"))
    groups = cut(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("row").alias("id")))
    nodes = _nodes(wide.where(F.col("n") >= least), groups)
    discard(wide)
    found = links(docs, nodes, percent=percent, **options)
    discard(nodes)
    linked = cut(_rooted(found, groups))
    discard(found, groups)
    whole = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = cut(join_counted(linked, whole, ["root"], "n", "inner").select("node", "rows", "component_id"))
    discard(linked, whole)
    out = join_counted(rows.where("n > 0").select("doc_id", "n", "node"), named, ["node"], "rows", "inner")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        alone.withColumnRenamed("n", "n_shingles"))
