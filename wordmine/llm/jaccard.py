"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A text is the set of its shingles (five words; hashes of 64 bits).  Two sets of
sizes n and m that link share at least T = ceil(0.75 n) of n's shingles.  Of the
n inverted lists of a set, T - need are skipped and the others merged: a partner
must occur at least ``need`` times in the merged ones.  The lists to skip are the
long ones.  Candidates are then settled by binary probes of the sorted sets.

How the lists are spread over Spark:

1. One pass gives each text a signature of its set, so that equal sets count as
   one from here on, and the shingles that more than one in ``1 / HOT_SHARE``
   texts of a task hold.  There are at most (shingles per text) / HOT_SHARE of
   them, however large the corpus.  They come last in the order in which lists
   are merged; among the rest the order is that of the hashes.
2. A second pass sends the first n - T + need shingles of each set to the list
   of the shingle.  Lists with one member are dropped; each of them is a shingle
   that its set shares with nobody.  So a set is left with a number of shingles
   that it may share, and it is dropped where that is too small for any partner.
3. Lists of at most ``LONG`` members are merged: pairs whose sizes, and shingles
   that they may share, fit are counted within the task and summed over the
   tasks.  Pairs that reach ``need`` are probed: first by sketches, of about a bit
   for each shingle, which tell most pairs that cannot link; then by their sets.
4. What remains are the longer lists, most of them of one large group of near
   copies.  The members that share most are its hubs; the others are probed
   against them first, which joins the group.  Then only pairs are merged that
   are not yet known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmine.llm.components import components
from wordmine.llm.memory import only
from wordmine.llm.textbytes import LOWER, runs, span_hashes, text_bytes, window_hashes, words
from wordmine.session import materialize

WIDTH = 5
PERCENT = 75
#: Share of a task's texts from which a shingle comes last in the order.
HOT_SHARE = 0.001
#: Members from which a list counts as long.
LONG = 16
#: Members of a long list that the others are probed against.
HUBS = 2
#: Bits of the sketch of a set: the power of two from its size on, within these limits.
SKETCH_BITS = (64, 1 << 14)
#: Ids up to which the texts to probe are picked by a broadcast (16 MB).
BROADCAST_IDS = 1_000_000


# Sets


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, each ascending, end to end, and their offsets."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(LOWER[data], offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    shingles = np.zeros(len(hashes), np.uint64)
    full = window_hashes(hashes, WIDTH)
    shingles[: len(full)] = full
    keep = np.arange(len(hashes)) <= first[1:][owner] - WIDTH
    for i in np.flatnonzero((count > 0) & (count < WIDTH)):
        own = hashes[first[i] : first[i + 1]]
        shingles[first[i]] = window_hashes(own, len(own))[0]
        keep[first[i]] = True
    shingles, owner = shingles[keep], owner[keep]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(count) + 1))


def _signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits for each set; 0 for the empty one."""
    raw = memoryview(np.ascontiguousarray(shingles).view(np.uint8))
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            digest = hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little", signed=True) or 1
    return out


def _sketches(shingles: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each set, which of its hash values an odd number of shingles has.

    Two sketches of a length differ in no more bits than their sets in shingles.
    Half as long a sketch is made by folding one.
    """
    n = np.diff(offsets)
    least, most = SKETCH_BITS
    bits = 1 << np.ceil(np.log2(np.clip(n, least, most))).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(bits)))
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    owner = np.repeat(np.arange(len(n)), n)
    at = begins[owner] + (mixed & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=begins[-1]) & 1).astype(np.uint8))
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(n), [None, pa.py_buffer((begins // 8).astype(np.int32)), pa.py_buffer(data.tobytes())]
    )


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` without those whose sketches differ too much for a link."""
    for batch in batches:
        a, b, na, nb, *sketches = batch.columns
        both = np.asarray(na).astype(np.int64) + np.asarray(nb)
        sizes = [np.array([len(x) for x in s.to_pylist()], np.int64) for s in sketches]
        keep = np.zeros(len(both), bool)
        for x, y in np.unique(np.stack(sizes, 1), axis=0).tolist():
            own = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
            rows = [
                np.frombuffer(b"".join(s.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                for s in sketches
            ]
            while rows[0].shape[1] != rows[1].shape[1]:
                rows.sort(key=lambda r: r.shape[1])
                half = rows[1].shape[1] // 2
                rows[1] = rows[1][:, :half] ^ rows[1][:, half:]
            differ = np.bitwise_count(rows[0] ^ rows[1]).sum(1, dtype=np.int64)
            keep[own] = (100 + PERCENT) * differ <= (100 - PERCENT) * both[own]
        chosen = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(chosen), b.filter(chosen)], names=["a", "b"])


def least_overlap(n: np.ndarray) -> np.ndarray:
    """T: shingles of a set of ``n`` that any linked set shares."""
    return -(-PERCENT * n // 100)


def needed(n: np.ndarray) -> np.ndarray:
    """How often a partner of a set of ``n`` must occur in the merged lists."""
    return np.minimum(1 + n // 16, least_overlap(n))


def _slices(batches: Iterator[pa.RecordBatch]):
    only()
    for batch in batches:
        for start, stop in runs(batch.column("text")):
            part = batch.slice(start, stop - start)
            yield part, *shingle_sets(part.column("text"))


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (doc_id, text_hash, sig, n, sketch), then rows of frequent shingles (hot)."""
    names = ["doc_id", "text_hash", "sig", "n", "hot", "sketch"]
    held, texts = {}, 0
    for part, shingles, offsets in _slices(batches):
        sig = _signatures(shingles, offsets)
        n = np.diff(offsets)
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in names[:2]),
                pa.array(sig),
                pa.array(n),
                pa.nulls(len(n), pa.int64()),
                _sketches(shingles, offsets),
            ],
            names=names,
        )
        distinct = np.unique(sig, return_index=True)[1]
        texts += len(distinct)
        once = np.zeros(len(n), bool)
        once[distinct] = True
        values, times = np.unique(shingles[np.repeat(once, n)], return_counts=True)
        often = times > max(2, HOT_SHARE * len(distinct))
        for v, t in zip(values[often].tolist(), times[often].tolist(), strict=True):
            held[v] = held.get(v, 0) + t
    hot = [v for v, t in held.items() if t > max(8, HOT_SHARE * texts)]
    if hot:
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(len(hot), pa.int64())] * 4,
                pa.array(np.array(hot, np.uint64).view(np.int64)),
                pa.nulls(len(hot), pa.binary()),
            ],
            names=names,
        )


def _posting_rows(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shingles, offsets in _slices(batches):
            sig = _signatures(shingles, offsets)
            n = np.diff(offsets)
            once = np.zeros(len(n), bool)
            once[np.unique(sig, return_index=True)[1]] = True
            once &= n > 0
            owner = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(shingles), bool)
            if len(hot):
                at = np.searchsorted(hot, shingles)
                at[at == len(hot)] = 0
                late = hot[at] == shingles
                order = np.lexsort((late, owner))  # stable: by hash within
                shingles, owner = shingles[order], owner[order]
            place = np.arange(len(shingles)) - offsets[owner]
            prefix = n - least_overlap(n) + needed(n)
            keep = once[owner] & (place < prefix[owner])
            owner = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shingles[keep].view(np.int64)),
                    pa.array(sig[owner]),
                    pa.array(n[owner].astype(np.int32)),
                ],
                names=["shingle", "sig", "n"],
            )

    return run


# Lists


def _fitting(n: np.ndarray, m: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Can sets of sizes n, m link that may share u, v of their shingles at most?"""
    return (100 + PERCENT) * np.minimum(u, v) >= PERCENT * (n + m)


class PairCounts:
    """Pairs and how often they were met."""

    MOST = 2_000_000

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.seen, self.part = 0, [], None

    def add(self, sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        swap = sig[i] > sig[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        self.held.append((sig[i], sig[j], n[i], n[j], np.ones(len(i), np.int64)))
        self.size += len(i)
        if self.size > self.MOST:
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        """Every pair once."""
        a, b, na, nb, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((b, a))
        a, b, na, nb, times = a[order], b[order], na[order], nb[order], times[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        out = (a[at], b[at], na[at], nb[at], np.add.reduceat(times, at) if len(at) else times)
        self.held, self.size = [out], len(at)
        return out

    def reached(self) -> np.ndarray:
        """Pairs that can link, if all others of their lists are elsewhere.

        ``seen`` holds the sets of the lists merged here, once per list, with the
        number of all their lists; so a pair occurs as often as here, and in the
        lists that either set has elsewhere, at most.
        """
        a, b, na, nb, times = self.held[0]
        sig, lists = (np.concatenate(x) for x in zip(*self.seen, strict=True))
        ids, first, here = np.unique(sig, return_index=True, return_counts=True)
        rest = lists[first] - here
        rest = np.minimum(rest[np.searchsorted(ids, a)], rest[np.searchsorted(ids, b)])
        ta, tb = least_overlap(na.astype(np.int64)), least_overlap(nb.astype(np.int64))
        skipped = np.maximum(ta - needed(na), tb - needed(nb))
        return (100 + PERCENT) * (times + rest + skipped) >= PERCENT * (na + nb)

    def rows(self, check: bool) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = self.compact()
            if check:
                keep = self.reached()
                columns = [c[keep] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in columns], names=["a", "b", "na", "nb", "c"]
            )
        self.__init__()


_PAIRS = "a long, b long, na int, nb int, c long"


def _merging(check: bool):
    """Count the pairs of bounded groups; rows come sorted by ``part`` and ``key``.

    ``side`` 0 and 1 are the two halves of a tile of a long list, 2 is a whole
    list; ``comp`` tells members that are known to be connected.  With ``check``
    a part holds all lists of one tile, and of its pairs those that cannot reach
    the overlap are left out; a part then has two blocks' pairs at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = PairCounts()
        rest = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            part, key = columns[:2]
            if not len(key):
                continue
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            bounds = np.flatnonzero(new)
            rest = [c[bounds[-1] :] for c in columns]
            parts = part[bounds]
            for own in np.split(np.arange(len(bounds) - 1), np.flatnonzero(parts[1:-1] != parts[:-2]) + 1):
                if check and len(own) and pairs.part not in (None, parts[own[0]]):
                    yield from pairs.rows(check)
                if len(own):
                    pairs.part = parts[own[0]]
                    _count_groups(columns, bounds[own[0] : own[-1] + 2], pairs)
            if not check and pairs.size > pairs.MOST // 2:
                yield from pairs.rows(check)
        if rest is not None:
            if check and pairs.part not in (None, rest[0][0]):
                yield from pairs.rows(check)
            _count_groups(rest, np.array([0, len(rest[0])]), pairs)
        yield from pairs.rows(check)

    return run


def _count_groups(columns: list[np.ndarray], bounds: np.ndarray, pairs: PairCounts) -> None:
    _, _, sig, n, u, comp, side = columns
    sizes = np.diff(bounds)
    own = slice(bounds[0], bounds[-1])
    size = n[own].astype(np.int64)
    pairs.seen.append((sig[own], u[own] - least_overlap(size) + needed(size)))
    # Small groups of one size are handled together: row g holds group g.
    for size in np.unique(sizes).tolist():
        if size < 2:
            continue
        starts = bounds[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(starts), step):
            own = starts[k : k + step, None]
            x, y = (own + i).ravel(), (own + j).ravel()
            keep = _fitting(n[x], n[y], u[x], u[y]) & (comp[x] != comp[y])
            keep &= (side[x] == 2) | (side[x] != side[y])
            pairs.add(sig, n, x[keep], y[keep])


def _merge(rows: DataFrame, check: bool = False) -> DataFrame:
    """``a, b, na, nb, c`` over all groups of ``part, key, sig, n, u, comp, side``."""
    ordered = rows.select("part", "key", "sig", "n", "u", "comp", "side")
    ordered = ordered.repartition("part" if check else "key").sortWithinPartitions("part", "key")
    counted = ordered.mapInArrow(_merging(check), _PAIRS)
    return counted.groupBy("a", "b").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c")
    )


def _tiles(rows: DataFrame, block: int) -> DataFrame:
    """Deal the members of long lists to tiles: all pairs of blocks of a list.

    A group of the result holds at most two blocks, however long the list.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("most") / block)).cast("int")
    rows = rows.withColumn("blocks", blocks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # A block meets itself in its own tile; in the others only across.  Lists of one
    # group have the same hub (the group of the member that shares most), so that the
    # pairs of a tile meet in one part.
    part, key = F.xxhash64("hub", low, high), F.xxhash64("shingle", low, high)
    return rows.select(part.alias("part"), key.alias("key"), "sig", "n", "u", "comp", side.alias("side"))


def _least(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def _need(n: Column) -> Column:
    return F.least(F.floor(n / 16) + 1, _least(n))


def _reached() -> Column:
    """Can a pair with ``c`` common merged lists link?

    What two sets share and neither has beyond its merged lists is in ``c``; so
    they share ``c`` and what one of them skips, n - prefix = T - need, at most.
    """
    na, nb = F.col("na"), F.col("nb")
    skipped = F.greatest(_least(na) - _need(na), _least(nb) - _need(nb))
    return (100 + PERCENT) * (F.col("c") + skipped) >= PERCENT * (na + nb)


# Probes


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    slices = (x.slice(k, 500) for x in batches for k in range(0, x.num_rows, 500))
    for batch in slices:
        a, b, texts_a, texts_b = (batch.column(k) for k in range(4))
        sig = np.concatenate((np.asarray(a), np.asarray(b)))
        ids, first, which = np.unique(sig, return_index=True, return_inverse=True)
        both = pa.concat_arrays([texts_a, texts_b]).take(pa.array(first))
        sets = []
        for start, stop in runs(both):
            shingles, offsets = shingle_sets(both.slice(start, stop - start))
            sets += [shingles[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        links = []
        for x, y in zip(which[: len(a)], which[len(a) :], strict=True):
            few, many = sorted((sets[x], sets[y]), key=len)
            at = np.searchsorted(many, few)
            at[at == len(many)] = 0
            common = int((many[at] == few).sum())
            links.append(100 * common >= PERCENT * (len(few) + len(many) - common))
        keep = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def _texts_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, text`` for the signatures in ``wanted``: the text of the smallest id."""
    chosen = materialize(sets.join(wanted, "sig", "left_semi").select("sig", "rep"))
    ids = chosen.select(F.col("rep").alias("doc_id"), "sig")
    if chosen.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.select("doc_id", "text").join(ids, "doc_id")

    def run(batches):
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                own = _signatures(*shingle_sets(part.column("text")))
                yield part.filter(pa.array(own == np.asarray(part.column("sig"))))

    # Ids may repeat; only the text that has the signature counts.
    exact = found.select("sig", "text").mapInArrow(run, "sig long, text string")
    return materialize(exact.groupBy("sig").agg(F.min("text").alias("text")))


def _probe(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs ``a, b`` of signatures, those that link.

    Texts are fetched only for pairs whose sketches are near enough.
    """
    of = sets.select("sig", "n", "sketch")
    known = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b")
    pairs = materialize(known.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near_rows, "a long, b long"))
    either = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig")))
    texts = _texts_of(docs, sets, either.distinct())
    joined = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_probe_rows, "a long, b long")


# The join


def _by_documents(links: DataFrame, sets: DataFrame) -> DataFrame:
    rep = sets.select("sig", "rep")
    named = links.join(rep.withColumnsRenamed({"sig": "a", "rep": "ra"}), "a")
    named = named.join(rep.withColumnsRenamed({"sig": "b", "rep": "rb"}), "b")
    return named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def jaccard_join(docs: DataFrame, block: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``texts, sets, links`` of ``docs`` (``doc_id, text``).

    ``texts``: ``doc_id, text_hash, sig, n``, one row per row of ``docs``.  ``sets``:
    ``sig, rep, copies``, one per different set, with its smallest doc_id.  ``links``:
    ``a, b``, pairs of representatives that link; pairs within a group that is
    connected by others may be missing.  Null and wordless texts have the signature 0
    and no row in ``sets``; so have rows without a doc_id.
    """
    texts, sets, links = _linked_sets(docs, block)
    sets = sets.select("sig", "rep", "copies")
    return texts, sets, _by_documents(links, sets)


def _linked_sets(docs: DataFrame, block: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with links between signatures."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    kinds = "doc_id long, text_hash long, sig long, n long, hot long, sketch binary"
    rows = materialize(hashed.mapInArrow(_signature_rows, kinds))
    texts = rows.where("hot is null").select("doc_id", "text_hash", "sig", "n")
    known = rows.where("hot is null and sig <> 0 and doc_id is not null")
    sets = known.groupBy("sig").agg(
        F.min("doc_id").alias("rep"),
        F.count("*").alias("copies"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    sets = materialize(sets)
    hot = rows.where("hot is not null").select("hot").distinct().toPandas()["hot"]
    hot = np.sort(hot.to_numpy(np.int64).view(np.uint64))

    postings = docs.where("doc_id is not null").mapInArrow(
        _posting_rows(hot), "shingle long, sig long, n int"
    )
    # A list, in one window: lists of one set go, and repetitions of a member.
    whole = "over (partition by shingle order by sig rows between unbounded preceding and unbounded following)"
    lists = postings.select(
        "shingle",
        "sig",
        "n",
        F.expr(f"first(sig) {whole} <> last(sig) {whole}").alias("shared"),
        F.expr("lag(sig) over (partition by shingle order by sig)").alias("before"),
    )
    lists = lists.where("shared and (before is null or before <> sig)").select("shingle", "sig", "n")
    lists = materialize(lists)
    alive = lists.groupBy("sig").agg(F.count("*").alias("k"), F.max("n").alias("size"))
    smallest = _least(F.col("size"))
    alive = alive.where(F.col("k") >= _need(smallest)).select(
        F.col("sig").alias("s"),
        (F.col("k") + smallest - _need(F.col("size"))).cast("int").alias("u"),
    )
    lists = lists.join(alive, F.col("sig") == F.col("s")).select("shingle", "sig", "n", "u")
    lists = lists.withColumn("m", F.count("*").over(Window.partitionBy("shingle"))).where("m > 1")
    lists = materialize(lists)

    short = lists.where(F.col("m") <= LONG).select(
        F.lit(0).alias("part"),
        F.col("shingle").alias("key"),
        "sig",
        "n",
        "u",
        F.col("sig").alias("comp"),
        F.lit(2).alias("side"),
    )
    short = materialize(_merge(short))
    long_lists = lists.where(F.col("m") > LONG)
    by_share = Window.partitionBy("shingle").orderBy(F.desc(F.col("u") / F.col("n")), "sig")
    by_share = by_share.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hubs = [F.nth_value(F.struct("sig", "n"), k).over(by_share) for k in range(1, HUBS + 1)]
    near = long_lists.select("sig", "n", F.array(*hubs).alias("hubs"))
    near = near.select("sig", "n", F.explode("hubs").alias("x")).where("sig <> x.sig")
    near = near.groupBy(
        F.least("sig", "x.sig").alias("a"), F.greatest("sig", "x.sig").alias("b")
    ).agg(F.max("n").alias("na"), F.max("x.n").alias("nb"), F.count("*").alias("c"))
    tried = short.unionByName(near).where(_reached()).select("a", "b").distinct()
    tried = materialize(tried)
    links = materialize(_probe(docs, sets, tried))
    if long_lists.isEmpty():
        return texts, sets, links

    joined = sets.join(components(links), F.col("sig") == F.col("node"), "left")
    joined = joined.select("sig", F.coalesce("component", "sig").alias("comp"))
    named = long_lists.join(joined, "sig")
    mixed = named.groupBy("shingle").agg(
        F.min("comp").alias("x"),
        F.max("comp").alias("y"),
        F.max("m").alias("most"),
        F.max_by("comp", F.struct(F.col("u") / F.col("n"), "sig")).alias("hub"),
    )
    # As many blocks for all lists of a hub, so that a member is always in the same.
    most = F.max("most").over(Window.partitionBy("hub")).alias("most")
    mixed = mixed.where("x <> y").select("shingle", "hub", most)
    apart = _merge(_tiles(named.join(mixed, "shingle"), block), check=True)
    earlier = short.select("a", "b", F.col("c").alias("more"))
    apart = apart.join(earlier, ["a", "b"], "left")
    apart = apart.withColumn("c", F.col("c") + F.coalesce("more", F.lit(0)))
    apart = apart.where(_reached()).select("a", "b").join(tried, ["a", "b"], "left_anti")
    apart = materialize(apart)
    more = materialize(_probe(docs, sets, apart))
    return texts, sets, links.unionAll(more)


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``s, comp, component_id``: a signature's component, and the smallest doc_id in it."""
    joined = sets.join(components(links), F.col("sig") == F.col("node"), "left")
    joined = joined.select("sig", "rep", F.coalesce("component", "sig").alias("comp"))
    least = joined.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("component_id"))
    return joined.join(least, F.col("comp") == F.col("c")).select(F.col("sig").alias("s"), "comp", "component_id")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links lead to.  A null or
    wordless text has 0 shingles and is alone; so is a row without doc_id, whose
    component is null.  Equal texts, and repeated rows, are in one component.
    """
    texts, sets, links = _linked_sets(docs)
    labels = _labels(sets, links)
    alone = (F.col("sig") == 0) | F.col("doc_id").isNull()
    single = texts.where(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    rest = texts.where(~alone).join(labels, F.col("sig") == F.col("s"))
    return rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(single)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row, all columns, of every group of near copies: that with the smallest doc_id.

    Rows are told by doc_id and text.  Of rows that are equal in both, the one whose
    other columns are smallest stays.  Rows without a doc_id belong to the group of
    documents with the same set of shingles, if there is one, else to one of their
    own.  Null and wordless texts stay.
    """
    texts, sets, links = _linked_sets(docs)
    keys = texts.where("sig <> 0").groupBy("doc_id", "text_hash", "sig").agg(F.count("*").alias("rows"))
    keys = keys.join(_labels(sets, links), F.col("sig") == F.col("s"), "left")
    # Where no document has the set, the set itself is the group.
    keys = materialize(keys.select("doc_id", "text_hash", "rows", F.coalesce("comp", "sig").alias("g")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    judged = keys.join(keys.groupBy("g").agg(F.min(order).alias("first")), "g")
    stays = order.eqNullSafe(F.col("first"))
    marked = judged.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "rows", stays.alias("_stays")
    )
    marked = materialize(marked.where("not _stays or rows > 1").drop("rows"))
    repeated = marked.where("_stays").count()
    few = marked if marked.count() > BROADCAST_IDS else F.broadcast(marked)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (
        F.xxhash64(docs["text"].cast("string")) == F.col("_hash")
    )
    joined = docs.join(few, same, "left")
    kept = joined.where("_stays is null").select(*docs.columns)
    if not repeated:
        return kept
    again = joined.where("_stays").groupBy("_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.unionAll(again.select(*[F.col(f"row.{c}") for c in docs.columns]))
