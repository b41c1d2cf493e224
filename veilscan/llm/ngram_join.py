"""N-gram Jaccard self-join by a grouped prefix join, ending in connected components.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two
documents link when 100 * |x & y| >= threshold * |x | y|.

1. One scan gives each document's set size and set signature, and a fixed-size
   sketch of shingle frequencies (2^20 counters, whatever the input).
2. A second scan orders each set by (sketched frequency, hash), rarest first.
   This is one global order, so two linked sets share a shingle among their
   first n - ceil(t*n) + 1: the prefix. Documents with identical prefix and
   size collapse into one group.
3. Prefix postings of the groups are dealt by shingle. The postings of every
   shingle that the sketch does not rule out are counted exactly; a list of more
   than HOT of them is dealt over several salted blocks. Consecutive groups of a
   list are first candidates; pairs that survive the size and position filters
   are expanded to members and verified on whole sets, and joined to components.
4. Lists that still hold several components give all their remaining cross
   pairs (block against block where salted, and only between size bands that can
   link), filtered, expanded and verified. A pair inside one component needs no
   check: it cannot change a component.

No list, group or component is ever held by one task or the driver: lists are
streamed, pairs and components stay in DataFrames.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, release
from .textbatch import column_bytes, mix64, shingle_sets, slices

SKETCH_BITS = 20
CHUNK = 1 << 14
#: Postings of a list, or of a block of one, at any size of input.
HOT = 10_000
MOST_BLOCKS = 1 << 14
#: Lists of several blocks are broadcast up to so many (16 MB), joined by a shuffle beyond.
BROADCAST_LISTS = 1_000_000
FILTER_SLOTS = 1_048_573
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
_PARITY = [f"k{i}" for i in range(SKETCH_WORDS)]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _batches(frames: Iterator[pa.RecordBatch]):
    """(doc ids, sets) for row ranges of bounded bytes."""
    for batch in frames:
        raw, off = column_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in slices(off):
            yield ids.slice(i, j - i), shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i])


def _signature(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _parity(s: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of the set's shingles fall into slot i. The xor of two sets' bits shows their difference alone."""
    slots = 64 * SKETCH_WORDS
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for ids, sets in _batches(frames):
        counts += np.bincount(_bucket(np.concatenate(sets)), minlength=1 << SKETCH_BITS) if sets else 0
        k = len(sets)
        yield pa.record_batch([ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_SCAN)
    used = [c for c in range(len(counts) // CHUNK) if counts[c * CHUNK:(c + 1) * CHUNK].any()]
    part = [np.minimum(counts[c * CHUNK:(c + 1) * CHUNK], 2**31 - 1).astype(np.int32).tobytes() for c in used]
    k = len(used)
    yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(used, pa.int32()), pa.array([pa.compress(p, "zstd", asbytes=True) for p in part], pa.binary())], schema=_SCAN)


def _add_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums sketch chunks as they stream by; holds at most the whole fixed-size sketch."""
    total: dict[int, np.ndarray] = {}
    for batch in frames:
        for c, z in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(pa.decompress(z, CHUNK * 4, "zstd", asbytes=True), np.int32)
            total[c] = total.get(c, 0) + part.astype(np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def _prefixes(level: np.ndarray, percent: int):
    """Scan 2: each set's prefix in the order of the sketch's frequency levels, then of the hashes."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("gkey", pa.binary()), ("prefix", pa.list_(pa.int64())), *((k, pa.int64()) for k in _PARITY)])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(frames):
            keep = [i for i, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            toks, gkeys, ends, sigs = [], [], [0], []
            for i in keep:
                s = sets[i]
                p = len(s) - -(-percent * len(s) // 100) + 1
                x = s[np.argsort(level[_bucket(s)], kind="stable")[:p]]
                toks.append(x)
                gkeys.append(hashlib.blake2b(x.tobytes(), digest_size=16, salt=len(s).to_bytes(8, "little")).digest())
                ends.append(ends[-1] + p)
                sigs.append(_signature(s))
            cells = pa.array(np.concatenate(toks).view(np.int64))
            parity = np.stack([_parity(sets[i]) for i in keep])
            yield pa.record_batch([ids.take(pa.array(keep)).cast(pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array(sigs, pa.binary()), pa.array(gkeys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells), *(pa.array(c) for c in parity.T)], schema=out)

    return run


def _suspects(possible: np.ndarray):
    """groups(prefix) -> the prefix shingles whose bucket of the sketch holds more than a block; all others have shorter lists."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            t = batch.column("prefix").flatten().to_numpy()
            yield pa.record_batch([pa.array(t[possible[_bucket(t.view(np.uint64))]])], names=["t"])

    return run


def _postings(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """groups(gid, n, prefix) -> one row per prefix shingle; ``np`` packs (n << 32) + place."""
    for batch in frames:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            prefix = part.column("prefix")
            sizes = np.diff(prefix.offsets.to_numpy())
            t = prefix.flatten()
            gid = np.repeat(part.column("gid").to_numpy(), sizes)
            place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch([t, pa.array(gid), pa.array((np.repeat(part.column("n").to_numpy(), sizes) << 32) + place)], names=["t", "gid", "np"])


def _lists(percent: int):
    """Rows sorted by (t, blk): those that share their list, each with the next group of its list. Holds two rows.

    The two groups of an unsalted list of two go at once if the size and
    position filters refuse them.
    """
    names = ["t", "blk", "gid", "np", "next_gid", "next_np"]

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m, p, q = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
        return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * (1 + np.minimum(n - p - 1, m - q - 1)) >= percent * (n + m))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        same = [False, False]  # whether the two rows before the first held one share a list, and the later of them its list
        fits = False  # whether the row before the first held one and that one may link

        def blocks() -> Iterator[np.ndarray]:
            for batch in frames:
                yield np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names[:4]])
            yield np.array([[0, 0], [-1, -2], [0, 0], [0, 0]], np.int64)  # two rows of no list push out the last ones

        for block in blocks():
            rows = np.concatenate([held, block], 1)
            k = rows.shape[1] - 2
            if k < 1:
                held = rows
                continue
            near = np.concatenate([same, (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])])
            before2, before, after, after2 = near[:k], near[1:k + 1], near[2:k + 2], near[3:k + 3]
            after2 = np.concatenate([after2, np.zeros(k - len(after2), bool)])
            ok = allowed(rows[3, :-1], rows[3, 1:])
            refused = (~before & after & ~after2 & ~ok[:k]) | (~before2 & before & ~after & ~np.concatenate([[fits], ok[:k - 1]]))
            keep = (rows[1, :k] >> 16 > 1) | ((before | after) & ~refused)
            nxt, dead = rows[:, 1:k + 1][:, keep], ~after[keep]
            yield pa.record_batch([pa.array(c) for c in rows[:, :k][:, keep]] + [pa.array(c, mask=dead) for c in nxt[2:]], names=names)
            same, fits, held = [bool(near[k]), bool(near[k + 1])], bool(ok[k - 1]), rows[:, k:]

    return run


def _packed(s: np.ndarray) -> bytes:
    """A whole set in about 5 bytes a shingle: the top 48 bits of each hash, as byte planes of the gaps between them."""
    gaps = np.diff(s >> np.uint64(16), prepend=np.uint64(0)).astype("<u8")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 6 * n, "zstd", asbytes=True), np.uint8).reshape(6, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _holds(slots: np.ndarray):
    """Scan 3: whole sets of the documents whose id may be wanted."""
    out = pa.schema([("id", pa.int64()), ("m", pa.int64()), ("shingles", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            want = known & slots[ids.fill_null(0).to_numpy(zero_copy_only=False) % FILTER_SLOTS]
            for part, sets in _batches(iter([batch.filter(pa.array(want))])):
                some = [i for i, s in enumerate(sets) if len(s)]
                yield pa.record_batch([part.take(pa.array(some, pa.int64())).cast(pa.int64()), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([_packed(sets[i]) for i in some], pa.binary())], schema=out)

    return run


def _small_batches(frames: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _verify(percent: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(frames):
            keep = []
            for x, m, y, n in zip(*(batch.column(c).to_pylist() for c in ("x", "mx", "y", "my"))):
                x, y = sorted((_unpacked(x, m), _unpacked(y, n)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _filter_sql(percent: int, x: str, y: str) -> str:
    """Size and position filters on packed (n << 32) + place: enough can still be shared after these places of a common shingle."""
    n1, n2, p1, p2 = f"({x} >> 32)", f"({y} >> 32)", f"({x} & 4294967295)", f"({y} & 4294967295)"
    return (f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND "
            f"{100 + percent} * (1 + least({n1} - {p1} - 1, {n2} - {p2} - 1)) >= {percent} * ({n1} + {n2})")


class JaccardJoin:
    """The join over documents(doc_id, text, ...); other columns are not read."""

    def __init__(self, docs: DataFrame, percent: int = 80) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark: SparkSession = docs.sparkSession
        self.percent = percent

    def _frequency(self, scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Per bucket: frequency level (an order), and whether a list of its shingles may be longer than a block."""
        parts = scan.where("chunk is not null").select("chunk", "counts")
        mid = parts.repartition(16, "chunk", F.spark_partition_id() % 64).mapInArrow(_narrow_counts, "chunk int, counts binary")
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for c, z in mid.repartition(8, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect():  # the sketch: 8 MB, always
            total[c * CHUNK:(c + 1) * CHUNK] += np.frombuffer(z, np.int64)
        return np.minimum(np.log2(total + 1.0) * 6, 255).astype(np.uint8), total > HOT

    def _dealt(self, groups: DataFrame, possible: np.ndarray) -> DataFrame:
        """Postings of the groups with ``blk``, which packs (blocks of the list << 16) + the posting's block."""
        counted = groups.select("prefix").mapInArrow(_suspects(possible), "t long").groupBy("t").agg(F.count("*").alias("size"))
        blocks = F.least(F.ceil(F.col("size") / HOT), F.lit(MOST_BLOCKS)).cast("int").alias("blocks")
        hot = cut(counted.where(F.col("size") > HOT).select("t", blocks))
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_LISTS else hot
        postings = groups.select("gid", "n", "prefix").mapInArrow(_postings, "t long, gid long, np long").join(hot, "t", "left")
        blk = "(coalesce(blocks, 1) << 16) + cast(pmod(xxhash64(gid, t, 'block'), coalesce(blocks, 1)) as int)"
        return postings.select("t", F.expr(blk).alias("blk"), "gid", "np")

    def _near(self, x: str, y: str, n1: str, n2: str) -> str:
        """The parity sketches allow a link: their differing bits are no more than the sets may differ."""
        apart = " + ".join(f"bit_count({x}{k} ^ {y}{k})" for k in range(SKETCH_WORDS))
        return f"{100 + self.percent} * ({apart}) <= {100 - self.percent} * ({n1} + {n2})"

    def _band(self) -> float:
        """Width of a size band in ln(n), a little over what the sizes of linked sets may differ by, for the sake of rounding."""
        return 1.000001 * max(math.log(100 / self.percent), 1e-3)

    def _linked(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs(a, b) of document ids, those whose whole sets link; the sketches of classes go first."""
        side = lambda key, v: classes.select(F.col("cid").alias(key), F.col("n").alias(f"n_{v}"), *[F.col(k).alias(f"{v}{i}") for i, k in enumerate(_PARITY)])
        close = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(self._near("x", "y", "n_x", "n_y"))
        pairs = cut(close.select("a", "b").distinct())
        ids = pairs.select("a").union(pairs.select(F.col("b").alias("a")))
        slots = np.zeros(FILTER_SLOTS, bool)
        bits = ids.select(F.expr(f"pmod(a, {FILTER_SLOTS})").alias("k")).groupBy(F.expr("k div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 32 as int)))").alias("m"))
        for w, m in bits.collect():  # a bitmap of fixed size
            slots[[w * 32 + i for i in range(32) if m >> i & 1]] = True
        # the filter lets a few more through; the joins drop them
        sets = cut(self.docs.mapInArrow(_holds(slots), "id long, m long, shingles binary"))
        release(self.spark)
        side = lambda key, v: sets.select(F.col("id").alias(key), F.col("m").alias(f"m{v}"), F.col("shingles").alias(v))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "mx", "y", "my").mapInArrow(_verify(self.percent), "a long, b long")

    def result(self) -> DataFrame:
        scan = cut(self.docs.mapInArrow(_scan, "doc_id long, n long, sig binary, chunk int, counts binary"))
        level, possible = self._frequency(scan)
        rows = scan.where("chunk is null").select("doc_id", "n", "sig")
        # read twice: the prefixes once for the groups, without them for the classes
        prefixed = self.docs.where("doc_id is not null").mapInArrow(_prefixes(level, self.percent), "doc_id long, n long, sig binary, gkey binary, prefix array<bigint>, " + ", ".join(f"{k} long" for k in _PARITY))
        groups = cut(prefixed.groupBy("gkey").agg(F.min("doc_id").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix")).drop("gkey"))
        release(self.spark)
        spread = self._dealt(groups, possible).repartition("t", "blk").sortWithinPartitions("t", "blk", F.xxhash64("t", "gid"))
        lists = cut(spread.mapInArrow(_lists(self.percent), "t long, blk long, gid long, np long, next_gid long, next_np long"))
        release(self.spark)

        classes = cut(prefixed.groupBy("gkey", "sig").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in _PARITY]))
        shared = classes.groupBy("gkey").agg(F.min("cid").alias("gid"), F.count("*").alias("members")).where("members > 1").select("gkey", "gid")
        members = cut(classes.join(shared, "gkey").select("gid", "cid"))

        near = lists.where("next_gid is not null").where(_filter_sql(self.percent, "np", "next_np"))
        first = near.select(F.least("gid", "next_gid").alias("a"), F.greatest("gid", "next_gid").alias("b"))
        inside = members.where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
        links = self._linked(first.union(inside).where("a <> b").distinct(), classes)
        part = cut(components(links))
        release(self.spark)

        comp = lambda df, key: df.join(part.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", F.col(key)))
        # members of a group, as one list; groups of one need no row
        own = comp(members, "cid")
        seated = comp(lists.select("t", "blk", "gid", "np"), "gid")
        spans = own.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        seated = seated.join(spans, "gid", "left").withColumn("many", F.col("lo").isNotNull())
        seated = seated.withColumn("lo", F.least(F.coalesce("lo", "component"), "component")).withColumn("hi", F.greatest(F.coalesce("hi", "component"), "component"))
        # a list of two has had its only pair verified
        open_ = seated.groupBy("t").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("c"), F.max("blk").alias("b"), F.max("many").alias("many"))
        open_ = open_.where("l <> h and (c > 2 or (b >> 16) > 1 or many)").select("t")
        shapes = classes.groupBy(F.col("cid").alias("gid")).agg((F.count("*") > 1).alias("twice"), *[F.first(k).alias(k) for k in _PARITY])
        rest = seated.join(open_, "t", "left_semi").join(shapes, "gid")
        rest = cut(rest.withColumn("many", F.col("many") | F.col("twice")).drop("twice"))  # no one sketch stands for these
        release(self.spark)
        dealt = rest.withColumn("j", F.explode(F.expr("sequence(0L, (blk >> 16) - 1)"))).withColumn("s", F.expr("blk & 65535")).withColumn("u", F.least("s", "j")).withColumn("v", F.greatest("s", "j"))
        # sets that link are of one size band or of neighbouring ones
        dealt = dealt.withColumn("band", F.expr(f"cast(floor(ln(np >> 32) / {self._band()!r}) as int)"))
        cols = ["gid", "np", "lo", "hi", "many", "band", *_PARITY]
        left = dealt.where("s = u").withColumn("w", F.explode(F.expr("if(u = v, array(band, band + 1), array(band - 1, band, band + 1))")))
        left = left.select("t", "u", "v", "w", *[F.col(c).alias(f"{c}1") for c in cols])
        right = dealt.where("s = v").select("t", "u", "v", F.col("band").alias("w"), *[F.col(c).alias(f"{c}2") for c in cols])
        near = " + ".join(f"bit_count({k}1 ^ {k}2)" for k in _PARITY)
        near = f"{100 + self.percent} * ({near}) <= {100 - self.percent} * ((np1 >> 32) + (np2 >> 32))"  # of groups with one member
        pairs = left.join(right, ["t", "u", "v", "w"]).where(f"(many1 or many2 or {near}) and (u < v or band1 < band2 or gid1 < gid2) and gid1 <> gid2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").where(_filter_sql(self.percent, "np1", "np2"))
        pairs = cut(pairs.select(F.least("gid1", "gid2").alias("g"), F.greatest("gid1", "gid2").alias("h")).distinct())
        release(self.spark)
        # expand groups to members; inside a group of several components, its members meet too
        inner = spans.where("lo <> hi").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
        pairs = pairs.union(inner)
        full = own.select("gid", "cid", "component")
        side = lambda df, key, out: df.join(full.select(F.col("gid").alias(key), F.col("cid").alias(f"{out}_m"), F.col("component").alias(f"{out}_c")), key, "left").withColumn(out, F.coalesce(f"{out}_m", F.col(key)))
        lone = part.select(F.col("node"), F.col("component").alias("c"))
        wide = side(side(pairs, "g", "a"), "h", "b").where("a <> b")
        for out in ("a", "b"):
            wide = wide.join(lone.withColumnRenamed("node", out), out, "left").withColumn(f"{out}_c", F.coalesce("c", F.col(out))).drop("c")
        wide = wide.where("a_c <> b_c").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = self._linked(wide, classes)

        whole = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        release(self.spark)
        named = classes.select("sig", "cid").join(whole.withColumnRenamed("node", "cid"), "cid", "left").select("sig", F.coalesce("component", "cid").alias("component"))
        # documents without words take no part in the join: their null would be one key
        seated = rows.where("sig is not null").join(named, "sig", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
        alone = rows.where("sig is null").select("doc_id", "n", F.col("doc_id").alias("component"))
        return seated.unionByName(alone).toDF("doc_id", "n_shingles", "component_id")


def _narrow_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First of two levels of the sketch sum: many tasks' chunks to one compressed chunk each."""
    for batch in _add_counts(frames):
        small = [pa.compress(np.minimum(np.frombuffer(z, np.int64), 2**31 - 1).astype(np.int32).tobytes(), "zstd", asbytes=True) for z in batch.column("counts").to_pylist()]
        yield pa.record_batch([batch.column("chunk"), pa.array(small, pa.binary())], names=["chunk", "counts"])


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Text null or without words: n_shingles 0 and its own component. Rows that
    repeat a doc_id count as one document that holds all their texts. A null
    doc_id stays a row of its own with a null component unless its set equals
    another document's. Ties and copies need no order: ids are minima. Extra
    columns are ignored.
    """
    return JaccardJoin(docs, percent).result()
