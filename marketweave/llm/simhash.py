"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 (seed 42) of a
text's word shingles. Two fingerprints link at ``radius`` or fewer differing bits;
linked documents form components.

Pigeonring: cut the ring of 64 bits into SEGMENTS equal segments. If the whole ring
differs in at most ``radius`` bits, some starting segment exists from which every
chain of consecutive segments (of length 1, 2, ... round the ring) differs in at most
its proportional budget, floor(length * radius / SEGMENTS). With 16 segments and
radius 2 the first seven budgets are zero, so such a pair agrees exactly on seven
consecutive segments (28 bits): that is the join key, once for each of the 16 starts.
Candidates of a key must then meet the budgets of the longer chains, and only those
that do are put to the full Hamming test.

Hot keys: where more than ``bucket`` distinct fingerprints share a key, they are not
paired. Two fingerprints are within two bits exactly if flipping at most one bit of
each gives a common value; so those fingerprints send their 65 values as hubs, and each
hub (which at most 65 fingerprints can reach) links its fingerprints to the
smallest one. That way is exact, linear in the group's size, and drops nothing.
(For another radius than 2, hot keys are dealt by longer exact keys plus pairs.)

Exact copies share a fingerprint and are reduced to it by map-side combining before
any pairing. Components come from alternating large-star and small-star steps over
the links, each written to the shared folder; nothing is gathered on the driver.

Defined cases: null and empty texts have fingerprint 0, linked like any other; a
document with fewer words than a shingle is one shingle; repeated rows each get a
row; rows with a null doc_id take part but never name a component; an empty table
gives an empty result. Columns other than id and text are not read.

Similarity of shingle sets (``similar_groups``, ``keep_one``): five-word shingles and a Jaccard
similarity of 0.8 or more. Such sets differ in up to 15 % of the bits of a fingerprint, far
beyond two of 64, so the same method runs on a wide fingerprint: many rings of 64 bits, each
cut into segments whose length follows the number of rows, as many as the wanted recall
asks for (``layout``). A pair is a candidate if it agrees on a whole segment, it must then
keep within the proportional budgets (RATIO of the bits) of the longer chains round that ring, then
of the whole fingerprint, and last the shingle sets themselves are compared. So
all links are true ones; a pair is missed only if no segment agrees.

There each segment's sets are first linked to their smallest one (a star, not all
pairs; a set's stars are compared by their shingles nearest first, in rounds, so that most need no comparison), which joins nearly every
large group. Only what is then in another component than the most frequent one of its segment is compared with all of the
segment's other members, in blocks where they are many, so that no pair of a large group becomes a row. (Among texts that are
all just below the similarity, these comparisons grow with the square of their number.) Texts without words are one set; texts that differ in
white space or case only are equal; ids may repeat, rows are told apart by id and text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from marketweave.llm.common import discard, lower_words, short_batches, stored, table

BITS = 64
RADIUS = 2
SEGMENTS = 16
BUCKET = 64
SHINGLE = 3
SEED = 42
BLOCK = 65_536

WORDS = 5
SIMILARITY = 0.8
MISS = 0.05  # chance that a pair at the very similarity shares no segment
RATIO = 0.25  # of a chain's bits may differ: well above what similar sets differ in, well below a half
LEAST_SEGMENT, MOST_SEGMENT = 12, 40
FEW_SHINGLES = 64  # below so many, a set's bits stray too far from their chances for a closer limit than RATIO
BROADCAST_BYTES = 64 << 20
STAR_ROUNDS = 2  # in which each set's nearest star is compared, before other pairs of a segment are looked at
PAIRED = 32  # sets under one segment up to which those left apart are compared as rows, else in blocks
BLOCK_SETS = 256
SIZE_STEPS = 8  # of a set's size, as a segment's row holds it, to the factor 1 / similarity
BATCH_BYTES = 2 << 20  # of texts in an Arrow batch, as the JVM and the Python worker both hold it whole


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text; memory is bounded by BLOCK shingles."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def _rotated(col: Column, by: int) -> Column:
    return col if by == 0 else F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, BITS - by))


def _budgets(radius: int, segments: int) -> list[int]:
    return [(n * radius) // segments for n in range(1, segments + 1)]


def chain_viable(a: Column, b: Column, start: Column, radius: int = RADIUS, segments: int = SEGMENTS) -> Column:
    """True if every chain from segment ``start`` keeps within its proportional budget.

    Only the longest chain of each budget needs a test: shorter ones with the same
    budget follow from it.
    """
    width, budgets = BITS // segments, _budgets(radius, segments)
    diff = a.bitwiseXOR(b)
    ring = reduce(lambda acc, s: acc.when(start == s, _rotated(diff, (BITS - s * width) % BITS)), range(1, segments), F.when(start == 0, diff))
    tests = []
    for n, budget in enumerate(budgets, 1):
        if n < segments and budgets[n] == budget or n == segments:
            continue
        mask = (1 << (n * width)) - 1
        tests.append(F.bit_count(ring.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))) <= budget)
    return reduce(lambda x, y: x & y, tests) if tests else F.lit(True)


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Rows (u, v), u < v, over distinct fingerprints ``fp``; every linked pair is connected by them.

    Pairs of small buckets are given in full; those of hot buckets through hubs.
    """
    if radius != RADIUS or BITS % segments:
        raise ValueError("links() is exact for radius 2 and a number of segments that divides 64")
    width = BITS // segments
    exact = sum(1 for b in _budgets(radius, segments) if b == 0) * width
    mask = F.lit((1 << exact) - 1)
    keys = F.array(
        *[
            F.struct(F.lit(s).alias("start"), _rotated(F.col("fp"), (BITS - s * width) % BITS).bitwiseAND(mask).alias("bits"))
            for s in range(segments)
        ]
    )
    keyed = fps.select("fp", F.inline(keys).alias("start", "bits"))
    sizes = keyed.groupBy("start", "bits").agg(F.count("*").alias("size")).where("size > 1")
    sized = stored(keyed.join(sizes, ["start", "bits"]), "simhash-keys")
    small = sized.where(F.col("size") <= bucket)
    a = small.select("start", "bits", F.col("fp").alias("u"))
    b = small.select("start", "bits", F.col("fp").alias("v"))
    pairs = (
        a.join(b, ["start", "bits"])
        .where((F.col("u") < F.col("v")) & chain_viable(F.col("u"), F.col("v"), F.col("start"), radius, segments))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
        .select("u", "v")
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(BITS)])
    hubs = sized.where(F.col("size") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("hub", "u")
    through = hubs.join(least, "hub").where("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(through).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable; nodes without an edge have no row."""
    current = stored(edges.select("u", "v"), "simhash-links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    seen = state(current)
    if not seen[0]:
        return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
        before, current = current, stored(small.select("e.*").where("u <> v").distinct(), "simhash-links")
        discard(before)
        now = state(current)
        if now == seen:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "simhash-prints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps.select("fp")))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets ----------------------------------------------


class Layout(NamedTuple):
    """A wide fingerprint: ``words`` rings of 64 bits, each with ``per`` segments of ``bits`` bits."""

    bits: int
    per: int
    words: int
    similarity: float

    def farthest(self) -> tuple[int, int]:
        """Differing bits of similar sets: at most so many for small sets; and for others (3 deviations above the mean)."""
        most, size = int(RATIO * BITS * self.words), BITS * self.words
        differ = 1 - agreement(self.similarity)
        return most, min(most, math.ceil(size * differ + 3 * math.sqrt(size * differ * (1 - differ))))


def agreement(similarity: float) -> float:
    """The least chance that a bit agrees for sets of a Jaccard similarity: their cosine is 2 s / (1 + s) at least."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(rows: int, similarity: float = SIMILARITY, miss: float = MISS) -> Layout:
    """Segments as long as log2 of the rows, so that unlike texts meet about once; as many of them as ``miss`` asks for.

    A segment agrees with the chance of a bit to the power of its bits.
    """
    agree = agreement(similarity)
    bits = min(MOST_SEGMENT, max(LEAST_SEGMENT, math.ceil(math.log2(max(rows, 2)))))
    segments = math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    return Layout(bits, BITS // bits, math.ceil(segments / (BITS // bits)), similarity)


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none give no shingle."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed(out + _MIX[0] + hashes[k : k + n])
    return np.unique(out)


def wide_fingerprint(grams: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 majority bits of the set, from as many independent hashes of each shingle."""
    ones, seeds = np.zeros(words * BITS, np.int64), np.arange(1, words + 1, dtype=np.uint64) * _MIX[0]
    for at in range(0, len(grams), 255):  # so many rows of bits fit a sum of bytes
        bits = np.unpackbits(_mixed(grams[at : at + 255, None] ^ seeds).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, shape: Layout, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS) -> DataFrame:
    """Rows (doc_id, mark, sid, n, fp): the text's hash, its shingle set's hash and size, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sids, sizes, prints = [], [], []
                for t in batch.column(2):
                    grams = shingle_set(t.as_py(), shingle)
                    sids.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                    sizes.append(len(grams))
                    prints.append(wide_fingerprint(grams, shape.words))
                columns = [batch.column(0), batch.column(1), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "sid", "n", "fp"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), text_mark(text).alias("mark"), F.col(text).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, mark long, sid long, n long, fp array<long>")


def _grams(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """Rows (sid, grams): the shingle sets of the rows (sid, doc_id, mark) wanted, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                grams = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["sid", "grams"])

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").cast("binary").alias("text"), text_mark(text).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))
    found = texts.join(_small(wanted, "doc_id"), same).select("sid", "text").mapInArrow(run, "sid long, grams array<long>")
    return found.groupBy("sid").agg(F.first("grams").alias("grams"))  # equal rows give equal sets


def _small(rows: DataFrame, doc_id: str) -> DataFrame:
    """The stored rows, to be broadcast if they are within BROADCAST_BYTES."""
    size = rows.agg(F.sum(F.octet_length(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) + 48)).first()[0]
    return F.broadcast(rows) if (size or 0) <= BROADCAST_BYTES else rows


def text_mark(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _within_ring(a: Column, b: Column, shape: Layout) -> Column:
    """Whether words of ``_segments`` may be of similar sets: sizes and, round the ring from the segment, the chains of each length allow it."""
    low, diff = F.lit((1 << shape.bits) - 1), a.bitwiseXOR(b)
    out = F.abs(a.bitwiseAND(low) - b.bitwiseAND(low)) <= SIZE_STEPS + 1
    for length in range(2, shape.per + 1):
        mask = (1 << shape.bits * length) - (1 << shape.bits)
        out = out & (F.bit_count(diff.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))) <= int(RATIO * shape.bits * length))
    return out


def _segments(sets: DataFrame, shape: Layout) -> DataFrame:
    """Rows (key, sid, word): each set under each segment of its fingerprint.

    word: the segment's ring, turned so that the segment comes first. As the key has the segment's own bits, the set's size
    takes their place, in steps of which SIZE_STEPS are the factor 1 / similarity; so unlike sizes part before whole fingerprints are fetched.
    """
    own, ring = (1 << shape.bits) - 1, (1 << shape.bits * shape.per) - 1
    step = max(-math.log(shape.similarity), 0.05) / SIZE_STEPS  # a longer step only lets more pass, and so does the largest size
    size = F.least(F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / step).cast("long"), F.lit(own))
    words = sets.select("sid", size.alias("size"), F.posexplode("fp").alias("w", "word"))
    rest = F.lit((ring ^ own) if ring < 1 << 63 else (ring ^ own) - (1 << 64))

    def placed(j: int) -> Column:
        at = j * shape.bits
        table = F.shiftleft((F.col("w") * shape.per + j).cast("long"), shape.bits)
        turned = F.shiftrightunsigned("word", at)
        if j:
            turned = turned.bitwiseAND(F.lit(ring >> at)).bitwiseOR(F.shiftleft("word", shape.bits * shape.per - at))
        key = table.bitwiseOR(turned.bitwiseAND(F.lit(own)))
        return F.struct(key.alias("key"), turned.bitwiseAND(rest).bitwiseOR(F.col("size")).alias("word"))

    return words.select("sid", F.inline(F.array(*[placed(j) for j in range(shape.per)]))).select("key", "sid", "word")


def _close(pairs: DataFrame, sets: DataFrame, shape: Layout) -> DataFrame:
    """Rows (u, v, far) of the pairs whose whole fingerprints and sizes allow the similarity; far: differing bits."""
    side = lambda n: sets.select(F.col("sid").alias(n), F.col("n").alias(f"n{n}"), F.col("fp").alias(f"f{n}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    far = reduce(lambda x, y: x + y, [F.bit_count(F.col("fu")[k].bitwiseXOR(F.col("fv")[k])) for k in range(shape.words)])
    sized = F.least("nu", "nv") >= shape.similarity * F.greatest("nu", "nv") - 1e-9
    small, large = shape.farthest()
    limit = F.when(F.least("nu", "nv") < FEW_SHINGLES, small).otherwise(large)
    return both.where(sized).select("u", "v", far.alias("far"), limit.alias("limit")).where("far <= limit").drop("limit")


def _similar(pairs: DataFrame, sets: DataFrame, grams_of: Callable[[DataFrame], DataFrame], shape: Layout) -> DataFrame:
    """Rows (u, v) of the pairs whose shingle sets have the Jaccard similarity; grams_of makes the sets."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(sets, "sid").select("sid", "best.doc_id", "best.mark")
    grams = stored(grams_of(stored(wanted, "simhash-wanted")), "simhash-grams")
    side = lambda n: grams.select(F.col("sid").alias(n), F.col("grams").alias(f"g{n}"))
    common = F.size(F.array_intersect("gu", "gv"))
    enough = common * (1 + shape.similarity) >= shape.similarity * (F.size("gu") + F.size("gv")) - 1e-9
    return pairs.join(side("u"), "u").join(side("v"), "v").where(enough).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v, far) whose sets are in different components."""
    root = lambda of, name: roots.select(F.col("node").alias(of), F.col("root").alias(name))
    both = pairs.join(root("u", "ru"), "u", "left").join(root("v", "rv"), "v", "left")
    return both.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "far")


def _nearest_first(pairs: DataFrame, roots: DataFrame | None, sets: DataFrame, grams_of: Callable[[DataFrame], DataFrame], shape: Layout) -> tuple[DataFrame, DataFrame]:
    """(roots, left): components after each set's nearest pair is compared, and the pairs (u, v, far) that this leaves apart and uncompared."""
    sides = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    nearest = pairs.select("far", F.inline(sides)).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    nearest = stored(nearest.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "simhash-nearest")
    links = _similar(nearest, sets, grams_of, shape)
    if roots is not None:
        links = links.unionByName(_as_links(roots))
    roots = components(links)
    return roots, stored(_apart(pairs.join(nearest, ["u", "v"], "left_anti"), roots), "simhash-left")


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("u"), F.col("node").alias("v"))


def set_links(sets: DataFrame, grams_of: Callable[[DataFrame], DataFrame], shape: Layout) -> DataFrame:
    """Rows (u, v) that connect similar sets, and no others: every similar pair that shares a segment."""
    keyed = _segments(sets, shape)
    # one exchange of all segments: a count and a join by it would move each of them twice
    bucket = Window.partitionBy("key")
    first_of = [F.count(F.lit(1)).over(bucket).alias("size"), F.min("sid").over(bucket).alias("rep"), F.min_by("word", "sid").over(bucket).alias("rep_word")]
    sized = keyed.select("key", "sid", "word", *first_of).where("size > 1 and sid <> rep").withColumn("star", _within_ring(F.col("word"), F.col("rep_word"), shape))
    sized = stored(sized.where("star or size > 2").select("key", "sid", "word", "size", "rep", "star"), "simhash-segments")
    star = sized.where("star").select(F.least("rep", "sid").alias("u"), F.greatest("rep", "sid").alias("v")).distinct()
    roots, left = None, stored(_close(star, sets, shape), "simhash-star")
    for _ in range(STAR_ROUNDS):
        roots, left = _nearest_first(left, roots, sets, grams_of, shape)
    # what the stars left apart: other components of a segment against all its members
    held = sized.where("size > 2").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "word", F.coalesce("root", "sid").alias("root"))
    counted = held.repartition("key").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "root")))
    whole = [F.max("n").over(bucket).alias("most"), F.max_by("root", F.struct("n", "root")).over(bucket).alias("main"), F.count(F.lit(1)).over(bucket).alias("all")]
    mixed = stored(counted.select("key", "sid", "word", "root", *whole).where("most < all"), "simhash-mixed")
    discard(sized)
    others = mixed.where("root <> main").select("key", F.col("sid").alias("a"), F.col("word").alias("wa"), F.col("root").alias("ra"))
    members = mixed.where(F.col("all") <= PAIRED).select("key", F.col("sid").alias("b"), F.col("word").alias("wb"), F.col("root").alias("rb"), "main")
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    cross = others.join(members, "key").where(apart & _within_ring(F.col("wa"), F.col("wb"), shape))
    cross = _close(cross.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), sets, shape)
    roots, left = _nearest_first(stored(cross.unionByName(left).distinct(), "simhash-more"), roots, sets, grams_of, shape)
    more = _similar(left.select("u", "v"), sets, grams_of, shape)
    return _as_links(roots).unionByName(more).unionByName(_blocks(mixed.where(F.col("all") > PAIRED), sets, grams_of, shape))


def _blocks(mixed: DataFrame, sets: DataFrame, grams_of: Callable[[DataFrame], DataFrame], shape: Layout) -> DataFrame:
    """Rows (u, v) that link different components of large segments: each set outside the main one against all members.

    Both sides are cut into blocks, and a task holds one block of either; no pair becomes a row unless it links
    two components that the block has not linked yet. A pair is compared only under the first segment that it shares.
    """
    if mixed.isEmpty():
        return mixed.select(F.col("sid").alias("u"), F.col("sid").alias("v"))
    wanted = mixed.select("sid").distinct().join(sets, "sid")
    grams = grams_of(stored(wanted.select("sid", "best.doc_id", "best.mark"), "simhash-wanted"))
    wide = stored(wanted.select("sid", "n", "fp").join(grams, "sid"), "simhash-grams")
    across, down = F.ceil(F.col("all") / BLOCK_SETS), F.ceil((F.col("all") - F.col("most")) / BLOCK_SETS)
    place = lambda n: F.pmod(F.xxhash64("sid"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = mixed.where("root <> main").select("key", place(down).alias("i"), every(across).alias("j"), F.lit(True).alias("own"), "sid", "root", "main")
    all_ = mixed.select("key", place(across).alias("j"), every(down).alias("i"), F.lit(False).alias("own"), "sid", "root", "main")
    rows = own.unionByName(all_).join(wide, "sid")
    small, large = shape.farthest()

    def compare(group: pa.Table) -> pa.Table:
        side = np.array(group.column("own").to_pylist(), bool)
        sid, root, n = (group.column(c).to_numpy() for c in ("sid", "root", "n"))
        key, main = group.column("key")[0].as_py(), group.column("main")[0].as_py()
        fp = np.array(group.column("fp").to_pylist(), np.int64).view(np.uint64)
        cuts = np.arange(shape.per, dtype=np.uint64) * np.uint64(shape.bits)
        segments = ((fp[:, :, None] >> cuts) & np.uint64((1 << shape.bits) - 1)).reshape(len(fp), -1)
        table, held, joined, out = key >> shape.bits, group.column("grams"), {}, []

        def top(r: int) -> int:
            while joined.get(r, r) != r:
                r = joined[r]
            return r

        all_ = np.flatnonzero(~side)
        for a in np.flatnonzero(side).tolist():
            far = np.bitwise_count(fp[all_] ^ fp[a]).sum(axis=1, dtype=np.int64)
            limit = np.where(np.minimum(n[all_], n[a]) < FEW_SHINGLES, small, large)
            fits = np.minimum(n[all_], n[a]) >= shape.similarity * np.maximum(n[all_], n[a]) - 1e-9
            near = (far <= limit) & fits & (root[all_] != root[a]) & ((root[all_] == main) | (sid[a] < sid[all_]))
            at = all_[near][np.argsort(far[near], kind="stable")]
            at = at[~(segments[at, :table] == segments[a, :table]).any(axis=1)]
            mine = held[a].values.to_numpy() if len(at) else None
            for b in at.tolist():
                x, y = top(int(root[a])), top(int(root[b]))
                if x != y:
                    common = len(np.intersect1d(mine, held[b].values.to_numpy(), assume_unique=True))
                    if common * (1 + shape.similarity) >= shape.similarity * (n[a] + n[b]) - 1e-9:
                        joined[x] = y
                        out.append(sorted((int(sid[a]), int(sid[b]))))
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """Rows (doc_id, mark, component_id, kept), one for each row of docs.

    Documents whose shingle sets have a Jaccard similarity of ``similarity`` are linked;
    a pair at that very similarity is missed with the chance ``miss``, more similar ones more seldom. kept: the row
    (or an equal one) stands for its component: the smallest doc_id, those without
    one last, then the smallest text hash ``mark``.
    """
    shape = layout(docs.count(), similarity, miss)
    with short_batches(docs.sparkSession, BATCH_BYTES):
        return _grouped(docs, shape, doc_id, text, shingle)


def _grouped(docs: DataFrame, shape: Layout, doc_id: str, text: str, shingle: int) -> DataFrame:
    prints = stored(sketches(docs, shape, doc_id, text, shingle), "simhash-sets")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")).alias("best")
    sets = stored(prints.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), best), "simhash-distinct")
    roots = components(set_links(sets, lambda wanted: _grams(docs, wanted, doc_id, text, shingle), shape))
    named = sets.select("sid", "best").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = stored(named, "simhash-roots")
    chosen = named.groupBy("root").agg(F.min("best").alias("chosen"))
    out = prints.select("doc_id", "mark", "sid").join(named.join(chosen, "root").select("sid", "chosen"), "sid")
    kept = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("mark") == F.col("chosen.mark"))
    return out.select("doc_id", "mark", F.col("chosen.doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near-duplicates (see similar_groups); all columns as they are.

    Decided by row, not by id: of rows with one id and different texts each stands for its own component. Rows
    equal in id and text are reduced to one (the least by a hash of all its columns). Whole
    rows move only if the list of rows to drop is beyond BROADCAST_BYTES.
    """
    found = similar_groups(docs, doc_id, text, shingle, similarity)
    listed = found.groupBy("doc_id", "mark").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("not kept or rows > 1")
    listed = stored(listed.select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark"), F.col("kept").alias("_kept")), "simhash-listed")
    same = docs[doc_id].eqNullSafe(F.col("_doc_id")) & (text_mark(text) == F.col("_mark"))
    out = docs.join(_small(listed, "_doc_id"), same, "left_anti")
    if not listed.where("_kept").isEmpty():
        repeated = docs.join(_small(listed.where("_kept"), "_doc_id"), same, "left_semi")
        columns = [F.col(f"`{c}`") for c in docs.columns]
        order = F.xxhash64(*[F.to_json(F.struct(c)) if _has_map(f.dataType) else c for c, f in zip(columns, docs.schema)])
        one = repeated.groupBy(F.col(f"`{doc_id}`").alias("_id"), text_mark(text).alias("_mark")).agg(F.min_by(F.struct(*columns), order).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out


def _has_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString()
