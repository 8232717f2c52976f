"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, components, drop_written, measured, mix64, table, text_chunks, written

SEED = 42
_digest = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` space-joined words of the text, A-Z lower-cased; of all words if they are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([_digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.array([_digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def _majority(hashes: np.ndarray, words: int) -> bytes:
    """The bits set in more than half of the rows of (hashes, words), as one big-endian number per word."""
    total = np.zeros(64 * words, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8 * words)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are those set in more than half of the hashes."""
    return int.from_bytes(_majority(hashes.reshape(-1, 1), 1), "big")


def fingerprint(text: Column, words: int) -> Column:
    """The SimHash of a text as a long; zero for a text without words, null included."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = []
        for _, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            found += [majority_bits(shingle_hashes(raw[a:b], words)) for a, b in zip(at, at[1:])]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return simhash(text)


def ball(print_: Column) -> Column:
    """The fingerprint and its 64 variants with one bit flipped."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: print_.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(print_), flips)


def linked_pairs(prints: DataFrame, column: str = "print") -> DataFrame:
    """Pairs (src, dst) of different fingerprints at most 2 bits apart that connect whatever such pairs connect.

    Two fingerprints at most 2 bits apart share a variant at most one bit from either, so distinct fingerprints meet
    in the shuffle on variants. A variant's group has at most 65 members, all within 2 bits of each other; each is
    paired with the smallest, which keeps the group connected without all its pairs.
    """
    spread = prints.select(F.col(column).alias("print")).distinct().select("print", F.explode(ball(F.col("print"))).alias("variant"))
    met = spread.groupBy("variant").agg(F.count("*").alias("n"), F.min("print").alias("dst"), F.collect_list("print").alias("members"))
    pairs = met.filter("n > 1").select("dst", F.explode("members").alias("src"))
    return pairs.filter((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)).select("src", "dst").distinct()


def fingerprint_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, print, component): each row's fingerprint and the smallest key among the rows that links reach.

    Rows with equal fingerprints, repeated rows included, are one node; rows without words share fingerprint zero and
    link like any other. A null key never is a component's name, unless all its rows have none. Very long texts are
    hashed whole, an empty table gives no rows, other columns are ignored. Texts are read once: keys and fingerprints
    are kept as a table in the shared folder.
    """
    bounded_batches(docs.sparkSession)
    prints = written(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), words).alias("print")), "prints")
    nodes = components(linked_pairs(prints)).withColumnRenamed("node", "print")
    sizes = prints.groupBy("print").agg(F.min("key").alias("first"))
    named = sizes.join(nodes, "print", "left").withColumn("component", F.coalesce("component", "print"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    classes = named.join(lowest, "component").select("print", "lowest")
    return prints.join(classes, "print").select(F.col("key").alias(key), "print", F.col("lowest").alias("component"))


#: Shingles that stand in MANY_TEXTS texts of one in SAMPLED texts or more come last in the order of shingles, MOST_COMMON
#: at most. Any order finds the same pairs; this one lets fewer chance pairs meet.
SAMPLED, MANY_TEXTS, MOST_COMMON = 16, 8, 1 << 20
#: Least bits for each shingle of the parity map of a set, by which pairs are ruled out for certain.
MAP_BITS = 2
#: 64-bit words of the short parity map that travels with a set's shingles; sets for which it is too short have none.
SKETCH_WORDS = 8
SKETCH = [f"k{k}" for k in range(SKETCH_WORDS)]
#: Classes of a shingle that all its others are compared with before they are compared with each other.
PIVOTS = 4

#: The wide fingerprint of ``similar_groups``: 64-bit words, of which the last is compared first, and the tables cut
#: from the others. Bits of a table's key beyond the logarithm of the number of fingerprints.
WIDE_WORDS, TABLES, SPARE_BITS = 4, 8, 6


def wide_bits(hashes: np.ndarray, words: int = WIDE_WORDS) -> bytes:
    """The majority bits of so many independent scrambles of the different hashes."""
    hashes = np.unique(hashes)
    return _majority(np.stack([mix64(hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)) for k in range(words)], axis=1), words)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles, given in rising order, apart."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def wide_prints(text: Column, words: int, size: int) -> Column:
    """The wide fingerprint of a text as a struct of longs w0, w1 and so on, with its set's digest s0 and s1."""
    names = [*(f"w{k}" for k in range(size)), "s0", "s1"]

    @F.arrow_udf("struct<" + ",".join(f"{n}:long" for n in names) + ">")
    def wide(texts: pa.Array) -> pa.Array:
        found = []
        for _, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            sets = (np.unique(shingle_hashes(raw[a:b], words)) for a, b in zip(at, at[1:]))
            found += [wide_bits(hashes, size) + set_digest(hashes) for hashes in sets]
        matrix = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, size + 2)
        return pa.StructArray.from_arrays([pa.array(matrix[:, k]) for k in range(size + 2)], names=names)

    return wide(text.cast("string"))


def shingle_sets(text: Column, words: int) -> Column:
    """The different shingle hashes of a text as an array of longs."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        found = []
        for _, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            found += [np.unique(shingle_hashes(raw[a:b], words)) for a, b in zip(at, at[1:])]
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        hashes = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes))

    return sets(text.cast("string"))


def share_of_bits(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _compared(pairs: DataFrame, prints: DataFrame, column: str, words: int, most: int) -> DataFrame:
    """The pairs (a, b) of ids whose fingerprints differ in at most so many bits."""
    for side in "ab":
        pairs = pairs.join(prints.select(F.col("id").alias(side), F.col(column).alias(f"_{side}")), side)
    differing = sum(F.bit_count(F.col(f"_a.w{k}").bitwiseXOR(F.col(f"_b.w{k}"))) for k in range(words))
    return pairs.filter(differing <= most).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets have this Jaccard similarity or more, counted element by element."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"_{side}")), side)
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.filter(common / (F.size("_a") + F.size("_b") - common) >= similarity).select("a", "b")


def common_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes of the shingles that stand in many texts, the rarer ones first; ``rows`` has _text and its digest tag."""
    sets = rows.filter(F.pmod("tag", F.lit(SAMPLED)) == 0).select("tag", shingle_sets(F.col("_text"), words).alias("shingles"))
    counts = sets.dropDuplicates(["tag"]).select(F.explode("shingles").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= MANY_TEXTS).orderBy(F.desc("n"), "hash").limit(MOST_COMMON).select("hash").toArrow()
    return found["hash"].to_numpy()[::-1].view(np.uint64)


def parity_map(hashes: np.ndarray, size: int | None = None) -> np.ndarray:
    """64-bit words, so many or a power of two by the set's size, whose bits say whether an odd number of the hashes falls on them."""
    size = size or 1 << max(0, math.ceil(math.log2(max(1, MAP_BITS * len(hashes) / 64))))
    place = ((hashes >> np.uint64(8)) % np.uint64(size)) * np.uint64(64) + hashes % np.uint64(64)
    odd = np.bincount(place.astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _map_difference(a: Column, b: Column) -> Column:
    """In how many bits two parity maps differ; the longer one is folded to the shorter, whose length divides its own."""
    size = F.least(F.size(a), F.size(b))

    def folded(words: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(words), size), lambda first: F.slice(words, first, size))
        start = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0).cast("long"))
        return F.when(F.size(words) == size, words).otherwise(F.aggregate(parts, start, lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))))

    bits = F.zip_with(folded(a), folded(b), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(bits, F.lit(0), lambda x, y: x + y)


def _prefix_length(size: int, similarity: float) -> int:
    """How many of a set's first shingles hold one of any set that is this similar, in whatever common order."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def set_prefixes(text: Column, words: int, similarity: float, common: np.ndarray) -> Column:
    """struct<s0, s1, n, prefix, map, k0, ...>: a text's set digest, its size, its first shingles, its parity map and the short one.

    Declared nondeterministic, or Spark would evaluate it again, in a worker of its own, for each filter on a field.
    """
    order = np.argsort(common)
    known = common[order]

    def ordered(hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return hashes
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = known[at] == hashes
        return np.concatenate([hashes[~often], common[np.sort(order[at[often]])]])

    def lists(found: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    telling = 32 * SKETCH_WORDS * (1 + similarity) / (1 - similarity) / 2 if similarity < 1 else math.inf
    unknown = np.zeros(SKETCH_WORDS, dtype=np.int64)
    names = ["s0", "s1", "n", "prefix", "map", *SKETCH]

    @F.arrow_udf("struct<s0:long,s1:long,n:int,prefix:array<long>,map:array<long>," + ",".join(f"{k}:long" for k in SKETCH) + ">")
    def prefixes(texts: pa.Array) -> pa.Array:
        digests, sizes, heads, maps, short = [], [], [], [], []
        for _, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            for a, b in zip(at, at[1:]):
                hashes = np.unique(shingle_hashes(raw[a:b], words))
                digests.append(set_digest(hashes))
                sizes.append(len(hashes))
                heads.append(ordered(hashes)[: _prefix_length(len(hashes), similarity)].view(np.int64))
                maps.append(parity_map(hashes))
                short.append(parity_map(hashes, SKETCH_WORDS) if len(hashes) < telling else unknown)
        digest = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sizes, pa.int32()), lists(heads), lists(maps)]
        sketch, none = np.array(short, dtype=np.int64).reshape(-1, SKETCH_WORDS), np.array(sizes) >= telling
        columns += [pa.array(sketch[:, k], mask=none) for k in range(SKETCH_WORDS)]
        return pa.StructArray.from_arrays(columns, names=names)

    return prefixes.asNondeterministic()(text.cast("string"))


def _prefixes(rows: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(n, prefix, map, k0, ..., id, component) of the classes that have shingles; texts are read once for it."""
    found = rows.select(set_prefixes(F.col("_text"), words, similarity, common_shingles(rows, words)).alias("p")).select("p.*")
    ids = classes.select(F.col("print.s0").alias("s0"), F.col("print.s1").alias("s1"), "id", "component")
    return written(found.filter("n > 0").join(ids, ["s0", "s1"]).drop("s0", "s1").dropDuplicates(["id"]), "prefixes")


def _meeting(tokens: DataFrame) -> DataFrame:
    """The rows of (hash, id, component, ...) whose hash more than one component has."""
    shared = tokens.groupBy("hash").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("hash")
    return written(tokens.join(shared, "hash"), "tokens")


def _missed(met: DataFrame, found: DataFrame, similarity: float, pivots: bool) -> tuple[DataFrame, int]:
    """Pairs (a, b), and their number, of classes of different components among which are all of this similarity, by exact bounds alone.

    Of two sets with this Jaccard similarity, the first shingles of each, as many as may be missing in the other and one
    more, share one: they meet there in an equi-join. Sizes, places in the order, and the shingles that the parity maps show
    to differ rule out pairs for certain; the short map does so where they meet, so that a group of copies that are not near
    enough does not leave its pairs. Shingles that only one component has have been dropped, see ``_meeting``.

    With ``pivots`` a class meets only so many of each of its shingles, and takes the likeliest of a component: rows grow
    with the shingles, not with the pairs. That joins most of a large group's members that fingerprints have left alone, so
    that the run without, which leaves nothing out, does not pair each of them with the whole group.
    """
    chosen = met
    if pivots:
        place = F.row_number().over(Window.partitionBy("hash").orderBy(F.xxhash64("hash", "id"), "id"))
        chosen = met.withColumn("_place", place).filter(F.col("_place") <= PIVOTS)
    a, b = (rows.select("hash", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "n", "pos", *SKETCH)]) for rows, side in ((met, "a"), (chosen, "b")))
    least = similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-6
    most = F.least("a_pos", "b_pos") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    limit = (1 - similarity) / (1 + similarity) * (F.col("a_n") + F.col("b_n")) + 1e-6
    differing = F.coalesce(sum(F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in SKETCH), F.lit(0))
    sizes_fit = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-6
    fits = sizes_fit & (most >= least) & (differing <= limit)
    apart = F.col("a_component") != F.col("b_component") if pivots else F.col("a_component") < F.col("b_component")
    pairs = a.join(b, "hash").filter(apart & fits)
    if pivots:
        pairs = pairs.groupBy("a_id", "b_component").agg(F.min(F.struct(differing / limit, "b_id")).alias("_best")).select("a_id", "_best.b_id")
    candidates = written(pairs.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).distinct(), "pairs")
    pairs = candidates
    for side in "ab":
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("n").alias(f"_n{side}"), F.col("map").alias(f"_{side}")), side)
    differing = _map_difference(F.col("_a"), F.col("_b"))
    limit = (1 - similarity) / (1 + similarity) * (F.col("_na") + F.col("_nb")) + 1e-6
    missed, number = measured(pairs.filter(differing <= limit).select("a", "b"), "missed", n=F.count("*"))
    drop_written(candidates)
    return missed, number["n"]


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component, group, tag) of every row: rows whose shingle sets have this Jaccard similarity or more, over links.

    Balls of small radius miss texts at 0.8 on one 64-bit fingerprint, which differ in ten bits. So the fingerprint is
    wide, and TABLES keys are cut from it; two fingerprints are candidates if some table's keys differ in 2 bits at
    most, for which both emit their keys' balls of radius one and meet in the shuffle. In a variant's group every member
    meets one pivot, the smallest by a hash that differs between tables, so no group's pairs are spread out and a group is
    read in a stream. Of its pivots in a table a member keeps two, the nearest and the smallest that is near enough: at most
    two pairs a table and member, however large a group. Fingerprints only pick candidates, up to three standard errors
    beyond the limit; a pair links if the exact Jaccard similarity of its shingle sets reaches the limit. Keys grow with the logarithm of the
    number of fingerprints, so chance meetings grow with the input. What fingerprints miss between the groups so found is
    then looked for by bounds that hold for certain, see ``_missed``, and judged alike: no link is left out. Rows of equal
    sets, repeated rows and those without words included, are one class. ``component`` is the smallest key of the group, null
    if its rows have none; ``group`` numbers the groups, ``tag`` is the XXH64 of the row's text.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("tag", F.xxhash64("_text"))
    prints = written(rows.select("key", "tag", wide_prints(F.col("_text"), words, WIDE_WORDS).alias("print")), "wide")
    classes = prints.groupBy("print").agg(F.min("key").alias("first"), F.min(F.struct(F.col("key").isNull(), "key", "tag")).alias("_row"))
    classes, number = measured(classes.select("print", "first", "_row.tag", F.monotonically_increasing_id().alias("id")), "classes", n=F.count("*"))
    bits = min(8 * WIDE_WORDS * 8 // TABLES - 8, max(8, math.ceil(math.log2(max(2, number["n"]))) + SPARE_BITS))

    def most(size: int, errors: float = 3) -> int:
        share = share_of_bits(similarity)
        return math.ceil(64 * size * share + errors * math.sqrt(64 * size * share * (1 - share)))

    def cut(table_: int) -> Column:
        """The key of a table: ``bits`` bits of the words before the last, from the table's place on."""
        place = table_ * (64 * (WIDE_WORDS - 1) // TABLES)
        word, shift = place // 64, place % 64
        low = F.shiftrightunsigned(F.col(f"print.w{word}"), shift)
        if shift + bits > 64:
            low = low.bitwiseOR(F.shiftleft(F.col(f"print.w{(word + 1) % WIDE_WORDS}"), 64 - shift))
        return low.bitwiseAND(F.lit((1 << bits) - 1))

    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    keyed = classes.select("id", F.col(f"print.w{WIDE_WORDS - 1}").alias("sketch"), F.posexplode(F.array(*(cut(t) for t in range(TABLES)))).alias("table", "cut"))
    spread = keyed.select("id", "sketch", "table", F.explode(F.transform(flips, lambda x: F.col("cut").bitwiseXOR(x))).alias("variant"))
    spread = spread.select("id", "sketch", F.col("variant").bitwiseOR(F.shiftleft(F.col("table").cast("long"), 48)).alias("variant"))
    order = F.xxhash64("id", F.shiftright("variant", 48))
    pivot = F.first(F.struct(order.alias("order"), "id", "sketch")).over(Window.partitionBy("variant").orderBy(order, "id"))
    differing = F.bit_count(F.col("sketch").bitwiseXOR(F.col("pivot.sketch")))
    met = spread.withColumn("pivot", pivot).filter((F.col("id") != F.col("pivot.id")) & (differing <= most(1)))
    likely, nearest = (F.min(F.struct(by, "pivot.order", "pivot.id")) for by in (F.greatest(differing, F.lit(most(1, 0))), differing))
    chosen = met.groupBy("id", F.shiftright("variant", 48)).agg(F.array(likely, nearest).alias("pivots")).select("id", F.explode("pivots.id").alias("pivot"))
    pairs = chosen.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
    close = written(_compared(pairs, classes.select("id", "print"), "print", WIDE_WORDS, most(WIDE_WORDS)), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        needed = classes.join(needed, "id").select("id", F.col("first").alias("_key"), F.col("tag").alias("_tag"))
        met = rows.join(needed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("tag") == F.col("_tag")))
        return written(met.select("id", shingle_sets(F.col("_text"), words).alias("shingles")).dropDuplicates(["id"]), "sets")

    def joined(named: DataFrame, links: DataFrame) -> DataFrame:
        """The classes with the components that the links make of theirs."""
        groups = components(links, "a", "b").withColumnRenamed("component", "_to")
        named = named.join(groups.withColumnRenamed("node", "component"), "component", "left")
        return written(named.withColumn("component", F.coalesce("_to", "component")).drop("_to"), "named")

    def merged(named: DataFrame, missed: DataFrame) -> DataFrame:
        """The classes with the components that the pairs of this similarity make of theirs."""
        sets = sets_of(missed)
        links = _alike(missed, sets, similarity)
        for side in "ab":
            links = links.join(named.select(F.col("id").alias(side), F.col("component").alias(f"_{side}")), side)
        found = joined(named, links.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        drop_written(sets)
        return found

    sets = sets_of(close)
    named = joined(classes.withColumn("component", F.col("id")), _alike(close, sets, similarity))
    drop_written(sets, close)
    found = _prefixes(rows, named, words, similarity)
    met = _meeting(found.select("id", "component", "n", *SKETCH, F.posexplode("prefix").alias("pos", "hash")))
    missed, left = _missed(met, found, similarity, pivots=True)
    if left:
        named, apart = merged(named, missed), met
        met = _meeting(apart.drop("component").join(named.select("id", "component"), "id"))
        drop_written(apart)
    drop_written(missed)
    missed, left = _missed(met, found, similarity, pivots=False)
    drop_written(met, found)
    if left:
        named = merged(named, missed)
    drop_written(missed)
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    members = named.join(lowest, "component").select("print", "lowest", F.col("component").alias("group"))
    return prints.join(members, "print").select(F.col("key").alias(key), F.col("lowest").alias("component"), "group", "tag")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest key of their group, all columns kept; of repeated rows of a key one.

    A row without a key stays only if no row of its group has one, one row of the group then.
    """
    found = written(similar_groups(docs, key, text, words, similarity), "groups")
    first = found.filter(F.col(key).eqNullSafe(F.col("component"))).groupBy("group").agg(F.min("tag").alias("_tag"), F.first("component").alias("_key"))
    staying = found.join(first, (found["group"] == first["group"]) & F.col(key).eqNullSafe(F.col("_key")) & (F.col("tag") == F.col("_tag")))
    staying, rows = measured(staying.groupBy("_key", "_tag").agg(F.count("*").alias("_n")), "staying", most=F.max("_n"))
    repeated = (rows["most"] or 0) > 1
    kept = docs.join(staying, docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col("_tag")), "left_semi")
    return kept.dropDuplicates([key, text]) if repeated else kept


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
