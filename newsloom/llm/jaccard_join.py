"""N-gram Jaccard join by parity sketches.

A document is the set of its 4-word shingles. The sets are cut by hash into parts, and each part is reduced to the
XOR of its shingles' hashes: the document's parity sketch. One shingle in either set but not in both changes one part,
so the number of differing parts is never above the symmetric difference. Two sets that reach the threshold differ by at most
``max_diff`` shingles, so with two filled parts more than that they agree on at least two (pigeonhole); only sets with fewer filled parts count empty ones, and parts are
so many that hardly any set does. Parts are numbered per size band, and a document takes part in each band in which a partner of its size can fall. The candidates are verified on
the exact sets. Nothing is sampled or capped, so no link is lost.

Cost: about 0.4 sketch rows per distinct shingle, one shuffle. Sets that are equal are merged first, so copies cost one row each.
Links within a group of near copies are tried with its least member and then with a few others first; pairs are formed only between
members that this left in different components. A part that more than ``HOT`` of these share is split by a second part that a pair agrees on; where keys are other than
parts and a pair may share just one, by size class and by blocks of the bit sketch: of one block more than sets of the class may differ in, a pair agrees on at least one.

Sets are told apart by fingerprints of 128 bits: XORs of two scrambles of the shingles' hashes, and for sets of up to ``SMALL`` shingles a digest of the words in
place of the second, as a single shingle's 64 bits would be too few: among 10^10 different short texts 2.7 pairs would meet by chance. Larger sets
that meet would have to meet in each shingle that they don't share. Verification counts equal 64-bit hashes of two sets as equal shingles, which is wrong for
one pair of 1000-word texts in 10^13.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import mix, text_shingles
from newsloom.operators.components import component_labels
from newsloom.scratch import Scratch

SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
GROWTH = 1.4
SKETCH_WORDS = 8
REPS = 4
HOT = 200
SMALL = 12


def max_diff(total: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Largest symmetric difference of two sets with ``total`` elements between them that still link."""
    return total * (den - num) // (den + num)


@lru_cache(maxsize=None)
def band(k: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[int, int, int, int]:
    """Band k: least and largest size of the smaller set, largest size of its partner, number of differences allowed."""
    low = 1 if k == 0 else band(k - 1, num, den)[1] + 1
    high = max(low, int(low * GROWTH) - 1) if low > 4 else low
    partner = high * den // num
    return low, high, partner, max_diff(high + partner, num, den)


def bands_of(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, differences allowed) for each band in which a set of n elements can have a partner."""
    out, k = [], 0
    while n:
        low, _, partner, diff = band(k, num, den)
        if low > n:
            break
        if n <= partner and diff:  # without a difference allowed only equal sets link, and these are merged already
            out.append((k, diff))
        k += 1
    return out


def parts_of(diff: int) -> int:
    """Parts of a sketch for so many differences: two more, and as many again as leave few sets with fewer than ``diff + 2`` filled ones."""
    return diff + 2 + max(60 // diff, 4 + diff // 32)


def parity_keys(s: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """The parts of a sorted set's sketches in all its bands, each as one 64-bit key."""
    keys = []
    value = mix(s + np.uint64(0x632BE59BD9B4E019))
    high = s >> np.uint64(32)
    for k, diff in bands_of(len(s), num, den):
        parts = parts_of(diff)
        part = (high * np.uint64(parts)) >> np.uint64(32)  # in order, as the set is sorted
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        xor = np.bitwise_xor.reduceat(value, at)
        part = part[at]
        if len(at) <= diff + 1:  # so few filled parts that one or none of them may agree with those of another set as poor: empty ones count too
            part = np.arange(parts, dtype=np.uint64)
            full = np.zeros(parts, dtype=np.uint64)
            full[((high * np.uint64(parts)) >> np.uint64(32))[at].astype(np.int64)] = xor
            xor = full
        keys.append(mix(xor + mix(part + np.uint64(k << 40))))
    return np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's counts by hash, 64 bits in each of SKETCH_WORDS words."""
    h = mix(s + np.uint64(0x1234567))
    bits = np.bincount((h % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _lists(values: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), type=kind))


def second_print(s: np.ndarray, raw: bytes, k: int) -> int:
    """The half of a set's fingerprint that ``set_print`` doesn't give."""
    if len(s) > SMALL:
        return int(np.bitwise_xor.reduce(mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))))
    w = raw.lower().split()  # bytes: A-Z and the six white-space characters alone
    shingles = {b" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}
    return int.from_bytes(blake2b(b"\n".join(sorted(shingles)), digest_size=8).digest(), "little")


def prints(sets: list[np.ndarray], raws: list[bytes], k: int) -> list[pa.Array]:
    """Both halves of the sets' fingerprints."""
    first = [int(np.bitwise_xor.reduce(mix(s))) ^ len(s) for s in sets]
    second = [second_print(s, raw, k) for s, raw in zip(sets, raws, strict=True)]
    return [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (first, second)]


def _with_sets(docs: DataFrame, id_col: str, text_col: str, k: int, what, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, sets, raws in text_shingles(batch.column(1), k):
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([ids[a:b], *what(sets, raws)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def set_table(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Per row: id, set size, set fingerprint, sketch keys, bit sketch."""

    def what(sets, raws):
        sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
        return sizes, *prints(sets, raws, k), _lists([parity_keys(s, num, den) for s in sets]), _lists([bit_sketch(s) for s in sets])

    return _with_sets(docs, id_col, text_col, k, what, "id long, n long, print long, print2 long, keys array<long>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (u, v), those whose sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def linked_sets(one: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, num: int, den: int, also: DataFrame | None = None, two: bool = True) -> DataFrame:
    """Components of different sets: ``one(id, n, keys, bits)`` -> ``(u, v)``, v the least id of u's component, where it isn't u.

    Sets that share a key are candidates; ``sets_of(ids)`` gives the sets of some ids as ``(id, members)``. ``also`` are links known before.
    ``two`` tells that sets that link share at least two keys, so that hot keys can be split.
    """
    # members of every key that two or more sets share, with the least of them
    rows = one.select("id", F.explode("keys").alias("key"))
    shared = scratch.save(rows.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("key", "rep"))
    members = scratch.save(rows.join(shared, "key"))
    scratch.drop(shared)
    sets = scratch.save(sets_of(members.select("id").distinct()))
    first = members.where("id <> rep").groupBy("id").agg(F.min("rep").alias("v")).select(F.col("id").alias("u"), "v")
    links = _verified(first, sets, num, den)
    links = scratch.save(links if also is None else links.union(also))
    # what the least members left apart is tried with a few more members of each key, and only then pair by pair
    labels = component_labels(links, scratch)
    apart = scratch.save(open_members(members, labels, one, scratch))
    for step in ("a few", "all"):
        if apart.isEmpty():
            break
        pairs = rep_pairs(apart, num, den, scratch) if step == "a few" else cross_pairs(apart, num, den, one if two else None, scratch)
        links = scratch.save(links.union(_verified(pairs, sets, num, den)))
        labels = component_labels(links, scratch)
        if step == "a few":
            was, apart = apart, scratch.save(open_members(apart.select("key", "id"), labels, one, scratch))
            scratch.drop(was)
    for used in (members, sets, apart):
        scratch.drop(used)
    return labels


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """``docs`` -> ``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Two documents link when ``den * |A & B| >= num * |A | B|``; a component's id is its least id.
    A null or blank text has no shingles and links with nothing; rows with a null id keep a null component and link nothing.
    Rows with one id are one document: all of them that have shingles are in one component, also where their texts differ; a blank row beside them links with nothing and
    keeps its id. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    table = scratch.save(set_table(docs, id_col, text_col, k, num, den))
    rows = scratch.save(table.select("id", "n", "print", "print2"))
    # each different set is a node; its number is unique, as ids needn't be
    sets = table.where("n > 0 and id is not null").groupBy("print", "print2", "n")
    sets = sets.agg(F.min("id").alias("doc"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"))
    one = scratch.save(sets.withColumn("id", F.monotonically_increasing_id()))
    scratch.drop(table)
    nodes = one.select("id", "doc", "print", "print2", "n")
    filled = rows.where("n > 0 and id is not null")
    mark = F.struct("print", "print2")
    several = filled.groupBy("id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("id")
    own = filled.join(several, "id", "left_semi").select(F.col("id").alias("row"), "print", "print2", "n").join(nodes, ["print", "print2", "n"])
    also = own.join(own.groupBy("row").agg(F.min("id").alias("v")), "row").where("id <> v").select(F.col("id").alias("u"), "v")
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = nodes.join(ids, "id", "left_semi")
        found = texts.join(asked.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi")
        made = _with_sets(found, id_col, text_col, k, lambda s, raws: [*prints(s, raws, k), _lists(s)], "id long, print long, print2 long, members array<long>")
        return made.drop("id").dropDuplicates(["print", "print2"]).join(asked.select("id", "print", "print2"), ["print", "print2"]).select("id", "members")

    final = linked_sets(one.select("id", "n", "keys", "bits"), sets_of, scratch, num, den, also)
    rooted = nodes.join(final.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = scratch.save(rooted.select("print", "print2", "n", "doc", "root"))
    least = scratch.save(rooted.groupBy("root").agg(F.min("doc").alias("component")))
    reps = scratch.save(rooted.join(least, "root").select("print", "print2", "n", "component"))
    out = rows.join(reps, ["print", "print2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def open_members(members: DataFrame, labels: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, id, comp, n, bits)`` of the keys whose members are in more than one component."""
    comp = members.select("key", "id").join(labels.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # written, so that the join with it can be split where a key is hot
    open_keys = scratch.save(comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
    return comp.join(open_keys, "key", "left_semi").join(one.select("id", "n", "bits"), "id").select("key", "id", "comp", "n", "bits")


def near(num: int, den: int):
    """What the sizes and bit sketches of columns a_ and b_ don't rule out, in different components."""
    differ = sum((F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    fits = den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")
    return (F.col("a_comp") != F.col("b_comp")) & fits & ((den + num) * differ <= (den - num) * (F.col("a_n") + F.col("b_n")))


def _side(apart: DataFrame, x: str) -> DataFrame:
    return apart.select(F.col("key").alias(f"{x}_key"), *(F.col(c).alias(f"{x}_{c}") for c in ("id", "comp", "n", "bits")))


def rep_pairs(apart: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Each member of a key with ``REPS`` members of it: as many pairs as members, not as pairs of members."""
    member = F.struct(*(F.col(c).alias(f"b_{c}") for c in ("id", "comp", "n", "bits")))
    reps = scratch.save(apart.groupBy(F.col("key").alias("b_key")).agg(F.array(*(F.min_by(member, F.xxhash64("id", F.lit(s))) for s in range(REPS))).alias("reps")))
    tried = _side(apart, "a").join(reps, F.col("a_key") == F.col("b_key")).select("a_id", "a_comp", "a_n", "a_bits", F.explode(F.array_distinct("reps")).alias("r"))
    pairs = tried.select("a_id", "a_comp", "a_n", "a_bits", "r.*").where(near(num, den))
    return pairs.select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v")).distinct()


@lru_cache(maxsize=None)
def class_from(c: int, num: int, den: int) -> int:
    """Least size of a size class: partners of the sets of one class are in it or in a neighbouring one."""
    return 1 if c <= 0 else class_from(c - 1, num, den) * den // num + 1


def class_blocks(c: int, num: int, den: int) -> int:
    """Blocks of a bit sketch for pairs whose smaller set is of size class c: one more than they may differ in."""
    return max_diff(class_from(c + 1, num, den) + class_from(c + 2, num, den) - 2, num, den) + 1


def sketch_blocks(n: int, bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's size classes and blocks of its bit sketch: two sets that link share at least one."""
    own = 0
    while class_from(own + 1, num, den) <= n:
        own += 1
    flat = np.unpackbits(bits.view(np.uint8))
    out = []
    for c in (own - 1, own):  # its partner's class is the same or a neighbour: the smaller set's names the pair
        cut = np.linspace(0, len(flat), min(class_blocks(c, num, den), len(flat)) + 1).astype(np.int64)[:-1]
        place = mix(np.arange(len(flat), dtype=np.uint64) + np.uint64(0x77))
        value = np.bitwise_xor.reduceat(np.where(flat, place, np.uint64(0)), cut)
        out.append(mix(value + mix(np.uint64((c + 1) << 20) + np.arange(len(cut), dtype=np.uint64))))
    return np.concatenate(out).view(np.int64)


def _block_keys(members: DataFrame, num: int, den: int) -> DataFrame:
    """``(key, id, comp, n, bits)`` with ``key2``, a row for each of ``sketch_blocks``."""

    def run(batches):
        for batch in batches:
            n, bits = batch.column("n").to_pylist(), batch.column("bits")
            with np.errstate(over="ignore"):
                keys = [sketch_blocks(k, np.asarray(b.values), num, den) for k, b in zip(n, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(keys)], names=[*batch.schema.names, "keys"])

    kind = "key long, id long, comp long, n long, bits array<long>, keys array<long>"
    return members.select("key", "id", "comp", "n", "bits").mapInArrow(run, kind).select("key", "id", "comp", "n", "bits", F.explode("keys").alias("key2"))


def cross_pairs(apart: DataFrame, num: int, den: int, one: DataFrame | None, scratch: Scratch) -> DataFrame:
    """All pairs that still share a key but no component; given the keys of ``one``, members of a hot key are paired only where they share a greater key too, else where they share
    a block of their bit sketches."""
    hot = scratch.save(apart.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > HOT).select("key"))
    both = apart.withColumn("key2", F.lit(0).cast("long"))
    if not hot.isEmpty() and one is None:
        split = scratch.save(_block_keys(scratch.save(apart.join(hot, "key", "left_semi")), num, den))
        both = both.join(hot, "key", "left_anti").unionByName(split)
    elif not hot.isEmpty():
        split = scratch.save(apart.join(hot, "key", "left_semi"))
        ids = scratch.save(split.select("id").distinct())  # written, so that the planner knows its size before it reads all keys
        keys = one.select("id", "keys").join(ids, "id", "left_semi").select("id", F.explode("keys").alias("key2"))
        both = both.join(hot, "key", "left_anti").unionByName(split.join(keys, "id").where("key2 > key"))
    side = lambda x: both.select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "key2", "id", "comp", "n", "bits")))
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a_key2") == F.col("b_key2")) & (F.col("a_id") < F.col("b_id")) & near(num, den)
    return side("a").join(side("b"), on).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()
