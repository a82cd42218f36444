"""Exact n-gram Jaccard self-join by universe partitions and the pigeonhole principle, and its components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets r and s with Jaccard similarity of at
least 0.8 differ in at most (|r| + |s|) / 9 tokens, and their sizes fall in the same or in neighbouring size bands.

* Each band has a scheme that hashes tokens into segments. Of more segments than differences some must agree: the sets'
  keys are the hashes of their segments' subsets. Where it costs less (short texts), a scheme has half as many segments
  and keys for each subset and its one-deletion neighbourhood, as one of them then differs in one token at most.
* Empty segments agree between unrelated sets. A scheme has ``slack`` more segments than it needs, so a set with no more
  than that many empty ones leaves them out; only sets with more emit them. ``allocation`` weighs slack, deletions
  and the chance of too many empty segments, and picks the cheapest.
* A set's keys are dealt out by hash as packed runs, to a number of buckets that follows the number of tokens. Keys held
  by several different sets are its candidates.
* Round one links every member of a shared key to the key's busiest set; verified links merge into components. Round two
  looks only at keys that still hold several components. It compares sets of different components by parity
  bitmaps, whose Hamming distance never exceeds the true difference, and verifies what passes. Sets of more tokens than
  a bitmap has bits have a second one of as many bits as tokens, since the first would rule nothing out. Every pair of a key
  is so either in one component already, or ruled out exactly, or verified on the whole sets. No pairs of copies or of
  a key's largest component are made, and nothing is capped. A key with more than ``BLOCK`` members is cut into blocks of
  its largest component and of the others, and pairs of blocks are dealt out as units of their own: the comparisons of
  unlinked members grow with the square of their number, but no task has more than some units of ``BLOCK`` squared.
* A component's lowest document comes from a partial aggregation by label and a join back, on rows of two or three longs;
  adaptive execution splits the join where one component has most of the rows.

Equal sets are one node from the start (``sid``, checked against a second hash), so groups of exact copies of any size
cost a row each. Texts without words, empty and null texts have an empty set and are linked with nothing. Documents that
share an id are separate texts. Rows with a null id have a set and a null component; they link nothing. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import released, removed, stored
from .components import components
from .segments import gathered, slices, whole_texts

SHINGLE = 5
#: Similarity of at least 4/5, so sizes differ by a factor of 5/4 at most and sets by (r + s) / 9 tokens.
SIMILAR = (80, 100)
BITMAP_WORDS = 16
#: Tokens of different sets a bucket of keys; a bucket's task sorts about half as many keys at once.
TOKENS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 100_000
#: Members of one key compared in one unit, on each side.
BLOCK = 2000

def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending within a text, and where each text's begin and end."""
    n = len(texts)
    spaced = texts
    for other in "\t\n\v\f\r":
        spaced = pc.replace_substring(spaced, other, " ")
    split = pc.split_pattern(spaced, " ")
    flat = split.flatten()
    owner = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = pc.dictionary_encode(flat)
    at = coded.indices.to_numpy().astype(np.int64)
    # Lower-casing the slice itself would go wrong: that kernel misreads arrays that begin inside a buffer.
    pool = pc.ascii_lower(coded.dictionary).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pool), np.uint64, len(pool))
    filled = np.fromiter((bool(w) for w in pool), bool, len(pool))[at] if len(pool) else np.zeros(0, bool)
    word, owner = hashes[at[filled]] if len(pool) else np.zeros(0, np.uint64), owner[filled]
    counts = np.bincount(owner, minlength=n)
    starts = np.cumsum(counts) - counts
    if len(word) < SHINGLE:
        full = np.zeros(0, np.int64)
    else:
        full = np.flatnonzero(owner[: len(owner) - SHINGLE + 1] == owner[SHINGLE - 1 :])
    sums = np.zeros(len(full), np.uint64)
    for k in range(SHINGLE):
        sums += word[full + k] * _MULTIPLIERS[k]
    values, owners = [mixed(sums)], [owner[full]]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            total[has] += word[starts[short[has]] + k] * _MULTIPLIERS[k]
        values.append(mixed(total + counts[short].astype(np.uint64), 1))
        owners.append(short)
    value, who = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    value, who = value[new], who[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum, modulo 2**64, of each run of values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    size = np.diff(bounds).astype(np.uint64)
    return (
        mixed(_sums(mixed(values, 2), bounds) + size, 3).astype(np.int64),
        mixed(_sums(mixed(values, 4), bounds) + size, 5).astype(np.int64),
    )


# One for each place in a shingle, without any relation between them: words that change places must change the sum.
_MULTIPLIERS = mixed(np.arange(SHINGLE, dtype=np.uint64), 10) | np.uint64(1)


@dataclass(frozen=True)
class Scheme:
    """How sets of one band, and those of the next, are cut for pairs whose smaller set is of this band."""

    number: int
    least: int
    most: int
    deletions: bool
    slack: int
    segments: int

    def needed(self, size: int) -> int:
        """Segments of which one must agree (or nearly), for a set of this size with any partner under this scheme."""
        smaller = min(size, self.most)
        larger = max(size, smaller * 5 // 4) if size <= self.most else size
        return _needed((smaller + larger) // 9, self.deletions)


def _needed(differences: int, deletions: bool) -> int:
    return (differences // 2 if deletions else differences) + 1


def _tail(mean: float, slack: int) -> float:
    """Chance that a Poisson number is above ``slack``."""
    term = total = math.exp(-mean)
    for k in range(1, slack + 1):
        term *= mean / k
        total += term
    return max(0.0, 1 - total)


def allocation(number: int, least: int, most: int, per_overflow: float = 5000.0) -> Scheme:
    """The cheapest cut for a band: keys a set emits, and the cost of sets with more trivial segments than the slack.

    The sets that overflow meet in a few common keys, so one is charged like ``per_overflow`` keys. Above some
    thousands of tokens the choice no longer changes, and the slack follows from the expected number of empty segments.
    """
    differences = (most + most * 5 // 4) // 9
    if most > 3000:
        need = _needed(differences, False)
        expected = need * math.exp(-least / (1.06 * need))
        slack = int(expected + 6 * math.sqrt(expected) + 6)
        return Scheme(number, least, most, False, slack, need + slack)
    best = None
    for deletions in (False, True):
        need = _needed(differences, deletions)
        if deletions and need == 1:
            slacks = range(1)
        else:
            slacks = range(8 + need // 4)
        for slack in slacks:
            m = need + slack
            mean = least / m
            trivial = 0 if m == 1 else m * math.exp(-mean) * (1 + mean * deletions)
            cost = m + most * deletions + per_overflow * _tail(trivial, slack)
            if best is None or cost < best[0]:
                best = cost, Scheme(number, least, most, deletions, slack, m)
    return best[1]


@lru_cache(1)
def bands(largest: int = 1 << 40) -> tuple[np.ndarray, tuple[Scheme, ...]]:
    """Upper ends of the bands, and each band's scheme; a set's partners lie in its own band or the next to it."""
    ends, schemes = [], []
    end = 0
    while end < largest:
        begin, end = end + 1, max(end + 1, end * 5 // 4)
        schemes.append(allocation(len(ends), begin, end))
        ends.append(end)
    return np.array(ends, np.int64), tuple(schemes)


def keys_of(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate keys of many sets: (key, number of the set)."""
    ends, schemes = bands()
    sizes = np.diff(bounds)
    band = np.searchsorted(ends, sizes)
    out_keys, out_sets = [], []
    for b in np.unique(band[sizes > 0]).tolist():
        members = np.flatnonzero((band == b) & (sizes > 0))
        for scheme in {schemes[b], schemes[max(b - 1, 0)]}:
            if (scheme.most + scheme.most * 5 // 4) // 9 == 0:
                continue  # such small sets are similar only when equal
            keys, who = _scheme_keys(scheme, members, values, bounds, sizes)
            out_keys.append(keys)
            out_sets.append(who)
    if not out_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_sets)


def _scheme_keys(scheme: Scheme, members, values, bounds, sizes) -> tuple[np.ndarray, np.ndarray]:
    m = scheme.segments
    used = np.array([scheme.needed(s) for s in sizes[members].tolist()], np.int64) + scheme.slack
    used = np.minimum(used, m)
    tokens = values[gathered(bounds[members], sizes[members])]
    row = np.repeat(np.arange(len(members)), sizes[members])
    scrambled = mixed(tokens, 6 + scheme.number)
    segment = ((scrambled >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    inside = segment < used[row]
    tokens, row, segment = scrambled[inside], row[inside], segment[inside]
    cell = row * m + segment
    count = np.bincount(cell, minlength=len(members) * m).reshape(-1, m)
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(count.ravel())
    sums = _sums(tokens[order], np.concatenate([[0], ends])).reshape(-1, m)
    tag = mixed(np.arange(m, dtype=np.uint64) + np.uint64(scheme.number << 32), 7)
    valid = np.arange(m)[None, :] < used[:, None]
    trivial = valid & (count <= (1 if scheme.deletions and m > 1 else 0))
    overflow = trivial.sum(1) > scheme.slack
    # A set with few empty segments leaves them out, and its deletions down to nothing too.
    empty = (count == 0) & valid
    emit = valid & (~empty | overflow[:, None])
    r, s = np.nonzero(emit)
    keys, who = [mixed(sums[r, s] ^ tag[s], 8)], [members[r]]
    if scheme.deletions:
        keep = (count[row, segment] > 1) | overflow[row] | (m == 1)
        keys.append(mixed((sums[row, segment] - tokens)[keep] ^ tag[segment[keep]], 8))
        who.append(members[row[keep]])
    return np.concatenate(keys), np.concatenate(who)


def parity_bitmaps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One bitmap a set: each token flips one bit, so two bitmaps differ in no more bits than their sets in tokens."""
    bits = BITMAP_WORDS * 64
    n = len(bounds) - 1
    who = np.repeat(np.arange(n), np.diff(bounds))
    bit = (mixed(values, 9) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(who * bits + bit, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.uint64)


def fine_bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A parity bitmap of at least as many bits as tokens, a power of two, for each set too large for the common one."""
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    for i in np.flatnonzero(np.diff(bounds) > BITMAP_WORDS * 64).tolist():
        own = values[bounds[i] : bounds[i + 1]]
        bits = 1 << (len(own) - 1).bit_length()
        odd = np.bincount((mixed(own, 9) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return out


def _finely_near(x: bytes | None, y: bytes | None, limit: int) -> bool:
    """Whether the fine bitmaps of two sets, if both have one, differ in ``limit`` bits at most; the longer is folded."""
    if x is None or y is None:
        return True
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= limit


# Spark stages ---------------------------------------------------------------------------------------------------------


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            values, bounds = shingle_sets(whole_texts(rows.column("text")))
            sid, check = set_ids(values, bounds)
            maps = pa.array([m.tobytes() for m in parity_bitmaps(values, bounds)], pa.binary())
            fine = pa.array(fine_bitmaps(values, bounds), pa.binary())
            arrays = [rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sid), pa.array(check), maps, fine]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "sid", "check", "bitmap", "fine"])


def _dealt_keys(batches: Iterator[pa.RecordBatch], buckets: int, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Packed keys: for each bucket the sets that have some, how many each, and the keys' low 40 bits."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        key, sid = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (key >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((sid, bucket))
        key, sid, bucket = key[order], sid[order], bucket[order].astype(np.int64)
        low = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.unique(bucket).tolist():
            x, y = cuts[b], cuts[b + 1]
            own, counts = np.unique(sid[x:y], return_counts=True)
            head = zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes())
            rows.append((b, own.astype("<i8").tobytes(), head, low[x:y].tobytes()))
        names = ["bucket", "sids", "counts", "keys"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    total = 0
    for batch in batches:
        for rows in slices(batch, "text"):
            values, bounds = shingle_sets(whole_texts(rows.column("text")))
            sid, _ = set_ids(values, bounds)
            # Equal sets count once a task.
            _, first = np.unique(sid, return_index=True)
            new = np.zeros(len(sid), bool)
            new[[i for i in first.tolist() if int(sid[i]) not in seen]] = True
            seen.update(sid[new].tolist())
            if not new.any():
                continue
            picked = np.flatnonzero(new)
            lengths = np.diff(bounds)[picked]
            values = values[gathered(bounds[picked], lengths)]
            keys, who = keys_of(values, np.concatenate([[0], np.cumsum(lengths)]))
            if len(keys):
                held.append((keys, sid[picked][who]))
                total += len(keys)
            if total >= flush:
                yield packed()
                total = 0
    if held:
        yield packed()


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sid, members) for the keys of a bucket that several different sets hold."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), "<u4").astype(np.int64)
            sid = np.repeat(np.frombuffer(row["sids"], "<i8"), counts)
            parts.setdefault(row["bucket"], []).append((wide.view(np.uint64).ravel(), sid))
    while parts:
        bucket, own = parts.popitem()
        key, sid = (np.concatenate(x) for x in zip(*own, strict=True))
        del own
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[new], sid[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        members = np.diff(np.concatenate([starts, [len(key)]]))
        many = np.repeat(members, members)
        keep = many > 1
        full = (key[keep] + np.uint64((bucket << 40) & (2**64 - 1))).astype(np.int64)
        for i in range(0, len(full), 100_000):
            j = slice(i, i + 100_000)
            arrays = [pa.array(full[j]), pa.array(sid[keep][j]), pa.array(many[keep][j])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "sid", "members"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            values, bounds = shingle_sets(whole_texts(rows.column("text")))
            sid, _ = set_ids(values, bounds)
            raw, ends = values.astype("<u8").tobytes(), (8 * bounds).tolist()
            tokens = pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sid), tokens], names=["sid", "tokens"])


PAIR_SCHEMA = "a long, b long"
PAIR = ["a", "b"]


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bitmaps don't rule similarity out."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
        x, y = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)
            for c in ("a_bitmap", "b_bitmap")
        )
        good = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.bitwise_count(x ^ y).sum(1) <= (n + m) // 9)
        fine = zip(*(batch.column(c).to_pylist() for c in ("a_fine", "b_fine")), strict=True)
        limits = ((n + m) // 9).tolist()
        good &= np.fromiter((_finely_near(*f, most) for f, most in zip(fine, limits, strict=True)), bool, len(good))
        yield batch.select(PAIR).filter(pa.array(good))


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    place = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(place, len(y) - 1)] == x)) if len(y) else 0
    union = len(x) + len(y) - both
    return union > 0 and SIMILAR[1] * both >= SIMILAR[0] * union


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist(), strict=True)
        good = pa.array([similar(x, y) for x, y in tokens], pa.bool_())
        yield batch.select(PAIR).filter(good)


#: Most rows, of 64 bits each, of the bitmap that stands for the ids of wanted texts, and most ids it is used for.
BITMAP_ROWS = 1 << 20
BITMAP_IDS = BITMAP_ROWS * 8


def _texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``named`` whose ids are in the (stored) ``wanted``, and perhaps a few others.

    Up to ``BITMAP_IDS`` ids are broadcast as a bitmap of bounded size, so that texts stay where they are; an eighth of the
    other rows pass it at most. More ids than that are joined with the texts by a shuffle.
    """
    ids = wanted.count()
    if ids > BITMAP_IDS:
        return named.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    rows = min(BITMAP_ROWS, 1 << (ids // 2).bit_length())
    hashed = F.xxhash64("doc_id")
    place, bit = F.pmod(F.shiftright(hashed, 6), F.lit(rows)), F.pmod(hashed, F.lit(64)).cast("int")
    bits = wanted.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    marked = named.withColumn("place", place).withColumn("bit", bit).join(F.broadcast(bits), "place")
    return marked.filter(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1L")).select(*named.columns)


def _links(pairs: DataFrame, firsts: DataFrame, named: DataFrame) -> DataFrame:
    """Those of the (stored) pairs that are similar, by the whole sets of their texts; stored."""
    spark = pairs.sparkSession
    members = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted = stored(
        firsts.join(members, "sid", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct(), "wanted"
    )
    # More sets than wanted take no part in the joins below.
    sets = stored(_texts_of(named, wanted).mapInArrow(_whole_sets, "sid long, tokens binary"), "whole")
    removed(spark, wanted)
    released(spark)
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(right, "b").join(left, "a").select(*PAIR, "a_tokens", "b_tokens")
    links = stored(both.mapInArrow(_verified, PAIR_SCHEMA), "links")
    removed(spark, sets)
    released(spark)
    return links


#: The columns that name a unit of comparisons.
UNIT = ["key", "kind", "u", "v"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units, from batches sorted by unit."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # All but the last unit are complete; the last one may go on.
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in UNIT:
            values = batch.column(c).to_numpy()
            changed |= values[1:] != values[:-1]
        last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        if pending and any(pending[-1].column(c)[-1] != batch.column(c)[0] for c in UNIT):
            yield pa.Table.from_batches(pending)
            pending = []
        if last:
            yield pa.Table.from_batches([*pending, batch.slice(0, last)])
            pending = []
        pending.append(batch.slice(last))
    if pending:
        yield pa.Table.from_batches(pending)


def _compared(key, within, side, label, n, maps, chunk: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs of one unit and of different components whose sizes and bitmaps let them be similar.

    ``key`` numbers the units. Within a unit that is ``within``, all rows but those of its largest component are compared
    with those before them; in others the rows of side 1 with those of side 0.
    """
    rows = np.lexsort((label, key))
    k, name = key[rows], label[rows]
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (name[1:] != name[:-1])]))
    lengths = np.diff(np.append(starts, len(rows)))
    order = np.lexsort((-lengths, k[starts]))
    largest = order[np.unique(k[starts][order], return_index=True)[1]]
    is_rest = np.ones(len(starts), np.int8)
    is_rest[largest] = 0
    later = np.where(within[rows], np.repeat(is_rest, lengths), side[rows])
    order = np.lexsort((later, k))
    rows, k, later = rows[order], k[order], later[order]
    begin = np.searchsorted(k, k)
    fronts = np.bincount(k, 1 - later, k.max() + 1).astype(np.int64)[k]
    back = np.where(later == 0, 0, np.where(within[rows], np.arange(len(rows)) - begin, fronts))
    at = np.flatnonzero(back)
    ends = np.cumsum(back[at])
    head = np.ascontiguousarray(maps[:, : BITMAP_WORDS // 4])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, side="right")))
        x = np.repeat(rows[at[i:j]], back[at[i:j]])
        y = rows[gathered(begin[at[i:j]], back[at[i:j]])]
        i = j
        low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fits = np.flatnonzero((5 * low >= 4 * high) & (label[x] != label[y]))
        x, y = x[fits], y[fits]
        # A part of the bitmap bounds the difference too, and rules most pairs out.
        for part in (head, maps):
            near = np.bitwise_count(part[x] ^ part[y]).sum(1) <= (n[x] + n[y]) // 9
            x, y = x[near], y[near]
        yield x, y


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that ``_compared`` leaves, of all units."""
    for table in _units(batches):
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
        sid, n, kind, u, v = (column(c) for c in ("sid", "n", "kind", "u", "v"))
        new = np.concatenate([[False], np.any([column(c)[1:] != column(c)[:-1] for c in UNIT], axis=0)])
        maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)
        fine = table.column("fine").to_pylist()
        long = np.fromiter((f is not None for f in fine), bool, len(fine))
        unit = np.cumsum(new)
        for x, y in _compared(unit, (kind == 1) & (u == v), column("side"), column("label"), n, maps):
            both = np.flatnonzero(long[x] & long[y])
            limits = ((n[x] + n[y])[both] // 9).tolist()
            near = np.ones(len(x), bool)
            pairs = zip(x[both].tolist(), y[both].tolist(), limits, strict=True)
            near[both] = [_finely_near(fine[i], fine[j], most) for i, j, most in pairs]
            x, y = x[near], y[near]
            if len(x):
                a, b = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=PAIR)


def _checked(summaries: DataFrame) -> DataFrame:
    """(sid, n, first_doc, bitmap): one row a set; raises if one sid ever stood for two sets."""
    grouped = summaries.filter("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("first_doc"),
        F.min("check").alias("c0"),
        F.max("check").alias("c1"),
        F.min("n").alias("n"),
        F.max("n").alias("n1"),
        F.first("bitmap").alias("bitmap"),
        F.first("fine").alias("fine"),
    )
    same = (F.col("c0") == F.col("c1")) & (F.col("n") == F.col("n1"))
    clash = F.raise_error(F.lit("two different sets share a 64-bit id")).cast("long")
    return grouped.select(F.when(same, F.col("sid")).otherwise(clash).alias("sid"), "n", "first_doc", "bitmap", "fine")


def _buckets(firsts: DataFrame) -> int:
    """How many buckets the keys of these sets are dealt to."""
    tokens = firsts.agg(F.sum("n")).first()[0] or 0
    least = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_BUCKETS, -(-tokens // TOKENS_PER_BUCKET)))


def _shared(named: DataFrame, buckets: int) -> DataFrame:
    """(key, sid, members) of all keys that several sets hold; stored."""
    schema = "bucket long, sids binary, counts binary, keys binary"
    dealt = named.mapInArrow(lambda b: _dealt_keys(b, buckets), schema)
    # By its own number, as hashes of so few numbers would leave some tasks empty and load others.
    dealt = dealt.repartitionById(buckets, F.col("bucket").cast("int"))
    return stored(dealt.mapInArrow(_shared_keys, "key long, sid long, members long"), "keys")


def _stars(shared: DataFrame, firsts: DataFrame) -> DataFrame:
    """Round one's plausible pairs: every member of a key with the key's busiest set; stored."""
    busy = shared.groupBy("sid").agg(F.sum("members").alias("busy"))
    middle = shared.join(busy, "sid").groupBy("key").agg(F.max(F.struct("busy", "sid"))["sid"].alias("center"))
    pairs = shared.join(middle, "key").filter("sid <> center").select(
        F.least("sid", "center").alias("a"), F.greatest("sid", "center").alias("b")
    )
    side = lambda k: firsts.select(
        F.col("sid").alias(k),
        F.col("n").alias(f"{k}_n"),
        F.col("bitmap").alias(f"{k}_bitmap"),
        F.col("fine").alias(f"{k}_fine"),
    )
    both = pairs.distinct().join(side("b"), "b").join(side("a"), "a")
    return stored(both.mapInArrow(_plausible, PAIR_SCHEMA), "pairs")


def _in_units(rows: DataFrame) -> DataFrame:
    """Rows (key, sid, members, label) of keys that hold several components, with each unit they take part in.

    Keys of at most ``BLOCK`` members are one unit. Of others, (0, u, v) is block u of the largest component with block v
    of the rest, and (1, u, v) two blocks of the rest; ``side`` is 0 for block u and 1 for block v.
    """
    unit = lambda kind, u, v, side: F.struct(
        F.lit(kind).alias("kind"), u.cast("int").alias("u"), v.cast("int").alias("v"), F.lit(side).cast("int").alias("side")
    )
    small = rows.filter(F.col("members") <= BLOCK).select(
        "key", "sid", "label", unit(1, F.lit(0), F.lit(0), F.lit(0)).alias("unit")
    )
    large = rows.filter(F.col("members") > BLOCK)
    counts = large.groupBy("key", "label").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("total")
    ).select(
        "key",
        F.col("main.label").alias("main"),
        F.ceil(F.col("main.n") / BLOCK).alias("mains"),
        F.ceil((F.col("total") - F.col("main.n")) / BLOCK).alias("rests"),
    )
    dealt = large.join(kinds, "key").withColumn("hash", F.xxhash64("sid"))
    own_main, own_rest = F.pmod("hash", "mains"), F.pmod("hash", "rests")
    others = F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)
    as_main = F.transform(others, lambda j: unit(0, own_main, j, F.lit(0)))
    as_rest = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda i: unit(0, i, own_rest, F.lit(1))),
        F.transform(
            others, lambda j: unit(1, F.least(own_rest, j), F.greatest(own_rest, j), F.when(own_rest <= j, 0).otherwise(1))
        ),
    )
    units = F.when(F.col("label") == F.col("main"), as_main).otherwise(as_rest)
    return small.unionByName(dealt.select("key", "sid", "label", F.explode(units).alias("unit"))).select(
        "key", "sid", "label", "unit.*"
    )


def _crossings(shared: DataFrame, firsts: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Round two's plausible pairs: those of one key and of different components; stored."""
    marked = shared.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", "members", F.coalesce("label", "sid").alias("label")
    )
    ends = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    left = marked.join(ends.filter("x <> y").select("key"), "key", "left_semi")
    rows = _in_units(left).join(firsts.select("sid", "n", "bitmap", "fine"), "sid").repartition(buckets, *UNIT).sortWithinPartitions(*UNIT)
    return stored(rows.mapInArrow(_crossing, PAIR_SCHEMA).distinct(), "pairs")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` doc_id, n and sid; and per sid the lowest id of its component and whether it ``keeps``.

    One set of a component keeps: the least of those that the lowest id has. Both stored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    summaries = stored(
        rows.mapInArrow(_summaries, "doc_id long, n long, sid long, check long, bitmap binary, fine binary"), "sets"
    )
    firsts = stored(_checked(summaries.filter(F.col("doc_id").isNotNull())), "firsts")
    buckets = _buckets(firsts)
    shared = _shared(named, buckets)
    released(spark)

    stars = _stars(shared, firsts)
    released(spark)
    first = _links(stars, firsts, named)
    labels = stored(components(first), "labels")

    crossing = _crossings(shared, firsts, labels, buckets)
    released(spark)
    second = _links(crossing, firsts, named)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(known.unionByName(second))

    least = firsts.join(final.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "first_doc", F.coalesce("label", "sid").alias("label")
    )
    lowest = least.groupBy("label").agg(F.min(F.struct("first_doc", F.col("sid").alias("keeper"))).alias("least"))
    named_sets = stored(
        least.join(lowest, "label").select(
            "sid", F.col("least.first_doc").alias("lowest"), (F.col("sid") == F.col("least.keeper")).alias("keeps")
        ),
        "classes",
    )
    for done in (shared, stars, first, labels, crossing, second, firsts):
        removed(spark, done)
    released(spark)
    return summaries.select("doc_id", "n", "sid"), named_sets


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    summaries, named_sets = _classes(docs)
    joined = summaries.join(named_sets, "sid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    )


def _with_sets(docs: DataFrame) -> DataFrame:
    """``docs`` with the size and the id of each row's set, ``_n`` and ``_sid``."""
    names = [*docs.columns, "_n", "_sid"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                values, bounds = shingle_sets(whole_texts(rows.column("text")))
                arrays = [*rows.columns, pa.array(np.diff(bounds)), pa.array(set_ids(values, bounds)[0])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(made, StructType([*docs.schema.fields, StructField("_n", LongType()), StructField("_sid", LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``, of those with its lowest id; rows without an id or a set stay.

    A document is an id with a set: rows that share an id are judged by their own sets, and where one component has
    several sets of its lowest id, one of them stays. Repeated rows of the document that stays all stay.
    """
    summaries, named_sets = _classes(docs)
    joined = summaries.filter(F.col("doc_id").isNotNull()).join(named_sets, "sid", "left")
    out = (F.col("n") > 0) & ~(F.col("keeps") & (F.col("doc_id") == F.col("lowest")))
    by_id = joined.groupBy("doc_id").agg((F.count("*") > 1).alias("shared"), F.max(out).alias("out"))
    marked = stored(by_id.filter("shared OR out"), "marked")
    once = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Few as a rule, if any; kept apart so that the texts of all others aren't moved for them.
    shared = stored(marked.filter("shared").select("doc_id"), "shared")
    rows = _with_sets(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    keepers = named_sets.filter("keeps").select(F.col("lowest").alias("doc_id"), F.col("sid").alias("_sid"))
    kept = rows.filter("_n > 0").join(keepers, ["doc_id", "_sid"], "left_semi").unionByName(rows.filter("_n = 0"))
    return once.unionByName(kept.select(*docs.columns))
