"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets fall into bands of size [l, l / t], t the least similarity.  Two sets that link lie in one band or in neighbouring
ones, so each set has signatures for its own band and for the next.  In a band of sizes up to r, linked sets differ in
at most k = (1 - t) / (1 + t) * 2r features.  The feature domain is cut by a hash into n1 parts, at least (k + 1) / (k2 + 1),
one of which holds at most k2 differences; each part is cut into n2 subparts, and one subset of n2 - k2 of them holds
none: a signature is the hash of what a set has in such a subset.  A subset that is empty in both sets (a gap) tells nothing
and is no signature.  With g parts to spare, a linked pair without a common signature shares gaps in more than g parts,
so both sets have that many: such a set is cut again by another hash, as often as it takes.  The first of the two that has
no more than g gaps then shares a signature with the other, which was cut alike.  So no linked pair is lost, at any size;
g is what makes the expected number of signatures smallest.

Documents of one set are one class before anything else.  Signatures give candidate families.  Parity sketches, four
bits or more for each allowed difference, split these: a pair that differs in more bits than it may in features cannot
link, which is exact and takes a seventieth of the sets' bytes.  What is left of each family has its sets
compared in blocks by products of incidence matrices, and a block pair gives one row a set: its root in the block pair's
forest and its number of links.  Pairs are never written out.  Components of the roots are the result.

Defined cases: null and blank texts have the empty set and link with nothing; texts of fewer than n words have their whole
sequence as one feature; repeated rows and rows of one id are one document; rows without an id belong to their copies' class;
an empty table gives no rows; other columns are ignored. A long text costs memory of its own features only.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks, stored
from tidemark.llm.components import components, roots, tree
from tidemark.llm.word_hash import mix, shingles, words

#: Second-level subparts, and differences allowed in a part.
N2, K2 = 3, 1
#: Sets and features of a family's block, sets of small families in a task's group, and features multiplied at once.
BLOCK, BLOCK_FEATURES, GROUP, FEATURES = 1024, 600_000, 1024, 2048
#: Rows from which a class is hot, and the most classes that can be: the bound rises with the rows.
HOT_ROWS, HOT_CLASSES = 1000, 100_000
#: Rows of (id, family) that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 2_000_000
#: Features for which there is one bucket of signatures, buckets that a task takes in turn, and the least number of tasks.
FEATURES_A_BUCKET, BUCKETS_A_TASK, LEAST_TASKS = 1_000_000, 8, 8
#: Signatures, or edges, that a task holds before it sends them.
HELD = 300_000
CHUNK = 1_000_000
_U = np.uint64


class Parts(NamedTuple):
    """Parts of the domain (0: each feature is a signature), and how many of them may have gaps without harm."""

    parts: int
    spare: int


def _chance(n: int, most: int, p: float) -> float:
    """That of n parts at most so many have gaps."""
    p = min(max(p, 1e-300), 1 - 1e-16)
    k = np.arange(1, most + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) / k) + math.log(p) - math.log1p(-p))]) + n * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


@cache
def parts(differences: int, smallest: int, largest: int, n2: int, k2: int) -> Parts:
    """The cut with the fewest signatures for sets of smallest to largest features, expected over their sizes."""
    fewest = -(-(differences + 1) // (k2 + 1))
    if smallest < fewest * (k2 + 1):  # such a set has gaps under every hash
        return Parts(0, 0)
    best = (math.inf, Parts(fewest, 0))
    for spare in sorted({int(1.1**k) - 1 for k in range(1, 20 + int(math.log(fewest + 8, 1.1)))}):
        n, cost = fewest + spare, 0.0
        for size in np.linspace(smallest, largest, 7):
            empty = math.exp(-size / (n * n2))
            gap = sum(math.comb(n2, k) * (1 - empty) ** k * empty ** (n2 - k) for k in range(k2 + 1))
            cost += n / max(_chance(n, spare, gap), 1e-9)
        best = min(best, (cost, Parts(n, spare)))
    return best[1]


class Bands:
    """Bounds of the size bands and the differences that each allows, in whole numbers."""

    def __init__(self, least: Fraction) -> None:
        self.least = least
        self._low = np.array([1])

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self._low[-1] <= max(sizes.max(initial=1), 1):
            self._low = np.append(self._low, self.high(self._low[-1]) + 1)
        return np.searchsorted(self._low, sizes, "right") - 1

    def high(self, low: int) -> int:
        return int(low) * self.least.denominator // self.least.numerator

    def parts(self, band: int, n2: int, k2: int) -> Parts:
        return parts(self.differences(band), int(self._low[max(band - 1, 0)]), self.high(self._low[band]), n2, k2)

    def bits(self, band: int) -> int:
        """Size of the sketches of a band: a power of two above four times what sets of it or the next may differ in."""
        return 1 << max(6, (4 * self.differences(band + 1)).bit_length())

    def differences(self, band: int) -> int:
        while len(self._low) <= band:
            self._low = np.append(self._low, self.high(self._low[-1]) + 1)
        t = self.least
        return (t.denominator - t.numerator) * 2 * self.high(self._low[band]) // (t.denominator + t.numerator)


def sketch(features: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the features' counts by hash: sketches differ in at most as many bits as sets in features."""
    return np.bincount((mix(features ^ _U(0x3C3C3C3CC3C3C3C3)) % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1


def signatures(sets: list[np.ndarray], bands: Bands, n2: int = N2, k2: int = K2) -> list[np.ndarray]:
    """The signatures of each set, for its band and the next."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    sizes = np.array([len(s) for s in sets])
    band = bands.of(sizes)
    for step in (0, 1):
        # without differences only equal sets link, and these are one class
        plans = {b: bands.parts(b + step, n2, k2) for b in np.unique(band[sizes > 0]).tolist() if bands.differences(b + step)}
        used = np.array([i for i, (b, n) in enumerate(zip(band.tolist(), sizes.tolist(), strict=True)) if n and b in plans], np.int64)
        for i in [i for i in used.tolist() if not plans[band[i]].parts]:
            out[i].append(mix(sets[i] + _U(band[i] + step + 1)))
        used = np.array([i for i in used.tolist() if plans[band[i]].parts], np.int64)
        times = 0
        while len(used):
            parts = np.array([plans[b].parts for b in band[used].tolist()])
            spare = np.array([plans[b].spare for b in band[used].tolist()])
            base = np.concatenate([[0], np.cumsum(parts)])
            features = np.concatenate([sets[i] for i in used])
            owner = np.repeat(np.arange(len(used)), sizes[used])
            times += 1
            spread = mix(features ^ mix(np.array([0xA5A5A5A55A5A5A5A + times], _U)))
            cell = (base[owner] + ((spread >> _U(20)) % parts[owner].astype(_U)).astype(np.int64)) * n2 + (spread % _U(n2)).astype(np.int64)
            sums = np.zeros(base[-1] * n2, _U)
            np.add.at(sums, cell, spread)
            filled = np.bincount(cell, minlength=base[-1] * n2).reshape(-1, n2)
            sums = sums.reshape(-1, n2)
            number = (np.arange(base[-1]) - np.repeat(base[:-1], parts)).astype(_U)
            place = (band[used] + step + 1).astype(_U) + (_U(times) << _U(32))
            salt = mix(np.repeat(place, parts) * _U(0x1000003) + number * _U(0x100000001B3))
            gap = np.zeros(base[-1], bool)
            for k, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
                some = filled[:, subset].sum(1) > 0
                gap |= ~some
                found = mix(sums[:, subset].sum(1, dtype=_U) + salt + _U(k + 1))[some]
                ends = np.concatenate([[0], np.cumsum(some)])[base]
                for j, i in enumerate(used.tolist()):
                    out[i].append(found[ends[j] : ends[j + 1]])
            used = used[np.add.reduceat(gap, base[:-1], dtype=np.int64) > spare]
    return [np.concatenate(x) if x else np.zeros(0, _U) for x in out]


def described(docs: DataFrame, n: int, least: Fraction) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, sketch, band of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(least)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                sets = shingles(*words(texts[lo:hi]), n)
                keys = [_key(s) for s in sets]
                size = np.array([len(s) for s in sets])
                sketches = [np.packbits(sketch(s, bands.bits(b))).tobytes() for s, b in zip(sets, bands.of(size).tolist(), strict=True)]
                band = pa.array(bands.of(size).astype(np.int32))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), band], names=["doc_id", "text_hash", "n_shingles", "set_key", "sketch", "band"])

    return _texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(describe, "doc_id long, text_hash long, n_shingles long, set_key binary, sketch binary, band int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _key(features: np.ndarray) -> bytes | None:
    return hashlib.blake2b(features.tobytes(), digest_size=16).digest() if len(features) else None


def _stars(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, their smallest node, which are shared, and edges from the other nodes to it."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    first = np.ones(len(sigs), bool)
    first[1:] = sigs[1:] != sigs[:-1]
    hub = nodes[first][np.cumsum(first) - 1]
    other = nodes != hub
    edges = np.unique(np.stack([nodes[other], hub[other]], 1), axis=0)
    shared = np.add.reduceat(~first, np.flatnonzero(first)) > 0 if len(first) else first
    return sigs[first], nodes[first], shared, edges[:, 0], edges[:, 1]


def _edges(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes of a signature and its smallest one. Only shared signatures' nodes are ever put in order."""
    order = np.argsort(sigs)
    same = sigs[order[1:]] == sigs[order[:-1]]
    several = np.zeros(len(sigs), bool)
    several[1:] = same
    several[:-1] |= same
    kept = order[several]
    _, _, _, u, v = _stars(sigs[kept], nodes[kept])
    return u, v


class _Known:
    """Signatures that several documents of a task had before, with the node that was sent: a table of bounded size, which may forget."""

    def __init__(self, slots: int = 1 << 19) -> None:
        self._sig, self._node, self._mask = np.zeros(slots, _U), np.zeros(slots, np.int64), _U(slots - 1)

    def take(self, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are known, and their nodes."""
        at = (sigs & self._mask).astype(np.int64)
        return (self._sig[at] == sigs) & (sigs > 0), self._node[at]

    def add(self, sigs: np.ndarray, nodes: np.ndarray) -> None:
        at = (sigs & self._mask).astype(np.int64)
        one = np.unique(at, return_index=True)[1]
        self._sig[at[one]], self._node[at[one]] = sigs[one], nodes[one]


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lower bytes of whole numbers, those of one weight together, which compresses."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def star_edges(rows: DataFrame, n: int, least: Fraction, buckets: int) -> DataFrame:
    """u, v: ids of rows (doc_id, text) that signatures join to a smaller one; edges may repeat.

    A task sends a signature that several of its documents have once, with the smallest id that its signatures join them to;
    their edges to that one go along as a tree, so a signature that very many share has one row a task.  Signatures are cut to a bucket and 40 bits: a
    chance match makes two sets candidates, no more, and is as rare at any size since buckets keep theirs.  A row has the
    signatures of one bucket in the order of their ids, of which only steps are sent.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, known = Bands(least), _Known()
        held: list[list[np.ndarray]] = [[], []]

        def send() -> Iterator[pa.RecordBatch]:
            sigs, nodes, shared, u, v = _stars(*map(np.concatenate, held))
            held[0].clear(), held[1].clear()
            again, sent_with = known.take(sigs)
            u, v = tree(np.concatenate([u, nodes[again]]), np.concatenate([v, sent_with[again]]))
            # one node stands for all that the task has joined
            place = np.minimum(np.searchsorted(u, nodes), max(len(u) - 1, 0))
            nodes = np.where(u[place] == nodes, v[place], nodes) if len(u) else nodes
            known.add(sigs[shared & ~again], nodes[shared & ~again])
            sigs, nodes = sigs[~again], nodes[~again]
            bucket = (sigs % _U(buckets)).astype(np.int32)
            order = np.lexsort((nodes, bucket))
            bucket, part, nodes = bucket[order], sigs[order] >> _U(24), nodes[order]
            marks = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for a, b in zip(marks.tolist(), [*marks[1:].tolist(), len(bucket)], strict=True):
                step = np.diff(nodes[a:b]).astype(_U)
                width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
                rows.append((int(bucket[a]), int(nodes[a]), width, _planes(part[a:b], 5), _planes(step, width)))
            if len(u):
                rows.append((int(u[0]) % buckets, 0, 0, u.astype("<i8").tobytes(), v.astype("<i8").tobytes()))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "least", "width", "one", "two"])

        for batch in batches:
            texts, ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            for lo, hi in chunks(texts, CHUNK):
                sigs = signatures(shingles(*words(texts[lo:hi]), n), bands)
                if sum(map(len, sigs)):  # else the sets are too small to have near ones
                    held[0].append(np.concatenate(sigs))
                    held[1].append(np.repeat(ids[lo:hi], [len(x) for x in sigs]))
                    if sum(map(len, held[0])) >= HELD:
                        yield from send()
        if held[0]:
            yield from send()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        edges: list[list[np.ndarray]] = [[], []]
        current = None

        def close() -> None:
            if held[0]:
                u, v = _edges(*map(np.concatenate, held))
                edges[0].append(u), edges[1].append(v)
            held[0].clear(), held[1].clear()

        def joined() -> Iterator[pa.RecordBatch]:
            if edges[0]:
                u, v = tree(*map(np.concatenate, edges))
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
            edges[0].clear(), edges[1].clear()

        for batch in batches:
            for bucket, least_id, width, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not width:
                    edges[0].append(np.frombuffer(one, "<i8")), edges[1].append(np.frombuffer(two, "<i8"))
                else:
                    if bucket != current:
                        close()
                        current = bucket
                    held[0].append(_numbers(one, 5))
                    held[1].append(np.cumsum(np.append(np.array([least_id], np.int64).view(_U), _numbers(two, width)), dtype=_U).view(np.int64))
                if sum(map(len, edges[0])) >= HELD:
                    yield from joined()
        close()
        yield from joined()

    sent = rows.mapInArrow(emit, "bucket int, least long, width int, one binary, two binary")
    # a task's edges are one tree, so fewer tasks send a pair of documents fewer times
    tasks = max(min(buckets, LEAST_TASKS), -(-buckets // BUCKETS_A_TASK))
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(match, "u long, v long")


def near_sketches(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, bands: Bands, only: int | None = None) -> np.ndarray:
    """Root of each set in a forest of the pairs that sizes and sketches allow to link. side: compare 0 with 1; all alike: all pairs.

    only: pairs whose larger set is of this band.
    """
    band = bands.of(sizes)
    t = bands.least
    found: list[np.ndarray] = []
    for top in np.unique(band).tolist() if only is None else [only]:
        for other in (top, top - 1):
            a, b = np.flatnonzero(band == top), np.flatnonzero(band == other)
            if not len(a) or not len(b):
                continue
            bits = bands.bits(other)
            x, y = (np.stack([np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(sketches[i], np.uint8)).reshape(-1, bits), 0) for i in of]).astype(np.float32) * 2 - 1 for of in (a, b))
            for lo in range(0, len(a), 1024):
                part = a[lo : lo + 1024]
                apart = (bits - x[lo : lo + 1024] @ y.T) / 2
                both = sizes[part][:, None] + sizes[b][None, :]
                allowed = (t.denominator - t.numerator) * both // (t.denominator + t.numerator)
                good = (apart <= allowed) & (part[:, None] != b[None, :])
                if side.any() and not side.all():
                    good &= side[part][:, None] != side[b][None, :]
                i, j = np.nonzero(good)
                found.append(np.stack([part[i], b[j]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return roots(len(sizes), pairs[:, 0], pairs[:, 1])


def forest(first: list[np.ndarray], second: list[np.ndarray] | None, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Root and number of links of each set; second: compare first with these only."""
    sets = first + (second or [])
    m, cut = len(sets), len(first)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, feature, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[feature] > 1
    owner, feature = owner[shared], feature[shared]
    number = np.cumsum(times > 1) - 1
    feature = number[feature]
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    rows, columns = (slice(0, cut), slice(cut, m)) if second is not None else (slice(0, m), slice(0, m))
    common = np.zeros((rows.stop - rows.start, columns.stop - columns.start), np.float32)
    for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, FEATURES):
        a, b = np.searchsorted(feature, [lo, lo + FEATURES])
        x = np.zeros((m, FEATURES), np.float32)
        x[owner[a:b], feature[a:b] - lo] = 1
        common += x[rows] @ x[columns].T
    both = sizes[rows, None] + sizes[None, columns] - common
    linked = least.denominator * common.astype(np.float64) >= least.numerator * both
    if second is None:
        np.fill_diagonal(linked, False)
        links = linked.sum(1)
    else:
        links = np.concatenate([linked.sum(1), linked.sum(0)])
    i, j = np.nonzero(linked)
    return roots(m, i, j + (cut if second is not None else 0)), links


def refined(families: DataFrame, least: Fraction) -> DataFrame:
    """u, v: forest edges of the pairs in families (class_id, family, n_shingles, sketch, band) that sketches allow to link.

    A large family is taken band by band with the next smaller one, and these in blocks; small families share groups.
    """
    counts = families.groupBy("family").agg(F.count("*").alias("size"))
    groups = max(1, -(-families.count() // GROUP))
    tops = F.when(F.col("size") > BLOCK, F.array("band", F.col("band") + 1)).otherwise(F.array(F.lit(-1)))
    rows = families.join(counts, "family").withColumn("top", F.explode(tops)).drop("size", "band")
    blocks = rows.filter("top >= 0").groupBy("family", "top").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["family", "top"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = _in_pairs(rows, groups, F.col("top") >= 0)

    def compare(group: pa.Table) -> pa.Table:
        bands, out = Bands(least), []
        low, high, top = (group.column(c)[0].as_py() for c in ("low", "high", "top"))
        of: dict[int, list[tuple]] = {}
        for doc, family, size, data, own in zip(*(group.column(c).to_pylist() for c in ("class_id", "family", "n_shingles", "sketch", "own")), strict=True):
            of.setdefault(family, []).append((doc, size, data, own))
        for rows in of.values():
            docs, sizes, data, own = zip(*sorted(rows, key=lambda r: r[0]), strict=True)
            side = np.array(own) == high if low != high else np.zeros(len(docs), bool)
            if low != high and (side.all() or not side.any()):
                continue
            root = near_sketches(np.array(sizes), list(data), side, bands, None if top < 0 else top)
            out += [(docs[i], docs[r]) for i, r in enumerate(root.tolist()) if i != r]
        columns = zip(*out, strict=True) if out else ([], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    return dealt.groupBy("many", "unit", "top", "low", "high").applyInArrow(compare, "u long, v long")


def _in_pairs(rows: DataFrame, groups: int, many: Column | None = None) -> DataFrame:
    """rows (class_id, family, blocks, …) once for each pair of blocks that they take part in."""
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = F.col("blocks") > 1 if many is None else many
    unit = F.when(many, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(groups)))
    return out.withColumns({"many": many, "unit": unit, "low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")


def _with_class(rows: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """rows (set_key, …) with the columns of their class (set_key, n, …), n its rows.

    Rows of classes of more than hot rows are never dealt by their key: such classes are few, and are broadcast.
    """
    large = classes.filter(F.col("n") > hot).drop("n")
    if large.isEmpty():
        return rows.join(classes.drop("n"), "set_key")
    rest = rows.join(F.broadcast(large.select("set_key")), "set_key", "left_anti")
    return rows.join(F.broadcast(large), "set_key").unionByName(rest.join(classes.filter(F.col("n") <= hot).drop("n"), "set_key"))


def representatives(docs: DataFrame, told: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """doc_id, text of docs less those that only repeat the set of a smaller id, and of those without an id."""
    of = _with_class(told.filter("doc_id IS NOT NULL AND set_key IS NOT NULL").select("doc_id", "set_key"), classes, hot)
    copies = stored(of.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first")).filter("NOT first").select("doc_id"), "copies", told.count())
    return _texts(docs).filter("doc_id IS NOT NULL").join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti").select("doc_id", "text")


def similar_documents(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links, text_hash for each row.

    class_id: smallest id of the documents of the same set. n_links: other sets that link with it. text_hash: xxhash64 of the text.
    """
    told = stored(described(docs, n, least), "sets")
    members = told.select("doc_id", "text_hash", "n_shingles", "set_key")
    rows, features = told.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    classes = stored(members.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes", rows)
    hot = max(HOT_ROWS, rows // HOT_CLASSES)
    edges = star_edges(representatives(docs, told, classes, hot), n, least, -(-features // FEATURES_A_BUCKET) or 1)
    families = components(edges).select(F.col("node").alias("class_id"), F.col("label").alias("family"))
    # an id may have rows of several texts: each that is the first of its class takes part
    of_class = told.filter("set_key IS NOT NULL").withColumnRenamed("doc_id", "class_id").join(families, "class_id").join(classes.drop("n"), ["set_key", "class_id"])
    families = stored(of_class.groupBy("class_id", "set_key").agg(*(F.first(c).alias(c) for c in ("family", "n_shingles", "sketch", "band"))), "families", 4 * rows)
    near = components(refined(families.drop("set_key"), least)).select(F.col("node").alias("class_id"), F.col("label").alias("family"))
    found = families.drop("family").join(near, "class_id")
    sizes = found.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_FEATURES)).cast("int").alias("blocks"))
    found = stored(found.join(sizes, "family").select("class_id", "family", "blocks", "set_key"), "candidates", rows)
    count = found.count()
    wanted = F.broadcast(found) if count <= BROADCAST_ROWS else found
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("string").alias("text")).join(wanted, "class_id")
    groups = max(1, -(-count // GROUP))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = batch.select(["class_id", "family", "blocks"])
            keys = batch.column("set_key").to_pylist()
            for lo, hi in chunks(texts, CHUNK):
                sets = [s.tobytes() for s in shingles(*words(texts[lo:hi]), n)]
                # an id may have rows of other texts: only the class's own set counts
                keep = [i for i, s in enumerate(sets) if s and hashlib.blake2b(s, digest_size=16).digest() == keys[lo + i]]
                part = own.slice(lo, hi - lo).take(pa.array(keep, pa.int64()))
                yield pa.record_batch([*part.columns, pa.array([sets[i] for i in keep], pa.binary())], names=["class_id", "family", "blocks", "features"])

    sets = texts.select("class_id", "family", "blocks", "text", "set_key").mapInArrow(sets_of, "class_id long, family long, blocks int, features binary")
    dealt = _in_pairs(sets, groups)

    def compare(group: pa.Table) -> pa.Table:
        rows: dict[int, dict[int, np.ndarray]] = {}
        side = {}
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        for doc, family, data, own in zip(*(group.column(c).to_pylist() for c in ("class_id", "family", "features", "own")), strict=True):
            rows.setdefault(family, {})[doc] = np.frombuffer(data, _U)
            side[doc] = own
        out: list[tuple[int, int, int]] = []
        for of in rows.values():
            ids = sorted(of)
            if low == high:
                first, second = ids, None
            else:
                first, second = [d for d in ids if side[d] == low], [d for d in ids if side[d] == high]
                if not first or not second:
                    continue
            root, links = forest([of[d] for d in first], None if second is None else [of[d] for d in second], least)
            names = first + (second or [])
            out += [(d, names[r], int(x)) for d, r, x in zip(names, root, links, strict=True) if x]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])

    linked = stored(dealt.groupBy("many", "unit", "low", "high").applyInArrow(compare, "u long, v long, links long"), "links")
    labels = components(linked.select("u", "v")).withColumnsRenamed({"node": "class_id", "label": "component_id"})
    links = linked.groupBy("u").agg(F.sum("links").alias("n_links")).withColumnRenamed("u", "class_id")
    told_of = classes.join(labels, "class_id", "left").join(links, "class_id", "left").select("set_key", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = _with_class(members.filter("set_key IS NOT NULL"), stored(told_of, "told", rows), hot)
    alone = members.filter("set_key IS NULL").withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    own_id = F.col("doc_id")
    return found.unionByName(alone).select("doc_id", "n_shingles", F.coalesce("component_id", own_id).alias("component_id"), F.coalesce("class_id", own_id).alias("class_id"), "n_links", "text_hash")
