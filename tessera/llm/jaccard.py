"""N-gram Jaccard join by a partitioned universe.

Documents are sets of hashed word shingles. Linked sets differ in at most H tokens, a number that a band of sizes
bounds. In each band, hashing splits the universe into segments so that H differences cannot touch them all: either
some segment is equal in both sets, or, in segments that also index every subset with one token deleted, differs by
one. How many segments of either kind a band has is a choice by cost: signatures written against candidates expected
by chance. A segment without a rare token says little: passages that many documents share fill it alike. A set leaves
such segments out if those that remain still outnumber H, which the band's spare segments make the rule; then one of
them is equal in every set that is linked with it. Candidates are verified exactly on the whole sets.

Sets that are equal form classes first, and only classes are joined. A signature that many classes share is a star,
not a clique: its members are compared with its most central one, and what that leaves unconnected is compared with the
component of the others, in blocks and by sketches first, so components are exact. Tasks reduce what they send to one entry per signature.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, arrow, batches, column, forget, grouped, hash_words, materialise, shingle, shuffle_partitions, signed, splitmix, utf8
from .components import components
from .substring import LAST, expand, keyed, squeeze

_U = np.uint64
_SALT = _U(0xC2B2AE3D27D4EB4F)
#: Entries of a share and of a part, about.
SHARE, PART = 400_000, 700_000
BAND_RATIO = 1.25
#: Classes at one signature whose pairs are all looked at; beyond, a signature is a crowd.
CROWD = 24
#: Members of a crowd that are compared at a time.
BLOCK = 2000
WHOLE, HOT, PLAIN = 1, 2, 4
#: Share of a set's tokens that are rare, about; a band's spare segments follow from it.
RARE_SHARE = 0.85
#: Buckets that tokens are counted in, as a power of two: the counts' size does not follow the input.
TOKEN_BITS = 20


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than k words, one hash of all; without words, nothing."""
    data, offs = utf8(column(batch, "text"))
    _, _, h, first = hash_words(data, offs, lower=True)
    s = shingle(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            out.append(splitmix(shingle(h[a:b], int(b - a)) + _U(int(b - a))))
        else:
            out.append(np.zeros(0, _U))
    return out


def _prints(s: np.ndarray) -> tuple[int, int]:
    a = splitmix(np.asarray([splitmix(s).sum(dtype=_U) + _U(len(s))], _U))
    b = splitmix(np.asarray([splitmix(s ^ _SALT).sum(dtype=_U)], _U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


class Bands:
    """Bands of set sizes and their segments, for a similarity of num / den."""

    def __init__(self, num: int, den: int, counts: dict[int, int] | None = None, common: np.ndarray | None = None):
        self.num, self.den, self.common = num, den, common
        self.edges, lo = [], 1
        while lo < 1 << 40:
            hi = max(lo, int(lo * BAND_RATIO))
            self.edges.append((lo, hi))
            lo = hi + 1
        self._lows = np.array([e[0] for e in self.edges])
        counts = counts or {}
        self.plan = [self._allocate(lo, hi, counts.get(i, 0) + counts.get(i - 1, 0)) for i, (lo, hi) in enumerate(self.edges)]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self._lows, size, "right")) - 1

    def joined(self, size: int) -> range:
        """Bands whose sets may be linked with a set of this size that is not larger."""
        return range(self.band(size), self.band(size * self.den // self.num) + 1)

    def differences(self, hi: int) -> int:
        return (self.den - self.num) * 2 * hi // (self.den + self.num)

    def _allocate(self, lo: int, hi: int, rows: int) -> tuple[int, int, int]:
        """H, plain segments and one-deletion segments (which count twice), by least cost."""
        h = self.differences(hi)
        if h == 0:
            return 0, 0, 0
        best = None
        tops = (h + 1) // 2
        for n1 in sorted({*range(min(tops, 6) + 1), tops, (h + 2) // 2}):
            n0, spare = max(0, h + 1 - 2 * n1), 0
            for _ in range(4):
                t = (lo + hi) / 2 / (n0 + spare + n1)
                p = math.exp(-t * RARE_SHARE)
                spare = math.ceil(n0 * p + 3 * math.sqrt(n0 * p)) if n0 else 0
            t = (lo + hi) / 2 / (n0 + spare + n1)
            chance = 1e-3 * (n0 + spare) * math.exp(-2 * t) + n1 * math.exp(-2 * t) * (1 + 2 * t)
            cost = n0 + spare + n1 * (1 + t) + 0.5 * rows * chance
            if best is None or cost < best[0]:
                best = (cost, n0 + spare, n1)
        return h, best[1], best[2]

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set and their tags: WHOLE (for a whole segment, else one with a token deleted), PLAIN (from a plain
        segment), the band, and how many plain keys the set can do without, plus one (0: none, it needs all).

        Of the plain segments, those with a rare token are enough if they outnumber what may differ; else those with
        two tokens are added, else all. What is enough for one of two linked sets, the other has too.
        """
        keys, tags = [], []
        rare = np.ones(len(s), bool) if self.common is None else ~self.common[token_bucket(s)]
        for b in self.joined(len(s)):
            h, n0, n1 = self.plan[b]
            if h == 0:
                continue
            m = n0 + n1
            salt = splitmix(np.array([b + 1], _U) * _SALT)[0]
            seg = (splitmix(s ^ salt) % _U(m)).astype(np.int64)
            g = splitmix(s + _SALT)
            total = np.bincount(seg, g & _U(0xFFFFFFFF), m).astype(_U) + (np.bincount(seg, g >> _U(32), m).astype(_U) << _U(32))
            size = np.bincount(seg, minlength=m)
            mark = splitmix(salt + np.arange(m, dtype=_U))
            take = np.ones(m, bool)
            telling = np.bincount(seg, rare, m)[:n0] > 0
            for enough in (telling, telling | (size[:n0] > 1), take[:n0]):
                spare = min(int(enough.sum()) + 2 * n1 - (h + 1), 8000)
                if spare >= 0:
                    break
            take[:n0] = enough
            tag = b << 16 | max(spare + 1, 0) << 3
            keys.append(splitmix(total[take] ^ mark[take]))
            tags.append(np.where(np.flatnonzero(take) < n0, tag | WHOLE | PLAIN, tag | WHOLE).astype(np.int32))
            if n1:
                d = seg >= n0
                keys.append(splitmix((total[seg[d]] - g[d]) ^ mark[seg[d]]))
                tags.append(np.full(int(d.sum()), tag, np.int32))
        if not keys:
            return np.zeros(0, _U), np.zeros(0, np.int32)
        return np.concatenate(keys), np.concatenate(tags)


def token_bucket(s: np.ndarray) -> np.ndarray:
    return (splitmix(s + _U(0x632BE59BD9B4E019)) >> _U(64 - TOKEN_BITS)).astype(np.int64)


def common_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """For each bucket of tokens, whether its count over all documents stands out, so that some token in it is common.

    Equal sets count once in a task. Counts only decide what a signature is made of; results do not depend on them.
    """
    chunk = 1 << 14

    def run(parts):
        total, held, size, seen = np.zeros(1 << TOKEN_BITS, np.int64), [], 0, set()

        def count():
            total[:] += np.bincount(np.concatenate(held), minlength=len(total))
            held.clear()

        for whole in parts:
            for batch in batches(whole):
                for s in _sets(batch, k):
                    p = _prints(s)[0] if len(s) else None
                    if p is None or p in seen:
                        continue
                    seen.add(p)
                    held.append(token_bucket(s))
                    size += len(s)
                if size > 1 << 20:
                    count()
                    size = 0
                if len(seen) > 100_000:
                    seen.clear()
        if held:
            count()
        at = [i for i in range(0, len(total), chunk) if total[i : i + chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // chunk for i in at], pa.int32()), pa.array([squeeze(total[i : i + chunk]) for i in at], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(expand(x)[0] for x in table["counts"].to_pylist())
        return pa.table({"chunk": table["chunk"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    got = grouped(arrow(docs.select("text"), run, "chunk int, counts binary"), ["chunk"], add, "chunk int, counts binary").toArrow()
    total = np.zeros(1 << TOKEN_BITS, np.int64)
    for c, x in zip(got["chunk"].to_pylist(), got["counts"].to_pylist()):
        total[c * chunk : (c + 1) * chunk] = np.frombuffer(x, np.int64)
    usual = float(total.mean())
    return total > usual + 5 * math.sqrt(usual) + CROWD


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens over a power of two of positions, at least four a token. Two sets' sketches differ in
    at most as many places as the sets differ in tokens, and in hardly fewer."""
    bits = max(256, 4 << (len(s) - 1).bit_length())
    odd = np.bincount((splitmix(s ^ _U(0x5851F42D4C957F2D)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(wide: np.ndarray) -> np.ndarray:
    """The sketch on a quarter of the positions, at least 64 bits, for where pairs carry it."""
    return np.bitwise_xor.reduce(wide.reshape(4, -1), axis=0)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, id (see ``keyed``), mark (the text's hash, 64 bits: all rows without a doc_id share an id), n_shingles, two 64-bit prints of the set, and its sketch."""

    def run(parts):
        for whole in parts:
            for batch in batches(whole):
                sets = _sets(batch, k)
                prints = [_prints(s) for s in sets]
                sketches = [sketch(x) if len(x) else np.zeros(0, np.uint8) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), column(batch, "id"), column(batch, "mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary()),
                     pa.array([folded(x).tobytes() if len(x) else b"" for x in sketches], pa.binary())],
                    ["doc_id", "id", "mark", "n_shingles", "cls", "cls2", "sketch", "small"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(keyed(docs).withColumn("mark", F.xxhash64("text")), run, f"doc_id {kind}, id long, mark long, n_shingles long, cls long, cls2 long, sketch binary, small binary")


def _sorted(key, cls, tag):
    """Order by key, whole segments first, then class, repeats left out; where keys begin; how many each has."""
    order = np.lexsort((cls, ~tag & WHOLE, key))
    k, c, w = key[order], cls[order], tag[order] & WHOLE
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])][: len(k)]
    order = order[new]
    k = key[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return order, begin, np.diff(np.r_[begin, len(k)])


def shared_signatures(docs: DataFrame, k: int, bands: Bands, parts: int, most: int = CROWD) -> DataFrame:
    """kind 0: x, y, two classes that share a signature of at most ``most`` classes. kind 1: x, y, tag: a signature that more
    share, and each class at it. Rows may repeat.

    A share sends a crowded signature's first class to the signature's part, marked, and its other classes elsewhere, so
    no task gathers a crowd.
    """

    def flush(held):
        key, cls, tag = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, begin, size = _sorted(key, cls, tag)
        key, cls, tag = key[order], cls[order], tag[order]
        crowd = np.repeat(size > most, size)
        first = np.zeros(len(key), bool)
        first[begin] = True
        tag = np.where(crowd, tag | HOT, tag)
        away = crowd & ~first
        part = (np.where(away, splitmix(cls.view(_U)), key) >> _U(32)) % _U(parts)
        part = part.astype(np.int64)
        for kind, pick in ((0, np.flatnonzero(~away)), (1, np.flatnonzero(away))):
            pick = pick[np.lexsort((cls[pick], part[pick]))]
            p = part[pick]
            bounds = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
            for a, b in zip(bounds, np.r_[bounds[1:], len(p)]):
                t = pick[a:b]
                names, at = np.unique(cls[t], return_inverse=True)
                yield int(p[a]), kind, key[t].tobytes(), names.tobytes(), squeeze(np.diff(at.astype(np.int32), prepend=np.int32(0)), tag[t])

    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def rows(found):
        held, size = [[] for _ in kinds], 0
        for row in found:
            for c, x in zip(held, row):
                c.append(x)
            size += sum(map(len, row[2:]))
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], ["part", "kind", "keys", "names", "meta"])
                held, size = [[] for _ in kinds], 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], ["part", "kind", "keys", "names", "meta"])

    def run(whole_parts):
        held, size, seen = [], 0, set()
        for batch_ in whole_parts:
            for batch in batches(batch_):
                for s in _sets(batch, k):
                    if len(s) == 0:
                        continue
                    c = _prints(s)[0]
                    if c in seen:
                        continue
                    seen.add(c)
                    keys, tags = bands.signatures(s)
                    if len(keys) == 0:
                        continue
                    held.append((keys, np.full(len(keys), c, np.int64), tags))
                    size += len(keys)
                    if size >= SHARE:
                        yield from rows(flush(held))
                        size = 0
                        seen.clear()
        if held:
            yield from rows(flush(held))

    def merge(table: pa.Table) -> pa.Table:
        key, cls, tag, out = [], [], [], []
        for kind, a, names, meta in zip(*(table[n].to_pylist() for n in ("kind", "keys", "names", "meta"))):
            at, t = expand(meta)
            a, c = np.frombuffer(a, _U), np.frombuffer(names, np.int64)[np.cumsum(at)]
            if kind == 1:
                out.append((np.ones(len(a), np.int32), signed(a), c, t))
            else:
                key.append(a)
                cls.append(c)
                tag.append(t)
        if key:
            key, cls, tag = np.concatenate(key), np.concatenate(cls), np.concatenate(tag)
            order, begin, size = _sorted(key, cls, tag)
            key, cls, tag = key[order], cls[order], tag[order]
            crowd = (size > most) | (np.bitwise_or.reduceat(tag, begin) & HOT > 0)
            hot = np.repeat(crowd, size)
            out.append((np.ones(int(hot.sum()), np.int32), signed(key[hot]), cls[hot], tag[hot]))
            few = np.flatnonzero(np.repeat(~crowd & (size > 1), size))
            key, cls, tag = key[few], cls[few], tag[few]
            for d in range(1, most):
                i = np.arange(max(len(key) - d, 0))
                i = i[(key[i] == key[i + d])]
                if not len(i):
                    break
                # whole ones come first: the second alone may be one with a token deleted
                i = i[(cls[i] != cls[i + d]) & (tag[i] & WHOLE > 0)]
                pairs = np.unique(np.stack([np.minimum(cls[i], cls[i + d]), np.maximum(cls[i], cls[i + d])]), axis=1)
                out.append((np.zeros(pairs.shape[1], np.int32), pairs[0], pairs[1], np.zeros(pairs.shape[1], np.int32)))
        n, x, y, t = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return pa.table({"kind": pa.array(n), "x": pa.array(x), "y": pa.array(y), "tag": pa.array(t)})

    entries = arrow(docs.select("text"), run, "part int, kind int, keys binary, names binary, meta binary").repartition(parts, "part")
    return grouped(entries, ["part"], merge, "kind int, x long, y long, tag int")


def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link; exact, since sketches never differ in more places than sets."""

    def run(parts):
        for batch in parts:
            keep = []
            for x, y, n, m in zip(column(batch, "sa"), column(batch, "sb"), column(batch, "na").to_pylist(), column(batch, "nb").to_pylist()):
                keep.append(sketch_distance(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) * (den + num) <= (den - num) * (n + m))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], ["a", "b"])

    side = lambda c, s, n: classes.select(F.col("cls").alias(c), F.col("small").alias(s), F.col("n_shingles").alias(n))
    both = pairs.join(side("b", "sb", "nb"), "b").join(side("a", "sa", "na"), "a")
    both = both.where(num * F.greatest("na", "nb") <= den * F.least("na", "nb"))
    return arrow(both.select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long").distinct()


def _near(sides: DataFrame, classes: DataFrame, num: int, den: int, nearest: bool, block: int = BLOCK) -> DataFrame:
    """Plausible pairs (a, b) of each group's outer rows (``out``) with its other rows, where their roots differ.

    ``sides`` has grp, cls, root, out; rows whose out is null are on both sides. Both sides are dealt into blocks, so no group meets in one task, and a pair of
    blocks is compared on sketches: no row is made for a pair that they exclude. ``nearest``: of each root only the row
    whose sketch is nearest.
    """
    share = lambda c: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / block)).cast("int")
    sizes = sides.groupBy("grp").agg(share(~F.coalesce("out", F.lit(False))).alias("rows"), share(F.coalesce("out", F.lit(True))).alias("outer"))
    d = sides.join(sizes, "grp").join(classes.select("cls", "sketch", "n_shingles"), "cls")
    one = (F.col("rows") == 1) & (F.col("outer") == 1)
    d = d.withColumn("out", F.explode(F.when(F.col("out").isNull() & ~one, F.array(F.lit(False), F.lit(True))).otherwise(F.array("out"))))
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    along = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    d = d.withColumns({"is": F.when(F.coalesce("out", F.lit(False)), along("rows")).otherwise(F.array(mine("rows"))), "js": F.when(F.coalesce("out", F.lit(False)), F.array(mine("outer"))).otherwise(along("outer"))})
    columns = ["cls", "root", "sketch", "n_shingles"]
    dealt = d.select("grp", F.explode("is").alias("i"), "js", "out", *columns).select("grp", "i", F.explode("js").alias("j"), "out", *columns)

    def compare(table: pa.Table) -> pa.Table:
        out = table["out"].combine_chunks()
        inner, out = ~np.asarray(out.fill_null(False)), np.asarray(out.fill_null(True))
        cls, root, n = (np.asarray(table[c].combine_chunks()) for c in ("cls", "root", "n_shingles"))
        sketches = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["sketch"].combine_chunks()]
        width = min(map(len, sketches))
        flat = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches]).view(np.uint64)
        members = np.flatnonzero(inner)
        found = [np.zeros((2, 0), np.int64)]
        for u in np.flatnonzero(out):
            far = np.bitwise_count(flat[members] ^ flat[u]).sum(axis=1, dtype=np.int64)
            ok = (far * (den + num) <= (den - num) * (n[members] + n[u])) & (root[members] != root[u]) & (num * np.maximum(n[members], n[u]) <= den * np.minimum(n[members], n[u]))
            m = members[ok]
            if nearest and len(m):
                order = np.argsort(far[ok], kind="stable")
                m = m[order[np.unique(root[m][order], return_index=True)[1]]]
            found.append(np.stack([np.minimum(cls[m], cls[u]), np.maximum(cls[m], cls[u])]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return grouped(dealt, ["grp", "i", "j"], compare, "a long, b long")


def _apart(outer: DataFrame, labels: DataFrame, classes: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Plausible pairs (a, b) of crowds' members outside the main component with all members of other components.

    ``outer`` has those members' key, cls, root and main. A member outside meets the whole main component once, however many crowds they
    share: the component has each of its members once. Members outside meet each other crowd by crowd.
    """
    mains = outer.select(F.col("main").alias("root")).distinct()
    inside = labels.select(F.col("node").alias("cls"), "root").unionByName(mains.select(F.col("root").alias("cls"), "root")).distinct().join(mains, "root", "left_semi")
    sides = inside.select(F.col("root").alias("grp"), "cls", "root", F.lit(False).alias("out")).unionByName(outer.select(F.col("main").alias("grp"), "cls", "root", F.lit(True).alias("out")).distinct())
    there = outer.select(F.col("key").alias("grp"), "cls", "root")
    several = there.groupBy("grp").agg(F.count_distinct("root").alias("n")).where("n > 1").select("grp")
    there = materialise(there.join(several, "grp", "left_semi"))
    both = there.withColumn("out", F.lit(None).cast("boolean"))
    return _near(sides, classes, num, den, nearest).unionByName(_near(both, classes, num, den, nearest)).distinct()


def _token_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """cls and tokens of the classes that ``pairs`` (a, b) name, from their first documents."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = materialise(classes.join(ends, "cls").select("cls", "rep"))
    known = Bloom(wanted, "rep").test()

    def run(parts):
        for whole in parts:
            for batch in batches(whole.filter(pa.array(known(np.asarray(column(whole, "hash")))))):
                sets = _sets(batch, k)
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([_prints(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "cls", "tokens"])

    sets = arrow(keyed(docs).select("id", "text", Bloom.hash("id").alias("hash")), run, "id long, cls long, tokens binary")
    sets = sets.join(wanted.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    return materialise(sets)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b: classes) whose sets are linked."""

    def test(parts):
        for batch in parts:
            found = []
            last, a = None, None
            for x, sa, sb in zip(column(batch, "a").to_pylist(), column(batch, "sa"), column(batch, "sb")):
                if x != last:
                    last, a = x, np.frombuffer(sa.as_buffer(), _U)
                b = np.frombuffer(sb.as_buffer(), _U)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                found.append(den * both >= num * (len(a) + len(b) - both))
            keep = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], ["a", "b"])

    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("sb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("sa")), "a")
    return arrow(both.select("a", "b", "sa", "sb"), test, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links among ``pairs`` that have the components of all links among them, and those components' labels.

    First each class is compared with that of its partners which has most partners itself; of the other pairs only those
    whose ends are still apart are, since a link inside a component changes nothing. So sets are sent about once a class,
    however many pairs a group of similar ones has.
    """
    sets = _token_sets(docs, pairs, classes, k)
    sides = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    partners = sides.groupBy("cls").agg(F.count("*").alias("n"))
    best = sides.join(partners.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.max(F.struct("n", "other")).alias("m"))
    tree = materialise(best.select(F.least("cls", "m.other").alias("a"), F.greatest("cls", "m.other").alias("b")).distinct())
    edges = materialise(_linked(tree, sets, num, den))
    labels = components(edges)
    root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(tree, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = materialise(apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if not apart.isEmpty():
        edges = materialise(edges.unionByName(_linked(apart, sets, num, den)))
        labels = components(edges)
    return edges, labels


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, id, mark, n_shingles, component_id (smallest doc_id reachable by links), root (of the component
    itself: components without a doc_id, or with one in common, differ in it; null where there are no words).

    Two documents are linked if ``den`` times what their sets of ``k``-word shingles share is at least ``num`` times
    their union. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    Defined cases: a text of fewer than k words is one shingle of all of them; a null or empty text, or one without
    words, has the empty set, is linked with nothing, and is its own component; a null doc_id counts as larger than
    all others and comes back null; repeated rows are linked; an empty table gives an empty one; further columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = materialise(describe(docs, k))
    classes = materialise(rows.where("n_shingles > 0").groupBy("cls", "cls2", "n_shingles").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"), F.first("small").alias("small")))
    plain = Bands(num, den)
    band = F.lit(0)
    top = classes.agg(F.max("n_shingles")).first()[0] or 0
    for lo, _ in plain.edges[1:]:
        if lo <= top:
            band = band + F.when(F.col("n_shingles") >= lo, 1).otherwise(0)
    stats = classes.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("tokens")).collect()
    bands = Bands(num, den, {r.band: r.n for r in stats}, common_tokens(docs, k))
    entries = sum(r.n * sum(bands.plan[b][1] + bands.plan[b][2] * (1 + r.tokens / r.n / max(1, sum(bands.plan[b][1:]))) for b in bands.joined(int(r.tokens / r.n))) for r in stats)
    parts = max(shuffle_partitions(spark), math.ceil(entries / PART))
    at = materialise(shared_signatures(docs, k, bands, parts, crowd))
    # a set that can do without its crowded signatures leaves them
    crowded = at.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("cls"), F.col("tag").bitwiseAND(F.lit(~HOT)).alias("tag")).distinct()
    crowded = crowded.select("key", "cls", (F.col("tag").bitwiseAND(F.lit(WHOLE)) > 0).alias("whole"), (F.col("tag").bitwiseAND(F.lit(PLAIN)) > 0).alias("plain"),
                             F.shiftright("tag", 16).alias("band"), F.shiftright(F.col("tag").bitwiseAND(F.lit(0xFFFF)), 3).alias("spare"))
    crowded = materialise(crowded)
    free = crowded.where("plain").groupBy("cls", "band").agg(F.count("*").alias("n"), F.max("spare").alias("spare")).where("n < spare").select("cls", "band", F.lit(True).alias("free"))
    crowded = materialise(crowded.join(free, ["cls", "band"], "left").where("free is null or not plain").select("key", "cls", "whole", "band"))
    # of a crowd, one member is compared with all: that with the most crowded signatures, which has changed least of what
    # the crowd has in common
    crowds = crowded.groupBy("cls", "band").agg(F.count("*").alias("n"))
    centres = crowded.where("whole").join(crowds, ["cls", "band"]).groupBy("key").agg(F.max(F.struct("n", "cls")).alias("m")).select("key", F.col("m.cls").alias("c"))
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    stars = crowded.join(centres, "key").where(F.col("cls") != F.col("c")).select(*ordered(F.col("cls"), F.col("c")))
    first = materialise(at.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(stars).distinct())
    edges, labels = _verified(docs, materialise(_plausible(first, classes, num, den)), classes, k, num, den)
    # what the stars left apart: members outside the largest component of their crowd, with the nearest member of each
    # other one, which joins most of them; then what is still apart with all members of others
    met = None
    for nearest in (True, False):
        root_of = labels.select(F.col("node").alias("cls"), "root")
        placed = crowded.select("key", "cls").join(root_of, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        of_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = of_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("m.root").alias("main"))
        outer = placed.join(main, "key").where("root <> main")
        if met is not None:
            # the first time, each plausible pair of components gave one of their members': others have nothing to meet
            ends = met.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(root_of, "cls", "left")
            outer = outer.join(materialise(ends.select(F.coalesce("root", "cls").alias("root")).distinct()), "root", "left_semi")
        outer = materialise(outer)
        if outer.isEmpty():
            break
        met = materialise(_apart(outer, labels, classes, num, den, nearest))
        more = materialise(met.join(first, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            first = first.unionByName(more)
            edges = materialise(edges.unionByName(_verified(docs, more, classes, k, num, den)[0]))
            labels = components(edges)
    named = classes.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest_of = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(smallest_of, "root").select("cls", "cls2", "n_shingles", "component", "root")
    kind = docs.schema["doc_id"].dataType
    out = rows.join(named, ["cls", "cls2", "n_shingles"], "left").withColumn("component", F.coalesce("component", "id"))
    return out.select("doc_id", "id", "mark", "n_shingles", F.when(F.col("component") < F.lit(LAST), F.col("component")).cast(kind).alias("component_id"), "root")


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id, and of repeated rows one.

    Only documents that may have to go are shuffled.

    Defined cases: documents without words are groups of their own, by text (null and empty apart); rows without a
    doc_id, or with one in common, are told apart by their text; a group without a doc_id keeps the row whose text has
    the smallest hash; of rows with equal doc_id and text any one stays; an empty table gives an empty one; further
    columns are kept, whatever their names.
    """
    found = materialise(join(docs, k, num, den))
    forget(docs.sparkSession)
    group = [F.coalesce("root", "id").alias("component"), F.when(F.col("n_shingles") == 0, F.col("mark")).alias("empty")]
    stays = found.groupBy(*group).agg(F.min(F.struct("id", "mark")).alias("s"), F.count("*").alias("n"))
    groups = found.select(*group, "id")
    several = stays.where("n > 1")
    touched = Bloom(groups.join(several, groups["component"].eqNullSafe(several["component"]) & groups["empty"].eqNullSafe(several["empty"]), "left_semi").select("id").distinct(), "id")
    stays = stays.select("s.id", "s.mark").distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)))
    looked_at = touched.keep(rows, "id").withColumn("mark", F.xxhash64("row.text"))
    kept = looked_at.join(stays, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return kept.select("row.*").unionByName(touched.drop(rows, "id").select("row.*"))
