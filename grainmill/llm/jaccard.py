"""Exact Jaccard join on word shingles, by partition of the universe.

A document's set are its distinct shingles. Sizes fall into bands so that two sets of a Jaccard of SHARE per cent or
more are in the same band or in neighbouring ones; a set takes part in the instance of its own band and in that of the
next. In an instance, sets differ by at most H elements if they are similar, and the shingles are hashed into H + 1
segments. So similar sets agree in a segment wholly: the segment's subset is a signature, and the sets that have it are
its index list.

Signatures are allocated by what the lists cost, which is their pairs. Any segment can be given up, and its neighbour
then takes over with its one-deletion neighbourhood: its subset and the subsets without one element each. An empty
segment is always given up, for its list would be the longest of all. Of the others the lists are counted first; those
longer than REFINE are tried with the given-up segment's own subset and the neighbour's one-deletion neighbourhood as
signature, and whichever has fewer pairs in all stays. Nothing is lost: whether a list is given up is the same for all of
its sets, and if two sets agreed in segments only that both give up, the neighbours of these could not each differ by two
or more, for that would be more than H in all.

What the lists' sets have in common is found in two steps. The sets of lists longer than STAR are compared with one of
the list first, the one that is in most lists with others; the links make components. What is left are pairs of different
components: those of lists up to LIGHT are made once each, ruled out by sketches (sets differ by at least as much as
their counts in cells of the universe do) and compared whole; the sketches come with the sets of the lists, which are fewer
than the pairs, and to the pairs themselves only in lists up to SHORT; in longer lists blocks of sets meet, block with block within a
task, at first their sketches, then, unless few pairs are left, whole sets, which gives back links that join components and no pairs. So rows grow
with the lists, and only comparisons inside tasks with the square of a group that is alike but does not link.
Links are counted after that: all pairs of a component's sets are compared, in blocks of sets, each block with each.
64-bit hashes stand for shingles and sets.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import pretokens
from grainmill.llm._common import Workspace, input_bytes, ship, small_side, table
from grainmill.llm.graph import connected_components

#: Bytes of text that are hashed at a time, bytes of input for each range of signatures, shingles in a verified group.
BLOCK_BYTES, RANGE_BYTES, GROUP_SHINGLES = 2 << 20, 8 << 20, 1_000_000
#: Signatures that a task gathers before it hands them on in ranges, and bits of one.
GATHERED, KEY_BITS = 1 << 20, 48
#: Lists longer than REFINE may be given up; those longer than STAR are first compared with one set; up to LIGHT, by pairs,
#: which take sketches along only up to SHORT.
REFINE, STAR, LIGHT, SHORT = 16, 8, 64, 4
#: Links that one task makes components of; more are joined in distributed rounds.
ONE_TASK = 1_000_000
#: Sets of a block of a component or list that is compared whole; its shingles are at most about GROUP_SHINGLES.
BLOCK_SETS = 512
#: Pairs for each of its sets that sketches may leave two blocks to go by pairs.
PAIRS = 2
#: Cells of a sketch, as powers of 2: about half as many as the set has shingles. A cell has 2 bits.
LEAST_CELLS, MOST_CELLS = 5, 12

C1, C2, C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, each sorted, one after the other, and their len(texts) + 1 offsets."""
    import xxhash

    words, codes, ends = pretokens.factorized(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    listed = words.cast(pa.binary()).to_pylist()
    hashed = mix(np.array([xxhash.xxh3_64_intdigest(w) for w in listed], dtype=np.uint64))
    real = np.array([len(w) > 0 for w in listed], dtype=bool)
    keep = real[codes] if len(listed) else np.zeros(0, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    w = hashed[codes[keep]] if len(listed) else np.zeros(0, dtype=np.uint64)
    rolled = np.zeros(max(len(w) - width + 1, 0), dtype=np.uint64)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64) * C3) | np.uint64(1)  # no two places may be multiples in step
    for k in range(width):
        rolled += w[k : k + len(rolled)] * odd[k]
    rolled, out = mix(rolled), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:  # fewer words: the whole sequence is the one shingle
            x = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                x = mix(x * C3 + w[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    n = np.array([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum(n)])


def set_hashes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(flat ^ C3), dtype=np.uint64)])
    return mix((total[ends[1:]] - total[ends[:-1]]) ^ np.diff(ends).astype(np.uint64) * C2)


@lru_cache
def bands(share: int, largest: int) -> np.ndarray:
    """Upper ends of the size bands, beyond largest by two: sizes that differ by the factor share / 100 are at most a band apart."""
    out = [1]
    while len(out) < 3 or out[-3] < largest:
        out.append(max(out[-1] + 1, out[-1] * 100 // share))
    return np.array(out)


class Instance:
    """The segments of sets in the instance of their own band (step 0) or of the next one (1).

    Segments are numbered through: set i has parts[i] of them from base[i] on; holder has the set of each, place its number
    in the set, segment the one of each shingle, count and sums how many shingles it has and the sums that tell subsets apart.
    """

    def __init__(self, flat: np.ndarray, size: np.ndarray, share: int, step: int):
        tops = bands(share, int(size.max()))
        instance = np.searchsorted(tops, size) + step
        row = np.repeat(np.arange(len(size)), size)
        value = mix(flat + C1)
        self.halves = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
        # |x ^ y| <= (1 - s) / (1 + s) * (|x| + |y|), and both are at most the band's upper end.
        self.parts = np.where(size > 0, 2 * (100 - share) * tops[instance] // (100 + share) + 1, 0)
        self.base = np.cumsum(self.parts) - self.parts
        seed = mix(instance.astype(np.uint64) + C3)
        spread = mix(flat ^ seed[row]) >> np.uint64(32)
        self.segment = self.base[row] + ((spread * self.parts[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        self.n = int(self.parts.sum())
        self.count = np.bincount(self.segment, minlength=self.n)
        self.sums = [np.bincount(self.segment, weights=x, minlength=self.n).astype(np.uint64) for x in self.halves]
        self.holder = np.repeat(np.arange(len(size)), self.parts)
        self.place = np.arange(self.n) - self.base[self.holder]
        self.name = mix(seed[self.holder] * C1 + self.place.astype(np.uint64))

    def subsets(self, which: np.ndarray, names: np.ndarray) -> np.ndarray:
        return mix(mix(self.sums[0][which] * C3 + self.sums[1][which]) ^ names)

    def neighbourhoods(self, given_up: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the neighbours of segments: their subsets and these without one element each, in names; and whose they are."""
        after = self.base[self.holder[given_up]] + (self.place[given_up] + 1) % self.parts[self.holder[given_up]]
        wanted = np.zeros(self.n, dtype=bool)
        wanted[after] = True
        mine = np.flatnonzero(wanted[self.segment])
        mine = mine[np.argsort(self.segment[mine], kind="stable")]
        first = np.searchsorted(self.segment[mine], after)
        at, k = pretokens.ragged(first, self.count[after], np.arange(len(after)))
        which, element = np.repeat(np.arange(len(after)), k), mine[at]
        less = [s[after][which] - x[element].astype(np.uint64) for s, x in zip(self.sums, self.halves, strict=True)]
        keys = [self.subsets(after, names), mix(mix(less[0] * C3 + less[1]) ^ names[which])]
        return np.concatenate(keys), np.concatenate([np.arange(len(after)), which])


def signatures(flat: np.ndarray, ends: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of KEY_BITS bits, and the number of the set that each belongs to: subsets, and neighbourhoods for empty segments."""
    size = np.diff(ends)
    keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for step in (0, 1) if size.any() else ():
        of = Instance(flat, size, share, step)
        there, empty = np.flatnonzero(of.count > 0), np.flatnonzero(of.count == 0)
        near, whose = of.neighbourhoods(empty, mix(of.name[empty] + C2))
        keys += [of.subsets(there, of.name[there]), near]
        owners += [of.holder[there], of.holder[empty][whose]]
    return np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(owners)


def refined(flat: np.ndarray, ends: np.ndarray, share: int, keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the signatures (keys[i] of set owners[i]) that are subsets: the key, the keys instead, and the set.

    Those instead are of the subset and its neighbour's one-deletion neighbourhood together.
    """
    size, out = np.diff(ends), []
    wanted = np.sort(mix(keys * C3 + owners.astype(np.uint64)))
    for step in (0, 1) if size.any() else ():
        of = Instance(flat, size, share, step)
        there = np.flatnonzero(of.count > 0)
        own = of.subsets(there, of.name[there]) >> np.uint64(64 - KEY_BITS)
        given_up = np.isin(mix(own * C3 + of.holder[there].astype(np.uint64)), wanted)
        there, own = there[given_up], own[given_up]
        near, whose = of.neighbourhoods(there, mix(own + C2))
        out.append((own[whose], near, of.holder[there][whose]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (keys[:0], keys[:0], owners[:0])


def sketches(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each set the counts of its shingles in equal cells of the universe, four to a byte; 3 stands for 3 or more."""
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        bits = min(max((b - a).bit_length() - 1, LEAST_CELLS), MOST_CELLS)
        cells = np.minimum(np.bincount((flat[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 3).astype(np.uint8)
        out.append((cells[::4] | cells[1::4] << 2 | cells[2::4] << 4 | cells[3::4] << 6).tobytes())
    return out


def _cells(packed: list[bytes]) -> np.ndarray:
    """Counts of sketches of one size, a row each."""
    four = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    return np.stack([four >> i & 3 for i in (0, 2, 4, 6)], axis=2).reshape(len(packed), -1)


def _folded(cells: np.ndarray, n_cells: int) -> np.ndarray:
    """Counts in fewer cells; 3 stands for 3 or more again, as otherwise counts of 3 or more would be less than they are."""
    return np.minimum(cells.reshape(len(cells), n_cells, -1).sum(axis=2, dtype=np.int32), 3)


def may_link(one: list[bytes], other: list[bytes], n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """Which pairs of sketches, of sets of n and m shingles, can be of similar sets: sets differ by no less than the counts do,
    and counts by no less than the lesser of them and 3 do."""
    may = np.ones(len(one), dtype=bool)
    lengths = np.array([[len(x) for x in one], [len(x) for x in other]]).reshape(2, -1)
    for p, q in np.unique(lengths, axis=1).T.tolist():
        rows = np.flatnonzero((lengths[0] == p) & (lengths[1] == q))
        for some in np.split(rows, np.arange(4096, len(rows), 4096)):
            x, y = (_folded(_cells([z[i] for i in some]), min(p, q) * 4) for z in (one, other))
            may[some] = np.abs(x - y).sum(axis=1) * (100 + share) <= (100 - share) * (n[some] + m[some])
    return may


def may_link_among(packed: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """The same for pairs (a[i], b[i]) of the sets with the sketches packed: those of a piece of the pairs are unpacked once."""
    may, lengths = np.ones(len(a), dtype=bool), np.array([len(x) for x in packed])
    both = np.stack([lengths[a], lengths[b]]) if len(a) else np.zeros((2, 0), dtype=np.int64)
    for p, q in np.unique(both, axis=1).T.tolist():
        rows = np.flatnonzero((both[0] == p) & (both[1] == q))
        for some in np.split(rows, np.arange(4096, len(rows), 4096)):
            cells = []
            for side in (a[some], b[some]):
                sets, at = np.unique(side, return_inverse=True)
                cells.append(_folded(_cells([packed[i] for i in sets]), min(p, q) * 4).astype(np.int8)[at])
            differ = np.abs(cells[0] - cells[1]).sum(axis=1, dtype=np.int64)
            may[some] = differ * (100 + share) <= (100 - share) * (size[a[some]] + size[b[some]])
    return may


def with_partners(packed: list[bytes], size: np.ndarray, share: int, comp: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Which of some sets have another of another component, and block if there are two, that their sketches do not rule out;
    and the pairs of these, if there are no more than PAIRS for each set."""
    pairs, n_pairs = [], 0
    n_cells = 4 * min(map(len, packed))
    cells = np.zeros((len(packed), n_cells), dtype=np.int32)
    lengths = np.array([len(x) for x in packed])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        cells[rows] = _folded(_cells([packed[i] for i in rows]), n_cells)
    partners = np.zeros(len(packed), dtype=bool)
    names, which, times = np.unique(comp, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(which != times.argmax()).tolist():  # one of a pair is not of the largest component
        apart = comp != comp[i]
        if block.min() < block.max():
            apart &= block != block[i]
        rows = np.flatnonzero(apart)
        far = np.abs(cells[rows] - cells[i]).sum(axis=1) * (100 + share) > (100 - share) * (size[rows] + size[i])
        rows = rows[~far]
        partners[rows] = True
        partners[i] |= len(rows) > 0
        n_pairs += len(rows)
        if n_pairs <= PAIRS * len(packed):
            pairs.append(np.stack([np.full(len(rows), i), rows]))
    return partners, np.concatenate(pairs, axis=1) if pairs and n_pairs <= PAIRS * len(packed) else None


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, as a square matrix.

    Elements that many sets have are counted by a matrix product, a chunk of them at a time, others by their pairs of sets.
    """
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.append(first, len(flat)))
    both = np.zeros((k, k), dtype=np.float64)
    many = max(8, k // 16)
    dense = np.flatnonzero(times >= many)
    for some in np.split(dense, np.arange(1024, len(dense), 1024)):
        at, n = pretokens.ragged(first, times, some)
        has = np.zeros((k, len(some)), dtype=np.float32)
        has[owner[at], np.repeat(np.arange(len(some)), n)] = 1
        both += has @ has.T
    codes, n_codes = [], 0

    def add():
        pairs = np.bincount(np.concatenate(codes), minlength=k * k).reshape(k, k)
        return pairs + pairs.T

    for f in np.unique(times[(times > 1) & (times < many)]).tolist():
        i, j = np.triu_indices(f, 1)
        step = 500_000 // len(i) + 1
        at = first[times == f]
        for some in np.split(at, np.arange(step, len(at), step)):
            rows = owner[some[:, None] + np.arange(f)]
            codes.append((rows[:, i] * k + rows[:, j]).ravel())
            n_codes += len(codes[-1])
            if n_codes > 500_000:
                both += add()
                codes, n_codes = [], 0
    if codes:
        both += add()
    return both.astype(np.int64)


def _slices(batches):
    for batch in batches:
        texts = pretokens.text_column(batch)
        for at, to in pretokens.slices(texts, BLOCK_BYTES):
            yield batch.slice(at, to - at), texts.slice(at, to - at)


def _describe(width: int):
    def run(batches):
        for batch, texts in _slices(batches):
            flat, ends = shingle_sets(texts, width)
            n = np.diff(ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(set_hashes(flat, ends).view(np.int64), mask=n == 0), pa.array(sketches(flat, ends), pa.binary())], names=["doc_id", "text_key", "n", "set", "sketch"])
        pretokens.trim()

    return run


def _sign(width: int, share: int, ranges: int):
    def handed_on(gathered):
        keys, owner = (np.concatenate(x) for x in zip(*gathered, strict=True))
        part = (keys * np.uint64(ranges)) >> np.uint64(KEY_BITS)
        order = np.argsort(part, kind="stable")
        keys, owner, part = keys[order], owner[order], part[order]
        some, first = np.unique(part, return_index=True)
        low, high, cuts = keys.astype("<u4"), (keys >> np.uint64(32)).astype("<u2"), [*first.tolist(), len(keys)]
        blobs = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (low, high, owner)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], names=["part", "low", "high", "sets"])

    def run(batches):
        gathered, n_gathered = [], 0
        for _, texts in _slices(batches):
            flat, ends = shingle_sets(texts, width)
            names = set_hashes(flat, ends)
            _, once = np.unique(names, return_index=True)  # copies in a block have the same signatures
            at, n = pretokens.ragged(ends[:-1], np.diff(ends), once)
            keys, owner = signatures(flat[at], np.concatenate([[0], np.cumsum(n)]), share)
            gathered.append((keys, names[once][owner]))
            n_gathered += len(keys)
            if n_gathered > GATHERED:
                yield handed_on(gathered)
                gathered, n_gathered = [], 0
        if gathered:
            yield handed_on(gathered)
        pretokens.trim()

    return run


def _lists(part: pa.Table) -> pa.Table:
    """(key, set, k) of the keys of a range that k sets have, two or more."""
    low, high, sets = (np.concatenate([np.frombuffer(x, dtype=t) for x in part.column(c).to_pylist()]) for c, t in (("low", "<u4"), ("high", "<u2"), ("sets", "<u8")))
    keys = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    order = np.argsort(keys, kind="stable")
    keys, sets = keys[order], sets[order]
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    keys, sets = keys[shared], sets[shared]
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])[: len(keys)]
    keys, sets = keys[new], sets[new]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    k = times[which] if len(keys) else np.zeros(0, dtype=np.int64)
    two = k > 1
    pretokens.trim()
    return pa.table({"key": pa.array(keys[two].view(np.int64)), "set": pa.array(sets[two].view(np.int64)), "k": pa.array(k[two], pa.int64())})


def _right_sets(batch: pa.RecordBatch, texts: pa.Array, width: int):
    """The batch's sets that are those its column set names (another row may have their doc_id), one after the other."""
    flat, ends = shingle_sets(texts, width)
    names = set_hashes(flat, ends).view(np.int64)
    right = np.flatnonzero((names == batch.column("set").to_numpy()) & (np.diff(ends) > 0))
    at, n = pretokens.ragged(ends[:-1], np.diff(ends), right)
    return right, names[right], flat[at], np.concatenate([[0], np.cumsum(n)])


def _refine(width: int, share: int):
    def run(batches):
        for batch, texts in _slices(batches):
            right, names, flat, ends = _right_sets(batch, texts, width)
            lists = batch.column("keys").take(pa.array(right))
            keys, owners = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(right)), lists.value_lengths().to_numpy())
            before, key, owner = refined(flat, ends, share, keys, owners)
            yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), pa.array(key.view(np.int64)), pa.array(names[owner])], names=["before", "key", "set"])
        pretokens.trim()

    return run


def _contents(width: int):
    def run(batches):
        for batch, texts in _slices(batches):
            _, names, flat, ends = _right_sets(batch, texts, width)
            blobs = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["set", "content"])
        pretokens.trim()

    return run


def _possible(share: int):
    def run(batches):
        for batch in batches:
            one, other = (batch.column(c).to_pylist() for c in ("one", "other"))
            may = may_link(one, other, batch.column("m").to_numpy(), batch.column("n").to_numpy(), share)
            yield batch.select(["a", "b", "n"]).filter(pa.array(may))

    return run


def possible(pairs: DataFrame, sets: DataFrame, share: int, firsts: DataFrame | None = None) -> DataFrame:
    """(a, b, n) for those of pairs(a, b) whose sketches do not rule out that they link; n is b's size. firsts: the sets of a."""
    known = sets.select("set", "n", "sketch")
    firsts = known if firsts is None else firsts
    one = pairs.join(known, F.col("set") == F.col("b")).select("a", "b", F.col("n").alias("_n"), F.col("sketch").alias("other"))
    both = one.join(firsts, F.col("set") == F.col("a")).select("a", "b", F.col("_n").alias("n"), F.col("n").alias("m"), F.col("sketch").alias("one"), "other")
    return both.mapInArrow(_possible(share), "a long, b long, n long")


def _compare(share: int):
    def run(group: pa.Table) -> pa.Table:
        a, b = (group.column(c).to_pylist() for c in ("a", "b"))
        sets = [np.frombuffer(x, dtype="<u8") for x in group.column("content").to_pylist()]
        centers = {x: s for x, y, s in zip(a, b, sets, strict=True) if y is None}
        links = []
        for x, y, s in zip(a, b, sets, strict=True):
            if y is not None and (c := centers.get(x)) is not None:
                place = np.searchsorted(c, s)
                both = int((c[np.minimum(place, len(c) - 1)] == s).sum())
                if 100 * both >= share * (len(c) + len(s) - both):
                    links.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def verify(pairs: DataFrame, contents: DataFrame, share: int, work: Workspace) -> DataFrame:
    """Those of distinct pairs(a, b, n) that link (n is b's size).

    Each a is compared with its partners, whole, in groups of about GROUP_SHINGLES; an a with more has several groups,
    those with fewer share one.
    """
    n_pairs = pairs.count()
    total = pairs.groupBy("a").agg(F.sum("n").alias("total"))
    pools = F.lit(int(total.agg(F.sum("total")).first()[0] or 0) // GROUP_SHINGLES * 2 + 16)
    many = F.floor(F.col("total") / GROUP_SHINGLES) + 1
    pool = F.when(many > 1, F.xxhash64("a", F.pmod(F.xxhash64("b"), many))).otherwise(F.pmod(F.xxhash64("a"), pools))
    dealt = work.stored(pairs.join(total.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select("a", "b", pool.alias("pool")), "pairs")
    partners = contents.join(small_side(dealt, n_pairs, 100), contents["set"] == F.col("b")).select("pool", "a", "b", "content")
    centers = contents.join(small_side(dealt.select("pool", "a").distinct(), n_pairs, 100), contents["set"] == F.col("a")).select("pool", "a", F.lit(None).cast("long").alias("b"), "content")
    return work.stored(partners.union(centers).groupBy("pool").applyInArrow(_compare(share), "a long, b long"), "verified")


def _union_find(links: pa.Table) -> pa.Table:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(n) for n in nodes], pa.int64())})


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of links(a, b): up to ONE_TASK links in one task, which takes seconds; more by distributed rounds."""
    links = work.stored(links.select("a", "b"), "links")
    if links.count() > ONE_TASK:
        return work.stored(connected_components(links, work), "roots")
    return work.stored(links.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_union_find, "node long, root long"), "roots")


def _pairs(part: pa.Table, share: int) -> pa.Table:
    """Each pair of sets of different components that are in one of the lists of a part, and of sizes that can link, once."""
    key, sets, comp, size = (part.column(c).to_numpy() for c in ("key", "set", "comp", "n"))
    order = np.lexsort((sets, key))
    key, sets, comp, size = key[order], sets[order], comp[order], size[order]
    names, code = np.unique(sets, return_inverse=True)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, found = np.diff(np.append(first, len(key))), []
    for k in np.unique(times[times > 1]).tolist():
        i, j = np.triu_indices(k, 1)
        at = first[times == k]
        for some in np.split(at, np.arange(1_000_000 // len(i) + 1, len(at), 1_000_000 // len(i) + 1)):
            rows = some[:, None] + np.arange(k)
            one, other = rows[:, i].ravel(), rows[:, j].ravel()
            apart = (comp[one] != comp[other]) & (sets[one] != sets[other])
            apart &= 100 * np.minimum(size[one], size[other]) >= share * np.maximum(size[one], size[other])
            found.append(np.unique(code[one[apart]] * len(names) + code[other[apart]]))
    a, b = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64), max(len(names), 1))
    pretokens.trim()
    return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})


def _sifted(share: int):
    def run(part: pa.Table) -> pa.Table:
        """_pairs, with the size n of b: of lists with sketches those that these leave, of others all, with n null."""
        bare = pc.is_null(part.column("sketch"))
        open_pairs, part = _pairs(part.filter(bare), share), part.filter(pc.invert(bare))
        pairs = _pairs(part, share)
        names, first = np.unique(part.column("set").to_numpy(), return_index=True)
        packed, size = part.column("sketch").take(pa.array(first)).to_pylist(), part.column("n").to_numpy()[first]
        a, b = (np.searchsorted(names, pairs.column(c).to_numpy()) for c in ("a", "b"))
        may = may_link_among(packed, size, a, b, share)
        left = pairs.filter(pa.array(may)).append_column("n", pa.array(size[b[may]], pa.int64()))
        pretokens.trim()
        return pa.concat_tables([left, open_pairs.append_column("n", pa.nulls(len(open_pairs), pa.int64()))])

    return run


def _partners(share: int):
    def run(part: pa.Table) -> pa.Table:
        comp, block, names = (part.column(c).to_numpy() for c in ("comp", "block", "_s"))
        found, pairs = with_partners(part.column("sketch").to_pylist(), part.column("n").to_numpy(), share, comp, block)
        if pairs is None:
            rows = part.drop_columns(["sketch", "n"]).filter(pa.array(found))
            return rows.append_column("_b", pa.nulls(len(rows), pa.int64()))
        rows = part.drop_columns(["sketch", "n"]).take(pa.array(pairs[0]))
        return rows.append_column("_b", pa.array(names[pairs[1]]))

    return run


def _unlike(share: int):
    def run(part: pa.Table) -> pa.Table:
        """Links between sets of two blocks of a list, as many as join what all their links join."""
        names, first = np.unique(part.column("set").to_numpy(), return_index=True)
        comp, block = (part.column(c).to_numpy()[first] for c in ("comp", "block"))
        sets = [np.frombuffer(x, dtype="<u8") for x in part.column("content").take(pa.array(first)).to_pylist()]
        size, both = np.array([len(s) for s in sets]), in_common(sets)
        linked = (100 * both >= share * (size[:, None] + size - both)) & (comp[:, None] != comp)
        if part.column("x")[0] != part.column("y")[0]:
            linked &= block[:, None] != block
        a, b, root = [], [], dict(zip(comp.tolist(), comp.tolist(), strict=True))

        def find(x: int) -> int:
            while (up := root[x]) != x:
                root[x] = x = root[up]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[x] = y
                a.append(names[i])
                b.append(names[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def compare_lists(lists: DataFrame, sets: DataFrame, extended, share: int, work: Workspace) -> DataFrame:
    """Links (a, b) between sets of different components in lists(key, set, n, sketch, comp), enough to join what they join.

    A list's sets are dealt to blocks, those of a large component to blocks of their own, and two blocks meet in one group
    unless they are of one component. First only their sketches meet. If these leave few pairs, they are compared once each;
    if many, the sets that have a partner left meet whole.
    """
    each = lists.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    share_of = lambda k, s: F.greatest(F.ceil(k / BLOCK_SETS), F.ceil(s / (GROUP_SHINGLES / 2)))
    each = each.withColumn("own", F.when((F.col("k") >= BLOCK_SETS) | (F.col("s") >= GROUP_SHINGLES / 2), share_of(F.col("k"), F.col("s"))).otherwise(F.lit(0)))
    rest = each.where("own = 0").groupBy("key").agg(share_of(F.sum("k"), F.sum("s")).alias("blocks")).withColumnRenamed("key", "_key")
    each = each.join(rest, F.col("key") == F.col("_key"), "left").select(F.col("key").alias("_key"), F.col("comp").alias("_comp"), "own", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    dealt = lists.join(each, (F.col("key") == F.col("_key")) & (F.col("comp") == F.col("_comp")))
    block = F.when(F.col("own") > 0, F.xxhash64("comp", F.pmod(F.xxhash64("set"), F.col("own")))).otherwise(F.pmod(F.xxhash64("comp"), F.col("blocks")))
    dealt = work.stored(dealt.select("key", "set", "n", "comp", "sketch", block.alias("block"), (F.col("own") > 0).alias("pure")), "blocks")
    blocks = dealt.groupBy("key", "block").agg(F.max(F.when(F.col("pure"), F.col("comp"))).alias("of"))
    x, y = blocks.toDF("_key", "x", "p"), blocks.toDF("_k", "y", "q")
    met = x.join(y, F.col("_key") == F.col("_k")).where("x <= y and not coalesce(p = q, false)").select("_key", "x", "y")
    met = work.stored(met.withColumn("mine", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y")))), "meetings")
    rows = dealt.join(met, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("mine"))).select("key", F.col("set").alias("_s"), "comp", "block", "x", "y", "n", "sketch")
    rows = work.stored(rows.groupBy("key", "x", "y").applyInArrow(_partners(share), "key long, _s long, comp long, block long, x long, y long, _b long"), "partners")
    pairs = rows.where("_b is not null").select(F.least("_s", "_b").alias("a"), F.greatest("_s", "_b").alias("b")).distinct()
    pairs = work.stored(pairs.join(sets.select("set", "n"), F.col("b") == F.col("set")).select("a", "b", "n"), "some")
    rows = rows.where("_b is null").drop("_b")
    contents = extended(rows.select(F.col("_s").alias("set")).union(pairs.select("a")).union(pairs.select("b")))
    rows = contents.join(rows, F.col("set") == F.col("_s")).drop("_s")
    return verify(pairs, contents, share, work).union(rows.groupBy("key", "x", "y").applyInArrow(_unlike(share), "a long, b long"))


def _count(share: int):
    def run(part: pa.Table) -> pa.Table:
        names, first = np.unique(part.column("set").to_numpy(), return_index=True)  # rows that repeat have a set twice
        root, block = (part.column(c).to_numpy()[first] for c in ("root", "block"))
        x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
        contents = part.column("content").take(pa.array(first)).to_pylist()
        order = np.argsort(root, kind="stable")
        links = np.zeros(len(names), dtype=np.int64)
        for mine in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            sets = [np.frombuffer(contents[i], dtype="<u8") for i in mine]
            size, both = np.array([len(s) for s in sets]), in_common(sets)
            linked = 100 * both >= share * (size[:, None] + size - both)
            np.fill_diagonal(linked, False)
            if x != y:
                linked &= block[mine][:, None] != block[mine]
            links[mine] = linked.sum(axis=1)
        return pa.table({"set": pa.array(names), "links": pa.array(links)})

    return run


def count_links(roots: DataFrame, contents: DataFrame, sets: DataFrame, share: int, work: Workspace) -> DataFrame:
    """(set, degree): with how many other sets each set of roots(node, root) links.

    Sets that link are in one component, so all pairs of a component are compared. Its sets are dealt to blocks, and two
    blocks meet in one group; components of one block share groups.
    """
    members = roots.join(sets.select("set", "n"), F.col("node") == F.col("set")).select("set", "root", "n")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / (GROUP_SHINGLES / 2))).alias("blocks"), F.sum("n").alias("total")).withColumnRenamed("root", "_root")
    blocks = work.stored(blocks, "blocks")
    pools = F.lit((blocks.agg(F.sum("total")).first()[0] or 0) // GROUP_SHINGLES * 2 + 16)
    dealt = members.join(blocks, F.col("root") == F.col("_root")).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("set"), F.col("blocks"))).otherwise(F.lit(0)))
    pool = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), pools))
    dealt = dealt.select("set", "root", "block", pool.alias("pool"), (F.col("blocks") > 1).alias("large"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other").withColumnRenamed("set", "_s")
    rows = work.stored(dealt, "dealt")
    rows = contents.select("set", "content").join(small_side(rows, rows.count(), 100), F.col("set") == F.col("_s")).drop("_s")
    found = rows.groupBy("large", "pool", "x", "y").applyInArrow(_count(share), "set long, links long")
    return work.stored(found.groupBy("set").agg(F.sum("links").alias("degree")), "degrees")


def index_lists(rows: DataFrame, sets: DataFrame, width: int, share: int, ranges: int, work: Workspace) -> DataFrame:
    """(key, set, k): the index lists of two sets or more, with their lengths, after allocation by cost."""
    signed = rows.select("text").mapInArrow(_sign(width, share, ranges), "part int, low binary, high binary, sets binary")
    lists = work.stored(signed.groupBy("part").applyInArrow(_lists, "key long, set long, k long"), "lists")
    long = lists.where(F.col("k") > REFINE)
    keys = work.stored(long.groupBy("set").agg(F.collect_list("key").alias("keys")), "long lists")
    n_long = keys.count()
    if not n_long:
        return lists
    texts = texts_of(rows, keys, n_long, sets, "keys")
    instead = work.stored(texts.mapInArrow(_refine(width, share), "before long, key long, set long"), "refined")
    each = work.stored(instead.groupBy("before", "key").agg(F.count("*").alias("k")), "refined lists")
    after = each.groupBy("before").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("cost"))
    before = long.select(F.col("key").alias("_key"), "k").distinct()
    given_up = before.join(after, F.col("_key") == F.col("before")).where("cost < k * (k - 1)").select("_key")
    given_up = work.stored(given_up, "given up")
    n_given_up = given_up.count()
    stay = lists.join(small_side(given_up, n_given_up, 24), F.col("key") == F.col("_key"), "left_anti")
    several = each.where("k > 1").join(given_up, F.col("before") == F.col("_key"), "left_semi").select(F.col("before").alias("_before"), F.col("key").alias("_key"), "k")
    finer = instead.join(several, (F.col("key") == F.col("_key")) & (F.col("before") == F.col("_before"))).select("key", "set", "k")
    out = work.stored(stay.union(finer), "allocated")
    work.discard("lists", "long lists", "refined", "refined lists", "given up")
    return out


def texts_of(rows: DataFrame, wanted: DataFrame, n_wanted: int, sets: DataFrame, *more: str) -> DataFrame:
    """A text for each of wanted(set, *more), from the row with the least doc_id that has the set; rows that repeat each give one."""
    ids = wanted.join(sets.select(F.col("set").alias("_set"), "id", "text_key"), F.col("set") == F.col("_set")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "set", *more)
    here = (F.coalesce("doc_id", F.lit(-1 << 63)) == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return rows.join(small_side(ids, n_wanted, 400 if more else 64), here).select("set", "text", *more)


def join(docs: DataFrame, width: int = 5, share: int = 80, counted: bool = True) -> DataFrame:
    """doc_id, text_key, class, n_shingles, component_id and, if counted, n_links for each row of docs(doc_id, text).

    Two rows link when 100 * |x & y| >= share * |x | y| for their sets of width-word shingles (A-Z folded, words
    `[^\\x20\\x09-\\x0D]+`; with fewer words the whole sequence is one shingle). component_id is the smallest doc_id
    reachable by links, its own included; equal sets link. n_links is the number of different sets that the row's set
    links with, every one, in a component of any size. class is the component's number, null for an empty
    set; text_key is xxhash64(text). A null or empty text, or one without words, has an
    empty set and links with nothing; a very long one is a set like any. A null doc_id is no smallest one; a component
    without another has a null id. Rows that repeat each give a row. No rows: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = work.stored(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(width), "doc_id long, text_key long, n long, set long, sketch binary"), "documents")
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "text_key"))
    sets = described.where("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), row.alias("row"), F.min("sketch").alias("sketch"))
    sets = work.stored(sets.select("set", "n", "least", "row.id", "row.text_key", "sketch"), "sets")
    ranges = max(8, input_bytes(docs) // RANGE_BYTES)
    lists = index_lists(rows, sets, width, share, ranges, work)
    work.tidy()
    found = _links(rows, lists, sets, width, share, ranges, work) if not lists.isEmpty() else None
    degree = spark.createDataFrame([], "set long, degree long")
    if found is None:
        labels = sets.select(F.col("set").alias("_set"), F.col("least").alias("component"), F.col("set").alias("class"))
    else:
        roots, contents = found
        if counted:
            degree = count_links(roots, contents, sets, share, work)
        joined = sets.join(roots, sets["set"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set"))
        least = joined.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "_root")
        labels = joined.join(least, F.col("root") == F.col("_root")).select(F.col("set").alias("_set"), "component", F.col("root").alias("class"))
    if counted:
        labels = labels.join(degree.withColumnRenamed("set", "_d"), F.col("_set") == F.col("_d"), "left").drop("_d")
    labels = work.stored(labels, "labels")
    out = described.join(labels, F.col("set") == F.col("_set"), "left")
    return out.select("doc_id", "text_key", "class", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *([F.coalesce("degree", F.lit(0).cast("long")).alias("n_links")] if counted else []))


def _links(rows: DataFrame, lists: DataFrame, sets: DataFrame, width: int, share: int, ranges: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the components that the links of the lists' sets make, and the contents(set, content) of these sets."""

    tables: list[DataFrame] = []

    def extended(wanted: DataFrame | None = None) -> DataFrame:
        """The contents so far, with those of the sets wanted."""
        if wanted is not None:
            wanted = wanted.distinct()
            for known in tables:
                wanted = wanted.join(known.select(F.col("set").alias("_s")), F.col("set") == F.col("_s"), "left_anti")
            wanted = work.stored(wanted, "wanted")
            n = wanted.count()
            more = work.stored(texts_of(rows, wanted, n, sets).mapInArrow(_contents(width), "set long, content binary"), "contents")
            tables.append(more if more.count() == n else work.stored(more.dropDuplicates(["set"]), "contents"))  # else rows repeat
        return reduce(DataFrame.union, tables)

    # First the sets of longer lists with one of the list: the one that shares most lists with others, of copies with edits the original.
    longer = lists.where(F.col("k") > STAR)
    score = lists.groupBy("set").agg(F.sum(F.col("k") - 1).alias("score")).withColumnRenamed("set", "_set")
    scored = longer.join(score, F.col("set") == F.col("_set")).select("key", "set", "score")
    center = work.stored(scored.groupBy("key").agg(F.max_by("set", F.struct("score", "set")).alias("a")).withColumnRenamed("key", "_key"), "centers")
    stars = longer.join(center, F.col("key") == F.col("_key")).where("a <> set").select("a", F.col("set").alias("b")).distinct()
    # Centers are few: their sketches go to the other sets' if they can, else these to the centers.
    centers = sets.select("set", "n", "sketch").join(small_side(center.select("a").distinct(), center.count(), 24), F.col("set") == F.col("a"), "left_semi")
    n_bytes = centers.agg(F.sum(F.length("sketch") + 60)).first()[0] or 0
    stars = work.stored(possible(stars, sets, share, small_side(centers, n_bytes, 1)), "stars")
    work.tidy()
    found = verify(stars, extended(stars.select("a").union(stars.select("b")).toDF("set")), share, work)
    # Then what is left in lists of more than one component: first in those up to LIGHT, then in longer ones.
    now = sets.select(F.col("set").alias("_set"), "n", "sketch").join(components(found, work), F.col("_set") == F.col("node"), "left").select("_set", "n", F.coalesce("root", "_set").alias("comp"), "sketch")
    light = lists.where(F.col("k") <= LIGHT).join(now, F.col("set") == F.col("_set"))
    dealt = light.select(F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("part"), "key", "set", "n", "comp", F.when(F.col("k") > SHORT, F.col("sketch")).alias("sketch"))
    met = work.stored(dealt.groupBy("part").applyInArrow(_sifted(share), "a long, b long, n long"), "met")
    work.discard("stars", "centers")
    open_pairs = met.where("n is null").select("a", "b").repartition("b").distinct()  # dealt by b once, also for the join
    pairs = work.stored(possible(open_pairs, sets, share).union(met.where("n is not null")).distinct(), "possible")
    found = found.union(verify(pairs, extended(pairs.select("a").union(pairs.select("b")).toDF("set")), share, work))
    heavy = _apart(lists.where(F.col("k") > LIGHT), components(found, work), work)
    heavy = work.stored(heavy.join(sets.select(F.col("set").alias("_s"), "n", "sketch"), F.col("set") == F.col("_s")).select("key", "set", "n", "sketch", "comp"), "long")
    work.tidy()
    found = found.union(compare_lists(heavy, sets, extended, share, work))
    return components(found, work), extended()


def _apart(lists: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """(key, set, k, comp) of those lists(key, set, k) that have sets of more than one component."""
    now = lists.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", "k", F.coalesce("root", "set").alias("comp"))
    apart = now.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select(F.col("key").alias("_key"))
    return work.stored(now.join(apart, F.col("key") == F.col("_key"), "left_semi"), "apart")


def keep_first(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of each class the row with the smallest doc_id.

    A null doc_id is larger than any. Of rows of the class with that same doc_id the one with the least text hash stays,
    of rows with the same doc_id and text the least by its columns. Rows with an empty set all stay. What is joined to
    docs is (doc_id, text hash) of the rows that go; within its size bound it is broadcast, so that texts are not shuffled.
    """
    work = Workspace(docs.sparkSession)
    found = work.stored(join(docs.select("doc_id", "text"), width, share, counted=False).where("n_shingles > 0").select("doc_id", "text_key", "class"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = found.groupBy("class").agg(F.min(order).alias("x"), F.count("*").alias("n"))
    first = work.stored(first.where("n > 1").select(F.col("class").alias("_class"), "x.doc_id", "x.text_key"), "first")
    members = found.join(small_side(first.select("_class", F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")), first.count(), 40), F.col("class") == F.col("_class"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))
    gone = work.stored(members.where(~same).select("doc_id", "text_key").distinct().toDF("_d", "_t"), "gone")
    many = work.stored(members.where(same).groupBy("doc_id", "text_key").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "text_key").toDF("_d", "_t"), "repeated")
    # The columns of docs go in a struct, so that none of them can have the name of one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    here = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("_row.text") == F.col("_t"))
    left = rows.join(small_side(gone, gone.count(), 32), here, "left_anti")
    n_many = many.count()
    if n_many:
        several = left.join(small_side(many, n_many, 32), here, "left_semi").groupBy("_row.doc_id", F.xxhash64("_row.text")).agg(F.min("_row").alias("_row"))
        left = left.join(small_side(many, n_many, 32), here, "left_anti").union(several.select("_row"))
    return left.select("_row.*")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs, 4, 85).select("doc_id", "n_shingles", "component_id", "n_links")
