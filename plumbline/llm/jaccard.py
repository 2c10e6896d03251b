"""N-gram Jaccard join with prefix trees.

1. A document becomes the set of its distinct shingles. Equal sets are one set from here on.
2. Sets that can reach the threshold are brought together without loss. Two such sets of about ``n`` shingles differ in at most ``D`` shingles,
   D = (1 - t) / t * n of the smaller one. Shingles are dealt to K = D + 1 + slack slices by hash, so linked sets agree in more
   than ``slack`` whole slices, and sets that agree in one slice meet by the slice's signature. Slices of fewer than two shingles and
   signatures that very many sets have (a passage that is everywhere) say little; a set may ignore up to ``slack`` of them and still
   meets all its links. A set with more of them than that is dealt again with another hash, and keeps its common signatures.
   Of what a set may ignore, the part that it doesn't need must be shared as well: a pair is a candidate only if it shares more signatures than
   both can still spare. Signatures of more than ``PAIRED`` sets join their sets without that count.
3. Components beyond ``BLOCK`` sets, which grow with the corpus by chains of pairs that are not linked, are split first. A sketch marks the cells
   that a set's shingles fall into by hash. Each cell of one set that another hasn't holds a shingle that they don't share, so two sketches
   bound the overlap from above, and sets whose bound misses the threshold are not linked. Sets of like sizes meet by their sketches alone.
4. The sets of a component of candidates are stored in a prefix tree under one global order. One walk over the tree keeps the partial
   overlaps with all other sets, shares them below each node, and leaves a branch when the shingles that remain can't reach any set's bound.
   Components that are still beyond ``BLOCK`` sets are dealt to pairs of blocks.
5. Links become components by alternating stars; nothing is gathered but one block pair.

Defined results: null and empty texts have no set, size 0, and are components of their own; fewer words than ``width`` are one
shingle; repeated rows and equal texts are linked; a null key takes part in links, but the smallest key that is not null names the
component. Input columns besides key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import FOLD, ID_LIST, SPACE_SEPARATED, arrow_batches, durable, mix, only, pieces, stored, utf8, words
from plumbline.llm.components import connected

WIDTH = 4
PERCENT = 85
BAND = 1.25  # sizes of one band share a number of slices
SLACK = 0.12  # slices beyond the largest difference, as a share of it
COMMON = 64  # a signature of more sets is common
PAIRED = 32  # signatures of up to so many sets are counted for each pair of them
HELD_PAIRS = 300_000  # pairs a task counts before it gives them out
DEALS = 6  # hashes to deal by before a burdened set keeps whatever signatures it has
BLOCK = 2048
CELLS = 4  # cells of a sketch for each shingle, at least
SKETCHED = 4096  # sets of a block of sketches
HELD_WORDS = 1_000_000  # words of sketches compared at once
RECENT = 50_000  # sets a task remembers, so that it sends the signatures of copies once


def _mix_with(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each text, and where each text's begin (n + 1 values)."""
    _, _, h, first = words(data, off, SPACE_SEPARATED, FOLD)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    doc = np.repeat(np.arange(len(n)), count)
    start = first[doc] + np.arange(int(at[-1])) - at[doc]
    s = np.zeros(len(start), np.uint64)
    length = np.minimum(n[doc], width)
    for j in range(width):
        on = j < length
        s[on] = s[on] * np.uint64(0xC2B2AE3D27D4EB4F) + h[start[on] + j]
    s = mix(s + length.astype(np.uint64))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def set_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets, equal names; 0 for an empty set."""
    if not len(s):
        return np.zeros(len(at) - 1, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix_with(s, 1), dtype=np.uint64)])
    n = np.diff(at)
    out = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out.view(np.int64)


def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """Lower ends of size bands; consecutive ends are further apart than the ratio of two linked sizes."""
    ends, ratio = [1], max(BAND, 100 / percent * 1.02)
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, math.ceil(ends[-1] * ratio)))
    return np.array(ends, np.int64)


def least_shingles(percent: int) -> int:
    """How many shingles a slice must have to count: two, if the slack then covers the slices with fewer in most sets, else one."""
    mean = 1 / ((100 - percent) / percent * (1 + SLACK) * BAND)  # shingles to a slice of the smallest sets of a band
    return 2 if math.exp(-mean) * (1 + mean) * (1 + SLACK) <= SLACK else 1


def signatures(s: np.ndarray, at: np.ndarray, percent: int = PERCENT):
    """(set index, system, signature, slack left) of every slice with two or more shingles, for every system a set takes part in.

    A system is a band with its number of slices and a deal. A set takes part in its own band and in the lower one if a linked set may lie there.
    """
    ends = bands(percent)
    least = least_shingles(percent)
    size = np.diff(at)
    band = np.searchsorted(ends, size, "right") - 1
    apart = (100 - percent) / percent  # largest symmetric difference over the smaller size
    out = []
    for below in (0, 1):
        b = band - below
        may = size > 0
        if below:
            may &= (b >= 0) & (np.ceil(size * percent / 100 - 1e-9) <= ends[np.maximum(b + 1, 0)] - 1)
        top = ends[np.maximum(b, 0) + 1] - 1  # largest smaller set of the band
        differ = np.floor(apart * top + 1e-9).astype(np.int64)
        may &= differ > 0  # sets this small are linked only if equal
        slack = np.maximum(2, np.ceil(differ * SLACK).astype(np.int64))
        slices = differ + 1 + slack
        for deal in range(DEALS):
            which = np.flatnonzero(may)
            if not len(which):
                break
            n = size[which]
            base = np.concatenate([[0], np.cumsum(slices[which])])
            pos = np.repeat(at[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            doc = np.repeat(np.arange(len(which)), n)
            token = s[pos]
            k = slices[which][doc].astype(np.uint64)
            cell = base[doc] + ((_mix_with(token, 11 + deal) >> np.uint64(33)) * k >> np.uint64(31)).astype(np.int64)
            cells = int(base[-1])
            count = np.bincount(cell, minlength=cells)
            order = np.argsort(cell, kind="stable")
            first = np.searchsorted(cell[order], np.arange(cells))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix_with(token, 2)[order], dtype=np.uint64)])
            total = sums[np.minimum(first + count, len(token))] - sums[np.minimum(first, len(token))]
            owner = np.repeat(np.arange(len(which)), slices[which])
            place = np.arange(cells) - base[owner]
            system = (b[which] * DEALS + deal)[owner]
            full = count >= least
            left = slack[which] - np.bincount(owner[~full], minlength=len(which))
            last = deal == DEALS - 1
            use = full | last  # the last deal uses every slice, so it loses nothing
            sig = mix(total + mix(place.astype(np.uint64) * np.uint64(1 << 20) + system.astype(np.uint64)))
            out.append((which[owner[use]], system[use], sig[use], np.maximum(left, -1)[owner[use]]))
            may[which[left >= 0]] = False  # burdened sets only are dealt again
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out))


def _sets_of(key: str, text: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                s, at = shingle_sets(*utf8(batch.column(batch.schema.get_field_index(text)))[:2], width)
                yield pa.RecordBatch.from_pydict({"key": batch.column(batch.schema.get_field_index(key)), "content": batch.column(batch.schema.get_field_index("content")),
                                                  "n": pa.array(np.diff(at)), "sid": pa.array(set_ids(s, at))})

    return run


def _signatures_of(text: str, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, None] = {}
        for whole in batches:
            for batch in pieces(whole, text):
                s, at = shingle_sets(*utf8(batch.column(batch.schema.get_field_index(text)))[:2], width)
                sid = set_ids(s, at)
                fresh = np.zeros(len(sid), bool)
                for i, x in enumerate(sid.tolist()):
                    fresh[i] = x not in recent
                    recent[x] = None
                while len(recent) > RECENT:
                    recent.pop(next(iter(recent)))
                n = np.where(fresh, np.diff(at), 0)
                s = s[np.repeat(fresh, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(n)])
                which, system, sig, left = signatures(s, at, percent)
                yield pa.RecordBatch.from_pydict({"sig": pa.array(sig.view(np.int64)), "sid": pa.array(sid[which]),
                                                  "system": pa.array(system.astype(np.int32)), "left": pa.array(left.astype(np.int32))})

    return run


def _pairs(x: dict[str, np.ndarray], edge: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (larger set, smaller set, system, slack left of either) for every two sets of the signatures that begin at ``edge``; sets ascend in each."""
    out = []
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        first = edge[size == n][:, None]
        high, low = (first + j).ravel(), (first + i).ravel()
        out.append(np.stack([x["sid"][high], x["sid"][low], x["system"][high].astype(np.int64), x["left"][high].astype(np.int64), x["left"][low].astype(np.int64)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition come ordered by (sig, sid). Of signatures with two or more sets, says (sid, leader, sig, system, left, other, n): a pair of
    sets with what either can spare and the number of signatures counted here; or, without a number, a set with the first one of its
    signature, and the signature if it is common.

    A run may be longer than a batch; only what is needed to call it common is held back.
    """
    held = {c: np.zeros(0, t) for c, t in (("sig", np.int64), ("sid", np.int64), ("system", np.int32), ("left", np.int32))}
    running = None  # (signature, leader) of a common run that goes on
    pairs: list[np.ndarray] = []

    def out(sid, leader, sig, system, left, other, n):
        return pa.RecordBatch.from_pydict({"sid": pa.array(sid, pa.int64()), "leader": pa.array(leader, pa.int64()), "sig": sig, "system": pa.array(system.astype(np.int32)),
                                           "left": pa.array(left.astype(np.int32)), "other": other, "n": n})

    def counted() -> pa.RecordBatch:
        rows = np.concatenate(pairs)
        pairs.clear()
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        sid, leader, system, left, other = rows[first].T
        return out(sid, leader, pa.nulls(len(first), pa.int64()), system, left, pa.array(other.astype(np.int32)), pa.array(np.diff(np.r_[first, len(rows)]).astype(np.int32)))

    def decide(x, end: bool):
        nonlocal running
        if not len(x["sig"]):
            return None, x
        new = np.ones(len(x["sig"]), bool)
        new[1:] = (x["sig"][1:] != x["sig"][:-1]) | (x["sid"][1:] != x["sid"][:-1])  # copies from several tasks
        x = {c: v[new] for c, v in x.items()}
        edge = np.flatnonzero(np.r_[True, x["sig"][1:] != x["sig"][:-1]])
        size = np.diff(np.r_[edge, len(x["sig"])])
        leader, common = np.repeat(x["sid"][edge], size), np.repeat(size > COMMON, size)
        ready = np.repeat(size > 1, size)
        if running and x["sig"][0] == running[0]:
            leader[: size[0]], common[: size[0]], ready[: size[0]] = running[1], True, True
        keep = len(x["sig"])
        if not end and not common[-1]:  # the last run may go on
            keep = int(edge[-1])
        elif common[-1]:
            running = (x["sig"][-1], leader[-1])
        ready[keep:] = False
        few = (size > 1) & (size <= PAIRED) & ready[edge] & ~common[edge]
        pairs.append(_pairs(x, edge[few], size[few]))
        ready &= ~np.repeat(few, size)
        n = int(ready.sum())
        said = out(x["sid"][ready], leader[ready], pa.array(x["sig"][ready], mask=~common[ready]), x["system"][ready], x["left"][ready],
                   pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())) if n else None
        return said, {c: v[keep:] for c, v in x.items()}

    for batch in batches:
        x = {c: np.concatenate([held[c], batch.column(batch.schema.get_field_index(c)).to_numpy()]) for c in held}
        said, held = decide(x, False)
        if said is not None:
            yield said
        if sum(map(len, pairs)) > HELD_PAIRS:
            yield counted()
    said, _ = decide(held, True)
    if said is not None:
        yield said
    if sum(map(len, pairs)):
        yield counted()


def candidate_edges(documents: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(a, b) set ids; every two linked sets are in one component of these edges."""
    rows = documents.select(F.col(text).alias("text")).mapInArrow(_signatures_of("text", width, percent), "sig long, sid long, system int, left int")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored(rows.repartition(n, "sig").sortWithinPartitions("sig", "sid").mapInArrow(
        _meet, "sid long, leader long, sig long, system int, left int, other int, n int"))
    common = met.filter("sig is not null")
    often = durable(common.groupBy("sig").agg(F.count(F.lit(1)).alias("often")))
    ranked = common.join(F.broadcast(often) if often.count() <= ID_LIST else often, "sig")
    # A set drops the most frequent common signatures that it can spare. All sets have the same order, so of what two linked sets share the least
    # frequent stays with both. The list is as long as the set has slices; most of it names the same few leaders.
    listed = ranked.groupBy("sid", "system").agg(F.min("left").alias("left"), F.array_sort(F.collect_list(F.struct("often", "sig", "leader"))).alias("all"))
    kept = F.slice("all", F.lit(1), F.greatest(F.size("all") - F.greatest("left", F.lit(0)), F.lit(0)))
    listed = durable(listed.select("sid", "system", F.size("all").cast("long").alias("spent"), F.array_distinct(F.transform(kept, lambda x: x["leader"])).alias("leaders")))
    heavy = listed.select("sid", F.explode("leaders").alias("leader"))
    spent = listed.select("sid", "system", "spent")
    # Linked sets agree in more slices than the slack, so a set that ignores some of them shares more than what is left of it.
    pairs = met.filter("n is not null").groupBy("sid", "leader", "system").agg(F.sum("n").alias("n"), F.min("left").alias("left"), F.min("other").alias("other"))
    pairs = (pairs.join(spent, ["sid", "system"], "left").filter("n > left - coalesce(spent, 0)").drop("spent")
             .join(spent.withColumnRenamed("sid", "leader"), ["leader", "system"], "left").filter("n > other - coalesce(spent, 0)").select("sid", "leader"))
    stars = met.filter("n is null and sig is null").select("sid", "leader")
    return stars.union(pairs).union(heavy).filter("sid <> leader").distinct().toDF("a", "b")


def _needed(n_x, n_y, percent: int):
    """Smallest overlap of linked sets: 100 * overlap >= percent * (n_x + n_y - overlap)."""
    return -(-percent * (n_x + n_y) // (100 + percent))


class Forest:
    """Union by smallest root over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def tree_links(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[Forest, np.ndarray]:
    """Components of the links among ``sets`` and the number of links of each set.

    The order of shingles is from rare to frequent in this group. Sets in that order are walked as a prefix tree: ``stack`` has the
    partial overlaps at the nodes that the next set shares.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, name, df = np.unique(token, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    name = rank[name]
    order = np.lexsort((owner, name))
    where, begin = owner[order], np.searchsorted(name[order], np.arange(len(df) + 1))
    lonely = int((df == 1).sum())  # the first names: in one set only, never in an overlap
    ordered = np.split(name[np.lexsort((name, owner))], np.cumsum(size)[:-1])
    alone = np.array([np.searchsorted(x, lonely) for x in ordered])
    tail = [x[a:] for x, a in zip(ordered, alone)]  # shared shingles only
    walk = sorted(range(m), key=lambda i: tail[i].tolist())
    forest, links = Forest(m), np.zeros(m, np.int64)
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(m, np.int32))]
    before = np.zeros(0, np.int64)
    for step, i in enumerate(walk):
        x = tail[i]
        n = min(len(before), len(x))
        shared = int(np.argmin(np.r_[before[:n] == x[:n], False]))
        while stack[-1][0] > shared:
            stack.pop()
        following = tail[walk[step + 1]] if step + 1 < m else x[:0]
        n = min(len(following), len(x))
        node = int(np.argmin(np.r_[following[:n] == x[:n], False]))
        depth, overlap = stack[-1]
        need = _needed(size[i], size, percent)
        need[i] = size[i] + size.max() + 1  # not with itself
        at = depth
        # Read on in strides; a node that the next set shares is kept, and the branch ends when no bound can be reached.
        stops = sorted({*range(depth + max(8, len(x) // 6), len(x), max(8, len(x) // 6)), len(x), *([node] if node > depth else [])})
        for stop in stops:
            names = x[at:stop]
            spans = [where[begin[t]: begin[t + 1]] for t in names.tolist()]
            overlap = overlap + np.bincount(np.concatenate(spans), minlength=m).astype(np.int32) if spans else overlap
            at = stop
            if stop == node and node > stack[-1][0]:
                stack.append((node, overlap))
            if stop >= node and not np.any(overlap + (len(x) - stop) >= need):
                break
        else:
            hits = np.flatnonzero(overlap >= need)
            links[i] = len(hits)
            for j in hits.tolist():
                forest.join(i, j)
        before = x
    return forest, links


def _group_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid").sort_values("sid", ignore_index=True)
        forest, _ = tree_links([np.frombuffer(x, np.uint64) for x in pdf.shingles], percent)
        root = [forest.find(i) for i in range(len(pdf))]
        out = pd.DataFrame({"a": pdf.sid, "b": pdf.sid.to_numpy()[root]})
        return out[out.a != out.b]

    return run


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of a power of two of cells, set if a shingle falls into it; in half as many cells, the halves are laid over each other."""
    cells = max(64, 1 << math.ceil(math.log2(CELLS * max(1, len(s)))))
    bit = np.zeros(cells, np.uint8)
    bit[s & np.uint64(cells - 1)] = 1
    return np.packbits(bit, bitorder="little").tobytes()


def sketch_links(n: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """A label of each set, sizes ``n`` ascending: the same for sets that are linked, over any number of links, as far as sketches can tell."""
    label = np.arange(len(n))
    wide = np.array([len(x) // 8 for x in sketches])
    for w in np.unique(wide).tolist():
        first, last = np.searchsorted(wide, [w, w + 1])
        far = np.searchsorted(n, n[first:last] * 100 // percent, "right")  # a larger set is linked to none of these
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, w), axis=0) for x in sketches[first: far[-1]]])
        held = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for i in range(first, last):
            others = i + 1 + np.flatnonzero(label[i + 1: far[i - first]] != label[i])
            for at in range(0, len(others), max(1, HELD_WORDS // w)):
                j = others[at: at + max(1, HELD_WORDS // w)]
                both = np.bitwise_count(bits[j - first] & bits[i - first]).sum(axis=1, dtype=np.int64)
                most = both + np.minimum(n[i] - held[i - first], n[j] - held[j - first])
                hits = j[most >= _needed(n[i], n[j], percent)]
                if len(hits):
                    label[np.isin(label, label[hits])] = label[i]
    return label


def _sketches_of(width: int, percent: int):
    ends = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shingles_of(width)(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(batch.schema.get_field_index("shingles")).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            band = np.searchsorted(ends, n, "right") - 1
            below = np.flatnonzero((band > 0) & (np.ceil(n * percent / 100 - 1e-9) <= ends[band] - 1))  # may be linked to a set of the band below
            row = np.r_[np.arange(len(n)), below]
            marks = [sketch(x) for x in sets]
            yield pa.RecordBatch.from_pydict({
                "comp": batch.column(batch.schema.get_field_index("comp")).take(pa.array(row)), "sid": batch.column(batch.schema.get_field_index("sid")).take(pa.array(row)),
                "band": pa.array(np.r_[band, band[below] - 1].astype(np.int32)), "n": pa.array(n[row]), "sketch": pa.array([marks[i] for i in row], pa.binary())})

    return run


def _group_sketches(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid").sort_values(["n", "sid"], ignore_index=True)
        out = pd.DataFrame({"a": pdf.sid, "b": pdf.sid.to_numpy()[sketch_links(pdf.n.to_numpy(), pdf.sketch.tolist(), percent)]})
        return out[out.a != out.b]

    return run


def _blocks(together: DataFrame) -> DataFrame:
    return together.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))


def _block_pairs(sets: DataFrame) -> DataFrame:
    """``sets`` with i and j: a set goes to the pairs of its block with every block of its group; mostly there is one block and one pair."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "blocks")


def _shingles_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                s, at = shingle_sets(*utf8(batch.column(batch.schema.get_field_index("text")))[:2], width)
                sid = set_ids(s, at)
                wanted = batch.column(batch.schema.get_field_index("sid")).to_numpy()
                rows = np.flatnonzero(sid == wanted)  # another text with the hash of this one's text falls out here
                rows = rows[np.unique(sid[rows], return_index=True)[1]]
                yield pa.RecordBatch.from_pydict({
                    "comp": batch.column(batch.schema.get_field_index("comp")).take(pa.array(rows)), "sid": pa.array(sid[rows]), "blocks": batch.column(batch.schema.get_field_index("blocks")).take(pa.array(rows)),
                    "shingles": pa.array([s[at[i]: at[i + 1]].tobytes() for i in rows], pa.binary())})

    return run


def labelled_sets(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, content (hash of the text), n (shingles) and label (of the component; null without shingles) of every row; stored."""
    arrow_batches(documents.sparkSession)
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = docs.withColumn("content", F.xxhash64("text"))
    key_type = docs.schema["key"].dataType.simpleString()
    thin = durable(hashed.mapInArrow(_sets_of("key", "text", width), f"key {key_type}, content long, n long, sid long"))
    one = thin.filter("n > 0").groupBy("sid").agg(F.min(F.struct("content", "key")).alias("at"))

    def texts(components: DataFrame) -> DataFrame:
        """comp, sid, blocks and a text of every set; texts of other rows stay where they are."""
        wanted = components.join(one, "sid").select("sid", "comp", "blocks", F.col("at.content").alias("_content"), F.col("at.key").alias("_key"))
        wanted = durable(wanted.withColumn("_row", F.xxhash64("_key", "_content")))
        there = only(hashed.withColumn("_row", F.xxhash64("key", "content")), wanted.select("_row"), ["_row"]).drop("_row")
        return there.join(wanted, F.expr("content = _content and key <=> _key")).select("comp", "sid", "blocks", "text")

    together = durable(connected(candidate_edges(docs, "text", width, percent)).toDF("sid", "comp"))
    large = durable(_blocks(together).filter("blocks > 1"))
    if not large.isEmpty():
        sketches = stored(texts(together.join(large, "comp")).mapInArrow(_sketches_of(width, percent), "comp long, sid long, band int, n long, sketch binary"))
        blocks = sketches.groupBy("comp", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(SKETCHED)).cast("int").alias("blocks"))
        dealt = _block_pairs(sketches.join(F.broadcast(blocks), ["comp", "band"]))  # a group holds more than BLOCK sets in all, so there are few
        parts = connected(dealt.groupBy("comp", "band", "i", "j").applyInPandas(_group_sketches(percent), "a long, b long"))
        together = durable(together.join(large, "comp", "left_anti").select("sid", "comp").union(parts.toDF("sid", "comp")))
    sets = texts(together.join(_blocks(together), "comp")).mapInArrow(_shingles_of(width), "comp long, sid long, blocks int, shingles binary")
    links = _block_pairs(sets).groupBy("comp", "i", "j").applyInPandas(_group_links(percent), "a long, b long")
    roots = connected(links).toDF("sid", "root")
    placed = thin.join(roots, "sid", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("root", "sid")))
    return durable(placed.select("key", "content", "n", "label"))


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row."""
    placed = labelled_sets(documents, key, text, width, percent)
    names = placed.filter("label is not null").groupBy("label").agg(F.min("key").alias("component"))
    return (placed.join(names, "label", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id")))


def one_per_component(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are linked, over any number of links, to one with a smaller key.

    Of rows with the same key and text one stays; texts without words all stay. Only row hashes are joined with the texts.
    """
    placed = labelled_sets(documents, key, text, width, percent).withColumn("_row", F.xxhash64("key", "content"))
    grouped = placed.filter("label is not null")
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("content"), F.col("_row"))).alias("at")).select("at._row")
    bare = placed.filter("label is null").select("_row").distinct()
    often = durable(grouped.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row").join(first, "_row"))
    single = durable(first.join(often, "_row", "left_anti").union(bare))
    docs = documents.withColumn("_row", F.xxhash64(F.col(key), F.xxhash64(F.col(text))))
    return only(docs, single, ["_row"]).unionByName(only(docs, often, ["_row"]).dropDuplicates(["_row"])).select(*documents.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c USING (doc_id)
"""
