"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with equal sets are one class; its smallest id stands for
it. Every class has a minwise signature. Independent trees branch the classes: a node chooses one signature coordinate
by its path and sends each member to the child of its minwise token there. Nodes of one member are dropped, nodes of
``LEAF`` members at most are compared exhaustively, larger ones branch again up to ``DEPTH``. Two sets of similarity J
meet in a node of depth d with probability J**d in each tree, so T independent trees miss a link with probability
(1 - J**d)**T at most. ``Links.at`` takes as many as keep this below ``MISS_TREES`` at depth ``DEPTH``: for J = 0.85 these
are 19, which gives 2e-16, 3e-11, 1e-8 and 8e-7 for d = 1 to 4. The trees share one signature, so they are independent in
part only: their roots have coordinates of their own, deeper nodes may choose those of another tree.

Comparisons run in rounds, so that a large group of copies costs no more than its size:

1. Every member of a node is paired with the node's pivot. The best pair of each class by signature is confirmed on the
   full sets, and components are found from these links.
2. Nodes whose members are all in one component need no more work. In the others, each member is paired with the member of
   another component whose signature agrees most. Again the best pair of each class is confirmed, and components are
   found anew.
3. In nodes that still hold several components, members of different components whose signatures agree enough are
   compared on the full sets, inside the task that holds the node.

Nodes that are large at the last depth are worked off in blocks of ``BLOCK`` members, packed into one row each: members
outside the node's main component against everything, block by block, never in one task. So n members make n / BLOCK
rows for each block of members outside the main component.

A signature agreement below ``Links.agree`` of ``WIDTH`` coordinates rejects a pair unseen; for a linked pair this happens
with a probability of ``MISS_SIGNATURE`` at most (2e-6 at 0.85). Confirmation is exact, on the shingles of both whole texts.

Results for odd input: a null text, or one without words, has an empty set and no links; a text of fewer words than a
shingle is one shingle; a null id has no component; repeated rows of an id are one document.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.llm.common import Scratch, dealt, map_arrow

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union, unless other ``Links`` are given.
PERCENT = 85
WIDTH, DEPTH, LEAF = 64, 4, 64
#: Members in one block of a node that stays large.
BLOCK = 1024
#: Shingles of the texts that are compared in one task; more are compared part by part.
TEXT_SHINGLES = 500_000
#: A row with texts, and one with a signature, count as so many rows of ids.
TEXT_ROWS, SKETCH_ROWS = 100, 5
#: The largest classes of equal sets that are broadcast; each of the others has at most a share of 1 / HOT_CLASSES of all rows.
HOT_CLASSES = 1000
#: Limits of the chance that a linked pair meets in no tree, and that its signature rejects it.
MISS_TREES, MISS_SIGNATURE = 1e-6, 5e-6
#: Ids may be broadcast up to this number (8 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Links:
    """Links have 100 * intersection >= percent * union; ``trees`` and ``agree`` are wide enough for pairs at that limit."""

    percent: int
    trees: int
    agree: int

    @staticmethod
    def at(percent: int) -> "Links":
        """The fewest trees and the strictest filter that miss a pair at the limit with ``MISS_TREES`` and ``MISS_SIGNATURE`` at most."""
        j = percent / 100
        trees = math.ceil(math.log(MISS_TREES) / math.log(1 - j**DEPTH))
        below, agree = 0.0, 0
        while (below := below + math.comb(WIDTH, agree) * j**agree * (1 - j) ** (WIDTH - agree)) <= MISS_SIGNATURE:
            agree += 1
        return Links(percent, trees, agree)


LINKS = Links.at(PERCENT)


_rng = np.random.default_rng(7)
_ODD = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty for _ in texts]
    lengths = stops - starts
    chars = np.flatnonzero(inside[1:-1])
    place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = _mix((data[chars].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    words = np.add.reduceat(letters, np.cumsum(lengths) - lengths)
    cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = len(words) - SHINGLE + 1
    runs = sum(words[i : i + n] * _PLACE[i] for i in range(SHINGLE)) if n > 0 else empty
    runs = _mix(runs)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            short = words[a:b] * _PLACE[: b - a]
            out.append(_mix(short.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def signature_columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minwise signatures (sets x WIDTH, 32 bits each) of non-empty sets, and two 64-bit digests of each set."""
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    every = np.concatenate(sets)
    out = np.zeros((len(sets), WIDTH), np.uint32)
    for c in range(WIDTH):
        out[:, c] = np.minimum.reduceat((every * _ODD[c] + _ADD[c]) >> np.uint64(32), first)
    return out, np.add.reduceat(_mix(every + np.uint64(1)), first), np.bitwise_xor.reduceat(_mix(every * np.uint64(3)), first)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): size, digests and signature of each row's set; sig is null for an empty set."""

    def build():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, d1, d2 = [None] * len(sets), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            if full:
                signatures, a, b = signature_columns([sets[i] for i in full])
                d1[full], d2[full] = a.view(np.int64), b.view(np.int64)
                for i, row in zip(full, signatures.view(np.int32)):
                    sig[i] = row.tobytes()
            return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

        return apply

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "doc_id long, n_shingles long, d1 long, d2 long, sig binary", rows=400)


def _coordinate(sig: Column, at: Column) -> Column:
    return F.substr(sig, at * 4 + 1, F.lit(4))


def _step(path: Column, sig: Column) -> Column:
    """The child's path: the node's path chooses a coordinate, whose minwise token is the branch."""
    return F.xxhash64(path, _coordinate(sig, F.pmod(F.xxhash64(path, F.lit("choose")), F.lit(WIDTH)).cast("int")))


def build_nodes(classes: DataFrame, links: Links, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Branch (rep, sig) in all trees.

    Returns pairs (rep, pivot), distinct, of every node's members with its pivot, and members (path, rep, n) of the
    nodes at which branching ends. n is the node's size. The pivot is the member of least (rep xor path).
    """
    level = classes.select("rep", F.explode(F.array([F.lit(t) for t in range(links.trees)])).alias("tree"), "sig").select("rep", F.xxhash64(F.lit("tree"), "tree", _coordinate(F.col("sig"), F.pmod("tree", F.lit(WIDTH)))).alias("path"))
    most = classes.count() * links.trees
    pairs, ended = [], []
    for depth in range(1, DEPTH + 1):
        mixed = F.col("rep").bitwiseXOR(F.col("path"))
        nodes = level.groupBy("path").agg(F.count("*").alias("n"), F.min(mixed).alias("m")).where("n > 1").select("path", "n", F.col("m").bitwiseXOR(F.col("path")).alias("pivot"))
        # written before it is joined, so that the join stands alone in its stage and a hot node's members can be split
        members = scratch.keep(level.join(scratch.keep(nodes, most), "path"), most)
        pairs.append(members.where("rep <> pivot").select("rep", "pivot"))
        last = depth == DEPTH
        ended.append((members if last else members.where(F.col("n") <= LEAF)).select("path", "rep", "n"))
        large = members.where(F.col("n") > LEAF).select("path", "rep")
        most = 0 if last else large.count()
        if not most:
            break
        level = large.join(classes, "rep").select("rep", _step(F.col("path"), F.col("sig")).alias("path"))
    return functools.reduce(DataFrame.unionByName, pairs).distinct(), functools.reduce(DataFrame.unionByName, ended)


def _agreements(a: Column, b: Column) -> Column:
    """Estimated links: coordinates in which two signatures agree."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(WIDTH - 1)), F.lit(0), lambda acc, i: acc + (_coordinate(a, i) == _coordinate(b, i)).cast("int"))


def best_pairs(pairs: DataFrame, classes: DataFrame, links: Links) -> DataFrame:
    """Of each class, the pair (a, b) with the pivot whose signature agrees most."""
    own = classes.select("rep", F.col("sig").alias("s1"), F.col("n_shingles").alias("n1"))
    other = classes.select(F.col("rep").alias("pivot"), F.col("sig").alias("s2"), F.col("n_shingles").alias("n2"))
    most = classes.count()
    both = dealt(dealt(pairs, most * links.trees).join(own, "rep").join(other, "pivot"), most * links.trees).where(_sizes_fit(F.col("n1"), F.col("n2"), links)).select("rep", "pivot", _agreements(F.col("s1"), F.col("s2")).alias("agree")).where(F.col("agree") >= links.agree)
    return dealt(both.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("pivot")).alias("p"))).alias("x")), most).select(F.col("rep").alias("a"), (-F.col("x.p")).alias("b"))


def _sizes_fit(n1: Column, n2: Column, links: Links) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * links.percent


def _texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of some documents; ids that are counted to be few (``most``) are broadcast, others joined by a shuffle."""
    few = most <= MAX_BROADCAST_IDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def confirm(pairs: DataFrame, docs: DataFrame, links: Links, scratch: Scratch, most: int) -> DataFrame:
    """The pairs (a, b), ``most`` at most, whose documents are linked, found on the shingles of their whole texts."""
    pairs = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most)
    most = pairs.count()
    ids = dealt(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * most)
    texts = _texts(docs, ids, 2 * most)
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def build():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ones, others = shingle_sets(batch.column(2).to_pylist()), shingle_sets(batch.column(3).to_pylist())
            keep = []
            for x, y in zip(ones, others):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                keep.append(common > 0 and 100 * common >= links.percent * (len(x) + len(y) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return apply

    return scratch.keep(map_arrow(dealt(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), most * TEXT_ROWS), build, "a long, b long", rows=200))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, comp) of every node of the links (a, b): comp is the smallest id reachable.

    Large-star and small-star steps alternate until every child has one parent, which is no child itself; each is one
    aggregation and one join over the links.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), links.count())

    def star(edges: DataFrame, large: bool, most: int) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
        joined = dealt(both.join(least, "a"), most)
        if large:
            joined = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            joined = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        return dealt(joined.where("a <> b").distinct(), most)

    while True:
        most = 2 * edges.count()
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("child")))
        roles = dealt(ends.groupBy("x").agg(F.sum("child").alias("parents"), F.min("child").alias("leaf")), most)
        if not most or roles.where("parents > 1 or (parents = 1 and leaf = 0)").isEmpty():
            break
        edges = scratch.keep(star(star(edges, True, most), False, most), most)
    roots = edges.select(F.col("b").alias("rep"), F.col("b").alias("comp"))
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("comp")).unionByName(roots).distinct()


def merged(comps: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` after further links (a, b): components of the components that these join. A node that is in no component yet is its own."""
    of = lambda end: comps.select(F.col("rep").alias(end), F.col("comp").alias("c" + end))
    most = more.count()
    lifted = dealt(more.join(of("a"), "a", "left").join(of("b"), "b", "left"), most).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = scratch.keep(components(lifted.where("a <> b"), scratch), 2 * most)
    every = comps.unionByName(new.select("rep", F.col("rep").alias("comp"))).distinct()
    return every.join(new.select(F.col("rep").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))


def _mixed(members: DataFrame, classes: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, rep, n, comp) of the members of nodes that hold several components."""
    info = classes.join(comps, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))
    most = members.count()
    tagged = scratch.keep(members.join(info, "rep"), most)
    nodes = tagged.groupBy("path").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("path")
    return scratch.keep(tagged.join(scratch.keep(nodes, most), "path"), most)


def _meetings(tagged: DataFrame, sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, block, rows): what is compared in one task. A row of ``rows`` has rep, comp, outer and the columns of ``sketch``.

    A node of up to ``BLOCK`` members is one block. Of a larger one, the main component's members are dealt to blocks; so are the others (outer).
    Each block of the main component meets each block of the others, and these meet each other; all pairs of different components lie in some block.
    """
    row = F.struct(F.col("rep"), F.col("comp"), F.col("outer"), *(F.col(c) for c in sketch.columns if c != "rep"))
    small = dealt(tagged.where(F.col("n") <= BLOCK).withColumn("outer", F.lit(True)).join(sketch, "rep"), tagged.count() * SKETCH_ROWS)
    small = dealt(small.groupBy("path").agg(F.collect_list(row).alias("rows")), tagged.count() * SKETCH_ROWS).select("path", F.lit("").alias("block"), "rows")
    large = tagged.where(F.col("n") > BLOCK)
    most = large.count()
    if not most:
        return small
    sizes = large.groupBy("path", "comp").agg(F.count("*").alias("c"))
    nodes = sizes.groupBy("path").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("all"))
    nodes = scratch.keep(nodes.select("path", F.col("x.comp").alias("main"), F.ceil(F.col("x.c") / BLOCK).cast("int").alias("mains"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("x.c")) / BLOCK)).cast("int").alias("outers")), most // BLOCK)
    # such a node has more than BLOCK rows, so there are few; their number is checked all the same
    nodes = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_IDS // 4 else nodes
    placed = large.join(nodes, "path").withColumn("outer", F.col("comp") != F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("mains"))).cast("int"))
    packs = placed.join(sketch, "rep").groupBy("path", "outer", "own", "mains", "outers").agg(F.collect_list(row).alias("pack"))
    name = lambda kind, i, j: F.concat(F.lit(kind), i.cast("string"), F.lit("-"), j.cast("string"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda j: name("m", F.col("own"), j))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: name("m", i, F.col("own")))
    with_outer = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda j: name("o", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    meeting = packs.select("path", "pack", F.explode(F.when(F.col("outer"), F.concat(with_main, with_outer)).otherwise(of_main)).alias("block"))
    return small.unionByName(meeting.groupBy("path", "block").agg(F.flatten(F.collect_list("pack")).alias("rows")))


class _Node:
    """The members of a block, as columns, and who of them may be linked to whom."""

    def __init__(self, block: str, rows: list[dict], links: Links):
        self.block, self.links, self.rows = block, links, rows
        self.rep, self.comp, self.n = (np.array([r[k] for r in rows], np.int64) for k in ("rep", "comp", "n_shingles"))
        self.outer = np.array([r["outer"] for r in rows])
        self.sig = np.frombuffer(b"".join([r["sig"] for r in rows]), np.uint32).reshape(len(rows), WIDTH)

    def partners(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each outer member: members of other components whose size and signature allow a link, and in how many coordinates they agree."""
        for i in np.flatnonzero(self.outer).tolist():
            fit = (self.comp != self.comp[i]) & (np.minimum(self.n, self.n[i]) * 100 >= np.maximum(self.n, self.n[i]) * self.links.percent)
            if self.block.startswith("m"):
                fit &= ~self.outer
            at = np.flatnonzero(fit)
            agree = (self.sig[at] == self.sig[i]).sum(axis=1)
            enough = agree >= self.links.agree
            if enough.any():
                yield i, at[enough], agree[enough]


def _best_partners(batch: pa.RecordBatch, links: Links) -> pa.RecordBatch:
    """Of each member with a possible partner, the one whose signature agrees most: (a, b, agree)."""
    out: list[tuple[int, int, int]] = []
    for block, rows in zip(*(c.to_pylist() for c in batch.columns)):
        node = _Node(block, rows, links)
        best: dict[int, tuple[int, int]] = {}
        for i, others, agree in node.partners():
            # the others of a main block are looked at from here only
            for member, partner, value in [(i, int(others[agree.argmax()]), int(agree.max()))] + [(j, i, v) for j, v in zip(others.tolist(), agree.tolist()) if not node.outer[j]]:
                if value > best.get(member, (0, 0))[0]:
                    best[member] = (value, partner)
        out.extend((int(node.rep[i]), int(node.rep[j]), value) for i, (value, j) in best.items())
    a, b, agree = zip(*out) if out else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], ["a", "b", "agree"])


def partner_links(members: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, links: Links, scratch: Scratch) -> DataFrame:
    """Links (a, b) of classes with the member of another component that agrees most; one pair of each class is tried."""
    meeting = _meetings(_mixed(members, classes, comps, scratch), classes.select("rep", "n_shingles", "sig"), scratch)
    found = map_arrow(meeting.select("block", "rows"), lambda: lambda batch: _best_partners(batch, links), "a long, b long, agree int", rows=64)
    best = found.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    return confirm(best, docs, links, scratch, classes.count())


def _possible(batch: pa.RecordBatch, links: Links) -> pa.RecordBatch:
    """Members of nodes that have a possible partner: (path, block, rep, comp). A pair that meets in several nodes counts in the one of the smallest path only."""
    out: list[tuple[int, str, int, int, int]] = []
    for path, block, rows in zip(*(c.to_pylist() for c in batch.columns)):
        node = _Node(block, rows, links)
        paths = [frozenset(r["paths"]) for r in rows]
        found = np.zeros(len(rows), bool)
        for i, others, _ in node.partners():
            for j in others.tolist():
                if not (found[i] and found[j]) and min(paths[i] & paths[j]) == path:
                    found[i] = found[j] = True
        out.extend((path, block, int(node.rep[i]), int(node.comp[i]), int(node.n[i])) for i in np.flatnonzero(found))
    path, block, rep, comp, n = zip(*out) if out else ((), (), (), (), ())
    return pa.record_batch([pa.array(path, pa.int64()), pa.array(block, pa.string()), *(pa.array(x, pa.int64()) for x in (rep, comp, n))], ["path", "block", "rep", "comp", "n"])


def rest_links(members: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, links: Links, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components that meet in a node; as many as are needed to connect what is linked.

    First the signatures of a node tell which members have a possible partner in another component. Then the texts of these members come together and are
    compared on their full sets. Pairs stay inside a task.
    """
    tagged = _mixed(members, classes, comps, scratch)
    sketch = classes.select("rep", "n_shingles", "sig").join(tagged.groupBy("rep").agg(F.collect_set("path").alias("paths")), "rep")
    meeting = _meetings(tagged, sketch, scratch)
    possible = scratch.keep(map_arrow(meeting.select("path", "block", "rows"), lambda: lambda batch: _possible(batch, links), "path long, block string, rep long, comp long, n long", rows=64))
    # blocks of many or long texts in parts, each of which meets each
    weights = possible.groupBy("path", "block").agg(F.ceil(F.sum("n") / TEXT_SHINGLES).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep", F.lit("part")), "parts").cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    parted = possible.join(weights, ["path", "block"]).select("path", "block", "rep", "comp", F.explode(meets).alias("part"))
    most = possible.count()
    ids = dealt(possible.select(F.col("rep").alias("doc_id")).distinct(), most)
    texts = _texts(docs, ids, most).select(F.col("doc_id").alias("rep"), "text")
    together = parted.join(texts, "rep").groupBy("path", "block", "part").agg(F.collect_list(F.struct("rep", "comp", "text")).alias("rows"))
    return scratch.keep(map_arrow(dealt(together.select("rows"), most * TEXT_ROWS), lambda: lambda batch: _compare(batch, links), "a long, b long", rows=8))


def _compare(batch: pa.RecordBatch, links: Links) -> pa.RecordBatch:
    """All members of a node against each other, on their full sets: a spanning forest of the links between components."""
    a, b = [], []
    for rows in batch.column(0).to_pylist():
        sets = shingle_sets([r["text"] for r in rows])
        comp = [r["comp"] for r in rows]
        root = {c: c for c in comp}

        def find(c: int, root=root) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sizes = np.array([len(x) for x in sets])
        first = np.cumsum(sizes) - sizes
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(int(place.max()) + 1, np.int64)
        for i in range(len(rows) - 1):
            own = place[first[i] : first[i] + sizes[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[place], first)[i + 1 :]
            mark[own] = 0
            for j in (np.flatnonzero(100 * common >= links.percent * (sizes[i] + sizes[i + 1 :] - common)) + i + 1).tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(rows[i]["rep"])
                    b.append(rows[j]["rep"])
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def find_components(docs: DataFrame, links: Links = LINKS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.keep(sketches(docs))
    full = sketched.where("sig is not null and doc_id is not null")
    grouped = full.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("x"), F.count("*").alias("size"))
    classes = scratch.keep(grouped.select("d1", "d2", "n_shingles", "size", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig")), sketched.count() * SKETCH_ROWS)
    pairs, members = build_nodes(classes.select("rep", "sig"), links, scratch)
    most = classes.count()
    comps = scratch.keep(components(confirm(best_pairs(pairs, classes, links), docs, links, scratch, most), scratch), most)
    for further in (partner_links, rest_links):
        more = further(members, classes, comps, docs, links, scratch)
        if more.count():
            comps = scratch.keep(merged(comps, more, scratch), most)
    out = _labelled(sketched, classes.join(comps, "rep", "left").select("d1", "d2", "n_shingles", "size", "rep", F.coalesce("comp", "rep").alias("comp")))
    # the result alone stays
    result = out.checkpoint()
    scratch.clear()
    return result


def _labelled(sketched: DataFrame, found: DataFrame) -> DataFrame:
    """The component of every row. Rows without a class are their own; so are classes of one document in no link, which need no join.

    The largest classes are broadcast, ``HOT_CLASSES`` at most, so that no key of the other join has many rows.
    """
    key = ["d1", "d2", "n_shingles"]
    named = found.where("size > 1 or comp <> rep")
    hot = named.orderBy(F.col("size").desc(), *key).limit(HOT_CLASSES).select(*key, F.col("comp").alias("hot"))
    rows = sketched.select("doc_id", *key, F.col("sig").isNull().alias("bare")).join(F.broadcast(hot), key, "left")
    cold = named.join(F.broadcast(hot.select(*key)), key, "left_anti").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("n_shingles").alias("k3"), F.col("comp").alias("cold"))
    # rows that need no other class go anywhere, where they meet nothing
    apart = F.col("bare") | F.col("hot").isNotNull()
    rows = rows.withColumn("k1", F.when(apart, F.xxhash64("doc_id", F.spark_partition_id())).otherwise(F.col("d1"))).withColumn("k2", F.col("d2")).withColumn("k3", F.when(apart, F.lit(-1).cast("long")).otherwise(F.col("n_shingles")))
    out = rows.join(cold, ["k1", "k2", "k3"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("hot", "cold", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, links: Links = LINKS) -> DataFrame:
    """The rows of ``docs`` that stand for their component (and those without an id), as they are."""
    gone = find_components(docs, links).where("not kept").select(F.col("doc_id").alias("__near_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__near_gone"], "left_anti")
