"""Near-duplicate documents by a chosen-path set-similarity join.

A document's set holds its distinct word shingles as 64-bit hashes.  Documents with equal sets form one class; only
classes are compared.  Each class has ``COORDS`` minwise values.  A tree is walked from its root: at a node, one or two
coordinates are drawn from the node's own path (1 / threshold of them on average, so that a pair at the threshold keeps
about one common child), and a class goes to the child named by its minwise value there.  Dissimilar classes part
quickly.  ``TREES`` independent trees bring the chance of missing a pair at the threshold below 1 in 1,000.

Nodes are worked on in this order:

1. every class of a node is compared with the node's pivot (its least class), and links are confirmed on full sets;
2. nodes whose classes are now in one component are finished;
3. small nodes (``LEAF`` classes at most) compare the classes of different components exhaustively, minwise values first,
   then full sets, in pairs of chunks that hold at most about ``CHUNK`` classes and ``CHUNK_SHINGLES`` shingles;
4. the classes of larger nodes meet again by an exact prefix filter, whatever node they came from: shingles are ordered
   by the number of these classes that hold them, rarest first, and two sets that reach the threshold share one of the
   first n - ceil(threshold * n) + 1 shingles of each.  Classes that share such a shingle are compared as in 3.  Branching
   on from a large node instead would lose pairs, as the chance of a common path falls with every level.

So work grows with the square of a group only for at most ``LEAF`` classes of a node, and for classes that share even
one of their rarest shingles without being in one component.  A class is named by 128 bits of its set's hash; shingles
are 64-bit hashes, whose few collisions move a similarity by one part in the set's size.

Defined cases: null or wordless texts have an empty set, link with nothing and are kept; texts with fewer words than a
shingle count as one shingle; repeated rows share a class; rows with the same id but other texts are compared like any
others; ids may be of any type; a null id never is the least id of a group that has another; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, written
from .components import components

COORDS, TREES, DEPTH, LEAF, CHUNK, CHUNK_SHINGLES = 128, 10, 4, 4096, 1024, 4_000_000
#: Rows of a group from which its pairs are looked at as a matrix; pairs looked at together in smaller groups.
WIDE, PAIRS = 64, 100_000
#: Bits of the map that picks the rows whose sets are needed: a fixed size; more rows than bits only weaken the filter.
MAP_BITS = 26
WORD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
U = np.uint64
_r = np.random.default_rng(20240229)
MULT, ADD = (_r.integers(0, 2**32, COORDS, dtype=np.uint32) | np.uint32(1)), _r.integers(0, 2**32, COORDS, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit permutation whose output bits all depend on all input bits."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    ws = (text or "").encode().translate(WORD_TABLE).split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minwise(s: np.ndarray) -> np.ndarray:
    x = (s >> U(32)).astype(np.uint32)
    out = np.full(COORDS, 2**32 - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(out, (x[i : i + 2048, None] * MULT + ADD).min(0), out=out)
    return out


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def slots(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bits of the map for (hash of the set, hash of the id)."""
    return (mix(h.astype(np.int64).view(np.uint64) ^ mix(row.astype(np.int64).view(np.uint64))) >> U(64 - MAP_BITS)).astype(np.int64)


def descend(path: np.ndarray, row: np.ndarray, sig: np.ndarray, threshold: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (path, row) after some levels; draws depend on the path alone."""
    second = U(int((1 / threshold - 1) * 2**32))
    with np.errstate(over="ignore"):
        for _ in range(levels):
            draw = mix(path + U(0x632BE59BD9B4E019))
            one = (draw >> U(40)) % U(COORDS)
            two = (one + U(1) + (draw >> U(20)) % U(COORDS - 1)) % U(COORDS)
            more = (mix(draw) & U(0xFFFFFFFF)) < second
            coord = np.concatenate([one, two[more]])
            path, row = np.concatenate([path, path[more]]), np.concatenate([row, row[more]])
            path = mix(path ^ mix((coord << U(32)) + sig[row, coord.astype(np.int64)]))
    return path, row


def classes_of(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(key, n, h, g, sig) of each row; h, g (the class) and sig are null for an empty set."""

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                s = shingles(t, k)
                rows.append((len(s), *class_of(s), minwise(s).tobytes()) if len(s) else (0, None, None, None))
            n, h, g, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            # Nullable integers: a column of floats would round the hashes.
            yield pd.DataFrame({"key": pdf["key"].values, "n": n, "h": pd.array(h, dtype="Int64"), "g": pd.array(g, dtype="Int64"), "sig": sig})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, n long, h long, g long, sig binary")


def sets_of(docs: DataFrame, k: int, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(c, s): the sets of the classes in ``wanted`` (c, h, g, rep), read from their representatives only."""
    wanted = written(wanted.select("c", "h", "g", F.xxhash64("rep").alias("row")))

    def bits(batches):
        for pdf in batches:
            b = slots(pdf["h"].to_numpy(), pdf["row"].to_numpy())
            yield pd.DataFrame({"w": b >> 6, "m": np.left_shift(np.int64(1), b & 63)})

    parts = wanted.select("h", "row").mapInPandas(bits, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    chosen = np.zeros(2 ** (MAP_BITS - 6), dtype=np.int64)
    chosen[parts["w"].to_numpy(dtype=np.int64)] = parts["m"].to_numpy(dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for pdf in batches:
            rows = []
            for row, t in zip(pdf["row"], pdf["text"]):
                s = shingles(t, k)
                if len(s):
                    h, g = class_of(s)
                    b = int(slots(np.array([h]), np.array([row]))[0])
                    if (int(sent.value[b >> 6]) >> (b & 63)) & 1:
                        rows.append((h, g, s.tobytes()))
            yield pd.DataFrame(rows, columns=["h", "g", "s"])

    found = docs.select(F.xxhash64(key).alias("row"), F.col(text).alias("text")).mapInPandas(run, "h long, g long, s binary")
    return written(found.dropDuplicates(["h", "g"]).join(wanted, ["h", "g"]).select("c", "s"))


def front_of(nodes: DataFrame) -> DataFrame:
    """(node, c, size, n, mass, pivot) of the nodes (node, c, size) with at least two classes; mass: shingles of all."""
    nodes = written(nodes)
    stats = written(nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("c").alias("pivot")).where("n > 1"))
    return written(nodes.join(stats, "node"))


def chunks() -> F.Column:
    """Chunks of a node."""
    return F.ceil(F.greatest(F.col("n") / CHUNK, F.col("mass") / CHUNK_SHINGLES))


def pivot_links(front: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between a node's pivot and its other classes, confirmed on full sets.

    The pivot's set goes once to each chunk of its partners, which then pass by one at a time.
    """
    percent = round(threshold * 10_000)
    pairs = written(front.where("c != pivot").select("pivot", "c", "size").distinct())
    many = written(pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("size").alias("mass")).withColumn("k", chunks()).select("pivot", "k"))
    partners = pairs.join(many, "pivot").select("pivot", F.pmod(F.xxhash64("c"), "k").alias("i"), F.lit(1).alias("late"), "c")
    pivots = many.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"), F.lit(0).alias("late"), F.col("pivot").alias("c"))
    dealt = partners.unionByName(pivots).join(sets, "c").select("pivot", "i", "late", "c", "s")

    def run(batches):
        of, one = None, None
        for pdf in batches:
            found = []
            for p, i, late, c, s in zip(*(pdf[x] for x in ("pivot", "i", "late", "c", "s")), strict=True):
                s = np.frombuffer(s, dtype=np.uint64)
                if not late:
                    of, one = (p, i), s
                elif of == (p, i) and reaches(one, s, percent):
                    found.append((p, c))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return written(dealt.repartition("pivot", "i").sortWithinPartitions("pivot", "i", "late").mapInPandas(run, "a long, b long"))


def labelled(front: DataFrame, links: DataFrame) -> DataFrame:
    """``front`` with each class's component so far, without the nodes that lie in one component."""
    of = written(components(links).select(F.col("id").alias("c"), F.col("component_id").alias("label")))
    rows = written(front.join(of, "c", "left").withColumn("label", F.coalesce("label", "c")))
    mixed = written(rows.groupBy("node").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select("node"))
    return written(rows.join(mixed, "node"))


def by_node(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on whole groups (node, i, j), many at a time; a group has two chunks at most, so it fits in a task."""

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf[["node", "i", "j"]].to_numpy()
            last = int(np.flatnonzero((ids == ids[-1]).all(1))[0])  # the last group may go on
            if last:
                yield work(pdf.iloc[:last])
            rest = pdf.iloc[last:]
        if rest is not None and len(rest):
            yield work(rest)

    keys = [F.col(c) for c in ("node", "i", "j")]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def agreeing(low: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that agree on six of the first sixteen values (by their last bytes), and on ``least`` of all."""
    some = np.count_nonzero(low[i] == low[j], axis=1) >= 6
    i, j = i[some], j[some]
    ok = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 10_000):
        ok[lo : lo + 10_000] = np.count_nonzero(sig[i[lo : lo + 10_000]] == sig[j[lo : lo + 10_000]], axis=1) >= least
    return i[ok], j[ok]


def likely(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the groups (node, i, j), of different components, whose minwise values agree as often as a linked pair's can.

    A linked pair agrees on ``threshold`` of the coordinates on average; 4 standard deviations below that are allowed.
    Before that, six of the first sixteen values must agree: a pair at the threshold misses that about once in 100,000
    (0.8) or less.
    """
    least = COORDS * threshold - 4 * (COORDS * threshold * (1 - threshold)) ** 0.5
    ids = rows[["node", "i", "j"]].to_numpy()
    label, chunk, cross = rows["label"].to_numpy(), rows["chunk"].to_numpy(), ids[:, 1] != ids[:, 2]
    sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(len(rows), COORDS)
    low = np.ascontiguousarray(sig[:, :16].astype(np.uint8))
    edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]])
    sizes, out = np.diff(edges), []
    # Small groups: the pairs of each row with the rows behind it in its group, many groups at once.
    behind = np.repeat(edges[1:], sizes) - np.arange(len(ids)) - 1
    behind[np.repeat(sizes > WIDE, sizes)] = 0
    total, lo = np.cumsum(behind), 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        k = behind[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        may = (label[i] != label[j]) & (~cross[i] | (chunk[i] != chunk[j]))
        out.append(agreeing(low, sig, i[may], j[may], least))
        lo = hi
    for lo, hi in zip(edges[:-1][sizes > WIDE], edges[1:][sizes > WIDE], strict=True):
        may = np.triu(label[lo:hi, None] != label[None, lo:hi], 1)
        if cross[lo]:
            may &= chunk[lo:hi, None] != chunk[None, lo:hi]
        agree = np.zeros(may.shape, dtype=np.uint8)
        for x in np.ascontiguousarray(low[lo:hi].T):
            agree += x[:, None] == x[None, :]
        i, j = np.nonzero(may & (agree >= 6))
        out.append(agreeing(low, sig, i + lo, j + lo, least))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, in hundredths of a percent."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 10_000 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 10_000 * both >= percent * (len(x) + len(y) - both)


def confirmed(s: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the threshold, from products of 0/1 matrices over the shingles that several sets share."""
    sizes = np.array([len(x) for x in s])
    terms, at, df = np.unique(np.concatenate(s), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(s)), sizes)
    shared = np.flatnonzero(df > 1)
    place = np.full(len(terms), -1)
    place[shared] = np.arange(len(shared))
    both = np.zeros((len(s), len(s)), dtype=np.float32)
    for lo in range(0, len(shared), 4096):
        m = (place[at] >= lo) & (place[at] < lo + 4096)
        grid = np.zeros((len(s), 4096), dtype=np.float32)
        grid[of[m], place[at[m]] - lo] = 1
        both += grid @ grid.T
    both = both[i, j].astype(np.int64)
    return 10_000 * both >= percent * (sizes[i] + sizes[j] - both)


def prefix_front(front: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The classes of ``front`` that share a shingle (node) of their prefixes, as from ``front_of``; no linked pair is missed."""
    percent = round(threshold * 10_000)

    def spread(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 100):
                s = [np.frombuffer(b, dtype=np.int64) for b in pdf["s"].iloc[lo : lo + 100]]
                size = [len(x) for x in s]
                yield pd.DataFrame({"c": np.repeat(pdf["c"].to_numpy()[lo : lo + 100], size), "size": np.repeat(size, size), "node": np.concatenate(s)})

    each = written(front.select("c").distinct().join(sets, "c")).mapInPandas(spread, "c long, size long, node long")
    # Shingles of one class alone come first in its order and meet nothing.
    df = written(each.groupBy("node").agg(F.count("*").alias("df")).where("df > 1"))
    shared, of = written(each.join(df, "node")), W.partitionBy("c")
    first = F.col("size") - F.ceil(F.col("size") * percent / 10_000) + 1 - (F.col("size") - F.count("*").over(of))
    met = shared.withColumn("first", first).withColumn("place", F.row_number().over(of.orderBy("df", "node"))).where("place <= first")
    return front_of(met.select("node", "c", "size"))


def grouped(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row a name of its group, the rows that pairs (i, j) join; alike for the same classes ``c``, whatever their order."""
    root = np.arange(len(c))
    while len(i):
        low, old = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            break
    name = np.zeros(len(c), dtype=np.uint64)
    np.add.at(name, root, mix(c.astype(np.int64).view(np.uint64)))
    return mix(name)[root].view(np.int64)


def active(front: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, i, j, chunk, c, size, label): the classes of ``front`` that have a likely partner in their node, by minwise values alone.

    A node of several chunks is dealt out as pairs of chunks, so no task holds a large node.  What is left of a node falls into
    groups without a likely pair between them, each named by its classes: the groups that several trees find alike are one.
    """
    rows = front.withColumn("k", chunks()).withColumn("chunk", F.pmod(F.xxhash64("c"), "k"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("node", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "c", "size", "label")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = likely(pdf, threshold)
        out = pdf.assign(name=grouped(pdf["c"].to_numpy(), i, j)).iloc[np.unique(np.concatenate([i, j]))].drop(columns="sig")
        # Pairs of two chunks stay as they are, so that pairs inside a chunk aren't looked at again.
        whole = (out["i"] == out["j"]).to_numpy()
        out["node"] = np.where(whole, out["name"], out["node"])
        out.loc[whole, ["i", "j", "chunk"]] = 0
        return out.drop(columns="name")

    full = dealt.join(classes.select("c", "sig"), "c").select("node", "i", "j", "chunk", "c", "size", "label", "sig")
    return written(by_node(full, pick, "node long, i long, j long, chunk long, c long, size long, label long").distinct())


def leaf_links(front: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components in the nodes of ``front``, confirmed on full sets.

    Only classes with a likely partner bring their sets; pairs that earlier links have joined needn't be compared.
    """
    percent = round(threshold * 10_000)

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        c, root = pdf["c"].to_numpy(), {x: x for x in pdf["label"]}
        label, raw, found = pdf["label"].to_numpy(), pdf["s"].to_numpy(), []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first, second = likely(pdf, threshold)
        by = np.argsort(first, kind="stable")
        first, second = first[by], second[by]
        ids = pdf[["node", "i", "j"]].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]])
        cuts = np.searchsorted(first, edges)
        for n in np.flatnonzero(np.diff(cuts)):
            i, j = first[cuts[n] : cuts[n + 1]], second[cuts[n] : cuts[n + 1]]
            s = {x: np.frombuffer(raw[x], dtype=np.uint64) for x in np.unique(np.concatenate([i, j])).tolist()}
            many = len(i) > 2000
            if many:
                place = {x: k for k, x in enumerate(s)}
                at = lambda x: np.array([place[y] for y in x.tolist()])  # noqa: B023, E731
                ok = confirmed(list(s.values()), at(i), at(j), percent)
                i, j = i[ok], j[ok]
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(label[a]), find(label[b])
                if p != q and (many or reaches(s[a], s[b], percent)):
                    root[p] = q
                    found.append((min(c[a], c[b]), max(c[a], c[b])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    near = active(front, classes, threshold).join(classes.select("c", "sig"), "c")
    full = near.join(sets, "c").select("node", "i", "j", "chunk", "c", "label", "sig", "s")
    return written(by_node(full, confirm, "a long, b long").distinct())


def links_between(docs: DataFrame, classes: DataFrame, *, k: int, threshold: float, key: str, text: str) -> DataFrame:
    """Links (a, b) between classes (c, h, g, rep, size, sig) that join all linked classes into components."""

    def branch(batches):
        roots = mix(np.arange(1, TREES + 1, dtype=np.uint64))
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), COORDS)
            path, row = descend(np.tile(roots, len(pdf)), np.repeat(np.arange(len(pdf)), TREES), sig, threshold, DEPTH)
            yield pd.DataFrame({"node": path.view(np.int64), "c": pdf["c"].to_numpy()[row], "size": pdf["size"].to_numpy()[row]})

    front = front_of(classes.select("c", "size", "sig").mapInPandas(branch, "node long, c long, size long"))
    # Classes that merely met by chance go before any set is read.
    near = active(front.where(F.col("n") <= LEAF).withColumn("label", F.col("c")), classes, threshold).select("node", "c", "size").distinct()
    front = front_of(near.unionByName(front.where(F.col("n") > LEAF).select("node", "c", "size")))
    sets = sets_of(docs, k, key, text, front.select("c").distinct().join(classes, "c"))
    links = pivot_links(front, sets, threshold)
    front = labelled(front, links)
    links = links.unionByName(leaf_links(front.where(F.col("n") <= LEAF), classes, sets, threshold))
    large = front.where(F.col("n") > LEAF)
    if large.limit(1).count():
        met = labelled(prefix_front(large, sets, threshold), links)
        links = links.unionByName(leaf_links(met, classes, sets, threshold))
    return links


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = written(classes_of(docs, k, key, text))
    with scratch() as keep:
        each = rows.where("h is not null").groupBy("h", "g").agg(F.min("key").alias("rep"), F.first("n").alias("size"), F.first("sig").alias("sig"))
        # A number stands for the class's 128 bits.
        classes = written(each.withColumn("c", F.monotonically_increasing_id()))
        links = links_between(docs, classes, k=k, threshold=threshold, key=key, text=text)
        label = components(links).select(F.col("id").alias("c"), F.col("component_id").alias("label"))
        reps = written(classes.select("c", "h", "g", "rep").join(label, "c", "left").withColumn("label", F.coalesce("label", "c")))
        least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
        of = keep(written(reps.join(least, "label").select("h", "g", "component_id")))
    out = rows.select("key", "n", "h", "g").join(of, ["h", "g"], "left")
    # A group whose ids are all null has no least id: its rows stand alone.
    component = F.when(F.col("h").isNull() | F.col("component_id").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op8_chosen_path(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, sh FROM (SELECT r, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)), l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
g AS (SELECT r AS a, r AS b FROM d UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b), c AS (SELECT g.a AS r, min(d.doc_id) AS component_id FROM g JOIN d ON d.r = g.b GROUP BY g.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
