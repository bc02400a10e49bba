"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct word shingles. Two small collections of m
composite hashes, each of k minhashes, are computed per set; the key of table
(i, j) is the pair (A_i, B_j). So 2*m*k minhash functions serve m*m tables of
2*k minhashes each, where independent tables would need 2*m*m*k functions. A
pair of similarity s meets in some table with probability
(1 - (1 - s^k)^m)^2: with k = 3 and m = 18, 0.9999 at 0.75 and nearer to 1
above.

Plan, with everything after the first scan on thin rows:

1. One scan makes sets, hashes them and writes (row, set key, size, A, B).
   Rows of equal sets become one node, so copies cost one row per task.
2. A composite that only one node has can't be half of a shared key. Counting
   them first (2*m rows a node) leaves few nodes to expand to m*m keys.
3. Each bucket (key) gets a hub, the member that shares most composites with
   others (of a text and its altered copies, the text itself). A hub and all
   members of its buckets are a star; they are compared with the hub on the full
   sets, which also tells what a member has outside the hub. Verified links are
   contracted to components.
4. Stars that still hold several components are settled without verifying
   their pairs. With h(x) the shingles that x has in common with the hub, two
   members of sizes n can only be linked if min(h(x), h(y)) alone reaches the
   overlap that the limit asks for, percent / (100 + percent) of n(x) + n(y), or
   if they share shingles that the hub has not. The first is a bound on thin
   rows, the second an equi-join on (star, shingle) of the rarest of those
   shingles, as many as must hold a common one. Members that the first lets pass
   (excerpts of the hub, say) are told apart by sketches: of each bin of hashes,
   whether an odd number of a set's shingles falls into it. Sets differ in at least
   as many shingles as their sketches in bins, so sketches too far apart are no
   link. All three lose nothing.
   First, in rounds until one finds no link, groups get pivots of their own and
   are contracted: each (star, shingle), and each (star, mark) of the members that
   share a minhash of the bins in which they differ from the hub. Then the pairs
   that are still apart and within the bounds, each once, are verified.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import by_keys, discard, join_keys, same_keys, texts_of, written

SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Minhashes of the bins in which a member differs from its hub.
MARKS = 8


class WordHashes(dict):
    """Word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, A-Z lower-cased, words
    split at ASCII white space. Fewer words than ``width``: one shingle of all."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(width, n)
    h = w[: n - span + 1].copy()
    for k in range(1, span):
        h = h * MULTIPLIER + w[k : n - span + 1 + k]
    return np.unique(_mix(h + np.uint64(span)))


def _functions(tables: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = 2 * tables * width
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _minhashes(sets: list[np.ndarray], flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(functions, sets) minima; no set is empty. Blocks stay in the cache."""
    out = np.empty((len(flips), len(sets)), np.uint32)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= 32_768):
            n += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        buffer = np.empty_like(x)
        for f in range(len(flips)):
            np.bitwise_xor(x, flips[f], out=buffer)
            np.multiply(buffer, factors[f], out=buffer)
            out[f, at:end] = np.minimum.reduceat(buffer, starts)
        at = end
    return out


def _composites(minima: np.ndarray, tables: int, width: int) -> np.ndarray:
    """(sets, 2 * tables) 64-bit composites; the number of the table is mixed in."""
    by_table = minima.reshape(2 * tables, width, -1).astype(np.uint64)
    out = np.arange(1, 2 * tables + 1, dtype=np.uint64)[:, None] * MULTIPLIER
    out = np.broadcast_to(out, (2 * tables, minima.shape[1]))
    for k in range(width):
        out = _mix(out * MULTIPLIER + by_table[:, k])
    return out.T.astype(np.int64, copy=False)


def _features(docs: DataFrame, id_col: str, text_col: str, width: int, tables: int, k: int) -> DataFrame:
    """(doc_id, row, set_key, n_shingles, composites) of each row."""

    def run(batches):
        hashes, (flips, factors) = WordHashes(), _functions(tables, k)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = [shingle_set(t, hashes, width) for t in texts_of(part.column(1))]
                full = [s for s in sets if len(s)]
                minima = _minhashes(full, flips, factors) if full else None
                found = iter(_composites(minima, tables, k) if full else ())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "row": pa.array(np.arange(row, row + len(sets)), pa.int64()),
                        "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "composites": pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )
                row += len(sets)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, row long, set_key binary, n_shingles long, composites array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (node, doc_id, set_key)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = [shingle_set(t, hashes, width) for t in texts_of(part.column(0))]
                yield pa.RecordBatch.from_pydict({"set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    ids = by_keys(wanted.select("doc_id").distinct()).hint("shuffle_hash")
    texts = docs.select(*join_keys(id_col, text_col), F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(ids, same_keys(), "left_semi").select("_text")
    sets = texts.mapInArrow(run, "set_key binary, shingles array<long>")
    # A node has one key, by which the join deals its rows already.
    return sets.join(wanted.select("node", "set_key"), "set_key").dropDuplicates(["set_key"]).select("node", "shingles")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, c, linked, rest) of the pairs, by their full sets: sizes,
    size of the intersection, and b's shingles that a has not. The side with the
    hubs is joined while rows are thin; a hub that many pairs share is split by
    the skew handling of the join."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.array_except("sb", "sa").alias("rest"))
    both = both.withColumn("c", F.col("nb") - F.size("rest"))
    return both.select("a", "b", "na", "nb", "c", (100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).alias("linked"), "rest")


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is
    its smallest node. Each round, every node points to its smallest neighbour,
    pointers are doubled until they end at nodes that point to themselves, and
    the edges follow. So a round leaves at most half the nodes, and a chain
    takes as many doublings as its length has binary digits."""
    edges = written(edges.where("a <> b"), name)
    assign = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), name)
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(up, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), name)
            discard(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("a", "p")
        if assign is None:
            assign = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("a").alias("component"), "p")
            assign = written(assign.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), name)
        moved = edges.join(parent.withColumnRenamed("p", "pa"), "a").join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        left = written(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
        discard(edges)
        edges = left
        if edges.isEmpty():
            return assign


def _merged(assign: DataFrame, found: DataFrame) -> DataFrame:
    """``assign`` after more links (a, b) of its nodes or of new ones."""
    own = lambda side: assign.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    of = found.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    of = written(of, "links")
    up = connected_components(of.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("p"))
    new = of.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("e")).select("e.*").distinct()
    every = assign.unionByName(new.join(assign, "node", "left_anti"))
    return written(every.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "components")


def _open_stars(compared: DataFrame, assign: DataFrame) -> DataFrame:
    """Members of the stars that hold several components: (hub, node, n, h,
    component, main, least_n, before), ``main`` the component with most members,
    ``before`` the larger open stars that the member is in as well."""
    stars = compared.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("nb").alias("n"), F.col("c").alias("h"))
    placed = stars.join(assign, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("hub", "component").agg(F.count("*").alias("size"), F.min("n").alias("least_n"))
    heads = sizes.groupBy("hub").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.min("least_n").alias("least_n"), F.count("*").alias("m"), F.sum("size").alias("size")).where("m > 1").drop("m")
    # Written first, so that a star of very many members can be split in the join.
    heads = written(heads, "open-stars")
    rows = written(placed.join(heads, "hub"), "open-stars")
    of_node = rows.groupBy("node").agg(F.collect_list(F.struct("size", "hub")).alias("stars"))
    larger = lambda o: (o["size"] > F.col("size")) | ((o["size"] == F.col("size")) & (o["hub"] > F.col("hub")))
    out = rows.join(of_node, "node").withColumn("before", F.transform(F.filter("stars", larger), lambda o: o["hub"])).drop("stars", "size")
    out = written(out, "open-stars")
    discard(rows, heads)
    return out


def _needed(percent: int):
    """What a member has to share with another one beside the hub's shingles."""
    return F.ceil(percent / F.lit(100 + percent) * (F.col("n") + F.greatest(F.col("least_n"), F.col("n") * percent / 100)) - 1e-9) - F.col("h")


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, size, sketch array<long>) of every set, with two to four bins for each
    of its shingles."""

    def run(batches):
        for batch in batches:
            n, out = [], []
            for shingles in batch.column(1):
                n.append(len(shingles.values))
                bins = max(256, 1 << (2 * n[-1] - 1).bit_length())
                at = shingles.values.to_numpy() & (bins - 1)
                out.append(np.packbits(np.bincount(at, minlength=bins).astype(np.uint8) & 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["node", "size", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, size long, sketch array<long>")


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch with the bins of a smaller one: bin i and its pair in the upper half
    become one."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _marks(stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(hub, node, marks) of the members of open stars that may be linked by
    shingles of the hub alone, each in its largest open star."""
    factors = np.random.default_rng(20240301).integers(0, 2**31, MARKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches):
        for batch in batches:
            marks = []
            for own, hub in zip(batch.column(2), batch.column(3), strict=True):
                own, hub = own.values.to_numpy(), hub.values.to_numpy()
                least = min(len(own), len(hub))
                at = np.flatnonzero(np.unpackbits((_folded(own, least) ^ _folded(hub, least)).view(np.uint8))).astype(np.uint32)
                mixed = (at * np.uint32(0x9E3779B1)) ^ (at >> np.uint32(3))
                marks.append(((mixed[:, None] + np.uint32(1)) * factors).min(axis=0).astype(np.int64) if len(at) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(marks, pa.list_(pa.int64()))], names=["hub", "node", "marks"])

    thin = stars.where((_needed(percent) <= 0) & (F.size("before") == 0)).select("hub", "node")
    both = thin.join(sketches.select("node", "sketch"), "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    return written(both.select("hub", "node", "sketch", "hub_sketch").mapInArrow(run, "hub long, node long, marks array<long>").where("marks is not null"), "marks")


def _within(x: str, y: str, n_x: str, n_y: str, percent: int):
    """Whether two sketches and sizes leave a link possible. Sizes of linked sets
    are so near that bins differ by one doubling at most."""

    def fold(own: str, other: str):
        half = (F.size(own) / 2).cast("int")
        halves = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > F.size(other), halves).otherwise(F.col(own))

    apart = F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, e: s + e)
    near = percent * F.greatest(n_x, n_y) <= 100 * F.least(n_x, n_y)
    return near & ((100 + percent) * apart <= (100 - percent) * (F.col(n_x) + F.col(n_y)))


def _ends() -> list:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _reaching(stars: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """(star, shingle) rows of the members, for the rarest of their shingles that
    the hub has not: as many as must hold one in common with any linked member.

    Shingles outside the hub count if members of several components have them; a
    member needs ``least`` of those in common with any other, so the rarest
    ``s - least + 1`` hold one."""
    member = ["hub", "node", "n", "h", "component", "main", "before"]
    rest = compared.where(F.size("rest") > 0).select(F.col("a").alias("hub"), F.col("b").alias("node"), "rest")
    parts = stars.select("hub", "node", "component").join(rest, ["hub", "node"]).select("hub", "node", "component", F.explode("rest").alias("shingle"))
    several = parts.groupBy("hub", "shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("df")).where("c0 <> c1").drop("c0", "c1")
    # Written first, so that a shingle of very many members can be split in the join.
    several = written(several, "open-shingles")
    live = parts.join(several, ["hub", "shingle"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("live"), F.count("*").alias("s"))
    reach = stars.join(live, ["hub", "node"]).withColumn("least", F.greatest(F.lit(1), _needed(percent))).where("s >= least")
    reach = reach.select(*member, "s", F.explode(F.slice("live", 1, (F.col("s") - F.col("least") + 1).cast("int"))).alias("l")).select(*member, "s", "l.shingle")
    reach = written(reach, "open-shingles")
    discard(several)
    return reach


def _enough(c, percent: int):
    return (100 + percent) * c >= percent * (F.col("x.n") + F.col("y.n"))


def _beyond_hub(percent: int):
    """Whether x and y can be linked, but not by shingles of the hub alone."""
    of_hub = F.least("x.h", "y.h")
    return _enough(of_hub + F.least("x.s", "y.s"), percent) & ~_enough(of_hub, percent)


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the pairs: by their sketches, then by their sets."""
    of = lambda side: sketches.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    near = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(_within("sa", "sb", "na", "nb", percent))
    near = written(near.select("a", "b"), "pairs")
    # Few of the sets are in pairs. Their nodes are written first, so that it is
    # known before the exchange of the sets whether they can be broadcast.
    nodes = written(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pairs")
    found = written(_compared(near, sets.join(nodes, "node", "left_semi"), percent).where("linked").select("a", "b"), "links")
    discard(near, nodes)
    return found


def _pivot_links(stars: DataFrame, compared: DataFrame, marks: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links (a, b) between components of the open stars, of members and the pivot
    of a group that they are in: (star, mark) and, at the first turn, (star,
    shingle). Pairs are as many as rows of the groups."""
    marked = stars.select("hub", "node", "component").join(marks, ["hub", "node"]).select("hub", "node", "component", F.posexplode("marks").alias("at", "mark"))
    pivots = marked.groupBy("hub", "at", "mark").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("hash"), "node", "component")).alias("y"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    pairs = marked.alias("x").join(pivots.select("hub", "at", "mark", "y.node", "y.component").alias("y"), ["hub", "at", "mark"]).where("x.component <> y.component").select(*_ends())
    if not turn:
        reach = _reaching(stars, compared, percent)
        pivots = reach.groupBy("hub", "shingle").agg(F.max(F.struct(F.expr("component = main").alias("o"), F.xxhash64("node").alias("hash"), "node", "n", "h", "s", "component")).alias("y")).select("hub", "shingle", "y.node", "y.n", "y.h", "y.s", "y.component")
        pairs = pairs.union(reach.alias("x").join(pivots.alias("y"), ["hub", "shingle"]).where((F.col("x.component") != F.col("y.component")) & _beyond_hub(percent)).select(*_ends()))
    found = _verified(pairs, sketches, sets, percent)
    if not turn:
        discard(reach)
    return found


def _last_links(stars: DataFrame, compared: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all pairs between components of the open stars that the
    bounds leave, each settled in the largest star that both are in."""
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & ~F.arrays_overlap("x.before", "y.before")
    of = lambda rows, on, bound: rows.where("component <> main").alias("x").join(rows.alias("y"), on & apart & bound).select(*_ends())
    star, shingle = F.col("x.hub") == F.col("y.hub"), F.col("x.shingle") == F.col("y.shingle")
    # Written first, so that a star of very many members can be split in the join.
    thin = written(stars.where(_needed(percent) <= 0).select("hub", "node", "n", "h", "component", "main", "before").join(sketches.select("node", "sketch"), "node"), "placed")
    reach = _reaching(stars, compared, percent)
    by_hub = _enough(F.least("x.h", "y.h"), percent) & _within("x.sketch", "y.sketch", "x.n", "y.n", percent)
    found = _verified(of(thin, star, by_hub).union(of(reach, star & shingle, _beyond_hub(percent))), sketches, sets, percent)
    discard(reach, thin)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = SHINGLE, tables: int = 18, k: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join documents with ``100 * |intersection| >= percent * |union|`` of
    their shingle sets; ``component_id`` is the smallest doc_id reachable (null
    only if every reachable id is null), ``kept`` says whether it is the row's
    own id. Null and empty texts have an empty set and no links. Repeated ids
    are separate rows, both kept if they share the smallest id. Other columns
    are ignored; an empty table gives an empty result."""
    features = written(_features(docs, id_col, text_col, width, tables, k), "features")
    nodes = features.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("composites").alias("c"))
    nodes = written(nodes, "nodes")
    # Composites that at least two nodes have.
    each = nodes.select("node", F.posexplode("c").alias("at", "value"))
    shared = each.groupBy("value").count().where("count > 1")
    halves = each.join(shared, "value").groupBy("node").agg(F.sum("count").alias("weight"), F.collect_list(F.when(F.col("at") < tables, F.col("value"))).alias("a"), F.collect_list(F.when(F.col("at") >= tables, F.col("value"))).alias("b"))
    keys = halves.select("node", "weight", F.explode("a").alias("a"), "b").select("node", "weight", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node", "weight")
    keys = written(keys, "keys")
    hubs = keys.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    pairs = keys.join(hubs.select("key", F.col("hub.node").alias("a")), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    discard(keys)
    in_stars = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "set_key").join(in_stars, "node", "left_semi")
    wanted = wanted.join(features.select(F.col("row").alias("node"), "doc_id"), "node").select("node", "doc_id", "set_key")
    sets = written(_full_sets(docs, wanted, id_col, text_col, width), "sets")
    compared = written(_compared(pairs, sets, percent), "compared")
    assign = connected_components(compared.where("linked").select("a", "b"))
    stars = _open_stars(compared, assign)
    sketches = written(_sketches(sets), "sketches")
    marks = _marks(stars, sketches, percent)
    for turn in itertools.count():
        found = _pivot_links(stars, compared, marks, sketches, sets, percent, turn)
        if found.isEmpty():
            break
        discard(stars)
        assign = _merged(assign, found)
        stars = _open_stars(compared, assign)
    found = _last_links(stars, compared, sketches, sets, percent)
    discard(stars, marks, sketches)
    if not found.isEmpty():
        assign = _merged(assign, found)
    discard(sets, pairs, compared)

    placed = nodes.select("set_key", "node", "doc_id").join(assign, "node", "left")
    smallest = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least_id"))
    placed = written(placed.join(smallest, "component", "left").select("set_key", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id")), "components")
    discard(nodes)
    thin = features.select("doc_id", "n_shingles", "set_key", F.shiftright("row", 33).alias("run"))
    of_run = thin.select("run", "set_key").distinct().join(placed, "set_key")
    out = thin.join(of_run, ["run", "set_key"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id stays, one document of each group. Where an
    id repeats, it stays if any of its rows does."""
    judged = written(near_duplicates(docs, id_col, text_col, **options), "near")
    gone = by_keys(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("some")).where("not some").select("doc_id")).hint("shuffle_hash")
    keyed = docs.select("*", *join_keys(id_col, text_col))
    return keyed.join(gone, same_keys(), "left_anti").select(*docs.columns)
