"""Exact Jaccard self-join of word-shingle sets, by prefix filters under several global token orders.

1. Sets: one scan yields each document's set size and a 128-bit hash of its set; equal sets are one node, whatever their ids.
2. Orders: tokens that are frequent come last in all orders; ties are broken by another scrambling in each order. Any order
   that is the same for all sets is correct, so frequencies may be a bounded list of heavy tokens.
3. Candidates: different sets that link share SHARED tokens of their prefixes under every order. Postings of the first order's
   prefixes are grouped by token.
4. First pairs: nodes with the same first token under a plain scrambling are paired with one pivot, and each node with a few
   pivots of its tokens that it shares the most tokens with. Pivots are the nodes with the largest shares of shared tokens:
   copies with few changes, which link with most of their group. Then tokens whose nodes lie in one component need no pairs,
   and the others' nodes have another round of pivots, of other components.
5. Then all pairs of nodes from different components that share enough open tokens, at places from which enough is left of both
   sets, are verified too, so no link between components is lost.
6. Verification: a pair must share as many prefix tokens under the other orders, and then its sets are intersected. Sets are
   sent once a pair's side: a pivot's to the tasks that hold its partners, which are split where they are many.
7. Counts: all links are within components now. Where some pair of a component's sets hasn't been verified, its sets are dealt
   into parts, and every two parts are intersected as a whole; only counts leave a task, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import discard, documents, forget_tables, prepare, release, save
from keyloom.llm.components import components
from keyloom.llm.shingles import mixed, shingle_sets

#: Links need a similarity of PERCENT / 100.
PERCENT = 80
#: Token orders; the first generates candidates, the others filter them.
ORDERS = 3
#: Prefix tokens that a linked pair must share. Different sets that link have four tokens in common at least.
SHARED = 3
#: Tokens that a task reports at most, and how many are ordered by frequency. These bound the ordering's table, not the result.
TASK_HEAVY, HEAVY = 1 << 17, 1 << 20
#: Bits of the filter before the table of heavy tokens.
FILTER = 1 << 25
#: Plain scramblings whose first tokens yield the first pairs.
FIRSTS = 3
#: Nodes from which a token of the first prefixes is ordered by frequency too.
RECOUNTED = 8
#: Pivots of a token and of a node, and rounds of pairs with pivots after the first pairs at most.
PIVOTS, ROUNDS = 8, 1
#: Partners of a pivot in one task, about; rows of a table that is sent to all executors, at most.
PARTNERS, BROADCAST = 500, 200_000
#: Sets and tokens of a component's part, about.
PART_SETS, PART_TOKENS = 2048, 2_000_000
#: Columns of a dense product of two parts; pairs of a sparse step; how many dense cells cost as much as a sparse pair.
DENSE, SPARSE, CHEAPER = 2048, 2_000_000, 64
#: Tokens that a task gathers before it counts them.
COUNT_EVERY = 2_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 (id, size, set hash, text hash) and, at the task's end, of kind 1 (token, count) for tokens of several sets."""
    forget_tables()
    seen: set[int] = set()
    held: list[np.ndarray] = []
    n_held, tokens, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count() -> None:
        nonlocal tokens, counts, n_held
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        new, n = new[n >= 2], n[n >= 2]
        both, at = np.unique(np.concatenate([tokens, new]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        keep = np.argsort(-sums, kind="stable")[:TASK_HEAVY]
        tokens, counts, n_held = both[keep], sums[keep], 0
        held.clear()

    for batch in batches:
        rows = []
        for doc, i, th, s in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "id", "th")], shingle_sets(batch.column("text")), strict=True):
            a, b = _set_key(s) if len(s) else (0, 0)
            rows.append((0, i, len(s), a, b, th, [int(t) for t in _signed(_firsts(s))] if len(s) else None, doc))
            if len(s) and a not in seen:
                seen.add(a)
                held.append(s)
                n_held += len(s)
                if n_held > COUNT_EVERY:
                    count()
        yield _rows(rows)
    count()
    zeros = np.zeros(len(tokens), np.int64)
    columns = [pa.array(v, t) for v, t in zip((zeros + 1, _signed(tokens), counts, zeros, zeros, zeros), SCAN.types[:6], strict=True)]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(tokens), t) for t in SCAN.types[6:])], schema=SCAN)


def _firsts(s: np.ndarray) -> np.ndarray:
    """The first tokens of a set under plain scramblings."""
    return np.array([s[np.argmin(mixed(s, 20 + k))] for k in range(FIRSTS)], np.uint64)


def _heavy(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of sums (token, n) the most frequent tokens and their n: all above a frequency that leaves at most HEAVY."""
    least, total = 2, 0
    for r in sums.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():  # at most 10,000 rows
        total += r["count"]
        if total > HEAVY:
            least = r.n + 1
            break
    table = sums.where(F.col("n") >= least).toArrow()
    return table.column("token").to_numpy(), table.column("n").to_numpy()


def _ordered(*parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tokens of several lists, the most frequent first, at most HEAVY."""
    tokens, n = np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])
    at = np.lexsort((tokens, -n))
    _, first = np.unique(tokens[at], return_index=True)
    return tokens[at][np.sort(first)][:HEAVY]


SCAN = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("th", pa.int64()), ("firsts", pa.list_(pa.int64())), ("doc_id", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), SCAN.types, strict=True)] if rows else [pa.array([], t) for t in SCAN.types], schema=SCAN)


class Orders:
    """The global token orders: by rank among the heavy tokens (all others before them), then by a scrambling."""

    def __init__(self, heavy: np.ndarray):
        tokens = heavy.view(np.uint64)  # the most frequent first
        at = np.argsort(tokens)
        self.tokens, self.ranks = tokens[at], (len(tokens) - at).astype(np.int64)
        low = tokens & np.uint64(FILTER - 1)
        self.seen = np.zeros(FILTER // 8, np.uint8)
        np.bitwise_or.at(self.seen, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def prefix(self, s: np.ndarray, order: int) -> np.ndarray:
        """The first tokens, in order, of which a linked set must have SHARED in its own prefix."""
        rank = np.zeros(len(s), np.int64)
        low = s & np.uint64(FILTER - 1)  # few tokens are heavy: a bit for each value of the low bits tells most others
        maybe = np.flatnonzero(self.seen[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, s[maybe]), len(self.tokens) - 1)
            rank[maybe] = np.where(self.tokens[at] == s[maybe], self.ranks[at], 0)
        most = _most(len(s))
        scrambled = mixed(s, order + 1)
        if not rank.any():
            at = np.argpartition(scrambled, most - 1)[:most] if most < len(s) else np.arange(len(s))
            return s[at[np.argsort(scrambled[at])]]
        return s[np.lexsort((scrambled, rank))[:most]]


def _most(n: int) -> int:
    """The length of a prefix: of n tokens a linked set has PERCENT, so it has SHARED of these."""
    return min(n, n - (PERCENT * n + 99) // 100 + SHARED)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def linked(x: np.ndarray, y: np.ndarray, xp: np.ndarray, yp: np.ndarray) -> bool:
    """Whether two sets link; xp and yp have their sorted prefixes under the orders after the first, in a row."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    i, j = _most(len(x)), _most(len(y))
    if any(_common(xp[k * i : (k + 1) * i], yp[k * j : (k + 1) * j]) < SHARED for k in range(ORDERS - 1)):
        return False
    both = _common(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of x with all sets of y."""
    values, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    rows = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (x, y)]
    cols = np.split(at, [len(rows[0])])
    n = [np.bincount(c, minlength=len(values)) for c in cols]
    often = n[0] * n[1] * CHEAPER > len(x) * len(y)
    out = np.zeros((len(x), len(y)), np.int64)
    # Tokens of many sets: products of 0/1 matrices, whose sums are exact in 32 bits.
    place = np.cumsum(often) - 1
    sides = []
    for r, c in zip(rows, cols, strict=True):
        mine = np.flatnonzero(often[c])
        mine = mine[np.argsort(place[c[mine]], kind="stable")]
        sides.append((r[mine], place[c[mine]]))
    for start in range(0, int(often.sum()), DENSE):
        a, b = (np.zeros((len(sets), DENSE), np.float32) for sets in (x, y))
        for block, (r, c) in zip((a, b), sides, strict=True):
            low, high = np.searchsorted(c, (start, start + DENSE))
            block[r[low:high], c[low:high] - start] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    # Other tokens: their pairs of sets, some at a time.
    (rx, ry), (cx, cy) = rows, cols
    mine = ~often[cx] & (n[1][cx] > 0)
    rx, cx = rx[mine], cx[mine]
    ry, first, times = ry[np.argsort(cy, kind="stable")], np.cumsum(n[1]) - n[1], n[1][cx]
    ends = np.cumsum(times)
    low = 0
    while low < len(rx):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SPARSE, "right")))
        t = times[low:high]
        within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        cells = np.repeat(rx[low:high] * len(y), t) + ry[np.repeat(first[cx[low:high]], t) + within]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        low = high
    return out


def link_table(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether each set of x links with each set of y."""
    both = shared_counts(x, y)
    total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None]
    return 100 * both >= PERCENT * (total - both)


def _count_links(table: pa.Table) -> pa.Table:
    """Of two parts of a component, or a part with itself: how many sets of the other part each set links with."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    parts: dict[int, dict[int, np.ndarray]] = {i: {}, j: {}}
    for key, part, tokens in zip(*[table.column(c).to_pylist() for c in ("key", "part", "tokens")], strict=True):
        parts[part][key] = np.frombuffer(tokens, np.uint64)  # a repeated row overwrites its like
    x, y = parts[i], parts[j]
    if i == j:
        keys, n = list(x), link_table(list(x.values()), list(x.values())).sum(1) - 1  # but itself
    elif x and y:
        links = link_table(list(x.values()), list(y.values()))
        keys, n = [*x, *y], np.concatenate([links.sum(1), links.sum(0)])
    else:
        keys, n = [], []
    return pa.table([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n_links"])


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, n_links, th, component) for each row of docs (doc_id, text).

    th is the text's xxhash64; component tells components apart that have no id (null for texts without words).

    n_links counts all links of the document's set with different sets (not with its copies). Without words a document links
    with nothing, not even its copies. Rows link by their sets alone, so rows with the same doc_id or without one are in one component only if their texts are; a component's
    id is the smallest doc_id in it, null if it has none. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = documents(docs).withColumn("th", F.xxhash64("text"))
    scanned = save(rows.mapInArrow(_scan, "kind int, a long, n long, s1 long, s2 long, th long, firsts array<long>, doc_id long"), "shingle-sets")
    sets = scanned.where("kind = 0").select("doc_id", F.col("a").alias("id"), "n", "s1", "s2", "th", "firsts")
    # Links and components are between keys, one for each set; at is a row that has the set: ids alone may be null or repeated.
    nodes = sets.where("n > 0").groupBy(F.col("s1").alias("node"), "s2").agg(F.min(F.struct("id", "th")).alias("at"), F.first("n").alias("n"), F.first("firsts").alias("firsts"), F.min("doc_id").alias("doc_id"))
    nodes = save(nodes.select("node", "s2", "n", "at.id", "at.th", "firsts", "doc_id", F.monotonically_increasing_id().alias("key")), "nodes")

    def postings(heavy) -> DataFrame:
        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            orders, seen = Orders(heavy.value), set()
            for batch in batches:
                tokens, owners = [np.zeros(0, np.uint64)], []
                for s in shingle_sets(batch.column("text")):
                    if len(s) and (key := _set_key(s)[0]) not in seen:
                        seen.add(key)
                        tokens.append(orders.prefix(s, 0))
                        owners.append((key, len(s), len(tokens[-1])))
                node, n, most = np.array(owners, np.int64).reshape(-1, 3).T
                place = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
                columns = [_signed(np.concatenate(tokens)), np.repeat(node, most), np.repeat(n, most).astype(np.int32), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place"])

        return save(rows.select("text").mapInArrow(prefixes, "token long, node long, n int, place int"), "prefixes")

    def shared_postings():
        """The postings of tokens that are in several nodes' prefixes, and the order's heavy tokens."""
        reported = _heavy(save(scanned.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n")), "heavy-tokens"))
        heavy = spark.sparkContext.broadcast(_ordered(reported))
        raw = postings(heavy)
        # What a task sees once may be frequent over all tasks: the first prefixes tell, and are made anew.
        recounted = _heavy(save(raw.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= RECOUNTED), "heavy-tokens"))
        if len(recounted[0]):
            discard(raw)
            release(spark)
            heavy = spark.sparkContext.broadcast(_ordered(reported, recounted))
            raw = postings(heavy)
        shared = raw.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("token")
        posted = save(raw.join(shared, "token").distinct(), "postings")
        discard(raw)
        release(spark)
        return posted, heavy

    posted, heavy = shared_postings()

    def text_rows(wanted: DataFrame) -> DataFrame:
        """Rows of the wanted (id, th, ...) with their texts; a short list is sent to the texts, a long one meets them in a shuffle."""
        wanted = save(wanted, "wanted")
        return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, ["id", "th"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, seen = Orders(heavy.value), set()
        for batch in batches:
            keep = []
            for key, node, s2, s in zip(*[batch.column(c).to_pylist() for c in ("key", "node", "s2")], shingle_sets(batch.column("text")), strict=True):
                if key not in seen and len(s) and _set_key(s) == (node, s2):  # not a repeated row
                    seen.add(key)
                    keep.append((key, node, s.tobytes(), b"".join(np.sort(orders.prefix(s, k)).tobytes() for k in range(1, ORDERS))))
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["key", "node", "tokens", "prefixes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pivot, the pivot's own first and then its partners."""
        x, pivots = None, {}
        for batch in batches:
            found = []
            for pivot, salt, partner, key, tokens, prefixes in zip(*[batch.column(c).to_pylist() for c in ("x", "salt", "partner", "key", "tokens", "prefixes")], strict=True):
                if (pivot, salt) != x:
                    x, pivots = (pivot, salt), {}
                own = np.frombuffer(tokens, np.uint64), np.frombuffer(prefixes, np.uint64)
                if not partner:
                    pivots[key] = own
                else:
                    found += [(k, key) for k, p in pivots.items() if k != key and linked(p[0], own[0], p[1], own[1])]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(2)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (a, b) between keys of the saved pairs of nodes (x, y), x being a pivot of y."""
        wanted = nodes.join(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "node", "left_semi")
        own = save(text_rows(wanted.select("key", "node", "s2", "id", "th")).mapInArrow(members, "key long, node long, tokens binary, prefixes binary"), "members")
        release(spark)
        parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
        sides = pairs.join(parts, "x").select("x", F.pmod(F.xxhash64("y"), "parts").alias("salt"), F.lit(True).alias("partner"), F.col("y").alias("node"))
        sides = sides.union(parts.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("partner"), F.col("x").alias("node")))
        sides = sides.join(own, "node").select("x", "salt", "partner", "key", "tokens", "prefixes")
        links = sides.repartition("x", "salt").sortWithinPartitions("x", "salt", "partner").mapInArrow(verify, "a long, b long")
        links = save(links.distinct(), "links")
        discard(own)
        release(spark)
        return links

    def counted(links: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, n_links) of the sets that have links."""
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = links.select(F.col("a").alias("key")).union(links.select("b")).groupBy("key").agg(F.count("*").alias("found"))
        linked_nodes = save(nodes.join(labels.withColumnRenamed("node", "key"), "key").join(found, "key"), "linked")
        sizes = linked_nodes.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum("found").alias("found")).where("found < k * (k - 1)")
        parts = F.greatest(F.ceil(F.col("k") / PART_SETS), F.ceil(F.col("t") / PART_TOKENS)).alias("parts")
        sizes = save(sizes.select("label", parts), "open-components")
        if sizes.isEmpty():
            return linked_nodes.select("key", F.col("found").alias("n_links"))
        large = F.broadcast(sizes.where("parts > 1"))  # few
        wanted = linked_nodes.join(large, "label").unionByName(linked_nodes.join(large, "label", "left_anti").join(sizes.where("parts = 1"), "label"))
        wanted = wanted.select("key", "node", "s2", "id", "th", "label", "parts", F.pmod(F.xxhash64("key"), "parts").alias("part"))

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                keep, tokens = [], []
                for k, (key, node, s2, s) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "node", "s2")], shingle_sets(batch.column("text")), strict=True)):
                    if key not in seen and len(s) and _set_key(s) == (node, s2):
                        seen.add(key)
                        keep.append(k)
                        tokens.append(s.tobytes())
                kept = batch.select(["key", "label", "parts", "part"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tokens, pa.binary())], names=["key", "label", "parts", "part", "tokens"])

        own = text_rows(wanted).mapInArrow(sets_of, "key long, label long, parts long, part long, tokens binary")
        own = own.select("key", "label", "part", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        own = own.select("key", "label", "part", "tokens", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        all_links = own.groupBy("label", "i", "j").applyInArrow(_count_links, "key long, n_links long")
        all_links = save(all_links.groupBy("key").agg(F.sum("n_links").alias("n_links")), "link-counts")
        release(spark)
        return linked_nodes.join(all_links, "key", "left").select("key", F.coalesce("n_links", "found").alias("n_links"))

    def open_tokens(labels: DataFrame) -> DataFrame:
        """(token, node, n, place, label) of the tokens that still join several components."""
        own = nodes.select("node", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("node", F.coalesce("label", "key").alias("label"))
        placed = save(posted.join(own, "node"), "placed")
        several = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
        out = save(placed.join(several, "token"), "open")
        discard(placed)
        release(spark)
        return out

    fits = lambda a, b: (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))
    def sides(placed: DataFrame) -> list[DataFrame]:
        return [placed.select("token", F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}")) for c in "xy"]

    # Of a linked pair's first SHARED common tokens each leaves both sets as much as they must still share.
    enough = 9 * (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + SHARED - 1) >= 4 * (F.col("nx") + F.col("ny"))

    def nearest(placed: DataFrame) -> DataFrame:
        """Each node with the PIVOTS nodes that it shares the most tokens with, of those that are some token's pivots.

        A copy with few changes has few tokens of its own, so most of its prefix is shared, and it links with many others. A token's
        pivots are, by the length of that share, the first node of each of its first PIVOTS labels, so the join makes PIVOTS rows
        a posting at most.
        """
        x, y = sides(placed)
        x = x.withColumn("wx", F.count("*").over(Window.partitionBy("x")) / F.col("nx"))  # a node's postings are of one text
        x = x.groupBy("token", "lx").agg(F.max(F.struct("wx", "x", "nx", "px")).alias("p")).select("token", "lx", "p.*")
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("wx"), "lx"))).where(F.col("rank") <= PIVOTS).drop("rank", "wx")
        near = y.join(x, "token").where((F.col("lx") != F.col("ly")) & fits("nx", "ny") & enough).groupBy("x", "y").count().where(F.col("count") >= SHARED)
        if tried is not None:
            near = near.join(tried, ["x", "y"], "left_anti")
        best = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("count"), "x"))
        return near.withColumn("rank", best).where(F.col("rank") <= PIVOTS).select("x", "y")

    firsts = nodes.select("node", "n", F.posexplode("firsts").alias("order", "token"))
    pivots = firsts.groupBy("order", "token").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("last")).where("p.node < last").select("order", "token", "p")
    paired = firsts.join(pivots, ["order", "token"]).where((F.col("node") != F.col("p.node")) & fits("n", "p.n")).select(F.col("p.node").alias("x"), F.col("node").alias("y"))
    tried = None
    tried = save(paired.union(nearest(posted.withColumn("label", F.col("node")))).distinct(), "pairs")
    links = verified(tried)
    labels = components(links)
    for _ in range(ROUNDS):
        open_ = open_tokens(labels)
        pairs = save(nearest(open_), "pairs")
        tried = tried.union(pairs)
        new = verified(pairs)
        if new.isEmpty():
            break
        discard(open_)
        links = links.union(new)
        labels = components(links)
    else:
        open_ = open_tokens(labels)
    left, right = sides(open_)
    far = left.join(right, "token").where((F.col("lx") < F.col("ly")) & fits("nx", "ny") & enough)
    far = far.groupBy("x", "y").count().where(F.col("count") >= SHARED).select("x", "y")
    far = save(far.join(tried.union(tried.select("y", "x")), ["x", "y"], "left_anti"), "far-pairs")
    if not far.isEmpty():
        links = links.union(verified(far))
        labels = components(links)
    degree = counted(links, labels)
    classes = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left").select(F.col("node").alias("s1"), "s2", F.col("doc_id").alias("own"), F.coalesce("label", "key").alias("label"), "n_links")
    least = nodes.join(labels.withColumnRenamed("node", "key"), "key").groupBy("label").agg(F.min("doc_id").alias("least"))
    classes = classes.join(least, "label", "left").select("s1", "s2", "label", F.coalesce("least", "own").alias("component"), "n_links")
    out = sets.join(classes, ["s1", "s2"], "left")
    low = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), low.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "th", F.when(F.col("n") > 0, F.col("label")).alias("component"))
