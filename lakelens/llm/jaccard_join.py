"""Exact n-gram Jaccard join by token-combination prefixes, and its components.

Tokens (shingle hashes) have one global order: rare ones by value, then
frequent ones, then very frequent ones. A set indexes a prefix of its tokens:
rare tokens one by one, frequent tokens as pairs and very frequent ones as
triples inside a class. The prefix is extended until, with at most ``e`` of the
set's tokens missing from any partner, a common key is left: rare tokens, the
tokens but one of each class of pairs and the tokens but two of each class of
triples must sum to e + 1.

Short posting lists give pairs of sets, which sketches of fixed size a set rule
out or leave open; a long list ties all its sets together. What is tied
together is a territory, so every link lies inside one. Whole sets are then
compared once, in cells of one or two blocks of a territory's sets that write a
row a set and no pairs: its number of links and the smallest set it reaches in
the cell. In a territory of many blocks these follow the long lists, and two
blocks meet only if some key or open pair is common to them.

Which tokens are frequent, and which keys occur twice, is kept in bitmaps sized
by what they hold, up to a bound: a false hit makes a rare token frequent or
keeps a key too many, which costs time but loses nothing. Exact copies are one
set throughout. Sets and shingles are told apart by 64-bit hashes; among 10^8
different sets one pair is mistaken with a chance of about 3 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, find, importable, saved, slices, unite
from .shingles import Hasher, mix

#: A token of more sets than this is frequent, and very frequent.
FREQUENT, VERY_FREQUENT = 10, 1000
#: Longest posting list whose pairs are written; a longer one ties its sets to one territory.
SHORT = 16
#: Least and most bits of a bitmap (the latter bounds what is broadcast), and bits for each value in it.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 16
#: Bands of sets below this size have one class of pairs.
SMALL = 24
#: About the sets, and the tokens of sets, of a block; a large home has blocks of up to 8 times as many sets.
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 20
#: Most blocks of a territory that all meet; a set is then copied at most so often.
WHOLE = 16
#: Sets of a cell that are compared first where only components are asked for.
PIVOTS = 16
#: Distinct tokens that a cell of two blocks compares at a time.
WIDTH = 4096
#: Most long lists whose keys are sent to every task; beyond, Spark chooses the join.
FEW_LISTS = 250_000


@dataclass(frozen=True)
class Join:
    """Shingle width and the threshold ``num / den`` of the Jaccard similarity."""

    width: int = 5
    num: int = 75
    den: int = 100

    def missing(self, n):
        """Most tokens of a set of n that a partner may lack."""
        return n - -(-(n * self.num) // self.den)


def _bit_places(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)


class Bitmap:
    """A set of hashed values; it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray):
        self.bits = words

    def has(self, tokens: np.ndarray) -> np.ndarray:
        at = _bit_places(np.ascontiguousarray(tokens, np.int64), len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def bitmap(tokens: DataFrame) -> Bitmap:
    """The bitmap of a one-column table of long values; what is collected is at most MOST_BITS bits."""
    bits = LEAST_BITS
    n = tokens.count()
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            p = _bit_places(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False), np.int64), bits)
            np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        words = own.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["at", "word"])

    rows = tokens.mapInArrow(places, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return Bitmap(words.view(np.uint8))


def bands(upto: int = 1 << 40, j: Join = Join()) -> np.ndarray:
    """Lower ends of size bands such that the sizes of linked sets lie in one band or two neighbours."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(ends[-1] * j.den // j.num + 1)
    return np.array(ends)


_BANDS: dict[Join, np.ndarray] = {}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(256)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k).T


def combination_keys(tokens: np.ndarray, level: np.ndarray, need: int, band: int, size: int, j: Join) -> np.ndarray:
    """Keys of a set's frequent tokens (level 1 or 2, in that order) in one band, from the shortest prefix that is enough.

    A class of pairs adds its tokens but one to the prefix, a class of triples its tokens but two.
    """
    if size < SMALL:
        cls, k = np.zeros(len(tokens), np.int64), np.full(len(tokens), 2)
    else:
        classes = max(1, j.missing(size) // 4)
        cls = (mix(tokens.view(np.uint64)) % np.uint64(classes)).astype(np.int64) + classes * (level - 1)
        k = level + 1
    order = np.argsort(cls, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(cls[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    place = np.zeros(len(tokens), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    stop = min(len(tokens), int(np.searchsorted(np.cumsum(place >= k - 1), need)) + 1)
    v, c, k = tokens[:stop].view(np.uint64), cls[:stop], k[:stop]
    out = [np.zeros(0, np.int64)]
    for x in np.unique(c):
        own, width = v[c == x], int(k[c == x][0])
        if len(own) >= width:
            key = np.full(1, band * 8 + width, np.uint64)
            for at in _choices(len(own), width):
                key = mix((key + own[at]) * _FACTOR)
            out.append(key.view(np.int64))
    return np.concatenate(out)


def prefix_keys(tokens: np.ndarray, level: np.ndarray, n: int, j: Join) -> tuple[np.ndarray, np.ndarray] | None:
    """Index keys of a set of ``n`` tokens from its smallest ones in order: rare tokens, and keys of combinations.

    ``level`` is 0 for a rare token, 1 for a frequent one, 2 for a very
    frequent one. None if the prefix needs tokens beyond those given. As the
    number of classes belongs to a band of sizes, a set makes the keys of its
    own band and of the next. A set of one token links with no other set and needs none.
    """
    level = np.asarray(level).astype(np.int64)
    need = j.missing(n) + 1
    rare = tokens[level == 0]
    if len(rare) >= need:
        return rare[:need], rare[:0]
    if len(tokens) < n:
        return None  # frequent tokens come after all rare ones, so the whole set is needed
    if j not in _BANDS:
        _BANDS[j] = bands(j=j)
    band = int(np.searchsorted(_BANDS[j], n, side="right")) - 1
    often, lev = np.concatenate([tokens[level == 1], tokens[level == 2]]), np.sort(level[level > 0])
    keys = [combination_keys(often, lev, need - len(rare), b, int(_BANDS[j][b]), j) for b in (band, band + 1)]
    return rare, np.unique(np.concatenate(keys))


def _sets(docs: DataFrame, j: Join, schema: str, row, wanted=None) -> DataFrame:
    """Run ``row(id, tokens) -> tuple`` over the sets of (id, text); a third column goes before; ``wanted``: broadcast bitmap of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        kinds = [f.type for f in pa_schema]
        for b in slices(batches, 256):
            ids, texts = b.column(0), b.column(1)
            if wanted is not None:
                at = np.flatnonzero(wanted.value.has(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & ids.is_valid().to_numpy(zero_copy_only=False))
                ids, texts = ids.take(pa.array(at)), texts.take(pa.array(at))
            rows = [row(i, s) for i, s in zip(ids.to_pylist(), hasher.sets(texts.to_pylist(), j.width))]
            if b.num_columns > 2:
                rows = [(t, *r) for t, r in zip(b.column(2).to_pylist(), rows)]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    pa_schema = to_arrow_schema(StructType.fromDDL(schema))
    return docs.mapInArrow(run, schema)


def signature(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    u = s.view(np.uint64)
    with np.errstate(over="ignore"):
        x = np.array([u.sum(dtype=np.uint64), mix(u ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)], np.uint64)
        return int(mix(mix(x[:1]) * _FACTOR + x[1:] + np.uint64(len(s))).view(np.int64)[0])


def _first_tokens(j: Join):
    def row(i, s):
        need = j.missing(len(s)) + 1
        return i, signature(s), len(s), s[: need + need // 4], sketch(s)

    return row


def _whole(i, s):
    return signature(s), len(s), s


def candidates(docs: DataFrame, j: Join) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (id, text, tag) the tables that the comparison of whole sets needs.

    ``mapped``: (id, tag, n, sid) of every row, sid being the number of its set (null
    without words or an id); ``groups``: (sid, n, rep), rep being the smallest id of a set;
    ``pairs``: (a, b) of sets that short lists leave open; ``long``: (key, sid, m, tie) of the
    lists of m > SHORT sets, tie being the smallest of them.
    """
    sc = docs.sparkSession.sparkContext
    sigs = _sets(docs, j, "tag long, id long, sid long, n long, toks array<long>, sketch array<long>", _first_tokens(j))
    sigs = saved(sigs.withColumn("row", F.monotonically_increasing_id()), "jaccard-sigs")
    some = sigs.filter("n > 0 AND id IS NOT NULL")
    groups = saved(some.groupBy("sid").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.min("row").alias("row")), "jaccard-groups")
    mapped = saved(sigs.select("id", "tag", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("sid")).alias("sid")), "jaccard-map")
    first = saved(sigs.join(groups.select("row"), "row", "left_semi").select("sid", "n", "toks", "sketch"), "jaccard-first")
    drop(sigs)

    # sets that a token has, counted over the beginnings of all sets
    counted = saved(first.select(F.explode("toks").alias("t")).groupBy("t").count().filter("count > 1"), "jaccard-df")
    over = lambda *tables: [t.filter(F.col("count") > FREQUENT) for t in tables]
    frequent = sc.broadcast(bitmap(over(counted)[0].select("t")))
    hot = _hot(first, frequent, j)
    full = "sid long, n long, toks array<long>"

    def whole(sids: DataFrame) -> DataFrame:
        reps = sc.broadcast(bitmap(groups.join(sids, "sid", "left_semi").select("rep")))
        return _sets(docs.select("id", "text"), j, full, _whole, reps).join(sids, "sid", "left_semi").dropDuplicates(["sid"])

    # sets made of frequent tokens are counted whole
    hot_sets = saved(whole(hot), "jaccard-hot")
    counted_hot = saved(hot_sets.select(F.explode("toks").alias("t")).groupBy("t").count(), "jaccard-df-hot")
    a, b = over(counted, counted_hot)
    often = saved(a.union(b).groupBy("t").agg(F.max("count").alias("count")), "jaccard-often")
    frequent = sc.broadcast(bitmap(often.select("t")))
    very = sc.broadcast(bitmap(often.filter(F.col("count") > VERY_FREQUENT).select("t")))
    hot2 = _hot(first, frequent, j)
    more = saved(hot2.join(hot, "sid", "left_anti"), "jaccard-hot-ids")
    more_sets = saved(whole(more), "jaccard-hot")
    # a rare token matters if two beginnings have it or a hot set does
    twice = counted.select("t").union(counted_hot.select("t")).union(more_sets.select(F.explode("toks").alias("t")))
    twice = sc.broadcast(bitmap(twice))
    all_hot = hot_sets.union(more_sets)
    post = _postings(first.join(all_hot.select("sid"), "sid", "left_anti"), frequent, very, twice, j).union(_postings(all_hot, frequent, very, twice, j))
    post = saved(post, "jaccard-postings")
    drop(counted, counted_hot, often, hot, hot2, more, hot_sets, more_sets)

    lists = saved(post.groupBy("key").agg(F.count("*").alias("m"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("m > 1"), "jaccard-lists")
    own = post.join(lists.filter(F.col("m").between(3, SHORT)).select("key"), "key", "left_semi").groupBy("key")
    # many keys have the same sets
    own = own.agg(F.sort_array(F.collect_list("sid")).alias("sids")).select("sids").distinct()
    own = own.select("sids", F.explode("sids").alias("a")).select("a", F.explode(F.filter("sids", lambda x: x > F.col("a"))).alias("b"))
    tried = lists.filter("m = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(own).distinct()
    side = lambda x: first.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))
    near_ = tried.join(side("b"), "b").join(side("a"), "a").filter(near(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"), j))
    pairs = saved(near_.select("a", "b"), "jaccard-pairs")
    long = lists.filter(F.col("m") > SHORT).select("key", "m", F.col("lo").alias("tie"))
    long = F.broadcast(long) if long.limit(FEW_LISTS + 1).count() <= FEW_LISTS else long
    long = saved(post.join(long, "key").select("key", "sid", "m", "tie"), "jaccard-long")
    drop(post, lists, first)
    return mapped, groups, pairs, long


def _hot(first: DataFrame, frequent, j: Join) -> DataFrame:
    """Numbers of the sets whose kept beginning has too few rare tokens for a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            toks = b.column(2)
            size = toks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rare = ~frequent.value.has(toks.flatten().to_numpy(zero_copy_only=False))
            edge = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[0], np.cumsum(rare)])
            n = b.column(1).to_numpy(zero_copy_only=False)
            short = total[edge[1:]] - total[edge[:-1]] < j.missing(n) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(short))], names=["sid"])

    return saved(first.select("sid", "n", "toks").mapInArrow(run, "sid long"), "jaccard-hot-ids")


def _postings(sets: DataFrame, frequent, very, twice, j: Join) -> DataFrame:
    """(key, sid) of every set; rare tokens that occur once are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            out, sids = [], []
            for i, n, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = toks.values.to_numpy(zero_copy_only=False)
                often = frequent.value.has(t)
                rare, combined = prefix_keys(t, often + (often & very.value.has(t)).astype(np.int64), n, j)
                k = np.concatenate([rare[twice.value.has(rare)], combined])
                out.append(k)
                sids.append(np.full(len(k), i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out, sids)], names=["key", "sid"])

    return sets.select("sid", "n", "toks").mapInArrow(run, "key long, sid long")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens' hashes over a power of two of places, as 64-bit words.

    Two sketches differ in at most as many places as the sets have tokens
    apart; folding the halves of one together gives the sketch of half the size.
    """
    places = max(64, 1 << int(len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = mix(tokens.view(np.uint64) ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(places - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=places) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def near(na, nb, xa, xb, j: Join):
    """Whether sizes and sketches leave it open that two sets are linked."""
    n = F.least(F.size(xa), F.size(xb))
    fold = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    apart = F.aggregate(F.zip_with(fold(xa), fold(xb), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    common = F.ceil((na + nb) * j.num / (j.num + j.den))
    return (na * j.den >= nb * j.num) & (nb * j.den >= na * j.num) & (F.size(xa) <= 2 * n) & (F.size(xb) <= 2 * n) & (apart <= na + nb - 2 * common)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of the nodes of edges (a, b): the smallest id of each node's component.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so that long chains shorten by half; every round is a written
    table, and the loop ends when no label changes.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "components-edges")
    label = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "components")
    while True:
        around = both.join(label.withColumnsRenamed({"id": "b", "comp": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        nearer = label.join(around, "id").select("id", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        step = saved(nearer.join(up, "comp", "left").select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "components")
        drop(label)
        label = step.select("id", "comp")
        label._lakelens_path = step._lakelens_path
        if step.filter("comp != was").isEmpty():
            drop(both)
            return label


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right (rows: left)."""
    sides = []
    for sets in (left, right):
        tokens, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        sides.append((tokens[order], rows[order]))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), WIDTH):
        part = shared[at : at + WIDTH]
        dense = []
        for (tokens, rows), sets in zip(sides, (left, right)):
            lo, hi = np.searchsorted(tokens, part[0], "left"), np.searchsorted(tokens, part[-1], "right")
            place = np.searchsorted(part, tokens[lo:hi])
            own = part[place] == tokens[lo:hi]
            x = np.zeros((len(sets), len(part)), np.float32)
            x[rows[lo:hi][own], place[own]] = 1
            dense.append(x)
        common += (dense[0] @ dense[1].T).astype(np.int64)
    return common


def _linked(left: list[np.ndarray], right: list[np.ndarray], j: Join) -> np.ndarray:
    """Whether each set on the left is linked with each on the right."""
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    common = common_counts(left, right)
    return common * j.den >= (na[:, None] + nb[None, :] - common) * j.num


def _cell(sids: list[int], before: list[bool], sets: list[np.ndarray], inside: bool, j: Join, links: bool) -> Iterator[tuple[int, int, int]]:
    """(sid, n_links, root) of the linked sets of a cell: links inside its one block, or between its two.

    Without ``links`` n_links is 0, and sets already in one component are not compared.
    """
    nodes = np.array([k for k, x in enumerate(before) if x] + [k for k, x in enumerate(before) if not x and not inside], np.int64)
    everyone = np.arange(len(nodes))
    n_left = sum(before)
    left, right = everyone[:n_left], everyone[:n_left] if inside else everyone[n_left:]
    if not len(left) or not len(right) or inside and len(left) < 2:
        return
    parent, degree = everyone.copy(), np.zeros(len(nodes), np.int64)

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        others = [sets[x] for x in nodes[b]]
        for at in range(0, len(a) if len(b) else 0, 512):
            part = a[at : at + 512]
            i, k = np.nonzero(_linked([sets[x] for x in nodes[part]], others, j))
            i, k = part[i], b[k]
            apart = i != k
            i, k = i[apart], k[apart]
            if links:  # all pairs of the cell meet once, inside a block from either end
                degree[:] += np.bincount(i, minlength=len(nodes)) + (0 if inside else np.bincount(k, minlength=len(nodes)))
            unite(parent, i, k)

    if links:
        meet(left, right)
    else:
        done = np.zeros(len(nodes), bool)
        first = left[:PIVOTS]
        meet(first, right)
        done[first] = True
        while True:
            root = find(parent, everyone)
            grown = ~done & np.isin(root, root[done])
            if not grown.any():
                break
            for r in np.unique(root[grown]):
                for own, other in ((left, right),) if inside else ((left, right), (right, left)):
                    meet(own[grown[own] & (root[own] == r)], other[root[other] != r])
            done |= grown
        # what no component has reached was compared with all that some has
        meet(left[~done[left]], right[~done[right]])
    root = find(parent, everyone)
    own = np.array(sids, np.int64)[nodes]
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, own)
    for x in np.flatnonzero(np.bincount(root, minlength=len(nodes))[root] > 1):
        yield int(own[x]), int(degree[x]), int(least[root[x]])


def _cells(rows: DataFrame, j: Join, links: bool) -> DataFrame:
    """(sid, n_links, root) of every cell of rows (lo, hi, before, sid, toks)."""
    rows = rows.select("lo", "hi", "before", "sid", "toks").repartition("lo", "hi").sortWithinPartitions("lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(key, held):
            out = list(_cell(*map(list, zip(*held)), key[0] == key[1], j, links))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["sid", "n_links", "root"])

        key, held = None, []
        for b in slices(batches, 512):
            for *k, before, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4)):
                if k != key and held:
                    yield result(key, held)
                    held = []
                key = k
                held.append((i, before, t.values.to_numpy(zero_copy_only=False).copy()))
        if held:
            yield result(key, held)

    return rows.mapInArrow(run, "sid long, n_links long, root long")


def _blocks(n_sets, n_tokens):
    """Blocks for so many sets of so many tokens together."""
    width = F.least(F.greatest(n_sets / 16, F.lit(BLOCK_SETS)), F.lit(8 * BLOCK_SETS))
    return F.ceil(F.greatest(n_sets / width, n_tokens / BLOCK_TOKENS)).cast("long")


def linked(docs: DataFrame, groups: DataFrame, pairs: DataFrame, long: DataFrame, j: Join, links: bool = True) -> DataFrame:
    """(sid, root, n_links) of the sets that link with others: smallest set reachable, and links to different sets (0 without ``links``)."""
    terr = components(pairs.union(long.filter("sid != tie").select("sid", "tie").distinct()))
    members = groups.join(terr.select(F.col("id").alias("sid"), F.col("comp").alias("terr")), "sid").select("sid", "n", "rep", "terr")
    size = members.groupBy("terr").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    members = saved(members.join(size.select("terr", _blocks(F.col("m"), F.col("tokens")).alias("blocks")), "terr"), "jaccard-members")
    # territories of several blocks: in those of many, a set's home is its longest list, and blocks are parts of a home
    several = members.filter("blocks > 1")
    at = long.join(several.filter(F.col("blocks") > WHOLE).select("sid"), "sid", "left_semi")
    home = several.join(at.groupBy("sid").agg(F.max_by("key", F.struct("m", "key")).alias("home")), "sid", "left")
    home = home.select("sid", "n", "rep", "terr", "blocks", F.coalesce("home", F.lit(0)).alias("home"))
    parts = home.groupBy("terr", "home").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).select("terr", "home", _blocks(F.col("m"), F.col("tokens")).alias("parts"))
    block = F.xxhash64("terr", "home", F.pmod(F.xxhash64(F.lit(3), "sid"), "parts")).alias("block")
    home = saved(home.join(parts, ["terr", "home"]).select("sid", "rep", "terr", (F.col("blocks") <= WHOLE).alias("all"), block), "jaccard-home")
    # blocks meet all others of a territory of few, else those that share a long list or an open pair
    shared = at.select("key", "sid").join(home.select("sid", "block"), "sid").select("key", "block")
    shared = shared.union(home.filter("all").select("terr", "block")).distinct()
    met = shared.join(shared.withColumnRenamed("block", "hi"), "key").filter("block <= hi").select(F.col("block").alias("lo"), "hi")
    ends = lambda x: home.filter("NOT all").select(F.col("sid").alias(x), F.col("block").alias(f"at{x}"))
    drawn = pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.least("ata", "atb").alias("lo"), F.greatest("ata", "atb").alias("hi"))
    met = saved(met.union(drawn).distinct(), "jaccard-cells")
    sides = met.select("lo", "hi", F.col("lo").alias("block"), F.lit(True).alias("before")).union(met.filter("lo != hi").select("lo", "hi", F.col("hi").alias("block"), F.lit(False).alias("before")))
    # every set of a territory once

    def whole(of: DataFrame) -> DataFrame:
        reps = docs.sparkSession.sparkContext.broadcast(bitmap(of.select("rep")))
        toks = _sets(docs.select("id", "text"), j, "sid long, n long, toks array<long>", _whole, reps).select("sid", "toks")
        return toks.join(of.drop("rep"), "sid").dropDuplicates(["sid"])

    alone = whole(members.filter("blocks = 1").select("sid", "terr", "rep"))
    alone = _cells(alone.select(F.col("terr").alias("lo"), F.col("terr").alias("hi"), F.lit(True).alias("before"), "sid", "toks"), j, links)
    alone = saved(alone, "jaccard-linked")
    if met.isEmpty():
        drop(members, home, met)
        return alone.select("sid", "root", "n_links")
    apart = saved(_cells(whole(home.select("sid", "rep", "block")).join(sides, "block"), j, links), "jaccard-linked")
    roots = components(apart.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    added = apart.groupBy("sid").agg(F.sum("n_links").alias("n_links")).join(roots.select(F.col("id").alias("sid"), F.col("comp").alias("root")), "sid")
    out = saved(alone.select("sid", "root", "n_links").union(added.select("sid", "root", "n_links")), "jaccard-linked")
    drop(members, home, met, apart, alone)
    return out


def classes(docs: DataFrame, j: Join = Join(), id_col: str = "doc_id", text_col: str = "text", with_links: bool = True, tag_col: str | None = None) -> DataFrame:
    """Near-duplicate class of every document: id, ``n_shingles``, ``component_id``, ``n_links`` and ``class_id``.

    A document's set is its distinct ``width``-word shingles of the text with
    A-Z lower-cased (fewer words: the whole sequence; no words or a null text:
    empty, linked with nothing). Two documents link if num/den of the union is
    common. ``component_id`` is the smallest id reachable by links;
    ``n_links`` counts all other sets that a document's set links with
    (left out if ``with_links`` is false); ``class_id`` is a number that the
    rows of one class share, null for a row without words or an id. One row
    comes out for each row that goes in; repeated rows, and rows of one id with
    other texts, are judged by their own text; a row without an id has a null
    ``component_id``. A long column ``tag_col`` comes out as it went in; other
    extra columns are ignored; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    tag = F.col(tag_col).cast("long") if tag_col else F.lit(0).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), tag.alias("tag"))
    mapped, groups, pairs, long = candidates(src, j)
    found = linked(src, groups, pairs, long, j, with_links)
    least = found.join(groups, "sid").groupBy("root").agg(F.min("rep").alias("comp"))
    of = groups.select("sid", "rep").join(found.join(least, "root").select("sid", "root", "comp", "n_links"), "sid", "left")
    of = of.select("sid", F.coalesce("root", "sid").alias("class_id"), F.coalesce("comp", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = mapped.join(saved(of, "jaccard-classes"), "sid", "left")
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if with_links else []
    tags = [F.col("tag").alias(tag_col)] if tag_col else []
    return out.select(F.col("id").alias(id_col), *tags, F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), *n_links, "class_id")
