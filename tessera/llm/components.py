"""Connected components of a distributed set of links, and the pairing of members of hash buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, forget, mix, settle, slices

SLOTS, SMALL = 1 << 18, 16
#: Longs of a set's parity map, and different orders in which buckets choose the member that the others meet.
LONGS, ORDERS = 16, 4
#: Records of buckets that a task deals at a time; so many of one bucket among them are linked there; the mark of one that stands for them.
RUN_KEYS, HOT, OF_HOT = 1 << 19, 256, np.uint8(128)
#: Links, 16 bytes each, that a task contracts at a time.
TASK_LINKS = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes that are not smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: u.size], at[u.size :]
    label = np.arange(nodes.size)
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        open_ = low != high
        if not open_.any():
            break
        u, v = u[open_], v[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    inner = label != np.arange(nodes.size)
    return nodes[inner], nodes[label[inner]]


def _contracted(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    node, root = roots(np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", *spent: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node. Settled; spent as for settle.

    Links are dealt to tasks, TASK_LINKS each or about that, which contract theirs to one link for each node. If that
    took more than one task, distributed union-find by alternating large and small stars goes on until nothing changes.
    Every round aggregates by minimum, which combines before the shuffle, so a node with very many neighbours needs no
    task of its own.
    """
    edges = settle(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), *spent)
    tasks = max(1, -(-edges.count() // TASK_LINKS))
    dealt = edges.select("u", "v").repartition(tasks) if tasks > 1 else edges.select("u", "v").coalesce(1)
    edges = settle(dealt.mapInArrow(_contracted, "u long, v long").distinct(), edges)
    before = None
    while tasks > 1:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least, edges)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own).distinct(), edges)


def _met(bucket: np.ndarray, key: np.ndarray, uid: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The place of the member that all others of its bucket meet, for each bucket; bucket: rising numbers from 0."""
    order = key & U(ORDERS - 1)
    rank = (np.where(order == 0, U(0), rarity.astype(np.uint64)) << U(57)) + (mix(uid.astype(np.uint64) ^ mix(order + U(0x51A2))) >> U(7))
    by = np.lexsort((rank, bucket))
    return by[np.searchsorted(bucket, np.arange(bucket[-1] + 1 if bucket.size else 0))]


def _stars(key: np.ndarray, uid: np.ndarray, rarity: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, bucket of each, met of each, place of each bucket's met) of the buckets that begin at start, in records by key."""
    bucket = np.repeat(np.arange(size.size), size)
    at = np.arange(bucket.size) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if size.size else bucket
    met = at[_met(bucket, key[at], uid[at], rarity[at])]
    return at, bucket, uid[met][bucket], met


def _links(uid: np.ndarray, met: np.ndarray, key: np.ndarray, member: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """x, y, n: pairs without n; of buckets whose members are wanted key, uid and n."""
    pair = np.unique(np.stack([np.minimum(uid, met), np.maximum(uid, met)])[:, uid != met], axis=1) if uid.size else np.zeros((2, 0), np.int64)
    none = pa.nulls(pair.shape[1], pa.int64())
    return [pa.array(np.concatenate([pair[0], key.view(np.int64)])), pa.array(np.concatenate([pair[1], member])), pa.concat_arrays([none, pa.array(n, pa.int64())])]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, key.size))


DEALT = ["p", "records", "x", "y", "n"]


def dealt(parts: int):
    """(p, records) for each run of rows (uid, n, copies, keys) and part p of the keys; (x, y, n), in any part, of HOT buckets.

    Records are longs: all keys, all uids, all n; then a byte each: how rare (63 less the power of two of copies), or OF_HOT.
    """

    def deal(key, uid, n, rarity):
        by = np.argsort(key)
        key, uid, n, rarity = key[by], uid[by], n[by], rarity[by]
        start, size = _runs(key)
        hot = size >= HOT
        if hot.any():
            at, bucket, met, first = _stars(key, uid, rarity, start[hot], size[hot])
            gone = np.zeros(key.size, bool)
            gone[at] = True
            gone[first] = False
            out = _links(uid[at], met, key[gone], uid[gone], n[gone])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out[0])) % parts, pa.int32()), pa.nulls(len(out[0]), pa.binary()), *out], DEALT)
            rarity[first] |= OF_HOT
            key, uid, n, rarity = key[~gone], uid[~gone], n[~gone], rarity[~gone]
        bounds = np.searchsorted(((key >> U(32)) * U(parts)) >> U(32), np.arange(parts + 1).astype(np.uint64))
        there = np.flatnonzero(np.diff(bounds))
        records = [b"".join(x[bounds[p] : bounds[p + 1]].tobytes() for x in (key, uid, n, rarity)) for p in there]
        none = pa.nulls(there.size, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(records, pa.binary()), none, none, none], DEALT)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            keys = batch.column(3)
            times = np.diff(np.asarray(keys.offsets))
            uid, n, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            rarity = (63 - np.floor(np.log2(np.maximum(copies, 1)))).astype(np.uint8)
            held.append((keys.flatten().to_numpy().view(np.uint64), np.repeat(uid, times), np.repeat(n, times), np.repeat(rarity, times)))
            size += held[-1][0].size
            if size >= RUN_KEYS:
                yield from deal(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from deal(*map(np.concatenate, zip(*held)))

    return run


def _gathered(batches):
    """(x, y, n) as from _links of all records of a task, (p, records, x, y, n); rows without records as they are."""
    held = []
    for batch in batches:
        linked = batch.filter(batch.column(1).is_null())
        if linked.num_rows:
            yield linked.select(["x", "y", "n"])
        for x in batch.column(1).drop_null():
            own = np.frombuffer(x.as_buffer(), np.uint8)
            k = own.size // 25
            held.append((own[: 8 * k].view(np.uint64), own[8 * k : 16 * k].view(np.int64), own[16 * k : 24 * k].view(np.int64), own[24 * k :]))
    if not held:
        return
    key, uid, n, rarity = map(np.concatenate, zip(*held))
    del held
    by = np.argsort(key)
    again = key[by]
    again = again[1:] == again[:-1]
    shared = np.zeros(key.size, bool)
    shared[:-1] |= again
    shared[1:] |= again
    by = by[shared | (rarity[by] >= OF_HOT)]  # what stands alone in its bucket is most of all
    key, uid, n, rarity = key[by], uid[by], n[by], rarity[by]
    start, size = _runs(key)
    of_hot = np.maximum.reduceat(rarity, start) >= OF_HOT if start.size else np.zeros(0, bool)
    _, bucket, met, _ = _stars(key, uid, rarity & (OF_HOT - 1), start, size)
    large = (of_hot | (size > 2))[bucket]
    yield pa.RecordBatch.from_arrays(_links(uid, met, key[large], uid[large], n[large]), ["x", "y", "n"])


def bucket_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b), a < b, of every bucket's members with one of them; (key, uid, n) of buckets over two.

    rows: (uid, n, copies, keys), a row in a bucket for each of its keys, evenly spread 64-bit hashes. Most stand alone
    there; so records of buckets are dealt in packed form, once, to a task for each part of the keys, which sorts them.
    Of a bucket that has HOT records or more in a run of RUN_KEYS, the run's task links them to one of them and passes
    on that one alone, so a bucket is at most HOT records a run to the task of its part. The one that all meet is the
    first in one of ORDERS orders, which the key picks: one unlucky choice, say of a text far from the others, then does
    not hold for every bucket. In all orders but one, what is copied most (by powers of two) comes first: where texts
    are changed copies of one that is there itself, each is nearer to that one than to the others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ints = rows.select("uid", F.col("n").cast("long"), F.col("copies").cast("long"), "keys")
    return linked(ints.mapInArrow(dealt(parts), "p int, records binary, x long, y long, n long"), parts)


def linked(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """bucket_pairs of what dealt(parts) made of them."""
    found = settle(rows.repartitionById(parts, F.col("p")).mapInArrow(_gathered, "x long, y long, n long"))
    pairs = settle(found.where("n IS NULL").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    members = settle(found.where("n IS NOT NULL").select(F.col("x").alias("key"), F.col("y").alias("uid"), "n"), found)
    return pairs, members


def crossing(members: DataFrame, parts: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, inside) of bucket members that stand in different components: what is left to compare after bucket_pairs.

    members: (key, uid, n) of buckets over two. Members of one component need no further pair; a bucket whose members
    all stand in one yields nothing, whatever its size. Of the others, buckets of up to SMALL members give all pairs
    (a, b), a < b, of different components whose sizes allow the ratio, which is at most SMALL rows a member. Members
    of larger ones, (uid, part), are for prefix_pairs, whose rows do not grow with the square of a bucket.
    """
    in_part = members.join(parts.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("part"))
    mixed = in_part.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).where("lo != hi").select("key", "members")
    own = settle(in_part.join(mixed, "key"))
    x, y = own.where(F.col("members") <= SMALL).alias("x"), own.where(F.col("members") <= SMALL).alias("y")
    near = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(ratio - 1e-9)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.uid") < F.col("y.uid")) & (F.col("x.part") != F.col("y.part")) & near)
    pairs = settle(pairs.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct())
    return pairs, settle(own.where(F.col("members") > SMALL).select("uid", "part").distinct(), own)


def _frequencies(batches):
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in slices(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False), 8 * SLOTS):
            every = b"".join(batch.column(0)[part].to_pylist())
            total += np.bincount((np.frombuffer(every, np.uint64) >> np.uint64(64 - 18)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["slot", "n"])


def _prefixes(often, ratio: float):
    def run(batches):
        for batch in batches:
            sizes, tokens, maps = [], [], []
            for x in batch.column(2):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                n = own.size - int(np.ceil(ratio * own.size - 1e-9)) + 1 if own.size else 0
                rare = np.lexsort((own, often.value[(own >> np.uint64(64 - 18)).astype(np.int64)]))[:n]
                odd = np.bincount((own & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
                sizes.append(own.size)
                tokens.append(own[rare].view(np.int64))
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], ["uid", "part", "n", "tokens", "map"]
            )

    return run


def prefixed(rows: DataFrame, ratio: float) -> DataFrame:
    """(uid, part, n, tokens, map): the sets' sizes, prefixes and maps. Settled.

    rows: (uid, part, shingles), the last sorted distinct 64-bit elements. Sets of a Jaccard similarity of ratio or
    more share one of their n - ceil(ratio n) + 1 first elements in any common order, so no such pair is lost. The
    order is by rising frequency: what many sets hold comes last and in few prefixes, so a passage that thousands
    share brings no pairs about. Frequencies are sums over SLOTS hash slots, which bounds what is broadcast.

    A set's map has a bit for each residue of its elements: whether their number is odd. Where two maps differ, the sets
    differ in an element at least, so sets whose maps differ in more bits than the ratio allows elements are not similar:
    such pairs never leave the join, and no similar one is lost.
    """
    often = np.zeros(SLOTS, np.int64)
    for r in rows.select("shingles").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        often[r["slot"]] = r["n"]
    often = rows.sparkSession.sparkContext.broadcast(often)
    return settle(rows.select("uid", "part", "shingles").mapInArrow(_prefixes(often, ratio), "uid long, part long, n long, tokens array<long>, map array<long>"))


def _each(sets: DataFrame) -> DataFrame:
    """A row for each token of a prefix, made where it is needed: sets are far fewer to store and to join with their parts."""
    return sets.select("uid", "part", F.explode("tokens").alias("token"))


def _info(sets: DataFrame) -> DataFrame:
    return sets.select("uid", "part", "n", *[F.col("map")[k].alias(f"m{k}") for k in range(LONGS)])


def _near(ratio: float):
    """Whether x and y, (part, n, m0, ...), stand in different parts and may be similar by sizes and maps."""
    near = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(ratio - 1e-9)
    differ = [F.bit_count(F.col(f"x.m{k}").bitwiseXOR(F.col(f"y.m{k}"))) for k in range(LONGS)]
    most = (F.col("x.n") + F.col("y.n")) * F.lit((1 - ratio) / (1 + ratio)) + F.lit(1e-6)
    some = sum(differ[1 : LONGS // 4], differ[0]) <= most  # what already differs too much in a part needs no look at the rest
    return (F.col("x.part") != F.col("y.part")) & near & some & (sum(differ[1:], differ[0]) <= most)


def star_pairs(sets: DataFrame, ratio: float, turn: int = 0, rows: int | None = None) -> DataFrame:
    """Of each token's sets, the pairs (a, b) of one, which token and turn pick, with the others of other parts.

    rows: how many tokens the prefixes have. There are fewer of them than rows: sets that already stand in the part of the one they meet leave with the first join.
    """
    each, info, mask = _each(sets), _info(sets), F.xxhash64("token", F.lit(turn))
    rank = F.col("uid").bitwiseXOR(mask)
    met = each.groupBy("token").agg(F.min(rank).alias("met"), F.min_by("part", rank).alias("met_part"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    met = met.where("lo != hi").select("token", F.col("met").bitwiseXOR(mask).alias("met"), "met_part")
    met = settle(met, rows=rows)  # so that the join's shuffle can split a hot token
    pairs = each.alias("e").join(met.alias("m"), (F.col("e.token") == F.col("m.token")) & (F.col("e.part") != F.col("m.met_part")))
    pairs = pairs.select(F.least("uid", "met").alias("a"), F.greatest("uid", "met").alias("b")).distinct()
    some = pairs.join(info.alias("x"), F.col("a") == F.col("x.uid")).join(info.alias("y"), F.col("b") == F.col("y.uid"))
    # settled, since an anti join that follows would else be pushed below these joins, to all rows of the tokens
    return settle(some.where(_near(ratio)).select("a", "b"), met, rows=rows)


def all_pairs(sets: DataFrame, ratio: float, rows: int | None = None) -> DataFrame:
    """(a, b) with a < b of different parts that share a token, and whose sizes and maps allow the ratio; rows as for star_pairs."""
    each = _each(sets)
    mixed = each.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("token")
    mixed = settle(mixed, rows=rows)  # so that the join's shuffle can split a hot token
    each = settle(each.select("uid", "token").join(mixed, "token"), mixed, rows=rows)
    wide = settle(each.join(_info(sets), "uid"), each)
    x, y = wide.alias("x"), wide.hint("merge").alias("y")  # a hot token's rows are read in turn, not looked up
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.uid") < F.col("y.uid")) & _near(ratio))
    return settle(pairs.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct(), wide)


def prefix_pairs(rows: DataFrame, ratio: float) -> DataFrame:
    """(a, b) with a < b of different parts among which are all pairs of that similarity; rows as for prefixed."""
    return all_pairs(prefixed(rows, ratio), ratio)


def _in_parts(x: DataFrame, parts: DataFrame) -> DataFrame:
    own = parts.withColumnRenamed("node", "uid")
    return x.drop("part").join(own, "uid", "left").withColumn("part", F.coalesce("component", "uid")).drop("component")


def completed(pairs: DataFrame, links: DataFrame, members: DataFrame, sizes: float, ratio: float, rows_of, verify) -> DataFrame:
    """(node, component) by links and all further ones between members of one bucket; both as from bucket_pairs.

    sizes: the ratio that n of similar members has at least. rows_of(inside) gives (uid, part, shingles), verify(pairs)
    the similar ones, settled. Tokens' stars come first, with other centres in every turn, as long as a turn still links
    a tenth of the sets: they join most of what is left with as many pairs as rows, so that the last step, which
    compares all sets of a token, has few different parts to compare. All settled tables that are given are deleted when
    nothing reads them any more.
    """
    parts = components(links)
    some, inside = crossing(members, parts, sizes)
    forget(members)
    tried, sets, turn, count, tokens = settle(some.join(pairs, ["a", "b"], "left_anti"), some), None, 0, 0, 0
    if not inside.isEmpty():
        own = rows_of(inside)
        sets = prefixed(own, ratio)
        forget(own)
        count, tokens = sets.agg(F.count("*"), F.sum(F.size("tokens"))).first()
        stars = star_pairs(sets, ratio, 0, tokens)
        tried = settle(tried.union(stars.join(pairs, ["a", "b"], "left_anti")).distinct(), tried, stars)
    forget(inside)
    new = tried
    tried = settle(pairs.union(new), pairs)  # what need not be compared again
    while not new.isEmpty():
        more = verify(new)
        n = more.count()
        if n:
            links = settle(links.union(more), links, more)
            forget(parts)
            parts = components(links)
        if sets is None or 10 * n < count:
            break
        turn += 1
        sets = settle(_in_parts(sets, parts), sets)
        stars, spent = star_pairs(sets, ratio, turn, tokens), new
        new = settle(stars.join(tried, ["a", "b"], "left_anti").distinct(), stars)
        forget(spent)
        tried = settle(tried.union(new), tried)
    if sets is not None:
        sets = settle(_in_parts(sets, parts), sets)
        found = all_pairs(sets, ratio, tokens)
        rest = settle(found.join(tried, ["a", "b"], "left_anti"), found, sets)
        if not rest.isEmpty():
            more = verify(rest)
            if not more.isEmpty():
                forget(parts)
                parts = components(links.union(more))
            forget(more)
        forget(rest)
    forget(links, new, tried)
    return parts
