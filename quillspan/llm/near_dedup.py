"""Near-duplicate classes by BagMinHash signatures over multisets of five-word shingles.

Counts are cut at powers of two into weight intervals. Every (shingle, interval) drives a Poisson
process of the interval's width, whose points fall on random signature places; where a
count ends inside an interval, points are split by halves until they lie inside or outside.
The smallest point of each place agrees between two texts with the probability of their weighted
Jaccard similarity. Bands of the signature gather buckets, in which the multiset overlap decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import less, maybe_in, stored, table, whole_rows

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4  # a pair at 0.8 shares no band with a chance of 5e-8
PLACES = BANDS * ROWS
CHUNK = 1 << 19  # bytes of text at once
BUCKET = 2048  # members that are compared in one task
#: Shares of a bag before the rarest code it has in common with a similar bag: of any, and of one that is not smaller.
PROBE, INDEX = 1 - SIMILAR, (1 - SIMILAR) / (1 + SIMILAR)
U = np.uint64
_word = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_low = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie in one buffer from at[i] to at[i + 1], and the text of each."""
    is_word = _word[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    first[cuts] = is_word[cuts]
    inside, starts = np.flatnonzero(is_word), np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U), np.empty(0, np.int64)
    begins = np.flatnonzero(first[inside])
    length = np.diff(np.r_[begins, len(inside)])
    place = np.arange(len(inside)) - np.repeat(begins, length)
    power = np.cumprod(np.r_[U(1), np.full(int(length.max()), U(0x9E3779B97F4A7C15))])
    h = np.add.reduceat((_low[data[inside]] + U(1)) * power[place], begins)
    return _mix(h + length.astype(U)), np.searchsorted(at, starts, "right") - 1


def _shingles(words: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their text and count, sorted by text; fewer than five words are one shingle."""
    n = np.bincount(doc, minlength=docs)
    begin = np.cumsum(n) - n
    size = np.minimum(n, SHINGLE)
    many = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(docs), many)
    start = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    s = np.zeros(len(owner), U)
    padded = np.r_[words, np.zeros(SHINGLE, U)]
    for i in range(SHINGLE):
        s = np.where(size[owner] > i, _mix(s * U(0x2545F4914F6CDD1D) + padded[start + i]), s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])]) if len(s) else np.empty(0, np.int64)
    return s[new], owner[new], np.diff(np.r_[new, len(s)])


def _intervals(s: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, width, covered units) of each weight interval [0,1), [1,2), [2,4), [4,8) ... that a count reaches into."""
    keys, docs, widths, covered = [], [], [], []
    low, width, level = 0, 1, 0
    while len(s):
        keys.append(_mix(s + U(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
        docs.append(doc)
        widths.append(np.full(len(s), width))
        covered.append(np.minimum(count - low, width))
        low += width
        more = count > low
        s, doc, count = s[more], doc[more], count[more]
        width, level = low, level + 1
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, docs, widths, covered))


def _inside(mark: np.ndarray, width: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Whether points lie in the covered part of their intervals: each is sent to a half by a bit of its mark, and that half
    is split again until it lies wholly inside or outside."""
    out = np.zeros(len(mark), bool)
    at, half, covered = np.arange(len(mark)), width // 2, covered.copy()
    while len(at):
        upper = (mark & U(1)).astype(bool)
        out[at[~upper & (covered >= half)]] = True
        on = np.where(upper, covered > half, covered < half)
        covered = np.where(upper, covered - half, covered)[on]
        at, half, mark = at[on], half[on] // 2, mark[on] >> U(1)
    return out


def bag_minhash(s: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int) -> np.ndarray:
    """The smallest point of every place and text; a process ends when it is past its text's largest minimum."""
    sig = np.full((docs, PLACES), np.inf)
    flat = sig.reshape(-1)
    key, doc, width, covered = _intervals(s, doc, count)
    time, step = np.zeros(len(key)), 0
    unit = 2.0**-53
    while len(key):
        step += 1
        r = _mix(key + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> U(11)).astype(float) + 1) * unit) / width
        r = _mix(r)
        place, hit = (r % U(PLACES)).astype(np.int64), np.ones(len(r), bool)
        part = covered < width
        if part.any():
            hit[part] = _inside(_mix(r[part] + U(1)), width[part], covered[part])
        np.minimum.at(flat, doc[hit] * PLACES + place[hit], time[hit])
        go = time < sig.max(axis=1)[doc]
        key, doc, width, covered, time = key[go], doc[go], width[go], covered[go], time[go]
    return sig


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Slices of batches of about CHUNK bytes of their last column, ``text``, with the shingles of their texts."""
    for b in batches:
        text = b.column(b.num_columns - 1).cast(pa.string()).fill_null("")
        size = np.cumsum([0, *pc.binary_length(text).to_pylist()])
        a = 0
        while a < len(text):
            z = max(a + 1, int(np.searchsorted(size, size[a] + CHUNK, "right")) - 1)
            some = pa.concat_arrays([text.slice(a, z - a)])
            at = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + z - a + 1].astype(np.int64)
            data = np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[-1]] if some.buffers()[2] else np.empty(0, np.uint8)
            yield b.slice(a, z - a), _shingles(*_word_hashes(data, at - at[0]), z - a)
            a = z


def _multiset(s: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int) -> list[pa.Array]:
    """Two 64-bit keys of each text's multiset."""
    k1, k2 = np.zeros(docs, U), np.zeros(docs, U)
    np.add.at(k1, doc, _mix(s ^ _mix(count.astype(U))))
    np.add.at(k2, doc, _mix(s + _mix(count.astype(U) + U(7))))
    return [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, (s, doc, count) in _parts(batches):
        docs = b.num_rows
        n = np.bincount(doc, count, docs).astype(np.int64)
        sig = bag_minhash(s, doc, count, docs).view(U).reshape(docs, BANDS, ROWS)
        band = np.broadcast_to(np.arange(BANDS, dtype=U) + U(1), (docs, BANDS)).copy()
        for i in range(ROWS):
            band = _mix(band * U(0x2545F4914F6CDD1D) + sig[:, :, i])
        has = n > 0
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, BANDS, 0))], pa.int32()), pa.array(band[has].reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *_multiset(s, doc, count, docs), bands], ["doc_id", "h", "n", "k1", "k2", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n (shingles), k1 and k2 (of the multiset), and bands."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, h bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_signatures, schema)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, (s, doc, count) in _parts(batches):
        keys = _multiset(s, doc, count, b.num_rows)
        again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        bag = _mix(np.repeat(s, count) + again.astype(U) * U(0xD6E8FEB86659FD93)).view(np.int64)
        n = np.bincount(doc, count, b.num_rows).astype(np.int64)
        bags = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(bag))
        yield pa.RecordBatch.from_arrays([b.column(0), *keys, bags], ["doc_id", "k1", "k2", "bag"])


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and the multiset of shingles as 64-bit codes, one for each occurrence."""
    return docs.select("doc_id", "text").mapInArrow(_bags, f"doc_id {dict(docs.dtypes)['doc_id']}, k1 bigint, k2 bigint, bag array<bigint>")


def bucket_links(bags: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join all texts of one bucket which similar pairs connect: a search from each text over those not reached.

    Every pair is compared exactly, unless both are already joined.
    """
    size = np.array([len(b) for b in bags])
    _, code = np.unique(np.concatenate(bags), return_inverse=True)
    cut = np.cumsum(size) - size
    mark = np.zeros(code.max() + 1, bool)
    left = np.arange(len(bags))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            own = code[cut[u] : cut[u] + size[u]]
            fits = np.minimum(size[left], size[u]) >= SIMILAR * np.maximum(size[left], size[u])
            some = left[fits]
            if not len(some):
                continue
            mark[own] = True
            if len(some) == len(bags) - 1:
                same = np.add.reduceat(mark[code], cut)[some]
            else:
                at = np.repeat(cut[some] - np.r_[0, np.cumsum(size[some])[:-1]], size[some]) + np.arange(size[some].sum())
                same = np.add.reduceat(mark[code[at]], np.r_[0, np.cumsum(size[some])[:-1]])
            mark[own] = False
            new = some[same >= SIMILAR * (size[some] + size[u] - same)]
            yield from ((u, x) for x in new)
            queue += list(new)
            left = np.setdiff1d(left, new, assume_unique=True)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket's bags are held at a time."""
    found: dict = {"a": [], "b": []}
    held, nodes, bags = None, [], []

    def close() -> None:
        for x, y in bucket_links(bags) if len(bags) > 1 else ():
            found["a"].append(nodes[x])
            found["b"].append(nodes[y])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found["a"], pa.int64()), pa.array(found["b"], pa.int64())], ["a", "b"])

    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        flat, at = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        for i, key in enumerate(keys):
            if key != held:
                close()
                held, nodes, bags = key, [], []
            nodes.append(ids[i])
            bags.append(flat[at[i] : at[i + 1]].copy())
        if len(found["a"]) > 10_000:
            yield out()
            found = {"a": [], "b": []}
    close()
    if found["a"]:
        yield out()


def _buckets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of at most BUCKET members, one for each set of members, as (v, node); larger ones as (v, node, c, head)."""
    groups = members.groupBy("v").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit("2"))).alias("x2"), F.min("node").alias("head")
    )
    groups = stored(groups.where("c > 1"), "groups")
    small = stored(groups.where(F.col("c") <= BUCKET).groupBy("c", "x1", "x2").agg(F.min("v").alias("v")).select("v"), "small")
    large = stored(groups.where(F.col("c") > BUCKET).select("v", "c", "head"), "large")
    # Most bands have one member: a filter of the chosen buckets keeps them out of the joins.
    held = lambda chosen: maybe_in(members, "v", chosen.select("v")).join(chosen, "v")
    return held(small).select("v", "node"), held(large).select("v", "node", "c", "head")


def _blocks(large: DataFrame) -> DataFrame:
    """Large buckets dealt into blocks of about BUCKET members, each with the bucket's head among them."""
    block = F.xxhash64("v", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BUCKET)))
    rows = large.select(block.alias("v"), "node", "head")
    return rows.select("v", "node").union(rows.select("v", "head")).distinct()


def _prefixes(bags: DataFrame) -> DataFrame:
    """(v, node, root, index) of the codes by which similar bags of ``bags`` (node, root, bag) must meet: prefix filtering.

    A bag's distinct codes stand in one order, rarest first. Of bags similar by 0.8, the rarest common code has at
    most a fifth of the larger bag before it, and at most a ninth of the smaller (``index``). Codes that one bag has are counted only.
    """
    each = stored(bags.select("node", "root", F.size("bag").alias("n"), F.array_distinct("bag").alias("codes")), "codes")
    codes = each.select("node", F.explode("codes").alias("v"))
    common = stored(codes.groupBy("v").agg(F.count("*").alias("f")).where("f > 1"), "common")
    shared = codes.join(common, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("shared"))
    at = each.select("node", "root", "n", F.size("codes").alias("d")).join(shared, "node")
    at = at.select("node", "root", "n", (F.col("d") - F.size("shared")).alias("own"), F.posexplode("shared").alias("i", "x"))
    before = F.col("own") + F.col("i")
    most = lambda share: F.floor(F.col("n") * share + 1e-6)
    return at.where(before <= most(PROBE)).select(F.col("x.v").cast("long").alias("v"), "node", "root", (before <= most(INDEX)).alias("index"))


#: Kinds of a group's members: 0 and 1 outside its most frequent root, 2 and 3 inside; odd ones only probe. Those that meet:
MEET = {0: (0, 1, 2, 3), 1: (0, 2), 2: (0, 1), 3: (0,)}


def _cells(large: DataFrame) -> DataFrame:
    """Groups of more than BUCKET members, (v, node, kind), as (v, node) of pairs of blocks of half as many members.

    Every pair of members meets in a cell, unless both have the group's most frequent root or both only probe.
    """
    half = max(1, BUCKET // 2)
    counts = large.groupBy("v").agg(*[F.ceil(F.count_if(F.col("kind") == k) / half).alias(f"b{k}") for k in MEET])
    rows = large.join(counts, "v")
    own = F.when(F.col("kind") == 0, F.col("b0")).when(F.col("kind") == 1, F.col("b1")).when(F.col("kind") == 2, F.col("b2")).otherwise(F.col("b3"))
    rows = rows.withColumn("own", F.struct("kind", F.pmod(F.xxhash64("node"), own).alias("block")))
    others = F.lit(None)
    for k, kinds in MEET.items():
        met = [F.expr(f"IF(b{q} > 0, transform(sequence(0L, b{q} - 1), j -> struct({q} AS kind, j AS block)), array())") for q in kinds]
        others = F.when(F.col("kind") == k, F.concat(*met)).otherwise(others)
    rows = rows.select("v", "node", "own", F.explode(others).alias("other"))
    return rows.select(F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other")).alias("v"), "node")


def _exact(large: DataFrame, bags: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(v, node): groups in which all similar pairs of a large bucket meet that ``roots`` does not join; None if it joins all."""
    rooted = large.select("v", "node").join(roots, "node", "left").select("v", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    apart = rooted.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("v")
    some = stored(rooted.join(apart, "v", "left_semi").select("node", "root").distinct(), "apart")
    if some.isEmpty():
        return None
    rows = stored(_prefixes(bags.join(some, "node")), "prefixes")
    sums = [F.bit_xor(F.xxhash64("node", "index", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    groups = rows.groupBy("v").agg(F.count("*").alias("c"), *sums, F.mode("root").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("index").alias("index"))
    groups = stored(groups.where("lo <> hi AND index").groupBy("c", "x1", "x2").agg(F.min(F.struct("v", "most")).alias("g")).select("c", "g.*"), "groups")
    small = rows.join(groups.where(F.col("c") <= BUCKET).select("v"), "v").select("v", "node")
    kind = F.when(F.col("root") == F.col("most"), 2).otherwise(0) + F.when(F.col("index"), 0).otherwise(1)
    many = stored(rows.join(groups.where(F.col("c") > BUCKET).select("v", "most"), "v").select("v", "node", kind.alias("kind")), "many")
    return stored(small.unionByName(_cells(many)), "meet")


def near_links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (k1, k2, doc_id, node, rows), one for each distinct multiset, and (node, root) of those with links of 0.8 or more.

    A node is the number ``u`` of a row of ``signed`` with the multiset's smallest id. Bags of nodes with bucket mates are
    counted from the texts again, so signatures alone are stored for all rows. A bucket's members meet in one task with
    their bags; buckets of the same members are taken once. A bucket of more than BUCKET members is split twice
    over: by each other band, so the most similar members still meet, and into blocks that share the bucket's smallest member.
    All its members take part in both. Where that leaves such a bucket in several classes, its members are joined
    exactly, by the rarest codes of their bags.
    """
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    each = some.groupBy("k1", "k2", "doc_id").agg(F.min("u").alias("u"), F.count("*").alias("c"))
    nodes = each.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "u", "c")).alias("m"), F.sum("c").alias("rows"))
    nodes = stored(nodes.select("k1", "k2", "m.doc_id", F.col("m.u").alias("node"), F.col("m.c").alias("c"), "rows"), "nodes")
    heads = stored(some.select(F.col("u").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi"), "heads")
    small, large = _buckets(heads.select("node", F.explode("bands").alias("v")))
    meet = [small]
    large = stored(large, "members")
    split = not large.isEmpty()
    if split:
        finer = large.select("v", "node").join(heads, "node")
        finer = finer.select("node", F.explode(F.expr("transform(bands, b -> xxhash64(v, b))")).alias("v"))
        within, still = _buckets(stored(finer, "finer"))
        meet += [_blocks(large), within, _blocks(still)]
    rows = meet[0]
    for x in meet[1:]:
        rows = rows.unionByName(x)
    again = not nodes.where("c > 1").isEmpty()  # rows that share id and multiset have equal bags, of which one is wanted

    def with_bags(rows: DataFrame) -> DataFrame:
        """``rows`` (with node) and the bag of each node; bags are shuffled once."""
        keyed = stored(rows.join(nodes.select("node", "doc_id", "k1", "k2"), "node"), "wanted")
        found = bags(maybe_in(docs.where("doc_id IS NOT NULL"), "doc_id", keyed.select("doc_id").distinct()))
        found = found.dropDuplicates(["doc_id", "k1", "k2"]) if again else found
        return found.join(keyed, ["doc_id", "k1", "k2"]).select(*rows.columns, "bag")

    def links(rows: DataFrame) -> DataFrame:
        rows = with_bags(rows).select("v", "node", "bag")
        return stored(rows.repartition("v").sortWithinPartitions("v").mapInArrow(_link, "a bigint, b bigint"), "links")

    roots = stored(components(links(stored(rows, "meet"))), "roots")
    rows = _exact(large, with_bags(large.select("node").distinct()), roots) if split else None
    if rows is not None:
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(known.unionByName(links(rows))), "roots")
    return nodes, roots


def near_marks(docs: DataFrame) -> DataFrame:
    """``near_classes`` with h, the hash of the text, beside each id: together they name a row of ``docs``, or rows that repeat it."""
    signed = stored(signatures(docs).withColumn("u", F.monotonically_increasing_id()), "signed")
    nodes, roots = near_links(docs, signed)
    known = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    lead = known.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("lead"), F.sum("rows").alias("class_size"))
    known = stored(known.join(lead, "root").select("k1", "k2", F.col("lead.doc_id").alias("class_id"), "class_size", F.col("lead.node").alias("u0")), "leads")
    has = "n > 0 AND doc_id IS NOT NULL"
    member = signed.where(has).select("doc_id", "h", "u", "k1", "k2").join(known, ["k1", "k2"])
    member = member.select("doc_id", "h", "class_id", "class_size", (F.col("u") == F.col("u0")).alias("kept"))
    alone = signed.where(f"NOT ({has})").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return member.unionByName(alone)


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept.

    Documents are similar if the multisets of their five-word shingles overlap by 0.8 or more
    (sum of smaller counts over sum of larger ones); classes are the connected components. Words are runs of letters, digits and characters
    beyond ASCII, A-Z as a-z; fewer than five words are one shingle. Documents without words or with a null
    id are in a class of their own. Equal multisets are one node, so copies are not
    compared with each other. Rows with one id come out as often as they went in and are told apart by their texts; exactly one row
    of a class is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    return near_marks(docs).drop("h")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each class of ``near_classes``, with all its columns.

    Rows are known by id and text, so rows that share an id stay or go on their own; of rows equal in both, one
    at most stays. Texts move only of rows that a filter cannot tell from dropped ones.
    """
    docs = whole_rows(docs)
    marks = stored(near_marks(docs.select("doc_id", "text")).groupBy("doc_id", "h").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")).where("stay < rows"), "near")
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rest = less(docs, keys, marks.select("doc_id", "h"))
    once = marks.where("stay > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    if once.isEmpty():
        return rest.select("row.*")
    held = docs.withColumn("__t", F.xxhash64("text"))
    again = maybe_in(held, "doc_id", once.select("__id")).join(once, F.expr("doc_id = __id AND __t = __h"), "left_semi")
    return rest.unionByName(again.dropDuplicates(["doc_id", "__t"]).drop("__t")).select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
