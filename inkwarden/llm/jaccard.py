"""Near duplicates by Jaccard similarity of word shingles: a size-aware heavy-light join.

Words are runs of characters other than ASCII white space, A-Z in lower case; a document's set holds its distinct
runs of ``words`` words, or its whole sequence if shorter.  Equal sets are one class.  With the least similarity
``t = part / whole`` a set of ``n`` shingles needs an overlap of at least ``ceil(t n)`` with any partner, so in one
order of all shingles two partners share ``l`` of the first ``n - ceil(t n) + l``.  Sets up to a boundary size (light) enumerate all pairs of such shingles
(``l`` = 2) as signatures; larger sets (heavy), and light ones that can be partners of heavy ones, enter the inverted
list of each single shingle (``l`` = 1).  The boundary is the size at which enumeration begins to cost more than
scanning.  The order puts frequent
shingles last; a signature's members that differ too much in size are separate groups.

Signatures tie classes to clusters.  A cluster that fits a task is compared there, each set shipped once.  In a larger
one no group's pairs are enumerated: all members of a signature's group are compared with one pivot, and of groups
that still hold several components the members outside the largest one meet the others in blocks of bounded size.
So each pair that shares a signature is compared or already connected.
Identities of shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX, chunks, column_texts, documents, ends_of, mix, scratch_table


class Rule(NamedTuple):
    """Words of a shingle, and the least similarity of a link as ``part / whole``."""

    words: int = 4
    part: int = 85
    whole: int = 100


#: The values of op3.
OP3 = Rule()
#: Tasks count shingles in runs of this many; a shingle in FREQUENT sets or more goes to the end of the order.
RUN, FREQUENT = 1 << 21, 4
#: Counted are shingles whose forty bits lie below LOW (three tenths), in so many buckets; bound of the broadcast list.
LOW, BUCKETS, LISTED = np.uint64((1 << 40) * 3 // 10), 1024, 1 << 20
#: Frequency that the other shingles are taken to have: they come after low shingles of smaller groups of copies.
UNCOUNTED = 64
#: Tokens and sets of a block of comparisons.
BLOCK_TOKENS, BLOCK_SETS = 1 << 16, 256
#: Sets and shingles of a cluster that one task compares; number of nodes up to which they are broadcast to find their texts.
CLUSTER_SETS, CLUSTER_TOKENS, FEW = 1024, 1 << 20, 1 << 20

#: Bytes of text whose words are hashed at once.
RUN_BYTES = 1 << 17
#: White space; a number for each byte, and the base of a word's polynomial.
_WHITE = [b" ", b"\t", b"\n", b"\v", b"\f", b"\r"]
_SPACE = np.isin(np.arange(256), list(b"".join(_WHITE)))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def need(n: np.ndarray | int, rule: Rule = OP3) -> np.ndarray | int:
    """Least overlap of a set of ``n`` shingles with a partner."""
    return -(-rule.part * n // rule.whole)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a number modulo 2^64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out[:n]


def _parts(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into parts of at most RUN_BYTES, longer ones only for a longer word."""
    a = 0
    while len(text) - a > RUN_BYTES:
        cut = max(text.rfind(c, a, a + RUN_BYTES) for c in _WHITE)
        if cut < 0:
            cut = min((at for c in _WHITE if (at := text.find(c, a + RUN_BYTES)) >= 0), default=len(text))
        yield text[a:cut]
        a = cut + 1
    yield text[a:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one text after the other, and the number of words of each.

    A word is a polynomial over its bytes: a difference of running sums, moved to the word's start.  Sums start anew in
    each RUN_BYTES of text, so their memory stays bounded.
    """
    owned = [(i, part) for i, text in enumerate(texts) for part in _parts(text)]
    hashes, counts, a = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while a < len(owned):
        b, size = a, 0
        while b < len(owned) and (b == a or size + len(owned[b][1]) < RUN_BYTES):
            size += len(owned[b][1]) + 1
            b += 1
        run = owned[a:b]
        raw = np.frombuffer(b"".join([part + b" " for _, part in run]), np.uint8)
        word = ~_SPACE[raw]
        first = np.flatnonzero(word & ~np.append(False, word[:-1]))
        last = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
        moved = (sums[last] - sums[first]) * _powers(pow(_BASE, -1, 1 << 64), len(raw))[first]
        hashes.append(mix(moved + (last - first).astype(np.uint64) * MIX))
        ends = ends_of(np.array([len(part) + 1 for _, part in run], np.int64))
        np.add.at(counts, [i for i, _ in run], np.diff(np.searchsorted(first, ends)))
        a = b
    return np.concatenate(hashes), counts


def shingle_sets(texts: list[str], size: int = OP3.words, low: bool = False) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; none for a text without words.  ``low``: only the low ones."""
    hashes, counts = word_hashes([x.encode().lower() for x in texts])
    factors = [np.uint64(pow(int(MIX), i, 1 << 64)) for i in range(1, size + 1)]
    n = max(0, len(hashes) - size + 1)
    joined = mix(sum((hashes[i:i + n] * f for i, f in enumerate(factors)), np.zeros(n, np.uint64)))
    out, at, bound = [], 0, LOW << np.uint64(24)
    for many in counts.tolist():
        end = at + many
        if many >= size:
            own = joined[at:end - size + 1]
            out.append(_distinct(own[own < bound] if low else own))
        elif many:
            own = hashes[at:end]
            own = mix(np.array([np.sum(own * np.array(factors[:len(own)])) + np.uint64(len(own))], np.uint64))
            out.append(own[own < bound] if low else own)
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; for short arrays in less time than ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def class_of(shingles: np.ndarray) -> int:
    """Identity of a set, the same for every order of its members."""
    total = int(np.sum(mix(shingles ^ MIX), dtype=np.uint64)) + len(shingles) * int(MIX) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def single(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles + MIX).view(np.int64)


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """Forty bits of each shingle, by which frequencies are kept."""
    return shingles >> np.uint64(24)


def signatures(shingles: np.ndarray, listed: np.ndarray, counts: np.ndarray, boundary: int,
               rule: Rule = OP3) -> np.ndarray:
    """Signatures of one set: pairs of its first shingles if light, single ones for the inverted lists."""
    n = len(shingles)
    if len(listed):
        keys = keys_of(shingles)
        at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
        weight = np.where(listed[at] == keys, counts[at], np.where(keys < LOW, 0, UNCOUNTED))
        shingles = shingles[np.lexsort((shingles, weight))]
    spare, out = n - int(need(n, rule)), []
    if n <= boundary and need(n, rule) >= 2:
        first = shingles[:spare + 2]
        a, b = np.triu_indices(len(first), 1)
        low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        out.append(mix(low * MIX + high).view(np.int64))
    if n > boundary or n >= need(boundary + 1, rule):
        out.append(single(shingles[:spare + 1]))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Frequencies of low shingles in runs of texts, in buckets: those that came once, and others with their counts."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        values, count = np.unique(keys_of(np.concatenate(held)), return_counts=True)
        bucket = (values % np.uint64(BUCKETS)).astype(np.int64)
        order = np.lexsort((count > 1, bucket))
        values, count, bucket = (values[order] // np.uint64(BUCKETS)).astype("<u4"), count[order].astype("<u4"), bucket[order]
        ends = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        out = []
        for b in np.flatnonzero(np.diff(ends)):
            part = slice(ends[b], ends[b + 1])
            out.append((int(b), values[part].tobytes(), count[part][count[part] > 1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()),
                                           pa.array([r[2] for r in out], pa.binary())], ["bucket", "shingles", "counts"])

    for batch in chunks(batches, 1000, size=4_000_000):
        for s in shingle_sets(column_texts(batch), rule.words, low=True):
            held.append(s)
            size += len(s)
        if size >= RUN:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent shingles of buckets that arrive one after the other; under null the number of all."""
    bucket, held = None, []

    def found() -> pa.RecordBatch:
        values, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        count = np.bincount(place, np.concatenate([c for _, c in held]), len(values)).astype(np.int64)
        keep = count >= FREQUENT
        keys = values[keep].astype(np.int64) * BUCKETS + bucket
        return pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), None], pa.int64()),
                                           pa.array([*count[keep].tolist(), int(count.sum())], pa.int64())], ["shingle", "n"])

    for batch in batches:
        for b, raw, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield found()
                held = []
            bucket, values, more = b, np.frombuffer(raw, "<u4"), np.frombuffer(counts, "<u4")
            held.append((values, np.concatenate([np.ones(len(values) - len(more)), more])))
    if held:
        yield found()


def frequent_shingles(docs: DataFrame, rule: Rule = OP3) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys of at most LISTED frequent shingles, ascending, their counts, and the share of shingles that are frequent.

    Counted are the low shingles, which stand first in an order by hash.  Which ones are listed only sets the order
    of shingles, never the result.
    """
    parts = docs.select("text").mapInArrow(lambda batches: _counted(batches, rule), "bucket int, shingles binary, counts binary")
    found = (parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent, "shingle bigint, n bigint"))
    found = scratch_table(found, "frequent")
    sums = found.agg(F.sum(F.when(F.col("shingle").isNotNull(), F.col("n"))), F.sum(F.when(F.col("shingle").isNull(), F.col("n")))).first()
    found, level = found.where(F.col("shingle").isNotNull()), F.floor(F.log2("n")).cast("int")
    least, room = 0, LISTED
    for row in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            least = row["level"] + 1
            break
    rows = found.where(level >= least).toPandas()
    listed = rows["shingle"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(listed)
    return listed[order], rows["n"].to_numpy(np.int64)[order], (sums[0] or 0) / (sums[1] or 1)


def boundary_size(met: float, scan: float = 8.0, rule: Rule = OP3) -> int:
    """Largest set size up to which enumerating pairs costs no more than scanning inverted lists.

    A light set emits one row for each pair of its ``spare + 2`` first shingles.  A heavy one emits ``spare + 1``
    rows, and in the share ``met`` of those lists it meets others, whose comparison costs ``scan`` rows.
    """
    best, n = 2, 2
    while True:
        n += 1
        spare = n - int(need(n, rule))
        if (spare + 2) * (spare + 1) / 2 > (spare + 1) * (1 + met * scan):
            return best
        best = n


def _signed(shared, boundary: int, rule: Rule):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = shared.value
        for batch in chunks(batches, 1000, size=4_000_000):
            sets = shingle_sets(column_texts(batch), rule.words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signatures(s, listed, counts, boundary, rule) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "sigs"])

    return rows


def _members(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The sets of texts (text, cluster, wanted) and their nodes."""
    for batch in chunks(batches, 1000, size=4_000_000):
        sets = shingle_sets(column_texts(batch), rule.words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([class_of(s) for s in sets], pa.int64()),
             pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cluster", "wanted", "node", "members"])


def _rank(node: str, turn: int = 0):
    """The place of a node in a random order, another one for each turn."""
    return F.xxhash64(F.lit(turn), F.col(node))


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of the links (a, b) and the smallest node it reaches.

    Each round puts the first of a node and its neighbours, in a random order, in the node's place; links within one
    place are done.  Every second round takes a new order: a star is one place after two rounds, and in links of any
    shape a quarter of the nodes is expected to go at least.  So links that are left, and not all links, meet a
    further round.  Places are then followed from the last round to the first.  Sums are combined before each shuffle,
    so a node with very many links is no hot spot.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges, rounds = scratch_table(links.where("a <> b").select(a, b).distinct(), "edges"), []
    while True:
        turn = len(rounds) // 2
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min_by("b", _rank("b", turn)).alias("first"))
        place = F.when(_rank("first", turn) < _rank("node", turn), F.col("first")).otherwise(F.col("node"))
        places = scratch_table(near.select("node", place.alias("place")), "places")
        rounds.append(places)
        moved = (edges.join(places.toDF("a", "of_a"), "a").join(places.toDF("b", "of_b"), "b").where("of_a <> of_b")
                 .select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        edges = scratch_table(moved.select(a, b).distinct(), "edges")
        if edges.isEmpty():
            break
    found = rounds.pop()
    for places in reversed(rounds):
        found = places.join(found.toDF("place", "last"), "place", "left").select("node", F.coalesce("last", "place").alias("place"))
    found = scratch_table(found, "places")
    labels = found.join(found.groupBy("place").agg(F.min("node").alias("label")), "place").select("node", "label")
    return scratch_table(labels, "labels")


def _reached(common: np.ndarray, size: int, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether overlaps of one set with others make links."""
    return rule.whole * common >= rule.part * (size + sizes - common)


def linked_groups(nodes: list[int], sets: list[np.ndarray], rule: Rule = OP3) -> dict[int, int]:
    """Smallest node that links reach, for the nodes of a few sets that have links."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(known), np.int32), np.array(nodes, np.int64)
    linked = np.zeros(len(nodes), bool)
    for k in range(len(sets)):
        own = place[starts[k]:starts[k] + sizes[k]]
        mark[own] = 1
        near = _reached(np.add.reduceat(mark[place], starts), sizes[k], sizes, rule)
        mark[own] = 0
        if near.sum() > 1:
            linked |= near
            joined = np.isin(label, label[near])
            label[joined] = label[joined].min()
    return {n: int(x) for n, x, some in zip(nodes, label, linked, strict=True) if some}


def _in_clusters(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Labels of the linked nodes of clusters that arrive one after the other; memory holds one small cluster."""
    cluster, held = None, {}

    def labelled() -> pa.RecordBatch:
        found = linked_groups(list(held), list(held.values()), rule) if len(held) > 1 else {}
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                          ["node", "label"])

    for batch in batches:
        members = batch.column(2)
        values, ends = members.values.to_numpy(), members.offsets.to_numpy()
        for i, (key, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != cluster:
                if held:
                    yield labelled()
                cluster, held = key, {}
            held[node] = values[ends[i]:ends[i + 1]].copy()
    if held:
        yield labelled()


def _compared(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links between the sets of two blocks; of each set's links into one component the first is enough."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (batch.column(c)[i].as_py() for c in (0, 1))
            sets = [np.array(x["members"], np.int64) for x in left]
            known, sizes = np.unique(np.concatenate(sets)), np.array([len(x) for x in sets])
            own = np.zeros((len(sets), len(known)), np.float32)
            for k, s in enumerate(sets):
                own[k, np.searchsorted(known, s)] = 1
            found: dict[tuple, int] = {}
            for y in right:
                s = np.array(y["members"], np.int64)
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                common = own[:, at[known[at] == s]].sum(axis=1, dtype=np.float64)
                for k in np.flatnonzero(_reached(common, len(s), sizes, rule)):
                    if left[k]["label"] != y["label"]:
                        found.setdefault((left[k]["node"], y["label"]), y["node"])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                              pa.array(list(found.values()), pa.int64())], ["a", "b"])


def _blocked(members: DataFrame, sets: DataFrame, role: str) -> DataFrame:
    """Members (group, node, label) with their sets, gathered in blocks of bounded size: group, block, <role>."""
    full = members.join(sets.select("node", "n", "members"), "node")
    sizes = members.join(sets.select("node", "n"), "node").groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS),
                                                 F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    return (full.join(sizes, "group").groupBy("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias(f"{role}_block"))
            .agg(F.collect_list(F.struct("node", "label", "members")).alias(role)))


def _in_large_clusters(grouped: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, label) of the linked nodes of clusters too large for one task, without comparing all their pairs.

    In every signature's group all members are compared with one pivot.  Groups that still hold several components
    are merged by their largest component, and their other members meet all members, in blocks of bounded size.
    """
    near = lambda a, b: F.lit(rule.whole) * F.least(a, b) >= F.lit(rule.part) * F.greatest(a, b)
    pairs = grouped.where(F.col("node") != F.col("pivot")).select("node", "pivot").distinct()
    common = F.size(F.array_intersect("members", "pivot_members"))
    pivots = sets.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("members").alias("pivot_members"))
    links = (pairs.join(sets, "node").join(pivots, "pivot").where(near(F.col("n"), F.col("pivot_n")))
             .where(F.lit(rule.whole) * common >= F.lit(rule.part) * (F.col("n") + F.col("pivot_n") - common))
             .select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    links = scratch_table(links, "links")
    labels = components(links)
    open_groups = (grouped.select("sig", "run", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    kinds = open_groups.groupBy("sig", "run", "label").count()
    largest = (kinds.groupBy("sig", "run").agg(F.count("*").alias("kinds"), F.max_by("label", F.struct("count", "label")).alias("group"))
               .where("kinds > 1").select("sig", "run", "group"))
    members = scratch_table(open_groups.join(largest, ["sig", "run"]).select("group", "node", "label").distinct(), "open")
    minors = _blocked(members.where(F.col("group") != F.col("label")), sets, "minors")
    others = _blocked(members, sets, "others")
    more = minors.join(others, "group").select("minors", "others").mapInArrow(lambda batches: _compared(batches, rule), "a bigint, b bigint")
    more = scratch_table(more, "more")
    return labels if more.isEmpty() else components(links.unionAll(more))


def _same_sets(clusters: DataFrame, reps: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(cluster, node, members) of the nodes (cluster, node): the text of each node's smallest doc_id is read again.

    Few nodes are broadcast, many are joined by a shuffle.  Rows without a doc_id are matched by their node.
    """
    members = lambda batches: _members(batches, rule)
    named = scratch_table(clusters.join(reps, "node").select("doc_id", "cluster", "node"), "named")
    few = named.count() <= FEW
    hint = F.broadcast if few else (lambda x: x)
    rows = (docs.join(hint(named.where(F.col("doc_id").isNotNull()).withColumnRenamed("node", "wanted")), "doc_id")
            .select("text", "cluster", "wanted").mapInArrow(members, "cluster bigint, wanted bigint, node bigint, members array<bigint>")
            .where("node = wanted").select("cluster", "node", "members"))
    keyless = docs.where(F.col("doc_id").isNull()).select("text", F.lit(0).cast("bigint").alias("cluster"), F.lit(0).cast("bigint").alias("wanted"))
    keyless = (keyless.mapInArrow(members, "cluster bigint, wanted bigint, node bigint, members array<bigint>").select("node", "members")
               .join(hint(named.where(F.col("doc_id").isNull()).select("node", "cluster")), "node"))
    return rows.unionByName(keyless)


def linked_components(docs: DataFrame, boundary: int | None = None, rule: Rule = OP3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest non-null doc_id that links reach.  A text without words (null, empty, only white
    space) has 0 shingles, is linked with nothing and keeps its own doc_id; repeated rows are linked with each
    other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    listed, counts, met = frequent_shingles(docs, rule)
    if boundary is None:
        boundary = boundary_size(met, rule=rule)
    shared = spark.sparkContext.broadcast((listed, counts))
    signed = scratch_table(docs.mapInArrow(_signed(shared, boundary, rule), "doc_id bigint, node bigint, n bigint, sigs array<bigint>"),
                           "signed")
    full = signed.where("n > 0")
    classes = full.groupBy("node").agg(F.first("n").alias("n"), F.first("sigs").alias("sigs"))
    entries = classes.select(F.explode("sigs").alias("sig"), "node", F.col("n").cast("int").alias("n"))
    # Members of a signature in the order of their size; where the next is too large for the one before, a group ends.
    by_size = Window.partitionBy("sig").orderBy("n", "node")
    entries = entries.withColumn("before", F.lag("n").over(by_size))
    entries = entries.withColumn("run", F.sum(F.when(rule.whole * F.col("before") < rule.part * F.col("n"), 1).otherwise(0)).over(by_size))
    group = Window.partitionBy("sig", "run")
    grouped = (entries.withColumn("size", F.count("*").over(group))
               .withColumn("pivot", F.min(F.struct(_rank("node").alias("rank"), "node")).over(group)).where("size > 1"))
    grouped = scratch_table(grouped.select("sig", "run", "node", F.col("pivot.node").alias("pivot")), "grouped")
    # Clusters: nodes that groups tie together, whether similar or not.
    clusters = components(grouped.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()).withColumnRenamed("label", "cluster")
    reps = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    sizes = (clusters.join(reps, "node").groupBy("cluster").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens"))
             .withColumn("large", (F.col("nodes") > CLUSTER_SETS) | (F.col("tokens") > CLUSTER_TOKENS)))
    clusters = scratch_table(clusters.join(sizes.select("cluster", "large"), "cluster"), "clusters")
    small = _same_sets(clusters.where(~F.col("large")), reps, docs, rule)
    labels = scratch_table(small.repartition("cluster").sortWithinPartitions("cluster", "node")
                           .mapInArrow(lambda batches: _in_clusters(batches, rule), "node bigint, label bigint"), "small")
    large = clusters.where("large")
    if not large.isEmpty():
        sets = _same_sets(large, reps, docs, rule).groupBy("node").agg(F.first("members").alias("members"))
        sets = scratch_table(sets.withColumn("n", F.size("members")), "sets")
        labels = labels.unionByName(_in_large_clusters(grouped.join(large.select("node"), "node", "left_semi"), sets, rule))
    nodes = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = scratch_table(nodes.select("node", "label", "doc_id"), "nodes")
    linked = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch_table(nodes.join(linked, "label").select("node", "component_id"), "components")
    return (signed.select("doc_id", "node", "n").join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard similarity 0.85 of four-word shingles."""
    return linked_components(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS node, b AS to_node FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.to_node = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce((SELECT min(to_node) FROM reach r WHERE r.node = s.doc_id), s.doc_id)) AS component_id
FROM sets s
"""
