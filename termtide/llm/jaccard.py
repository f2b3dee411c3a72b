"""Jaccard join of shingle sets: a grouped prefix join.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. In an
order of all shingles from rare to frequent, the first n - ceil(t n) + 1 shingles of linked
documents (their prefixes) have one in common. The steps:

1. One pass hashes every document's shingles and sends them, packed and without copies of text, to
   buckets by hash. A bucket tells which of its shingles occur in more than one document. Those are
   the only ones that two documents can share, so everything after works on them alone:
   the others count as the rarest, and a document whose prefix they fill has no links. Shingles
   in a large share of all documents skip the buckets; they are known from a count before and come
   last in the order.
2. Documents with equal sets become one class. Classes with identical prefixes and size
   become one group, and groups that share a prefix shingle one cluster.
3. Inside a cluster group pairs are filtered by size and by position of the shared shingle,
   then expanded, and their members verified exactly. Pairs already connected are
   skipped, as only components are asked for. Clusters too large for one task are dealt
   out in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtide.llm.common import freeing, give_back, parts, written
from termtide.llm.components import components
from termtide.llm.shingles import WordHasher, shingle_sets

# Similarity as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
# Shingles per packed row set, and per bucket; they bound the memory of a task.
FLUSH = 500_000
PER_BUCKET = 1_000_000
# Rows that a bucket hands back at once.
RETURNED = 1 << 16
# Shingles in this share of the documents of a flush are counted as candidates for frequent ones;
# frequent are those in the second share of all documents. There are at most (shingles per
# document) / HOT_SHARE of them.
LOCAL_SHARE, LOCAL_LEAST, HOT_SHARE = 0.005, 8, 0.002
# More rows to leave out than this are joined by shuffle.
BROADCAST_ROWS = 2_000_000
# Files of a table whose names are broadcast.
BROADCAST_FILES = 100_000
# Shingles of a cluster that one task compares.
BLOCK = 4_000_000

_INDEX = ("bucket int, base long, shingles binary, owners binary, "
          "uid long, row long, doc_id long, n long, set_hash binary, frequent array<long>")
_SHARED = "uid long, shingle long, df long, row long, doc_id long, n long, set_hash binary, frequent array<long>"


def _flushes(batches: Iterator[pa.RecordBatch], hasher: WordHasher
             ) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Groups of documents ((row, doc_id), sets) with about ``FLUSH`` shingles or fewer than 2**16 rows."""
    ids, sets, size = [], [], 0
    for batch in parts(batches):
        ids += zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
        found = shingle_sets(batch.column("text").to_pylist(), hasher)
        sets += found
        size += sum(map(len, found))
        if size >= FLUSH or len(sets) > 60_000:
            yield ids, sets
            ids, sets, size = [], [], 0
    if sets:
        yield ids, sets


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle, docs of the locally frequent shingles; with shingle null the number of shingles."""
    hasher = WordHasher()
    for _, sets in _flushes(batches, hasher):
        every = np.concatenate(sets)
        values, counts = np.unique(every, return_counts=True)
        often = counts >= max(LOCAL_LEAST, LOCAL_SHARE * len(sets))
        shingles = [*values[often].view(np.int64).tolist(), None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingles, pa.int64()), pa.array([*counts[often].tolist(), len(every)],
                                                      pa.int64())], names=["shingle", "docs"])


def _bucket_bits(shingles: int) -> int:
    return max(6, (max(1, shingles) // PER_BUCKET).bit_length())


def _packer(bits: int, frequent):
    """Rows of shingles by bucket, and one row for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        hasher, part = WordHasher(), TaskContext.get().partitionId()
        for number, (ids, sets) in enumerate(_flushes(batches, hasher)):
            base = part << 38 | number << 16
            rows = {name: [] for name in (
                "bucket", "base", "shingles", "owners", "uid", "row", "doc_id", "n", "set_hash",
                "frequent")}
            kept = []
            for i, ((row, doc_id), found) in enumerate(zip(ids, sets, strict=True)):
                at = np.searchsorted(hot, found)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == found if len(hot) else at < 0
                kept.append(found[~is_hot])
                for name, value in (
                        ("bucket", -1 - part), ("uid", base + i), ("row", row),
                        ("doc_id", doc_id),
                        ("n", len(found)),
                        ("set_hash", hashlib.blake2b(found.tobytes(), digest_size=16).digest()),
                        ("frequent", found[is_hot].view(np.int64).tolist())):
                    rows[name].append(value)
                for name in ("base", "shingles", "owners"):
                    rows[name].append(None)
            owners = np.repeat(np.arange(len(kept), dtype=np.uint16), [len(k) for k in kept])
            every = np.concatenate(kept)
            order = np.argsort(every)
            every, owners = every[order], owners[order]
            cuts = np.searchsorted(every >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[bucket], cuts[bucket + 1]
                for name, value in (("bucket", bucket), ("base", base),
                                    ("shingles", pack(every[lo:hi], bits)),
                                    ("owners", owners[lo:hi].tobytes())):
                    rows[name].append(value)
                for name in ("uid", "row", "doc_id", "n", "set_hash", "frequent"):
                    rows[name].append(None)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                     pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)],
                names=list(rows))
    return run


def pack(shingles: np.ndarray, bits: int) -> bytes:
    """Sorted shingles of one bucket in 6 bytes each. The bits that name the bucket are left out; what
    is between them and the 6 bytes follows from how many shingles there are with each value of it."""
    spans = 1 << max(0, 16 - bits)
    span = (shingles >> np.uint64(48) & np.uint64(spans - 1)).astype(np.int64)
    counts = np.bincount(span, minlength=spans).astype("<u4")
    # Byte by byte, as the upper ones are mostly 0 and compress to nothing.
    head = np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T)
    low = np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return head.tobytes() + low.tobytes()


def unpack(data: bytes, bucket: int, bits: int) -> np.ndarray:
    spans = 1 << max(0, 16 - bits)
    head = np.frombuffer(data, np.uint8, 4 * spans).reshape(4, spans)
    counts = np.ascontiguousarray(head.T).view("<u4").reshape(-1)
    low = np.frombuffer(data, np.uint8, offset=4 * spans).reshape(-1, 6)
    raw = np.zeros((len(low), 8), np.uint8)
    raw[:, :6] = low
    span = np.repeat(np.arange(spans, dtype=np.uint64) << np.uint64(48), counts)
    below = (raw.reshape(-1).view("<u8") | span) & np.uint64((1 << 64 - bits) - 1)
    return below | np.uint64(bucket << 64 - bits)


def _shared_in_bucket(bits: int):
    """The shingles of a bucket that occur more than once, by document; document rows pass."""
    def run(rows: pa.Table) -> pa.Table:
        names = ["uid", "shingle", "df", "row", "doc_id", "n", "set_hash", "frequent"]
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            nulls = pa.nulls(len(rows), pa.int64())
            return pa.table([rows.column("uid"), nulls, nulls,
                             *(rows.column(c) for c in names[3:])], names=names)
        shingles = [unpack(x.as_buffer(), bucket, bits) for x in rows.column("shingles")]
        uids = [np.frombuffer(o.as_buffer(), np.uint16).astype(np.int64) + b.as_py()
                for o, b in zip(rows.column("owners"), rows.column("base"), strict=True)]
        shingles, uids = np.concatenate(shingles), np.concatenate(uids)
        order = np.argsort(shingles, kind="stable")
        shingles, uids = shingles[order], uids[order]
        del order
        first = np.flatnonzero(np.diff(shingles, prepend=~shingles[:1]))
        counts = np.diff(first, append=len(shingles))
        df = np.repeat(counts, counts)
        more = df > 1
        m = int(more.sum())
        nulls = pa.nulls(m, pa.int64())
        found = pa.table(
            [pa.array(uids[more]), pa.array(shingles[more].view(np.int64)),
             pa.array(df[more].astype(np.int64)), nulls, nulls, nulls, pa.nulls(m, pa.binary()),
             pa.nulls(m, pa.list_(pa.int64()))], names=names)
        del shingles, uids, first, counts, df, more
        give_back()
        # Every chunk is a message of its own, which the executor holds beside its heap.
        return pa.Table.from_batches(found.to_batches(RETURNED), found.schema)
    return run


def shared_shingles(df: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, shared): one row per document (uid, row, doc_id, n, set_hash, frequent) and one
    per document and shingle that other documents have too (uid, shingle, df). ``row`` names a
    column with a number for every row of ``df``."""
    spark = df.sparkSession
    texts = df.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
                      "doc_id", "text")
    counted = written(texts.mapInArrow(freeing(_count_frequent), "shingle long, docs long")
                      .groupBy("shingle").agg(F.sum("docs").alias("docs")), "jaccard-frequent")
    total = counted.where("shingle IS NULL").agg(F.sum("docs")).first()[0] or 0
    least = HOT_SHARE * texts.count()
    hot = counted.where("shingle IS NOT NULL").where(F.col("docs") >= least)
    values = np.sort(np.asarray(
        hot.select("shingle").toArrow().column(0).to_numpy(), np.int64).view(np.uint64))
    bits = _bucket_bits(total)
    packed = texts.mapInArrow(
        freeing(_packer(bits, spark.sparkContext.broadcast(values))), _INDEX)
    both = written(packed.groupBy("bucket").applyInArrow(_shared_in_bucket(bits), _SHARED),
                   "jaccard-shared")
    documents = both.where("shingle IS NULL").select(
        "uid", "row", "doc_id", "n", "set_hash", "frequent")
    return documents, both.where("shingle IS NOT NULL").select("uid", "shingle", "df")


def _prefix_length(n):
    """n - ceil(n t) + 1 for a column or a number."""
    num, den = SIMILARITY
    ceil = (n * num + den - 1) / den
    return n - (F.floor(ceil) if hasattr(n, "alias") else int(ceil)) + 1


def candidates(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """uid, n, shingles, prefix, for the first document of every class that may have links.

    ``shingles`` are those that others have too, from rare to frequent; the first ``prefix``
    of them belong to the prefix.
    """
    leaders = documents.where("n > 0").groupBy("set_hash").agg(
        F.min("uid").alias("uid"), F.first("n").alias("n"))
    own = shared.join(leaders.select("uid", "n"), "uid").groupBy("uid", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    last = documents.where(F.size("frequent") > 0).join(
        leaders.select("uid"), "uid", "left_semi").select("uid", "n", "frequent")
    known = own.select("uid", "n", F.col("rare.shingle").alias("rare")).join(
        last.withColumnRenamed("n", "last_n"), "uid", "full_outer")
    empty = F.array().cast("array<long>")
    n = F.coalesce("n", "last_n")
    shingles = F.concat(F.coalesce("rare", empty), F.coalesce("frequent", empty))
    rows = known.select("uid", n.alias("n"), shingles.alias("shingles"))
    prefix = _prefix_length(F.col("n")) - (F.col("n") - F.size("shingles"))
    return rows.select("*", prefix.cast("int").alias("prefix")).where("prefix > 0")


def clusters(rows: DataFrame) -> DataFrame:
    """The rows of ``candidates`` with the cluster of their group; those alone in it are left out.

    A group has the same prefix and size. Groups that share a prefix shingle are in one cluster.
    """
    grouped = rows.withColumn(
        "group", F.xxhash64("n", F.slice("shingles", F.lit(1), F.col("prefix"))))
    groups = grouped.groupBy("group").agg(F.count("*").alias("members"), F.min("uid").alias("uid"))
    first = grouped.join(groups.select("uid", "members"), "uid").select(
        "group", "members", F.explode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("s"))
    sharing = Window.partitionBy("s")
    edges = first.select("group", "members", F.min("group").over(sharing).alias("v")).where(
        (F.col("group") != F.col("v")) | (F.col("members") > 1))
    edges = written(edges.select(F.col("group").alias("u"), "v").distinct(), "jaccard-groups")
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("own"))
    found = components(edges).join(alone, "node", "full_outer").select(
        F.col("node").alias("group"), F.coalesce("component", "own").alias("cluster"))
    return grouped.join(found, "group").select("cluster", "uid", "n", "shingles", "prefix")


class Forest:
    """Disjoint sets of rows."""

    def __init__(self, labels: list[int]):
        self.parent: dict[int, int] = {}
        self.labels = labels

    def find(self, i: int) -> int:
        i = self.labels[i]
        root = i
        while (up := self.parent.get(root, root)) != root:
            root = up
        while i != root:
            self.parent[i], i = root, self.parent.get(i, i)
        return root

    def union(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def links(n: list[int], shingles: list[list[int]], prefix: list[int], labels: list[int],
          left: list[bool]) -> list[tuple[int, int]]:
    """Links that connect different ``labels``: a spanning forest of all links between rows of
    which one is on the left."""
    num, den = SIMILARITY
    forest, found = Forest(labels), []
    order = sorted(range(len(n)), key=lambda i: n[i])
    groups: dict[tuple, int] = {}
    members: list[list[int]] = []
    heads: list[tuple[int, tuple[int, ...]]] = []
    for i in order:
        key = n[i], tuple(shingles[i][:prefix[i]])
        g = groups.setdefault(key, len(members))
        if g == len(members):
            members.append([])
            heads.append(key)
        members[g].append(i)
    sets: dict[int, frozenset] = {}

    def shingle_set(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(shingles[i])
        return sets[i]

    def verify(i: int, j: int) -> None:
        if (left[i] or left[j]) and forest.find(i) != forest.find(j):
            need = num * (n[i] + n[j])  # |i & j| (den + num) >= num (|i| + |j|)
            if min(len(shingles[i]), len(shingles[j])) * (den + num) < need:
                return
            if len(shingle_set(i) & shingle_set(j)) * (den + num) >= need:
                forest.union(i, j)
                found.append((i, j))

    index: dict[int, list[tuple[int, int]]] = {}
    for g, (size, head) in enumerate(heads):
        unseen = size - len(shingles[members[g][0]])  # rarer shingles that nobody shares
        near: dict[int, bool] = {}
        for at, s in enumerate(head):
            posts = index.setdefault(s, [])
            for h, rest in posts:
                if h not in near:
                    other = heads[h][0]
                    # The first shared prefix shingle bounds the overlap by what is left.
                    bound = min(size - unseen - at, rest)
                    near[h] = other * den >= size * num and (
                        bound * (den + num) >= num * (size + other))
            posts.append((g, size - unseen - at))
        for k, i in enumerate(members[g]):
            for j in members[g][:k]:
                verify(i, j)
        for h, possible in near.items():
            if possible:
                for i in members[g]:
                    for j in members[h]:
                        verify(i, j)
    return found


def _link_groups(rows: pa.Table) -> pa.Table:
    """u, v: links of the clusters that were dealt to one group."""
    columns = [rows.column(c).to_pylist() for c in ("cluster", "uid", "n", "prefix", "label", "left")]
    lists = [x.values.to_numpy().tolist() for x in rows.column("shingles")]
    own: dict[int, list[int]] = {}
    for i, cluster in enumerate(columns[0]):
        own.setdefault(cluster, []).append(i)
    pairs = []
    for at in own.values():
        _, uid, n, prefix, label, left = ([c[i] for i in at] for c in columns)
        pairs += [(uid[i], uid[j]) for i, j in links(n, [lists[i] for i in at], prefix, label, left)]
    del columns, lists
    give_back()
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()),
                     pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _compare(rows: DataFrame) -> DataFrame:
    """Links within the groups named by ``task``; ``label`` says what is already connected."""
    return rows.select("task", "cluster", "uid", "n", "shingles", "prefix", "label", "left").groupBy(
        "task").applyInArrow(_link_groups, "u long, v long")


def _large_links(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links in clusters of several blocks (``blocks``: cluster, blocks).

    First the members are compared within blocks, dealt twice, which connects nearly all
    members of a group of near copies. What is not in a cluster's largest component then is
    compared with everything, block by block.
    """
    rows = written(rows.join(blocks, "cluster"), "jaccard-large")

    def dealt(seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("blocks"))
        return rows.select("*", F.xxhash64("cluster", block, F.lit(seed)).alias("task"),
                           F.col("uid").alias("label"), F.lit(True).alias("left"))

    first = written(_compare(dealt(1)).union(_compare(dealt(2))), "jaccard-blocks")
    found = components(first).select(F.col("node").alias("uid"), "component")
    labelled = written(rows.join(found, "uid", "left").withColumn(
        "label", F.coalesce("component", "uid")), "jaccard-labels")
    sizes = labelled.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("m", "label")).alias("top")).select(
        "cluster", F.col("top.label").alias("top_label"))
    sided = labelled.join(largest, "cluster").withColumn("left", F.col("label") != F.col("top_label"))
    weights = sided.groupBy("cluster").agg(
        F.sum(F.when(F.col("left"), F.size("shingles")).otherwise(0)).alias("weight"))
    block_of_left = F.ceil(F.col("weight") / BLOCK)
    dealt_rows = sided.join(weights.where("weight > 0"), "cluster").withColumn(
        "left_blocks", F.greatest(block_of_left, F.lit(1)))
    # Left block a meets every block b: rows on the left go to (own, all b) and, as the other
    # side, to (all a, own); the rest goes to (all a, own).
    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    left_own = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("left_blocks"))
    as_left = dealt_rows.where("left").select(
        "*", left_own.alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    as_right = dealt_rows.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)).alias("a"),
        own.alias("b"))
    met = as_left.unionByName(as_right.withColumn("left", F.lit(False))).groupBy(
        "cluster", "a", "b", "uid").agg(
        F.first("n").alias("n"), F.first("shingles").alias("shingles"),
        F.first("prefix").alias("prefix"), F.first("label").alias("label"),
        F.max("left").alias("left"))
    second = _compare(met.withColumn("task", F.xxhash64("cluster", "a", "b")))
    return first.union(second)


def _tasks(weight: int, parallelism: int) -> int:
    """Groups for small clusters that hold ``weight`` shingles: about ``BLOCK`` each at most."""
    return max(16 * parallelism, -(-weight // BLOCK))


def class_links(rows: DataFrame) -> DataFrame:
    """u, v: links between classes that connect all that any link connects."""
    rows = written(clusters(rows), "jaccard-clusters")
    sizes = written(rows.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("weight")),
                    "jaccard-weights")
    large = written(sizes.where(F.col("weight") > BLOCK).select(
        "cluster", F.ceil(F.col("weight") / BLOCK).alias("blocks")), "jaccard-sizes")
    small = rows.join(large, "cluster", "left_anti")
    # Many small clusters to a task group, whose size does not grow with the corpus.
    weight = sizes.where(F.col("weight") <= BLOCK).agg(F.sum("weight")).first()[0] or 0
    tasks = _tasks(weight, rows.sparkSession.sparkContext.defaultParallelism)
    found = _compare(small.select(
        "*", F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.col("uid").alias("label"),
        F.lit(True).alias("left")))
    return found if large.isEmpty() else found.union(_large_links(rows, large))


def _labelled(df: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with words: row, doc_id, n, class_id, component, component_id; all documents)."""
    documents, shared = shared_shingles(df, row)
    rows = written(candidates(documents, shared), "jaccard-candidates")
    found = components(class_links(rows))
    classes = documents.where("n > 0").groupBy("set_hash").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("class_id"))
    joined = classes.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labelled = joined.join(smallest, "component").select(
        "set_hash", "class_id", "component", "component_id")
    return documents.where("n > 0").join(labelled, "set_hash").select(
        "row", "doc_id", "n", "class_id", "component", "component_id"), documents


def join(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of ``df`` (doc_id, text).

    Linked are sets with Jaccard similarity of at least ``SIMILARITY``; components are those of the
    links. class_id and component_id are the smallest doc_id with the same set and in the
    component. Documents without words link with nothing: their class and component are
    their own doc_id. Rows with a null doc_id link like others; a component of nothing else has
    a null id. Repeated rows are copies of each other. Other columns of ``df`` do not matter.
    """
    worded, documents = _labelled(df)
    bare = documents.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"))
    return worded.select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id").union(bare)


def _numbered(df: DataFrame, place: str) -> DataFrame:
    """``df`` with a number ``place`` for every row that is the same each time it is read.

    In a table of up to ``BROADCAST_FILES`` files a row is known by its file and its place in it, and
    nothing is copied. Anything else is written once with the numbers.
    """
    spark = df.sparkSession
    try:
        files = df.select(F.col("_metadata.file_path").alias("file")).distinct()
    except AnalysisException:
        return written(df.withColumn(place, F.monotonically_increasing_id()), "jaccard-rows")
    names = sorted(r["file"] for r in files.limit(BROADCAST_FILES + 1).collect())
    if len(names) > BROADCAST_FILES:
        return written(df.withColumn(place, F.monotonically_increasing_id()), "jaccard-rows")
    number, file = f"{place}_number", f"{place}_file"
    numbers = spark.createDataFrame(list(enumerate(names)), f"`{number}` long, `{file}` string")
    located = df.withColumn(file, F.col("_metadata.file_path")).withColumn(
        place, F.col("_metadata.row_index"))
    in_order = F.shiftleft(F.col(number), 40) + F.col(place)
    return located.join(F.broadcast(numbers), file).withColumn(place, in_order).select(
        *(F.col(f"`{c}`") for c in df.columns), place)


def first_of_groups(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without those that the smallest doc_id of their component stands for.

    Of repeated rows with that id the first stays. Rows without words stay. Rows to leave out are
    known by a number that does not depend on the partitions in which ``df`` is read. The list of
    them is broadcast up to ``BROADCAST_ROWS`` and joined by shuffle beyond.
    """
    place = "row"
    while any(c.lower().startswith(place) for c in df.columns):
        place += "_"
    placed = _numbered(df, place)
    rows, _ = _labelled(placed, place)
    rows = written(rows.select("row", "doc_id", "component", "component_id"), "jaccard-components")
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("row").alias("kept"))
    dropped = written(rows.join(kept, "component").where("row <> kept").select(
        F.col("row").alias(place)), "jaccard-dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(dropped) if small else dropped, place, "left_anti").drop(place)
