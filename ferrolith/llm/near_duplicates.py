"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.llm.bytetext import Chunk, mix, span_hashes, windows
from ferrolith.llm.columns import with_text_columns
from ferrolith.llm.components import components, forest
from ferrolith.llm.stages import written

WORDS = 5
PERCENT = 80

SLOTS = 128
BANDS = 32
#: Of a pair's signatures, the share of equal slots below which it is no candidate: about six standard deviations
#: below 0.8, so that a true pair is lost with a probability under 1e-7, as by the bands.
LEAST_SHARE = 0.6
#: Members of a bucket that are compared at once; larger buckets are cut into blocks of this size, two of which meet.
BLOCK = 2000
#: Rows of one bigint (16 MB in memory) up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000

_STEP = 0x9E3779B97F4A7C15
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, in order; A-Z counts as a-z. A document with fewer
    words has its whole sequence as its one shingle."""
    lowered = chunk.lowered()
    start, end, doc = lowered.words()
    hashes = span_hashes(lowered.data, start, end)
    at, shingle = windows(hashes, doc, words)
    docs, found = [doc[at]], [shingle]
    count = chunk.per_doc(doc)
    for few in range(1, words):
        short = count[doc] == few
        at, shingle = windows(hashes[short], doc[short], few)
        docs.append(doc[short][at])
        found.append(mix(shingle + np.uint64(few)))
    docs, found = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(found)
    order = order[np.argsort(docs[order].astype(np.uint32), kind="stable")]
    docs, found = docs[order], found[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    return docs[fresh], found[fresh]


def super_minhash(doc: np.ndarray, element: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (n x slots) of the sets given as (document, element) rows; all ones for an empty set.

    Each element visits the slots in an order of its own, a random permutation drawn step by step, and brings the value
    step + fraction to the slot of each step. All elements take a step together; a document stops as soon as its slots
    are all filled, for what comes later is larger.
    """
    out = np.full((n, slots), _FREE, np.uint64)
    flat = out.reshape(-1)
    live = np.arange(len(doc))
    order = None  # of slots, for the live elements: what is left of each one's permutation
    for step in range(slots):
        if not len(live):
            break
        draw = mix(element[live] + np.uint64(_STEP * (step + 1) % (1 << 64)))
        pick = ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(slots - step)).astype(np.int64) + step
        if step == 0:
            slot = pick
        else:
            rows = np.arange(len(live))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
        np.minimum.at(flat, doc[live] * slots + slot, (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_docs = (out == _FREE).any(axis=1)
        on = open_docs[doc[live]]
        if step == 0:
            pick = pick[on]
            live = live[on]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
            order[np.arange(len(live)), pick] = 0
        elif not on.all():
            live, order = live[on], order[on]
    return out


def sketch_chunk(chunk: Chunk, words: int) -> dict[str, object]:
    doc, element = shingle_sets(chunk, words)
    n = chunk.n
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(first, doc, mix(element))
    np.add.at(second, doc, mix(element ^ np.uint64(0x5851F42D4C957F2D)))
    signature = super_minhash(doc, element, n)
    bands = np.zeros((n, BANDS), np.uint64)
    rows = SLOTS // BANDS
    for r in range(rows):
        bands = mix(bands + signature[:, r::rows])
    bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP))
    short = mix(signature).astype(np.uint8)
    return {
        "n_shingles": chunk.per_doc(doc),
        "d1": first.view(np.int64),
        "d2": second.view(np.int64),
        "signature": [r.tobytes() for r in short],
        "bands": list(bands.view(np.int64)),
    }


SKETCH = {"n_shingles": "bigint", "d1": "bigint", "d2": "bigint", "signature": "binary", "bands": "array<bigint>"}


def sketch(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """keep and SKETCH: size and 128-bit digest of the set of shingles, eight bits of each slot, and the band hashes."""
    return with_text_columns(docs, lambda: lambda chunk: sketch_chunk(chunk, words), SKETCH, keep)


def set_elements(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, elements): the full sets, as ascending 64-bit hashes."""

    def elements(chunk: Chunk) -> dict[str, object]:
        doc, element = shingle_sets(chunk, words)
        return {"elements": np.split(element.view(np.int64), np.cumsum(chunk.per_doc(doc))[:-1])}

    return with_text_columns(docs, lambda: elements, {"elements": "array<bigint>"}, ["doc_id"])


@F.pandas_udf(T.DoubleType())
def equal_share(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SLOTS) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _near(x: str, y: str, percent: int):
    """Whether sets of these sizes can be alike enough."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _checked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and signatures allow a link."""
    light = classes.select("node", "n_shingles", "signature")
    a, b = (light.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").where(_near("n_a", "n_b", percent)).where(equal_share("s_a", "s_b") >= LEAST_SHARE).select("a", "b")


def _semi_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (one bigint column); ids is broadcast only if counted small enough."""
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (one bigint column, written); rows without doc_id stay."""
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, written."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    # several rows may share an id: a pair is linked if any of their texts are
    sets = written(set_elements(_semi_by_id(docs, ids), words), "near-sets")
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("elements").alias(f"e_{k}")) for k in "ab")
    common = F.size(F.array_intersect("e_a", "e_b"))
    linked = pairs.join(a, "a").join(b, "b").where(100 * common >= percent * (F.size("e_a") + F.size("e_b") - common))
    return written(linked.select("a", "b").distinct(), "near-links")


def _forest_frame(a: list, b: list) -> pd.DataFrame:
    """The links as a forest: as many rows as there are nodes at most."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    node, root = forest(a, b) if len(a) else (a, b)
    return pd.DataFrame({"a": root, "b": node})


def _joining(signatures: np.ndarray, sizes: np.ndarray, groups: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, confirm=None):
    """Links (rows i, j) of left x right, between different groups, whose sizes and signatures allow a link and which
    confirm(i, j) confirms; enough of them to join all labels that they join. Some rows of left are compared at a time;
    what they join has one label from then on (labels are changed), so that pairs which are joined already are not
    looked at again, however many they are."""
    step = max(1, (1 << 17) // max(1, len(right)))
    for lo in range(0, len(left), step):
        i, j = (x.reshape(-1) for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
        fit = (groups[i] != groups[j]) & (labels[i] != labels[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        fit &= (i < j) if left is right else True
        i, j = i[fit], j[fit]
        near = [(signatures[i[at : at + (1 << 15)]] == signatures[j[at : at + (1 << 15)]]).mean(axis=1) >= LEAST_SHARE for at in range(0, len(i), 1 << 15)]
        near = np.concatenate([np.zeros(0, bool), *near])
        i, j = i[near], j[near]
        if len(i) and confirm is not None:
            linked = confirm(i, j)
            i, j = i[linked], j[linked]
        if len(i):
            node, root = forest(labels[i], labels[j])
            at = np.minimum(np.searchsorted(node, labels), len(node) - 1)
            labels[:] = np.where(node[at] == labels, root[at], labels)
            yield i, j


def common_elements(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets i and j, exactly: as bit rows over the elements that two sets hold."""
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.array([len(sets[k]) for k in used])
    _, code, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(used)), size)[shared[code]]
    place = column[code[shared[code]]]
    bits = np.zeros((len(used), (int(shared.sum()) + 7) // 8), np.uint8)
    np.bitwise_or.at(bits, (row, place >> 3), np.uint8(1) << (place & 7).astype(np.uint8))
    i, j = where[: len(i)], where[len(i) :]
    step = max(1, (1 << 24) // max(1, bits.shape[1]))
    return np.concatenate([np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), step)])


def _dealt(members: DataFrame, group: str, rows_a_task: int) -> DataFrame:
    """members (node, component) dealt to tasks, so that all pairs of a group that differ in their component meet once.

    A component of more than BLOCK rows in a group is cut into blocks of its own, which meet only blocks of others; the
    smaller ones share blocks, which also meet each other and themselves. Columns own, i, j tell a row's block and the
    two that meet, task what is worked on at once: one meeting (two blocks) of a large group, or some small groups.
    """
    parts = members.groupBy(group, "component").agg(F.count(F.lit(1)).alias("_c"))
    large = F.when(F.col("_c") > BLOCK, F.struct("component", F.ceil(F.col("_c") / BLOCK).cast("int").alias("blocks")))
    small = F.coalesce(F.sum(F.when(F.col("_c") <= BLOCK, F.col("_c"))), F.lit(0))
    groups = parts.groupBy(group).agg(F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("_n"), F.ceil(small / BLOCK).cast("int").alias("_shared"), F.array_sort(F.collect_list(large)).alias("_large"))
    # the component that each block belongs to, null for a shared one
    owners = F.concat(F.array_repeat(F.lit(None).cast("bigint"), F.col("_shared")), F.flatten(F.transform("_large", lambda x: F.array_repeat(x["component"], x["blocks"]))))
    groups = groups.where("_k > 1").select(group, "_n", "_shared", owners.alias("_owners"))
    groups = written(groups.withColumn("_alone", (F.size("_owners") > 1) | (F.col("_n") > rows_a_task // 10)), "near-groups")
    bundled = groups.where("not _alone").agg(F.sum("_n")).first()[0] or 0
    first = F.array_position("_owners", F.col("component")).cast("int")
    mine = F.when(first > 0, F.size(F.filter("_owners", lambda x: x == F.col("component")))).otherwise(F.col("_shared"))
    own = F.greatest(first - 1, F.lit(0)) + F.pmod(F.xxhash64("node"), mine).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.size("_owners") - 1), lambda k: F.coalesce(F.get("_owners", k) != F.col("component"), F.lit(True)))
    out = members.join(groups, group).withColumn("own", own).withColumn("other", F.explode(met))
    out = out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    task = F.when(F.col("_alone"), F.xxhash64(group, "i", "j")).otherwise(F.pmod(F.xxhash64(group), F.lit(max(1, -(-bundled // rows_a_task)))))
    return out.withColumn("task", task).drop("other", "_n", "_shared", "_owners", "_alone")


def _meetings(frame: pd.DataFrame, group: str):
    """The row numbers of the two blocks of each meeting (the same array twice within a block)."""
    own, i, j = (frame[c].to_numpy() for c in ("own", "i", "j"))
    order = np.lexsort((j, i, frame[group].to_numpy()))
    key = np.stack([frame[group].to_numpy()[order], i[order], j[order]])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    for rows in np.split(order, cuts):
        if len(rows) > 1:
            left = rows[own[rows] == i[rows]]
            yield left, left if i[rows[0]] == j[rows[0]] else rows[own[rows] == j[rows]]


def _signatures(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(-1, SLOTS)


def _clusters(shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up, over whatever path, all classes that share a bucket but not a component and whose
    sizes and signatures allow a link. Each task returns a forest, so that rows stay below 32 a class."""
    labelled = shared.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    members = written(labelled.join(mixed, "band").join(classes.select("node", "n_shingles", "signature"), "node"), "near-mixed")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        signature, size, component, node = _signatures(frame), frame["n_shingles"].to_numpy(), frame["component"].to_numpy(), frame["node"].to_numpy()
        a, b = [], []
        for left, right in _meetings(frame, "band"):
            for i, j in _joining(signature, size, component, np.arange(len(frame)), left, right, percent):
                links = _forest_frame([node[i]], [node[j]])
                a.append(links["a"].to_numpy())
                b.append(links["b"].to_numpy())
        return _forest_frame(a, b)

    return _dealt(members, "band", 20_000).groupBy("task").applyInPandas(compare, "a bigint, b bigint").distinct()


def _links_across(docs: DataFrame, shared: DataFrame, labels: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between different components, from all pairs of classes that share a bucket: the classes that may be
    linked are gathered into clusters by their signatures, and each cluster's pairs are checked on full sets where the
    sets are, block by block. Only a forest of the links found leaves a task."""
    joined = written(_clusters(shared, labels, classes, percent), "near-clusters")
    if joined.isEmpty():
        return None
    cluster = written(components(joined).select("node", F.col("component").alias("cluster")), "near-cluster-nodes")
    sets = set_elements(_semi_by_id(docs, cluster.select(F.col("node").alias("doc_id"))), words).withColumnRenamed("doc_id", "node")
    members = cluster.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members.join(classes.select("node", "n_shingles", "signature"), "node").join(sets, "node"), "near-members")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        signature, size, component, node = _signatures(frame), frame["n_shingles"].to_numpy(), frame["component"].to_numpy(), frame["node"].to_numpy()
        sets = frame["elements"].to_list()
        held = np.array([len(x) for x in sets])

        def confirmed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            common = common_elements(sets, i, j)
            return 100 * common >= percent * (held[i] + held[j] - common)

        a, b = [], []
        for left, right in _meetings(frame, "cluster"):
            for i, j in _joining(signature, size, component, component.copy(), left, right, percent, confirmed):
                links = _forest_frame([node[i]], [node[j]])
                a.append(links["a"].to_numpy())
                b.append(links["b"].to_numpy())
        return _forest_frame(a, b)

    return _dealt(members, "cluster", 2_000).groupBy("task").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its set), component_id (the smallest doc_id that it reaches over
    links of at least percent % Jaccard similarity), kept (whether that is itself).

    Documents of equal sets form a class, which its smallest doc_id stands for; no pairs are made within it. In each
    bucket of a band all classes are compared with the smallest, then classes that share a bucket but not yet a
    component with each other; links are confirmed on full sets. A null text or one without words has an empty set and
    is linked with nothing. Rows of one doc_id are one document. A row without doc_id is linked with nothing: its
    component_id is null and it is kept.
    """
    docs = docs.select("doc_id", "text")
    sketches = written(sketch(docs, ["doc_id"], words), "near-sketches")
    digest = ["d1", "d2", "n_shingles"]
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "near-classes")
    buckets = classes.select("node", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader")
    shared = written(buckets.join(leaders, "band"), "near-buckets")
    pairs = shared.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = written(_checked(pairs, classes, percent), "near-pairs")
    links = verified(first, docs, words, percent)
    labels = written(components(links), "near-labels")
    more = _links_across(docs, shared, labels, classes, words, percent)
    if more is not None:
        labels = components(links.unionByName(more))
    known = classes.select(*digest, "node").join(labels, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in digest], F.coalesce("component", "node").alias("component"))
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_shingles") == F.col("_n_shingles")) & F.col("doc_id").isNotNull()
    found = sketches.drop("signature", "bands").join(known, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM texts WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(node, root) AS (
  SELECT DISTINCT a, a FROM ways UNION SELECT b, root FROM reached JOIN ways ON a = node
), found AS (
  SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN found ON node = doc_id
"""
