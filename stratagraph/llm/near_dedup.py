"""Near-duplicate classes over five-word shingles at a Jaccard similarity of 0.8 or more.

1. One Arrow pass over the texts gives each row a 128-bit digest of its word sequence, a
   DartMinHash signature and its band keys. Texts never leave their task.
2. Rows of one digest are one node of what follows.
3. Nodes of one band key are compared with their leader, the node that meets most others under all
   its keys (the text that others were copied from, as a rule), which gives as many pairs as
   nodes. Those that fail choose a new leader among themselves, LEADS times in all.
4. Then every pair of nodes of one bucket that the links so far leave in different components is tested, in blocks of
   about BLOCK rows of at most 8 KB: a pair in the bucket of the first band it shares, most alike first, until links of the block join its components.
   A task hands on links only, fewer than it has nodes. No bucket is capped.
5. A pair whose signatures agree in under 0.64 of the coordinates is refused (a pair of
   similarity 0.8 falls below with probability about 1e-5), one that agrees in 0.98 is taken,
   and all others are decided by the exact similarity of the whole texts' shingles, held as 64-bit hashes.
6. Connected components of the links; the smallest id names the class.

Elements may be weighted. By default each distinct shingle weighs 1, so that the similarity is that of shingle sets; with
weights="count" a shingle weighs as many times as the text holds it, and the similarity is the weighted one (sum of smaller
weights by sum of larger ones).

Defined results
- Null and empty texts: one class. A text under five words is one shingle of its words.
- A row without id is no member of any class (class_id null, kept). Repeated rows: one class;
  `kept` is true on all rows of the class's id, as they are one document.
- Ties: of equal texts and of a class the smallest id; of leaders the first in the input.
- An id over different texts: each text has its own class. Classes may then have one name; `class_key` tells them apart.
- Empty table: no rows. Extra columns are ignored, whatever their names. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import BROADCAST_ROWS, bitmap_of, bound_batches, filter_by_ids, materialize, text_of, with_bit, with_groups
from .components import connected_components
from .dart_minhash import band_keys, signatures

BANDS, ROWS = 25, 5
THRESHOLD = 0.8
REFUSE, TAKE = 0.64, 0.98
#: Rows of at most ROW_BYTES that one side of a block holds (8 MB); a larger row counts as several.
BLOCK, ROW_BYTES = 1024, 8192
#: Rounds of leaders before blocks are compared.
LEADS = 2
_SKETCH = "row long, id long, h1 long, h2 long, sig binary, bands array<long>"


def _elements(sh: np.ndarray, owner: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Shingles, their texts, and their weights (None: 1 each)."""
    if not counted:
        return sh, owner, None
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])])) if len(sh) else np.zeros(0, np.int64)
    return sh[fresh], owner[fresh], np.diff(fresh, append=len(sh)).astype(float)


def _sketcher(counted: bool):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in S.small_batches(batches):
            ids = batch.column(0)
            for i, j, data, offsets in S.text_slices(batch.column(1)):
                words, bounds = S.word_hashes(data, offsets)
                same = S.sequence_digests(data, offsets)
                sh, owner, weights = _elements(*S.shingle_hashes(words, bounds), counted)
                sig = signatures(sh, owner, j - i, BANDS * ROWS, weights)
                keys = band_keys(sig, BANDS, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + j - i)),
                        ids.slice(i, j - i),
                        pa.array(np.ascontiguousarray(same[:, 0])),
                        pa.array(np.ascontiguousarray(same[:, 1])),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
                    ],
                    names=["row", "id", "h1", "h2", "sig", "bands"],
                )
                row += j - i

    return sketch


def _setter(counted: bool):
    """(h1, h2, set) of texts: distinct shingles in order and, where counted, their weights."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.small_batches(batches):
            for _, _, data, offsets in S.text_slices(batch.column(0)):
                same = S.sequence_digests(data, offsets)
                sh, owner, n = _elements(*S.shingle_hashes(*S.word_hashes(data, offsets)), True)
                cut = np.searchsorted(owner, np.arange(len(offsets)))
                _, one = np.unique(same, axis=0, return_index=True)
                blobs = [sh[a:b].tobytes() + (n[a:b].astype("<u4").tobytes() if counted else b"") for a, b in zip(cut[one].tolist(), cut[one + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(same[one, 0])), pa.array(np.ascontiguousarray(same[one, 1])), pa.array(blobs, pa.binary())], names=["h1", "h2", "set"])

    return sets


def _similar(a: bytes, b: bytes, counted: bool) -> bool:
    """Exact similarity of two sets or weighted sets of at least THRESHOLD."""
    if a == b:
        return True
    unit = 12 if counted else 8
    n, m = len(a) // unit, len(b) // unit
    if not counted and min(n, m) < THRESHOLD * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    if not n or not m:
        return False
    at = np.minimum(np.searchsorted(x, y), n - 1)
    hit = x[at] == y
    if counted:
        p, q = np.frombuffer(a, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(b, "<u4", m, 8 * m).astype(np.int64)
        both, total = int(np.minimum(p[at[hit]], q[hit]).sum()), int(p.sum() + q.sum())
    else:
        both, total = int(hit.sum()), n + m
    return both >= THRESHOLD * (total - both)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in S.small_batches(batches):
        if not batch.num_rows:
            continue
        a = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        b = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead"), pa.array((a == b).mean(axis=1))], names=["node", "lead", "agree"])


def _exact(counted: bool):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.small_batches(batches, 100):
            near = [_similar(x, y, counted) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead"), pa.array(near, pa.bool_())], names=["node", "lead", "near"])

    return exact


def _block(counted: bool):
    """Links that join components of one pair of blocks of a bucket."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        nodes, comp, side = (table.column(c).to_numpy() for c in ("node", "comp", "side"))
        band = table.column("band")[0].as_py()
        sets = table.column("set")
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(nodes), BANDS, ROWS)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)  # a block with itself
        b = a if alone else b
        left, right, share = [], [], []
        for i in a.tolist():
            js = b[(comp[b] != comp[i]) & ((nodes[b] > nodes[i]) | (not alone))]
            if not len(js):
                continue
            same = sig[js] == sig[i]
            agree = same.mean(axis=(1, 2))
            # The bucket of the first band that two nodes share tests them.
            hit = (agree >= REFUSE) & (same.all(axis=2).argmax(axis=1) == band)
            left.append(np.full(int(hit.sum()), i))
            right.append(js[hit])
            share.append(agree[hit])
        x, y, agree = (np.concatenate(p) if p else np.zeros(0, t) for p, t in ((left, np.int64), (right, np.int64), (share, float)))
        order = np.lexsort((nodes[y], nodes[x], -agree))
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        out: list[tuple[int, int]] = []
        held: dict[int, bytes] = {}
        for i, j, g in zip(x[order].tolist(), y[order].tolist(), agree[order].tolist()):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p == q:
                continue
            if g < TAKE:
                for k in (i, j):
                    if k not in held:
                        held[k] = sets[k].as_py()
                if not _similar(held[i], held[j], counted):
                    continue
            top[max(p, q)] = min(p, q)
            out.append((int(nodes[i]), int(nodes[j])))
        cols = list(zip(*out)) or [(), ()]
        return pa.table({"node": pa.array(cols[0], pa.int64()), "lead": pa.array(cols[1], pa.int64())})

    return block


def _decided(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, counted: bool) -> DataFrame:
    """The pairs(node, lead) that are similar enough, written."""
    both = pairs.join(sigs.select("node", F.col("sig").alias("sa")), "node").join(sigs.select(F.col("node").alias("lead"), F.col("sig").alias("sb")), "lead")
    agree = materialize(both.select("node", "lead", "sa", "sb").mapInArrow(_agreement, "node long, lead long, agree double").where(F.col("agree") >= REFUSE), "agree")
    taken = agree.where(F.col("agree") >= TAKE).select("node", "lead")
    ends = agree.where(F.col("agree") < TAKE).join(sets.select("node", F.col("set").alias("ta")), "node").join(sets.select(F.col("node").alias("lead"), F.col("set").alias("tb")), "lead")
    exact = ends.select("node", "lead", "ta", "tb").mapInArrow(_exact(counted), "node long, lead long, near boolean").where("near")
    return materialize(taken.unionByName(exact.select("node", "lead")), "links")


def _across(buckets: DataFrame, sigs: DataFrame, sets: DataFrame, links: DataFrame, counted: bool) -> DataFrame:
    """Links between nodes of one bucket(key, band, node) that links leave in different components."""
    comp = connected_components(links.select(F.col("node").alias("a"), F.col("lead").alias("b"))).select("node", F.col("component").alias("comp"))
    rows = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = materialize(rows.join(sets.select("node", F.ceil((F.length("set") + 4.0 * BANDS * ROWS) / ROW_BYTES).alias("cost")), "node"), "across_components")
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("key")  # both of a bucket of two were compared
    rows = rows.join(several, "key")
    # A component of over BLOCK rows has blocks of its own; the others share blocks.
    sizes = rows.groupBy("key", "comp").agg(F.sum("cost").alias("m"))
    small = sizes.groupBy("key").agg(F.sum(F.when(F.col("m") <= BLOCK, F.col("m")).otherwise(0)).alias("shared"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / BLOCK))
    rows = rows.join(sizes, ["key", "comp"]).join(small, "key").withColumn("own", F.when(F.col("m") > BLOCK, F.col("comp")))
    block = F.when(F.col("own").isNotNull(), F.xxhash64("own", salt("node", "m"))).otherwise(salt("comp", "shared"))
    rows = materialize(rows.select("key", "band", "node", "comp", "own", block.alias("p")), "across_rows")
    blocks = rows.select("key", "p", "own").distinct()
    other = blocks.select("key", F.col("p").alias("q"), F.col("own").alias("own_q"))
    todo = materialize(blocks.join(other, "key").where("p <= q and not (own <=> own_q and own is not null)").select("key", "p", "q"), "across_todo")
    columns = ["key", "p", "q", "band", "side", "node", "comp"]
    sides = rows.join(todo, ["key", "p"]).withColumn("side", F.lit(0)).select(*columns).unionByName(
        rows.withColumnRenamed("p", "q").join(todo.where("p <> q"), ["key", "q"]).withColumn("side", F.lit(1)).select(*columns)
    )
    whole = sides.join(sigs, "node").join(sets, "node")
    return materialize(whole.groupBy("key", "p", "q").applyInArrow(_block(counted), "node long, lead long"), "links_across")


def near_links(nodes: DataFrame, docs: DataFrame, counted: bool = False) -> DataFrame:
    """Verified links (a, b) between nodes(node, id, h1, h2, sig, bands), which stand for rows of docs(id, text)."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(members.join(counts, "key").select("key", "band", "node", "n"), "buckets")
    near = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    sigs = materialize(near.select("node", "id", "h1", "h2", "sig"), "signatures")
    texts = with_bit(docs, "id", bitmap_of(sigs, "id"), "__bit").where("__bit").select("text")
    sets = texts.mapInArrow(_setter(counted), "h1 long, h2 long, set binary").join(sigs.select("h1", "h2", "node"), ["h1", "h2"]).dropDuplicates(["node"]).select("node", "set")
    sets, sigs = materialize(sets, "sets"), sigs.select("node", "sig")
    links, left = None, buckets
    for turn in range(LEADS):
        meets = left.groupBy("node").agg(F.sum("n").alias("meets"))
        scored = left.join(meets, "node")
        leads = scored.groupBy("key").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("lead"))
        open_rows = materialize(scored.select("key", "node").join(leads, "key").where("node <> lead"), "open")
        found = _decided(open_rows.select("node", "lead").distinct(), sigs, sets, counted)
        links = found if links is None else links.unionByName(found)
        if turn + 1 < LEADS:
            left = open_rows.join(found, ["node", "lead"], "left_anti").select("key", "node")
            left = materialize(left.join(left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "left")
    links = links.unionByName(_across(buckets, sigs, sets, links, counted))
    return links.select(F.col("node").alias("a"), F.col("lead").alias("b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, weights: str) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2, class_key, class_id) of rows with an id, written; and the rows without."""
    if weights not in ("set", "count"):
        raise ValueError(f"weights: set or count, not {weights!r}")
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    known = base.where("id is not null")
    sketch = materialize(known.mapInArrow(_sketcher(weights == "count"), _SKETCH), "sketch")
    same = materialize(sketch.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("id").alias("rep")), "nodes")
    nodes = sketch.withColumnRenamed("row", "node").join(same.select("node"), "node", "left_semi")
    comp = connected_components(near_links(nodes, known, weights == "count"))
    named = comp.join(same.select("node", "rep"), "node").withColumnRenamed("component", "class_key")
    names = materialize(named.join(named.groupBy("class_key").agg(F.min("rep").alias("class_id")), "class_key").select("node", "class_key", "class_id"), "names")
    side = F.broadcast(names) if names.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4 else names
    of = same.join(side, "node", "left").select("h1", "h2", F.coalesce("class_key", "node").alias("class_key"), F.coalesce("class_id", "rep").alias("class_id"))
    return materialize(sketch.select("id", "h1", "h2").join(of, ["h1", "h2"]), "classes"), base.where("id is null")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = "set") -> DataFrame:
    """One row per input row: id_col, class_id (smallest id of the class), class_size (documents), kept, class_key."""
    classes, without = _classes(docs, id_col, text_col, weights)
    sizes = classes.groupBy("class_key").agg(F.count_distinct("id").alias("class_size"), F.count("*").alias("rows")).where("rows > 1")
    sized = with_groups(classes, materialize(sizes, "class_sizes"), "class_key", "rows")
    out = sized.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"), "class_key")
    none = F.lit(None).cast("long")
    lone = without.select(F.col("id").alias(id_col), none.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), none.alias("class_key"))
    return out.unionByName(lone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = "set") -> DataFrame:
    """One document of each class stays, with all its columns; rows without id stay. Of an id over several texts each text is a document."""
    classes, _ = _classes(docs, id_col, text_col, weights)
    kept, gone = classes.where("id = class_id"), classes.where("id <> class_id").select(F.col("id").alias(id_col)).distinct()
    out = filter_by_ids(docs, materialize(gone, "near_gone"), id_col, "left_anti")
    # Ids of which one text goes and another stays.
    mixed = materialize(gone.join(kept.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"), "near_mixed")
    if not mixed.limit(1).count():
        return out

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.small_batches(batches):
            at = batch.schema.get_field_index(text_col)
            same = [S.sequence_digests(data, offsets) for _, _, data, offsets in S.text_slices(batch.column(at))]
            both = np.concatenate([np.zeros((0, 2), np.int64), *same])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[*batch.schema.names, "__h1", "__h2"])

    schema = docs.limit(0).withColumns({"__h1": F.lit(0).cast("long"), "__h2": F.lit(0).cast("long")}).schema
    rows = docs.join(mixed, id_col, "left_semi").select(*docs.columns).mapInArrow(digest, schema)
    stay = kept.select(F.col("id").alias(id_col), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    return out.select(*docs.columns).unionByName(rows.join(stay, [id_col, "__h1", "__h2"], "left_semi").select(*docs.columns))
