"""Self-join of texts by the Jaccard similarity of their word shingles, found along chosen paths.

A text is a set of shingles, and the set a signature of minima under fixed hash functions. Every run starts with all sets
in one node. A node samples one or two coordinates (1 / threshold on average) and splits its sets by the shingle they
have there, so similar sets walk on together and others part. Nodes of a few sets are compared by brute force, larger ones
take two pivots: sets close to one are done, the rest walks on. Runs are repeated until the recall asked for.

Paths only decide which texts belong together loosely. Inside such a group all pairs are then compared exactly, block by
block, each pair in one task, so a link is never lost because one of its buckets was large. Tasks return counts and a
spanning forest, never the pairs. Equal texts are one set with a number of rows throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_map, components, discard, row_of, stored, unfolded
from attest.llm.hashing import Words, mix, scramble, shingles_of, signed, slices, text_column, words_of

COORDINATES = 64
SMALL = 256
CLOSE = 0.7  # a set of a large node that is this like a pivot walks no further
BLOCK = 256
RUNS_AT_ONCE = 12  # paths that a task holds of each set
_SEEDS = scramble(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | np.uint64(1)


def survival(threshold: float, depth: int) -> float:
    """The chance that two sets at the threshold still share a node at a depth."""
    second = 1 / threshold - 1
    chance = 1.0
    for _ in range(depth):
        step = threshold * chance
        chance = (1 - second) * step + second * (1 - (1 - step) ** 2)
    return chance


def runs_for(recall: float, threshold: float, depth: int = 4) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, ordered by both; fewer words than `width` make one shingle."""
    words = words_of(raw, at)
    doc, code = shingles_of(words, width)
    counts = words.counts(len(at) - 1)
    few = (counts[words.doc] < width) if len(words.doc) else np.zeros(0, bool)
    if few.any():
        short = Words(words.doc[few], words.start[few], words.end[few], words.code[few])
        heads = np.flatnonzero(np.r_[True, short.doc[1:] != short.doc[:-1]])
        sizes = np.diff(np.r_[heads, len(short.doc)])
        whole = short.code[heads]
        for k in range(1, width - 1):
            more = sizes > k
            whole[more] = mix(whole[more], short.code[heads[more] + k])
        doc, code = np.concatenate([doc, short.doc[heads]]), np.concatenate([code, whole])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[keep], code[keep]


def _signature_rows(width: int):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            raw, at = text_column(part.column("text"))
            doc, code = shingle_sets(raw, at, width)
            if not len(doc):
                continue
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            marks = np.empty((len(heads), COORDINATES), np.uint32)
            for k in range(COORDINATES):
                marks[:, k] = np.minimum.reduceat(((code ^ _XOR[k]) * _ODD[k]) >> np.uint64(32), heads)
            data, step = marks.tobytes(), 4 * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(doc[heads])), part.column("least").take(pa.array(doc[heads])),
                 pa.array([data[k:k + step] for k in range(0, len(data), step)], pa.binary())],
                names=["key", "least", "signature"])

    return rows


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _children(node: np.ndarray, marks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node): one or two sampled coordinates of every node, split by the mark there."""
    draw = scramble(node + np.uint64(77))
    both = (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53) < 1 / threshold - 1
    rows, nodes = [], []
    for turn, some in ((1, np.ones(len(node), bool)), (2, both)):
        row = np.flatnonzero(some)
        pick = scramble(node[row] * np.uint64(2) + np.uint64(turn)) % np.uint64(COORDINATES)
        value = marks[row, pick.astype(np.int64)].astype(np.uint64)
        rows.append(row)
        nodes.append(mix(mix(node[row], pick + np.uint64(turn * COORDINATES)), value))
    return np.concatenate(rows), np.concatenate(nodes)


def _path_rows(first: int, last: int, threshold: float, depth: int):
    """`depth` steps of the runs `first` to `last` (not included) from their roots."""
    def rows(batch: pa.RecordBatch):
        marks = _marks(batch.column("signature"))
        for low in range(first, last, RUNS_AT_ONCE):
            runs = np.arange(low + 1, min(low + RUNS_AT_ONCE, last) + 1, dtype=np.uint64)
            row = np.tile(np.arange(batch.num_rows), len(runs))
            node = np.repeat(scramble(runs), batch.num_rows)
            for _ in range(depth):
                step, node = _children(node, marks[row], threshold)
                row = row[step]
            yield pa.RecordBatch.from_arrays([pa.array(signed(node)), batch.column("key").take(pa.array(row)),
                                              pa.array(np.full(len(row), depth, np.int32))], names=["node", "key", "depth"])

    return rows


def _pivot_rows(threshold: float, near: float, far: float):
    """Rows of large nodes: edges to the pivots that are near, and the way on unless the set is close to one."""
    def rows(batch: pa.RecordBatch):
        marks = _marks(batch.column("signature"))
        node = batch.column("node").to_numpy().view(np.uint64)
        key = batch.column("key").to_numpy()
        alike = [(marks == _marks(batch.column(c))).mean(1) for c in ("low_signature", "high_signature")]
        own, other = [], []
        for share, pivot in zip(alike, ("low", "high")):
            edge = np.flatnonzero(share >= far)
            own.append(key[edge])
            other.append(batch.column(pivot).to_numpy()[edge])
        on = np.flatnonzero(np.maximum(*alike) < near)
        # larger nodes take more steps at once
        steps = np.clip(np.ceil(np.log2(batch.column("n").to_numpy()[on] / SMALL) * 2), 1, 4).astype(np.int64)
        deep = batch.column("depth").to_numpy()[on] + steps
        keys, children, depths = [], [], []
        on_node = node[on]
        while len(on):
            step, on_node = _children(on_node, marks[on], threshold)
            on, steps, deep = on[step], steps[step] - 1, deep[step]
            there = steps == 0
            keys.append(key[on[there]])
            children.append(on_node[there])
            depths.append(deep[there])
            on, on_node, steps, deep = on[~there], on_node[~there], steps[~there], deep[~there]
        edges, ways = sum(map(len, own)), sum(map(len, keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(edges, np.int64), *map(signed, children)])),
             pa.array(np.concatenate([*own, *keys])), pa.array(np.concatenate([*other, np.zeros(ways, np.int64)])),
             pa.array(np.r_[np.ones(edges, bool), np.zeros(ways, bool)]),
             pa.array(np.concatenate([np.zeros(edges, np.int32), *depths]).astype(np.int32))],
            names=["node", "key", "pivot", "edge", "depth"])

    return rows


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that rows with equal `columns` are never apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in columns]
        same = np.ones(batch.num_rows, bool)
        for c, value in zip(columns, last):
            same &= batch.column(c).to_numpy(zero_copy_only=False) == value
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held and not all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == batch.column(c)[0].as_py() for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find: each member's root."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _bucket_edges(alike: float):
    """A spanning forest of the like pairs of each node; pairs that are connected already are not compared."""
    def over(batches):
        for table in whole_groups(batches, ["node"]):
            node, key = table.column("node").to_numpy(), table.column("key").to_numpy()
            marks = _marks(table.column("signature").combine_chunks())
            root = np.arange(len(node))
            a, b = [], []
            for apart in range(1, SMALL):
                same = node[apart:] == node[:-apart]
                if not same.any():
                    break
                first = np.flatnonzero(same & (root[apart:] != root[:-apart]))
                first = first[(marks[first] == marks[first + apart]).mean(1) >= alike]
                if not len(first):
                    continue
                a.append(key[first])
                b.append(key[first + apart])
                tree = _forest(zip(root[first].tolist(), root[first + apart].tolist()))
                move = np.arange(len(node))
                move[list(tree)] = list(tree.values())
                root = move[root]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return over


def _walk(marks: DataFrame, starts: DataFrame, first: int, last: int, threshold: float, depth: int, most_depth: int,
          plain_depth: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Edges found by some runs from `starts`, the keys of sets in nodes deeper than `plain_depth`, and the depth reached."""
    spread = 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    alike, near = threshold - spread, min(CLOSE, threshold)
    far = max(0.0, near + threshold - 1 - spread / 2)  # whatever is similar to a set that is close to a pivot
    way = stored(arrow_map(starts, _path_rows(first, last, threshold, depth), "node long, key long, depth int"), "paths")
    edges, deep, reached = [], [], depth
    for _ in range(most_depth):
        nodes = stored(way.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
            F.max("depth").alias("depth")).where("n > 1"), "nodes")
        met = stored(way.drop("depth").join(nodes.select("node", "n", "depth"), "node").join(marks, "key"), "met")
        small = met.where(F.col("n") <= SMALL).select("node", "key", "signature").repartition("node").sortWithinPartitions("node")
        edges.append(stored(small.mapInArrow(_bucket_edges(alike), "a long, b long").distinct(), "edges"))
        large, deepest = nodes.agg(F.count_if(F.col("n") > SMALL), F.max("depth")).first()
        reached = max(reached, deepest or 0)
        if (deepest or 0) > plain_depth:
            deep.append(stored(met.where(F.col("depth") > plain_depth).select("key").distinct(), "deep"))
        if not large:
            break
        pivots = nodes.where(F.col("n") > SMALL).drop("n", "depth")
        for pivot in ("low", "high"):
            pivots = pivots.join(marks.select(F.col("key").alias(pivot), F.col("signature").alias(f"{pivot}_signature")), pivot)
        pivots = stored(pivots, "pivots")
        walked = stored(arrow_map(met.where(F.col("n") > SMALL).join(pivots, "node").select(
            "node", "key", "n", "depth", "low", "high", "signature", "low_signature", "high_signature"), _pivot_rows(threshold, near, far),
            "node long, key long, pivot long, edge boolean, depth int"), "walked")
        discard(met)
        edges.append(walked.where("edge").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        way = walked.where("not edge").select("node", "key", "depth")
    else:
        raise RuntimeError("sets do not part along their paths")
    return edges, deep, reached


def loose_edges(sets: DataFrame, threshold: float, recall: float, depth: int = 2, most_depth: int = 60,
                plain_depth: int = 4) -> DataFrame:
    """(a, b): a spanning set of edges between the keys of `sets` (key, signature) that may be similar.

    The first runs give the recall for nodes of at most `plain_depth` steps. Sets that met others in deeper nodes, where a
    similar pair is likelier to have parted, start again in as many further runs as the depth that was reached needs.
    """
    marks = sets.select("key", "signature")
    starts, edges, done, needed = marks, [], 0, runs_for(recall, threshold, plain_depth)
    while done < needed:
        found, deep, reached = _walk(marks, starts, done, needed, threshold, depth, most_depth, plain_depth)
        edges += found
        done, needed = needed, max(needed, runs_for(recall, threshold, reached))
        if not deep:
            break
        starts = stored(marks.join(reduce(DataFrame.union, deep).distinct(), "key", "left_semi"), "starts")
    return reduce(DataFrame.union, edges)


def _set_rows(width: int):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            raw, at = text_column(part.column("text"))
            doc, code = shingle_sets(raw, at, width)
            sizes = np.bincount(doc, minlength=part.num_rows)
            stops = np.cumsum(sizes) * 8
            data = code.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("root"), part.column("key"), part.column("n"), part.column("blocks"),
                 pa.array([data[b:e] for b, e in zip((stops - sizes * 8).tolist(), stops.tolist())], pa.binary())],
                names=["root", "key", "n", "blocks", "shingles"])

    return rows


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code = np.concatenate(sets)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    new = np.r_[True, code[1:] != code[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), np.float64)
    if not len(owner):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    step = max(256, (1 << 22) // len(sets))
    for first in range(0, int(column[-1]) + 1, step):
        low, high = np.searchsorted(column, [first, first + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[low:high], column[low:high] - first] = 1
        out += part @ part.T
    return out


def _pair_rows(threshold: float):
    share = threshold / (1 + threshold)

    def over(batches):
        for table in whole_groups(batches, ["root", "low", "high"]):
            names = ("root", "low", "high", "key", "n", "block")
            root, low, high, key, n, block = (table.column(c).to_numpy() for c in names)
            data = table.column("shingles").to_pylist()
            heads = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            keys, links, tops = [], [], []
            for b, e in zip(heads.tolist(), [*heads[1:].tolist(), len(root)]):
                if e - b < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in data[b:e]]
                sizes = np.array([len(s) for s in sets], np.float64)
                like = _overlaps(sets) >= share * (sizes[:, None] + sizes[None, :]) - 1e-9
                np.fill_diagonal(like, False)
                if low[b] != high[b]:
                    like &= block[b:e, None] != block[None, b:e]
                if not like.any():
                    continue
                tree = _forest(map(tuple, np.argwhere(np.triu(like)).tolist()))
                own = np.flatnonzero(like.any(1))
                keys.append(key[b:e][own])
                links.append(like[own] @ n[b:e])
                tops.append(key[b:e][[tree[x] for x in own.tolist()]])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, links, tops)],
                                                 names=["key", "links", "top"])

    return over


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))


def text_classes(rows: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(key, n, least, class, links) of every distinct text with a word of `rows` (doc_id, key, text): its rows, their
    smallest id, the smallest key of the texts connected with it, and the rows of the other texts linked to it."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed_rows = arrow_map(rows.select("key", "text", F.col("doc_id").alias("least")), _signature_rows(width),
                            f"key long, least {kind}, signature binary")
    sets = stored(signed_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"),
                                                 F.first("signature").alias("signature")), "sets")
    groups = stored(components(loose_edges(sets, threshold, recall), "loose").select(F.col("node").alias("key"), "root"), "loose")
    counted = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = stored(groups.join(stored(counted, "counted"), "root").join(sets.select("key", "n"), "key"), "members")
    once = rows.groupBy("key").agg(F.first("text").alias("text"))
    whole = stored(arrow_map(once.join(members, "key").select("root", "key", "n", "blocks", "text"), _set_rows(width),
                             "root long, key long, n long, blocks int, shingles binary"), "shingles")
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    dealt = whole.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "n", "block", "shingles")
    linked = stored(dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(
        _pair_rows(threshold), "key long, links long, top long"), "linked")
    discard(whole)
    classes = components(linked.select(F.col("key").alias("a"), F.col("top").alias("b")), "classes")
    classes = classes.select(F.col("node").alias("key"), F.col("root").alias("class"))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    return stored(sets.select("key", "n", "least").join(classes, "key", "left").join(links, "key", "left").select(
        "key", "n", "least", F.coalesce("class", "key").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "classes")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8,
                   recall: float = 0.999) -> DataFrame:
    """(doc_id, key, class_id, n_links) of every row.

    Two rows are linked if their sets of `width`-word shingles have a Jaccard similarity of at least `threshold`; fewer
    words than `width` are one shingle, and a text without words (or null) is linked to nothing. class_id is the smallest
    doc_id of all rows connected by links (null where all are null), n_links the number of other rows linked to the row,
    repeated rows and equal texts included. `key` is the 64-bit hash that stands for the text. Links of texts that the
    paths bring together are all found; runs are repeated until a link at the threshold shares a node at depth 4 with a
    chance of `recall`. Ties need no rule; an empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, doc_id, text)
    known = text_classes(rows, width, threshold, recall)
    first = stored(known.groupBy("class").agg(F.min("least").alias("class_id")), "first")
    told = stored(known.join(first, "class").select(
        "key", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links")), "told")
    return rows.select("doc_id", "key").join(told, "key", "left").select(
        "doc_id", "key", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near duplicates: of every class that with the smallest id (null last) stays.

    Rows without words stay as they are. Of rows with one id and one text, one stays. Columns may have any
    names. Options as in `similar_groups`.
    """
    known = text_classes(_rows(docs, doc_id, text), **options)
    best = F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("key")))
    chosen = stored(known.groupBy("class").agg(best["key"].alias("key")), "chosen")
    others = known.select("key")
    keyed = docs.select(row_of(docs).alias("row"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("key"))
    own = F.col("row").getField(doc_id)
    single = keyed.join(chosen, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(own.isNull(), own)).alias("row"))
    return unfolded(single.select("row").unionByName(keyed.join(others, "key", "left_anti").select("row")), docs.columns)
