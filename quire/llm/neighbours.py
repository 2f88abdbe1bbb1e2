"""Approximate nearest neighbours by inner product: NN-descent builds the graph, greedy search asks it.

Equal vectors are one node with its smallest ids. The graph starts from blocks of nodes that are next to each other in
a few random orders, and improves in rounds of joins: all neighbours that meet in one node's list (its own and a
sample of those that point to it) are introduced to each other, if one of them is new there, and each node
keeps its best. Rounds end when few lists change. Nodes live in cells of bounded size, and a node's number names its
cell. What goes from one cell to another (links, wanted nodes and their codes, introductions) is one row of bytes for
each pair of cells and step, however many nodes it is about; a cell fetches the code of a node once, whichever of its lists name it.

A search starts at the query's own node and a few vectors of largest norm, opens the lists of its best nodes
found so far, and ends when these are all open. All queries advance together; a node is opened once per query, so it
ends by itself. Codes stay in their cells: a query's code goes to the cells of the nodes it asks about, and scores come back.

The largest inner product is not a distance, so the graph is built on vectors with one more component that gives all
the same length; the search uses the inner product itself. Both work on half-precision codes; the best
candidates are then scored exactly on the original vectors.

Defined results: rows without id, and null, empty, zero or non-finite vectors take no part. Components a
shorter vector lacks count as zero. Rows that repeat id and vector are one. No row of the query's id is its
candidate. Ties go by the smaller id. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.batches import mix64, offsets_of
from quire.llm.components import by_shuffle
from quire.llm.hard_negatives import finite_vector
from quire.session import scratch_path, shuffles_dropped

#: Random orders the graph starts from, bits of an order's key, nodes of a block, and neighbours it gives each.
ORDERS, BITS, BLOCK, FIRST = 4, 32, 2048, 24
#: Neighbours of a node for each doubling of the number of nodes.
DEGREE = 3
#: Nodes of a cell at most, bits of a node's number within it, of a cell's number within the task that gives it, and of both with the task's.
CELL, SLOT_BITS, CELL_BITS, NODE_BITS = 4096, 12, 14, 46
SLOT = (1 << SLOT_BITS) - 1
#: Lists whose introductions are scored at once, and pairs of query and node.
LISTS, PAIRS = 64, 1 << 13
#: Best introductions that a list gives to each of its nodes in a round.
INTRODUCED = 6
#: Rounds end when at most this share of all list entries is new.
STILL = 0.01
#: Nodes a search keeps, as a multiple of the graph's degree.
BEAM = 4
#: Vectors of largest norm that every search starts from besides its own node.
ENTRIES = 128
#: Candidates scored exactly, as a multiple of those asked for.
RESCORE = 2
SEED = 20_240

KEYS = [f"key{t}" for t in range(ORDERS)]
CODES = "vector array<double>, members array<long>, code binary, scale double, extra double, norm double, " + ", ".join(f"{k} long" for k in KEYS)
#: Lists are binary: nodes in 64 bits, scores in 64 or (of links and lists) 32, flags in 8.
GRAPH = "cell long, node long, code binary, scale double, extra double, near binary, score binary, fresh binary, new long"
LINKS = "cell long, node binary, found binary, score binary"
SEARCH = "cell long, node long, code binary, near binary, score binary, open binary, new long"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"neighbours-{name}")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- rows of bytes

def _bytes(values: np.ndarray, offsets) -> pa.Array:
    """One binary row for each range of ``values``."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * math.prod(values.shape[1:])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((np.asarray(offsets, np.int64) * size).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _values(table, name: str, kind) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _counts(table, name: str, kind) -> np.ndarray:
    return np.array([len(b) for b in table.column(name).to_pylist()], np.int64) // np.dtype(kind).itemsize


def _in_order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Positions by keys of so many bits, which are packed with the position: a sort of numbers is several times
    faster than one of positions. The last key loses its lowest bits if all don't fit."""
    n = len(keys[0][0])
    place = max(1, n - 1).bit_length()
    room = 63 - place
    packed = np.zeros(n, np.int64)
    for key, bits in keys:
        used = min(bits, room)
        packed = packed << used | key >> (bits - used)
        room -= used
    return np.sort(packed << place | np.arange(n)) & ((1 << place) - 1)


def _mail(to: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Rows for the cells ``to``: the cell, and of each column the values that go there, in their order."""
    if not (to[1:] >= to[:-1]).all():
        order = _in_order((to, NODE_BITS - SLOT_BITS))
        to, columns = to[order], [c.take(order, axis=0) for c in columns]
    at = _starts(to)
    return [pa.array(to[at], pa.int64()), *(_bytes(c, np.append(at, len(to))) for c in columns)]


def _starts(*groups: np.ndarray) -> np.ndarray:
    """Positions where a group of equal neighbours starts."""
    change = np.ones(len(groups[0]), bool)
    change[1:] = False
    for g in groups:
        change[1:] |= g[1:] != g[:-1]
    return np.flatnonzero(change)


def _places(sorted_groups: np.ndarray) -> np.ndarray:
    """Number of each entry within its group."""
    at = _starts(sorted_groups)
    return np.arange(len(sorted_groups)) - np.repeat(at, np.diff(np.append(at, len(sorted_groups))))


def _first_of_each(group: np.ndarray, bits: int, ids: np.ndarray, id_bits: int = NODE_BITS) -> np.ndarray:
    """Positions of the first entry of every (group, id), by group."""
    room = 63 - bits - max(1, len(ids) - 1).bit_length()
    if id_bits <= room:
        order = _in_order((group, bits), (ids, id_bits))
    else:
        draw = (mix64(ids.astype(np.uint64)) >> np.uint64(64 - room)).view(np.int64)
        order = _in_order((group, bits), (draw, room))
        a, b = order[1:], order[:-1]
        if ((group[a] == group[b]) & (draw[a] == draw[b]) & (ids[a] != ids[b])).any():  # two ids look the same
            order = np.lexsort((ids, group))
    return order[_starts(group[order], ids[order])]


def _descending(score: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of so many bits that are smaller for larger scores."""
    width = 8 * score.itemsize
    kind = np.dtype(f"u{score.itemsize}").type
    bits = (score + score.dtype.type(0)).view(kind)
    sign = kind(1 << width - 1)
    down = ~np.where(bits & sign, ~bits, bits | sign) >> kind(1)
    return down.astype(np.int64), width - 1


def _top(group: np.ndarray, bits: int, ids: np.ndarray, score: np.ndarray, k: int, id_bits: int = NODE_BITS) -> np.ndarray:
    """Positions of the best ``k`` distinct neighbours of every group, by group and best first: as many digits
    of the scores count as a sort of one number leaves room for, four at least."""
    first = _first_of_each(group, bits, ids, id_bits)
    group = group[first]
    order = _in_order((group, bits), _descending(score[first]))
    return first[order[_places(group[order]) < k]]


# ---------------------------------------------------------------- codes

def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero behind a list's end."""
    flat, lengths = np.asarray(column.flatten(), np.float64), np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lengths), width))
    out.reshape(-1)[np.repeat(np.arange(len(lengths)) * width - offsets_of(lengths)[:-1], lengths) + np.arange(len(flat))] = flat
    return out


def _rows(flat: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of equal width."""
    return flat.reshape(n, len(flat) // max(1, n))


def _halves(table) -> np.ndarray:
    """Half-precision codes, one row for each of the table's."""
    return _rows(_values(table, "code", np.float16), table.num_rows)


def _augmented(code: np.ndarray, scale: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Vectors of equal length."""
    out = np.empty((len(code), code.shape[1] + 1), np.float32)
    np.multiply(code, scale[:, None].astype(np.float32), out=out[:, :-1], casting="unsafe")
    out[:, -1] = extra
    return out


def _encode(width: int, longest: float):
    """Codes relative to the longest vector, the extra component, and the keys of the random orders."""
    planes = np.random.default_rng(SEED).standard_normal((width + 1, ORDERS * BITS))
    weights = 1 << np.arange(BITS)[::-1].astype(np.int64)

    def run(batches):
        for batch in batches:
            x = dense(batch.column("vector"), width) / longest
            scale = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny)
            unit = x / scale[:, None]
            norm = scale * np.sqrt((unit * unit).sum(axis=1))
            extra = np.sqrt(np.maximum(0.0, 1 - np.square(norm)))
            signs = (np.concatenate([x, extra[:, None]], axis=1) @ planes > 0).reshape(len(x), ORDERS, BITS)
            keys = signs.astype(np.int64) @ weights
            kept = {c: batch.column(c) for c in ("vector", "members")}
            code = _bytes(unit.astype(np.float16), np.arange(len(x) + 1))
            yield pa.RecordBatch.from_pydict(kept | {"code": code, "scale": scale, "extra": extra, "norm": norm} | {k: keys[:, t] for t, k in enumerate(KEYS)})

    return run


def _number(batches):
    """Nodes are numbered by cells of rows that are next to each other; a node's number names its cell."""
    cell = TaskContext.get().partitionId() << CELL_BITS
    for batch in batches:
        nodes = []
        for piece in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows // CELL)):
            nodes.append((cell << SLOT_BITS) + np.arange(len(piece)))
            cell += 1
        nodes = np.concatenate(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(nodes >> SLOT_BITS), pa.array(nodes), *batch.columns], ["cell", "node", *batch.schema.names])


def _parts(spark: SparkSession, n: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // (2 * CELL)))


def _numbered(codes: DataFrame, n: int) -> DataFrame:
    order = [KEYS[0], "vector"]
    return codes.repartitionByRange(_parts(codes.sparkSession, n), *order).sortWithinPartitions(*order).mapInArrow(_number, f"cell long, node long, {CODES}")


# ---------------------------------------------------------------- graph

def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of every row; minus infinity doesn't count."""
    kept = scores > -np.inf
    if k < scores.shape[1]:
        kept &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
        tied = np.flatnonzero(np.count_nonzero(kept, axis=1) > k)
        if len(tied):
            kept[tied] = False
            kept[tied[:, None], np.argpartition(scores[tied], -k, axis=1)[:, -k:]] = True
    return np.nonzero(kept)


def _blocks(batches):
    """The best neighbours of every node within its block, for the nodes' cells."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        x = _augmented(_halves(batch), batch.column("scale").to_numpy(), batch.column("extra").to_numpy())
        node, near, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for piece in np.array_split(np.arange(len(nodes)), -(-len(nodes) // BLOCK)):
            gram = x[piece] @ x[piece].T
            np.fill_diagonal(gram, -np.inf)
            row, col = _best_of(gram, FIRST)
            node.append(nodes[piece[row]])
            near.append(nodes[piece[col]])
            score.append(gram[row, col])
        node = np.concatenate(node)
        yield pa.RecordBatch.from_arrays(_mail(node >> SLOT_BITS, node, np.concatenate(near), np.concatenate(score)), ["cell", "node", "found", "score"])


def _merge(k: int, kept: tuple[str, ...], kind, flag: str):
    """Lists of a cell joined with newly found neighbours; ``flag`` marks what the list didn't hold before."""

    def run(lists: pa.Table, links: pa.Table) -> pa.Table:
        lists = lists.combine_chunks().sort_by("node")
        nodes, counts = lists["node"].to_numpy(), _counts(lists, "near", np.int64)
        place = np.zeros(SLOT + 1, np.int64)
        place[nodes & SLOT] = np.arange(len(nodes))  # a cell's searches are some of its nodes
        slot = np.concatenate([np.repeat(np.arange(len(nodes)), counts), place[_values(links, "node", np.int64) & SLOT]])
        near = np.concatenate([_values(lists, "near", np.int64), _values(links, "found", np.int64)])
        score = np.concatenate([_values(lists, "score", kind), _values(links, "score", kind)])
        best = _top(slot, SLOT_BITS, near, score, k)
        offsets = np.searchsorted(slot[best], np.arange(len(nodes) + 1))
        marked = best >= counts.sum()
        new = np.bincount(slot[best][marked], minlength=len(nodes))
        return pa.table({c: lists[c] for c in kept} | {"near": _bytes(near[best], offsets), "score": _bytes(score[best], offsets), flag: _bytes(marked, offsets), "new": new.astype(np.int64)})

    return run


def _backs(most: int, step: int):
    """A random sample of the lists that name a node, no more than ``most`` of a batch, for the node's cell."""

    def run(batches):
        for batch in batches:
            node, fresh = _values(batch, "near", np.int64), _values(batch, "fresh", bool)
            back = np.repeat(batch.column("node").to_numpy(), _counts(batch, "near", np.int64))
            named = np.sort(node)
            often = np.unique(named[most:][named[most:] == named[: max(0, len(named) - most)]])
            if len(often):
                rest = np.isin(node, often)
                some = np.flatnonzero(rest)
                rest = ~rest
                rest[some[_sampled(np.searchsorted(often, node[some]), 32, node[some], back[some], most, step)]] = True
                node, back, fresh = node[rest], back[rest], fresh[rest]
            yield pa.RecordBatch.from_arrays(_mail(node >> SLOT_BITS, node, back, fresh), ["cell", "node", "back", "fresh"])

    return run


def _sampled(group: np.ndarray, bits: int, node: np.ndarray, back: np.ndarray, most: int, step: int) -> np.ndarray:
    """Positions of at most ``most`` entries of every node's group, by a hash of the pair and the step."""
    draw = mix64(mix64(back.astype(np.uint64) + np.uint64(step)) + node.astype(np.uint64)) >> np.uint64(1)
    order = _in_order((group, bits), (draw.view(np.int64), 63))
    return order[_places(group[order]) < most]


def _meet(most: int, step: int):
    """Who meets in each list of a cell (its own and those that point to it) where one is new, and the nodes that the cell needs of others."""

    def run(lists: pa.Table, backs: pa.Table) -> pa.Table:
        lists = lists.combine_chunks().sort_by("node")
        nodes = lists["node"].to_numpy()
        node, back, back_fresh = (_values(backs, c, kind) for c, kind in (("node", np.int64), ("back", np.int64), ("fresh", bool)))
        pairs = _in_order((node & SLOT, SLOT_BITS), (back, NODE_BITS))  # rows come in any order
        node, back, back_fresh = node[pairs], back[pairs], back_fresh[pairs]
        kept = _sampled(node & SLOT, SLOT_BITS, node, back, most, step)
        slot = np.concatenate([np.repeat(np.arange(len(nodes)), _counts(lists, "near", np.int64)), node[kept] & SLOT])
        met = np.concatenate([_values(lists, "near", np.int64), back[kept]])
        fresh = np.concatenate([_values(lists, "fresh", bool), back_fresh[kept]])
        first = _first_of_each(slot, SLOT_BITS, met)
        slot, met, fresh = slot[first], met[first], fresh[first]
        some = np.bincount(slot[fresh], minlength=len(nodes)) > 0
        slot, met, fresh = slot[some[slot]], met[some[slot]], fresh[some[slot]]
        offsets = np.append(np.searchsorted(slot, np.flatnonzero(some)), len(slot))
        needed = np.unique(met)
        to, ids = _mail(needed >> SLOT_BITS, needed)
        cell = np.full(len(offsets) - 1 + len(to), nodes[0] >> SLOT_BITS)
        return pa.table({"cell": cell, "to": pa.concat_arrays([pa.nulls(len(offsets) - 1, pa.int64()), to]), "met": pa.concat_arrays([_bytes(met, offsets), ids]),
                         "fresh": pa.concat_arrays([_bytes(fresh, offsets), pa.nulls(len(to), pa.binary())])})

    return run


def _answer(degree: int):
    """Codes of the nodes that other cells need, and the score that a newcomer to the list of each has to beat."""

    def run(graph: pa.Table, asking: pa.Table) -> pa.Table:
        graph = graph.combine_chunks().sort_by("node")
        nodes, code, held = graph["node"].to_numpy(), _halves(graph), _counts(graph, "score", np.float32)
        worst = np.full(len(nodes), -np.inf, np.float32)
        worst[held >= degree] = _values(graph, "score", np.float32)[np.cumsum(held)[held >= degree] - 1]
        rest = np.stack([graph["scale"].to_numpy(), graph["extra"].to_numpy(), worst], axis=1).astype(np.float32)
        at = _values(asking, "met", np.int64) & SLOT
        offsets = offsets_of(_counts(asking, "met", np.int64))
        return pa.table({"cell": asking["cell"], "ids": asking["met"], "code": _bytes(code.take(at, axis=0), offsets), "rest": _bytes(rest.take(at, axis=0), offsets)})

    return run


def _introduce(k: int):
    """Best new pairs among the neighbours that meet in each list of a cell, for the cells of those who get them."""

    def run(lists: pa.Table, codes: pa.Table) -> pa.Table:
        ids = _values(codes, "ids", np.int64)
        order = np.argsort(ids)
        ids, rest = ids[order], _values(codes, "rest", np.float32).reshape(-1, 3).take(order, axis=0)
        # one more that is nobody: it fills up short lists, and nothing beats what it holds
        x = _augmented(_rows(_values(codes, "code", np.float16), len(ids)).take(order, axis=0), rest[:, 0], rest[:, 1])
        x, worst = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), np.append(rest[:, 2], np.float32(np.inf))
        counts = _counts(lists, "met", np.int64)
        offsets = offsets_of(counts)
        met, fresh = np.searchsorted(ids, _values(lists, "met", np.int64)), _values(lists, "fresh", bool)
        dest, cand, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for a in range(0, len(counts), LISTS):
            some = counts[a:a + LISTS]
            inside = np.arange(some.max()) < some[:, None]
            at, new = np.full(inside.shape, len(ids)), np.zeros(inside.shape, bool)
            at[inside], new[inside] = met[offsets[a]:offsets[a] + some.sum()], fresh[offsets[a]:offsets[a] + some.sum()]
            own = x.take(at.reshape(-1), axis=0).reshape(*at.shape, -1)
            gram = own @ own.transpose(0, 2, 1)
            kept = (new[:, :, None] | new[:, None, :]) & (gram > worst.take(at)[:, :, None]) & inside[:, None, :]
            kept &= ~np.eye(at.shape[1], dtype=bool)
            some = np.flatnonzero(kept.any(axis=2))
            value = np.where(kept.reshape(-1, at.shape[1]).take(some, axis=0), gram.reshape(-1, at.shape[1]).take(some, axis=0), np.float32(-np.inf))
            row, col = _best_of(value, INTRODUCED)
            dest.append(at.reshape(-1)[some[row]])
            cand.append(at[some[row] // at.shape[1], col])
            score.append(value[row, col])
        dest, cand, score = np.concatenate(dest), np.concatenate(cand), np.concatenate(score)
        bits = len(ids).bit_length()
        best = _top(dest, bits, cand, score, k, bits)
        return pa.table(dict(zip(("cell", "node", "found", "score"), _mail(ids[dest[best]] >> SLOT_BITS, ids[dest[best]], ids[cand[best]], score[best]), strict=True)))

    return run


def _degree(n: int, k: int) -> int:
    return max(k + 4, DEGREE * math.ceil(math.log2(max(2, n))))


def _meeting(one: DataFrame, other: DataFrame, fn, schema: str, by: str = "cell") -> DataFrame:
    return one.groupBy("cell").cogroup(other.groupBy(by)).applyInArrow(fn, schema)


def _linked(graph: DataFrame, links: DataFrame, degree: int) -> DataFrame:
    lists = graph.select("cell", "node", "code", "scale", "extra", "near", "score")
    return _meeting(lists, links, _merge(degree, ("cell", "node", "code", "scale", "extra"), np.float32, "fresh"), GRAPH)


def first_graph(codes: DataFrame, n: int, degree: int) -> DataFrame:
    """Neighbours within blocks of consecutive nodes of several random orders."""
    found = None
    for key in KEYS:
        order = [key, "node"]
        near = codes.select("node", "code", "scale", "extra", key).repartitionByRange(_parts(codes.sparkSession, n), *order).sortWithinPartitions(*order).mapInArrow(_blocks, LINKS)
        found = near if found is None else found.unionByName(near)
    nothing = F.lit(b"")
    return _linked(codes.withColumns({"near": nothing, "score": nothing}), found, degree)


def improved(graph: DataFrame, degree: int, step: int) -> DataFrame:
    """One round: every list introduces its nodes to each other, and all keep their best."""
    backs = graph.select("node", "near", "fresh").mapInArrow(_backs(degree // 2, step), "cell long, node binary, back binary, fresh binary")
    met = _written(_meeting(graph.select("cell", "node", "near", "fresh"), backs, _meet(degree // 2, step), "cell long, to long, met binary, fresh binary"), f"met{step}")
    codes = _meeting(graph.select("cell", "node", "code", "scale", "extra", "score"), met.where("to is not null").select("cell", "to", "met"), _answer(degree), "cell long, ids binary, code binary, rest binary", "to")
    return _linked(graph, _meeting(met.where("to is null").select("cell", "met", "fresh"), codes, _introduce(degree), LINKS), degree)


def neighbour_graph(codes: DataFrame, n: int, degree: int) -> DataFrame:
    """Lists of ``degree`` neighbours of all ``n`` nodes of ``codes``; every round is written, so
    that a lost executor costs no more than that round."""
    graph = _written(first_graph(codes, n, degree), "graph0")
    step, new = 0, n * degree
    while new > STILL * n * degree:
        step += 1
        graph = _written(improved(graph, degree, step), f"graph{step}")
        new = graph.agg(F.sum("new")).first()[0] or 0
    return graph


# ---------------------------------------------------------------- search

def _start(entries: list[int]):
    """The first nodes that every search looks at."""

    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            ids = np.concatenate([nodes[:, None], np.tile(np.array(entries, np.int64), (len(nodes), 1))], axis=1)
            query = np.repeat(nodes, ids.shape[1])
            yield pa.RecordBatch.from_arrays(_mail(query >> SLOT_BITS, query, ids.reshape(-1)), ["cell", "query", "ids"])

    return run


def _open(batches):
    """The nodes that searches open, for their cells."""
    for batch in batches:
        waits = _values(batch, "open", bool)
        query, ids = np.repeat(batch.column("node").to_numpy(), _counts(batch, "near", np.int64))[waits], _values(batch, "near", np.int64)[waits]
        yield pa.RecordBatch.from_arrays(_mail(ids >> SLOT_BITS, query, ids), ["cell", "query", "ids"])


def _named(lists: pa.Table, opened: pa.Table) -> pa.Table:
    """What the opened lists of a cell name, for the cells of the queries."""
    lists = lists.combine_chunks().sort_by("node")
    counts, near = _counts(lists, "near", np.int64), _values(lists, "near", np.int64)
    offsets = offsets_of(counts)
    query, at = _values(opened, "query", np.int64), _values(opened, "ids", np.int64) & SLOT
    if len(query):
        order = _in_order((query >> SLOT_BITS, NODE_BITS - SLOT_BITS))
        query, at = query[order], at[order]
    some = counts[at]
    ids = near[np.repeat(offsets[at] - offsets_of(some)[:-1], some) + np.arange(some.sum())]
    query = np.repeat(query, some)
    return pa.table(dict(zip(("cell", "query", "ids"), _mail(query >> SLOT_BITS, query, ids), strict=True)))


def _ask(beam: int):
    """The nodes that searches of a cell don't hold yet, for the nodes' cells, with the queries and the score to beat."""

    def run(searches: pa.Table, named: pa.Table) -> pa.Table:
        searches = searches.combine_chunks().sort_by("node")
        nodes, code, held = searches["node"].to_numpy(), _halves(searches), _counts(searches, "near", np.int64)
        worst = np.full(len(nodes), -np.inf)
        worst[held >= beam] = _values(searches, "score", np.float64)[np.cumsum(held)[held >= beam] - 1]
        # numbers of a query's slot, a node and whether it is new; what the search holds comes before what is new
        old = (np.repeat(nodes & SLOT, held) << NODE_BITS | _values(searches, "near", np.int64)) << 1
        new = ((_values(named, "query", np.int64) & SLOT) << NODE_BITS | _values(named, "ids", np.int64)) << 1 | 1
        pairs = np.sort(np.concatenate([old, new]))
        pairs = pairs[_starts(pairs >> 1)]
        pairs = pairs[(pairs & 1).astype(bool)] >> 1
        slot, ids = pairs >> NODE_BITS, pairs & ((1 << NODE_BITS) - 1)
        heads = _starts(slot, ids >> SLOT_BITS)
        counts = np.diff(np.append(heads, len(ids)))
        if len(heads):
            order = _in_order((ids[heads] >> SLOT_BITS, NODE_BITS - SLOT_BITS))
            heads, counts = heads[order], counts[order]
            ids = ids[np.repeat(heads - offsets_of(counts)[:-1], counts) + np.arange(len(ids))]
        first = offsets_of(counts)[:-1]
        at = np.searchsorted(nodes & SLOT, slot[heads])
        asked = _mail(ids[first] >> SLOT_BITS, nodes[at], worst[at], counts, code.take(at, axis=0))
        return pa.table(dict(zip(("cell", "query", "worst", "counts", "code", "ids"), (*asked, _mail(ids >> SLOT_BITS, ids)[1]), strict=True)))

    return run


def _score(graph: pa.Table, asking: pa.Table) -> pa.Table:
    """Inner products of queries and nodes of a cell that beat what a query holds, for the cells of the queries."""
    graph = graph.combine_chunks().sort_by("node")
    theirs, scale = _halves(graph).astype(np.float32), graph["scale"].to_numpy()
    queries, worst, counts = (_values(asking, c, kind) for c, kind in (("query", np.int64), ("worst", np.float64), ("counts", np.int64)))
    own = _rows(_values(asking, "code", np.float16), len(queries)).astype(np.float32)
    ids = _values(asking, "ids", np.int64)
    at, row = ids & SLOT, np.repeat(np.arange(len(queries)), counts)
    value = [np.zeros(0)]
    for a in range(0, len(ids), PAIRS):
        value.append(np.einsum("ij,ij->i", own.take(row[a:a + PAIRS], axis=0), theirs.take(at[a:a + PAIRS], axis=0)) * scale[at[a:a + PAIRS]])
    value = np.concatenate(value)
    better = value > worst[row]
    query = queries[row[better]]
    return pa.table(dict(zip(("cell", "node", "found", "score"), _mail(query >> SLOT_BITS, query, ids[better], value[better]), strict=True)))


def search(graph: DataFrame, asking: DataFrame, entries: list[int], degree: int) -> DataFrame:
    """``node, near, score`` of the searches from each node of ``asking (node)``; ``open`` nodes have not been looked into yet."""
    beam = BEAM * degree
    nothing = F.lit(b"")
    now = _written(graph.join(by_shuffle(asking), "node", "left_semi").select("cell", "node", "code", nothing.alias("near"), nothing.alias("score"), nothing.alias("open"), F.lit(0).cast("long").alias("new")), "search0")
    named = now.select("node").mapInArrow(_start(entries), "cell long, query binary, ids binary")
    step, new = 0, 1
    while True:
        asked = _meeting(now.select("cell", "node", "code", "near", "score"), named, _ask(beam), "cell long, query binary, worst binary, counts binary, code binary, ids binary")
        found = _meeting(graph.select("cell", "node", "code", "scale"), asked, _score, LINKS)
        step += 1
        now = _written(_meeting(now.select("cell", "node", "code", "near", "score"), found, _merge(beam, ("cell", "node", "code"), np.float64, "open"), SEARCH), f"search{step}")
        new = now.agg(F.sum("new")).first()[0] or 0
        if not new:
            return now
        opened = now.where("new > 0").select("node", "near", "open").mapInArrow(_open, "cell long, query binary, ids binary")
        named = _meeting(graph.select("cell", "node", "near"), opened, _named, "cell long, query binary, ids binary")


def _listed(most: int):
    """``node, id`` of the first nodes of each search."""

    def run(batches):
        for batch in batches:
            counts, ids = _counts(batch, "near", np.int64), _values(batch, "near", np.int64)
            place = np.arange(len(ids)) - np.repeat(offsets_of(counts)[:-1], counts)
            yield pa.RecordBatch.from_pydict({"node": np.repeat(batch.column("node").to_numpy(), counts)[place < most], "id": ids[place < most]})

    return run


# ---------------------------------------------------------------- whole search

def nearest(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for every query of ``rows
    (vec_id, vector)``. Copies share a node that names its smallest ids, more than any query can return."""
    spark = rows.sparkSession
    x = F.col("vector")
    kept = _written(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
                    .where(F.col("vec_id").isNotNull() & finite_vector(x) & F.exists(x, lambda c: c != 0)), "rows")
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    members = kept.groupBy("vector", "vec_id").agg(F.lit(1)).withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    classes = _written(members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c))
    n, width, longest = classes.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
    degree = _degree(n, k)
    classes = _written(_numbered(classes.mapInArrow(_encode(width or 0, longest or 1.0), CODES), n), "codes")
    queries = _written(kept.where("is_query").select(F.col("vec_id").alias("query_id"), "vector").distinct().join(by_shuffle(classes.select("vector", "node")), "vector").select("query_id", "node"), "queries")
    entries = [r[0] for r in classes.orderBy(F.col("norm").desc(), "node").select("node").limit(ENTRIES).collect()]
    graph = neighbour_graph(classes.select("cell", "node", "code", "scale", "extra", *KEYS), n, degree)
    found = search(graph, queries.select("node").distinct(), entries, degree)
    pairs = found.select("node", "near").mapInArrow(_listed(RESCORE * k + 1), "node long, id long")
    theirs = classes.select(F.col("node").alias("id"), F.col("vector").alias("other"), "members")
    exact = F.aggregate(F.zip_with("vector", "other", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, c: s + c)
    scored = pairs.join(by_shuffle(theirs), "id").join(by_shuffle(classes.select("node", "vector")), "node").select("node", "members", exact.alias("score"))
    first = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    best = (scored.select("node", "score", F.explode("members").alias("vec_id")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= RESCORE * k + 1)
            .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best")))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (queries.join(by_shuffle(best), "node").select("query_id", F.posexplode(others).alias("rank", "b"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every id divisible by 20, against all rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e.select("vec_id", F.col("embedding").alias("vector")), F.col("vec_id") % 20 == 0)
