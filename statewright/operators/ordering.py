"""Orders: models by dependency, changes by what waits for what, circles, trees."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def components_of(n: int, after: Sequence[Sequence[int]]) -> list[int]:
    """The strongly connected component of each node (depth first, twice, without recursion)."""
    seen, finished = [False] * n, []
    for root in range(n):
        stack = [(root, 0)] if not seen[root] else []
        seen[root] = True
        while stack:
            node, i = stack.pop()
            if i < len(after[node]):
                stack.append((node, i + 1))
                if not seen[after[node][i]]:
                    seen[after[node][i]] = True
                    stack.append((after[node][i], 0))
            else:
                finished.append(node)
    before: list[list[int]] = [[] for _ in range(n)]
    for a in range(n):
        for b in after[a]:
            before[b].append(a)
    own, count = [-1] * n, 0
    for root in reversed(finished):
        if own[root] < 0:
            stack2 = [root]
            own[root] = count
            while stack2:
                node = stack2.pop()
                for b in before[node]:
                    if own[b] < 0:
                        own[b] = count
                        stack2.append(b)
            count += 1
    return own


def condensed(nodes: Sequence[int], after: Sequence[Sequence[int]], rank: Callable[[int], int]) -> list[list[int]]:
    """nodes parted into their circles (most are one node), in the order that the edges between them ask for.

    Of circles that wait for nothing the one with the lowest-ranked member comes first.
    """
    at = {node: i for i, node in enumerate(nodes)}
    inner = [[at[b] for b in after[a] if b in at] for a in nodes]
    own = components_of(len(nodes), inner)
    members: dict[int, list[int]] = {}
    for node in nodes:
        members.setdefault(own[at[node]], []).append(node)
    waits: dict[int, set[int]] = {c: set() for c in members}
    for i, followers in enumerate(inner):
        for j in followers:
            if own[j] != own[i]:
                waits[own[j]].add(own[i])
    plan = TopologicalSorter(waits)
    plan.prepare()
    queue: list[tuple[int, int]] = []
    out = []
    while plan.is_active():
        for c in plan.get_ready():
            heapq.heappush(queue, (min(map(rank, members[c])), c))
        _, c = heapq.heappop(queue)
        out.append(members[c])
        plan.done(c)
    return out


def topological(n: int, after: Sequence[Sequence[int]], rank: Callable[[int], int] = lambda i: i) -> tuple[list[int], list[int]]:
    """(order, forced): the smallest order by rank in which every node comes before those in after[node].

    A circle stays together, at the place that its lowest-ranked member earns; that member goes first, is
    listed in forced, and what is left of the circle is ordered in the same way.
    """
    order: list[int] = []
    forced: list[int] = []
    parts = [list(range(n))] if n else []
    while parts:
        nodes = parts.pop()
        if len(nodes) == 1:
            order += nodes
            continue
        circles = condensed(nodes, after, rank)
        if len(circles) > 1:
            parts += reversed(circles)
            continue
        first = min(nodes, key=rank)
        forced.append(first)
        order.append(first)
        parts.append([x for x in nodes if x != first])
    return order, forced


def dependency_order(models: Sequence[str], refs: dict[str, dict[str, str]]) -> list[str]:
    """Models with those they refer to first, otherwise as listed; a circle between models is an error."""
    at = {m: i for i, m in enumerate(models)}
    after: list[list[int]] = [[] for _ in models]
    for m in models:
        for target in refs.get(m, {}).values():
            if target != m and target in at:
                after[at[target]].append(at[m])
    order, forced = topological(len(models), after)
    if forced:
        raise ValueError(f"models refer to each other in a circle: {', '.join(models[i] for i in forced)}")
    return [models[i] for i in order]


def unique_edges(changes: DataFrame, seq: str, frees: str, takes: str) -> DataFrame:
    """Which change waits for which because a unique value moves: from_seq frees what to_seq takes."""
    free = changes.where(F.col(frees).isNotNull()).select(F.col(seq).alias("from_seq"), F.col(frees).alias("value"))
    take = changes.where(F.col(takes).isNotNull()).select(F.col(seq).alias("to_seq"), F.col(takes).alias("value"))
    return free.join(take, "value").where("from_seq <> to_seq").select("from_seq", "to_seq", "value")


def swaps(changes: DataFrame, seq: str, frees: str, takes: str) -> DataFrame:
    """Circles of two: pairs of changes that take each other's value, each pair once."""
    edges = unique_edges(changes, seq, frees, takes)
    back = edges.select(F.col("from_seq").alias("to_seq"), F.col("to_seq").alias("from_seq"))
    return edges.where("from_seq < to_seq").join(back, ["from_seq", "to_seq"], "left_semi").select("from_seq", "to_seq")


def order_changes(changes: DataFrame, edges: DataFrame, seq: str = "seq") -> tuple[DataFrame, list[int]]:
    """changes with position, in the smallest order by seq that the edges allow; the changes in forced circles.

    Edges and sequence numbers of one change set come to the driver: a set is made to be reviewed and is
    small beside the tables. Everything else about a change stays distributed.
    """
    numbers = [r[0] for r in changes.select(seq).orderBy(seq).collect()]
    at = {s: i for i, s in enumerate(numbers)}
    after: list[list[int]] = [[] for _ in numbers]
    for r in edges.select("from_seq", "to_seq").distinct().collect():
        after[at[r[0]]].append(at[r[1]])
    order, forced = topological(len(numbers), after)
    places = changes.sparkSession.createDataFrame([(numbers[i], p) for p, i in enumerate(order)], f"{seq} {changes.schema[seq].dataType.simpleString()}, position int")
    return changes.join(places, seq), [numbers[i] for i in forced]


def refused_with(edges: DataFrame, refused: DataFrame, seq: str = "seq") -> DataFrame:
    """Refused changes and all that wait on them, however long the chains.

    Where a change waits on one other alone, pointer doubling follows the whole chain in as many rounds as
    its length has binary digits; changes that wait on several are looked at once the chains are settled.
    """
    links = edges.select(F.col("from_seq").alias("a"), F.col("to_seq").alias("b")).where("a <> b").distinct()
    known = cut(refused.select(F.col(seq).alias("s")).distinct())
    nodes = links.select(F.col("b").alias("s")).unionByName(links.select(F.col("a").alias("s"))).distinct()
    single = links.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select(F.col("b").alias("__s"), F.col("a").alias("up"))
    tree = cut(nodes.join(single, F.col("s") == F.col("__s"), "left").select("s", "up"))
    several = cut(links.join(links.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "b"))
    while True:
        chain = cut(tree.join(known.withColumn("bad", F.lit(True)), "s", "left").select("s", "up", F.coalesce("bad", F.lit(False)).alias("bad")))
        rounds = max(1, chain.count()).bit_length() + 1
        for _ in range(rounds):  # on a circle of single waits every node has seen all others by then
            if chain.where("up is not null and not bad").isEmpty():
                break
            above = chain.select(F.col("s").alias("__s"), F.col("up").alias("__up"), F.col("bad").alias("__bad"))
            chain = cut(chain.join(above, F.col("up") == F.col("__s"), "left").select("s", F.col("__up").alias("up"), (F.col("bad") | F.coalesce("__bad", F.lit(False))).alias("bad")))
        reached = known.unionByName(chain.where("bad").select("s")).distinct()
        more = several.join(reached, F.col("a") == F.col("s"), "left_semi").select(F.col("b").alias("s"))
        now = cut(reached.unionByName(more).distinct())
        if now.count() == known.count():
            return now.withColumnRenamed("s", seq)
        known = now


def tree_depth(rows: DataFrame, id_col: str, parent: str) -> DataFrame:
    """id, depth: parents before children, by pointer doubling (a chain of n rows takes log n rounds).

    A row without a parent, or whose parent is not among the rows or itself, is a root. Rows whose chain of
    parents never ends form a circle, which is an error.
    """
    up = F.when(F.col(parent) != F.col(id_col), F.col(parent))
    named = rows.select(F.col(id_col).alias("id"), up.alias("up"))
    there = named.select(F.col("id").alias("__id"))
    hops = cut(named.join(there, F.col("up") == F.col("__id"), "left").select("id", F.col("__id").alias("up"), F.col("__id").isNotNull().cast("int").alias("depth")))
    for _ in range(hops.count().bit_length() + 1):
        if hops.where("up is not null").isEmpty():
            return hops.select("id", "depth")
        above = hops.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        hops = cut(hops.join(above, F.col("up") == F.col("__id"), "left").select("id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")))
    raise ValueError("parents form a circle")


def model_order(models: Sequence[str], refs: dict[str, dict[str, str]], files: Sequence[str] = ()) -> list[str]:
    """Models with those they refer to first; ties as the files list them, then as configured; circles are broken."""
    rank = {m: i for i, m in enumerate(dict.fromkeys([*files, *models]))}
    at = {m: i for i, m in enumerate(models)}
    after: list[list[int]] = [[] for _ in models]
    for m in models:
        for target in refs.get(m, {}).values():
            if target != m and target in at:
                after[at[target]].append(at[m])
    return [models[i] for i in topological(len(models), after, lambda i: rank[models[i]])[0]]


def unique_tuple(values: Column, columns: Sequence[str], nulls_equal: bool = False) -> Column:
    """struct(tuple, exact): what a unique index holds for a map of values.

    A null among the columns means that the index holds nothing (null), unless nulls count as equal. A column
    that the map does not have could be anything, so the tuple is not exact.
    """
    at = [F.try_element_at(values, F.lit(c)) for c in columns]
    held = [F.array_contains(F.map_keys(values), c) for c in columns]
    null = reduce(lambda a, b: a | b, [h & v.isNull() for h, v in zip(held, at, strict=True)], F.lit(False))
    said = F.to_json(F.array(*[F.when(h, v) for h, v in zip(held, at, strict=True)]))
    every = reduce(lambda a, b: a & b, held, F.lit(True))
    return F.when(values.isNotNull() & (F.lit(nulls_equal) | ~null), F.struct(said.alias("tuple"), every.alias("exact")))


def backwards(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """changes renumbered from the last to the first: the order of a revert."""
    last = changes.agg(F.max(seq)).first()[0]
    return changes.withColumn(seq, F.lit(last) - F.col(seq)) if last is not None else changes


def reference_edges(changes: DataFrame, refs: DataFrame, seq: str = "seq") -> DataFrame:
    """from_seq, to_seq: a change that writes a reference comes after the insert or rename that makes the name,
    and the delete or rename that takes a name away after the changes that stop using it.

    changes has seq, model, makes and loses (names that come and go); refs has seq, model (of the target),
    name and side (new: the change writes the reference, old: it drops one).
    """
    made = changes.where("makes is not null").select(F.col(seq).alias("from_seq"), "model", F.col("makes").alias("name"))
    lost = changes.where("loses is not null").select(F.col(seq).alias("to_seq"), "model", F.col("loses").alias("name"))
    first = refs.where("side = 'new'").select(F.col(seq).alias("to_seq"), "model", "name").join(made, ["model", "name"])
    last = refs.where("side = 'old'").select(F.col(seq).alias("from_seq"), "model", "name").join(lost, ["model", "name"])
    return first.select("from_seq", "to_seq").unionByName(last.select("from_seq", "to_seq")).where("from_seq <> to_seq").distinct()


def circles(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """seq of every change that waits, in the end, on itself. Edges of one set come to the driver."""
    pairs = [(r[0], r[1]) for r in edges.select("from_seq", "to_seq").distinct().collect()]
    names = sorted({x for p in pairs for x in p})
    at = {s: i for i, s in enumerate(names)}
    after: list[list[int]] = [[] for _ in names]
    for a, b in pairs:
        after[at[a]].append(at[b])
    own = components_of(len(names), after)
    sizes = Counter(own)
    kind = edges.schema["from_seq"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(s,) for s in names if sizes[own[at[s]]] > 1], f"{seq} {kind}")
