"""Links inside groups of sets, however large a group is.

A group is a set of classes that share a token; wanted are links that connect the same
classes as all pairs of similar members would.  Small groups are compared in one place.
A large one is centred first: with any set P, the difference of two sets x and y is that
of their own differences to P, ``x ^ y = (x ^ P) ^ (y ^ P)``.  P holds what most members
have, so these differences are short, and

* two members whose differences to P add up to no more than similar sets may differ by
  are similar.  If there are any such pairs, they all link up through the member that is
  nearest to P for its size;
* any other similar pair must share an element of the differences, and one of their
  first elements (the prefix) under an order of all elements.

So the members of a large group that are not linked by its centre are compared by their
short differences, in blocks of members; and a group with very many blocks falls into
groups by element of the differences first, which are centred again if still large.  The
choice of P decides how fast this goes, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import Tables, small_batches

#: Members of a group compared in one place: of whole sets, and of differences to a centre.
WHOLE, CENTRED = 48, 768
#: Members (about) that a centre is made of, and times a group is centred at most.
SAMPLE, ROUNDS = 24, 6
#: Blocks of a centred group that meet each other; one of more is split by elements.
BLOCKS = 96
#: Bytes of a table that may travel to all tasks.
TRAVEL = 32_000_000
#: Elements of the member table of one comparison.
_CELLS = 4_000_000

Compare = Callable[[np.ndarray, list[np.ndarray]], np.ndarray]


def allowed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """By how many elements two sets of these sizes may differ and still be similar."""
    return (100 - percent) * (n + m) // (100 + percent)


def common_elements(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[element]
    owner, element = owner[keep], number[element[keep]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    number = int(shared.sum())
    width = max(1, min(number, _CELLS // len(sets)))
    for first in range(0, number, width):
        part = slice(*np.searchsorted(element, (first, first + width)))
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[part], element[part] - first] = 1
        out += (cells @ cells.T).astype(np.int64)
    return out


def similar_pairs(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are similar; ``sets`` may be differences to one centre."""
    own = np.array([len(s) for s in sets], np.int64)
    apart = own[:, None] + own[None, :] - 2 * common_elements(sets)
    return apart <= allowed(sizes[:, None], sizes[None, :], percent)


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """(member, another one of its component) so that components stay connected."""
    out, left = [], np.ones(len(adjacent), bool)
    for i in range(len(adjacent)):
        if not left[i]:
            continue
        left[i] = False
        edge = [i]
        while edge:
            at = edge.pop()
            for j in np.flatnonzero(adjacent[at] & left):
                left[j] = False
                out.append((at, int(j)))
                edge.append(j)
    return out


def centre_of(sets: list[np.ndarray]) -> np.ndarray:
    """What most of those sets have that are near the most central one."""
    both = common_elements(sets)
    sizes = np.array([len(s) for s in sets])
    share = both / np.maximum(1, sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(share, 1)
    near = share[share.sum(1).argmax()] >= 0.4
    elements, times = np.unique(np.concatenate([s for s, use in zip(sets, near, strict=True) if use]), return_counts=True)
    return elements[2 * times > near.sum()]


def prefix_length(own: int, size: int, percent: int) -> int:
    """How many first elements of a difference similar members have one of in common.

    Similar sets differ by D at most, so their differences share at least (own + other -
    D) / 2 elements; as they cannot share more than the other has, at least own - D.
    """
    most = (100 - percent) * size // percent
    return min(own, most + 1)


def by_group(rows: DataFrame, columns: list[str], make: Callable[[int, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``make`` to the rows of each group, which the group's bound keeps few."""
    small_batches(rows.sparkSession)
    target = pa.schema([(x.split()[0], pa.list_(pa.int64()) if "array" in x else pa.int64()) for x in schema.split(", ")])

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], target.field(i).type) for i in range(len(target))], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, found = None, {}, []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            fields = [batch.column(i) for i in range(1, len(columns))]
            for i, g in enumerate(groups):
                if g != group:
                    if held:
                        found.extend(make(group, list(held.values())))
                    group, held = g, {}
                    if len(found) > 5000:
                        yield out(found)
                        found = []
                row = [c[i].values.to_numpy() if pa.types.is_list(c.type) else c[i].as_py() for c in fields]
                held[row[0]] = row
        if held:
            found.extend(make(group, list(held.values())))
        if found:
            yield out(found)

    return rows.select(*columns).repartition("grp").sortWithinPartitions("grp").mapInArrow(run, schema)


def _links_within(rows: DataFrame, percent: int, compare: Compare | None) -> DataFrame:
    """Links that connect the similar members of each small group."""

    def links(_: int, members: list) -> Iterator[tuple]:
        if len(members) < 2 or all(core for *_, core in members):
            return
        sizes, sets = np.array([m[1] for m in members], np.int64), [m[2] for m in members]
        adjacent = similar_pairs(sizes, sets, percent) if compare is None else compare(sizes, sets)
        core = np.array([m[3] for m in members], bool)
        # what the centre has linked needs no further link among itself
        adjacent |= core[:, None] & core[None, :]
        for i, j in spanning(adjacent):
            if not (core[i] and core[j]):
                yield members[i][0], members[j][0]

    return by_group(rows, ["grp", "cls", "n", "v", "core"], links, "a bigint, b bigint")


def _centres(rows: DataFrame) -> DataFrame:
    """grp, centre: made of a share of each group's members, chosen by a hash."""
    drawn = rows.filter(F.pmod(F.xxhash64("cls", "grp"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("members"))

    def centre(group: int, members: list) -> Iterator[tuple]:
        yield group, centre_of([m[1] for m in members])

    return by_group(drawn, ["grp", "cls", "v"], centre, "grp bigint, centre array<bigint>")


def _differences(rows: DataFrame, percent: int) -> DataFrame:
    """grp, cls, n, members, v, slack, tokens: the difference of each member to its centre."""
    small_batches(rows.sparkSession)
    longs, lists = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("grp", longs), ("cls", longs), ("n", longs), ("members", longs), ("v", lists), ("slack", longs), ("tokens", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, own, slack, tokens = batch.column(2).to_pylist(), [], [], []
            for n, v, c in zip(sizes, batch.column(4), batch.column(5), strict=True):
                d = np.setxor1d(v.values.to_numpy(), c.values.to_numpy() if c.is_valid else none, assume_unique=True)
                own.append(d)
                slack.append((100 + percent) * len(d) - (100 - percent) * n)
                tokens.append(d[: prefix_length(len(d), n, percent)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, lists), pa.array(slack, longs), pa.array(tokens, lists)], schema=schema)

    kinds = "grp bigint, cls bigint, n bigint, members bigint, v array<bigint>, slack bigint, tokens array<bigint>"
    return rows.select("grp", "cls", "n", "members", "v", "centre").mapInArrow(run, kinds)


def _blocks(rows: DataFrame) -> DataFrame:
    """Each group dealt into parts, of which any two meet in a group of bounded size."""
    parts = F.when(F.col("members") <= CENTRED, 1).otherwise(F.ceil(F.lit(2) * F.col("members") / CENTRED)).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts.cast("long")).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("grp", F.xxhash64("grp", F.least("_own", "_other"), F.greatest("_own", "_other")))


def links_of(groups: DataFrame, sets: DataFrame, percent: int, tables: Tables, compare: Compare | None = None) -> DataFrame:
    """Links (a, b) that connect all classes which similar pairs inside the groups connect.

    ``groups`` has grp, cls, each pair once; ``sets`` has cls, n, v, a class's size and its
    elements in ascending order.  ``compare`` may replace the comparison of whole sets in
    a small group.
    """
    with Tables(sets.sparkSession) as inner:
        counts = groups.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
        named = inner.keep(groups.join(counts, "grp"))
        columns = ["grp", "cls", "n", "v", "members"]

        def whole(part: DataFrame) -> DataFrame:
            return sets.join(_small(part, TRAVEL, F.lit(24)), "cls").select(*columns)

        small = whole(named.filter(F.col("members") <= WHOLE)).withColumn("core", F.lit(0).cast("long"))
        found = [inner.keep(_links_within(small, percent, compare))]
        large = named.filter(F.col("members") > WHOLE)
        rows, split = None if large.isEmpty() else whole(large), None
        for number in range(ROUNDS):
            if rows is None:
                break
            centres = inner.keep(_centres(rows))
            own = rows.join(_small(centres, TRAVEL, 16 + 8 * F.size("centre")), "grp", "left")
            apart = inner.keep(_differences(own, percent))
            nearest = apart.groupBy("grp").agg(F.min(F.struct("slack", "cls")).alias("x"), F.max("slack").alias("most"))
            nearest = inner.keep(nearest.select("grp", F.col("x.slack").alias("least"), F.col("x.cls").alias("nearest"), "most"))
            own = apart.join(_small(nearest, TRAVEL, F.lit(32)), "grp")
            near = F.col("slack") + F.col("least") <= 0
            found.append(inner.keep(own.filter(near & (F.col("cls") != F.col("nearest"))).select(F.col("cls").alias("a"), F.col("nearest").alias("b"))))
            # groups that the centre links as a whole are done
            own = own.filter("most + least > 0").withColumn("core", near.cast("long"))
            wide = F.col("members") > BLOCKS * CENTRED // 2 if number < ROUNDS - 1 else F.lit(False)
            found.append(inner.keep(_links_within(_blocks(own.filter(~wide)), percent, None)))
            rest = own.filter(wide)
            if rest.isEmpty():
                break
            token = rest.select("grp", "cls", "core", F.explode("tokens").alias("token")).select(F.xxhash64("grp", "token").alias("next"), "grp", "cls", "core")
            counts = token.groupBy("next").agg(F.count("*").alias("members"), F.min("core").alias("core")).filter("members > 1 and core = 0")
            token = inner.keep(token.join(counts.select("next", "members"), "next"))
            rows = token.join(rest.select("grp", "cls", "n", "v"), ["grp", "cls"]).select(F.col("next").alias("grp"), "cls", "n", "v", "core", "members")
            before, split = split, inner.keep(rows)
            inner.drop(*([before] if before else []), apart, token)
            found.append(inner.keep(_links_within(split.filter(F.col("members") <= CENTRED), percent, None)))
            rows = split.filter(F.col("members") > CENTRED).select(*columns)
            rows = None if rows.isEmpty() else rows
        out = found[0]
        for part in found[1:]:
            out = out.union(part)
        return tables.keep(out.distinct())


def _small(frame: DataFrame, most: int, width) -> DataFrame:
    """The frame, marked for a broadcast if its rows of that width have at most so many bytes."""
    total = frame.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(frame) if total <= most else frame


def labelled(tokens: DataFrame, tables: Tables) -> DataFrame:
    """grp, cls: groups such that classes which share a token (token, cls) share a group.

    A token's group is named by the least token that any of its classes has, so the many
    tokens of classes that are alike mostly fall into one group.
    """
    rows = tables.keep(tokens)
    least = rows.groupBy("cls").agg(F.min("token").alias("least"))
    named = rows.join(least, "cls").groupBy("token").agg(F.min("least").alias("grp"))
    return rows.join(named, "token").select("grp", "cls").distinct()
