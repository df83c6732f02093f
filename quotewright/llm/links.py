"""Links among things that share keys, without meeting everybody in a group."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, joined_components, narrowed, views

KEY_ROUNDS, RARE_ROUNDS = 2, 1
CELL = math.log(1.05)
BEFORE, SKETCH = 8, 512


def shared_keys(keyed: DataFrame, scratch: Scratch, name: str, *more: str) -> DataFrame:
    """keyed (key, id) without the keys of one row. more: c, to have the key's rows in keyed, too."""
    keys = scratch.cut(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", *more), f"{name}-several")
    found = narrowed(keyed.select("key", "id"), keys, "key", "key").join(keys, "key").distinct()
    return scratch.cut(found, name)


def within(pairs: DataFrame, sets: DataFrame, num: int, den: int, distance: int | None, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most distance values and whose sets have den * |intersection| >= num * |union|.

    sets has (id, v, n, sig, s); an id may have several sets (v), and any of them may make the link. Signatures (16-bit
    values) are compared first, so that only pairs under the distance meet the sets.
    """

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
            keep = pa.array((x != y).sum(1) <= distance)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], ["a", "b", "va", "vb"])

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for p, q in zip(views(batch.column(2)), views(batch.column(3))):
                small, large = sorted((len(p), len(q)))
                ok = den * small >= num * large
                if ok:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok = both and den * both >= num * (small + large - both)
                keep.append(bool(ok))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda c, *more: sets.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), *[F.col(m).alias(m + c) for m in more])
    met = pairs.join(side("b", "n", *["sig"] * (distance is not None)), "b").join(side("a", "n", *["sig"] * (distance is not None)), "a")
    met = met.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    if distance is not None:
        met = met.select("a", "b", "va", "vb", "siga", "sigb").mapInArrow(near, "a bigint, b bigint, va bigint, vb bigint")
    met = scratch.cut(met.select("a", "b", "va", "vb"), f"{name}-close")
    full = met.join(side("b", "s"), ["b", "vb"]).join(side("a", "s"), ["a", "va"]).select("a", "b", "sa", "sb")
    return scratch.cut(full.mapInArrow(compare, "a bigint, b bigint").distinct(), f"{name}-links")


def elements(sets: DataFrame) -> DataFrame:
    """(id, v, n, x): a row for each element of each set."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            each = views(batch.column(3))
            size = [len(x) for x in each]
            flat = (np.concatenate(each) if each else np.zeros(0, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(i).to_numpy(), size)) for i in range(3)), pa.array(flat)], ["id", "v", "n", "x"])

    return sets.select("id", "v", "n", "s").mapInArrow(spread, "id bigint, v bigint, n int, x bigint")


def sketches(sets: DataFrame) -> DataFrame:
    """(id, v, b): SKETCH parity bits of each set, of how many elements fall on each. Two sets' bits differ in no more places than their elements do."""

    def run(batches):
        import pyarrow as pa

        names = [f"b{i}" for i in range(SKETCH // 64)]
        for batch in batches:
            bits = [np.packbits((np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)) for x in views(batch.column(2))]
            words = np.stack(bits).view(np.int64) if bits else np.zeros((0, SKETCH // 64), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(names))], names)], ["id", "v", "b"])

    return sets.select("id", "v", "s").mapInArrow(run, f"id bigint, v bigint, b struct<{','.join(f'b{i}:bigint' for i in range(SKETCH // 64))}>")


def prefixes(sets: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """(x, id, n, i, c, before, b): the elements by which a set may first meet another that reaches num / den with it.

    Every set's elements are put in one order for all, rarest first; i is an element's place, c how many sets have it,
    before the BEFORE elements that stand before it, b the set's sketch. The overlap of a pair of sizes r >= s is at least num r / den, so its
    first shared element stands among the first r - num r / den + 1 of the larger set, and so does that of the smaller.
    A set's own elements are its rarest: they fill the places of a heavily edited copy, and need no row.
    """
    each = elements(sets)
    several = scratch.cut(each.groupBy("x").agg(F.count("*").cast("int").alias("c")).where("c > 1"), f"{name}-often")  # combined before it is shuffled
    order = Window.partitionBy("id", "v").orderBy("c", "x")  # a text's elements
    ranked = narrowed(each, several, "x", "x").join(several, "x").withColumns({"k": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("id", "v"))})
    placed = ranked.withColumn("i", F.expr("cast(n - all + k - 1 as int)")).where(f"i <= n - ({num} * n + {den - 1}) div {den}")
    placed = placed.withColumn("before", F.collect_list("x").over(order.rowsBetween(-BEFORE, -1)))  # what stands before a place that is left is left, too
    placed = placed.select("x", "id", "v", "n", "i", "c", "before").join(sketches(sets), ["id", "v"])
    return scratch.cut(placed.drop("v"), f"{name}-placed")


def _enough(num: int, den: int) -> str:
    """Whether p and q, which meet at the elements i, may reach num / den: their sizes, what follows in both, and how much their sketches differ."""
    differ = " + ".join(f"bit_count(p.b.b{i} ^ q.b.b{i})" for i in range(SKETCH // 64))
    return f"{den} * least(p.n, q.n) >= {num} * greatest(p.n, q.n) and {den + num} * least(p.n - p.i, q.n - q.i) >= {num} * (p.n + q.n) and {den + num} * ({differ}) <= {den - num} * (p.n + q.n)"


def _apart(placed: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """placed with comp, of the elements that several components have, and main, the one that has it most often. Narrow rows say which these are."""
    named = comps.withColumnRenamed("node", "id")
    narrow = placed.select("x", "id").join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = narrow.groupBy("x", "comp").agg(F.count("*").alias("m")).groupBy("x").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("kinds"))
    main = scratch.cut(main.where("kinds > 1").select("x", "main"), f"{name}-main")
    return narrowed(placed, main, "x", "x").join(main, "x").join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def rare_pairs(placed: DataFrame, comps: DataFrame, num: int, den: int, turn: int, scratch: Scratch, name: str) -> DataFrame:
    """For each id up to three pairs (a, b) with members of other components that may reach num / den, by the rarest and the most frequent element that has one."""
    member = _apart(placed.drop("before"), comps, scratch, name).select("x", "c", F.struct("comp", "id", "n", "i", "b").alias("p"))
    mark = F.xxhash64("p.id", F.lit(turn))
    heads = member.groupBy("x").agg(F.min_by("p", mark).alias("any"), F.min_by("p", F.struct("p.comp", mark)).alias("least"), F.max_by("p", F.struct("p.comp", mark)).alias("most")).where("least.comp < most.comp")
    met = member.join(heads, "x").withColumn("q", F.expr("case when p.comp <> any.comp then any when p.comp <> least.comp then least else most end"))
    other = lambda seed: F.min_by("q.id", F.struct("c", F.xxhash64("q.id", F.lit(turn), F.lit(seed))))
    met = met.where(f"p.comp <> q.comp and {_enough(num, den)}").groupBy("p.id").agg(F.array_distinct(F.array(other(0), other(1), F.max_by("q.id", F.struct("c", "q.id")))).alias("o")).withColumn("o", F.explode("o"))
    return met.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def prefix_pairs(placed: DataFrame, comps: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """All pairs (a, b) of different components that may reach num / den.

    With s the smaller and r the larger size, the overlap is num (r + s) / (num + den) at least, so the smaller set's first
    shared element is among its first s - 2 num s / (num + den) + 1, and an element at place i only has partners of sizes
    up to (num + den) (n - i) / num - n. Elements are met by size cells of 5 % and not within their most frequent
    component, so the members of one group don't all meet; a pair that met at one of the elements before does not come up
    again.
    """
    apart = scratch.cut(_apart(placed, comps, scratch, name).withColumn("in_main", F.col("comp") == F.col("main")), f"{name}-apart")
    one = F.struct("id", "comp", "n", "i", "before", "b")
    cell = lambda c: F.floor(F.log(F.col(c).cast("double")) / CELL + 1e-9).cast("int")
    lo, hi = F.expr(f"({num} * n + {den - 1}) div {den}"), F.expr(f"least(n, ({den + num} * (n - i)) div {num} - n)")
    large = apart.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi")))).select("x", "cell", "in_main", one.alias("p"))
    small = apart.where(f"i <= n - (2 * {num} * n + {den + num - 1}) div {den + num}").withColumn("in_main", F.explode(F.when(F.col("in_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    small = small.select("x", cell("n").alias("cell"), "in_main", one.alias("q"))
    spot = F.xxhash64("x", "cell", "in_main")
    large = narrowed(large.withColumn("at", spot), small.select(spot.alias("at")), "at", "at").drop("at")  # few have somebody to meet
    met = large.join(small, ["x", "cell", "in_main"]).where(f"p.comp <> q.comp and (p.n > q.n or p.n = q.n and p.id > q.id) and {_enough(num, den)} and not arrays_overlap(p.before, q.before)")
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def pairs_of_groups(keyed: DataFrame) -> DataFrame:
    """All pairs (a, b) that share a key. Only for groups of a bounded size."""
    side = lambda c: keyed.select("key", F.col("id").alias(c))
    return side("a").join(side("b"), "key").where("a < b").select("a", "b").distinct()


def resolve(keyed: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int, distance: int | None, scratch: Scratch, name: str, small: int = 0) -> DataFrame:
    """(node, comp) of the links (a, b) and of the pairs within() confirms among ids that share a key.

    keyed has (key, id), sets what within() says, for every id of keyed. Where small is given, keyed has c, too, how many
    rows a key has at most, and in groups of up to small rows everybody meets everybody: at most (small - 1) / 2 pairs a
    row, fewer than the rounds below would try. The other groups go through the rounds. First comes what is easily joined: in KEY_ROUNDS,
    every member of a key's group meets one partner of another component, from the second round on the group's most
    central one, that whose keys are the most frequent; in RARE_ROUNDS, it meets one by its rarest element. Groups that
    lie in one component are done. Then prefix_pairs gives every pair that is left across components and may still
    reach the threshold. Nothing is capped, a pair is tried once.
    """
    state = {"comps": connected_components(links, scratch, f"{name}-comps"), "tried": None, "turn": 0}

    def open_members() -> DataFrame:
        member = keyed.join(state["comps"].withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        several = member.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select("key")
        return scratch.cut(member.join(several, "key"), f"{name}-member")

    def try_(pairs: DataFrame) -> None:
        state["turn"] += 1
        if state["tried"] is not None:
            pairs = pairs.join(state["tried"], ["a", "b"], "left_anti")
        pairs = scratch.cut(pairs, f"{name}-pairs-{state['turn']}")
        if pairs.limit(1).count():
            new = within(pairs, sets, num, den, distance, scratch, f"{name}-{state['turn']}")
            state["tried"] = pairs if state["tried"] is None else state["tried"].union(pairs)
            if new.limit(1).count():
                state["comps"] = joined_components(state["comps"], new, scratch, f"{name}-comps")

    if small:
        try_(pairs_of_groups(keyed.where(F.col("c") <= small)))
        keyed = scratch.cut(keyed.where(F.col("c") > small).select("key", "id"), f"{name}-large")
    for turn in range(KEY_ROUNDS):
        member = open_members()
        if not member.limit(1).count():
            return state["comps"]
        one, mark = F.struct("comp", "id"), F.xxhash64("id", F.lit(turn))
        if turn:
            often = member.groupBy("key").agg(F.count("*").alias("c"))
            member = member.join(member.join(often, "key").groupBy("id").agg(F.sum("c").alias("central")), "id")
            heads = member.groupBy("key").agg(F.max_by(one, F.struct("central", mark)).alias("p"), F.max_by(one, F.struct("comp", mark)).alias("q"), F.min_by(one, F.struct("comp", mark)).alias("r"))
        else:
            heads = member.groupBy("key").agg(F.min(one).alias("p"), F.max(one).alias("q"), F.max(one).alias("r"))
        met = member.join(heads, "key").withColumn("o", F.expr("case when comp <> p.comp then p when comp <> q.comp then q else r end"))
        met = met.groupBy("id").agg(F.min_by("o.id", F.xxhash64("o.id", F.lit(turn))).alias("o"))
        try_(met.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct())
    member = open_members()
    if not member.limit(1).count():
        return state["comps"]
    left = scratch.cut(sets.join(member.select("id").distinct(), "id", "left_semi").select("id", "v", "n", "s"), f"{name}-left")
    placed = prefixes(left, num, den, scratch, name)
    for turn in range(RARE_ROUNDS):
        try_(rare_pairs(placed, state["comps"], num, den, turn, scratch, name))
    try_(prefix_pairs(placed, state["comps"], num, den, scratch, name))
    scratch.drop(f"{name}-member", f"{name}-left", f"{name}-often", f"{name}-placed", f"{name}-main", f"{name}-apart")
    return state["comps"]
