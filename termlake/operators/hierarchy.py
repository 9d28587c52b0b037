"""Hierarchies of any depth by pointer doubling: after k rounds every node knows its ancestor 2^k levels up.

Descendants and ancestors of asked nodes take as many rounds as the depth has binary digits, and rows in proportion to
their result. ``intervals`` numbers a whole forest so that "at or below" is a range test. Asking a tree for
what lies on or above a circle raises CycleFound; where a node may have several parents, circles are allowed. A code with several parents
has the smallest one in tree functions; a parent without a row of its own is a root. Every round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored


class CycleFound(ValueError):
    """Parents run in a circle at or above the named codes."""


def pointers(concepts: DataFrame) -> DataFrame:
    """(code, up): each code's smallest parent, of the codes that have one."""
    return concepts.where("code IS NOT NULL AND parent_code IS NOT NULL").groupBy("code").agg(F.min("parent_code").alias("up"))


def _doubled(now: DataFrame) -> DataFrame:
    """Twice as far."""
    a, b = now.alias("a"), now.alias("b")
    return a.join(b, F.col("a.up") == F.col("b.code")).select("a.code", "b.up")


def jumps(single: DataFrame) -> Iterator[tuple[int, DataFrame, bool]]:
    """(distance, table of (code, up), False) for the distances 1, 2, 4, ... as long as any node has an ancestor so far up.

    A path without a circle is no longer than there are nodes with a parent. If some go on beyond that, a last table with
    True has the nodes at or below a circle.
    """
    now, path = stored(single.select("code", "up"), "jumps")
    longest = rows = now.count()
    distance = 1
    while rows:
        yield distance, now, distance > longest
        if distance > longest:
            return
        further, further_path = stored(_doubled(now), "jumps")
        dropped(now.sparkSession, path)
        now, path, distance, rows = further, further_path, 2 * distance, further.count()
    dropped(now.sparkSession, path)


def _grown(start: DataFrame, single: DataFrame, step) -> tuple[DataFrame, DataFrame | None]:
    """``start`` with the rows that ``step(so far, jumps, distance)`` adds for each distance; and the codes at or below a circle, if any."""
    now, path = stored(start, "closure")
    for distance, jump, endless in jumps(single):
        if endless:
            return now, jump.select("code")
        more, more_path = stored(now.unionByName(step(now, jump, distance)), "closure")
        dropped(now.sparkSession, path)
        now, path = more, more_path
    return now, None


def _refuse(looped: DataFrame) -> None:
    """Raise if there are such codes."""
    some = [str(r["code"]) for r in looped.select("code").distinct().orderBy("code").limit(3).collect()]
    if some:
        raise CycleFound(f"no root above {', '.join(some)}")


def descendants(concepts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, code, depth) of every node at or below the codes of ``roots`` (code), none of which may lie on a circle."""
    start = roots.select(F.col("code").alias("root"), F.col("code"), F.lit(0).alias("depth")).distinct()

    def step(now: DataFrame, jump: DataFrame, distance: int) -> DataFrame:
        return now.alias("d").join(jump.alias("j"), F.col("d.code") == F.col("j.up")).select("d.root", "j.code", (F.col("d.depth") + distance).alias("depth"))

    found, endless = _grown(start, pointers(concepts), step)
    if endless is not None:
        _refuse(found.where("root = code AND depth > 0"))
    return found


def ancestors(concepts: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, ancestor, position) of every node on the way up, the root first at position 1; no code may lie at or below a circle."""
    start = codes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("up")).distinct()

    def step(now: DataFrame, jump: DataFrame, distance: int) -> DataFrame:
        return now.alias("a").join(jump.alias("j"), F.col("a.ancestor") == F.col("j.code")).select("a.code", F.col("j.up").alias("ancestor"), (F.col("a.up") + distance).alias("up"))

    found, endless = _grown(start, pointers(concepts), step)
    if endless is not None:
        _refuse(codes.join(endless, "code", "left_semi"))
    levels = F.max("up").over(Window.partitionBy("code"))
    return found.select("code", "ancestor", (levels - F.col("up") + 1).cast("int").alias("position"))


def looped(single: DataFrame) -> DataFrame:
    """(code) of the nodes at or below a circle."""
    for _, table, endless in jumps(single):
        if endless:
            return table.select("code")
    return single.select("code").where("false")


def _followers(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``follower``: the next larger key of the same group, NULL for the last. No task orders more than its range."""
    order = [F.col(group).asc_nulls_first(), F.col(key)]
    ranged, path = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(group, key)).alias("x")).orderBy("_part").collect()  # a row for each range
    heads = [(a["_part"], b["x"][group], b["x"][key]) for a, b in zip(firsts, firsts[1:])]
    kinds = dict(rows.dtypes)
    after = rows.sparkSession.createDataFrame(heads, f"_part int, _group {kinds[group]}, _key {kinds[key]}")
    within = Window.partitionBy("_part").orderBy(*order)
    own = ranged.withColumns({"_g": F.lead(group).over(within), "_k": F.lead(key).over(within)})
    placed = own.join(F.broadcast(after), "_part", "left")
    last = F.col("_k").isNull()
    next_group, next_key = F.when(last, F.col("_group")).otherwise(F.col("_g")), F.when(last, F.col("_key")).otherwise(F.col("_k"))
    out, _ = stored(placed.select(*rows.columns, F.when(next_group.eqNullSafe(F.col(group)), next_key).alias("follower")), "followers")
    dropped(rows.sparkSession, path)
    return out


def intervals(concepts: DataFrame) -> DataFrame:
    """(code, root, depth, low, high) of every node: x lies at or below y if both have one root and low_y <= low_x <= high_y.

    A walk around each tree goes down to and up from every node once; each step knows the next one, and doubling
    counts the steps left to the end. ``low`` and ``high`` are the counts when the node is left and entered.
    """
    single = pointers(concepts)
    codes = concepts.where("code IS NOT NULL").select("code").union(single.select("up")).distinct()
    nodes = _followers(codes.join(single, "code", "left"), "up", "code")
    first = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("of")).agg(F.min("code").alias("child"))
    known = nodes.join(first, F.col("code") == F.col("of"), "left")
    step = lambda code, down: F.struct(code.alias("code"), F.lit(down).alias("down"))
    enter = F.when(F.col("child").isNotNull(), step(F.col("child"), True)).otherwise(step(F.col("code"), False))
    sibling = F.col("follower").isNotNull() & F.col("up").isNotNull()
    leave = F.when(sibling, step(F.col("follower"), True)).when(F.col("up").isNotNull(), step(F.col("up"), False))
    arc = lambda at, following, w: F.struct(at.alias("at"), following.alias("next"), F.lit(w).alias("w"))
    walk = known.select(F.explode(F.array(arc(step(F.col("code"), True), enter, 1), arc(step(F.col("code"), False), leave, -1))).alias("x"))
    now, path = stored(walk.select("x.at", "x.next", F.when(F.col("x.next").isNull(), 0).otherwise(1).cast("bigint").alias("left"), F.col("x.w").cast("bigint").alias("level"), F.coalesce("x.next", "x.at").alias("end")), "walk")
    steps, distance = now.count(), 1
    while not now.where("next IS NOT NULL").isEmpty():
        if distance > steps:
            raise CycleFound("no root above " + ", ".join(str(r["code"]) for r in now.where("next IS NOT NULL").select("at.code").distinct().orderBy("code").limit(3).collect()))
        a, b = now.alias("a"), now.alias("b")
        joined = a.join(b, F.col("a.next") == F.col("b.at"), "left")
        more = lambda c: (F.col(f"a.{c}") + F.coalesce(f"b.{c}", F.lit(0))).alias(c)
        further, further_path = stored(joined.select("a.at", "b.next", more("left"), more("level"), F.coalesce("b.end", "a.end").alias("end")), "walk")
        dropped(now.sparkSession, path)
        now, path, distance = further, further_path, 2 * distance
    # A node counts as entered: -depth is what the walk goes down, up counted as less, from there to its end.
    down = lambda c: F.max(F.when(F.col("at.down"), F.col(c)))
    low = F.max(F.when(~F.col("at.down"), F.col("left")))
    return now.groupBy("at.code").agg(F.max("end.code").alias("root"), (-down("level")).cast("int").alias("depth"), low.alias("low"), down("left").alias("high"))


def inside(numbered: DataFrame, code: str) -> DataFrame:
    """The rows of ``intervals`` at or below ``code``, by a range test; none if the code is unknown."""
    at = numbered.where(F.col("code") == code).first()
    return numbered.where((F.col("root") == at["root"]) & F.col("low").between(at["low"], at["high"])) if at else numbered.where("false")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(code) of every node at or below ``start`` (code) over ``edges`` (code, parent_code), several parents and circles allowed.

    Over the smallest parents doubling reaches everything below a set; the other edges then carry on from what is new.
    So rounds follow the other edges on a path, not its length.
    """
    edges, _ = stored(edges.where("code IS NOT NULL AND parent_code IS NOT NULL").select("code", "parent_code").distinct(), "edges")
    single, _ = stored(pointers(edges), "first-parents")
    other = edges.join(single.withColumnRenamed("up", "parent_code"), ["code", "parent_code"], "left_anti")

    def step(now: DataFrame, jump: DataFrame, distance: int) -> DataFrame:
        return jump.join(now.withColumnRenamed("code", "up"), "up", "left_semi").select("code").join(now, "code", "left_anti")

    reached, new = None, start.select("code").distinct()
    while True:
        found, _ = _grown(new, single, step)
        reached, _ = stored(found if reached is None else reached.unionByName(found).distinct(), "reached")
        beyond = other.join(reached.withColumnRenamed("code", "parent_code"), "parent_code", "left_semi").select("code").distinct()
        new, _ = stored(beyond.join(reached, "code", "left_anti"), "reached")
        if new.isEmpty():
            return reached


def excluded_subtree(labels: DataFrame, edges: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Codes at or below a node whose label starts with a prefix, over all parents. ``edges``: code, parent_code."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("label").startswith(p)
    return reachable(edges, labels.where(test).select("code"))


def ancestry(labels: DataFrame, edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """code, its chain of codes (root first) and level, by the smallest eligible parent at each step, cycles cut.

    Only codes below a circle, whose chain depends on what it has passed, are followed step by step.
    """
    keep = labels.join(excluded, "code", "left_anti").select("code")
    ok = edges.join(keep, "code", "left_semi").join(keep.withColumnRenamed("code", "parent_code"), "parent_code", "left_semi").where("code <> parent_code")
    ok, _ = stored(ok.select("code", "parent_code").distinct(), "eligible")
    try:
        return _chains(ok, keep)
    except CycleFound:
        around = looped(pointers(ok))
        straight = _chains(ok.join(around, "code", "left_anti"), keep.join(around, "code", "left_anti"))
        return straight.unionByName(_followed(ok, around))


def _chains(edges: DataFrame, codes: DataFrame) -> DataFrame:
    up = ancestors(edges, codes).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("position", "ancestor"))).alias("x"))
    return up.select("code", F.col("x.ancestor").alias("chain"), F.size("x").alias("level"))


def _followed(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Chains one step a round, each time to the smallest parent that the chain hasn't passed."""
    parents = edges.groupBy("code").agg(F.array_sort(F.collect_set("parent_code")).alias("parents")).withColumnRenamed("code", "top")
    now, path = stored(codes.select("code", F.array("code").alias("chain"), F.lit(True).alias("open")), "chains")
    while not now.where("open").isEmpty():
        step = F.get(F.array_except("parents", "chain"), F.lit(0))
        more = now.where("open").withColumn("top", F.get("chain", F.lit(0))).join(parents, "top", "left")
        longer = more.select("code", F.when(step.isNotNull(), F.array_prepend("chain", step)).otherwise(F.col("chain")).alias("chain"), step.isNotNull().alias("open"))
        further, further_path = stored(now.where("NOT open").unionByName(longer), "chains")
        dropped(now.sparkSession, path)
        now, path = further, further_path
    return now.select("code", "chain", F.size("chain").alias("level"))


def flattened(labels: DataFrame, edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Concept rows with parent, level and the first three codes of the chain."""
    chain = ancestry(labels, edges, excluded).join(labels.select("code", "label"), "code")
    at = lambda i: F.get("chain", F.lit(i))
    parent = F.when(F.col("level") > 1, F.get("chain", F.col("level") - 2))
    return chain.select("code", "label", parent.alias("parent_code"), "level", *[at(i).alias(f"level_{i + 1}_code") for i in range(3)])


def under(entities: DataFrame, concepts: DataFrame, code: str, column: str = "industry_code") -> DataFrame:
    """Entities whose concept is ``code`` or lies anywhere below it.

    The stored ancestry answers this for three levels; only a deeper hierarchy is gone down.
    """
    if concepts.where("level > 3").isEmpty():
        within = concepts.where(F.lit(code).isin(*map(F.col, ("code", "level_1_code", "level_2_code", "level_3_code")))).select("code")
    else:
        within = descendants(concepts, concepts.where(F.col("code") == code)).select("code")
    return entities.join(within.withColumnRenamed("code", column), column, "left_semi")
