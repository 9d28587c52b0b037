"""A selection of governed members compiled to one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import CONSIDERATION_POINT, DIMENSIONS, GRANULARITIES, MEASURES, OPERATORS, PREFIX, Cubes, Selection

MOST_ROWS = 1000
CASTS = {"number": "double", "boolean": "boolean", "time": "timestamp", "string": "string"}


class InvalidSelection(ValueError):
    """A member, operator or limit outside the vocabulary. Raised before any plan is built."""


def alias_of(member: str) -> str:
    return member.replace(".", "__")


def validate(selection: Selection) -> None:
    for m in selection.measures:
        if m not in MEASURES:
            raise InvalidSelection(f"unknown measure {m}")
        if not MEASURES[m].selectable:
            raise InvalidSelection(f"measure {m} is not selectable")
    for d in [*selection.dimensions, *(t["dimension"] for t in selection.time_dimensions)]:
        if d not in DIMENSIONS or DIMENSIONS[d].hidden:
            raise InvalidSelection(f"unknown dimension {d}")
    for t in selection.time_dimensions:
        if DIMENSIONS[t["dimension"]].type != "time" or t.get("granularity") not in (None, *GRANULARITIES):
            raise InvalidSelection(f"bad time dimension {t}")
    for f in selection.filters:
        if f["member"] not in DIMENSIONS and f["member"] not in MEASURES:
            raise InvalidSelection(f"unknown filter member {f['member']}")
        if f["operator"] not in OPERATORS:
            raise InvalidSelection(f"unknown operator {f['operator']}")
        if not f.get("values"):
            raise InvalidSelection(f"filter without values on {f['member']}")
    for m in selection.order:
        if m not in selection.measures and m not in selection.dimensions:
            raise InvalidSelection(f"order by {m}, which is not selected")
    if selection.limit is not None and not 1 <= selection.limit <= MOST_ROWS:
        raise InvalidSelection(f"limit must be 1 to {MOST_ROWS}")


def filter_column(value: Column, type_: str, operator: str, values: list[str]) -> Column:
    """Filter values are text; they are cast by the member's declared type."""
    literals = [F.lit(v).cast(CASTS[type_]) for v in values]
    if operator == "equals":
        return value.isin(*literals)
    if operator == "contains":
        test = F.lit(False)
        for v in values:
            test = test | value.cast("string").ilike(f"%{v}%")
        return test
    return value > literals[0] if operator == "gt" else value < literals[0]


def _prefixed(df: DataFrame, cube: str) -> DataFrame:
    return df.select(*[F.col(c).alias(PREFIX[cube] + c) for c in df.columns])


def joined(cubes: Cubes, needed: set[str], root: str) -> tuple[DataFrame, bool]:
    """The root cube left-joined along the declared edges, and whether a 1:N edge repeats its rows."""
    facts = _prefixed(cubes.deal_points, "deal_points").withColumn("dp_key", F.concat_ws("|", "dp_matter_id", "dp_deal_point_name"))
    entities = cubes.matters
    if "consideration" in needed:
        answer = cubes.deal_points.where(F.col("deal_point_name") == CONSIDERATION_POINT).select(F.col("matter_id").alias("_cid"), F.col("position").alias("consideration_type"))
        entities = entities.join(answer, F.col("id") == F.col("_cid"), "left").drop("_cid")
    entities = _prefixed(entities, "matters")
    out, fanned = (facts, False) if root == "deal_points" else (entities, False) if root == "matters" else (_prefixed(cubes.concepts, "concepts"), False)
    if root == "deal_points" and needed & {"matters", "concepts"}:
        out = out.join(entities, F.col("dp_matter_id") == F.col("m_id"), "left")
    if root == "matters" and "deal_points" in needed:
        out, fanned = out.join(facts, F.col("m_id") == F.col("dp_matter_id"), "left"), True
    if root != "concepts" and "concepts" in needed:
        out = out.join(_prefixed(cubes.concepts, "concepts"), F.col("m_industry_code") == F.col("c_code"), "left")
    return out, fanned


def compile_selection(selection: Selection, cubes: Cubes) -> DataFrame:
    """Rows of the selection; columns are member names with ``__`` for the dot.

    The root is the cube of the measures. With measures of two cubes it is the entities, whose rows the
    facts repeat, so counts of entities then count their distinct keys. Dimensions alone give their distinct values.
    """
    validate(selection)
    members = [DIMENSIONS[d] for d in selection.dimensions]
    times = [(DIMENSIONS[t["dimension"]], t) for t in selection.time_dimensions]
    measure_names = list(dict.fromkeys([*selection.measures, *(f["member"] for f in selection.filters if f["member"] in MEASURES)]))
    measures = [MEASURES[m] for m in measure_names]
    on_rows = [f for f in selection.filters if f["member"] in DIMENSIONS]
    dims = [*members, *(d for d, _ in times), *(DIMENSIONS[f["member"]] for f in on_rows)]
    needed = {d.cube for d in dims} | {m.cube for m in measures}
    roots = {m.cube for m in measures} or {d.cube for d in dims}
    root = "matters" if "matters" in roots else "deal_points" if "deal_points" in roots else "concepts"
    if any(d.name == "matters.consideration_type" for d in dims):
        needed.add("consideration")
    base, fanned = joined(cubes, needed, root)
    for f in on_rows:
        d = DIMENSIONS[f["member"]]
        base = base.where(filter_column(d.column(), d.type, f["operator"], f["values"]))
    keys = [d.column().alias(alias_of(d.name)) for d in members]
    for d, t in times:
        if t.get("date_range"):
            low, high = t["date_range"]
            base = base.where(d.column().between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
        if t.get("granularity"):
            keys.append(F.date_trunc(t["granularity"], d.column()).alias(f"{alias_of(d.name)}__{t['granularity']}"))
    if not measures:
        out = base.select(*keys).distinct()
    else:
        facts_counted = fanned and root == "matters"
        aggregates = []
        for m in measures:
            if m.cube == "matters":
                repeated = fanned or root != "matters"
            else:
                repeated = facts_counted and m.how == "count"  # an entity without a fact has a row and no fact key
            aggregates.append(m.column(repeated).alias(alias_of(m.name)))
        out = base.groupBy(*keys).agg(*aggregates) if keys else base.agg(*aggregates)
    for f in selection.filters:
        if f["member"] in MEASURES:
            out = out.where(filter_column(F.col(alias_of(f["member"])), "number", f["operator"], f["values"]))
    names = [k for k in out.columns if k not in {alias_of(m) for m in measure_names} or k in {alias_of(m) for m in selection.measures}]
    out = out.select(*names)
    if selection.order or selection.limit is not None:
        asked = [F.col(alias_of(m)).desc_nulls_first() if way == "desc" else F.col(alias_of(m)).asc_nulls_last() for m, way in selection.order.items()]
        ties = [F.col(c).asc_nulls_last() for c in out.columns if c not in {alias_of(m) for m in MEASURES}]
        out = out.orderBy(*asked, *ties)
    return out.limit(selection.limit) if selection.limit is not None else out


def governed(selection: Selection, cubes: Cubes, min_n: int) -> DataFrame:
    """The selection with every group below ``min_n`` facts (or entities) left out, whatever was asked for."""
    root = "matters" if any(m.startswith("matters.") for m in selection.measures) else "deal_points"
    gate = {"member": f"{root}.n", "operator": "gt", "values": [str(min_n - 1)]}
    return compile_selection(Selection(selection.measures, selection.dimensions, [*selection.filters, gate], selection.time_dimensions, selection.order, selection.limit), cubes)


def described_rows() -> list[tuple[str, str, str]]:
    """(name, kind, description) of every member that is not hidden."""
    dims = [(d.name, "dimension", d.description) for d in DIMENSIONS.values() if not d.hidden]
    return dims + [(m.name, "measure", m.description) for m in MEASURES.values()]


def catalog_rows() -> list[tuple[str, str, str, str, bool]]:
    """(name, kind, cube, type or aggregate, selectable) of every member that is not hidden."""
    dims = [(d.name, "dimension", d.cube, d.type, True) for d in DIMENSIONS.values() if not d.hidden]
    return dims + [(m.name, "measure", m.cube, m.how, m.selectable) for m in MEASURES.values()]


def label_sizes(cubes: Cubes) -> DataFrame:
    """(name, n_values) of every dimension that is not hidden: how many different values the data have for it, NULL left out.

    Values of all dimensions of a cube are told apart together, so no task gathers those of one dimension.
    """
    out = None
    for cube in PREFIX:
        dims = [d for d in DIMENSIONS.values() if d.cube == cube and not d.hidden]
        rows, _ = joined(cubes, {cube, "consideration"} if cube == "matters" else {cube}, cube)
        cells = F.array(*[F.struct(F.lit(d.name).alias("name"), d.column().cast("string").alias("value")) for d in dims])
        values = rows.select(F.explode(cells).alias("x")).select("x.name", "x.value").distinct()
        sizes = values.groupBy("name").agg(F.count("value").alias("n_values"))
        out = sizes if out is None else out.unionByName(sizes)
    return out
