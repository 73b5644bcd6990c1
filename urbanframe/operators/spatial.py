"""Exact nearest-site assignment by great-circle distance, without a cross join.

Every point is matched with its closest site (Haversine, km); ties go to the
smallest site label; when several points share an id, the id keeps its single
closest (point, site) pair.  This is the argmin of the full points x sites
product, but the product is never built:

1. Sites are cleaned (NULL coordinates dropped) and collapsed per exact position
   to the smallest label -- at one position only that label can ever win.
2. Points and sites become unit vectors (x, y, z).  The chord |p - s| grows
   monotonically with the great-circle distance, so cells of a 3-D grid bound it;
   no special case at poles or the date line.
3. Occupied cells of points, and of sites, form pyramids: a cell of one level lies in
   a cell of the level above, and each has the tight box of what is in it.
4. Both pyramids are descended together.  A site cell stays a candidate of a point
   cell only if its least possible distance is no more than the smallest greatest
   distance among that point cell's candidates.  The bound keeps every site that can
   be nearest to any point of the cell, ties included.
5. Point cells whose list of candidate sites is longer than ``max_sites_per_cell`` are
   split: their points are cut into cells 16 times finer, one level after the other,
   and each new cell prunes its parent's list.  So a patch of sites costs a far or a
   near suburb of it only what its points cannot tell apart.
6. Every point meets its own cell's short list, held as one array, in one equi-join and
   leaves it as one row with its nearest site: candidate pairs are never sorted or moved.
   Those rows are rebalanced by id before the argmin, so a task sorts a bounded number
   of them however long its scan was, and an id with very many points is spread.

Points are read for their extent, for their cells and for the last join; the points
of cells that were split are written once and read twice more a round.  Lists and
cells are Parquet in the shared checkpoint folder, which cuts the lineage and
survives executor loss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions.scalars import haversine_sql, to_double, unit_vector
from urbanframe.operators.aggregate import reproducible_avg
from urbanframe.operators.joins import DEFAULT_MAX_BROADCAST_BYTES, JOIN_STRATEGIES, with_strategy
from urbanframe.session import materialize

# Slack of every distance comparison: coordinates of unit vectors are exact to about
# 1e-15, so a relative 1e-9 plus an absolute 1e-13 keeps the proofs sound.
RELATIVE_MARGIN, ABSOLUTE_MARGIN = 1e-9, 1e-13
MIN_CELL = 1e-7  # unit-sphere chord, about 0.6 m on Earth
MAX_CELL = 4.0  # cells of level 0; a cell of level n is 2**n times smaller
MAX_LEVEL = 28  # about 0.1 m; sites that are no farther apart than that stay on one list
DEFAULT_MAX_SITES_PER_CELL = 32
FEW_SITES = 64  # sites that all first lists hold, without a pyramid
LEAF_SITES = 8  # sites of a cell on the last level of their pyramid
LEAST_POINT_CELLS = 4096
FINER = 4  # levels by which a cell is split in a round


def clean_points(points: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """Keep points with both coordinates, dropping only the exact (0, 0) 'null island'.

    A point with a single zero coordinate is kept; NaN or infinite coordinates
    (which have no distance) are dropped like missing ones.
    """
    la, lo = to_double(lat), to_double(lon)
    return points.select(F.col(id_col).alias("_id"), la.alias("_lat"), lo.alias("_lon")).filter(
        _finite("_lat") & _finite("_lon") & ~((F.col("_lat") == 0) & (F.col("_lon") == 0))
    )


def _finite(c: str) -> Column:
    """Not NULL, not NaN, not infinite (text such as "NaN" parses to a double)."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))


def clean_sites(sites: DataFrame, label: str, lat: str, lon: str) -> DataFrame:
    """Sites with both coordinates, one row per exact position (smallest label).

    A site without coordinates is dropped: left in, its NULL distance would sort
    first and capture every point.  ``_rank`` is a bigint that orders positions
    like their labels (from a range-partitioned sort, so no single task sees all
    sites); comparing ranks instead of strings keeps the per-id argmin light.
    """
    out = (
        sites.select(F.col(label).alias("_label"), to_double(lat).alias("_slat"), to_double(lon).alias("_slon"))
        .filter(_finite("_slat") & _finite("_slon"))
        .groupBy("_slat", "_slon")
        .agg(F.min("_label").alias("_label"))
    )
    sx, sy, sz = unit_vector("_slat", "_slon")
    return (
        out.orderBy("_label", "_slat", "_slon")
        .withColumn("_rank", F.monotonically_increasing_id())
        .select("_label", "_rank", "_slat", "_slon", sx.alias("_sx"), sy.alias("_sy"), sz.alias("_sz"))
    )


_UNIT = (
    "cos(radians(_lat)) * cos(radians(_lon)) AS _px",
    "cos(radians(_lat)) * sin(radians(_lon)) AS _py",
    "sin(radians(_lat)) AS _pz",
)

_NEAREST = (
    "array_min(transform(_sites, s -> named_struct("
    f"'distance_km', {haversine_sql('_lat', '_lon', 's._slat', 's._slon')}, 'rank', s._rank)))"
)


def _cell_name(prefix: str, level: int | str) -> str:
    """SQL text of the cell of ``level`` that holds a vector; its name starts with the level."""
    size = f"({MAX_CELL!r}D / pow(2.0D, {level}))"
    return f"concat_ws(':', {level}, {', '.join(f'CAST(floor({prefix}{a} / {size}) AS BIGINT)' for a in 'xyz')})"


def _parent(node: str, steps: int) -> str:
    """SQL text of the cell ``steps`` levels above a named cell."""
    part = f"split({node}, ':')"
    index = ", ".join(f"shiftright(CAST({part}[{i}] AS BIGINT), {steps})" for i in (1, 2, 3))
    return f"concat_ws(':', CAST({part}[0] AS INT) - {steps}, {index})"


def _box(kind: str, low: str = "_{0}", high: str = "_{0}") -> list[Column]:
    """Tight box of grouped vectors or boxes as ``_<kind>lo<axis>, _<kind>hi<axis>``."""
    out = []
    for axis in "xyz":
        out.append(F.min(low.format(axis)).alias(f"_{kind}lo{axis}"))
        out.append(F.max(high.format(axis)).alias(f"_{kind}hi{axis}"))
    return out


def _box_names(kind: str) -> list[str]:
    return [f"_{kind}{end}{axis}" for axis in "xyz" for end in ("lo", "hi")]


def _chords(kind: str) -> tuple[str, str]:
    """SQL text of the least and the greatest chord between a point cell's box and a site box."""
    lo, hi = f"_{kind}lo", f"_{kind}hi"
    least = [f"pow(greatest(0.0D, {lo}{a} - _phi{a}, _plo{a} - {hi}{a}), 2)" for a in "xyz"]
    most = [f"pow(greatest({hi}{a} - _plo{a}, _phi{a} - {lo}{a}), 2)" for a in "xyz"]
    return f"sqrt({' + '.join(least)})", f"sqrt({' + '.join(most)})"


def _pruned(state: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """Keep a point cell's candidates that can hold the nearest site of one of its points."""
    least, most = _chords(kind)
    rows = state.selectExpr("_pc", *keep, f"{least} AS _least", f"min({most}) OVER (PARTITION BY _pc) AS _bound")
    return rows.where(f"_least <= _bound * {1 + RELATIVE_MARGIN!r}D + {ABSOLUTE_MARGIN!r}D").drop("_least", "_bound")


def _level_of(cell: float) -> int:
    return min(MAX_LEVEL, max(0, math.floor(math.log2(MAX_CELL / max(cell, MIN_CELL)))))


class _Sites:
    """Cleaned sites with the pyramid of their occupied cells, from ``top`` (at most 64 cells) down to ``last``."""

    def __init__(self, sites: DataFrame, max_broadcast_bytes: int):
        self.sites = sites
        stats = sites.agg(F.count(F.lit(1)).alias("n"), *[f(f"_s{a}").alias(f"{k}{a}") for a in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]).first()
        self.count = int(stats["n"])
        if not self.count:
            return
        extents = sorted((stats[f"hi{a}"] - stats[f"lo{a}"] for a in "xyz"), reverse=True)
        # the average spacing: one site a cell over the box's largest face
        self.spacing = math.sqrt(max(extents[0] * extents[1], MIN_CELL * MIN_CELL) / self.count)
        self.top = _level_of(extents[0])  # cells as wide as all sites: two along an axis at most
        self.small = self.count * _SITE_BYTES <= max_broadcast_bytes
        self.few = self.count <= FEW_SITES

    def build(self) -> None:
        """The pyramid, down to the first level on which no cell holds more than ``LEAF_SITES``; few sites need none."""
        if self.few:
            return
        levels = list(range(self.top, MAX_LEVEL + 1, 2))
        names = ", ".join(f"named_struct('level', {n}, 'node', {_cell_name('_s', n)})" for n in levels)
        each = self.sites.selectExpr("_sx AS _x", "_sy AS _y", "_sz AS _z", f"inline(array({names}))")
        boxes = each.groupBy("level", "node").agg(F.count(F.lit(1)).alias("n"), *_box("s"))
        self.cells = materialize(boxes, "site-cells")
        fullest = {r["level"]: r["n"] for r in self.cells.groupBy("level").agg(F.max("n").alias("n")).collect()}
        self.last = next((n for n in levels if fullest[n] <= LEAF_SITES), levels[-1])

    def below(self, level: int) -> DataFrame:
        """Cells of ``level`` with their parents two levels above."""
        rows = self.cells.where(f"level = {level}")
        return self._joined(rows.selectExpr("node AS _child", f"{_parent('node', 2)} AS _parent", *_box_names("s")))

    def leaves(self) -> DataFrame:
        box = [f"_s{a} AS _s{end}{a}" for a in "xyz" for end in ("lo", "hi")]
        return self._joined(self.sites.selectExpr("_rank", "_slat", "_slon", *box, f"{_cell_name('_s', self.last)} AS _leaf"))

    def _joined(self, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if self.small else side.hint("merge")

    def all(self) -> Column:
        """All of a few sites, as one literal array."""
        rows = self.sites.orderBy("_rank").limit(FEW_SITES).collect()
        sites = []
        for r in rows:
            box = ", ".join(f"'_s{end}{a}', {r[f'_s{a}']!r}D" for a in "xyz" for end in ("lo", "hi"))
            sites.append(f"named_struct('_rank', {r['_rank']}L, '_slat', {r['_slat']!r}D, '_slon', {r['_slon']!r}D, {box})")
        return F.expr(f"inline(array({', '.join(sites)}))")

    def first(self) -> Column:
        """The cells of the top level as one literal array: 64 at most, as each axis has two or three."""
        rows = self.cells.where(f"level = {self.top}").collect()
        cells = [
            "named_struct('_sc', '{}', {})".format(r["node"], ", ".join(f"'{c}', {r[c]!r}D" for c in _box_names("s")))
            for r in sorted(rows, key=lambda r: r["node"])
        ]
        return F.expr(f"inline(array({', '.join(cells)}))")


def _descended(cells: DataFrame, level: int, sites: _Sites) -> DataFrame:
    """Candidate sites ``_pc, _rank, _slat, _slon`` of point ``cells`` (``_pc`` and its box) of ``level``.

    The point cells' ancestors go down with the site cells, two levels a step, so that a
    list is shared while it is long and the cells are few.
    """
    if sites.few:
        return _pruned(cells.select("*", sites.all()), "s", ["_rank", "_slat", "_slon"])
    at, deep = level - 2 * max(0, (level - sites.top) // 2), sites.top
    boxes = [*_box_names("p"), *_box_names("s")]
    state = _ancestors(cells, level - at).select("*", sites.first())
    state = _pruned(state, "s", ["_sc", *boxes])
    while at < level or deep < sites.last:
        if at < level:
            at += 2
            finer = _ancestors(cells, level - at).selectExpr(f"{_parent('_pc', 2)} AS _up", "*")
            state = state.withColumnRenamed("_pc", "_up").drop(*_box_names("p")).join(finer, "_up").drop("_up")
        if deep < sites.last:
            deep += 2
            state = state.drop(*_box_names("s")).join(sites.below(deep), F.col("_sc") == F.col("_parent"))
            state = state.drop("_sc").withColumnRenamed("_child", "_sc")
        state = _pruned(state, "s", ["_sc", *boxes])
        if not sites.small and (deep - sites.top) % 4 == 0:
            state = materialize(state, "nearest-cells")
    state = state.drop(*_box_names("s")).join(sites.leaves(), F.col("_sc") == F.col("_leaf"))
    return _pruned(state, "s", ["_rank", "_slat", "_slon"])


def _ancestors(cells: DataFrame, steps: int) -> DataFrame:
    """The point cells ``steps`` levels above ``cells``, with their boxes."""
    if not steps:
        return cells.select("_pc", *_box_names("p"))
    boxes = []
    for axis in "xyz":
        boxes += [F.min(f"_plo{axis}").alias(f"_plo{axis}"), F.max(f"_phi{axis}").alias(f"_phi{axis}")]
    return cells.withColumn("_pc", F.expr(_parent("_pc", steps))).groupBy("_pc").agg(*boxes)


def _refined(cells: DataFrame, lists: DataFrame, steps: int) -> DataFrame:
    """Lists of ``cells`` from those of their ancestors ``steps`` levels above, pruned level by level."""
    box = [f"_s{c}" for c in ("lat", "lon")]
    sx, sy, sz = unit_vector("_slat", "_slon")
    named = {f"_s{end}{a}": v for a, v in zip("xyz", (sx, sy, sz)) for end in ("lo", "hi")}
    state = lists
    for above in range(steps - 1, -1, -1):
        finer = _ancestors(cells, above).selectExpr(f"{_parent('_pc', 1)} AS _up", "*")
        state = state.selectExpr("_pc AS _up", "_rank", *box).join(finer, "_up").drop("_up").withColumns(named)
        state = _pruned(state, "s", ["_rank", *box])
    return state


def _keyed(points: DataFrame, level: int) -> DataFrame:
    return points.selectExpr("_id", "_lat", "_lon", *_UNIT).withColumn("_pc", F.expr(_cell_name("_p", level)))


def _point_cells(points: DataFrame, level: int) -> DataFrame:
    rows = _keyed(points, level).withColumnsRenamed({f"_p{a}": f"_{a}" for a in "xyz"})
    return rows.groupBy("_pc").agg(*_box("p"))


def _first_level(points: DataFrame, sites: _Sites) -> int:
    """Level of the first point cells: about half the sites' spacing, unless the points' area has too many such cells."""
    coarse = _point_cells(points, 6)
    spans = [F.greatest(F.col(f"_phi{a}") - F.col(f"_plo{a}"), F.lit(MIN_CELL)) for a in "xyz"]
    face = F.greatest(spans[0] * spans[1], spans[0] * spans[2], spans[1] * spans[2])
    area = coarse.agg(F.sum(face).alias("area")).first()["area"] or 0.0
    return _level_of(max(sites.spacing / 2, math.sqrt(area / (LEAST_POINT_CELLS + 16 * sites.count))))


def _grouped(lists: DataFrame, max_sites_per_cell: int) -> DataFrame:
    """Lists as one array a cell; those longer than ``max_sites_per_cell`` (at ``MAX_LEVEL``) as several.

    A table of its own: both sides of the join with the points are then plain exchanges,
    which Spark splits if a cell is hot.
    """
    place = "row_number() OVER (PARTITION BY _pc ORDER BY _rank) - 1"
    parts = lists.withColumn("_part", F.expr(f"({place}) DIV {max(1, max_sites_per_cell)}"))
    arrays = parts.groupBy("_pc", "_part").agg(F.collect_list(F.struct("_rank", "_slat", "_slon")).alias("_sites"))
    return materialize(arrays.drop("_part"), "cell-sites")


def _best_near(points: DataFrame, lists: DataFrame) -> DataFrame:
    """The best of each point and array of its cell, as ``_id`` and ``_b``, a ``(distance_km, rank)``."""
    return points.join(lists, "_pc").selectExpr("_id", f"{_NEAREST} AS _b")


def candidate_lists(
    points: DataFrame, sites: _Sites, max_sites_per_cell: int, max_broadcast_bytes: int
) -> list[tuple[DataFrame, DataFrame, int]]:
    """Rounds of (points with their cell ``_pc``, lists ``_pc, _sites``, sites on the lists).

    Every point belongs to exactly one round.
    """
    level = _first_level(points, sites)
    rounds = []
    lists, rest = None, points
    steps = 0
    while True:
        cells = materialize(_point_cells(rest, level), "point-cells")
        found = _descended(cells, level, sites) if lists is None else _refined(cells, lists, steps)
        lists = materialize(found, "site-lists")
        sizes = lists.groupBy("_pc").agg(F.count(F.lit(1)).alias("_n")).withColumn("_open", F.col("_n") > max_sites_per_cell)
        total = sizes.groupBy("_open").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("cells")).collect()
        seen = {r["_open"]: r for r in total}
        split = True in seen and level < MAX_LEVEL
        if not split:
            rounds.append((_keyed(rest, level), _grouped(lists, max_sites_per_cell), sum(r["rows"] for r in total)))
            return rounds
        wide = materialize(sizes.filter("_open").select("_pc"), "open-cells")
        fits = seen[True]["cells"] * _NAME_BYTES <= max_broadcast_bytes
        wide = F.broadcast(wide) if fits else wide.hint("merge")
        short = lists.join(wide, "_pc", "left_anti")
        if False in seen:
            rounds.append((_keyed(rest, level), _grouped(short, max_sites_per_cell), seen[False]["rows"]))
        keyed = _keyed(rest, level).join(wide, "_pc", "left_semi")
        rest = materialize(keyed.select("_id", "_lat", "_lon"), "open-points")
        lists = materialize(lists.join(wide, "_pc", "left_semi"), "open-lists")
        steps = min(FINER, MAX_LEVEL - level)
        level += steps


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    id_col: str,
    lat: str,
    lon: str,
    site_label: str,
    site_lat: str,
    site_lon: str,
    strategy: str = "default",
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    max_sites_per_cell: int = DEFAULT_MAX_SITES_PER_CELL,
) -> DataFrame:
    """Per point id: ``id_col, distance_km, <site_label>`` of its nearest site.

    ``strategy`` picks the physical join between points and the cells' lists (see
    :mod:`urbanframe.operators.joins`).  ``default`` and ``broadcast`` broadcast the
    lists only when they fit ``max_broadcast_bytes`` (from their exact row count and
    fixed row width) and sort-merge join otherwise; ``merge`` and ``shuffle_hash``
    always shuffle both sides.  A point meets at most ``max_sites_per_cell`` sites,
    unless more are equally near as far as 0.1 m can tell.
    """
    if strategy not in JOIN_STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}; choose one of {JOIN_STRATEGIES}")
    spark = points.sparkSession
    site_pos = materialize(clean_sites(sites, site_label, site_lat, site_lon), "nearest-sites")
    clean = clean_points(points, id_col, lat, lon)
    known = _Sites(site_pos, max_broadcast_bytes)
    if known.count == 0:
        return spark.createDataFrame(
            [], points.select(F.col(id_col)).schema.add("distance_km", "double").add(
                site_label, sites.schema[site_label].dataType
            )
        )
    known.build()
    nearest = None
    for keyed, lists, rows in candidate_lists(clean, known, max_sites_per_cell, max_broadcast_bytes):
        if strategy in ("default", "broadcast"):
            # Catalyst's estimate comes from compressed files
            lists = F.broadcast(lists) if rows * _LIST_BYTES <= max_broadcast_bytes else with_strategy(lists, "merge")
        else:
            lists = with_strategy(lists, strategy)
        some = _best_near(keyed, lists)
        nearest = some if nearest is None else nearest.unionByName(some)
    best = nearest.hint("rebalance", "_id").groupBy("_id").agg(F.min("_b").alias("_b"))
    out = best.select(F.col("_id").alias(id_col), F.col("_b.distance_km").alias("distance_km"), F.col("_b.rank").alias("_rank"))
    labels = site_pos.select("_rank", F.col("_label").alias(site_label))
    return out.join(labels, "_rank").drop("_rank")


_SITE_BYTES = 200  # a cell name of at most 70 characters and a box
_NAME_BYTES = 100
_LIST_BYTES = 130  # a cell name, rank, two coordinates, row header


def nearest_site_summary(nearest: DataFrame, site_label: str, digits: int = 3) -> DataFrame:
    """Per site: mean distance of the ids assigned to it and their number (``#``).

    The mean does not depend on how the ids are partitioned, not even in its last bit.
    """
    averages = reproducible_avg(nearest, site_label, "distance_km", "_avg", "#")
    return averages.select(site_label, F.round("_avg", digits).alias("average_distance"), "#").orderBy(
        F.desc("#"), F.asc(site_label)
    )
