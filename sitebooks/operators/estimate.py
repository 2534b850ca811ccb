"""Bid estimation: take-off rows priced per trade.

All trades go through one plan: each take-off row is keyed once per trade it
belongs to, one aggregation sums area and hours per key, one join brings the price.
What differs between trades (keys, price positions, rounding, formulas) is in the
``TRADES`` table, so a trade on its own and all trades together are the same job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import append_total, clean_names, if_known, joined, map_columns, matches, total_or_null
from .ledger import first_hit

KEYS = ("difficulty", "surface", "material", "texture", "design", "thickness", "location", "type")
# wide enough that no measured fraction is cut before it is summed
QUANTITY = "decimal(24,10)"

# Rows that are no take-off lines, and the design framing assumes.
NO_LINE = "not|tot"
DEFAULT_DESIGN = "20ga"
# Drywall price -> material cost per square foot.
DRYWALL_MATERIALS = {
    "1.88": "1.04",
    "2.01": "1.17",
    "1.30": "0.46",
    "1.34": "0.50",
    "1.22": "0.38",
    "1.18": "0.34",
}
# Insulation material pattern -> (price, material cost), the first hit counts.
INSULATION = (("batt", "1.2", "0.72"), ("r", "1.6", "0.74"))
# Plywood material cost, square feet per yard, hours per day, waterproofing rate.
PLYWOOD_MATERIALS = "2.5"
FEET_PER_YARD, HOURS_PER_DAY, WATERPROOFING_RATE = 9, 8, 50
# Share of labor that materials cost.
WATERPROOFING_SHARE, PAINT_SHARE = "0.22", "0.20"


@dataclass(frozen=True)
class Trade:
    """How one trade groups and prices take-off rows.

    ``price`` names, for each grouping key, the price-list column it is matched to;
    empty when the trade has a fixed rate.
    """

    service: str
    pattern: str
    keys: tuple[str, ...]
    price: Mapping[str, str] = field(default_factory=dict)
    measure: str = "total_sf"
    rounded: bool = True
    complete: bool = False  # rows with an unknown key or quantity are left out
    label: str = "service"  # the column that says "Total"


TRADES = {
    "framing": Trade(
        "framing", "framing", ("surface", "material", "thickness", "design"),
        {"material": "difficulty", "surface": "texture", "design": "design", "thickness": "thickness"},
        complete=True,
    ),
    "drywall": Trade(
        "drywall_installation", "drywall", ("difficulty", "material", "thickness"),
        {"difficulty": "difficulty", "material": "design", "thickness": "thickness"},
        complete=True,
    ),
    "insulation": Trade("insulation", "insulat", ("material", "thickness"), rounded=False),
    "plywood": Trade(
        "plywood_installation", "plywood", ("difficulty",), {"difficulty": "difficulty"}, label="difficulty"
    ),
    "finish": Trade(
        "finish", "finish", ("difficulty", "material", "texture", "design"),
        {"difficulty": "difficulty", "material": "texture", "texture": "thickness", "design": "design"},
        label="difficulty",
    ),
    "stucco": Trade(
        "stucco", "stucc", ("difficulty", "texture", "design", "thickness"),
        {"difficulty": "difficulty", "texture": "texture", "design": "design", "thickness": "thickness"},
        complete=True,
    ),
    "waterproofing": Trade("waterproofing", "waterpr", (), measure="hours"),
    "interior_paint": Trade(
        "interior_paint", "interior_p", ("difficulty", "location", "type"),
        {"difficulty": "difficulty", "location": "texture", "type": "design"}, measure="hours",
    ),
    "exterior_paint": Trade(
        "exterior_paint", "exterior_p", ("difficulty", "location", "type"),
        {"difficulty": "difficulty", "location": "texture", "type": "design"}, measure="hours",
    ),
}
_PAINT = ("interior_paint", "exterior_paint")


# -- take-off ------------------------------------------------------------------------


def takeoff_clean(takeoff: DataFrame) -> DataFrame:
    """Lower-case trimmed take-off lines, totals and notes removed, difficulty as text."""
    lower = map_columns(takeoff, F.lower)
    lines = lower.where(F.col("project").isNotNull() & ~matches("project", NO_LINE))
    return map_columns(lines, F.trim).withColumn("difficulty", F.col("difficulty").cast("string"))


def service_area(clean: DataFrame) -> DataFrame:
    """Area per service of each project."""
    return clean.groupBy("project", "service").agg(
        total_or_null(F.col("total_sf").cast(QUANTITY)).alias("area")
    )


def _tagged(rows: DataFrame, trades: Sequence[str]) -> DataFrame:
    """Each row once per trade its service belongs to."""
    hits = [F.when(F.col("service").rlike(TRADES[name].pattern), F.lit(name)) for name in trades]
    return rows.withColumn("trade", F.explode(F.array_compact(F.array(*hits))))


def _key(column: str, trades: Sequence[str], value: Column) -> Column:
    """A key column, null for the trades that do not group by it."""
    users = [name for name in trades if column in TRADES[name].keys]
    return F.when(F.col("trade").isin(users), value) if users else F.lit(None).cast("string")


def _takeoff_keys(trades: Sequence[str]) -> list[Column]:
    trade, material, thickness = F.col("trade"), F.col("material"), F.col("thickness")
    written = {
        "material": F.when(trade.isin("drywall", "finish") & (material == "gypsum_type_x"), "gypsum").otherwise(
            material
        ),
        "thickness": F.when(trade == "insulation", thickness).otherwise(
            F.replace(thickness, F.lit("''"), F.lit('"'))
        ),
    }
    return [_key(k, trades, written.get(k, F.col(k))).alias(k) for k in KEYS]


def trade_quantities(clean: DataFrame, trades: Sequence[str]) -> DataFrame:
    """Summed area or hours per project, trade, service and key."""
    by_hours = [name for name in trades if TRADES[name].measure == "hours"]
    measure = F.when(F.col("trade").isin(by_hours), F.col("hours")).otherwise(F.col("total_sf"))
    sums = (
        _tagged(clean, trades)
        .select("project", "trade", "service", *_takeoff_keys(trades), measure.cast(QUANTITY).alias("measure"))
        .groupBy("project", "trade", "service", *KEYS)
        .agg(total_or_null("measure").alias("measure"))
    )
    as_is = F.col("trade").isin([n for n in trades if not TRADES[n].rounded])
    quantity = F.when(as_is, F.col("measure")).otherwise(F.bround("measure", 0)).cast(QUANTITY)
    sums = sums.withColumns(
        {
            "quantity": quantity,
            # framing assumes its design only after grouping, so two groups may become alike
            "design": F.when(F.col("trade") == "framing", F.coalesce("design", F.lit(DEFAULT_DESIGN))).otherwise(
                F.col("design")
            ),
        }
    ).drop("measure")
    sums = sums.where(_complete(trades))
    # keys are unique but for framing, where lines that became alike count once
    return sums.distinct() if "framing" in trades else sums


def _complete(trades: Sequence[str]) -> Column:
    keep = F.lit(True)
    for name in trades:
        trade = TRADES[name]
        if trade.complete:
            missing = F.col("service").isNull() | F.col("quantity").isNull()
            for key in trade.keys:
                missing = missing | F.col(key).isNull()
            keep = keep & ~((F.col("trade") == name) & missing)
    return keep


def trade_prices(prices: DataFrame, trades: Sequence[str]) -> DataFrame:
    """The price list under the key names of the take-off, per trade that looks it up."""
    looked_up = [name for name in trades if TRADES[name].price]
    columns = []
    for key in KEYS:
        cell = F.lit(None).cast("string")
        for name in looked_up:
            position = TRADES[name].price.get(key)
            if position is not None:
                cell = F.when(F.col("trade") == name, F.col(position)).otherwise(cell)
        columns.append(cell.alias(key))
    if not looked_up:
        nothing = prices.where(F.lit(False)).withColumn("trade", F.lit(None).cast("string"))
        return nothing.select("trade", "service", *columns, "price")
    listed = _tagged(prices, looked_up).select("trade", "service", *columns, "price")
    if "framing" not in looked_up:
        return listed
    framing = F.col("trade") == "framing"
    return listed.where(framing).distinct().unionByName(listed.where(~framing))


def _by_trade(cases: Mapping[str, Column]) -> Column:
    chosen = F.when(F.lit(False), F.lit(None))
    for name, value in cases.items():
        chosen = chosen.when(F.col("trade") == name, value)
    return chosen


def _rate(text: str) -> Column:
    return F.lit(text).cast("decimal(6,2)")


def priced_lines(clean: DataFrame, prices: DataFrame, trades: Sequence[str] = tuple(TRADES)) -> DataFrame:
    """One line per project, trade and key with units, price, labor, materials and total."""
    lines = joined(
        trade_quantities(clean, trades), trade_prices(prices, trades), ["trade", "service", *KEYS]
    )
    money = "decimal(30,4)"
    quantity, price, labor = F.col("quantity"), F.col("price"), F.col("labor")
    days = F.ceil(quantity / HOURS_PER_DAY)
    insulation_price = first_hit(F.col("material"), [(p, rate) for p, rate, _ in INSULATION])
    insulation_cost = first_hit(F.col("material"), [(p, rate) for p, _, rate in INSULATION])
    drywall_cost = F.when(F.lit(False), F.lit(None).cast("decimal(6,2)"))
    for at, cost in DRYWALL_MATERIALS.items():
        drywall_cost = drywall_cost.when(price == _rate(at), _rate(cost))
    lines = lines.withColumns(
        {
            "price": _by_trade(
                {"insulation": insulation_price.cast("decimal(18,2)"),
                 "waterproofing": F.lit(WATERPROOFING_RATE).cast("decimal(18,2)")}
            ),
            "listed": F.col("price"),
            "units": _by_trade(
                {"stucco": F.bround(quantity / FEET_PER_YARD, 0)} | {t: days for t in ("waterproofing", *_PAINT)}
            ).cast(QUANTITY),
        }
    )
    lines = lines.withColumn("price", F.coalesce("price", "listed").cast("decimal(18,2)")).drop("listed")
    lines = lines.withColumn(
        "labor", _by_trade({t: price * F.col("units") * HOURS_PER_DAY for t in ("waterproofing", *_PAINT)}).cast(money)
    )
    lines = lines.withColumns(
        {
            "materials": _by_trade(
                {
                    "drywall": drywall_cost,
                    "insulation": insulation_cost.cast("decimal(6,2)"),
                    "plywood": _rate(PLYWOOD_MATERIALS),
                    "waterproofing": labor * _rate(WATERPROOFING_SHARE),
                }
                | {t: labor * _rate(PAINT_SHARE) for t in _PAINT}
            ).cast(money),
        }
    )
    worth = price * quantity
    lines = lines.withColumns(
        {
            "materials_cost": _by_trade(
                {t: F.col("materials") * quantity for t in ("drywall", "insulation", "plywood")}
            ).cast(money),
            "total_price": _by_trade(
                {"framing": worth, "insulation": worth, "stucco": price * F.col("units")}
                | {t: F.bround(worth, 0) for t in ("drywall", "plywood", "finish")}
                | {t: labor + F.col("materials") for t in ("waterproofing", *_PAINT)}
            ).cast(money),
        }
    )
    return lines


def _report(lines: DataFrame, trade: Trade, columns: Mapping[str, str], unpriced: bool = True) -> DataFrame:
    """Columns of one trade's sheet and its total row per project."""
    rows = lines.select("project", *[F.col(c).alias(new) for c, new in columns.items()])
    # a price is no sum: as a text it stays out of the total row
    if unpriced and "price" in columns:
        rows = rows.withColumn("price", F.col("price").cast("string"))
    out = append_total(rows, trade.label, by=["project"])
    if unpriced and "price" in columns:
        out = out.withColumn("price", F.col("price").try_cast("decimal(18,2)"))
    return out


def _numeric_difficulty(df: DataFrame) -> DataFrame:
    return df.withColumn("difficulty", F.col("difficulty").try_cast("double"))


def estimate(clean: DataFrame, prices: DataFrame, trade: str) -> DataFrame:
    """The priced sheet of one trade for every project of the take-off, total rows included."""
    spec = TRADES[trade]
    lines = priced_lines(clean, prices, [trade])
    keys = {k: k for k in ("service", *spec.keys)}
    area, hours = {"quantity": "total_sqft"}, {"quantity": "total_hours", "units": "days"}
    paid = {"price": "price", "labor": "labor", "materials": "materials", "total_price": "total_price"}
    if trade == "framing":
        return _report(lines, spec, keys | area | {"price": "price", "total_price": "total_price"})
    if trade == "drywall":
        columns = keys | area | {c: c for c in ("price", "total_price", "materials", "materials_cost")}
        return _numeric_difficulty(_report(lines, spec, columns))
    if trade == "insulation":
        columns = {"service": "service", "thickness": "thickness", "quantity": "total_sf", "price": "price",
                   "total_price": "total_price", "materials": "material", "materials_cost": "materials_cost"}
        return _report(lines, spec, columns, unpriced=False)
    if trade == "plywood":
        columns = keys | {"quantity": "total_sf"} | {c: c for c in ("price", "materials", "total_price", "materials_cost")}
        rate = lines.withColumn("materials", F.col("materials").cast("double").cast("string"))
        return _numeric_difficulty(_report(rate, spec, columns))
    if trade == "finish":
        columns = {"service": "service", "difficulty": "difficulty", "material": "material",
                   "quantity": "total_sf", "price": "price", "total_price": "total_price"}
        return _numeric_difficulty(_report(lines, spec, columns))
    if trade == "stucco":
        columns = keys | area | {"price": "price", "units": "total_yards", "total_price": "total_price"}
        return _numeric_difficulty(_report(lines, spec, columns))
    return _report(lines, spec, keys | hours | paid)


def priced_projects(clean: DataFrame) -> DataFrame:
    """Trades each project can be estimated for: its exact service occurs and there is area at all."""
    flags = [F.max(F.col("service") == t.service).alias(name) for name, t in TRADES.items()]
    seen = clean.groupBy("project").agg(
        total_or_null(F.col("total_sf").cast(QUANTITY)).alias("area"), *flags
    )
    offered = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in TRADES]))
    return seen.where("area > 1").select("project", F.explode(offered).alias("trade"))


def estimate_all(clean: DataFrame, prices: DataFrame) -> DataFrame:
    """All trades of all projects as one long table, a total row per project and trade.

    A trade without lines has no total row either, so it is simply absent.
    """
    columns = ["project", "trade", "service", *KEYS, "quantity", "units", "price", "total_price"]
    lines = joined(priced_lines(clean, prices), priced_projects(clean), ["project", "trade"], "left_semi")
    rows = lines.select(*columns).withColumn("price", F.col("price").cast("string"))
    full = append_total(rows, "service", by=["project", "trade"])
    return full.withColumn("price", F.col("price").try_cast("decimal(18,2)"))


# -- flat estimates of the earlier workflow ---------------------------------------------


def flat_takeoff(takeoff: DataFrame) -> DataFrame:
    """Take-off with the earlier service families and drywall designs."""
    service = F.lower("service")
    design = F.when(service == "drywall_installation", F.col("material")).otherwise(F.col("design"))
    named = takeoff.withColumns(
        {
            "project": F.lower("project"),
            "location": F.lower("location"),
            "difficulty": F.col("difficulty").cast("string"),
            "design": first_hit(
                design, (("gypsum", "gypsum"), ("durock", "durock"), ("green_board", "durock")), design
            ),
            "service": first_hit(
                service, (("exterior", "exterior_painting"), ("interior", "interior_painting")), service
            ),
        }
    )
    return map_columns(named, F.trim)


def _flat(
    flat: DataFrame, prices: DataFrame, service: str, keys: Sequence[str], on: Sequence[str], yards: bool
) -> DataFrame:
    sums = (
        flat.where(F.col("service") == service)
        .groupBy("project", "location", "service", *keys)
        .agg(total_or_null(F.col("total_sf").cast(QUANTITY)).alias("sqft"))
    )
    measure = F.col("sqft")
    if yards:
        measure = F.col("yards")
        sums = sums.withColumn("yards", F.col("sqft") / FEET_PER_YARD)
    listed = prices.where(F.col("price").isNotNull()).select("service", *on, "price")
    lines = joined(sums, listed, ["service", *on]).withColumn("total_price", F.col("price") * measure)
    rows = lines.distinct() if yards else lines
    out = append_total(rows.withColumn("price", F.col("price").cast("string")), "project")
    return out.withColumn("price", F.col("price").try_cast("decimal(18,2)"))


def flat_stucco(flat: DataFrame, prices: DataFrame) -> DataFrame:
    keys = ["difficulty", "design", "texture", "thickness"]
    return _flat(flat, prices, "stucco", keys, keys, yards=True)


def flat_drywall(flat: DataFrame, prices: DataFrame) -> DataFrame:
    keys = ["difficulty", "design", "thickness"]
    out = _flat(flat, prices, "drywall_installation", keys, keys, yards=False)
    return out.withColumnRenamed("design", "material")


def flat_finish(flat: DataFrame, prices: DataFrame) -> DataFrame:
    keys = ["difficulty", "design"]
    return _flat(flat, prices, "finish", keys, keys, yards=False).withColumnRenamed("design", "material")


def flat_paint(flat: DataFrame, prices: DataFrame) -> DataFrame:
    """Painting days with one to three spare days, labor and materials."""
    sums = (
        flat.where(matches("service", "paint"))
        .groupBy("project", "location", "service", "difficulty")
        .agg(total_or_null(F.col("hours").cast(QUANTITY)).alias("hours"))
        .withColumn("days", F.bround(F.col("hours") / HOURS_PER_DAY, 0).cast(QUANTITY))
    )
    days = F.col("days")
    spare = F.when(days.between(0, 30), 1).when(days.between(31, 60), 2).when(days >= 60, 3).otherwise(0)
    planned = sums.withColumn("days", days + spare)
    listed = prices.where(F.col("price").isNotNull()).select("service", "difficulty", "texture", "price")
    lines = joined(planned, listed, ["service", "difficulty", ("location", "texture")])
    labor = (days * HOURS_PER_DAY * F.col("price")).cast("decimal(28,2)")
    priced = lines.withColumn("labor", labor).withColumn("materials", F.col("labor") * _rate(PAINT_SHARE))
    return append_total(priced.withColumn("total_price", F.col("labor") + F.col("materials")), "project")


# -- stucco upload form --------------------------------------------------------------------

# Services of the upload form, and yard prices by surface and level.
UPLOAD_SERVICES = {
    "stucco": "stucco",
    "framing": "framing",
    "stucco adittion": "stucco_adittion",
    "exterior paint": "exterior_paint",
    "interior paint": "interior_paint",
    "drywall & finish": "drywall_finish",
}
YARD_PRICES = {
    ("5/8_texture_stucco", "1"): 38,
    ("5/8_texture_stucco", "2"): 39,
    ("5/8_texture_stucco_wire_lath", "1"): 41,
    ("5/8_texture_stucco_wire_lath", "2"): 42,
}


def stucco_budget(upload: DataFrame) -> DataFrame:
    """Stucco area, yards and price per level and surface of an uploaded take-off."""
    form = clean_names(upload)
    form = map_columns(form.withColumn("level", F.trim(F.substring("level", 6, 3))), F.lower)
    service = F.when(F.lit(False), F.lit(None).cast("string"))
    for text, name in UPLOAD_SERVICES.items():
        service = service.when(F.col("service") == text, name)
    sums = (
        form.where(service == "stucco")
        .groupBy("level", "material_surface")
        .agg(total_or_null(F.col("total_sf").cast(QUANTITY)).alias("square_feet"))
    )
    yard_price = F.when(F.lit(False), F.lit(None).cast("int"))
    for (surface, level), price in YARD_PRICES.items():
        yard_price = yard_price.when((F.col("material_surface") == surface) & (F.col("level") == level), price)
    yards = F.bround(F.col("square_feet") / FEET_PER_YARD, 0).cast("decimal(18,0)")
    budget = sums.select(
        if_known(F.col("level") == "1", F.lit("First Level"), F.lit("Second Level")).alias("floor_level"),
        "material_surface",
        "square_feet",
        yards.alias("yards"),
        (yards * yard_price).alias("price"),
    )
    return append_total(budget, "floor_level").withColumn(
        "price", F.concat(F.lit("$"), F.format_number("price", 0))
    )


# -- price list and bid sheets ---------------------------------------------------------------


def price_lookup(
    prices: DataFrame, service: str, texture: str, design: str, difficulty: str, thickness: str
) -> DataFrame:
    """Price rows by exact service, texture, design and difficulty and a thickness pattern."""
    return prices.where(
        (F.col("service") == service)
        & (F.col("texture") == texture)
        & (F.col("design") == design)
        & (F.col("difficulty") == difficulty)
        & matches("thickness", thickness)
    )


def price_list_extend(prices: DataFrame, pattern: str, thickness: str, without_difficulty: str) -> DataFrame:
    """Copy stucco prices of one thickness to another and leave one difficulty out."""
    copied = prices.where((F.col("service") == "stucco") & matches("thickness", pattern))
    both = prices.unionByName(copied.withColumn("thickness", F.lit(thickness)))
    return both.where(F.col("difficulty") != without_difficulty)


def bid_rows(sheet: DataFrame) -> DataFrame:
    """Complete bid lines in lower case without the grand total."""
    lower = map_columns(sheet, F.lower, T.StringType)
    return lower.where(F.col("material") != "grand_total").na.drop("any")


def site_distance(lat1: Column, long1: Column, lat2: Column, long2: Column, unit: str = "km") -> Column:
    """Great-circle distance between two coordinates in degrees."""
    radius = {"km": 6371, "miles": 3959}[unit]
    half_lat = F.radians(lat2 - lat1) / 2
    half_long = F.radians(long2 - long1) / 2
    chord = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_long), 2.0
    )
    return 2 * F.atan2(F.sqrt(chord), F.sqrt(1 - chord)) * radius
