"""Named queries: bid estimation and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimate as E
from ..operators import forecast as T
from .registry import STEPS, Tables, query

HOME = (25.1, -80.4)

STEPS["toff"] = """
select trim(lower(project)) as project, trim(lower(location)) as location, trim(lower(service)) as service,
  trim(lower(surface)) as surface, trim(lower(material)) as material, trim(lower(texture)) as texture,
  trim(lower(design)) as design, trim(lower(thickness)) as thickness, cast(difficulty as varchar) as difficulty,
  trim(lower(type)) as type, total_sf, hours
from takeoff where project is not null and not regexp_matches(lower(project), 'not|tot')"""
_THICK = "replace(thickness, '''''', '\"')"
_ALIAS = "case when material = 'gypsum_type_x' then 'gypsum' else material end"

STEPS["framing_lines"] = f"""
select distinct g.project, g.service, surface, material, g.thickness, g.design, qty as total_sqft, p.price,
  qty * p.price as total_price from (
    select project, service, surface, material, {_THICK} as thickness, coalesce(design, '20ga') as design,
      round_even(sum(total_sf), 0)::decimal(18,2) as qty
    from toff where service like '%framing%' group by project, service, surface, material, {_THICK}, toff.design) g
left join prices p on p.service = g.service and p.difficulty = g.material and p.texture = g.surface
  and p.design = g.design and p.thickness = g.thickness
where surface is not null and material is not null and g.thickness is not null"""
STEPS["drywall_lines"] = f"""
select *, round_even((price * total_sqft)::double, 0)::decimal(18,2) as total_price, materials * total_sqft as materials_cost
from (select g.project, g.service, g.difficulty, material, g.thickness, qty as total_sqft, p.price,
    case p.price when 1.88 then 1.04 when 2.01 then 1.17 when 1.30 then 0.46 when 1.34 then 0.50 when 1.22 then 0.38
      when 1.18 then 0.34 end as materials from (
    select project, service, difficulty, {_ALIAS} as material, {_THICK} as thickness,
      round_even(sum(total_sf), 0)::decimal(18,2) as qty
    from toff where service like '%drywall%' group by 1, 2, 3, 4, 5) g
  left join prices p on p.service = g.service and p.difficulty = g.difficulty and p.design = g.material
    and p.thickness = g.thickness where g.difficulty is not null and material is not null and g.thickness is not null) d"""
STEPS["insulation_lines"] = """
select project, service, thickness, total_sf, price, total_sf * price as total_price, rate as material,
  total_sf * rate as materials_cost, source_material from (
  select project, service, thickness, material as source_material, sum(total_sf)::decimal(18,2) as total_sf,
    case when material like '%batt%' then 1.20 when material like '%r%' then 1.60 end as price,
    case when material like '%batt%' then 0.72 when material like '%r%' then 0.74 end as rate
  from toff where service like '%insulat%' group by project, service, material, thickness) i"""
STEPS["plywood_lines"] = """
select g.project, g.service, g.difficulty, qty as total_sf, p.price,
  round_even((p.price * qty)::double, 0)::decimal(18,2) as total_price, 2.5 * qty as materials_cost from (
  select project, service, difficulty, round_even(sum(total_sf), 0)::decimal(18,2) as qty from toff
  where service like '%plywood%' group by 1, 2, 3) g
left join prices p on p.service = g.service and p.difficulty is not distinct from g.difficulty"""
STEPS["finish_lines"] = f"""
select g.project, g.service, g.difficulty, material, g.texture, g.design, qty as total_sf, p.price,
  round_even((p.price * qty)::double, 0)::decimal(18,2) as total_price from (
  select project, service, difficulty, {_ALIAS} as material, texture, design, round_even(sum(total_sf), 0)::decimal(18,2) as qty
  from toff where service like '%finish%' group by 1, 2, 3, 4, 5, 6) g
left join prices p on p.service = g.service and p.difficulty is not distinct from g.difficulty
  and p.texture is not distinct from g.material and p.thickness is not distinct from g.texture
  and p.design is not distinct from g.design"""
STEPS["stucco_lines"] = f"""
select g.project, g.service, g.difficulty, g.texture, g.design, g.thickness, qty as total_sqft, p.price,
  round_even(qty::double / 9, 0)::decimal(18,2) as total_yards,
  p.price * round_even(qty::double / 9, 0)::decimal(18,2) as total_price from (
  select project, service, difficulty, texture, design, {_THICK} as thickness, round_even(sum(total_sf), 0)::decimal(18,2) as qty
  from toff where service like '%stucc%' group by 1, 2, 3, 4, 5, 6) g
left join prices p on p.service = g.service and p.difficulty = g.difficulty and p.texture = g.texture
  and p.design = g.design and p.thickness = g.thickness
where g.difficulty is not null and g.texture is not null and g.design is not null and g.thickness is not null"""
STEPS["waterproofing_lines"] = """
select *, labor * 0.22 as materials, labor + labor * 0.22 as total_price from (
  select *, 50.00::decimal(18,2) as price, 50 * days * 8 as labor from (
    select project, service, qty as total_hours, ceil(qty::double / 8)::decimal(18,2) as days from (
      select project, service, round_even(sum(hours), 0)::decimal(18,2) as qty from toff
      where service like '%waterpr%' group by 1, 2) a) b) c"""


def _paint(pattern: str) -> str:
    return f"""
select *, labor * 0.20 as materials, labor + labor * 0.20 as total_price from (
  select g.project, g.service, g.difficulty, location, type, qty as total_hours,
    ceil(qty::double / 8)::decimal(18,2) as days, p.price, p.price * ceil(qty::double / 8)::decimal(18,2) * 8 as labor from (
    select project, service, difficulty, location, type, round_even(sum(hours), 0)::decimal(18,2) as qty from toff
    where service like '%{pattern}%' group by 1, 2, 3, 4, 5) g
  left join prices p on p.service = g.service and p.difficulty is not distinct from g.difficulty
    and p.texture is not distinct from g.location and p.design is not distinct from g.type) h"""


STEPS["interior_paint_lines"] = _paint("interior_p")
STEPS["exterior_paint_lines"] = _paint("exterior_p")


def _sheet(step: str, texts: dict[str, str], sums: list[str], nulls: list[str], casts: str = "") -> str:
    """A trade's lines and, per project, the total row: texts, sums and empty cells."""
    columns = [*texts, *sums, *nulls]
    lines = ", ".join(
        [*[f"{c}" for c in texts], *[f"{c}::double as {c}" for c in sums],
         *[f"cast({c} as double) as {c}" for c in nulls]]
    )
    totals = ", ".join(
        [*[f"'{v}' as {c}" for c, v in texts.items()], *[f"coalesce(sum({c}), 0)::double as {c}" for c in sums],
         *[f"cast(null as double) as {c}" for c in nulls]]
    )
    assert columns
    return f"select project, {lines} from {step} union all select project, {totals} from {step} group by project"


def _prices(t: Tables):
    return t.view("prices")


def _clean(t: Tables):
    return E.takeoff_clean(t.view("takeoff"))


@query("takeoff_clean", "select * from toff")
def takeoff_clean(t: Tables):
    return _clean(t)


@query("service_area", "select project, service, sum(total_sf) as area from toff group by 1, 2")
def service_area(t: Tables):
    return E.service_area(_clean(t))


@query(
    "estimate_framing",
    _sheet(
        "framing_lines", {"service": "Total", "surface": "-", "material": "-", "thickness": "-", "design": "-"},
        ["total_sqft", "total_price"], ["price"],
    ),
)
def estimate_framing(t: Tables):
    return E.estimate(_clean(t), _prices(t), "framing")


@query(
    "estimate_drywall",
    _sheet(
        "drywall_lines", {"service": "Total", "material": "-", "thickness": "-"},
        ["total_sqft", "total_price", "materials", "materials_cost"], ["difficulty", "price"],
    ),
)
def estimate_drywall(t: Tables):
    return E.estimate(_clean(t), _prices(t), "drywall")


@query(
    "estimate_insulation",
    _sheet(
        "insulation_lines", {"service": "Total", "thickness": "-"},
        ["total_sf", "price", "total_price", "material", "materials_cost"], [],
    ),
)
def estimate_insulation(t: Tables):
    return E.estimate(_clean(t), _prices(t), "insulation")


@query(
    "estimate_plywood",
    _sheet(
        "(select *, '2.5' as materials from plywood_lines) p", {"service": "-", "materials": "-"},
        ["total_sf", "total_price", "materials_cost"], ["difficulty", "price"],
    ),
)
def estimate_plywood(t: Tables):
    return E.estimate(_clean(t), _prices(t), "plywood")


@query(
    "estimate_finish",
    _sheet(
        "finish_lines", {"service": "-", "material": "-"}, ["total_sf", "total_price"], ["difficulty", "price"]
    ),
)
def estimate_finish(t: Tables):
    return E.estimate(_clean(t), _prices(t), "finish")


@query(
    "estimate_stucco",
    _sheet(
        "stucco_lines", {"service": "Total", "texture": "-", "design": "-", "thickness": "-"},
        ["total_sqft", "total_yards", "total_price"], ["difficulty", "price"],
    ),
)
def estimate_stucco(t: Tables):
    return E.estimate(_clean(t), _prices(t), "stucco")


_PAID = ["total_hours", "days", "labor", "materials", "total_price"]


@query("estimate_waterproofing", _sheet("waterproofing_lines", {"service": "Total"}, _PAID, ["price"]))
def estimate_waterproofing(t: Tables):
    return E.estimate(_clean(t), _prices(t), "waterproofing")


_PAINT_TEXTS = {"service": "Total", "difficulty": "-", "location": "-", "type": "-"}


@query("estimate_interior_paint", _sheet("interior_paint_lines", _PAINT_TEXTS, _PAID, ["price"]))
def estimate_interior_paint(t: Tables):
    return E.estimate(_clean(t), _prices(t), "interior_paint")


@query("estimate_exterior_paint", _sheet("exterior_paint_lines", _PAINT_TEXTS, _PAID, ["price"]))
def estimate_exterior_paint(t: Tables):
    return E.estimate(_clean(t), _prices(t), "exterior_paint")


def _long(trade: str, service: str, keys: tuple[str, ...], quantity: str, units: str = "null") -> str:
    cells = ", ".join(k if k in keys else f"null as {k}" for k in E.KEYS if k != "material")
    material = "source_material" if trade == "insulation" else "material" if "material" in keys else "null"
    return (
        f"select project, '{trade}' as trade, service, {cells}, {material} as material, {quantity} as quantity, "
        f"{units} as units, price, total_price from {trade}_lines where project in "
        f"(select project from toff where service = '{service}')"
    )


_UNITS = {"stucco": "total_yards", "waterproofing": "days", "interior_paint": "days", "exterior_paint": "days"}
_QUANTITY = {"framing": "total_sqft", "drywall": "total_sqft", "stucco": "total_sqft"}
STEPS["long_lines"] = " union all ".join(
    _long(n, s.service, s.keys, _QUANTITY.get(n, "total_sf" if s.measure == "total_sf" else "total_hours"),
          _UNITS.get(n, "null"))
    for n, s in E.TRADES.items()
)


@query(
    "estimate_all",
    """with g as (select * from long_lines where project in (select project from toff group by 1 having sum(total_sf) > 1))
    select project, trade, service, difficulty, surface, material, texture, design, thickness, location, type,
      quantity::double as quantity, units::double as units, price::double as price, total_price::double as total_price from g
    union all select project, trade, 'Total', '-', '-', '-', '-', '-', '-', '-', '-', coalesce(sum(quantity), 0)::double,
      coalesce(sum(units), 0)::double, null, coalesce(sum(total_price), 0)::double from g group by project, trade""",
)
def estimate_all(t: Tables):
    return E.estimate_all(_clean(t), _prices(t))


STEPS["flat"] = """
select trim(lower(project)) as project, trim(lower(location)) as location, trim(texture) as texture, trim(thickness) as thickness,
  cast(difficulty as varchar) as difficulty, total_sf, hours,
  case when lower(service) like '%exterior%' then 'exterior_painting' when lower(service) like '%interior%' then
    'interior_painting' else trim(lower(service)) end as service,
  case when d like '%gypsum%' then 'gypsum' when d like '%durock%' then 'durock' when d like '%green_board%' then 'durock'
    else trim(d) end as design
from (select *, case when lower(service) = 'drywall_installation' then material else design end as d from takeoff) f"""


@query(
    "flat_stucco",
    """with g as (select distinct a.*, p.price, p.price::double * a.yards as total_price from (
        select project, location, service, difficulty, design, texture, thickness, sum(total_sf)::decimal(18,2) as sqft,
          sum(total_sf)::double / 9 as yards from flat where service = 'stucco' group by 1, 2, 3, 4, 5, 6, 7) a
      left join prices p on p.service = a.service and p.difficulty is not distinct from a.difficulty
        and p.design is not distinct from a.design and p.texture is not distinct from a.texture
        and p.thickness is not distinct from a.thickness)
    select project, location, service, difficulty, design, texture, thickness, sqft::double as sqft, round(yards, 6) as yards,
      price::double as price, round(total_price, 6) as total_price from g union all select 'Total', '-', '-', '-', '-', '-', '-',
      sum(sqft)::double, round(sum(yards), 6), null, round(coalesce(sum(total_price), 0), 6) from g""",
)
def flat_stucco(t: Tables):
    return E.flat_stucco(E.flat_takeoff(t.view("takeoff")), _prices(t))


@query(
    "flat_drywall",
    """with g as (select a.*, p.price, p.price * a.sqft as total_price from (
        select project, location, service, difficulty, design, thickness, sum(total_sf)::decimal(18,2) as sqft
        from flat where service = 'drywall_installation' group by 1, 2, 3, 4, 5, 6) a
      left join prices p on p.service = a.service and p.difficulty is not distinct from a.difficulty
        and p.design is not distinct from a.design and p.thickness is not distinct from a.thickness)
    select project, location, service, difficulty, design as material, thickness, sqft::double as sqft, price::double as price,
      total_price::double as total_price from g union all select 'Total', '-', '-', '-', '-', '-', sum(sqft)::double, null,
      coalesce(sum(total_price), 0)::double from g""",
)
def flat_drywall(t: Tables):
    return E.flat_drywall(E.flat_takeoff(t.view("takeoff")), _prices(t))


@query(
    "flat_finish",
    """with g as (select a.*, p.price, p.price * a.sqft as total_price from (
        select project, location, service, difficulty, design, sum(total_sf)::decimal(18,2) as sqft
        from flat where service = 'finish' group by 1, 2, 3, 4, 5) a
      left join (select * from prices where price is not null) p
        on p.service = a.service and p.difficulty is not distinct from a.difficulty and p.design is not distinct from a.design)
    select project, location, service, difficulty, design as material, sqft::double as sqft, price::double as price,
      total_price::double as total_price from g union all select 'Total', '-', '-', '-', '-', sum(sqft)::double, null,
      coalesce(sum(total_price), 0)::double from g""",
)
def flat_finish(t: Tables):
    # a line meets every price of its difficulty and design, whatever the texture and thickness
    return E.flat_finish(E.flat_takeoff(t.view("takeoff")), _prices(t))


@query(
    "flat_paint",
    """with g as (select project, location, service, difficulty, hours, days, price, days * 8 * price as labor,
        days * 8 * price * 0.20 as materials, days * 8 * price * 1.20 as total_price from (
        select a.project, a.location, a.service, a.difficulty, hours, p.price,
          (d + case when d between 0 and 30 then 1 when d between 31 and 60 then 2 when d >= 60 then 3 else 0 end)::decimal(18,2) as days
        from (select project, location, service, difficulty, sum(hours)::decimal(18,2) as hours,
            round_even(sum(hours) / 8, 0) as d from flat where service like '%paint%' group by 1, 2, 3, 4) a
        left join prices p on p.service || 'ing' = a.service and p.difficulty is not distinct from a.difficulty
          and p.texture is not distinct from a.location) b)
    select project, location, service, difficulty, hours::double as hours, days::double as days, price::double as price,
      labor::double as labor, materials::double as materials, total_price::double as total_price from g
    union all select 'Total', '-', '-', '-', sum(hours)::double, sum(days)::double, sum(price)::double, sum(labor)::double,
      sum(materials)::double, sum(total_price)::double from g""",
)
def flat_paint(t: Tables):
    # the earlier workflow calls the painting services "... painting"
    prices = _prices(t).withColumn("service", F.concat("service", F.lit("ing")))
    return E.flat_paint(E.flat_takeoff(t.view("takeoff")), prices)


@query(
    "stucco_budget",
    """with g as (select case when level = '1' then 'First Level' else 'Second Level' end as floor_level, material_surface,
        sf::double as square_feet, round_even(sf / 9, 0) as yards,
        round_even(sf / 9, 0) * case when material_surface = '5/8_texture_stucco' then case level when '1' then 38 when '2' then 39 end
          when material_surface = '5/8_texture_stucco_wire_lath' then case level when '1' then 41 when '2' then 42 end end as price
      from (select trim(substr(level, 6, 3)) as level, lower(material_surface) as material_surface, sum(total_sf) as sf
        from takeoff_upload where lower(service) = 'stucco' group by 1, 2) s)
    select floor_level, material_surface, square_feet, yards, '$' || format('{:,}', price::bigint) as price from g
    union all select 'Total', '-', sum(square_feet), sum(yards), '$' || format('{:,}', sum(price)::bigint) from g""",
)
def stucco_budget(t: Tables):
    upload = t.view("takeoff_upload").withColumnsRenamed({"level": "Level", "total_sf": "Total.SF"})
    return E.stucco_budget(upload)


@query(
    "price_lookup",
    """select service, difficulty, texture, design, thickness, price::double as price from prices
    where service = 'stucco' and texture = 'medium' and design = '20ga' and difficulty = '2'
      and regexp_matches(thickness, '[57]')""",
)
def price_lookup(t: Tables):
    return E.price_lookup(_prices(t), "stucco", "medium", "20ga", "2", "[57]")


@query(
    "price_list_extend",
    """select service, difficulty, texture, design, thickness, price::double as price from (select * from prices union all
      select service, difficulty, texture, design, '7/8"' as thickness, price from prices
      where service = 'stucco' and thickness like '%5%') p where difficulty <> '2'""",
)
def price_list_extend(t: Tables):
    return E.price_list_extend(_prices(t), "5", '7/8"', "2")


@query(
    "bid_rows",
    """select lower(proposal) as proposal, lower(trade) as trade, lower(material) as material, lower(unit) as unit,
      price::double as price from bid_sheet where lower(material) <> 'grand_total' and unit is not null""",
)
def bid_rows(t: Tables):
    return E.bid_rows(t.view("bid_sheet"))


@query(
    "site_distance",
    f"""select site, round(6371 * c, 6) as km, round(3959 * c, 6) as miles from (
      select site, 2 * atan2(sqrt(a), sqrt(1 - a)) as c from (
        select site, power(sin(radians({HOME[0]}::double - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HOME[0]}::double))
          * power(sin(radians({HOME[1]}::double - long) / 2), 2) as a from sites) s) d""",
)
def site_distance(t: Tables):
    here = (F.col("lat"), F.col("long"), F.lit(HOME[0]), F.lit(HOME[1]))
    return t.view("sites").select(
        "site",
        E.site_distance(*here, unit="km").alias("km"),
        E.site_distance(*here, unit="miles").alias("miles"),
    )


# -- forecasting -----------------------------------------------------------------------

STEPS["cut"] = "select cast(max(date) - interval 3 month as date) as day from daily_series"


@query(
    "ts_split",
    "select date, value, case when date > (select day from cut) then 'test' else 'train' end as part from daily_series",
)
def ts_split(t: Tables):
    return T.ts_split(t.view("daily_series"))


@query(
    "ts_features",
    """select date, value, strftime(date, '%a') as weekday, strftime(date, '%b') as month,
      (date - date '1970-01-01')::int as day_number from daily_series""",
)
def ts_features(t: Tables):
    return T.ts_features(t.view("daily_series"))


_P, _SWEEPS = 18, 150
_CODED = ", ".join(
    f"({list(column)})[{place}]"
    for place, levels in (("(dayofweek(date) + 1)", 7), ("month(date)", 12))
    for column in zip(*T.polynomial_contrasts(levels))
)
_DESIGN = f"[{_CODED}, (date - date '{T.ORIGIN}')::double]::double[]"


def _glm_steps(name: str, rows: str) -> None:
    """The model by the same objective, its coordinate descent as a recursive query on the Gram matrix."""
    STEPS[f"{name}_rows"] = f"select row_number() over () as id, value::double as y, {_DESIGN} as v from {rows}"
    STEPS[f"{name}_cells"] = f"select id, y, generate_subscripts(v, 1) as i, unnest(v) as x from {name}_rows"
    STEPS[f"{name}_scale"] = f"""
      select i, avg(x) as mx, stddev_pop(x) as sx, covar_pop(x, y) / stddev_pop(x) as c from {name}_cells group by i"""
    STEPS[f"{name}_gram"] = f"""
      select a.i, b.i as j, covar_pop(a.x, b.x) / any_value(s.sx * t.sx) as r from {name}_cells a join {name}_cells b using (id)
      join {name}_scale s on s.i = a.i join {name}_scale t on t.i = b.i group by a.i, b.i"""
    STEPS[f"{name}_descent"] = f"""
      select 0 as step, list_resize([]::double[], {_P}, 0.0) as beta, (select list(c order by i) from {name}_scale) as c,
        (select list(gram_row order by i) from (select i, list(r order by j) as gram_row from {name}_gram group by i)) as g
      union all select step + 1, list_concat(list_concat(beta[1:step % {_P}], [sign(z) * greatest(abs(z) - {T.PENALTY}, 0)]),
        beta[step % {_P} + 2:]), c, g from (select *, c[step % {_P} + 1] - list_inner_product(g[step % {_P} + 1], beta)
          + beta[step % {_P} + 1] as z from {name}_descent where step < {_P * _SWEEPS})"""
    STEPS[f"{name}_terms"] = f"""
      select i, mx, beta[i] / sx as b, d.c[i] - list_inner_product(g[i], beta) as slack
      from (select * from {name}_descent order by step desc limit 1) d cross join {name}_scale s"""
    STEPS[f"{name}_model"] = f"""
      select list(b order by i) as b, (select avg(y) from {name}_rows) - sum(b * mx) as b0 from {name}_terms"""


_glm_steps("glm_train", "(select * from daily_series where date <= (select day from cut)) d")
_glm_steps("glm_all", "daily_series")


@query(
    "ts_glm",
    f"""select date, value, round(b0 + list_inner_product({_DESIGN}, b), 6) as predicted from daily_series
    cross join glm_train_model where date > (select day from cut)""",
)
def ts_glm(t: Tables):
    return T.ts_glm(t.view("daily_series"))


_TERMS = [
    "(intercept)", *[f"weekday_{i}" for i in range(1, 7)], *[f"month_{i}" for i in range(1, 12)], "day_number"
]


@query(
    "ts_glm_terms",
    f"""select ({_TERMS})[i + 1] as term, round(coefficient, 6) + 0.0 as coefficient, round(gradient, 6) as gradient,
      {T.PENALTY} as bound from (select i, b as coefficient, slack as gradient from glm_train_terms
        union all select 0, b0, null from glm_train_model) m""",
)
def ts_glm_terms(t: Tables):
    return T.ts_glm_terms(t.view("daily_series"))


@query(
    "ts_future",
    f"""select date, round(b0 + list_inner_product({_DESIGN}, b), 6) as predicted from (
      select unnest(generate_series(last + interval 1 day, last + interval 3 month, interval 1 day))::date as date
      from (select max(date) as last from daily_series) m) f cross join glm_all_model""",
)
def ts_future(t: Tables):
    return T.ts_future(t.view("daily_series"))


@query(
    "ts_accuracy",
    """with p as (select s.date, s.value::double as a, b.value::double as e, lag(s.value::double) over (order by s.date) as l
      from daily_series s join daily_series b on b.date + 7 = s.date where s.date > (select day from cut))
    select round(avg(abs(a - e)), 6) as mae, round(100 * avg(abs(a - e) / nullif(abs(a), 0)), 6) as mape,
      round(avg(abs(a - e)) / nullif(avg(abs(a - l)), 0), 6) as mase,
      round(100 * avg(2 * abs(a - e) / nullif(abs(a) + abs(e), 0)), 6) as smape,
      round(sqrt(avg((a - e) * (a - e))), 6) as rmse, round(power(corr(a, e), 2), 6) as rsq from p""",
)
def ts_accuracy(t: Tables):
    split = T.ts_split(t.view("daily_series"))
    test = T.seasonal_naive(split).where("part = 'test'")
    return T.ts_accuracy(test.drop("part"))
