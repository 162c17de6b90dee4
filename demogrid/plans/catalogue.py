"""The published variables, measures, preset questions and golden totals, as data."""

from __future__ import annotations

from ..model import Between, In, Preset, Question, Registry, Threshold, Variable, Variant

# Ids, tables, types, roles, decimals, filter ranges and categories shown last. Labels are our own.
VARIABLES = (
    Variable("pop_total", "core", "int", ("filter", "profile"), group="people", label="All residents", unit="people"),
    Variable("pop_f", "core", "int", ("profile",), group="people", label="Women", unit="people"),
    Variable("pop_m", "core", "int", ("profile",), group="people", label="Men", unit="people"),
    Variable("pop_0_14", "core", "int", ("profile",), group="people", label="Children under 15", unit="people"),
    Variable("pop_15_64", "core", "int", ("profile",), group="people", label="Aged 15 to 64", unit="people"),
    Variable("pop_65p", "core", "int", ("profile",), group="people", label="Aged 65 and over", unit="people"),
    Variable("pop_ocupata", "core", "int", ("profile",), group="people", label="In work", unit="people"),
    Variable("pop_cet_ro", "core", "int", ("profile",), group="people", label="Citizens of the country", unit="people"),
    Variable("pop_mutati_in_tara", "core", "int", ("profile",), group="people", label="Moved within the country", unit="people"),
    Variable("pop_mutati_strainatate", "core", "int", ("profile",), group="people", label="Moved from abroad", unit="people"),
    Variable("pop_2011", "core", "float", ("profile",), decimals=0, group="people", label="Residents at the 2011 census", unit="people"),
    Variable("pop_2006", "core", "float", ("profile",), decimals=0, group="people", label="Residents in 2006", unit="people"),
    Variable("mediu", "env", "cat", ("filter", "profile"), group="place", label="Urban or rural unit"),
    Variable("intravilan", "env", "cat", ("filter", "profile"), group="place", label="Kind of built-up area"),
    Variable("uat_status", "env", "cat", ("filter", "profile"), group="place", label="Status of the municipality"),
    Variable("uat_name", "env", "cat", ("profile",), group="place", label="Municipality"),
    Variable("county_mn", "env", "cat", ("filter", "profile"), group="place", label="County"),
    Variable("region_name", "env", "cat", ("filter", "profile"), group="place", label="Region"),
    Variable("alt_mean", "env", "float", ("filter", "profile"), decimals=0, filter_range=(0, 2544), group="relief", label="Mean altitude", unit="m"),
    Variable("alt_min", "env", "float", ("profile",), decimals=0, group="relief", label="Lowest point", unit="m"),
    Variable("alt_max", "env", "float", ("profile",), decimals=0, group="relief", label="Highest point", unit="m"),
    Variable("alt_std", "env", "float", ("profile",), decimals=1, group="relief", label="Spread of altitudes", unit="m"),
    Variable("slope_mean", "env", "float", ("filter", "profile"), decimals=1, group="relief", label="Mean slope", unit="degrees"),
    Variable("landform_type", "env", "cat", ("filter", "profile"), group="relief", label="Landform"),
    Variable("landform_lvl0", "env", "cat", ("filter", "profile"), group="relief", label="Landform, coarsest level"),
    Variable("landform_lvl1", "env", "cat", ("profile",), group="relief", label="Landform, second level"),
    Variable("landform_name", "env", "cat", ("profile",), group="relief", label="Name of the landform unit"),
    Variable("dist_coast_km", "env", "float", ("filter", "profile"), decimals=0, filter_range=(0, 685), group="water", label="Distance to the coast", unit="km"),
    Variable("dist_water_km", "env", "float", ("filter", "profile"), decimals=1, filter_range=(0, 28), group="water", label="Distance to standing water", unit="km"),
    Variable("categorie_apa", "env", "cat", ("filter", "profile"), pin_last=("Alt tip",), group="water", label="Kind of the nearest standing water"),
    Variable("dist_curs_km", "env", "float", ("filter", "profile"), decimals=1, filter_range=(0, 30), group="water", label="Distance to a watercourse", unit="km"),
    Variable("categorie_curs", "env", "cat", ("filter", "profile"), group="water", label="Kind of the nearest watercourse"),
    Variable("dist_inundatii_km", "env", "float", ("filter", "profile"), decimals=1, filter_range=(0, 20), group="hazards", label="Distance to a flood zone", unit="km"),
    Variable("scenariu_inundatii", "env", "cat", ("profile",), group="hazards", label="Flood scenario"),
    Variable("risc_urs", "env", "cat", ("filter", "profile"), group="hazards", label="Bear risk"),
    Variable("dist_border_km", "env", "float", ("filter", "profile"), decimals=0, filter_range=(0, 218), group="access", label="Distance to the border", unit="km"),
    Variable("border_neighbor", "env", "cat", ("filter", "profile"), group="access", label="Nearest neighbouring country"),
    Variable("dist_crossing_km", "env", "float", ("filter", "profile"), decimals=0, filter_range=(0, 235), group="access", label="Distance to a border crossing", unit="km"),
    Variable("nearest_crossing", "env", "cat", ("profile",), group="access", label="Nearest border crossing"),
    Variable("dist_protected_km", "env", "float", ("filter", "profile"), decimals=1, group="nature", label="Distance to a protected area", unit="km"),
    Variable("acces_gaz", "env", "cat", ("filter", "profile"), group="access", label="Gas network"),
    Variable("dist_hospital_km", "env", "float", ("filter", "profile"), decimals=1, filter_range=(0, 73), group="access", label="Distance to a hospital", unit="km"),
    Variable("nearest_hospital", "env", "cat", ("profile",), group="access", label="Nearest hospital"),
    Variable("dist_airport_km", "env", "float", ("filter", "profile"), decimals=0, filter_range=(0, 126), group="access", label="Distance to an airport", unit="km"),
    Variable("nearest_airport", "env", "cat", ("profile",), group="access", label="Nearest airport"),
    Variable("tmean", "climate", "float", ("filter", "profile"), decimals=1, group="climate", label="Mean temperature", unit="°C"),
    Variable("tmin_mean", "climate", "float", ("profile",), decimals=1, group="climate", label="Mean of daily minima", unit="°C"),
    Variable("tmax_mean", "climate", "float", ("profile",), decimals=1, group="climate", label="Mean of daily maxima", unit="°C"),
    Variable("precip_total", "climate", "float", ("filter", "profile"), decimals=0, group="climate", label="Precipitation", unit="mm"),
    Variable("precip_max_daily", "climate", "float", ("filter", "profile"), decimals=1, group="climate", label="Wettest day", unit="mm"),
    Variable("hot_days", "climate", "int", ("filter", "profile"), group="climate", label="Days of 30 °C and more", unit="days"),
    Variable("tropical_nights", "climate", "int", ("filter", "profile"), group="climate", label="Nights of 20 °C and more", unit="days"),
    Variable("frost_days", "climate", "int", ("filter", "profile"), group="climate", label="Days with frost", unit="days"),
    Variable("summer_days", "climate", "int", ("profile",), group="climate", label="Days of 25 °C and more", unit="days"),
    Variable("wet_days", "climate", "int", ("profile",), group="climate", label="Days with rain", unit="days"),
    Variable("tmean_norm_9120", "climate", "float", ("filter", "profile"), decimals=1, group="climate", label="Mean temperature 1991-2020", unit="°C"),
    Variable("tmean_norm_6190", "climate", "float", ("profile",), decimals=1, group="climate", label="Mean temperature 1961-1990", unit="°C"),
    Variable("warming_deg", "climate", "float", ("filter", "profile"), decimals=2, group="climate", label="Warming between the two periods", unit="°C"),
    Variable("tmean_trend_dec", "climate", "float", ("filter", "profile"), decimals=2, group="climate", label="Trend per decade", unit="°C"),
    Variable("tmean_anom_2025", "climate", "float", ("filter", "profile"), decimals=1, group="climate", label="Departure of 2025", unit="°C"),
    Variable("prec_norm_9120", "climate", "float", ("filter", "profile"), decimals=0, group="climate", label="Precipitation 1991-2020", unit="mm"),
    Variable("prec_norm_6190", "climate", "float", ("profile",), decimals=0, group="climate", label="Precipitation 1961-1990", unit="mm"),
    Variable("prec_change_pct", "climate", "float", ("filter", "profile"), decimals=1, group="climate", label="Change of precipitation", unit="%"),
)

MEASURES = ("pop_total", "pop_f", "pop_m", "pop_0_14", "pop_15_64", "pop_65p", "pop_ocupata")

REGISTRY = Registry(VARIABLES, MEASURES)

# Category sets used by the questions.
PLAIN = ("câmpie", "vale", "grind", "baltă/lac")
HILL = ("deal", "podiș", "depresiune")
FLOOD_10, FLOOD_1, FLOOD_01 = "10% (~10 ani)", "1% (~100 ani)", "0,1% (~1.000 ani)"
BEAR = ("Risc potențial", "Risc mediu", "Risc ridicat")
OTHER_WATER = "Alt tip"
WATER_KINDS = ("Lac", "Lac de acumulare", "Iaz", "Iaz piscicol", "Bazin", "Lagună", OTHER_WATER)
STREAM_KINDS = ("Râu", "Pârâu")
ADMIN_STATUS = {
    "Comuna": "comună",
    "Oras": "oraș",
    "Municipiu resedinta de judet": "municipiu",
    "Municipiu, altul decat resedinta de judet": "municipiu",
    "Sectoarele municipiului Bucuresti": "sector București",
}


def _ask(*constraints, measure: str = "pop_total") -> Question:
    return Question(measure, tuple(constraints))


def _touching(var: str) -> Between:
    return Between(var, None, 0, max_inclusive=True)


def _flood(label: str, *scenarios: str) -> Variant:
    return Variant(label, _ask(_touching("dist_inundatii_km"), In("scenariu_inundatii", scenarios)))


def _at_least(var: str, *bounds: float) -> tuple[Variant, ...]:
    return tuple(Variant(f"≥ {b:g} km", _ask(Between(var, min=b))) for b in bounds)


# The preset questions, in display order.
PRESETS: tuple[Preset, ...] = (
    Preset("atac-ancpi", _ask()),
    Preset("la-mare", _ask(Between("dist_coast_km", max=5))),
    Preset("frontiera", _ask(Between("dist_border_km", max=30))),
    Preset("munte", _ask(In("landform_type", ("munte",)))),
    Preset("deal", _ask(In("landform_type", HILL))),
    Preset("campie", _ask(In("landform_type", PLAIN))),
    Preset("unitate-relief", _ask(In("landform_lvl0"))),
    Preset("judet", _ask(In("county_mn"))),
    Preset("corp-apa", _ask(Between("dist_water_km", max=1), In("categorie_apa"))),
    Preset("curs-apa", _ask(Between("dist_curs_km", max=0.5), In("categorie_curs"))),
    Preset("risc-inundatii", _ask(_touching("dist_inundatii_km"), In("scenariu_inundatii")),
           variants=(_flood("Combinat"),
                     _flood(FLOOD_01, FLOOD_01, FLOOD_1, FLOOD_10),
                     _flood(FLOOD_1, FLOOD_1, FLOOD_10),
                     _flood(FLOOD_10, FLOOD_10)),
           threshold=Threshold("dist_inundatii_km", "max", 0, inclusive=True)),
    Preset("arie-protejata", _ask(_touching("dist_protected_km")),
           threshold=Threshold("dist_protected_km", "max", 0, inclusive=True)),
    Preset("risc-urs", _ask(In("risc_urs", BEAR))),
    Preset("oras-sat", _ask(In("intravilan", ("oraș",))),
           variants=(Variant("La oraș", _ask(In("intravilan", ("oraș",)))),
                     Variant("La sat", _ask(In("intravilan", ("sat",)))))),
    Preset("acces-gaz", _ask(In("acces_gaz", ("conectat",)))),
    Preset("departe-spital", _ask(Between("dist_hospital_km", min=10)),
           variants=_at_least("dist_hospital_km", 10, 20, 25)),
    Preset("peste-1000", _ask(Between("alt_mean", min=1000))),
    Preset("exemplu-multi", _ask(Between("alt_mean", 200, 500), Between("precip_total", max=400),
                                 Between("tmean", 11.5, 12.5), measure="pop_f")),
)

MORE_PRESETS: tuple[Preset, ...] = (
    Preset("bucuresti", _ask(In("county_mn", ("B",)))),
    Preset("altitudine-joasa", _ask(Between("alt_mean", max=100))),
    Preset("departe-aeroport", _ask(Between("dist_airport_km", min=50)),
           variants=_at_least("dist_airport_km", 50, 75, 100)),
    Preset("teren-inclinat", _ask(Between("slope_mean", min=5))),
    Preset("incalzire", _ask(Between("warming_deg", min=1.1))),
    Preset("zile-caniculare", _ask(Between("hot_days", min=20))),
)

ALL_PRESETS = PRESETS + MORE_PRESETS


def preset(preset_id: str) -> Preset:
    return next(p for p in ALL_PRESETS if p.id == preset_id)


# Golden questions as (label, measure, conditions), a condition being
# (variable, operator, value).
GOLDEN: tuple[tuple[str, str, tuple[tuple, ...]], ...] = (
    ("coast < 5 km", "pop_total", (("dist_coast_km", "<", 5),)),
    ("border < 30 km", "pop_total", (("dist_border_km", "<", 30),)),
    ("mountain landform", "pop_total", (("landform_type", "=", "munte"),)),
    ("hill landform", "pop_total", (("landform_type", "in", HILL),)),
    ("plain landform", "pop_total", (("landform_type", "in", PLAIN),)),
    ("altitude > 1000 m", "pop_total", (("alt_mean", ">", 1000),)),
    ("urban unit", "pop_total", (("mediu", "=", "urban"),)),
    ("rural unit", "pop_total", (("mediu", "=", "rural"),)),
    ("built-up urban", "pop_total", (("intravilan", "=", "oraș"),)),
    ("built-up village", "pop_total", (("intravilan", "=", "sat"),)),
    ("outside built-up", "pop_total", (("intravilan", "null", None),)),
    ("gas connected", "pop_total", (("acces_gaz", "=", "conectat"),)),
    ("gas not connected", "pop_total", (("acces_gaz", "=", "neconectat"),)),
    ("protected area 0 km", "pop_total", (("dist_protected_km", "<=", 0),)),
    ("protected area <= 1 km", "pop_total", (("dist_protected_km", "<=", 1),)),
    ("water body < 1 km", "pop_total", (("dist_water_km", "<", 1),)),
    ("watercourse < 0.5 km", "pop_total", (("dist_curs_km", "<", 0.5),)),
    ("hospital >= 10 km", "pop_total", (("dist_hospital_km", ">=", 10),)),
    ("hospital >= 20 km", "pop_total", (("dist_hospital_km", ">=", 20),)),
    ("hospital >= 25 km", "pop_total", (("dist_hospital_km", ">=", 25),)),
    ("airport >= 50 km", "pop_total", (("dist_airport_km", ">=", 50),)),
    ("airport >= 100 km", "pop_total", (("dist_airport_km", ">=", 100),)),
    ("warming >= 1.1 C", "pop_total", (("warming_deg", ">=", 1.1),)),
    ("women, 200-500 m, < 400 mm, 11.5-12.5 C", "pop_f",
     (("alt_mean", ">=", 200), ("alt_mean", "<=", 500), ("precip_total", "<", 400),
      ("tmean", ">=", 11.5), ("tmean", "<=", 12.5))),
)
# The twenty-fifth golden figure is a weighted mean, not a total.
GOLDEN_MEAN = ("mean airport distance", "dist_airport_km", "pop_total")
