"""Fixed values of the permit rules, from the regulations that they cite, and their small tables."""

from __future__ import annotations

#: Wide pollutant columns, in the order in which ties are broken.
POLLUTANTS = ("nox", "co", "pm10", "pm25", "so2", "voc", "co2e", "hcho")
CRITERIA = POLLUTANTS[:6]

MOVERS = ("simple_cycle_turbine", "combined_cycle_turbine", "recip_lean_burn", "recip_rich_burn", "diesel_recip", "fuel_cell")

#: lb/MMBtu by mover and fuel, in POLLUTANTS' order (EPA AP-42 3.1, 3.2, 3.4; 40 CFR 98).
EMISSION_FACTORS = {
    ("simple_cycle_turbine", "natural_gas"): (0.32, 0.082, 0.0066, 0.0066, 0.0034, 0.0021, 110.0, 0.00071),
    ("combined_cycle_turbine", "natural_gas"): (0.32, 0.082, 0.0066, 0.0066, 0.0034, 0.0021, 110.0, 0.00071),
    ("simple_cycle_turbine", "diesel"): (0.88, 0.085, 0.012, 0.012, 0.0011, 0.0041, 161.0, 0.00028),
    ("recip_lean_burn", "natural_gas"): (0.847, 0.557, 0.000771, 0.000771, 0.000588, 0.118, 110.0, 0.0528),
    ("recip_rich_burn", "natural_gas"): (2.21, 3.72, 0.0095, 0.0095, 0.000588, 0.0296, 110.0, 0.0021),
    ("diesel_recip", "diesel"): (0.024 / 0.007, 0.0055 / 0.007, 0.0007 / 0.007, 0.0007 / 0.007, 0.0011, 0.0007 / 0.007, 161.0, 0.000118),
    ("fuel_cell", "natural_gas"): (0.00025, 0.0007, 0.00002, 0.00002, 0.0, 0.00002, 110.0, 0.0),
}
#: Default heat rates, Btu/kWh.
HEAT_RATES = {
    "simple_cycle_turbine": 10500.0, "combined_cycle_turbine": 6800.0, "recip_lean_burn": 8500.0,
    "recip_rich_burn": 9200.0, "diesel_recip": 7500.0, "fuel_cell": 7400.0,
}
#: Share that a control removes, by pollutant.
CONTROL_EFFICIENCY = {
    "dry_low_nox": {"nox": 0.69},
    "water_injection": {"nox": 0.60},
    "scr": {"nox": 0.90},
    "oxidation_catalyst": {"co": 0.90, "voc": 0.50, "hcho": 0.70},
}
#: Tier 4 final, g/kWh (40 CFR 1039.101), and grams in a pound.
TIER4 = {"nox": 0.67, "pm10": 0.03, "pm25": 0.03, "co": 3.5, "voc": 0.19}
GRAMS_PER_LB = 453.592
#: Significant emission rates, tons a year (40 CFR 52.21(b)(23)(i)).
SIGNIFICANT = {"nox": 40.0, "co": 100.0, "pm10": 15.0, "pm25": 10.0, "so2": 40.0, "voc": 40.0, "co2e": 75000.0}

#: Pathway, rank, months low, likely, high.
PATHWAYS = (
    ("permit_by_rule", 0, 1.0, 2.0, 4.0),
    ("minor_nsr", 1, 4.0, 6.0, 10.0),
    ("synthetic_minor", 2, 5.0, 8.0, 14.0),
    ("major_psd", 3, 14.0, 24.0, 36.0),
    ("major_nonattainment_nsr", 4, 20.0, 30.0, 48.0),
)
#: Major thresholds in nonattainment areas, tons a year, by designated pollutant and class.
NA_THRESHOLDS = {
    "ozone": {"marginal": 100.0, "moderate": 100.0, "serious": 50.0, "severe": 25.0, "severe-15": 25.0, "severe-17": 25.0, "extreme": 10.0, "unclassified": 100.0},
    "pm25": {"moderate": 100.0, "serious": 70.0, "unclassified": 100.0},
    "pm10": {"moderate": 100.0, "serious": 70.0, "unclassified": 100.0},
    "co": {"moderate": 100.0, "serious": 50.0, "unclassified": 100.0},
    "so2": {"unclassified": 100.0},
    "no2": {"unclassified": 100.0},
    "lead": {"unclassified": 100.0},
}
#: The emitted pollutants that count for a designation, in order.
PRECURSORS = {"ozone": ("nox", "voc"), "pm25": ("pm25", "so2", "nox"), "pm10": ("pm10",), "co": ("co",), "so2": ("so2",), "no2": ("nox",), "lead": ()}
#: Offset ratios by class.
OFFSETS = {"marginal": 1.1, "moderate": 1.15, "serious": 1.2, "severe": 1.3, "severe-15": 1.3, "severe-17": 1.3, "extreme": 1.5, "unclassified": 1.0}
SEVERITY = ("extreme", "severe-17", "severe-15", "severe", "serious", "moderate", "marginal", "unclassified")
OTR_THRESHOLD, PBR_TPY, PBR_HEAT = 50.0, 25.0, 100.0

#: State overlays: months multiplier, permit by rule, state toxics program.
OVERLAYS = {
    "VA": (1.25, False, True), "TX": (0.75, True, True), "GA": (1.0, False, False), "OH": (0.95, True, False),
    "AZ": (1.15, False, False), "NJ": (1.6, False, True), "NM": (1.35, False, False), "IL": (1.2, False, False),
}
#: The Ozone Transport Region, and the states whose agency can deny on environmental justice grounds.
OTR_STATES = ("CT", "DE", "ME", "MD", "MA", "NH", "NJ", "NY", "PA", "RI", "VT", "DC")
OTR_VA = ("Arlington", "Fairfax", "Loudoun", "Prince William", "Stafford", "Alexandria", "Falls Church", "Manassas", "Manassas Park")
EJ_STATES = ("NJ",)

MONTH_DAYS, PROJECT_MONTH_DAYS, IMAGE_MONTH_DAYS = 30.437, 30.44, 30.4375


def values(rows) -> str:
    """Rows as the body of SQL VALUES; text is quoted, numbers are doubles unless they are ints or bools."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, int) else f"CAST({x!r} AS DOUBLE)"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)

#: The text of law or the kind of record that each step of a chain of reasons rests on.
CITATIONS = {
    "nonattainment_designation": "40 CFR 81",
    "permit_by_rule": "state program",
    "minor_nsr": "40 CFR 51.160",
    "synthetic_minor": "40 CFR 52.21(b)(4)",
    "major_psd": "40 CFR 52.21(b)(1)(i)",
    "major_nonattainment_nsr": "CAA 173; 40 CFR 51.165(a)(1)(iv)(A)",
    "class_i_aqrv": "40 CFR 52.21(p)",
    "psd_increment_consumed": "40 CFR 52.21(c)",
    "title_v": "40 CFR 70",
    "nsps_turbine": "40 CFR 60 KKKK, KKKKa",
    "nsps_rice": "40 CFR 60 IIII, JJJJ; 40 CFR 63 ZZZZ",
    "state_toxics": "state program",
    "ozone_transport_region": "CAA 184; 40 CFR 51.165",
    "ej_denial_authority": "state program",
    "complex_terrain": "40 CFR 51 W",
    "county_moratorium": "county record",
    "zoning_posture": "county record",
    "litigation": "court docket",
    "gas_reachability": "utility map",
    "source_aggregation_risk": "40 CFR 52.21(b)(6)",
}
