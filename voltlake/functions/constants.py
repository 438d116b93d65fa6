"""Codes and limits that results depend on."""

SERVICES = ["DCH", "DCL", "DRH", "DRL", "DMH", "DML"]
SERVICE_LABELS = {"DCH": "DC High", "DCL": "DC Low", "DRH": "DR High", "DRL": "DR Low", "DMH": "DM High", "DML": "DM Low"}
MARKETS = {"DC": ("DCH", "DCL"), "DR": ("DRH", "DRL"), "DM": ("DMH", "DML")}
PROVIDER = "APXMIDP"
SOC_LOWER, SOC_UPPER = 0.10, 0.90
BLOCK_HOURS = 4
FUEL_GROUPS = {
    "CCGT": "Gas", "OCGT": "Gas", "NUCLEAR": "Nuclear", "WIND": "Wind", "NPSHYD": "Hydro", "BIOMASS": "Biomass",
    "COAL": "Coal", "OIL": "Oil", "PS": "Pumped Storage", "INTFR": "Interconnectors", "INTIRL": "Interconnectors",
    "INTNED": "Interconnectors", "INTNEM": "Interconnectors", "INTNSL": "Interconnectors", "INTVKL": "Interconnectors",
    "INTIFA2": "Interconnectors", "INTEW": "Interconnectors", "INTELEC": "Interconnectors", "OTHER": "Other",
    "SOLAR": "Solar", "EMBEDDED_WIND": "Wind",
}
GROUPS = sorted(set(FUEL_GROUPS.values()))
RENEWABLE, FOSSIL = ("wind", "hydro", "biomass", "solar"), ("gas", "coal", "oil")
BATTERY_TECHNOLOGIES = ["battery", "battery storage", "advanced conversion technologies"]
PROJECT_ALIASES = {
    "technology_type": ["technology type", "technology"],
    "installed_capacity_mw": ["installed capacity (mwelec)", "installed capacity (mw)", "capacity (mw)", "mwelec"],
    "development_status": ["development status", "status"],
    "operational_date": ["operational", "date of operation"],
    "site_name": ["site name", "project name", "project"],
}
FLEET_MILESTONES = {2019: 800.0, 2021: 1400.0, 2023: 3500.0}
WEAR_STEPS = [0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0]
LEGACY_END, ARCHIVE_START, ARCHIVE_END, CURRENT_START = "2023-11-01", "2023-11-02", "2025-03-31", "2025-04-01"
