"""Schemas of the processed and raw tables. Values are doubles, missing is null, never NaN."""

AUCTIONS = "service string, efa_date date, efa int, delivery_start timestamp_ntz, delivery_end timestamp_ntz, volume double, price double"
MARKET_INDEX = "settlement_date date, settlement_period int, provider string, price double, volume double, start_time timestamp"
SYSTEM_PRICES = "settlement_date date, settlement_period int, sell_price double, buy_price double"
GENERATION_DAILY = "settlement_date date, fuel_group string, generation double"
FLEET = "month date, fleet_mw double"
EAC_RAW = "auctionProduct string, deliveryStart string, deliveryEnd string, clearedVolume string, clearingPrice string"
FUEL_HH = "settlementDate string, settlementPeriod int, fuelType string, generation double, startTime string, publishTime string"
DEMAND = "SETTLEMENT_DATE string, SETTLEMENT_PERIOD int, EMBEDDED_SOLAR_GENERATION string, EMBEDDED_WIND_GENERATION string"
MONTHLY = "month date, imbalance_revenue_gbp double, cycling_cost_gbp double, mwh_cycled double"
SOC = "scenario string, date date, sp int, soc_frac double"
SCENARIO = "scenario string, power_mw double, duration_h double, efficiency double, wear double, availability double, initial_soc double"

#: Names in the processed files, to the names used here.
PROCESSED_NAMES = {
    "auctions": {"Service": "service", "EFA Date": "efa_date", "EFA": "efa", "Delivery Start": "delivery_start", "Delivery End": "delivery_end", "Cleared Volume": "volume", "Clearing Price": "price"},
    "market_index": {"settlementDate": "settlement_date", "settlementPeriod": "settlement_period", "dataProvider": "provider", "startTime": "start_time"},
    "system_prices": {"settlementDate": "settlement_date", "settlementPeriod": "settlement_period", "systemSellPrice": "sell_price", "systemBuyPrice": "buy_price"},
    "generation_daily": {"settlementDate": "settlement_date", "fuelGroup": "fuel_group"},
    "bess_fleet_capacity": {"month_start": "month", "bess_fleet_mw": "fleet_mw"},
}
TABLES = {"auctions": AUCTIONS, "market_index": MARKET_INDEX, "system_prices": SYSTEM_PRICES, "generation_daily": GENERATION_DAILY, "bess_fleet_capacity": FLEET}
