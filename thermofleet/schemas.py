"""Table schemas. Every table carries `site_id`; unknown numbers are NULL, never NaN or zero."""

from __future__ import annotations

READINGS = "site_id bigint, ts timestamp, name string, value string"

ENTITY_STATES = (
    "site_id bigint, entity_id string, state string, attributes map<string,string>, "
    "last_changed timestamp, last_updated timestamp"
)

STATE_HISTORY_JSON = (
    "site_id bigint, entity_id string, state string, attributes map<string,string>, "
    "last_changed string, last_updated string"
)

FORECAST = (
    "site_id bigint, issued_at timestamp, target_ts timestamp, temperature double, condition string, "
    "wind_speed double, cloud_coverage double, precipitation double"
)

FORECAST_ENTRY = (
    "datetime string, temperature string, condition string, wind_speed string, "
    "cloud_coverage string, precipitation string"
)

EFFECTOR_DECISIONS = "array<struct<name:string,mode:string,target:double,delay_steps:int,duration_steps:int>>"
PREDICTIONS = "map<string,map<string,double>>"
BOUNDS = "map<string,map<string,double>>"
NUMBERS = "map<string,double>"
REASONS = "map<string,string>"

# JSON text columns of a landed decision row and the type each is parsed to.
DECISION_JSON = {
    "current_temps": NUMBERS,
    "predictions": PREDICTIONS,
    "comfort_bounds": BOUNDS,
    "effector_decisions": EFFECTOR_DECISIONS,
    "command_targets": NUMBERS,
    "mrt_offsets": NUMBERS,
    "blocked": REASONS,
    "outcomes": "map<string,map<string,struct<predicted:double,actual:double,error:double>>>",
}

DECISION_PLAIN = {
    "site_id": "bigint",
    "ts": "timestamp",
    "live": "boolean",
    "outdoor_temp": "double",
    "comfort_cost": "double",
    "energy_cost": "double",
    "active_profile": "string",
    "outcome_backfilled": "boolean",
}

OUTCOMES = (
    "site_id bigint, decision_ts timestamp, sensor string, horizon string, "
    "predicted double, actual double, error double"
)

RUN_METRICS = (
    "timestamp string, mode string, experiment string, git_hash string, "
    "data struct<rows_raw:bigint,rows_train:bigint,rows_val:bigint,n_features:bigint,date_range:array<string>>, "
    "targets array<struct<target:string,rmse:double,mae:double,n_train:bigint,n_val:bigint>>, "
    "_corrupt_record string"
)

FITTED_PARAMETERS = (
    "fitted_taus array<struct<sensor:string,tau_base:double,n_segments:int,"
    "environment_tau_betas:map<string,double>,advisory_tau_betas:map<string,double>,"
    "window_betas:map<string,double>>>, "
    "effector_sensor_gains array<struct<effector:string,sensor:string,gain_f_per_hour:double,"
    "best_lag_minutes:double,t_statistic:double,negligible:boolean>>, "
    "solar_elevation_gains map<string,double>, "
    "environment_solar_betas map<string,map<string,double>>, "
    "advisory_solar_betas map<string,map<string,double>>"
)
