"""Registered queries and their DuckDB oracles (see __spark_entry__.py)."""

from __future__ import annotations

from limnos.catalog import file_oracles as FO
from limnos.catalog import file_queries as FQ
from limnos.catalog import layer_oracles as LO
from limnos.catalog import layer_queries as LQ
from limnos.catalog import oracles as O
from limnos.catalog import queries as Q

# name -> (query, oracle SQL or None when only a rows check is possible)
REGISTRY = {
    "station_master": (Q.station_master, O.STATION_MASTER),
    "baseline_final": (Q.baseline_final, O.BASELINE_FINAL),
    "baseline_rejected": (Q.baseline_rejected, O.BASELINE_REJECTED),
    "tp_final": (Q.tp_final, O.TP_FINAL),
    "tp_top5": (Q.tp_top5, O.TP_TOP5),
    "tp_histogram": (Q.tp_histogram, O.TP_HISTOGRAM),
    "logger_readings": (Q.logger_readings, O.LOGGER_READINGS),
    "logger_qc": (Q.logger_qc, O.LOGGER_QC),
    "logger_warnings": (Q.logger_warnings, O.LOGGER_WARNINGS),
    "logger_trimmed": (Q.logger_trimmed, O.LOGGER_TRIMMED),
    "logger_status": (Q.logger_status, O.LOGGER_STATUS),
    "logger_status_summary": (Q.logger_status_summary, O.LOGGER_STATUS_SUMMARY),
    "inventory_without_data": (Q.inventory_without_data, O.INVENTORY_WITHOUT_DATA),
    "inventory_export": (Q.inventory_export, O.INVENTORY_EXPORT),
    "logger_daily": (Q.logger_daily, O.LOGGER_DAILY),
    "logger_daily_ranges": (Q.logger_daily_ranges, O.LOGGER_DAILY_RANGES),
    "weather_requests": (Q.weather_requests, O.WEATHER_REQUESTS),
    "loggers_per_year": (Q.loggers_per_year, O.LOGGERS_PER_YEAR),
    "baseline_station_tally": (Q.baseline_station_tally, O.BASELINE_STATION_TALLY),
    "stations_missing_from_list": (Q.stations_missing_from_list, O.STATIONS_MISSING_FROM_LIST),
    "baseline_visits_per_year": (Q.baseline_visits_per_year, O.BASELINE_VISITS_PER_YEAR),
    "duplicate_coordinates": (Q.duplicate_coordinates, O.DUPLICATE_COORDINATES),
    "duplicate_samples": (Q.duplicate_samples, O.DUPLICATE_SAMPLES),
    "unique_partner_samples": (Q.unique_partner_samples, O.UNIQUE_PARTNER_SAMPLES),
    "samples_by_source": (Q.samples_by_source, O.SAMPLES_BY_SOURCE),
    "watershed_hierarchy": (Q.watershed_hierarchy, O.WATERSHED_HIERARCHY),
    "station_watersheds": (Q.station_watersheds, O.STATION_WATERSHEDS),
    "layer_stats": (Q.layer_stats, O.LAYER_STATS),
    "display_layer_stats": (Q.display_layer_stats, LO.DISPLAY_LAYER_STATS),
    "stations_wtm": (Q.stations_wtm, O.STATIONS_WTM),
    "landcover_shares": (Q.landcover_shares, O.LANDCOVER_SHARES),
    "landcover_area_summary": (Q.landcover_area_summary, O.LANDCOVER_AREA_SUMMARY),
    "landcover_state_means": (Q.landcover_state_means, O.LANDCOVER_STATE_MEANS),
    "landcover_vs_state": (Q.landcover_vs_state, O.LANDCOVER_VS_STATE),
    "landcover_sample_watershed": (Q.landcover_sample_watershed, O.LANDCOVER_SAMPLE_WATERSHED),
    "plan_attributes": (Q.plan_attributes, O.PLAN_ATTRIBUTES),
    "stations_csv_roundtrip": (Q.stations_csv_roundtrip, O.STATION_MASTER),
    "logger_files_roundtrip": (Q.logger_files_roundtrip, O.LOGGER_READINGS),
    "event_props": (Q.event_props, O.EVENT_PROPS),
    "logger_export_roundtrip": (Q.logger_export_roundtrip, O.LOGGER_EXPORT_ROUNDTRIP),
    "weather_files_roundtrip": (Q.weather_files_roundtrip, O.WEATHER_FILES_ROUNDTRIP),
    "stations_table_roundtrip": (Q.stations_table_roundtrip, O.STATION_MASTER),
    "stations_export_targets": (Q.stations_export_targets, O.STATIONS_EXPORT_TARGETS),
    "tally_tee": (Q.tally_tee, O.BASELINE_VISITS_PER_YEAR),
    "weather_long": (Q.weather_long, O.WEATHER_LONG),
    "tp_scale": (Q.tp_scale, O.TP_SCALE),
    "landcover_axis_range": (Q.landcover_axis_range, O.LANDCOVER_AXIS_RANGE),
    "visits_excel_text": (Q.visits_excel_text, O.VISITS_EXCEL_TEXT),
    "layers_geojson_roundtrip": (LQ.layers_geojson_roundtrip, LO.LAYERS_GEOJSON_ROUNDTRIP),
    "dnr_watershed_layer": (LQ.dnr_watershed_layer, LO.DNR_WATERSHED_LAYER),
    "display_layers_export": (LQ.display_layers_export, LO.DISPLAY_LAYERS_EXPORT),
    "landcover_cells_roundtrip": (LQ.landcover_cells_roundtrip, LO.LANDCOVER_CELLS_ROUNDTRIP),
    "nke_plans": (LQ.nke_plans, LO.NKE_PLANS),
    "flow_first_in_file": (FQ.flow_first_in_file, FO.FLOW_FIRST_IN_FILE),
    "logger_years": (FQ.logger_years, FO.LOGGER_YEARS),
    "logger_years_qc": (FQ.logger_years_qc, FO.LOGGER_YEARS_QC),
    "inventory_years_without_data": (FQ.inventory_years_without_data, FO.INVENTORY_YEARS_WITHOUT_DATA),
    "logger_titles": (FQ.logger_titles, FO.LOGGER_TITLES),
    "station_tally_arranged": (FQ.station_tally_arranged, FO.STATION_TALLY_ARRANGED),
    "tp_histogram_auto": (FQ.tp_histogram_auto, FO.TP_HISTOGRAM_AUTO),
    "baseline_at_duplicates": (FQ.baseline_at_duplicates, FO.BASELINE_AT_DUPLICATES),
    "duplicate_samples_of_year": (FQ.duplicate_samples_of_year, FO.DUPLICATE_SAMPLES_OF_YEAR),
    "reading_time_zone": (FQ.reading_time_zone, FO.READING_TIME_ZONE),
}
