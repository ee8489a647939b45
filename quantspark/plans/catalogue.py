"""Imports every module that registers queries."""

from quantspark.plans import diagnostic_queries, execution_queries, feature_queries, indicator_queries, kernel_queries, layer_queries, market_queries, model_queries, network_queries, more_market_queries, panel_queries, report_queries, series_queries, study_queries, text_queries  # noqa: F401
