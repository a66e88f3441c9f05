"""All named queries and their SQL."""

from riskloom.plans import calibration_queries, combination_queries, detail_queries, horizon_queries, inference_queries, panel_queries, risk_queries, source_queries

QUERIES, SQL = {}, {}
for module in (panel_queries, risk_queries, detail_queries, source_queries, inference_queries, horizon_queries, calibration_queries, combination_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
