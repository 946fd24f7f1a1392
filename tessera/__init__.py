"""Cross-sectional price-trend analytics on Spark DataFrames.

Panels are DataFrames keyed by entity and date; operators take and return DataFrames.
"""
