"""Operations analytics on event data, written for Spark.

Events land once as raw rows with a JSON payload, are routed by name into typed tables, and every question about
orders, stations, stock and decisions is a DataFrame built from those tables.
"""
