"""Strandline: event fusion, geo-temporal analytics and corpus preparation as plain Spark jobs."""
