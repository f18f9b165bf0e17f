"""Accrete: Spark jobs for data sets that grow over time."""
