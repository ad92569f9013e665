"""Composed jobs, driver-table views and the query catalog."""
