"""Registered queries over the driver's tables, with SQL to check them by."""
