"""Registered queries over the analytic test tables, and their SQL oracles."""
