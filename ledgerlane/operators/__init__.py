"""Reconciliation, timing, rule, issue, metric and integrity operators."""
