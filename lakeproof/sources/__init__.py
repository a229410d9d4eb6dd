"""Readers of specifications, rules, load-test results and scanner reports."""
