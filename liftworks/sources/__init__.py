"""Readers and the mapping of test tables to campaign tables."""
