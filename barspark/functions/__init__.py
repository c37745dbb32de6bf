"""Columns of indicators and factors."""
