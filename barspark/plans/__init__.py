"""Recipes: ordered steps over bars."""
