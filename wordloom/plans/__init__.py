"""Recipes, jobs and the registered queries."""
