"""Registered queries by inventory ID, each with SQL that gives the same rows where SQL can."""
