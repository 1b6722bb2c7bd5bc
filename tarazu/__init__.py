"""Tarazu: a ledger analytics engine on PySpark.

Statement files become typed tables with whole-number money, every ledger is proved against the
arithmetic that its source states, rows are labelled with merchants and categories, and structured
questions are planned onto DataFrames and answered with their evidence rows.
"""
