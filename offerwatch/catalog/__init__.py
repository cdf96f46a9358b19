"""Queries over the driver tables, each with the SQL that states the same result.

A query maps a table onto listings, pages or runs and then calls the library; the
SQL derives the rows from the base tables in its own way.
"""

from offerwatch.catalog import changes, costs, landings, offers, places, serving, texts, watching

MODULES = (changes, costs, texts, offers, places, watching, serving, landings)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
