"""All registered point-cloud queries and their SQL: importing the modules registers them."""

from tessera.plans import catalogue, details, shapes, structures, tiles

MODULES = (catalogue, tiles, shapes, structures, details)
QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
