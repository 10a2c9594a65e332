"""Training-data operators: scoring, search, deduplication, media, mixing, packing, archives.

Each module holds one operator with its own general interface; ``queries`` binds the
operators to the tables with production parameters. Nothing outside this subpackage
imports it.
"""
