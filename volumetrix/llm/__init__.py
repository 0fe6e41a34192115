"""Training-data operators: quality rules, mixing, dedup, scans, language id, packing, counts.

Each module is one operator with its own interface; ``queries`` wires them to the tables.
Nothing outside this package imports it.
"""
