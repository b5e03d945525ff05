"""Training-data operators: tokenisation, packing, near-duplicate search, archives, chat and secrets.

Nothing outside this subpackage imports it. Every operator is a function
``DataFrame -> DataFrame``. Each first selects just the key and payload columns
it needs, so extra input columns, whatever their names, never clash with the
columns an operator makes; they are left out of its result.
"""
