"""Training-data operators: thirteen corpus operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
