"""Training-data operators: ten corpus-preparation operators on Spark DataFrames.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` binds them to
the test tables.
"""
