"""carryover: prove and carry out a data-platform move as Spark jobs.

Every operator is a function from DataFrames to DataFrames; ``carryover.plans``
binds them to the sample tables and pairs each with an equivalent SQL text.
"""
