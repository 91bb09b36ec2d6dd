"""centime: a Spark-first analytics engine for published public-accounts data.

Everything is a function from DataFrame to DataFrame; plans stay declarative so
that Catalyst and AQE choose the physical strategy.
"""
