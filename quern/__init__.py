"""quern: a relational engine on Spark DataFrames, with SQL tables that can be changed in place."""
