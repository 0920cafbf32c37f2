"""The registered queries, their inputs made from the given tables, and the SQL they are checked against."""
