"""Reading and writing tables, row numbering, durable intermediate tables, shaped views over the given tables."""
