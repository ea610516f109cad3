"""DNS traffic analytics as Spark table and stream operators."""
