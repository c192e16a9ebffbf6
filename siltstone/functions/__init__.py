"""Values as Spark columns: encoding, equality, total order, string functions."""
