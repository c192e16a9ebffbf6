"""A deductive analytics engine on PySpark: typed Datalog rules, planned in Python and run as DataFrame plans."""

__version__ = "0.1.0"
