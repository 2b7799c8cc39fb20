"""lexilink: entity linking and name disambiguation as Spark DataFrame operators."""
