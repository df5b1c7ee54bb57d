"""sparquill: corpus search, citation and audit analytics as Spark plans."""
