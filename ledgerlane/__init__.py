"""Plan-contribution reconciliation and compliance analytics as Spark DataFrame plans."""
