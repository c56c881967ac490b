"""bundlelens: fleet-scale support-bundle analytics as Spark DataFrame plans."""
