"""strata: block classification and interval analytics expressed as Spark plans."""
