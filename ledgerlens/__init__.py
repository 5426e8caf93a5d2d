"""ledgerlens: card-fraud investigation operators as Spark DataFrame transformations."""
