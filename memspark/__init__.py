"""Analytics over long-term memory records, expressed as lazy Spark plans."""
