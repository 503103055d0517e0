"""hoarfrost: frost-risk and micro-climate analytics expressed as Spark plans."""
