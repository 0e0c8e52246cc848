"""fluvia: stream-style dataflow operators expressed as Spark DataFrame plans."""
