"""wristwave: wearable-sensor analytics expressed as Spark DataFrame jobs."""
