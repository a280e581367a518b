"""Frame telemetry, imaging and codec analytics as Spark jobs."""
