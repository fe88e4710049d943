"""cargolens: document reconciliation for shipping mail as Spark DataFrame jobs."""
