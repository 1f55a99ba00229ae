"""Point-in-time features, walk-forward scoring and market reporting on Spark."""
