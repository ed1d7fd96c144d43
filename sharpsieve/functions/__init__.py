"""Technical image-quality triage on Spark."""
