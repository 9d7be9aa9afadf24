"""End-to-end jobs: enrichment, general testing, cross-validation."""
