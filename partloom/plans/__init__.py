"""End-to-end jobs: raw files to wide catalogue, wide catalogue to star, queries."""
