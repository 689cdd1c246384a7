"""Steps put together: from raw tables to the enriched panel, and the analyses on it."""
