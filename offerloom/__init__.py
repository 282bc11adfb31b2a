"""Catalogue analytics on Spark: search, matching, scoring, audits and page jobs as DataFrame code."""
