"""Bilingual row-layout analytics on Spark."""
