"""Plumbline: conformance analytics and corpus preparation as Spark DataFrame programs."""
