"""In-silico PCR analytics as Spark plans: hits, amplicons, probes, nested products, thermodynamics."""

__version__ = "0.1.0"
