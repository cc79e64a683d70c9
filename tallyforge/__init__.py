"""Tallyforge: declarative business-data preparation and marts as lazy Spark plans."""
