"""voyage: a PySpark engine for long event timelines of many subjects."""
