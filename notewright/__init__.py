"""notewright: text-extraction, evaluation and tensor analytics as PySpark DataFrame programs."""

__version__ = "0.1.0"
