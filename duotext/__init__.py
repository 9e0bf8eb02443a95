"""duotext: DataFrame operators for corpora of labelled text pairs."""

__version__ = "0.1.0"
