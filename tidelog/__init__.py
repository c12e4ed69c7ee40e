"""tidelog: change-log decoding, dedup, replay, apply and health analysis on PySpark."""
