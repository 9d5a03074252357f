"""Training-data operators: mixing, decontamination, licences, dedup, WARC,
language ID, sharding and nearest neighbours.  Nothing outside this package
imports it; queries are in ``queries.py``."""
