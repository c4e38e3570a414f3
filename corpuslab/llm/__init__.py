"""Training-data operators: extraction, filtering, deduplication, scoring, mixing, encoding and sharding.

One module per operator; ``queries`` registers them for the driver. Nothing outside this
subpackage imports it except the entry module, which adds its queries when it is present.
"""
