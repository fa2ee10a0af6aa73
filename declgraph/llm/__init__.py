"""Training-data operators: quality, tokenisation, near-dedup, WARC, URL
filters, mixing, licences, sharding, media and repetition rules.

Nothing else in the library imports this subpackage. Python functions that
run on executors live in these modules, so the package has to be importable
there (``--py-files`` or an image that carries it).
"""
