"""The queries of this subpackage and their SQL, by name."""

from . import centroids, fingerprints, licenses, mixing, near_duplicates, ogg, packing, phrases, quality_classifier, quality_rules, sharding, token_counts, warc

_MODULES = (quality_rules, packing, sharding, licenses, token_counts, mixing, warc, quality_classifier, ogg, near_duplicates, centroids, phrases, fingerprints)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
