"""The queries, by family; importing this package registers them."""

from . import contrast_queries, integrity_queries, judgment_queries, lexical_queries, quality_queries, resampling_queries, token_queries, vector_queries  # noqa: F401
