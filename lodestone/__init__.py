"""A lexical search, ranking and faceting engine on Spark DataFrames."""

from .errors import Error, InvalidQueryError, MissingFieldError, UnsupportedError
from .operators.filters import Between
from .sources.model import SearchModel, models, parquet_model, search

__all__ = ["Between", "Error", "InvalidQueryError", "MissingFieldError", "SearchModel", "UnsupportedError", "models", "parquet_model", "search"]
