"""Errors of the engine."""


class IngestionError(Exception):
    """Pages could not be read or told apart."""


class RetrievalError(Exception):
    """Sections could not be searched: an index is missing or was made for other tables."""


class ModelError(ValueError):
    """A model could not be asked, or its reply holds nothing."""
