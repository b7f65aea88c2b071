def load() -> None:
    """Imports the modules that register queries."""
    from . import documents, evaluation, retrieval, review, rules, tabular  # noqa: F401
