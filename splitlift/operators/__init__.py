"""DataFrame -> DataFrame operators; each works with ``DataFrame.transform``."""
