"""Base estimators on numpy, fitted and applied inside tasks."""
