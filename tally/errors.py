"""Exceptions raised by driver-side checks (no job runs for these)."""


class TallyError(Exception):
    """Base class."""


class ValidationError(TallyError):
    """A batch fails schema or value checks."""


class NotFoundError(TallyError):
    """A requested key does not exist."""


class PermissionDenied(TallyError):
    """Rows reference accounts the user does not own."""


class ModelNotFoundError(TallyError):
    """No trained model exists at the given path."""


class InsufficientDataError(TallyError):
    """Too little history to fit a forecaster."""
