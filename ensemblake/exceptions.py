"""Errors and warnings of the engine."""


class ImproperlyConfigured(Exception):
    """Parameters that contradict each other or name nothing."""


class DataInvalid(Exception):
    """Data of the wrong shape or kind."""


class InsufficientResourceError(Exception):
    """Not enough memory or disk for a driver-side step."""


class SuspiciousDataWarning(UserWarning):
    """Data that is valid but unlikely to be meant."""


class PerformanceWarning(UserWarning):
    """A slower way was taken."""


class ConvergenceWarning(UserWarning):
    """An iteration ended before it converged."""
