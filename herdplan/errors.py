"""Errors of the library."""


class HerdplanError(Exception):
    """Base of all errors raised here."""


class NonPositivePivot(HerdplanError):
    """A relationship matrix is not positive definite at the given ridge; ``index``
    is the candidate whose pivot fails first, where that is known."""

    def __init__(self, ridge: float, index: int | None = None):
        super().__init__(f"not positive definite with ridge {ridge:g}" + (f" at {index}" if index is not None else ""))
        self.ridge, self.index = ridge, index


class RidgeExhausted(HerdplanError):
    """No ridge that was tried made the matrix positive definite."""


class FormatError(HerdplanError):
    """A file does not have the expected format."""


class InputError(HerdplanError, ValueError):
    """Arguments that do not describe a selection problem."""
