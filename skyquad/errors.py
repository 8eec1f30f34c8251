"""What can go wrong, by kind."""

from __future__ import annotations


class SolverError(Exception):
    """What goes wrong outside of solving itself."""


class NoDatabase(SolverError):
    pass


class AlreadyLoaded(SolverError):
    pass


class NoSources(SolverError):
    pass


class Cancelled(SolverError):
    pass


class TimedOut(SolverError):
    pass


class FormatError(SolverError, ValueError):
    """A file that cannot be what it should be."""


class BadMagic(FormatError):
    pass


class UnsupportedVersion(FormatError):
    pass


class Truncated(FormatError):
    pass


class StarOutOfRange(SolverError, IndexError):
    pass


class PatternOutOfRange(SolverError, IndexError):
    pass
