"""Errors a run can raise while its plan is built, before any output is written."""


class SpecError(ValueError):
    """The export description is unusable; ``problems`` lists everything found at once."""

    def __init__(self, problems):
        self.problems = list(problems)
        super().__init__("; ".join(self.problems))


class FilterError(ValueError):
    """The caller supplied a filter that cannot be honoured."""


class SetupError(RuntimeError):
    """The description needs something the run was not given (a lookup, a table, a folder)."""


class UnknownCode(ValueError):
    """Raised by a request lookup for a value it does not know."""


class DuplicateKeys(ValueError):
    """A level of a tree has rows that share one key."""


class SubtreeTooLarge(ValueError):
    """One nested row would hold more rows than the caller allows in a single task."""
