"""The three refusals of the engine."""


class LockedSplitError(PermissionError):
    """The test split was asked for before it was unlocked."""


class LeakError(ValueError):
    """Rows used for training also appear where they are judged."""


class EvidenceError(RuntimeError):
    """A stored artifact disagrees with what its inputs give."""
