"""Errors of the engine: one base class and its kinds."""


class GraphError(Exception):
    """Base of all errors of this package."""


class SyntaxProblem(GraphError):
    """The query text is not well-formed."""


class BindingProblem(GraphError):
    """The query does not fit the catalog or the parameters."""


class MutationProblem(GraphError):
    """An update is not allowed or cannot be applied."""


class ConstraintViolation(GraphError):
    """Data do not meet declared constraints."""


class StoreProblem(GraphError):
    """A store is missing, locked, damaged or in conflict."""


class LockProblem(StoreProblem):
    """Another writer holds the store."""


class ConflictProblem(StoreProblem):
    """The store moved on since this version was read."""


class MigrationProblem(StoreProblem):
    """No contiguous path of migrations, or one of them failed."""
