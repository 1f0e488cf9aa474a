"""What the engine raises."""


class GraphError(Exception):
    """Base of all errors of the engine."""


class SyntaxProblem(GraphError):
    """The text is not a statement of the language."""


class BindError(GraphError):
    """A name, type or clause does not fit the catalog or the scope."""


class ConstraintError(GraphError):
    """A write would break a primary key or leave a dangling relationship."""


class TransactionError(GraphError):
    """Another write is under way, or the session is read-only."""
