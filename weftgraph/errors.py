"""What can go wrong, by kind."""


class GraphError(Exception):
    """Any error of this package."""


class PlanError(GraphError):
    """A pattern or expression that cannot be built: unknown variable, wrong use of an entity."""


class ConstraintError(GraphError):
    """A unique property that is not unique, or a node that still has edges."""


class StorageError(GraphError):
    """A graph folder that cannot be read or published."""
