"""Error types of the library."""


class GridloomError(Exception):
    """Base of all errors raised on purpose."""


class DataValidationError(GridloomError):
    """Input data don't have the shape or columns that an operator needs."""


class DataLoadError(DataValidationError):
    """A source can't be read."""


class ModelTrainingError(GridloomError):
    """A model can't be fitted."""


class ArtifactError(GridloomError):
    """A stored model can't be read or written."""


class ArtifactVersionError(ArtifactError):
    """A stored model has a format of another version."""


class DriftDetectionError(GridloomError):
    """Two tables can't be compared."""


class UpdateError(GridloomError):
    """An update failed."""


class PermissionUpdateError(UpdateError):
    """An update lacks permission."""


class ConfigError(GridloomError):
    """A configuration is invalid."""


class NotSupported(GridloomError):
    """A capability that this library leaves out, with the reason."""
