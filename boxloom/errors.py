"""Errors by what a caller can do about them."""


class BoxloomError(Exception):
    """Anything this engine refuses; command line exit code 1."""


class ConfigError(BoxloomError):
    """A setting is missing, unknown or of the wrong kind; exit code 2."""


class DataError(BoxloomError):
    """Input rows break a rule; exit code 2."""


class EvaluationError(BoxloomError):
    """Predictions and records do not fit together; exit code 2."""


class ArtifactError(BoxloomError):
    """A published folder is missing, incomplete or changed; exit code 2."""


EXIT_CODES = {ConfigError: 2, DataError: 2, EvaluationError: 2, ArtifactError: 2}


def exit_code(error: BaseException) -> int:
    return next((code for kind, code in EXIT_CODES.items() if isinstance(error, kind)), 1)
