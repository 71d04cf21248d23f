"""Exception types raised by the engine."""


class HelixmillError(Exception):
    """Base of all errors of the engine."""


class ConfigurationError(HelixmillError):
    pass


class SourceError(HelixmillError):
    pass


class PreprocessingError(HelixmillError):
    pass


class MissingDataError(PreprocessingError):
    pass


class QualityControlError(HelixmillError):
    pass


class IntegrationError(HelixmillError):
    pass


class SampleAlignmentError(IntegrationError):
    pass


class ExportError(HelixmillError):
    pass


class FHIRError(ExportError):
    pass


class ValidationError(HelixmillError):
    pass
