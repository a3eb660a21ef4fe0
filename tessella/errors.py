"""Errors of the engine."""


class OutlineError(Exception):
    """Any error of the engine."""


class UnsupportedExtensionError(OutlineError):
    def __init__(self, ext: str):
        super().__init__(f"No generator found for file extension: {ext}")
        self.extension = ext


class UnsupportedFormatError(OutlineError):
    def __init__(self, name: str, available: list[str]):
        super().__init__(f"Unsupported format: {name}. Available formats: {', '.join(available)}")
        self.format = name


class OutlineParseError(OutlineError):
    """A document that can't be parsed, with its place where that is known."""

    def __init__(self, message: str, file_name: str | None = None, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.file_name, self.line, self.column = file_name, line, column
