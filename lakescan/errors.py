"""What can be wrong with a file or a request, by kind."""


class ScanError(ValueError):
    """Any of the below."""


class IncorrectFile(ScanError):
    """Fewer than 12 bytes, or a footer longer than the file."""


class MissingMagicHeader(ScanError):
    """The first four bytes are not PAR1."""


class MissingMagicFooter(ScanError):
    """The last four bytes are not PAR1."""


class CorruptFooter(ScanError):
    """The footer is no Thrift compact struct."""


class UnexpectedType(ScanError):
    """The physical type in the file is not the one asked for."""


class UnknownField(ScanError):
    """No such path in the schema."""


class MissingColumnMetadata(ScanError):
    """A column chunk without metadata."""


class NotAListColumn(ScanError):
    """A list was asked for where nothing repeats."""


class NotAMapColumn(ScanError):
    """A map was asked for where the schema has none."""


class MissingDecimalScale(ScanError):
    """A decimal view of a column without a scale."""


class UnsupportedDecimal(ScanError):
    """A decimal view of a physical type, or of a width, that holds none."""


class UnsupportedCodec(ScanError):
    """BROTLI and LZO: Spark has no codec for them (the row-group source reads BROTLI)."""
