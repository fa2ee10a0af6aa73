"""Files that come in pieces.

A file is a row (path, content). A long one may be several, with ``piece``,
its number, and ``before``, the number of lines that go before those of its
body: an XML file is cut between children of its root, which stands around
each piece, and a dictionary between rows. So no task has to hold a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

PIECES = ("piece", "before")


def of(files: DataFrame) -> list[str]:
    """The columns of pieces that files have."""
    return [c for c in PIECES if c in files.columns]
