"""XML declarations as rows.

Every element of a file becomes a node with its line, its attributes and the
chain of the elements around it. What a kind of file declares is then a table
of which elements count and which attributes they take from where (specs.py),
so the kinds share one parser and one scan. Nodes leave the parser as their
elements end, some thousand at a time, however long the file is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import PIECES

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
NODE = (
    T.StructType().add("seq", "long").add("line", "integer").add("tag", "string").add("attrs", ATTRIBUTES).add("text", "string")
    .add("trail", T.ArrayType(T.StructType().add("tag", "string").add("attrs", ATTRIBUTES)))
)
ROWS = 4_000  #: nodes that leave the parser at once
CHARACTERS = 1 << 16  #: characters that it gets at once
IN_PIECE = 1 << 32  #: a node's seq is its piece's number times this, and its place therein


def closed(text: str | None, errors: list[str]) -> Iterator[list[tuple]]:
    """Nodes as their elements end; those that are still open come last. What stopped the parser goes into errors."""
    parser = expat.ParserCreate()
    done: list[tuple] = []
    open_: list[tuple[int, int, str, dict, list[str], list]] = []
    count = 0

    def start(tag, attrs):
        nonlocal count
        plain = {k.rpartition(":")[2]: v for k, v in attrs.items()}
        open_.append((count, parser.CurrentLineNumber, tag.rpartition(":")[2], plain, [], [(o[2], o[3]) for o in open_]))
        count += 1

    def end(tag=None):
        s, line, name, attrs, parts, trail = open_.pop()
        done.append((s, line, name, attrs, "".join(parts).strip(), trail))

    def data(text):
        if open_ and (open_[-1][4] or not text.isspace()):
            open_[-1][4].append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    text = text or ""
    try:
        for at in range(0, len(text), CHARACTERS):
            parser.Parse(text[at : at + CHARACTERS], False)
            if len(done) >= ROWS:
                yield done
                done = []
        parser.Parse("", True)
    except expat.ExpatError as e:
        errors.append(str(e))
    while open_:
        end()
    yield done


def nodes_of(text: str | None) -> tuple[list[tuple], str | None]:
    """Nodes in document order, as far as the file can be read, and what stopped it."""
    errors: list[str] = []
    found = sorted((n for some in closed(text, errors) for n in some), key=lambda n: n[0])
    return found, errors[0] if errors else None


def maps(dicts: list[dict]) -> pa.MapArray:
    ends, keys, values = [0], [], []
    for d in dicts:
        keys += d.keys()
        values += d.values()
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def columns_of(nodes: list[tuple], piece: int, before: int) -> list[pa.Array]:
    seq, line, tag, attrs, text, trail = zip(*nodes)
    ends, around = [0], []
    for t in trail:
        around += t
        ends.append(len(around))
    chain = pa.StructArray.from_arrays([pa.array([t for t, _ in around], pa.string()), maps([a for _, a in around])], names=["tag", "attrs"])
    return [
        pa.array([piece * IN_PIECE + s for s in seq], pa.int64()), pa.array([before + n for n in line], pa.int32()), pa.array(tag, pa.string()), maps(attrs), pa.array(text, pa.string()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chain),
    ]


def over_files(files: DataFrame, read: Callable, more: T.StructType) -> DataFrame:
    """read(content, piece, before) yields lists of columns for each file; its other columns are repeated for them."""
    kept = [c for c in files.columns if c not in ("content", *PIECES)]
    given = [c for c in ("content", *PIECES) if c in files.columns]
    schema = T.StructType([*(files.schema[c] for c in kept), *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(kept)
            for k in range(batch.num_rows):
                content, *place = (batch.column(c)[k].as_py() for c in given)
                for columns in read(content, *(p or 0 for p in place)):
                    same = own.take(pa.array([k] * len(columns[0]), pa.int64())).columns
                    yield pa.RecordBatch.from_arrays([*same, *columns], names=schema.names)

    return files.select(*kept, *given).mapInArrow(run, schema)


def xml_nodes(files: DataFrame) -> DataFrame:
    """A row per element: the file's columns but its content and piece, and seq, line, tag, attrs, text, trail."""

    def read(content, piece=0, before=0):
        for nodes in closed(content, []):
            if before:  # the root stands in each piece; it counts in the first
                nodes = [n for n in nodes if n[5]]
            for at in range(0, len(nodes), ROWS):
                yield columns_of(nodes[at : at + ROWS], piece, before)

    return over_files(files, read, NODE)


def xml_errors(files: DataFrame) -> DataFrame:
    """path, severity, message of the files that can't be read to their end."""

    def read(content, piece=0, before=0):
        errors: list[str] = []
        for _ in closed(content, errors):
            pass
        yield [pa.array(["error"] * len(errors), pa.string()), pa.array(errors, pa.string())]

    return over_files(files.select("path", "content"), read, T.StructType().add("severity", "string").add("message", "string"))
