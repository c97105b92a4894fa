"""The formats a channel may name, open to further ones, and a user's Arrow function as a chain step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.delimited import SPECS, Parsed, parse_delimited
from ..functions.trees import Tree, parse_tree


@dataclass(frozen=True)
class Codec:
    """A format.  ``parse(df, raw, out)`` adds a struct column with at least ``error``; ``view(col)`` gives accessors over it:
    ``get``, ``error`` and ``serialize`` at least, ``set`` for formats that are written, ``name`` (None once edited) and
    ``col`` for those."""

    name: str
    parse: Callable[[DataFrame, str, str], DataFrame]
    view: Callable[[str], object]


_CODECS: dict[str, Codec] = {}


def register(codec: Codec) -> Codec:
    """Add a format; a name that is taken is a ValueError."""
    if codec.name in _CODECS:
        raise ValueError(f'duplicate registration of data type "{codec.name}"')
    _CODECS[codec.name] = codec
    return codec


def unregister(name: str) -> None:
    _CODECS.pop(name)


def names() -> list[str]:
    return sorted(_CODECS)


def codec(name: str) -> Codec:
    if name not in _CODECS:
        raise ValueError(f'unknown data type "{name}" (registered: {names()})')
    return _CODECS[name]


for _spec in SPECS.values():
    register(Codec(_spec.name, lambda df, raw, out, s=_spec: parse_delimited(df, s, raw, out), lambda col, s=_spec: Parsed(col, s)))
for _fmt in ("csv", "json", "xml"):
    register(Codec(_fmt, lambda df, raw, out, f=_fmt: parse_tree(df, f, raw, out), lambda col, f=_fmt: Tree(col, f)))


class ArrowText:
    """What a translator returns to build the new message with a function over Arrow batches.

    ``fn(batch)`` gets a RecordBatch of the named columns and gives as many texts of ``data_type``.  A batch that raises is
    tried row by row, so a failure stops its own message alone and its text becomes the message's error."""

    def __init__(self, fn: Callable[[pa.RecordBatch], object], data_type: str, **columns: Column):
        self.data_type, self.columns = codec(data_type).name, columns
        self.fn = fn

    def result(self) -> Column:
        """STRUCT<text, error>."""
        fn, kind = self.fn, pa.struct([("text", pa.string()), ("error", pa.string())])

        def texts(batch: pa.RecordBatch) -> list:
            got = fn(batch)
            got = got.to_pylist() if isinstance(got, (pa.Array, pa.ChunkedArray)) else list(got)
            if len(got) != batch.num_rows:
                raise ValueError(f"{len(got)} texts for {batch.num_rows} messages")
            return got

        def run(rows: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_struct_array(rows)
            try:
                out = [(t, None) for t in texts(batch)]
            except Exception:
                out = []
                for i in range(batch.num_rows):
                    try:
                        out.append((texts(batch.slice(i, 1))[0], None))
                    except Exception as e:
                        out.append((None, f"{type(e).__name__}: {e}"))
            return pa.array([{"text": t, "error": e} for t, e in out], kind)

        run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, returnType="struct<text:string,error:string>")(F.struct(*(c.alias(n) for n, c in self.columns.items())))
