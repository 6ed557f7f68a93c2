"""JSON payload to typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import safe_bool, safe_int, safe_timestamp
from tidemark.session import compiled_methods


def _text_leaf(text: Column, payload: Column, path: str) -> Column:
    """The text of a scalar; NULL for an object or an array.

    The parser gives nested values as JSON text, which a message such as ``[WIP]``
    resembles.  Only a leaf that starts like one is looked up in the payload again.
    """
    found = F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "variant")
    is_string = F.to_json(found).startswith('"')
    return F.when(F.substring(text, 1, 1).isin("{", "["), F.when(is_string, text)).otherwise(text)


# Leaf kind -> column of the leaf's text, the payload and the path.  Numbers,
# flags and times need no look at the payload: no object text survives their cast.
LEAF_KINDS = {
    "text": _text_leaf,
    "int": lambda text, *_: safe_int(text),
    "bool": lambda text, *_: safe_bool(text),
    "timestamp": lambda text, *_: safe_timestamp(text),
    # A whole sub-object, kept as JSON text.
    "json": lambda text, *_: F.coalesce(text, F.lit("null")),
}


def payload_schema(paths: Iterable[str]) -> str:
    """DDL of the parsed payload: nested structs with a string at every path."""
    tree: dict = {}
    for path in paths:
        *parents, leaf = path.split(".")
        node = tree
        for step in parents:
            node = node.setdefault(step, {})
            if node is None:
                raise ValueError(f"{path}: {step} is also read as a leaf")
        if node.get(leaf) is not None:
            raise ValueError(f"{path} is also read as an object")
        node[leaf] = None

    def ddl(node: dict) -> str:
        fields = (f"`{name}`: {'string' if inner is None else ddl(inner)}" for name, inner in node.items())
        return f"struct<{', '.join(fields)}>"

    return ddl(tree)


def flatten_payload(
    df: DataFrame,
    leaves: Mapping[str, tuple[str, str]],
    payload: str = "data",
    keep: Sequence[str | Column] = (),
) -> DataFrame:
    """``keep`` columns, then one column per leaf ``name: (dotted path, kind)``.

    The payload is parsed once for all leaves, and Catalyst prunes the parser's
    schema down to the leaves a consumer really reads.
    """
    compiled_methods(df.sparkSession)
    schema = payload_schema(path for path, _ in leaves.values())
    kept = [F.col(c) if isinstance(c, str) else c for c in keep]
    data = F.col(payload)
    parsed = df.select(*kept, data.alias("_data"), F.from_json(data, schema).alias("_payload"))
    columns = []
    for name, (path, kind) in leaves.items():
        columns.append(LEAF_KINDS[kind](F.col(f"_payload.{path}"), F.col("_data"), path).alias(name))
    return parsed.select(*[F.col(f"`{name}`") for name in parsed.columns[: len(kept)]], *columns)
