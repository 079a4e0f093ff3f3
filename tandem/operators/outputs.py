"""Files for graph tools. CSV is streamed row by row; the lines of GraphML are made and packed in tasks, and the driver unpacks them in order."""

from __future__ import annotations

import csv
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from . import graph
from .lines import write_lines


def _csv(df: DataFrame, path: str) -> None:
    """Every field quoted, null as an empty one; rows reach the driver a partition at a time."""
    with Path(path).open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])


def write_edge_csv(network: DataFrame, edge_type: str, path: str, loops: bool = False) -> None:
    """source,target,weight,edge_type in the order of the accounts."""
    e = graph.edges(network, edge_type, loops).orderBy("user_1", "user_2")
    _csv(e.withColumnsRenamed({"user_1": "source", "user_2": "target"}), path)


def write_node_csv(messages: DataFrame, path: str, n_messages: int = 10) -> None:
    """Id,username,message_0..., every account that wrote anything."""
    _csv(graph.nodes(messages, n_messages).withColumnRenamed("user_id", "Id").orderBy("Id"), path)


_KINDS = {"bigint": "long", "string": "string", "double": "double"}


def write_graphml(network: DataFrame, edge_type: str, messages: DataFrame, path: str, loops: bool = False, n_messages: int = 10) -> None:
    """A directed GraphML file; attributes that are null are left out. Neither table is held whole. The edges are stored first,
    since ordering them and finding the nodes read them several times."""
    stored = written(network if loops else network.where("user_1 <> user_2"), "edges")
    e, n = graph.graph(stored, edge_type, messages, loops, n_messages)
    keys = [(f"n{i}", "node", c, t) for i, (c, t) in enumerate(n.dtypes[1:])] + [(f"e{i}", "edge", c, t) for i, (c, t) in enumerate(e.dtypes[2:])]
    data = lambda of: [_data(i, F.col(c)) for i, kind, c, _ in keys if kind == of]
    node = F.concat(F.lit("    <node id="), _attribute(F.col("user_id")), F.lit(">"), *data("node"), F.lit("</node>\n"))
    edge = F.concat(F.lit("    <edge source="), _attribute(F.col("user_1")), F.lit(" target="), _attribute(F.col("user_2")), F.lit(">"), *data("edge"), F.lit("</edge>\n"))
    with Path(path).open("wb") as f:
        f.write(b'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for i, of, c, t in keys:
            f.write(f'  <key id="{i}" for="{of}" attr.name={quoteattr(c)} attr.type="{_KINDS[t]}"/>\n'.encode())
        f.write(b'  <graph edgedefault="directed">\n')
        write_lines(n.orderBy("user_id").select(node.alias("line")), f)
        write_lines(e.orderBy("user_1", "user_2").select(edge.alias("line")), f)
        f.write(b"  </graph>\n</graphml>\n")
    forget(stored)


def _replaced(s: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def _clean(value: Column) -> Column:
    """Text without the control characters that XML can't hold, escaped."""
    s = value.cast("string")
    clean = F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(s.rlike(r"[&<>\x00-\x1f]"), _replaced(clean, ("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"))).otherwise(s)


def _attribute(value: Column) -> Column:
    """A quoted attribute. A null account is None."""
    s = _clean(F.coalesce(value.cast("string"), F.lit("None")))
    flat = _replaced(s, ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))
    single = F.concat(F.lit("'"), flat, F.lit("'"))
    double = F.concat(F.lit('"'), _replaced(flat, ('"', "&quot;")), F.lit('"'))
    return F.when(s.rlike(r"[\n\r\t\"]"), F.when(flat.contains('"') & ~flat.contains("'"), single).otherwise(double)).otherwise(F.concat(F.lit('"'), s, F.lit('"')))


def _data(key: str, value: Column) -> Column:
    """The element of an attribute, nothing where it is null."""
    return F.coalesce(F.concat(F.lit(f'<data key="{key}">'), _clean(value), F.lit("</data>")), F.lit(""))


def write_output(network: DataFrame, edge_type: str, messages: DataFrame, path: str, output_type: str = "csv", loops: bool = False, n_messages: int = 10) -> None:
    if output_type == "csv":
        write_edge_csv(network, edge_type, path, loops)
    elif output_type == "graphml":
        write_graphml(network, edge_type, messages, path, loops, n_messages)
    else:
        raise ValueError("the output type must be csv or graphml")
