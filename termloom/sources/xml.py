"""String tables in XML: read, and written to a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.strings import coalesce_id

_SCHEMA = "_EDID string, _id string, EDID array<string>, Source array<string>, Dest array<string>"


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, id, source, dest) of every ``<String>`` with a Source; first child of a kind counts.

    ``row_idx`` follows the order of the document within a file. A String
    inside a String isn't seen on its own; child markup of a text is kept as
    text. Missing texts are empty.
    """
    raw = spark.read.format("xml").schema(_SCHEMA).options(rowTag="String", ignoreSurroundingSpaces="false", nullValue="\u0000").load(path)
    first = lambda c: F.get(F.col(c), F.lit(0))
    return raw.filter(F.size("Source") > 0).select(
        F.monotonically_increasing_id().alias("row_idx"),
        coalesce_id(F.col("_EDID"), first("EDID"), F.col("_id")).alias("id"),
        F.coalesce(first("Source"), F.lit("")).alias("source"), F.coalesce(first("Dest"), F.lit("")).alias("dest"),
    )


def write_strings(rows: DataFrame, path: str) -> None:
    """Rows (id, source, dest) as XML parts in a new folder; an existing one is refused."""
    out = rows.select(F.col("id").alias("_EDID"), F.coalesce("source", F.lit("")).alias("Source"), F.coalesce("dest", F.lit("")).alias("Dest"))
    out.write.format("xml").options(rowTag="String", rootTag="Content", declaration='version="1.0" encoding="UTF-8"').mode("error").save(path)


_DOC = "path string, nth bigint, id string, source string, dest string"


def _strings(content: bytes):
    """The tree of a file and its String elements with a Source, in order, at any depth."""
    from xml.etree import ElementTree as ET

    root = ET.fromstring(content, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))
    return root, [e for e in root.iter("String") if e.find("Source") is not None]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, id, source, dest) of every ``<String>`` at any depth, one inside another too, file by file.

    Files are trees, so each is read whole by one task; a file that isn't
    well formed gives no row. ``nth`` counts the rows of a file from 0.
    """

    def run(batches):
        import pandas as pd
        from xml.etree.ElementTree import ParseError

        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    found = _strings(bytes(content))[1]
                except ParseError:
                    continue
                for n, e in enumerate(found):
                    child = e.findtext("EDID") or None
                    key = e.get("EDID") if e.get("EDID") is not None else child or e.get("id") or ""
                    rows.append((p, n, key, e.findtext("Source") or "", e.findtext("Dest") or ""))
            yield pd.DataFrame(rows, columns=["path", "nth", "id", "source", "dest"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _DOC)


def write_documents(spark: SparkSession, path: str, done: DataFrame, out: str) -> DataFrame:
    """Every file of ``path`` written to the new folder ``out`` with the ``dest`` of ``done`` (path, nth, dest); all other nodes stay.

    Gives (path, n) of the rows written, when it is computed: an action
    writes the files, and a repeated task writes the same bytes again. A
    missing Dest is added; null texts count as empty.
    """
    import pandas as pd

    def one(key, files: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        import os
        from urllib.parse import unquote
        from xml.etree import ElementTree as ET

        if not len(files):
            return pd.DataFrame({"path": pd.Series(dtype=str), "n": pd.Series(dtype="int64")})
        root, found = _strings(bytes(files["content"].iloc[0]))
        for n, text in zip(rows["nth"], rows["dest"]):
            e = found[n].find("Dest")
            if e is None:
                e = ET.SubElement(found[n], "Dest")
            e.text = text if isinstance(text, str) else ""
        os.makedirs(out, exist_ok=True)
        to = os.path.join(out, unquote(os.path.basename(key[0])))
        ET.ElementTree(root).write(to + ".part", encoding="utf-8", xml_declaration=True)
        os.replace(to + ".part", to)
        return pd.DataFrame({"path": [to], "n": [len(rows)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.groupBy("path").cogroup(done.select("path", "nth", "dest").groupBy("path")).applyInPandas(one, "path string, n bigint")
